"""Wavelet matrix over token ids: succinct bit planes with rank and select, in one compressed file.

File layout (little-endian): magic, JSON header length, JSON header, then zstandard frames. Each bit plane is cut into
blocks of BLOCK bits; every block is a frame of its own, and the header's directory has its place and the ones before
it. Access, rank and select therefore decompress one block per plane; decoding everything reads each block once.
The documents' ids and token counts are in two frames of their own.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import zstandard

MAGIC = b"WMTOK001"
#: Bits per block of a plane; a multiple of 8.
BLOCK = 1 << 18


def build(ids: np.ndarray, doc_ids: list[int | None], counts: np.ndarray, bits: int = 16) -> bytes:
    """The file of one shard: ``ids`` of consecutive documents, whose ids and token counts go with them."""
    squeeze = zstandard.ZstdCompressor(level=1, write_content_size=True)
    frames: list[bytes] = []
    place = 0

    def put(raw: bytes) -> list[int]:
        nonlocal place
        frames.append(squeeze.compress(raw))
        place += len(frames[-1])
        return [place - len(frames[-1]), len(frames[-1])]

    seq = np.asarray(ids).astype(np.uint32 if bits > 16 else np.uint16)
    planes = []
    for level in range(bits):
        bit = (seq >> (bits - 1 - level)) & 1 == 1
        packed = np.packbits(bit, bitorder="little")
        blocks, ones = [], 0
        for a in range(0, len(packed), BLOCK // 8):
            part = packed[a : a + BLOCK // 8]
            blocks.append([*put(part.tobytes()), ones])
            ones += int(np.bitwise_count(part).sum())
        planes.append({"zeros": len(seq) - ones, "blocks": blocks})
        seq = np.concatenate((seq[~bit], seq[bit]))
    known = np.array([x is not None for x in doc_ids], bool)
    docs = np.array([x if x is not None else 0 for x in doc_ids], np.int64)
    head = {
        "n": len(ids), "bits": bits, "block": BLOCK, "planes": planes, "doc_ids": put(docs.tobytes()),
        "known": put(np.packbits(known).tobytes()), "counts": put(np.asarray(counts, np.int64).tobytes()), "docs": len(docs),
    }
    text = json.dumps(head, separators=(",", ":")).encode()
    return MAGIC + len(text).to_bytes(8, "little") + text + b"".join(frames)


class WaveletMatrix:
    """Reads one shard. ``fetch(start, length)`` returns bytes of the file, so a remote file needs no full read."""

    def __init__(self, fetch: Callable[[int, int], bytes]):
        start = fetch(0, 16)
        if start[:8] != MAGIC:
            raise ValueError("not a token file")
        size = int.from_bytes(start[8:16], "little")
        self.head = json.loads(fetch(16, size))
        self.base, self.fetch = 16 + size, fetch
        self.n, self.bits = self.head["n"], self.head["bits"]
        self.kept: dict[tuple[int, int], np.ndarray] = {}

    @classmethod
    def of(cls, data: bytes) -> "WaveletMatrix":
        return cls(lambda start, length: data[start : start + length])

    def _frame(self, place: list[int]) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.fetch(self.base + place[0], place[1]))

    def _block(self, level: int, k: int) -> np.ndarray:
        if (level, k) not in self.kept:
            if len(self.kept) >= 64:
                self.kept.pop(next(iter(self.kept)))
            self.kept[level, k] = np.frombuffer(self._frame(self.head["planes"][level]["blocks"][k]), np.uint8)
        return self.kept[level, k]

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        blocks = self.head["planes"][level]["blocks"]
        k = min(i // self.head["block"], len(blocks) - 1)
        if k < 0:
            return 0
        inside = i - k * self.head["block"]
        block = self._block(level, k)
        whole = int(np.bitwise_count(block[: inside // 8]).sum())
        if inside % 8:
            whole += (int(block[inside // 8]) & ((1 << inside % 8) - 1)).bit_count()
        return blocks[k][2] + whole

    def _bit(self, level: int, i: int) -> int:
        block = self._block(level, i // self.head["block"])
        i %= self.head["block"]
        return int(block[i // 8]) >> (i % 8) & 1

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value = value << 1 | bit
            i = self.head["planes"][level]["zeros"] + ones if bit else i - ones
        return value

    def _range(self, token: int, a: int, b: int) -> tuple[int, int]:
        for level in range(self.bits):
            x, y = self._ones(level, a), self._ones(level, b)
            if token >> (self.bits - 1 - level) & 1:
                zeros = self.head["planes"][level]["zeros"]
                a, b = zeros + x, zeros + y
            else:
                a, b = a - x, b - y
        return a, b

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        """How often a token occurs at places a to b (exclusive)."""
        if token >> self.bits or token < 0:
            return 0
        x, y = self._range(token, max(a, 0), self.n if b is None else min(b, self.n))
        return max(y - x, 0)

    rank = count

    def select(self, token: int, k: int) -> int:
        """The place of occurrence k (from 0) of a token; -1 if there are fewer."""
        if token >> self.bits or token < 0 or k < 0:
            return -1
        first, last = self._range(token, 0, self.n)
        if k >= last - first:
            return -1
        i = first + k
        for level in reversed(range(self.bits)):
            zeros = self.head["planes"][level]["zeros"]
            bit = token >> (self.bits - 1 - level) & 1
            i = self._place(level, bit, i - zeros if bit else i)
        return i

    def _place(self, level: int, bit: int, k: int) -> int:
        """The place of one or zero number k in a plane."""
        blocks, size = self.head["planes"][level]["blocks"], self.head["block"]
        before = [x[2] if bit else j * size - x[2] for j, x in enumerate(blocks)]
        j = int(np.searchsorted(before, k, "right")) - 1
        flags = np.unpackbits(self._block(level, j), bitorder="little")
        return j * size + int(np.flatnonzero(flags == bit)[k - before[j]])

    def occurrences(self, token: int) -> list[int]:
        """All places of a token, in order."""
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All tokens in order; every plane is read once."""
        values = np.zeros(self.n, np.uint32 if self.bits > 16 else np.uint16)
        for level in reversed(range(self.bits)):
            plane = self.head["planes"][level]
            packed = b"".join(self._frame(x) for x in plane["blocks"])
            bit = np.unpackbits(np.frombuffer(packed, np.uint8), count=self.n, bitorder="little").view(bool)
            before = np.empty_like(values)
            before[~bit] = values[: plane["zeros"]]
            before[bit] = values[plane["zeros"] :] | values.dtype.type(1 << (self.bits - 1 - level))
            values = before
        return values

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Ids and token counts of the shard's documents, in order."""
        n = self.head["docs"]
        known = np.unpackbits(np.frombuffer(self._frame(self.head["known"]), np.uint8), count=n).astype(bool)
        ids = np.frombuffer(self._frame(self.head["doc_ids"]), np.int64)
        return [int(x) if k else None for x, k in zip(ids, known)], np.frombuffer(self._frame(self.head["counts"]), np.int64)
