"""Whole texts as flat byte arrays: word spans, hashes and code point positions for one Arrow batch.

Every function works on all texts of a batch at once with numpy, so a task needs a few array passes
per batch and no loop over words. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.default_rng(20240607)
#: One random number per byte; A-Z share the numbers of a-z in the folded table.
BYTE_KEYS = _RNG.integers(1, 2**64 - 1, 256, dtype=U64) | U64(1)
FOLDED_KEYS = BYTE_KEYS.copy()
FOLDED_KEYS[65:91] = BYTE_KEYS[97:123]
_RADIX = U64(0x9E3779B97F4A7C15 | 1)
_RADIX_INVERSE = U64(pow(int(_RADIX), -1, 2**64))
#: Space and the control characters 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes per slice of a batch; bounds the working arrays of a task whatever the batch holds.
SLICE_BYTES = 1 << 20

_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_RADIX, _RADIX_INVERSE)):
            steps = np.full(n, base, U64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=U64)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over the word."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


class Texts:
    """The bytes of several texts one after another: text i is data[offsets[i]:offsets[i + 1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    @classmethod
    def of(cls, texts: list[str | None]) -> "Texts":
        return cls.from_arrow(pa.array(texts, pa.string()))

    @classmethod
    def from_arrow(cls, column: pa.Array) -> "Texts":
        if column.null_count:
            column = column.fill_null("")
        wide = pa.types.is_large_string(column.type)
        _, places, data = column.buffers()
        offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
        offsets = offsets.astype(np.int64)
        if data is None:
            return cls(np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64))
        return cls(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0])

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode("utf-8")

    def owner(self, starts: np.ndarray) -> np.ndarray:
        """The text that each byte position lies in."""
        return np.searchsorted(self.offsets, starts, "right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Byte starts and ends of the maximal runs without white space, in order."""
        return self._runs(~SPACE[self.data])

    def _runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(inside)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.concatenate(([False], inside[:-1]))
        after = np.concatenate((inside[1:], [False]))
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends

    def hashes(self, starts: np.ndarray, ends: np.ndarray, folded: bool = False) -> np.ndarray:
        """A 64-bit hash of each byte range; ``folded`` takes A-Z as a-z."""
        keys = FOLDED_KEYS if folded else BYTE_KEYS
        up, down = _power_tables(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, U64)
        np.cumsum(keys[self.data] * up[:-1], dtype=U64, out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))

    def chars_before(self) -> np.ndarray:
        """For each byte position, the code points that start before it within the whole batch."""
        out = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=out[1:])
        return out

    def slices(self, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, "Texts"]]:
        """Consecutive texts (first, end, Texts) of about ``most`` bytes each; a longer text stays whole."""
        first = 0
        while first < len(self):
            end = int(np.searchsorted(self.offsets, self.offsets[first] + most, "right")) - 1
            end = max(end, first + 1)
            a, b = self.offsets[first], self.offsets[end]
            yield first, end, Texts(self.data[a:b], self.offsets[first : end + 1] - a)
            first = end


def shingles(words: np.ndarray, counts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` word hashes, and how many each text has; a shorter text with words has its
    whole sequence as one.

    ``counts`` has the number of words per text.
    """
    n = len(words)
    ends = np.cumsum(counts)
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    if n == 0:
        return np.zeros(0, U64), made
    factor = U64(0xA24BAED4963EE407)
    span = max(n - size + 1, 0)
    full = np.zeros(span, U64)
    for j in range(size):
        full = full * factor + words[j : j + span]
    full = mix(full)
    # a run that starts in the last size - 1 words of a text would cross into the next text
    left = np.repeat(ends, counts) - np.arange(n)
    keep = left >= size
    hashes = np.zeros(n, U64)
    hashes[:span] = full
    short = np.flatnonzero((counts > 0) & (counts < size))
    for i in short:
        acc = U64(counts[i])
        with np.errstate(over="ignore"):
            for w in words[ends[i] - counts[i] : ends[i]]:
                acc = acc * factor + w
        keep[ends[i] - counts[i]] = True
        hashes[ends[i] - counts[i]] = mix(np.array([acc ^ U64(0x5851F42D4C957F2D)], U64))[0]
    return hashes[keep], made
