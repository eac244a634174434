"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

At each end position the automaton yields, over its output links, every piece that ends there (longest first); each
relaxes the best score of that position. Characters outside the vocabulary fall back to bytes. The result is the
segmentation with the largest sum of piece scores; on equal sums the longer last piece wins at each position. No piece
holds a blank after another character, so a run of blanks always starts a piece, and repeated chunks between such
places are encoded once.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyloom.llm.chunkids import CALL_BYTES, ChunkEncoder, before_blank, flat
from tallyloom.llm.frames import arrow_map
from tallyloom.llm.textbatch import Texts

#: Fixed value of the format: the sign that stands for a blank inside pieces.
BLANK = "▁"
#: Fixed value of the format: what an unknown character costs below the worst piece.
UNKNOWN_COST = 10.0


class PieceModel:
    """Pieces with scores; ``byte_ids`` has the id of each of the 256 byte pieces, or None without them."""

    def __init__(self, pieces: list[tuple[int, str, float]], byte_ids: list[int] | None, unknown: int):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for number, piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), number, score))
        self.automaton.make_automaton()
        self.single = {piece for _, piece, _ in pieces if len(piece) == 1}
        self.byte_ids, self.unknown = byte_ids, unknown
        self.floor = min((s for _, _, s in pieces), default=0.0) - UNKNOWN_COST
        self.bytes_of = {number: piece.replace(BLANK, " ").encode() for number, piece, _ in pieces}
        if byte_ids:
            self.bytes_of |= {number: bytes([b]) for b, number in enumerate(byte_ids)}
        self.bytes_of[unknown] = " ⁇ ".encode()

    @classmethod
    def load(cls, path: str) -> "PieceModel":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids = [], [0] * 256
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                byte_ids[int(model.id_to_piece(i)[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces.append((i, model.id_to_piece(i), model.get_score(i)))
        return cls(pieces, byte_ids if any(byte_ids) else None, model.unk_id())

    def encode(self, text: str) -> list[int]:
        """Ids of ``text``, whose blanks are already BLANK."""
        n = len(text)
        best = [0.0] + [-math.inf] * n
        back = [(0, 0)] * (n + 1)
        done = 0  # positions up to here have their final score
        for last, (size, number, score) in self.automaton.iter(text):
            while done < last:
                done += 1
                self._unknown(text, best, back, done)
            found = best[last + 1 - size] + score
            if found > best[last + 1]:
                best[last + 1], back[last + 1] = found, (size, number)
        while done < n:
            done += 1
            self._unknown(text, best, back, done)
        out: list[int] = []
        at = n
        while at:
            size, number = back[at]
            if number >= 0:
                out.append(number)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in reversed(text[at - 1].replace(BLANK, " ").encode())]
            else:
                out.append(self.unknown)
            at -= size
        return out[::-1]

    def _unknown(self, text: str, best: list[float], back: list[tuple[int, int]], end: int) -> None:
        """Relaxes the edge of one character that is no piece itself."""
        if text[end - 1] not in self.single and best[end - 1] + self.floor > best[end]:
            best[end], back[end] = best[end - 1] + self.floor, (1, -1)

    def encode_text(self, text: str) -> list[int]:
        """Ids of a whole plain text: a blank goes in front, blanks become BLANK; an empty text has no ids."""
        return self.encode((" " + text).replace(" ", BLANK)) if text else []

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 bytes of ids without the blank in front."""
        made = b"".join(map(self.bytes_of.__getitem__, ids))
        return made[1:] if made[:1] == b" " else made


@lru_cache(maxsize=2)
def _loaded(path: str) -> tuple[PieceModel, ChunkEncoder]:
    model = PieceModel.load(path)

    def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return flat([model.encode(x.replace(" ", BLANK)) for x in chunks])

    return model, ChunkEncoder(before_blank, encode)


def _prefixed(texts: Texts) -> Texts:
    """Puts a blank in front of every text that isn't empty."""
    sizes = np.diff(texts.offsets)
    full = sizes > 0
    data = np.insert(texts.data, texts.offsets[:-1][full], 32)
    return Texts(data, np.concatenate(([0], np.cumsum(sizes + full))))


def encode(docs: DataFrame, model_path: str, id_column: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids), decoded_crc32 (of the
    decoded UTF-8 text), same_text (decoding gives the text back) and, on request, ids (array of int).

    Null texts count as empty: no ids, and crc32 of nothing. A text that holds BLANK itself decodes to a blank there,
    as the format can't tell them apart. Repeated ids stay separate rows.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def each(batch: pa.RecordBatch):
        model, encoder = _loaded(model_path)
        for first, end, texts in Texts.from_arrow(batch.column(1)).slices(CALL_BYTES):
            flat, sizes = encoder(_prefixed(texts))
            ends = np.cumsum(sizes)
            wide = flat.astype("<u4")
            crcs, back, same = [], [], []
            for i, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist())):
                crcs.append(zlib.crc32(wide[a:b].tobytes()))
                made = model.decode(flat[a:b].tolist())
                back.append(zlib.crc32(made))
                same.append(made == texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes())
            out = {
                id_column: batch.column(0).slice(first, end - first), "n_tokens": sizes,
                "ids_crc32": pa.array(crcs, pa.int64()), "decoded_crc32": pa.array(back, pa.int64()), "same_text": pa.array(same, pa.bool_()),
            }
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(np.concatenate(([0], ends)).astype(np.int32), flat.astype(np.int32))
            yield out

    schema = f"`{id_column}` {kind}, n_tokens long, ids_crc32 long, decoded_crc32 long, same_text boolean" + ", ids array<int>" * with_ids
    return arrow_map(docs, [id_column, text], each, schema)


def decode(rows: DataFrame, model_path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``rows`` with ``text`` decoded from the array ``ids``; null ids give null. Bytes that aren't UTF-8 become
    replacement characters."""
    names = [c for c in rows.columns if c != text]
    at = names.index(ids)

    def each(batch: pa.RecordBatch):
        model, _ = _loaded(model_path)
        made = [None if x is None else model.decode(x).decode("utf-8", "replace") for x in batch.column(at).to_pylist()]
        yield {n: batch.column(i) for i, n in enumerate(names)} | {text: pa.array(made, pa.string())}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text) + f", `{text}` string"
    return arrow_map(rows, names, each, schema)
