"""Cost-balanced packing: token pieces into sequences that take about the same time, without padding.

What a piece costs is estimated as a linear and a quadratic part of its length (attention stays inside a document). Pieces
are dealt into groups of bounded size. A group's tokens fix its sequences beforehand: as many of full length as there
are, and for the rest one of each power of two, which is no padding either. Pieces go, most expensive first, to the
sequence of least cost that still has room for them. When none has, the piece is cut: the sequence of least cost with any
room left takes what it can, and the rest of the piece waits for its turn. Every cut fills a sequence, so there are
fewer cuts than sequences, and in the end every sequence is full.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.chunkids import CALL_BYTES
from tallyloom.llm.frames import arrow_map
from tallyloom.llm.textbatch import Texts
from tallyloom.llm.tokens import crc, encoder, with_end
from tallyloom.session import written

#: Pieces per group: enough for even costs, few enough for one task.
GROUP = 16_384


@dataclass(frozen=True)
class Cost:
    """Estimated cost of a piece of n tokens: linear * n + quadratic * n * n."""

    linear: float = 1.0
    quadratic: float = 1 / 1024

    def __call__(self, n):
        return self.linear * n + self.quadratic * n * n


def sequence_sizes(tokens: int, capacity: int) -> np.ndarray:
    """Lengths of sequences that ``tokens`` fill without padding: full ones, then falling powers of two."""
    rest = tokens % capacity
    return np.array([capacity] * (tokens // capacity) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1], np.int64)


def assign(lengths: np.ndarray, capacity: int, cost: Cost = Cost()) -> np.ndarray:
    """Where the pieces of one group go: rows of (piece, start in the piece, length, sequence, offset)."""
    room = sequence_sizes(int(lengths.sum()), capacity)
    full, spent = room.copy(), np.zeros(len(room))
    waiting = [(-n, i, 0) for i, n in enumerate(lengths.tolist()) if n]
    heapq.heapify(waiting)
    out = []
    while waiting:
        n, piece, start = heapq.heappop(waiting)
        n = -n
        can = room >= n
        if not can.any():
            can = room > 0
        k = int(np.where(can, spent, np.inf).argmin())
        taken = min(n, int(room[k]))
        out.append((piece, start, taken, k, int(full[k] - room[k])))
        room[k] -= taken
        spent[k] += cost(taken)
        if taken < n:
            heapq.heappush(waiting, (taken - n, piece, start + taken))
    return np.array(out, np.int64).reshape(-1, 5)


def pieces(
    docs: DataFrame, tokenizer: str, cut: str, end_id: int, capacity: int, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: id, start, length, ids (bytes, little-endian, of as many bytes as the
    vocabulary needs), doc_tokens. Null texts are empty: one piece with the end id."""
    kind = docs.schema[id_column].dataType.simpleString()

    def each(batch: pa.RecordBatch):
        encode = encoder(tokenizer, cut)
        for first, end, texts in Texts.from_arrow(batch.column(1)).slices(CALL_BYTES):
            flat, sizes = with_end(*encode(texts), end_id)
            made = -(-sizes // capacity)
            owner = np.repeat(np.arange(len(sizes)), made)
            start = capacity * (np.arange(len(owner)) - np.repeat(np.cumsum(made) - made, made))
            length = np.minimum(capacity, sizes[owner] - start)
            width = flat.dtype.itemsize
            data = flat.astype(flat.dtype.newbyteorder("<")).tobytes()
            begin = ((np.cumsum(sizes) - sizes)[owner] + start) * width
            yield {
                id_column: batch.column(0).slice(first, end - first).take(pa.array(owner)), "start": start, "length": length,
                "ids": pa.array([data[a : a + n] for a, n in zip(begin.tolist(), (length * width).tolist())], pa.binary()),
                "doc_tokens": sizes[owner],
            }

    return arrow_map(docs, [id_column, text], each, f"`{id_column}` {kind}, start long, length long, ids binary, doc_tokens long")


def _wide(ids: bytes, length: int) -> np.ndarray:
    return np.frombuffer(ids, f"<u{len(ids) // length}").astype("<u4")


def pack(
    docs: DataFrame, tokenizer: str, cut: str, end_id: int, capacity: int = 1024, cost: Cost = Cost(), group: int = GROUP,
    id_column: str = "doc_id", text: str = "text", with_ids: bool = True,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, on request, ids (little-endian
    unsigned 32-bit).

    Sequences of ``capacity`` tokens (a power of two) are full; the others, at most log2(capacity) per group, are full at a
    power of two. Texts are encoded once, and their pieces written. A piece of full length is a sequence of its own and takes
    no part in the shuffle; the others are dealt into groups by row, so no id or length makes a group large.
    Null and empty texts are the end id alone. Rows that share an id, null ids included, are documents of their own: only
    their sequence tells their pieces apart. Other columns are ignored; an empty table gives no rows.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity of a sequence is a power of two")
    cut_rows = pieces(docs, tokenizer, cut, end_id, capacity, id_column, text)
    placed = written(cut_rows.withColumn("__row", F.monotonically_increasing_id()), "balanced-pieces")
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    schema += ", ids binary" * with_ids

    def row_columns(ids: pa.Array, parts: dict[str, np.ndarray], made: list[np.ndarray]) -> dict[str, pa.Array]:
        out = {
            id_column: ids, "start": parts["start"], "length": parts["length"], "ids_crc32": np.array([crc(x) for x in made], np.int64),
            "doc_tokens": parts["doc_tokens"], "sequence_id": parts["sequence"], "offset": parts["offset"],
        }
        if with_ids:
            out["ids"] = pa.array([x.tobytes() for x in made], pa.binary())
        return {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in out.items()}

    def whole(batch: pa.RecordBatch):
        start, length, row, tokens = (batch.column(i).to_numpy() for i in (1, 2, 3, 4))
        made = [_wide(x, capacity) for x in batch.column(5).to_pylist()]
        # groups number their sequences from 2^32 on each; these lie behind all of them
        parts = {"start": start, "length": length, "doc_tokens": tokens, "sequence": row + (1 << 62), "offset": np.zeros_like(row)}
        yield row_columns(batch.column(0), parts, made)

    def one(part: pa.Table) -> pa.Table:
        part = part.sort_by("__row").combine_chunks()
        start, length, tokens = (part[c].to_numpy() for c in ("start", "length", "doc_tokens"))
        data = part["ids"].to_pylist()
        where = assign(length, capacity, cost)
        piece, inside, taken, sequence, offset = where.T
        made = [_wide(data[i], int(length[i]))[a : a + n] for i, a, n in zip(piece.tolist(), inside.tolist(), taken.tolist())]
        first = int(part["__group"][0].as_py()) << 32
        parts = {"start": start[piece] + inside, "length": taken, "doc_tokens": tokens[piece], "sequence": sequence + first, "offset": offset}
        ids = part[id_column].combine_chunks() if part.num_rows else part[id_column]
        return pa.table(row_columns(ids.take(pa.array(piece)), parts, made))

    rest = placed.where(F.col("length") < capacity)
    groups = max(1, math.ceil(rest.count() / group))
    rest = rest.withColumn("__group", F.pmod(F.xxhash64("__row"), F.lit(groups)).cast("int"))
    packed = rest.groupBy("__group").applyInArrow(one, schema)
    full = arrow_map(placed.where(F.col("length") == capacity), [id_column, "start", "length", "__row", "doc_tokens", "ids"], whole, schema)
    return packed.unionByName(full)
