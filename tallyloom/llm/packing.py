"""Vector best-fit packing of token pieces into sequences.

Every document becomes pieces of at most ``capacity`` tokens. Pieces are dealt into groups of bounded size; each group
is packed in one task, longest piece first. A sequence has residual tokens, document count and attention cost (sum of
squared piece lengths); a piece may go where all three suffice, and of those sequences the one with the smallest
weighted residual norm after placing it (or the largest weighted dot product before) takes it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.chunkids import CALL_BYTES
from tallyloom.llm.frames import arrow_map
from tallyloom.llm.textbatch import Texts
from tallyloom.llm.tokens import crc, encoder, with_end
from tallyloom.session import written

#: Pieces per group: large enough that the last open sequences of a group don't count, small enough for one task.
GROUP = 16_384


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence, weights of the three dimensions, and the rule that ranks sequences.

    With the default document and attention limits only tokens bind: a sequence of 4096 tokens can't hold more than
    4096 pieces or cost more than 4096 squared.
    """

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"


def best_fit(lengths: np.ndarray, limits: Limits = Limits()) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece of one group.

    A piece that alone exceeds the attention limit still gets a sequence of its own.
    """
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    caps = np.array([limits.tokens, limits.documents, limits.attention], float)
    weights = np.array(limits.weights)
    size = max(n, 1)
    left = np.zeros((3, size))
    number = np.zeros(size, np.int64)
    opened = used = 0
    order = np.argsort(-lengths, kind="stable")
    least = int(lengths.min()) if n else 0
    for i in order.tolist():
        length = int(lengths[i])
        need = np.array([length / caps[0], 1 / caps[1], length * length / caps[2]])
        room = left[:, :opened]
        fits = (room[0] >= need[0] - 1e-12) & (room[1] >= need[1] - 1e-12) & (room[2] >= need[2] - 1e-12)
        can = np.flatnonzero(fits)
        if len(can):
            at = room[:, can]
            if limits.rule == "dot":
                k = int(can[np.argmax((weights * need) @ at)])
            else:
                rest = at - need[:, None]
                k = int(can[np.argmin(weights @ (rest * rest))])
        else:
            k = opened
            left[:, k] = 1.0
            number[k] = used
            opened, used = opened + 1, used + 1
        bins[i] = number[k]
        offsets[i] = round((1.0 - left[0, k]) * caps[0])
        left[:, k] -= need
        if left[0, k] * caps[0] < least - 0.5 or left[1, k] < 1 / caps[1] - 1e-12:
            # a full sequence leaves the open ones
            opened -= 1
            left[:, k], number[k] = left[:, opened], number[opened]
    return bins, offsets


def pieces(
    docs: DataFrame, tokenizer: str, cut: str, end_id: int, capacity: int, id_column: str = "doc_id",
    text: str = "text", with_ids: bool = True,
) -> DataFrame:
    """The pieces of every document: id, piece, start, length, ids_crc32 and, on request, the ids (uint32 bytes).

    Only documents longer than ``capacity`` are cut; the last piece may be shorter. Null texts are empty: one piece
    with the end id. Rows that share an id are packed as documents of their own.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def each(batch: pa.RecordBatch):
        encode = encoder(tokenizer, cut)
        for first, end, texts in Texts.from_arrow(batch.column(1)).slices(CALL_BYTES):
            flat, sizes = with_end(*encode(texts), end_id)
            made = -(-sizes // capacity)
            owner = np.repeat(np.arange(len(sizes)), made)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(made) - made, made)
            length = np.minimum(capacity, sizes[owner] - number * capacity)
            begin = (np.cumsum(sizes) - sizes)[owner] + number * capacity
            cuts = [flat[a : a + n] for a, n in zip(begin.tolist(), length.tolist())]
            out = {
                id_column: batch.column(0).slice(first, end - first).take(pa.array(owner)),
                "piece": number.astype(np.int32), "start": number * capacity, "length": length.astype(np.int64),
                "ids_crc32": np.array([crc(x) for x in cuts], np.int64),
            }
            if with_ids:
                out["ids"] = pa.array([x.astype("<u4").tobytes() for x in cuts], pa.binary())
            yield out

    schema = f"`{id_column}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return arrow_map(docs, [id_column, text], each, schema)


def pack(rows: DataFrame, limits: Limits = Limits(), group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces (any columns with ``length``, at most ``limits.tokens`` each).

    The pieces are written once: their number sets the number of groups, and each row gets a number that places it,
    so that no key decides how large a group becomes. Empty input gives no rows.
    """
    placed = written(rows.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, math.ceil(placed.count() / group))
    placed = placed.withColumn("__group", F.pmod(F.xxhash64("__row"), F.lit(groups)).cast("int"))
    names = rows.columns

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__row")
        bins, offsets = best_fit(part["length"].to_numpy(), limits)
        out = part[names].copy()
        out["sequence_id"] = part["__group"].to_numpy().astype(np.int64) * (1 << 32) + bins
        out["offset"] = offsets
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id long, offset long"
    return placed.groupBy("__group").applyInPandas(one, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, n_tokens, and the pieces in order with their ids; needs the ids column."""
    keys = [c for c in packed.columns if c != "sequence_id"]
    ordered = ["offset", *(c for c in keys if c != "offset")]
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct(*ordered))).alias("pieces")
    )
