"""Exact top-k by integer inner product with block-at-a-time pruning.

Vectors are dealt into segments; inside a segment they are ordered so that near vectors stand together and cut into
document-range blocks with a forward index each. Per query the blocks are ordered by the sum of the query's products
with the block's term maxima (minima for negative weights), and scored one after another until the next bound falls
below the k-th score. A bounded pilot set gives every query a first k-th score, so most segments end at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import written

#: Vectors per segment and queries per query block: the size of one task's work.
SEGMENT = 8192
QUERY_BLOCK = 2048
#: Vectors per document-range block.
LEAF = 64
#: Vectors that give the first k-th score; the only rows that are broadcast.
PILOT = 1024

FOUND = "query_id long, vec_id long, score long"


def quantized(vectors: DataFrame, scale: float = 1024.0, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, terms): every component becomes floor(scale * x) as long. Rows with a null id, a null vector or null
    or non-finite components are left out."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.where(F.col(id_column).isNotNull() & x.isNotNull() & finite).select(
        F.col(id_column).cast("long").alias("vec_id"),
        F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double"))).alias("terms"),
    )


def _matrix(lists: list, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _ordered(rows: np.ndarray) -> np.ndarray:
    """An order that halves the rows at the median of the widest term, down to blocks of LEAF."""
    out: list[np.ndarray] = []
    todo = [np.arange(len(rows))]
    while todo:
        part = todo.pop()
        if len(part) <= LEAF or not rows.shape[1]:
            out.append(part)
            continue
        own = rows[part].astype(float)
        axis = int(np.argmax(own.var(axis=0)))
        half = (len(part) // 2 + LEAF - 1) // LEAF * LEAF
        ranked = part[np.argsort(own[:, axis], kind="stable")]
        todo += [ranked[half:], ranked[:half]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class BlockIndex:
    """Document-range blocks of one segment: forward index, term maxima and minima per block."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = _ordered(rows)
        self.ids, self.rows = ids[order], rows[order]
        starts = np.arange(0, len(ids), LEAF)
        self.starts, self.ends = starts, np.minimum(starts + LEAF, len(ids))
        # products of small integers are exact in doubles, which have fast matrix products
        small = rows.size == 0 or int(np.abs(rows).max()) ** 2 * max(rows.shape[1], 1) < 1 << 52
        self.kind = np.float64 if small else np.int64
        self.rows = self.rows.astype(self.kind)
        self.high = np.maximum.reduceat(self.rows, starts) if len(ids) else self.rows
        self.low = np.minimum.reduceat(self.rows, starts) if len(ids) else self.rows

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query id, vector ids, scores) with the best k per query that aren't below its floor; ties to smaller ids."""
        queries = queries.astype(self.kind) if self.kind is np.int64 or np.abs(queries).max(initial=0) < 1 << 22 else queries
        bounds = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        ranked = np.argsort(-bounds, axis=1, kind="stable")
        for i, own in enumerate(query_ids.tolist()):
            ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
            kth = floors[i]
            for block in ranked[i].tolist():
                if bounds[i, block] < kth:
                    break
                a, b = self.starts[block], self.ends[block]
                made = (self.rows[a:b] @ queries[i]).astype(np.int64)
                keep = (made >= kth) & (self.ids[a:b] != own)
                if keep.any():
                    ids, scores = np.concatenate((ids, self.ids[a:b][keep])), np.concatenate((scores, made[keep]))
                    best = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[best], scores[best]
                    if len(ids) == k:
                        kth = max(kth, int(scores[-1]))
            if len(ids):
                yield own, ids, scores


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k best vectors of every query, never those with the query's own id.

    Both inputs have (vec_id, terms), see ``quantized``. Missing terms of shorter vectors count as 0; ties go to the
    smaller vec_id; fewer than k candidates give fewer rows. Of query rows that share an id the smallest vector
    counts; candidate rows that share an id stay separate candidates.
    """
    queries = queries.groupBy("vec_id").agg(F.min("terms").alias("terms"))
    queries, vectors = written(queries, "queries"), written(vectors, "vectors")
    n_queries, n_vectors = queries.count(), vectors.count()
    segments, blocks = max(1, math.ceil(n_vectors / SEGMENT)), max(1, math.ceil(n_queries / QUERY_BLOCK))
    pilot = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PILOT)
    pilot_rows = pilot.collect()
    lowest = -(1 << 62)
    pilot_ids = np.array([r["vec_id"] for r in pilot_rows], np.int64)
    pilot_terms = [r["terms"] for r in pilot_rows]

    def block_of(part: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
        return part["vec_id"].to_numpy(np.int64), _matrix(part["terms"].tolist(), width)

    def wide(*parts: list) -> int:
        return max((len(x) for part in parts for x in part), default=0)

    def first_kth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            width = wide(part["terms"].tolist(), pilot_terms)
            ids, rows = block_of(part, width)
            index = BlockIndex(pilot_ids, _matrix(pilot_terms, width))
            part["kth"] = lowest
            found = {own: int(scores[-1]) for own, made, scores in index.search(ids, rows, np.full(len(ids), lowest), k) if len(made) == k}
            part["kth"] = [found.get(x, lowest) for x in ids.tolist()]
            yield part[["vec_id", "terms", "kth"]]

    started = queries.mapInPandas(first_kth, "vec_id long, terms array<long>, kth long")
    left = started.withColumn("qblock", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn(
        "seg", F.explode(F.sequence(F.lit(0), F.lit(segments - 1)))
    )
    # the second hash has its own seed column, or segments and query blocks would follow one another
    right = vectors.withColumn("seg", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(segments)).cast("int")).withColumn(
        "qblock", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )

    def search(key, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            width = wide(asked["terms"].tolist(), held["terms"].tolist())
            ids, rows = block_of(asked, width)
            index = BlockIndex(*block_of(held, width))
            for own, made, scores in index.search(ids, rows, asked["kth"].to_numpy(np.int64), k):
                out.append(pd.DataFrame({"query_id": own, "vec_id": made, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: pd.Series(dtype="int64") for c in FOUND.split(", ")})

    found = left.groupBy("seg", "qblock").cogroup(right.groupBy("seg", "qblock")).applyInPandas(search, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
