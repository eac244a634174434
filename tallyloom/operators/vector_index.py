"""Approximate nearest vectors: a trained index of k-means cells and product-quantised residual codes.

Every item is kept as the number of its nearest cell and one byte per small slice of what is left after subtracting the
cell's centre. A query reads the codes of its nearest cells only and scores them with tables of inner products of its slices
with all codewords; the best of these, a small multiple of k, are fetched as whole vectors and scored exactly.

Cells, codewords, and how many cells and survivors a query needs for the wanted recall are learnt from a bounded sample,
the items with the smallest hashes; every item is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.retrieval import block_count, cosine_topk, places, shortlist, unit_rows
from tallyloom.session import written

#: Items that an index learns from at most.
SAMPLE = 8192
#: Sampled items that serve as queries when the index is calibrated, at most.
TRIALS = 256
#: Codewords per slice: one byte.
WORDS = 256
#: Dimensions per slice.
SLICE = 2


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the centre with the least distance."""
    return np.argmin((centres * centres).sum(axis=1) - 2 * rows @ centres.T, axis=1)


def k_means(rows: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of at most ``k`` clusters; a cluster that runs empty keeps its centre."""
    centres = rows[rng.permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(rows, centres)
        count = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, rows[:, d], len(centres)) for d in range(rows.shape[1])], axis=1)
        full = count > 0
        centres[full] = sums[full] / count[full, None]
    return centres


@dataclass(frozen=True)
class Quantiser:
    """Centres of the cells (cell, dimension) and codewords (slice, word, dimension of the slice)."""

    centres: np.ndarray
    words: np.ndarray

    @classmethod
    def fit(cls, rows: np.ndarray, cells: int, seed: int = 5) -> "Quantiser":
        rng = np.random.default_rng(seed)
        centres = k_means(rows, min(cells, len(rows)), 8, rng)
        left = cls._slices(rows - centres[_nearest(rows, centres)])
        # fewer sampled rows than codewords: the rest repeat the first
        words = [k_means(part, WORDS, 5, rng) for part in left.transpose(1, 0, 2)]
        return cls(centres, np.stack([np.concatenate((w, np.repeat(w[:1], WORDS - len(w), axis=0))) for w in words]))

    @staticmethod
    def _slices(rows: np.ndarray) -> np.ndarray:
        """(row, slice, dimension of the slice), padded with zeros."""
        padded = np.pad(rows, ((0, 0), (0, -rows.shape[1] % SLICE)))
        return padded.reshape(len(rows), -1, SLICE)

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells and codes (row, slice) of unit vectors."""
        cells = _nearest(rows, self.centres)
        left = self._slices(rows - self.centres[cells])
        codes = np.stack([_nearest(left[:, s], self.words[s]) for s in range(left.shape[1])], axis=1)
        return cells, codes.astype(np.uint8)

    def decode(self, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that cells and codes stand for: centres and codewords together."""
        left = np.stack([words[code] for words, code in zip(self.words, codes.T)], axis=1)
        return (self.centres[cells] + left.reshape(len(cells), -1)[:, : self.centres.shape[1]]).astype(np.float32)

    def scores(self, queries: np.ndarray, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Estimated inner products (query, item)."""
        return queries.astype(np.float32) @ self.decode(cells, codes).T


@dataclass(frozen=True)
class VectorIndex:
    """A quantiser, the cells and survivors that a query needs, and the written items: id, cell, code, vec.

    ``sizes`` are the items per cell.
    """

    quantiser: Quantiser
    probes: int
    survivors: float
    items: DataFrame
    sizes: np.ndarray


def calibrated(quantiser: Quantiser, rows: np.ndarray, k: int, recall: float) -> tuple[int, float]:
    """Cells to visit, and survivors as a multiple of k, with which sampled queries keep ``recall`` of their nearest
    sampled items, in each of the two steps."""
    n, k = len(rows), min(k, len(rows) - 1)
    if k < 1:
        return len(quantiser.centres), 2.0
    queries = rows[:TRIALS]
    own = np.arange(len(queries))
    exact = queries @ rows.T
    exact[own, own] = -np.inf
    true = np.argpartition(-exact, k - 1, axis=1)[:, :k]
    cells, codes = quantiser.encode(rows)
    order = np.argsort(-(queries @ quantiser.centres.T), axis=1, kind="stable")
    turn = np.argsort(order, axis=1)  # at which visit a query comes to a cell
    visits = np.take_along_axis(turn, cells[true], axis=1)
    guess = quantiser.scores(queries, cells, codes)
    guess[own, own] = -np.inf
    place = np.argsort(np.argsort(-guess, axis=1), axis=1)
    ranks = np.take_along_axis(place, true, axis=1)
    at = lambda x: float(np.quantile(x, recall, method="higher")) + 1
    return int(at(visits)), max(1.5, min(at(ranks), n) / k)


def build_index(items: DataFrame, k: int = 20, cells: int = 64, recall: float = 0.97, sample: int = SAMPLE) -> VectorIndex | None:
    """The index of ``items`` (id, vec); None without items. Sample, codewords and cell sizes are what the driver holds."""
    rows = items.select("vec").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    if not rows:
        return None
    known = unit_rows([r["vec"] for r in rows])
    quantiser = Quantiser.fit(known, cells)
    probes, survivors = calibrated(quantiser, known, k, recall)
    shared = items.sparkSession.sparkContext.broadcast(quantiser)  # of fixed size

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                of, codes = shared.value.encode(unit_rows(frame["vec"]))
                yield pd.DataFrame({"id": frame["id"], "cell": of.astype(np.int32), "code": [c.tobytes() for c in codes], "vec": frame["vec"]})

    kind = items.schema["vec"].dataType.simpleString()  # floats stay floats: vectors of survivors are most of what travels
    coded = written(items.select("id", "vec").mapInPandas(encode, f"id string, cell int, code binary, vec {kind}"), "vector-index")
    sizes = np.zeros(len(quantiser.centres), np.int64)
    for r in coded.groupBy("cell").count().collect():  # one row per cell
        sizes[r["cell"]] = r["count"]
    return VectorIndex(quantiser, probes, survivors, coded, sizes)


def _blocks(sizes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell: small cells share one, large ones are cut."""
    first, parts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    at, held = 0, 0
    for cell, n in enumerate(sizes.tolist()):
        if held and held + n > size:
            at, held = at + 1, 0
        first[cell] = at
        if n > size:
            parts[cell] = -(-n // size)
            at, held = at + int(parts[cell]), 0
        else:
            held += n
    return first, parts


def _visits(order: np.ndarray, index_sizes: np.ndarray, probes: int, need: int) -> np.ndarray:
    """Per query how many cells, in its order, it visits: at least ``probes``, and until they hold ``need`` items."""
    held = np.cumsum(index_sizes[order], axis=1)
    enough = (held < need).sum(axis=1) + 1
    return np.minimum(np.maximum(enough, probes), order.shape[1])


def indexed_topk(
    queries: DataFrame, index: VectorIndex, k: int = 20, exclude_self: bool = False, block: int = 1 << 18, query_block: int = 65_536
) -> DataFrame:
    """Approximate k nearest items per query: qid, id, similarity = max(0, cosine), rank.

    A query meets the blocks that hold cells it visits; codes travel once per query block, whole vectors only for
    survivors. A query visits further cells until these hold enough items, so none gets fewer than k if there are k.
    Items have larger blocks than queries: of every block that a query meets its survivors travel, of queries four bytes per dimension.
    """
    spark = queries.sparkSession
    keep = int(np.ceil(index.survivors * k)) + int(exclude_self)
    first, parts = _blocks(index.sizes, block)
    shared = spark.sparkContext.broadcast((index.quantiser, first, parts, index.sizes))  # of fixed size
    probes = index.probes

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        quantiser, first, parts, sizes = shared.value
        for frame in frames:
            if not len(frame):
                continue
            unit = unit_rows(frame["vec"])
            near = unit @ quantiser.centres.T
            order = np.argsort(-near, axis=1, kind="stable")
            many = _visits(order, sizes, probes, keep)
            cells = [row[:n] for row, n in zip(order, many.tolist())]
            to = [np.unique(np.concatenate([np.arange(first[c], first[c] + parts[c]) for c in own])) for own in cells]
            visited = np.zeros(near.shape, bool)
            for row, own in enumerate(cells):
                visited[row, own] = True
            yield pd.DataFrame({
                "qid": frame["qid"], "_unit": [v.tobytes() for v in unit.astype(np.float32)],
                "_cells": [v.tobytes() for v in np.packbits(visited, axis=1)], "_blocks": to,
            })

    asked = queries.select(F.col("qid").cast("bigint"), "vec")
    turns = block_count(queries, query_block)
    asked = asked.mapInPandas(place, "qid bigint, _unit binary, _cells binary, _blocks array<bigint>").select(
        "qid", "_unit", "_cells", F.explode("_blocks").alias("_to"), F.pmod(F.xxhash64("qid"), turns).cast("int").alias("_turn")
    )
    cell_block = F.element_at(F.array(*[F.lit(int(x)) for x in first]), F.col("cell") + 1)
    cell_parts = F.element_at(F.array(*[F.lit(int(x)) for x in parts]), F.col("cell") + 1)
    held = index.items.select(
        "id", "cell", "code", (cell_block + F.pmod(F.xxhash64("id"), cell_parts)).cast("bigint").alias("_block"),
        F.explode(F.sequence(F.lit(0), turns - 1)).alias("_at"),
    )

    def guess(q: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(i):
            return pd.DataFrame({"qid": np.zeros(0, np.int64), "id": np.zeros(0, object), "score": np.zeros(0)})
        quantiser = shared.value[0]
        i = i.sort_values("cell", kind="stable")  # items of a cell lie side by side
        cells = i["cell"].to_numpy(np.int64)
        codes = np.frombuffer(b"".join(i["code"]), np.uint8).reshape(len(i), -1)
        visited = np.frombuffer(b"".join(q["_cells"]), np.uint8).reshape(len(q), -1)
        visited = np.unpackbits(visited, axis=1, count=len(quantiser.centres)).astype(bool)
        vectors = np.frombuffer(b"".join(q["_unit"]), np.float32).reshape(len(q), -1)
        qids, ids = q["qid"].to_numpy(np.int64), i["id"].to_numpy(object)
        decoded = quantiser.decode(cells, codes)
        here, begin = np.unique(cells, return_index=True)
        spans = list(zip(here.tolist(), begin.tolist(), [*begin[1:].tolist(), len(cells)]))
        out = []
        step = max(1, (1 << 22) // len(i))  # estimates that are held at once
        for a in range(0, len(q), step):
            scores = vectors[a : a + step] @ decoded.T
            for cell, first_item, end in spans:
                scores[~visited[a : a + step, cell], first_item:end] = -np.inf
            row, column = shortlist(scores, keep)
            found = scores[row, column]
            order, place = places(row, found)
            best = order[place < keep]
            out.append(pd.DataFrame({"qid": qids[a + row[best]], "id": ids[column[best]], "score": found[best].astype(np.float64)}))
        return pd.concat(out)

    near = asked.groupBy("_to", "_turn").cogroup(held.groupBy("_block", "_at")).applyInPandas(guess, "qid bigint, id string, score double")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    near = near.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= keep).select("qid", "id")
    if exclude_self:
        near = near.where(F.col("qid").cast("string") != F.col("id"))
    own = queries.select(F.col("qid").cast("bigint"), F.col("vec").alias("_q"))
    both = near.join(index.items.select("id", "vec"), "id").join(own, "qid").select("qid", "id", "_q", "vec")

    def rescore(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                cosine = np.round((unit_rows(frame["_q"]) * unit_rows(frame["vec"])).sum(axis=1), 9)
                yield pd.DataFrame({"qid": frame["qid"], "id": frame["id"], "cosine": cosine})

    scored = both.mapInPandas(rescore, "qid bigint, id string, cosine double")
    order = Window.partitionBy("qid").orderBy(F.desc("cosine"), "id")
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("qid", "id", F.greatest("cosine", F.lit(0.0)).alias("similarity"), "rank")
    )


def approximate_topk(queries: DataFrame, items: DataFrame, k: int = 20, exclude_self: bool = False, cells: int = 64, recall: float = 0.97) -> DataFrame:
    """Builds an index of ``items`` and searches it; without items the result is empty, as that of the exact search."""
    index = build_index(items, k, cells, recall)
    return cosine_topk(queries, items, k, exclude_self) if index is None else indexed_topk(queries, index, k, exclude_self)


def visited_share(index: VectorIndex, queries: Sequence[Sequence[float]], k: int) -> tuple[float, float]:
    """Shares of the items whose codes and whose whole vectors the given queries visit, on average."""
    keep = int(np.ceil(index.survivors * k))
    order = np.argsort(-(unit_rows(queries) @ index.quantiser.centres.T), axis=1, kind="stable")
    many = _visits(order, index.sizes, index.probes, keep)
    read = [index.sizes[row[:n]].sum() for row, n in zip(order, many.tolist())]
    total = int(index.sizes.sum())
    return float(np.mean(read)) / total, min(1.0, keep / total)
