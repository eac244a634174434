"""Dense text vectors: TF-IDF over hashed words, folded onto the directions that hold most of it.

The directions come from a randomised singular value decomposition. A random block of vectors is multiplied by the matrix of
all rows and its transpose, a few times with the block made orthogonal between; each product is one pass in which every task
multiplies its own rows and only sums of the size of the block travel. The small problem that is left is solved on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tallyloom.operators.retrieval import word_weights
from tallyloom.session import written

#: Vectors of the random block beyond those that are kept.
EXTRA = 16
#: Parts that a product's sums travel in, and tasks whose parts are summed up together first.
PARTS = 16
FAN = 64
#: Rows that a task holds as a full matrix at once.
TOGETHER = 512
SUMS = "part int, fan int, data binary, weight double"


@dataclass(frozen=True)
class TextSpace:
    """Directions as columns, orthogonal and of length one, the most important first; the share of all squared weights that
    each explains."""

    directions: np.ndarray
    shares: np.ndarray


def _matrix(column: pa.Array, features: int) -> np.ndarray:
    """Rows of a list column, or of a sparse one (indices, values), as a full matrix."""
    if not pa.types.is_struct(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), features)
    parts = dict(zip((f.name for f in column.type), column.flatten()))
    out = np.zeros((len(column), features))
    row = np.repeat(np.arange(len(column)), pc.list_value_length(parts["indices"]).to_numpy(zero_copy_only=False))
    out[row, parts["indices"].flatten().to_numpy()] = parts["values"].flatten().to_numpy()
    return out


def _matrices(column: pa.Array, features: int) -> Iterator[np.ndarray]:
    """The same in turns of at most TOGETHER rows."""
    for at in range(0, len(column), TOGETHER):
        yield _matrix(column.slice(at, TOGETHER), features)


def _product(rows: DataFrame, vec: str, block: np.ndarray) -> tuple[np.ndarray, float]:
    """The matrix of all rows times its transpose applied to ``block``, and the sum of all squared weights."""
    shared = rows.sparkSession.sparkContext.broadcast(block)  # features x block, of fixed size

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = np.zeros_like(shared.value), 0.0
        for batch in batches:
            for own in _matrices(batch.column(0), len(total)):
                total += own.T @ (own @ shared.value)
                weight += float(np.vdot(own, own))
        if weight:
            parts = np.array_split(total, PARTS)
            fan = TaskContext.get().partitionId() % FAN
            cells = [list(range(PARTS)), [fan] * PARTS, [p.tobytes() for p in parts], [weight if i == 0 else 0.0 for i in range(PARTS)]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cells, (pa.int32(), pa.int32(), pa.binary(), pa.float64()))], names=["part", "fan", "data", "weight"]
            )

    def added(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in group["data"].to_pylist())
        cells = [[group["part"][0].as_py()], [0], [total.tobytes()], [sum(group["weight"].to_pylist())]]
        return pa.table([pa.array(c, k) for c, k in zip(cells, (pa.int32(), pa.int32(), pa.binary(), pa.float64()))], names=["part", "fan", "data", "weight"])

    sums = rows.select(vec).mapInArrow(multiply, SUMS).groupBy("part", "fan").applyInArrow(added, SUMS)
    found = sums.groupBy("part").applyInArrow(added, SUMS).orderBy("part").collect()  # together as large as the block
    if not found:
        return np.zeros_like(block), 0.0
    width = block.shape[1]
    return np.concatenate([np.frombuffer(r["data"]).reshape(-1, width) for r in found]), sum(r["weight"] for r in found)


def fit_space(rows: DataFrame, vec: str, features: int, size: int = 64, rounds: int = 3, seed: int = 11) -> TextSpace:
    """The ``size`` best directions of the vectors in column ``vec``, from all rows: array<double> of ``features``, or sparse
    as a struct with ``indices`` and ``values``.

    Without rows, or with fewer directions than asked for, the rest explain nothing.
    """
    width = min(features, size + EXTRA)
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(features, width)))[0]
    for turn in range(rounds):
        product, weight = _product(rows, vec, block)
        if turn < rounds - 1:
            block = np.linalg.qr(product)[0]
    small = block.T @ product
    values, turned = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values, kind="stable")[:size]
    return TextSpace(block @ turned[:, order], np.maximum(values[order], 0.0) / (weight or 1.0))


def folded(rows: DataFrame, vec: str, space: TextSpace) -> DataFrame:
    """``rows`` with ``vec`` replaced by its place in the space, scaled to length one; zero vectors stay zero."""
    shared = rows.sparkSession.sparkContext.broadcast(space.directions)
    at = rows.columns.index(vec)
    schema = StructType([StructField(f.name, ArrayType(DoubleType())) if f.name == vec else f for f in rows.schema])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, size = shared.value.shape
        for batch in batches:
            dense = np.concatenate([np.zeros((0, size)), *(own @ shared.value for own in _matrices(batch.column(at), features))])
            norms = np.linalg.norm(dense, axis=1, keepdims=True)
            dense = np.divide(dense, norms, out=np.zeros_like(dense), where=norms > 1e-12)
            ends = np.arange(0, dense.size + 1, size, dtype=np.int32)
            columns = list(batch.columns)
            columns[at] = pa.ListArray.from_arrays(pa.array(ends), pa.array(dense.ravel()))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return rows.mapInArrow(fold, schema)


def dense_text_vectors(df: DataFrame, text: str, size: int = 64, features: int = 1024) -> tuple[DataFrame, TextSpace]:
    """``df`` with ``vec``: ``size`` numbers of length one for a text with words (all zero without), and the space they lie in.
    Whole texts; null texts count as empty. The TF-IDF vectors are written once, sparse, since every product reads them."""
    kept = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    if kept.isEmpty():
        sparse = df.withColumn("vec", F.lit(None).cast("struct<indices: array<int>, values: array<double>>"))
    else:
        unit = F.unwrap_udt("weights")
        vec = F.struct(unit["indices"].alias("indices"), unit["values"].alias("values"))
        sparse = word_weights(kept, "_text", features).withColumn("vec", vec).drop("_text", "weights")
    sparse = written(sparse, "text-vectors")
    space = fit_space(sparse, "vec", features, size)
    return folded(sparse, "vec", space), space
