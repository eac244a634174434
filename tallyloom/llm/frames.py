"""Small Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


#: Rows of whole texts per Arrow batch at most: a batch is held several times, by the JVM and by the worker.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows per Arrow batch to BATCH_ROWS, if it allows more."""
    allowed = int(spark.conf.get(_BATCH, "10000"))
    if allowed <= 0 or allowed > BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def release() -> None:
    """Gives memory that a worker has freed back to the system: workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(
    df: DataFrame, columns: list[str], each: Callable[[pa.RecordBatch], Iterable[dict[str, object]]], schema: str | StructType,
    rows: int = 1 << 30,
) -> DataFrame:
    """Maps Arrow batches: ``each`` gets a batch with ``columns`` in this order, of at most ``rows`` rows, and yields dicts of
    arrays, one per column of ``schema`` in its order. The session's Arrow batches become small, see ``small_batches``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                for made in each(batch.slice(at, rows)):
                    arrays = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in made.values()]
                    yield pa.RecordBatch.from_arrays(arrays, names=list(made))
            release()

    small_batches(df.sparkSession)
    return df.select(*columns).mapInArrow(run, schema)
