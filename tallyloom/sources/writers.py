"""Sinks. Each writes a folder of part files; ``single_file`` is for small exports only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> str:
    """Headed CSV; returns the path."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).csv(path)
    return path


def write_submission(df: DataFrame, key: str, prediction: str, path: str, digits: int = 4) -> str:
    """Key and rounded prediction as headed CSV."""
    return write_csv(df.select(key, F.round(prediction, digits).alias(prediction)), path)


def write_report(df: DataFrame, path: str) -> str:
    """Metric or per-class rows as JSON records."""
    df.write.mode("overwrite").json(path)
    return path


def upsert(base: DataFrame, updates: DataFrame, key: str, version: str) -> DataFrame:
    """Insert or replace by id: the row with the highest version of each id stays, an update
    before a base row of the same version. Updates hold an id and version at most once.

    An aggregate, not a window: copies of one id are reduced before the shuffle.
    """
    rest = [c for c in base.columns if c not in (key, version)]
    both = base.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    merged = both.groupBy(key).agg(
        F.max(version).alias(version), F.max_by(F.struct(*rest), F.struct(version, "_new")).alias("_row")
    )
    return merged.select(key, version, "_row.*").select(base.columns)
