"""A table of rows by key that takes batches of inserts and updates without being written anew.

Rows lie in buckets by the hash of their key, each bucket in one segment of files or a few. A manifest names the
segments, with a bitmap of the key hashes in each. A batch reads only the segments whose bitmap may hold one of its keys, merges
them with the batch, writes a new segment for each bucket it touches, and swaps the manifest: the next number, in
one file. A key is never in two segments, so reading needs no merge. What an older manifest names stays as it is, so
readers keep their version, and a batch that fails leaves no trace in the table.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import new_path, written
from tallyloom.sources.writers import upsert

#: Bits of a segment's key bitmap: what ``bitmap_construct_agg`` makes, a fixed value.
BITS = 1 << 15
#: Segments of a bucket from which a batch that touches it merges them all.
SEGMENTS = 4
MANIFEST = "number int, buckets int, key string, version string, bucket int, path string, rows long, keys binary"


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _bit(key: str) -> Column:
    """Place of a key in a segment's bitmap; independent of its bucket."""
    return F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(BITS))


def _holds(bitmap: str, bit: str) -> Column:
    """Whether the bitmap has the bit."""
    byte = F.conv(F.hex(F.substr(F.col(bitmap), (F.floor(F.col(bit) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (F.col(bit) % 8).cast("int")) == 1


def manifests(spark: SparkSession, root: str) -> DataFrame | None:
    """All manifests of the table, or None without a table; one row per segment and manifest."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{root}/manifest-*")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The latest manifest; fails where there is no table."""
    every = manifests(spark, root)
    if every is None:
        raise ValueError(f"no keyed table at {root}")
    last = every.agg(F.max("number")).first()[0]
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest-{last:08d}")


def _segments(rows: DataFrame, root: str, key: str, buckets: int) -> DataFrame:
    """Writes rows as one new segment per bucket and describes them: bucket, path, rows, keys."""
    spark = rows.sparkSession
    folder = f"{root}/data/{new_path(spark, 'x').rsplit('-', 1)[1]}"
    placed = rows.withColumn("_bucket", _bucket(key, buckets))
    placed.repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
    made = spark.read.schema(placed.schema).parquet(folder)
    return made.groupBy(F.col("_bucket").alias("bucket")).agg(
        F.count(F.lit(1)).alias("rows"), F.bitmap_construct_agg(_bit(key)).alias("keys")
    ).select("bucket", F.format_string(f"{folder}/_bucket=%d", F.col("bucket")).alias("path"), "rows", "keys")


def _swap(segments: DataFrame, root: str, number: int, buckets: int, key: str, version: str) -> None:
    """Writes a manifest; fails if another batch has written this number first. Its first row names no segment, so that
    an empty table has one too."""
    fixed = [F.lit(number).alias("number"), F.lit(buckets).alias("buckets"), F.lit(key).alias("key"), F.lit(version).alias("version")]
    head = segments.sparkSession.range(1).select(
        *fixed, F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("string").alias("path"), F.lit(0).cast("long").alias("rows"),
        F.lit(None).cast("binary").alias("keys"),
    )
    rows = head.unionByName(segments.select(*fixed, "bucket", "path", "rows", "keys"))
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{root}/manifest-{number:08d}")  # one small row per segment


def create(rows: DataFrame, root: str, key: str, version: str, buckets: int = 64) -> str:
    """Writes ``rows`` as a new table at ``root``: of each key the row with the highest version. Rows without a key are left out."""
    known = rows.where(F.col(key).isNotNull())
    only = upsert(known.limit(0), known, key, version)
    _swap(_segments(only, root, key, buckets), root, 0, buckets, key, version)
    return root


def merge(root: str, batch: DataFrame) -> DataFrame:
    """Inserts or replaces rows by key, the highest version of each key stays, a row of the batch before one of the table with
    the same version; returns the segments written: bucket, path, rows.

    An empty batch changes nothing. Columns are those of the table, in any order; rows without a key are left out.
    """
    spark = batch.sparkSession
    now = written(manifest(spark, root), "manifest")
    about = now.first()
    key, version, buckets = about["key"], about["version"], about["buckets"]
    number = about["number"] + 1
    segments = now.where("path is not null")
    incoming = batch.where(F.col(key).isNotNull())
    incoming = written(upsert(incoming.limit(0), incoming, key, version).withColumn("_bucket", _bucket(key, buckets)), "batch")
    if incoming.isEmpty():
        return segments.limit(0).select("bucket", "path", "rows")
    asked = incoming.select(F.col("_bucket").alias("bucket"), _bit(key).alias("bit")).distinct()  # at most BITS per bucket
    crowded = segments.groupBy("bucket").count().where(F.col("count") >= SEGMENTS).select("bucket", F.lit(True).alias("crowded"))
    hit = segments.join(asked, "bucket").join(crowded, "bucket", "left")
    hit = hit.where(F.coalesce("crowded", F.lit(False)) | _holds("keys", "bit")).select("path").distinct()
    stale = [r["path"] for r in hit.collect()]  # paths of segments: at most SEGMENTS per bucket
    rows = incoming.drop("_bucket")
    old = spark.read.schema(rows.schema).parquet(*stale) if stale else rows.limit(0)
    made = written(_segments(upsert(old, rows, key, version), root, key, buckets), "segments")
    kept = segments.where(~F.col("path").isin(stale)) if stale else segments
    _swap(kept.select("bucket", "path", "rows", "keys").unionByName(made), root, number, buckets, key, version)
    return made.select("bucket", "path", "rows")


def read(spark: SparkSession, root: str, schema) -> DataFrame:
    """The rows of the latest version of the table."""
    paths = [r["path"] for r in manifest(spark, root).where("path is not null").select("path").collect()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
