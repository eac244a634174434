"""Session helpers: test sessions and the shared work folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = 8, memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallyloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors of a cluster that doesn't have it installed; once per session."""
    if getattr(spark, "_tallyloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tallyloom-package-")  # on the driver only: Spark serves the file from there
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "tallyloom"), "zip", os.path.dirname(root), "tallyloom"))
    spark._tallyloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a session without ``spark.checkpoint.dir`` (a local test run) gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    own = getattr(spark, "_tallyloom_dir", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="tallyloom-")
        spark._tallyloom_dir = own
    return own


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path below the shared folder."""
    return f"{shared_dir(spark)}/tallyloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    Used for intermediates that several branches of one plan scan with different columns,
    where column pruning would defeat exchange reuse. Survives the loss of executors.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, name: str, key: str, path: str | None = None, buckets: int | None = None) -> DataFrame:
    """Like :func:`written`, in buckets by ``key``: aggregates, windows and joins by that column need no further shuffle.

    The table is in the session's catalog only until its frame is made; a ``path`` that is given is written anew.
    """
    spark, n = df.sparkSession, buckets or bucket_count(df)
    table = f"tallyloom_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    to = df.repartition(n, key).write.format("parquet").mode("overwrite").option("path", path or new_path(spark, name))
    to.bucketBy(n, key).saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay
    return found


def bucket_count(df: DataFrame) -> int:
    """How many pieces to split a hot group into: follows the session's shuffle width."""
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
