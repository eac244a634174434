"""Readers with explicit schemas; nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TRANSACTION_SCHEMA = (
    "cust_id bigint, sale_id bigint, prod_id bigint, order_date date, pack_date date,"
    " sale_revenue decimal(18,4), sale_discount decimal(18,4), returned_to bigint, web_only int"
)
LABEL_SCHEMA = "cust_id bigint, revenue_label double"
TEST_SCHEMA = "cust_id bigint"
RECORD_SCHEMA = "item_id bigint, category string, img_path string, year_released string, themes array<string>"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Headed CSV; a date or number that does not fit its column becomes null."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_records(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA, array_file: bool = False) -> DataFrame:
    """JSON records, one per line; ``array_file`` for files that hold one array each.

    Lines can be split between tasks, an array file cannot: convert large ones once.
    """
    return spark.read.schema(schema).option("multiLine", array_file).json(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded image files (column ``image``); unreadable files are kept with sizes of -1."""
    return spark.read.format("image").option("dropInvalid", False).load(path)


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """Paths of the files below a folder; their bytes are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")


def read_capped(df: DataFrame, key: str, limit: int = 5000) -> DataFrame:
    """The first ``limit`` records of a table by key."""
    return df.orderBy(key).limit(limit)
