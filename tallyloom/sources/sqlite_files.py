"""Tables in embedded SQLite files as a Spark data source: no server, many files, row-id ranges as partitions.

    spark.dataSource.register(SqliteFiles)
    spark.read.format("sqlite_files").schema(...).option("table", "games").load(folder)

Every file below the folder holds the table. The plan of a scan reads only the least and greatest row id of each file; a
partition is one range of row ids of one file. Only the columns of the schema are read, and simple comparisons become part of
the statement (``spark.sql.python.filterPushdown.enabled``).
"""

from __future__ import annotations

import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows per partition and per Arrow batch.
PER_PARTITION = 100_000
BATCH = 10_000

OPERATORS = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    """A read-only connection: files on a mounted folder are read in place, others are fetched into memory."""
    system, place = fs.FileSystem.from_uri(path)
    if isinstance(system, fs.LocalFileSystem):
        return sqlite3.connect(f"file:{place}?mode=ro&immutable=1", uri=True)
    with system.open_input_stream(place) as source:
        held = sqlite3.connect(":memory:")
        held.deserialize(source.read())
        return held


def condition(filters: list[ds.Filter]) -> tuple[list[str], list[object], list[ds.Filter]]:
    """Terms of a WHERE clause with their parameters, and the filters that can't be one.

    Texts compare by bytes and numbers by value, as in Spark; other kinds of values stay with Spark.
    """
    terms, values, rest = [], [], []
    for f in filters:
        name = _quoted(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
        own = list(f.value) if isinstance(f, ds.In) else [getattr(f, "value", 0)]
        plain = all(isinstance(v, (int, float, str)) and not isinstance(v, bool) for v in own)
        if name and type(f) in OPERATORS and plain:
            terms.append(f"{name} {OPERATORS[type(f)]} ?")
            values += own
        elif name and isinstance(f, ds.In) and plain and len(own) <= 500:
            terms.append(f"{name} IN ({', '.join('?' * len(own))})")
            values += own
        elif name and isinstance(f, ds.IsNotNull):
            terms.append(f"{name} IS NOT NULL")
        elif name and isinstance(f, ds.IsNull):
            terms.append(f"{name} IS NULL")
        else:
            rest.append(f)
    return terms, values, rest


@dataclass
class RowRange(ds.InputPartition):
    path: str
    first: int
    last: int


class SqliteReader(ds.DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema = schema
        self.table, self.folder = options["table"], options["path"]
        self.rows = int(options.get("rowsperpartition", PER_PARTITION))
        self.terms: list[str] = []
        self.values: list[object] = []

    def pushFilters(self, filters: list[ds.Filter]):
        self.terms, self.values, rest = condition(filters)
        return rest

    def partitions(self) -> list[RowRange]:
        system, place = fs.FileSystem.from_uri(self.folder)
        scheme = self.folder.split("://", 1)[0] + "://" if "://" in self.folder else ""
        found = system.get_file_info(fs.FileSelector(place, recursive=True))
        out = []
        for path in sorted(f.path for f in found if f.is_file and f.path.endswith(".sqlite")):
            with _open(scheme + path) as source:
                low, high = source.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
            if low is not None:
                out += [RowRange(scheme + path, a, min(a + self.rows - 1, high)) for a in range(low, high + 1, self.rows)]
        return out

    def read(self, partition: RowRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # without any partition Spark asks for one empty one
            return
        kinds = to_arrow_schema(self.schema)
        names = ", ".join(_quoted(n) for n in self.schema.names) or "NULL"
        where = " AND ".join(["rowid BETWEEN ? AND ?", *self.terms])
        with _open(partition.path) as source:
            rows = source.execute(f"SELECT {names} FROM {_quoted(self.table)} WHERE {where}", [partition.first, partition.last, *self.values])
            while some := rows.fetchmany(BATCH):
                columns = [pa.array(list(c), pa_type) for c, pa_type in zip(zip(*some), kinds.types)]
                yield pa.RecordBatch.from_arrays(columns, schema=kinds)


class SqliteFiles(ds.DataSource):
    """Options: ``path`` (a folder), ``table``, ``rowsPerPartition``. The schema is given by the reader."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_files"

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, dict(self.options))


def read_sqlite(spark, folder: str, table: str, schema: str, rows_per_partition: int = PER_PARTITION) -> DataFrame:
    """The rows of ``table`` over all files of a folder, by explicit schema."""
    spark.dataSource.register(SqliteFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("sqlite_files").schema(schema).option("table", table).option("rowsPerPartition", rows_per_partition).load(folder)


def write_sqlite(df: DataFrame, folder: str, table: str) -> str:
    """One file per task with the task's rows; numbers and texts only. A file is written whole under a fresh name, and
    counts once its name is listed, so a repeated task's file of a failed attempt is left out; returns the folder of the rest."""
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "string": "TEXT"}
    columns = ", ".join(f"{_quoted(f.name)} {kinds[f.dataType.simpleString()]}" for f in df.schema)
    marks = ", ".join("?" * len(df.columns))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = sqlite3.connect(":memory:")
        made.execute(f"CREATE TABLE {_quoted(table)} ({columns})")
        count = 0
        for batch in batches:
            made.executemany(f"INSERT INTO {_quoted(table)} VALUES ({marks})", zip(*(c.to_pylist() for c in batch.columns)))
            count += batch.num_rows
        made.commit()
        if count:
            system, base = fs.FileSystem.from_uri(folder)
            system.create_dir(f"{base}/tries", recursive=True)
            name = f"{uuid.uuid4().hex}.sqlite"
            with system.open_output_stream(f"{base}/tries/{name}") as out:
                out.write(made.serialize())
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    names = [r["name"] for r in df.mapInArrow(save, "name string").select(F.col("name")).collect()]  # one per task
    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(f"{base}/files", recursive=True)
    for name in names:
        system.move(f"{base}/tries/{name}", f"{base}/files/{name}")
    return f"{folder}/files"
