"""One headed CSV file, written by many tasks.

Every task writes the lines of its partition to a part of its own and reports its size; what counts is decided once all have
(``HeadedParts``, a data source with two-phase commit). A second job then lets every part be copied to its place in the
file, whose length is known by then, and the file gets its name last. So no stage has a single task, rows keep the order of their
partitions, and an attempt that is cut off leaves no file under that name.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from tallyloom.session import new_path

#: Bytes that a copy holds at once.
COPY_BYTES = 8 << 20


@dataclass
class Part(ds.WriterCommitMessage):
    number: int
    name: str
    size: int


class PartsWriter(ds.DataSourceArrowWriter):
    """Writes the column ``value`` as lines; a commit names the parts in ``parts.json``, an abort removes them."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        system, base = fs.FileSystem.from_uri(self.folder)
        system.create_dir(base, recursive=True)
        name, size = uuid.uuid4().hex, 0
        with system.open_output_stream(f"{base}/{name}") as out:
            for batch in iterator:
                lines = batch.column(0).to_pylist()
                body = "".join(f"{line}\n" for line in lines).encode()
                out.write(body)
                size += len(body)
        return Part(TaskContext.get().partitionId(), name, size)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m.number, m.name, m.size) for m in messages if m is not None)
        system, base = fs.FileSystem.from_uri(self.folder)
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/parts.json") as out:
            out.write(json.dumps(parts).encode())

    def abort(self, messages: list[Part | None]) -> None:
        system, base = fs.FileSystem.from_uri(self.folder)
        for m in messages:
            if m is not None:
                system.delete_file(f"{base}/{m.name}")


class HeadedParts(ds.DataSource):
    """Option ``path``: the folder of the parts."""

    @classmethod
    def name(cls) -> str:
        return "headed_parts"

    def writer(self, schema, overwrite: bool) -> PartsWriter:
        return PartsWriter(self.options["path"])


def write_headed_csv(df: DataFrame, path: str) -> str:
    """Writes ``df`` as the file ``path`` with a header line, in the order of its partitions; replaces an older file.

    Cells look as Spark's CSV writer makes them. The file's folder must be mounted on every machine: parts are copied to
    their places side by side. On other file systems, which append only, one task streams them one after another.
    """
    spark = df.sparkSession
    spark.dataSource.register(HeadedParts)
    folder = new_path(spark, "parts")
    lines = df.select(F.to_csv(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))
    lines.write.format("headed_parts").mode("append").save(folder)
    parts_in, parts_at = fs.FileSystem.from_uri(folder)
    with parts_in.open_input_stream(f"{parts_at}/parts.json") as source:
        parts = json.loads(source.read())
    # the header cells are quoted as Spark quotes values
    names = ", ".join(f"`n{i}` string" for i in range(len(df.columns)))
    header = spark.createDataFrame([tuple(df.columns)], names).select(F.to_csv(F.struct("*"))).first()[0]
    head = f"{header}\n".encode()
    system, place = fs.FileSystem.from_uri(path)
    draft = f"{place}.{uuid.uuid4().hex}"
    system.create_dir(os.path.dirname(place), recursive=True)
    mounted = isinstance(system, fs.LocalFileSystem)
    with system.open_output_stream(draft) as out:
        out.write(head)
    rows, at = [], len(head)
    for number, name, size in parts:
        if size:
            rows.append((number, name, at))
            at += size

    def chunks(name: str) -> Iterator[bytes]:
        source_system, base = fs.FileSystem.from_uri(folder)
        with source_system.open_input_stream(f"{base}/{name}") as source:
            while chunk := source.read(COPY_BYTES):
                yield chunk

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                file = os.open(draft, os.O_WRONLY)
                for chunk in chunks(name):
                    start += os.pwrite(file, chunk, start)
                os.close(file)
            yield batch

    def append(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with fs.FileSystem.from_uri(path)[0].open_output_stream(draft) as out:
            out.write(head)
            for batch in batches:
                for name in batch.column(1).to_pylist():
                    for chunk in chunks(name):
                        out.write(chunk)
                yield batch

    if rows:
        table = spark.createDataFrame(rows, "number int, name string, start long")  # one row per part
        placed = table.repartition(len(rows), "name") if mounted else table.coalesce(1).sortWithinPartitions("number")
        placed.mapInArrow(copy if mounted else append, table.schema).count()
    system.move(draft, place)
    return path
