"""Token files: encode whole texts, write ids as wavelet matrix shards in id order, read them back.

Documents are dealt into ranges of their id (one shuffle of the texts), sorted inside each range, and every task writes
shards of about SHARD_TOKENS ids through the shared file system. A shard gets a fresh name per attempt and counts only
once its row is in the written manifest, so lost or repeated tasks leave nothing wrong behind.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.chunkids import CALL_BYTES, ChunkEncoder, JoinedEncode, at_words, before_space
from tallyloom.llm.frames import release, small_batches
from tallyloom.llm.textbatch import Texts
from tallyloom.llm.wavelet import WaveletMatrix, build
from tallyloom.session import new_path, written

SHARD_TOKENS = 1 << 22
MANIFEST = "part int, shard int, path string, before long, n_tokens long, n_docs long"


@lru_cache(maxsize=4)
def encoder(path: str, cut: str) -> ChunkEncoder:
    """One encoder per worker process. ``cut`` names where the tokenizer always cuts: "space" for byte-level BPE,
    "words" for tokenizers that drop white space."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    at, glue = {"space": (before_space, ""), "words": (at_words, " ")}[cut]
    encode = JoinedEncode(Tokenizer.from_file(path), glue)
    return ChunkEncoder(at, encode, encode.dtype)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends ``end_id`` to each text's ids."""
    upto = np.cumsum(counts)
    return np.insert(ids, upto, end_id), counts + 1


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_shards(
    docs: DataFrame, tokenizer: str, cut: str, end_id: int, id_column: str = "doc_id", text: str = "text",
    shard_tokens: int = SHARD_TOKENS, folder: str | None = None,
) -> DataFrame:
    """Writes the token files and returns their manifest, one row per shard in (part, shard) order.

    Null texts count as empty: only the end id. Rows with a null id come first; rows that share an id follow one
    another by a hash of their text, so they may lie in any number of tasks. Other columns are ignored; an empty table writes no shard.
    """
    small_batches(docs.sparkSession)
    folder = folder or new_path(docs.sparkSession, "tokens")
    ordered = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    order = ["id", F.xxhash64("text"), "text"]
    ordered = ordered.repartitionByRange(*order[:2]).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, cut)
        part = TaskContext.get().partitionId()
        files, base = _open(folder)
        files.create_dir(base, recursive=True)
        parts: list[np.ndarray] = []
        ids: list[int | None] = []
        counts: list[np.ndarray] = []
        held, before, shard = 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, before, shard
            name = f"{part:06d}-{shard:05d}-{uuid.uuid4().hex}.wm"
            with files.open_output_stream(f"{base}/{name}") as out:
                out.write(build(np.concatenate(parts), ids, np.concatenate(counts), 8 * parts[0].dtype.itemsize))
            row = [[part], [shard], [f"{folder}/{name}"], [before], [held], [len(ids)]]
            before, shard, held = before + held, shard + 1, 0
            parts.clear()
            ids.clear()
            counts.clear()
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], names=[c.split()[0] for c in MANIFEST.split(", ")])

        for batch in batches:
            for first, end, texts in Texts.from_arrow(batch.column(1)).slices(min(CALL_BYTES, 2 * shard_tokens)):
                flat, sizes = with_end(*encode(texts), end_id)
                parts.append(flat)
                counts.append(sizes)
                ids += batch.column(0).slice(first, end - first).to_pylist()
                held += len(flat)
                if held >= shard_tokens:
                    yield flush()
            release()
        if ids:
            yield flush()

    return written(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """Adds ``start``: the tokens of all shards before. The window holds one row per part, not per shard."""
    totals = manifest.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(upto), F.lit(0)).alias("base"))
    return manifest.join(bases, "part").withColumn("start", F.col("base") + F.col("before")).drop("base")


def open_shard(path: str) -> WaveletMatrix:
    files, name = _open(path)
    handle = files.open_input_file(name)

    def fetch(start: int, length: int) -> bytes:
        handle.seek(start)
        return handle.read(length)

    return WaveletMatrix(fetch)


def read_documents(manifest: DataFrame, id_column: str, each: Callable[[np.ndarray], object], name: str, kind: str) -> DataFrame:
    """One row per document from the files: id, start, n_tokens, and ``name`` = each(its ids)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                files, place = _open(path)
                with files.open_input_stream(place) as source:
                    shard = WaveletMatrix.of(source.read())
                ids, counts = shard.documents()
                tokens = shard.decode()
                ends = np.cumsum(counts)
                made = [each(tokens[a:b]) for a, b in zip((ends - counts).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(start + ends - counts), pa.array(counts), pa.array(made)],
                    names=[id_column, "start", "n_tokens", name],
                )

    shards = with_starts(manifest).select("path", "start")
    spread = shards.repartition(max(1, shards.sparkSession.sparkContext.defaultParallelism * 4), "path")
    return spread.mapInArrow(read, f"`{id_column}` long, start long, n_tokens long, {name} {kind}")


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
