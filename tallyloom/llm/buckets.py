"""Members that share a key, found without shuffling a row per member and without a task that holds one hot key.

Map tasks pack (key, member) entries per bucket of keys. A key that many members of a task's window share leaves the
task as one entry: its members are paired with the smallest of them at once. Bucket tasks pair the members of small
keys fully and of large keys with the smallest member (a star); all members of large keys also come out as ``kind`` 1
rows, so that a caller can go on with the keys whose members prove not to belong together. A key that any map task
cut is named in its bucket and large there, however few entries arrive.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Entries that a map task gathers before it packs them.
WINDOW = 500_000
#: Members of a key that are paired fully.
SMALL = 8
#: Bytes of packed entries that one bucket task should get.
BUCKET_BYTES = 8 << 20

PACKED = "bucket int, kind int, x binary, y binary"
PAIRS = "kind int, a long, b long"


def bucket_count(df: DataFrame, entries: int) -> int:
    """Buckets for so many entries in all: as many as the session's shuffles have partitions, more for more data."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(width, math.ceil(entries * 16 / BUCKET_BYTES))


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.ones(len(sorted_keys), bool)
    edge[1:] = sorted_keys[1:] != sorted_keys[:-1]
    starts = np.flatnonzero(edge)
    return starts, np.diff(np.concatenate((starts, [len(sorted_keys)])))


def _sorted(keys: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct entries by key, then member."""
    order = np.lexsort((members, keys))
    keys, members = keys[order], members[order]
    keep = np.ones(len(keys), bool)
    keep[1:] = (keys[1:] != keys[:-1]) | (members[1:] != members[:-1])
    return keys[keep], members[keep]


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.minimum(a, b), np.maximum(a, b)
    return _sorted(low, high)


class Packer:
    """Gathers entries of one map task and packs them into rows of PACKED."""

    def __init__(self, buckets: int, window: int = WINDOW):
        self.buckets, self.window = buckets, window
        self.keys: list[np.ndarray] = []
        self.members: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray, members: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys)
        self.members.append(members)
        self.held += len(keys)
        if self.held >= self.window:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        keys, members = _sorted(np.concatenate(self.keys), np.concatenate(self.members))
        self.keys, self.members, self.held = [], [], 0
        starts, sizes = _runs(keys)
        hot = np.repeat(sizes > SMALL, sizes)
        center = np.repeat(members[starts], sizes)
        rest = hot.copy()
        rest[starts] = False
        a, b = _distinct_pairs(center[rest], members[rest])
        keep = ~rest
        yield from self._rows(0, keys[keep], members[keep], keys[keep])
        yield from self._rows(1, keys[hot], members[hot], members[hot])
        yield from self._rows(2, a, b, b)
        cut = keys[starts[sizes > SMALL]]
        yield from self._rows(3, cut, cut, cut)

    def _rows(self, kind: int, x: np.ndarray, y: np.ndarray, by: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(x):
            return
        # the high bits deal buckets: entries of one bucket still differ in the low ones
        bucket = ((by >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        x, y, bucket = x[order], y[order], bucket[order]
        starts, sizes = _runs(bucket)
        rows = list(zip(starts.tolist(), (starts + sizes).tolist()))
        for at in range(0, len(rows), 64):
            some = rows[at : at + 64]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[starts[at : at + 64]]), pa.array(np.full(len(some), kind, np.int32)),
                    pa.array([x[a:b].tobytes() for a, b in some], pa.binary()), pa.array([y[a:b].tobytes() for a, b in some], pa.binary()),
                ],
                names=["bucket", "kind", "x", "y"],
            )


def _pairs_of(keys: np.ndarray, members: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a bucket's sorted entries, and which entries belong to large keys: those of many entries and those in ``cut``."""
    starts, sizes = _runs(keys)
    many = (sizes > SMALL) | np.isin(keys[starts], cut) if len(keys) else np.zeros(len(sizes), bool)
    made_a, made_b = [], []
    for gap in range(1, SMALL):
        # members of small keys ``gap`` places apart
        first = np.flatnonzero(np.repeat(~many, sizes)[: len(keys) - gap] & (keys[:-gap] == keys[gap:])) if len(keys) > gap else np.zeros(0, np.int64)
        made_a.append(members[first])
        made_b.append(members[first + gap])
    large = np.repeat(many, sizes)
    rest = large.copy()
    rest[starts] = False
    made_a.append(np.repeat(members[starts], sizes)[rest])
    made_b.append(members[rest])
    return np.concatenate(made_a), np.concatenate(made_b), large


def _array(chunks: list, dtype=np.uint64) -> np.ndarray:
    return np.frombuffer(b"".join(chunks), dtype)


def match(packed: DataFrame) -> DataFrame:
    """PAIRS rows: kind 0 has candidate pairs of members (a < b as unsigned), distinct within a bucket; kind 1 has (key, member)
    of all keys with more than SMALL members in all or in a map task."""

    def one(part: pa.Table) -> pa.Table:
        kinds = part["kind"].to_numpy()
        xs, ys = part["x"].to_pylist(), part["y"].to_pylist()

        def of(kind: int) -> tuple[np.ndarray, np.ndarray]:
            chosen = np.flatnonzero(kinds == kind).tolist()
            return _array([xs[i] for i in chosen]), _array([ys[i] for i in chosen])

        keys, members = _sorted(*of(0))
        a, b, large = _pairs_of(keys, members, of(3)[0])
        more_a, more_b = of(2)
        a, b = _distinct_pairs(np.concatenate((a, more_a)), np.concatenate((b, more_b)))
        hot_keys, hot_members = of(1)
        hot_keys, hot_members = np.concatenate((hot_keys, keys[large])), np.concatenate((hot_members, members[large]))
        return pa.table(
            {
                "kind": pa.array(np.repeat(np.array([0, 1], np.int32), [len(a), len(hot_keys)])),
                "a": pa.array(np.concatenate((a, hot_keys)).view(np.int64)),
                "b": pa.array(np.concatenate((b, hot_members)).view(np.int64)),
            }
        )

    return packed.groupBy("bucket").applyInArrow(one, PAIRS)
