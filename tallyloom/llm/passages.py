"""Passages that repeat across documents, by compact windows over token min-hashes.

The tokens of a text are its five-word shingles. Under one hash function every run of tokens has a smallest token; the runs
of at least LEAST tokens that share it form a compact window (start, centre, end), a node of the Cartesian tree over the
hash values. Only positions that are the minimum of some LEAST tokens are such nodes, so they come from sliding
minima and the tree is built over them alone. Windows with the same minimum meet in a bucket; seeds of one pair of documents whose windows
overlap under enough hash functions are joined by interval, and the words of both regions are compared in full.

A text keeps the passages it has first (by id); the result names every later repetition with its source. Windows of a
minimum with at most SMALL members are all paired. In larger ones each is paired with the first window of its minimum, and
with the first that also has the same token some way before or behind; a second pass over the texts then groups every
run of LEAST tokens inside such windows, so that whatever repeats word for word meets a document that has it. The same
pass sketches the tokens of such a window around its minimum: all windows of one minimum are compared by these sketches,
in blocks where there are many, and each meets the earlier ones that share most with it until none shares anything more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.frames import arrow_map, release, small_batches
from tallyloom.llm.ngram_join import FILTER_BITS, id_filter, place_filter, with_place
from tallyloom.llm.textbatch import Texts, mix, shingles
from tallyloom.session import written

WIDTH = 5
#: Tokens that a passage has at least: 50 words.
LEAST = 46
HASHES = 4
#: Hash functions whose windows must overlap in both texts.
ENOUGH = 2
PERCENT = 80
#: Words by which edits may shift two copies against each other inside one region.
SLACK = 16
#: Tokens without a partner that a passage may bridge: two words changed close together.
GAP = 12
#: Windows that a map task gathers before it packs them, and members of a minimum from which it pairs them itself.
WINDOW = 300_000
SMALL = 8
BUCKET_BYTES = 8 << 20

U64 = np.uint64
SEEDS = mix(np.arange(1, HASHES + 1, dtype=U64))
ENTRY = np.dtype([("key", "u8"), ("doc", "i8"), ("pos", "u8"), ("near", "u8")])
SEED = np.dtype([("b", "i8"), ("a", "i8"), ("pos_b", "u8"), ("pos_a", "u8"), ("hash", "i8")])
#: A run of LEAST tokens that stands in the window of a large minimum.
RUN = np.dtype([("key", "u8"), ("doc", "i8"), ("pos", "u8")])
#: Hash functions whose large minima are compared by sketches, and bits of a sketch.
SKETCHED = 3
BITS = 512
#: Bits that two sketches share where a passage may stand, and that a further partner adds: the tokens of one word.
SHARED = LEAST * PERCENT // 100
ADDED = WIDTH
#: Sketches that one task compares with each other, or with as many of another block.
BLOCK = 4096
#: The tokens around a large minimum: ``key`` names the exact ones, under HASHES plus the number of the hash function.
SPOT = np.dtype([("key", "u8"), ("doc", "i8"), ("pos", "u8"), ("low", "u8"), ("bits", "u8", (BITS // 64,))])
_PLACE = U64((1 << 28) - 1)
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def tokens_of(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in order (A-Z as a-z) and their numbers; texts below five words have none."""
    starts, ends = texts.words()
    counts = np.bincount(texts.owner(starts), minlength=len(texts))
    long = counts >= WIDTH
    hashes = texts.hashes(starts, ends, folded=True)[np.repeat(long, counts)]
    tokens, made = shingles(hashes, np.where(long, counts, 0)[long], WIDTH)
    sizes = np.zeros(len(texts), np.int64)
    sizes[long] = made
    return tokens, sizes


def compact_windows(values: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres, starts and ends (inclusive) of all compact windows of at least ``least`` tokens, as positions in the
    concatenated ``values``; the leftmost of equal minima counts."""
    n = len(values)
    none = np.zeros(0, np.int64)
    if n < least:
        return none, none, none
    ranked = (values & ~_PLACE) | np.arange(n, dtype=U64)
    low, width = ranked, 1
    while width * 2 <= least:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: n - least + 1], low[least - width : n - width + 1])
    stops = np.cumsum(sizes)
    stop_of = np.repeat(stops, sizes)
    first = np.arange(n - least + 1)
    low = low[first + least <= stop_of[: n - least + 1]]
    if not len(low):
        return none, none, none
    changes = np.ones(len(low), bool)
    changes[1:] = low[1:] != low[:-1]
    centres = np.unique((low[changes] & _PLACE).astype(np.int64))
    # nearest smaller centre on both sides: the Cartesian tree over the centres
    own = ranked[centres].tolist()
    places = centres.tolist()
    begin = (stop_of - np.repeat(sizes, sizes))[centres].tolist()
    end = stop_of[centres].tolist()
    starts, ends = [0] * len(places), [0] * len(places)
    stack: list[int] = []
    for i, (value, text) in enumerate(zip(own, begin)):
        if stack and begin[stack[-1]] != text:
            for k in stack:
                ends[k] = end[k] - 1
            stack.clear()
        while stack and own[stack[-1]] > value:
            ends[stack.pop()] = places[i] - 1
        starts[i] = places[stack[-1]] + 1 if stack else text
        stack.append(i)
    for k in stack:
        ends[k] = end[k] - 1
    return centres, np.array(starts), np.array(ends)


def _positions(centres: np.ndarray, starts: np.ndarray, ends: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Windows in 64 bits: the centre's place in its text and how far the window reaches before and behind it."""
    reach = [np.minimum(x, 65535).astype(U64) for x in (centres - starts, ends - centres)]
    return (centres - begin).astype(U64) << U64(32) | reach[0] << U64(16) | reach[1]


def entries(texts: Texts, ids: np.ndarray) -> np.ndarray:
    """The compact windows of all texts under all hash functions as ENTRY records."""
    tokens, sizes = tokens_of(texts)
    stops = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    half = LEAST // 2
    parts = []
    for j, seed in enumerate(SEEDS):
        values = mix(tokens ^ seed)
        centres, starts, ends = compact_windows(values, sizes)
        text = owner[centres]
        begin = (stops - sizes)[text]
        out = np.zeros(len(centres), ENTRY)
        out["key"] = (values[centres] & ~U64(7)) | U64(j)
        out["doc"] = ids[text]
        out["pos"] = _positions(centres, starts, ends, begin)
        before, after = centres - half, centres + half
        left = np.where(before >= begin, tokens[np.maximum(before, 0)] >> U64(32), U64(0))
        right = np.where(after < stops[text], tokens[np.minimum(after, max(len(tokens) - 1, 0))] >> U64(32), U64(0))
        out["near"] = left << U64(32) | right
        parts.append(out)
    return np.concatenate(parts)


def _places(keys: np.ndarray) -> np.ndarray:
    """Places of minima in a filter of FILTER_BITS bits."""
    return (mix(keys) >> U64(64 - FILTER_BITS)).astype(np.int64)


def _sums(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums and factors: (sums[b] - sums[a]) * back[a] is a hash of the tokens from a up to b, wherever they stand."""
    n = len(tokens)
    powers = np.full(n, _BASE, U64)
    back = np.full(n, _INVERSE, U64)
    powers[:1] = back[:1] = 1
    sums = np.zeros(n + 1, U64)
    np.cumsum(mix(tokens) * np.cumprod(powers, dtype=U64), dtype=U64, out=sums[1:])
    return sums, np.cumprod(back, dtype=U64)


def run_hashes(sums: np.ndarray, back: np.ndarray, least: int = LEAST) -> np.ndarray:
    """A hash of the ``least`` tokens from every position on, as far as there are so many."""
    return mix((sums[least:] - sums[:-least]) * back[: len(back) - least + 1]) if len(back) >= least else np.zeros(0, U64)


def _sketches(marks: np.ndarray, low: np.ndarray, high: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """One bit for each token from ``low`` to ``high`` (inclusive); ``marks`` are the bits of all tokens."""
    out = np.zeros((len(centres), BITS // 64), U64)
    for step in range(1 - LEAST, LEAST):
        at = centres + step
        row = np.flatnonzero((at >= low) & (at <= high))
        mark = marks[at[row]]
        out[row, mark >> 6] |= U64(1) << (mark & 63).astype(U64)
    return out


def runs(texts: Texts, ids: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """RUN records of all runs of LEAST tokens whose minimum the filter holds, under ENOUGH hash functions: those
    of one run then make seeds with the same partner under so many. And SPOT records of such minima."""
    tokens, sizes = tokens_of(texts)
    stops = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    sums, back = _sums(tokens)
    whole = run_hashes(sums, back)
    marks = (mix(tokens ^ U64(0x510E527FADE682D1)) >> U64(32)).astype(np.int64) % BITS
    parts, spots = [np.zeros(0, RUN)], [np.zeros(0, SPOT)]
    for j, seed in enumerate(SEEDS[:SKETCHED]):
        values = mix(tokens ^ seed)
        centres, starts, ends = compact_windows(values, sizes)
        place = _places((values[centres] & ~U64(7)) | U64(j))
        large = np.flatnonzero(wanted[place >> 6] >> (place & 63).astype(U64) & U64(1))
        centres, starts, ends = centres[large], starts[large], ends[large]
        text = owner[centres]
        low, high = np.maximum(starts, centres - LEAST + 1), np.minimum(ends, centres + LEAST - 1)
        spot = np.zeros(len(centres), SPOT)
        spot["low"] = (values[centres] & ~U64(7)) | U64(j)
        exact = (sums[high + 1] - sums[low]) * back[low] + mix(((high - low) << 32 | (centres - low)).astype(U64)) if len(low) else np.zeros(0, U64)
        spot["key"] = (mix(exact ^ spot["low"]) & ~U64(7)) | U64(HASHES + j)
        spot["doc"] = ids[text]
        spot["pos"] = _positions(centres, starts, ends, (stops - sizes)[text])
        spot["bits"] = _sketches(marks, low, high, centres)
        spots.append(spot)
        if j >= ENOUGH:
            continue
        many = np.maximum(np.minimum(ends - LEAST + 1, centres) - low + 1, 0)
        at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        out = np.zeros(len(at), RUN)
        out["key"] = (whole[at] & ~U64(7)) | U64(j)
        out["doc"] = np.repeat(ids[text], many)
        out["pos"] = np.repeat(_positions(centres, starts, ends, (stops - sizes)[text]), many)
        parts.append(out)
    return np.concatenate(parts), np.concatenate(spots)


def _firsts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (later, first) of row numbers with one key, one for each two windows, and which rows are of a first document."""
    order = np.lexsort((rows["pos"], rows["doc"], rows["key"]))
    key = rows["key"][order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(order)])
    first = np.repeat(order[starts], np.diff(np.concatenate((starts, [len(order)]))))
    own = rows["doc"][order] == rows["doc"][first]
    head = np.zeros(len(rows), bool)
    head[order[own]] = True
    later, first = order[~own], first[~own]
    # the runs of one window mostly have the same partner
    ends = [(rows["key"] & U64(7))[later], *(rows[n][x] for n in ("pos", "doc") for x in (later, first))]
    order = np.lexsort(ends)
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[order][1:] != x[order][:-1] for x in ends], axis=0)
    kept = order[new]
    return later[kept], first[kept], head


def _all_pairs(rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (later, earlier) of row numbers with one key in different documents; ``rows`` are sorted by key and document,
    ``sizes`` are those of their keys, at most SMALL."""
    later, earlier = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for gap in range(1, int(sizes.max(initial=0))):
        first = np.flatnonzero((rows["key"][:-gap] == rows["key"][gap:]) & (rows["doc"][:-gap] != rows["doc"][gap:]))
        later.append(first + gap)
        earlier.append(first)
    return np.concatenate(later), np.concatenate(earlier)


def _stars(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (later, first) of row numbers, and which rows are first of some group."""
    later, firsts = [], []
    head = np.zeros(len(rows), bool)
    for near in (None, rows["near"] >> U64(32), rows["near"] & U64(0xFFFFFFFF)):
        order = np.lexsort((rows["pos"], rows["doc"], rows["key"]) if near is None else (rows["pos"], rows["doc"], near, rows["key"]))
        key = rows["key"][order]
        edge = np.ones(len(order), bool)
        edge[1:] = key[1:] != key[:-1]
        if near is not None:
            edge[1:] |= near[order][1:] != near[order][:-1]
            edge |= near[order] == 0
        starts = np.flatnonzero(edge)
        first = np.repeat(order[starts], np.diff(np.concatenate((starts, [len(order)]))))
        head[order[starts]] = True
        other = rows["doc"][order] != rows["doc"][first]
        later.append(order[other])
        firsts.append(first[other])
    pair = np.unique(np.concatenate(later).astype(np.int64) << 32 | np.concatenate(firsts).astype(np.int64))
    return pair >> 32, pair & 0xFFFFFFFF, head


def _seeds(rows: np.ndarray, later: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros(len(later), SEED)
    out["b"], out["a"] = rows["doc"][later], rows["doc"][first]
    out["pos_b"], out["pos_a"] = rows["pos"][later], rows["pos"][first]
    out["hash"] = (rows["key"][later] & U64(7)).astype(np.int64)
    return out


def _packed(kind: int, rows: np.ndarray, by: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    if not len(rows):
        return
    bucket = ((mix(by) >> U64(32)) % U64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    ends = np.concatenate((starts[1:], [len(rows)]))
    for at in range(0, len(starts), 64):
        some = list(zip(starts[at : at + 64].tolist(), ends[at : at + 64].tolist()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[starts[at : at + 64]]), pa.array(np.full(len(some), kind, np.int32)), pa.array([rows[a:b].tobytes() for a, b in some], pa.binary())],
            names=["bucket", "kind", "data"],
        )


def _combined(made: list[tuple[np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Packs a map task's windows; minima with many members leave only the first of each group, paired with the others."""
    rows = np.concatenate([x for x, in made])
    rows = rows[np.argsort(rows["key"], kind="stable")]
    edge = np.concatenate(([True], rows["key"][1:] != rows["key"][:-1]))
    starts = np.flatnonzero(edge)
    sizes = np.diff(np.concatenate((starts, [len(rows)])))
    many = np.repeat(sizes > SMALL, sizes)
    hot = rows[many]
    later, first, head = _stars(hot)
    seeds = _seeds(hot, later, first)
    kept = np.concatenate((rows[~many], hot[head]))
    large = rows["key"][starts[sizes > SMALL]]
    yield from _packed(0, kept, kept["key"], buckets)
    yield from _packed(1, seeds, seeds["b"].astype(U64), buckets)
    yield from _packed(2, large, large, buckets)


def _combined_runs(made: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Packs a map task's runs and spots; of each run and of equal spots those of the first document leave, paired with the
    others."""
    for kind, rows in zip((0, 2), (np.concatenate(x) for x in zip(*made))):
        later, first, head = _firsts(rows)
        seeds = _seeds(rows, later, first)
        kept = rows[head]
        yield from _packed(kind, kept, kept["key"], buckets)
        yield from _packed(1, seeds, seeds["b"].astype(U64), buckets)


def _partners(rows: np.ndarray, sides: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (later, earlier) of row numbers of one minimum; ``rows`` are sorted by document. Each meets the one of an earlier
    document whose sketch shares most with its own, then the one that shares most of what is left, as long as that is
    ADDED or more. With ``sides`` only rows of different sides meet."""
    bits, docs = np.ascontiguousarray(rows["bits"]), rows["doc"]
    before = np.searchsorted(docs, docs)
    later, earlier = [], []
    for i in np.flatnonzero(before).tolist():
        shared = np.bitwise_count(bits[: before[i]] & bits[i]).sum(axis=1)
        near = shared >= SHARED
        if sides is not None:
            near &= sides[: before[i]] != sides[i]
        near = np.flatnonzero(near)
        left, adds = bits[i], shared[near]
        while len(near) and adds.max() >= ADDED:
            best = near[np.argmax(adds)]
            later.append(i)
            earlier.append(best)
            left = left & ~bits[best]
            adds = np.bitwise_count(bits[near] & left).sum(axis=1)
    return np.array(later, np.int64), np.array(earlier, np.int64)


def _distinct(seeds: np.ndarray) -> np.ndarray:
    """Each seed once: the runs of two windows mostly make the same one."""
    order = np.lexsort([seeds[n] for n in SEED.names])
    seeds = seeds[order]
    return seeds[np.concatenate(([True], seeds[1:] != seeds[:-1]))[: len(seeds)]]


def _merged(seeds: np.ndarray) -> np.ndarray:
    """Distinct seeds with those joined that are windows of one pair of documents under one hash function and shift and
    overlap: ``_regions`` makes the same of the joined window as of its parts. A joined window that the reaches of a seed
    can't hold stays in parts."""
    cb, ca = (seeds["pos_b"] >> U64(32)).astype(np.int64), (seeds["pos_a"] >> U64(32)).astype(np.int64)
    reach = [(seeds[n] >> U64(k) & U64(65535)).astype(np.int64) for n in ("pos_b", "pos_a") for k in (16, 0)]
    lb, rb, la, ra = cb - reach[0], cb + reach[1], ca - reach[2], ca + reach[3]
    order = np.lexsort((lb, cb - ca, seeds["hash"], seeds["a"], seeds["b"]))
    seeds, cb, ca, lb, rb, la, ra = (x[order] for x in (seeds, cb, ca, lb, rb, la, ra))
    if not len(seeds):
        return seeds
    key = [seeds["b"], seeds["a"], seeds["hash"], cb - ca]
    other = np.concatenate(([False], np.any([x[1:] != x[:-1] for x in key], axis=0)))
    group = np.cumsum(other)
    upto = np.maximum.accumulate(rb + (group << 33))
    apart = np.concatenate(([True], other[1:] | (lb[1:] + (group[1:] << 33) > upto[:-1])))
    starts = np.flatnonzero(apart)
    sizes = np.diff(np.append(starts, len(seeds)))
    ends = [np.minimum.reduceat(lb, starts), np.maximum.reduceat(rb, starts), np.minimum.reduceat(la, starts), np.maximum.reduceat(ra, starts)]
    lengths = [cb[starts] - ends[0], ends[1] - cb[starts], ca[starts] - ends[2], ends[3] - ca[starts]]
    short = np.all([x < 65536 for x in lengths], axis=0)
    out = seeds[starts]
    before_b, behind_b, before_a, behind_a = (np.clip(x, 0, 65535).astype(U64) for x in lengths)
    out["pos_b"] = cb[starts].astype(U64) << U64(32) | before_b << U64(16) | behind_b
    out["pos_a"] = ca[starts].astype(U64) << U64(32) | before_a << U64(16) | behind_a
    return np.concatenate((out[short], seeds[np.repeat(~short, sizes)]))


#: Columns of a region: the documents and the first and last tokens in both.
REGION = ("b", "a", "b0", "b1", "a0", "a1")
PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])


def regions(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(b, a, b0, b1, a0, a1): token regions of two documents that seeds show to be alike. Seeds are pairs of windows with one
    minimum in different documents, all of a small minimum, and of a large one as many as bring every run of LEAST tokens to
    a document that has it before. They travel packed by later document, and no seed is a row."""
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.length(text))).first()[0] or 0
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    # about one token per five code points, 2 / LEAST windows per token and hash function
    buckets = max(width, math.ceil(size / 5 * 2 / LEAST * HASHES * ENTRY.itemsize / BUCKET_BYTES))

    def packing(made, combined):
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, count = [], 0
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for first, end, texts in Texts.from_arrow(batch.column(1)).slices():
                    held.append(made(texts, ids[first:end]))
                    count += sum(len(x) for x in held[-1])
                    if count >= WINDOW:
                        yield from combined(held, buckets)
                        held, count = [], 0
                release()
            if count:
                yield from combined(held, buckets)

        return pack

    def parts(part: pa.Table, *kinds: np.dtype) -> list[np.ndarray]:
        of, data = part["kind"].to_pylist(), part["data"].to_pylist()
        return [np.frombuffer(b"".join(x for x, k in zip(data, of) if k == n), kind) for n, kind in enumerate(kinds)]

    def match(part: pa.Table) -> pa.Table:
        release()
        rows, paired, cut = parts(part, ENTRY, SEED, U64)
        rows = rows[np.lexsort((rows["pos"], rows["doc"], rows["key"]))]
        starts = np.flatnonzero(np.concatenate(([True], rows["key"][1:] != rows["key"][:-1]))[: len(rows)])
        sizes = np.diff(np.concatenate((starts, [len(rows)])))
        # a minimum that a map task has cut is large, however few of its windows are left
        large = (sizes > SMALL) | np.isin(rows["key"][starts], cut)
        many = np.repeat(large, sizes)
        few, hot = rows[~many], rows[many]
        later, first, _ = _stars(hot)
        made = _distinct(np.concatenate((paired, _seeds(few, *_all_pairs(few, sizes[~large])), _seeds(hot, later, first))))
        named = np.unique(_places(rows["key"][starts[large]])).astype(U64)
        packs = [*_packed(1, made, made["b"].astype(U64), buckets), *_packed(2, named, np.zeros(len(named), U64), buckets)]
        return pa.Table.from_batches(packs, PACKED)

    def match_runs(part: pa.Table) -> pa.Table:
        release()
        # a document's runs lie in many buckets: their seeds meet again by document before any of them is a row
        rows, paired, spots = parts(part, RUN, SEED, SPOT)
        made = [paired]
        for same in (rows, spots):
            later, first, head = _firsts(same)
            made.append(_seeds(same, later, first))
        made, kept = _distinct(np.concatenate(made)), spots[head]
        packs = [*_packed(1, made, made["b"].astype(U64), buckets), *_packed(2, kept, kept["low"], buckets)]
        return pa.Table.from_batches(packs, PACKED)

    def unpack_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(data, np.int64))], names=["place"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = np.frombuffer(data, SPOT)
                columns = [pa.array(np.ascontiguousarray(rows[n]).view(np.int64)) for n in ("low", "key", "doc", "pos")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([x.tobytes() for x in rows], pa.binary())], names=["low", "key", "doc", "pos", "spot"])

    def compare_spots(part: pa.Table) -> pa.Table:
        release()
        rows = np.frombuffer(b"".join(part["spot"].to_pylist()), SPOT)
        i, j, side = (part[n].to_numpy() for n in ("i", "j", "block"))
        order = np.lexsort((rows["pos"], rows["doc"], j, i, rows["low"]))
        rows, i, j, side = rows[order], i[order], j[order], side[order]
        edge = np.any([x[1:] != x[:-1] for x in (rows["low"], i, j)], axis=0)
        starts = np.concatenate(([0], np.flatnonzero(edge) + 1, [len(rows)]))
        made = [np.zeros(0, SEED)]
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            made.append(_seeds(rows[a:b], *_partners(rows[a:b], side[a:b] if i[a] != j[a] else None)))
        made = np.concatenate(made)
        return pa.Table.from_batches(_packed(1, made, made["b"].astype(U64), buckets), PACKED)

    def collapse(part: pa.Table) -> pa.Table:
        release()
        return _region_table(_merged(_distinct(parts(part, RUN, SEED)[1])))

    known = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long"), text)
    schema, columns = "bucket int, kind int, data binary", ", ".join(f"{n} long" for n in REGION)
    packed = known.mapInArrow(packing(lambda texts, ids: (entries(texts, ids),), _combined), schema)
    found = written(packed.groupBy("bucket").applyInArrow(match, schema), "seeds")
    wanted = place_filter(found.where("kind = 2").select("data").mapInArrow(unpack_places, "place long").distinct(), F.col("place"))
    found = found.where("kind = 1")
    if not wanted.any():
        return found.groupBy("bucket").applyInArrow(collapse, columns)
    again = known.mapInArrow(packing(lambda texts, ids: runs(texts, ids, wanted), _combined_runs), schema)
    matched = written(again.groupBy("bucket").applyInArrow(match_runs, schema), "second-seeds")
    spots = matched.where("kind = 2").select("data").mapInArrow(unpack, "low long, key long, doc long, pos long, spot binary")
    # minima with more sketches than one task should hold are cut into blocks, every two of which meet
    many = spots.groupBy("low").count().where(F.col("count") > BLOCK)
    many = many.select("low", F.ceil(F.col("count") / F.lit(float(BLOCK))).cast("int").alias("blocks"))
    cut = spots.join(F.broadcast(many), "low", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("key", "doc", "pos"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = cut.select("low", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "spot")
    units = units.withColumn("unit", F.pmod(F.xxhash64("low", "i", "j"), F.lit(buckets)).cast("int"))
    near = units.groupBy("unit").applyInArrow(compare_spots, schema)
    return found.unionByName(matched.where("kind = 1")).unionByName(near).groupBy("bucket").applyInArrow(collapse, columns)


def _regions(pos_b: np.ndarray, pos_a: np.ndarray, hashes: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Token regions (b0, b1, a0, a1), ends inclusive, where windows of enough hash functions overlap at one shift."""
    cb, ca = (pos_b >> 32), (pos_a >> 32)
    lb, rb = (cb - (pos_b >> 16 & 65535)).tolist(), (cb + (pos_b & 65535)).tolist()
    la, ra = (ca - (pos_a >> 16 & 65535)).tolist(), (ca + (pos_a & 65535)).tolist()
    # most pairs have a few seeds only: plain lists are faster there
    shift, kinds = (cb - ca).tolist(), hashes.tolist()
    groups: list[list[int]] = []
    last = None
    for i in sorted(range(len(shift)), key=shift.__getitem__):
        if last is None or shift[i] - last > SLACK:
            groups.append([])
        groups[-1].append(i)
        last = shift[i]
    out = []
    for rows in groups:
        reach, chain = -1, []
        for i in [*sorted(rows, key=lb.__getitem__), -1]:
            if chain and (i < 0 or lb[i] > reach):
                seen = {kinds[k] for k in chain}
                # seeds of sketches or of equal spots share a passage's tokens already
                if len(seen) >= ENOUGH or max(seen) >= HASHES:
                    out.append((min(lb[k] for k in chain), max(rb[k] for k in chain), min(la[k] for k in chain), max(ra[k] for k in chain)))
                reach, chain = -1, []
            if i >= 0:
                chain.append(i)
                reach = max(reach, rb[i])
    return out


def _region_table(seeds: np.ndarray) -> pa.Table:
    """The regions of all pairs of documents in ``seeds``, REGION columns."""
    seeds = seeds[np.lexsort((seeds["a"], seeds["b"]))]
    starts = np.flatnonzero(np.concatenate(([True], (seeds["b"][1:] != seeds["b"][:-1]) | (seeds["a"][1:] != seeds["a"][:-1])))[: len(seeds)])
    rows: list[tuple[int, ...]] = []
    for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(seeds)]):
        some = seeds[x:y]
        rows += [(int(some["b"][0]), int(some["a"][0]), *r) for r in _regions(some["pos_b"].view(np.int64), some["pos_a"].view(np.int64), some["hash"])]
    columns = np.array(rows, np.int64).reshape(-1, len(REGION)).T
    return pa.table({n: pa.array(np.ascontiguousarray(x)) for n, x in zip(REGION, columns)})


def _tokens(words: np.ndarray) -> np.ndarray:
    return shingles(mix(words.astype(U64)), np.array([len(words)]), WIDTH)[0]


def compare(words_b: np.ndarray, words_a: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int, int, int]]:
    """Repeated passages in two regions as word ranges (b start, b end, a start, a end), ends exclusive: at least LEAST tokens
    whose sets are similar enough, as long as they can be, starting and ending with a shared token."""
    if len(words_b) < LEAST + WIDTH - 1 or len(words_a) < LEAST + WIDTH - 1:
        return []
    tb, ta = _tokens(words_b), _tokens(words_a)
    order = np.argsort(ta, kind="stable")
    sorted_a = ta[order]
    at = np.minimum(np.searchsorted(sorted_a, tb), len(ta) - 1)
    place = np.where(sorted_a[at] == tb, order[at], -1)
    # a token that stands in several places of the source counts where the copy goes on, if it does
    several = (place >= 0) & (sorted_a[np.minimum(at + 1, len(ta) - 1)] == tb) & (at + 1 < len(ta))
    for i in np.flatnonzero(several[1:]).tolist():
        p = place[i] + 1
        if 0 < p < len(ta) and place[i + 1] != p and ta[p] == tb[i + 1]:
            place[i + 1] = p
    found = np.flatnonzero(place >= 0)
    if len(found) < LEAST * percent // 100:
        return []
    breaks = np.flatnonzero(np.diff(found) > GAP)
    todo = [(int(found[a]), int(found[b])) for a, b in zip(np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(found) - 1])))]
    out = []
    while todo:
        first, last = todo.pop()
        if last - first + 1 < LEAST:
            continue
        inner = found[(found >= first) & (found <= last)]
        spots = place[inner]
        a0, a1 = int(spots.min()), int(spots.max())
        own, other = np.unique(tb[first : last + 1]), np.unique(ta[a0 : a1 + 1])
        shared = len(np.intersect1d(own, other, assume_unique=True))
        if a1 - a0 + 1 >= LEAST and 100 * shared >= percent * (len(own) + len(other) - shared):
            out.append((first, last + WIDTH, a0, a1 + WIDTH))
            continue
        # split where the copy jumps or pauses most
        jumps = np.abs(np.diff(spots) - 1) + np.diff(inner) - 1
        if len(jumps) and jumps.max() > 0:
            k = int(np.argmax(jumps))
            todo += [(first, int(inner[k])), (int(inner[k + 1]), last)]
    return out


def _words(docs: DataFrame, wanted: np.ndarray, id_column: str, text: str) -> DataFrame:
    """(id, digest, words) of the texts that the filter lets through; words are 32-bit hashes in order."""

    def each(batch: pa.RecordBatch):
        place = batch.column(2).to_numpy(zero_copy_only=False)
        chosen = pa.array(np.flatnonzero(wanted[place >> 6] >> (place & 63).astype(U64) & U64(1)))
        ids, column, digests = (batch.column(i).take(chosen) for i in (0, 1, 3))
        for first, end, texts in Texts.from_arrow(column).slices():
            starts, ends = texts.words()
            words = (texts.hashes(starts, ends, folded=True) >> U64(32)).astype(np.uint32)
            cuts = np.searchsorted(starts, texts.offsets)
            yield {
                "id": ids.slice(first, end - first), "digest": digests.slice(first, end - first),
                "words": pa.array([words[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.binary()),
            }

    known = docs.where(F.col(id_column).isNotNull())
    placed = with_place(known.select(F.col(id_column).cast("long").alias(id_column), text, F.xxhash64(text).alias("__digest")), id_column)
    return arrow_map(placed, [id_column, text, "__place", "__digest"], each, "id long, digest long, words binary")


def repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per repeated passage: id, start_word, end_word (exclusive), source_id, source_start, source_end.

    The document with the smaller id is the source. Texts below 50 words, empty and null texts have no passages; rows
    with a null id take no part; of rows that share an id each is compared with other ids only. Other columns are
    ignored; an empty table gives no rows.
    """
    return _repeats(docs, id_column, text).drop("digest").distinct()


def _repeats(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """``repeats`` with the digest of the text that repeats the passage, as rows that share an id may differ in their text; the
    same row may come several times."""
    found = written(regions(docs, id_column, text), "regions")
    copies = _words(docs, id_filter(found.select("b").distinct(), "b"), id_column, text).withColumnRenamed("id", "b")
    sources = _words(docs, id_filter(found.select("a").distinct(), "a"), id_column, text).withColumnRenamed("id", "a").drop("digest")

    names = ["b", "a", "b0", "b1", "a0", "a1", "digest"]
    sliced = copies.join(found, "b").select(*names, "words")

    def slices(batch: pa.RecordBatch):
        made = [w[4 * x : 4 * (y + WIDTH)] for w, x, y in zip(*(batch.column(i).to_pylist() for i in (7, 2, 3)))]
        yield {n: batch.column(i) for i, n in enumerate(names)} | {"words_b": pa.array(made, pa.binary())}

    cut_rows = arrow_map(sliced, [*names, "words"], slices, ", ".join(f"{n} long" for n in names) + ", words_b binary", rows=256)
    both = cut_rows.join(sources.withColumnRenamed("words", "words_a"), "a")

    def verify(batch: pa.RecordBatch):
        rows = {k: [] for k in ("id", "start_word", "end_word", "source_id", "source_start", "source_end", "digest")}
        for b, a, b0, a0, a1, wb, wa, digest in zip(*(batch.column(i).to_pylist() for i in range(8))):
            words_b = np.frombuffer(wb, np.uint32)
            words_a = np.frombuffer(wa[4 * a0 : 4 * (a1 + WIDTH)], np.uint32)
            for x, y, u, v in compare(words_b, words_a):
                for k, value in zip(rows, (b, b0 + x, b0 + y, a, a0 + u, a0 + v, digest)):
                    rows[k].append(value)
        yield {k: pa.array(v, pa.int64()) for k, v in rows.items()}

    made = arrow_map(
        both, ["b", "a", "b0", "a0", "a1", "words_b", "words_a", "digest"], verify,
        "id long, start_word long, end_word long, source_id long, source_start long, source_end long, digest long", rows=256,
    )
    return made.withColumnRenamed("id", id_column)


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with every repeated passage cut out of the later text, words and the white space behind them; a text
    that loses everything stays as an empty text. ``n_chars``, if there is such a column, is counted anew where a
    text changes. Of rows that share an id each loses the passages of its own text only. Columns, their order and all
    other rows stay."""
    found = written(_repeats(docs, id_column, text), "repeats")
    spans = found.groupBy(F.col(id_column).alias("__id"), F.col("digest").alias("__of")).agg(
        F.sort_array(F.collect_set(F.struct("start_word", "end_word"))).alias("__spans")
    )
    wanted = id_filter(found.select(F.col(id_column).alias("id")).distinct(), "id")
    names = docs.columns
    known = F.col(id_column).isNotNull()
    place = with_place(docs.where(known).withColumn("__key", F.col(id_column).cast("long")), "__key")
    hit = _passing(place, wanted)
    own = (F.col("__key") == F.col("__id")) & (F.xxhash64(text) == F.col("__of"))
    touched = hit.where("__hit").drop("__hit").join(spans, own, "left")
    at, kind = names.index(text), docs.schema

    def each(batch: pa.RecordBatch):
        column = batch.column(at)
        spans_of = batch.column(len(names)).to_pylist()
        made = []
        for first, end, texts in Texts.from_arrow(column).slices():
            starts, ends = texts.words()
            cuts = np.searchsorted(starts, texts.offsets)
            for i in range(end - first):
                a, b = int(texts.offsets[i]), int(texts.offsets[i + 1])
                own = starts[cuts[i] : cuts[i + 1]].tolist()
                parts, upto = [], a
                for span in spans_of[first + i] or []:
                    x = own[span["start_word"]]
                    y = own[span["end_word"]] if span["end_word"] < len(own) else b
                    if x > upto:
                        parts.append(texts.data[upto:x].tobytes())
                    upto = max(upto, y)
                parts.append(texts.data[upto:b].tobytes())
                made.append(b"".join(parts).decode("utf-8"))
        made = [m if ok else None for m, ok in zip(made, column.is_valid().to_pylist())]
        yield {n: (pa.array(made, pa.string()) if i == at else batch.column(i)) for i, n in enumerate(names)}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind)
    cut = arrow_map(touched, [*names, "__spans"], each, schema)
    if n_chars in names:
        cut = cut.withColumn(n_chars, F.length(text).cast(kind[n_chars].dataType))
    rest = hit.where("not __hit").select(*names).unionByName(docs.where(~known))
    return cut.select(*names).unionByName(rest)


def _passing(placed: DataFrame, wanted: np.ndarray) -> DataFrame:
    """Adds __hit: whether the filter holds the row's place; the filter travels as one packed literal."""
    from pyspark.sql import types as T

    def test(batches):
        for batch in batches:
            place = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            hit = pa.array((wanted[place >> 6] >> (place & 63).astype(U64) & U64(1)).astype(bool))
            yield pa.RecordBatch.from_arrays([*batch.columns, hit], names=[*batch.schema.names, "__hit"])

    return placed.mapInArrow(test, T.StructType([*placed.schema.fields, T.StructField("__hit", T.BooleanType())]))
