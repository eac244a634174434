"""N-gram Jaccard join by PartEnum signatures, exact for any group sizes.

Sets of word shingles fall into bands of similar size. Within a band the hashed domain of shingles is cut into more
partitions than two sufficiently similar sets can differ in, and the signature of a partition is the set's projection on it
(pairs of partitions with subsets of one, in PartEnum's terms); a linked pair then shares a signature. A set sends the
signatures of its first h + 1 partitions that aren't empty, where h bounds the difference from any partner: at most h
of them can differ, so one of them agrees. Sets that fill too few partitions for that also send those of a domain cut so
finely that each shingle is alone: the prefix of h + 1 shingles, which every set has.

Shingles that a sample shows to be frequent are left out of the domain first, because a projection on a passage that
many texts share says nothing; sets with too little else use the full domain among themselves. The choice of shingles only
steers the work: a smaller domain can only lessen a difference, so every choice gives the same links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.buckets import PACKED, Packer, bucket_count, match
from tallyloom.llm.components import components
from tallyloom.llm.frames import arrow_map, release
from tallyloom.llm.textbatch import Texts, mix, shingles
from tallyloom.session import written

WIDTH = 5
#: Documents link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: One text in SAMPLE shows which shingles are frequent: those in FREQUENT sampled texts, the most frequent KNOWN of them.
SAMPLE = 32
FREQUENT = 6
KNOWN = 65_536
#: Partitions of the finest domain.
ALONE = 1 << 32
#: Bits of the filter that tells which texts take part in a comparison; fixed, whatever the input.
FILTER_BITS = 24

U64 = np.uint64


def bands(most: int) -> np.ndarray:
    """Upper ends of the size bands up to the one that holds ``most``; each is up to 25/16 of its lower end."""
    ends, low = [], 1
    while not ends or ends[-1] < most:
        ends.append(max(low, low * 25 // 16))
        low = ends[-1] + 1
    return np.array(ends, np.int64)


BANDS = bands(1 << 34)


def partner_sizes(sizes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The largest size that a partner of a set of each size can have."""
    return sizes * 100 // percent


def most_apart(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Elements in which linked sets of sizes a and b differ at most."""
    return (a + b) * (100 - percent) // (100 + percent)


def shingle_sets(texts: Texts, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text (A-Z as a-z), one text after another, and their numbers."""
    starts, ends = texts.words()
    counts = np.bincount(texts.owner(starts), minlength=len(texts))
    hashes, made = shingles(texts.hashes(starts, ends, folded=True), counts, width)
    stops = np.cumsum(made)
    sets = [np.unique(hashes[a:b]) for a, b in zip((stops - made).tolist(), stops.tolist())]
    return (np.concatenate(sets) if sets else hashes), np.array([len(x) for x in sets], np.int64)


def digests(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 63-bit name of each set, so that it is positive as a long; equal sets have equal names."""
    stops = np.cumsum(sizes)
    sums = np.zeros(len(sets) + 1, U64)
    np.cumsum(mix(sets ^ U64(0x6A09E667F3BCC909)), dtype=U64, out=sums[1:])
    return mix(sums[stops] - sums[stops - sizes] + sizes.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(1)


def _projections(
    sets: np.ndarray, owner: np.ndarray, n: int, partitions: np.ndarray, needed: np.ndarray, salt: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures and their owners: the first ``needed`` non-empty partitions of each set, or all where it has fewer,
    and which sets have enough."""
    spread = mix(sets ^ U64(0xBB67AE8584CAA73B))
    part = ((spread >> U64(31)) % np.maximum(partitions[owner], 1).astype(U64)).astype(np.int64)
    order = np.argsort(owner << 33 | part, kind="stable")
    cell = (owner << 33 | part)[order]
    if not len(cell):
        return np.zeros(0, U64), np.zeros(0, np.int64), needed <= 0
    edge = np.ones(len(cell), bool)
    edge[1:] = cell[1:] != cell[:-1]
    starts = np.flatnonzero(edge)
    sums = np.add.reduceat(mix(sets[order] ^ U64(0x3C6EF372FE94F82B)), starts)
    sizes = np.diff(np.concatenate((starts, [len(cell)])))
    holder, number = cell[starts] >> 33, cell[starts] & ((1 << 33) - 1)
    filled = np.bincount(holder, minlength=n)
    rank = np.arange(len(starts)) - (np.cumsum(filled) - filled)[holder]
    keep = rank < needed[holder]
    keys = mix(sums + sizes.astype(U64) * U64(0xA54FF53A5F1D36F1)) ^ mix(number.astype(U64) * U64(0x510E527FADE682D1) ^ salt[holder])
    return keys[keep], holder[keep], filled >= needed


def signatures(sets: np.ndarray, sizes: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of the sets, and the number of the set each belongs to. ``frequent`` is sorted."""
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    common = np.zeros(len(sets), bool)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, sets), len(frequent) - 1)
        common = frequent[at] == sets
    home = np.searchsorted(BANDS, np.maximum(sizes, 1))
    largest = partner_sizes(sizes, percent)
    keys, holders = [], []
    for step in (0, 1):
        band = home + step
        takes = (sizes > 0) & ((largest > BANDS[home]) if step else True)
        apart = most_apart(sizes, np.minimum(largest, BANDS[band]) if step == 0 else largest, percent)
        # a tenth more partitions than the largest pair of the band can differ in
        partitions = most_apart(BANDS[band], BANDS[band], percent) * 11 // 10 + 1
        needed = np.where(takes, apart + 1, 0)
        salt = mix(band.astype(U64) + U64(0x1F83D9ABFB41BD6B))
        use = takes[owner] & ~common
        made, held, enough = _projections(sets[use], owner[use], n, partitions, needed, salt)
        keys.append(made)
        holders.append(held)
        if len(frequent):
            left = takes & ~enough
            use = left[owner]
            salt = mix(salt ^ U64(0x5BE0CD19137E2179))
            made, held, enough = _projections(sets[use], owner[use], n, partitions, np.where(left, needed, 0), salt)
            keys.append(made)
            holders.append(held)
            enough |= ~left
        # two sets of which one fills enough partitions share one of these; the others meet in single shingles
        left = takes & ~enough
        use = left[owner]
        salt = mix(salt ^ U64(0x1F3D5B79A6C8E042))
        made, held, enough = _projections(sets[use], owner[use], n, np.full(n, ALONE), np.where(left, needed, 0), salt)
        keys.append(made)
        holders.append(held)
        sparse = np.flatnonzero(left & ~enough)  # shingles of one set with one place of 2^32: next to never
        keys.append(mix(salt[sparse] ^ U64(0xCBBB9D5DC1059ED8)))
        holders.append(sparse)
    return np.concatenate(keys), np.concatenate(holders)


def _meta(docs: DataFrame, id_column: str, text: str, width: int) -> DataFrame:
    kind = docs.schema[id_column].dataType.simpleString()

    def each(batch: pa.RecordBatch):
        for first, end, texts in Texts.from_arrow(batch.column(1)).slices():
            sets, sizes = shingle_sets(texts, width)
            yield {"id": batch.column(0).slice(first, end - first), "n_shingles": sizes, "digest": digests(sets, sizes).view(np.int64)}

    return arrow_map(docs, [id_column, text], each, f"id {kind}, n_shingles long, digest long")


def frequent_shingles(docs: DataFrame, id_column: str, text: str, width: int) -> np.ndarray:
    """At most KNOWN shingles that stand in many of the sampled texts, sorted. They steer the work only."""
    some = docs.where(F.pmod(F.xxhash64(id_column, F.lit(3)), F.lit(SAMPLE)) == 0).select(text).dropDuplicates([text])

    def each(batch: pa.RecordBatch):
        for _, _, texts in Texts.from_arrow(batch.column(0)).slices():
            yield {"h": shingle_sets(texts, width)[0].view(np.int64)}

    counts = arrow_map(some, [text], each, "h long").groupBy("h").count().where(F.col("count") >= FREQUENT)
    rows = counts.orderBy(F.desc("count"), "h").limit(KNOWN).collect()
    return np.sort(np.array([r["h"] for r in rows], np.int64).view(U64))


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A filter of FILTER_BITS bits that holds every id."""
    return place_filter(ids, F.pmod(F.xxhash64(column), F.lit(1 << FILTER_BITS)))


def place_filter(rows: DataFrame, place: Column) -> np.ndarray:
    """A filter of FILTER_BITS bits that holds every place: built from at most 2**(FILTER_BITS - 6) aggregated rows."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    words = rows.select(F.shiftright(place, 6).alias("word"), bit.alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 6), U64)
    for r in words.groupBy("word").agg(F.bit_or("bits").alias("bits")).collect():
        out[r["word"]] = np.int64(r["bits"]).view(U64)
    return out


def with_place(docs: DataFrame, id_column: str) -> DataFrame:
    return docs.withColumn("__place", F.pmod(F.xxhash64(id_column), F.lit(1 << FILTER_BITS)))


def _sequences(docs: DataFrame, wanted: np.ndarray, id_column: str, text: str, width: int) -> DataFrame:
    """(id, digest, words) of the texts that the filter lets through; words are 64-bit hashes in order."""
    kind = docs.schema[id_column].dataType.simpleString()

    def each(batch: pa.RecordBatch):
        place = batch.column(2).to_numpy(zero_copy_only=False)
        chosen = np.flatnonzero(wanted[place >> 6] >> (place & 63).astype(U64) & U64(1))
        ids, column = batch.column(0).take(pa.array(chosen)), batch.column(1).take(pa.array(chosen))
        for first, end, texts in Texts.from_arrow(column).slices():
            sets, sizes = shingle_sets(texts, width)
            starts, ends = texts.words()
            words = texts.hashes(starts, ends, folded=True)
            cuts = np.searchsorted(starts, texts.offsets)
            yield {
                "id": ids.slice(first, end - first), "digest": digests(sets, sizes).view(np.int64),
                "words": pa.array([words[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.binary()),
            }

    placed = with_place(docs.where(F.col(id_column).isNotNull()), id_column)
    return arrow_map(placed, [id_column, text, "__place"], each, f"id {kind}, digest long, words binary")


def _set_of(words: bytes, width: int) -> np.ndarray:
    own = np.frombuffer(words, U64)
    return np.unique(shingles(own, np.array([len(own)]), width)[0])


def verified(pairs: DataFrame, sequences: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b, id_a, id_b) whose sets are linked, as (a, b): the words of both come by join and the sets are
    compared in full."""
    left = sequences.select(F.col("digest").alias("a"), F.col("id").alias("id_a"), F.col("words").alias("words_a"))
    right = sequences.select(F.col("digest").alias("b"), F.col("id").alias("id_b"), F.col("words").alias("words_b"))
    both = pairs.join(left, ["a", "id_a"]).join(right, ["b", "id_b"])

    def each(batch: pa.RecordBatch):
        last, own = None, np.zeros(0, U64)
        linked = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if y != last:
                last, own = y, _set_of(y, width)
            other = _set_of(x, width)
            shared = len(np.intersect1d(own, other, assume_unique=True))
            linked.append(100 * shared >= percent * (len(own) + len(other) - shared))
        keep = pa.array(linked, pa.bool_())
        yield {"a": batch.column(0).filter(keep), "b": batch.column(1).filter(keep)}

    return arrow_map(both, ["a", "b", "words_a", "words_b"], each, "a long, b long", rows=256)


def link_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles and component_id, the smallest id it reaches over links.

    Texts without words are linked with nothing and are their own component; rows with a null id take no part in links and
    have a null component. Rows with words that share an id are one node, whatever their texts. Equal sets are one class, compared once. Other columns
    are ignored; an empty table gives no rows.
    """
    meta = written(_meta(docs, id_column, text, width), "sets")
    classes = meta.where(F.col("id").isNotNull() & (F.col("n_shingles") > 0)).groupBy("digest").agg(
        F.min("id").alias("rep"), F.max("n_shingles").alias("n")
    )
    classes = written(classes, "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = bucket_count(docs, total * 2 // 5)
    frequent = frequent_shingles(docs, id_column, text, width)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(buckets)
        for batch in batches:
            for _, _, texts in Texts.from_arrow(batch.column(0)).slices():
                sets, sizes = shingle_sets(texts, width)
                keys, holders = signatures(sets, sizes, frequent, percent)
                yield from packer.add(keys, digests(sets, sizes)[holders])
            release()
        yield from packer.flush()

    packed = docs.where(F.col(id_column).isNotNull()).select(text).mapInArrow(pack, PACKED)
    found = written(match(packed), "candidates")
    pairs = sized(found.where("kind = 0").select("a", "b").distinct(), classes, percent)
    edges = _compare(docs, pairs, id_column, text, width, percent)
    known = meta.where(F.col("id").isNotNull() & (F.col("n_shingles") > 0))
    several = known.groupBy("id").agg(F.min("digest").alias("a"), F.max("digest").alias("most")).where("a <> most")
    joined = components(edges.unionByName(known.join(several, "id").select("a", F.col("digest").alias("b"))))

    # keys with many members were only compared with one of them: go on where the members aren't one component
    large = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("digest")).distinct()
    placed = large.join(joined.withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    placed = written(placed, "large-keys")
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("digest").alias("center"))
    rows = placed.join(mixed.where("x <> y").select("key", "center"), "key").select("center", "digest", "component").distinct()
    rows = written(rows.join(classes.select("digest", F.col("rep").alias("id")), "digest"), "open-members")
    if not rows.isEmpty():
        more = _within_groups(docs, rows, id_column, text, width, percent)
        joined = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    # components of classes, then of the documents in them; a class without links is its own
    reps = classes.select("digest", "rep").join(joined.withColumnRenamed("node", "digest"), "digest", "left")
    reps = reps.withColumn("component", F.coalesce("component", "digest"))
    least = reps.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = reps.join(least, "component").select("digest", "component_id")
    full = meta.where("n_shingles > 0").join(named, "digest", "left")
    alone = meta.where("n_shingles = 0").withColumn("component_id", F.col("id"))
    rows = full.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
    return rows.unionByName(alone.select("id", "n_shingles", "component_id")).withColumnRenamed("id", id_column)


#: Members of a group that one task compares with each other, or with as many of another block.
BLOCK = 1024
#: Counters of a set's sketch: elements per hash class. Their differences never exceed the sets' difference.
CLASSES = 256


def _sketch(own: np.ndarray) -> np.ndarray:
    return np.minimum(np.bincount((own >> U64(40)).astype(np.int64) & (CLASSES - 1), minlength=CLASSES), 255).astype(np.int16)


def _joined_members(words: list[bytes], labels: np.ndarray, sides: np.ndarray | None, width: int, percent: int) -> list[tuple[int, int]]:
    """Links (row, row) between members of different components, one for each two components that they join.

    Pairs whose sketches differ more than linked sets can are passed over; the rest are compared in full unless they are
    joined by then. With ``sides`` only rows of different sides meet.
    """
    sets = [_set_of(w, width) for w in words]
    sizes = np.array([len(x) for x in sets], np.int64)
    _, label, share = np.unique(labels, return_inverse=True, return_counts=True)
    # members of one largest component last: rows after the last other one need no turn of their own
    order = np.lexsort((label, share[label]))
    turns = len(order) if sides is not None else int(np.count_nonzero(label != label[order[-1]]))
    sketches = np.stack([_sketch(sets[i]) for i in order])
    parent = list(range(len(share)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for at in range(turns):
        i = int(order[at])
        rest = order[at + 1 :]
        a, b = sizes[i], sizes[rest]
        fits = (np.minimum(a, b) * 100 >= np.maximum(a, b) * percent) & (label[rest] != label[i])
        if sides is not None:
            fits &= sides[rest] != sides[i]
        chosen = np.flatnonzero(fits)
        if not len(chosen):
            continue
        apart = np.abs(sketches[at + 1 + chosen] - sketches[at]).sum(axis=1)
        near = apart <= most_apart(a, b[chosen], percent)
        for j in rest[chosen[near]][np.argsort(apart[near], kind="stable")].tolist():
            p, q = root(int(label[i])), root(int(label[j]))
            if p != q:
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * shared >= percent * (sizes[i] + sizes[j] - shared):
                    parent[max(p, q)] = min(p, q)
                    links.append((i, j))
    return links


def _within_groups(docs: DataFrame, rows: DataFrame, id_column: str, text: str, width: int, percent: int) -> DataFrame:
    """Verified links (a, b) that join components inside the groups of ``rows`` (center, digest, component, id).

    Keys with one smallest member form a group, since their members are mostly the same. A group larger than BLOCK is
    cut into blocks, and every two blocks meet in a task of their own.
    """
    sizes = rows.groupBy("center").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(BLOCK))).cast("int").alias("blocks"))
    cut = rows.join(sizes, "center").withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = cut.select(
        "center", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "digest", "component", "id"
    )
    sequences = _sequences(docs, id_filter(rows.select("id").distinct(), "id"), id_column, text, width)
    full = placed.join(sequences, ["digest", "id"])

    def one(part: pa.Table) -> pa.Table:
        digest = part["digest"].to_numpy()
        _, first = np.unique(digest, return_index=True)
        digest, labels, block = digest[first], part["component"].to_numpy()[first], part["block"].to_numpy()[first]
        words = part["words"].take(pa.array(first)).to_pylist()
        apart = part["i"][0].as_py() != part["j"][0].as_py()
        links = _joined_members(words, labels, block if apart else None, width, percent)
        ends = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": digest[ends[:, 0]], "b": digest[ends[:, 1]]})

    return written(full.groupBy("center", "i", "j").applyInArrow(one, "a long, b long"), "links")


def sized(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, id_a, id_b) whose sizes allow a link."""
    left = classes.select(F.col("digest").alias("a"), F.col("rep").alias("id_a"), F.col("n").alias("n_a"))
    right = classes.select(F.col("digest").alias("b"), F.col("rep").alias("id_b"), F.col("n").alias("n_b"))
    both = pairs.join(left, "a").join(right, "b")
    return both.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent).select("a", "b", "id_a", "id_b")


def _compare(docs: DataFrame, pairs: DataFrame, id_column: str, text: str, width: int, percent: int) -> DataFrame:
    pairs = written(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    sequences = written(_sequences(docs, id_filter(ids, "id"), id_column, text, width), "sequences")
    return written(verified(pairs, sequences, width, percent), "links")
