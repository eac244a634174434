"""Merkle manifest of a table: a leaf per row, a binary tree per language, one over the languages, and a proof per row.

Leaves are hashed where the rows lie. Their digests alone are put in order and dealt into leaf partitions: ranges of
(tree, order), each a stretch of neighbouring leaves in one or more trees. Every leaf partition hashes up the nodes that
it covers alone; only the topmost of these, two per level and stretch at most, travel, and the nodes above them are computed per tree.
To prove its leaves, a leaf partition works out the smallest set of node coordinates that its own leaves don't give
(octopus): per level the neighbour of its first and of its last known node, where these have one outside. It fetches these
few nodes in one join, derives all shared interior nodes once, and expands and folds the proof of each leaf from them.

A node is named by (tree, level, place); level 0 are leaves, trees are numbered by the order of languages, and TOP is the tree
over the roots of the languages. A last node without a neighbour is hashed alone, once per level.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import written

#: Number of the tree over the roots of all languages.
TOP = -1
#: Leaves per leaf partition, about.
LEAVES = 1 << 16

NODES = "tree long, level int, place long, hash string"


def field_digest(fields: list[Column]) -> Column:
    """H of fields one after another: each ``-`` if null, else its UTF-8 byte count, ``:`` and its text."""
    parts = []
    for f in fields:
        text = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def node(*children: str) -> str:
    """H of child digests, all as hex text."""
    return sha256("".join(children).encode()).hexdigest()


def widths(leaves: int) -> list[int]:
    """Nodes per level, from the leaves to the root."""
    out = [leaves]
    while out[-1] > 1:
        out.append(-(-out[-1] // 2))
    return out


def parents(first: int, nodes: list[str], width: int) -> tuple[int, list[str]]:
    """The parents that neighbouring nodes (from place ``first`` of a level of ``width`` nodes) give without others."""
    skip = first % 2
    known = nodes[skip:]
    made = [node(*known[i : i + 2]) for i in range(0, len(known) - 1, 2)]
    if len(known) % 2 and first + len(nodes) == width:
        made.append(node(known[-1]))
    return (first + skip) // 2, made


def missing(first: int, count: int, leaves: int) -> Iterator[tuple[int, int]]:
    """Coordinates (level, place) of the nodes that ``count`` neighbouring leaves lack to compute the root: the fewest."""
    low, high = first, first + count - 1
    for level, width in enumerate(widths(leaves)[:-1]):
        if low % 2:
            yield level, low - 1
        if high % 2 == 0 and high + 1 < width:
            yield level, high + 1
        low, high = low // 2, high // 2


def frontier(first: int, nodes: list[str], leaves: int) -> Iterator[tuple[int, int, str]]:
    """The topmost nodes that neighbouring leaves give alone: with those of all other stretches they give every node above."""
    for level, width in enumerate(widths(leaves)):
        if width == 1 and nodes:
            yield level, first, nodes[0]
            return
        last = first + len(nodes) - 1
        if nodes and first % 2:
            yield level, first, nodes[0]
        if nodes and last % 2 == 0 and last + 1 < width:
            yield level, last, nodes[-1]
        first, nodes = parents(first, nodes, width)


def above(known: dict[tuple[int, int], str], leaves: int) -> dict[tuple[int, int], str]:
    """``known`` nodes of one tree and all nodes that follow from them."""
    levels = widths(leaves)
    out = dict(known)
    by_level: list[set[int]] = [set() for _ in levels]
    for level, place in known:
        by_level[level].add(place)
    for level, width in enumerate(levels[:-1]):
        for parent in {p // 2 for p in by_level[level]}:
            pair = [p for p in (2 * parent, 2 * parent + 1) if p < width]
            if (level + 1, parent) not in out and all(p in by_level[level] for p in pair):
                out[level + 1, parent] = node(*(out[level, p] for p in pair))
                by_level[level + 1].add(parent)
    return out


def filled(first: int, nodes: list[str], leaves: int, fetched: dict[tuple[int, int], str]) -> list[tuple[int, list[str]]]:
    """Per level the first place and the known nodes of a stretch, the fetched ones at both ends included."""
    out = []
    for level, width in enumerate(widths(leaves)):
        if first % 2 and (level, first - 1) in fetched:
            first, nodes = first - 1, [fetched[level, first - 1], *nodes]
        if (level, first + len(nodes)) in fetched:
            nodes = [*nodes, fetched[level, first + len(nodes)]]
        out.append((first, nodes))
        first, nodes = parents(first, nodes, width)
    return out


def path(place: int, levels: list[tuple[int, list[str]]], leaves: int) -> list[tuple[str, int]]:
    """Per level the hex digest of a leaf's sibling ("" if it has none) and the side it stands on (0 left, 1 right)."""
    out = []
    for (first, nodes), width in zip(levels, widths(leaves)[:-1]):
        other = place ^ 1
        out.append((nodes[other - first] if other < width else "", int(other > place)))
        place //= 2
    return out


def fold(digest: str, siblings: list[tuple[str, int]]) -> str:
    """The root that a leaf (hex) and the siblings on its path give."""
    for other, right in siblings:
        digest = sha256((digest + other if right else other + digest).encode()).hexdigest()
    return digest


def _null_first(c: Column) -> list[Column]:
    return [c.isNotNull(), c.cast("binary")]


def _node_table(rows: list[tuple[int, int, int, str]]) -> pa.Table:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string()]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["tree", "level", "place", "hash"])


def proofs(leaves: DataFrame, by: str, id_column: str, leaf: str, shown: str, with_siblings: bool = False) -> DataFrame:
    """Adds subroot, root, proof_sha256 (H of the siblings from leaf to root), folded_root and, on request, the siblings (array
    of hex digests, empty where a node has none) to ``leaves``.

    ``by`` names the tree of a row (a text or null), ``id_column`` the order in it (nulls first), ``leaf`` the hex
    digest that stands in the tree and ``shown`` the one (or null for the same) that the proof is checked with: folded_root is
    what it gives with the siblings of the leaf. Rows of one tree and id are ordered by their leaf; equal ones differ by place only.
    There is one tree per value of ``by``, and their roots meet in one task: values are names, not keys of rows.
    """
    spark = leaves.sparkSession
    rows = written(leaves.withColumn("__row", F.monotonically_increasing_id()), "merkle-leaves")
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), math.ceil(rows.count() / LEAVES))
    order = [*_null_first(F.col(by)), F.col(id_column).asc_nulls_first(), F.col(leaf), F.col("__row")]
    placed = rows.repartitionByRange(width, *order).sortWithinPartitions(*order)
    # a row's number inside its partition, and the partition, stay as they are once written
    placed = placed.withColumn("__at", F.monotonically_increasing_id())
    placed = written(placed.withColumn("__part", F.shiftright("__at", 33)), "merkle-order")

    parts = placed.groupBy("__part", by).agg(F.count(F.lit(1)).alias("count"), F.min("__at").alias("begin"))
    trees = parts.groupBy(by).agg(F.sum("count").alias("leaves"))
    names = Window.orderBy(*_null_first(F.col(by)))
    trees = trees.select(
        F.col(by).alias("__name"), "leaves", (F.row_number().over(names) - 1).cast("long").alias("tree"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("trees"),
    )
    upto = Window.partitionBy("tree").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.join(trees, F.col(by).eqNullSafe(F.col("__name"))).withColumn("first", F.coalesce(F.sum("count").over(upto), F.lit(0)))
    stretches = written(parts.select("__part", "tree", "leaves", "trees", "first", "count", "begin"), "merkle-stretches")

    def kept(part: pa.Table) -> list[dict]:
        return sorted(part.to_pylist(), key=lambda s: s["begin"])

    def of(some: dict, held: pa.Table, column: str) -> list:
        at = some["begin"] - held["__at"][0].as_py()
        return held[column].slice(at, some["count"]).to_pylist()

    def climb(held: pa.Table, some: pa.Table) -> pa.Table:
        held = held.sort_by("__at")
        out = []
        for s in kept(some):
            nodes = of(s, held, leaf)
            out += [(s["tree"], *n) for n in frontier(s["first"], nodes, s["leaves"])]
        return _node_table(out)

    low = placed.select("__part", "__at", leaf).groupBy("__part").cogroup(stretches.groupBy("__part")).applyInArrow(climb, NODES)

    def grow(part: pa.Table) -> pa.Table:
        tree = part["tree"][0].as_py()
        known = {(level, place): h for level, place, h in zip(*(part[c].to_pylist() for c in ("level", "place", "hash")))}
        return _node_table([(tree, *at, h) for at, h in above(known, part["leaves"][0].as_py()).items()])

    sizes = stretches.select("tree", "leaves").distinct()
    nodes = written(low.join(sizes, "tree").groupBy("tree").applyInArrow(grow, NODES), "merkle-nodes")
    height = F.when(F.col("leaves") > 1, F.length(F.bin(F.col("leaves") - 1))).otherwise(0)
    roots = nodes.join(sizes, "tree").where((F.col("place") == 0) & (F.col("level") == height))
    roots = roots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("place"), "hash")
    top = roots.withColumn("leaves", stretches.agg(F.max("trees")).scalar()).groupBy("tree").applyInArrow(grow, NODES)

    def lacking(part: pa.Table) -> pa.Table:
        out = []
        some = kept(part)
        for s in some:
            out += [(s["tree"], *c) for c in missing(s["first"], s["count"], s["leaves"])]
        out += [(TOP, *c) for c in missing(some[0]["tree"], len(some), some[0]["trees"])]
        key = part["__part"][0].as_py()
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        cells = [[key] * len(out), *([r[i] for r in out] for i in range(3))]
        return pa.table([pa.array(c, k) for c, k in zip(cells, kinds)], names=["__part", "tree", "level", "place"])

    asked = stretches.groupBy("__part").applyInArrow(lacking, "__part long, tree long, level int, place long")
    fetched = asked.join(nodes.unionByName(top), ["tree", "level", "place"])
    known = stretches.withColumns({"level": F.lit(None).cast("int"), "place": F.lit(None).cast("long"), "hash": F.lit(None).cast("string")})
    known = known.unionByName(fetched.select("__part", "tree", "level", "place", "hash"), allowMissingColumns=True)

    names = leaves.columns

    def expand(held: pa.Table, some: pa.Table) -> pa.Table:
        held = held.sort_by("__at")
        rows_of = some.to_pylist()
        got: dict[int, dict[tuple[int, int], str]] = {}
        for r in rows_of:
            if r["level"] is not None:
                got.setdefault(r["tree"], {})[r["level"], r["place"]] = r["hash"]
        own = sorted((r for r in rows_of if r["level"] is None), key=lambda s: s["begin"])
        trees = own[0]["trees"]
        inner = [filled(s["first"], of(s, held, leaf), s["leaves"], got.get(s["tree"], {})) for s in own]
        subroots = [levels[-1][1][0] for levels in inner]
        over = filled(own[0]["tree"], subroots, trees, got.get(TOP, {}))
        root = over[-1][1][0]
        added: dict[str, list] = {"subroot": [], "root": [], "proof_sha256": [], "folded_root": []}
        lists: list[list[str]] = []
        for s, levels, subroot in zip(own, inner, subroots):
            tail = path(s["tree"], over, trees)
            digests, checked = of(s, held, leaf), of(s, held, shown)
            for i, (digest, other) in enumerate(zip(digests, checked)):
                siblings = path(s["first"] + i, levels, s["leaves"]) + tail
                added["proof_sha256"].append(node(*(x for x, _ in siblings)))
                added["folded_root"].append(fold(other or digest, siblings))
                if with_siblings:
                    lists.append([x for x, _ in siblings])
            added["subroot"] += [subroot] * len(digests)
            added["root"] += [root] * len(digests)
        columns = {n: held[n] for n in names} | {n: pa.array(v, pa.string()) for n, v in added.items()}
        if with_siblings:
            columns["siblings"] = pa.array(lists, pa.list_(pa.string()))
        return pa.table(columns)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.schema)
    schema += ", subroot string, root string, proof_sha256 string, folded_root string" + ", siblings array<string>" * with_siblings
    return placed.groupBy("__part").cogroup(known.groupBy("__part")).applyInArrow(expand, schema)


def manifest(
    docs: DataFrame, fields: list[str], shown_fields: dict[str, Column] | None = None, by: str = "lang", id_column: str = "doc_id",
    with_siblings: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: id, leaf, subroot, root, proof_sha256, folded_root and, on request, siblings (see ``proofs``).

    ``fields`` go into the leaf in this order; ``shown_fields`` has the values that stand in for some of them in the
    copy that is checked. Null ids come first in their language, a null language is a tree of its own and the first;
    repeated rows are leaves of their own; other columns are ignored; an empty table gives no rows.
    """
    leaf = field_digest([F.col(f) for f in fields])
    shown = field_digest([(shown_fields or {}).get(f, F.col(f)) for f in fields])
    changed = F.lit(False)
    for f, value in (shown_fields or {}).items():
        changed = changed | ~value.eqNullSafe(F.col(f))
    leaves = docs.select(F.col(id_column), F.col(by).alias("__by"), leaf.alias("leaf"), F.when(changed, shown).alias("__shown"))
    return proofs(leaves, "__by", id_column, "leaf", "__shown", with_siblings).drop("__by", "__shown")
