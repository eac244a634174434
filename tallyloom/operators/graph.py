"""Property-graph analytics over node and edge tables.

Tables: entity (name, entity_type), related_to (src, dst, action, doc_id), in_category (doc_id,
category), claim (claim_id, doc_id, actor, target, topic), mention (doc_id, name). Patterns are
anchored: the anchor's side is filtered first and expanded by equi- or semi-joins, so nothing is
paired beyond the anchor's own documents and claims.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.scalars import contains_ci, flag, one_of, ratio

# --- nodes ------------------------------------------------------------------------------------


def literal_rows(spark: SparkSession, name: str, values: Sequence[str]) -> DataFrame:
    """A literal list as rows."""
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def match_name(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(F.col("name") == name)


def name_in(nodes: DataFrame, names: Sequence[str], ci: bool = False) -> DataFrame:
    """Membership in a list; case-sensitive unless ``ci``."""
    return nodes.where(one_of(F.col("name"), names, ci))


def name_contains(nodes: DataFrame, piece: str, negate: bool = False) -> DataFrame:
    """Case-insensitive substring, or its negation."""
    found = contains_ci(F.col("name"), piece)
    return nodes.where(~found if negate else found)


def classify(nodes: DataFrame, names: Sequence[str], yes: str, no: str) -> DataFrame:
    """Node type by list membership."""
    return nodes.withColumn("type", F.when(F.col("name").isin(list(names)), yes).otherwise(no))


def typed_nodes(entity: DataFrame, categories: DataFrame) -> DataFrame:
    """One node table over two labels: id, label, node_type."""

    def nodes(df: DataFrame, name: str, label: str) -> DataFrame:
        return df.select(F.col(name).alias("id"), F.col(name).alias("label"), F.lit(label).alias("node_type"))

    return nodes(entity, "name", "Entity").unionByName(nodes(categories, "category", "Category")).distinct()


# --- expansion --------------------------------------------------------------------------------


def expand_out(edges: DataFrame, ego: str) -> DataFrame:
    """Edges leaving the ego; a self-loop makes the ego its own neighbour."""
    return edges.where(F.col("src") == ego)


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge seen from both ends, in one scan; a self-loop only once."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    there = F.struct("src", "dst")
    back = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ends = F.explode(F.when(F.col("src") == F.col("dst"), F.array(there)).otherwise(F.array(there, back)))
    return edges.select(ends.alias("_e"), *rest).select("_e.src", "_e.dst", *rest)


def expand_both(edges: DataFrame, name: str) -> DataFrame:
    """Edges touching the named node, in either direction, seen from it."""
    touching = edges.where((F.col("src") == name) | (F.col("dst") == name))
    return undirected(touching).where(F.col("src") == name)


def variant_contacts(edges: DataFrame, piece: str) -> DataFrame:
    """Edges with exactly one end among the ego's variants, seen from the variant.

    Edges between two variants are left out, so one pass without copies is enough.
    """
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    out, back = contains_ci(F.col("src"), piece), contains_ci(F.col("dst"), piece)
    return edges.where(out != back).select(
        F.when(out, F.col("src")).otherwise(F.col("dst")).alias("src"),
        F.when(out, F.col("dst")).otherwise(F.col("src")).alias("dst"),
        *rest,
    )


def any_type(edge_tables: dict[str, DataFrame]) -> DataFrame:
    """Edges of all types with the type as a column."""
    out = None
    for rel_type, edges in edge_tables.items():
        part = edges.select("src", "dst", F.lit(rel_type).alias("rel_type"))
        out = part if out is None else out.unionByName(part)
    return out


def claim_links(claim: DataFrame) -> DataFrame:
    """Claim -> entity edges of either role."""
    role = F.explode(
        F.array(
            F.struct(F.col("actor").alias("name"), F.lit("ACTOR").alias("role")),
            F.struct(F.col("target").alias("name"), F.lit("TARGET").alias("role")),
        )
    )
    return claim.select("claim_id", "doc_id", role.alias("r")).select("claim_id", "doc_id", "r.name", "r.role")


def ego_network_nodes(entity: DataFrame, edges: DataFrame, ego: str) -> DataFrame:
    """The ego and everything an edge leads to from it."""
    reached = expand_out(edges, ego).select(F.col("dst").alias("name"))
    is_ego = entity.where(F.col("name") == ego).select("name")
    return entity.join(reached.unionByName(is_ego).distinct(), "name", "left_semi")


def edge_export(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "action", "doc_id")


def node_export(entity: DataFrame) -> DataFrame:
    return entity.select(F.col("name").alias("id"), F.col("name").alias("label"), "entity_type")


def claim_pairs(
    claim: DataFrame, in_category: DataFrame, ego: str, alters: Sequence[str] | None = None,
    categories: Sequence[str] | None = None,
) -> DataFrame:
    """Claims that touch both the ego and another entity, with the category of their document; optionally only
    some other entities and some categories."""
    of_ego = claim.where((F.col("actor") == ego) | (F.col("target") == ego)).select("claim_id")
    others = claim_links(claim).where(F.col("name") != ego)
    if alters is not None:
        others = name_in(others, alters)
    if categories is not None:
        in_category = in_category.where(F.col("category").isin(list(categories)))
    return (
        others.join(of_ego, "claim_id", "left_semi")
        .join(in_category, "doc_id")
        .select(F.col("name").alias("alter"), "category", "doc_id", "claim_id")
    )


def co_mentions(mention: DataFrame, in_category: DataFrame, piece: str) -> DataFrame:
    """Entities mentioned together with the ego's variants: name, doc_id, category.

    The ego's documents come first; only their mentions are expanded.
    """
    docs = name_contains(mention, piece).select("doc_id").distinct()
    return name_contains(mention, piece, negate=True).join(docs, "doc_id", "left_semi").join(in_category, "doc_id")


# --- aggregates -------------------------------------------------------------------------------


def docs_per_category(in_category: DataFrame) -> DataFrame:
    return in_category.groupBy("category").agg(F.count(F.lit(1)).alias("documents"))


def neighbour_counts(edges: DataFrame, ego: str) -> DataFrame:
    return (
        expand_out(edges, ego)
        .groupBy(F.col("dst").alias("neighbor"))
        .agg(F.count(F.lit(1)).alias("interactions"))
    )


def interaction_profile(
    edges: DataFrame, ego: str, social: Sequence[str], legal: Sequence[str], by_word: bool = False
) -> DataFrame:
    """Per alter: interactions, social and legal ones, legal share.

    Actions are compared whole; ``by_word`` also counts phrases that contain a listed word.
    """

    def kind(words: Sequence[str]) -> Column:
        if by_word:
            return F.arrays_overlap(F.split(F.lower("action"), "[^a-z]+"), F.array(*map(F.lit, words)))
        return F.col("action").isin(list(words))

    counted = (
        expand_out(edges, ego)
        .groupBy(F.col("dst").alias("alter"))
        .agg(
            F.count(F.lit(1)).alias("total_interactions"),
            F.sum(flag(kind(social))).alias("social_interactions"),
            F.sum(flag(kind(legal))).alias("legal_interactions"),
        )
    )
    share = F.coalesce(ratio(F.col("legal_interactions"), F.col("total_interactions")), F.lit(0.0))
    return counted.withColumn("legal_share", share)


def top(df: DataFrame, by: str, names: Sequence[str], k: int) -> DataFrame:
    """Largest ``by`` first, names settle ties; sorted and cut in one operator."""
    return df.orderBy(F.desc(by), *names).limit(k)


def category_docs(pairs: DataFrame) -> DataFrame:
    """Distinct documents per alter and category."""
    return pairs.groupBy("alter", "category").agg(F.countDistinct("doc_id").alias("doc_count"))


def category_edges(pairs: DataFrame) -> DataFrame:
    """The same as weighted edges."""
    return (
        category_docs(pairs)
        .where(F.col("doc_count") > 0)
        .select(F.col("alter").alias("source"), F.col("category").alias("target"), F.col("doc_count").alias("weight"))
    )


def alters_by_type(edges: DataFrame, ego: str) -> DataFrame:
    return (
        expand_out(edges, ego)
        .groupBy("rel_type", F.col("dst").alias("alter"))
        .agg(F.count(F.lit(1)).alias("interactions"))
    )


def variant_edges(
    edges: DataFrame, piece: str, min_weight: int, merge_variants: bool = False
) -> DataFrame:
    """Edges between each ego variant and its alters: edge count, distinct documents.

    ``merge_variants`` folds all variants into one source named by the pattern.
    """
    touching = variant_contacts(edges, piece)
    source = F.lit(piece) if merge_variants else F.col("src")
    return (
        touching.groupBy(source.alias("source"), F.col("dst").alias("target"))
        .agg(F.count(F.lit(1)).alias("weight"), F.countDistinct("doc_id").alias("docs"))
        .where(F.col("weight") >= min_weight)
    )


def comention_edges(together: DataFrame, min_docs: int) -> DataFrame:
    """Entity - category edges weighted by distinct shared documents."""
    return (
        together.groupBy(F.col("name").alias("source"), F.col("category").alias("target"))
        .agg(F.countDistinct("doc_id").alias("weight"))
        .where(F.col("weight") >= min_docs)
    )


def topic_counts(claim: DataFrame) -> DataFrame:
    return claim.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


def variant_network_nodes(edges: DataFrame, piece: str) -> DataFrame:
    """Distinct ego variants with an alter, and all alters; no weight threshold."""
    touching = variant_contacts(edges, piece)
    ends = F.explode(F.array("src", "dst"))
    return touching.select("src", "dst").distinct().select(ends.alias("name")).distinct()


def edge_endpoints(edges: DataFrame) -> DataFrame:
    """Nodes of a bipartite entity - category edge table: id, label, node_type."""
    ends = F.explode(
        F.array(
            F.struct(F.col("source").alias("id"), F.lit("Entity").alias("node_type")),
            F.struct(F.col("target").alias("id"), F.lit("Category").alias("node_type")),
        )
    )
    return edges.select(ends.alias("e")).select("e.id", F.col("e.id").alias("label"), "e.node_type").distinct()


def ego_links(selected: DataFrame, ego: str) -> DataFrame:
    """Constant edges from the ego to selected alters."""
    return selected.select(
        F.lit(ego).alias("source"),
        F.col("name").alias("target"),
        F.lit(1).cast("bigint").alias("weight"),
        F.lit("ego_link").alias("edge_type"),
    )


def stacked_edges(*tables: DataFrame) -> DataFrame:
    """Edge tables under each other; columns one of them lacks become null."""
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out
