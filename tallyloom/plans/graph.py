"""Queries of the graph family."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import graph as g
from tallyloom.plans.registry import query, with_sql
from tallyloom.sources import bindings as b
from tallyloom.sources.bindings import EGO, GRAPH_SQL, LEGAL, SOCIAL, VARIANT

MIN_DOCS = 10
MIN_WEIGHT = 3
SELECTED = ["S#1", "S#2", "S#3"]
SELECTED_CATEGORIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _sql(select: str, extra: str = "") -> str:
    return with_sql(*([GRAPH_SQL, extra] if extra else [GRAPH_SQL]), select=select)


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


BOTH_SQL = f"""
both_ways AS (
  SELECT src, dst, doc_id FROM related_to UNION ALL
  SELECT dst, src, doc_id FROM related_to WHERE src <> dst),
touching AS (
  SELECT * FROM both_ways WHERE contains(lower(src), '{VARIANT}') AND NOT contains(lower(dst), '{VARIANT}'))
"""

PAIRS_SQL = f"""
of_ego AS MATERIALIZED (
  SELECT DISTINCT claim_id FROM links WHERE name = '{EGO}'),
pairs AS (
  SELECT l.name AS alter, category, l.doc_id, l.claim_id
  FROM (SELECT links.* FROM links JOIN of_ego USING (claim_id) WHERE name <> '{EGO}') l JOIN in_category USING (doc_id))
"""

TOGETHER_SQL = f"""
own_docs AS MATERIALIZED (
  SELECT DISTINCT doc_id FROM mention WHERE contains(lower(name), '{VARIANT}')),
together AS (
  SELECT doc_id, name, category
  FROM (SELECT mention.* FROM mention JOIN own_docs USING (doc_id) WHERE NOT contains(lower(name), '{VARIANT}'))
  JOIN in_category USING (doc_id)),
comention AS (
  SELECT name AS source, category AS target, count(DISTINCT doc_id) AS weight FROM together
  GROUP BY 1, 2 HAVING weight >= {MIN_DOCS})
"""

PROFILE = f"""
SELECT dst AS alter, count(*) AS total_interactions,
       CAST(sum(CASE WHEN action IN ({_list(SOCIAL)}) THEN 1 ELSE 0 END) AS BIGINT) AS social_interactions,
       CAST(sum(CASE WHEN action IN ({_list(LEGAL)}) THEN 1 ELSE 0 END) AS BIGINT) AS legal_interactions,
       sum(CASE WHEN action IN ({_list(LEGAL)}) THEN 1.0 ELSE 0.0 END)::DOUBLE / count(*) AS legal_share
FROM related_to WHERE src = '{EGO}' GROUP BY 1 ORDER BY total_interactions DESC, alter"""


def profile(spark, sf):
    return g.interaction_profile(b.related_to(spark, sf), EGO, SOCIAL, LEGAL)


def together(spark, sf):
    return g.co_mentions(b.mentions(spark, sf), b.in_category(spark, sf), VARIANT)


def pairs(spark, sf):
    return g.claim_pairs(b.claims(spark, sf), b.in_category(spark, sf), EGO)


def typed_edges(spark, sf):
    """Two outgoing edge types: supplier -> customer and supplier -> part."""
    supplies = b.table(spark, sf, "lineitem").select(
        F.concat(F.lit("S#"), F.col("l_suppkey").cast("string")).alias("src"),
        F.concat(F.lit("P#"), F.col("l_partkey").cast("string")).alias("dst"),
    )
    return g.any_type({"RELATED_TO": b.related_to(spark, sf), "SUPPLIES": supplies})


TYPED_SQL = """
typed AS (
  SELECT src, dst, 'RELATED_TO' AS rel_type FROM related_to UNION ALL
  SELECT 'S#' || CAST(l_suppkey AS VARCHAR), 'P#' || CAST(l_partkey AS VARCHAR), 'SUPPLIES' FROM lineitem)
"""

# --- nodes and predicates ---------------------------------------------------------------------


@query("literal_rows", _sql(f"""
SELECT l.name, entity_type, (SELECT count(*) FROM mention m WHERE m.name = l.name) AS docs
FROM (SELECT unnest([{_list(SELECTED + ['nobody'])}]) AS name) l LEFT JOIN entity e ON l.name = e.name"""))
def _(spark, sf):
    names = g.literal_rows(spark, "name", SELECTED + ["nobody"])
    found = g.name_in(b.mentions(spark, sf), SELECTED)
    docs = found.groupBy("name").agg(F.count(F.lit(1)).alias("docs"))
    return (
        names.join(b.entities(spark, sf), "name", "left")
        .join(docs, "name", "left")
        .na.fill(0, subset=["docs"])
    )


@query("node_property_match", _sql(f"SELECT * FROM entity WHERE name = '{EGO}'"))
def _(spark, sf):
    return g.match_name(b.entities(spark, sf), EGO)


@query("name_in_list", _sql(f"SELECT * FROM entity WHERE name IN ({_list(SELECTED)})"))
def _(spark, sf):
    return g.name_in(b.entities(spark, sf), SELECTED)


@query("name_contains_ci", _sql(f"""
SELECT *, contains(lower(name), '{VARIANT}') AS is_variant FROM entity
WHERE contains(lower(name), '{VARIANT}') OR NOT contains(lower(name), '{VARIANT}')"""))
def _(spark, sf):
    nodes = b.entities(spark, sf)
    yes = g.name_contains(nodes, VARIANT).withColumn("is_variant", F.lit(True))
    return yes.unionByName(g.name_contains(nodes, VARIANT, negate=True).withColumn("is_variant", F.lit(False)))


@query("node_not_equal", _sql(f"""
SELECT claim_id, name, role FROM links WHERE name <> '{EGO}'"""))
def _(spark, sf):
    return g.claim_links(b.claims(spark, sf)).where(F.col("name") != EGO).select("claim_id", "name", "role")


@query("rename_as_source_target", _sql("""
SELECT src AS source, dst AS target, action, doc_id FROM related_to"""))
def _(spark, sf):
    return g.edge_export(b.related_to(spark, sf))


@query("case_classify", _sql(f"""
SELECT name, CASE WHEN name IN ({_list([EGO] + SELECTED)}) THEN 'selected' ELSE 'other' END AS type FROM entity"""))
def _(spark, sf):
    return g.classify(b.entities(spark, sf).select("name"), [EGO] + SELECTED, "selected", "other")


@query("coalesce_by_label", _sql("""
SELECT name AS id, name AS label, 'Entity' AS node_type FROM entity
UNION SELECT category, category, 'Category' FROM in_category"""))
def _(spark, sf):
    return g.typed_nodes(b.entities(spark, sf), b.in_category(spark, sf))


# --- expansion --------------------------------------------------------------------------------


@query("one_hop_expand_directed", _sql(f"""
SELECT dst, entity_type, action, doc_id FROM related_to JOIN entity ON dst = name WHERE src = '{EGO}'"""))
def _(spark, sf):
    out = g.expand_out(b.related_to(spark, sf), EGO)
    return out.join(b.entities(spark, sf), F.col("dst") == F.col("name")).select(
        "dst", "entity_type", "action", "doc_id"
    )


@query("one_hop_expand_undirected", _sql(f"""
SELECT src, dst, doc_id FROM touching UNION ALL
SELECT src, dst, doc_id FROM both_ways WHERE src = '{EGO}'""", BOTH_SQL))
def _(spark, sf):
    edges = b.related_to(spark, sf).select("src", "dst", "doc_id")
    return g.variant_contacts(edges, VARIANT).unionByName(g.expand_both(edges, EGO))


@query("any_type_expand", _sql(f"SELECT * FROM typed WHERE src = '{EGO}'", TYPED_SQL))
def _(spark, sf):
    return g.expand_out(typed_edges(spark, sf), EGO)


@query("alternative_type_expand", _sql("SELECT claim_id, doc_id, name, role FROM links"))
def _(spark, sf):
    return g.claim_links(b.claims(spark, sf))


NODES_SQL = f"""
SELECT name AS id, name AS label, entity_type FROM entity e
WHERE name = '{EGO}' OR EXISTS (SELECT 1 FROM related_to WHERE src = '{EGO}' AND dst = e.name)"""


@query("ego_or_neighbour_semi", _sql(NODES_SQL))
def ego_nodes(spark, sf):
    return g.node_export(g.ego_network_nodes(b.entities(spark, sf), b.related_to(spark, sf), EGO))


@query("claim_pair_join", _sql("SELECT * FROM pairs", PAIRS_SQL))
def _(spark, sf):
    return pairs(spark, sf)


PAIR_ALTERS = ["C#1", "C#10", "C#100", "C#1000", "C#7", "C#77"]
PAIR_CATEGORIES = ["1-URGENT", "2-HIGH", "5-LOW"]


@query("claim_pairs_selected", _sql(f"""
SELECT * FROM pairs WHERE category IN ({_list(PAIR_CATEGORIES)}) AND (alter IN ({_list(PAIR_ALTERS)}) OR alter LIKE 'C#2%')""", PAIRS_SQL))
def _(spark, sf):
    """Only some other entities and some categories."""
    some = b.table(spark, sf, "customer").where(F.col("c_custkey").cast("string").startswith("2"))
    claims = b.claims(spark, sf)
    listed = g.claim_pairs(claims, b.in_category(spark, sf), EGO, PAIR_ALTERS, PAIR_CATEGORIES)
    by_prefix = g.claim_pairs(claims, b.in_category(spark, sf), EGO, categories=PAIR_CATEGORIES).join(
        some.select(F.concat(F.lit("C#"), F.col("c_custkey").cast("string")).alias("alter")), "alter", "left_semi"
    )
    return listed.unionByName(by_prefix)


@query("co_mention_join", _sql("SELECT * FROM together", TOGETHER_SQL))
def _(spark, sf):
    return together(spark, sf)


# --- aggregates -------------------------------------------------------------------------------


@query("docs_per_category", _sql("SELECT category, count(*) AS documents FROM in_category GROUP BY 1"))
def _(spark, sf):
    return g.docs_per_category(b.in_category(spark, sf)).orderBy(F.desc("documents"), "category")


@query("neighbour_counts", _sql(f"""
SELECT dst AS neighbor, count(*) AS interactions FROM related_to WHERE src = '{EGO}' GROUP BY 1"""))
def _(spark, sf):
    return g.neighbour_counts(b.related_to(spark, sf), EGO)


@query("interaction_profile", _sql(PROFILE + " LIMIT 100"))
def _(spark, sf):
    return g.top(profile(spark, sf), "total_interactions", ["alter"], 100)


@query("alter_category_docs", _sql("""
SELECT alter, category, count(DISTINCT doc_id) AS doc_count FROM pairs GROUP BY 1, 2""", PAIRS_SQL))
def _(spark, sf):
    return g.category_docs(pairs(spark, sf)).orderBy("alter", F.desc("doc_count"), "category")


@query("alter_category_edges", _sql("""
SELECT alter AS source, category AS target, count(DISTINCT doc_id) AS weight FROM pairs GROUP BY 1, 2
HAVING weight > 0""", PAIRS_SQL))
def _(spark, sf):
    return g.category_edges(pairs(spark, sf))


@query("alters_by_reltype", _sql(f"""
SELECT rel_type, dst AS alter, count(*) AS interactions FROM typed WHERE src = '{EGO}' GROUP BY 1, 2
ORDER BY interactions DESC, alter, rel_type LIMIT 10""", TYPED_SQL))
def _(spark, sf):
    return g.top(g.alters_by_type(typed_edges(spark, sf), EGO), "interactions", ["alter", "rel_type"], 10)


@query("ego_variant_edges", _sql(f"""
SELECT src AS source, dst AS target, count(*) AS weight, count(DISTINCT doc_id) AS docs FROM touching
GROUP BY 1, 2 HAVING weight >= {MIN_WEIGHT}""", BOTH_SQL))
def variant_edges(spark, sf):
    return g.variant_edges(b.related_to(spark, sf), VARIANT, MIN_WEIGHT)


@query("comention_category_edges", _sql("SELECT * FROM comention", TOGETHER_SQL))
def comention_edges(spark, sf):
    return g.comention_edges(together(spark, sf), MIN_DOCS)


@query("topic_counts", _sql("SELECT topic, count(*) AS n FROM claim GROUP BY 1 ORDER BY n DESC, topic LIMIT 50"))
def _(spark, sf):
    return g.top(g.topic_counts(b.claims(spark, sf)), "n", ["topic"], 50)


@query("collect_distinct_nodes", _sql("SELECT src AS name FROM touching UNION SELECT dst FROM touching", BOTH_SQL))
def _(spark, sf):
    return g.variant_network_nodes(b.related_to(spark, sf), VARIANT)


# --- order and limit --------------------------------------------------------------------------


@query("order_by_multi", _sql("SELECT * FROM comention ORDER BY weight DESC, source, target", TOGETHER_SQL))
def _(spark, sf):
    return comention_edges(spark, sf).orderBy(F.desc("weight"), "source", "target")


@query("limit_sample", _sql(f"""
SELECT dst AS neighbor, action, doc_id FROM related_to WHERE src = '{EGO}'
ORDER BY neighbor, action, doc_id LIMIT 50"""))
def _(spark, sf):
    out = g.expand_out(b.related_to(spark, sf), EGO)
    return out.select(F.col("dst").alias("neighbor"), "action", "doc_id").orderBy(
        "neighbor", "action", "doc_id"
    ).limit(50)


@query("topk_by_count", _sql("""
SELECT dst AS alter, count(*) AS interactions FROM related_to GROUP BY 1
ORDER BY interactions DESC, alter LIMIT 100"""))
def _(spark, sf):
    counts = b.related_to(spark, sf).groupBy(F.col("dst").alias("alter")).agg(F.count(F.lit(1)).alias("interactions"))
    return g.top(counts, "interactions", ["alter"], 100)


# --- set operations ---------------------------------------------------------------------------


@query("ego_nodes_union", _sql("""
SELECT t.name AS id, t.name AS label, 'Entity' AS node_type FROM (
  SELECT src AS name FROM touching UNION SELECT dst FROM touching) t JOIN entity USING (name)""", BOTH_SQL))
def _(spark, sf):
    names = g.variant_network_nodes(b.related_to(spark, sf), VARIANT)
    return b.entities(spark, sf).join(names, "name", "left_semi").select(
        F.col("name").alias("id"), F.col("name").alias("label"), F.lit("Entity").alias("node_type")
    )


@query("comention_nodes_union", _sql("""
SELECT source AS id, source AS label, 'Entity' AS node_type FROM comention
UNION SELECT target, target, 'Category' FROM comention""", TOGETHER_SQL))
def _(spark, sf):
    return g.edge_endpoints(comention_edges(spark, sf))


SELECTED_SQL = f"""
chosen AS (SELECT unnest([{_list([EGO] + SELECTED + SELECTED_CATEGORIES)}]) AS name),
node_docs AS (
  SELECT name, count(*) AS docs FROM mention GROUP BY 1 UNION ALL
  SELECT category, count(*) FROM in_category GROUP BY 1)
"""


@query("selected_node_table", _sql(f"""
SELECT c.name AS id, c.name AS label,
       CASE WHEN c.name IN ({_list([EGO] + SELECTED)}) THEN 'Entity' ELSE 'Category' END AS type,
       coalesce(docs, 0) AS docs
FROM chosen c LEFT JOIN node_docs USING (name)""", SELECTED_SQL))
def _(spark, sf):
    """The selected nodes, classified, with the documents each appears in."""
    chosen = g.literal_rows(spark, "name", [EGO] + SELECTED + SELECTED_CATEGORIES)
    docs = (
        g.name_in(b.mentions(spark, sf), [EGO] + SELECTED).groupBy("name").agg(F.count(F.lit(1)).alias("docs"))
        .unionByName(
            g.docs_per_category(b.in_category(spark, sf)).select(
                F.col("category").alias("name"), F.col("documents").alias("docs")
            )
        )
    )
    nodes = g.classify(chosen, [EGO] + SELECTED, "Entity", "Category").join(docs, "name", "left")
    return nodes.select(
        F.col("name").alias("id"), F.col("name").alias("label"), "type", F.coalesce("docs", F.lit(0)).alias("docs")
    ).orderBy("type", "label")


LINKS_SQL = f"""
ego_link AS (
  SELECT '{EGO}' AS source, name AS target, CAST(1 AS BIGINT) AS weight, 'ego_link' AS edge_type
  FROM entity WHERE name IN ({_list(SELECTED)}))
"""


def ego_links(spark, sf):
    """Links to the selected alters that exist as nodes."""
    return g.ego_links(g.name_in(b.entities(spark, sf), SELECTED), EGO)


@query("selected_ego_links", _sql("SELECT * FROM ego_link", LINKS_SQL))
def _(spark, sf):
    return ego_links(spark, sf).orderBy("target")


@query("combined_edge_table", _sql("""
SELECT alter AS source, category AS target, count(DISTINCT doc_id) AS weight, NULL::VARCHAR AS edge_type
FROM pairs GROUP BY 1, 2 UNION ALL SELECT source, target, weight, edge_type FROM ego_link""", PAIRS_SQL.strip() + "," + LINKS_SQL.strip()))
def _(spark, sf):
    return g.stacked_edges(g.category_edges(pairs(spark, sf)), ego_links(spark, sf))
