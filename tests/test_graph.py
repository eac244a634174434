"""Graph rules on hand-made rows, and the invariants of the exported tables on bundled data."""

import os

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import graph as g
from tallyloom.plans import graph as plans

SF = "/root/testdata/sf0.001"
bundled = pytest.mark.skipif(not os.path.isdir(SF), reason="bundled tables not present")


@pytest.fixture(scope="module")
def edges(spark):
    rows = [
        ("ego", "ego", "met", 1),                # self-loop
        ("ego", "ann", "met", 1),
        ("ego", "ann", "met with someone", 2),   # phrase around a listed word
        ("bob", "ego", "sued", 3),
        ("ego2", "ann", "met", 4),
        ("Ego3", "ego2", "met", 5),              # both ends are variants
    ]
    return spark.createDataFrame(rows, "src string, dst string, action string, doc_id int")


def test_self_loop_once_when_undirected(edges):
    both = g.expand_both(edges, "ego").groupBy("dst").count().collect()
    assert {r.dst: r["count"] for r in both} == {"ego": 1, "ann": 2, "bob": 1}


def test_profile_compares_whole_actions(edges):
    exact = {r.alter: r for r in g.interaction_profile(edges, "ego", ["met"], ["sued"]).collect()}
    assert exact["ann"].total_interactions == 2 and exact["ann"].social_interactions == 1
    assert exact["ego"].legal_share == 0.0
    words = {r.alter: r for r in g.interaction_profile(edges, "ego", ["met"], ["sued"], by_word=True).collect()}
    assert words["ann"].social_interactions == 2


def test_variants_stay_apart_unless_merged(edges):
    apart = {(r.source, r.target): r.weight for r in g.variant_edges(edges, "EGO", 1).collect()}
    assert apart == {("ego", "ann"): 2, ("ego", "bob"): 1, ("ego2", "ann"): 1}
    merged = {r.target: (r.weight, r.docs) for r in g.variant_edges(edges, "ego", 1, merge_variants=True).collect()}
    assert merged == {"ann": (3, 3), "bob": (1, 1)}


def test_name_lists_and_case(spark):
    nodes = spark.createDataFrame([("Ann",), ("ann",), ("Bob",)], "name string")
    assert g.name_in(nodes, ["ann"]).count() == 1
    assert g.name_in(nodes, ["ann"], ci=True).count() == 2
    assert g.name_contains(nodes, "AN").count() == 2 and g.name_contains(nodes, "AN", negate=True).count() == 1


def test_several_claims_in_one_document_count_once(spark):
    claim = spark.createDataFrame(
        [("c1", 1, "ego", "ann", "t"), ("c2", 1, "ann", "ego", "t"), ("c3", 2, "bob", "ann", "t"), ("c4", 3, "ego", "ego", "t")],
        "claim_id string, doc_id int, actor string, target string, topic string",
    )
    category = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "doc_id int, category string")
    pairs = g.claim_pairs(claim, category, "ego")
    assert pairs.count() == 2
    assert [tuple(r) for r in g.category_docs(pairs).collect()] == [("ann", "x", 1)]
    assert g.claim_pairs(claim, category, "ego", ["nobody"]).count() == 0


def test_stacked_edges_fill_missing_columns(spark):
    a = spark.createDataFrame([("a", "b", 1)], "source string, target string, weight bigint")
    links = g.ego_links(spark.createDataFrame([("n",)], "name string"), "ego")
    out = g.stacked_edges(a, links).collect()
    assert [r.edge_type for r in out] == [None, "ego_link"]


@bundled
def test_nodes_are_the_endpoints_of_the_edges(spark):
    edges = plans.comention_edges(spark, SF)
    ends = {r[0] for r in edges.select("source").union(edges.select("target")).collect()}
    nodes = {r.id for r in g.edge_endpoints(edges).collect()}
    assert nodes == ends and edges.where(F.col("weight") < plans.MIN_DOCS).count() == 0


@bundled
def test_documents_never_exceed_weight(spark):
    out = plans.variant_edges(spark, SF)
    assert out.where((F.col("docs") > F.col("weight")) | (F.col("weight") < plans.MIN_WEIGHT)).count() == 0


@bundled
def test_profile_totals_equal_neighbour_counts(spark):
    totals = plans.profile(spark, SF)
    assert totals.where(F.col("legal_share") != F.col("legal_interactions") / F.col("total_interactions")).count() == 0
    from tallyloom.sources import bindings as b

    counts = {r.neighbor: r.interactions for r in g.neighbour_counts(b.related_to(spark, SF), b.EGO).collect()}
    assert {r.alter: r.total_interactions for r in totals.collect()} == counts


def test_mentions_of_a_document_are_dealt_to_one_of_the_sessions_partitions(spark, tmp_path):
    from tallyloom.session import bucket_count
    from tallyloom.sources import bindings as b

    folder = str(tmp_path)
    lines = [(d, p, s) for d in range(40) for p, s in ((1, 2), (1, 2), (3, 2))] + [(None, 1, None), (None, 1, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(d, d % 5) for d in range(40)], "o_orderkey long, o_custkey long").write.parquet(f"{folder}/orders.parquet")
    out = b.mentions(spark, folder)
    wanted = [(d, n) for d in range(40) for n in ("S#2", "P#1", "P#3", f"C#{d % 5}")] + [(None, "P#1"), (None, None)]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, wanted))
    assert out.rdd.getNumPartitions() == bucket_count(out)
    places = {tuple(r) for r in out.select("doc_id", F.spark_partition_id()).collect()}
    assert len(places) == 41


def test_edges_of_a_document_are_dealt_to_one_of_the_sessions_partitions(spark, tmp_path):
    from tallyloom.session import bucket_count
    from tallyloom.sources import bindings as b

    folder = str(tmp_path)
    lines = [(d, 1, s) for s in (2, 2, 3) for d in range(40)] + [(None, 1, 2), (7, 9, 2), (99, 1, 2)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(d, d % 5) for d in range(40)], "o_orderkey long, o_custkey long").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(1, "PROMO")], "p_partkey long, p_type string").write.parquet(f"{folder}/part.parquet")
    out = b.related_to(spark, folder)
    wanted = [(f"S#{s}", f"C#{d % 5}", "promo", d) for d in range(40) for s in (2, 2, 3)]
    assert sorted(map(tuple, out.collect())) == sorted(wanted)
    assert out.rdd.getNumPartitions() == bucket_count(out)
    places = {tuple(r) for r in out.select("doc_id", F.spark_partition_id()).collect()}
    assert len(places) == 40
