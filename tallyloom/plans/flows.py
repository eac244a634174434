"""The two whole flows as queries: a batch of searches, and the revenue prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.plans.customer_value import predict_revenue
from tallyloom.plans.models import labelled
from tallyloom.plans.registry import query, with_sql
from tallyloom.plans.retrieval import LANGUAGE, URL, records
from tallyloom.plans.search import search
from tallyloom.sources import bindings as b
from tallyloom.sources.bindings import RETRIEVAL_SQL, TX_SQL


@query("search_flow", with_sql(RETRIEVAL_SQL, select="""
SELECT qid, id, similarity AS score, rank, id IN (SELECT app_id FROM games) AS has_card
FROM cand WHERE rank <= 5"""))
def _(spark, sf):
    """Every vector as a query, matched, joined to its records, with contexts and answers assembled."""
    asked = b.query_vectors(spark, sf).withColumn("query", F.concat(F.lit("vector "), F.col("qid").cast("string")))
    others = b.vectors(spark, sf)
    found = search(asked, others, records(spark, sf), b.reviews(spark, sf), None, URL, LANGUAGE, 20, 5, exclude_self=True)
    cards = found.cards.select("qid", "rank", F.lit(True).alias("has_card"))
    kept = found.matches.select("qid", "id", "score", "rank").join(cards, ["qid", "rank"], "left")
    answered = kept.join(found.answers.select("qid"), "qid", "left_semi")
    return answered.select("qid", "id", "score", "rank", F.coalesce("has_card", F.lit(False)).alias("has_card"))


@query("revenue_flow", with_sql(TX_SQL, select="""
SELECT cust_id, true AS predicted FROM labels_clv WHERE part = 'test'"""))
def _(spark, sf):
    """Features, encodings, three models, their blend: a prediction of zero or more for every test customer."""
    run = predict_revenue(labelled(spark, sf), "cust_id", "revenue_label")
    return run.submission.select("cust_id", (F.coalesce("prediction", F.lit(-1.0)) >= 0).alias("predicted"))
