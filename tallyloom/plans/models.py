"""Queries of the model family: fits have no SQL equivalent, so these are checked by properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import boosting as bo
from tallyloom.operators import customer as cv
from tallyloom.operators import models as ml
from tallyloom.operators import sampling as sa
from tallyloom.plans.customer import FIXED_COLUMNS, G_PIVOT, dealt_lines, encoding_input, features
from tallyloom.plans.registry import query, with_sql
from tallyloom.plans.sampling import KEYS
from tallyloom.session import written
from tallyloom.sources import bindings as b
from tallyloom.sources.bindings import TX_SQL

NULLABLE = ["avg_ipt", "std_ipt", "std_order_val"]


def labelled(spark, sf):
    """Customers with label, part, fold, validation mark and the vector of all features, the five target encodings
    included: out of fold for training rows, from all training rows for the test part. Written once, since
    fits scan it often; features, the widest part, come last, so their rows travel in no join, fold or split."""
    names = [*FIXED_COLUMNS, *G_PIVOT[0]]
    encoded = [f"te_{k}" for k in KEYS]
    lines = dealt_lines(spark, sf, "fine_category")
    labels = b.revenue_labels(spark, sf)
    keyed = encoding_input(spark, sf, lines).join(labels.select("cust_id", "part"), "cust_id")
    keyed = written(sa.kfold(written(keyed, "encoding"), "cust_id", 5, sa.hashed("cust_id", 7)), "keys")
    train = keyed.where(F.col("part") == "train")
    codes = sa.encode_out_of_fold(train, "cust_id", KEYS, "y_log").select("cust_id", "fold", *encoded).unionByName(
        sa.encode_full(train, keyed.where(F.col("part") == "test"), "cust_id", KEYS, "y_log").select("cust_id", "fold", *encoded)
    )
    rows = written(labels.join(codes, "cust_id").withColumn("spends", F.col("revenue_label") > 0), "encoded")
    parts = {"fit": 0.8, "validate": 0.2}
    rows = sa.stratified_split(rows, "spends", "cust_id", parts, sa.hashed("cust_id", 42)).withColumn("held", F.col("split") == "validate")
    wide = features(spark, sf, lines).select("cust_id", *[F.col(c).cast("double").alias(c) for c in names])
    rows = cv.merge_labels(rows, wide)
    keep = ["cust_id", "revenue_label", "part", "fold", "held"]
    return ml.model_rows(rows, keep, [*names, *encoded], NULLABLE)


def train_part(rows):
    return rows.where(F.col("part") == "train")


def test_part(rows):
    return rows.where(F.col("part") == "test")


@query("two_stage_revenue")
def _(spark, sf):
    rows = labelled(spark, sf)
    out = ml.two_stage_revenue(train_part(rows), rows, "revenue_label", "held")
    return out.select("cust_id", "part", "revenue_label", "spend_probability", "prediction")


@query("log_target_regression_cv")
def _(spark, sf):
    rows = labelled(spark, sf)
    held, test, _ = ml.log_target_cv(train_part(rows), test_part(rows), "revenue_label")
    columns = ["cust_id", "part", "revenue_label", "prediction"]
    return held.select(columns).unionByName(test.select(columns))


@query("tweedie_regression")
def _(spark, sf):
    rows = labelled(spark, sf)
    model = bo.fit_tweedie(train_part(rows), "revenue_label", "held")
    return model.predict(rows).select("cust_id", "part", "revenue_label", "prediction")


@query("tweedie_deviance", with_sql(TX_SQL, select="""
SELECT true AS trees_below_linear, true AS ended_by_validation, count(*) AS customers FROM labels_clv"""))
def _(spark, sf):
    """Boosted trees against the linear model, both fitted on the fitting rows, by their deviance on the validating rows."""
    rows = labelled(spark, sf)
    train = train_part(rows)
    model = bo.fit_tweedie(train, "revenue_label", "held")
    held = train.where("held")
    linear = ml.tweedie(train.where("not held"), held, "revenue_label")
    unit = lambda df: df.agg(F.avg(bo.tweedie_deviance(
        F.col("revenue_label") / model.scale, F.greatest(F.col("prediction") / model.scale, F.lit(1e-9)), 1.5
    )))
    return rows.agg(
        (unit(model.predict(held)).scalar() < unit(linear).scalar()).alias("trees_below_linear"),
        F.lit(model.stopped).alias("ended_by_validation"), F.count(F.lit(1)).alias("customers"),
    )


@query("linear_probe")
def _(spark, sf):
    rows = b.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")
    split = sa.stratified_split(rows, "label", "vec_id", {"train": 0.8, "test": 0.2}, sa.hashed("vec_id", 42))
    out = ml.linear_probe(split.where(F.col("split") == "train"), split.where(F.col("split") == "test"), "vec", "label")
    return out.select("vec_id", "label", "prediction", "probs")


@query("feature_importance_top25")
def _(spark, sf):
    rows = labelled(spark, sf)
    _, _, model = ml.log_target_cv(train_part(rows), test_part(rows), "revenue_label")
    return ml.feature_importances(rows, model, 25)
