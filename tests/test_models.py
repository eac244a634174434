"""Fits learn what they should on data with a known signal."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import boosting as bo
from tallyloom.operators import evaluation as ev
from tallyloom.operators import models as ml
from tallyloom.operators import sampling as sa


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    n = 600
    x, noise = rng.normal(size=n), rng.normal(size=n)
    spend = np.where(x + 0.3 * rng.normal(size=n) > 0, np.exp(2 + x), 0.0)
    frame = pd.DataFrame({"id": np.arange(n), "x": x, "noise": noise, "y": spend})
    df = spark.createDataFrame(frame).withColumn("gap", F.when(F.col("id") % 7 > 0, F.col("noise")))
    df = sa.kfold(df, "id", 3, sa.hashed("id", 7))
    return ml.assembled(df, ["x", "noise", "gap"], ["gap"]).cache()


def rho(df):
    return ev.spearman(df, "y", "prediction").first().rho


def test_missing_values_get_a_flag(rows):
    assert len(rows.first().features) == 4


def test_model_rows_hold_the_written_vector_and_its_names(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, None), (2, None, 5.0, 7.0)], "id long, y double, x double, gap double")
    out = ml.model_rows(df, ["id", "y"], ["x", "gap"], ["gap"])
    assert spark.read.parquet(*out.inputFiles()).columns == ["id", "y", "features"]
    assert {r.id: (r.y, list(r.features.toArray())) for r in out.collect()} == {1: (2.0, [3.0, 0.0, 1.0]), 2: (None, [5.0, 7.0, 0.0])}
    named = {a["name"] for kind in out.schema["features"].metadata["ml_attr"]["attrs"].values() for a in kind}
    assert named == {"x", "gap", "gap_missing"}


def test_two_stage(rows):
    out = ml.two_stage_revenue(rows.withColumn("held", F.col("id") % 5 == 0), rows, "y", "held", trees=5, depth=3)
    assert rho(out) > 0.8
    assert out.where((F.col("prediction") < 0) | (F.col("spend_probability") > 1)).count() == 0


def test_cross_validation_and_importances(rows):
    held, test, model = ml.log_target_cv(rows, rows.limit(50), "y", folds=3, trees=5, depth=3)
    assert held.count() == 600 and held.select("id").distinct().count() == 600 and rho(held) > 0.7
    assert test.count() == 50 and test.where("prediction < 0").count() == 0
    top = ml.feature_importances(rows, model, 2).collect()
    assert top[0].feature == "x" and len(top) == 2 and top[0].importance >= top[1].importance


def test_tweedie(rows):
    out = ml.tweedie(rows, rows, "y")
    assert rho(out) > 0.7 and out.where("prediction <= 0").count() == 0


def test_boosted_tweedie_ends_by_validation_and_beats_the_linear_model(rows):
    marked = rows.withColumn("held", F.col("id") % 5 == 0)
    model = bo.fit_tweedie(marked, "y", "held", least=5)
    assert model.stopped and 3 <= len(model.trees) < 4000 and min(model.history) == model.history[len(model.trees)]
    scaled = lambda df: df.agg(F.avg(bo.tweedie_deviance(F.col("y") / model.scale, F.col("prediction") / model.scale, 1.5))).first()[0]
    held = marked.where("held")
    mine = scaled(model.predict(held))
    assert mine == pytest.approx(min(model.history)) and mine < scaled(ml.tweedie(marked.where("not held"), held, "y"))
    assert rho(model.predict(held)) > 0.7


def test_boosting_goes_on_where_it_was(rows, spark):
    from tallyloom.session import new_path

    marked = rows.withColumn("held", F.col("id") % 5 == 0)
    folder = new_path(spark, "resumed")
    whole = bo.fit_tweedie(marked, "y", "held", least=5, most=7)
    bo.fit_tweedie(marked, "y", "held", least=5, most=5, folder=folder)
    resumed = bo.fit_tweedie(marked, "y", "held", least=5, most=7, folder=folder)
    assert resumed.history == pytest.approx(whole.history) and len(resumed.trees) == len(whole.trees)


def test_boosting_writes_rows_once_and_margins_alone(rows, spark, monkeypatch):
    """What a round writes doesn't grow with the features, and rows and margins meet where they are."""
    import os

    from tallyloom.session import new_path

    plans = []
    saved = bo._saved
    monkeypatch.setattr(bo, "_saved", lambda model, folder, df, *more: plans.append(df._jdf.queryExecution().toString()) or saved(model, folder, df, *more))
    folder = new_path(spark, "margins")
    bo.fit_tweedie(rows.withColumn("held", F.col("id") % 5 == 0), "y", "held", least=5, most=5, folder=folder)
    assert [f for f in sorted(os.listdir(folder)) if not f.startswith(("tree", "state"))] == ["margins-0", "margins-4", "rows"]
    assert spark.read.parquet(f"{folder}/margins-4").columns == ["_id", "_f"] and spark.read.parquet(f"{folder}/margins-4").count() == 600
    assert len(plans) == 2 and "ShuffledHashJoin" in plans[1] and "Exchange" not in plans[1]


def test_boosting_without_rows_or_spend(rows):
    none = bo.fit_tweedie(rows.withColumn("held", F.lit(False)).limit(0), "y", "held")
    assert none.trees == [] and none.predict(rows).where("prediction <> 0").count() == 0
    zero = rows.withColumns({"held": F.col("id") % 5 == 0, "y": F.lit(None).cast("double")})
    assert bo.fit_tweedie(zero, "y", "held").scale == 0.0


def test_linear_probe(spark):
    rng = np.random.default_rng(1)
    label = rng.integers(0, 3, 300)
    vec = np.eye(3)[label] + 0.1 * rng.normal(size=(300, 3))
    df = spark.createDataFrame([([float(v) for v in r], int(l)) for r, l in zip(vec, label)], "vec array<double>, label int")
    train, test = df.limit(200), df.exceptAll(df.limit(200))
    out = ml.linear_probe(train, test, "vec", "label")
    assert out.where(F.col("prediction") == F.col("label")).count() > 0.95 * out.count() > 0
    assert len(out.first().probs) == 3


def test_whole_revenue_run(rows):
    from tallyloom.plans.customer_value import predict_revenue

    parted = rows.withColumn("part", F.when(F.col("id") % 5 == 0, "test").otherwise("train"))
    run = predict_revenue(parted, "id", "y", trees=3, depth=2)
    assert sum(run.weights) == pytest.approx(1.0)
    rhos = {r.model: r.rho for r in run.correlations.collect()}
    assert rhos["blend"] >= max(rhos["a"], rhos["b"], rhos["c"]) - 1e-9 and rhos["blend"] > 0.7
    assert {r.segment for r in run.errors.collect()} == {"all", "zeros", "nonzeros"}
    assert run.submission.count() == 120 and run.submission.where("prediction < 0").count() == 0
