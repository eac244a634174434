"""Next-period revenue from a feature table: three models, their best blend, and the submission."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import boosting as bo
from tallyloom.operators import evaluation as ev
from tallyloom.operators import models as ml
from tallyloom.operators import sampling as sa
from tallyloom.session import written


@dataclass(frozen=True)
class RevenueRun:
    """Weights of the blend, validation errors and rank correlations, predictions for the test rows."""

    weights: tuple[float, float, float]
    errors: DataFrame
    correlations: DataFrame
    submission: DataFrame


def predict_revenue(rows: DataFrame, row_id: str, label: str, trees: int = ml.MAX_TREES, depth: int = 5, seed: int = 42) -> RevenueRun:
    """``rows``: id, label, part ('train' or 'test'), vector ``features``.

    A fifth of the training rows, stratified by spend, validates. The two-stage model and the Tweedie trees are
    fitted on the rest, and the validating rows stop both; the log model predicts every training row out of five folds.
    """
    test = rows.where(F.col("part") == "test").select(row_id, "features")
    known = rows.where(F.col("part") == "train").select(row_id, label, "features")
    folded = sa.kfold(known.withColumn("spends", F.col(label) > 0), row_id, 5, sa.hashed(row_id, 7))
    parts = {"fit": 0.8, "validate": 0.2}
    train = written(sa.stratified_split(folded, "spends", row_id, parts, sa.hashed(row_id, seed)), "train")
    train = train.withColumn("held", F.col("split") == "validate")
    validate = train.where("held")

    unseen = validate.select(row_id, "features").unionByName(test)
    only = lambda df, name: df.select(row_id, F.col("prediction").alias(name))
    a = only(ml.two_stage_revenue(train, unseen, label, "held", trees, depth, seed), "a")
    out_of_fold, on_test, _ = ml.log_target_cv(train, test, label, folds=5, trees=trees, depth=depth)
    b = only(out_of_fold, "b").unionByName(only(on_test, "b"))
    c = only(bo.fit_tweedie(train, label, "held", depth=depth, most=trees, seed=seed).predict(unseen), "c")
    scored = written(a.join(b, row_id).join(c, row_id), "predictions")

    checked = validate.select(row_id, F.col(label).alias("y")).join(scored, row_id)
    best = ev.ensemble_search(checked, "y", "a", "b", "c").where("is_best").first()
    blend = best["wa"] * F.col("a") + best["wb"] * F.col("b") + best["wc"] * F.col("c")
    blended = checked.withColumn("blend", blend)
    long = blended.unpivot([row_id, "y"], ["a", "b", "c", "blend"], "model", "p")
    return RevenueRun(
        (best["wa"], best["wb"], best["wc"]),
        ev.mae_by_segment(blended, "y", "blend"),
        ev.spearman(long, "y", "p", ["model"]),
        test.select(row_id).join(scored, row_id).select(row_id, blend.alias("prediction")),
    )
