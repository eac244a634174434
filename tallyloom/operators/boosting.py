"""Boosted trees for Tweedie deviance: Newton steps over MLlib regression trees, ended by validation rows.

Every round fits one tree to the Newton step of each row, minus gradient over curvature of the deviance at the row's present
margin, weighted by the curvature; a leaf's weighted mean is then the Newton step of the leaf. Margins are written every
few rounds, together with the trees so far, so plans stay short and a fit that was cut off goes on where it was. Rows are written
once, with a number; margins are number and margin only, in the same buckets, so neither moves when they meet.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import dealt, new_path

#: Rounds without a better validation deviance after which a fit ends, and what counts as better (a share of the deviance).
PATIENCE = 3
BETTER = 1e-4
#: Rounds between two written tables of margins.
STRIDE = 4
#: Rows of a bucket, where there are more buckets than cores. Every bucket sends its sums of all bins in every round.
BUCKET_ROWS = 1 << 17


def tweedie_deviance(y: Column, mean: Column, power: float) -> Column:
    """Unit deviance for 1 < power < 2."""
    p = power
    return 2 * (
        F.pow(F.greatest(y, F.lit(0.0)), 2 - p) / ((1 - p) * (2 - p)) - y * F.pow(mean, 1 - p) / (1 - p) + F.pow(mean, 2 - p) / (2 - p)
    )


def newton_step(y: Column, margin: Column, power: float) -> tuple[Column, Column]:
    """(step, weight) of a row under a log link: minus gradient over curvature, and the curvature."""
    low, high = F.exp((1 - power) * margin), F.exp((2 - power) * margin)
    gradient = high - y * low
    curvature = (2 - power) * high - (1 - power) * y * low
    return -gradient / curvature, curvature


@dataclass
class BoostedTrees:
    """Trees in order with one rate; ``scale`` is the mean of the target, which it was divided by. ``history`` has the
    validation deviance before the first and after every round, also of the rounds behind the best one."""

    scale: float
    rate: float
    trees: list[DecisionTreeRegressionModel] = field(default_factory=list)
    history: list[float] = field(default_factory=list)
    stopped: bool = False

    def margin(self, df: DataFrame, out: str, begin: str | None = None, trees: list[DecisionTreeRegressionModel] | None = None) -> DataFrame:
        """Adds the margin: that of column ``begin`` (or 0) and the sum of the trees, or of some of them."""
        steps = [f"{out}_{i}" for i in range(len(self.trees if trees is None else trees))]
        scored = df
        for name, tree in zip(steps, self.trees if trees is None else trees):
            scored = tree.setPredictionCol(name).transform(scored)
        first = F.col(begin) if begin else F.lit(0.0)
        return scored.withColumn(out, sum((F.col(n) * self.rate for n in steps), first)).drop(*steps)

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Adds the expected target."""
        return self.margin(df, "_margin").withColumn(out, F.exp("_margin") * self.scale).drop("_margin")


def _buckets(spark: SparkSession, rows: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-rows // BUCKET_ROWS))


def _saved(model: BoostedTrees, folder: str, rows: DataFrame, buckets: int) -> DataFrame:
    """Writes the margins, and last the row that makes them and the trees count; returns the margins (_id, _f)."""
    spark = rows.sparkSession
    done = len(model.trees)
    margins = dealt(rows.select("_id", "_f"), "margins", "_id", f"{folder}/margins-{done}", buckets)
    state = {"rounds": done, "scale": model.scale, "rate": model.rate, "history": model.history}
    spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/state-{done}")
    return margins


def _resumed(spark: SparkSession, folder: str) -> tuple[BoostedTrees, DataFrame, DataFrame, int] | None:
    """The last state in ``folder``, rows, margins and their buckets: it is written after everything it names. Both tables are
    dealt anew for this session."""
    try:
        states = spark.read.parquet(f"{folder}/state-*").collect()  # one row per STRIDE rounds
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    state = max((json.loads(r["state"]) for r in states), key=lambda x: x["rounds"])
    trees = [DecisionTreeRegressionModel.load(f"{folder}/tree-{i}") for i in range(state["rounds"])]
    tables = [spark.read.parquet(f"{folder}/{name}") for name in ("rows", f"margins-{state['rounds']}")]
    buckets = _buckets(spark, tables[1].count())
    rows, margins = (dealt(table, "resumed", "_id", buckets=buckets) for table in tables)
    return BoostedTrees(state["scale"], state["rate"], trees, state["history"]), rows, margins, buckets


def fit_tweedie(
    train: DataFrame, label: str, held: str, power: float = 1.5, rate: float = 0.2, depth: int = 4, least: int = 20,
    most: int = 4000, seed: int = 42, folder: str | None = None, features: str = "features",
) -> BoostedTrees:
    """Boosted trees under Tweedie deviance with a log link, zeros and positive amounts in one model.

    Rows with the boolean column ``held`` validate: the fit ends PATIENCE rounds behind the best one, and later trees
    are dropped; ``stopped`` tells whether it was this and not ``most`` that ended it. ``folder`` (shared) keeps the
    rounds: a fit into a folder that has some goes on from there. Null and negative targets count as 0; without
    training rows there are no trees and every prediction is the mean, 0.
    """
    spark = train.sparkSession
    target = F.greatest(F.coalesce(F.col(label).cast("double"), F.lit(0.0)), F.lit(0.0))
    folder = folder or new_path(spark, "boosted-trees")
    before = _resumed(spark, folder)
    if before:
        model, rows, margins, buckets = before
    else:
        first, many = train.agg(F.avg(F.when(~F.col(held), target)), F.count(F.lit(1))).first()
        model, buckets = BoostedTrees(first or 0.0, rate), _buckets(spark, many)
        if not model.scale:
            return model
        rows = train.select(
            F.monotonically_increasing_id().alias("_id"), features, (target / model.scale).alias("_y"), F.col(held).alias("_held")
        )
        rows = dealt(rows, "boosted-rows", "_id", f"{folder}/rows", buckets)
        margins = _saved(model, folder, rows.withColumn("_f", F.lit(0.0)), buckets)
    at = lambda margins: rows.join(margins.hint("shuffle_hash"), "_id")  # noqa: E731  no sort: the margins of a bucket are few
    done = len(model.trees)  # trees that ``margins`` hold
    current = at(margins)
    if not model.history:
        model.history.append(_validation(current, power))
    while len(model.trees) < most:
        best = min(range(len(model.history)), key=model.history.__getitem__)
        if len(model.history) - 1 - best >= PATIENCE:
            model.stopped = True
            break
        step, weight = newton_step(F.col("_y"), F.col("_f"), power)
        fitted = DecisionTreeRegressor(
            featuresCol=features, labelCol="_step", weightCol="_weight", maxDepth=depth, minInstancesPerNode=least,
            seed=seed + len(model.trees), predictionCol="_p",
        ).fit(current.where(~F.col("_held")).select(features, step.alias("_step"), weight.alias("_weight")))
        fitted.write().overwrite().save(f"{folder}/tree-{len(model.trees)}")
        model.trees.append(fitted)
        current = model.margin(at(margins).withColumnRenamed("_f", "_g"), "_f", "_g", model.trees[done:]).drop("_g")
        now = _validation(current, power)
        model.history.append(now if now < min(model.history) * (1 - BETTER) else max(now, min(model.history)))
        if len(model.trees) - done >= STRIDE:
            done = len(model.trees)
            margins = _saved(model, folder, current, buckets)
            current = at(margins)
    best = min(range(len(model.history)), key=model.history.__getitem__)
    model.trees = model.trees[:best]
    return model


def _validation(rows: DataFrame, power: float) -> float:
    found = rows.where("_held").agg(F.avg(tweedie_deviance(F.col("_y"), F.exp("_f"), power))).first()[0]
    return float("inf") if found is None else float(found)
