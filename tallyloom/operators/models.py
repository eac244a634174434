"""Distributed fits over feature tables: revenue models, a linear probe, importances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import written


def assembled(df: DataFrame, columns: Sequence[str], nullable: Sequence[str] = ()) -> DataFrame:
    """Adds the vector ``features``: nulls become 0; ``nullable`` columns also get a null flag."""
    flags = {f"{c}_missing": F.col(c).isNull().cast("double") for c in nullable}
    filled = df.withColumns(flags) if flags else df
    filled = filled.na.fill(0, subset=list(columns))
    vector = VectorAssembler(inputCols=[*columns, *flags], outputCol="features")
    return vector.transform(filled).drop(*flags)


def model_rows(df: DataFrame, keep: Sequence[str], columns: Sequence[str], nullable: Sequence[str] = ()) -> DataFrame:
    """The columns ``keep`` and the vector ``features``, written once: a fit reads its rows about five times, and to assemble
    a hundred columns costs more than to read one vector."""
    return written(assembled(df, columns, nullable).select(*keep, "features"), "model-rows")


#: Trees that a boosted model grows at most; validation rows end a fit long before.
MAX_TREES = 4000


def two_stage_revenue(
    train: DataFrame, df: DataFrame, label: str, held: str, trees: int = MAX_TREES, depth: int = 5, seed: int = 42
) -> DataFrame:
    """P(spend > 0) times the predicted amount, fitted on spenders with relative-error loss.

    Absolute error weighted by 1 / max(1, amount) is the mean relative error. Training rows marked by the
    boolean column ``held`` validate: both models stop growing when these no longer improve.
    """
    marked = train.withColumn("_spends", (F.col(label) > 0).cast("double"))
    classifier = GBTClassifier(
        labelCol="_spends", maxIter=trees, maxDepth=depth, seed=seed, predictionCol="_class", validationIndicatorCol=held
    ).fit(marked)
    weighted = marked.where(F.col("_spends") == 1).withColumn("_w", 1 / F.greatest(F.col(label), F.lit(1.0)))
    regressor = GBTRegressor(
        labelCol=label, weightCol="_w", lossType="absolute", maxIter=trees, maxDepth=depth, seed=seed,
        predictionCol="_amount", validationIndicatorCol=held,
    ).fit(weighted)
    scored = regressor.transform(classifier.transform(df))
    chance = vector_to_array("probability")[1]
    return (
        scored.withColumn("spend_probability", chance)
        .withColumn("prediction", chance * F.greatest("_amount", F.lit(0.0)))
        .drop("probability", "rawPrediction", "_class", "_amount")
    )


def back_transformed(log_prediction: Column) -> Column:
    """expm1(max(x, 0))."""
    return F.expm1(F.greatest(log_prediction, F.lit(0.0)))


def log_target_cv(
    train: DataFrame, test: DataFrame, label: str, fold: str = "fold", folds: int = 5, trees: int = MAX_TREES,
    depth: int = 5, seed: int = 7,
) -> tuple[DataFrame, DataFrame, object]:
    """Cross-validated regression of log(1 + target).

    Returns out-of-fold predictions of the training rows, the mean of the fold models on the
    test rows, and a model refitted on all rows with the mean number of trees kept.
    """
    logged = train.withColumn("_y", F.log1p(F.greatest(F.col(label), F.lit(0.0))))
    model = lambda n: GBTRegressor(labelCol="_y", maxIter=n, maxDepth=depth, seed=seed, predictionCol="_p")
    out_of_fold, fitted = None, []
    for f in range(folds):
        marked = logged.withColumn("_held", F.col(fold) == f)
        fit = model(trees).setValidationIndicatorCol("_held").fit(marked)
        fitted.append(fit)
        part = fit.transform(logged.where(F.col(fold) == f))
        out_of_fold = part if out_of_fold is None else out_of_fold.unionByName(part)
    scored, names = test, []
    for f, fit in enumerate(fitted):
        names.append(f"_p{f}")
        scored = fit.setPredictionCol(names[-1]).transform(scored)
    mean = sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)
    kept = max(1, round(sum(m.getNumTrees for m in fitted) / len(fitted)))
    refit = model(kept).fit(logged)
    return (
        out_of_fold.withColumn("prediction", back_transformed(F.col("_p"))).drop("_p", "_y"),
        scored.withColumn("prediction", back_transformed(mean)).drop(*names),
        refit,
    )


def tweedie(train: DataFrame, df: DataFrame, label: str, power: float = 1.5, penalty: float = 0.01) -> DataFrame:
    """Tweedie regression with a log link; zeros and positive amounts in one model.

    The target is divided by its mean for the fit, which the log link absorbs.
    """
    mean = train.agg(F.avg(label)).first()[0] or 1.0
    scaler = StandardScaler(inputCol="features", outputCol="_scaled", withMean=True)
    model = GeneralizedLinearRegression(
        family="tweedie", variancePower=power, linkPower=0.0, labelCol="_y", featuresCol="_scaled",
        regParam=penalty, maxIter=50, predictionCol="_p",
    )
    fitted = Pipeline(stages=[scaler, model]).fit(train.withColumn("_y", F.col(label) / mean))
    return fitted.transform(df).withColumn("prediction", F.col("_p") * mean).drop("_scaled", "_p")


def linear_probe(train: DataFrame, df: DataFrame, vector: str, label: str, penalty: float = 0.01) -> DataFrame:
    """Linear classifier over frozen vectors, standardised and multinomial: fitted on ``train``, adds prediction and
    probs to ``df``."""
    rows = lambda part: part.withColumn("_v", array_to_vector(vector))
    scaler = StandardScaler(inputCol="_v", outputCol="_scaled", withMean=True)
    model = LogisticRegression(
        featuresCol="_scaled", labelCol=label, family="multinomial", regParam=penalty, maxIter=100,
        probabilityCol="_probs", rawPredictionCol="_raw",
    )
    out = Pipeline(stages=[scaler, model]).fit(rows(train)).transform(rows(df))
    return out.withColumn("probs", vector_to_array("_probs")).drop("_v", "_scaled", "_probs", "_raw")


def feature_importances(df: DataFrame, model, k: int = 25) -> DataFrame:
    """The k most important inputs of a fitted tree model over ``features`` of ``df``."""
    attributes = df.schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for kind in attributes.values() for a in kind}
    rows = [(names[i], float(v)) for i, v in enumerate(model.featureImportances.toArray())]
    table = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature").limit(k)
