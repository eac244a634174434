"""Classification and regression evaluation over prediction tables.

Classification metrics derive from counts per (label, prediction), so the rows are read once
and only class pairs are shuffled. A division by zero counts as 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.scalars import argmax, flag, ratio, softmax
from tallyloom.operators.ordering import (
    average_rank,
    dense_index,
    local_counts,
    placed_values,
    range_starts,
)
from tallyloom.session import bucket_count, written

ERROR = "decimal(28,6)"


def _ratio0(a: Column, b: Column) -> Column:
    return F.coalesce(ratio(a, b), F.lit(0.0))


def score_logits(df: DataFrame, logits: str = "logits") -> DataFrame:
    """Adds class probabilities and the predicted class (lowest index on ties)."""
    return df.withColumn("probs", softmax(F.col(logits))).withColumn("pred", argmax(F.col(logits)))


# --- classification ---------------------------------------------------------------------------


def confusion_counts(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*groups, "label", "pred").agg(F.count(F.lit(1)).alias("n"))


def accuracy(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*groups).agg(F.avg(flag(F.col("pred") == F.col("label"))).alias("accuracy"))


def per_class(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1, support of every class seen as label or prediction."""
    zero = F.lit(0).cast("bigint")
    right = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(zero)
    sides = F.explode(
        F.array(
            F.struct(F.col("label").alias("class"), F.col("n").alias("support"), zero.alias("predicted"), right.alias("tp")),
            F.struct(F.col("pred").alias("class"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("tp")),
        )
    )
    counts = (
        confusion_counts(df, groups)
        .select(*groups, sides.alias("s"))
        .select(*groups, "s.*")
        .groupBy(*groups, "class")
        .agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    )
    return counts.select(
        *groups,
        "class",
        _ratio0(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio0(F.col("tp"), F.col("support")).alias("recall"),
        _ratio0(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
        "support",
        "tp",
    )


def _averages(classes: DataFrame, groups: Sequence[str]) -> DataFrame:
    weighted = lambda c: ratio(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    return classes.groupBy(*groups).agg(
        F.sum("support").alias("n"),
        ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        *[F.avg(c).alias(f"{c}_macro") for c in ("precision", "recall", "f1")],
        *[weighted(c).alias(f"{c}_weighted") for c in ("precision", "recall", "f1")],
    )


def summary(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Rows, accuracy, macro and support-weighted F1."""
    return _averages(per_class(df, groups), groups).select(
        *groups, "n", "accuracy", "f1_macro", "f1_weighted"
    )


def in_top_k(scores: str, k: int = 3) -> Column:
    """Whether the label is among the k highest scores; equal scores favour the lower class."""
    own = F.get(F.col(scores), F.col("label"))
    positions = F.sequence(F.lit(0), F.size(scores) - 1)
    ahead = F.filter(
        positions,
        lambda i: (F.get(F.col(scores), i) > own) | ((F.get(F.col(scores), i) == own) & (i < F.col("label"))),
    )
    return F.size(ahead) < k


def topk_accuracy(df: DataFrame, scores: str, k: int = 3, groups: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*groups).agg(F.avg(flag(in_top_k(scores, k))).alias(f"top{k}_accuracy"))


def confusion_matrix(df: DataFrame) -> DataFrame:
    """Counts for every pair of known classes, zeros included.

    Each class row spreads itself over the class indexes, then two equi-joins fill it.
    """
    counts = confusion_counts(df)
    seen = counts.select(F.explode(F.array("label", "pred")).alias("class"))
    classes = dense_index(seen, "class", "i")
    size = seen.agg(F.countDistinct("class").cast("int")).scalar()
    grid = (
        classes.select(F.col("class").alias("label"), F.explode(F.sequence(F.lit(0), size - 1)).alias("i"))
        .join(classes, "i")
        .select("label", F.col("class").alias("pred"))
    )
    return grid.join(counts, ["label", "pred"], "left").na.fill(0, subset=["n"])


def per_class_accuracy(df: DataFrame, out: str = "accuracy") -> DataFrame:
    """Share of each label's rows that are predicted right; 0 for classes that are only predicted."""
    return per_class(df).select("class", F.col("recall").alias(out))


def side_by_side(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per-class accuracy of two models."""
    a = per_class_accuracy(first, "first_accuracy")
    return a.join(per_class_accuracy(second, "second_accuracy"), "class", "full")


def report(df: DataFrame) -> DataFrame:
    """Per-class rows plus accuracy, macro and weighted averages."""
    classes = per_class(df)
    values = ["precision", "recall", "f1", "support"]
    rows = classes.select(F.col("class").cast("string").alias("class"), *values)
    none = F.lit(None).cast("double")
    lines = F.explode(
        F.array(
            F.struct(
                F.lit("accuracy").alias("class"), none.alias("precision"), none.alias("recall"),
                F.col("accuracy").alias("f1"), F.col("n").alias("support"),
            ),
            *[
                F.struct(
                    F.lit(f"{kind} avg").alias("class"),
                    *[F.col(f"{c}_{kind}").alias(c) for c in ("precision", "recall", "f1")],
                    F.col("n").alias("support"),
                )
                for kind in ("macro", "weighted")
            ],
        )
    )
    return rows.unionByName(_averages(classes, []).select(lines.alias("r")).select("r.*"))


def split_metrics(df: DataFrame, scores: str) -> DataFrame:
    """Metrics per split, with the accuracy gap between train and test on every row."""
    base = summary(df, ["split"]).join(topk_accuracy(df, scores, 3, ["split"]), "split")
    by_split = accuracy(df, ["split"])
    gap = by_split.agg(
        (F.max(F.when(F.col("split") == "train", F.col("accuracy")))
         - F.max(F.when(F.col("split") == "test", F.col("accuracy")))).alias("gap")
    )
    return base.withColumn("train_test_gap", gap.scalar())


def comparison_table(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per metric, one column per model, and the most accurate model (first on ties)."""
    metrics = summary(df, ["model"])
    place = F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model"))
    best = metrics.agg(F.min(F.struct((-F.col("accuracy")).alias("a"), place.alias("p"), "model"))["model"]).scalar()
    long = metrics.unpivot(["model"], ["accuracy", "f1_macro", "f1_weighted"], "metric", "value")
    return long.groupBy("metric").pivot("model", list(models)).agg(F.first("value")).withColumn("best_model", best)


def paired_correctness(first: DataFrame, second: DataFrame, key: str = "row_id") -> DataFrame:
    """Per item: both models' predictions and whether each is right."""
    a = first.select(key, "label", F.col("pred").alias("first_pred"))
    b = second.select(key, F.col("pred").alias("second_pred"))
    return a.join(b, key).withColumns(
        {
            "first_right": flag(F.col("first_pred") == F.col("label")),
            "second_right": flag(F.col("second_pred") == F.col("label")),
        }
    )


def agreement(paired: DataFrame) -> DataFrame:
    """One row: right answers per model, and how the two agree."""
    a, b = F.col("first_right"), F.col("second_right")
    return paired.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(a).alias("first_correct"),
        F.sum(b).alias("second_correct"),
        F.sum(a * b).alias("both_right"),
        F.sum((1 - a) * (1 - b)).alias("both_wrong"),
        F.sum(flag(F.col("first_pred") == F.col("second_pred"))).alias("same_answer"),
    )


def accuracy_at_threshold(df: DataFrame, prob: str, positive: Column, threshold: float = 0.5) -> DataFrame:
    return df.agg(F.avg(flag((F.col(prob) > threshold) == positive)).alias("accuracy"))


def gain_table(df: DataFrame, baseline: str) -> DataFrame:
    """Per model: train and test accuracy, their gap, and the test gain over a baseline model."""
    right = flag(F.col("pred") == F.col("label"))
    share = lambda s: F.avg(F.when(F.col("split") == s, right))
    base = df.groupBy("model").agg(share("train").alias("train"), share("test").alias("test"))
    reference = base.where(F.col("model") == baseline).select("test").scalar()
    return base.withColumn("gap", F.col("train") - F.col("test")).withColumn(
        "gain", F.col("test") - reference
    )


# --- training history -------------------------------------------------------------------------


def loss_gaps(history: DataFrame) -> DataFrame:
    return history.select("model", "epoch", (F.col("val_loss") - F.col("train_loss")).alias("loss_gap"))


def overfitting_score(history: DataFrame, last_n: int = 5) -> DataFrame:
    """Mean validation - training loss over the last epochs of each model."""
    latest = Window.partitionBy("model").orderBy(F.desc("epoch"))
    return (
        loss_gaps(history)
        .withColumn("_r", F.row_number().over(latest))
        .where(F.col("_r") <= last_n)
        .groupBy("model")
        .agg(F.avg("loss_gap").alias("overfitting"))
    )


def early_stop(history: DataFrame, patience: int, phase: int = 2) -> DataFrame:
    """Per model: the best epoch by strict improvement and the epoch where training stops.

    An epoch improves when it beats all before it; training stops at the first epoch that ends
    ``patience`` epochs without improvement, else at the last one. One row per epoch, so a
    model's window is as long as its training.
    """
    by_epoch = Window.partitionBy("model").orderBy("epoch")
    before = by_epoch.rowsBetween(Window.unboundedPreceding, -1)
    so_far = by_epoch.rowsBetween(Window.unboundedPreceding, 0)
    improved = F.coalesce(F.col("val_loss") < F.min("val_loss").over(before), F.lit(True))
    runs = (
        history.where(F.col("phase") == phase)
        .withColumn("improved", improved)
        .withColumn("island", F.sum(flag(F.col("improved"))).over(so_far))
        .withColumn("run", F.row_number().over(Window.partitionBy("model", "island").orderBy("epoch")) - 1)
    )
    stops = F.min(F.when(F.col("run") >= patience, F.col("epoch"))).over(Window.partitionBy("model"))
    until = runs.withColumn(
        "stop_epoch", F.coalesce(stops, F.max("epoch").over(Window.partitionBy("model")))
    ).where(F.col("epoch") <= F.col("stop_epoch"))
    best = F.max(F.when(F.col("improved"), F.struct("epoch", "val_loss")))
    return until.groupBy("model", "stop_epoch").agg(best.alias("b")).select(
        "model", F.col("b.epoch").alias("best_epoch"), F.col("b.val_loss").alias("best_val_loss"), "stop_epoch"
    )


# --- regression and ranking -------------------------------------------------------------------


def mae_by_segment(df: DataFrame, y: str, p: str) -> DataFrame:
    """Mean absolute error overall, on zero targets, on the others."""
    error = F.abs(F.col(y) - F.col(p)).cast(ERROR)
    segments = {"all": F.lit(True), "zeros": F.col(y) == 0, "nonzeros": F.col(y) != 0}
    wide = df.agg(
        *[F.count(F.when(c, 1)).alias(f"{s}_n") for s, c in segments.items()],
        *[ratio(F.sum(F.when(c, error)), F.count(F.when(c, 1))).alias(f"{s}_mae") for s, c in segments.items()],
    )
    rows = F.explode(
        F.array(*[F.struct(F.lit(s).alias("segment"), F.col(f"{s}_n").alias("n"), F.col(f"{s}_mae").alias("mae")) for s in segments])
    )
    return wide.select(rows.alias("r")).select("r.*")


def rank_correlation(
    df: DataFrame, y_rank: str, p: str, groups: Sequence[str] = (), placed: DataFrame | None = None
) -> DataFrame:
    """Pearson correlation between a rank column over the group and the tie-averaged ranks of ``p``.

    Ranks of ``p`` are taken inside value ranges; each range is summed up on its own and the
    rows below it enter as a shift of those sums, so no rank is joined back to the rows.
    Null when either side is constant. ``placed`` are the rows with ranges of the caller's own.
    """
    y, keys = F.col(y_rank), [*groups, "_bucket"]
    placed = placed_values(df, p, groups) if placed is None else placed
    values = local_counts(placed, p, groups, [
        F.sum(y).alias("_s"), F.sum(y * y).alias("_ss"), F.min(y).alias("_lo"), F.max(y).alias("_hi"),
    ])
    n, local = F.col("n"), F.col("_local") + (F.col("n") + 1) / 2.0
    ranges = values.groupBy(*keys).agg(
        F.sum(n).alias("_size"),
        F.count(F.lit(1)).alias("_values"),
        F.sum(n * local).alias("_r"),
        F.sum(n * local * local).alias("_rr"),
        F.sum(local * F.col("_s")).alias("_rs"),
        F.sum("_s").alias("_s"),
        F.sum("_ss").alias("_ss"),
        F.min("_lo").alias("_lo"),
        F.max("_hi").alias("_hi"),
    )
    return _correlation(ranges, groups)


def _correlation(ranges: DataFrame, groups: Sequence[str]) -> DataFrame:
    """n and rho per group from the sums of its value ranges: rows and values, ranks inside the range (sum, squares, times
    the target's rank), the target's ranks (sum, squares, least, greatest)."""
    middle = (F.col("total") + 1) / 2.0
    size, shift = F.col("_size"), F.col("_start") - middle
    sums = range_starts(ranges, groups).groupBy(*groups).agg(
        F.sum("_size").alias("n"),
        F.sum(F.col("_rs") + shift * F.col("_s")).alias("_cov"),
        F.sum(F.col("_rr") + 2 * shift * F.col("_r") + shift * shift * size).alias("_vp"),
        F.sum(F.col("_ss") - 2 * middle * F.col("_s") + middle * middle * size).alias("_vy"),
        ((F.sum("_values") > 1) & (F.max("_hi") > F.min("_lo"))).alias("_varies"),
    )
    rho = F.col("_cov") / (F.sqrt("_vp") * F.sqrt("_vy"))
    return sums.select(*groups, "n", F.when(F.col("_varies"), rho).alias("rho"))


def spearman(df: DataFrame, y: str, p: str, groups: Sequence[str] = ()) -> DataFrame:
    """Spearman rank correlation per group, average ranks on ties."""
    pairs = df.select(*groups, y, p).na.drop(subset=[y, p])
    return rank_correlation(average_rank(pairs, y, groups, "_y"), "_y", p, groups)


# --- ensembles --------------------------------------------------------------------------------


def weight_grid(steps: int = 20) -> Column:
    """All weight triples on a grid as a literal array: integer steps, so none is negative."""
    return F.array(
        *[
            F.struct(F.lit(i).alias("ia"), F.lit(j).alias("ib"))
            for i in range(steps + 1)
            for j in range(steps + 1 - i)
        ]
    )


def blends(df: DataFrame, a: str, b: str, c: str, keep: Sequence[str], steps: int = 20) -> DataFrame:
    """Every prediction row under every weight triple: a fixed number of copies per row."""
    rows = df.select(*keep, a, b, c, F.explode(weight_grid(steps)).alias("w")).select(
        *keep, a, b, c, "w.ia", "w.ib"
    )
    wa, wb = F.col("ia") / float(steps), F.col("ib") / float(steps)
    wc = (steps - F.col("ia") - F.col("ib")) / float(steps)
    blend = wa * F.col(a) + wb * F.col(b) + wc * F.col(c)
    return rows.select(*keep, "ia", "ib", blend.alias("blend"))


#: Rows that one task sorts together, and rows per value range, about.
TOGETHER = 1 << 18
PER_RANGE = 1 << 20
PACKED = "point int, _bucket int, xs binary, ns binary, ys binary, _ss double, _lo double, _hi double"
SUMS = "point int, _bucket int, _size long, _values long, _r double, _rr double, _rs double, _s double, _ss double, _lo double, _hi double"


def _packed_blends(points: np.ndarray, cuts: np.ndarray, y: np.ndarray, models: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One batch per grid point with a row per value range: the distinct blends in order, their rows, and the sum of their
    target ranks. All points together would hold hundreds of copies of the rows."""
    kinds = {"int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    for point, (weights, cut) in enumerate(zip(points, cuts)):
        rows: dict[str, list] = {f.split()[0]: [] for f in PACKED.split(", ")}
        blend = weights[0] * models[0] + weights[1] * models[1] + weights[2] * models[2]
        order = np.argsort(blend, kind="stable")
        x, own = blend[order], y[order]
        first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        n, s = np.diff(np.append(first, len(x))), np.add.reduceat(own, first)
        bucket = np.searchsorted(cut, x[first], "left")
        starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        inner = first[starts]
        rows["_ss"] += np.add.reduceat(own * own, inner).tolist()
        rows["_lo"] += np.minimum.reduceat(own, inner).tolist()
        rows["_hi"] += np.maximum.reduceat(own, inner).tolist()
        rows["_bucket"] += bucket[starts].tolist()
        rows["point"] += [point] * len(starts)
        for name, values in (("xs", x[first]), ("ns", n), ("ys", s)):
            rows[name] += [part.tobytes() for part in np.split(values, starts[1:])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[f.split()[0]], kinds[f.split()[1]]) for f in PACKED.split(", ")], names=list(rows)
        )


def _range_sums(part: pa.Table) -> pa.Table:
    """The sums of one value range of one grid point over the packed blends of all tasks."""
    x, n, s = (np.frombuffer(b"".join(part[c].to_pylist()), kind) for c, kind in (("xs", "f8"), ("ns", "i8"), ("ys", "f8")))
    order = np.argsort(x, kind="stable")
    x, n, s = x[order], n[order], s[order]
    first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    n, s = np.add.reduceat(n, first), np.add.reduceat(s, first)
    local = np.cumsum(n) - n + (n + 1) / 2.0
    low, high = pc.min(part["_lo"]).as_py(), pc.max(part["_hi"]).as_py()
    sums = [int(n.sum()), len(n), float((n * local).sum()), float((n * local * local).sum()), float((local * s).sum()), float(s.sum())]
    row = [part["point"][0].as_py(), part["_bucket"][0].as_py(), *sums, pc.sum(part["_ss"]).as_py(), low, high]
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    return pa.table({f.split()[0]: pa.array([v], kinds[f.split()[1]]) for f, v in zip(SUMS.split(", "), row)})


def ensemble_search(df: DataFrame, y: str, a: str, b: str, c: str, steps: int = 20) -> DataFrame:
    """Spearman of every blend; the first maximum in (weight a, weight b) order is best.

    The target is ranked once. Every task blends and sorts its own rows for each grid point and hands on, per point
    and value range, its distinct blends as one packed row; a range is then merged and ranked in one task, and
    the rows of lower ranges are a shift of its sums. No row is copied per grid point. The ranges of all points come
    from one sample of the rows, 50 for each range; they only balance the work.
    """
    spark = df.sparkSession
    target = written(average_rank(df.select(y, a, b, c).na.drop(), y, out="_y").select("_y", a, b, c), "ranked-target")
    buckets = max(bucket_count(df), math.ceil(target.count() / PER_RANGE))
    grid = [(i, j) for i in range(steps + 1) for j in range(steps + 1 - i)]
    points = np.array([(i / float(steps), j / float(steps), (steps - i - j) / float(steps)) for i, j in grid])
    some = target.select(a, b, c).orderBy(F.xxhash64(a, b, c)).limit(50 * buckets).collect()
    sample = points @ np.array([tuple(r) for r in some], float).reshape(-1, 3).T
    at = (np.arange(1, buckets) * sample.shape[1]) // buckets
    cuts = np.sort(sample, axis=1)[:, at] if len(some) else np.zeros((len(grid), 0))
    shared = spark.sparkContext.broadcast((points, cuts))  # points x ranges

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([x.to_numpy() for x in batch.columns]))
            if sum(x.shape[1] for x in held) >= TOGETHER:
                rows = np.concatenate(held, axis=1)
                held = []
                yield from _packed_blends(*shared.value, rows[0], rows[1:])
        if held and sum(x.shape[1] for x in held):
            rows = np.concatenate(held, axis=1)
            yield from _packed_blends(*shared.value, rows[0], rows[1:])

    kinds = target.select(*(F.col(x).cast("double") for x in ("_y", a, b, c)))
    ranges = kinds.mapInArrow(pack, PACKED).groupBy("point", "_bucket").applyInArrow(_range_sums, SUMS)
    place = spark.createDataFrame([(n, i, j) for n, (i, j) in enumerate(grid)], "point int, ia int, ib int")
    scores = place.join(F.broadcast(_correlation(ranges, ["point"])), "point")  # one row per grid point
    scores = scores.select(
        (F.col("ia") / float(steps)).alias("wa"),
        (F.col("ib") / float(steps)).alias("wb"),
        ((steps - F.col("ia") - F.col("ib")) / float(steps)).alias("wc"),
        F.round("rho", 9).alias("rho"),
    )
    # At most one row per grid point from here on.
    place = Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("rho"), "wa", "wb")
    return scores.withColumn("is_best", F.row_number().over(place) == 1)
