"""Evaluation operators against brute force, and their edge cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import evaluation as ev


def preds(spark, rows):
    return spark.createDataFrame(rows, "label int, pred int")


def test_class_never_predicted_and_never_true(spark):
    out = {r["class"]: r for r in ev.per_class(preds(spark, [(0, 0), (0, 1), (1, 1), (2, 0), (1, 3)])).collect()}
    assert (out[2].precision, out[2].recall, out[2].f1, out[2].support) == (0.0, 0.0, 0.0, 1)
    assert (out[3].precision, out[3].recall, out[3].support) == (0.0, 0.0, 0)
    assert out[1].precision == 0.5 and out[1].recall == 0.5


def test_averages_follow_from_the_class_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(int(a), int(a if rng.random() < 0.7 else b)) for a, b in rng.integers(0, 6, (500, 2))]
    report = {r["class"]: r for r in ev.report(preds(spark, rows)).collect()}
    classes = [report[str(c)] for c in range(6)]
    support = sum(c.support for c in classes)
    assert support == 500 == report["accuracy"].support
    assert report["macro avg"].f1 == pytest.approx(np.mean([c.f1 for c in classes]))
    assert report["weighted avg"].f1 == pytest.approx(sum(c.f1 * c.support for c in classes) / support)
    assert report["accuracy"].f1 == pytest.approx(sum(c.recall * c.support for c in classes) / support)
    assert report["accuracy"].f1 == pytest.approx(np.mean([a == b for a, b in rows]))


def test_confusion_matrix_is_dense(spark):
    out = {(r.label, r.pred): r.n for r in ev.confusion_matrix(preds(spark, [(0, 0), (0, 2), (5, 5)])).collect()}
    assert len(out) == 9 and out[0, 0] == 1 and out[0, 2] == 1 and out[5, 5] == 1 and sum(out.values()) == 3


def test_tied_scores_at_third_place(spark):
    scores = [0.4, 0.2, 0.2, 0.2]
    df = spark.createDataFrame([(i, scores) for i in range(4)], "label int, s array<double>")
    out = {r.label: r.ok for r in df.select("label", ev.in_top_k("s", 3).alias("ok")).collect()}
    assert out == {0: True, 1: True, 2: True, 3: False}


def test_softmax_and_first_maximum(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([1000.0, 0.0, 0.0],)], "logits array<double>")
    rows = ev.score_logits(df).collect()
    assert [r.pred for r in rows] == [1, 0]
    assert rows[0].probs == pytest.approx(list(np.exp([-2, 0, 0]) / np.exp([-2, 0, 0]).sum()))
    assert rows[1].probs == pytest.approx([1.0, 0.0, 0.0])


def brute_rho(frame):
    a, b = frame.y.rank(), frame.p.rank()
    return np.nan if a.std() == 0 or b.std() == 0 else np.corrcoef(a, b)[0, 1]


def test_spearman_with_ties_and_groups(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"g": rng.integers(0, 3, 800), "y": np.maximum(0, np.round(rng.normal(size=800), 1))})
    frame["p"] = np.round(frame.y + rng.normal(size=800), 1)
    out = {r.g: r.rho for r in ev.spearman(spark.createDataFrame(frame), "y", "p", ["g"]).collect()}
    for g, part in frame.groupby("g"):
        assert out[g] == pytest.approx(brute_rho(part))


def test_spearman_of_a_constant_is_null(spark):
    df = spark.createDataFrame([("c", 1.0, 2.0), ("c", 1.0, 3.0), ("one", 1.0, 1.0)], "g string, y double, p double")
    assert {r.g: r.rho for r in ev.spearman(df, "y", "p", ["g"]).collect()} == {"c": None, "one": None}


def test_packed_blends_leave_a_task_one_grid_point_at_a_time():
    rng = np.random.default_rng(4)
    points = np.array([(i / 20, j / 20, (20 - i - j) / 20) for i in range(21) for j in range(21 - i)])
    made = ev._packed_blends(points, np.tile(np.linspace(0.1, 0.9, 7), (len(points), 1)), rng.random(5000), rng.random((3, 5000)))
    seen = 0
    for point, batch in enumerate(made):
        assert set(batch["point"].to_pylist()) == {point} and batch.nbytes < 40 * 5000
        seen += sum(len(n) // 8 for n in batch["xs"].to_pylist())
    assert point == len(points) - 1 and seen == 5000 * len(points)


def test_ensemble_search_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    f = pd.DataFrame(rng.integers(0, 12, (120, 4)).astype(float), columns=["y", "a", "b", "c"])
    out = ev.ensemble_search(spark.createDataFrame(f), "y", "a", "b", "c", steps=5).toPandas()
    assert len(out) == 21 and out.is_best.sum() == 1
    for r in out.itertuples():
        blend = r.wa * f.a + r.wb * f.b + r.wc * f.c
        assert r.rho == pytest.approx(brute_rho(pd.DataFrame({"y": f.y, "p": blend.round(9)})), abs=2e-2)
    best = out[out.is_best].iloc[0]
    assert best.rho == out.rho.max()
    assert (out[out.rho == best.rho][["wa", "wb"]].apply(tuple, axis=1).min()) == (best.wa, best.wb)


def test_weight_grid_has_no_negative_weight(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0, 1.0)], "id int, a double, b double, c double")
    out = ev.blends(df, "a", "b", "c", ["id"])
    assert out.count() == 231
    assert out.where((20 - F.col("ia") - F.col("ib")) < 0).count() == 0


def brute_stop(losses, patience):
    best, best_epoch, bad = float("inf"), None, 0
    for epoch, loss in losses:
        if loss < best:
            best, best_epoch, bad = loss, epoch, 0
        else:
            bad += 1
            if bad >= patience:
                return best_epoch, best, epoch
    return best_epoch, best, losses[-1][0]


@pytest.mark.parametrize("patience", [1, 2, 3, 50])
def test_early_stop_equals_brute_force(spark, patience):
    rng = np.random.default_rng(2)
    curves = {f"m{i}": [(e, float(x)) for e, x in enumerate(rng.integers(0, 9, 25), 11)] for i in range(8)}
    rows = [(m, e, 2, x) for m, c in curves.items() for e, x in c]
    rows += [(m, e, 1, -1.0) for m in curves for e in range(1, 11)]  # phase 1 does not count
    history = spark.createDataFrame(rows, "model string, epoch int, phase int, val_loss double")
    for r in ev.early_stop(history, patience).collect():
        assert (r.best_epoch, r.best_val_loss, r.stop_epoch) == brute_stop(curves[r.model], patience)


def test_mae_with_an_empty_segment(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.5)], "y double, p double")
    out = {r.segment: (r.n, r.mae) for r in ev.mae_by_segment(df, "y", "p").collect()}
    assert out == {"all": (2, 0.75), "zeros": (0, None), "nonzeros": (2, 0.75)}


def test_best_model_on_a_tie_is_the_first(spark):
    rows = [("b", 0, 0), ("b", 1, 0), ("a", 0, 0), ("a", 1, 0)]
    df = spark.createDataFrame(rows, "model string, label int, pred int")
    assert {r.best_model for r in ev.comparison_table(df, ["b", "a"]).collect()} == {"b"}
