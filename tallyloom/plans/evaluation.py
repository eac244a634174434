"""Queries of the evaluation family."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.scalars import rounded
from tallyloom.operators import evaluation as ev
from tallyloom.plans.registry import query, with_sql
from tallyloom.sources import bindings as b
from tallyloom.sources.bindings import HISTORY_SQL, PRED2_SQL, PRED_SQL, REVPRED_SQL, TX_SQL

PATIENCE = 7

CLASS_SQL = """
both_models AS (
  SELECT 'first' AS model, row_id, split, label, pred FROM scored
  UNION ALL SELECT 'second', row_id, split, label, pred FROM scored2),
per_class AS (
  SELECT model, split, c AS class, sum(tp) AS tp, sum(s) AS support, sum(p) AS predicted FROM (
    SELECT model, split, label AS c, CASE WHEN label = pred THEN 1 ELSE 0 END AS tp, 1 AS s, 0 AS p FROM both_models
    UNION ALL SELECT model, split, pred, 0, 0, 1 FROM both_models)
  GROUP BY GROUPING SETS ((model, split, c), (model, c))),
scores AS (
  SELECT model, split, class, CAST(support AS BIGINT) AS support, CAST(tp AS BIGINT) AS tp,
         coalesce(tp::DOUBLE / nullif(predicted, 0), 0.0) AS precision,
         coalesce(tp::DOUBLE / nullif(support, 0), 0.0) AS recall,
         coalesce(2 * tp::DOUBLE / nullif(predicted + support, 0), 0.0) AS f1 FROM per_class),
summary AS (
  SELECT model, split, CAST(sum(support) AS BIGINT) AS n, sum(tp)::DOUBLE / sum(support) AS accuracy,
         avg(precision) AS precision_macro, avg(recall) AS recall_macro, avg(f1) AS f1_macro,
         sum(precision * support) / sum(support) AS precision_weighted,
         sum(recall * support) / sum(support) AS recall_weighted, sum(f1 * support) / sum(support) AS f1_weighted
  FROM scores GROUP BY 1, 2)
"""

TOP3 = """(SELECT count(*) FROM range(0, 8) r(i)
    WHERE logits[i + 1] > logits[label + 1] OR (logits[i + 1] = logits[label + 1] AND i < label)) < 3"""


def _sql(select: str, *extra: str) -> str:
    return with_sql(PRED_SQL, PRED2_SQL, CLASS_SQL, *extra, select=select)


def scored(spark, sf):
    """First model: predictions from the logits (argmax needs no probabilities)."""
    rows = b.predictions(spark, sf)
    return rows.withColumn("pred", ev.argmax(F.col("logits")))


def both_models(spark, sf):
    columns = ["model", "row_id", "split", "label", "pred"]
    first = scored(spark, sf).withColumn("model", F.lit("first")).select(columns)
    return first.unionByName(b.second_model(spark, sf).withColumn("model", F.lit("second")).select(columns))


@query("softmax_argmax", with_sql(PRED_SQL, select="""
SELECT row_id, pred, round(p[1], 6) AS p0, round(p[8], 6) AS p7, round(list_max(p), 6) AS p_max FROM (
  SELECT row_id, pred, list_transform(e, lambda x: x / list_sum(e)) AS p FROM (
    SELECT row_id, pred, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM scored))"""))
def _(spark, sf):
    out = ev.score_logits(b.predictions(spark, sf))
    return rounded(
        out.select("row_id", "pred", F.get("probs", F.lit(0)).alias("p0"), F.get("probs", F.lit(7)).alias("p7"),
                   F.array_max("probs").alias("p_max"))
    )


@query("accuracy", _sql("SELECT avg(CASE WHEN pred = label THEN 1 ELSE 0 END) AS accuracy FROM scored"))
def _(spark, sf):
    return ev.accuracy(scored(spark, sf))


@query("f1_macro_weighted", _sql("""
SELECT n, accuracy, round(f1_macro, 9) AS f1_macro, round(f1_weighted, 9) AS f1_weighted
FROM summary WHERE model = 'first' AND split IS NULL"""))
def _(spark, sf):
    return ev.summary(scored(spark, sf)).withColumns({c: F.round(c, 9) for c in ("f1_macro", "f1_weighted")})


@query("topk_accuracy", _sql(f"SELECT avg(CASE WHEN {TOP3} THEN 1 ELSE 0 END) AS top3_accuracy FROM scored"))
def _(spark, sf):
    return ev.topk_accuracy(scored(spark, sf), "logits", 3)


@query("confusion_matrix", _sql("""
SELECT CAST(a.i AS INT) AS label, CAST(p.i AS INT) AS pred, coalesce(n, 0) AS n
FROM range(0, 8) a(i), range(0, 8) p(i) LEFT JOIN (
  SELECT label, pred, count(*) AS n FROM scored2 GROUP BY 1, 2) c ON c.label = a.i AND c.pred = p.i"""))
def _(spark, sf):
    return ev.confusion_matrix(b.second_model(spark, sf))


@query("per_class_accuracy", _sql("""
SELECT class, max(recall) FILTER (model = 'first') AS first_accuracy, max(recall) FILTER (model = 'second') AS second_accuracy
FROM scores WHERE split IS NULL GROUP BY 1"""))
def _(spark, sf):
    return ev.side_by_side(scored(spark, sf), b.second_model(spark, sf))


@query("classification_report", _sql("""
SELECT CAST(class AS VARCHAR) AS class, precision, recall, f1, support FROM scores WHERE model = 'first' AND split IS NULL
UNION ALL SELECT 'accuracy', NULL, NULL, round(accuracy, 9), n FROM summary WHERE model = 'first' AND split IS NULL
UNION ALL SELECT 'macro avg', round(precision_macro, 9), round(recall_macro, 9), round(f1_macro, 9), n
  FROM summary WHERE model = 'first' AND split IS NULL
UNION ALL SELECT 'weighted avg', round(precision_weighted, 9), round(recall_weighted, 9), round(f1_weighted, 9), n
  FROM summary WHERE model = 'first' AND split IS NULL"""))
def classification_report(spark, sf):
    out = ev.report(scored(spark, sf))
    is_class = F.col("class").cast("string").rlike("^[0-9]+$")
    return out.withColumns(
        {c: F.when(is_class, F.col(c)).otherwise(F.round(c, 9)) for c in ("precision", "recall", "f1")}
    )


@query("split_metrics", _sql(f"""
SELECT split, n, accuracy, round(f1_macro, 9) AS f1_macro, round(f1_weighted, 9) AS f1_weighted, top3_accuracy,
       (SELECT max(accuracy) FILTER (split = 'train') - max(accuracy) FILTER (split = 'test')
        FROM summary WHERE model = 'first') AS train_test_gap
FROM summary JOIN (
  SELECT split, avg(CASE WHEN {TOP3} THEN 1 ELSE 0 END) AS top3_accuracy FROM scored GROUP BY 1) t USING (split)
WHERE model = 'first'"""))
def _(spark, sf):
    out = ev.split_metrics(scored(spark, sf), "logits")
    return out.withColumns({c: F.round(c, 9) for c in ("f1_macro", "f1_weighted")})


@query("overfitting_score", with_sql(HISTORY_SQL, select="""
SELECT model, round(avg(val_loss - train_loss), 9) AS overfitting FROM (
  SELECT * FROM hist QUALIFY row_number() OVER (PARTITION BY model ORDER BY epoch DESC) <= 5) GROUP BY 1"""))
def _(spark, sf):
    return rounded(ev.overfitting_score(b.history(spark, sf)), 9)


@query("loss_gap_series", with_sql(HISTORY_SQL, select="""
SELECT model, epoch, val_loss - train_loss AS loss_gap FROM hist"""))
def _(spark, sf):
    return ev.loss_gaps(b.history(spark, sf))


@query("early_stop_epoch", with_sql(HISTORY_SQL, f"""
flags AS (
  SELECT model, epoch, val_loss, coalesce(val_loss < min(val_loss) OVER (
    PARTITION BY model ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved
  FROM hist WHERE phase = 2),
runs AS (
  SELECT *, row_number() OVER (PARTITION BY model, island ORDER BY epoch) - 1 AS run FROM (
    SELECT *, sum(CAST(improved AS INT)) OVER (PARTITION BY model ORDER BY epoch) AS island FROM flags)),
stops AS (
  SELECT model, coalesce(min(epoch) FILTER (run >= {PATIENCE}), max(epoch)) AS stop_epoch FROM runs GROUP BY 1)
""", select="""
SELECT model, stop_epoch, max(epoch) AS best_epoch, arg_max(val_loss, epoch) AS best_val_loss
FROM runs JOIN stops USING (model) WHERE improved AND epoch <= stop_epoch GROUP BY 1, 2"""))
def _(spark, sf):
    return ev.early_stop(b.history(spark, sf), PATIENCE)


@query("model_comparison_table", _sql("""
SELECT metric, round(max(v) FILTER (model = 'first'), 9) AS first, round(max(v) FILTER (model = 'second'), 9) AS second,
       (SELECT arg_min(model, (-accuracy, model)) FROM summary WHERE split IS NULL) AS best_model
FROM (SELECT model, 'accuracy' AS metric, accuracy AS v FROM summary WHERE split IS NULL
      UNION ALL SELECT model, 'f1_macro', f1_macro FROM summary WHERE split IS NULL
      UNION ALL SELECT model, 'f1_weighted', f1_weighted FROM summary WHERE split IS NULL) GROUP BY metric"""))
def _(spark, sf):
    return rounded(ev.comparison_table(both_models(spark, sf), ["first", "second"]), 9)


@query("paired_model_correctness", _sql("""
SELECT count(*) AS n, CAST(sum(a) AS BIGINT) AS first_correct, CAST(sum(b) AS BIGINT) AS second_correct,
       CAST(sum(a * b) AS BIGINT) AS both_right, CAST(sum((1 - a) * (1 - b)) AS BIGINT) AS both_wrong,
       CAST(sum(CAST(s AS INT)) AS BIGINT) AS same_answer
FROM (SELECT CAST(x.pred = x.label AS INT) AS a, CAST(y.pred = x.label AS INT) AS b, x.pred = y.pred AS s
      FROM scored x JOIN scored2 y USING (row_id))"""))
def _(spark, sf):
    return ev.agreement(ev.paired_correctness(scored(spark, sf), b.second_model(spark, sf)))


@query("accuracy_at_threshold", with_sql(TX_SQL, REVPRED_SQL, select="""
SELECT avg(CASE WHEN (b / (b + 200000) > 0.5) = (y > 0) THEN 1 ELSE 0 END) AS accuracy FROM revpred"""))
def _(spark, sf):
    rows = b.revenue_predictions(spark, sf).withColumn("prob", F.col("b") / (F.col("b") + 200000))
    return ev.accuracy_at_threshold(rows, "prob", F.col("y") > 0)


@query("model_gain_table", _sql("""
SELECT model, train, test, train - test AS gap, test - (
  SELECT accuracy FROM summary WHERE model = 'second' AND split = 'test') AS gain
FROM (SELECT model, max(accuracy) FILTER (split = 'train') AS train, max(accuracy) FILTER (split = 'test') AS test
      FROM summary GROUP BY 1)"""))
def _(spark, sf):
    return ev.gain_table(both_models(spark, sf), "second")


@query("mae_by_segment", with_sql(TX_SQL, REVPRED_SQL, """
err AS (SELECT CAST(abs(y - a) AS DECIMAL(28,6)) AS e, y FROM revpred)""", select="""
SELECT 'all' AS segment, count(*) AS n, CAST(sum(e) AS DOUBLE) / count(*) AS mae FROM err
UNION ALL SELECT 'zeros', count(*), CAST(sum(e) AS DOUBLE) / count(*) FROM err WHERE y = 0
UNION ALL SELECT 'nonzeros', count(*), CAST(sum(e) AS DOUBLE) / count(*) FROM err WHERE y <> 0"""))
def _(spark, sf):
    return ev.mae_by_segment(b.revenue_predictions(spark, sf), "y", "a")


RANKS_SQL = """
long AS (
  SELECT 'all' AS segment, model, y, p FROM (UNPIVOT (SELECT y, a, b, c FROM revpred) ON a, b, c INTO NAME model VALUE p)
  UNION ALL SELECT 'nonzeros', model, y, p
  FROM (UNPIVOT (SELECT y, a, b, c FROM revpred WHERE y > 0) ON a, b, c INTO NAME model VALUE p)),
ranked AS (
  SELECT segment, model,
    rank() OVER (PARTITION BY segment, model ORDER BY y) + (count(*) OVER (PARTITION BY segment, model, y) - 1) / 2.0 AS ry,
    rank() OVER (PARTITION BY segment, model ORDER BY p) + (count(*) OVER (PARTITION BY segment, model, p) - 1) / 2.0 AS rp
  FROM long)
"""


@query("spearman", with_sql(TX_SQL, REVPRED_SQL, RANKS_SQL, select="""
SELECT segment, model, count(*) AS n, round(corr(ry::DOUBLE, rp::DOUBLE), 9) AS rho FROM ranked GROUP BY 1, 2"""))
def _(spark, sf):
    """Each model against the target, on all rows and on the rows with spend."""
    wide = b.revenue_predictions(spark, sf).select("y", "a", "b", "c")
    long = wide.unpivot(["y"], ["a", "b", "c"], "model", "p")
    segments = F.explode(
        F.when(F.col("y") > 0, F.array(F.lit("all"), F.lit("nonzeros"))).otherwise(F.array(F.lit("all")))
    )
    return rounded(ev.spearman(long.select("*", segments.alias("segment")), "y", "p", ["segment", "model"]), 9)


GRID_SQL = """
blend AS (
  SELECT id, y, i AS ia, j AS ib, i / 20.0::DOUBLE * a + j / 20.0::DOUBLE * b + (20 - i - j) / 20.0::DOUBLE * c AS blend
  FROM revpred, range(0, 21) g(i), range(0, 21) h(j) WHERE i + j <= 20)
"""


@query("weight_grid_cross", with_sql(TX_SQL, REVPRED_SQL, GRID_SQL, select="""
SELECT CAST(ia AS INT) AS ia, CAST(ib AS INT) AS ib, count(*) AS n, min(blend) AS lowest, max(blend) AS highest
FROM blend GROUP BY 1, 2"""))
def _(spark, sf):
    rows = ev.blends(b.revenue_predictions(spark, sf), "a", "b", "c", ["id"])
    return rows.groupBy("ia", "ib").agg(
        F.count(F.lit(1)).alias("n"), F.min("blend").alias("lowest"), F.max("blend").alias("highest")
    )


@query("ensemble_weight_search", with_sql(TX_SQL, REVPRED_SQL, GRID_SQL, """
r AS (
  SELECT ia, ib,
    rank() OVER (PARTITION BY ia, ib ORDER BY y) + (count(*) OVER (PARTITION BY ia, ib, y) - 1) / 2.0 AS ry,
    rank() OVER (PARTITION BY ia, ib ORDER BY blend) + (count(*) OVER (PARTITION BY ia, ib, blend) - 1) / 2.0 AS rp
  FROM blend),
rhos AS (SELECT ia, ib, round(corr(ry::DOUBLE, rp::DOUBLE), 9) AS rho FROM r GROUP BY 1, 2)
""", select="""
SELECT ia / 20.0::DOUBLE AS wa, ib / 20.0::DOUBLE AS wb, (20 - ia - ib) / 20.0::DOUBLE AS wc, rho,
       row_number() OVER (ORDER BY rho DESC NULLS LAST, ia, ib) = 1 AS is_best FROM rhos"""))
def _(spark, sf):
    return ev.ensemble_search(b.revenue_predictions(spark, sf), "y", "a", "b", "c")
