"""Queries of the sampling and encoding family."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.scalars import rounded
from tallyloom.operators import sampling as sa
from tallyloom.plans.customer import TOP_SQL, encoding_input
from tallyloom.plans.profiling import key_sql
from tallyloom.plans.registry import query, with_sql
from tallyloom.session import written
from tallyloom.sources import bindings as b
from tallyloom.sources.bindings import IMAGE_SQL, PROFILE_SQL, TX_SQL

WEIGHTS = {"train": 0.70, "val": 0.15, "test": 0.15}
KEYS = ["top_brand", "top_brand_y2", "top_cat", "top_fine_cat", "cohort_q"]


def draw_sql(column: str, seed: int) -> str:
    return f"CAST('0x' || substr(md5(CAST({column} AS VARCHAR) || '#{seed}'), 1, 15) AS BIGINT)"


@query("stratified_split_70_15_15", with_sql(PROFILE_SQL, f"""
r AS (
  SELECT item_id, category, count(*) OVER (PARTITION BY category) AS n,
         row_number() OVER (PARTITION BY category ORDER BY {key_sql('item_id', 42)}, item_id) AS rn FROM minifig)
""", select="""
SELECT item_id, category, CASE WHEN rn <= round(n * 0.70::DOUBLE) THEN 'train'
       WHEN rn <= round(n * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r"""))
def _(spark, sf):
    items = b.minifigs(spark, sf).select("item_id", "category")
    return sa.stratified_split(items, "category", "item_id", WEIGHTS, sa.arithmetic("item_id", 42))


@query("stratified_holdout_80_20", with_sql(TX_SQL, f"""
r AS (
  SELECT cust_id, revenue_label > 0 AS spends, count(*) OVER (PARTITION BY revenue_label > 0) AS n,
         row_number() OVER (PARTITION BY revenue_label > 0 ORDER BY {key_sql('cust_id', 42)}, cust_id) AS rn FROM labels_clv)
""", select="""
SELECT cust_id, spends, CASE WHEN rn <= round(n * 0.80::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM r"""))
def _(spark, sf):
    rows = b.revenue_labels(spark, sf).select("cust_id", (F.col("revenue_label") > 0).alias("spends"))
    return sa.stratified_split(rows, "spends", "cust_id", {"train": 0.8, "val": 0.2}, sa.arithmetic("cust_id", 42))


FOLD_SQL = f"""
folds AS (
  SELECT c_custkey AS cust_id,
         CAST((row_number() OVER (ORDER BY {key_sql('c_custkey', 7)}, c_custkey) - 1) % 5 AS INT) AS fold FROM customer)
"""


@query("kfold_assign", with_sql(FOLD_SQL, select="SELECT * FROM folds"))
def _(spark, sf):
    rows = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("cust_id"))
    return sa.kfold(rows, "cust_id", 5, sa.arithmetic("cust_id", 7))


@query("sample_n_per_group", with_sql(PROFILE_SQL, select=f"""
SELECT item_id, category FROM minifig
QUALIFY row_number() OVER (PARTITION BY category ORDER BY {key_sql('item_id', 42)}, item_id) <= 20"""))
def _(spark, sf):
    items = b.minifigs(spark, sf).select("item_id", "category")
    return sa.sample_per_group(items, "category", "item_id", 20, sa.arithmetic("item_id", 42))


@query("sample_n_total", with_sql(IMAGE_SQL, select=f"""
SELECT vec_id, category FROM img ORDER BY {key_sql('vec_id', 42)}, vec_id LIMIT 200"""))
def _(spark, sf):
    rows = b.images(spark, sf).select("vec_id", "category")
    return sa.sample_total(rows, "vec_id", 200, sa.arithmetic("vec_id", 42))


@query("class_counts_weights", with_sql(PROFILE_SQL, select="""
SELECT item_id, category, 1.0::DOUBLE / count(*) OVER (PARTITION BY category) AS weight FROM minifig"""))
def _(spark, sf):
    return sa.class_weights(b.minifigs(spark, sf).select("item_id", "category"), "category")


@query("weighted_resample", with_sql(PROFILE_SQL, f"""
item AS (
  SELECT item_id, category, count(*) OVER (PARTITION BY category) AS n,
         row_number() OVER (PARTITION BY category ORDER BY {key_sql('item_id', 1)}, item_id) AS rn FROM minifig),
cls AS (
  SELECT category, any_value(n) AS n, row_number() OVER (ORDER BY category) - 1 AS c, count(*) OVER () AS k
  FROM item GROUP BY 1)
""", select=f"""
SELECT d.item_id AS draw_id, cls.category, i.item_id
FROM minifig d JOIN cls ON {draw_sql('d.item_id', 2)} % k = c
     JOIN item i ON i.category = cls.category AND i.rn = {draw_sql('d.item_id', 3)} % cls.n + 1"""))
def _(spark, sf):
    items = b.minifigs(spark, sf).select("item_id", "category")
    order = sa.arithmetic("item_id", 1)
    return sa.balanced_resample(
        items, "category", "item_id", sa.draw("item_id", 2), sa.draw("item_id", 3), order
    )


ENC_SQL = """
enc AS (
  SELECT cust_id, part, ln(1 + greatest(revenue_label, 0)) AS y_log, top_brand, top_brand_y2, top_cat,
         top_fine_cat, cohort_q, fold
  FROM labels_clv LEFT JOIN topv USING (cust_id) LEFT JOIN cohort USING (cust_id) JOIN folds USING (cust_id)),
d AS (SELECT *, CAST(y_log AS DECIMAL(28,12)) AS yd FROM enc),
g AS (SELECT CAST(sum(yd) AS DOUBLE) / count(*) AS mean FROM d),
gt AS (SELECT CAST(sum(yd) AS DOUBLE) / count(*) AS mean FROM d WHERE part = 'train')
"""


def _oof(key: str) -> str:
    return (
        f"round(coalesce((SELECT CAST(sum(o.yd) AS DOUBLE) / count(*) FROM d o"
        f" WHERE o.{key} = d.{key} AND o.fold <> d.fold), g.mean), 6) AS te_{key}"
    )


def _full(key: str) -> str:
    return (
        f"round(coalesce((SELECT CAST(sum(o.yd) AS DOUBLE) / count(*) FROM d o"
        f" WHERE o.{key} = d.{key} AND o.part = 'train'), gt.mean), 6) AS te_{key}"
    )


@query("oof_target_encode", with_sql(TOP_SQL, FOLD_SQL, ENC_SQL, select=f"""
SELECT cust_id, fold, {', '.join(_oof(k) for k in KEYS)} FROM d, g"""))
def _(spark, sf):
    keyed = encoding_input(spark, sf)
    folded = written(sa.kfold(keyed, "cust_id", 5, sa.arithmetic("cust_id", 7)), "encoding")
    out = sa.encode_out_of_fold(folded, "cust_id", KEYS, "y_log")
    return rounded(out.select("cust_id", "fold", *[f"te_{k}" for k in KEYS]))


@query("full_target_encode", with_sql(TOP_SQL, FOLD_SQL, ENC_SQL, select=f"""
SELECT cust_id, part, {', '.join(_full(k) for k in KEYS)} FROM d, gt"""))
def _(spark, sf):
    """Means over the training part, applied to every customer."""
    parts = b.revenue_labels(spark, sf).select("cust_id", "part")
    rows = written(encoding_input(spark, sf).join(parts, "cust_id"), "encoding")
    out = sa.encode_full(rows.where(F.col("part") == "train"), rows, "cust_id", KEYS, "y_log")
    return rounded(out.select("cust_id", "part", *[f"te_{k}" for k in KEYS]))
