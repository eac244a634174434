"""Queries of the customer-value family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.scalars import flag, ratio, rounded
from tallyloom.operators import customer as cv
from tallyloom.operators.ordering import average_rank, selected_quantiles
from tallyloom.plans.registry import query, with_sql
from tallyloom.session import dealt, written
from tallyloom.sources import bindings as b
from tallyloom.sources.bindings import TX_SQL, YEAR1, YEAR2

YEARS = (YEAR1, YEAR2)


# Logarithms and deviations may differ in the last bit between engines; the rest is plain
# arithmetic on exact sums and is compared unrounded.
INEXACT = {
    "std_order_val", "std_ipt", "std_order_month", "brand_entropy", "monetary_log", "frequency_log",
    "rev_y2_log", "rev_last90d_log", "rev_last180d_log", "freq_x_monetary_log", "log_recency_ipt",
    "rev_y2_q4_log",
}


def _digits(column: str) -> int:
    """Six digits, but three for the deviation of amounts, whose last digits depend on the order
    in which partial results are merged."""
    return 3 if column == "std_order_val" else 6


def _r(*columns: str) -> str:
    """Select list; + 0.0 turns a negative zero of the rounding into zero."""
    return ", ".join(f"round({c}, {_digits(c)}) + 0.0 AS {c}" if c in INEXACT else c for c in columns)


def _per_period(name: str, inside: str) -> str:
    return f"""
    coalesce(CAST(sum(order_revenue) FILTER ({inside}) AS DOUBLE), 0.0) AS revenue_{name},
    CAST(count(DISTINCT sale_id) FILTER ({inside}) AS BIGINT) AS orders_{name},
    coalesce(CAST(sum(order_revenue) FILTER ({inside}) AS DOUBLE)
      / nullif(count(*) FILTER ({inside}), 0), 0.0) AS avg_val_{name},
    CAST(coalesce(sum(has_return) FILTER ({inside}), 0) AS BIGINT) AS returns_{name},
    CAST(coalesce(sum(n_items) FILTER ({inside}), 0) AS BIGINT) AS items_{name}"""


_PERIODS = ",".join(
    [_per_period("y1", f"order_year = {YEAR1}"), _per_period("y2", f"order_year = {YEAR2}")]
    + [_per_period(f"last{n}d", f"order_date >= ref.d - {n}") for n in cv.LOOKBACKS]
    + [
        f"""coalesce(CAST(sum(order_revenue) FILTER (order_year = {YEAR2} AND quarter(order_date) = {q}) AS DOUBLE), 0.0) AS rev_y2_q{q},
    CAST(count(DISTINCT sale_id) FILTER (order_year = {YEAR2} AND quarter(order_date) = {q}) AS BIGINT) AS orders_y2_q{q}"""
        for q in (1, 2, 3, 4)
    ]
)

_PIVOTS = ",\n".join(
    f"coalesce(max(CASE WHEN kind = '{kind}' AND value = '{v}' THEN share END),"
    f" max(CASE WHEN kind = '{kind}' THEN 0.0 END)) AS {prefix}_{v.lower()}"
    for kind, prefix, values in (("category", "cat", b.CATEGORIES), ("season", "season", b.SEASONS))
    for v in values
)

ORD_SQL = f"""
{TX_SQL.strip()},
ref AS (SELECT max(order_date) + 1 AS d FROM lines),
ord AS (
  SELECT cust_id, sale_id, order_date, sum(sale_revenue) AS order_revenue,
         sum(sale_discount) AS order_discount, count(prod_id) AS n_items,
         max(CASE WHEN returned_to IS NOT NULL THEN 1 ELSE 0 END) AS has_return,
         CAST(year(order_date) AS INT) AS order_year
  FROM lines GROUP BY 1, 2, 3)
"""

FEAT_SQL = f"""
{ORD_SQL.strip()},
wide AS (
  SELECT cust_id, CAST(any_value(ref.d) - max(order_date) AS INT) AS recency,
    count(DISTINCT sale_id) AS frequency, CAST(sum(order_revenue) AS DOUBLE) AS monetary,
    CAST(sum(order_revenue) AS DOUBLE) / count(*) AS avg_order_val,
    median(CAST(order_revenue AS DOUBLE)) AS median_order_val,
    CAST(max(order_revenue) AS DOUBLE) AS max_order_val,
    stddev_samp(CAST(order_revenue AS DOUBLE)) AS std_order_val,
    CAST(sum(n_items) AS BIGINT) AS total_items,
    CAST(sum(n_items) AS DOUBLE) / count(*) AS avg_items_per_order,
    CAST(any_value(ref.d) - min(order_date) AS INT) AS first_purchase_days,
    CAST(max(order_date) - min(order_date) AS INT) AS purchase_span_days,
    count(DISTINCT date_trunc('month', order_date)) AS n_active_months,
    CAST(sum(order_discount) AS DOUBLE) AS total_discount,
    CAST(sum(order_discount) AS DOUBLE) / count(*) AS avg_discount,
    CAST(min(order_discount) AS DOUBLE) AS max_discount,
    CAST(sum(has_return) AS DOUBLE) / count(*) AS return_rate,
    CAST(sum(has_return) AS BIGINT) AS n_returns,
    CAST(sum(order_discount) AS DOUBLE) / nullif(sum(n_items), 0) AS discount_per_item,
    {_PERIODS}
  FROM ord, ref GROUP BY cust_id),
gap AS (
  SELECT cust_id, sale_id, order_date, CAST(order_date - lag(order_date) OVER (
           PARTITION BY cust_id ORDER BY order_date, sale_id) AS INT) AS gap_days FROM ord
  QUALIFY gap_days IS NOT NULL),
gaps AS (
  SELECT cust_id, avg(gap_days) AS avg_ipt, stddev_samp(gap_days) AS std_ipt,
         CAST(min(gap_days) AS BIGINT) AS min_ipt, CAST(max(gap_days) AS BIGINT) AS max_ipt
  FROM gap GROUP BY 1),
items AS (
  SELECT cust_id, avg(web_only) AS web_only_rate, avg(outlet) AS outlet_rate,
    count(DISTINCT brand) AS n_unique_brands, count(DISTINCT prod_id) AS n_unique_products,
    count(DISTINCT size) AS n_unique_sizes, count(DISTINCT color) AS n_unique_colors,
    avg(isodow(order_date) - 1) AS avg_order_weekday,
    stddev_samp(month(order_date)) AS std_order_month, avg(month(order_date)) AS avg_order_month,
    avg(CASE WHEN month(order_date) >= 10 THEN 1 ELSE 0 END) AS share_q4,
    CAST(sum(sale_revenue) AS DOUBLE) / count(*) AS avg_item_price
  FROM tx GROUP BY 1),
share AS (
  SELECT cust_id, kind, value, n, n / sum(n) OVER (PARTITION BY cust_id, kind) AS share FROM (
    SELECT cust_id, kind, value, count(*) AS n FROM (
      SELECT cust_id, 'brand' AS kind, brand AS value FROM tx
      UNION ALL SELECT cust_id, 'category', category FROM tx
      UNION ALL SELECT cust_id, 'season', season FROM tx) WHERE value IS NOT NULL GROUP BY 1, 2, 3)),
pivoted AS (
  SELECT cust_id, -sum(CASE WHEN kind = 'brand' THEN share * ln(share + 1e-12) END) AS brand_entropy,
         max(CASE WHEN kind = 'brand' THEN share END) AS top_brand_share, {_PIVOTS}
  FROM share GROUP BY 1),
base AS (
  SELECT wide.*, gaps.* EXCLUDE (cust_id), items.* EXCLUDE (cust_id), pivoted.* EXCLUDE (cust_id),
         wide.recency / (gaps.avg_ipt + 1) AS recency_ipt_ratio
  FROM wide LEFT JOIN gaps USING (cust_id) LEFT JOIN items USING (cust_id)
       LEFT JOIN pivoted USING (cust_id)),
feat AS (
  SELECT *,
    (revenue_y2 - revenue_y1) / (abs(revenue_y1) + 1) AS revenue_growth,
    (orders_y2 - orders_y1) / (orders_y1 + 1) AS orders_growth,
    CAST(orders_y2 > 0 AS INT) AS active_in_y2, CAST(orders_y1 > 0 AS INT) AS active_in_y1,
    revenue_y2 / (abs(monetary) + 1) AS share_rev_y2,
    rev_y2_q3 + rev_y2_q4 AS rev_y2_h2, rev_y2_q1 + rev_y2_q2 AS rev_y2_h1,
    (rev_y2_q3 + rev_y2_q4) / (rev_y2_q1 + rev_y2_q2 + 1) AS rev_y2_h2h1_ratio,
    orders_y2_q3 + orders_y2_q4 AS orders_y2_h2, CAST(orders_y2_q4 > 0 AS INT) AS active_q4_y2,
    ln(1 + greatest(monetary, 0)) AS monetary_log, ln(1 + frequency) AS frequency_log,
    ln(1 + greatest(revenue_y2, 0)) AS rev_y2_log,
    ln(1 + greatest(revenue_last90d, 0)) AS rev_last90d_log,
    ln(1 + greatest(revenue_last180d, 0)) AS rev_last180d_log,
    frequency / (first_purchase_days / 30.0::DOUBLE + 1) AS purchase_rate_monthly,
    monetary / (first_purchase_days / 30.0::DOUBLE + 1) AS revenue_rate_monthly,
    revenue_last90d / (orders_last90d + 1) AS rev_per_recent_order,
    frequency / (recency + 1) AS freq_x_recency_inv,
    ln(1 + frequency) * ln(1 + greatest(monetary, 0)) AS freq_x_monetary_log,
    revenue_y2 / (orders_y2 + 1) AS rev_y2_per_order, revenue_y2 / 12 AS rev_y2_per_month,
    revenue_last90d / (abs(monetary) + 1) AS rev_last90d_share,
    revenue_last180d / (abs(monetary) + 1) AS rev_last180d_share,
    revenue_last365d / (abs(monetary) + 1) AS rev_last365d_share,
    abs(total_discount) / (abs(monetary) + 1) AS discount_rate,
    frequency / (n_unique_brands + 1) AS orders_per_brand,
    ln(1 + CASE WHEN recency_ipt_ratio IS NOT NULL THEN greatest(recency_ipt_ratio, 0) END) AS log_recency_ipt,
    CASE WHEN recency_ipt_ratio IS NOT NULL THEN greatest(recency_ipt_ratio, 0) END
      * CASE WHEN recency_ipt_ratio IS NOT NULL THEN greatest(recency_ipt_ratio, 0) END AS ript_sq,
    CAST(coalesce(recency_ipt_ratio >= 1, false) AS INT) AS skipped_1_cycle,
    CAST(coalesce(recency_ipt_ratio >= 2, false) AS INT) AS skipped_2_cycle,
    CAST(coalesce(recency_ipt_ratio >= 3, false) AS INT) AS skipped_3_cycle,
    ln(1 + greatest(rev_y2_q4, 0)) AS rev_y2_q4_log, rev_y2_q4 / (rev_y2_q3 + 1) AS q4_to_q3_rev_ratio,
    orders_last90d / (90.0::DOUBLE / (avg_ipt + 1) + 0.01::DOUBLE) AS recent_vs_expected,
    max_order_val * frequency / (recency + 1) AS max_val_x_freq_inv_rec,
    frequency / (n_active_months + 1) AS freq_per_active_month
  FROM base)
"""

G_RFM = (["monetary", "avg_order_val", "median_order_val", "max_order_val", "std_order_val", "avg_items_per_order"],
         ["recency", "frequency", "total_items"])
G_TENURE = ([], ["first_purchase_days", "purchase_span_days", "n_active_months"])
G_GAPS = (["avg_ipt", "std_ipt"], ["min_ipt", "max_ipt"])
G_YEARS = (["revenue_y1", "avg_val_y1", "revenue_y2", "avg_val_y2"],
           ["orders_y1", "orders_y2", "returns_y1", "returns_y2"])
G_QUARTERS = ([f"rev_y2_q{q}" for q in (1, 2, 3, 4)], [f"orders_y2_q{q}" for q in (1, 2, 3, 4)])
G_LOOKBACK = ([f"{m}_last{n}d" for n in cv.LOOKBACKS for m in ("revenue", "avg_val")],
              [f"{m}_last{n}d" for n in cv.LOOKBACKS for m in ("orders", "items")])
G_DISCOUNT = (["total_discount", "avg_discount", "max_discount", "return_rate", "discount_per_item"], ["n_returns"])
G_PREFS = (["web_only_rate", "outlet_rate", "avg_order_weekday", "std_order_month", "avg_order_month", "share_q4"],
           ["n_unique_brands", "n_unique_products", "n_unique_sizes", "n_unique_colors"])
G_BRAND = (["brand_entropy", "top_brand_share"], [])
G_PRICE = (["avg_item_price"], [])
G_PIVOT = ([f"cat_{v.lower()}" for v in b.CATEGORIES] + [f"season_{v.lower()}" for v in b.SEASONS], [])
F_GROWTH = (["revenue_growth", "orders_growth", "share_rev_y2", "rev_y2_h2", "rev_y2_h1", "rev_y2_h2h1_ratio"],
            ["active_in_y2", "active_in_y1", "orders_y2_h2", "active_q4_y2"])
F_VELOCITY = (["monetary_log", "frequency_log", "rev_y2_log", "rev_last90d_log", "rev_last180d_log",
               "purchase_rate_monthly", "revenue_rate_monthly", "rev_per_recent_order",
               "freq_x_recency_inv", "freq_x_monetary_log"], [])
F_INTENSITY = (["rev_y2_per_order", "rev_y2_per_month", "recency_ipt_ratio", "rev_last90d_share",
                "rev_last180d_share", "rev_last365d_share", "discount_rate", "orders_per_brand"], [])
F_CYCLE = (["log_recency_ipt", "ript_sq", "rev_y2_q4_log", "q4_to_q3_rev_ratio", "recent_vs_expected",
            "max_val_x_freq_inv_rec", "freq_per_active_month"],
           ["skipped_1_cycle", "skipped_2_cycle", "skipped_3_cycle"])

FIXED_GROUPS = [G_RFM, G_TENURE, G_GAPS, G_YEARS, G_QUARTERS, G_LOOKBACK, G_DISCOUNT, G_PREFS, G_BRAND,
                G_PRICE, F_GROWTH, F_VELOCITY, F_INTENSITY, F_CYCLE]
FIXED_COLUMNS = [c for doubles, whole in FIXED_GROUPS for c in doubles + whole]


def _features_sql(*groups, source: str = "feat", ctes: str = FEAT_SQL) -> str:
    parts = ["cust_id"]
    for doubles, whole in groups:
        parts += [_r(c) for c in doubles] + list(whole)
    return with_sql(ctes, select=f"SELECT {', '.join(parts)} FROM {source}")


def _pick(df: DataFrame, *groups) -> DataFrame:
    columns = [c for doubles, whole in groups for c in doubles + whole]
    return df.select(
        "cust_id", *[F.round(c, _digits(c)).alias(c) if c in INEXACT else F.col(c) for c in columns]
    )


def orders_of(spark: SparkSession, sf: str) -> DataFrame:
    return cv.order_rollup(b.order_lines(spark, sf))


def kept_orders(spark: SparkSession, sf: str):
    """The order table, written once for plans that scan it in several branches, and the
    reference date taken from it."""
    orders = written(orders_of(spark, sf), "orders")
    return orders, cv.as_of(orders)


#: What the item features read of a transaction; order features need the sale, the date and the amounts too.
ITEM_COLUMNS = [
    "cust_id", "prod_id", "order_date", "sale_revenue", "web_only", "outlet", "brand", "size", "color", "category", "season",
]


def kept_transactions(spark: SparkSession, sf: str, columns=None) -> DataFrame:
    """The flat transaction table with the columns a plan needs, joined and written once for plans with several item
    branches: each branch then scans its own columns instead of repeating two fact-sized joins."""
    return written(b.transactions(spark, sf).select(*(columns or ["*"])), "transactions")


def dealt_lines(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """What features read of the item rows of known customers, and further columns, written and dealt by customer: nothing that is
    computed per customer moves items again. Items of unknown products are in it too, with ``listed`` null."""
    lines = b.transactions(spark, sf, every=True).where(F.col("cust_id").isNotNull())
    return dealt(lines.select(*ITEM_COLUMNS, "sale_id", "sale_discount", "returned_to", "listed", *columns), "lines", "cust_id")


def features(spark: SparkSession, sf: str, lines: DataFrame | None = None) -> DataFrame:
    """The whole feature matrix over the transaction and order tables, dealt by customer; ``lines`` may give the items."""
    tx = (dealt_lines(spark, sf) if lines is None else lines).where("listed")
    orders = dealt(cv.order_rollup(tx), "orders", "cust_id")
    return cv.feature_matrix(tx, orders, cv.as_of(orders), YEARS, b.CATEGORIES, b.SEASONS, dealt=True)


# --- preparation ------------------------------------------------------------------------------


@query("derive_tx_columns", with_sql(TX_SQL, select="""
SELECT cust_id, sale_id, prod_id, order_date, CASE WHEN returned_to IS NOT NULL THEN 1 ELSE 0 END AS is_returned,
       CAST(year(order_date) AS INT) AS order_year, CAST(month(order_date) AS INT) AS order_month,
       CAST(isodow(order_date) - 1 AS INT) AS order_weekday FROM lines"""))
def _(spark, sf):
    cols = ["cust_id", "sale_id", "prod_id", "order_date"]
    derived = ["is_returned", "order_year", "order_month", "order_weekday"]
    return cv.derive_columns(b.order_lines(spark, sf)).select(*cols, *derived)


@query("filter_year", with_sql(TX_SQL, select=f"""
SELECT cust_id, sale_id, order_date, CAST(sale_revenue AS DOUBLE) AS sale_revenue
FROM lines WHERE year(order_date) = {YEAR2}"""))
def _(spark, sf):
    return cv.filter_period(b.order_lines(spark, sf), YEAR2).select(
        "cust_id", "sale_id", "order_date", F.col("sale_revenue").cast("double").alias("sale_revenue")
    )


@query("filter_year_quarter", with_sql(TX_SQL, select=f"""
SELECT cust_id, sale_id, order_date, CAST(sale_revenue AS DOUBLE) AS sale_revenue
FROM lines WHERE year(order_date) = {YEAR2} AND quarter(order_date) = 4"""))
def _(spark, sf):
    return cv.filter_period(b.order_lines(spark, sf), YEAR2, 4).select(
        "cust_id", "sale_id", "order_date", F.col("sale_revenue").cast("double").alias("sale_revenue")
    )


@query("filter_since_cutoff", with_sql(ORD_SQL, select="""
SELECT cust_id, sale_id, order_date, CAST(order_revenue AS DOUBLE) AS order_revenue
FROM ord, ref WHERE order_date >= ref.d - 180"""))
def _(spark, sf):
    orders = orders_of(spark, sf)
    return cv.filter_since(orders, cv.as_of(b.order_lines(spark, sf)), 180).select(
        "cust_id", "sale_id", "order_date", F.col("order_revenue").cast("double").alias("order_revenue")
    )


@query("reference_date", with_sql(ORD_SQL, select="SELECT d AS reference_date FROM ref"))
def _(spark, sf):
    return cv.reference_date(b.order_lines(spark, sf))


# --- aggregates -------------------------------------------------------------------------------


@query("order_rollup", with_sql(ORD_SQL, select="""
SELECT cust_id, sale_id, order_date, CAST(order_revenue AS DOUBLE) AS order_revenue,
       CAST(order_discount AS DOUBLE) AS order_discount, n_items, has_return, order_year FROM ord"""))
def _(spark, sf):
    return orders_of(spark, sf).withColumns(
        {c: F.col(c).cast("double") for c in ("order_revenue", "order_discount")}
    )


@query("rfm_core", _features_sql(G_RFM, source="wide"))
def _(spark, sf):
    orders, ref = kept_orders(spark, sf)
    out = (
        cv.customer_aggregate(orders, cv.rfm_aggregates(ref))
        .join(cv.distinct_orders(orders, ref), "cust_id")
        .join(cv.median_order_value(orders), "cust_id", "left")
    )
    return _pick(out, G_RFM)


@query("tenure_features", _features_sql(G_TENURE, source="wide"))
def _(spark, sf):
    orders, ref = kept_orders(spark, sf)
    out = cv.customer_aggregate(orders, cv.tenure_aggregates(ref)).join(cv.gap_statistics(orders), "cust_id")
    return _pick(out, G_TENURE)


@query("interpurchase_stats", _features_sql(G_GAPS, source="gaps"))
def _(spark, sf):
    return _pick(cv.gap_statistics(orders_of(spark, sf)).where(F.col("avg_ipt").isNotNull()), G_GAPS)


@query("yearly_split", _features_sql(G_YEARS, source="wide"))
def _(spark, sf):
    orders, ref = kept_orders(spark, sf)
    out = cv.customer_aggregate(orders, cv.yearly_aggregates(YEARS)).join(
        cv.distinct_orders(orders, ref, YEARS), "cust_id"
    )
    return _pick(out, G_YEARS)


@query("quarterly_split", _features_sql(G_QUARTERS, source="wide"))
def _(spark, sf):
    orders, ref = kept_orders(spark, sf)
    out = cv.customer_aggregate(orders, cv.quarterly_aggregates(YEAR2)).join(
        cv.distinct_orders(orders, ref, quarters_of=YEAR2), "cust_id"
    )
    return _pick(out, G_QUARTERS)


@query("recency_windows", _features_sql(G_LOOKBACK, source="wide"))
def _(spark, sf):
    orders, ref = kept_orders(spark, sf)
    out = cv.customer_aggregate(orders, cv.lookback_aggregates(ref)).join(
        cv.distinct_orders(orders, ref, days=cv.LOOKBACKS), "cust_id"
    )
    return _pick(out, G_LOOKBACK)


@query("zero_fill", with_sql(FEAT_SQL, select=f"""
SELECT c_custkey AS cust_id, {', '.join(f'coalesce({c}, 0.0) AS {c}' for c in G_YEARS[0])},
       {', '.join(f'coalesce({c}, 0) AS {c}' for c in G_YEARS[1])}, monetary
FROM customer LEFT JOIN wide ON c_custkey = cust_id"""))
def _(spark, sf):
    orders, ref = kept_orders(spark, sf)
    split = cv.customer_aggregate(orders, [*cv.yearly_aggregates(YEARS), *cv.rfm_aggregates(ref)])
    known = cv.merge_labels(b.revenue_labels(spark, sf).select("cust_id"), split).join(
        cv.distinct_orders(orders, ref, YEARS), "cust_id", "left"
    )
    return _pick(cv.zero_fill(known, G_YEARS[0] + G_YEARS[1]), G_YEARS, (["monetary"], []))


@query("discount_return_stats", _features_sql(G_DISCOUNT, source="wide"))
def _(spark, sf):
    return _pick(cv.customer_aggregate(orders_of(spark, sf), cv.discount_aggregates()), G_DISCOUNT)


@query("product_preferences", _features_sql(G_PREFS, source="items"))
def _(spark, sf):
    return _pick(cv.preferences(kept_transactions(spark, sf, ITEM_COLUMNS)), G_PREFS)


@query("group_share", with_sql(FEAT_SQL, select="""
SELECT cust_id, kind, value, n, round(share, 6) AS share FROM share"""))
def _(spark, sf):
    return rounded(cv.shares(b.transactions(spark, sf), ["brand", "category", "season"]))


@query("brand_entropy", _features_sql((["brand_entropy"], []), source="pivoted"))
def _(spark, sf):
    entropy = cv.brand_aggregates()[0]
    return rounded(cv.shares(b.transactions(spark, sf), ["brand"]).groupBy("cust_id").agg(entropy))


@query("top_share", _features_sql((["top_brand_share"], []), source="pivoted"))
def _(spark, sf):
    largest = cv.brand_aggregates()[1]
    return cv.shares(b.transactions(spark, sf), ["brand"]).groupBy("cust_id").agg(largest)


@query("share_pivot", _features_sql(G_PIVOT, source="pivoted"))
def _(spark, sf):
    long = cv.shares(b.transactions(spark, sf), ["category", "season"])
    out = long.groupBy("cust_id").agg(
        *cv.pivot_aggregates("category", b.CATEGORIES, "cat"),
        *cv.pivot_aggregates("season", b.SEASONS, "season"),
    )
    return _pick(out, G_PIVOT)


@query("avg_item_price", _features_sql(G_PRICE, source="items"))
def _(spark, sf):
    return cv.customer_aggregate(b.order_lines(spark, sf), [cv.item_price_aggregate()])


TOP_SQL = f"""
{TX_SQL.strip()},
topn AS (
  SELECT cust_id, kind, arg_min(value, (-n, value)) AS value FROM (
    SELECT cust_id, kind, value, count(*) AS n FROM (
      SELECT cust_id, 'brand' AS kind, brand AS value FROM tx
      UNION ALL SELECT cust_id, 'brand_y2', brand FROM tx WHERE year(order_date) = {YEAR2}
      UNION ALL SELECT cust_id, 'cat', category FROM tx
      UNION ALL SELECT cust_id, 'fine', coalesce(fine_category, 'unknown') FROM tx)
    WHERE value IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
topv AS (
  SELECT cust_id, max(value) FILTER (kind = 'brand') AS top_brand,
         max(value) FILTER (kind = 'brand_y2') AS top_brand_y2,
         max(value) FILTER (kind = 'cat') AS top_cat, max(value) FILTER (kind = 'fine') AS top_fine_cat
  FROM topn GROUP BY 1),
cohort AS (
  SELECT cust_id, CAST(year(min(order_date)) AS VARCHAR) || 'Q' || CAST(quarter(min(order_date)) AS VARCHAR) AS cohort_q
  FROM lines GROUP BY 1)
"""


@query("top_value_per_customer", with_sql(TOP_SQL, select="SELECT * FROM topv"))
def _(spark, sf):
    return cv.top_values(b.transactions(spark, sf), cv.encoding_keys(YEAR2))


@query("top1_per_group", with_sql(TOP_SQL, select="SELECT cust_id, top_fine_cat FROM topv"))
def _(spark, sf):
    return cv.top_values(
        b.transactions(spark, sf), {"top_fine_cat": cv.encoding_keys(YEAR2)["top_fine_cat"]}
    )


@query("acquisition_cohort", with_sql(TOP_SQL, select="SELECT cust_id, cohort_q FROM cohort"))
def _(spark, sf):
    return cv.acquisition_cohort(b.order_lines(spark, sf))


@query("target_rate", with_sql(TX_SQL, select="""
SELECT part, count(*) AS customers, CAST(sum(CASE WHEN revenue_label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zeros,
       CAST(sum(CASE WHEN revenue_label > 0 THEN 1 ELSE 0 END) AS BIGINT) AS spenders,
       round(avg(CASE WHEN revenue_label = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_rate
FROM labels_clv GROUP BY part"""))
def _(spark, sf):
    zero = flag(F.col("revenue_label") == 0)
    return rounded(
        b.revenue_labels(spark, sf).groupBy("part").agg(
            F.count(F.lit(1)).alias("customers"),
            F.sum(zero).alias("zeros"),
            F.sum(flag(F.col("revenue_label") > 0)).alias("spenders"),
            ratio(F.sum(zero), F.count(F.lit(1))).alias("zero_rate"),
        )
    )


@query("describe_predictions", with_sql(TX_SQL, b.REVPRED_SQL, select="""
SELECT count(a) AS n, CAST(sum(CAST(a AS DECIMAL(20,6))) AS DOUBLE) / count(a) AS mean,
       round(stddev_samp(a), 3) AS std, min(a) AS min, quantile_cont(a, 0.25) AS q25,
       quantile_cont(a, 0.5) AS q50, quantile_cont(a, 0.75) AS q75, max(a) AS max FROM revpred"""))
def _(spark, sf):
    pred = b.revenue_predictions(spark, sf).select("a")
    wide = pred.agg(
        F.count("a").alias("n"),
        ratio(F.sum(F.col("a").cast("decimal(20,6)")), F.count("a")).alias("mean"),
        F.round(F.stddev_samp("a"), 3).alias("std"),
        F.min("a").alias("min"),
        F.max("a").alias("max"),
    )
    quartiles = selected_quantiles(pred, "a", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return wide.select("*", *[
        quartiles.select(q).scalar().alias(q) for q in ("q25", "q50", "q75")
    ])


# --- joins and windows ------------------------------------------------------------------------


@query("merge_features_left", with_sql(FEAT_SQL, select=f"""
SELECT c_custkey AS cust_id, {_r('monetary', 'avg_ipt', 'brand_entropy')}, frequency, n_unique_brands
FROM customer LEFT JOIN base ON c_custkey = cust_id"""))
def _(spark, sf):
    # only what is asked for travels and is written
    tx = kept_transactions(spark, sf, ["cust_id", "sale_id", "prod_id", "order_date", "sale_revenue", "sale_discount", "returned_to", "brand"])
    orders = written(cv.order_rollup(tx).select("cust_id", "sale_id", "order_date", "order_revenue", "n_items"), "orders")
    ref = cv.as_of(orders)
    everyone = b.revenue_labels(spark, sf).select("cust_id")
    # a row of shares is one brand of a customer
    brands = cv.shares(tx, ["brand"]).groupBy("cust_id").agg(F.count("value").alias("n_unique_brands"), cv.brand_aggregates()[0])
    parts = [
        cv.customer_aggregate(orders, cv.rfm_aggregates(ref)).select("cust_id", "monetary"),
        cv.distinct_orders(orders, ref),
        cv.gap_statistics(orders).select("cust_id", "avg_ipt"),
        brands,
    ]
    for part in parts:
        everyone = cv.merge_labels(everyone, part)
    return everyone.withColumn("brand_entropy", F.round("brand_entropy", 6))


@query("merge_labels_left", with_sql(ORD_SQL, select="""
SELECT cust_id, part, revenue_label, CAST(monetary AS DOUBLE) AS monetary
FROM labels_clv LEFT JOIN (SELECT cust_id, sum(order_revenue) AS monetary FROM ord GROUP BY 1) USING (cust_id)"""))
def _(spark, sf):
    spent = orders_of(spark, sf).groupBy("cust_id").agg(
        F.sum("order_revenue").cast("double").alias("monetary")
    )
    return cv.merge_labels(b.revenue_labels(spark, sf), spent).select(
        "cust_id", "part", "revenue_label", "monetary"
    )


@query("lookup_map", with_sql(TOP_SQL, select="""
SELECT cust_id, top_brand, coalesce(mean_label, -1.0) AS mean_label FROM (
  SELECT cust_id, top_brand FROM labels_clv LEFT JOIN topv USING (cust_id)) LEFT JOIN (
  SELECT top_brand, CAST(sum(CAST(revenue_label AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS mean_label
  FROM labels_clv JOIN topv USING (cust_id) GROUP BY 1) USING (top_brand)"""))
def _(spark, sf):
    labels = b.revenue_labels(spark, sf)
    keyed = cv.merge_labels(labels, cv.top_values(b.transactions(spark, sf), {"top_brand": F.col("brand")}))
    means = (
        keyed.where(F.col("top_brand").isNotNull())
        .groupBy("top_brand")
        .agg((F.sum(F.col("revenue_label").cast(b.MONEY)).cast("double") / F.count(F.lit(1))).alias("mean_label"))
    )
    found = cv.lookup(keyed.select("cust_id", "top_brand"), "top_brand", means, "mean_label", F.lit(-1.0))
    return found.select("cust_id", "top_brand", "mean_label")


@query("index_join_lookup", with_sql(TOP_SQL, select="""
SELECT cust_id, round(ln(1 + greatest(revenue_label, 0)), 6) AS y_log, top_brand, top_brand_y2, top_cat, top_fine_cat, cohort_q
FROM labels_clv LEFT JOIN topv USING (cust_id) LEFT JOIN cohort USING (cust_id)"""))
def _(spark, sf):
    return rounded(encoding_input(spark, sf))


def encoding_input(spark: SparkSession, sf: str, lines: DataFrame | None = None) -> DataFrame:
    """All labelled customers with their log target and the five encoding keys; ``lines`` may give the items, dealt by customer."""
    kept = lines is not None
    tx = lines.where("listed") if kept else b.transactions(spark, sf)
    labels = b.revenue_labels(spark, sf).select(
        "cust_id", F.log1p(F.greatest("revenue_label", F.lit(0.0))).alias("y_log")
    )
    keyed = cv.merge_labels(labels, cv.top_values(tx, cv.encoding_keys(YEAR2), kept))
    return cv.merge_labels(keyed, cv.acquisition_cohort(lines if kept else b.order_lines(spark, sf)))


@query("interpurchase_gaps", with_sql(FEAT_SQL, select="SELECT * FROM gap"))
def _(spark, sf):
    return cv.purchase_gaps(orders_of(spark, sf))


@query("partition_total_share", with_sql(TX_SQL, select="""
SELECT cust_id, brand, n, CAST(sum(n) OVER (PARTITION BY cust_id) AS BIGINT) AS total,
       round(n / sum(n) OVER (PARTITION BY cust_id), 6) AS share
FROM (SELECT cust_id, brand, count(*) AS n FROM tx WHERE brand IS NOT NULL GROUP BY 1, 2)"""))
def _(spark, sf):
    long = cv.shares(b.transactions(spark, sf), ["brand"])
    return rounded(
        long.select("cust_id", F.col("value").alias("brand"), "n",
                    F.round(F.col("n") / F.col("share")).cast("bigint").alias("total"), "share")
    )


@query("average_rank", with_sql(TX_SQL, b.REVPRED_SQL, select="""
SELECT id, y, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS avg_rank FROM revpred"""))
def _(spark, sf):
    return average_rank(b.revenue_predictions(spark, sf).select("id", "y"), "y").select("id", "y", "avg_rank")


# --- derived feature groups -------------------------------------------------------------------


@query("growth_features", _features_sql(F_GROWTH))
def _(spark, sf):
    orders, ref = kept_orders(spark, sf)
    base = cv.customer_aggregate(
        orders,
        [*cv.rfm_aggregates(ref), *cv.yearly_aggregates(YEARS), *cv.quarterly_aggregates(YEAR2)],
    ).join(cv.distinct_orders(orders, ref, YEARS, YEAR2), "cust_id")
    return _pick(cv.growth_columns(base), F_GROWTH)


@query("velocity_features", _features_sql(F_VELOCITY))
def _(spark, sf):
    orders, ref = kept_orders(spark, sf)
    aggregates = [*cv.rfm_aggregates(ref), *cv.tenure_aggregates(ref), *cv.yearly_aggregates(YEARS),
                  *cv.lookback_aggregates(ref)]
    base = cv.customer_aggregate(orders, aggregates).join(
        cv.distinct_orders(orders, ref, days=(90,)), "cust_id"
    )
    return _pick(cv.velocity_columns(base), F_VELOCITY)


@query("intensity_share_features", _features_sql(F_INTENSITY))
def _(spark, sf):
    return _pick(features(spark, sf), F_INTENSITY)


@query("cycle_features", _features_sql(F_CYCLE))
def _(spark, sf):
    return _pick(features(spark, sf), F_CYCLE)


@query("feature_matrix", _features_sql(*FIXED_GROUPS, G_PIVOT))
def feature_matrix(spark, sf):
    return _pick(features(spark, sf), *FIXED_GROUPS, G_PIVOT)
