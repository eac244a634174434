"""Customer-value features from a flat transaction table.

Input columns: cust_id, sale_id, prod_id, order_date, sale_revenue, sale_discount, returned_to,
web_only and, for item features, brand, category, fine_category, season, size, color, outlet.
Money is decimal, so sums do not depend on the order of rows; results are double.

Rows without a grouping key are dropped, a sum over nulls is 0, division by zero is null, and
gap features of customers with one order stay null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.scalars import flag, floor0, ratio, total, year_quarter
from tallyloom.operators.ordering import exact_quantiles
from tallyloom.session import bucket_count

CUST = "cust_id"
LOOKBACKS = (90, 180, 365)
MONEY = "decimal(18,4)"
ENTROPY_EPSILON = 1e-12
# Fixed values of the cycle features: days expected orders are counted over, and the floor of that count.
EXPECTED_DAYS, EXPECTED_FLOOR = 90.0, 0.01


# --- preparation ------------------------------------------------------------------------------


def derive_columns(tx: DataFrame) -> DataFrame:
    """Returned flag from a non-null shop, year, month, weekday with Monday = 0."""
    return tx.withColumns(
        {
            "is_returned": flag(F.col("returned_to").isNotNull()),
            "order_year": F.year("order_date"),
            "order_month": F.month("order_date"),
            "order_weekday": F.weekday("order_date"),
        }
    )


def filter_period(df: DataFrame, year: int, quarter: int | None = None) -> DataFrame:
    """Rows of one year, or of one quarter of it; written as a date range so scans can prune."""
    first, months = (1, 12) if quarter is None else (3 * quarter - 2, 3)
    start = F.make_date(F.lit(year), F.lit(first), F.lit(1))
    return df.where((F.col("order_date") >= start) & (F.col("order_date") < F.add_months(start, months)))


def reference_date(df: DataFrame) -> DataFrame:
    """One row: the day after the latest order."""
    return df.agg(F.date_add(F.max("order_date"), 1).alias("reference_date"))


def as_of(df: DataFrame) -> Column:
    """The reference date as a scalar subquery, usable inside any expression."""
    return reference_date(df).scalar()


def filter_since(df: DataFrame, ref: Column, days: int) -> DataFrame:
    """Orders of the last ``days`` days before the reference date."""
    return df.where(F.col("order_date") >= F.date_sub(ref, days))


def order_rollup(tx: DataFrame) -> DataFrame:
    """Items -> orders (customer x sale x date)."""
    keys = [CUST, "sale_id", "order_date"]
    return (
        tx.na.drop(subset=keys)
        .groupBy(*keys)
        .agg(
            # Back to long-backed decimals: compact in the order table, fast in later sums.
            total(F.col("sale_revenue")).cast(MONEY).alias("order_revenue"),
            total(F.col("sale_discount")).cast(MONEY).alias("order_discount"),
            F.count("prod_id").alias("n_items"),
            F.max(flag(F.col("returned_to").isNotNull())).alias("has_return"),
        )
        .withColumn("order_year", F.year("order_date"))
    )


# --- order-grain features: lists of aggregates that fit into one groupBy ----------------------


def _revenue() -> Column:
    return F.col("order_revenue")


def _mean(x: Column) -> Column:
    return F.try_divide(F.sum(x).cast("double"), F.count(x).cast("double"))


def _amount(x: Column) -> Column:
    return total(x).cast("double")


def rfm_aggregates(ref: Column) -> list[Column]:
    return [
        F.datediff(ref, F.max("order_date")).alias("recency"),
        _amount(_revenue()).alias("monetary"),
        _mean(_revenue()).alias("avg_order_val"),
        F.max(_revenue()).cast("double").alias("max_order_val"),
        F.stddev_samp(_revenue().cast("double")).alias("std_order_val"),
        F.sum("n_items").alias("total_items"),
        _mean(F.col("n_items")).alias("avg_items_per_order"),
    ]


def tenure_aggregates(ref: Column) -> list[Column]:
    return [
        F.datediff(ref, F.min("order_date")).alias("first_purchase_days"),
        F.datediff(F.max("order_date"), F.min("order_date")).alias("purchase_span_days"),
    ]


def yearly_aggregates(years: Sequence[int]) -> list[Column]:
    out = []
    for i, year in enumerate(years, 1):
        inside = F.col("order_year") == year
        value = F.when(inside, _revenue())
        out += [
            _amount(value).alias(f"revenue_y{i}"),
            F.coalesce(_mean(value), F.lit(0.0)).alias(f"avg_val_y{i}"),
            total(F.when(inside, F.col("has_return"))).alias(f"returns_y{i}"),
        ]
    return out


def quarterly_aggregates(year: int) -> list[Column]:
    inside = lambda q: (F.col("order_year") == year) & (F.quarter("order_date") == q)
    return [_amount(F.when(inside(q), _revenue())).alias(f"rev_y2_q{q}") for q in (1, 2, 3, 4)]


def lookback_aggregates(ref: Column, days: Sequence[int] = LOOKBACKS) -> list[Column]:
    out = []
    for n in days:
        inside = F.col("order_date") >= F.date_sub(ref, n)
        value = F.when(inside, _revenue())
        out += [
            _amount(value).alias(f"revenue_last{n}d"),
            total(F.when(inside, F.col("n_items"))).alias(f"items_last{n}d"),
            F.coalesce(_mean(value), F.lit(0.0)).alias(f"avg_val_last{n}d"),
        ]
    return out


def discount_aggregates() -> list[Column]:
    """``max_discount`` is the minimum on purpose: discounts are stored as negative amounts."""
    discount = F.col("order_discount")
    return [
        _amount(discount).alias("total_discount"),
        _mean(discount).alias("avg_discount"),
        F.min(discount).cast("double").alias("max_discount"),
        _mean(F.col("has_return")).alias("return_rate"),
        F.sum("has_return").alias("n_returns"),
        ratio(total(discount), F.sum("n_items")).alias("discount_per_item"),
    ]


def distinct_orders(
    orders: DataFrame,
    ref: Column,
    years: Sequence[int] = (),
    quarters_of: int | None = None,
    days: Sequence[int] = (),
) -> DataFrame:
    """Distinct sales per customer: all, per year, per quarter, per look-back.

    Collapses to one row per sale with a flag per period first; many distinct counts in one
    aggregate would instead copy every order once per count.
    """
    day = F.col("order_date")
    periods = {f"orders_y{i}": F.col("order_year") == y for i, y in enumerate(years, 1)}
    if quarters_of is not None:
        for q in (1, 2, 3, 4):
            periods[f"orders_y2_q{q}"] = (F.col("order_year") == quarters_of) & (F.quarter(day) == q)
    for n in days:
        periods[f"orders_last{n}d"] = day >= F.date_sub(ref, n)
    flags = [F.max(flag(inside)).alias(name) for name, inside in periods.items()]
    sales = orders.groupBy(CUST, "sale_id").agg(F.lit(1).alias("frequency"), *flags)
    return sales.groupBy(CUST).agg(*[F.sum(c).alias(c) for c in ["frequency", *periods]])


def median_order_value(orders: DataFrame) -> DataFrame:
    return exact_quantiles(orders, "order_revenue", {"median_order_val": 0.5}, [CUST])


def _days(orders: DataFrame) -> DataFrame:
    """Customer x day with the day before it; a customer has at most one row per calendar day."""
    by_day = Window.partitionBy(CUST).orderBy("order_date")
    return (
        orders.groupBy(CUST, "order_date")
        .agg(F.count(F.lit(1)).alias("n"), F.min("sale_id").alias("first_sale"))
        .withColumn("previous", F.lag("order_date").over(by_day))
    )


def purchase_gaps(orders: DataFrame) -> DataFrame:
    """Days since the customer's previous order, one row per order but the first.

    Orders of one day follow each other by sale_id with gap 0.
    """
    days = _days(orders).select(CUST, "order_date", "first_sale", "previous")
    opens = F.col("sale_id") == F.col("first_sale")
    gap = F.when(opens, F.datediff("order_date", "previous")).otherwise(0)
    return (
        orders.select(CUST, "sale_id", "order_date")
        .join(days, [CUST, "order_date"])
        .select(CUST, "sale_id", "order_date", gap.alias("gap_days"))
        .where(F.col("gap_days").isNotNull())
    )


def gap_statistics(orders: DataFrame) -> DataFrame:
    """Mean, deviation, minimum and maximum of the gaps, and the number of active months.

    Works on day rows: n orders on a day are n - 1 gaps of 0 and one gap to the day before.
    """
    gap = F.datediff("order_date", "previous").cast("bigint")
    new_month = F.col("previous").isNull() | (F.trunc("previous", "MM") < F.trunc("order_date", "MM"))
    sums = _days(orders).groupBy(CUST).agg(
        (F.sum("n") - 1).alias("m"),
        total(gap).alias("s"),
        total(gap * gap).alias("ss"),
        F.max("n").alias("most"),
        F.min(gap).alias("low"),
        F.max(gap).alias("high"),
        F.sum(flag(new_month)).alias("n_active_months"),
    )
    m, s, ss = F.col("m"), F.col("s"), F.col("ss")
    some = m > 0
    return sums.select(
        CUST,
        "n_active_months",
        F.when(some, s / m).alias("avg_ipt"),
        F.when(m > 1, F.sqrt((m * ss - s * s) / (m * (m - 1)))).alias("std_ipt"),
        F.when(some, F.when(F.col("most") > 1, F.lit(0)).otherwise(F.col("low"))).alias("min_ipt"),
        F.when(some, F.coalesce(F.col("high"), F.lit(0))).alias("max_ipt"),
    )


# --- item-grain features ----------------------------------------------------------------------


def preference_aggregates() -> list[Column]:
    month = F.month("order_date")
    return [
        _mean(F.col("web_only")).alias("web_only_rate"),
        _mean(F.col("outlet")).alias("outlet_rate"),
        _mean(F.weekday("order_date")).alias("avg_order_weekday"),
        F.stddev_samp(month).alias("std_order_month"),
        _mean(month).alias("avg_order_month"),
        _mean(flag(month >= 10)).alias("share_q4"),
    ]


def _entries(tx: DataFrame, keys: dict[str, Column], dealt: bool = False) -> DataFrame:
    """Rows per customer, kind and known value: several key columns under each other, counted.

    Nearly every row brings new entries, so a task's table of counts is as large as its rows. Narrow rows are dealt evenly
    over all of the session's partitions first, by customer and values, so not even one busy customer fills a task. Rows that are
    ``dealt`` by customer (:func:`tallyloom.session.dealt`) are as evenly dealt as customers are, and stay where they are.
    """
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    narrow = tx.where(F.col(CUST).isNotNull()).select(CUST, *[c.cast("string").alias(names[k]) for k, c in keys.items()])
    if not dealt:
        narrow = narrow.repartition(bucket_count(tx), CUST, *names.values())
    entries = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in names.items()]))
    return (
        narrow.select(CUST, entries.alias("e"))
        .select(CUST, "e.kind", "e.value")
        .where(F.col("value").isNotNull())
        .groupBy(CUST, "kind", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def distinct_values(tx: DataFrame, columns: dict[str, str], dealt: bool = False) -> DataFrame:
    """Distinct known values per customer for several columns (output name -> column).

    Narrow key rows are counted once each; several distinct counts in one aggregate would
    carry every column and every other sum through the same shuffle.
    """
    entries = _entries(tx, {name: F.col(c) for name, c in columns.items()}, dealt)
    counts = [F.count(F.when(F.col("kind") == name, 1)).alias(name) for name in columns]
    return entries.groupBy(CUST).agg(*counts)


VARIETY = {
    "n_unique_brands": "brand",
    "n_unique_products": "prod_id",
    "n_unique_sizes": "size",
    "n_unique_colors": "color",
}


def preferences(tx: DataFrame) -> DataFrame:
    """Rates, weekday and month statistics, and the variety of brands, products, sizes, colors."""
    plain = customer_aggregate(tx, [*preference_aggregates(), item_price_aggregate()])
    return plain.join(distinct_values(tx, VARIETY), CUST, "left").na.fill(0, subset=list(VARIETY))


def item_price_aggregate() -> Column:
    """Revenue per item row; rows without revenue still count."""
    return ratio(total(F.col("sale_revenue")), F.count(F.lit(1))).alias("avg_item_price")


def shares(tx: DataFrame, keys: Sequence[str], dealt: bool = False) -> DataFrame:
    """Long table of shares: customer, kind, value, n, share of the customer's known values.

    Counts are taken first, so the window sees one row per customer and vocabulary entry.
    """
    of_customer = Window.partitionBy(CUST, "kind")
    # One shuffle by customer serves this window and the aggregate by customer that follows.
    counts = _entries(tx, {k: F.col(k) for k in keys}, dealt)
    counts = counts if dealt else counts.repartition(CUST)
    return counts.withColumn("share", F.col("n") / F.sum("n").over(of_customer))


def brand_aggregates() -> list[Column]:
    """Entropy and largest share over the long share table (kind 'brand')."""
    p = F.when(F.col("kind") == "brand", F.col("share"))
    return [
        (-F.sum(p * F.log(p + ENTROPY_EPSILON))).alias("brand_entropy"),
        F.max(p).alias("top_brand_share"),
    ]


def pivot_aggregates(kind: str, values: Sequence[str], prefix: str) -> list[Column]:
    """One share column per listed value: 0 when absent, null for customers without the kind."""
    mine = F.col("kind") == kind
    present = F.max(F.when(mine, F.lit(0.0)))
    return [
        F.coalesce(F.max(F.when(mine & (F.col("value") == v), F.col("share"))), present).alias(
            f"{prefix}_{v.lower().replace(' ', '_')}"
        )
        for v in values
    ]


def share_aggregates(column: str, values: Sequence[str], prefix: str) -> list[Column]:
    """The columns of ``pivot_aggregates`` straight from item rows: a fixed list of values needs no row per customer and value."""
    known, value = F.count(column).cast("double"), F.col(column).cast("string")
    return [
        F.try_divide(F.count(F.when(value == v, 1)).cast("double"), known).alias(f"{prefix}_{v.lower().replace(' ', '_')}")
        for v in values
    ]


def top_values(tx: DataFrame, keys: dict[str, Column], dealt: bool = False) -> DataFrame:
    """Most frequent known value per customer for each key, the smaller value on ties."""
    counts = _entries(tx, keys, dealt)
    best = [
        F.min(F.when(F.col("kind") == name, F.struct((-F.col("n")).alias("less"), "value")))["value"].alias(name)
        for name in keys
    ]
    return counts.groupBy(CUST).agg(*best)


def encoding_keys(last_year: int) -> dict[str, Column]:
    """Top brand (ever, last year), top category, top fine category with a word for missing."""
    return {
        "top_brand": F.col("brand"),
        "top_brand_y2": F.when(F.year("order_date") == last_year, F.col("brand")),
        "top_cat": F.col("category"),
        "top_fine_cat": F.coalesce("fine_category", F.lit("unknown")),
    }


def acquisition_cohort(df: DataFrame) -> DataFrame:
    return (
        df.where(F.col(CUST).isNotNull())
        .groupBy(CUST)
        .agg(year_quarter(F.min("order_date")).alias("cohort_q"))
    )


# --- derived columns --------------------------------------------------------------------------


def growth_columns(f: DataFrame) -> DataFrame:
    c = F.col
    return f.withColumns(
        {
            "revenue_growth": (c("revenue_y2") - c("revenue_y1")) / (F.abs("revenue_y1") + 1),
            "orders_growth": (c("orders_y2") - c("orders_y1")) / (c("orders_y1") + 1),
            "active_in_y2": flag(c("orders_y2") > 0),
            "active_in_y1": flag(c("orders_y1") > 0),
            "share_rev_y2": c("revenue_y2") / (F.abs("monetary") + 1),
            "rev_y2_h2": c("rev_y2_q3") + c("rev_y2_q4"),
            "rev_y2_h1": c("rev_y2_q1") + c("rev_y2_q2"),
            "rev_y2_h2h1_ratio": ratio(
                c("rev_y2_q3") + c("rev_y2_q4"), c("rev_y2_q1") + c("rev_y2_q2") + 1
            ),
            "orders_y2_h2": c("orders_y2_q3") + c("orders_y2_q4"),
            "active_q4_y2": flag(c("orders_y2_q4") > 0),
        }
    )


def velocity_columns(f: DataFrame) -> DataFrame:
    c = F.col
    months = c("first_purchase_days") / F.lit(30.0) + 1
    log_of = lambda name: F.log1p(floor0(c(name)))
    return f.withColumns(
        {
            "monetary_log": log_of("monetary"),
            "frequency_log": F.log1p(c("frequency")),
            "rev_y2_log": log_of("revenue_y2"),
            "rev_last90d_log": log_of("revenue_last90d"),
            "rev_last180d_log": log_of("revenue_last180d"),
            "purchase_rate_monthly": ratio(c("frequency"), months),
            "revenue_rate_monthly": ratio(c("monetary"), months),
            "rev_per_recent_order": c("revenue_last90d") / (c("orders_last90d") + 1),
            "freq_x_recency_inv": ratio(c("frequency"), c("recency") + 1),
            "freq_x_monetary_log": F.log1p(c("frequency")) * log_of("monetary"),
        }
    )


def intensity_columns(f: DataFrame) -> DataFrame:
    c = F.col
    spent = F.abs("monetary") + 1
    return f.withColumns(
        {
            "rev_y2_per_order": c("revenue_y2") / (c("orders_y2") + 1),
            "rev_y2_per_month": c("revenue_y2") / 12,
            "recency_ipt_ratio": ratio(c("recency"), c("avg_ipt") + 1),
            **{f"rev_last{n}d_share": c(f"revenue_last{n}d") / spent for n in LOOKBACKS},
            "discount_rate": F.abs("total_discount") / spent,
            "orders_per_brand": ratio(c("frequency"), c("n_unique_brands") + 1),
        }
    )


def cycle_columns(f: DataFrame) -> DataFrame:
    """Cycle features; null gap ratios stay null, their flags count as 0."""
    c = F.col
    r = floor0(c("recency_ipt_ratio"))
    return f.withColumns(
        {
            "log_recency_ipt": F.log1p(r),
            "skipped_1_cycle": flag(r >= 1),
            "skipped_2_cycle": flag(r >= 2),
            "skipped_3_cycle": flag(r >= 3),
            "ript_sq": r * r,
            "rev_y2_q4_log": F.log1p(floor0(c("rev_y2_q4"))),
            "q4_to_q3_rev_ratio": ratio(c("rev_y2_q4"), c("rev_y2_q3") + 1),
            "recent_vs_expected": ratio(
                c("orders_last90d"), F.lit(EXPECTED_DAYS) / (c("avg_ipt") + 1) + EXPECTED_FLOOR
            ),
            "max_val_x_freq_inv_rec": ratio(c("max_order_val") * c("frequency"), c("recency") + 1),
            "freq_per_active_month": ratio(c("frequency"), c("n_active_months") + 1),
        }
    )


# --- assembly ---------------------------------------------------------------------------------


def customer_aggregate(orders: DataFrame, aggregates: Sequence[Column]) -> DataFrame:
    return orders.where(F.col(CUST).isNotNull()).groupBy(CUST).agg(*aggregates)


def order_features(orders: DataFrame, ref: Column, years: tuple[int, int]) -> DataFrame:
    """All order-grain features: one wide aggregate plus the three that need another grain."""
    wide = customer_aggregate(
        orders,
        [
            *rfm_aggregates(ref),
            *tenure_aggregates(ref),
            *yearly_aggregates(years),
            *quarterly_aggregates(years[1]),
            *lookback_aggregates(ref),
            *discount_aggregates(),
        ],
    )
    counts = distinct_orders(orders, ref, years, years[1], LOOKBACKS)
    return (
        wide.join(counts, CUST)
        .join(gap_statistics(orders), CUST)
        .join(median_order_value(orders), CUST, "left")
    )


def item_features(tx: DataFrame, categories: Sequence[str], seasons: Sequence[str], dealt: bool = False) -> DataFrame:
    """All item-grain features: one aggregate over items, one over their keys, one over the shares of brands."""
    pivots = [*share_aggregates("category", categories, "cat"), *share_aggregates("season", seasons, "season")]
    plain = customer_aggregate(tx, [*preference_aggregates(), item_price_aggregate(), *pivots])
    brands = shares(tx, ["brand"], dealt).groupBy(CUST).agg(F.count("value").alias("n_unique_brands"), *brand_aggregates())
    others = {name: column for name, column in VARIETY.items() if column != "brand"}
    return plain.join(distinct_values(tx, others, dealt), CUST, "left").join(brands, CUST, "left").na.fill(0, subset=list(VARIETY))


def feature_matrix(
    tx: DataFrame,
    orders: DataFrame,
    ref: Column,
    years: tuple[int, int],
    categories: Sequence[str],
    seasons: Sequence[str],
    dealt: bool = False,
) -> DataFrame:
    """One row per customer: 101 fixed features plus one column per category and season. ``dealt``: both tables are dealt by customer."""
    base = order_features(orders, ref, years).join(
        item_features(tx, categories, seasons, dealt), CUST, "left"
    )
    return cycle_columns(intensity_columns(velocity_columns(growth_columns(base))))


def merge_labels(labels: DataFrame, features: DataFrame) -> DataFrame:
    """Label rows keep their place; customers without features get nulls."""
    return labels.join(features, CUST, "left")


def zero_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null -> 0 in the named columns only."""
    return df.na.fill(0, subset=list(columns))


def lookup(df: DataFrame, key: str, table: DataFrame, value: str, default: Column) -> DataFrame:
    """Attach ``value`` of a one-row-per-key table; unmatched keys get the default."""
    found = df.join(table.select(key, value), key, "left")
    return found.withColumn(value, F.coalesce(F.col(value), default))
