"""Ranks, row numbers and exact quantiles that never put one whole group into one task.

A window over a group is as large as the group. Here each group is cut into value ranges
("buckets"); windows run per (group, bucket), and the offset of a bucket is a running sum over
the per-bucket counts, at most ``buckets`` rows per group. Equal values are counted before
any window, so a value held by a third of all rows is one row there.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.session import bucket_count


def cut_points(df: DataFrame, value: str, buckets: int) -> Column:
    """Ascending cut values, about ``buckets - 1`` of them, as an array that the plan computes once.

    Numbers and dates use a quantile sketch; other types a hash-ordered sample of fixed size.
    The cuts only balance the work; results are exact for any cuts.
    """
    if isinstance(df.schema[value].dataType, (T.NumericType, T.DateType)):
        fractions = [i / buckets for i in range(1, buckets)]
        return df.agg(F.array_distinct(F.percentile_approx(value, fractions, 10 * buckets))).scalar()
    sample = df.where(F.col(value).isNotNull()).select(value).distinct().orderBy(F.xxhash64(value)).limit(16 * buckets)
    return sample.agg(F.filter(F.sort_array(F.collect_list(value)), lambda x, i: i % 16 == 15)).scalar()


def bucket_of(value: Column, cuts: Column, buckets: int) -> Column:
    """Number of cuts below ``value``: a binary search with one step per power of two."""
    steps = [F.lit(1 << i) for i in reversed(range(max(1, (buckets - 1).bit_length())))]
    size = F.coalesce(F.size(cuts), F.lit(0))

    def step(low: Column, width: Column) -> Column:
        ahead = low + width
        return F.when((ahead <= size) & (F.get(cuts, ahead - 1) < value), ahead).otherwise(low)

    return F.aggregate(F.array(*steps), F.lit(0), step)


def placed_values(df: DataFrame, value: str, groups: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Rows with a known value, and the range (``_bucket``) of their value; shared ranges bound every
    (group, range) by 1 / buckets of all rows."""
    df = df.where(F.col(value).isNotNull())
    buckets = buckets or bucket_count(df)
    return df.withColumn("_cuts", cut_points(df, value, buckets)).withColumn(
        "_bucket", bucket_of(F.col(value), F.col("_cuts"), buckets)
    ).drop("_cuts")


def local_counts(
    placed: DataFrame, value: str, groups: Sequence[str] = (), aggregates: Sequence[Column] = ()
) -> DataFrame:
    """One row per (group, range, value): ``n`` rows, ``_local`` rows of the range with a smaller
    value, and any further aggregates over the rows of the value."""
    keys = [*groups, "_bucket"]
    inside = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    counted = placed.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), *aggregates)
    return counted.withColumn("_local", F.coalesce(F.sum("n").over(inside), F.lit(0)))


def range_starts(sizes: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Adds to one row per (group, range) with its ``_size``: ``_start``, the rows of lower
    ranges, and ``total``, the rows of the group. A group has few ranges."""
    by_group = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    lower = by_group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumns(
        {
            "_start": F.coalesce(F.sum("_size").over(lower), F.lit(0)),
            "total": F.sum("_size").over(by_group),
        }
    )


def ranked_values(
    df: DataFrame, value: str, groups: Sequence[str] = (), buckets: int | None = None
) -> DataFrame:
    """Distinct values per group with ``n`` (rows), ``before`` (rows with a smaller value) and
    ``total`` (rows of the group). Null values are left out."""
    groups = list(groups)
    keys = [*groups, "_bucket"]
    placed = placed_values(df, value, groups, buckets=buckets)
    # Counted from the rows: combined before the shuffle to one row per task and range.
    sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    return (
        local_counts(placed, value, groups)
        .join(range_starts(sizes, groups).drop("_size"), keys)
        .withColumn("before", F.col("_local") + F.col("_start"))
        .drop("_local", "_start", "_bucket")
    )


def average_rank(
    df: DataFrame, value: str, groups: Sequence[str] = (), out: str = "avg_rank"
) -> DataFrame:
    """Adds the tie-averaged ascending rank of ``value`` inside its group (null stays null).

    Values that hold a hundredth of their group or more (at most a hundred per group) reach their rows in
    one aggregated map per group, so no join key holds many rows; all other values are joined.
    """
    groups = list(groups)
    ranks = ranked_values(df, value, groups).select(
        *groups, value, (F.col("n") * 100 >= F.col("total")).alias("_often"),
        (F.col("before") + (F.col("n") + 1) / 2.0).alias(out),
    )
    often = ranks.where("_often").groupBy(*groups).agg(
        F.map_from_entries(F.collect_list(F.struct(value, out))).alias("_ranks")
    )
    if groups:
        known = df.join(often, groups, "left")
    else:
        known = df.withColumn("_ranks", often.select("_ranks").scalar())
    known = known.withColumn("_rank", F.when(F.col(value).isNotNull(), F.element_at("_ranks", F.col(value)))).drop("_ranks")
    # rows that have their rank, or need none, get a key of their own and spread over all tasks
    spread = F.when(F.col("_rank").isNull() & F.col(value).isNotNull(), F.lit(0)).otherwise(1 + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)))
    rest = ranks.where("not _often").select(*groups, value, out, F.lit(0).cast("long").alias("_own"))
    keyed = known.withColumn("_own", spread.cast("long"))
    joined = keyed.join(rest, [*groups, value, "_own"], "left")
    return joined.withColumn(out, F.coalesce(F.col("_rank"), F.col(out))).drop("_rank", "_own").select(*df.columns, out)


def dense_index(df: DataFrame, value: str, out: str = "index") -> DataFrame:
    """Distinct non-null values of a column with their 0-based position in ascending order."""
    distinct = df.where(F.col(value).isNotNull()).select(value).distinct()
    ranked = ranked_values(distinct, value)
    return ranked.select(value, F.col("before").cast("int").alias(out))


def numbered(
    df: DataFrame,
    key: Column,
    tie: str,
    groups: Sequence[str] = (),
    key_range: tuple[int, int] = (-(2**63), 2**63),
    out: str = "rn",
    buckets: int | None = None,
) -> DataFrame:
    """Exact 1-based row number inside the group, ordered by ``key`` then ``tie``; adds
    ``total``, the group size.

    ``key`` must be spread evenly over ``key_range`` (a hash is), which makes its ranges
    equal shares of a group of any size.
    """
    groups = list(groups)
    buckets = buckets or bucket_count(df)
    low, high = key_range
    share = (F.col("_key").cast("double") - float(low)) / float(high - low)
    df = df.withColumn("_key", key).withColumn(
        "_bucket", F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("int")
    )
    inside = Window.partitionBy(*groups, "_bucket").orderBy("_key", tie)
    local = df.withColumn("_local", F.row_number().over(inside))
    sizes = df.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    return (
        local.join(range_starts(sizes, groups).drop("_size"), [*groups, "_bucket"])
        .withColumn(out, F.col("_local") + F.col("_start"))
        .drop("_local", "_start", "_bucket", "_key")
    )


def _interpolated(fraction: float) -> Column:
    """Linear-interpolation quantile over the rows of :func:`ranked_values`."""
    position = (F.col("total") - 1) * F.lit(float(fraction))

    def holds(index: Column) -> Column:
        return (F.col("before") <= index) & (index < F.col("before") + F.col("n"))

    low = F.max(F.when(holds(F.floor(position)), F.col("_value")))
    high = F.max(F.when(holds(F.ceil(position)), F.col("_value")))
    weight = F.max(position - F.floor(position))
    return F.when(low == high, low).otherwise((1 - weight) * low + weight * high)


def exact_quantiles(df: DataFrame, value: str, quantiles: dict[str, float], groups: Sequence[str] = ()) -> DataFrame:
    """Exact interpolated quantiles per group, one column per entry of ``quantiles``: from the ranks of the
    distinct values, so that a group of any size is spread over ranges."""
    groups = list(groups)
    rows = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("_value"))
    exprs = [_interpolated(q).alias(name) for name, q in quantiles.items()]
    return ranked_values(rows, "_value", groups).groupBy(*groups).agg(*exprs)


#: Size of the sketch that brackets a quantile, and the share of the rows by which the bracket is wider than the sketch errs.
SKETCH = 4096
MARGIN = 0.005


def selected_quantiles(df: DataFrame, value: str, quantiles: dict[str, float]) -> DataFrame:
    """One row of exact interpolated quantiles of a whole column, null without values.

    A sketch brackets each of them; a second pass counts the rows below every bracket and ranks only those inside, about a
    hundredth of all. Should a bracket miss, or NaN occur, which sketches leave out, all distinct values are ranked.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_value"))
    sketch = rows.agg(
        F.kll_sketch_agg_double("_value", SKETCH).alias("s"), F.count(F.lit(1)).alias("n"), F.count_if(F.isnan("_value")).alias("odd")
    )
    found = sketch.select("n", "odd", *[
        F.when(F.col("n") > F.col("odd"), F.kll_sketch_get_quantile_double("s", F.lit(min(1.0, max(0.0, q + side))))).alias(f"{name}_{i}")
        for name, q in quantiles.items() for i, side in enumerate((-MARGIN, MARGIN))
    ]).first()
    n = found["n"]
    if not n or found["odd"]:
        return exact_quantiles(df, value, quantiles)
    low = {name: found[f"{name}_0"] for name in quantiles}
    high = {name: found[f"{name}_1"] for name in quantiles}
    # places just outside count too: the sketch's least and greatest values are those of the rows
    inside = {name: (F.col("_value") >= low[name]) & (F.col("_value") <= high[name]) for name in quantiles}
    counts = rows.agg(
        *[F.count_if(F.col("_value") < low[name]).alias(f"{name}_below") for name in quantiles],
        *[F.count_if(inside[name]).alias(f"{name}_inside") for name in quantiles],
    ).first()
    for name, q in quantiles.items():
        place = (n - 1) * q
        if counts[f"{name}_below"] > math.floor(place) or counts[f"{name}_below"] + counts[f"{name}_inside"] <= math.ceil(place):
            return exact_quantiles(df, value, quantiles)
    tags = F.filter(F.array(*[F.when(inside[name], F.lit(name)) for name in quantiles]), lambda x: x.isNotNull())
    near = rows.select("_value", F.explode(tags).alias("_name"))
    below = F.create_map(*[x for name in quantiles for x in (F.lit(name), F.lit(counts[f"{name}_below"]))])
    place = F.create_map(*[x for name, q in quantiles.items() for x in (F.lit(name), F.lit((n - 1) * float(q)))])[F.col("_name")]
    ranked = ranked_values(near, "_value", ["_name"]).withColumn("before", F.col("before") + below[F.col("_name")])
    holds = lambda at: (F.col("before") <= at) & (at < F.col("before") + F.col("n"))
    both = ranked.groupBy("_name").agg(
        F.max(F.when(holds(F.floor(place)), F.col("_value"))).alias("a"), F.max(F.when(holds(F.ceil(place)), F.col("_value"))).alias("b"),
        F.max(place - F.floor(place)).alias("w"),
    )
    between = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("w"))
    return both.agg(*[F.max(F.when(F.col("_name") == name, between)).alias(name) for name in quantiles])
