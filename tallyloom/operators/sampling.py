"""Seeded splits, folds, samples, resampling and target encoding.

Randomness is a key per row: a hash of the id and a seed by default, or any column spread
evenly over a known range. The same seed gives the same result on any cluster.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.ordering import dense_index, numbered
from tallyloom.session import written

# Modulus and multipliers of the arithmetic key (fixed values; the modulus is prime).
PRIME, STEP, SHIFT = 1_000_003, 7_919, 104_729
EXACT = "decimal(28,12)"


@dataclass(frozen=True)
class Shuffle:
    """A pseudo-random order: key column and the range it covers."""

    key: Column
    low: int
    high: int

    @property
    def range(self) -> tuple[int, int]:
        return (self.low, self.high)


def hashed(row_id: str, seed: int) -> Shuffle:
    """Order by a 64-bit hash of id and seed; the default for real data."""
    return Shuffle(F.xxhash64(F.col(row_id), F.lit(seed)), -(2**63), 2**63)


def arithmetic(row_id: str, seed: int) -> Shuffle:
    """Order by modular arithmetic on an integer id, which any SQL engine can repeat."""
    key = ((F.col(row_id) % PRIME + seed) * STEP + seed * SHIFT) % PRIME
    return Shuffle(key, 0, PRIME)


def draw(row_id: str, seed: int) -> Column:
    """A number of 60 bits from md5 of id and seed, which other engines can repeat; draws of different seeds are
    independent, and no modulus narrows the range of ids."""
    text = F.concat_ws("#", F.col(row_id).cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def stratified_split(
    df: DataFrame,
    label: str,
    row_id: str,
    weights: dict[str, float],
    order: Shuffle,
) -> DataFrame:
    """Adds ``split``: the named parts hold their exact share of every class.

    The last part takes what rounding leaves.
    """
    ranked = numbered(df, order.key, row_id, [label], order.range)
    names = list(weights)
    bound, split = 0.0, None
    for name in names[:-1]:
        bound += weights[name]
        inside = F.col("rn") <= F.round(F.col("total") * round(bound, 12))
        split = F.when(inside, name) if split is None else split.when(inside, name)
    return ranked.withColumn("split", split.otherwise(names[-1])).drop("rn", "total")


def kfold(df: DataFrame, row_id: str, k: int, order: Shuffle) -> DataFrame:
    """Adds ``fold`` 0..k-1; fold sizes differ by at most one row."""
    ranked = numbered(df, order.key, row_id, [], order.range)
    return ranked.withColumn("fold", ((F.col("rn") - 1) % k).cast("int")).drop("rn", "total")


def sample_per_group(df: DataFrame, group: str, row_id: str, n: int, order: Shuffle) -> DataFrame:
    """At most n rows per group; every task keeps its own first n before the shuffle."""
    first = Window.partitionBy(group).orderBy("_key", row_id)
    return (
        df.withColumn("_key", order.key)
        .withColumn("_r", F.row_number().over(first))
        .where(F.col("_r") <= n)
        .drop("_key", "_r")
    )


def sample_total(df: DataFrame, row_id: str, n: int, order: Shuffle) -> DataFrame:
    """n rows overall."""
    return df.withColumn("_key", order.key).orderBy("_key", row_id).limit(n).drop("_key")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Adds 1 / class size to every row, from a class table instead of a window over the class."""
    sizes = df.groupBy(label).agg((F.lit(1.0) / F.count(F.lit(1))).alias("weight"))
    return df.join(sizes, label)


def balanced_resample(
    df: DataFrame,
    label: str,
    row_id: str,
    class_draw: Column,
    item_draw: Column,
    order: Shuffle,
    draws_per_copy: int = 100_000,
) -> DataFrame:
    """As many draws with replacement as there are rows; every class is equally likely.

    Each row stands for one draw (``draw_id``): ``class_draw`` (a non-negative whole number)
    picks the class, ``item_draw`` the item inside it. Weights of 1 / class size give every
    class the same total, which is what this draws. The few items of a rare class are drawn
    very often: they are copied so that about ``draws_per_copy`` draws meet each copy.
    """
    n = df.count()
    sizes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    k = sizes.count()
    copies = F.ceil(F.lit(float(n)) / (F.lit(float(k * draws_per_copy)) * F.col("_size"))).cast("int")
    classes = dense_index(sizes, label, "_class").join(sizes, label).withColumn("_copies", copies)
    items = (
        numbered(df, order.key, row_id, [label], order.range)
        .drop("total")
        .join(classes.select(label, "_copies"), label)
        .withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
        .drop("_copies")
    )
    draws = (
        df.select(F.col(row_id).alias("draw_id"), (class_draw % k).cast("int").alias("_class"), item_draw.alias("_item"))
        .join(classes, "_class")
        .select(
            "draw_id",
            label,
            (F.col("_item") % F.col("_size") + 1).alias("rn"),
            F.pmod(F.xxhash64("draw_id"), F.col("_copies")).cast("int").alias("_copy"),
        )
    )
    return draws.join(items, [label, "rn", "_copy"]).drop("rn", "_copy")


# --- target encoding --------------------------------------------------------------------------


def _mean(total: Column, count: Column) -> Column:
    return F.try_divide(total.cast("double"), count.cast("double"))


def global_mean(df: DataFrame, target: str) -> Column:
    """Mean over all rows, as a scalar subquery; includes the held-out fold by design."""
    return df.agg(_mean(F.sum(F.col(target).cast(EXACT)), F.count(target))).scalar()


def _key_sums(df: DataFrame, keys: Sequence[str], target: str, by: Sequence[str]) -> DataFrame:
    """Sum and count of the target per key column, known key and ``by``: all keys in one pass."""
    entries = F.explode(
        F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in keys])
    )
    return (
        df.select(entries.alias("e"), target, *by)
        .where(F.col("e.value").isNotNull())
        .groupBy("e.kind", "e.value", *by)
        .agg(F.sum(F.col(target).cast(EXACT)).alias("_s"), F.count(target).alias("_n"))
    )


def _attach(df: DataFrame, row_id: str, keys: Sequence[str], means: DataFrame, by: Sequence[str], default: Column) -> DataFrame:
    """Adds te_<key> for every key from the long table of means; unknown keys get the default.

    One join for all keys: rows become long (id, kind, value), meet the means once, and come back as
    one row per id. The join's value side is small next to the rows; a value that holds very
    many rows is split by adaptive execution.
    """
    entries = F.explode(
        F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in keys])
    )
    long = df.select(row_id, *by, entries.alias("e")).select(row_id, *by, "e.*").where(F.col("value").isNotNull())
    met = long.join(means.select("kind", "value", *by, "mean"), ["kind", "value", *by])
    wide = met.groupBy(row_id).agg(*[F.max(F.when(F.col("kind") == k, F.col("mean"))).alias(f"te_{k}") for k in keys])
    out = df.join(wide, row_id, "left")
    return out.withColumns({f"te_{k}": F.coalesce(F.col(f"te_{k}"), default) for k in keys})


def encode_out_of_fold(df: DataFrame, row_id: str, keys: Sequence[str], target: str, fold: str = "fold") -> DataFrame:
    """Adds te_<key>: the mean target of the key's rows in the other folds; ``row_id`` is unique.

    One aggregate for all keys: totals minus the own fold. Unknown or missing keys get the
    global mean.
    """
    of_key = Window.partitionBy("kind", "value")
    s, n = F.col("_s"), F.col("_n")
    means = _key_sums(df, keys, target, [fold]).select(
        "kind", "value", fold, _mean(F.sum(s).over(of_key) - s, F.sum(n).over(of_key) - n).alias("mean")
    )
    return _attach(df, row_id, keys, means, [fold], global_mean(df, target))


def encode_full(train: DataFrame, df: DataFrame, row_id: str, keys: Sequence[str], target: str) -> DataFrame:
    """Adds te_<key> to ``df``: the mean target of the key over all training rows; ``row_id`` is unique."""
    means = _key_sums(train, keys, target, []).select("kind", "value", _mean(F.col("_s"), F.col("_n")).alias("mean"))
    return _attach(df, row_id, keys, means, [], global_mean(train, target))
