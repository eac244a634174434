"""Dataset profiling: category balance, gaps, histograms, tags, image statistics.

Image rows follow the schema of Spark's image source: a struct ``image`` (origin, height, width,
nChannels, mode, data), bytes in B, G, R(, A) order; unreadable files have sizes of -1.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallyloom.functions.scalars import ratio
from tallyloom.operators.ordering import dense_index

# Luma weights of red, green, blue in a gray value (fixed values, ITU-R 601).
LUMA = (0.299, 0.587, 0.114)
# Names of image modes by their numeric code (fixed values of the image source).
MODE_NAMES = {0: "L", 16: "RGB", 24: "RGBA"}


def present(df: DataFrame, column: str) -> DataFrame:
    """Rows where the column is known."""
    return df.na.drop(subset=[column])


def file_exists(df: DataFrame, path: str, listing: DataFrame) -> DataFrame:
    """Rows whose file is in the listing (column ``path``)."""
    return df.join(listing.select(F.col("path").alias(path)), path, "left_semi")


def file_missing(df: DataFrame, path: str, listing: DataFrame) -> DataFrame:
    """Rows whose file is not in the listing, including rows without a path."""
    return df.join(listing.select(F.col("path").alias(path)), path, "left_anti")


def category_counts(df: DataFrame, category: str) -> DataFrame:
    return df.where(F.col(category).isNotNull()).groupBy(category).agg(F.count(F.lit(1)).alias("n"))


def frequent_only(df: DataFrame, category: str, min_samples: int) -> DataFrame:
    """Rows of categories with at least ``min_samples`` rows."""
    kept = category_counts(df, category).where(F.col("n") >= min_samples)
    return df.join(kept, category, "left_semi")


def balance_summary(df: DataFrame, category: str) -> DataFrame:
    """One row: largest and smallest category (first name on ties) and their ratio."""
    counts = category_counts(df, category)
    largest = F.min(F.struct((-F.col("n")).alias("m"), category))
    smallest = F.min(F.struct("n", category))
    return counts.agg(
        F.count(F.lit(1)).alias("categories"),
        F.sum("n").alias("rows"),
        largest[category].alias("largest"),
        F.max("n").alias("largest_n"),
        smallest[category].alias("smallest"),
        F.min("n").alias("smallest_n"),
        ratio(F.max("n"), F.min("n")).alias("imbalance"),
    )


def category_distribution(df: DataFrame, category: str) -> DataFrame:
    """Rows per category with the overall imbalance ratio."""
    imbalance = balance_summary(df, category).select("imbalance").scalar()
    return category_counts(df, category).withColumn("imbalance", imbalance)


def kept_dropped(df: DataFrame, category: str, min_samples: int) -> DataFrame:
    """One row: categories and rows kept and dropped by the threshold, ratio among the kept."""
    kept = F.col("n") >= min_samples
    zero = F.lit(0)
    return category_counts(df, category).agg(
        F.count(F.when(kept, 1)).alias("categories_kept"),
        F.count(F.when(~kept, 1)).alias("categories_dropped"),
        F.coalesce(F.sum(F.when(kept, F.col("n"))), zero).alias("rows_kept"),
        F.coalesce(F.sum(F.when(~kept, F.col("n"))), zero).alias("rows_dropped"),
        ratio(F.max(F.when(kept, F.col("n"))), F.min(F.when(kept, F.col("n")))).alias("kept_imbalance"),
    )


def _missing(counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns with nulls from one row of null counts and ``_rows``."""
    long = counts.unpivot(["_rows"], list(columns), "column", "missing")
    return long.where(F.col("missing") > 0).select(
        "column", "missing", F.round(F.try_divide(F.col("missing") * 100.0, F.col("_rows")), 1).alias("pct")
    )


def _null_counts(columns: Sequence[str]) -> list[Column]:
    return [F.count(F.lit(1)).alias("_rows"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns]]


def missing_profile(df: DataFrame) -> DataFrame:
    """Columns with nulls: how many, and percent with one decimal; one pass over the rows."""
    return _missing(df.agg(*_null_counts(df.columns)), df.columns)


def written_profile(df: DataFrame, path: str, category: str | None = None, kinds: Sequence[str] = ()) -> tuple[DataFrame, dict[str, int]]:
    """Writes ``df`` as Parquet to ``path``; the same scan observes what ``missing_profile`` tells and the rows of some known
    categories. Returns the profile, and rows per category."""
    seen = Observation()
    per_kind = [F.count_if(F.col(category).eqNullSafe(k)).alias(f"_kind{i}") for i, k in enumerate(kinds)] if category else []
    df.observe(seen, *_null_counts(df.columns), *per_kind).write.parquet(path)
    found = seen.get
    fields = ", ".join(f"`{c}` bigint" for c in ["_rows", *df.columns])
    counts = df.sparkSession.createDataFrame([tuple(found[c] for c in ["_rows", *df.columns])], fields)
    return _missing(counts, df.columns), {k: found[f"_kind{i}"] for i, k in enumerate(kinds)}


def as_year(column: str) -> Column:
    """Text to year; anything that is not a number becomes null."""
    return F.col(column).try_cast("double").cast("int")


def year_histogram(df: DataFrame, column: str) -> DataFrame:
    return (
        df.select(as_year(column).alias("year"))
        .where(F.col("year").isNotNull())
        .groupBy("year")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def mean_year(df: DataFrame, category: str, column: str, min_samples: int) -> DataFrame:
    """Average year per kept category."""
    return frequent_only(df, category, min_samples).groupBy(category).agg(F.avg(as_year(column)).alias("mean_year"))


def list_length_histogram(df: DataFrame, column: str) -> DataFrame:
    """Counts by list length; a missing list has length 0."""
    length = F.coalesce(F.size(column), F.lit(0))
    return (
        df.select(F.when(F.col(column).isNull(), 0).otherwise(length).alias("length"))
        .groupBy("length")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_elements(df: DataFrame, column: str, k: int = 15) -> DataFrame:
    """Most frequent list elements."""
    return (
        df.select(F.explode(column).alias("element"))
        .groupBy("element")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "element")
        .limit(k)
    )


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram: bin, lo, hi, n. The maximum belongs to the last bin, empty bins
    are kept, and a constant column spans one unit around its value."""
    x = F.col(column).cast("double")
    span = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    flat = F.col("lo") == F.col("hi")
    span = span.select(
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    position = F.floor((x - lo) * bins / (hi - lo)) + 1
    counts = (
        df.where(x.isNotNull())
        .groupBy(F.least(position, F.lit(bins)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    edges = span.select(
        F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"),
        F.col("lo").alias("_lo"),
        ((F.col("hi") - F.col("lo")) / bins).alias("_step"),
    )
    return edges.join(counts, "bin", "left").select(
        "bin",
        (F.col("_lo") + (F.col("bin") - 1) * F.col("_step")).alias("lo"),
        (F.col("_lo") + F.col("bin") * F.col("_step")).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def label_encode(df: DataFrame, category: str) -> DataFrame:
    """Distinct categories in ascending order with their 0-based index; serves both directions."""
    return dense_index(df, category, "label")


# --- images -----------------------------------------------------------------------------------


def image_profile(images: DataFrame) -> DataFrame:
    """One row: files, unreadable ones, size range, images per mode."""
    i = F.col("image")
    ok = i["width"] > 0
    sizes = []
    for side in ("width", "height"):
        value = F.when(ok, i[side])
        sizes += [
            F.min(value).alias(f"min_{side}"),
            F.max(value).alias(f"max_{side}"),
            F.avg(value).alias(f"mean_{side}"),
        ]
    modes = [F.count(F.when(i["mode"] == code, 1)).alias(f"mode_{name.lower()}") for code, name in MODE_NAMES.items()]
    return images.agg(
        F.count(F.lit(1)).alias("files"), F.count(F.when(~ok, 1)).alias("corrupt"), *sizes, *modes
    )


def _channel_means(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mean red, green, blue and gray value of each image."""
    for frame in frames:
        rows = []
        for data, channels in zip(frame["data"], frame["nChannels"]):
            pixels = np.frombuffer(data, dtype=np.uint8).reshape(-1, channels).astype(float)
            if channels == 1:
                red = green = blue = pixels[:, 0].mean()
            else:
                blue, green, red = pixels[:, :3].mean(axis=0)
            gray = red if channels == 1 else LUMA[0] * red + LUMA[1] * green + LUMA[2] * blue
            rows.append((red, green, blue, gray))
        means = pd.DataFrame(rows, columns=["red", "green", "blue", "gray"])
        yield pd.concat([frame[["category"]].reset_index(drop=True), means], axis=1)


def channel_means(images: DataFrame) -> DataFrame:
    """Per readable image: category and mean red, green, blue, gray."""
    readable = images.where(F.col("image.width") > 0).select("category", "image.nChannels", "image.data")
    return readable.mapInPandas(
        _channel_means, "category string, red double, green double, blue double, gray double"
    )


def brightness_by_category(sampled: DataFrame) -> DataFrame:
    """Mean gray value per category of an image sample."""
    return channel_means(sampled).groupBy("category").agg(
        F.count(F.lit(1)).alias("images"), F.avg("gray").alias("brightness")
    )


def channel_mean_std(sampled: DataFrame) -> DataFrame:
    """Mean and population deviation, over images, of each channel's mean; scaled to 0..1."""
    colors = ["red", "green", "blue"]
    long = channel_means(sampled).unpivot(["category"], colors, "channel", "value")
    return long.groupBy("channel").agg(
        F.avg(F.col("value") / 255).alias("mean"), F.stddev_pop(F.col("value") / 255).alias("std")
    )
