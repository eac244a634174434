"""Null-safe scalar expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null when b is 0 (ANSI division would raise)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def floor0(x: Column) -> Column:
    """max(x, 0) that keeps null (``greatest`` alone would turn null into 0)."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def flag(condition: Column) -> Column:
    """1/0 flag; an unknown condition counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def total(x: Column) -> Column:
    """Sum that is 0 for a group of nulls."""
    return F.coalesce(F.sum(x), F.lit(0))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Rounds every double column; money stays decimal until it is cast."""
    doubles = {f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)}
    return df.select(
        *[F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in df.columns]
    )


def year_quarter(day: Column) -> Column:
    """Quarter period text such as 2000Q3."""
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def softmax(logits: Column) -> Column:
    """Softmax of an array column, shifted by the maximum for stability."""
    peak = F.array_max(logits)
    grown = F.transform(logits, lambda x: F.exp(x - peak))
    norm = F.aggregate(grown, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(grown, lambda x: x / norm)


def argmax(values: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def text_or_null(x: Column) -> Column:
    """Empty text as null, so that ``concat_ws`` skips it."""
    return F.when(x != "", x)


def contains_ci(x: Column, piece: str) -> Column:
    return F.lower(x).contains(piece.lower())


def one_of(x: Column, values: Sequence[str], ci: bool = False) -> Column:
    """Membership in a literal list; exact case unless ``ci``."""
    return F.lower(x).isin([v.lower() for v in values]) if ci else x.isin(list(values))


def tags_of_map(tags: Column, limit: int = 8) -> Column:
    """Tag names of a name-to-votes map, at most ``limit``; empty when missing."""
    return F.coalesce(F.slice(F.map_keys(tags), 1, limit), F.array().cast("array<string>"))


def tags_of_list(tags: Column, limit: int = 8) -> Column:
    """Tag names of a list, at most ``limit``; empty when missing."""
    return F.coalesce(F.slice(tags, 1, limit), F.array().cast("array<string>"))
