"""Profiling edge cases and image statistics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import profiling as pr
from tallyloom.session import new_path


def test_histogram_matches_numpy(spark):
    values = np.random.default_rng(0).normal(size=500)
    out = pr.histogram(spark.createDataFrame([(float(v),) for v in values], "v double"), "v", 12).orderBy("bin").toPandas()
    counts, edges = np.histogram(values, 12)
    assert (out.n.to_numpy() == counts).all()
    assert np.allclose(out.lo, edges[:-1]) and np.allclose(out.hi, edges[1:])


def test_histogram_of_a_constant_keeps_all_bins(spark):
    out = pr.histogram(spark.createDataFrame([(3.0,), (3.0,), (None,)], "v double"), "v", 10).collect()
    assert len(out) == 10 and sum(r.n for r in out) == 2


def test_missing_profile_lists_only_gaps(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, 3, None), (3, None, "y")], "a int, b int, c string")
    assert {tuple(r) for r in pr.missing_profile(df).collect()} == {("b", 2, 66.7), ("c", 1, 33.3)}


def test_years_that_are_no_numbers_are_left_out(spark):
    df = spark.createDataFrame([("1999",), ("n/a",), (None,), ("1999.0",)], "y string")
    assert [tuple(r) for r in pr.year_histogram(df, "y").collect()] == [(1999, 2)]


def test_profile_of_a_write_equals_the_aggregate(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, None), (3, 1.0, "b"), (4, 2.0, "a")], "id int, b double, c string").repartition(3)
    path = new_path(spark, "profiled")
    profile, kinds = pr.written_profile(df, path, "c", ["a", "b", "z"])
    assert sorted(profile.collect()) == sorted(pr.missing_profile(df).collect()) and kinds == {"a": 2, "b": 1, "z": 0}
    assert sorted(spark.read.parquet(path).collect(), key=str) == sorted(df.collect(), key=str)
    empty, _ = pr.written_profile(df.limit(0), new_path(spark, "profiled"))
    assert empty.count() == 0


def test_list_lengths_count_missing_as_zero(spark):
    df = spark.createDataFrame([(["a", "b"],), (None,), ([],)], "t array<string>")
    assert {tuple(r) for r in pr.list_length_histogram(df, "t").collect()} == {(2, 1), (0, 2)}


def test_file_semi_and_anti(spark):
    df = spark.createDataFrame([(1, "p1"), (2, "p2"), (3, None)], "id int, path string")
    listing = spark.createDataFrame([("p1",), ("p1",)], "path string")
    assert [r.id for r in pr.file_exists(df, "path", listing).collect()] == [1]
    assert sorted(r.id for r in pr.file_missing(df, "path", listing).collect()) == [2, 3]


def test_threshold_summary(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 2 + [("c",)] + [(None,)], "k string")
    row = pr.kept_dropped(df, "k", 2).first()
    assert tuple(row) == (2, 1, 7, 1, 2.5)
    assert pr.frequent_only(df, "k", 2).count() == 7
    balance = pr.balance_summary(df, "k").first()
    assert (balance.largest, balance.smallest, balance.imbalance) == ("a", "c", 5.0)


def test_channel_means_of_color_and_gray(spark):
    rows = [
        ("g", (1, 2, 1, 0, bytes([10, 30]))),
        ("c", (1, 1, 4, 24, bytes([30, 20, 10, 255]))),  # B, G, R, A
        ("c", (-1, -1, -1, -1, None)),
    ]
    df = spark.createDataFrame(
        rows, "category string, image struct<height:int,width:int,nChannels:int,mode:int,data:binary>"
    )
    out = {r.category: r for r in pr.channel_means(df).collect()}
    assert (out["g"].red, out["g"].gray) == (20.0, 20.0)
    assert (out["c"].red, out["c"].green, out["c"].blue) == (10.0, 20.0, 30.0)
    assert out["c"].gray == pytest.approx(0.299 * 10 + 0.587 * 20 + 0.114 * 30)
    profile = pr.image_profile(df).first()
    assert (profile.files, profile.corrupt, profile.max_width, profile.mode_rgba) == (3, 1, 2, 1)
    spread = {r.channel: r for r in pr.channel_mean_std(df).collect()}
    assert spread["red"].mean == pytest.approx(15 / 255) and spread["red"].std == pytest.approx(5 / 255)


def test_label_encoding_is_sorted(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "k string")
    assert {tuple(r) for r in pr.label_encode(df, "k").orderBy(F.col("label")).collect()} == {("a", 0), ("b", 1)}
