"""Ranks, row numbers and quantiles against brute force, with hot values and hot groups."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import ordering as o


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 3000
    value = np.round(rng.normal(size=n) * 50)
    value[rng.random(n) < 0.4] = 0.0  # one value holds over a third of the rows
    group = np.where(rng.random(n) < 0.5, 0, rng.integers(1, 60, n))  # one group holds half
    return pd.DataFrame({"id": np.arange(n), "g": group, "v": value})


def test_average_rank(spark, frame):
    out = o.average_rank(spark.createDataFrame(frame), "v").toPandas().set_index("id")["avg_rank"]
    assert (out.sort_index().to_numpy() == frame.v.rank().to_numpy()).all()


def test_average_rank_in_groups(spark, frame):
    out = o.average_rank(spark.createDataFrame(frame), "v", ["g"]).toPandas().set_index("id")["avg_rank"]
    assert (out.sort_index().to_numpy() == frame.groupby("g").v.rank().to_numpy()).all()


@pytest.mark.parametrize("buckets", [2, 8, 1000])
def test_ranges_add_up_to_ranks(spark, frame, buckets):
    placed = o.placed_values(spark.createDataFrame(frame), "v", ["g"], buckets)
    values = o.local_counts(placed, "v", ["g"], [F.sum("id").alias("s")])
    sizes = values.groupBy("g", "_bucket").agg(F.sum("n").alias("_size"))
    out = values.join(o.range_starts(sizes, ["g"]), ["g", "_bucket"]).toPandas()
    want = frame.groupby(["g", "v"]).id.agg(["size", "sum"]).reset_index()
    got = out.sort_values(["g", "v"]).reset_index(drop=True)
    assert (got.n.to_numpy() == want["size"].to_numpy()).all()
    assert (got.s.to_numpy() == want["sum"].to_numpy()).all()
    before = want.groupby("g")["size"].cumsum() - want["size"]
    assert ((got['_local'] + got['_start']).to_numpy() == before.to_numpy()).all()
    assert (got.total == got.groupby("g").n.transform("sum")).all()


def test_quantiles_by_group(spark, frame):
    out = o.exact_quantiles(spark.createDataFrame(frame), "v", {"q": 0.5, "p": 0.9}, ["g"]).toPandas()
    got = out.set_index("g").sort_index()
    want = frame.groupby("g").v.quantile([0.5, 0.9]).unstack()
    assert np.allclose(got["q"], want[0.5]) and np.allclose(got["p"], want[0.9])


def test_quantiles_of_all_rows(spark, frame):
    row = o.exact_quantiles(spark.createDataFrame(frame), "v", {"a": 0.25, "b": 0.75}).first()
    assert np.allclose([row.a, row.b], frame.v.quantile([0.25, 0.75]))


def test_numbered_is_exact(spark, frame):
    df = spark.createDataFrame(frame)
    out = o.numbered(df, F.xxhash64("id"), "id", ["g"], buckets=16).withColumn("h", F.xxhash64("id")).toPandas()
    want = out.sort_values(["g", "h", "id"]).groupby("g").cumcount() + 1
    assert (out.rn == want.sort_index()).all()
    assert (out.total == out.groupby("g").id.transform("size")).all()


def test_dense_index_of_text(spark):
    words = [("pear",), ("apple",), ("fig",), ("fig",), (None,), ("äpfel",)]
    out = o.dense_index(spark.createDataFrame(words, "w string"), "w").collect()
    assert {r.w: r["index"] for r in out} == {"apple": 0, "fig": 1, "pear": 2, "äpfel": 3}


def test_a_value_that_most_rows_hold(spark):
    values = [0.0] * 300 + [float(i % 7) for i in range(90)] + [None] * 5
    rows = pd.DataFrame({"id": range(len(values)), "v": values})
    out = o.average_rank(spark.createDataFrame(rows).withColumn("v", F.nanvl("v", F.lit(None))), "v").toPandas()
    want = rows.v.rank(method="average")
    got = out.set_index("id").sort_index().avg_rank
    assert np.allclose(got.fillna(-1), want.fillna(-1))


def test_empty_input(spark):
    empty = spark.createDataFrame([], "id bigint, g int, v double")
    assert o.average_rank(empty, "v").count() == 0
    assert o.exact_quantiles(empty, "v", {"q": 0.5}, ["g"]).count() == 0
    assert o.dense_index(empty, "v").count() == 0


@pytest.mark.parametrize("kind", ["hot", "spread", "few"])
def test_selected_quantiles(spark, frame, kind):
    values = {"hot": frame.v, "spread": pd.Series(np.random.default_rng(5).normal(size=60_000)), "few": pd.Series([3.0, 1.0, 2.0, 10.0])}[kind]
    wanted = {"low": 0.0, "q1": 0.25, "mid": 0.5, "near": 0.503, "top": 0.999, "high": 1.0}
    df = spark.createDataFrame(pd.DataFrame({"v": values})).repartition(5).union(spark.createDataFrame([(None,)], "v double"))
    row = o.selected_quantiles(df, "v", wanted).first()
    for name, q in wanted.items():
        assert row[name] == pytest.approx(values.quantile(q), rel=1e-12, abs=1e-12), name


def test_selected_quantiles_where_a_sketch_does_not_help(spark, monkeypatch):
    assert o.selected_quantiles(spark.createDataFrame([(None,)], "v double"), "v", {"mid": 0.5}).first().mid is None
    odd = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "v double")
    assert o.selected_quantiles(odd, "v", {"mid": 0.5}).first().mid == 2.0
    monkeypatch.setattr(o, "MARGIN", -0.2)  # brackets that miss
    df = spark.createDataFrame([(float(i),) for i in range(100)], "v double")
    assert o.selected_quantiles(df, "v", {"mid": 0.5}).first().mid == 49.5
