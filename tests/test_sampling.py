"""Splits, folds, samples, resampling and encodings: sizes, determinism, edge cases."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import sampling as sa


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    label = np.where(rng.random(2000) < 0.6, "hot", rng.choice(["a", "b", "rare"], 2000, p=[0.6, 0.39, 0.01]))
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(2000), "label": label}))


WEIGHTS = {"train": 0.7, "val": 0.15, "test": 0.15}


@pytest.mark.parametrize("order", [sa.hashed, sa.arithmetic])
def test_split_is_exact_in_every_class(rows, order):
    out = sa.stratified_split(rows, "label", "id", WEIGHTS, order("id", 42)).toPandas()
    assert len(out) == 2000 and out.id.is_unique
    for _, part in out.groupby("label"):
        n, sizes = len(part), part.split.value_counts()
        assert sizes.get("train", 0) == math.floor(0.7 * n + 0.5)
        assert sizes.get("train", 0) + sizes.get("val", 0) == math.floor(0.85 * n + 0.5)


def test_same_seed_same_split_however_partitioned(rows):
    a = sa.stratified_split(rows, "label", "id", WEIGHTS, sa.hashed("id", 1)).toPandas()
    b = sa.stratified_split(rows.repartition(13), "label", "id", WEIGHTS, sa.hashed("id", 1)).toPandas()
    assert a.set_index("id").split.sort_index().equals(b.set_index("id").split.sort_index())


def test_folds_are_even(rows):
    sizes = sa.kfold(rows, "id", 7, sa.hashed("id", 7)).groupBy("fold").count().toPandas()["count"]
    assert len(sizes) == 7 and sizes.max() - sizes.min() <= 1 and sizes.sum() == 2000


def test_samples(rows):
    out = sa.sample_per_group(rows, "label", "id", 20, sa.hashed("id", 3)).groupBy("label").count().collect()
    counts = {r.label: r["count"] for r in out}
    rare = rows.where("label = 'rare'").count()
    assert counts == {"hot": 20, "a": 20, "b": 20, "rare": min(20, rare)}
    assert sa.sample_total(rows, "id", 50, sa.hashed("id", 3)).count() == 50


def test_weights_sum_to_one_per_class(rows):
    out = sa.class_weights(rows, "label").groupBy("label").agg(F.sum("weight").alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in out)


@pytest.mark.parametrize("draws_per_copy", [20, 100_000])
def test_resample_keeps_size_and_balances(rows, draws_per_copy):
    draw = lambda seed: F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 1)
    out = sa.balanced_resample(rows, "label", "id", draw(1), draw(2), sa.hashed("id", 3), draws_per_copy).toPandas()
    assert len(out) == 2000 and out.draw_id.is_unique
    known = {r.id: r.label for r in rows.collect()}
    assert all(known[i] == l for i, l in zip(out.id, out.label))
    assert out.label.value_counts().between(400, 600).all()


@pytest.fixture(scope="module")
def encoded(spark):
    data = [
        (1, "a", 1.0, 0), (2, "a", 3.0, 1), (3, "a", 5.0, 1),
        (4, "once", 7.0, 0),   # key seen in one fold only
        (5, None, 9.0, 1),     # no key
    ]
    df = spark.createDataFrame(data, "id int, k string, y double, fold int")
    return df, {r.id: r.te_k for r in sa.encode_out_of_fold(df, "id", ["k"], "y").collect()}


def test_own_fold_is_left_out(encoded):
    _, te = encoded
    assert te[1] == 4.0 and te[2] == 1.0 and te[3] == 1.0


def test_unseen_and_missing_keys_get_the_mean_of_all_rows(encoded):
    _, te = encoded
    assert te[4] == 5.0 and te[5] == 5.0


def test_full_encoding(encoded, spark):
    train, _ = encoded
    test = spark.createDataFrame([(1, "a"), (2, "new"), (3, None)], "id int, k string")
    assert {r.k: r.te_k for r in sa.encode_full(train, test, "id", ["k"], "y").collect()} == {"a": 3.0, "new": 5.0, None: 5.0}


def test_draws_are_independent_and_reach_every_item(spark):
    """Distinct items per class as drawing with replacement gives them, in the registered query."""
    import math

    import __spark_entry__ as entry

    out = entry.queries()["weighted_resample"](spark, "/root/testdata/sf0.1").toPandas()
    sizes = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").groupBy("lang").count().toPandas()
    for lang, size in zip(sizes["lang"], sizes["count"]):
        own = out[out.category == lang]
        expected = size * (1 - math.exp(-len(own) / size))
        assert abs(own.item_id.nunique() - expected) < 0.05 * expected
        assert abs(len(own) - len(out) / len(sizes)) < 0.05 * len(out) / len(sizes)


def test_draws_cover_classes_of_any_size(spark):
    """Row numbers drawn for a class of 2,500,000 rows reach its end."""
    highest = spark.range(100_000).select(F.max(sa.draw("id", 3) % 2_500_000 + 1)).first()[0]
    assert highest > 2_499_000
