"""Every query with a SQL twin gives exactly its rows on the smallest bundled data."""

import os

import pytest
from parity import compare, duck

import __spark_entry__ as entry
from tallyloom.plans.registry import ORACLES, PLANS

SF = "/root/testdata/sf0.001"
FITS = [
    "approx_cosine_topk", "text_vectorize_corpus", "two_stage_revenue", "log_target_regression_cv",
    "tweedie_regression", "linear_probe", "feature_importance_top25",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="bundled tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_only_fits_lack_sql():
    assert sorted(set(PLANS) - set(ORACLES)) == sorted(FITS)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    df = PLANS[name](spark, SF)
    assert compare(df.collect(), df.schema, con, ORACLES[name]) == ""


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert len(df.columns) == 1 + 101 + 6 + 4


def test_entry_names_every_query():
    assert set(PLANS) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
