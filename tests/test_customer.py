"""Null, tie and division rules of the customer features on hand-made rows."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import customer as cv

SCHEMA = (
    "cust_id bigint, sale_id bigint, prod_id bigint, order_date date, sale_revenue decimal(18,4),"
    " sale_discount decimal(18,4), returned_to bigint, web_only int, outlet int, brand string, size string,"
    " color string, category string, fine_category string, season string"
)


def item(cust, sale, day, revenue=10, brand="b", category="c", fine="f", season="S1", returned=None, prod=1, discount=-1):
    money = None if revenue is None else Decimal(revenue)
    return (cust, sale, prod, dt.date.fromisoformat(day), money, Decimal(discount), returned, 1, 0, brand, "1", "red",
            category, fine, season)


ROWS = [
    item(1, 10, "1999-03-01", revenue=7),                       # one order only
    item(2, 20, "1999-05-01"), item(2, 21, "1999-05-01"),        # two orders on one day
    item(3, 30, "2000-01-31", brand=None, category=None, season=None, fine=None),
    item(4, 40, "2000-02-01", revenue=None), item(4, 41, "2000-03-01", revenue=None),  # no revenue at all
    item(5, 50, "1999-01-01", brand="z"), item(5, 51, "1999-01-11", brand="a"), item(5, 51, "1999-01-11", brand="z"),
    item(5, 52, "1999-02-10", brand="a", returned=9),            # two brands tied
    item(None, 60, "2000-12-31"),                                # no customer
]


@pytest.fixture(scope="module")
def tx(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def orders(tx):
    return cv.order_rollup(tx)


@pytest.fixture(scope="module")
def matrix(tx, orders):
    out = cv.feature_matrix(tx, orders, cv.as_of(orders), (1999, 2000), ["C", "c"], ["S1", "S2"])
    return {r.cust_id: r.asDict() for r in out.collect()}


def test_rows_without_customer_are_dropped(orders, matrix):
    assert orders.where(F.col("cust_id").isNull()).count() == 0
    assert sorted(matrix) == [1, 2, 3, 4, 5]


def test_reference_date_is_day_after_last_order(orders):
    assert cv.reference_date(orders).first()[0] == dt.date(2000, 3, 2)


def test_fixed_vocabularies_make_no_rows_per_value(tx):
    """Shares of listed values come with the item aggregate: no exploded row names a category or a season."""
    made = cv.item_features(tx, ["other", "c"], ["S1", "S2"])
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    exploded = [line for line in plan.splitlines() if "Generate explode" in line]
    assert exploded and not any("category" in line or "season" in line for line in exploded)
    names = ["cat_other", "cat_c", "season_s1", "season_s2"]
    long = cv.shares(tx, ["category", "season"]).groupBy("cust_id").agg(
        *cv.pivot_aggregates("category", ["other", "c"], "cat"), *cv.pivot_aggregates("season", ["S1", "S2"], "season")
    )
    want = {r.cust_id: [r[n] for n in names] for r in long.collect()}
    got = {r.cust_id: [r[n] for n in names] for r in made.collect()}
    assert got == want | {3: [None] * 4} and got[5] == [0.0, 1.0, 1.0, 0.0]


def test_single_order_has_null_gaps_and_deviation(matrix):
    for column in ("avg_ipt", "std_ipt", "min_ipt", "max_ipt", "std_order_val", "recency_ipt_ratio", "ript_sq"):
        assert matrix[1][column] is None
    assert matrix[1]["skipped_1_cycle"] == 0


def test_same_day_orders_have_gap_zero(matrix):
    assert (matrix[2]["avg_ipt"], matrix[2]["min_ipt"], matrix[2]["max_ipt"]) == (0.0, 0, 0)
    assert matrix[2]["std_ipt"] is None and matrix[2]["frequency"] == 2


def test_gap_statistics(matrix, orders):
    gaps = sorted(r.gap_days for r in cv.purchase_gaps(orders).where("cust_id = 5").collect())
    assert gaps == [10, 30]
    assert matrix[5]["avg_ipt"] == 20.0 and matrix[5]["std_ipt"] == pytest.approx(200**0.5)
    assert matrix[5]["n_active_months"] == 2


def test_missing_keys_leave_shares_null(matrix):
    assert matrix[3]["brand_entropy"] is None and matrix[3]["cat_c"] is None and matrix[3]["n_unique_brands"] == 0
    assert matrix[1]["cat_c"] in (0.0, 1.0) and matrix[1]["season_s2"] == 0.0


def test_sum_of_nulls_is_zero(matrix):
    assert matrix[4]["monetary"] == 0.0 and matrix[4]["avg_item_price"] == 0.0
    assert matrix[4]["total_discount"] == -2.0


def test_customer_absent_from_last_year(matrix):
    assert matrix[1]["revenue_y2"] == 0.0 and matrix[1]["orders_y2"] == 0 and matrix[1]["active_in_y2"] == 0


def test_max_discount_is_the_minimum(tx):
    rows = tx.where("cust_id = 5").withColumn("sale_discount", -F.col("sale_id").cast("decimal(18,4)"))
    out = cv.customer_aggregate(cv.order_rollup(rows), cv.discount_aggregates()).first()
    assert out.max_discount == -102.0 and out.n_returns == 1


def test_tied_brand_takes_the_smaller_name(tx):
    top = {r.cust_id: r for r in cv.top_values(tx, cv.encoding_keys(2000)).collect()}
    assert top[5].top_brand == "a" and top[5].top_brand_y2 is None
    assert top[3].top_brand is None and top[3].top_fine_cat == "unknown"


def test_median_equals_built_in(orders):
    own = {r.cust_id: r.median_order_val for r in cv.median_order_value(orders).collect()}
    built_in = orders.groupBy("cust_id").agg(F.percentile(F.col("order_revenue").cast("double"), 0.5).alias("m")).collect()
    assert own == {r.cust_id: r.m for r in built_in if r.m is not None}


def test_weekday_starts_monday(tx):
    day = cv.derive_columns(tx).where("sale_id = 10").first()
    assert day.order_weekday == dt.date(1999, 3, 1).weekday() and day.is_returned == 0


def test_lookup_default(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    table = spark.createDataFrame([("a", 1.0)], "k string, v double")
    out = {r.k: r.v for r in cv.lookup(df, "k", table, "v", F.lit(-1.0)).collect()}
    assert out == {"a": 1.0, "b": -1.0, None: -1.0}


def test_quarter_filter_bounds(spark):
    days = ["1999-12-31", "2000-01-01", "2000-03-31", "2000-04-01", "2000-12-31", "2001-01-01"]
    df = spark.createDataFrame([(dt.date.fromisoformat(d),) for d in days], "order_date date")
    assert cv.filter_period(df, 2000).count() == 4
    assert cv.filter_period(df, 2000, 1).count() == 2


def test_counts_of_values_begin_with_rows_dealt_over_all_partitions(spark):
    """Also those of one busy customer; an aggregate over undealt rows holds whatever a task has read."""
    from tallyloom.session import bucket_count

    rows = [(1, f"b{i % 7}", "c") for i in range(700)] + [(2, "x", None), (None, "x", "c"), (3, None, None)]
    tx = spark.createDataFrame(rows, "cust_id int, brand string, category string")
    entries = cv._entries(tx, {"brand": F.col("brand"), "category": F.col("category")})
    assert f"{bucket_count(tx)}), REPARTITION_BY_NUM" in entries._jdf.queryExecution().toString()
    got = {(r.cust_id, r.kind, r.value): r.n for r in entries.collect()}
    assert got == {**{(1, "brand", f"b{i}"): 100 for i in range(7)}, (1, "category", "c"): 700, (2, "brand", "x"): 1}


def _moves(df):
    """Shuffles by customer in a plan, those of the ranges of medians aside."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning(cust_id" in line and "_bucket" not in line]


def test_features_of_dealt_tables_move_no_rows_by_customer(spark, tx, orders, matrix):
    from tallyloom.session import dealt

    lines = dealt(tx.where("cust_id is not null"), "lines", "cust_id")
    made = dealt(cv.order_rollup(lines), "orders", "cust_id")
    df = cv.feature_matrix(lines, made, cv.as_of(made), (1999, 2000), ["C", "c"], ["S1", "S2"], dealt=True)
    assert not _moves(df) and not _moves(cv.top_values(lines, cv.encoding_keys(2000), dealt=True))
    assert _moves(cv.feature_matrix(tx, orders, cv.as_of(orders), (1999, 2000), ["C", "c"], ["S1", "S2"]))
    short = lambda row: {c: round(v, 9) if isinstance(v, float) else v for c, v in row.items()}
    assert {r.cust_id: short(r.asDict()) for r in df.collect()} == {c: short(row) for c, row in matrix.items()}
    assert not spark.sql("SHOW TABLES LIKE 'tallyloom*'").count()  # scratch tables leave no names behind


def test_kept_lines_give_the_same_encoding_keys(spark, tmp_path):
    """Items of unknown products count for the cohort only, items and customers without a key nowhere."""
    from tallyloom.plans.customer import dealt_lines, encoding_input

    day = lambda text: dt.datetime.fromisoformat(text)
    tables = {
        "customer": ([(1,), (2,), (3,), (3,), (None,)], "c_custkey long"),
        "orders": ([(10, 1, 5.0, day("1999-01-05")), (11, 1, 7.0, day("2000-06-01")), (12, 2, 1.0, day("1999-08-01")),
                    (13, None, 1.0, day("1999-08-01")), (14, 3, 9.0, day("2001-02-01")), (None, 2, 1.0, day("1998-01-01"))],
                   "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp"),
        "part": ([(7, "red shoe x", "B1", "PROMO", 3), (8, "blue hat", "B2", "SMALL", 4)],
                 "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
        "lineitem": ([(o, p, 1, 2.0, 0.5, "R", "O", day("1999-01-06")) for o, p in
                      [(10, 99), (11, 7), (11, 8), (11, 7), (12, 99), (12, None), (13, 7), (14, 8), (None, 7)]],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_extendedprice double, l_discount double, l_returnflag string,"
                     " l_linestatus string, l_shipdate timestamp"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    plain = lambda df: sorted(map(str, df.collect()))
    got = plain(encoding_input(spark, str(tmp_path), dealt_lines(spark, str(tmp_path), "fine_category")))
    assert got == plain(encoding_input(spark, str(tmp_path))) and len(got) == 5 and "1999Q1" in got[0] and "top_brand='B1'" in got[0]
