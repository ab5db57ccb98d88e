"""Registered queries against their SQL on rows that the shared tables hold at larger sizes only."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabulon.checks import load
from tabulon.operators import cashflows as C
from verify import TABLES, compare

QUERIES, ORACLES = load()
SMALL = "/root/testdata/sf0.001"


def agrees(spark, tmp_path, name, **tables):
    """Compare a query with its SQL on the smallest tables, some of them replaced."""
    for t in TABLES.split():
        if t in tables:
            tables[t].toPandas().to_parquet(tmp_path / f"{t}.parquet", coerce_timestamps="us")
        else:
            (tmp_path / f"{t}.parquet").symlink_to(f"{SMALL}/{t}.parquet")
    note, ok = compare(spark, str(tmp_path), QUERIES[name], ORACLES[name])
    assert ok, note


_DAYS = [0, 239, 532, 722, 1060, 1133, 1239, 1568, 1584, 1609, 1624, 1634, 1812]
_PAID = [374050.57, 54432.0375, 88895.285, 67314.1675, 26896.805, 99514.0225, 91173.0075, 8508.365, 30042.81, 6948.99, 90254.0825, 71999.92, 37124.3225]


@pytest.mark.parametrize("listed", [4096, 1])
def test_dated_rates_near_a_rounding_border_and_beyond_the_range(spark, tmp_path, monkeypatch, listed):
    """0.09944766649998 shows as 0.099447666; a rate of 9.4e11 is past what the SQL shows, 8.7e11 is not."""
    monkeypatch.setattr(C, "_LISTED", listed)
    one = lambda c, flows: [(c, d, v if i == 0 else 4 * v) for i, (d, v) in enumerate(flows)]
    grown = lambda rate: [(0, 1000.0), (30, 1000.0 * (1 + rate) ** (30 / 365))]
    rows = one(1, list(zip(_DAYS, _PAID))) + one(2, grown(9.4e11)) + one(3, grown(8.7e11)) + one(4, [(0, 5.0)])
    start = dt.datetime(1992, 1, 1)
    rows = [(i, c, v, start + dt.timedelta(days=d)) for i, (c, d, v) in enumerate(rows)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz")
    agrees(spark, tmp_path, "a_xirr", orders=orders)


def test_moments_at_midnight_keep_their_time(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 11)), (2, dt.datetime(2024, 1, 11, 0, 0, 1)), (3, dt.datetime(2024, 2, 29, 23, 59, 59))]
    agrees(spark, tmp_path, "f_iso", events=spark.createDataFrame(rows, "event_id long, ts timestamp_ntz"))


def test_reported_amounts_keep_their_point(spark, tmp_path):
    debts = [-660.0, -0.5, -0.0, 12.0, -0.00025, -0.00001, -1.25e7, -123456789012.0, -1e16, -1.5e300, float("-inf"), -10.0]
    rows = [(i, f"Customer#{i}", i % 25, v, "BUILDING" if i % 2 else "FURNITURE") for i, v in enumerate(debts)]
    agrees(spark, tmp_path, "q_report", customer=spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"))


def test_error_bars_of_no_length_end_at_the_value(spark, tmp_path):
    rows = [(1, "a", 0.0), (2, "a", 4.0), (3, "even", 2.0), (4, "even", 2.0), (5, "one", 7.0)]
    agrees(spark, tmp_path, "w_error_bars", events=spark.createDataFrame(rows, "event_id long, event_type string, value double"))
