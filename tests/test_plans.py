"""Filters and column lists must reach the Parquet scan; row order must not need a single task."""

import pytest
from pyspark.sql import functions as F

from tabulon.operators import aggregates as A
from tabulon.operators import filters as X
from tabulon.operators import pivot as V
from tabulon.operators import rules as R
from tabulon.operators import transforms as T
from tabulon.operators.criteria import matches


@pytest.fixture
def orders(spark):
    return spark.read.parquet("/root/testdata/sf0.001/orders.parquet")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def text(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize(
    "make,pushed",
    [
        (lambda d: T.filter_rows(d, "o_totalprice", "gt", "100"), "GreaterThan(o_totalprice,100.0)"),
        (lambda d: T.filter_rows(d, "o_orderpriority", "starts", "1"), "StringStartsWith(o_orderpriority,1)"),
        (lambda d: d.where(matches(d, "o_totalprice", ">=100")), "GreaterThanOrEqual(o_totalprice,100.0)"),
        (lambda d: X.timeline(d, "o_orderdate", "1997-01-01", "1998-01-01"), "LessThan(o_orderdate,1998-01-01"),
        (lambda d: X.slicer(d, "o_orderstatus", ["F", "P"]), "In(o_orderstatus, [F,P])"),
        (lambda d: X.value_filter(d, {"o_orderstatus": ["F"]}), "o_orderstatus,F)"),
        (lambda d: d.where(R.cell_is(F.col("o_totalprice"), "greaterThan", 5.0)), "GreaterThan(o_totalprice,5.0)"),
    ],
)
def test_filters_are_pushed(orders, make, pushed):
    assert pushed in text(make(orders)).split("PushedFilters", 1)[1].splitlines()[0]


def test_only_needed_columns_are_read(orders):
    spec = V.PivotSpec(("o_orderstatus",), (), (V.Value("o_totalprice"),))
    scan = text(V.compute(orders, spec))
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double>" in scan
    scan = text(orders.agg(A.sum_if(orders, "o_totalprice", [("o_custkey", ">5")])))
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in scan


def test_aggregates_combine_before_the_shuffle(orders):
    got = plan(A.basic(orders, "o_totalprice", ["o_orderstatus"]))
    assert "partial_sum" in got and got.count("Exchange") == 1
    top = plan(T.keep_top(orders, 10, ["o_orderdate", "o_orderkey"]))
    assert "TakeOrderedAndProject" in top and "Exchange" not in top


def test_pivot_aggregates_to_the_full_key_before_expanding(orders):
    got = plan(V.compute(orders, V.PivotSpec(("o_orderstatus",), ("o_orderpriority",), (V.Value("o_totalprice"),))))
    assert got.index("Expand") < got.index("Scan parquet") and "SinglePartition" not in got


def test_row_index_sorts_in_parallel(orders):
    got = plan(T.index_column(orders, ["o_orderdate", "o_orderkey"]))
    assert "BroadcastHashJoin" in got  # block starts: one row per range partition
    assert got.count("SinglePartition") == 1 and "__rows" in got.split("SinglePartition", 1)[1].splitlines()[1]
