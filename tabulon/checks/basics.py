"""Steps and row/column transforms (P, T)."""

from pyspark.sql import functions as F

from tabulon.checks.registry import check
from tabulon.operators import transforms as T
from tabulon.plans.steps import Steps, column_quality


def order_steps(t):
    return (
        Steps(t.orders)
        .add("Filtered Rows", lambda d: T.filter_rows(d, "o_totalprice", "gt", "100000"))
        .add("Renamed Columns", lambda d: T.rename_columns(d, {"o_totalprice": "price"}))
        .add("Added Custom", lambda d: T.custom_column(d, "net", "price * 2"))
        .add("Removed Columns", lambda d: T.remove_columns(d, "o_orderpriority"))
    )


_STEP_SQL = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice AS price, o_orderdate{extra}
FROM orders WHERE o_totalprice > 100000"""


@check("pipe_run", _STEP_SQL.format(extra=", o_totalprice * 2 AS net"))
def _(t):
    return order_steps(t).run()


@check("pipe_upto", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice AS price, o_orderdate, o_orderpriority FROM orders WHERE o_totalprice > 100000")
def _(t):
    return order_steps(t).upto("Renamed Columns").run()


@check("pipe_preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000")
def _(t):
    return Steps(t.orders).preview(order_by=["o_orderkey"])


@check(
    "pipe_ref",
    "SELECT o_orderstatus, count(*) AS Count FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus",
)
def _(t):
    base = order_steps(t)
    return Steps(base).add("Grouped Rows", lambda d: T.group_by(d, "o_orderstatus", [("count", None)])).run()


@check(
    "profile_quality",
    """SELECT 'raw' AS "column", count(*) FILTER (p_size % 7 <> 0 AND p_size % 5 = 0) AS valid,
 count(*) FILTER (p_size % 7 = 0) AS empty, count(*) FILTER (p_size % 7 <> 0 AND p_size % 5 <> 0) AS error FROM part
UNION ALL SELECT 'p_brand', count(p_brand), count(*) - count(p_brand), 0 FROM part""",
)
def _(t):
    raw = (
        F.when(F.col("p_size") % 7 == 0, F.lit(None))
        .when(F.col("p_size") % 5 == 0, F.col("p_size").cast("string"))
        .otherwise(F.col("p_name"))
    )
    return column_quality(t.part.select(raw.alias("raw"), "p_brand"), {"raw": "number"})


@check("t_remove_cols", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(t):
    return T.remove_columns(t.customer, "c_nationkey", "c_mktsegment")


@check("t_choose_cols", "SELECT c_name, c_custkey FROM customer")
def _(t):
    return T.choose_columns(t.customer, "c_name", "c_custkey")


@check("t_rename", "SELECT p_partkey AS id, p_name AS label, p_brand, p_type, p_size, p_retailprice FROM part")
def _(t):
    return T.rename_columns(t.part, {"p_partkey": "id", "p_name": "label"})


@check(
    "t_custom_col",
    "SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem",
)
def _(t):
    d = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax")
    d = T.custom_column(d, "charge", "l_extendedprice * (1 - l_discount) * (1 + l_tax)")
    return d.select("l_orderkey", "l_partkey", "l_linenumber", "charge")


@check(
    "t_filter_rows",
    """SELECT 'eq' AS op, count(*) AS n FROM part WHERE p_size = 10 UNION ALL
SELECT 'ne', count(*) FROM part WHERE p_size <> 10 UNION ALL SELECT 'gt', count(*) FROM part WHERE p_size > 10 UNION ALL
SELECT 'ge', count(*) FROM part WHERE p_size >= 10 UNION ALL SELECT 'lt', count(*) FROM part WHERE p_size < 10 UNION ALL
SELECT 'le', count(*) FROM part WHERE p_size <= 10 UNION ALL
SELECT 'contains', count(*) FROM part WHERE contains(p_name, 'ring') UNION ALL
SELECT 'starts', count(*) FROM part WHERE starts_with(p_name, 'red') UNION ALL
SELECT 'ends', count(*) FROM part WHERE ends_with(p_name, 'bolt')""",
)
def _(t):
    cases = [(op, "p_size", "10") for op in ("eq", "ne", "gt", "ge", "lt", "le")]
    cases += [("contains", "p_name", "ring"), ("starts", "p_name", "red"), ("ends", "p_name", "bolt")]
    out = None
    for op, col, value in cases:
        one = T.filter_rows(t.part, col, op, value).agg(F.lit(op).alias("op"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@check("t_sort", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def _(t):
    return T.sort_rows(t.orders, "o_totalprice", descending=True, order_by=["o_orderkey"])


@check("t_keep_top", "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25")
def _(t):
    return T.keep_top(t.orders, 25, ["o_orderdate", "o_orderkey"])


@check("t_keep_bottom", "SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25")
def _(t):
    return T.keep_bottom(t.orders, 25, ["o_orderdate", "o_orderkey"])


@check("t_skip_top", "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey OFFSET 25")
def _(t):
    return T.remove_top(t.orders, 25, ["o_orderdate", "o_orderkey"])


@check("t_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, l_discount FROM lineitem")
def _(t):
    return T.remove_duplicates(t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber", "l_discount"))


@check(
    "t_reverse",
    "SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey DESC) - 1 AS \"Index\" FROM part",
)
def _(t):
    return T.reverse_rows(t.part.select("p_partkey", "p_name"), ["p_partkey"])


@check(
    "t_change_type",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, TRY_CAST(split_part(o_orderpriority, '-', 1) AS BIGINT) AS rank,
 TRY_CAST(o_orderpriority AS DOUBLE) AS bad, CAST(round_even(o_totalprice, 0) AS BIGINT) AS o_totalprice FROM orders""",
)
def _(t):
    d = t.orders.select(
        "o_orderkey",
        "o_orderdate",
        F.substring_index("o_orderpriority", "-", 1).alias("rank"),
        F.col("o_orderpriority").alias("bad"),
        "o_totalprice",
    )
    for col, kind in (("o_orderdate", "date"), ("rank", "whole"), ("bad", "number"), ("o_totalprice", "whole")):
        d = T.change_type(d, col, kind)
    return d


@check(
    "t_replace_values",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Done' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_custkey = 7 THEN 0 ELSE o_custkey END AS o_custkey FROM orders",
)
def _(t):
    d = t.orders.select("o_orderkey", "o_orderstatus", "o_custkey")
    return T.replace_values(T.replace_values(d, "o_orderstatus", "F", "Done"), "o_custkey", "7", "0")


@check(
    "t_split_col",
    """SELECT p_partkey, split_part(p_name, ' ', 1) AS "p_name.1", nullif(split_part(p_name, ' ', 2), '') AS "p_name.2",
 CAST(NULL AS VARCHAR) AS "p_name.3" FROM part""",
)
def _(t):
    return T.split_column(t.part.select("p_partkey", "p_name"), "p_name", " ", 3)


@check(
    "t_group_by",
    """SELECT l_returnflag, l_linestatus, count(*) AS "Count", sum(l_quantity) AS "Sum of l_quantity",
 max(l_extendedprice) AS "Max of l_extendedprice", min(l_discount) AS "Min of l_discount",
 round(avg(l_quantity), 4) AS "Average of l_quantity" FROM lineitem GROUP BY 1, 2""",
)
def _(t):
    d = T.group_by(
        t.lineitem,
        ["l_returnflag", "l_linestatus"],
        [("count", None), ("sum", "l_quantity"), ("max", "l_extendedprice"), ("min", "l_discount"), ("avg", "l_quantity")],
    )
    return d.withColumn("Average of l_quantity", F.round("`Average of l_quantity`", 4))


@check("t_index_col", 'SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS "Index" FROM orders')
def _(t):
    d = t.orders.select("o_orderkey", "o_totalprice", "o_orderdate")
    return T.index_column(d, ["o_orderdate", "o_orderkey"], 1).drop("o_orderdate")


@check(
    "t_transpose",
    """WITH s AS (SELECT o_orderpriority AS k, count(*) AS n, max(o_totalprice) AS m FROM orders GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY k) AS i FROM s)
SELECT 'k' AS "Column", max(k) FILTER (i = 1) AS "Column1", max(k) FILTER (i = 2) AS "Column2", max(k) FILTER (i = 3) AS "Column3",
 max(k) FILTER (i = 4) AS "Column4", max(k) FILTER (i = 5) AS "Column5" FROM r
UNION ALL SELECT 'n', max(CAST(n AS VARCHAR)) FILTER (i = 1), max(CAST(n AS VARCHAR)) FILTER (i = 2), max(CAST(n AS VARCHAR)) FILTER (i = 3),
 max(CAST(n AS VARCHAR)) FILTER (i = 4), max(CAST(n AS VARCHAR)) FILTER (i = 5) FROM r
UNION ALL SELECT 'm', max(CAST(m AS VARCHAR)) FILTER (i = 1), max(CAST(m AS VARCHAR)) FILTER (i = 2), max(CAST(m AS VARCHAR)) FILTER (i = 3),
 max(CAST(m AS VARCHAR)) FILTER (i = 4), max(CAST(m AS VARCHAR)) FILTER (i = 5) FROM r""",
)
def _(t):
    summary = t.orders.groupBy(F.col("o_orderpriority").alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("m")
    )
    return T.transpose(summary, ["k"])


@check(
    "t_promote_headers",
    """SELECT c_custkey AS "0", c_name AS "Customer#000000000" FROM customer WHERE c_custkey > 0""",
)
def _(t):
    return T.promote_headers(t.customer.select("c_custkey", "c_name"), ["c_custkey"])


@check(
    "t_unpivot",
    """SELECT p_partkey, 'p_size' AS "Attribute", CAST(p_size AS DOUBLE) AS "Value" FROM part UNION ALL
SELECT p_partkey, 'p_retailprice', p_retailprice FROM part""",
)
def _(t):
    return T.unpivot_others(t.part.select("p_partkey", "p_size", "p_retailprice"), ["p_partkey"])
