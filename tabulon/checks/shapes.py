"""Sorting, de-duplication and reshaping (O, D)."""

from pyspark.sql import functions as F

from tabulon.checks.registry import check
from tabulon.operators import shaping as S
from tabulon.scale.ordering import row_index


def in_order(df):
    """``df`` with the place of each row in its own output order."""
    return row_index(df.withColumn("__made", F.monotonically_increasing_id()), ["__made"], "pos", 1).drop("__made")


@check(
    "o_sort_multi",
    """SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg, c_acctbal,
 row_number() OVER (ORDER BY nullif(c_mktsegment, 'BUILDING') ASC NULLS LAST, c_acctbal DESC NULLS LAST, c_custkey) AS pos FROM customer""",
)
def _(t):
    seg = F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment"))
    d = t.customer.select("c_custkey", seg.alias("seg"), "c_acctbal")
    ordered = S.sort_multi(d, [("seg", True), ("c_acctbal", False)], ["c_custkey"])
    return in_order(ordered).withColumn("seg", F.expr("nullif(seg, '')"))


@check(
    "o_sort_mixed",
    """WITH k AS (SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN CAST(p_size AS VARCHAR) WHEN p_size % 10 = 1 THEN ''
 ELSE p_brand || ' ' || p_size END AS label FROM part)
SELECT p_partkey, label, row_number() OVER (ORDER BY (label = ''), TRY_CAST(label AS DOUBLE) IS NULL, TRY_CAST(label AS DOUBLE),
 regexp_extract(label, '#(\\d+)', 1) = '', TRY_CAST(regexp_extract(label, '#(\\d+)', 1) AS INT), TRY_CAST(regexp_extract(label, ' (\\d+)', 1) AS INT), p_partkey) AS pos FROM k""",
)
def _(t):
    label = (
        F.when(F.col("p_size") % 10 == 0, F.col("p_size").cast("string"))
        .when(F.col("p_size") % 10 == 1, "")
        .otherwise(F.concat_ws(" ", "p_brand", "p_size"))
    )
    d = t.part.select("p_partkey", label.alias("label"))
    return in_order(S.sort_mixed(d, "label", ["p_partkey"]))


@check(
    "o_dedupe_first",
    "SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) = 1",
)
def _(t):
    return S.dedupe_first(t.orders, ["o_custkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"])


@check(
    "o_append",
    """SELECT c_custkey AS id, c_name AS name, c_acctbal AS bal, c_mktsegment AS segment FROM customer UNION ALL
SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier""",
)
def _(t):
    a = t.customer.selectExpr("c_custkey id", "c_name name", "c_acctbal bal", "c_mktsegment segment")
    return S.append(a, t.supplier.selectExpr("s_suppkey id", "s_name name", "s_acctbal bal"))


@check(
    "o_text_to_columns",
    """SELECT o_orderkey, o_orderpriority, split_part(replace(o_orderpriority, ' ', '-'), '-', 1) AS o_orderpriority_1,
 split_part(replace(o_orderpriority, ' ', '-'), '-', 2) AS o_orderpriority_2,
 nullif(split_part(replace(o_orderpriority, ' ', '-'), '-', 3), '') AS o_orderpriority_3 FROM orders""",
)
def _(t):
    return S.text_to_columns(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["-", " "])


@check(
    "d_unique",
    """SELECT user_id, event_type, row_number() OVER (ORDER BY f) AS pos FROM
 (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY 1, 2)""",
)
def _(t):
    return in_order(S.unique_rows(t.events.select("event_id", "user_id", "event_type"), ["event_id"]))


@check(
    "d_sortby",
    "SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS pos FROM part",
)
def _(t):
    keys = [F.col("p_retailprice").desc()]
    d = S.sort_by(t.part.select("p_partkey", "p_name", "p_retailprice"), keys, ["p_partkey"])
    return in_order(d).drop("p_retailprice")


@check("d_filter", "SELECT event_id, value FROM events WHERE event_id % 3 <> 0")
def _(t):
    return S.filter_mask(t.events.select("event_id", "value"), F.col("event_id") % 3)


@check(
    "d_sequence",
    """SELECT i AS row, CAST(10 + i * 3 * 2 AS BIGINT) AS c1, CAST(10 + (i * 3 + 1) * 2 AS BIGINT) AS c2, CAST(10 + (i * 3 + 2) * 2 AS BIGINT) AS c3
FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)""",
)
def _(t):
    numbered = row_index(t.orders.select("o_orderkey"), ["o_orderkey"], "row")
    return S.sequence_columns(numbered, "row", cols=3, start=10, step=2)


@check(
    "d_take_drop",
    """(SELECT 'take' AS op, event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 30)
UNION ALL (SELECT 'drop', event_id FROM events ORDER BY ts DESC, event_id DESC OFFSET 40)""",
)
def _(t):
    d = t.events.select("ts", "event_id")
    a = S.take(d, -30, ["ts", "event_id"]).select(F.lit("take").alias("op"), "event_id")
    return a.unionByName(S.drop_rows(d, -40, ["ts", "event_id"]).select(F.lit("drop").alias("op"), "event_id"))


@check(
    "d_choose",
    """WITH r AS (SELECT p_name, p_partkey, row_number() OVER (ORDER BY p_partkey) AS i, count(*) OVER () AS n FROM part)
SELECT p.k AS pick, p_name, p_partkey FROM r JOIN (VALUES (1, 3), (2, 1), (3, -1), (4, 3)) p(k, pos)
 ON i = CASE WHEN pos < 0 THEN n + 1 + pos ELSE pos END""",
)
def _(t):
    d = S.choose_cols(t.part, [2, 1])
    return S.choose_rows(d, [3, 1, -1, 3], ["p_partkey"])


@check(
    "d_stack",
    """WITH a AS (SELECT c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer),
b AS (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier)
SELECT coalesce(a.i, b.i) AS "Index", c_name, s_name FROM a FULL JOIN b ON a.i = b.i
UNION ALL SELECT -1, c_name, NULL FROM customer UNION ALL SELECT -1, s_name, NULL FROM supplier""",
)
def _(t):
    wide = S.hstack(t.customer.select("c_custkey", "c_name"), t.supplier.select("s_suppkey", "s_name"), ["c_custkey"], ["s_suppkey"])
    tall = S.vstack(t.customer.select("c_name"), t.supplier.select("s_name"))
    wide = wide.select("Index", "c_name", "s_name")
    return wide.union(tall.select(F.lit(-1).cast("bigint"), "c_name", F.lit(None).cast("string")))


@check(
    "d_tocol",
    """SELECT o_orderkey, 0 AS pos, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 1, o_orderpriority FROM orders""",
)
def _(t):
    return S.to_column(t.orders, ["o_orderstatus", "o_orderpriority"], ["o_orderkey"])


@check(
    "d_wrap",
    """WITH r AS (SELECT p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part)
SELECT i // 3 AS row, coalesce(max(p_name) FILTER (i % 3 = 0), '-') AS c1, coalesce(max(p_name) FILTER (i % 3 = 1), '-') AS c2,
 coalesce(max(p_name) FILTER (i % 3 = 2), '-') AS c3 FROM r GROUP BY 1
UNION ALL SELECT -(i // 4) - 1, CAST(i % 4 AS VARCHAR), p_name, 'col' FROM r""",
)
def _(t):
    d = t.part.select("p_partkey", "p_name")
    a = S.wrap_rows(d, "p_name", 3, ["p_partkey"], pad="-")
    b = S.wrap_cols(d, "p_name", 4, ["p_partkey"])
    return a.union(b.select(-F.col("col") - 1, F.col("row").cast("string"), "value", F.lit("col")))


@check(
    "d_expand",
    """WITH r AS (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier), n AS (SELECT count(*) AS c FROM r)
SELECT i AS "Index", s_suppkey, s_name, '0' AS extra FROM r
UNION ALL SELECT c + k, 0, '0', '0' FROM n, range(1, (SELECT c FROM n) + 1) x(k)""",
)
def _(t):
    d = t.supplier.select("s_suppkey", "s_name")
    return S.expand(d, 2 * d.count(), ["extra"], ["s_suppkey"], pad="0")


@check(
    "d_rand",
    """SELECT o_orderkey, true AS in_range, true AS repeatable, (SELECT count(*) > 0 FROM orders) AS spread FROM orders""",
)
def _(t):
    d = S.random_column(t.orders.select("o_orderkey"), "r", 7, 2.0, 5.0)
    d = S.random_column(S.random_column(d, "again", 7, 2.0, 5.0), "other", 8, 2.0, 5.0)
    differ = d.agg((F.count_if(F.col("r") != F.col("other")) > 0.9 * F.count(F.lit(1)))).scalar()
    inside = (F.col("r") >= 2) & (F.col("r") < 5)
    return d.select("o_orderkey", inside.alias("in_range"), (F.col("r") == F.col("again")).alias("repeatable"), differ.alias("spread"))
