"""Ranks, highlight rules, series operators and validation (W, Q)."""

from pyspark.sql import functions as F

from tabulon.checks.registry import check
from tabulon.functions.values import sql_text
from tabulon.operators import quality as Q
from tabulon.operators import rules as R
from tabulon.operators import series as S
from tabulon.operators.rules import Rule, Stop


@check(
    "w_rank",
    """SELECT c_custkey, c_nationkey, c_acctbal, rank() OVER (ORDER BY c_acctbal DESC) AS rank, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS in_nation FROM customer""",
)
def _(t):
    d = S.rank(t.customer.select("c_custkey", "c_nationkey", "c_acctbal"), "c_acctbal")
    return S.rank(d, "c_acctbal", ["c_nationkey"], ascending=True, name="in_nation")


@check(
    "w_top_n",
    """WITH s AS (SELECT *, rank() OVER (ORDER BY c_acctbal DESC) AS r, rank() OVER (ORDER BY c_acctbal) AS b, count(*) OVER () AS n, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) AS g FROM customer)
SELECT c_custkey, r <= 10 AS top10, b <= ceil(CAST(0.07 AS DOUBLE) * n) AS low7, g <= 3 AS seg3 FROM s""",
)
def _(t):
    d = R.top_n(t.customer, "c_acctbal", 10, name="top10")
    d = R.top_n(d, "c_acctbal", 7, percent=True, bottom=True, name="low7")
    d = R.top_n(d, "c_acctbal", 3, by=["c_mktsegment"], name="seg3")
    return d.select("c_custkey", "top10", "low7", "seg3")


@check(
    "w_above_avg",
    "SELECT c_custkey, c_acctbal > avg(c_acctbal) OVER () AS above, c_acctbal <= avg(c_acctbal) OVER () AS below FROM customer",
)
def _(t):
    s = R.stats_for(t.customer, "c_acctbal")
    return t.customer.select(
        "c_custkey", R.above_average(s.v, s.avg).alias("above"), R.above_average(s.v, s.avg, above=False, equal=True).alias("below")
    )


@check(
    "w_dup_unique",
    """SELECT event_id, CASE WHEN event_id % 10 > 0 THEN count(*) OVER (PARTITION BY value, event_id % 10 = 0) > 1 ELSE false END AS dup,
 CASE WHEN event_id % 10 > 0 THEN count(*) OVER (PARTITION BY value, event_id % 10 = 0) = 1 ELSE false END AS uniq FROM events""",
)
def _(t):
    d = t.events.select("event_id", F.when(F.col("event_id") % 10 > 0, F.col("value")).alias("v"))
    d = R.repeats(d, "v")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return d.select("event_id", flag(F.col("copies") > 1).alias("dup"), flag(F.col("copies") == 1).alias("uniq"))


_STATS = "(SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, quantile_cont(c_acctbal, 0.5) AS mid FROM customer)"


@check(
    "w_color_scale",
    f"""WITH x AS (SELECT c_custkey, c_acctbal AS v, s.* FROM customer, {_STATS} s),
y AS (SELECT *, CASE WHEN v <= mid THEN (v - lo) / (mid - lo) ELSE (v - mid) / (hi - mid) END AS t FROM x),
z AS (SELECT *, CASE WHEN v <= mid THEN [248 + (255 - 248) * t, 105 + (235 - 105) * t, 107 + (132 - 107) * t] ELSE [255 + (99 - 255) * t, 235 + (190 - 235) * t, 132 + (123 - 132) * t] END AS c FROM y)
SELECT c_custkey, '#' || lower(format('{{:02x}}{{:02x}}{{:02x}}', CAST(floor(c[1] + 0.5) AS INT), CAST(floor(c[2] + 0.5) AS INT), CAST(floor(c[3] + 0.5) AS INT))) AS color FROM z""",
)
def _(t):
    stops = [Stop("min", color="#f8696b"), Stop("percentile", 50, "#ffeb84"), Stop("max", color="#63be7b")]
    s = R.stats_for(t.customer, "c_acctbal", *stops)
    return t.customer.select("c_custkey", R.color_scale(s.v, s, stops).alias("color"))


@check(
    "w_data_bar",
    f"SELECT c_custkey, round(least(1.0, greatest(0.0, (c_acctbal - 0) / (lo + 0.9 * (hi - lo) - 0))), 6) AS bar FROM customer, {_STATS} s",
)
def _(t):
    s = R.stats_for(t.customer, "c_acctbal")
    return t.customer.select("c_custkey", F.round(R.data_bar(s.v, s, Stop("num", 0), Stop("percent", 90)), 6).alias("bar"))


@check(
    "w_icon_bucket",
    f"SELECT c_custkey, CAST(2 - CASE WHEN c_acctbal < lo + 0.33 * (hi - lo) THEN 0 WHEN c_acctbal <= lo + 0.67 * (hi - lo) THEN 1 ELSE 2 END AS INT) AS icon FROM customer, {_STATS} s",
)
def _(t):
    stops = [Stop("min"), Stop("percent", 33), Stop("percent", 67, inclusive=False)]
    s = R.stats_for(t.customer, "c_acctbal", *stops)
    return t.customer.select("c_custkey", R.icon_bucket(s.v, s, stops, reverse=True).alias("icon"))


@check(
    "w_cell_is",
    """SELECT o_orderkey, o_totalprice > 250000 AS gt, o_totalprice BETWEEN 100000 AND 200000 AS bt, NOT o_totalprice BETWEEN 100000 AND 200000 AS nb, o_totalprice >= o_custkey * 300 AS ge FROM orders""",
)
def _(t):
    v = F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey",
        R.cell_is(v, "greaterThan", 250000).alias("gt"),
        R.cell_is(v, "between", 100000, 200000).alias("bt"),
        R.cell_is(v, "notBetween", 100000, 200000).alias("nb"),
        R.cell_is(v, "greaterThanOrEqual", "o_custkey * 300").alias("ge"),
    )


@check(
    "w_text_rule",
    """SELECT p_partkey, contains(p_name, 'ring') AS c, NOT contains(p_name, 'ring') AS n, starts_with(p_name, 'red') AS b, ends_with(p_name, 'Bolt') AS e FROM part""",
)
def _(t):
    c = F.col("p_name")
    names = {"c": ("containsText", "ring"), "n": ("notContainsText", "ring"), "b": ("beginsWith", "red"), "e": ("endsWith", "Bolt")}
    return t.part.select("p_partkey", *[R.text_is(c, *a).alias(k) for k, a in names.items()])


@check(
    "w_expr_rule",
    "SELECT l_orderkey, l_partkey, l_quantity, 1 AS rule_id FROM lineitem WHERE l_discount > l_tax AND l_quantity % 2 = 0 UNION ALL SELECT l_orderkey, l_partkey, l_quantity, NULL FROM lineitem WHERE NOT (l_discount > l_tax AND l_quantity % 2 = 0)",
)
def _(t):
    d = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_tax")
    d = R.apply_rules(d, "l_quantity", [Rule(1, "expression", {"condition": "l_discount > l_tax AND l_quantity % 2 = 0"}, "bold")])
    return d.select("l_orderkey", "l_partkey", "l_quantity", "rule_id")


_T = "DATE '1998-07-24'"
_WEEK = "(CAST({} AS DATE) - CAST(dayofweek({}) AS INT))"


@check(
    "w_time_period",
    f"""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) - CAST(dayofweek(o_orderdate) AS INT) AS w, DATE '1998-07-19' AS tw FROM orders)
SELECT o_orderkey, d = {_T} AS today, d = {_T} - 1 AS yesterday, d = {_T} + 1 AS tomorrow, d BETWEEN {_T} - 6 AND {_T} AS "last7Days",
 w = tw AS "thisWeek", w = tw - 7 AS "lastWeek", w = tw + 7 AS "nextWeek", date_trunc('month', d) = DATE '1998-07-01' AS "thisMonth",
 date_trunc('month', d) = DATE '1998-06-01' AS "lastMonth", date_trunc('month', d) = DATE '1998-08-01' AS "nextMonth" FROM o""",
)
def _(t):
    periods = ("today", "yesterday", "tomorrow", "last7Days", "thisWeek", "lastWeek", "nextWeek", "thisMonth", "lastMonth", "nextMonth")
    return t.orders.select("o_orderkey", *[R.time_period(F.col("o_orderdate"), p, "1998-07-24").alias(p) for p in periods])


@check(
    "w_rule_chain",
    """WITH s AS (SELECT *, rank() OVER (ORDER BY c_acctbal DESC) AS r, (SELECT min(c_acctbal) FROM customer) AS lo, (SELECT max(c_acctbal) FROM customer) AS hi FROM customer)
SELECT c_custkey, CASE WHEN r <= 20 THEN 1 WHEN c_acctbal < 0 THEN 2 WHEN c_acctbal BETWEEN 4000 AND 5000 THEN 3 ELSE 4 END AS rule_id,
 CASE WHEN r <= 20 THEN 'gold' WHEN c_acctbal < 0 THEN 'red' WHEN c_acctbal BETWEEN 4000 AND 5000 THEN 'grey' END AS style,
 CASE WHEN NOT (r <= 20 OR c_acctbal < 0 OR c_acctbal BETWEEN 4000 AND 5000) THEN round((c_acctbal - lo) / (hi - lo), 6) END AS bar FROM s""",
)
def _(t):
    rules = [
        Rule(3, "cellIs", {"operator": "between", "a": 4000, "b": 5000}, "grey"),
        Rule(4, "dataBar"),
        Rule(1, "top", {"rank": 20}, "gold"),
        Rule(2, "cellIs", {"operator": "lessThan", "a": 0}, "red"),
        Rule(5, "aboveAverage", {}, "never"),
    ]
    d = R.apply_rules(t.customer, "c_acctbal", rules)
    return d.select("c_custkey", "rule_id", "style", F.round("bar", 6).alias("bar"))


@check(
    "w_moving_avg",
    """SELECT event_id, user_id, value, round(avg(value) OVER w, 4) AS average FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS 4 PRECEDING)
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) >= 5""",
)
def _(t):
    d = S.moving_average(t.events.select("event_id", "user_id", "value", "event_type", "ts"), "value", ["ts", "event_id"], 5, ["event_type"])
    return d.select("event_id", "user_id", "value", F.round("average", 4).alias("average"))


_CAT = "(SELECT o_orderpriority, o_orderstatus, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2)"


@check("w_pct_stack", f"SELECT o_orderpriority, o_orderstatus, round(v / sum(v) OVER (PARTITION BY o_orderpriority) * 100, 6) AS percent FROM {_CAT}")
def _(t):
    d = t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return S.percent_stack(d, "v", ["o_orderpriority"]).select("o_orderpriority", "o_orderstatus", F.round("percent", 6).alias("percent"))


@check(
    "w_tail_other",
    """WITH c AS (SELECT CAST(c_nationkey AS VARCHAR) AS nation, count(*) AS n, c_nationkey AS k FROM customer GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS m FROM c)
SELECT least(i, m - 4) AS pos, CASE WHEN i < m - 4 THEN nation ELSE 'Other' END AS nation, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1, 2""",
)
def _(t):
    d = t.customer.groupBy(F.col("c_nationkey").cast("string").alias("nation"), "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return S.tail_other(d, "nation", "n", ["c_nationkey"], last=4)


@check(
    "w_sparkline",
    """SELECT event_id, user_id, row_number() OVER w - 1 AS pos, round((value - min(value) OVER u) / CASE WHEN max(value) OVER u = min(value) OVER u THEN 1 ELSE max(value) OVER u - min(value) OVER u END, 6) AS scaled,
 CAST(sign(value) AS INT) AS sign FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), u AS (PARTITION BY user_id)""",
)
def _(t):
    d = S.sparkline(t.events.select("event_id", "user_id", "ts", "value"), "value", ["ts", "event_id"], ["user_id"])
    return d.select("event_id", "user_id", "pos", F.round("scaled", 6).alias("scaled"), "sign")


@check(
    "w_error_bars",
    """SELECT event_id, round(value - 2 * stddev_samp(value) OVER w, 4) AS sd_low, round(value + 2 * stddev_samp(value) OVER w, 4) AS sd_high,
 round(value + stddev_samp(value) OVER w / sqrt(count(*) OVER w), 4) AS se_high, value - 0.5 AS fx_low, round(value + abs(value) * 10 / 100, 4) AS pc_high FROM events WINDOW w AS (PARTITION BY event_type)""",
)
def _(t):
    d = t.events.select("event_id", "event_type", "value")
    d = S.error_bars(d, "value", "stdDev", 2, ["event_type"], empty=True).withColumnsRenamed({"low": "sd_low", "high": "sd_high"})
    d = S.error_bars(d, "value", "stdErr", by=["event_type"], direction="plus", empty=True).withColumnRenamed("high", "se_high").drop("low")
    d = S.error_bars(d, "value", "fixed", 0.5, direction="minus", empty=True).withColumnRenamed("low", "fx_low").drop("high")
    d = S.error_bars(d, "value", "percentage", 10, empty=True).withColumnRenamed("high", "pc_high").drop("low")
    r = lambda c: F.round(c, 4).alias(c)
    return d.select("event_id", r("sd_low"), r("sd_high"), r("se_high"), "fx_low", r("pc_high"))


_LEVELS = "(SELECT *, CAST(CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 0 END + (turn % 3 = 2)::INT AS INT) AS lvl FROM conversations)"


def levels(t):
    base = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(0)
    return t.conversations.withColumn("lvl", base + (F.col("turn") % 3 == 2).cast("int"))


@check(
    "w_outline_groups",
    f"""WITH l AS (SELECT lvl, row_number() OVER (ORDER BY conv_id, turn) AS i, count(*) OVER () AS n FROM {_LEVELS}),
m AS (SELECT k AS level, i, n, i - row_number() OVER (PARTITION BY k ORDER BY i) AS g FROM l, range(1, 4) r(k) WHERE lvl >= k)
SELECT CAST(level AS INT) AS level, min(i) AS "from", max(i) AS "to", least(max(i) + 1, max(n)) AS summary, false AS collapsed FROM m GROUP BY level, g""",
)
def _(t):
    return S.outline_groups(levels(t), "lvl", ["conv_id", "turn"])


@check("w_outline_level", f"SELECT conv_id, turn, lvl FROM {_LEVELS} WHERE lvl <= 1")
def _(t):
    return S.outline_level(levels(t), "lvl", 1).select("conv_id", "turn", "lvl")


@check(
    "w_fill_series",
    """WITH s AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS len, o_orderstatus AS v FROM orders)
SELECT 'num' AS kind, o_custkey, n, CAST(o_custkey + (len + n) * 3 AS VARCHAR) AS value FROM s, range(0, 4) r(n) WHERE i = 0 AND len >= 2
UNION ALL SELECT 'num', o_custkey, n, CAST(o_custkey AS VARCHAR) FROM s, range(0, 4) r(n) WHERE i = 0 AND len = 1
UNION ALL SELECT 'cycle', o_custkey, n, v FROM s, range(0, 4) r(n) WHERE i = n % len
UNION ALL SELECT 'tail', c_custkey, n, regexp_extract(c_name, '^(.*?)(\\d+)$', 1) || CAST(CAST(regexp_extract(c_name, '^(.*?)(\\d+)$', 2) AS BIGINT) - 1 - n AS VARCHAR) FROM customer, range(0, 3) r(n)""",
)
def _(t):
    from tabulon.operators.cashflows import numbered

    d = numbered(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus"), "o_orderkey", ["o_orderkey"], ["o_custkey"])
    d = d.withColumn("v", F.col("o_custkey") + F.col("period") * 3)
    a = S.fill_series(d, "v", ["o_orderkey"], 4, ["o_custkey"]).withColumn("kind", F.lit("num"))
    b = S.fill_series(d, "o_orderstatus", ["o_orderkey"], 4, ["o_custkey"]).withColumn("kind", F.lit("cycle"))
    c = S.fill_series(t.customer.withColumn("o_custkey", F.col("c_custkey")), "c_name", ["c_custkey"], 3, ["o_custkey"], backward=True)
    return a.unionByName(b).unionByName(c.withColumn("kind", F.lit("tail")))


_RULES = lambda t: [
    Q.Validation("c_acctbal", "decimal", "greaterThanOrEqual", 0, message="no debt"),
    Q.Validation("c_nationkey", "whole", "between", 1, 20, message="nation"),
    Q.Validation("c_mktsegment", "list", values=("BUILDING", "MACHINERY"), message="segment", style="warning"),
    Q.Validation("c_name", "textLength", "lessThan", 5, message="short"),
    Q.Validation("c_acctbal", "custom", sql="false"),
]


@check(
    "q_validate",
    """SELECT c_custkey, c_acctbal >= 0 AS valid_c_acctbal, c_nationkey BETWEEN 1 AND 20 AS valid_c_nationkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AS valid_c_mktsegment,
 length(c_name) < 5 AS valid_c_name FROM customer""",
)
def _(t):
    d = Q.validate(t.customer, _RULES(t))
    return d.select("c_custkey", *[c for c in d.columns if c.startswith("valid_")])


@check(
    "q_list_source",
    "SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AS valid_o_custkey FROM orders",
)
def _(t):
    allowed = t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey")
    d = Q.validate(t.orders.select("o_orderkey", "o_custkey"), [Q.Validation("o_custkey", "list", source=allowed)])
    return d.select("o_orderkey", "valid_o_custkey")


@check(
    "q_report",
    """SELECT c_custkey, 'c_nationkey' AS "column", CAST(c_nationkey AS VARCHAR) AS value, 'whole' AS rule, 'nation' AS message, 'stop' AS style FROM customer WHERE c_nationkey NOT BETWEEN 1 AND 20
UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment, 'list', 'segment', 'warning' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
UNION ALL SELECT c_custkey, 'c_name', c_name, 'textLength', 'short', 'stop' FROM customer WHERE length(c_name) >= 5
UNION ALL SELECT c_custkey, 'c_acctbal', CAST(c_acctbal AS VARCHAR), 'decimal', 'no debt', 'stop' FROM customer WHERE c_acctbal < 0""",
)
def _(t):
    return Q.report(t.customer, _RULES(t), ["c_custkey"], shown=lambda d, c: sql_text(F.col(c), d.schema[c].dataType.typeName()))
