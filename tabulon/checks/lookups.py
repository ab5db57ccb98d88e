"""Merges and lookups (J)."""

from pyspark.sql import functions as F

from tabulon.checks.registry import check
from tabulon.operators import joins as J

# Order keys are shifted, so that whole tables have unmatched rows on both sides.
_C = "(SELECT c_custkey, c_name FROM customer)"
_O = "(SELECT o_orderkey, o_custkey + 40 AS o_custkey, o_totalprice FROM orders)"
_COLS = 'c.c_custkey, c.c_name, o.o_orderkey AS "Orders.o_orderkey", o.o_custkey AS "Orders.o_custkey", o.o_totalprice AS "Orders.o_totalprice"'


def sides(t):
    c = t.customer.select("c_custkey", "c_name")
    return c, t.orders.select("o_orderkey", (F.col("o_custkey") + 40).alias("o_custkey"), "o_totalprice")


def _merge(kind):
    def run(t):
        c, o = sides(t)
        return J.merge(c, o, "c_custkey", "o_custkey", kind, "Orders")

    return run


for _kind in ("left", "right", "full", "inner"):
    check(f"j_{_kind}", f"SELECT {_COLS} FROM {_C} c {_kind.upper()} JOIN {_O} o ON c.c_custkey = o.o_custkey")(_merge(_kind))

check(
    "j_left_anti",
    f"SELECT * FROM {_C} c WHERE c_custkey NOT IN (SELECT o_custkey FROM {_O})",
)(_merge("left_anti"))
check(
    "j_right_anti",
    f"SELECT {_COLS} FROM {_C} c RIGHT JOIN {_O} o ON c.c_custkey = o.o_custkey WHERE c.c_custkey IS NULL",
)(_merge("right_anti"))


@check(
    "j_expand",
    f'SELECT c.c_custkey, c.c_name, o.o_orderkey AS "Orders.o_orderkey", o.o_totalprice AS "Orders.o_totalprice" FROM {_C} c LEFT JOIN {_O} o ON c.c_custkey = o.o_custkey',
)
def _(t):
    c, o = sides(t)
    nested = J.merge_nested(c, o, "c_custkey", "o_custkey", "all")
    return J.expand_nested(nested, "all", ["o_orderkey", "o_totalprice"], "Orders")


@check(
    "j_xlookup",
    """SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def _(t):
    return J.lookup_exact(t.documents.select("doc_id"), "doc_id", t.labels.withColumnRenamed("doc_id", "id"), "id", ["quality", "toxic"], ["id"], default=-1)


_RATES = "(SELECT o_custkey % 50 AS user_id, o_totalprice / 1000 AS level, o_orderkey FROM orders)"


def rate_table(t):
    return t.orders.selectExpr("o_custkey % 50 AS user_id", "o_totalprice / 1000 AS level", "o_orderkey")


def _asof_sql(op, pick, by=True):
    match = "r.user_id = e.user_id AND" if by else ""
    return f"""WITH e AS (SELECT event_id, user_id, value FROM events), r AS (SELECT {"user_id, " if by else ""}level, {pick}(o_orderkey) AS o_orderkey FROM {_RATES} GROUP BY ALL)
SELECT e.event_id, e.user_id, e.value, r.o_orderkey FROM e ASOF LEFT JOIN r ON {match} e.value {op} r.level"""


@check("j_asof_back", _asof_sql(">=", "max"))
def _(t):
    e = t.events.select("event_id", "user_id", "value")
    return J.asof(e, "value", rate_table(t), "level", ["o_orderkey"], ["o_orderkey"], by=["user_id"])


@check("j_asof_fwd", _asof_sql("<=", "min"))
def _(t):
    e = t.events.select("event_id", "user_id", "value")
    return J.asof(e, "value", rate_table(t), "level", ["o_orderkey"], ["o_orderkey"], by=["user_id"], direction="forward", ties="first")


@check("j_lookup", _asof_sql(">=", "max", by=False))
def _(t):
    e = t.events.select("event_id", "user_id", "value")
    return J.lookup_sorted(e, "value", rate_table(t).drop("user_id"), "level", ["o_orderkey"], ["o_orderkey"])


@check(
    "j_match",
    """WITH v AS (SELECT c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS pos, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS dpos FROM customer),
u AS (SELECT c_acctbal, max(pos) AS p, min(pos) AS f, max(dpos) AS dp FROM v GROUP BY 1),
s AS (SELECT s_suppkey, s_acctbal FROM supplier)
SELECT 1 AS mode, s.s_suppkey, u.p AS pos FROM s ASOF LEFT JOIN u ON s.s_acctbal >= u.c_acctbal
UNION ALL SELECT -1, s.s_suppkey, u.dp FROM s ASOF LEFT JOIN u ON s.s_acctbal <= u.c_acctbal
UNION ALL SELECT 0, c.c_custkey, u.f FROM customer c JOIN u ON c.c_acctbal = u.c_acctbal""",
)
def _(t):
    s = t.supplier.select("s_suppkey", "s_acctbal")
    c = t.customer.select("c_custkey", "c_acctbal")
    up = J.match_position(s, "s_acctbal", c, "c_acctbal", ["c_acctbal", "c_custkey"], 1)
    down = _descending(t, s)
    exact = J.match_position(c.withColumnsRenamed({"c_custkey": "s_suppkey", "c_acctbal": "s_acctbal"}), "s_acctbal", c, "c_acctbal", ["c_acctbal", "c_custkey"], 0)
    out = up.withColumn("mode", F.lit(1)).unionByName(down.withColumn("mode", F.lit(-1))).unionByName(exact.withColumn("mode", F.lit(0)))
    return out.select("mode", "s_suppkey", "pos")


def _descending(t, s):
    c = t.customer.selectExpr("c_custkey", "c_acctbal", "-c_acctbal AS neg")
    return J.match_position(s, "s_acctbal", c, "c_acctbal", ["neg", "c_custkey"], -1)


@check(
    "j_wildcard",
    """SELECT p.pattern, min(part.p_partkey) AS p_partkey, arg_min(part.p_name, part.p_partkey) AS p_name
FROM (VALUES ('red*', 'red%'), ('*RING', '%ring'), ('b?ue bolt', 'b_ue bolt'), ('none*', 'none%')) p(pattern, l) LEFT JOIN part ON part.p_name ILIKE p.l GROUP BY 1""",
)
def _(t):
    return J.lookup_wildcard(t.part, "p_name", ["red*", "*RING", "b?ue bolt", "none*"], ["p_partkey", "p_name"], ["p_partkey"])


_WILD = """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '*' || right(c_name, 4) WHEN 1 THEN left(c_name, 15) || '?*' WHEN 2 THEN replace(upper(c_name), '0', '?')
ELSE '*' || substr(c_name, 14, 3) || '*' END AS pattern FROM customer"""


@check(
    "j_wildcard_table",
    f"""WITH p AS ({_WILD}), d AS (SELECT DISTINCT pattern, replace(replace(pattern, '*', '%'), '?', '_') AS l FROM p),
f AS (SELECT d.pattern, min(c.c_custkey) AS found FROM d JOIN customer c ON c.c_name ILIKE d.l GROUP BY 1)
SELECT p.c_custkey, p.pattern, f.found FROM p LEFT JOIN f USING (pattern)""",
)
def _(t):
    """A pattern for every customer, from a column."""
    key, name = F.col("c_custkey") % 4, F.col("c_name")
    pattern = (
        F.when(key == 0, F.concat(F.lit("*"), F.right("c_name", F.lit(4)))).when(key == 1, F.concat(F.left("c_name", F.lit(15)), F.lit("?*")))
        .when(key == 2, F.replace(F.upper(name), F.lit("0"), F.lit("?"))).otherwise(F.concat(F.lit("*"), F.substring("c_name", 14, 3), F.lit("*")))
    )
    asked = t.customer.select("c_custkey", pattern.alias("pattern"))
    vector = t.customer.select(F.col("c_custkey").alias("found"), "c_name")
    hits = J.lookup_wildcard(vector, "c_name", asked.select("pattern").distinct(), ["found"], ["found"])
    return asked.join(hits, "pattern", "left")


@check(
    "j_index_match",
    """SELECT o.o_orderkey, o.o_custkey, c.c_name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""",
)
def _(t):
    return J.index_match(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", t.customer, "c_custkey", "c_name", ["c_custkey"])
