"""Criteria, filters, slicers, find and replace (C)."""

from pyspark.sql import functions as F

from tabulon.checks.registry import check
from tabulon.operators import filters as X
from tabulon.operators.criteria import matches


def _counts(df, column, criteria, dialect):
    cells = F.array(*[F.struct(F.lit(k).alias("criterion"), F.count_if(matches(df, column, k, dialect)).alias("n")) for k in criteria])
    return df.agg(cells.alias("c")).select(F.inline("c"))


def _sql_counts(table, pairs):
    return " UNION ALL ".join(f"SELECT '{k}' AS criterion, count(*) FILTER ({p}) AS n FROM {table}" for k, p in pairs)


_MIXED = """(SELECT CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN CAST(p_size AS VARCHAR) ELSE p_name END AS v FROM part)"""


def mixed(t):
    size = F.col("p_size")
    return t.part.select(F.when(size % 4 == 0, None).when(size % 4 == 1, size.cast("string")).otherwise(F.col("p_name")).alias("v"))


@check(
    "c_criteria",
    _sql_counts(
        _MIXED,
        [
            (">20", "coalesce(TRY_CAST(v AS DOUBLE) > 20, lower(coalesce(v, '')) > '20')"),
            ("<=9", "coalesce(TRY_CAST(v AS DOUBLE) <= 9, lower(coalesce(v, '')) <= '9')"),
            ("13", "coalesce(TRY_CAST(v AS DOUBLE) = 13, false)"),
            ("<>RED*", "NOT coalesce(v ILIKE 'red%', false)"),
            ("*ring", "v ILIKE '%ring'"),
            ("?ed bolt", "v ILIKE '_ed bolt'"),
            ("=", "v IS NULL"),
            ("<>", "v IS NOT NULL"),
            (">M", "lower(coalesce(v, '')) > 'm'"),
        ],
    )
    + " UNION ALL "
    + _sql_counts("lineitem", [("q>25", "l_quantity > 25"), ("q<>7", "l_quantity <> 7")]),
)
def _(t):
    a = _counts(mixed(t), "v", [">20", "<=9", "13", "<>RED*", "*ring", "?ed bolt", "=", "<>", ">M"], "ifs")
    b = _counts(t.lineitem, "l_quantity", [">25", "<>7"], "ifs")
    return a.unionByName(b.withColumn("criterion", F.concat(F.lit("q"), "criterion")))


@check(
    "c_autofilter_crit",
    _sql_counts(
        _MIXED,
        [
            (">20", "coalesce(TRY_CAST(v AS DOUBLE) > 20, coalesce(v, '') > '20')"),
            ("<>red*", "true"),
            ("=RED*", "v ILIKE 'red%'"),
            ("red bolt", "lower(v) = 'red bolt'"),
            ("<>Red Bolt", "lower(coalesce(v, '')) <> 'red bolt'"),
            (">M", "coalesce(v, '') > 'M'"),
        ],
    ),
)
def _(t):
    return _counts(mixed(t), "v", [">20", "<>red*", "=RED*", "red bolt", "<>Red Bolt", ">M"], "autofilter")


@check(
    "c_value_filter",
    """SELECT * FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority IN ('1-URGENT', '2-HIGH')
 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def _(t):
    keys = t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey")
    allowed = {"o_orderstatus": ["F", "P"], "o_orderpriority": ["1-URGENT", "2-HIGH"], "o_custkey": keys}
    return X.value_filter(t.orders, allowed)


@check("c_filter_values", "SELECT DISTINCT CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT DISTINCT p_brand FROM part")
def _(t):
    return X.filter_values(t.part, "p_size").union(X.filter_values(t.part, "p_brand"))


@check("c_autofilter", "SELECT * FROM part WHERE p_size > 30 AND (p_brand = 'Brand#7' OR p_brand ILIKE 'brand#1%')")
def _(t):
    return X.AutoFilter(t.part).set(5, ">30").set(2, "red*").set(2).set(3, "brand#7", "=Brand#1*", either=True).rows()


@check(
    "c_advanced",
    "SELECT * FROM part WHERE (lower(p_name) LIKE 'red%' AND p_size > 10) OR (p_retailprice < 950)",
)
def _(t):
    return X.advanced_filter(t.part, [{"P_NAME": "red*", "p_size": ">10"}, {"p_retailprice": "<950", "p_size": ""}])


@check("c_advanced_unique", "SELECT DISTINCT p_name, p_brand FROM part WHERE p_name ILIKE '%bolt' OR p_brand = 'Brand#3'")
def _(t):
    return X.advanced_filter(t.part.select("p_name", "p_brand"), [{"p_name": "*bolt"}, {"p_brand": "brand#3"}], unique=True)


@check("c_page_filter", "SELECT l_linestatus, count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def _(t):
    d = X.page_filter(X.page_filter(t.lineitem, "l_returnflag", "R"), "l_linestatus")
    return d.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))


@check(
    "c_slicer",
    """SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND CAST(o_custkey AS VARCHAR) IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal > 5000) GROUP BY 1""",
)
def _(t):
    d = X.slicer(t.orders, "o_orderpriority", ["1-URGENT", "5-LOW"])
    labels = t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").cast("string"))
    d = X.slicer(d, "o_custkey", labels)
    d = d.unionByName(X.slicer(t.orders, "o_orderstatus", []))
    return d.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@check("c_table_slicer", "SELECT * FROM customer WHERE c_nationkey IN (3, 5) AND c_mktsegment IN ('MACHINERY', 'BUILDING')")
def _(t):
    return X.table_slicer(X.table_slicer(t.customer, "c_nationkey", ["3", "5"]), "c_mktsegment", ["MACHINERY", "BUILDING"])


@check(
    "c_timeline",
    """SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1998-01-01'
UNION ALL SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01' AND o_orderdate < TIMESTAMP '1999-02-01'""",
)
def _(t):
    from tabulon.functions.dates import date_to_serial

    d = t.orders.select("o_orderkey", "o_orderdate")
    serial = d.withColumn("s", date_to_serial(F.col("o_orderdate")))
    return X.timeline(d, "o_orderdate", "1997-03-01", "1998-01-01").unionByName(
        X.timeline(serial, "s", "1999-01-01", "1999-02-01").drop("s")
    )


@check(
    "c_timeline_periods",
    """WITH b AS (SELECT min(o_orderdate) AS a, max(o_orderdate) AS z FROM orders),
m AS (SELECT unnest(generate_series(date_trunc('month', a), z, INTERVAL 1 MONTH)) AS s FROM b),
q AS (SELECT unnest(generate_series(date_trunc('quarter', a), z, INTERVAL 3 MONTH)) AS s FROM b),
y AS (SELECT unnest(generate_series(date_trunc('year', a), z, INTERVAL 1 YEAR)) AS s FROM b),
d AS (SELECT unnest(generate_series(date_trunc('day', a), z, INTERVAL 1 DAY)) AS s FROM b)
SELECT strftime(s, '%b %y') AS label, CAST(s AS DATE) AS start, CAST(s + INTERVAL 1 MONTH AS DATE) AS "end" FROM m
UNION ALL SELECT 'Q' || quarter(s) || ' ' || year(s), CAST(s AS DATE), CAST(s + INTERVAL 3 MONTH AS DATE) FROM q
UNION ALL SELECT CAST(year(s) AS VARCHAR), CAST(s AS DATE), CAST(s + INTERVAL 1 YEAR AS DATE) FROM y
UNION ALL SELECT day(s) || '/' || month(s), CAST(s AS DATE), CAST(s + INTERVAL 1 DAY AS DATE) FROM d""",
)
def _(t):
    bounds = t.orders.agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("z"))
    out = None
    for level in ("months", "quarters", "years", "days"):
        one = X.timeline_periods(bounds, "a", "z", level)
        out = one if out is None else out.unionByName(one)
    return out


@check(
    "c_find_all",
    """SELECT doc_id, 'lang' AS "column", lang AS value FROM documents WHERE contains(lower(lang), 'e')
UNION ALL SELECT doc_id, 'text', text FROM documents WHERE contains(lower(text), 'the') UNION ALL SELECT doc_id, 'source', source FROM documents WHERE contains(lower(source), 'the')""".replace("contains(lower(lang), 'e')", "contains(lower(lang), 'the')"),
)
def _(t):
    return X.find_all(t.documents, "The", ["doc_id"], ["lang", "text", "source"])


@check(
    "c_find_first",
    """(SELECT p_partkey, 'p_name' AS "column", p_name AS value FROM part WHERE p_name ILIKE '%BOLT%' ORDER BY p_partkey LIMIT 1)
UNION ALL (SELECT p_partkey, 'p_brand', p_brand FROM part WHERE p_brand = 'Brand#3' ORDER BY p_partkey LIMIT 1)""",
)
def _(t):
    a = X.find_first(t.part, "BOLT", ["p_partkey"], ["p_name", "p_brand"])
    return a.unionByName(X.find_first(t.part, "Brand#3", ["p_partkey"], ["p_name", "p_brand"], whole=True, match_case=True))


@check(
    "c_replace_all",
    """SELECT p_partkey, regexp_replace(p_name, 'RED', 'R$1', 'gi') AS p_name, replace(p_brand, 'rand', 'RAND') AS p_brand,
 CASE WHEN lower(p_type) = 'small' THEN 'S' ELSE p_type END AS p_type FROM part""",
)
def _(t):
    d = t.part.select("p_partkey", "p_name", "p_brand", "p_type")
    d = X.replace_all(d, ["p_name"], "RED", "R$1")
    d = X.replace_all(d, ["p_brand"], "rand", "RAND", match_case=True)
    return X.replace_all(d, ["p_type"], "small", "S", whole=True)


_GAPS = "(SELECT p_partkey, nullif(p_brand, 'Brand#3') AS brand, CASE WHEN p_size = 5 THEN '' ELSE p_name END AS name FROM part)"


@check(
    "c_special_cells",
    f"""SELECT p_partkey, 'brand' AS "column", '' AS value FROM {_GAPS} WHERE brand IS NULL UNION ALL
SELECT p_partkey, 'name', '' FROM {_GAPS} WHERE name = '' UNION ALL SELECT p_partkey, 'name', name FROM {_GAPS} WHERE name <> ''""",
)
def _(t):
    d = t.part.select("p_partkey", F.expr("nullif(p_brand, 'Brand#3')").alias("brand"), F.when(F.col("p_size") == 5, "").otherwise(F.col("p_name")).alias("name"))
    return X.special_cells(d, "blanks", ["p_partkey"]).unionByName(X.special_cells(d, "constants", ["p_partkey"], ["name"]))


@check(
    "c_table_ref",
    """SELECT 'p_name' AS p_name, 'p_brand' AS p_brand, 'p_type' AS p_type, true AS is_header UNION ALL SELECT p_name, p_brand, p_type, false FROM part""",
)
def _(t):
    return X.table_part(t.part, "#all", "P_TYPE", "p_name")
