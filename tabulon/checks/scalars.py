"""Scalar functions (F, U)."""

from pyspark.sql import functions as F

from tabulon.checks.registry import check
from tabulon.functions import dates as D
from tabulon.functions import formats as FM
from tabulon.functions import logic as L
from tabulon.functions import sqlfn
from tabulon.functions import text as X
from tabulon.functions.values import bind, number_text


@check("f_text_basic", "SELECT doc_id, upper(lang) AS u, length(text) AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", X.upper(F.col("lang")).alias("u"), F.length(X.as_text(F.col("text"))).cast("bigint").alias("n"))


@check(
    "f_substitute",
    """WITH s AS (SELECT p_partkey, p_name AS t, string_split(p_name, 'r') AS a FROM part)
SELECT p_partkey, replace(t, 'r', '__') AS every, CASE WHEN len(a) > 2 THEN a[1] || 'r' || a[2] || '__' || array_to_string(a[3:], 'r') ELSE t END AS second, t AS same FROM s""",
)
def _(t):
    c = F.col("p_name")
    return t.part.select(
        "p_partkey", X.substitute(c, "r", "__").alias("every"), X.substitute(c, "r", "__", 2).alias("second"), X.substitute(c, "", "x").alias("same")
    )


@check(
    "f_text_before_after",
    """WITH s AS (SELECT page_id, url, string_split(url, '/') AS a FROM pages)
SELECT page_id, array_to_string(a[1:3], '/') AS host, array_to_string(a[4:], '/') AS path, array_to_string(a[1:len(a) - 1], '/') AS dir, a[len(a)] AS leaf,
 CASE WHEN contains(url, '?') THEN string_split(url, '?')[1] END AS bare, CASE WHEN len(a) > 5 THEN array_to_string(a[6:], '/') END AS deep FROM s""",
)
def _(t):
    u = F.col("url")
    return t.pages.select(
        "page_id",
        X.text_before(u, "/", 3).alias("host"),
        X.text_after(u, "/", 3).alias("path"),
        X.text_before(u, "/", -1).alias("dir"),
        X.text_after(u, "/", -2).alias("leaf"),
        X.text_before(u, "?").alias("bare"),
        X.text_after(u, "/", 5).alias("deep"),
    )


@check(
    "f_textsplit",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS row FROM documents),
c AS (SELECT doc_id, row, string_split_regex(line, '[,.]') AS cells FROM l)
SELECT doc_id, CAST(count(*) AS INT) AS rows, CAST(max(len(cells)) AS INT) AS width, CAST(sum(len(list_filter(cells, lambda x: x <> ''))) AS BIGINT) AS filled FROM c GROUP BY 1""",
)
def _(t):
    filled = lambda g: F.aggregate(g, F.lit(0).cast("bigint"), lambda n, r: n + F.size(F.filter(r, lambda x: x != "")))
    measured = lambda g: F.struct(F.size(g).alias("rows"), F.size(F.get(g, F.lit(0))).alias("width"), filled(g).alias("filled"))
    grid = X.text_split(F.col("text"), [",", "."], "\n")
    return t.documents.select("doc_id", F.explode(F.array(bind(grid, measured))).alias("m")).select("doc_id", "m.*")


@check(
    "f_search",
    """SELECT page_id, nullif(instr(lower(url), 'example'), 0) AS ci, nullif(instr(url, 'EXAMPLE'), 0) AS cs, CASE WHEN regexp_matches(lower(url), 'e.a.*com') THEN instr(lower(url), regexp_extract(lower(url), 'e.a.*com')) END AS wild,
 CASE WHEN instr(substr(lower(url), 12), 'th') > 0 THEN instr(substr(lower(url), 12), 'th') + 11 END AS later FROM pages""",
)
def _(t):
    u = F.col("url")
    return t.pages.select(
        "page_id",
        X.search("EXAMPLE", u).cast("bigint").alias("ci"),
        X.find("EXAMPLE", u).cast("bigint").alias("cs"),
        X.search("e?a*com", u).cast("bigint").alias("wild"),
        X.search("TH", u, 12).cast("bigint").alias("later"),
    )


@check(
    "f_value",
    """SELECT o_orderkey, o_totalprice AS grouped, o_custkey / 100.0 AS percent, CAST(0 AS DOUBLE) AS blank, TRY_CAST(o_orderpriority AS DOUBLE) AS bad FROM orders""".replace("o_custkey / 100.0", "CAST(o_custkey AS DOUBLE) / 100"),
)
def _(t):
    return t.orders.select(
        "o_orderkey",
        X.value(F.format_number("o_totalprice", 2)).alias("grouped"),
        X.value(F.concat(F.col("o_custkey").cast("string"), F.lit("%"))).alias("percent"),
        X.value(F.lit(" ")).alias("blank"),
        X.value(F.col("o_orderpriority")).alias("bad"),
    )


@check(
    "f_textjoin",
    """SELECT p_partkey, concat_ws('; ', p_name, CASE WHEN p_size > 25 THEN p_brand END, p_type) AS skip, p_name || '; ' || CASE WHEN p_size > 25 THEN p_brand ELSE '' END || '; ' || p_type AS keep FROM part""",
)
def _(t):
    cells = [F.col("p_name"), F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(""), F.col("p_type")]
    return t.part.select("p_partkey", X.text_join("; ", True, *cells).alias("skip"), X.text_join("; ", False, *cells).alias("keep"))


@check(
    "f_if",
    """SELECT doc_id, CASE WHEN toxic <> 0 THEN quality ELSE -1 END AS num, CASE quality WHEN 1 THEN 1 ELSE 0 END AS txt, CASE WHEN toxic = 1 THEN NULL WHEN quality = 1 THEN 1 ELSE 2 END AS err FROM labels""",
)
def _(t):
    flag = F.when(F.col("quality") == 1, " true ").otherwise("FALSE")
    odd = F.when(F.col("toxic") == 1, "maybe").when(F.col("quality") == 1, "TRUE")
    return t.labels.select(
        "doc_id",
        L.if_(F.col("toxic"), "integer", F.col("quality"), F.lit(-1)).alias("num"),
        L.if_(flag, "string", F.lit(1), F.lit(None).cast("int")).alias("txt"),
        L.if_(odd, "string", F.lit(1), F.lit(2)).alias("err"),
    )


@check(
    "f_switch",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS s, CASE o_orderstatus WHEN 'F' THEN 1 END AS n FROM orders",
)
def _(t):
    c = F.col("o_orderstatus")
    return t.orders.select("o_orderkey", L.switch(c, "F", "done", "O", "open", "other").alias("s"), L.switch(c, "F", 1).alias("n"))


@check(
    "f_choose",
    "SELECT p_partkey, CASE p_size WHEN 1 THEN p_name WHEN 2 THEN 'two' WHEN 3 THEN p_brand END AS c FROM part",
)
def _(t):
    return t.part.select("p_partkey", L.choose(F.col("p_size") + 0.7, F.col("p_name"), F.lit("two"), F.col("p_brand")).alias("c"))


@check(
    "f_parse_typed",
    """WITH s AS (SELECT o_orderkey, o_custkey, o_orderkey % 6 AS k, o_orderdate, o_orderpriority FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN 'number' WHEN 1 THEN 'percent' WHEN 2 THEN 'date' WHEN 3 THEN 'logical' WHEN 4 THEN 'text' ELSE 'blank' END AS kind,
 CASE k WHEN 0 THEN o_custkey + 0.5 WHEN 1 THEN CAST(o_custkey AS DOUBLE) / 100 WHEN 2 THEN date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) END AS number,
 CASE k WHEN 3 THEN 'TRUE' WHEN 4 THEN o_orderpriority END AS text FROM s""",
)
def _(t):
    k = F.col("o_orderkey") % 6
    typed = (
        F.when(k == 0, F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(".5")))
        .when(k == 1, F.concat(F.col("o_custkey").cast("string"), F.lit(" %")))
        .when(k == 2, F.date_format("o_orderdate", "M/d/yyyy"))
        .when(k == 3, "True")
        .when(k == 4, F.col("o_orderpriority"))
        .otherwise("")
    )
    return t.orders.select("o_orderkey", L.parse_typed(typed).alias("p")).select("o_orderkey", "p.*")


@check(
    "f_serial",
    """WITH s AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, DATE '1900-01-01' + CAST(o_orderkey % 90 AS INT) AS early FROM orders)
SELECT o_orderkey, CAST(date_diff('day', DATE '1899-12-30', d) AS DOUBLE) AS serial, CAST(d AS TIMESTAMP) AS back,
 CAST(date_diff('day', DATE '1899-12-30', early) - CASE WHEN early < DATE '1900-03-01' THEN 1 ELSE 0 END AS DOUBLE) AS old, CAST(early AS TIMESTAMP) AS old_back FROM s""",
)
def _(t):
    early = F.date_add(F.lit("1900-01-01").cast("date"), (F.col("o_orderkey") % 90).cast("int"))
    d = t.orders.select("o_orderkey", D.date_to_serial(F.col("o_orderdate")).alias("serial"), D.date_to_serial(early).alias("old"))
    return d.withColumns({"back": D.serial_to_timestamp(F.col("serial")), "old_back": D.serial_to_timestamp(F.col("old"))})


@check(
    "f_iso",
    """SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') AS iso, round(date_diff('day', DATE '1899-12-30', CAST(ts AS DATE)) + (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 86400.0, 8) AS serial,
 strftime(ts, '%Y-%m-%d') AS day, CAST(NULL AS DOUBLE) AS bad FROM events""",
)
def _(t):
    ts = F.col("ts")
    iso = D.serial_to_iso(D.date_to_serial(ts), timed=True)
    day = D.serial_to_iso(D.date_to_serial(ts.cast("date")))
    return t.events.select("event_id", iso.alias("iso"), F.round(D.iso_to_serial(iso), 8).alias("serial"), day.alias("day"), D.iso_to_serial(F.lit("2026-02-30")).alias("bad"))


@check(
    "f_duration",
    """SELECT event_id, 'PT' || (event_id // 3600) || 'H' || (event_id % 3600 // 60) || 'M' || (event_id % 60) || 'S' AS d, round(event_id / 86400.0, 9) AS f FROM events""",
)
def _(t):
    text = D.serial_to_duration(F.col("event_id") / F.lit(86400.0))
    return t.events.select("event_id", text.alias("d"), F.round(D.duration_to_serial(text), 9).alias("f"))


@check(
    "f_parse_date",
    """WITH s AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders), n AS (SELECT *, day(d) AS dd, month(d) AS mm FROM s)
SELECT o_orderkey, CAST(date_diff('day', DATE '1899-12-30', d) AS DOUBLE) AS dmy,
 CAST(date_diff('day', DATE '1899-12-30', CASE WHEN dd > 12 THEN d ELSE make_date(year(d), dd, mm) END) AS DOUBLE) AS mdy,
 CAST(date_diff('day', DATE '1899-12-30', d) + 0.5 AS DOUBLE) AS timed, CAST(NULL AS DOUBLE) AS bad FROM n""",
)
def _(t):
    d = F.col("o_orderdate")
    text = F.date_format(d, "d/M/yyyy")
    return t.orders.select(
        "o_orderkey",
        D.parse_date(text, "dmy").alias("dmy"),
        D.parse_date(text, "mdy").alias("mdy"),
        D.parse_date(F.date_format(d, "yyyy/MM/dd 12:00"), "mdy").alias("timed"),
        D.parse_date(F.concat(F.lit("31/"), F.lit("02/"), F.date_format(d, "yyyy")), "dmy").alias("bad"),
    )


@check(
    "f_format",
    """SELECT o_orderkey, printf('%.2f', o_totalprice) AS number, format('{:,.2f}', o_totalprice) AS thousands, printf('%.2f', CAST(o_custkey AS DOUBLE)) || '%' AS percent, '$' || format('{:,.2f}', o_totalprice) AS usd,
 format('{:,.2f}', o_totalprice) || ' €' AS eur, '¥' || format('{:,}', o_custkey * 1000) AS jpy, strftime(o_orderdate, '%m/%d/%Y') AS d, strftime(o_orderdate, '%d/%m/%Y 00:00') AS dt FROM orders""",
)
def _(t):
    p, s = F.col("o_totalprice"), D.date_to_serial(F.col("o_orderdate"))
    k = F.col("o_custkey").cast("double")
    return t.orders.select(
        "o_orderkey",
        FM.format_value(p, "number").alias("number"),
        FM.format_value(p, "thousands").alias("thousands"),
        FM.format_value(k / 100, "percent").alias("percent"),
        FM.format_value(p, "currency", "en").alias("usd"),
        FM.format_value(p, "currency", "fr").alias("eur"),
        FM.format_value(k * 1000, "currency", "ja").alias("jpy"),
        FM.format_value(s, "date", "en").alias("d"),
        FM.format_value(s, "datetime", "fr").alias("dt"),
    )


@check(
    "f_num_text",
    """SELECT p_partkey, CAST(CAST(p_partkey AS BIGINT) AS VARCHAR) AS whole, CAST(p_size / 8 AS VARCHAR) AS eighth, CAST(p_retailprice AS VARCHAR) AS price FROM part""".replace("CAST(p_size / 8 AS VARCHAR)", "regexp_replace(CAST(p_size / 8 AS VARCHAR), '\\.0$', '')").replace("CAST(p_retailprice AS VARCHAR)", "regexp_replace(CAST(p_retailprice AS VARCHAR), '\\.0$', '')"),
)
def _(t):
    return t.part.select(
        "p_partkey",
        number_text(F.col("p_partkey").cast("double")).alias("whole"),
        number_text(F.col("p_size") / 8).alias("eighth"),
        number_text(F.col("p_retailprice") + 0.1 - 0.1).alias("price"),
    )


@check(
    "f_native",
    """SELECT o_orderkey, o_custkey > 10 AND o_orderstatus = 'F' AS both, CAST(o_custkey AS DOUBLE) - 7 * floor(o_custkey / 7) AS m, -CAST(o_custkey AS DOUBLE) - 7 * floor(-o_custkey / 7) AS neg, length(o_orderpriority) AS n,
 CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS mo, floor(o_totalprice / 100) * 100 AS fl, o_orderstatus || '-' || o_orderpriority AS c, round(log10(o_totalprice), 9) AS lg FROM orders""",
)
def _(t):
    k, seven = F.col("o_custkey").cast("double"), F.lit(7.0)
    return t.orders.select(
        "o_orderkey",
        L.all_true(F.col("o_custkey") > 10, F.col("o_orderstatus") == "F").alias("both"),
        L.modulo(k, seven).alias("m"),
        L.modulo(-k, seven).alias("neg"),
        F.length("o_orderpriority").cast("bigint").alias("n"),
        F.year("o_orderdate").alias("y"),
        F.month("o_orderdate").alias("mo"),
        L.floor_to(F.col("o_totalprice"), F.lit(100.0)).cast("double").alias("fl"),
        F.concat("o_orderstatus", F.lit("-"), "o_orderpriority").alias("c"),
        F.round(L.log10(F.col("o_totalprice")), 9).alias("lg"),
    )


@check(
    "u_sql_fn",
    """SELECT o_orderkey, upper(o_orderpriority) AS u, CAST(o_custkey AS DOUBLE) - 7 * floor(o_custkey / 7) AS m, o_totalprice / 4 AS s, date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS d, split_part(o_orderpriority, '-', 1) AS b, CAST(o_custkey AS DOUBLE) / 100 AS v FROM orders""",
)
def _(t):
    sqlfn.register(t.spark)
    return t.orders.selectExpr(
        "o_orderkey",
        "ws_upper(o_orderpriority) AS u",
        "ws_mod(o_custkey, 7) AS m",
        "ws_sln(o_totalprice, 0, 4) AS s",
        "CAST(ws_serial(CAST(o_orderdate AS DATE)) AS BIGINT) AS d",
        "ws_textbefore(o_orderpriority, '-') AS b",
        "ws_value(concat(o_custkey, '%')) AS v",
    )
