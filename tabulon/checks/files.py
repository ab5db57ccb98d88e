"""Sources and sinks (S, K) on files that Spark writes from the shared tables."""

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from tabulon.checks.registry import check
from tabulon.functions import formats as FM
from tabulon.plans.steps import Steps
from tabulon.scale.storage import scratch_path
from tabulon.sources import delimited as D
from tabulon.sources import documents as S
from tabulon.sources import sinks as K
from tabulon.sources import workbooks as W


def awkward(t):
    """Part names with delimiters, quotes and line breaks in them."""
    k = F.col("p_partkey") % 4
    name = (
        F.when(k == 0, F.concat(F.lit("a;"), F.col("p_name")))
        .when(k == 1, F.concat(F.lit('say "'), F.col("p_name"), F.lit('"')))
        .when(k == 2, F.concat(F.col("p_name"), F.lit("\nnext")))
        .otherwise(F.concat(F.lit("  "), F.col("p_name"), F.lit(" ")))
    )
    return t.part.select("p_partkey", name.alias("name"), F.nullif("p_brand", F.lit("Brand#1")).alias("brand"), "p_retailprice", (F.col("p_size") > 25).alias("big"))


_AWKWARD = """(SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a;' || p_name WHEN 1 THEN 'say "' || p_name || '"' WHEN 2 THEN p_name || chr(10) || 'next' ELSE '  ' || p_name || ' ' END AS name,
 nullif(p_brand, 'Brand#1') AS brand, p_retailprice, p_size > 25 AS big FROM part)"""
_AS_TEXT = f"""SELECT CAST(p_partkey AS VARCHAR) AS "Column1", name AS "Column2", brand AS "Column3", regexp_replace(CAST(p_retailprice AS VARCHAR), '\\.0$', '') AS "Column4", upper(CAST(big AS VARCHAR)) AS "Column5" FROM {_AWKWARD}"""


def written(t, df, delimiter=",", header=False):
    path = scratch_path(t.spark, "csv")
    D.write_delimited(df, path, delimiter, header)
    return path


@check("src_sniff", "SELECT p_partkey, (SELECT count(*) FROM part) AS n, d AS delimiter FROM part, (VALUES (';'), ('|'), (chr(9)), (',')) v(d)")
def _(t):
    out = None
    d = t.part.select("p_partkey", "p_brand", "p_size")
    for mark in (";", "|", "\t", ","):
        path = written(t, d, mark)
        found = D.sniff_delimiter(t.spark, path)
        rows = D.read_delimited(t.spark, path, found)
        one = rows.select(F.col("Column1").cast("bigint").alias("p_partkey"), rows.agg(F.count(F.lit(1))).scalar().alias("n"), F.lit(found).alias("delimiter"))
        out = one if out is None else out.unionByName(one)
    return out


@check("src_csv", _AS_TEXT)
def _(t):
    return D.read_delimited(t.spark, written(t, awkward(t), ";"))


@check(
    "src_csv_breaks",
    """SELECT CASE WHEN p_partkey % 3 <> 1 THEN p_partkey::VARCHAR END AS "Column1",
 CASE p_partkey % 3 WHEN 0 THEN p_name || chr(13) || chr(10) || 'x "y", z' WHEN 2 THEN p_name END AS "Column2",
 CASE p_partkey % 3 WHEN 0 THEN 'a' || chr(30) || 'b' WHEN 2 THEN 'z' END AS "Column3" FROM part""",
)
def _(t):
    """Line breaks and quotes inside fields, blank lines, CRLF and a control character."""
    k, key = F.col("p_partkey") % 3, F.col("p_partkey").cast("string")
    quoted = F.concat(key, F.lit(',"'), F.col("p_name"), F.lit('\r\nx ""y"", z",a\x1eb'))
    line = F.when(k == 0, quoted).when(k == 1, "").otherwise(F.concat(key, F.lit(","), F.col("p_name"), F.lit(",z\r")))
    path = scratch_path(t.spark, "lines")
    t.part.select(line).write.text(path)
    return D.read_delimited(t.spark, path, ",")


@check(
    "infer_types",
    f"""SELECT CAST(p_partkey AS DOUBLE) AS "Column1", name AS "Column2", brand AS "Column3", p_retailprice AS "Column4", big AS "Column5" FROM {_AWKWARD}""",
)
def _(t):
    return D.infer_types(D.read_delimited(t.spark, written(t, awkward(t), ";"), ";"))


@check("header_names", """SELECT p_partkey AS "Name", p_name AS "name2", p_brand AS "Column3", p_size AS "NAME3" FROM part""")
def _(t):
    return D.apply_header(t.part.select("p_partkey", "p_name", "p_brand", "p_size"), [" Name ", "name", "  ", "NAME"])


def cells(t):
    """Customers as a sparse sheet: header in row 3, one cell per filled value."""
    from tabulon.scale.ordering import row_index

    cell = lambda col, kind, value: F.struct(F.lit(col).alias("col"), F.lit(kind).alias("kind"), value.alias("value"))
    d = row_index(t.customer, ["c_custkey"], "i").select(
        (F.col("i") + 4).cast("int").alias("row"),
        F.array(
            cell(2, "n", F.col("c_custkey").cast("string")),
            cell(3, "s", F.nullif("c_mktsegment", F.lit("BUILDING"))),
            cell(4, "b", F.upper((F.col("c_acctbal") > 0).cast("string"))),
        ).alias("c"),
    )
    body = d.select(F.lit("Data").alias("sheet"), "row", F.inline("c")).where(F.col("value").isNotNull())
    head = [("Data", 3, 2, "s", "key"), ("Data", 3, 3, "s", "segment"), ("Data", 3, 4, "s", "KEY"), ("Other", 3, 2, "s", "x")]
    return t.spark.createDataFrame(head, "sheet string, row int, col int, kind string, value string").unionByName(body)


@check(
    "table_from_cells",
    """SELECT row_number() OVER (ORDER BY c_custkey) + 3 AS row, CAST(c_custkey AS DOUBLE) AS "key", nullif(c_mktsegment, 'BUILDING') AS segment, c_acctbal > 0 AS "KEY2" FROM customer
UNION ALL SELECT count(*) + 4, NULL, NULL, NULL FROM customer""",
)
def _(t):
    return S.table_from_cells(cells(t), "Data", 3, 2, 4 + t.customer.count(), 4)


def workbook(rows: pd.DataFrame) -> bytes:
    """A minimal workbook: one sheet, inline text, numbers, booleans, ISO dates and a named table."""
    esc = lambda s: str(s).replace("&", "&amp;").replace("<", "&lt;")
    lines = ['<row r="1"><c r="A1" t="inlineStr"><is><t>key</t></is></c><c r="B1" t="s"><v>0</v></c><c r="C1" t="str"><v>rich</v></c><c r="D1" t="str"><v>since</v></c></row>']
    for i, r in enumerate(rows.itertuples(), 2):
        lines.append(
            f'<row r="{i}"><c r="A{i}"><v>{r.c_custkey}</v></c><c r="B{i}" t="inlineStr"><is><t>{esc(r.c_name)}</t></is></c>'
            f'<c r="C{i}" t="b"><v>{int(r.c_acctbal > 5000)}</v></c><c r="D{i}" t="d"><v>2020-01-{r.c_nationkey + 1:02d}</v></c></row>'
        )
    last = len(rows) + 1
    names = "".join(f'<tableColumn id="{i}" name="{n}"/>' for i, n in enumerate(("key", "name", "rich", "since"), 1))
    parts = {
        "xl/workbook.xml": '<workbook xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><r><t>na</t></r><r><t>me</t></r><rPh><t>x</t></rPh></si></sst>",
        "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{''.join(lines)}</sheetData></worksheet>",
        "xl/worksheets/_rels/sheet1.xml.rels": '<Relationships><Relationship Id="rId1" Target="../tables/table1.xml"/></Relationships>',
        "xl/tables/table1.xml": f'<table displayName="Customers" ref="A1:D{last}"><tableColumns>{names}</tableColumns></table>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def workbooks(t):
    """Every 100 customers become one workbook."""

    def make(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("c_custkey")
        return pd.DataFrame({"path": [f"book-{rows['c_custkey'].iloc[0] // 100}.xlsx"], "content": [workbook(rows)]})

    block = F.floor(F.col("c_custkey") / 100)
    rows = t.customer.select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    return rows.groupBy(block).applyInPandas(make, "path string, content binary")


@check(
    "src_workbooks",
    """WITH c AS (SELECT *, 'book-' || (c_custkey // 100) || '.xlsx' AS path, row_number() OVER (PARTITION BY c_custkey // 100 ORDER BY c_custkey) + 1 AS r FROM customer)
SELECT path, 'Data' AS sheet, CAST(r AS INT) AS row, 1 AS col, 'n' AS kind, CAST(c_custkey AS VARCHAR) AS value FROM c UNION ALL SELECT path, 'Data', CAST(r AS INT), 2, 's', c_name FROM c
UNION ALL SELECT path, 'Data', CAST(r AS INT), 3, 'b', CASE WHEN c_acctbal > 5000 THEN 'TRUE' ELSE 'FALSE' END FROM c UNION ALL SELECT path, 'Data', CAST(r AS INT), 4, 'n', CAST(43831 + c_nationkey AS VARCHAR) FROM c
UNION ALL SELECT DISTINCT path, 'Data', 1, k, 's', ['key', 'name', 'rich', 'since'][k] FROM c, (VALUES (1), (2), (3), (4)) v(k)""",
)
def _(t):
    return W.workbook_cells(workbooks(t)).drop("formula")


@check(
    "src_tables",
    """SELECT 'book-' || (c_custkey // 100) || '.xlsx' AS path, 'Data' AS sheet, 'Customers' AS name, 1 AS first_row, 1 AS first_col, CAST(count(*) + 1 AS INT) AS last_row, 4 AS last_col, true AS header, 'key,name,rich,since' AS columns FROM customer GROUP BY 1""",
)
def _(t):
    return W.workbook_tables(workbooks(t)).withColumn("columns", F.array_join("columns", ","))


@check("src_csv_doc", f"""SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, name, regexp_replace(CAST(p_retailprice AS VARCHAR), '\\.0$', '') AS p_retailprice FROM {_AWKWARD}""")
def _(t):
    d = awkward(t).select("p_partkey", "name", "p_retailprice")
    return D.read_csv_document(t.spark, written(t, d, ",", header=True))


@check("src_json", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(t):
    return S.read_json_document(t.spark, _documents(t), "o_orderkey bigint, o_orderstatus string, o_totalprice double", S.SEQUENCE)


def _documents(t):
    """Orders as JSON documents, each an array of a bounded block of records; files hold many documents."""
    path = scratch_path(t.spark, "json")
    rows = t.orders.withColumn("r", F.to_json(F.struct("o_orderkey", "o_orderstatus", "o_totalprice")))
    docs = rows.groupBy(F.floor(F.col("o_orderkey") / 200).alias("doc")).agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("r"), ",\n"), F.lit("]")).alias("value"))
    docs.select("value").write.text(path, lineSep=S.SEQUENCE)
    return path


@check("src_odata", "SELECT c_custkey, c_name FROM customer")
def _(t):
    path = scratch_path(t.spark, "odata")
    page = F.floor(F.col("c_custkey") / 100)
    rows = t.customer.groupBy(page.alias("page")).agg(F.collect_list(F.struct("c_custkey", "c_name")).alias("value"))
    link = F.concat(F.lit("page-"), (F.col("page") + 1).cast("string")).alias("@odata.nextLink")
    rows.select(F.to_json(F.struct(link, "value"))).write.text(path, lineSep=S.SEQUENCE)
    return S.read_odata(t.spark, path, separator=S.SEQUENCE)


def _folder(t):
    path = scratch_path(t.spark, "files")
    t.customer.select("c_mktsegment", "c_name").write.partitionBy("c_mktsegment").text(path)
    return path


@check("src_folder", """SELECT '.txt' AS "Extension", c_name AS line, true AS named, count(*) AS n FROM customer GROUP BY 2""")
def _(t):
    files = S.list_folder(t.spark, _folder(t)).where(F.col("Extension") == ".txt")
    line = F.explode(F.split(F.regexp_replace(F.col("Content").cast("string"), "\n$", ""), "\n"))
    read = files.select("Extension", F.col("Name").rlike(r"^part-.*[.]txt$").alias("named"), line.alias("line"))
    return read.groupBy("Extension", "line", "named").agg(F.count(F.lit(1)).alias("n"))


@check("src_blank", "SELECT r_name AS \"Column1\" FROM region")
def _(t):
    return S.blank_source(t.spark).unionByName(t.region.select(F.col("r_name").alias("Column1")))


@check("src_file", "SELECT CAST(sum(length(c_name) + 1) AS BIGINT) AS bytes FROM customer")
def _(t):
    path = scratch_path(t.spark, "files")
    t.customer.select("c_name").write.text(path)
    names = S.list_folder(t.spark, path).where(F.col("Extension") == ".txt").select("Name").collect()
    files = S.file_contents(t.spark, path, *["some/folder/" + r["Name"] for r in names])
    return files.agg(F.sum(F.length("Content")).cast("bigint").alias("bytes"))


@check("src_catalog", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def _(t):
    t.customer.createOrReplaceTempView("check_customers")
    book = S.Catalog(t.spark)
    listed = book.names().where(F.col("Name") == "check_customers").first()[0]
    return book.content(listed).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@check("sink_csv", _AS_TEXT.replace("AS VARCHAR) AS \"Column1\"", "AS VARCHAR) AS \"Column1\""))
def _(t):
    return D.read_delimited(t.spark, written(t, awkward(t), ","), ",")


@check("sink_load", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY 1")
def _(t):
    d = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("s"))
    K.load_table(t.customer, "Orders by priority!")
    K.load_table(d, "Orders by priority!")
    return t.spark.table(K.target_table(t.spark, "Orders by priority!"))


@check(
    "sink_text",
    """SELECT CAST(o_orderkey AS VARCHAR) AS k, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS t, strftime(o_orderdate, '%Y-%m-%d') AS d, CASE WHEN o_custkey > 700 THEN 'TRUE' ELSE 'FALSE' END AS b,
 regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', '') AS p, '' AS none, (o_orderkey // 86400) || '.' || strftime(make_timestamp(0) + to_seconds(o_orderkey % 86400), '%H:%M:%S') AS span FROM orders""",
)
def _(t):
    d = t.orders.select(
        F.col("o_orderkey").alias("k"),
        F.col("o_orderdate").alias("t"),
        F.col("o_orderdate").cast("date").alias("d"),
        (F.col("o_custkey") > 700).alias("b"),
        F.col("o_totalprice").alias("p"),
        F.lit(None).cast("double").alias("none"),
        F.make_dt_interval(secs=F.col("o_orderkey")).alias("span"),
    )
    return d.select(*[FM.result_text(d, c).alias(c) for c in d.columns])


@check(
    "sink_refresh",
    """SELECT 'Totals' AS query, 'ok' AS status, count(DISTINCT o_orderstatus) AS rows, NULL AS detail FROM orders UNION ALL SELECT 'Broken', 'failed', NULL, 'ZeroDivisionError'
UNION ALL SELECT 'Number', 'notTable', NULL, 'int' UNION ALL SELECT 'Lost one', 'noTarget', NULL, 'Lost_one'""",
)
def _(t):
    totals = lambda: Steps(t.orders).add("Grouped", lambda d: d.groupBy("o_orderstatus").count()).run()
    K.load_table(t.orders.select("o_orderstatus").distinct(), "Totals")
    return K.refresh(t.spark, {"Totals": totals, "Broken": lambda: 1 // 0, "Number": lambda: 42, "Lost one": totals})
