"""Readers and writers on small files."""

import io
import json
import random
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabulon.sources import delimited as D
from tabulon.sources import documents as S
from tabulon.sources import sinks as K
from tabulon.sources import workbooks as W
from tabulon.sources.naming import header_names, table_name


@pytest.mark.parametrize(
    "text,mark",
    [("a;b\n1;2\n", ";"), ("a\tb\n1\t2", "\t"), ("a|b\n1|2", "|"), ('"a,b";c\n"d,e";f\n', ";"), ("a,b\n1,2", ","), ("plain\ntext", ","), ("a,b;c\n1,2;3\n", ","), ("", ",")],
)
def test_sniff(spark, tmp_path, text, mark):
    (tmp_path / "f.csv").write_text(text)
    assert D.sniff_delimiter(spark, str(tmp_path)) == mark


def test_ragged_quoted_and_crlf(spark, tmp_path):
    (tmp_path / "f.csv").write_bytes(b'0042,3.50,kg\r\n"the ""old"" mill","upper\nfloor"\r\n,"k,m",z,end')
    got = {tuple(r) for r in D.read_delimited(spark, str(tmp_path)).collect()}
    assert got == {("0042", "3.50", "kg", None), (None, "k,m", "z", "end"), ('the "old" mill', "upper\nfloor", None, None)}


def _plain_rows(text):
    """Rows by a walk over the characters: breaks count where the number of quotes so far is even."""
    rows, row, quotes, i = [], "", 0, 0
    while i < len(text):
        c = text[i]
        quotes += c == '"'
        if c in "\r\n" and quotes % 2 == 0:
            i += c == "\r" and text[i + 1 : i + 2] == "\n"
            rows.append(row)
            row = ""
        else:
            row += c
        i += 1
    return rows + [row] * bool(row)


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("seed", range(2))
def test_rows_are_cut_right_at_any_split(spark, tmp_path, small_splits, seed):
    rng = random.Random(seed)
    parts = ["alpha", "b", ",", ",", "\n", "\r\n", "\r", '"x\ny"', '"p\r\nq,""r"""', '"' + "long \n" * 30 + '"', "\u001e", "\u001e1", "ü", "\n\n", '""']
    want = []
    for f in range(3):
        text = "".join(rng.choice(parts[: 7 if f == 2 else 15]) for _ in range(150)) + rng.choice(["", "\n", "end"])
        (tmp_path / f"{f}.csv").write_bytes(text.encode())
        want.append(_plain_rows(text))
    lines = D._lines(spark, str(tmp_path))
    assert lines.select("file", "block").distinct().count() > 10
    got = {}
    for r in D._rows(lines).collect():
        got.setdefault(r["file"][-5], []).append(r["value"])
    assert {k: Counter(v) for k, v in got.items()} == {str(f): Counter(rows) for f, rows in enumerate(want)}
    firsts = {r["file"][-5]: r["value"] for r in D._rows(lines).where("first").collect()}
    assert firsts == {str(f): rows[0] for f, rows in enumerate(want)}
    cells = D.read_delimited(spark, str(tmp_path), ",")
    assert cells.count() == sum(map(len, want))


def test_an_open_quote_takes_the_rest_of_the_file(spark, tmp_path, small_splits):
    body = "\n".join(f"{i},row" for i in range(60))
    (tmp_path / "f.csv").write_text('a,b\n1,"' + body)
    got = [tuple(r) for r in D.read_delimited(spark, str(tmp_path), ",").collect()]
    assert sorted(got) == [("1", body), ("a", "b")]


def test_headed_csv_keeps_blank_lines_and_breaks(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_bytes(b'site,site,note\n\nx,1,one\n\ny,2,"two\r\nlines"\n' + b"z,3,more,extra\n" * 20)
    (tmp_path / "b.csv").write_bytes(b"site,site,note\nw,4,\x1e\n")
    got = D.read_csv_document(spark, str(tmp_path))
    assert got.columns == ["site", "site2", "note", "Column4"]
    rows = Counter(tuple(r) for r in got.collect())
    assert rows == Counter({(None,) * 4: 2, ("x", "1", "one", None): 1, ("y", "2", "two\r\nlines", None): 1, ("z", "3", "more", "extra"): 20, ("w", "4", "\x1e", None): 1})
    (tmp_path / "a.csv").write_text("site,site,note\n\nx,1,one\n")
    (tmp_path / "b.csv").write_text("")
    assert [tuple(r) for r in D.read_csv_document(spark, str(tmp_path)).collect()] == [(None, None, None), ("x", "1", "one")]


def test_hint_beats_sniffing_and_blocks_split(spark, tmp_path):
    (tmp_path / "f.txt").write_text("a,b\tc\n1,2\t3\n")
    assert D.read_delimited(spark, str(tmp_path), hint="tsv").columns == ["Column1", "Column2"]
    assert [tuple(r) for r in D.read_delimited(spark, str(tmp_path), hint="tsv").collect()] == [("a,b", "c"), ("1,2", "3")]


def test_types_and_names(table):
    d = D.infer_types(table("a string, b string, c string", ("1", "true", "x"), ("", "FALSE", "2"), ("2.5e1", None, None)))
    assert [f.dataType.simpleString() for f in d.schema.fields] == ["double", "boolean", "string"]
    assert header_names([" a ", "A", None, "a2", "a"]) == ["a", "A2", "Column3", "a22", "a3"]
    assert table_name("My query!é.1") == "My_query_é.1"


def test_json_odata_folder(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "1.json").write_text(json.dumps({"value": [{"Tool": "Rake", "Total": 31}], "@odata.nextLink": "2"}, indent=1))
    (pages / "2.json").write_text(json.dumps({"value": [{"Tool": "Spade", "Stock": 7}]}))
    got = {r.Tool: (r.Stock, r.Total) for r in S.read_odata(spark, str(pages)).collect()}
    assert got == {"Rake": (None, 31), "Spade": (7, None)}
    (pages / "raw").write_bytes(b"x")
    names = {r.Name: r.Extension for r in S.list_folder(spark, str(pages)).collect()}
    assert names == {"1.json": ".json", "2.json": ".json", "raw": ""}
    assert bytes(S.file_contents(spark, str(pages), "any/raw").first().Content) == b"x"
    with pytest.raises(FileNotFoundError):
        S.file_contents(spark, str(pages), "raw", "none.txt")
    assert S.blank_source(spark).columns == ["Column1"] and S.blank_source(spark).count() == 0


def test_load_replaces_and_refresh_reports(spark, table):
    assert K.load_table(table("a int", (1,), (2,)), "My load") == 2
    assert K.load_table(table("b string", ("x",)), "My load") == 1
    assert spark.table("My_load").columns == ["b"]

    def broken():
        raise KeyError("gone")

    got = {r.query: (r.status, r.rows) for r in K.refresh(spark, {"My load": lambda: table("c int", (7,), (8,)), "New": lambda: table("a int", (1,)), "Bad": broken}).collect()}
    assert got == {"My load": ("ok", 2), "New": ("noTarget", None), "Bad": ("failed", None)}


def test_open_document_cells(spark):
    ns = 'xmlns:office="urn:o" xmlns:table="urn:t" xmlns:text="urn:x"'
    content = f"""<office:document-content {ns}><office:body><office:spreadsheet><table:table table:name="S">
<table:table-row><table:table-cell office:value-type="string"><text:p>head</text:p></table:table-cell><table:table-cell table:number-columns-repeated="2" office:value-type="float" office:value="4"><text:p>4.0</text:p></table:table-cell></table:table-row>
<table:table-row table:number-rows-repeated="3"><table:table-cell/></table:table-row>
<table:table-row table:number-rows-repeated="2"><table:covered-table-cell/><table:table-cell office:value-type="date" office:date-value="2020-01-01"><text:p>x</text:p></table:table-cell></table:table-row>
<table:table-row><table:table-cell office:value-type="boolean" office:boolean-value="true"/><table:table-cell office:value-type="time" office:time-value="PT12H"/></table:table-row>
</table:table><table:database-ranges><table:database-range table:name="T" table:target-range-address="S.A1:S.C6"/><table:database-range table:name="__Anonymous_1" table:target-range-address="S.A1:S.C6"/></table:database-ranges></office:spreadsheet></office:body></office:document-content>"""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("content.xml", content)
    files = spark.createDataFrame([("b.ods", bytearray(out.getvalue()))], "path string, content binary")
    got = sorted((r.row, r.col, r.kind, r.value) for r in W.workbook_cells(files).collect())
    assert got == [(1, 1, "s", "head"), (1, 2, "n", "4"), (1, 3, "n", "4"), (5, 2, "n", "43831"), (6, 2, "n", "43831"), (7, 1, "b", "TRUE"), (7, 2, "n", "0.5")]
    t = W.workbook_tables(files).collect()
    assert [(r.sheet, r.name, r.first_row, r.last_col, r.header) for r in t] == [("S", "T", 1, 3, True)]


def _styled_book() -> bytes:
    """A sheet whose columns are a date, a moment, a share, an amount and a plain number, told apart by styles only."""
    codes = [None, "14", "164", "10", "165", "0", "166"]
    own = {"164": "yyyy\\-mm\\-dd&quot; at &quot;hh:mm", "165": "[Red]#,##0.00 &quot;days&quot;;-0", "166": "[h]:mm"}
    cells = [("A", 1, 43831), ("B", 2, 43831.75), ("C", 3, 0.256), ("D", 4, 1234567.891), ("E", 5, 7.5), ("F", 6, 1.25)]
    rows = "".join(f'<row r="{r}">' + "".join(f'<c r="{c}{r}" s="{s}"><v>{v + (r - 2) * (c in "AB")}</v></c>' for c, s, v in cells) + "</row>" for r in (2, 3))
    head = "".join(f'<c r="{c}1" t="str"><v>h{c}</v></c>' for c, _, _ in cells)
    xfs = "".join(f'<xf numFmtId="{n or 0}"/>' for n in codes)
    formats = "".join(f'<numFmt numFmtId="{k}" formatCode="{v}"/>' for k, v in own.items())
    parts = {
        "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="S" sheetId="1" r:id="i"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="i" Target="worksheets/s.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet><numFmts>{formats}</numFmts><cellStyleXfs><xf numFmtId="9"/></cellStyleXfs><cellXfs>{xfs}</cellXfs></styleSheet>',
        "xl/worksheets/s.xml": f'<worksheet><sheetData><row r="1">{head}</row>{rows}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_styles_tell_dates_from_numbers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "styled.xlsx").write_bytes(_styled_book())
    (tmp_path / "notes.txt").write_text("x")
    cells = W.workbook_cells(W.workbook_files(spark, str(tmp_path)), formats=True)
    shown = {(r["row"], r["col"]): r["display"] for r in cells.where("row = 2").collect()}
    assert shown == {(2, 1): "2020-01-01", (2, 2): "2020-01-01 18:00:00", (2, 3): "25.60%", (2, 4): "1,234,567.89", (2, 5): "7.5", (2, 6): "30:00:00"}
    t = S.table_from_cells(cells, "S", 1, 1, 3, 6)
    assert [f.dataType.simpleString() for f in t.schema][1:] == ["date", "timestamp_ntz", "double", "double", "double", "double"]
    assert [str(r["hA"]) for r in t.orderBy("row").collect()] == ["2020-01-01", "2020-01-02"]
    plain = S.table_from_cells(W.workbook_cells(W.workbook_files(spark, str(tmp_path))), "S", 1, 1, 3, 2)
    assert plain.orderBy("row").first()["hA"] == 43831.0
