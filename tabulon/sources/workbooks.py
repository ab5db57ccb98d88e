"""Many workbook files as one table of cells.

Spark lists and distributes the files; a small reader turns each file's bytes into raw cells, and all
typing happens afterwards as column expressions.
"""

from __future__ import annotations

import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabulon.functions.dates import duration_to_serial, iso_to_serial
from tabulon.functions.values import number_text
from tabulon.sources.styles import BUILT_IN, OPEN_DOCUMENT, display_text

RAW_CELLS = "path string, sheet string, row int, col int, raw string, value string, formula string, num_fmt string, rows int, cols int"
TABLES = (
    "path string, sheet string, name string, first_row int, first_col int, last_row int, last_col int, "
    "header boolean, columns array<string>"
)
_CHUNK = 4_000


def workbook_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of every workbook in the folder and those below; other files are not read."""
    either = "*.{[xX][lL][sS][xX],[xX][lL][sS][mM],[oO][dD][sS]}"
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=either).load(path)
    return files.select("path", "content")


def workbook_cells(files: DataFrame, formats: bool = False) -> DataFrame:
    """``path, sheet, row, col, kind, value, formula`` of every filled cell; kinds are n, s, b and e.

    With ``formats`` also ``num_fmt``, the format code of a number's style (null: general), and ``display``, the text shown.
    """
    # A repeated row or cell leaves the parser once, with its counts, and is spread out here.
    raw = files.select("path", "content").mapInArrow(_cells_of_batches, RAW_CELLS)
    raw = raw.withColumn("row", F.explode(F.expr("sequence(row, row + rows - 1)")))
    raw = raw.withColumn("col", F.explode(F.expr("sequence(col, col + cols - 1)")))
    v = F.col("value")
    serial = F.when(F.col("raw") == "date", iso_to_serial(v)).when(F.col("raw") == "time", duration_to_serial(v))
    kind = (
        F.when(F.col("raw").isin("date", "time"), F.when(serial.isNotNull(), "n").otherwise("s"))
        .when(F.col("raw") == "n", "n")
        .when(F.col("raw").isin("b", "e"), F.col("raw"))
        .otherwise("s")
    )
    cells = raw.withColumn("kind", kind).withColumn("value", F.coalesce(number_text(serial), v))
    filled = cells.where((F.col("value") != "") | F.col("formula").isNotNull())
    named = ["path", "sheet", "row", "col", "kind", "value", "formula"]
    if not formats:
        return filled.select(*named)
    code = F.when(F.col("kind") == "n", F.col("num_fmt"))
    shown = F.when(code.isNotNull(), display_text(F.col("value"), code)).otherwise(F.col("value"))
    return filled.select(*named, code.alias("num_fmt"), shown.alias("display"))


def workbook_tables(files: DataFrame) -> DataFrame:
    """Named tables of every workbook: sheet, rectangle, header flag and column names."""
    return files.select("path", "content").mapInArrow(_tables_of_batches, TABLES)


# --- reading one file ---------------------------------------------------------------------------------


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _attr(el, name: str, default=None):
    for k, v in el.attrib.items():
        if _local(k) == name:
            return v
    return default


def _each(book: zipfile.ZipFile, part: str, *names: str) -> Iterator:
    """Elements of a part by local name as they close, taken out of their parents once handled; the part is read in pieces."""
    above = []
    with book.open(part) as data:
        for event, el in ElementTree.iterparse(data, events=("start", "end")):
            if event == "start":
                above.append(el)
                continue
            above.pop()
            if _local(el.tag) in names:
                yield el
                el.clear()
                if above:
                    above[-1].remove(el)


def _text(el, *skip: str) -> str:
    """All text below an element, leaving out the named children (phonetic guides)."""
    out = [el.text or ""]
    for child in el:
        if _local(child.tag) not in skip:
            out.append(_text(child, *skip))
        out.append(child.tail or "")
    return "".join(out)


def column_number(letters: str) -> int:
    n = 0
    for ch in letters.upper():
        n = n * 26 + ord(ch) - 64
    return n


def box(ref: str) -> tuple[int, int, int, int] | None:
    """``B2:D9`` as first row, first column, last row, last column."""
    found = re.findall(r"([A-Za-z]{1,3})(\d+)", ref.replace("$", ""))
    if not found:
        return None
    (c1, r1), (c2, r2) = found[0], found[-1]
    return int(r1), column_number(c1), int(r2), column_number(c2)


def _relations(book: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, name = posixpath.split(part)
    rels = posixpath.join(folder, "_rels", name + ".rels")
    if rels not in book.namelist():
        return {}
    targets = {}
    for r in _each(book, rels, "Relationship"):
        t = r.get("Target", "")
        targets[r.get("Id")] = t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join(folder, t))
    return targets


def _sheet_parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    targets = _relations(book, "xl/workbook.xml")
    return [(s.get("name"), targets.get(_attr(s, "id"), "")) for s in _each(book, "xl/workbook.xml", "sheet")]


def _style_codes(book: zipfile.ZipFile) -> list[str | None]:
    """Format code of every cell style, by its number; None for general."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(x.get("numFmtId")): x.get("formatCode") for x in root.iter() if _local(x.tag) == "numFmt"}
    styles = next((x for x in root if _local(x.tag) == "cellXfs"), ())
    return [own.get(n) or BUILT_IN.get(n) for n in (int(x.get("numFmtId") or 0) for x in styles)]


def _xlsx_cells(book: zipfile.ZipFile):
    shared, codes = [], _style_codes(book)
    if "xl/sharedStrings.xml" in book.namelist():
        shared = [_text(si, "rPh") for si in _each(book, "xl/sharedStrings.xml", "si")]
    for sheet, part in _sheet_parts(book):
        if part not in book.namelist():
            continue
        row = 0
        for r in _each(book, part, "row"):
            row, col = int(r.get("r") or row + 1), 0
            for c in r:
                at = box(c.get("r", ""))
                col = at[1] if at else col + 1
                style = int(c.get("s") or 0)
                kind, value, formula = _xlsx_value(c, shared)
                code = codes[style] if style < len(codes) else None
                yield sheet, row, col, kind, value, formula, code or OPEN_DOCUMENT.get(kind), 1, 1


def _xlsx_value(c, shared: list[str]) -> tuple[str, str, str | None]:
    part = {_local(x.tag): x for x in c}
    v = (part["v"].text or "") if "v" in part else ""
    formula = part["f"].text if "f" in part else None
    t = c.get("t", "n")
    if t == "s":
        return "s", shared[int(v)] if v else "", formula
    if t == "inlineStr":
        return "s", _text(part["is"], "rPh") if "is" in part else "", formula
    if t == "b":
        return "b", "TRUE" if v == "1" else "FALSE", formula
    return {"str": "s", "e": "e", "d": "date"}.get(t, "n"), v, formula


def _ods_cells(book: zipfile.ZipFile):
    root = ElementTree.fromstring(book.read("content.xml"))
    for table in (t for t in root.iter() if _local(t.tag) == "table"):
        sheet, row = _attr(table, "name"), 0
        for r in (x for x in table.iter() if _local(x.tag) == "table-row"):
            repeat = int(_attr(r, "number-rows-repeated", 1))
            cells = [x for x in _ods_row(r) if x[2] != "" or x[3]]
            for col, raw, value, formula, code, cols in cells:
                yield sheet, row + 1, col, raw, value, formula, code, repeat, cols
            row += repeat


def _ods_row(r):
    col = 0
    for c in r:
        if _local(c.tag) not in ("table-cell", "covered-table-cell"):
            continue
        repeat = int(_attr(c, "number-columns-repeated", 1))
        if _local(c.tag) == "table-cell":
            raw, value = _ods_value(c)
            formula = _attr(c, "formula")
            if value != "" or formula:
                yield col + 1, raw, value, formula, OPEN_DOCUMENT.get(_attr(c, "value-type")), repeat
        col += repeat


def _ods_value(c) -> tuple[str, str]:
    paragraphs = [p for p in c if _local(p.tag) == "p"]
    text = "\n".join(_text(p, "ruby-text") for p in paragraphs)
    kind = _attr(c, "value-type")
    if kind in ("float", "percentage", "currency"):
        return "n", _attr(c, "value", text)
    if kind == "boolean":
        return "b", "TRUE" if _attr(c, "boolean-value") == "true" else "FALSE"
    if kind == "date":
        return "date", _attr(c, "date-value") or text
    if kind == "time":
        return "time", _attr(c, "time-value") or text
    return "s", _attr(c, "string-value", text) if kind == "string" else text


def _cells(content):
    with zipfile.ZipFile(content) as book:
        yield from _ods_cells(book) if "content.xml" in book.namelist() else _xlsx_cells(book)


def _tables(content):
    with zipfile.ZipFile(content) as book:
        if "content.xml" in book.namelist():
            for d in _each(book, "content.xml", "database-range"):
                name, target = _attr(d, "name", ""), _attr(d, "target-range-address", "")
                where = box(target.split(".", 1)[-1]) if "." in target else None
                if name and not name.startswith("__Anonymous") and where:
                    yield target.split(".", 1)[0].strip("'$"), name, *where, _attr(d, "contains-header", "true") != "false", []
            return
        for sheet, part in _sheet_parts(book):
            for target in _relations(book, part).values():
                if not re.search(r"tables/[^/]+\.xml$", target) or target not in book.namelist():
                    continue
                root = ElementTree.fromstring(book.read(target))
                where = box(root.get("ref", ""))
                if where:
                    names = [x.get("name") for x in root.iter() if _local(x.tag) == "tableColumn"]
                    name = root.get("displayName") or root.get("name")
                    yield sheet, name, *where, root.get("headerRowCount", "1") != "0", names


_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _batched(read, schema: str):
    """Rows of every file, in batches of at most _CHUNK; one file at a time leaves the batch that holds it."""
    fields = [pa.field(name, _ARROW[kind]) for name, kind in (f.split() for f in schema.split(", "))]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=pa.schema(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for files in batches:
            for path, content in zip(files["path"], files["content"]):
                path = path.as_py()
                for item in read(pa.BufferReader(content.as_buffer())):
                    rows.append((path, *item))
                    if len(rows) >= _CHUNK:
                        yield pack(rows)
                        rows = []
        if rows:
            yield pack(rows)

    return run


_cells_of_batches = _batched(_cells, RAW_CELLS)
_tables_of_batches = _batched(_tables, TABLES)
