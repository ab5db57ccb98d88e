"""Delimited text in and out."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tabulon.functions.values import NUMBER_PATTERN
from tabulon.scale.storage import materialize
from tabulon.sources.naming import header_names

# Candidate delimiters in order of preference and the size of the sniffed head.
CANDIDATES = (",", ";", "\t", "|")
HEAD_LINES, HEAD_CHARS = 20, 65_536
HINTS = {"tsv": "\t", "tab": "\t", "csv": None}


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """Delimiter whose usual per-line count is the most regular over the head of the text."""
    head = [r.value for r in spark.read.text(path).limit(HEAD_LINES).collect()]
    return delimiter_of("\n".join(head)[:HEAD_CHARS])


def delimiter_of(text: str) -> str:
    # Text inside double quotes does not count, line breaks included.
    outside = "".join(text.split('"')[::2])
    lines = outside.split("\n")[:HEAD_LINES]
    lines = lines[:-1] if lines and lines[-1] == "" else lines
    best, regular = ",", 0
    for mark in CANDIDATES:
        seen = Counter(n for n in (line.count(mark) for line in lines) if n)
        if seen and max(seen.values()) > regular:
            best, regular = mark, max(seen.values())
    return best


_CELLS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
_LINE_KEY = ["file", "block"]


def read_delimited(
    spark: SparkSession, path: str, delimiter: str | None = None, hint: str | None = None, columns: int | None = None
) -> DataFrame:
    """Text cells named ``Column1..n``; short rows are padded with nulls, empty fields are null, blank lines are rows.

    A row ends at a line break (LF, CRLF or CR) with an even number of quotes before it in the file. One splittable pass over the
    lines finds the width and whether any line has an odd number; only then are rows put together from lines (``_rows``).
    """
    sep = delimiter or HINTS.get((hint or "").lower()) or sniff_delimiter(spark, path)
    records, width = _records(spark, path, sep)
    schema = ", ".join(f"Column{i + 1} STRING" for i in range(columns or width))
    # Parsing rows as values keeps blank ones, which the file reader leaves out.
    return records.select(F.from_csv("value", schema, {"sep": sep} | _CELLS).alias("c")).select("c.*")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines (cut at LF) of every split: ``file, block`` name the split, ``mid`` orders its lines."""
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2
    lines = spark.read.option("lineSep", "\n").text(path)
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return lines.select(*at, F.monotonically_increasing_id().alias("mid"), "value", odd.alias("odd"))


def _shape(spark: SparkSession, path: str, sep: str) -> tuple[int, bool]:
    """Most fields of a line, and whether rows have to be put together: a quoted field spans lines, or lines end in CR alone."""
    lines = _lines(spark, path)
    bare = F.rtrim("value", F.lit("\r"))
    apart = (F.col("odd") == 1) | F.contains(bare, F.lit("\r"))
    seen = lines.agg(F.max(_fields(bare, sep)).alias("width"), F.max(apart).alias("apart")).first()
    return seen["width"] or 1, bool(seen["apart"])


def _records(spark: SparkSession, path: str, sep: str, heads: bool = False) -> tuple[DataFrame, int]:
    """``value`` of every row and the most fields of a row; with ``heads`` also ``file`` and ``first``, true for the first of its file."""
    lines = _lines(spark, path)
    width, apart = _shape(spark, path, sep)
    if apart:
        rows = materialize(_rows(lines), "rows")
        return rows, rows.agg(F.max(_fields(F.col("value"), sep))).first()[0] or 1
    plain = F.when(F.endswith("value", F.lit("\r")), F.substr("value", F.lit(1), F.length("value") - 1)).otherwise(F.col("value"))
    if not heads:
        return lines.select(plain.alias("value")), width
    head = lines.where("block = 0").groupBy("file").agg(F.min("mid").alias("mid"), F.lit(True).alias("first"))
    # One row per file; whether it is small enough to be broadcast is left to the planner.
    marked = lines.join(head.select("mid", "first"), "mid", "left")
    return marked.select("file", F.coalesce("first", F.lit(False)).alias("first"), plain.alias("value")), width


def _rows(lines: DataFrame) -> DataFrame:
    """Rows from lines whose quoted fields may span lines, split by split.

    The parity of the quotes of each split and a prefix sum over the splits of a file tell whether a split begins inside a
    quoted field, so each is cut into rows on its own. Only the pieces at borders, at most two a split, meet their neighbours.
    """
    per_split = lines.groupBy(*_LINE_KEY).agg((F.sum("odd") % 2).alias("flips"))
    before = F.sum("flips").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    known = per_split.select(*_LINE_KEY, (F.coalesce(before, F.lit(0)) % 2).alias("inside"), "flips")
    joined = lines.join(known, _LINE_KEY)  # the one shuffle of the lines, by split
    in_split = W.partitionBy(*_LINE_KEY).orderBy("mid")
    parity = (F.col("inside") + F.coalesce(F.sum("odd").over(in_split.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))) % 2
    numbered = joined.withColumn("starts", (parity == 0).cast("int")).withColumn("nth", F.sum("starts").over(in_split))
    whole = W.partitionBy(*_LINE_KEY)
    border = (F.col("nth") == 0) | ((F.col("nth") == F.max("nth").over(whole)) & ((F.col("inside") + F.col("flips")) % 2 == 1))
    pieces = numbered.withColumn("border", border).groupBy(*_LINE_KEY, "nth", "border").agg(
        F.expr("listagg(value, '\n') WITHIN GROUP (ORDER BY mid)").alias("value")
    )
    order = W.partitionBy("file").orderBy("block", "nth")
    cut = pieces.where("border").withColumn("row", F.sum((F.col("nth") > 0).cast("int")).over(order))
    mended = cut.groupBy("file", "row").agg(
        F.min(F.struct("block", "nth")).alias("at"), F.expr("listagg(value, '\n') WITHIN GROUP (ORDER BY block, nth)").alias("value")
    )
    both = pieces.where("not border").select("file", "block", "nth", "value").unionByName(mended.select("file", "at.block", "at.nth", "value"))
    each = both.select("file", ((F.col("block") == 0) & (F.col("nth") == 1)).alias("first"), F.posexplode(_at_carriage_returns(F.col("value"))))
    return each.select("file", (F.col("first") & (F.col("pos") == 0)).alias("first"), F.col("col").alias("value"))


def _at_carriage_returns(value: Column) -> Column:
    """Rows of a text that starts outside quotes: carriage returns outside quotes end a row, one at the end belongs to the last."""
    # U+001E escapes itself and marks the breaks, so texts may hold it.
    escaped = F.replace(value, F.lit("\u001e"), F.lit("\u001e0"))
    marked = lambda part, i: F.when(i % 2 == 0, F.replace(part, F.lit("\r"), F.lit("\u001e1"))).otherwise(part)
    parts = F.array_join(F.transform(F.split(escaped, '"', -1), marked), '"')
    rows = F.split(F.regexp_replace(parts, "\u001e1\\z", ""), "\u001e1", -1)
    plain = F.transform(rows, lambda r: F.replace(r, F.lit("\u001e0"), F.lit("\u001e")))
    return F.when(F.contains(value, F.lit("\r")), plain).otherwise(F.array(value))


def _fields(row: Column, sep: str) -> Column:
    mark = re.escape(sep)
    bare = F.regexp_replace(row, rf'(^|{mark})"[^"]*+(?:""[^"]*+)*+(?:"|\z)', "$1")  # an open quote takes all that follows
    return F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1


def read_csv_document(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """Headed CSV as text columns: the first row names them. Names are read from one row, the first of the first file.

    The first row of every file is its header. Rows longer than the header keep their cells under default names; quoted
    fields may hold line breaks, blank lines are rows.
    """
    records, width = _records(spark, path, delimiter, heads=True)
    options = {"sep": delimiter} | _CELLS
    parsed = lambda names: F.from_csv("value", ", ".join("`{}` STRING".format(n.replace("`", "``")) for n in names), options).alias("c")
    head = records.where("first").orderBy("file").select(parsed([f"c{i}" for i in range(width)])).select("c.*").first()
    names = header_names(list(head) if head else [None] * width)
    return records.where("not first").select(parsed(names)).select("c.*")


def infer_types(df: DataFrame) -> DataFrame:
    """Give each text column a type only if every non-blank value fits it: number or TRUE/FALSE."""
    stats = []
    for c in df.columns:
        v = F.col(f"`{c}`")
        filled = v.isNotNull() & (F.trim(v) != "")
        stats += [
            F.count_if(filled).alias(f"n_{c}"),
            F.count_if(filled & F.trim(v).rlike(NUMBER_PATTERN)).alias(f"d_{c}"),
            F.count_if(filled & F.upper(v).isin("TRUE", "FALSE")).alias(f"b_{c}"),
        ]
    seen = df.agg(*stats).first()
    typed = []
    for c in df.columns:
        v = F.col(f"`{c}`")
        n = seen[f"n_{c}"]
        if n and seen[f"d_{c}"] == n:
            v = F.trim(v).try_cast("double")
        elif n and seen[f"b_{c}"] == n:
            v = F.upper(v).try_cast("boolean")
        else:
            v = F.nullif(v, F.lit(""))
        typed.append(v.alias(c))
    return df.select(*typed)


def apply_header(df: DataFrame, cells: Sequence[str | None]) -> DataFrame:
    return df.toDF(*header_names(cells))


def write_delimited(df: DataFrame, path: str, delimiter: str = ",", header: bool = False) -> None:
    """Write text cells, quoting only fields that hold the delimiter, a quote or a line break."""
    from tabulon.functions.formats import result_text

    text = df.select(*[result_text(df, c).alias(c) for c in df.columns])
    text.write.options(sep=delimiter, quote='"', escape='"', quoteAll=False, header=header, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
