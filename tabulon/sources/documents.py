"""JSON, OData pages, folders, catalog and workbook tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tabulon.functions.dates import serial_to_timestamp
from tabulon.sources.naming import header_names
from tabulon.sources.styles import format_class


SEQUENCE = "\x1e"  # between the documents of a JSON text sequence (RFC 7464); inside a document it is always escaped


def read_json_document(spark: SparkSession, path: str, schema: str | None = None, separator: str | None = None) -> DataFrame:
    """Records of JSON documents; a list gives one row per element.

    Every file is one document. With ``separator`` the files hold many documents with it between them, so that a great number
    of documents needs few files, which Spark splits.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, lineSep=separator) if separator else reader.json(path, multiLine=True)


def read_odata(spark: SparkSession, path: str, schema: str | None = None, separator: str | None = None) -> DataFrame:
    """Rows of saved feed pages: the elements of ``value``, or the body itself when there is none."""
    pages = read_json_document(spark, path, schema, separator)
    if "value" not in pages.columns:
        return pages
    kind = pages.schema["value"].dataType
    if not isinstance(kind, T.ArrayType):
        return pages
    fields = kind.elementType.fieldNames()
    body = [c for c in pages.columns if c in fields]
    alone = F.struct(*[F.col(c) if c in body else F.lit(None).cast(kind.elementType[c].dataType).alias(c) for c in fields])
    rows = F.coalesce(F.col("value"), F.array(alone))
    return pages.select(F.inline(rows))


def list_folder(spark: SparkSession, path: str, names: str | None = None) -> DataFrame:
    """``Content, Name, Extension`` of every file; the extension keeps its dot and may be empty.

    ``names`` is a glob of file names that the listing itself applies, so other files are not read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", names) if names else reader).load(path)
    name = F.url_decode(F.regexp_extract("path", r"([^/]*)$", 1))
    return files.select(F.col("content").alias("Content"), name.alias("Name")).withColumn(
        "Extension", F.regexp_extract("Name", r"(\.[^.]*)$", 1)
    )


def file_contents(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """``Name, Content`` of the files with the given base names; an error when one is missing."""
    wanted = {n.replace("\\", "/").rsplit("/", 1)[-1] for n in names}
    plain = all(re.fullmatch(r"[\w. -]+", n) for n in wanted)
    found = list_folder(spark, path, "{" + ",".join(sorted(wanted)) + "}" if plain else None).where(F.col("Name").isin(list(wanted)))
    present = {r["Name"] for r in found.select("Name").distinct().collect()}
    if wanted - present:
        raise FileNotFoundError(", ".join(sorted(wanted - present)))
    return found.select("Name", "Content")


class Catalog:
    """Tables of the current session by name, read when asked for."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def names(self) -> DataFrame:
        listed = [(t.name,) for t in self.spark.catalog.listTables()]
        return self.spark.createDataFrame(listed, "Name string")

    def content(self, name: str) -> DataFrame:
        return self.spark.table(name)


def blank_source(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "Column1 string")


def table_from_cells(
    cells: DataFrame, sheet: str, first_row: int, first_col: int, last_row: int, last_col: int, header: bool = True
) -> DataFrame:
    """Table of a rectangle of ``sheet, row, col, kind, value`` cells, with its 1-based source ``row``.

    A column whose filled cells are all numbers or all booleans is typed; others stay text. If the cells have a ``num_fmt``
    and all numbers of a column show as dates, or as dates with times, it is a column of dates or timestamps. Rows without
    cells stay, as nulls.
    """
    spark = cells.sparkSession
    inside = cells.where(
        (F.col("sheet") == sheet)
        & F.col("row").between(first_row, last_row)
        & F.col("col").between(first_col, last_col)
        & (F.col("value") != "")
    )
    cols = range(first_col, last_col + 1)
    names = [None] * len(cols)
    body_start = first_row
    if header:
        body_start += 1
        heads = {r["col"]: r["value"] for r in inside.where(F.col("row") == first_row).select("col", "value").collect()}
        names = [heads.get(c) for c in cols]
    names = header_names(names)
    body = inside.where(F.col("row") >= body_start)
    shown = format_class(F.col("num_fmt")) if "num_fmt" in cells.columns else F.lit("general")
    seen = body.groupBy("col").agg(F.collect_set("kind").alias("k"), F.collect_set(shown).alias("f")).collect()  # a row a column
    kinds, formats = {r["col"]: set(r["k"]) for r in seen}, {r["col"]: set(r["f"]) for r in seen}
    wide = body.groupBy("row").agg(*[F.max(F.when(F.col("col") == c, F.col("value"))).alias(f"_c{c}") for c in cols])

    def typed(c: int, name: str):
        v, k = F.col(f"_c{c}"), kinds.get(c)
        if k == {"n"} and formats[c] <= {"date", "datetime"}:
            moment = serial_to_timestamp(v.try_cast("double"))
            v = moment.cast("date") if formats[c] == {"date"} else moment
        elif k == {"n"}:
            v = v.try_cast("double")
        elif k == {"b"}:
            v = F.upper(v).isin("TRUE", "1")
        return v.alias(name)

    rows = spark.range(body_start, last_row + 1).withColumnRenamed("id", "row")
    return rows.join(wide.withColumn("row", F.col("row").cast("bigint")), "row", "left").select(
        "row", *[typed(c, n) for c, n in zip(cols, names)]
    )
