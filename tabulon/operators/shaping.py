"""Sorting, de-duplication, stacking and array-style reshaping (O, D)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tabulon.functions.values import text_number
from tabulon.scale.ordering import OrderKey, order_columns, row_index

_DIGITS = 18


def sort_multi(df: DataFrame, keys: Sequence[tuple[str, bool]], order_by: Sequence[OrderKey] = ()) -> DataFrame:
    """Sort by ``(column, ascending)`` pairs; blanks come last in both directions, ``order_by`` breaks ties."""
    text = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    spec = []
    for name, ascending in keys:
        c = F.when(F.col(name) != "", F.col(name)) if name in text else F.col(name)
        spec.append(c.asc_nulls_last() if ascending else c.desc_nulls_last())
    return df.orderBy(*spec, *(order_columns(order_by) if order_by else []))


def natural_text(c: Column, collation: str | None = None) -> Column:
    """Text key under which ``item2`` precedes ``item10`` and case is ignored.

    Digit runs are left-padded; a run longer than the pad keeps its own length. With a ``collation`` (``UNICODE``, ``UNICODE_CI``,
    ``de_CI_AI`` and so on) texts compare by its rules, so that accented letters stand with their base letters;
    without one they compare by code point after lower-casing.
    """
    padded = F.regexp_replace(c if collation else F.lower(c), r"(\d+)", "0" * _DIGITS + "$1")
    key = F.regexp_replace(padded, rf"0*(\d{{{_DIGITS},}})", "$1")
    return F.collate(key, collation) if collation else key


def mixed_sort_key(c: Column, collation: str | None = None) -> list[Column]:
    """Numbers before text, text in natural order, blanks last."""
    text = c.cast("string")
    number = text_number(text)
    blank = text.isNull() | (text == "")
    return [blank.asc(), number.isNull().asc(), number.asc(), natural_text(text, collation).asc()]


def sort_mixed(df: DataFrame, column: str, order_by: Sequence[OrderKey] = (), collation: str | None = None) -> DataFrame:
    return df.orderBy(*mixed_sort_key(F.col(column), collation), *(order_columns(order_by) if order_by else []))


def dedupe_first(df: DataFrame, columns: Sequence[str], order_by: Sequence[OrderKey]) -> DataFrame:
    """First row per key in ``order_by`` order. Spark limits each task to one row per key before shuffling."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}")
    first = W.partitionBy(*columns).orderBy(*order_columns(order_by))
    return df.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") == 1).drop("_rn")


def append(*tables: DataFrame) -> DataFrame:
    """Stack by column name, missing columns null, duplicates kept."""
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def text_to_columns(
    df: DataFrame, column: str, delimiters: Sequence[str], width: int | None = None, fixed_width: bool = False
) -> DataFrame:
    """Split on any of ``delimiters`` into ``column_1 .. column_n``; ``n`` is measured unless given."""
    if fixed_width:
        raise ValueError("fixed-width splitting is not supported")
    marks = [d for d in delimiters if d]
    if not marks:
        raise ValueError("at least one delimiter is needed")
    parts = F.split(F.col(column), "|".join(re.escape(d) for d in marks), -1)
    if width is None:
        width = df.agg(F.max(F.size(parts))).first()[0] or 1
        limit = 16_384
        if width > limit:
            raise ValueError(f"{width} parts exceed the {limit} columns a table can have")
    return df.withColumns({f"{column}_{i + 1}": F.get(parts, i) for i in range(width)})


def unique_rows(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Distinct rows in first-seen order; ``order_by`` names position columns kept out of the comparison."""
    order_columns(order_by)
    data = [c for c in df.columns if c not in order_by]
    firsts = df.groupBy(*data).agg(F.min(F.struct(*order_by)).alias("_first"))
    return firsts.orderBy("_first").drop("_first")


def sort_by(df: DataFrame, keys: Sequence[OrderKey], order_by: Sequence[OrderKey]) -> DataFrame:
    return df.orderBy(*order_columns(keys), *order_columns(order_by))


def filter_mask(df: DataFrame, mask: Column) -> DataFrame:
    return df.where(mask.cast("double") != 0)


def sequence_grid(spark: SparkSession, rows: int, cols: int = 1, start: float = 1, step: float = 1) -> DataFrame:
    """Row-major arithmetic grid with columns ``c1 .. cn``."""
    return sequence_columns(spark.range(rows).withColumnRenamed("id", "row"), "row", cols, start, step)


def sequence_columns(df: DataFrame, row: str, cols: int = 1, start: float = 1, step: float = 1) -> DataFrame:
    """Grid cells for existing row numbers (0-based column ``row``)."""
    at = lambda j: F.lit(start) + (F.col(row) * cols + j) * F.lit(step)
    return df.select(row, *[at(j).alias(f"c{j + 1}") for j in range(cols)])


def take(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """First ``n`` rows, or the last ``-n`` rows."""
    from tabulon.operators.transforms import keep_bottom, keep_top

    return keep_top(df, n, order_by) if n >= 0 else keep_bottom(df, -n, order_by)


def drop_rows(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """All but the first ``n`` rows, or all but the last ``-n``."""
    from tabulon.operators.transforms import remove_bottom, remove_top

    return remove_top(df, n, order_by) if n >= 0 else remove_bottom(df, -n, order_by)


def choose_rows(df: DataFrame, positions: Sequence[int], order_by: Sequence[OrderKey]) -> DataFrame:
    """Rows at 1-based ``positions`` (negative counts from the end), in the order and multiplicity given."""
    indexed = row_index(df, order_by, "_i", 1)
    total = indexed.agg(F.max("_i")).scalar()
    picks = F.array(*[F.struct(F.lit(k).alias("pick"), F.lit(p).alias("at")) for k, p in enumerate(positions, 1)])
    at = lambda x: F.when(x["at"] < 0, F.col("_n") + 1 + x["at"]).otherwise(x["at"])
    hits = F.filter(picks, lambda x: at(x) == F.col("_i"))
    return (
        indexed.withColumn("_n", total)
        .withColumn("_hit", F.explode(hits))
        .withColumn("pick", F.col("_hit.pick"))
        .drop("_i", "_n", "_hit")
    )


def choose_cols(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    n = len(df.columns)
    return df.select(*[df.columns[p - 1 if p > 0 else n + p] for p in positions])


def vstack(*tables: DataFrame) -> DataFrame:
    """Stack by position; the first table names the columns and narrower tables are padded with nulls."""
    width = max(len(t.columns) for t in tables)
    names = max(tables, key=lambda t: len(t.columns)).columns
    names = tables[0].columns + names[len(tables[0].columns):]
    out = None
    for t in tables:
        padded = t.toDF(*names[: len(t.columns)]).select(
            *names[: len(t.columns)], *[F.lit(None).alias(n) for n in names[len(t.columns) : width]]
        )
        out = padded if out is None else out.union(padded)
    return out


def hstack(left: DataFrame, right: DataFrame, left_order, right_order) -> DataFrame:
    """Side by side by row position, the shorter side padded with nulls."""
    a, b = row_index(left, left_order, "Index"), row_index(right, right_order, "Index")
    return a.join(b, "Index", "full")


def to_column(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], ignore_blanks: bool = False) -> DataFrame:
    """Row-major single column: ``order_by`` keys, ``pos`` within the row, ``value``."""
    long = df.select(*order_by, F.posexplode(F.array(*columns)).alias("pos", "value"))
    return long.where(F.col("value").isNotNull()) if ignore_blanks else long


def to_row(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], max_cells: int = 16_384) -> DataFrame:
    """All cells as one array; a table row holds ``max_cells`` values at most, larger inputs are refused."""
    rows = df.limit(max_cells // len(columns) + 1).count()
    if rows * len(columns) > max_cells:
        raise ValueError(f"a row holds at most {max_cells} cells, use to_column")
    cells = F.transform(
        F.array_sort(F.collect_list(F.struct(*order_by, F.array(*columns).alias("_v")))), lambda x: x["_v"]
    )
    return df.agg(F.flatten(cells).alias("value"))


def wrap_rows(df: DataFrame, value: str, n: int, order_by: Sequence[OrderKey], pad=None) -> DataFrame:
    """A column folded into rows of ``n`` cells: ``row`` and ``c1 .. cn``."""
    indexed = row_index(df.select(*_needed(df, value, order_by)), order_by, "_i")
    cell = lambda j: F.max(F.when(F.col("_i") % n == j, F.struct(F.col(value).alias("v"))))
    folded = indexed.groupBy(F.floor(F.col("_i") / n).alias("row")).agg(*[cell(j).alias(f"c{j + 1}") for j in range(n)])
    out = lambda j: F.when(F.col(f"c{j}").isNull(), F.lit(pad)).otherwise(F.col(f"c{j}.v")).alias(f"c{j}")
    return folded.select("row", *[out(j + 1) for j in range(n)])


def wrap_cols(df: DataFrame, value: str, n: int, order_by: Sequence[OrderKey]) -> DataFrame:
    """A column folded into columns of ``n`` cells, in long form: ``row``, ``col``, ``value``."""
    indexed = row_index(df.select(*_needed(df, value, order_by)), order_by, "_i")
    return indexed.select(
        (F.col("_i") % n).alias("row"), F.floor(F.col("_i") / n).alias("col"), F.col(value).alias("value")
    )


def _needed(df: DataFrame, value: str, order_by) -> list[str]:
    keys = [k for k in order_by if isinstance(k, str)]
    if len(keys) != len(order_by):
        return df.columns
    return list(dict.fromkeys([value, *keys]))


def expand(df: DataFrame, rows: int, columns: Sequence[str], order_by: Sequence[OrderKey], pad=None) -> DataFrame:
    """Grow to ``rows`` rows and the extra ``columns``, filling new cells with ``pad``; adds ``Index`` from 1."""
    data = row_index(df, order_by, "Index", 1)
    have = data.count()
    if rows < have:
        raise ValueError(f"cannot shrink {have} rows to {rows}")
    fill = lambda f: F.lit(pad).try_cast(f.dataType).alias(f.name)
    extra = df.sparkSession.range(have + 1, rows + 1).select(
        *[F.col("id").alias("Index") if f.name == "Index" else fill(f) for f in data.schema.fields]
    )
    return data.union(extra.select(*data.columns)).withColumns({c: F.lit(pad) for c in columns})


def random_column(df: DataFrame, name: str, seed: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    return df.withColumn(name, F.lit(low) + F.rand(seed) * F.lit(high - low))
