"""Range filters, slicers, timelines, find and replace."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tabulon.functions.dates import iso_to_serial, serial_to_timestamp
from tabulon.functions.values import is_blank, number_text, text_number
from tabulon.operators.criteria import all_match, matches
from tabulon.operators.shaping import mixed_sort_key
from tabulon.scale.skew import salted_join

EMPTY_LABEL = "(empty)"


def label(df: DataFrame, column: str, empty: str = EMPTY_LABEL) -> Column:
    """Display label of a cell, with ``empty`` standing for blanks."""
    c = F.col(column)
    kind = df.schema[column].dataType.typeName()
    if kind in ("double", "float"):
        text = number_text(c)
    elif kind == "boolean":
        text = F.upper(c.cast("string"))
    else:
        text = c.cast("string")
    return F.when(is_blank(c), F.lit(empty)).otherwise(text)


def value_filter(df: DataFrame, allowed: Mapping[str, "Sequence | DataFrame"]) -> DataFrame:
    """Keep rows whose value is allowed in every named column.

    A value list becomes ``IN``; a one-column DataFrame of any size becomes a left-semi join.
    """
    for column, values in allowed.items():
        if isinstance(values, DataFrame):
            df = salted_join(df, values.toDF(column), [column], "left_semi")
        else:
            listed = [v for v in values if v is not None]
            hit = F.col(column).isin(listed)
            df = df.where(hit | F.col(column).isNull() if len(listed) < len(values) else hit)
    return df


def filter_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct labels a filter offers, numbers first, then text in natural order."""
    return df.select(label(df, column, "").alias("value")).distinct().orderBy(*mixed_sort_key(F.col("value")))


class AutoFilter:
    """Column criteria that accumulate; a missing criterion clears its column."""

    def __init__(self, df: DataFrame, criteria: Mapping[str, tuple] | None = None):
        self.df, self.criteria = df, dict(criteria or {})

    def set(self, field: int, *criteria, either: bool = False) -> "AutoFilter":
        if not 1 <= field <= len(self.df.columns):
            raise IndexError(f"field {field} is outside the range")
        column = self.df.columns[field - 1]
        kept = {c: k for c, k in self.criteria.items() if c != column}
        return AutoFilter(self.df, {**kept, column: (criteria, either)} if criteria else kept)

    def rows(self) -> DataFrame:
        out = self.df
        for column, (criteria, either) in self.criteria.items():
            tests = [matches(self.df, column, k, "autofilter") for k in criteria]
            out = out.where(reduce((lambda a, b: a | b) if either else (lambda a, b: a & b), tests))
        return out


def advanced_filter(df: DataFrame, criteria: Sequence[Mapping[str, str]], unique: bool = False) -> DataFrame:
    """Rows meeting any criteria row, each row being the conjunction of its non-blank cells."""
    names = {c.lower(): c for c in df.columns}
    tests = []
    for row in criteria:
        pairs = []
        for header, criterion in row.items():
            if criterion is None or criterion == "":
                continue
            if header.lower() not in names:
                raise ValueError(f"the criteria name a column {header!r} the table does not have")
            pairs.append((names[header.lower()], criterion))
        tests.append(all_match(df, pairs, "autofilter"))
    kept = df.where(reduce(lambda a, b: a | b, tests)) if tests else df
    return kept.dropDuplicates() if unique else kept


def page_filter(df: DataFrame, field: str, item=None) -> DataFrame:
    """One item of a field, or every row when no item is chosen; :data:`EMPTY_LABEL` picks blanks."""
    if item is None:
        return df
    return df.where(is_blank(F.col(field)) if item == EMPTY_LABEL else F.col(field).eqNullSafe(F.lit(item)))


def slicer(df: DataFrame, field: str, selected: "Sequence[str] | DataFrame", all_items: bool = False) -> DataFrame:
    """Keep rows whose label is selected; an empty selection keeps nothing, everything selected filters nothing."""
    if all_items:
        return df
    if isinstance(selected, DataFrame):
        labelled = df.withColumn("_label", label(df, field))
        return salted_join(labelled, selected.toDF("_label"), ["_label"], "left_semi").drop("_label")
    if not selected:
        return df.where(F.lit(False))
    if df.schema[field].dataType.typeName() == "string":
        plain = [s for s in selected if s != EMPTY_LABEL]
        hit = F.col(field).isin(plain)
        return df.where(hit | is_blank(F.col(field)) if len(plain) < len(selected) else hit)
    return df.where(label(df, field).isin(list(selected)))


def table_slicer(df: DataFrame, column: str, selected: Sequence[str], all_items: bool = False) -> DataFrame:
    """Like :func:`slicer`, but a blank cell's label is the empty text."""
    return df if all_items else df.where(label(df, column, "").isin(list(selected)))


def timeline(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Rows dated in ``[start, end)``; without a full range nothing is filtered.

    Date and timestamp columns compare directly; numbers are read as serials, text as ISO dates.
    """
    if not start or not end:
        return df
    kind = df.schema[column].dataType.typeName()
    c = F.col(column)
    if kind not in ("date", "timestamp", "timestamp_ntz"):
        serial = c.cast("double")
        if kind == "string":
            serial = F.coalesce(text_number(c), iso_to_serial(c))
        c = serial_to_timestamp(serial)
    as_time = lambda v: F.lit(v).cast("timestamp_ntz") if kind != "timestamp" else F.lit(v).cast("timestamp")
    return df.where((c >= as_time(start)) & (c < as_time(end)))


_PERIOD = {
    "years": ("year", "INTERVAL 1 YEAR"),
    "quarters": ("quarter", "INTERVAL 3 MONTH"),
    "months": ("month", "INTERVAL 1 MONTH"),
    "days": ("day", "INTERVAL 1 DAY"),
}


def period_label(c: Column, level: str) -> Column:
    if level == "years":
        return F.date_format(c, "yyyy")
    if level == "quarters":
        return F.concat(F.lit("Q"), F.quarter(c).cast("string"), F.lit(" "), F.date_format(c, "yyyy"))
    if level == "months":
        return F.date_format(c, "MMM yy")
    return F.date_format(c, "d/M")


def timeline_periods(bounds: DataFrame, start: str, end: str, level: str = "months") -> DataFrame:
    """Every period between two bound columns with its label and ``[start, end)`` range."""
    unit, step = _PERIOD[level]
    first = F.date_trunc(unit, F.col(start)).cast("date")
    starts = F.sequence(first, F.col(end).cast("date"), F.expr(step))
    rows = bounds.select(F.explode(starts).alias("start"))
    return rows.select(
        period_label(F.col("start"), level).alias("label"), "start", (F.col("start") + F.expr(step)).cast("date").alias("end")
    )


def _text_cells(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None) -> DataFrame:
    columns = [c for c in df.columns if c not in keys] if columns is None else list(columns)
    texts = [label(df, c, "").alias(c) for c in columns]
    return df.select(*keys, *texts).unpivot(list(keys), columns, "column", "value")


def find_all(df: DataFrame, query: str, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Cells containing ``query`` in any case: key columns, column name, value."""
    return _text_cells(df, keys, columns).where(F.contains(F.lower("value"), F.lit(query.lower())))


def find_first(
    df: DataFrame, what: str, order_by: Sequence[str], columns: Sequence[str], whole: bool = False, match_case: bool = False
) -> DataFrame:
    """First matching cell in row, then column order."""
    cells = _text_cells(df, order_by, columns)
    value = F.col("value") if match_case else F.lower("value")
    target = F.lit(what if match_case else what.lower())
    position = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column"))
    hit = value == target if whole else F.contains(value, target)
    return cells.where(hit).orderBy(*order_by, position).limit(1)


def replace_all(
    df: DataFrame, columns: Sequence[str], what: str, replacement: str, whole: bool = False, match_case: bool = False
) -> DataFrame:
    """Literal replacement in text columns, of whole cells or of every occurrence."""
    if not what:
        raise ValueError("replace needs something to look for")

    def swap(name: str) -> Column:
        c = F.col(name)
        if whole:
            same = c == what if match_case else F.lower(c) == what.lower()
            return F.when(same, F.lit(replacement)).otherwise(c)
        if match_case:
            return F.replace(c, F.lit(what), F.lit(replacement))
        literal = replacement.replace("\\", "\\\\").replace("$", "\\$")
        return F.regexp_replace(c, "(?iu)" + re.escape(what), literal)

    return df.withColumns({c: swap(c) for c in columns})


def special_cells(df: DataFrame, kind: str, keys: Sequence[str], columns: Sequence[str] | None = None, must_exist: bool = False) -> DataFrame:
    """Blank or constant cells of a range as (keys, column, value); optionally fails when there are none."""
    tests = {"blanks": F.col("value") == "", "constants": F.col("value") != ""}
    if kind not in tests:
        raise ValueError(f"special cells {kind!r} are not supported")
    found = _text_cells(df, keys, columns).where(tests[kind])
    if must_exist and found.isEmpty():
        raise ValueError("no cells were found")
    return found


def select_span(df: DataFrame, first: str, last: str | None = None) -> DataFrame:
    """One column, or every column between two, by case-insensitive name."""
    at = {c.lower(): i for i, c in enumerate(df.columns)}
    ends = []
    for name in (first, last or first):
        if name.lower() not in at:
            raise ValueError(f"no column {name!r} in the table")
        ends.append(at[name.lower()])
    return df.select(*df.columns[min(ends) : max(ends) + 1])


def table_part(df: DataFrame, part: str = "#data", first: str | None = None, last: str | None = None) -> DataFrame:
    """``#data`` rows, the ``#headers`` row, or ``#all`` (headers above data as text) of a column span.

    ``#all`` adds ``is_header`` so that the header row stays identifiable in an unordered table.
    """
    span = select_span(df, first, last) if first else df
    names = span.columns
    heads = df.sparkSession.range(1).select(*[F.lit(c).alias(c) for c in names])
    if part == "#data":
        return span
    if part == "#headers":
        return heads
    if part != "#all":
        raise ValueError(f"cannot resolve {part!r}")
    body = span.select(*[label(span, c, "").alias(c) for c in names], F.lit(False).alias("is_header"))
    return heads.withColumn("is_header", F.lit(True)).unionByName(body)
