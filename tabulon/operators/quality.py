"""Data validation (Q01-Q03)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tabulon.functions.dates import date_to_serial
from tabulon.functions.values import is_blank
from tabulon.operators.filters import label
from tabulon.scale.skew import attach

OPERATORS = (
    "between",
    "notBetween",
    "equal",
    "notEqual",
    "greaterThan",
    "lessThan",
    "greaterThanOrEqual",
    "lessThanOrEqual",
)


@dataclass(frozen=True)
class Validation:
    """One rule on a column. ``type`` is list, whole, decimal, date, time, textLength or custom."""

    column: str
    type: str
    operator: str = "between"
    a: float | None = None
    b: float | None = None
    values: tuple[str, ...] = ()
    source: DataFrame | None = None
    sql: str | None = None
    message: str = ""
    style: str = "stop"


def list_source(df: DataFrame, column: str) -> DataFrame:
    """Dropdown values of a range: distinct labels without blanks."""
    return df.where(~is_blank(F.col(column))).select(label(df, column, "").alias("value")).distinct()


def _number(df: DataFrame, column: str) -> Column:
    c, kind = F.col(column), df.schema[column].dataType.typeName()
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return date_to_serial(c)
    if kind == "string":
        return F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast("double")
    return c.cast("double")


def _within(v: Column, op: str, a, b) -> Column:
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op!r}")
    if a is None or (b is None and op in ("between", "notBetween")):
        return F.lit(False)
    return {
        "between": lambda: (v >= a) & (v <= b),
        "notBetween": lambda: (v < a) | (v > b),
        "equal": lambda: v == a,
        "notEqual": lambda: v != a,
        "greaterThan": lambda: v > a,
        "lessThan": lambda: v < a,
        "greaterThanOrEqual": lambda: v >= a,
        "lessThanOrEqual": lambda: v <= a,
    }[op]()


def is_valid(df: DataFrame, rule: Validation) -> Column:
    """Predicate of a rule that needs no other table; blanks are valid, non-numbers are not."""
    shown = label(df, rule.column, "")
    if rule.type == "list":
        ok = shown.isin(list(rule.values)) if rule.values else F.lit(True)
    elif rule.type == "custom":
        ok = F.coalesce(F.expr(rule.sql).cast("boolean"), F.lit(False)) if rule.sql else F.lit(True)
    else:
        v = F.length(shown).cast("double") if rule.type == "textLength" else _number(df, rule.column)
        ok = v.isNotNull() & _within(v, rule.operator, rule.a, rule.b)
        if rule.type == "whole":
            ok = ok & (v == F.floor(v))
        ok = F.coalesce(ok, F.lit(False))
    return (shown == "") | ok


def validate(df: DataFrame, rules: Sequence[Validation]) -> DataFrame:
    """Add a boolean ``valid_{column}`` per rule; the first rule on a column is the one that applies."""
    first: dict[str, Validation] = {}
    for r in rules:
        first.setdefault(r.column, r)
    out = df
    flags = {}
    for c, r in first.items():
        if r.source is not None:
            allowed = list_source(r.source, r.source.columns[0]).select(F.col("value").alias("_k"), F.lit(True).alias(f"_in_{c}"))
            out = attach(out.withColumn("_k", label(df, c, "")), allowed, ["_k"]).drop("_k")
            flags[f"valid_{c}"] = (label(df, c, "") == "") | F.col(f"_in_{c}").isNotNull()
        else:
            flags[f"valid_{c}"] = is_valid(df, r)
    return out.withColumns(flags).select(*df.columns, *flags)


def report(df: DataFrame, rules: Sequence[Validation], keys: Sequence[str], shown: Callable[[DataFrame, str], Column] | None = None) -> DataFrame:
    """One row per failing cell: keys, column, value, rule type, message and style.

    The value is the cell's label unless ``shown(df, column)`` gives another text.
    """
    shown = shown or (lambda d, c: label(d, c, ""))
    checked = validate(df, rules)
    seen, cells = set(), []
    for r in rules:
        if r.column in seen:
            continue
        seen.add(r.column)
        cell = F.struct(
            F.lit(r.column).alias("column"),
            shown(df, r.column).alias("value"),
            F.lit(r.type).alias("rule"),
            F.lit(r.message).alias("message"),
            F.lit(r.style).alias("style"),
        )
        cells.append(F.when(~F.col(f"valid_{r.column}"), cell))
    failing = F.filter(F.array(*cells), lambda x: x.isNotNull())
    return checked.select(*keys, F.inline(failing))
