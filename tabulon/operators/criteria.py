"""Criteria strings such as ``">=5"``, ``"ab*"`` or ``"<>x"`` compiled to one predicate.

A criterion is read once on the driver; numeric criteria on numeric columns become plain comparisons
that reach the Parquet scan.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tabulon.functions.values import NUMBER_PATTERN, number_text, text_number

_NUMERIC = ("byte", "short", "integer", "long", "float", "double", "decimal")
_CRITERION = re.compile(r"(<>|>=|<=|=|>|<)?(.*)", re.S)
_NUMBER = re.compile(NUMBER_PATTERN)


def wildcard_pattern(text: str) -> str:
    """Anchored, case-insensitive regular expression: ``*`` any run, ``?`` one character."""
    body = "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in text)
    return rf"(?isu)\A{body}\z"


def _compare(op: str, a: Column, b) -> Column:
    return {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b, "=": a == b, "<>": a != b}[op]


def matches(df: DataFrame, column: str, criterion, dialect: str = "ifs") -> Column:
    """Predicate for one criterion. ``dialect`` is ``"ifs"`` (criteria functions) or ``"autofilter"``."""
    kind = df.schema[column].dataType.typeName()
    c = F.col(column)
    numeric = kind in _NUMERIC
    text = F.coalesce(number_text(c) if numeric else c.cast("string"), F.lit(""))
    number = c if numeric else text_number(c.cast("string"))
    if dialect not in ("ifs", "autofilter"):
        raise ValueError(f"unknown dialect {dialect!r}")
    if isinstance(criterion, (int, float)) and not isinstance(criterion, bool):
        return number == F.lit(criterion)
    raw = "" if criterion is None else str(criterion)
    op, operand = _CRITERION.fullmatch(raw.strip() if dialect == "ifs" else raw).groups()
    op = op or "="
    operand = operand.strip() if dialect == "ifs" else operand
    value = float(operand) if _NUMBER.match(operand.strip()) else None
    if dialect == "ifs":
        return _ifs(op, operand, value, text, number, numeric, c)
    return _autofilter(op, operand, value, text, number, numeric, c)


def _ifs(op, operand, value, text, number, numeric, c) -> Column:
    if op in ("=", "<>"):
        by_text = text == "" if operand == "" else text.rlike(wildcard_pattern(operand))
        by_text = ~by_text if op == "<>" else by_text
    else:
        by_text = _compare(op, F.lower(text), F.lit(operand.lower()))
    if value is None:
        return by_text
    by_number = _compare(op, number, F.lit(value))
    if numeric:
        # Blank cells compare as empty text: below any number and different from it.
        return (c.isNull() | by_number) if op in ("<", "<=", "<>") else by_number
    return F.when(number.isNotNull(), by_number).otherwise(by_text)


def _autofilter(op, operand, value, text, number, numeric, c) -> Column:
    if op == "=" and re.search(r"[*?]", operand):
        return text.rlike(wildcard_pattern(operand))
    if op in ("=", "<>"):
        return _compare(op, F.lower(text), F.lit(operand.lower()))
    by_text = _compare(op, text, F.lit(operand))
    if value is None:
        return by_text
    by_number = _compare(op, number, F.lit(value))
    if numeric:
        return (c.isNull() | by_number) if op in ("<", "<=") else by_number
    return F.when(number.isNotNull(), by_number).otherwise(by_text)


def all_match(df: DataFrame, pairs: Sequence[tuple[str, object]], dialect: str = "ifs") -> Column:
    return reduce(lambda a, b: a & b, (matches(df, c, k, dialect) for c, k in pairs), F.lit(True))
