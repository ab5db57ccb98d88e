"""Query-editor transforms.

All of them are lazy except the ones that need row positions, which write their sorted rows once.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tabulon.functions.values import number_text, to_number
from tabulon.scale.ordering import OrderKey, order_columns, row_index

_NUMERIC_OPERAND = re.compile(r"-?\d+(\.\d+)?")

TYPES = {
    "text": "string",
    "whole": "bigint",
    "number": "double",
    "logical": "boolean",
    "date": "date",
    "datetime": "timestamp_ntz",
    "time": "double",
    "duration": "interval day to second",
}


def _require(df: DataFrame, cols: Sequence[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}")


def operand(raw) -> object:
    """A typed value from a dialog: numeric when it looks numeric, else text."""
    if isinstance(raw, str) and _NUMERIC_OPERAND.fullmatch(raw.strip()):
        return float(raw) if "." in raw else int(raw)
    return raw


def remove_columns(df: DataFrame, *cols: str) -> DataFrame:
    _require(df, cols)
    return df.drop(*cols)


def choose_columns(df: DataFrame, *cols: str) -> DataFrame:
    _require(df, cols)
    return df.select(*cols)


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    _require(df, list(names))
    return df.withColumnsRenamed(names)


def custom_column(df: DataFrame, name: str, formula: str | Column) -> DataFrame:
    return df.withColumn(name, F.expr(formula) if isinstance(formula, str) else formula)


def filter_rows(df: DataFrame, column: str, op: str, value) -> DataFrame:
    """Keep rows meeting one condition; text conditions are case-sensitive and nulls never match."""
    _require(df, [column])
    c = F.col(column)
    if op in ("contains", "starts", "ends"):
        text = c.cast("string")
        test = {"contains": text.contains, "starts": text.startswith, "ends": text.endswith}[op](str(value))
        return df.where(test)
    v = operand(value)
    tests = {"eq": c == v, "ne": c != v, "gt": c > v, "ge": c >= v, "lt": c < v, "le": c <= v}
    if op == "ne":
        return df.where(c.isNull() | tests[op])
    return df.where(tests[op])


def sort_rows(df: DataFrame, column: str, descending: bool = False, order_by: Sequence[OrderKey] = ()) -> DataFrame:
    key = F.col(column).desc() if descending else F.col(column).asc()
    return df.orderBy(key, *(order_columns(order_by) if order_by else []))


def _flip(keys: Sequence[OrderKey]) -> list[Column]:
    if any(not isinstance(k, str) for k in keys):
        raise ValueError("reverse order needs plain column names")
    return [F.col(k).desc() for k in keys]


def keep_top(df: DataFrame, n: int, order_by: Sequence[OrderKey]) -> DataFrame:
    return df.orderBy(*order_columns(order_by)).limit(n)


def keep_bottom(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    order_columns(order_by)
    return df.orderBy(*_flip(order_by)).limit(n)


def skip_rows(df: DataFrame, n: int, keys: Sequence[Column]) -> DataFrame:
    """All rows but the first ``n`` in ``keys`` order; ties and null keys count like any other row."""
    return row_index(df, keys, "_i").where(F.col("_i") >= n).drop("_i") if n > 0 else df


def remove_top(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    return skip_rows(df, n, order_columns(order_by))


def remove_bottom(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    order_columns(order_by)
    return skip_rows(df, n, _flip(order_by))


def remove_duplicates(df: DataFrame) -> DataFrame:
    return df.distinct()


def reverse_rows(df: DataFrame, order_by: Sequence[str], index: str = "Index") -> DataFrame:
    order_columns(order_by)
    return row_index(df, _flip(order_by), index)


def change_type(df: DataFrame, column: str, kind: str, flag: str | None = None) -> DataFrame:
    """Retype a column; values that do not convert become null, optionally flagged in ``flag``."""
    _require(df, [column])
    c = F.col(column)
    source = df.schema[column].dataType.typeName()
    if kind == "text":
        out = number_text(c) if source in ("double", "float") else c.cast("string")
    elif kind == "whole" and source in ("double", "float", "string", "decimal"):
        out = F.bround(to_number(c, source), 0).try_cast("bigint")
    elif kind == "number":
        out = to_number(c, source)
    elif kind == "time":
        text = F.date_format(c, "HH:mm:ss") if source.startswith("timestamp") else c.cast("string")
        out = clock_fraction(text)
    elif kind == "duration":
        whole = to_number(c, source)
        out = F.make_dt_interval(F.floor(whole).try_cast("int"), secs=F.round((whole - F.floor(whole)) * 86400, 6))
    else:
        out = c.try_cast(TYPES[kind])
    result = df.withColumn(flag, c.isNotNull() & out.isNull()) if flag else df
    return result.withColumn(column, out)


def clock_fraction(text: Column) -> Column:
    """``hh:mm[:ss]`` as a fraction of a day, null when it is not a time."""
    at = lambda i: F.regexp_extract(text, r"^\s*(\d{1,2}):(\d{2})(?::(\d{2}))?\s*$", i)
    h, m, s = (F.coalesce(at(i).try_cast("int"), F.lit(0)) for i in (1, 2, 3))
    valid = (at(1) != "") & (h <= 23) & (m <= 59) & (s <= 59)
    return F.when(valid, (h * 3600 + m * 60 + s) / F.lit(86400.0))


def replace_values(df: DataFrame, column: str, find, replacement) -> DataFrame:
    _require(df, [column])
    kind = df.schema[column].dataType
    if kind.typeName() != "string":
        find, replacement = operand(find), operand(replacement)
    c = F.col(column)
    return df.withColumn(column, F.when(c.eqNullSafe(F.lit(find)), F.lit(replacement).cast(kind)).otherwise(c))


def split_column(df: DataFrame, column: str, delimiter: str, parts: int = 2, quoted: bool = False) -> DataFrame:
    """Split into ``column.1 .. column.n``: missing parts are null, parts beyond ``n`` are dropped.

    ``quoted`` honours double quotes around fields and needs a one-character delimiter.
    """
    _require(df, [column])
    parts = max(2, parts)
    if quoted:
        schema = ", ".join(f"p{i} string" for i in range(parts))
        pieces = F.from_csv(F.col(column), schema, {"sep": delimiter, "quote": '"', "escape": '"'})
        value = lambda i: pieces[f"p{i}"]
    else:
        pieces = F.split(F.col(column), re.escape(delimiter), -1)
        value = lambda i: F.get(pieces, i)
    out = []
    for c in df.columns:
        if c == column:
            out += [value(i).alias(f"{column}.{i + 1}") for i in range(parts)]
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


def _as_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    return df.withColumns(
        {c: number_text(F.col(c)) if kinds[c] in ("double", "float") else F.col(c).cast("string") for c in cols}
    )


def transpose_long(df: DataFrame, order_by: Sequence[OrderKey]) -> DataFrame:
    """Transposed cells in long form: ``Column`` (source column), ``Row`` (1-based), ``Value`` as text."""
    indexed = row_index(df, order_by, "Row", 1)
    return _as_text(indexed, df.columns).unpivot(["Row"], df.columns, "Column", "Value").select("Column", "Row", "Value")


def transpose(df: DataFrame, order_by: Sequence[OrderKey], max_rows: int = 1000) -> DataFrame:
    """Rows become columns ``Column1..n``; meant for summary tables, larger inputs are refused."""
    rows = df.limit(max_rows + 1).count()
    if rows > max_rows:
        raise ValueError(f"transpose makes one column per row: {max_rows} at most, use transpose_long")
    long = transpose_long(df, order_by)
    wide = long.groupBy("Column").pivot("Row", list(range(1, rows + 1))).agg(F.first("Value"))
    return wide.withColumnsRenamed({str(i): f"Column{i}" for i in range(1, rows + 1)})


def promote_headers(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Use the first row as column names; only that row comes to the driver."""
    from tabulon.sources.naming import header_names

    first = df.orderBy(*order_columns(order_by)).limit(1)
    keyed = first.withColumn("_key", F.struct(*order_by))
    row = _as_text(keyed, df.columns).first()
    if row is None:
        return df
    is_header = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.lit(row["_key"][k])) for k in order_by))
    return df.where(~is_header).toDF(*header_names([row[c] for c in df.columns]))


def unpivot_others(df: DataFrame, keep: Sequence[str], keep_nulls: bool = False) -> DataFrame:
    """Turn every column not in ``keep`` into ``Attribute`` / ``Value`` rows."""
    _require(df, keep)
    rest = [c for c in df.columns if c not in keep]
    kinds = {df.schema[c].dataType.typeName() for c in rest}
    if kinds <= {"byte", "short", "integer", "long", "float", "double"}:
        typed = df.withColumns({c: F.col(c).cast("double") for c in rest}) if len(kinds) > 1 else df
    else:
        typed = df if len(kinds) == 1 else _as_text(df, rest)
    long = typed.unpivot(list(keep), rest, "Attribute", "Value")
    return long if keep_nulls else long.where(F.col("Value").isNotNull())


GROUP_LABEL = {"sum": "Sum of {}", "avg": "Average of {}", "max": "Max of {}", "min": "Min of {}"}


def group_by(df: DataFrame, keys: Sequence[str] | str, aggs: Sequence[tuple[str, str | None]]) -> DataFrame:
    """Group with ``(aggregation, column)`` pairs: count, sum, avg, max, min."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    out = []
    for name, col in aggs:
        if name == "count":
            out.append(F.count(F.lit(1)).alias("Count"))
        else:
            out.append(getattr(F, name)(F.col(col)).alias(GROUP_LABEL[name].format(col)))
    return df.groupBy(*keys).agg(*out)


def index_column(df: DataFrame, order_by: Sequence[OrderKey], start: int = 0) -> DataFrame:
    return row_index(df, order_by, "Index", start)
