"""Criteria aggregates, statistics and text joins over rows.

Sums, counts, extremes and spreads are plain partial/final aggregates. Medians, percentiles and the most
frequent value work from per-value counts, so a group is never gathered in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabulon.functions.values import finite, is_blank, to_number
from tabulon.operators.criteria import all_match
from tabulon.scale.counts import quantiles
from tabulon.scale.ordering import BLOCK, POS, OrderKey, order_columns, sorted_blocks

Pairs = Sequence[tuple[str, object]]


def numbers(df: DataFrame, column: str) -> Column:
    """Numeric cells of a column; text in a text column is skipped unless it is a number."""
    c = F.col(column)
    kind = df.schema[column].dataType.typeName()
    if kind == "boolean":
        return F.lit(None).cast("double")
    return to_number(c) if kind == "string" else c


def _picked(df: DataFrame, column: str, pairs: Pairs) -> Column:
    return F.when(all_match(df, pairs), numbers(df, column))


def sum_if(df: DataFrame, column: str, pairs: Pairs) -> Column:
    return F.coalesce(F.sum(_picked(df, column, pairs)), F.lit(0))


def count_if(df: DataFrame, pairs: Pairs) -> Column:
    return F.count_if(all_match(df, pairs))


def average_if(df: DataFrame, column: str, pairs: Pairs) -> Column:
    return F.avg(_picked(df, column, pairs))


def max_if(df: DataFrame, column: str, pairs: Pairs) -> Column:
    return F.coalesce(F.max(_picked(df, column, pairs)), F.lit(0))


def min_if(df: DataFrame, column: str, pairs: Pairs) -> Column:
    return F.coalesce(F.min(_picked(df, column, pairs)), F.lit(0))


def count_values(column: str) -> Column:
    return F.count_if(~is_blank(F.col(column)))


def count_blank(column: str) -> Column:
    return F.count_if(is_blank(F.col(column)))


def basic(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """SUM, AVERAGE, COUNT (numbers), COUNTA (non-blank), MIN and MAX in one pass."""
    v = numbers(df, column)
    return df.groupBy(*by).agg(
        F.coalesce(F.sum(v), F.lit(0)).alias("sum"),
        F.avg(v).alias("average"),
        F.count(v).alias("count"),
        count_values(column).alias("counta"),
        F.coalesce(F.min(v), F.lit(0)).alias("min"),
        F.coalesce(F.max(v), F.lit(0)).alias("max"),
    )


def spread(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Sample and population deviation and variance; null when there are too few values."""
    v = numbers(df, column).cast("double")
    return df.groupBy(*by).agg(
        F.stddev_samp(v).alias("stdev_s"),
        F.stddev_pop(v).alias("stdev_p"),
        F.var_samp(v).alias("var_s"),
        F.var_pop(v).alias("var_p"),
    )


def percentile(df: DataFrame, column: str, k: float, by: Sequence[str] = (), approximate: bool = False, name: str = "value") -> DataFrame:
    """Inclusive percentile with linear interpolation; ``approximate`` trades exactness for one sketch pass."""
    if not 0 <= k <= 1:
        return df.groupBy(*by).agg(F.lit(None).cast("double").alias(name))
    v = numbers(df, column)
    if approximate:
        return df.groupBy(*by).agg(F.percentile_approx(v, k).cast("double").alias(name))
    return quantiles(df, v, [k], by).select(*by, F.col("q")[0].alias(name))


def quartile(df: DataFrame, column: str, q: int, by: Sequence[str] = (), name: str = "value") -> DataFrame:
    return percentile(df, column, q / 4, by, name=name)


def median(df: DataFrame, column: str, by: Sequence[str] = (), name: str = "value") -> DataFrame:
    return percentile(df, column, 0.5, by, name=name)


def mode(df: DataFrame, column: str, order_by: Sequence[str], by: Sequence[str] = (), name: str = "value") -> DataFrame:
    """Most frequent number that repeats; the one seen first wins a tie, null when nothing repeats."""
    by = list(by)
    order_columns(order_by)
    counts = (
        df.withColumn("_v", numbers(df, column))
        .where(F.col("_v").isNotNull())
        .groupBy(*by, "_v")
        .agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*order_by)).alias("_first"))
    )
    best = counts.groupBy(*by, "_n").agg(F.min_by("_v", "_first").alias("_v"))
    return best.groupBy(*by).agg(F.max_by(F.when(F.col("_n") > 1, F.col("_v")), "_n").alias(name))


def kth(df: DataFrame, column: str, k: int, by: Sequence[str] = (), largest: bool = True, name: str = "value") -> DataFrame:
    """k-th largest or smallest value, repeats counted; null when ``k`` is out of range.

    Each task forwards at most ``k`` rows per group.
    """
    by, k = list(by), int(k)
    v = numbers(df, column)
    if k < 1:
        return df.groupBy(*by).agg(F.lit(None).cast("double").alias(name))
    rows = df.select(*by, v.alias("_v")).where(F.col("_v").isNotNull())
    order = F.col("_v").desc() if largest else F.col("_v").asc()
    if not by:
        top = rows.orderBy(order).limit(k)
        edge = F.min("_v") if largest else F.max("_v")
        return top.agg(F.when(F.count(F.lit(1)) == k, edge).alias(name))
    first_k = rows.withColumn("_rn", F.row_number().over(W.partitionBy(*by).orderBy(order))).where(F.col("_rn") <= k)
    return first_k.groupBy(*by).agg(F.max(F.when(F.col("_rn") == k, F.col("_v"))).alias(name))


def _subtotal_column(df: DataFrame, fn: int, column: str) -> Column:
    v = numbers(df, column)
    d = v.cast("double")
    return {
        1: lambda: F.avg(v),
        2: lambda: F.count(v),
        3: lambda: count_values(column),
        4: lambda: F.coalesce(F.max(v), F.lit(0)),
        5: lambda: F.coalesce(F.min(v), F.lit(0)),
        6: lambda: finite(F.coalesce(F.product(d), F.lit(1.0))),
        7: lambda: F.stddev_samp(d),
        8: lambda: F.stddev_pop(d),
        9: lambda: F.coalesce(F.sum(v), F.lit(0)),
        10: lambda: F.var_samp(d),
        11: lambda: F.var_pop(d),
    }[fn]()


def subtotal(df: DataFrame, fn: int, column: str, by: Sequence[str] = (), name: str = "value") -> DataFrame:
    """Aggregate chosen by number: 1-11, or 101-111 with the same meaning."""
    if fn % 100 not in range(1, 12):
        raise ValueError(f"unknown subtotal function {fn}")
    return df.groupBy(*by).agg(_subtotal_column(df, fn % 100, column).alias(name))


def aggregate(
    df: DataFrame, fn: int, column: str, k: float | None = None, by: Sequence[str] = (), order_by: Sequence[str] | None = None, name: str = "value"
) -> DataFrame:
    """Aggregate chosen by number: 1-11 as :func:`subtotal`, 12 median, 13 mode, 14-17 take ``k``."""
    if fn in range(1, 12):
        return subtotal(df, fn, column, by, name)
    if fn == 12:
        return median(df, column, by, name)
    if fn == 13:
        return mode(df, column, order_by, by, name)
    if fn in (14, 15):
        return kth(df, column, int(k), by, largest=fn == 14, name=name)
    if fn in (16, 17):
        return percentile(df, column, k if fn == 16 else k / 4, by, name=name)
    raise ValueError(f"unknown aggregate function {fn}")


def text_join(
    df: DataFrame, column: str, delimiter: str, order_by: Sequence[OrderKey], by: Sequence[str] = (), skip_empty: bool = True, name: str = "value"
) -> DataFrame:
    """Join the texts of each group in row order: first within each sorted block, then block by block."""
    by = list(by)
    text = F.col(column).cast("string")
    rows = df.where(text.isNotNull() & (text != "")) if skip_empty else df
    rows = rows.withColumn("_t", F.coalesce(text, F.lit("")))
    blocks = sorted_blocks(rows, [*[F.col(c) for c in by], *order_columns(order_by)])
    quoted = "'" + delimiter.replace("\\", "\\\\").replace("'", "\\'") + "'"
    joined = lambda what, order: F.expr(f"listagg({what}, {quoted}) WITHIN GROUP (ORDER BY {order})")
    parts = blocks.groupBy(BLOCK, *by).agg(joined("_t", POS).alias("_part"))
    return parts.groupBy(*by).agg(joined("_part", BLOCK).alias(name))
