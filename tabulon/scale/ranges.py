"""Carrying values along an order in one shuffle.

Rows are dealt to ranges of the order key, cut at bounds from a mergeable sketch, and each range of a group is one window
partition. What earlier ranges hand on comes from a table with one row per group and range, so nothing is sorted or
stored as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import DataType, DateType, NumericType, TimestampNTZType, TimestampType

from tabulon.scale.skew import attach

_FINE = 16  # bounds compared in each of the two steps that find a range
RANGE = "__range"


def can_cut(kind: DataType) -> bool:
    """Whether the sketch takes keys of this type."""
    return isinstance(kind, (NumericType, DateType, TimestampType, TimestampNTZType))


def range_bounds(df: DataFrame, key: str, ranges: int | None = None) -> list:
    """Ascending distinct bounds that cut ``key`` into about ``ranges`` equal parts (default: as many as shuffles have partitions)."""
    ranges = min(_FINE * _FINE, ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / ranges for i in range(1, ranges)]
    found = df.agg(F.percentile_approx(key, shares, 10 * ranges).alias("b")).first()["b"] if shares else None
    return sorted(set(found or []))


def range_of(key: Column, bounds: Sequence, kind: DataType) -> Column:
    """Number of bounds at or below ``key``, in two steps of a few comparisons each."""
    if not bounds:
        return F.lit(0)
    literal = lambda values: F.array(*[F.lit(v).cast(kind) for v in values])
    rows = [bounds[i : i + _FINE] for i in range(0, len(bounds), _FINE)]
    below = lambda among: F.size(F.filter(among, lambda b: b <= key))
    coarse = F.greatest(below(literal([r[0] for r in rows])) - 1, F.lit(0))
    return coarse * _FINE + below(F.get(F.array(*map(literal, rows)), coarse))


def carry_along(df: DataFrame, by: Sequence[str], key: str, value: str, backward: bool = True, name: str = "_near", bounds: Sequence | None = None) -> DataFrame:
    """Adds ``name``: the last non-null ``value`` at or before the row in the order of ``key`` (at or after it if not ``backward``).

    ``key`` must be distinct within a group and not null. A group that spans ranges gets what the ranges before it hand on.
    """
    by, kind = list(by), df.schema[key].dataType
    bounds = range_bounds(df, key) if bounds is None else bounds
    ranged = df.withColumn(RANGE, range_of(F.col(key), bounds, kind))
    order = F.col(key).asc() if backward else F.col(key).desc()
    near = F.last(value, ignorenulls=True).over(W.partitionBy(*by, RANGE).orderBy(order))
    local = ranged.withColumn(name, near)
    last = F.max_by if backward else F.min_by
    held = ranged.groupBy(*by, RANGE).agg(last(value, F.when(F.col(value).isNotNull(), F.col(key))).alias("_held"))
    along = F.col(RANGE).asc() if backward else F.col(RANGE).desc()
    before = W.partitionBy(*by).orderBy(along).rowsBetween(W.unboundedPreceding, -1)
    carried = held.select(*by, RANGE, F.last("_held", ignorenulls=True).over(before).alias("_carried")).where("_carried is not null")
    joined = attach(local, carried, [*by, RANGE])
    return joined.withColumn(name, F.coalesce(name, "_carried")).drop("_carried", RANGE)
