"""Ranks and quantiles from counts.

Single ranks come from sketches and brackets (``at_ranks``): two narrow passes and no sort of the values. Positions of all
values come from grouping by (group, value), which collapses repeats map-side, and a running count over the distinct values. In neither
does a task hold a whole group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabulon.scale.ordering import join_null_safe, running
from tabulon.scale.skew import attach
from tabulon.scale.storage import materialize

Rank = Callable[[Column], Column]
_ACCURACY = 10_000  # the sketch's rank error is a 10,000th of the rows
_MARGIN = 2 / _ACCURACY
_WINDOW_ROWS = 1_000_000  # rows of a group beyond which a running count replaces the window


def value_positions(
    df: DataFrame, value: Column, by: Sequence[str] = (), ascending: bool = True, sizes: bool = False
) -> DataFrame:
    """Distinct values per group with ``_n`` rows each and ``_upto`` rows at or before the value.

    With ``sizes`` the number of valued rows of the group is added as ``n``.
    """
    by = list(by)
    values = df.select(*by, value.alias("_v")).where(F.col("_v").isNotNull())
    counts = values.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    if sizes and by:
        per_group = values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        counts = attach(counts, per_group, by)
    elif sizes:
        counts = counts.withColumn("n", values.agg(F.count(F.lit(1))).scalar())
    order = F.col("_v") if ascending else F.col("_v").desc()
    return running(counts, by, [order], sums={"_upto": F.col("_n")})


def at_ranks(df: DataFrame, value: Column, ranks: Sequence[tuple[float, Rank]], by: Sequence[str] = ()) -> DataFrame:
    """Exact values at ranks of a group: one row per group with ``n`` (valued rows) and an array ``q``, one entry per rank.

    A rank is ``(share, rank of n)``: about where it lies in the group, and exactly which 0-based place of the ascending
    order it is. A mergeable sketch gives a bracket around each rank; one pass then counts the rows between brackets and keeps
    the values inside only, a few in ten thousand, so the values of a group are never sorted. Should a sketch
    miss a rank, the counts show it, and those groups are counted value by value.
    """
    by = list(by)
    values = df.select(*by, value.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    ends = [end for share, _ in ranks for end in (max(0.0, share - _MARGIN), min(1.0, share + _MARGIN))]
    sketch = F.percentile_approx("_v", ends, _ACCURACY).alias("_ends")
    if by:
        marked = attach(values, values.groupBy(*by).agg(sketch), by)
    else:
        marked = values.withColumn("_ends", values.agg(sketch).scalar())
    low, high = ([F.col("_ends")[2 * i + side] for i in range(len(ranks))] for side in (0, 1))
    inside = reduce(or_, [(F.col("_v") >= a) & (F.col("_v") <= b) for a, b in zip(low, high)])
    passed = reduce(add, [(F.col("_v") > b).cast("int") for b in high])
    # Values between two brackets share the number of brackets that they have passed, and make one row.
    spots = marked.groupBy(*by, passed.alias("_gap"), F.when(inside, F.col("_v")).alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_from")
    )
    spots = materialize(spots, "ranks")
    widest = spots.groupBy(*by).agg(F.count(F.lit(1)).alias("m")).agg(F.max("m")).first()[0] or 0
    if widest > _WINDOW_ROWS:
        counted = running(spots, by, ["_from"], sums={"_upto": F.col("_n")})
    else:
        counted = spots.withColumn("_upto", F.sum("_n").over(W.partitionBy(*by).orderBy("_from")))
    found = _pick(counted, [rank for _, rank in ranks], by)
    gap = F.coalesce(F.exists("q", lambda x: x.isNull()) & F.col("n").isNotNull(), F.lit(False))
    missed = found.where(gap)
    if missed.isEmpty():
        return found
    again = join_null_safe(values, missed.select(*by), by, "left_semi") if by else values
    exact = _pick(value_positions(again, F.col("_v"), by), [rank for _, rank in ranks], by)
    return found.where(~gap).unionByName(exact)


def _pick(spots: DataFrame, ranks: Sequence[Rank], by: list[str]) -> DataFrame:
    """Values of ``spots(_v, _n, _upto)`` at the ranks; null where a rank falls on a row without a value."""
    sizes = spots.groupBy(*by).agg(F.max("_upto").alias("n"))
    joined = attach(spots, sizes, by) if by else spots.withColumn("n", spots.agg(F.max("_upto")).scalar())
    at = lambda rank: (rank(F.col("n")) < F.col("_upto")) & (rank(F.col("n")) >= F.col("_upto") - F.col("_n"))
    picked = [F.max(F.when(at(rank), F.col("_v"))) for rank in ranks]
    return joined.groupBy(*by).agg(F.max("n").alias("n"), F.array(*picked).alias("q"))


def quantiles(df: DataFrame, value: Column, ks: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolation quantiles: one row per group with an array column ``q`` and ``n``."""
    by = list(by)
    at = lambda k, n: F.lit(float(k)) * (n - 1)
    ranks = [(float(k), lambda n, k=k, near=near: near(at(k, n))) for k in ks for near in (F.floor, F.ceil)]
    found = at_ranks(df, value, ranks, by)
    out = []
    for i, k in enumerate(ks):
        lo, hi = F.col("q")[2 * i], F.col("q")[2 * i + 1]
        out.append(lo + (hi - lo) * (at(k, F.col("n")) - F.floor(at(k, F.col("n")))))
    return found.select(*by, "n", F.array(*out).alias("q"))
