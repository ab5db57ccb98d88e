"""Trendlines per group.

Coefficients come from one aggregate of sums; goodness of fit for curved shapes takes a second pass over
the rows with the coefficients attached.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tabulon.scale.skew import attach

KINDS = ("linear", "exp", "log", "power", "poly")


def predict(kind: str, coefficients: Column, x: Column, order: int = 2) -> Column:
    """Fitted value; ``coefficients`` is ``[intercept or factor, slope or exponent, ...]``."""
    a, b = coefficients[0], coefficients[1]
    positive = F.when(x > 0, x)
    if kind == "linear":
        return a + b * x
    if kind == "exp":
        return a * F.exp(b * x)
    if kind == "log":
        return a + b * F.log(positive)
    if kind == "power":
        return a * F.pow(positive, b)
    out = coefficients[order]
    for i in range(order - 1, -1, -1):
        out = out * x + coefficients[i]
    return out


def _usable(df: DataFrame, kind: str) -> DataFrame:
    df = df.where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    if kind in ("exp", "power"):
        df = df.where(F.col("_y") > 0)
    if kind in ("log", "power"):
        df = df.where(F.col("_x") > 0)
    return df


def fit(
    df: DataFrame, x: str, y: str, kind: str = "linear", by: Sequence[str] = (), intercept: float | None = None, order: int = 2
) -> DataFrame:
    """One row per group: ``coefficients`` (array), ``r2``, ``n``, ``x_min``, ``x_max``.

    ``intercept`` forces the line through it and applies to the linear shape only.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown trendline {kind!r}")
    by = list(by)
    points = _usable(df.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")), kind)
    span = [F.count(F.lit(1)).alias("n"), F.min("_x").alias("x_min"), F.max("_x").alias("x_max")]
    if kind == "poly":
        return _with_r2(points, by, "poly", _polynomial(points, by, span, max(2, min(6, order))), max(2, min(6, order)))
    u = F.log("_x") if kind in ("log", "power") else F.col("_x")
    v = F.log("_y") if kind in ("exp", "power") else F.col("_y")
    if kind == "linear" and intercept is not None:
        b = F.lit(float(intercept))
        rest = F.col("_y") - b
        sums = points.groupBy(*by).agg(
            *span, F.sum(u * u).alias("_uu"), F.sum(rest * u).alias("_ru"), F.sum(rest * rest).alias("_rr"), F.var_pop("_y").alias("_vy")
        )
        slope = F.coalesce(F.try_divide(F.col("_ru"), F.col("_uu")), F.lit(0.0))
        left = F.col("_rr") - 2 * slope * F.col("_ru") + slope * slope * F.col("_uu")
        r2 = F.coalesce(1 - F.try_divide(left, F.col("_vy") * F.col("n")), F.lit(0.0))
        return sums.select(*by, F.array(b, slope).alias("coefficients"), r2.alias("r2"), "n", "x_min", "x_max")
    slope = F.coalesce(F.try_divide(F.covar_pop(v, u), F.var_pop(u)), F.lit(0.0))
    sums = points.groupBy(*by).agg(*span, slope.alias("_m"), F.avg(u).alias("_mu"), F.avg(v).alias("_mv"), F.corr(v, u).alias("_r"))
    start = F.col("_mv") - F.col("_m") * F.col("_mu")
    first = F.exp(start) if kind in ("exp", "power") else start
    found = sums.select(*by, F.array(first, F.col("_m")).alias("coefficients"), (F.col("_r") * F.col("_r")).alias("r2"), "n", "x_min", "x_max")
    if kind in ("linear", "log"):
        return found.withColumn("r2", F.coalesce(F.nanvl("r2", F.lit(None)), F.lit(0.0)))
    return _with_r2(points, by, kind, found.drop("r2"))


def _polynomial(points: DataFrame, by: list[str], span: list[Column], order: int) -> DataFrame:
    powers = [F.sum(F.pow("_x", F.lit(float(i)))).alias(f"_p{i}") for i in range(2 * order + 1)]
    mixed = [F.sum(F.pow("_x", F.lit(float(i))) * F.col("_y")).alias(f"_q{i}") for i in range(order + 1)]
    sums = points.groupBy(*by).agg(*span, *powers, *mixed)
    packed = sums.select(
        *by,
        "n",
        "x_min",
        "x_max",
        F.array(*[f"_p{i}" for i in range(2 * order + 1)]).alias("p"),
        F.array(*[f"_q{i}" for i in range(order + 1)]).alias("q"),
    )
    out = packed.drop("p", "q").withColumn("coefficients", F.array(F.lit(0.0))).schema

    def solve(batches):
        at = np.add.outer(np.arange(order + 1), np.arange(order + 1))
        for rows in batches:
            result = []
            for p, q in zip(rows["p"], rows["q"]):
                a, b = np.asarray(p, float)[at], np.asarray(q, float)
                # Equilibrate before solving: powers of x differ by many magnitudes.
                s = 1 / np.sqrt(np.maximum(np.diag(a), 1e-300))
                result.append((np.linalg.lstsq(a * np.outer(s, s), b * s, rcond=None)[0] * s).tolist())
            yield rows.drop(columns=["p", "q"]).assign(coefficients=result)

    # One row of sums per group: the solve touches (order + 1)^2 numbers each, batch by batch.
    return packed.mapInPandas(solve, out)


def _with_r2(points: DataFrame, by: list[str], kind: str, found: DataFrame, order: int = 2) -> DataFrame:
    if by:
        rows = attach(points, found.select(*by, "coefficients"), by)
    else:
        rows = points.withColumn("coefficients", found.select("coefficients").scalar())
    miss = F.col("_y") - predict(kind, F.col("coefficients"), F.col("_x"), order)
    quality = rows.groupBy(*by).agg((F.var_pop("_y") * F.count(F.lit(1))).alias("_sst"), F.sum(miss * miss).alias("_ssr"))
    r2 = F.coalesce(1 - F.try_divide(F.col("_ssr"), F.col("_sst")), F.lit(0.0))
    if by:
        return attach(found, quality.select(*by, r2.alias("r2")), by, hot=[])
    return found.withColumn("r2", quality.select(r2).scalar())


def project(
    fitted: DataFrame, kind: str, forward: float = 0, backward: float = 0, points: int = 65, order: int = 2
) -> DataFrame:
    """Evenly spaced points of each fitted curve, extended beyond the data on either side."""
    lo, hi = F.col("x_min") - backward, F.col("x_max") + forward
    steps = fitted.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    steps = steps.withColumn("x", lo + (hi - lo) * (F.col("point") / (points - 1)))
    return steps.withColumn("y", predict(kind, F.col("coefficients"), F.col("x"), order)).where(F.col("y").isNotNull())
