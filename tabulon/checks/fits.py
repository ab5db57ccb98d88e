"""Trendlines (R)."""

from pyspark.sql import functions as F

from tabulon.checks.registry import check
from tabulon.operators import regression as R

_P = "(SELECT p_brand, CAST(p_size AS DOUBLE) AS x, p_retailprice + p_size AS y FROM part)"


def points(t):
    return t.part.select("p_brand", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") + F.col("p_size")).alias("y"))


def flat(d, *by, digits=6):
    c = lambda i: F.round(F.col("coefficients")[i], digits).alias("ab"[i] if i < 2 else f"c{i}")
    return d.select(*by, c(0), c(1), F.round("r2", 6).alias("r2"), "n")


_R2 = "round(1 - sum((y - f) ** 2) / (var_pop(y) * count(*)), 6) AS r2, count(*) AS n"


@check(
    "r_linear",
    f"""SELECT p_brand, round(regr_intercept(y, x), 6) AS a, round(regr_slope(y, x), 6) AS b, round(regr_r2(y, x), 6) AS r2, count(*) AS n FROM {_P} GROUP BY 1
UNION ALL SELECT 'forced', round(1000.0, 6), round(sum((y - 1000) * x) / sum(x * x), 6), (SELECT round(1 - sum((y - 1000 - m * x) ** 2) / (var_pop(y) * count(*)), 6) FROM {_P}, (SELECT sum((y - 1000) * x) / sum(x * x) AS m FROM {_P})), count(*) FROM {_P}""".replace("round(1000.0, 6)", "1000.0::DOUBLE"),
)
def _(t):
    forced = R.fit(points(t), "x", "y", intercept=1000)
    return flat(R.fit(points(t), "x", "y", by=["p_brand"]), "p_brand").union(flat(forced.withColumn("p_brand", F.lit("forced")), "p_brand"))


def _curve(a, b, f, u="x", v="y"):
    return f"""WITH k AS (SELECT p_brand, regr_intercept({v}, {u}) AS i, regr_slope({v}, {u}) AS b FROM {_P} GROUP BY 1), c AS (SELECT p_brand, {a} AS a, b FROM k),
p AS (SELECT c.*, y, {f} AS f FROM {_P} s JOIN c USING (p_brand)) SELECT p_brand, round(any_value(a), 6) AS a, round(any_value(b), 6) AS b, {_R2} FROM p GROUP BY 1"""


@check("r_exp", _curve("exp(i)", "b", "a * exp(b * x)", v="ln(y)"))
def _(t):
    return flat(R.fit(points(t), "x", "y", "exp", ["p_brand"]), "p_brand")


@check("r_log", _curve("i", "b", "a + b * ln(x)", u="ln(x)"))
def _(t):
    return flat(R.fit(points(t), "x", "y", "log", ["p_brand"]), "p_brand")


@check("r_power", _curve("exp(i)", "b", "a * pow(x, b)", u="ln(x)", v="ln(y)"))
def _(t):
    return flat(R.fit(points(t), "x", "y", "power", ["p_brand"]), "p_brand")


@check(
    "r_poly",
    f"""WITH s AS (SELECT p_brand, count(*) AS n, sum(x) AS s1, sum(x ** 2) AS s2, sum(x ** 3) AS s3, sum(x ** 4) AS s4, sum(y) AS t0, sum(x * y) AS t1, sum(x * x * y) AS t2 FROM {_P} GROUP BY 1),
d AS (SELECT *, n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det FROM s),
c AS (SELECT p_brand, n, (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)) / det AS c0,
 (n * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - s2 * t1)) / det AS c1, (n * (s2 * t2 - s3 * t1) - s1 * (s1 * t2 - s2 * t1) + t0 * (s1 * s3 - s2 * s2)) / det AS c2 FROM d),
p AS (SELECT c.*, y, c0 + c1 * x + c2 * x * x AS f FROM {_P} JOIN c USING (p_brand))
SELECT p_brand, round(any_value(c0), 4) AS c0, round(any_value(c1), 4) AS c1, round(any_value(c2), 4) AS c2, round(1 - sum((y - f) ** 2) / (var_pop(y) * count(*)), 4) AS r2 FROM p GROUP BY 1""",
)
def _(t):
    d = R.fit(points(t), "x", "y", "poly", ["p_brand"], order=2)
    return d.select("p_brand", *[F.round(F.col("coefficients")[i], 4).alias(f"c{i}") for i in range(3)], F.round("r2", 4).alias("r2"))


@check(
    "r_project",
    f"""WITH k AS (SELECT p_brand, regr_intercept(y, x) AS a, regr_slope(y, x) AS b, min(x) - 2 AS lo, max(x) + 5 AS hi FROM {_P} GROUP BY 1)
SELECT p_brand, CAST(i AS INT) AS point, round(lo + (hi - lo) * (i / 64), 6) AS x, round(a + b * (lo + (hi - lo) * (i / 64)), 4) AS y FROM k, range(0, 65) r(i)""",
)
def _(t):
    d = R.project(R.fit(points(t), "x", "y", by=["p_brand"]), "linear", forward=5, backward=2)
    return d.select("p_brand", "point", F.round("x", 6).alias("x"), F.round("y", 4).alias("y"))
