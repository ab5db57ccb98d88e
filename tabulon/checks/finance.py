"""Loan and asset functions (FI) over terms derived from orders."""

from pyspark.sql import functions as F

from tabulon.checks.registry import check
from tabulon.functions import finance as N

_LOANS = """(SELECT o_orderkey, CAST(o_custkey % 10 AS DOUBLE) / 1000 AS rate, CAST([12, 24, 36, 60][o_orderkey % 4 + 1] AS DOUBLE) AS n, CAST(o_custkey % 90 * 100 + 1000 AS DOUBLE) AS pv, CAST(o_orderkey % 2 AS DOUBLE) AS due FROM orders)"""
_ANN = "CASE WHEN rate = 0 THEN n ELSE (pow(1 + rate, n) - 1) / rate * (1 + rate * due) END"
_PMT = f"(-(pv * pow(1 + rate, n) + 500) / ({_ANN}))"


def loans(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    years = F.get(F.array(*[F.lit(float(x)) for x in (12, 24, 36, 60)]), (k % 4).cast("int"))
    return t.orders.select(
        "o_orderkey",
        ((c % 10).cast("double") / 1000).alias("rate"),
        years.alias("n"),
        (c % 90 * 100 + 1000).cast("double").alias("pv"),
        (k % 2).cast("double").alias("due"),
    )


def _one(t, name, column, digits=4):
    return loans(t).select("o_orderkey", F.round(column, digits).alias(name))


def terms():
    return [F.col(c) for c in ("rate", "n", "pv", "due")]


@check("fi_pmt", f"SELECT o_orderkey, round({_PMT}, 4) AS pmt FROM {_LOANS}")
def _(t):
    rate, n, pv, due = terms()
    return _one(t, "pmt", N.pmt(rate, n, pv, 500, due))


@check("fi_fv", f"SELECT o_orderkey, round(-(pv * pow(1 + rate, n) - 30 * ({_ANN})), 4) AS fv FROM {_LOANS}")
def _(t):
    rate, n, pv, due = terms()
    return _one(t, "fv", N.fv(rate, n, -30, pv, due))


@check("fi_pv", f"SELECT o_orderkey, round(-(500 - 30 * ({_ANN})) / pow(1 + rate, n), 4) AS pv FROM {_LOANS}")
def _(t):
    rate, n, pv, due = terms()
    return _one(t, "pv", N.pv(rate, n, -30, 500, due))


@check(
    "fi_nper",
    f"""WITH l AS (SELECT *, -40 * (1 + rate * due) / nullif(rate, 0) AS c FROM {_LOANS}), r AS (SELECT *, (c - 0) / (pv + c) AS q FROM l)
SELECT o_orderkey, CASE WHEN rate = 0 THEN round(pv / 40, 4) WHEN q > 0 THEN round(ln(q) / ln(1 + rate), 4) END AS nper FROM r""",
)
def _(t):
    rate, n, pv, due = terms()
    return _one(t, "nper", N.nper(rate, -40, pv, 0, due))


@check(
    "fi_ipmt_ppmt",
    f"""WITH l AS (SELECT *, -pv * pow(1 + rate, n) / ({_ANN}) AS p FROM {_LOANS}),
b AS (SELECT *, -(pv * pow(1 + rate, 4) + p * CASE WHEN rate = 0 THEN 4 ELSE (pow(1 + rate, 4) - 1) / rate * (1 + rate * due) END) AS bal FROM l),
i AS (SELECT *, CASE WHEN due = 1 THEN (bal - p) * rate ELSE bal * rate END AS i5, CASE WHEN due = 1 THEN 0 ELSE -pv * rate END AS i1 FROM b)
SELECT o_orderkey, round(i5, 4) + 0 AS i5, round(p - i5, 4) AS p5, round(i1, 4) + 0 AS i1, CAST(NULL AS DOUBLE) AS none FROM i""",
)
def _(t):
    rate, n, pv, due = terms()
    r = lambda c: F.round(c, 4) + 0
    return loans(t).select(
        "o_orderkey",
        r(N.ipmt(rate, 5, n, pv, 0, due)).alias("i5"),
        F.round(N.ppmt(rate, 5, n, pv, 0, due), 4).alias("p5"),
        r(N.ipmt(rate, 1, n, pv, 0, due)).alias("i1"),
        N.ipmt(rate, 99, n, pv).alias("none"),
    )


@check(
    "fi_schedule",
    f"""WITH l AS (SELECT *, -pv * pow(1 + rate, n) / (CASE WHEN rate = 0 THEN n ELSE (pow(1 + rate, n) - 1) / rate END) AS p FROM {_LOANS}),
s AS (SELECT *, CASE WHEN rate = 0 THEN 0 ELSE -(pv * pow(1 + rate, k - 1) + p * (pow(1 + rate, k - 1) - 1) / rate) * rate END AS i FROM l, range(1, 61) r(k) WHERE k <= n)
SELECT o_orderkey, count(*) AS periods, round(sum(i), 3) + 0 AS interest, round(sum(p - i), 3) AS principal, round(sum(i) FILTER (k BETWEEN 3 AND 9), 3) + 0 AS cumipmt, round(sum(p - i) FILTER (k BETWEEN 3 AND 9), 3) AS cumprinc FROM s GROUP BY 1""",
)
def _(t):
    d = loans(t)
    full = N.schedule(d, "rate", "n", "pv").groupBy("o_orderkey").agg(
        F.count(F.lit(1)).alias("periods"), (F.round(F.sum("interest"), 3) + 0).alias("interest"), F.round(F.sum("principal"), 3).alias("principal")
    )
    part = N.cumulative(d, ["o_orderkey"], "rate", "n", "pv", 3, 9)
    part = part.select("o_orderkey", (F.round("cumipmt", 3) + 0).alias("cumipmt"), F.round("cumprinc", 3).alias("cumprinc"))
    return full.join(part, "o_orderkey")


@check(
    "fi_rate",
    f"""WITH l AS (SELECT *, -pv * pow(1 + rate, n) / ({_ANN}) AS p FROM {_LOANS}) SELECT o_orderkey, round(rate, 6) + 0 AS rate FROM l""",
)
def _(t):
    rate, n, pv, due = terms()
    return _one(t, "rate", N.rate(n, N.pmt(rate, n, pv, 0, due), pv, 0, due), 6).withColumn("rate", F.round("rate", 6) + 0.0)


_ASSETS = "(SELECT o_orderkey, CAST(o_custkey % 90 * 100 + 1000 AS DOUBLE) AS cost, 100.0::DOUBLE AS salvage, CAST(5 + o_orderkey % 6 AS DOUBLE) AS life, CAST(1 + o_orderkey % 5 AS DOUBLE) AS per FROM orders)"


def assets(t):
    k = F.col("o_orderkey")
    return t.orders.select(
        "o_orderkey",
        (F.col("o_custkey") % 90 * 100 + 1000).cast("double").alias("cost"),
        F.lit(100.0).alias("salvage"),
        (5 + k % 6).cast("double").alias("life"),
        (1 + k % 5).cast("double").alias("per"),
    )


def asset_terms():
    return [F.col(c) for c in ("cost", "salvage", "life", "per")]


@check("fi_sln_syd", f"SELECT o_orderkey, round((cost - salvage) / life, 4) AS sln, round((cost - salvage) * (life - per + 1) * 2 / (life * (life + 1)), 4) AS syd FROM {_ASSETS}")
def _(t):
    a = asset_terms()
    return assets(t).select("o_orderkey", F.round(N.sln(*a[:3]), 4).alias("sln"), F.round(N.syd(*a), 4).alias("syd"))


@check(
    "fi_ddb",
    f"""WITH a AS (SELECT *, list_reduce(list_transform(range(CAST(per AS INT)), lambda i: {{'acc': CAST(0 AS DOUBLE), 'dep': CAST(0 AS DOUBLE)}}),
 lambda s, x: {{'acc': s.acc + least((cost - s.acc) * (2 / life), greatest(0, cost - salvage - s.acc)), 'dep': least((cost - s.acc) * (2 / life), greatest(0, cost - salvage - s.acc))}},
 {{'acc': CAST(0 AS DOUBLE), 'dep': CAST(0 AS DOUBLE)}}) AS s FROM {_ASSETS}) SELECT o_orderkey, round(s.dep, 3) AS ddb FROM a""",
)
def _(t):
    a = asset_terms()
    return assets(t).select("o_orderkey", F.round(N.ddb(*a), 3).alias("ddb"))


@check(
    "fi_db",
    f"""WITH a AS (SELECT *, floor((1 - pow(salvage / cost, 1 / life)) * 1000 + 0.5) / 1000 AS r FROM {_ASSETS}),
b AS (SELECT *, cost * r * 7 / 12 AS f FROM a) SELECT o_orderkey, round(CASE WHEN per = 1 THEN f ELSE (cost - f) * pow(1 - r, per - 2) * r END, 3) AS db FROM b""",
)
def _(t):
    a = asset_terms()
    return assets(t).select("o_orderkey", F.round(N.db(*a, 7), 3).alias("db"))


@check(
    "fi_effect",
    f"SELECT o_orderkey, round(pow(1 + rate / 4, 4) - 1, 9) AS effect, round((pow(1 + rate, 1 / 12::DOUBLE) - 1) * 12, 9) AS nominal FROM {_LOANS}",
)
def _(t):
    rate, n, pv, due = terms()
    return loans(t).select("o_orderkey", F.round(N.effect(rate, 4), 9).alias("effect"), F.round(N.nominal(rate, 12), 9).alias("nominal"))
