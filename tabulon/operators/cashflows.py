"""Aggregates over cash-flow rows.

Present values are single partial/final aggregates. Internal rates are found by narrowing a grid of trial
rates: within the row of its list for a group of a few thousand dates, with one aggregate per pass for a longer one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabulon.functions.values import finite
from tabulon.scale.ordering import OrderKey, join_null_safe, running
from tabulon.scale.skew import attach
from tabulon.scale.storage import materialize

# Starting guess and lowest rate searched.
GUESS, LOWEST = 0.1, -0.9999
_GRID = 14  # trial rates in a pass
_PASSES = 40  # passes after which a list is left as it is; a bracket narrows by 13 in each
_LISTED = 4096  # dates up to which the flows of a group are one list
_CLOSE = 1e-6  # width of a bracket from which two secant steps finish


def numbered(df: DataFrame, amount: str, order_by: Sequence[OrderKey], by: Sequence[str] = (), name: str = "period") -> DataFrame:
    """Number the cash flows of each group from 0 in row order; rows without an amount are left out."""
    flows = df.where(F.col(amount).isNotNull())
    return running(flows, by, order_by, sums={name: F.lit(1)}).withColumn(name, F.col(name) - 1)


def npv(df: DataFrame, amount: str, period: str, rate: float, by: Sequence[str] = (), name: str = "npv") -> DataFrame:
    """Net present value; ``period`` counts from 0 and the first flow is discounted once."""
    value = F.sum(F.col(amount) / F.pow(F.lit(1.0 + rate), F.col(period) + 1))
    return df.groupBy(*by).agg(finite(F.coalesce(value, F.lit(0.0))).alias(name))


def xnpv(
    df: DataFrame, amount: str, date: str, rate: float, order_by: Sequence[str], by: Sequence[str] = (), name: str = "xnpv"
) -> DataFrame:
    """Present value at the date of the first row, with 365-day years.

    Discounting to a fixed day first and shifting the total to the group's first date keeps this one pass.
    """
    years = F.datediff(F.col(date).cast("date"), F.lit("2000-01-01").cast("date")) / F.lit(365.0)
    base = F.lit(1.0 + rate)
    total = F.sum(F.col(amount) / F.pow(base, years))
    first = F.min_by(years, F.struct(*order_by))
    flows = df.where(F.col(amount).isNotNull() & F.col(date).isNotNull())
    return flows.groupBy(*by).agg(finite(total * F.pow(base, first)).alias(name))


def mirr(
    df: DataFrame, amount: str, period: str, finance_rate: float, reinvest_rate: float, by: Sequence[str] = (), name: str = "mirr"
) -> DataFrame:
    """Modified internal rate: outflows discounted, inflows compounded to the last period."""
    v, i = F.col(amount), F.col(period)
    paid = F.sum(F.when(v < 0, v / F.pow(F.lit(1.0 + finance_rate), i)))
    earned = F.sum(F.when(v >= 0, v / F.pow(F.lit(1.0 + reinvest_rate), i)))
    sums = df.where(v.isNotNull()).groupBy(*by).agg(
        paid.alias("_paid"), F.coalesce(earned, F.lit(0.0)).alias("_earned"), (F.count(v) - 1).alias("_last")
    )
    grown = F.col("_earned") * F.pow(F.lit(1.0 + reinvest_rate), F.col("_last"))
    rate = F.pow(-grown / F.col("_paid"), F.try_divide(F.lit(1.0), F.col("_last"))) - 1
    usable = (F.col("_last") >= 1) & (F.col("_paid") < 0)
    return sums.select(*by, F.when(usable, finite(rate)).alias(name))


def irr(df: DataFrame, amount: str, period: str, by: Sequence[str] = (), name: str = "irr") -> DataFrame:
    """Rate at which the flows of each group are worth nothing; null when no rate in range does."""
    return _rate(df.select(*by, F.col(period).cast("double").alias("_t"), F.col(amount).alias("_v")), list(by), name)


def xirr(
    df: DataFrame, amount: str, date: str, order_by: Sequence[str], by: Sequence[str] = (), name: str = "xirr"
) -> DataFrame:
    """As :func:`irr` with dated flows. The zero rate does not depend on the day discounted to."""
    years = F.datediff(F.col(date).cast("date"), F.lit("2000-01-01").cast("date")) / F.lit(365.0)
    flows = df.select(*by, years.alias("_t"), F.col(amount).alias("_v"))
    start = flows.groupBy(*by).agg(F.min("_t").alias("_t0"))
    if by:
        flows = attach(flows, start, by)
    else:
        flows = flows.withColumn("_t0", start.select("_t0").scalar())
    return _rate(flows.select(*by, (F.col("_t") - F.col("_t0")).alias("_t"), "_v"), list(by), name)


def _first_rates() -> list[str]:
    # Denser near the guess, where the bracket closest to it is wanted.
    low = [LOWEST + (GUESS - LOWEST) * (k / 6) for k in range(6)]
    high = [GUESS + 10.0 * (k / 6) ** 2 for k in range(7)] + [10.0**k for k in (2, 4, 6, 8, 10, 12)]
    return [f"{r!r}D" for r in low + high]


def _worths(rates: list[str]) -> list[Column]:
    return [F.expr(f"sum(_v * power(1D + {r}, -_t))").alias(f"_y{k}") for k, r in enumerate(rates)]


def _bracket(points: str, n: int) -> str:
    """SQL for the sign change nearest to the guess among ``n`` points ``(r, y)``, with the worth at both ends."""
    return f"""get(transform(array({points}), p -> array_min(filter(
        zip_with(slice(p, 1, {n - 1}), slice(p, 2, {n - 1}), (a, b) -> named_struct(
            'far', greatest(0D, a.r - {GUESS}D, {GUESS}D - b.r), '_lo', a.r, '_hi', b.r, '_ylo', a.y, '_yhi', b.y)),
        x -> signum(x._ylo) * signum(x._yhi) <= 0))), 0)"""


def _narrow(sums: DataFrame, by: list[str], rates: list[str]) -> DataFrame:
    points = ", ".join(f"named_struct('r', {r}, 'y', _y{k})" for k, r in enumerate(rates))
    best = sums.select(*by, F.expr(_bracket(f"array({points})", len(rates))).alias("_best"))
    return best.select(*by, "_best._lo", "_best._hi", "_best._ylo", "_best._yhi")


# Width of a bracket as a share of the growth factor above zero, in rates below.
_WIDTH = "(({0}._hi - {0}._lo) / greatest(1D, 1D + {0}._lo))"


def _root(b: str) -> str:
    """SQL for a secant step in the bracket ``b``."""
    # Above zero, worth is nearly straight in the discount factor 1 / (1 + rate), for far roots too.
    near = f"{b}._lo - {b}._ylo * coalesce(try_divide({b}._hi - {b}._lo, {b}._yhi - {b}._ylo), 0D)"
    factor = f"1 / (1 + {b}._lo) - {b}._ylo * coalesce(try_divide(1 / (1 + {b}._hi) - 1 / (1 + {b}._lo), {b}._yhi - {b}._ylo), 0D)"
    return f"if({b}._lo < 0, {near}, try_divide(1D, {factor}) - 1)"


def _ends_and_root(b: str) -> list[str]:
    """Trial rates of the last pass: both ends and the secant's root between them; its error is squared by the next step."""
    return [f"{b}._lo", f"least({b}._hi, greatest({b}._lo, {_root(b)}))", f"{b}._hi"]


def _solve_lists(flows: DataFrame, by: list[str]) -> DataFrame:
    """Brackets of groups of at most _LISTED flows, each narrowed within its row: one shuffle and no passes."""
    lists = flows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_t", "_v"))).alias("_f"), F.sum("_n").alias("_count"))
    worth = "named_struct('r', r, 'y', aggregate(_f, 0D, (s, f) -> s + f._v * power(1D + r, -f._t)))"
    rates = _first_rates()
    first = _bracket(f"transform(array({', '.join(rates)}), r -> {worth})", len(rates))
    trial = f"transform(sequence(0, {_GRID - 1}), k -> b._lo + (b._hi - b._lo) * (k / {_GRID - 1}D))"
    step = _bracket(f"transform({trial}, r -> {worth})", _GRID)
    begun = lists.where("_count >= 2").select(*by, "_f", F.expr(first).alias("_b"))
    closed = F.expr(f"aggregate(sequence(1, {_PASSES}), _b, (b, i) -> if(b is null or {_WIDTH.format('b')} <= {_CLOSE}D, b, {step}))")
    last = F.expr(_bracket(f"transform(array({', '.join(_ends_and_root('_b'))}), r -> {worth})", 3))
    ended = begun.select(*by, "_f", closed.alias("_b")).select(*by, last.alias("_b"))
    return ended.select(*by, "_b._lo", "_b._hi", "_b._ylo", "_b._yhi")


def _solve_passes(flows: DataFrame, by: list[str]) -> DataFrame:
    """Brackets of long groups by one aggregate a pass, so that a series of any length stays distributed."""
    rates = _first_rates()
    sums = flows.groupBy(*by).agg(*_worths(rates))
    # One small row per group and pass is written out: plans stay short and a lost executor repeats one pass.
    state = materialize(_narrow(sums, by, rates), "rates")
    trial = [f"(_lo + (_hi - _lo) * {k / (_GRID - 1)!r}D)" for k in range(_GRID)]
    width = F.max(F.expr(_WIDTH.format("s")))
    while (state.select(F.struct("_lo", "_hi").alias("s")).agg(width).first()[0] or 0) > _CLOSE:
        joined = attach(flows, state.select(*by, "_lo", "_hi"), by).where(F.col("_lo").isNotNull())
        state = materialize(_narrow(joined.groupBy(*by, "_lo", "_hi").agg(*_worths(trial)), by, trial), "rates")
    tried = [f"_r{k}" for k in range(3)]
    last = state.where("_lo is not null").select(*by, F.struct("_lo", "_hi", "_ylo", "_yhi").alias("_b"))
    last = last.select(*by, *[F.expr(r).alias(c) for r, c in zip(_ends_and_root("_b"), tried)])
    joined = attach(flows, last, by).where(F.col("_r0").isNotNull())
    return materialize(_narrow(joined.groupBy(*by, *tried).agg(*_worths(tried)), by, tried), "rates")


def _rate(flows: DataFrame, by: list[str], name: str) -> DataFrame:
    if not by:
        return _rate(flows.withColumn("_all", F.lit(0)), ["_all"], name).drop("_all")
    flows = flows.where(F.col("_v").isNotNull()).groupBy(*by, "_t").agg(F.sum(F.col("_v").cast("double")).alias("_v"), F.count("_v").alias("_n"))
    flows = materialize(flows, "flows")
    sizes = flows.groupBy(*by).agg(F.count(F.lit(1)).alias("_dates"))
    long = materialize(sizes.where(F.col("_dates") > _LISTED).select(*by), "long")
    if long.isEmpty():
        state = _solve_lists(flows, by)
    else:
        # Few groups can be long, for each holds more than _LISTED flows.
        state = _solve_lists(join_null_safe(flows, long, by, "left_anti"), by).unionByName(
            _solve_passes(join_null_safe(flows, long, by, "left_semi"), by)
        )
    state = state.select(*by, F.struct("_lo", "_hi", "_ylo", "_yhi").alias("_b"))
    root = F.expr(_root("_b"))
    return attach(sizes.select(*by), state.select(*by, finite(root).alias(name)), by, hot=[])
