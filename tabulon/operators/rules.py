"""Highlight rules over a column.

Range statistics come from one aggregate used as a scalar subquery, so the rules themselves stay a
projection over the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabulon.operators.filters import label
from tabulon.functions.values import to_number
from tabulon.scale.counts import at_ranks, quantiles
from tabulon.scale.skew import attach


@dataclass(frozen=True)
class Stop:
    """A threshold: ``min``, ``max``, ``num``, ``percent`` or ``percentile`` with its value."""

    type: str
    value: float = 0.0
    color: str | None = None
    inclusive: bool = True


class Stats:
    """Lazy statistics of one column; each is planned as a scalar subquery when a rule asks for it."""

    def __init__(self, df: DataFrame, column: str, percentiles: Sequence[float] = ()):
        self.v = to_number(F.col(column)) if df.schema[column].dataType.typeName() == "string" else F.col(column).cast("double")
        one = df.agg(
            F.struct(
                F.coalesce(F.min(self.v), F.lit(0.0)).alias("min"),
                F.coalesce(F.max(self.v), F.lit(0.0)).alias("max"),
                F.coalesce(F.avg(self.v), F.lit(0.0)).alias("avg"),
                F.count(self.v).alias("n"),
            ).alias("s")
        ).scalar()
        self.min, self.max, self.avg, self.n = (one[k] for k in ("min", "max", "avg", "n"))
        wanted = sorted(set(percentiles))
        self._q = {}
        if wanted:
            q = quantiles(df, self.v, [p / 100 for p in wanted]).select("q").scalar()
            self._q = {p: F.coalesce(q[i], F.lit(0.0)) for i, p in enumerate(wanted)}

    def stop(self, s: Stop) -> Column:
        if s.type == "min":
            return self.min
        if s.type == "max":
            return self.max
        if s.type == "percent":
            return self.min + F.lit(s.value / 100) * (self.max - self.min)
        if s.type == "percentile":
            return self._q[s.value]
        return F.lit(float(s.value))


def stats_for(df: DataFrame, column: str, *stops: Stop) -> Stats:
    return Stats(df, column, [s.value for s in stops if s.type == "percentile"])


def top_n(
    df: DataFrame, column: str, rank: float = 10, percent: bool = False, bottom: bool = False, by: Sequence[str] = (), name: str = "hit"
) -> DataFrame:
    """Flag the top or bottom ``rank`` values (or percent of them, rounded up); ties at the cut are in."""
    by = list(by)
    v = F.col(column).cast("double")
    edge = F.max if bottom else F.min
    if percent:
        # The last row of the wanted share of a group.
        share = rank / 100
        nth = lambda n: F.least(F.greatest(F.ceil(F.lit(share) * n), F.lit(1)), n) - 1
        place = (min(1.0, share), nth) if bottom else (max(0.0, 1 - share), lambda n: n - 1 - nth(n))
        inside = at_ranks(df, v, [place], by).select(*by, F.col("q")[0].alias("_v"))
    else:
        # The first ``rank`` rows per group; each task forwards no more.
        order = F.col("_v").asc() if bottom else F.col("_v").desc()
        valued = df.select(*by, v.alias("_v")).where(F.col("_v").isNotNull())
        if by:
            placed = valued.withColumn("_at", F.row_number().over(W.partitionBy(*by).orderBy(order)))
            inside = placed.where(F.col("_at") <= max(1, int(rank)))
        else:
            inside = valued.orderBy(order).limit(max(1, int(rank)))
    if by:
        df = attach(df, inside.groupBy(*by).agg(edge("_v").alias("_cut")), by)
    else:
        df = df.withColumn("_cut", inside.agg(edge("_v")).scalar())
    hit = v <= F.col("_cut") if bottom else v >= F.col("_cut")
    return df.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_cut")


def above_average(v: Column, average: Column, above: bool = True, equal: bool = False) -> Column:
    if above:
        return v >= average if equal else v > average
    return v <= average if equal else v < average


def repeats(df: DataFrame, column: str, name: str = "copies") -> DataFrame:
    """Rows per distinct label, null for blanks: above one is a duplicate, one is unique."""
    labelled = df.withColumn("_label", F.nullif(label(df, column, ""), F.lit("")))
    counts = labelled.where(F.col("_label").isNotNull()).groupBy("_label").agg(F.count(F.lit(1)).alias(name))
    return attach(labelled, counts, ["_label"]).drop("_label")


def _channels(color: str) -> list[int]:
    h = color.lstrip("#")
    return [int(h[i : i + 2], 16) for i in (0, 2, 4)]


def color_scale(v: Column, stats: Stats, stops: Sequence[Stop]) -> Column:
    """Colour text interpolated between stops, clamped at both ends; null for non-numbers."""
    at = [stats.stop(s) for s in stops]
    rgb = [_channels(s.color or "#ffffff") for s in stops]
    solid = lambda c: F.lit("#" + "".join(f"{x:02x}" for x in c))

    def mix(i: int) -> Column:
        span = at[i] - at[i - 1]
        t = F.when(span > 0, (v - at[i - 1]) / F.when(span > 0, span)).otherwise(F.lit(0.0))
        parts = [F.floor(F.lit(a) + (b - a) * t + 0.5).cast("int") for a, b in zip(rgb[i - 1], rgb[i])]
        return F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(p)), 2, "0") for p in parts])

    out = F.when(v <= at[0], solid(rgb[0])).when(v >= at[-1], solid(rgb[-1]))
    for i in range(1, len(stops)):
        out = out.when(v <= at[i], mix(i))
    return F.when(v.isNotNull(), out.otherwise(F.lit("#ffffff")))


def data_bar(v: Column, stats: Stats, low: Stop = Stop("min"), high: Stop = Stop("max")) -> Column:
    """Bar length between 0 and 1."""
    lo, hi = stats.stop(low), stats.stop(high)
    span = hi - lo
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - lo) / F.when(span > 0, span)))
    return F.when(v.isNotNull(), F.coalesce(share, F.lit(0.0)))


def icon_bucket(v: Column, stats: Stats, stops: Sequence[Stop], reverse: bool = False) -> Column:
    """Bucket 0 .. n-1: thresholds are tried in order and the first one missed ends the climb."""
    index = F.lit(len(stops) - 1)
    for i in range(len(stops) - 1, 0, -1):
        t = stats.stop(stops[i])
        passed = v >= t if stops[i].inclusive else v > t
        index = F.when(passed, index).otherwise(F.lit(i - 1))
    if reverse:
        index = F.lit(len(stops) - 1) - index
    return F.when(v.isNotNull(), index)


def _operand(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.expr(x)
    return F.lit(x)


def cell_is(v: Column, operator: str, a, b=None) -> Column:
    """Compare a number with literals, columns or SQL expressions; a null operand never matches."""
    x = _operand(a)
    y = _operand(b) if b is not None else F.lit(None).cast("double")
    test = {
        "greaterThan": lambda: v > x,
        "greaterThanOrEqual": lambda: v >= x,
        "lessThan": lambda: v < x,
        "lessThanOrEqual": lambda: v <= x,
        "equal": lambda: v == x,
        "notEqual": lambda: v != x,
        "between": lambda: (v >= x) & (v <= y),
        "notBetween": lambda: (v < x) | (v > y),
    }[operator]()
    # A conjunction, not a conditional: false for nulls and still a filter the scan can take.
    known = v.isNotNull() & x.isNotNull()
    return test & (known & y.isNotNull() if operator in ("between", "notBetween") else known)


def text_is(c: Column, operator: str, text: str) -> Column:
    """Case-sensitive text tests on the displayed text; an empty needle never matches."""
    if not text:
        return F.lit(False)
    t = F.coalesce(c.cast("string"), F.lit(""))
    return {
        "containsText": lambda: t.contains(text),
        "notContainsText": lambda: ~t.contains(text),
        "beginsWith": lambda: t.startswith(text),
        "endsWith": lambda: t.endswith(text),
    }[operator]()


def _sunday(d: Column) -> Column:
    return F.date_sub(d, F.dayofweek(d) - 1)


def time_period(c: Column, period: str, today) -> Column:
    """Date tests against a reference day; weeks start on Sunday."""
    d = c.cast("date")
    t = today if isinstance(today, Column) else F.lit(today).cast("date")
    months = lambda x: F.year(x) * 12 + F.month(x)
    test = {
        "today": lambda: d == t,
        "yesterday": lambda: d == F.date_sub(t, 1),
        "tomorrow": lambda: d == F.date_add(t, 1),
        "last7Days": lambda: (d <= t) & (d >= F.date_sub(t, 6)),
        "thisWeek": lambda: _sunday(d) == _sunday(t),
        "lastWeek": lambda: _sunday(d) == F.date_sub(_sunday(t), 7),
        "nextWeek": lambda: _sunday(d) == F.date_add(_sunday(t), 7),
        "thisMonth": lambda: months(d) == months(t),
        "lastMonth": lambda: months(d) == months(t) - 1,
        "nextMonth": lambda: months(d) == months(t) + 1,
    }[period]()
    return F.coalesce(test, F.lit(False))


@dataclass(frozen=True)
class Rule:
    """One highlight rule: a predicate with a style, or a colour scale, data bar or icon set."""

    priority: int
    kind: str  # "cellIs", "text", "expression", "timePeriod", "aboveAverage", "top", "duplicates", "unique", "colorScale", "dataBar", "icons"
    args: dict = field(default_factory=dict)
    style: str | None = None


def apply_rules(df: DataFrame, column: str, rules: Sequence[Rule], today=None) -> DataFrame:
    """Add ``rule_id`` (priority of the winning rule), ``style``, ``fill``, ``bar`` and ``icon``.

    Rules are tried by priority; the first match wins and a graphical rule ends the chain for numbers.
    """
    rules = sorted(rules, key=lambda r: r.priority)
    columns = list(df.columns)
    stops = [s for r in rules for s in [*r.args.get("stops", ()), r.args.get("low"), r.args.get("high")] if s]
    stats = stats_for(df, column, *stops)
    v = stats.v
    work, helpers = df, []
    if any(r.kind in ("duplicates", "unique") for r in rules):
        work = repeats(work, column, "_copies")
        helpers.append("_copies")
    for i, r in enumerate(rules):
        if r.kind == "top":
            work = top_n(work, column, name=f"_top{i}", **r.args)
            helpers.append(f"_top{i}")
    fills = {"fill": F.lit(None).cast("string"), "bar": F.lit(None).cast("double"), "icon": F.lit(None).cast("int")}
    tests = []
    for i, r in enumerate(rules):
        shown = dict(fills)
        if r.kind in ("colorScale", "dataBar", "icons"):
            hit = v.isNotNull()
            if r.kind == "colorScale":
                shown["fill"] = color_scale(v, stats, r.args["stops"])
            elif r.kind == "dataBar":
                shown["bar"] = data_bar(v, stats, r.args.get("low", Stop("min")), r.args.get("high", Stop("max")))
            else:
                shown["icon"] = icon_bucket(v, stats, r.args["stops"], r.args.get("reverse", False)).cast("int")
        else:
            hit = _predicate(r, i, df, column, v, stats, today)
        look = F.struct(
            F.lit(r.priority).alias("rule_id"), F.lit(r.style).cast("string").alias("style"), *[c.alias(n) for n, c in shown.items()]
        )
        tests.append(F.when(hit, look))
    won = F.coalesce(*tests)
    return work.withColumn("_won", won).select(*columns, "_won.*")


def _predicate(r: Rule, i: int, df: DataFrame, column: str, v: Column, stats: Stats, today) -> Column:
    if r.kind == "cellIs":
        return cell_is(v, **r.args)
    if r.kind == "text":
        return text_is(label(df, column, ""), **r.args)
    if r.kind == "expression":
        return F.coalesce(F.expr(r.args["condition"]).cast("boolean"), F.lit(False))
    if r.kind == "timePeriod":
        return time_period(F.col(column), r.args["period"], today)
    if r.kind == "aboveAverage":
        return F.coalesce(above_average(v, stats.avg, **r.args), F.lit(False))
    if r.kind == "top":
        return F.col(f"_top{i}")
    if r.kind == "duplicates":
        return F.coalesce(F.col("_copies") > 1, F.lit(False))
    if r.kind == "unique":
        return F.coalesce(F.col("_copies") == 1, F.lit(False))
    raise ValueError(f"unknown rule kind {r.kind!r}")


