"""Pivot engine over grouping sets.

Source rows are aggregated once to the full key with mergeable accumulators; subtotals and grand totals
are grouping sets over that much smaller result. The result is long: one row per row line, column line
and measure. A crosstab is an optional last step.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tabulon.operators.aggregates import numbers
from tabulon.operators.filters import EMPTY_LABEL, label, page_filter, slicer
from tabulon.operators.formula import compile_formula, references
from tabulon.functions.values import is_blank
from tabulon.operators.shaping import mixed_sort_key
from tabulon.scale.ordering import join_null_safe, running
from tabulon.scale.skew import attach
from tabulon.scale.storage import materialize

FUNCTIONS = {"sum": "Sum", "count": "Count", "countNums": "Count", "average": "Average", "min": "Min", "max": "Max"}
SHOW_AS = ("normal", "percentOfTotal", "percentOfRow", "percentOfCol", "runningTotal")


@dataclass(frozen=True)
class Value:
    """An aggregated field, or a calculated one when ``calc`` holds a formula over field sums."""

    field: str | None = None
    func: str = "sum"
    calc: str | None = None
    name: str | None = None
    show_as: str = "normal"

    @property
    def label(self) -> str:
        if self.calc is not None:
            return self.name or "Calc"
        return f"{FUNCTIONS[self.func]} - {self.field}"


@dataclass(frozen=True)
class CalcItem:
    """A synthetic member of a row or column field, e.g. ``North + South``."""

    field: str
    name: str
    formula: str


@dataclass(frozen=True)
class PivotSpec:
    rows: tuple[str, ...] = ()
    cols: tuple[str, ...] = ()
    values: tuple[Value, ...] = ()
    pages: dict = field(default_factory=dict)
    slicers: dict = field(default_factory=dict)
    subtotals: bool = False
    calc_items: tuple[CalcItem, ...] = ()

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "PivotSpec":
        d = json.loads(text)
        return PivotSpec(
            tuple(d["rows"]),
            tuple(d["cols"]),
            tuple(Value(**v) for v in d["values"]),
            d["pages"],
            d["slicers"],
            d["subtotals"],
            tuple(CalcItem(**c) for c in d["calc_items"]),
        )


def items(df: DataFrame, column: str) -> DataFrame:
    """Distinct members of a field as ``label``, numbers ascending, then text, blanks labelled."""
    labels = df.select(label(df, column).alias("label")).distinct()
    return labels.orderBy(*mixed_sort_key(F.col("label")))


def _prefixes(fields: Sequence[str], subtotals: bool) -> list[tuple[str, ...]]:
    n = len(fields)
    depths = range(n, -1, -1) if subtotals else dict.fromkeys((n, 0))
    return [tuple(fields[:d]) for d in depths]


def _accumulators(df: DataFrame, spec: PivotSpec) -> dict[str, tuple[Column, Column]]:
    """Per-field (first pass, merge) aggregates needed by the measures."""
    need: dict[str, tuple[str, str]] = {}
    parts = {"sum": ["sum"], "count": ["count"], "countNums": ["nums"], "average": ["sum", "nums"], "min": ["min"], "max": ["max"]}
    for v in spec.values:
        pairs = [(f, "sum") for f in references(v.calc, df.columns)] if v.calc is not None else [(v.field, p) for p in parts[v.func]]
        for f, p in pairs:
            need[f"_{p}_{f}"] = (f, p)
    out = {}
    for name, (f, p) in need.items():
        n = numbers(df, f)
        first = {
            "sum": F.sum(n),
            "nums": F.count(n),
            "count": F.count_if(~is_blank(F.col(f))),
            "min": F.min(n),
            "max": F.max(n),
        }[p]
        col = F.col(f"`{name}`")
        merge = F.min(col) if p == "min" else F.max(col) if p == "max" else F.sum(col)
        out[name] = (first, merge)
    return out


def _measure(v: Value, df: DataFrame) -> Column:
    acc = lambda part, f: F.col(f"`_{part}_{f}`")
    if v.calc is not None:
        return compile_formula(v.calc, {f: acc("sum", f) for f in references(v.calc, df.columns)})
    if v.func == "average":
        return F.try_divide(acc("sum", v.field), acc("nums", v.field))
    if v.func in ("count", "countNums"):
        return F.nullif(acc("nums" if v.func == "countNums" else "count", v.field), F.lit(0))
    return acc(v.func, v.field)


def _depth(fields: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, (1 - F.grouping(c).cast("int") for c in fields), F.lit(0))


def _kind(depth: Column, n: int) -> Column:
    return F.when(depth == n, "leaf").when(depth == 0, "grand").otherwise("subtotal")


def compute(df: DataFrame, spec: PivotSpec) -> DataFrame:
    """Long pivot: row keys, column keys, ``row_kind``, ``col_kind``, ``measure``, ``value``.

    Kinds are ``leaf``, ``subtotal`` and ``grand``; keys below a subtotal are null.
    """
    return _lines(df, spec).select(*spec.rows, *spec.cols, "row_kind", "col_kind", "measure", "value")


def _lines(df: DataFrame, spec: PivotSpec) -> DataFrame:
    for f, item in spec.pages.items():
        df = page_filter(df, f, item)
    for f, chosen in spec.slicers.items():
        df = slicer(df, f, chosen)
    keys = [*spec.rows, *spec.cols]
    blank_safe = {c: F.nullif(F.col(c), F.lit("")) for c in keys if df.schema[c].dataType.typeName() == "string"}
    df = df.withColumns(blank_safe)

    accs = _accumulators(df, spec)
    base = df.groupBy(*keys).agg(*[a.alias(n) for n, (a, _) in accs.items()])
    merged = [m.alias(n) for n, (_, m) in accs.items()]
    row_sets, col_sets = _prefixes(spec.rows, spec.subtotals), _prefixes(spec.cols, spec.subtotals)
    if keys:
        sets = [[*r, *c] for r in row_sets for c in col_sets]
        # One marker row keeps the grand line when nothing is left to group, as a global aggregate would.
        marker = df.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in base.schema.fields], F.lit(0).alias("_real"))
        lines = (
            base.withColumn("_real", F.lit(1))
            .unionByName(marker)
            .groupingSets(sets, *keys)
            .agg(*merged, _depth(spec.rows).alias("_rd"), _depth(spec.cols).alias("_cd"), F.max("_real").alias("_real"))
            .where((F.col("_real") == 1) | (F.col("_rd") + F.col("_cd") == 0))
        )
    else:
        lines = base.withColumns({"_rd": F.lit(0), "_cd": F.lit(0)})
    measures = F.array(
        *[F.struct(F.lit(i).alias("vi"), _measure(v, df).cast("double").alias("value")) for i, v in enumerate(spec.values)]
    )
    long = lines.select(*keys, "_rd", "_cd", F.inline(measures)).withColumn("_calc", F.lit(False))
    if spec.calc_items or any(v.show_as != "normal" for v in spec.values):
        long = materialize(long, "pivot")
        long = _calculated_items(long, spec)
        long = _show_as(long, spec)
    names = F.array(*[F.lit(v.label) for v in spec.values])
    return long.withColumns(
        {
            "row_kind": _kind(F.col("_rd"), len(spec.rows)),
            "col_kind": _kind(F.col("_cd"), len(spec.cols)),
            "measure": F.get(names, F.col("vi")),
        }
    )


def _calculated_items(long: DataFrame, spec: PivotSpec) -> DataFrame:
    names = [c.name for c in spec.calc_items]
    pending = list(spec.calc_items)
    while pending:
        # An item may use another calculated one, whichever order they are listed in.
        ready = [c for c in pending if not any(o.name in c.formula and o is not c for o in pending if o.field == c.field)]
        if not ready:
            raise ValueError(f"calculated items {names} refer to each other in a circle")
        for item in ready:
            long = long.unionByName(_item_rows(long, spec, item))
            pending.remove(item)
    return long


def _item_rows(long: DataFrame, spec: PivotSpec, item: CalcItem) -> DataFrame:
    on_rows = item.field in spec.rows
    fields, depth = (spec.rows, "_rd") if on_rows else (spec.cols, "_cd")
    level = fields.index(item.field)
    others = [c for c in [*spec.rows, *spec.cols] if c != item.field] + ["_rd", "_cd", "vi"]
    shown = F.when(F.col(item.field).isNull(), F.lit(EMPTY_LABEL)).otherwise(F.col(item.field).cast("string"))
    siblings = long.where(F.col(depth) > level).withColumn("_label", shown)
    members = _labels_in(item.formula, siblings)
    per_key = siblings.where(F.col("_label").isin(members)).groupBy(*others).agg(
        *[F.max(F.when(F.col("_label") == m, F.col("value"))).alias(f"_m{i}") for i, m in enumerate(members)],
        F.max("_calc").alias("_calc"),
    )
    value = compile_formula(item.formula, {m: F.col(f"_m{i}") for i, m in enumerate(members)})
    kind = long.schema[item.field].dataType
    return per_key.withColumns({"value": value, item.field: F.lit(item.name).cast(kind), "_calc": F.lit(True)}).select(*long.columns)


def _labels_in(formula: str, siblings: DataFrame) -> list[str]:
    """Members the formula names: bounded by the text of the formula, not by the field."""
    hits = siblings.select("_label").distinct().where(F.contains(F.lit(formula), F.col("_label")))
    found = [r[0] for r in hits.collect()]
    return references(formula, found)


def _show_as(long: DataFrame, spec: PivotSpec) -> DataFrame:
    modes = [v.show_as for v in spec.values]
    unknown = set(modes) - set(SHOW_AS)
    if unknown:
        raise ValueError(f"unknown show-as {unknown}")
    pick = lambda mode: [i for i, m in enumerate(modes) if m == mode]
    parts = []
    plain = pick("normal")
    if plain:
        parts.append(long.where(F.col("vi").isin(plain)))
    for mode in ("percentOfTotal", "percentOfCol", "percentOfRow"):
        chosen = pick(mode)
        if chosen:
            parts.append(_percent(long.where(F.col("vi").isin(chosen)), spec, mode))
    chosen = pick("runningTotal")
    if chosen:
        parts.append(_running(long.where(F.col("vi").isin(chosen)), spec))
    return reduce(DataFrame.unionByName, parts)


def _percent(lines: DataFrame, spec: PivotSpec, mode: str) -> DataFrame:
    keys = {"percentOfTotal": [], "percentOfCol": [*spec.cols, "_cd"], "percentOfRow": [*spec.rows, "_rd"]}[mode]
    total_of = {"percentOfTotal": ("_rd", "_cd"), "percentOfCol": ("_rd",), "percentOfRow": ("_cd",)}[mode]
    totals = lines.where(reduce(lambda a, b: a & b, (F.col(c) == 0 for c in total_of))).select(
        "vi", *keys, F.col("value").alias("_total")
    )
    if mode == "percentOfTotal":
        joined = join_null_safe(lines, totals, ["vi"], "left", small=True)  # one row per measure
    else:
        joined = attach(lines, totals, ["vi", *keys])
    share = F.coalesce(F.try_divide(F.col("value"), F.col("_total")), F.lit(0.0))
    return joined.withColumn("value", F.when(F.col("value").isNotNull(), share)).drop("_total")


def _running(lines: DataFrame, spec: PivotSpec) -> DataFrame:
    leaves = lines.where((F.col("_rd") == len(spec.rows)) & F.col("value").isNotNull())
    order = [F.col("_calc"), *[k for c in spec.rows for k in _item_order(lines, c)]]
    summed = running(leaves, ["vi", *spec.cols, "_cd"], order, sums={"_run": F.col("value")})
    return summed.withColumn("value", F.col("_run")).drop("_run")


def _item_order(df: DataFrame, column: str) -> list[Column]:
    c = F.col(column)
    return [c.asc_nulls_first() if df.schema[column].dataType.typeName() == "string" else c.asc_nulls_last()]


def chart_data(df: DataFrame, spec: PivotSpec) -> DataFrame:
    """Leaf cells only."""
    return compute(df, spec).where("row_kind = 'leaf' AND col_kind = 'leaf'")


def crosstab(df: DataFrame, spec: PivotSpec, max_columns: int = 16_384) -> DataFrame:
    """One row per row line and one column per column line and measure, with total captions.

    Column lines come to the driver to name the columns; more than a table can hold is an error.
    """
    long = materialize(_lines(df, spec), "lines")  # read for the column lines and for the cells
    R, C, many = len(spec.rows), len(spec.cols), len(spec.values) > 1

    def caption(fields, depth, i, text):
        name = F.when(F.col(fields[i]).isNull(), F.lit(EMPTY_LABEL)).otherwise(label(long, fields[i]))
        last = F.col(depth) == i + 1
        shown = F.when(last & (F.col(depth) < len(fields)), F.concat(name, F.lit(" Total"))).otherwise(name)
        return F.when(F.col(depth) > i, shown).when((F.col(depth) == 0) & F.lit(i == 0), F.lit("Grand Total")).otherwise("").alias(text)

    heads = [caption(spec.cols, "_cd", i, f"_h{i}") for i in range(C)]
    if many or not C:
        heads.append(F.col("measure").alias(f"_h{C}"))
    titled = long.withColumn("_head", F.concat_ws(" / ", *[F.nullif(h, F.lit("")) for h in heads]))
    lines = titled.groupBy("_head").agg(F.min(F.struct(*_position(spec.cols, "_cd"), "vi")).alias("_at"))
    listed = [r[0] for r in lines.orderBy("_at").limit(max_columns + 1).collect()]
    if len(listed) > max_columns:
        raise ValueError(f"a table holds at most {max_columns} columns; use the long form")
    captions = {f"_r{i}": caption(spec.rows, "_rd", i, f"_r{i}") for i in range(R)} or {"_r0": F.lit("Total")}
    wide = (
        titled.withColumns(captions)
        .groupBy(*captions, *spec.rows, "_rd")
        .pivot("_head", listed)
        .agg(F.first("value", ignorenulls=True))
    )
    sort = []
    for i, c in enumerate(spec.rows):
        sort += [(F.col("_rd") <= i).asc(), *_item_order(long, c)]
    names = [F.col(k).alias(spec.rows[i] if R else "Total") for i, k in enumerate(captions)]
    return wide.orderBy(*sort).select(*names, *[F.col(f"`{h}`") for h in listed])


def _position(fields: Sequence[str], depth: str) -> list[Column]:
    """Sortable place of an axis line: leaves before their subtotal, the grand line last."""
    out = []
    for i, c in enumerate(fields):
        out += [(F.col(depth) <= i).alias(f"t{i}"), F.col(c).alias(f"k{i}")]
    return out
