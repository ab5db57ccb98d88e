"""Pivot engine (V) and the flagship query."""

from dataclasses import replace

from pyspark.sql import functions as F

from tabulon.checks.registry import check
from tabulon.operators import pivot as V
from tabulon.operators import transforms as T
from tabulon.plans.steps import Steps


def dec(df, n=2):
    return df.withColumn("value", F.round("value", n))


def _sql(measures, table="lineitem", rows=("l_returnflag",), cols=("l_linestatus",), subtotals=False, where="true", digits=2, value="v", only=None):
    """Long pivot in SQL: one SELECT per measure over the same grouping sets."""
    pre = lambda f: [f[:d] for d in (range(len(f), -1, -1) if subtotals else sorted({len(f), 0}, reverse=True))]
    sets = ", ".join("(" + ", ".join([*r, *c]) + ")" for r in pre(rows) for c in pre(cols))
    depth = lambda f: " + ".join(f"(1 - grouping({c}))" for c in f) or "0"
    kind = lambda f: f"CASE WHEN {depth(f)} = {len(f)} THEN 'leaf' WHEN {depth(f)} = 0 THEN 'grand' ELSE 'subtotal' END"
    keys = ", ".join([*rows, *cols])
    out = []
    for name, agg in measures:
        out.append(
            f"SELECT {keys}, {kind(rows)} AS row_kind, {kind(cols)} AS col_kind, '{name}' AS measure, round(CAST({agg} AS DOUBLE), {digits}) AS value FROM {table} WHERE {where} GROUP BY GROUPING SETS ({sets})"
        )
    return " UNION ALL ".join(out)


_SPEC = V.PivotSpec(("l_returnflag",), ("l_linestatus",), (V.Value("l_quantity"),))
_REV = "(SELECT *, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem WHERE l_quantity > 5)"


@check(
    "flagship",
    f"""WITH p AS ({_sql([("Sum - revenue", "sum(revenue)")], _REV, digits=6)}), n AS (SELECT *, (SELECT value FROM p WHERE row_kind = 'grand' AND col_kind = 'grand') AS t FROM p)
SELECT l_returnflag, l_linestatus, row_kind, col_kind, measure, round(value / t, 6) AS value FROM n""",
)
def _(t):
    steps = (
        Steps(t.lineitem)
        .add("Filtered Rows", lambda d: T.filter_rows(d, "l_quantity", "gt", "5"))
        .add("Added Custom", lambda d: T.custom_column(d, "revenue", "l_extendedprice * (1 - l_discount)"))
    )
    spec = replace(_SPEC, values=(V.Value("revenue", show_as="percentOfTotal"),))
    return dec(V.compute(steps.run(), spec), 6)


@check(
    "v_basic",
    _sql([("Sum - l_quantity", "sum(l_quantity)"), ("Count - l_returnflag", "nullif(count(l_returnflag), 0)"), ("Average - l_quantity", "avg(l_quantity)"), ("Min - l_extendedprice", "min(l_extendedprice)"), ("Max - l_extendedprice", "max(l_extendedprice)")], digits=4),
)
def _(t):
    v = (V.Value("l_quantity"), V.Value("l_returnflag", "count"), V.Value("l_quantity", "average"), V.Value("l_extendedprice", "min"), V.Value("l_extendedprice", "max"))
    return dec(V.compute(t.lineitem, replace(_SPEC, values=v)), 4)


@check("v_grand", _sql([("Average - l_extendedprice", "avg(l_extendedprice)")]).replace("SELECT l_returnflag", "SELECT l_returnflag", 1))
def _(t):
    return dec(V.compute(t.lineitem, replace(_SPEC, values=(V.Value("l_extendedprice", "average"),))))


_NEST = ("o_orderstatus", "o_orderpriority")
_YEARS = "(SELECT *, CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q FROM orders)"


def dated(t):
    return t.orders.withColumns({"y": F.year("o_orderdate"), "q": F.quarter("o_orderdate")})


@check("v_subtotals", _sql([("Sum - o_totalprice", "sum(o_totalprice)")], _YEARS, _NEST, ("y", "q"), subtotals=True))
def _(t):
    return dec(V.compute(dated(t), V.PivotSpec(_NEST, ("y", "q"), (V.Value("o_totalprice"),), subtotals=True)))


@check("v_multi", _sql([("Sum - l_quantity", "sum(l_quantity)"), ("Max - l_tax", "max(l_tax)")]))
def _(t):
    return dec(V.compute(t.lineitem, replace(_SPEC, values=(V.Value("l_quantity"), V.Value("l_tax", "max")))))


@check("v_items", "SELECT DISTINCT CAST(p_size AS VARCHAR) AS label FROM part UNION ALL SELECT DISTINCT coalesce(nullif(p_brand, 'Brand#1'), '(empty)') FROM part")
def _(t):
    blank = t.part.withColumn("p_brand", F.expr("nullif(p_brand, 'Brand#1')"))
    return V.items(t.part, "p_size").union(V.items(blank, "p_brand"))


def _share(kind, cond):
    return f"""WITH p AS ({_sql([("Sum - l_quantity", "sum(l_quantity)")], digits=6)})
SELECT p.l_returnflag, p.l_linestatus, p.row_kind, p.col_kind, p.measure, round(coalesce(p.value / t.value, 0), 6) AS value FROM p JOIN p t ON {cond}"""


def _pct(mode):
    def run(t):
        return dec(V.compute(t.lineitem, replace(_SPEC, values=(V.Value("l_quantity", show_as=mode),))), 6)

    return run


check("v_pct_total", _share("t", "t.row_kind = 'grand' AND t.col_kind = 'grand'"))(_pct("percentOfTotal"))
check("v_pct_col", _share("c", "t.row_kind = 'grand' AND t.col_kind = p.col_kind AND t.l_linestatus IS NOT DISTINCT FROM p.l_linestatus"))(_pct("percentOfCol"))
check("v_pct_row", _share("r", "t.col_kind = 'grand' AND t.row_kind = p.row_kind AND t.l_returnflag IS NOT DISTINCT FROM p.l_returnflag"))(_pct("percentOfRow"))


@check(
    "v_running",
    f"""WITH p AS ({_sql([("Sum - o_totalprice", "sum(o_totalprice)")], _YEARS, _NEST, ("y",), digits=2)})
SELECT o_orderstatus, o_orderpriority, y, row_kind, col_kind, measure, round(sum(value) OVER (PARTITION BY y, col_kind ORDER BY o_orderstatus, o_orderpriority), 2) AS value FROM p WHERE row_kind = 'leaf'""",
)
def _(t):
    return dec(V.compute(dated(t), V.PivotSpec(_NEST, ("y",), (V.Value("o_totalprice", show_as="runningTotal"),))))


@check("v_calc_field", _sql([("Unit price", "sum(l_extendedprice) / nullif(sum(l_quantity), 0) - 2 ^ 2")], digits=4))
def _(t):
    return dec(V.compute(t.lineitem, replace(_SPEC, values=(V.Value(calc="l_extendedprice / 'l_quantity' - 2 ^ 2", name="Unit price"),))), 4)


@check(
    "v_calc_item",
    f"""WITH p AS ({_sql([("Sum - l_quantity", "sum(l_quantity)")])}), k AS (SELECT l_linestatus, col_kind, measure,
 max(value) FILTER (l_returnflag = 'A') AS a, max(value) FILTER (l_returnflag = 'R') AS r, max(value) FILTER (l_returnflag = 'N') AS n FROM p WHERE row_kind = 'leaf' GROUP BY 1, 2, 3)
SELECT * FROM p UNION ALL SELECT 'Mixed', l_linestatus, 'leaf', col_kind, measure, a + r FROM k UNION ALL SELECT 'Gap', l_linestatus, 'leaf', col_kind, measure, (a + r) - n * 2 FROM k""",
)
def _(t):
    made = (V.CalcItem("l_returnflag", "Gap", "Mixed - N * 2"), V.CalcItem("l_returnflag", "Mixed", "A + R"))
    return dec(V.compute(t.lineitem, replace(_SPEC, calc_items=made)))


@check(
    "v_crosstab",
    """WITH g AS (SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'Grand Total' WHEN grouping(o_orderpriority) = 1 THEN o_orderstatus || ' Total' ELSE o_orderstatus END AS o_orderstatus,
 coalesce(o_orderpriority, '') AS o_orderpriority, round(sum(o_totalprice) FILTER (y % 2 = 0), 2) AS "0", round(sum(o_totalprice) FILTER (y % 2 = 1), 2) AS "1", round(sum(o_totalprice), 2) AS "Grand Total"
 FROM (SELECT *, year(o_orderdate) AS y FROM orders) GROUP BY ROLLUP (o_orderstatus, o_orderpriority)) SELECT * FROM g""",
)
def _(t):
    d = t.orders.withColumn("odd", F.year("o_orderdate") % 2)
    wide = V.crosstab(d, V.PivotSpec(_NEST, ("odd",), (V.Value("o_totalprice"),), subtotals=True))
    return wide.withColumns({c: F.round(F.col(c), 2) for c in ("0", "1", "Grand Total")})


@check("v_chart", _sql([("Sum - l_quantity", "sum(l_quantity)")]).replace("GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())", "GROUPING SETS ((l_returnflag, l_linestatus))"))
def _(t):
    return dec(V.chart_data(t.lineitem, _SPEC))


@check("v_refresh", _sql([("Sum - l_quantity", "sum(l_quantity)")], where="l_returnflag IN ('A', 'R')"))
def _(t):
    stored = replace(_SPEC, slicers={"l_returnflag": ["A", "R"]}).to_json()
    return dec(V.compute(t.lineitem, V.PivotSpec.from_json(stored)))
