"""Small tables with known figures."""

import math

import pytest
from pyspark.sql import functions as F

from tabulon.functions import dates as D
from tabulon.functions import finance as N
from tabulon.functions import formats as FM
from tabulon.functions import logic as L
from tabulon.functions import text as X
from tabulon.functions.values import number_text
from tabulon.operators import aggregates as A
from tabulon.operators import cashflows as C
from tabulon.operators import filters as FI
from tabulon.operators import joins as J
from tabulon.operators import pivot as V
from tabulon.operators import quality as Q
from tabulon.operators import regression as R
from tabulon.operators import rules as H
from tabulon.operators import series as S
from tabulon.operators import shaping as O
from tabulon.operators import transforms as T
from tabulon.operators.criteria import matches
from tabulon.operators.formula import compile_formula
from tabulon.plans.steps import Steps, Workbook, column_quality


def one(df):
    return df.first()[0]


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


def value(spark, *columns):
    """Evaluate column expressions on one row."""
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


# --- pivots -------------------------------------------------------------------------------------------


@pytest.fixture
def sales(table):
    return table(
        "Region string, Product string, Sales double",
        ("North", "Apple", 100.0), ("North", "Banana", 50.0), ("South", "Apple", 70.0),
        ("South", "Banana", 30.0), ("North", "Apple", 40.0), ("South", "Banana", 60.0),
    )


def cells(df):
    return {(r.Region, r.Product, r.measure): r.value for r in df.collect()}


def test_pivot_totals(sales):
    spec = V.PivotSpec(("Region",), ("Product",), (V.Value("Sales"), V.Value("Sales", "count"), V.Value("Sales", "average"), V.Value("Sales", "min")))
    got = cells(V.compute(sales, spec))
    s = "Sum - Sales"
    assert got["North", "Apple", s] == 140 and got["South", "Banana", s] == 90
    assert got["North", None, s] == 190 and got[None, "Apple", s] == 210 and got[None, None, s] == 350
    assert got["North", None, "Count - Sales"] == 3 and got["North", None, "Min - Sales"] == 40
    assert got["North", None, "Average - Sales"] == pytest.approx(63.3333, abs=1e-4)


def test_pivot_percent_running_and_calculated(sales):
    spec = V.PivotSpec(
        ("Region",), ("Product",),
        (V.Value("Sales", show_as="percentOfTotal"), V.Value("Sales", "max", show_as="runningTotal"), V.Value(calc="Sales * 2", name="Double")),
        calc_items=(V.CalcItem("Region", "Both", "North + South"), V.CalcItem("Product", "Gap", "Apple - Banana")),
    )
    got = cells(V.compute(sales, spec))
    p = "Sum - Sales"
    assert got["North", None, p] == pytest.approx(190 / 350) and got["South", None, p] == pytest.approx(160 / 350)
    assert got["North", None, "Double"] == 380 and got["South", None, "Double"] == 320 and got[None, None, "Double"] == 700
    assert got["Both", None, "Double"] == 700 and got["North", "Gap", "Double"] == 180 and got["South", "Gap", "Double"] == -40
    run = V.compute(sales, V.PivotSpec(("Region",), (), (V.Value("Sales", show_as="runningTotal"),)))
    assert [r.value for r in run.orderBy("Region").collect()] == [190, 350]


def test_pivot_filters_and_crosstab(sales):
    page = V.compute(sales, V.PivotSpec(("Region",), (), (V.Value("Sales"),), pages={"Product": "Apple"}))
    assert {r.Region: r.value for r in page.collect()} == {"North": 140, "South": 70, None: 210}
    none = V.compute(sales, V.PivotSpec(("Region",), (), (V.Value("Sales"),), slicers={"Region": []}))
    assert [r.value for r in none.collect()] == [None]
    wide = V.crosstab(sales, V.PivotSpec(("Region",), ("Product",), (V.Value("Sales"),)))
    assert wide.columns == ["Region", "Apple", "Banana", "Grand Total"]
    assert rows(wide) == [("North", 140, 50, 190), ("South", 70, 90, 160), ("Grand Total", 210, 140, 350)]


def test_pivot_spec_round_trip_and_blank_items(table):
    spec = V.PivotSpec(("a",), (), (V.Value("b", "average"),), slicers={"a": ["x"]}, calc_items=(V.CalcItem("a", "n", "x"),))
    assert V.PivotSpec.from_json(spec.to_json()) == spec
    d = table("a string, b double", ("x", 1.0), (None, 2.0), ("", 3.0))
    assert [r.label for r in V.items(d, "a").collect()] == ["(empty)", "x"]


def test_formula_precedence(spark):
    v = {"Net sales": F.lit(10.0), "Cost": F.lit(4.0), "None": F.lit(None).cast("double")}
    f = lambda s: compile_formula(s, v)
    got = value(spark, f("Net sales - Cost * 2"), f("-2 ^ 2"), f("-(2 ^ 2)"), f("2 ^ 3 ^ 2"), f("'Net sales' / 0"), f("Cost + None"), f("(Cost + 1) * 2"))
    assert got == (2.0, 4.0, -4.0, 512.0, None, None, 10.0)
    with pytest.raises(ValueError):
        f("Cost + __import__")


# --- statistics and criteria --------------------------------------------------------------------------


@pytest.fixture
def numbers(table):
    return table("pos int, a int, b string, c int", (1, 3, "a", 44000), (2, 1, "b", 44001), (3, 4, "c", 44002), (4, 1, "b", 44003), (5, 5, "a", 44004))


def test_statistics(numbers):
    assert one(A.median(numbers, "a")) == 3 and one(A.mode(numbers, "a", ["pos"])) == 1
    sd = A.spread(numbers, "a").first()
    assert sd.stdev_s == pytest.approx(1.7888543819998) and sd.stdev_p == pytest.approx(1.6)
    assert sd.var_s == pytest.approx(3.2) and sd.var_p == pytest.approx(2.56)
    assert one(A.kth(numbers, "a", 2)) == 4 and one(A.kth(numbers, "a", 9)) is None and one(A.quartile(numbers, "a", 1)) == 1
    assert {r.a: r.rank for r in S.rank(numbers, "a").collect()}[4] == 2
    assert {r.a: r.rank for r in S.rank(numbers, "a", ascending=True).collect()}[4] == 4
    b = A.basic(numbers, "a").first()
    assert (b["sum"], b["average"], b["count"]) == (14, 2.8, 5)
    assert one(A.percentile(numbers, "a", 1.5)) is None and one(A.subtotal(numbers, 106, "a")) == 60


def test_mode_needs_a_repeat(table):
    assert one(A.mode(table("p int, v int", (1, 5), (2, 6)), "v", ["p"])) is None
    assert one(A.mode(table("p int, v int", (1, 7), (2, 6), (3, 6), (4, 7)), "v", ["p"])) == 7


def test_criteria_aggregates(numbers):
    d = numbers
    got = d.agg(
        A.sum_if(d, "a", [("a", ">1")]), A.count_if(d, [("a", ">1")]), A.average_if(d, "a", [("a", ">1")]), A.min_if(d, "a", [("a", ">1")]),
        A.sum_if(d, "a", [("b", "b"), ("a", "<4")]), A.max_if(d, "a", [("a", ">99")]), A.average_if(d, "a", [("a", ">99")]),
    ).first()
    assert tuple(got) == (12, 3, 4, 3, 2, 0, None)


def test_mixed_range_and_blanks(table):
    d = table("v string", ("1",), ("text",), ("3",), (None,), ("",))
    b = A.basic(d, "v").first()
    assert (b["sum"], b["average"], b["count"], b["counta"], b["min"], b["max"]) == (4, 2, 2, 3, 1, 3)
    assert d.agg(A.count_blank("v")).first()[0] == 2
    assert A.basic(d.where("false"), "v").first()["average"] is None


@pytest.mark.parametrize(
    "criterion,ifs,auto",
    [("=", {None, ""}, {None, ""}), ("<>", {"apple", "Apple pie", "5", "banana"}, {"apple", "Apple pie", "5", "banana"}),
     ("app*", {"apple", "Apple pie"}, {"apple", "Apple pie"}), ("<>app*", {"5", "banana", None, ""}, {"apple", "Apple pie", "5", "banana", None, ""}),
     (">4", {"5", "apple", "Apple pie", "banana"}, {"5", "apple", "Apple pie", "banana"}), (">B", {"banana"}, {"apple", "banana"}), ("?anana", {"banana"}, {"banana"})],
)
def test_criteria_dialects(table, criterion, ifs, auto):
    d = table("v string", ("apple",), ("Apple pie",), ("5",), ("banana",), (None,), ("",))
    assert {r.v for r in d.where(matches(d, "v", criterion)).collect()} == ifs
    assert {r.v for r in d.where(matches(d, "v", criterion, "autofilter")).collect()} == auto


# --- query steps --------------------------------------------------------------------------------------


@pytest.fixture
def products(table):
    return table("Product string, Qty int, Price double", ("Apples", 10, 2.0), ("Pears", 4, 3.0), ("Cherries", 20, 5.0))


def test_transforms(products):
    assert T.filter_rows(products, "Qty", "gt", "5").count() == 2 and T.filter_rows(products, "Product", "contains", "err").count() == 1
    assert T.sort_rows(products, "Qty", descending=True).first().Product == "Cherries"
    assert T.keep_top(products, 2, ["Qty"]).count() == 2 and T.keep_bottom(products, 1, ["Qty"]).first().Qty == 20 and T.remove_top(products, 1, ["Qty"]).count() == 2
    assert T.unpivot_others(products, ["Product"]).count() == 6
    assert T.group_by(products, "Product", [("count", None), ("sum", "Qty")]).columns == ["Product", "Count", "Sum of Qty"]
    assert T.transpose(products, ["Qty"]).count() == 3
    assert "Plums" in [r.Product for r in T.replace_values(products, "Product", "Pears", "Plums").collect()]
    with pytest.raises(ValueError):
        T.keep_top(products, 1, [])
    with pytest.raises(ValueError):
        T.remove_columns(products, "Nope")


def test_sales_query(products):
    q = (
        Steps(products)
        .add("Filtered Rows", lambda d: T.filter_rows(d, "Qty", "gt", "5"))
        .add("Renamed Columns", lambda d: T.rename_columns(d, {"Qty": "Quantity"}))
        .add("Added Custom", lambda d: T.custom_column(d, "Total", "Quantity * Price"))
        .add("Removed Columns", lambda d: T.remove_columns(d, "Price"))
        .add("Sorted Rows", lambda d: T.sort_rows(d, "Total", descending=True))
    )
    assert rows(q.run()) == [("Cherries", 20, 100.0), ("Apples", 10, 20.0)]
    assert q.upto("Renamed Columns").columns == ["Product", "Quantity", "Price"]
    twice = q.add("Sorted Rows", lambda d: d).add("Sorted Rows", lambda d: d)
    assert twice.names[-2:] == ["Sorted Rows 1", "Sorted Rows 2"]
    assert "Removed Columns" not in q.deleted("Removed Columns").names and q.renamed("Added Custom", "Total").names[2] == "Total"
    assert q.replaced("Filtered Rows", lambda d: d).run().count() == 3
    assert q.preview_note(1) == "2 rows, first 1 shown"
    book = Workbook({"Sales": q}).add("Big", Steps(q))
    assert book.run("Big").count() == 2 and list(book.renamed("Big", "Huge").deleted("Sales").queries) == ["Huge"]


def test_change_type_and_quality(table):
    d = table("v string, w string", ("1.5", "08:30"), ("x", "25:00"), (None, None))
    kept = T.change_type(d, "v", "number", flag="bad")
    assert rows(kept, "v", "bad") == [(1.5, False), (None, True), (None, False)]
    assert rows(T.change_type(d, "w", "time"), "w") == [(8.5 / 24,), (None,), (None,)]
    assert rows(column_quality(d, {"v": "number"})) == [("v", 1, 1, 1), ("w", 2, 1, 0)]
    split = T.split_column(table("s string", ('"a,b",c',), ("only",)), "s", ",", 2, quoted=True)
    assert rows(split) == [("a,b", "c"), ("only", None)]


def test_promote_headers_names(table):
    d = table("k int, a string, b string", (0, "Name", ""), (1, "x", "y"))
    assert T.promote_headers(d, ["k"]).columns == ["0", "Name", "Column3"]


# --- ranges, lookups, fills ---------------------------------------------------------------------------


def test_sorting(table):
    d = table("i int, name string, score int", (1, "Carol", 3), (2, "alice", 10), (3, "Bob", 7), (4, "", 1), (5, "item10", 0), (6, "item2", 0), (7, "12", 0))
    assert [r.name for r in O.sort_mixed(d, "name", ["i"]).collect()] == ["12", "alice", "Bob", "Carol", "item2", "item10", ""]
    assert [r.name for r in O.sort_multi(d.where("i < 5"), [("name", False)], ["i"]).collect()] == ["alice", "Carol", "Bob", ""]


def test_advanced_filter(table):
    d = table("Fruit string, Qty int", ("apple", 5), ("pear", 2), ("apple", 9))
    assert FI.advanced_filter(d, [{"fruit": "apple"}, {"Qty": ">4"}]).count() == 2
    assert rows(FI.advanced_filter(d, [{"Fruit": "apple", "Qty": ">6"}])) == [("apple", 9)]
    assert FI.advanced_filter(d.select("Fruit"), [], unique=True).count() == 2
    with pytest.raises(ValueError):
        FI.advanced_filter(d, [{"Nope": "1"}])


def test_text_to_columns(table):
    d = O.text_to_columns(table("s string", ("a,b;c",), ("d",)), "s", [",", ";"])
    assert rows(d) == [("a,b;c", "a", "b", "c"), ("d", "d", None, None)]
    for bad in ({"delimiters": []}, {"delimiters": [","], "fixed_width": True}):
        with pytest.raises(ValueError):
            O.text_to_columns(d, "s", **bad)


def test_array_shapes(table, spark):
    d = table("p int, v string", (1, "a"), (2, "b"), (3, "a"), (4, "c"), (5, "b"))
    assert [r.v for r in O.unique_rows(d, ["p"]).collect()] == ["a", "b", "c"]
    assert rows(O.sequence_grid(spark, 2, 3).orderBy("row"), "c1", "c2", "c3") == [(1, 2, 3), (4, 5, 6)]
    assert O.to_row(d, ["v"], ["p"]).first().value == ["a", "b", "a", "c", "b"]
    assert [r.v for r in O.filter_mask(d, F.col("p") % 2).orderBy("p").collect()] == ["a", "a", "b"]
    assert rows(O.wrap_rows(d, "v", 2, ["p"]).orderBy("row")) == [(0, "a", "b"), (1, "a", "c"), (2, "b", None)]
    assert O.choose_cols(d, [-1, 1]).columns == ["v", "p"]
    with pytest.raises(ValueError):
        O.to_row(d, ["v"], ["p"], max_cells=3)


def test_lookups(table, numbers):
    keys = table("v double", (3.5,), (0.5,), (4.0,))
    t = table("k double, r int, p int", (1.0, 10, 1), (3.0, 20, 2), (4.0, 30, 3), (4.0, 31, 4))
    got = lambda d: {r.v: r.r for r in d.collect()}
    assert got(J.asof(keys, "v", t, "k", ["r"], ["p"], ties="first")) == {3.5: 20, 0.5: None, 4.0: 30}
    assert got(J.lookup_sorted(keys, "v", t, "k", ["r"], ["p"])) == {3.5: 20, 0.5: None, 4.0: 31}
    assert got(J.asof(keys, "v", t, "k", ["r"], ["p"], direction="forward", ties="first")) == {3.5: 30, 0.5: 10, 4.0: 30}
    assert got(J.lookup_exact(keys, "v", t, "k", ["r"], ["p"], default=-1, last=True)) == {3.5: -1, 0.5: -1, 4.0: 31}
    assert {r.v: r.pos for r in J.match_position(keys, "v", t, "k", ["p"], 0).collect()} == {3.5: None, 0.5: None, 4.0: 3}
    names = table("n string, p int", ("Apple", 1), ("apricot", 2))
    assert rows(J.lookup_wildcard(names, "n", ["ap*t", "zz*"], ["p"], ["p"])) == [("ap*t", 2), ("zz*", None)]


@pytest.mark.parametrize("how", ["left", "right", "full", "inner", "left_anti", "right_anti"])
def test_merge_kinds_with_nulls(table, how):
    a = table("k int, x string", (1, "a"), (2, "b"), (None, "n"))
    b = table("k int, y string", (2, "B"), (3, "C"), (None, "N"))
    counts = {"left": 3, "right": 3, "full": 5, "inner": 1, "left_anti": 2, "right_anti": 2}
    assert J.merge(a, b, "k", "k", how).count() == counts[how]
    safe = {"left": 3, "right": 3, "full": 4, "inner": 2, "left_anti": 1, "right_anti": 1}
    assert J.merge(a, b, "k", "k", how, null_safe=True).count() == safe[how]


def test_nested_merge(table):
    a, b = table("k int", (1,), (2,)), table("k int, y string", (1, "p"), (1, "q"))
    d = J.expand_nested(J.merge_nested(a, b, "k", "k"), "Merged", ["y"], "B")
    assert sorted(rows(d), key=str) == [(1, "p"), (1, "q"), (2, None)]


@pytest.mark.parametrize(
    "source,count,backward,out",
    [((1, 2), 4, False, "3 4 5 6"), ((3, 5), 3, True, "1 -1 -3"), ((7,), 3, False, "7 7 7"), (("item1",), 3, False, "item2 item3 item4"), (("a", "b"), 5, False, "a b a b a"), ((1, 2, 4), 4, False, "1 2 4 1")],
)
def test_fill(table, source, count, backward, out):
    kind = "string" if isinstance(source[0], str) else "double"
    d = table(f"p int, v {kind}", *[(i, float(x) if kind == "double" else x) for i, x in enumerate(source)])
    got = S.fill_series(d, "v", ["p"], count, backward=backward).orderBy("n")
    assert " ".join(r.value for r in got.collect()) == out


def test_outline(table):
    d = table("i int, lvl int", (1, 0), (2, 1), (3, 2), (4, 2), (5, 0), (6, 1))
    got = sorted(rows(S.outline_groups(d, "lvl", ["i"])))
    assert got == [(1, 2, 4, 5, False), (1, 6, 6, 6, False), (2, 3, 4, 5, False)]


# --- rules and validation -----------------------------------------------------------------------------


def test_rules(table):
    d = table("A double, B double, C double", (5.0, 0.0, 10.0), (15.0, 50.0, 20.0), (15.0, 100.0, 40.0))
    assert d.where(H.cell_is(F.col("A"), "greaterThan", 10)).count() == 2
    stops = [H.Stop("min", color="#ffffff"), H.Stop("max", color="#0000ff")]
    s = H.stats_for(d, "B", *stops)
    assert [r[0] for r in d.orderBy("B").select(H.color_scale(s.v, s, stops)).collect()] == ["#ffffff", "#8080ff", "#0000ff"]
    c = H.stats_for(d, "C")
    assert [r[0] for r in d.orderBy("C").select(H.data_bar(c.v, c)).collect()] == [0, pytest.approx(1 / 3), 1]
    icons = [H.Stop("min"), H.Stop("percent", 33), H.Stop("percent", 67)]
    assert [r[0] for r in d.orderBy("B").select(H.icon_bucket(s.v, s, icons)).collect()] == [0, 1, 2]
    chained = H.apply_rules(d, "A", [H.Rule(2, "unique", style="u"), H.Rule(1, "duplicates", style="d")])
    assert [r.style for r in chained.orderBy("A", "B").collect()] == ["u", "d", "d"]


def test_time_periods(table):
    d = table("d string", ("2026-07-24",), ("2026-07-23",), ("2026-07-20",), ("2026-06-20",)).select(F.col("d").cast("date"))
    n = lambda p: d.where(H.time_period(F.col("d"), p, "2026-07-24")).count()
    assert (n("thisMonth"), n("today"), n("last7Days"), n("thisWeek"), n("lastMonth")) == (3, 1, 3, 3, 1)


def test_timeline_labels(table):
    b = table("a timestamp_ntz, z timestamp_ntz", (__import__("datetime").datetime(2024, 1, 1), __import__("datetime").datetime(2024, 5, 1)))
    labels = lambda level: [r.label for r in FI.timeline_periods(b, "a", "z", level).orderBy("start").collect()]
    assert labels("months") == ["Jan 24", "Feb 24", "Mar 24", "Apr 24", "May 24"] and labels("quarters") == ["Q1 2024", "Q2 2024"]
    assert labels("days")[29:33] == ["30/1", "31/1", "1/2", "2/2"] and labels("years") == ["2024"]


@pytest.mark.parametrize(
    "rule,cell,ok",
    [(dict(type="list", values=("Yes", "No")), "Maybe", False), (dict(type="list", values=("Yes", "No")), "Yes", True), (dict(type="whole", a=1, b=10), "5.5", False),
     (dict(type="whole", a=1, b=10), "11", False), (dict(type="whole", a=1, b=10), "abc", False), (dict(type="whole", a=1, b=10), "10", True),
     (dict(type="decimal", operator="greaterThanOrEqual", a=0), "-1", False), (dict(type="textLength", operator="lessThanOrEqual", a=3), "abcd", False),
     (dict(type="date", operator="greaterThanOrEqual", a=45000), "44000", False), (dict(type="whole", a=1, b=10), "", True), (dict(type="custom"), "x", True)],
)
def test_validation(table, rule, cell, ok):
    d = table("v string", (cell,))
    assert Q.validate(d, [Q.Validation("v", **rule)]).first().valid_v is ok


# --- functions ----------------------------------------------------------------------------------------


def test_dates(spark):
    s = F.lit
    got = value(
        spark, D.parse_date(s("8/7/2026"), "dmy"), D.parse_date(s("8/7/2026"), "mdy"), D.parse_date(s("25/12/2026"), "mdy"), D.parse_date(s("13:30")),
        D.parse_date(s("2026-02-30")), D.parse_date(s("2020-01-01 12:00")), D.parse_date(s("nope")), D.parse_date(s("24:00")),
    )
    day = lambda y, m, d: (__import__("datetime").date(y, m, d) - __import__("datetime").date(1899, 12, 30)).days
    assert got == (day(2026, 7, 8), day(2026, 8, 7), day(2026, 12, 25), 0.5625, None, 43831.5, None, None)
    iso = value(spark, D.serial_to_iso(s(43831.0)), D.serial_to_iso(s(61.0)), D.serial_to_iso(s(1.0)), D.serial_to_iso(s(43831.75)), D.serial_to_iso(s(-1.0)), D.serial_to_iso(s(3e6)))
    assert iso == ("2020-01-01", "1900-03-01", "1900-01-01", "2020-01-01T18:00:00", None, None)
    assert value(spark, D.duration_to_serial(s("PT13H30M5S")), D.duration_to_serial(s("PT")), D.serial_to_duration(s(-0.5))) == (pytest.approx(48605 / 86400), None, "-PT12H0M0S")


def test_text(spark):
    s = F.lit
    got = value(
        spark, X.substitute(s("a-b-c"), "-", "+", 2), X.substitute(s("abc"), "-", "+", 3), X.text_before(s("a-b-c"), "-", 2), X.text_after(s("a-b-c"), "-", -1), X.text_after(s("abc"), "-"),
        X.text_before(s("a--b"), "--"), X.search("B?D", s("abcde")), X.search("zz", s("abc")), X.value(s("1,250.5")), X.value(s("50%")), X.value(s("")), X.value(s("x")),
    )
    assert got == ("a-b+c", "abc", "a-b", "c", None, "a", 2, None, 1250.5, 0.5, 0, None)
    assert value(spark, X.text_split(s("a,b;c"), ",", ";"))[0] == [["a", "b"], ["c", None]]


def test_logic(spark):
    s = F.lit
    got = value(spark, L.switch(s(3), 1, "a", 2, "b"), L.switch(s(3), 1, "a", "z"), L.choose(s(2.9), "a", "b"), L.choose(s(3.0), "a", "b"), L.modulo(s(-7.0), s(3.0)), L.modulo(s(1.0), s(0.0)))
    assert got == (None, "z", "b", None, 2.0, None)
    assert value(spark, L.if_(s(None).cast("string"), "string", s(1), s(2)), L.if_(s("other"), "string", s(1), s(2)), L.if_(s(5), "integer", s(1), s(0))) == (2, None, 1)


def test_number_text(spark):
    got = value(spark, *[number_text(F.lit(x)) for x in (3.0, 0.1 + 0.2, 1 / 3, 1234567.25, -0.5, 1e-7, 2.5e20)])
    assert got == ("3", "0.3", "0.333333333333333", "1234567.25", "-0.5", "1e-7", "2.5e+20")
    assert value(spark, FM.format_value(F.lit(-1234.5), "currency", "en"), FM.format_value(F.lit(0.256), "percent")) == ("-$1,234.50", "25.60%")


def test_loans(spark):
    got = value(
        spark, N.pmt(0.01, 12, 1000), N.fv(0.01, 12, -100), N.pv(0.01, 12, -100), N.nper(0.01, -100, 1000), N.ipmt(0.01, 1, 12, 1000), N.ppmt(0.01, 1, 12, 1000), N.pmt(0, 10, 1000),
        N.rate(12, -100, 1000), N.sln(1000, 100, 5), N.syd(1000, 100, 5, 1), N.ddb(1000, 100, 5, 1), N.db(1000, 100, 5, 1), N.ddb(1000, 100, 5, 9), N.effect(0.1, 4), N.nominal(0.1, 0),
    )
    want = (-88.848789, 1268.250301, 1125.507747, 10.588644, -10, -78.848789, -100, 0.029229, 180, 300, 400, 369, None, 0.103812890625, None)
    for g, w in zip(got, want):
        assert g is None if w is None else g == pytest.approx(w, abs=1e-6)


def test_declining_balance_follows_the_book_value(spark):
    def book(cost, salvage, life, factor, upto):
        left, out = cost, []
        for _ in range(upto):
            d = min(left * factor / life, max(0, left - salvage))
            out.append(d)
            left -= d
        return out

    for cost, salvage, life, factor in ((1000, 100, 5, 2), (1000, 500, 4, 2), (1000, 0, 3, 1.5), (100, 200, 4, 2), (1000, 50, 2, 3), (1000, 10, 2, 2)):
        got = value(spark, *[N.ddb(cost, salvage, life, p, factor) for p in range(1, life + 1)])
        assert got == pytest.approx(book(cost, salvage, life, factor, life))


def test_cash_flows(table, numbers):
    d = table("p int, v double", (0, -100.0), (1, 40.0), (2, 40.0), (3, 40.0))
    assert one(C.irr(d, "v", "p")) == pytest.approx(0.0970102574, abs=1e-8)
    x = numbers.withColumn("d", F.date_add(F.lit("1899-12-30").cast("date"), F.col("c"))).withColumn("p", F.col("pos") - 1).withColumn("v", F.col("a").cast("double"))
    assert one(C.npv(x, "v", "p", 0.1)) == pytest.approx(10.346598, abs=1e-6)
    assert one(C.xnpv(x, "v", "d", 0.1, ["pos"])) == pytest.approx(13.991648, abs=1e-6)
    assert one(C.irr(x, "v", "p")) is None
    dated = table("p int, v double, d string", (0, -1000.0, "2020-01-01"), (1, 1100.0, "2020-12-31"))
    assert one(C.xirr(dated, "v", "d", ["p"])) == pytest.approx(0.1, abs=1e-8)
    assert one(C.mirr(d, "v", "p", 0.1, 0.12)) == pytest.approx((40 * (1.12**2 + 1.12 + 1) / 100) ** (1 / 3) - 1)


def test_fits(table):
    line = table("x double, y double", *[(float(i), 2.0 * i + 1) for i in range(5)])
    f = R.fit(line, "x", "y").first()
    assert f.coefficients[0] + 10 * f.coefficients[1] == pytest.approx(21) and f.r2 == pytest.approx(1)
    grow = table("x double, y double", *[(float(i), 3 * math.exp(0.5 * i)) for i in range(4)])
    e = R.fit(grow, "x", "y", "exp").first().coefficients
    assert e[0] * math.exp(4 * e[1]) == pytest.approx(3 * math.exp(2))
    bend = table("x double, y double", *[(float(i), float(i * i - i + 2)) for i in range(-2, 3)])
    p = R.fit(bend, "x", "y", "poly").first()
    assert p.coefficients == pytest.approx([2, -1, 1]) and p.r2 == pytest.approx(1)
    avg = S.moving_average(table("x int, y double", (0, 10.0), (1, 20.0), (2, 30.0), (3, 40.0)), "y", ["x"], 2)
    assert [(r.x, r.average) for r in avg.orderBy("x").collect()] == [(1, 15), (2, 25), (3, 35)]
    forced = R.fit(line, "x", "y", intercept=0).first()
    assert forced.coefficients == pytest.approx([0, sum(x * (2 * x + 1) for x in range(5)) / 30])


def test_find_and_replace(table):
    d = table("k int, s string", (1, "Red x red"), (2, "blue"))
    assert rows(FI.replace_all(d, ["s"], "RED", "$1\\"), "s") == [("$1\\ x $1\\",), ("blue",)]
    assert FI.find_first(d, "BLUE", ["k"], ["s"]).first().k == 2 and FI.find_all(d, "e", ["k"]).count() == 2
    assert FI.find_first(d, "BLUE", ["k"], ["s"], match_case=True).count() == 0
    with pytest.raises(ValueError):
        FI.special_cells(d, "blanks", ["k"], must_exist=True)
    with pytest.raises(ValueError):
        FI.select_span(d, "Nope")
