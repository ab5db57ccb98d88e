"""Inputs that shared tables do not hold: ties, blank lines, long repeats, far roots, other alphabets."""

import io
import random
import re
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabulon.functions import dates, finance, text
from tabulon.operators import aggregates as A, cashflows as C, joins as J, series, shaping as S, transforms as T
from tabulon.operators.criteria import matches
from tabulon.sources import delimited as D, workbooks as W


@pytest.mark.parametrize("n", [0, 1, 2, 3, 100_000, 100_001])
def test_skipping_rows_with_ties_and_nulls(table, n):
    for keys in ((1, 1, 2), (None, 1, 2), (None, None, 1)):
        d = table("o int, v int", *[(k, i) for i, k in enumerate(keys)])
        left = max(0, 3 - n)
        assert T.remove_top(d, n, ["o"]).count() == left and S.drop_rows(d, n, ["o"]).count() == left
        assert S.drop_rows(d, -n, ["o"]).count() == left
        assert T.keep_top(d, n, ["o"]).count() == min(n, 3)


def test_csv_keeps_blanks_line_breaks_and_wide_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n\n"x\ny, z",2\n"say ""so""",3\n\nlast, padded \n')
    got = [tuple(r) for r in D.read_delimited(spark, str(tmp_path / "a.csv"), ",").collect()]
    assert got == [("a", "b"), (None, None), ("x\ny, z", "2"), ('say "so"', "3"), (None, None), ("last", " padded ")]
    (tmp_path / "b.csv").write_text("a;b\r\n\r\nc;d\r\n")
    assert [tuple(r) for r in D.read_delimited(spark, str(tmp_path / "b.csv")).collect()] == [("a", "b"), (None, None), ("c", "d")]
    (tmp_path / "wide.csv").write_text('"q,"' + ",1" * 17_000 + "\n")
    width, spans = D._shape(spark, str(tmp_path / "wide.csv"), ",")
    assert (width, spans) == (17_001, False)


def test_csv_document_with_line_breaks_and_long_rows(spark, tmp_path):
    (tmp_path / "d.csv").write_text('name,n\n"two\nlines",1\nlong,2,extra\n')
    d = D.read_csv_document(spark, str(tmp_path / "d.csv"))
    assert [tuple(r) for r in d.collect()] == [("two\nlines", "1", None), ("long", "2", "extra")] and d.columns[:2] == ["name", "n"]


def test_csv_round_trip_of_padded_values(spark, table, tmp_path):
    d = table("a string, b string", ("  lead", "trail  "), (" y ", None))
    D.write_delimited(d, str(tmp_path / "out"))
    assert sorted(map(tuple, D.read_delimited(spark, str(tmp_path / "out"), ",").collect())) == [("  lead", "trail  "), (" y ", None)]


def _ods(rows: int, cols: int) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(
            "content.xml",
            '<o:document xmlns:o="o" xmlns:t="t" xmlns:x="x"><t:table t:name="S">'
            f'<t:table-row t:number-rows-repeated="{rows}"><t:table-cell t:number-columns-repeated="{cols}" o:value-type="string"><x:p>v</x:p></t:table-cell></t:table-row>'
            '<t:table-row><t:table-cell o:value-type="float" o:value="7"><x:p>7</x:p></t:table-cell></t:table-row></t:table></o:document>',
        )
    return out.getvalue()


def test_repeated_workbook_rows_and_cells_from_real_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.ods").write_bytes(_ods(3000, 2))
    (tmp_path / "b.ods").write_bytes(_ods(2, 3000))
    (tmp_path / "no.txt").write_text("x")
    cells = W.workbook_cells(W.workbook_files(spark, str(tmp_path)))
    got = {r["f"]: (r["n"], r["r"], r["c"]) for r in cells.groupBy(F.regexp_extract("path", r"([^/]*)$", 1).alias("f")).agg(F.count("*").alias("n"), F.max("row").alias("r"), F.max("col").alias("c")).collect()}
    assert got == {"a.ods": (6001, 3001, 2), "b.ods": (6001, 3, 3000)}


@pytest.mark.parametrize("root", [-0.5, 0.0, 0.1, 3.0, 20.0, 500.0])
def test_irr_of_near_and_far_roots(table, root):
    d = table("g int, t int, v double", (1, 0, -1.0), (1, 1, 1.0 + root), (2, 0, -100.0), (2, 1, 40.0), (2, 2, 40.0), (2, 3, 40.0))
    got = {r["g"]: r["irr"] for r in C.irr(d, "v", "t", ["g"]).collect()}
    assert got[1] == pytest.approx(root, abs=1e-7, rel=1e-7) and got[2] == pytest.approx(0.0970102, abs=1e-6)


@pytest.mark.parametrize("rate", [-0.3, -0.01, 0.0, 0.004, 0.029229, 0.3, 5.0, 30.0])
def test_rate_solves_its_own_payments(table, rate):
    growth = (1 + rate) ** 12
    annuity = 12.0 if rate == 0 else (growth - 1) / rate
    for due in (0, 1):
        pay = -(1000 * growth) / (annuity * (1 + rate * due))
        got = table("pay double", (pay,)).select(finance.rate(12, F.col("pay"), 1000, 0, due).alias("r")).first()[0]
        assert got == pytest.approx(rate, abs=1e-7, rel=1e-6)


def test_rate_without_a_solution(table):
    assert table("x double", (1.0,)).select(finance.rate(12, F.col("x"), 1000).alias("r")).first()[0] is None
    assert table("x double", (None,)).select(finance.rate(12, F.col("x"), 1000).alias("r")).first()[0] is None


def test_text_match_ignores_case_and_takes_wildcards(table):
    vector = table("v string, i int", ("Banana", 1), ("apple", 2), ("Apricot", 3), ("Été", 4), ("50%_x", 5), (None, 6), ("APPLE", 7), ("long name here", 8))
    keys = ["APPLE", "ap*", "a?ricot", "été", "É*", "*an*", "50%*", "5_%*", "zz*", "none", None, "", "*", "long nam*", "long name h?re"]
    got = J.match_position(table("k string", *[(k,) for k in keys]), "k", vector, "v", ["i"], 0)
    assert {r["k"]: r["pos"] for r in got.collect()} == {"APPLE": 2, "ap*": 2, "a?ricot": 3, "été": 4, "É*": 4, "*an*": 1, "50%*": 5, "5_%*": None, "zz*": None, "none": None, None: None, "": None, "*": 1, "long nam*": 8, "long name h?re": 8}
    found = J.lookup_wildcard(vector, "v", ["éT*", "AP*T"], ["i"], ["i"]).collect()
    assert {r["pattern"]: r["i"] for r in found} == {"éT*": 4, "AP*T": 3}


def test_criteria_fold_every_alphabet(table):
    d = table("v string", ("Été",), ("été\nx",), ("ДОМ",), ("ete",))
    count = lambda c: d.where(matches(d, "v", c)).count()
    assert [count("été"), count("éT*"), count("дом"), count("<>été"), count("e?e")] == [1, 2, 1, 3, 1]


@pytest.mark.parametrize("kind,rows", [("left", 3), ("right", 2), ("full", 4), ("inner", 1), ("left_anti", 2), ("right_anti", 1)])
def test_merge_starts_no_job_and_keeps_odd_names(spark, table, kind, rows):
    a, b = table("`k.1` int, `a·b` string, l0 int", (1, "x", 0), (2, "y", 0), (None, "z", 0)), table("k int, `x y` int", (1, 5), (9, 6))
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    merged = J.merge(a, b, "k.1", "k", kind, "O")
    assert len(tracker.getJobIdsForGroup(None)) == before
    names = ["k.1", "a·b", "l0"] + (["O.k", "O.x y"] if kind != "left_anti" else [])
    assert merged.columns == names and merged.count() == rows


def test_substitute_of_a_late_instance(table):
    d = table("s string", ("ab" * 60,), ("ab",), ("aaaa",), (None,))
    got = [r[0] for r in d.select(text.substitute(F.col("s"), "ab", "-", 50).alias("x")).collect()]
    assert got == ["ab" * 49 + "-" + "ab" * 10, "ab", "aaaa", ""]
    assert d.where("s = 'aaaa'").select(text.substitute(F.col("s"), "aa", "-", 3)).first()[0] == "aa-"


@pytest.mark.parametrize(
    "typed,order,serial",
    [
        ("25/12/2026", "mdy", 46381), ("12/25/2026", "dmy", 46381), ("8/7/2026", "dmy", 46211), ("8/7/2026", "mdy", 46241), ("2026-12-25", "mdy", 46381),
        ("2026/12/25T06:00", "mdy", 46381.25), ("25.12.2026 6:00:00", "dmy", 46381.25), ("13:30", "mdy", 0.5625), ("1:05:09", "mdy", 3909 / 86400),
        ("2026-02-30", "mdy", None), ("25-12-2026", "dmy", None), ("2026.12.25", "mdy", None), ("2026-12/25", "mdy", None), ("25/12/26", "dmy", None),
        ("24:00", "mdy", None), ("1:5", "mdy", None), ("2026-12-25 6", "mdy", None), ("x", "mdy", None), ("", "mdy", None), ("2026-12-25T25:00", "mdy", None),
    ],
)
def test_typed_dates(table, typed, order, serial):
    got = table("s string", (typed,)).select(dates.parse_date(F.col("s"), order)).first()[0]
    assert got == (pytest.approx(serial) if serial is not None else None)


def test_patterns_from_a_table_against_every_text(spark):
    rng = random.Random(11)
    letters = ["a", "b", "ab", "x%", "_", "\\", "É", "ß", "\x02\x02", "\n", ""]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(6))) for _ in range(150)] + [None]
    wild = ["".join(rng.choice([*letters, "*", "?", "*", "?"]) for _ in range(rng.randrange(5))) for _ in range(200)]
    wild += ["*", "**", "?", "??", "?*", "*x*", "*ab*", "a*b", "", "*\x02\x02*", "?????????????*", None, "*", "zzz*"]
    table = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "i int, v string, _hit string")
    patterns = spark.createDataFrame([(p,) for p in wild], "pattern string")
    got = Counter((r["pattern"], r["i"], r["v"]) for r in J.lookup_wildcard(table, "v", patterns, ["i", "v"], ["i"]).collect())

    def first(pattern):
        if pattern is None:
            return None, None
        rx = re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern.lower()), re.S)
        return next(((i, t) for i, t in enumerate(texts) if t is not None and rx.fullmatch(t.lower())), (None, None))

    assert got == Counter((p, *first(p)) for p in wild)
    assert J.lookup_wildcard(table.limit(0), "v", ["a*", "*"], ["i"], ["i"]).count() == 2
    assert J.lookup_wildcard(table, "v", [], ["i"], ["i"]).count() == 0


def test_asof_over_many_ranges_and_key_types(spark, table):
    rng = random.Random(2)
    left = [(i, rng.choice([None, "g", "h"]), rng.choice([None, 7, *range(-40, 40)])) for i in range(500)]
    right = [(p, rng.choice([None, "g"]), rng.choice([None, *range(-60, 60, 3)])) for p in range(120)]
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        for cast in ("int", "double", "decimal(10,2)", "timestamp", "date", "string"):
            make = lambda c: F.lpad((F.col(c) + 100).cast("string"), 4, "0") if cast == "string" else F.date_add(F.lit("2020-01-01"), F.col(c)).cast(cast) if cast in ("timestamp", "date") else F.col(c).cast(cast)
            a = spark.createDataFrame(left, "i int, k string, t int").select("i", "k", make("t").alias("t"))
            b = spark.createDataFrame(right, "p int, k string, u int").select("p", "k", make("u").alias("u"))
            for direction in ("backward", "forward"):
                got = {r["i"]: r["p"] for r in J.asof(a, "t", b, "u", ["p"], ["p"], by=["k"], direction=direction).collect()}
                sign = 1 if direction == "backward" else -1
                for i, k, t in left:
                    near = [(sign * u, p) for p, g, u in right if g == k and u is not None and t is not None and sign * u <= sign * t]
                    assert got[i] == (max(near)[1] if near else None)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("tail", ["7", "007", "0", "99", "999999999999999999", "9999999999999999999", "12345678901234567890123", "9" * 30, "9" * 45, "1" + "0" * 44, "12" + "0" * 31, "5" * 60])
def test_fill_counts_on_digits_of_any_length(table, tail):
    for backward, sign in ((False, 1), (True, -1)):
        rows_ = series.fill_series(table("p int, v string", (1, f"a {tail}")), "v", ["p"], 3, backward=backward).orderBy("n").collect()
        want = [f"a {int(tail) + sign * (n + 1)}" for n in range(3)]
        assert [r["value"] for r in rows_] == want


def test_fill_wants_every_step_within_the_tolerance(table):
    drifting = [i * (1 + 0.5e-9) for i in range(8)]  # each step is the first one
    wobbly = [0.0, 1.0, 2.0 + 0.9e-9, 3.0 + 1.8e-9 + 1.5e-9]
    for values, linear in ((drifting, True), (wobbly, False)):
        d = table("p int, v double", *enumerate(values))
        got = series.fill_series(d, "v", ["p"], 2).orderBy("n").collect()
        assert (float(got[0]["value"]) > values[-1]) == linear


def test_rates_of_long_groups_as_of_short_ones(spark, monkeypatch):
    rng = random.Random(9)
    flows = [(g, t, -100.0 if t == 0 else rng.uniform(-2, 12)) for g in range(6) for t in range(20 + g)] + [(9, 0, 5.0), (9, 1, 6.0)]
    df = spark.createDataFrame(flows, "g int, t int, v double")
    listed = {r["g"]: r["irr"] for r in C.irr(df, "v", "t", ["g"]).collect()}
    monkeypatch.setattr(C, "_LISTED", 22)
    mixed = {r["g"]: r["irr"] for r in C.irr(df, "v", "t", ["g"]).collect()}
    assert set(listed) == set(mixed) == {*range(6), 9} and listed[9] is mixed[9] is None
    assert all(listed[g] == pytest.approx(mixed[g], abs=1e-9) for g in range(6))


def test_natural_order_by_collation(spark):
    want = ["7", "30", "äpfel 2", "Apfel 3", "apfel 10", "Äpfel 10 b", "café", "cafe9", "Cafe 9x", "zoo", "école", "ß1", "", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(want)], "i int, v string")
    got = lambda **k: [r["v"] for r in shaping_sort(df, **k).collect()]
    folded = got(collation="UNICODE_CI_AI")
    assert folded[:2] == ["7", "30"] and set(folded[-2:]) == {"", None}
    names = [v for v in folded if v and not v.isdigit()]
    assert names.index("äpfel 2") < names.index("Apfel 3") < names.index("apfel 10") < names.index("Äpfel 10 b") < names.index("café") < names.index("école") < names.index("zoo")
    plain = [v for v in got() if v and not v.isdigit()]
    assert plain.index("zoo") < plain.index("école")  # by code point
    pairs = spark.createDataFrame([(1, "b"), (2, "A"), (3, "a"), (4, "B")], "i int, v string")
    assert [r["v"] for r in shaping_sort(pairs, collation="UNICODE").collect()] == ["a", "A", "b", "B"]


def shaping_sort(df, **settings):
    return S.sort_mixed(df, "v", ["i"], **settings)
