"""Skewed and awkward inputs against brute force."""

import random

import pytest
from pyspark.sql import Window as W, functions as F

from tabulon.operators import aggregates as A
from tabulon.operators import cashflows as C
from tabulon.operators import joins as J
from tabulon.operators import series as S
from tabulon.operators import shaping as O
from tabulon.scale import counts, skew
from tabulon.scale.counts import quantiles
from tabulon.scale.ordering import row_index, running
from tabulon.scale.storage import clear_scratch, scratch_path, shared_dir


@pytest.fixture(scope="module")
def skewed(spark):
    """20,000 rows: one key holds half of them, some keys are null, values repeat."""
    rng = random.Random(5)
    rows = []
    for i in range(20_000):
        k = "hot" if rng.random() < 0.5 else None if rng.random() < 0.05 else f"k{rng.randrange(300)}"
        rows.append((i, k, rng.randrange(50), None if rng.random() < 0.1 else float(rng.randrange(200))))
    return spark.createDataFrame(rows, "id int, k string, o int, v double").repartition(4, "id").cache()


def test_row_index_is_gap_free(skewed):
    got = row_index(skewed, [F.col("o").desc(), "id"], "i", 1).select("id", "i").collect()
    want = sorted(skewed.select("o", "id").collect(), key=lambda r: (-r.o, r.id))
    assert {r.id: r.i for r in got} == {r.id: n for n, r in enumerate(want, 1)}


def test_running_matches_window(skewed):
    w = W.partitionBy("k").orderBy("o", "id").rowsBetween(W.unboundedPreceding, 0)
    plain = skewed.select("id", F.sum("v").over(w).alias("s"), F.last("v", True).over(w).alias("f"))
    mine = running(skewed, ["k"], ["o", "id"], sums={"s": F.col("v")}, fills={"f": F.col("v")}).select("id", "s", "f")
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, plain.collect()))


def test_quantiles_match_exact_percentile(skewed):
    ks = [0.0, 0.25, 0.5, 0.9, 1.0]
    want = {r.k: r.q for r in skewed.groupBy("k").agg(F.percentile("v", ks).alias("q")).collect()}
    got = {r.k: r.q for r in quantiles(skewed, F.col("v"), ks, ["k"]).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_hot_keys_are_found_and_bounded(skewed):
    hot = skew.hot_keys(skewed, ["k"])
    assert len(hot) == 1 and len(hot) <= 50
    assert skew.hot_keys(skewed, ["id"]) == []


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot_side", ["left", "right"])
def test_salted_join_equals_join(spark, skewed, how, hot_side):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = spark.createDataFrame([(f"k{i}", i) for i in range(0, 400, 3)] + [("hot", -1), ("hot", -2), (None, 0)], "k string, w int")
        a, b = (skewed.select("k", "id"), few) if hot_side == "left" else (few, skewed.select("k", "id"))
        hot = {"hot": skew.hot_keys(a, ["k"]), "hot_right": skew.hot_keys(b, ["k"])}
        assert "_salt" not in skew.salted_join(a, b, ["k"], how)._jdf.queryExecution().analyzed().toString()
        got = skew.salted_join(a, b, ["k"], how, **hot)
        assert sorted(map(str, got.collect())) == sorted(map(str, a.join(b, ["k"], how).select(*got.columns).collect()))
        assert hot_side == "right" and how != "inner" and how != "left" or "_salt" in got._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_attach_keeps_every_row(skewed):
    per = skewed.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = skew.attach(skewed, per, ["k"])
    assert got.count() == 20_000 and got.where("k is null").first().n == skewed.where("k is null").count()


@pytest.mark.parametrize("direction,ties", [("backward", "last"), ("backward", "first"), ("forward", "first")])
def test_asof_matches_brute_force(spark, skewed, direction, ties):
    left = skewed.where("id % 10 = 0").select("id", "k", F.col("v").alias("t"))
    right = skewed.where("id % 7 = 0").select("k", F.col("v").alias("u"), F.col("id").alias("r"))
    got = {x.id: x.r for x in J.asof(left, "t", right, "u", ["r"], ["r"], by=["k"], direction=direction, ties=ties).collect()}
    pool: dict = {}
    for x in right.collect():
        if x.u is not None:
            pool.setdefault(x.k, []).append((x.u, x.r))
    for x in left.collect():
        near = [p for p in pool.get(x.k, []) if x.t is not None and (p[0] <= x.t if direction == "backward" else p[0] >= x.t)]
        best = (max if direction == "backward" else min)((p[0] for p in near), default=None)
        tied = [r for u, r in near if u == best]
        assert got[x.id] == (None if not tied else max(tied) if ties == "last" else min(tied))


def test_rank_duplicates_and_first_rows(skewed):
    w = W.partitionBy("k").orderBy(F.col("v").desc())
    want = {r.id: r.x for r in skewed.where("v is not null").withColumn("x", F.rank().over(w)).collect()}
    got = {r.id: r.rank for r in S.rank(skewed, "v", ["k"]).where("v is not null").collect()}
    assert got == want
    first = O.dedupe_first(skewed, ["k", "o"], ["id"])
    assert "WindowGroupLimit" in first._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in first.collect()) == sorted(r.m for r in skewed.groupBy("k", "o").agg(F.min("id").alias("m")).collect())


def test_moving_average_crosses_chunks(skewed):
    from tabulon.scale import ordering

    rows = ordering.with_neighbours(skewed, ["id"], 4, chunk_rows=64)
    assert rows.where("_own").count() == 20_000 and rows.where("NOT _own").count() == 4 * (20_000 // 64)
    want = skewed.where("v is not null").withColumn("a", F.avg("v").over(W.partitionBy("k").orderBy("id").rowsBetween(-4, 0)))
    want = {r.id: r.a for r in want.collect()}
    got = {r.id: r.average for r in S.moving_average(skewed, "v", ["id"], 5, ["k"]).collect()}
    assert len(got) > 19_000 * 0.8 and all(want[i] == pytest.approx(a) for i, a in got.items())


def test_text_join_keeps_order(skewed):
    got = {r.k: r.value for r in A.text_join(skewed.withColumn("x", F.col("id").cast("string")), "x", ",", ["o", "id"], ["k"]).collect()}
    want: dict = {}
    for r in sorted(skewed.collect(), key=lambda r: (r.o, r.id)):
        want.setdefault(r.k, []).append(str(r.id))
    assert got == {k: ",".join(v) for k, v in want.items()}


def test_deep_kth(skewed):
    got = A.kth(skewed, "v", 5000).first().value
    assert got == sorted((r.v for r in skewed.where("v is not null").collect()), reverse=True)[4999]


def test_rates_of_a_long_series(spark):
    flows = spark.range(3000).select(F.lit("a").alias("k"), F.col("id").alias("p"), F.when(F.col("id") == 0, -100.0).otherwise(2.0).alias("v"))
    flows = flows.unionByName(spark.createDataFrame([("b", 0, -1.0), ("b", 1, 3.0), ("c", 0, 5.0), ("c", 1, 5.0)], "k string, p bigint, v double"))
    got = {r.k: r.irr for r in C.irr(flows, "v", "p", ["k"]).collect()}
    assert got["a"] == pytest.approx(0.02, abs=1e-9) and got["b"] == pytest.approx(2.0, abs=1e-8) and got["c"] is None


def test_scratch_lives_in_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(shared_dir(spark)) and spark.conf.get("spark.checkpoint.dir").rstrip("/") == shared_dir(spark)
    clear_scratch(spark)


@pytest.mark.parametrize("margin,accuracy,window", [(None, None, None), (0.0, 1, None), (0.2, 20, 3)])
def test_exact_values_at_ranks(spark, monkeypatch, margin, accuracy, window):
    for name, given in (("_MARGIN", margin), ("_ACCURACY", accuracy), ("_WINDOW_ROWS", window)):
        if given is not None:
            monkeypatch.setattr(counts, name, given)  # brackets that miss, and brackets too wide for a window
    rng = random.Random(5)
    groups = {None: [1.5], "one": [3.0] * 40, "few": [2.0, 1.0], "many": [float(rng.randrange(-500, 500)) for _ in range(3000)], "none": [None, None]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(7)
    ks = [0.0, 0.1, 0.5, 0.95, 1.0]

    def want(values):
        values = sorted(values)
        at = [k * (len(values) - 1) for k in ks]
        return [values[int(a)] + (values[-int(-a // 1)] - values[int(a)]) * (a - int(a)) for a in at]

    got = {r["g"]: (r["n"], r["q"]) for r in counts.quantiles(df, F.col("v"), ks, ["g"]).collect()}
    assert set(got) == {None, "one", "few", "many"}
    for g, (n, q) in got.items():
        assert n == len(groups[g]) and q == pytest.approx(want(groups[g]))
    every = [v for vs in groups.values() for v in vs if v is not None]
    r = counts.quantiles(df, F.col("v"), ks).first()
    assert r["n"] == len(every) and r["q"] == pytest.approx(want(every))
    assert counts.quantiles(df.limit(0), F.col("v"), ks).first()["n"] is None
    assert counts.quantiles(df.limit(0), F.col("v"), ks, ["g"]).count() == 0
