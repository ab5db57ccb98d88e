"""A text is split once, however many rows it has."""

from pyspark.sql import functions as F

from tabulon.checks import load
from tabulon.functions import text as X

QUERIES, _ = load()


def test_grid_is_split_once_per_text(spark):
    plan = QUERIES["f_textsplit"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 2  # into rows, and each row into cells


def test_ragged_rows_of_many_lines(spark, table):
    long = "\n".join("x," * (i % 5) + str(i) for i in range(20_000))
    d = table("k int, s string", (1, long), (2, None), (3, ""), (4, "a\n\nb,c"))
    got = {r["k"]: r["g"] for r in d.select("k", X.text_split(F.col("s"), ",", "\n").alias("g")).collect()}
    want = [["x"] * (i % 5) + [str(i)] + [None] * (4 - i % 5) for i in range(20_000)]
    assert got[1] == want and got[2] == got[3] == [[""]] and got[4] == [["a", None], ["", None], ["b", "c"]]
    kept = d.where("k = 4").select(X.text_split(F.col("s"), ",", "\n", ignore_empty=True)).first()[0]
    assert kept == [["a", None], ["b", "c"]]
