"""Streams over several triggers, and loads under a reader."""

import pytest
from pyspark.sql import functions as F

from tabulon.operators import transforms as T
from tabulon.sources import sinks as K
from tabulon.streaming import feeds as S
from tabulon.streaming.levels import BATCH, FAN, Levels


def done(query):
    query.awaitTermination()
    assert query.exception() is None


@pytest.fixture
def arrivals(spark, tmp_path):
    """``send(rows)`` adds a file, ``stream()`` follows the folder."""
    folder, schema = str(tmp_path / "in"), "id long, k string, ts timestamp_ntz, v long"

    def send(*rows):
        cells = [(i, k, v, ts) for i, k, ts, v in rows]
        df = spark.createDataFrame(cells, "id long, k string, v long, t string")
        df.select("id", "k", F.col("t").cast("timestamp_ntz").alias("ts"), "v").coalesce(1).write.mode("append").parquet(folder)

    return send, lambda: spark.readStream.schema(schema).parquet(folder), folder


def test_a_hundred_batches_leave_a_few_folders(spark, tmp_path):
    log = Levels(spark, str(tmp_path / "log"), lambda d: d.groupBy("k").agg(F.sum("v").alias("v")).withColumn(BATCH, F.lit(0).cast("long")))
    assert log.read() is None
    for b in range(40):
        assert log.append(spark.range(1).select((F.lit(b) % 3).alias("k"), F.lit(b).alias("v")), b)
    assert not log.append(spark.range(1).select(F.lit(0).alias("k"), F.lit(9).alias("v")), 39)  # sent again
    _, parts = log.manifest()
    assert len(parts) <= FAN * 3 and {r["k"]: r["v"] for r in log.read().collect()} == {k: sum(range(k, 40, 3)) for k in range(3)}
    assert len(log._names("data")) <= 2 * len(parts) + FAN and len(log._names("manifest")) == 2


def test_a_failure_before_the_swap_loses_nothing(spark, tmp_path, monkeypatch):
    log = Levels(spark, str(tmp_path / "log"), lambda d: d)
    one = spark.range(2).select(F.col("id").alias("v"))
    log.append(one, 0)
    commit = Levels._commit
    monkeypatch.setattr(Levels, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        log.append(one, 1)
    assert log.read().count() == 2
    monkeypatch.setattr(Levels, "_commit", commit)
    assert log.append(one, 1) and log.read().count() == 4
    assert log.append(one, 2) and len(log._names("data")) == 3  # what the failed job had left is gone


def test_grouped_query_over_three_arrivals(spark, arrivals, tmp_path):
    send, stream, folder = arrivals
    query = S.Grouping(lambda d: T.filter_rows(d, "v", "gt", "0"), ["k"], [("count", None), ("sum", "v"), ("avg", "v"), ("max", "v"), ("min", "ts")])
    for rows in ([(1, "a", "2024-01-01", 5), (2, None, "2024-01-02", 1)], [(3, "a", "2023-12-01", 7), (4, "b", "2024-01-01", -1)], [(5, "b", "2024-02-01", 2), (6, "a", "2024-01-01", None)]):
        send(*rows)
        done(query.follow(stream(), str(tmp_path / "out"), str(tmp_path / "cp")))
        want = query.run(spark.read.parquet(folder))
        got = query.read(spark, str(tmp_path / "out"))
        assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_windows_expire_and_late_rows_merge(spark, arrivals, tmp_path):
    send, stream, _ = arrivals
    follow = lambda: S.follow_totals(S.timeline_totals(stream(), "ts", "v", lateness="2 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    held = []
    for day in range(1, 13):
        send((day, "a", f"2024-03-{day:02d} 10:00:00", day), (day, "a", f"2024-03-{max(1, day - 1):02d} 09:00:00", 100))
        query = follow()
        done(query)
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert max(held) <= 5  # as many windows as the lateness spans, however long the stream runs
    got = {r["label"]: (r["n"], r["total"]) for r in S.read_totals(spark, str(tmp_path / "out")).collect()}
    assert got == {"1/3": (3, 201)} | {f"{d}/3": (2, d + 100) for d in range(2, 12)} | {"12/3": (1, 12)}
    month = S.read_totals(spark, str(tmp_path / "out"), "months").collect()
    assert [(r["label"], r["n"], r["total"]) for r in month] == [("Mar 24", 24, 1278)]


def test_cells_over_several_batches(spark, arrivals, tmp_path):
    send, stream, _ = arrivals
    for rows in ([(1, "s", "2024-01-02", 1)], [(2, "s", "2024-01-01", 2), (3, "t", "2024-01-01", 0)], [(4, "t", "2024-01-01", None)]):
        send(*rows)
        cells = stream().select(F.col("k").alias("sheet"), F.lit(1).alias("row"), F.lit(1).alias("col"), F.col("v").cast("string").alias("input"), "ts", F.col("id").alias("seq"))
        done(S.follow_cells(cells, str(tmp_path / "log"), str(tmp_path / "cp")))
    assert [(r["sheet"], r["input"]) for r in S.read_cells(spark, str(tmp_path / "log")).collect()] == [("s", "1")]


def test_any_query_is_refreshed_when_data_arrives(spark, arrivals, tmp_path):
    send, stream, folder = arrivals
    median = lambda: spark.read.parquet(folder).agg(F.median("v").alias("m"))
    for value, want in ((4, 4.0), (8, 6.0)):
        send((value, "a", "2024-01-01", value))
        done(S.follow_reload(stream(), median, "Arrived median", str(tmp_path / "cp")))
        assert spark.table("Arrived_median").first()["m"] == want


def test_readers_keep_a_whole_table_through_loads(spark, table):
    K.load_table(table("a int", (1,), (2,)), "Swapped")
    reader = spark.table("Swapped")
    K.load_table(table("b string, c int", ("x", 1)), "Swapped")
    assert [r["a"] for r in reader.orderBy("a").collect()] == [1, 2]  # began before the swap
    assert spark.table("Swapped").columns == ["b", "c"] and spark.table("Swapped").count() == 1
    table("z int", (1,)).write.mode("overwrite").saveAsTable("Stored")
    assert K.load_table(table("a int", (5,)), "Stored") == 1 and spark.table("Stored").first()["a"] == 5
