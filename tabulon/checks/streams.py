"""Streams (ST) over the events table, read as a file source and compared with their batch results."""

from pyspark.sql import Window as W, functions as F

from tabulon.checks.registry import check
from tabulon.plans.steps import Steps
from tabulon.operators import transforms as T
from tabulon.scale.storage import scratch_path
from tabulon.streaming import feeds as S


def arriving(t):
    schema = t.events.schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)


def _done(query):
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def changes(events):
    return events.select(
        F.col("event_type").alias("sheet"),
        F.col("user_id").alias("row"),
        (F.col("event_id") % 5).alias("col"),
        F.when(F.col("event_id") % 7 == 0, "").otherwise(F.col("event_id").cast("string")).alias("input"),
        "ts",
        F.col("event_id").alias("seq"),
    )


@check(
    "st_latest_cells",
    """SELECT event_type AS sheet, user_id AS row, event_id % 5 AS col, CAST(event_id AS VARCHAR) AS input, ts, event_id AS seq FROM events
QUALIFY row_number() OVER (PARTITION BY event_type, user_id, event_id % 5 ORDER BY ts DESC, event_id DESC) = 1 AND event_id % 7 <> 0""",
)
def _(t):
    log, checkpoint = scratch_path(t.spark, "cells"), scratch_path(t.spark, "progress")
    _done(S.follow_cells(changes(arriving(t)), log, checkpoint))
    return S.read_cells(t.spark, log)


@check("st_refresh", "SELECT event_id, user_id, value * 2 AS twice FROM events WHERE value > 20 AND event_type = 'click'")
def _(t):
    def steps(d):
        q = Steps(d).add("Filtered Rows", lambda x: T.filter_rows(x, "value", "gt", "20"))
        q = q.add("Filtered Rows", lambda x: T.filter_rows(x, "event_type", "eq", "click"))
        q = q.add("Added Custom", lambda x: T.custom_column(x, "twice", "value * 2"))
        return q.add("Chosen Columns", lambda x: T.choose_columns(x, "event_id", "user_id", "twice")).run()

    target, checkpoint = scratch_path(t.spark, "refresh"), scratch_path(t.spark, "progress")
    _done(S.follow_query(arriving(t), steps, target, checkpoint))
    return t.spark.read.parquet(target)


def in_arrivals(t, n):
    """The events as ``n`` files, by days, with every seventh row one arrival late; yields the folder after each arrival."""
    folder = scratch_path(t.spark, "arrivals")
    days = t.events.select(F.to_date("ts").alias("d")).distinct().select("d", F.ntile(n).over(W.orderBy("d")).alias("k"))
    late = (F.col("event_id") % 7 == 0).cast("int")
    dealt = t.events.withColumn("d", F.to_date("ts")).join(days, "d").withColumn("k", F.least(F.col("k") + late, F.lit(n))).drop("d")
    for k in range(1, n + 1):
        dealt.where(F.col("k") == k).drop("k").write.mode("append").parquet(folder)
        yield folder


def arrived(t, folder):
    return t.spark.readStream.schema(t.events.schema).parquet(folder)


@check(
    "st_refresh_groups",
    """SELECT event_type, user_id, count(*) AS "Count", sum(event_id)::BIGINT AS "Sum of event_id", avg(event_id) AS "Average of event_id", max(ts) AS "Max of ts", min(value) AS "Min of value"
FROM events WHERE value > 20 GROUP BY ALL""",
)
def _(t):
    """A filter and a group-by followed over three arrivals."""
    query = S.Grouping(
        lambda d: T.filter_rows(d, "value", "gt", "20"), ["event_type", "user_id"],
        [("count", None), ("sum", "event_id"), ("avg", "event_id"), ("max", "ts"), ("min", "value")],
    )
    target, checkpoint = scratch_path(t.spark, "groups"), scratch_path(t.spark, "progress")
    for folder in in_arrivals(t, 3):
        _done(query.follow(arrived(t, folder), target, checkpoint))
    return query.read(t.spark, target)


@check(
    "st_timeline",
    """SELECT 'days' AS level, date_trunc('day', ts)::TIMESTAMP AS start, day(ts) || '/' || month(ts) AS label, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL
UNION ALL SELECT 'months', date_trunc('month', ts)::TIMESTAMP, strftime(ts, '%b %y'), count(*), round(sum(value), 2) FROM events GROUP BY ALL""",
)
def _(t):
    """Day windows over two arrivals, late rows within the lateness; months are read from them."""
    target, checkpoint = scratch_path(t.spark, "totals"), scratch_path(t.spark, "progress")
    for folder in in_arrivals(t, 2):
        _done(S.follow_totals(S.timeline_totals(arrived(t, folder), "ts", "value", lateness="400 days"), target, checkpoint))
    out = None
    for level in ("days", "months"):
        one = S.read_totals(t.spark, target, level).select(F.lit(level).alias("level"), "start", "label", "n", F.round("total", 2).alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


@check("st_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    target, checkpoint = scratch_path(t.spark, "distinct"), scratch_path(t.spark, "progress")
    d = S.distinct_events(arriving(t), "ts", ["user_id", "event_type"], "400 days").select("user_id", "event_type")
    _done(S.follow_query(d, lambda x: x, target, checkpoint))
    return t.spark.read.parquet(target)
