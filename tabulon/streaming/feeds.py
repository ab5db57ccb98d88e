"""Change feeds and refresh loops as streams (ST01-ST04).

Every job runs over whatever has arrived (``availableNow``) and resumes from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulon.operators.filters import period_label
from tabulon.operators.transforms import GROUP_LABEL, group_by
from tabulon.sources.sinks import load_table
from tabulon.streaming.levels import BATCH, Levels

CELL = ["sheet", "row", "col"]


def latest_cells(changes: DataFrame, keep_cleared: bool = False) -> DataFrame:
    """Last write per cell by event time, then sequence number; an empty input clears the cell."""
    last = changes.groupBy(*CELL).agg(F.max_by(F.struct("input", "ts", "seq"), F.struct("ts", "seq")).alias("w"))
    cells = last.select(*CELL, "w.*")
    return cells if keep_cleared else cells.where(F.coalesce(F.col("input"), F.lit("")) != "")


def _fold_cells(rows: DataFrame) -> DataFrame:
    return latest_cells(rows, keep_cleared=True).withColumn(BATCH, F.lit(0).cast("long"))


def follow_cells(changes: DataFrame, log: str, checkpoint: str):
    """Apply a stream of cell changes to a log with one row per touched cell and level; :func:`read_cells` folds it.

    A batch that runs again after a failure is not added twice, and old batches are folded together as new ones come in.
    """
    return _into(changes, log, _fold_cells, checkpoint, "append")


def read_cells(spark: SparkSession, log: str) -> DataFrame:
    return latest_cells(Levels(spark, log, _fold_cells).read())


def _into(stream: DataFrame, target: str, fold: Callable[[DataFrame], DataFrame], checkpoint: str, mode: str):
    def store(batch: DataFrame, batch_id: int) -> None:
        Levels(batch.sparkSession, target, fold).append(batch, batch_id)

    return stream.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_query(source: DataFrame, steps: Callable[[DataFrame], DataFrame], target: str, checkpoint: str):
    """Run a query's row-wise steps over arriving data and append the result to its table."""
    return (
        source.transform(steps)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


@dataclass(frozen=True)
class Grouping:
    """A grouped query whose groups can be kept up to date: row-wise steps, keys, and ``(aggregation, column)`` pairs
    as :func:`tabulon.operators.transforms.group_by` takes them (count, sum, avg, max, min)."""

    steps: Callable[[DataFrame], DataFrame]
    keys: Sequence[str]
    aggs: Sequence[tuple[str, str | None]]

    def run(self, df: DataFrame) -> DataFrame:
        """The result over a whole table."""
        return group_by(df.transform(self.steps), self.keys, self.aggs)

    def _partial(self, df: DataFrame) -> DataFrame:
        made = []
        for i, (name, column) in enumerate(self.aggs):
            if name == "count":
                made.append(F.count(F.lit(1)).alias(f"_a{i}"))
            elif name == "avg":
                made += [F.sum(F.col(column).cast("double")).alias(f"_a{i}"), F.count(column).alias(f"_n{i}")]
            else:
                made.append(getattr(F, name)(column).alias(f"_a{i}"))
        return df.transform(self.steps).groupBy(*self.keys).agg(*made)

    def _fold(self, rows: DataFrame) -> DataFrame:
        made = []
        for i, (name, _) in enumerate(self.aggs):
            merge = getattr(F, name) if name in ("max", "min") else F.sum
            made.append(merge(f"_a{i}").alias(f"_a{i}"))
            if name == "avg":
                made.append(F.sum(f"_n{i}").alias(f"_n{i}"))
        return rows.groupBy(*self.keys).agg(*made).withColumn(BATCH, F.lit(0).cast("long"))

    def follow(self, source: DataFrame, target: str, checkpoint: str):
        """Fold what has arrived into the stored groups; only the new rows are read."""

        def store(batch: DataFrame, batch_id: int) -> None:
            Levels(batch.sparkSession, target, self._fold).append(self._partial(batch), batch_id)

        return source.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def read(self, spark: SparkSession, target: str) -> DataFrame:
        """The current result, with the columns of :meth:`run`."""
        stored = Levels(spark, target, self._fold).read()
        labels = [("Count" if name == "count" else GROUP_LABEL[name].format(column)) for name, column in self.aggs]
        final = [F.try_divide(f"_a{i}", f"_n{i}") if name == "avg" else F.col(f"_a{i}") for i, (name, _) in enumerate(self.aggs)]
        return stored.select(*self.keys, *[c.alias(label) for c, label in zip(final, labels)])


def follow_reload(source: DataFrame, run: Callable[[], DataFrame], query: str, checkpoint: str):
    """Refresh any other query when data arrives: it runs anew and its table is swapped."""

    def reload(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            load_table(run(), query)

    return source.writeStream.foreachBatch(reload).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_WINDOW = {"hours": "1 hour", "weeks": "7 days"}


def timeline_totals(
    events: DataFrame, ts: str, value: str, level: str = "days", lateness: str = "1 day", by: Sequence[str] = ()
) -> DataFrame:
    """Count and sum per window: hours, weeks, or days (which also serve months, quarters and years, see :func:`read_totals`).

    The state of a window is dropped once it ended more than ``lateness`` before the newest event, and rows that come later than that
    are left out. The time column becomes an instant, which watermarks require.
    """
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", lateness)
    out = timed.groupBy(F.window("_ts", _WINDOW.get(level, "1 day")).alias("_w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("_w.start").cast("timestamp_ntz").alias("start"), *by, "n", "total")


def _fold_totals(rows: DataFrame) -> DataFrame:
    """The newest totals of each window."""
    keys = [c for c in rows.columns if c not in ("n", "total", BATCH)]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct("n", "total", BATCH), BATCH).alias("_l"))
    return last.select(*keys, "_l.*")


def follow_totals(totals: DataFrame, target: str, checkpoint: str):
    """Merge the windows that a trigger has changed into ``target``; windows that did not change are not written again."""
    return _into(totals, target, _fold_totals, checkpoint, "update")


def read_totals(spark: SparkSession, target: str, level: str = "days") -> DataFrame:
    """``start, label, n, total`` per period and group, from windows of hours, of weeks, or of days for all other levels."""
    windows = Levels(spark, target, _fold_totals).read().drop(BATCH)
    by = [c for c in windows.columns if c not in ("start", "n", "total")]
    unit = {"months": "month", "quarters": "quarter", "years": "year"}.get(level)
    if unit:
        windows = windows.groupBy(F.date_trunc(unit, "start").cast("timestamp_ntz").alias("start"), *by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    start = F.col("start")
    label = F.date_format(start, "yyyy-MM-dd HH:mm") if level == "hours" else period_label(start, "days" if level == "weeks" else level)
    return windows.select("start", label.alias("label"), *by, "n", "total")


def distinct_events(events: DataFrame, ts: str, keys: Sequence[str], lateness: str = "1 day") -> DataFrame:
    """One row per key among rows arriving within the lateness; which of the copies is kept is open."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", lateness)
    return timed.dropDuplicatesWithinWatermark(list(keys)).drop("_ts")
