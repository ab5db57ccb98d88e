"""Balanced shards by minimax contiguous partition of ordered atomic groups. DataFrame functions only.

Documents with equal texts are one group and stay together; groups are ordered by their smallest id. A group larger
than an even share of what is left takes a shard of its own. For the rest the smallest capacity is found by binary
search, each capacity checked greedily: fill a shard up to the capacity, cut at the last group that fits, go on. Cuts
are then moved as near to even ones as that capacity allows, so that no shard is left short at the end.

Group ends (running byte totals) stay distributed. The driver sees a summary of at most CELLS ranges: the first and
last group end in each. A greedy check on it gives a lower and an upper bound of every cut, so a capacity is feasible,
infeasible or open. The ranges in which cuts are still open are summarised again, finer by the same number of ranges,
until the capacity and all cuts are exact: a handful of narrow scans, whatever the number of groups.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, functions as F

from tabulon.scale.ordering import row_index, running
from tabulon.scale.storage import materialize

ROW_BYTES = 16  # added to every text
CELLS = 16_384  # ranges of group ends in a summary, and at least 8 for each pair of shards, so that bounds shrink


def text_key(text: Column) -> Column:
    """Groups are equal texts, compared by SHA-256; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class Summary:
    """First and last group end of every range, ranges in order; a range with at most two ends is known exactly."""

    def __init__(self, rows: list[tuple[int, int, int]]):
        rows = sorted(rows)
        self.low, self.high, self.exact = [r[0] for r in rows], [r[1] for r in rows], [r[2] <= 2 for r in rows]

    def last_end(self, x: int, at: int) -> tuple[int, int]:
        """Bounds of the last group end at or before ``x``; ``at`` where nothing fits."""
        i = bisect_right(self.low, x) - 1
        if i < 0 or self.low[i] <= at and self.high[i] <= at:
            return at, at
        if self.high[i] <= x:
            return self.high[i], self.high[i]
        return max(at, self.low[i]), max(at, self.low[i]) if self.exact[i] else x

    def first_end(self, x: int) -> tuple[int, int]:
        """Bounds of the first group end at or after ``x``; the start of the first group counts as one."""
        if x <= 0:
            return 0, 0
        i = bisect_left(self.high, x)
        if i == len(self.high):
            return x, x
        if self.low[i] >= x:
            return self.low[i], self.low[i]
        return (self.high[i] if self.exact[i] else x), self.high[i]

    def greedy(self, capacity: int, shards: int, upper: bool) -> list[int]:
        """Cuts of shards filled up to the capacity one after the other, as bounds from below or above."""
        found, at = [], 0
        for _ in range(shards):
            at = self.last_end(at + capacity, at)[upper]
            found.append(at)
        return found

    def even(self, capacity: int, shards: int, total: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """Bounds of the cuts nearest below the even ones that the capacity allows, and of the earliest possible cuts."""
        need = [(total, total)]  # the rest behind an earlier cut would not fit the shards that are left
        for _ in range(shards - 1):
            low, high = need[-1]
            need.append((self.first_end(low - capacity)[0], self.first_end(high - capacity)[1]))
        need.reverse()
        cuts, low, high = [], 0, 0
        for k in range(shards):
            goal = total * (k + 1) // shards
            low = self.last_end(min(low + capacity, max(goal, need[k][0])), low)[0]
            high = self.last_end(min(high + capacity, max(goal, need[k][1])), high)[1]
            cuts.append((low, high))
        return cuts, need


def _smallest(feasible, low: int, high: int) -> int:
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(middle) else (middle + 1, high)
    return low


def summarise(ends: DataFrame, spans: list[tuple[int, int]], cells: int) -> Summary:
    """One scan of the group ends within ``spans`` (at most two for each shard)."""
    width = max(1, -(-sum(b - a + 1 for a, b in spans) // cells))
    cell, before = F.lit(None).cast("long"), 0
    for a, b in spans:
        place = before + F.floor((F.col("upto") - a) / width)
        cell = F.when((F.col("upto") >= a) & (F.col("upto") <= b), place).otherwise(cell)
        before += -(-(b - a + 1) // width)
    inside = ends.select("upto", cell.alias("cell")).where("cell is not null")
    grouped = inside.groupBy("cell").agg(F.min("upto"), F.max("upto"), F.count(F.lit(1)))
    return Summary([(r[1], r[2], r[3]) for r in grouped.collect()])


def best_cuts(ends: DataFrame, total: int, largest: int, shards: int, cells: int = CELLS) -> list[int]:
    """Last group end of every shard. ``ends`` has the column ``upto``.

    First the smallest feasible capacity is searched; among the cuts that keep to it, those next below the even ones.
    """
    cells = max(cells, 8 * shards * shards)
    whole = summary = summarise(ends, [(0, total)], cells)
    low, high = max(largest, -(-total // shards)), total // shards + largest
    while True:
        low = _smallest(lambda c: summary.greedy(c, shards, True)[-1] >= total, low, high)
        high = _smallest(lambda c: summary.greedy(c, shards, False)[-1] >= total, low, high)
        if low == high:
            break
        open_cuts = zip(summary.greedy(low, shards, False), summary.greedy(high, shards, True))
        summary = summarise(ends, _joined(list(open_cuts)), cells)
    cuts, need = whole.even(low, shards, total)
    while any(a != b for a, b in cuts):
        cuts, need = summarise(ends, _joined(cuts + need), cells).even(low, shards, total)
    return [a for a, _ in cuts]


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def group_shards(rows: DataFrame, shards: int) -> DataFrame:
    """``(key, shard)`` for every group of ``rows(id, size, key)``; stored."""
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.min("id").alias("first")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    # At most shards - 1 groups can be larger than an even share of what is left.
    giants, left = [], shards
    largest = groups.orderBy(F.col("bytes").desc(), "first", "key").limit(shards).collect()
    for g in largest:
        if left > 1 and g["bytes"] * left > total:
            giants.append(bytes(g["key"]))
            total, left = total - g["bytes"], left - 1
    own = F.lit(None).cast("int")
    for n, key in enumerate(giants):
        own = F.when(F.col("key") == F.lit(key), F.lit(left + n)).otherwise(own)
    marked = groups.withColumn("own", own)
    rest = [g["bytes"] for g in largest if bytes(g["key"]) not in set(giants)]
    parts = marked.where("own is not null").select("key", F.col("own").alias("shard"))
    if total:
        small = marked.where("own is null").select("key", "bytes", "first")
        ends = materialize(running(small, [], ["first", "key"], sums={"upto": F.col("bytes")}).select("key", "upto"), "ends")
        cuts = best_cuts(ends, total, rest[0], left)
        shard = sum(((F.col("upto") > c).cast("int") for c in cuts[:-1]), F.lit(0))
        parts = parts.unionByName(ends.select("key", shard.alias("shard")))
    return materialize(parts, "shards")


def sized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, size, crc, key)`` of every row: UTF-8 bytes of the text plus ROW_BYTES, its CRC-32 and its group."""
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
        text_key(text).alias("key"),
    )


def shard_rows(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, size, crc, shard, slot)`` for every row: shards of near equal bytes, slots counted from 0 in each.

    Null and empty texts are one group. Rows with a null id come first in their shard; repeated rows each get a
    slot of their own. Fewer groups than shards leave shards empty. An empty table gives an empty result.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    rows = materialize(sized(docs, id_col, text_col), "sizes")
    placed = rows.join(group_shards(rows, shards), "key").select("id", "size", "crc", "shard")
    numbered = row_index(placed, ["shard", "id", "crc"], "__at")
    starts = numbered.groupBy("shard").agg(F.min("__at").alias("__start"))  # one row per shard
    return numbered.join(F.broadcast(starts), "shard").select("id", "size", "crc", "shard", (F.col("__at") - F.col("__start")).alias("slot"))


def with_shards(
    docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", name: str = "shard", order_col: str | None = None
) -> DataFrame:
    """``docs`` with the shard of every row as one more column; a column of that name is replaced.

    Shards take the groups in the order of their least id. With ``order_col`` they take them in the order of its least value,
    so that each shard is one stretch of that order, and the rows leave sorted by shard and that column.
    """
    rows = materialize(sized(docs, order_col or id_col, text_col), "sizes")
    placed = group_shards(rows, shards).select(F.col("key").alias("__key"), F.col("shard").alias("__shard"))
    kept = [c for c in docs.columns if c != name]
    out = docs.withColumn("__key", text_key(F.col(text_col))).join(placed, "__key").select(*kept, F.col("__shard").alias(name))
    return out.repartitionByRange(name, order_col).sortWithinPartitions(name, order_col) if order_col else out
