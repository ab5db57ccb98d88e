"""Mixing sources to target weights by Pfair scheduling.

The rows of a source, in the order of a seeded hash, form blocks. Block j (from 0) of a source with weight w is
released at slot floor(j / w) and due by slot ceil((j + 1) / w); in every slot the released block with the earliest
deadline goes next. With weights that add up to 1 all blocks then meet their deadlines, so that after any number
of slots every source is less than one block away from its share.

When a due source has no block left, it leaves, and from then on those that still have blocks share its weight: the
time at which such a source has had v blocks per unit of weight is the number of blocks that all of them have had by
then, at most what each of them holds. Windows between such times keep their deadlines in the same way.

The schedule is made in one task from a table with one row per source; it holds one entry per source and writes one
row per block.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabulon.scale.ordering import row_index
from tabulon.scale.storage import materialize

PERIOD = 1000
BLOCK_ROWS = 16
TEMPER = 0.5  # default target weight of a source: its number of rows to this power
SEED = 42
PLACE = "mix_place"  # column for the place of a row in the mix
_BATCH = 1 << 14  # blocks written at once
_SCHEDULE = "source string, block long, release long, deadline long, slot long, strict boolean"


def quotas(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Slots of each source in a period: its weight in whole slots, at least one, by largest remainder."""
    weights = {s: w for s, w in weights.items() if w > 0}
    if len(weights) > period:
        raise ValueError(f"{len(weights)} sources do not fit a period of {period} slots")
    if not weights:
        return {}
    whole = sum(weights.values())
    exact = {s: w / whole * period for s, w in weights.items()}
    got = {s: max(1, int(x)) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (got[s] - exact[s], s))  # most underserved first
    while sum(got.values()) < period:
        got[min(by_rest, key=lambda s: (got[s] - exact[s], s))] += 1
    while sum(got.values()) > period:
        got[max((s for s in by_rest if got[s] > 1), key=lambda s: (got[s] - exact[s], s))] -= 1
    return got


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the same proportions; weights of zero or less are left out."""
    exact = {s: Fraction(w) for s, w in weights.items() if w > 0}
    unit = lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * unit) for s, w in exact.items()}


def _earliest_first(names: list[str], window, base: int) -> Iterator[tuple[str, int, int, int, int]]:
    """``(source, block, release, deadline, slot)`` from slot ``base`` on; ``window(s, j)`` is None past the last block."""
    waiting = [(base, s, 0) for s in sorted(names)]
    ready: list[tuple[int, str, int, int]] = []
    slot = base
    while waiting or ready:
        while waiting and waiting[0][0] <= slot:
            release, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (window(s, j)[1], s, j, release))
        deadline, s, j, release = heapq.heappop(ready)
        yield s, j, release, deadline, slot
        slot += 1
        if after := window(s, j + 1):
            heapq.heappush(waiting, (after[0], s, j + 1))


def schedule(weight: dict[str, int], blocks: dict[str, int]) -> Iterator[tuple[str, int, int, int, int, bool]]:
    """``(source, block, release, deadline, slot, strict)`` of every block, ``strict`` before a due source has none left."""
    weight = {s: w for s, w in weight.items() if blocks.get(s, 0) > 0 and w > 0}
    whole = sum(weight.values())
    done, base = dict.fromkeys(weight, 0), 0
    endless = lambda s, j: (j * whole // weight[s], -(-(j + 1) * whole // weight[s]))
    for s, j, release, deadline, slot in _earliest_first(list(weight), endless, 0):
        if j == blocks[s]:
            break
        yield s, j, release, deadline, slot, True
        done[s], base = j + 1, slot + 1

    left = {s: blocks[s] - n for s, n in done.items() if n < blocks[s]}
    leaving = sorted(left, key=lambda s: Fraction(left[s], weight[s]))
    shared, gone = [sum(weight[s] for s in leaving)], [base]  # weight and blocks once the first i sources have left
    for s in leaving:
        shared.append(shared[-1] - weight[s])
        gone.append(gone[-1] + left[s])

    def window(s: str, j: int) -> tuple[int, int] | None:
        if j == left[s]:
            return None
        at = lambda n: bisect_left(leaving, True, key=lambda o: left[o] * weight[s] >= n * weight[o])
        a, b = at(j), at(j + 1)
        return gone[a] + j * shared[a] // weight[s], gone[b] - (-(j + 1) * shared[b] // weight[s])

    for s, j, release, deadline, slot in _earliest_first(leaving, window, base):
        yield s, done[s] + j, release, deadline, slot, False


def one_period(quota: dict[str, int]) -> list[tuple[str, int, int]]:
    """``(source, nth block of the period, slot)`` by earliest deadline first among the released blocks."""
    return [(s, j, slot) for s, j, _, _, slot, _ in schedule(quota, quota)]


def _schedule_table(sizes: DataFrame, weights: dict[str, float] | None, block_rows: int, period: int | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = {s: n for batch in batches for s, n in zip(batch["source"].to_pylist(), batch["n"].to_pylist())}
        target = {s: n**TEMPER for s, n in rows.items()} if weights is None else weights
        whole = whole_weights(target) if period is None else quotas(target, period)
        planned, names = [], _SCHEDULE.replace(",", "").split()[::2]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*planned), types)], names)
        for row in schedule(whole, {s: -(-n // block_rows) for s, n in rows.items()}):
            planned.append(row)
            if len(planned) == _BATCH:
                yield pack()
                planned = []
        if planned:
            yield pack()

    return sizes.select("source", "n").coalesce(1).mapInArrow(run, _SCHEDULE)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", id_col: str = "doc_id", block_rows: int = BLOCK_ROWS, period: int | None = None, seed: int = SEED) -> DataFrame:
    """``(id, source, block, release, deadline, slot, place, selected)`` for every row.

    Every row of a source with a weight has a slot. Rows with a slot before a source is due whose blocks are used up are
    ``selected``: up to there all target weights hold; afterwards the sources that have rows left share the weight.
    Without ``weights`` each source weighs its number of rows to the power TEMPER. Sources without a weight have no
    slot and are not selected. A null source goes by the empty name. Repeated rows have places of their own.
    Weights are taken exactly; only with a ``period`` they are rounded to multiples of 1 / period, and more sources
    than that raise. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"))
    rows = materialize(rows, "sources")
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    plan = materialize(_schedule_table(sizes, weights, block_rows, period), "schedule")

    numbered = row_index(rows, ["source", F.xxhash64("id", F.lit(seed)), "id"], "__at")
    # The rows are numbered by source, so a source starts after all rows of those before it.
    starts = materialize(numbered.groupBy("source").agg(F.min("__at").alias("__start")), "starts")  # size known to the planner
    nth = numbered.join(starts, "source").withColumn("__nth", F.col("__at") - F.col("__start"))
    nth = nth.withColumn("block", F.floor(F.col("__nth") / block_rows)).withColumn("place", (F.col("__nth") % block_rows).cast("int"))
    placed = nth.join(plan, ["source", "block"], "left")
    return placed.select(
        "id", "source", "block", "release", "deadline", "slot", "place", F.coalesce("strict", F.lit(False)).alias("selected")
    )


def with_places(docs: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", id_col: str = "doc_id", name: str = PLACE, **settings) -> DataFrame:
    """All rows of ``docs`` whose source has a weight, with their place in the mix as one more column; a column of that name
    is replaced. Rows with the same id share the place of the first of them.
    """
    placed = mix(docs, weights, source_col, id_col, **settings).where("slot is not null")
    at = F.col("slot") * settings.get("block_rows", BLOCK_ROWS) + F.col("place")
    first = placed.groupBy(F.col("id").alias("__id")).agg(F.min(at).alias("__at"))
    kept = docs.join(first.hint("merge"), docs[id_col].eqNullSafe(F.col("__id")))
    return kept.select(*[c for c in docs.columns if c != name], F.col("__at").alias(name))


def take_mix(docs: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", id_col: str = "doc_id", **settings) -> DataFrame:
    """All rows of ``docs`` whose source has a weight, in the order of the mix; rows with the same id go together."""
    placed = with_places(docs, weights, source_col, id_col, "__place", **settings)
    return placed.repartitionByRange("__place").sortWithinPartitions("__place").select(*docs.columns)
