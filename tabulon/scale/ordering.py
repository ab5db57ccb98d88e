"""Row order without a single-task global window.

Rows are range-partitioned on the whole order key and sorted inside each partition. Position inside
the sorted partition plus the sizes of the partitions before it give a gap-free index, so the only
global step works on one row per partition. The same layout carries running totals and last-seen
values across partition borders, which keeps a group holding a third of all rows spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabulon.scale.storage import materialize

OrderKey = str | Column
BLOCK, POS = "__block", "__pos"
_POS_BITS = 33  # monotonically_increasing_id keeps the partition number above bit 33


def order_columns(order_by: Sequence[OrderKey] | OrderKey | None) -> list[Column]:
    """Order keys as columns; positional operators refuse to run without one."""
    if order_by is None or (isinstance(order_by, (list, tuple)) and not order_by):
        raise ValueError("this operator depends on row order: pass order_by=[...] with a unique key")
    keys = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def sorted_blocks(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """Globally sorted copy of ``df`` with ``__block`` (range number) and ``__pos`` (0-based inside it).

    Up to ``spark.sql.shuffle.partitions`` ranges; adaptive execution joins neighbours that are small.
    """
    tagged = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("__mid", F.monotonically_increasing_id())
        .withColumn(BLOCK, F.shiftright("__mid", _POS_BITS).cast("int"))
        .withColumn(POS, F.col("__mid").bitwiseAND(F.lit((1 << _POS_BITS) - 1)))
        .drop("__mid")
    )
    return materialize(tagged, "sorted")


def _block_starts(blocks: DataFrame) -> DataFrame:
    # One row per range partition: bounded by spark.sql.shuffle.partitions whatever the data size.
    sizes = blocks.groupBy(BLOCK).agg(F.count(F.lit(1)).alias("__rows"))
    before = W.orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    return sizes.select(BLOCK, F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))


def row_index(
    df: DataFrame, order_by: Sequence[OrderKey] | OrderKey | None, name: str = "Index", start: int = 0
) -> DataFrame:
    """Add a gap-free ``name`` column counting rows from ``start`` in ``order_by`` order."""
    blocks = sorted_blocks(df, order_columns(order_by))
    starts = F.broadcast(_block_starts(blocks))  # at most one row per shuffle partition
    return (
        blocks.join(starts, BLOCK)
        .withColumn(name, F.col("__start") + F.col(POS) + F.lit(start))
        .drop(BLOCK, POS, "__start")
    )


def join_null_safe(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, small: bool = False
) -> DataFrame:
    """Equi-join where null keys match; the key columns of ``right`` are dropped from the result."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    if small:
        renamed = F.broadcast(renamed)
    condition = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys))
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def running(
    df: DataFrame,
    by: Sequence[str],
    order_by: Sequence[OrderKey] | OrderKey,
    sums: dict[str, Column] | None = None,
    fills: dict[str, Column] | None = None,
    lags: dict[str, Column] | None = None,
) -> DataFrame:
    """Running sums and last-non-null values per group, inclusive of the current row.

    ``sums`` maps a new column to the expression summed so far; ``fills`` maps a new column to the
    expression whose latest non-null value is carried forward; ``lags`` maps a new column to the expression of the
    row before, null on the first. Work is split by (block, group): a group
    crossing blocks receives what earlier blocks contributed from a table with at most two rows per block.
    """
    sums, fills, lags = sums or {}, fills or {}, lags or {}
    by = list(by)
    inputs = {f"_s_{n}": c for n, c in sums.items()} | {f"_f_{n}": c for n, c in fills.items()} | {f"_g_{n}": c for n, c in lags.items()}
    prepared = df.withColumns(inputs)
    order = order_columns(order_by)
    blocks = sorted_blocks(prepared, [F.col(c) for c in by] + order)

    so_far = W.partitionBy(BLOCK, *by).orderBy(POS).rowsBetween(W.unboundedPreceding, 0)
    local = blocks.withColumns(
        {f"_ls_{n}": F.sum(f"_s_{n}").over(so_far) for n in sums}
        | {f"_lf_{n}": F.last(f"_f_{n}", ignorenulls=True).over(so_far) for n in fills}
        | {f"_lg_{n}": F.lag(F.struct(F.col(f"_g_{n}").alias("v"))).over(W.partitionBy(BLOCK, *by).orderBy(POS)) for n in lags}
    )

    totals = [F.sum(f"_s_{n}").alias(f"_cs_{n}") for n in sums] + [
        F.max_by(f"_f_{n}", F.when(F.col(f"_f_{n}").isNotNull(), F.col(POS))).alias(f"_cf_{n}") for n in fills
    ] + [F.max_by(F.struct(F.col(f"_g_{n}").alias("v")), POS).alias(f"_cg_{n}") for n in lags]
    spanning = blocks
    if by:
        # Only a group that opens a block can have rows in an earlier one: one head row per block.
        heads = blocks.where(F.col(POS) == 0).select(*by).distinct()
        spanning = join_null_safe(blocks, heads, by, "left_semi", small=True)
    per_block = spanning.groupBy(BLOCK, *by).agg(*totals)
    earlier = W.partitionBy(*by).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    carry = per_block.select(
        BLOCK,
        *by,
        *[F.sum(f"_cs_{n}").over(earlier).alias(f"_cs_{n}") for n in sums],
        *[F.last(f"_cf_{n}", ignorenulls=True).over(earlier).alias(f"_cf_{n}") for n in fills],
        *[F.last(f"_cg_{n}", ignorenulls=True).over(earlier).alias(f"_cg_{n}") for n in lags],
    )
    joined = join_null_safe(local, carry, [BLOCK, *by], "left", small=True)
    result = {}
    for n in sums:
        own, before = F.col(f"_ls_{n}"), F.col(f"_cs_{n}")
        result[n] = F.when(own.isNull(), before).otherwise(own + F.coalesce(before, F.lit(0)))
    for n in fills:
        result[n] = F.coalesce(F.col(f"_lf_{n}"), F.col(f"_cf_{n}"))
    for n in lags:
        result[n] = F.coalesce(F.col(f"_lg_{n}"), F.col(f"_cg_{n}"))["v"]
    return joined.select(*df.columns, *[v.alias(n) for n, v in result.items()])


def with_neighbours(
    df: DataFrame, order_by: Sequence[OrderKey] | OrderKey, reach: int, by: Sequence[str] = (), chunk_rows: int = 100_000
) -> DataFrame:
    """Cut the ordered rows into fixed-size chunks, each led by the last ``reach`` rows of the one before.

    Adds ``_row`` (global index), ``_chunk`` and ``_own`` (false for the borrowed rows). A window
    partitioned by ``_chunk`` (and ``by``) then sees every trailing frame of up to ``reach + 1`` rows.
    """
    size = max(chunk_rows, reach)
    indexed = row_index(df, [*[F.col(c) for c in by], *order_columns(order_by)], "_row")
    home = F.floor(F.col("_row") / size).cast("long")
    lent = F.col("_row") % size >= size - reach
    chunks = F.when(lent, F.array(home, home + 1)).otherwise(F.array(home)) if reach else F.array(home)
    return indexed.withColumn("_home", home).withColumn("_chunk", F.explode(chunks)).withColumn(
        "_own", F.col("_chunk") == F.col("_home")
    ).drop("_home")
