"""Joins that stay balanced when one key holds a large share of the rows.

By default a join is the plain join and starts no job: adaptive execution splits the partitions of a hot key.
Where that is not enough (a full outer join, a plan that needs the key's layout afterwards) pass ``hot``, the result
of ``hot_keys``: a frequent-items sketch, one narrow scan with a fixed-size state per task and at most ``1 / share``
hashes for the driver. Rows of a hot key then get a salt and the rows that they match are repeated once per salt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabulon.scale.ordering import join_null_safe

_TRACKED = 1024


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = 0.02) -> list[int]:
    """Hashes of the keys that hold more than ``share`` of the rows (at most ``1 / share`` of them)."""
    hashed = df.select(F.xxhash64(*keys).alias("h"))
    top = hashed.agg(
        F.expr(f"approx_top_k(h, {min(int(1 / share) + 1, 128)}, {_TRACKED})").alias("items"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    return [i["item"] for i in top["items"] or [] if i["count"] > share * top["n"] and i["count"] > _TRACKED]


def _spread(df: DataFrame, salts: int) -> Column:
    # Repeatable on retry, and different for equal rows read by different tasks.
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    return F.pmod(F.xxhash64(F.spark_partition_id(), *plain), F.lit(salts)).cast("int")


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    hot: Sequence[int] = (),
    hot_right: Sequence[int] = (),
    salts: int | None = None,
    null_safe: bool = False,
) -> DataFrame:
    """Join on equally named ``keys``; ``how`` is inner, left, left_semi or left_anti.

    ``hot`` and ``hot_right`` name key hashes to salt on either side, over ``salts`` tasks (default: as many as
    shuffles have partitions).

    Columns of ``right`` other than the keys must not clash with ``left``.
    """
    keys = list(keys)
    left_hot = list(hot)
    right_hot = [h for h in hot_right if h not in set(left_hot)] if how in ("inner", "left") else []
    if how in ("left_semi", "left_anti"):
        right = right.select(*keys).distinct()
    probe, build = left, right
    join_keys = keys
    if left_hot or right_hot:
        probe, build, join_keys = _salt_sides(left, right, keys, how, left_hot, right_hot, salts or _salts(left))
    joined = join_null_safe(probe, build, join_keys, how) if null_safe else probe.join(build, join_keys, how)
    extra = [] if how in ("left_semi", "left_anti") else [c for c in right.columns if c not in keys]
    if right_hot and how == "left":
        # A key hot on the right exists there, so every repeated left row keeps at least one real match.
        joined = joined.where(~F.col("_repeated") | F.col("_hit").isNotNull())
    return joined.select(*left.columns, *extra)


def _salts(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _salt_sides(left, right, keys, how, left_hot, right_hot, salts):
    h = F.xxhash64(*keys)
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    zero = F.array(F.lit(0))
    one_of = lambda df: F.array(_spread(df, salts))
    is_left, is_right = h.isin(left_hot), h.isin(right_hot)
    probe = left.withColumn("_salt", F.explode(F.when(is_left, one_of(left)).when(is_right, every).otherwise(zero)))
    build = right.withColumn("_salt", F.explode(F.when(is_left, every).when(is_right, one_of(right)).otherwise(zero)))
    if right_hot and how == "left":
        # Copies of a repeated left row that meet no match in their salt must not survive the left join.
        build = build.withColumn("_hit", F.lit(True))
        probe = probe.withColumn("_repeated", F.coalesce(is_right, F.lit(False)))
    return probe, build, [*keys, "_salt"]


def attach(
    left: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "left", hot: list[int] | None = None
) -> DataFrame:
    """Add the columns of ``per_key`` (one row per key) to ``left``; null keys match each other.

    ``hot`` takes the result of a :func:`hot_keys` call; rows of those keys are salted.
    """
    keys = list(keys)
    probe, build, join_keys = left, per_key, keys
    if hot:
        probe, build, join_keys = _salt_sides(left, per_key, keys, how, hot, [], _salts(left))
    joined = join_null_safe(probe, build, join_keys, how)
    return joined.select(*left.columns, *[c for c in per_key.columns if c not in keys])
