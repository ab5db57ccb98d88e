"""Merges and lookups (J).

Merges are one native join each; adaptive execution splits keys that hold a large share of a side.
Lookups are joins against one row per key; nearest-key lookups match distinct keys range by range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from tabulon.operators.patterns import first_matches
from tabulon.operators.shaping import dedupe_first
from tabulon.scale.ordering import OrderKey, order_columns, row_index, running
from tabulon.scale.ranges import can_cut, carry_along, range_bounds
from tabulon.scale.skew import attach

_SIDE_JOIN = ("left", "right", "full", "inner", "left_anti", "right_anti")


def merge(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    how: str = "left",
    name: str = "Other",
    null_safe: bool = False,
) -> DataFrame:
    """Merge two tables on one key each; columns of ``right`` come back as ``name.column``."""
    if how not in _SIDE_JOIN:
        raise ValueError(f"unknown join kind {how!r}")
    names = [*left.columns, *[f"{name}.{c}" for c in right.columns]]
    # Plain positional names while joining, so that dots and other marks in column names need no care.
    mine = left.toDF(*[f"l{i}" for i in range(len(left.columns))])
    other = right.toDF(*[f"r{i}" for i in range(len(right.columns))])
    a, b = mine[f"l{left.columns.index(left_key)}"], other[f"r{right.columns.index(right_key)}"]
    same = a.eqNullSafe(b) if null_safe else a == b
    if how == "left_anti":
        return mine.join(other, same, "left_anti").toDF(*left.columns)
    if how == "right_anti":
        blank = [F.lit(None).cast(f.dataType) for f in mine.schema.fields]
        return other.join(mine, same, "left_anti").select(*blank, *other.columns).toDF(*names)
    return mine.join(other, same, how).toDF(*names)


def merge_nested(left: DataFrame, right: DataFrame, left_key: str, right_key: str, column: str = "Merged") -> DataFrame:
    """Left merge keeping the matches of each row as an array of structs; join first, nest on demand.

    A nested cell holds every match of its key, so prefer :func:`merge`, which never nests.
    """
    nested = right.groupBy(F.col(right_key).alias("_k")).agg(F.collect_list(F.struct(*right.columns)).alias(column))
    joined = left.withColumn("_k", F.col(left_key))
    return attach(joined, nested, ["_k"]).drop("_k")


def expand_nested(df: DataFrame, column: str, fields: Sequence[str], name: str) -> DataFrame:
    keep = [c for c in df.columns if c != column]
    rows = df.select(*keep, F.explode_outer(column).alias("_m"))
    return rows.select(*keep, *[F.col(f"_m.{f}").alias(f"{name}.{f}") for f in fields])


def lookup_exact(
    df: DataFrame,
    key: str,
    table: DataFrame,
    table_key: str,
    returns: Sequence[str],
    order_by: Sequence[str],
    default=None,
    last: bool = False,
) -> DataFrame:
    """First (or last) match per key; unmatched rows get ``default`` in every returned column."""
    order = [F.col(k).desc() if last else F.col(k) for k in order_by]
    one = dedupe_first(table.where(F.col(table_key).isNotNull()), [table_key], order)
    one = one.select(F.col(table_key).alias("_k"), F.lit(True).alias("_found"), *returns)
    out = attach(df.withColumn("_k", F.col(key)), one, ["_k"]).drop("_k")
    if default is not None:
        out = out.withColumns({c: F.when(F.col("_found"), F.col(c)).otherwise(F.lit(default)) for c in returns})
    return out.drop("_found")


def asof(
    df: DataFrame,
    on: str,
    table: DataFrame,
    table_on: str,
    returns: Sequence[str],
    order_by: Sequence[str],
    by: Sequence[str] = (),
    direction: str = "backward",
    ties: str = "last",
    default=None,
) -> DataFrame:
    """Nearest key at or before (``backward``) or at or after (``forward``) each row; exact matches win.

    ``by`` names equality columns present on both sides, ``order_by`` the position of a ``table`` row
    among equal keys, and ``ties`` which of those is returned. Rows without a match get ``default`` in every
    returned column. The distinct keys of both sides are cut into the same ranges and matched range by range; the rows of ``df``
    move once, to meet their key's match. Rows with a null key take no part.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"unknown direction {direction!r}")
    by = list(by)
    picked = F.min_by if ties == "first" else F.max_by
    hit = F.struct(F.col(table_on).alias("_on"), *returns)
    # Equal keys collapse first, on both sides: the sort sees each key of a group once, whatever its share of the rows.
    offered = table.where(F.col(table_on).isNotNull()).select(
        *by, F.col(table_on).alias("_on"), hit.alias("_hit"), F.struct(*[F.col(k) for k in order_by]).alias("_at"), F.lit(False).alias("_asked")
    )
    keyed = df.where(F.col(on).isNotNull())
    blank = [F.lit(None).cast(offered.schema[c].dataType).alias(c) for c in ("_hit", "_at")]
    asked = keyed.select(*by, F.col(on).alias("_on"), *blank, F.lit(True).alias("_asked"))
    kind = offered.schema["_hit"].dataType
    both = offered.unionByName(asked)
    points = both.groupBy(*by, "_on").agg(picked("_hit", "_at").alias("_hit"), F.max("_asked").alias("_asked"))
    if can_cut(points.schema["_on"].dataType):
        near = carry_along(points, by, "_on", "_hit", direction == "backward", bounds=range_bounds(both, "_on"))
    else:
        near = running(points, by, [F.col("_on").asc() if direction == "backward" else F.col("_on").desc()], fills={"_near": F.col("_hit")})
    near = near.where(F.col("_asked") & F.col("_near").isNotNull()).select(*by, "_on", "_near")
    other = lambda c: F.lit(default).cast(kind[c].dataType)
    joined = attach(keyed.withColumn("_on", F.col(on).cast(near.schema["_on"].dataType)), near, [*by, "_on"])
    found = joined.select(*df.columns, *[F.when(F.col("_near").isNull(), other(c)).otherwise(F.col("_near")[c]).alias(c) for c in returns])
    return found.unionAll(df.where(F.col(on).isNull()).select("*", *[other(c).alias(c) for c in returns]))


def lookup_sorted(df: DataFrame, key: str, table: DataFrame, vector: str, returns: Sequence[str], order_by) -> DataFrame:
    """Last row of an ascending vector at or below the key."""
    return asof(df, key, table, vector, returns, order_by)


def match_position(
    df: DataFrame, key: str, table: DataFrame, vector: str, order_by: Sequence[str], mode: int = 1, name: str = "pos"
) -> DataFrame:
    """1-based position of the key in a vector: ``0`` exact first, ``1`` ascending, ``-1`` descending input."""
    placed = row_index(table.select(*dict.fromkeys([vector, *order_by])), order_by, "_pos", 1)
    if mode == 0:
        if isinstance(df.schema[key].dataType, StringType) and isinstance(placed.schema[vector].dataType, StringType):
            return _match_text(df, key, placed, vector, name)
        first = placed.groupBy(F.col(vector).alias("_k")).agg(F.min("_pos").alias(name)).where(F.col("_k").isNotNull())
        return attach(df.withColumn("_k", F.col(key)), first, ["_k"]).drop("_k")
    direction = "backward" if mode == 1 else "forward"
    hits = placed.select(F.col(vector), F.col("_pos").alias(name))
    return asof(df, key, hits, vector, [name], [name], direction=direction)


def _match_text(df: DataFrame, key: str, placed: DataFrame, vector: str, name: str) -> DataFrame:
    """First position of each text key in any case; ``*`` and ``?`` in a key stand for any run and any character.

    Plain keys meet the vector in an equality join on the lower-case text, distinct patterns through the index of pieces.
    """
    lower = F.lower(F.col(key))
    wild = lower.rlike(r"[*?]")
    texts = placed.where(F.col(vector).isNotNull()).select(F.lower(vector).alias("text"), F.col("_pos").alias(name))
    plain = texts.groupBy(F.col("text").alias("_k")).agg(F.min(name).alias(name)).withColumn("_w", F.lit(False))
    found = first_matches(texts, df.where(wild).select(lower.alias("pattern")), name)
    found = found.select(F.col("pattern").alias("_k"), name, F.lit(True).alias("_w"))
    keyed = df.withColumn("_k", lower).withColumn("_w", F.coalesce(wild, F.lit(False)))
    return attach(keyed, plain.unionByName(found), ["_k", "_w"]).drop("_k", "_w")


def lookup_wildcard(
    table: DataFrame, column: str, patterns: Sequence[str] | DataFrame, returns: Sequence[str], order_by: Sequence[OrderKey]
) -> DataFrame:
    """First row matching each pattern in any case; no match gives nulls.

    ``patterns`` is a list, or a table with a column ``pattern`` for any number of them; each row of it gives a row.
    """
    if not isinstance(patterns, DataFrame):
        patterns = table.sparkSession.createDataFrame([(p,) for p in patterns], "pattern string")
    at = F.struct(F.struct(*order_columns(order_by)).alias("place"), *returns)
    found = first_matches(table.select(F.lower(F.col(column).cast("string")).alias("text"), at.alias("_hit")), patterns.select(F.lower("pattern").alias("pattern")), "_hit")
    joined = attach(patterns.select("pattern", F.lower("pattern").alias("_k")), found.withColumnRenamed("pattern", "_k"), ["_k"])
    return joined.select("pattern", *[F.col("_hit")[c].alias(c) for c in returns])


def index_match(
    df: DataFrame, key: str, table: DataFrame, vector: str, values: str, order_by: Sequence[str], name: str | None = None
) -> DataFrame:
    """Value of another column at the exact-match position of the key."""
    placed = row_index(table, order_by, "_pos", 1)
    found = match_position(df, key, table, vector, order_by, 0, "_at")
    at = placed.select(F.col("_pos").alias("_at"), F.col(values).alias(name or values))
    return attach(found, at, ["_at"]).drop("_at")
