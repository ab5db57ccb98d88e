"""Wildcard patterns against texts through an index of short pieces.

Every text is posted under its pieces of one to three characters, with marks around it that stand for its start and end. The literal
parts of a pattern give pieces that all of its matches hold; the pattern meets the texts posted under the rarest of
them only and is then compared in full. Many patterns with letters at the same places share one key per text instead, and a
short piece that may stand anywhere is answered from its postings. Patterns without any letter ask for a length and are
answered from counts of lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabulon.functions.values import bind
from tabulon.scale.storage import materialize

PIECE = 3
_PARTS = 64  # parts of the texts that meet the shapes on their own
_START, _END = "\x02\x02", "\x03\x03"  # two marks, so that a first or last letter alone makes a piece of three


def _windows(text: Column, size: int) -> Column:
    """All runs of ``size`` characters of a text."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (size - 1), F.lit(1)))
    runs = F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, runs).otherwise(F.array().cast("array<string>"))


def pattern_pieces(pattern: Column) -> Column:
    """Distinct pieces that every match of a pattern holds: of three characters, or shorter where a literal part is."""
    parts = F.split(F.concat(F.lit(_START), pattern, F.lit(_END)), r"[*?]", -1)
    bare = lambda p, i: (p == "") | ((i == 0) & (p == _START)) | ((i == F.size(parts) - 1) & (p == _END))
    each = F.transform(
        F.filter(parts, lambda p, i: ~bare(p, i)), lambda p: F.when(F.length(p) >= PIECE, _windows(p, PIECE)).otherwise(F.array(p))
    )
    return F.array_distinct(F.flatten(each))


def text_pieces(text: Column) -> Column:
    """Distinct pieces of a text: of three characters with its marks, and of one and two without."""
    framed = F.concat(F.lit(_START), text, F.lit(_END))
    return F.array_distinct(F.concat(_windows(framed, PIECE), _windows(text, 2), _windows(text, 1)))


def like_pattern(pattern: Column) -> Column:
    escaped = F.regexp_replace(pattern, r"([\\%_])", r"\\$1")
    return F.translate(escaped, "*?", "%_")


def first_matches(texts: DataFrame, patterns: DataFrame, payload: str) -> DataFrame:
    """``(pattern, payload)``: the least ``payload`` of ``texts(text, payload)`` that each distinct pattern matches, if any.

    ``*`` stands for any run of characters, ``?`` for one; case must be folded on both sides. Null texts and patterns
    match nothing.
    """
    asked = patterns.select("pattern").where("pattern is not null").distinct().withColumn("pieces", pattern_pieces(F.col("pattern")))
    asked = materialize(asked, "patterns")
    posted = materialize(asked.select("pattern", F.explode("pieces").alias("piece")), "pieces")
    numbered = materialize(texts.where("text is not null").groupBy("text").agg(F.min(payload).alias(payload)), "texts")
    wanted = posted.select("piece").distinct()
    postings = numbered.select("text", payload, F.explode(bind(F.col("text"), text_pieces)).alias("piece")).join(wanted, "piece", "left_semi")
    # Patterns of which some piece occurs nowhere match nothing and are out.
    counts = materialize(postings.groupBy("piece").agg(F.count(F.lit(1)).alias("n"), F.min(payload).alias("_first")), "piece_counts")
    known = posted.join(counts, "piece", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("rarest"))
    known = known.where("rarest.n > 0").select("pattern", "rarest", _shape(F.col("pattern")).alias("shape"), _inner_piece(F.col("pattern")).alias("inner"))
    known = materialize(known, "known")
    # A piece anywhere in the text: the least payload posted under it is the answer.
    within = known.where("inner is not null").select("pattern", F.col("inner").alias("piece")).join(counts, "piece").select("pattern", F.col("_first").alias(payload))
    # Letters at fixed places from both ends: one key a text for each shape answers all patterns of the shape, which is chosen
    # where the postings of its patterns are more than the texts.
    fixed = known.where("inner is null and shape is not null")
    total = numbered.agg(F.count(F.lit(1)).alias("texts"))
    shapes = fixed.groupBy("shape").agg(F.sum("rarest.n").alias("met")).withColumn("texts", total.scalar()).where("met > texts").select("shape")
    shapes = materialize(shapes, "shapes")
    keyed = known.where("inner is null").join(shapes, "shape", "left_anti")
    keyed = keyed.select("pattern", F.col("rarest.piece").alias("piece"), like_pattern(F.col("pattern")).alias("_like"))
    met = keyed.join(postings, "piece").where(F.expr("text like _like"))
    found = met.groupBy("pattern").agg(F.min(payload).alias(payload)).unionByName(within)
    found = found.unionByName(_by_shape(numbered, fixed.join(shapes, "shape").select("shape", "pattern"), shapes, payload))
    return found.unionByName(_by_length(numbered, asked.where(F.size("pieces") == 0).select("pattern"), payload))


def _inner_piece(pattern: Column) -> Column:
    """The piece of at most three letters that is all a pattern asks for, anywhere in the text; null for other patterns."""
    inner = F.regexp_extract(pattern, r"(?s)^\*+([^*?\x02\x03]{1,3})\*+$", 1)
    return F.when(inner != "", inner)


def _shape(pattern: Column) -> Column:
    """What a pattern with at most one run of ``*`` fixes, besides the letters: ``head`` and ``tail``, the places of its letters
    from the start and from the end, ``size``, the least length of a match, and ``open``, whether it may be longer. Else null.
    """
    head, tail = F.regexp_extract(pattern, r"(?s)^([^*]*)", 1), F.regexp_extract(pattern, r"(?s)\*([^*]*)$", 1)
    starred = F.contains(pattern, F.lit("*"))

    def places(part: Column, at) -> Column:
        every = F.when(F.length(part) > 0, F.sequence(F.lit(1), F.length(part))).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(every, lambda i: F.substring(part, i, F.lit(1)) != "?"), at)

    shape = F.struct(
        places(head, lambda i: i).alias("head"), places(tail, lambda i: i - F.length(tail) - 1).alias("tail"),
        (F.length(head) + F.length(tail)).alias("size"), starred.alias("open"),
    )
    return F.when(pattern.rlike(r"(?s)^[^*]*(\*+[^*]*)?$"), shape)


def _letters(text: Column, shape: Column) -> Column:
    """The letters of a text at the places of a shape; those from the end count back from the end."""
    return F.array_join(F.transform(F.concat(shape["head"], shape["tail"]), lambda i: F.substring(text, i, F.lit(1))), "")


def _by_shape(texts: DataFrame, patterns: DataFrame, shapes: DataFrame, payload: str) -> DataFrame:
    """Patterns of some shapes: every text meets every shape once and is looked up by its letters there."""
    # Each shape goes to every part of the texts, so that few shapes still keep all tasks busy.
    spread = shapes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))))
    parted = texts.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(_PARTS)).cast("int"))
    size = F.length("text")
    long_enough = (size == F.col("shape.size")) | (F.col("shape.open") & (size > F.col("shape.size")))
    met = parted.join(spread, "part").where(long_enough).select(_shape_key(F.col("shape"), _letters(F.col("text"), F.col("shape"))).alias("key"), payload)
    asked = patterns.select("pattern", _shape_key(F.col("shape"), _letters(F.replace("pattern", F.lit("*"), F.lit("")), F.col("shape"))).alias("key"))
    return met.join(asked, "key").groupBy("pattern").agg(F.min(payload).alias(payload))


def _shape_key(shape: Column, letters: Column) -> Column:
    places = lambda c: F.array_join(shape[c].cast("array<string>"), ",")
    return F.concat_ws(";", places("head"), places("tail"), shape["size"].cast("string"), shape["open"].cast("string"), letters)


def _by_length(texts: DataFrame, bare: DataFrame, payload: str) -> DataFrame:
    """Patterns of nothing but ``*`` and ``?``: texts of a length, or of at least that length."""
    best = texts.groupBy(F.length("text").alias("size")).agg(F.min(payload).alias("own"))
    need = bare.withColumn("size", F.length(F.replace("pattern", F.lit("*"), F.lit(""))))
    exact = need.where(~F.contains("pattern", F.lit("*"))).join(best, "size").select("pattern", F.col("own").alias(payload))
    least = need.where(F.contains("pattern", F.lit("*")))
    # Distinct lengths are few, whatever the number of texts.
    none = F.lit(None).cast(best.schema["own"].dataType).alias("own")
    points = best.unionByName(least.select("size", none).distinct())
    upward = points.select("size", F.min("own").over(W.orderBy(F.col("size").desc())).alias("up")).distinct()
    return exact.unionByName(least.join(upward, "size").where("up is not null").select("pattern", F.col("up").alias(payload)))
