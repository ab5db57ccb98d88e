"""Pairs of texts whose sets of word shingles have a Jaccard coefficient of a threshold or more.

Every text gets BANDS keys, each from ROWS min-hashes of its shingle set; a pair of similarity s shares a key with
probability 1 - (1 - s^ROWS)^BANDS, 0.9996 at 0.8. The members of a key are compared with one of them, the centre, chosen
by a hash of text and key, so that a group costs as many comparisons as it has members and keys differ in centres.
Each such pair is then compared by its whole shingle sets, so no link is below the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tabulon.scale.storage import materialize

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 5
SEED = 42
_KNOWN = 100_000  # words whose hashes a task remembers
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)  # odd factors
_DRAW = np.random.default_rng(SEED)
_ODD = _DRAW.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _DRAW.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


class Shingles:
    """Hashes of the word runs of texts. A word is hashed once and remembered; runs are combined from word hashes in numpy."""

    def __init__(self, width: int = WIDTH):
        self.width, self._seen = width, {}

    def of(self, text: bytes | None) -> np.ndarray:
        """Distinct 64-bit hashes of every run of ``width`` words, of all words if there are fewer; none without words."""
        words, seen = (text or b"").lower().split(), self._seen  # on bytes: A-Z and ASCII white space only
        if not words:
            return np.empty(0, np.uint64)
        if len(seen) > _KNOWN:
            seen.clear()
        for w in set(words):
            if w not in seen:
                seen[w] = xxhash.xxh64_intdigest(w, SEED)
        codes = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(words))
        runs = codes[: len(words) - width + 1] + np.uint64(width)
        for i in range(1, width):
            runs = runs * _STEP + codes[i : i + len(runs)]
        runs ^= runs >> np.uint64(31)
        return np.unique(runs * _MIX)


def band_keys(hashes: np.ndarray) -> list[int]:
    """BANDS signed keys of a set of 64-bit hashes; none for an empty set."""
    if not len(hashes):
        return []
    least = np.array([((hashes ^ f) * a).min() for f, a in zip(_FLIP, _ODD)], "<u8")
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), band) - (1 << 63) for band, row in enumerate(rows)]


def band_keys_udf(width: int = WIDTH):
    @F.arrow_udf("array<bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shingles = Shingles(width)
        for texts in batches:
            yield pa.array([band_keys(shingles.of(t)) for t in texts.cast(pa.binary()).to_pylist()], pa.list_(pa.int64()))

    return run


def jaccard_udf(width: int = WIDTH):
    """Jaccard coefficient of two texts; rows come by the second text, whose set is kept for those with the same one."""

    @F.arrow_udf("double")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        shingles, last, held = Shingles(width), None, None
        for left, right in batches:
            out = []
            for a, b in zip(left.cast(pa.binary()).to_pylist(), right.cast(pa.binary()).to_pylist()):
                if held is None or b != last:
                    last, held = b, shingles.of(b)
                own = shingles.of(a)
                both = len(np.intersect1d(own, held, assume_unique=True))
                out.append(both / max(1, len(own) + len(held) - both))
            yield pa.array(out, pa.float64())

    return run


def similar_links(signed: DataFrame, texts: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """Edges ``(a, b)`` between ``fp`` values of similar texts, from ``signed(fp, mark, tag, keys)`` and ``texts(mark, tag, txt)``.

    ``mark`` is a hash of the text, ``tag`` one of the id. Equal ``fp`` values are linked anyway and not compared.
    Texts without words (null texts among them) have no keys and no links here, repeated rows count once. Empty
    tables give an empty result.
    """
    each = signed.groupBy("fp", "mark").agg(F.any_value("keys").alias("keys"), F.min("tag").alias("tag"))  # copies count once
    posted = materialize(each.select("fp", "mark", F.explode("keys").alias("key")), "bands")
    member = F.struct(F.xxhash64("mark", "key").alias("order"), "fp", "mark")
    lists = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(member).alias("centre")).where("n > 1")
    lists = materialize(lists.select("key", F.col("centre.fp").alias("b"), F.col("centre.mark").alias("b_mark")), "lists")
    pairs = posted.join(lists, "key").where("fp != b").select(F.col("fp").alias("a"), F.col("mark").alias("a_mark"), "b", "b_mark")
    pairs = materialize(pairs.distinct(), "pairs")
    needed = pairs.select(F.col("a_mark").alias("mark")).union(pairs.select("b_mark")).distinct()
    # One copy of each text is asked for by its id, so that a text with many copies does not meet in one task.
    needed = each.select("mark", "tag").join(needed, "mark").distinct()
    found = materialize(texts.join(needed.hint("merge"), ["mark", "tag"], "left_semi").dropDuplicates(["mark"]).drop("tag"), "texts")
    for side in ("a", "b"):
        pairs = pairs.join(found.select(F.col("mark").alias(f"{side}_mark"), F.col("txt").alias(f"{side}_txt")), f"{side}_mark")
    alike = pairs.where(jaccard_udf(width)("a_txt", "b_txt") >= threshold)
    return alike.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
