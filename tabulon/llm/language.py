"""Language identification by rank-order profiles of letter n-grams.

A profile lists the most frequent n-grams (one to three symbols, words padded with a border symbol) by rank. The
out-of-place distance of a document to a language adds, over the document's profile, how far each n-gram is from its
rank in the language's profile; an n-gram that the language lacks counts as far as the profile is long. The nearest
language wins. N-grams are exact 63-bit numbers (21 bits per symbol), counted whole-text with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

LENGTH = 300  # n-grams in a profile
UNKNOWN = "und"
MIN_SCORE = 0.2  # a text that no learned language fits this well is rejected by keep_known
_PART = 1 << 20  # characters counted at once
_FLUSH = 1_000_000  # distinct n-grams that a learning task holds before it passes them on
_SYMBOL = (1 << 21) - 1
_BORDER = 1  # symbols are code point + 1, so 1 is free


def letter_table() -> np.ndarray:
    """True for the code points that are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _symbols(part: str, letter: np.ndarray, before: int) -> np.ndarray:
    points = np.frombuffer(part.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.where(letter[points], points + 1, _BORDER)
    return codes[(codes != _BORDER) | (np.r_[before, codes[:-1]] != _BORDER)]


def trigram_counts(text: str, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted three-symbol n-grams around every letter of the whole text and their counts; empty without letters."""
    found = (np.empty(0, np.int64), np.empty(0, np.int64))
    tail = np.array([_BORDER], np.int64)
    for at in range(0, len(text), _PART):
        codes = _symbols(text[at : at + _PART], letter, int(tail[-1]))
        if at + _PART >= len(text):
            codes = np.r_[codes, _BORDER]
        row = np.r_[tail, codes]
        if len(row) > 2:
            three = (row[:-2] << 42 | row[1:-1] << 21 | row[2:])[row[1:-1] != _BORDER]
            found = add_counts([found, np.unique(three, return_counts=True)])
        tail = row[-2:]
    return found


def with_shorter(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of one to three symbols and their counts, from the three-symbol ones.

    Every letter is the middle of one of these, every pair that ends in a letter starts one, and every pair of a
    letter and a border ends one. So longer texts are sorted once, not once per length.
    """
    if not len(grams):
        return grams, counts
    middle = grams >> 21 & _SYMBOL
    closing = grams & _SYMBOL == _BORDER
    pairs = grams >> 21
    first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
    return add_counts([
        (grams, counts), (pairs[first], np.add.reduceat(counts, first)),
        (middle[closing] << 21 | _BORDER, counts[closing]), (middle, counts),
    ])


def add_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    parts = [p for p in parts if len(p[0])] or parts[:1]
    if len(parts) == 1:
        return parts[0]
    grams, inverse = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(np.int64)


def top(grams: np.ndarray, counts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The most frequent n-grams in rank order, ties by n-gram."""
    if len(grams) > length:  # leave out what is rarer than the last rank
        floor = np.partition(counts, -length)[-length]
        grams, counts = grams[counts >= floor], counts[counts >= floor]
    return grams[np.lexsort((grams, -counts))][:length]


def learn_profiles(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", length: int = LENGTH) -> "Profiles":
    """Profiles from all rows with a text and a language. One row per language and rank reaches the driver.

    Tasks add up their own n-grams first, so that a hot language or many copies shuffle a row per task and n-gram.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter, held = letter_table(), {}
        for batch in batches:
            parts: dict[str, list] = {k: [v] for k, v in held.items()}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts.setdefault(lang, []).append(trigram_counts(text, letter))
                if len(parts[lang]) > 500:
                    parts[lang] = [add_counts(parts[lang])]
            held = {k: add_counts(v) for k, v in parts.items()}
            if sum(len(g) for g, _ in held.values()) > _FLUSH:
                yield from _rows(held)
                held = {}
        yield from _rows(held)

    labelled = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("txt")).where("lang is not null and txt is not null")
    counted = labelled.mapInArrow(run, "lang string, gram bigint, n bigint")
    totals = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = totals.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.col("n").desc(), "gram")))
    return Profiles.of([tuple(r) for r in ranked.where(F.col("rank") <= length).select("lang", "gram", "rank").collect()], length)


def _rows(held: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for lang, (grams, counts) in held.items():
        grams, counts = with_shorter(grams, counts)
        names = pa.array([lang] * len(grams), pa.string())
        yield pa.RecordBatch.from_arrays([names, pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])


@dataclass
class Profiles:
    """Rank of every profile n-gram in every language; ``length`` where a language lacks it."""

    langs: list[str]
    grams: np.ndarray
    ranks: np.ndarray  # languages x n-grams
    length: int

    @classmethod
    def of(cls, rows: list[tuple[str, int, int]], length: int) -> "Profiles":
        langs = sorted({r[0] for r in rows})
        grams = np.array(sorted({r[1] for r in rows}), np.int64)
        ranks = np.full((len(langs), len(grams)), length, np.int64)
        for lang, gram, rank in rows:
            ranks[langs.index(lang), np.searchsorted(grams, gram)] = rank - 1
        return cls(langs, grams, ranks, length)

    def nearest(self, text: str | None, letter: np.ndarray) -> tuple[str, float]:
        """Nearest language (ties: the first by name) and 1 minus its distance as a share of the greatest one."""
        own = top(*with_shorter(*trigram_counts(text, letter)), self.length) if text else ()
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        known = self.grams[at] == own
        away = np.where(known, np.abs(self.ranks[:, at] - np.arange(len(own))), self.length)
        away = np.where(self.ranks[:, at] == self.length, self.length, away).sum(axis=1)
        best = int(np.argmin(away))
        return self.langs[best], 1.0 - float(away[best]) / (self.length * len(own))


def identify(text: Column, profiles: Profiles) -> Column:
    """``struct<lang, score>`` of the whole text: ``und`` and 0 for null, for texts without a letter, or if nothing was learned."""

    @F.arrow_udf("struct<lang:string,score:double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        letter = letter_table()
        for texts in batches:
            got = [profiles.nearest(t, letter) for t in texts.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["lang", "score"])

    return run(text)


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; fold 2 is held out. A null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)), F.lit(0).cast("long"))


def keep_known(docs: DataFrame, profiles: Profiles, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """Rows whose text has letters and fits its nearest language with ``min_score`` or more; all columns stay."""
    found = identify(F.col(text_col), profiles)
    return docs.where((found["lang"] != UNKNOWN) & (found["score"] >= min_score))
