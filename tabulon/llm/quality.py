"""Quality verdicts: base rules and a calibrated logistic regression over hashed words and character n-grams.

A text is the mean weight of its hashed words plus the mean weight of its hashed character n-grams plus a bias; the
weights are fitted on a bounded sample of labelled rows, a second fold of the sample calibrates the score to a
probability (Platt's two parameters), and a fixed threshold gives the verdict. Features are counted over whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

MIN_WORDS = 10
REPEAT_SHARE = 20  # per cent of the words
WINDOW = 5
BUCKET_BITS = 13
BUCKETS = 1 << BUCKET_BITS  # per kind of feature
GRAM = 4  # characters (code points) in a character n-gram
KINDS = 2  # words, character n-grams
SAMPLE_ROWS = 2_000  # labelled rows that a model is fitted on, at most
THRESHOLD = 0.5
_SYMBOLS = b"#*$%&|<>"
_PART = 1 << 20
_MIX = np.uint32(0x9E3779B1)  # a prime near 2**32 over the golden ratio
_STEP = np.uint32(0x01000193)  # an odd factor: distinct short runs of ASCII get distinct numbers
_KNOWN = 500_000  # words whose buckets a task remembers


def repeated_words(codes: np.ndarray, width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur twice or more, the first occurrence included.

    Windows are compared by exact numbers, as many word codes in one as fit 63 bits.
    """
    n = len(codes) - width + 1
    if n < 2:
        return 0
    base = int(codes.max()) + 1
    runs, room = codes[:n], base
    for at in range(1, width):
        if room * base >= 1 << 63:  # no more room for an exact number: go on from class numbers
            runs = np.unique(runs, return_inverse=True)[1]
            room = int(runs.max()) + 1
        runs = runs * base + codes[at : at + n]
        room *= base
    ordered = np.sort(runs)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    twice = np.isin(runs, again)
    edge = np.zeros(len(codes) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the whole text."""
    words = text.split()  # on bytes: the six ASCII white space characters
    chars = np.frombuffer(text, np.uint8)
    inside = int(np.count_nonzero((chars & 0xC0) != 0x80))  # code points
    blank = sum(text.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    symbols = sum(text.count(_SYMBOLS[i : i + 1]) for i in range(len(_SYMBOLS)))
    lines = [x for x in text.split(b"\n") if x.split(None, 1)]
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    return len(words), inside - blank, symbols, len(lines) - len(set(lines)), repeated_words(codes)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > REPEAT_SHARE * n_words)


class Hasher:
    """Bucket numbers of words, remembered over the texts of a task, and of character n-grams."""

    def __init__(self):
        self.seen: dict[bytes, int] = {}

    def buckets(self, text: bytes) -> Iterator[tuple[int, np.ndarray]]:
        """(kind, bucket numbers) of the whole text, long texts in parts."""
        seen, words = self.seen, text.split()
        if len(seen) > _KNOWN:
            seen.clear()
        for w in set(words):
            if w not in seen:
                seen[w] = zlib.crc32(w) % BUCKETS
        yield 0, np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
        chars_of = text.decode("utf-8", "replace")
        for at in range(0, max(len(chars_of) - GRAM + 1, 0), _PART):
            chars = np.frombuffer(chars_of[at : at + _PART + GRAM - 1].encode("utf-32-le", "replace"), np.uint32)
            mixed = chars[: len(chars) - GRAM + 1]
            for i in range(1, GRAM):
                mixed = mixed * _STEP + chars[i : i + len(mixed)]
            yield 1, (BUCKETS + ((mixed * _MIX) >> np.uint32(32 - BUCKET_BITS))).astype(np.int64)


def features(text: bytes, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and values; the values of each kind add up to 1."""
    total = np.zeros(KINDS * BUCKETS, np.int64)
    for _, part in hasher.buckets(text):
        if len(part):
            total += np.bincount(part, minlength=len(total))
    share = total.reshape(KINDS, BUCKETS) / np.maximum(total.reshape(KINDS, BUCKETS).sum(axis=1, keepdims=True), 1)
    at = np.flatnonzero(total)
    return at, share.reshape(-1)[at]


@dataclass
class Model:
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def score(self, text: bytes, hasher: Hasher) -> float:
        sums, sizes = [0.0] * KINDS, [0] * KINDS
        for kind, part in hasher.buckets(text):
            sums[kind] += float(self.weights[part].sum())
            sizes[kind] += len(part)
        return sum(s / max(n, 1) for s, n in zip(sums, sizes))

    def probability(self, text: bytes, hasher: Hasher) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.score(text, hasher) + self.shift, -500, 500))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], fold: np.ndarray, rounds: int = 100, decay: float = 1e-6) -> Model:
    """Adam on the mean log loss of the rows outside ``fold``, then Platt scaling on the rows inside it.

    With one class only, or no rows at all, the model is constant: the share of good rows, 1 if there are none.
    """
    labels = np.array([r[2] for r in rows], float)
    weights = np.zeros(KINDS * BUCKETS)
    if len(rows) < 2 or len(set(labels)) < 2:
        share = float(labels.mean()) if len(rows) else 1.0
        return Model(weights, 1.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    fit_on = ~fold if len(set(labels[~fold])) == 2 else np.ones(len(rows), bool)
    sizes = np.array([len(r[0]) for r in rows])
    at, owner = np.concatenate([r[0] for r in rows]), np.repeat(np.arange(len(rows)), sizes)
    # Frequent features vary little from text to text, rare ones much: scale by the root of the mean share.
    value = np.concatenate([r[1] for r in rows])
    scale = 1 / np.sqrt(np.bincount(at, value, len(weights)) / len(rows) + 1e-6)
    value = value * scale[at]
    mean, speed, bias = np.zeros_like(weights), np.zeros_like(weights), 0.0
    for step in range(1, rounds + 1):
        z = np.bincount(owner, weights[at] * value, len(rows)) + bias
        off = np.where(fit_on, 1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels, 0) / fit_on.sum()
        grad = np.bincount(at, off[owner] * value, len(weights)) + decay * weights
        bias -= 0.5 * off.sum()
        mean, speed = 0.9 * mean + 0.1 * grad, 0.999 * speed + 0.001 * grad**2
        weights = weights - 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(speed / (1 - 0.999**step)) + 1e-8)
    z = np.bincount(owner, weights[at] * value, len(rows)) + bias
    check = fold if len(set(labels[fold])) == 2 else np.ones(len(rows), bool)
    slope, shift = _platt(z[check], labels[check])
    return Model(weights * scale, slope, shift + slope * bias)


def _platt(z: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps with Platt's softened targets."""
    good, bad = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    spread = z.std() or 1.0
    x, ab = np.stack([(z - z.mean()) / spread, np.ones_like(z)]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(ab @ x, -30, 30)))
        hess = (x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, x @ (p - target) + 1e-3 * ab * np.array([1, 0]))
        ab = ab - np.clip(step, -2, 2)
    return float(ab[0] / spread), float(ab[1] - ab[0] * z.mean() / spread)


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Model from at most ``sample_rows`` labelled rows, those with the smallest hash of the id.

    An id counts once, with its smaller label and the text of the smallest hash, however often either table repeats it.
    Rows with a null id, label or text are left out. The sample is joined by broadcast (its size is the bound)
    and only its hashed features reach the driver. Empty tables give a constant model.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    sample = known.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("txt")).where("txt is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            rows = [features(t, hasher) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1),
                    pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.float64())),
                ],
                ["mark", "y", "at", "value"],
            )

    joined = texts.join(F.broadcast(sample), "id")
    one = joined.groupBy("id").agg(F.min(F.struct(F.xxhash64("txt").alias("hash"), "txt")).alias("of"), F.min("y").alias("y"))
    joined = one.select(F.xxhash64("id").alias("mark"), "y", F.col("of.txt").alias("txt"))
    table = joined.mapInArrow(run, "mark bigint, y int, at array<bigint>, value array<double>").toArrow()
    got = sorted(
        (
            (m, y, at.values.to_numpy(), value.values.to_numpy())
            for m, y, at, value in zip(table["mark"].to_pylist(), table["y"].to_pylist(), table["at"], table["value"])
        ),
        key=lambda r: (r[0], r[1], len(r[2]), r[3].sum()),
    )
    fold = np.array([(r[0] >> 7) % 4 == 0 for r in got], bool)
    return fit([(r[2], r[3], r[1]) for r in got], fold)


def judge(text: Column, model: Model) -> Column:
    """``struct`` of the base counts and ``prob``, the calibrated probability of a good text. Null counts as empty."""

    @F.arrow_udf("struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,prob:double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        hasher = Hasher()
        for texts in batches:
            rows = [(base_counts(t or b""), model.probability(t or b"", hasher)) for t in texts.cast(pa.binary()).to_pylist()]
            parts = [pa.array([r[0][i] for r in rows], pa.int64()) for i in range(len(names))]
            yield pa.StructArray.from_arrays([*parts, pa.array([r[1] for r in rows], pa.float64())], [*names, "prob"])

    return run(text)
