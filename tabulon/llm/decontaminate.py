"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` stores postings of every training token. The corpus is split by document into segments of about
half a million words, as search engines do; a row of the index is one segment: its terms (sorted 64-bit hashes),
how long the posting list of each term is, and the positions, each as bytes. Row groups hold a few segments, for a
Parquet writer buffers, and a reader decodes, a whole one at a time. Documents lie one behind the other in the position
space with one empty place between them, so no phrase crosses from one into the next.

A query set is taken in blocks of a fixed number of words. Every segment looks its windows up: windows with an
absent term are out at once, the others start from their rarest term and intersect the offset-adjusted lists of the
next rarest until nothing is left or all terms agree. No posting is shuffled; only hits leave a segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tabulon.scale.ordering import running
from tabulon.scale.storage import materialize, scratch_path

WINDOW = 13
SEGMENT_WORDS = 500_000
# A row is megabytes long, so the writer looks at the size of its pages and row groups after every row, not after a hundred.
STORED = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
BLOCK_WORDS = 200_000  # words of the query set that go to the executors at once
# Words are runs of 0-9, a-z (after A-Z went to lower case) and bytes from 0x80 on; everything else separates.
_SEPARATE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(_SEPARATE).split()


def _hash_terms(terms: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(t) for t in terms), np.uint64, len(terms)).view(np.int64)


def _planes(values: np.ndarray) -> bytes:
    """32-bit numbers as bytes: all lowest ones, then the next; the higher ones hardly vary and compress well."""
    return values.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()


class _Segment:
    """Postings of the documents gathered so far."""

    def __init__(self):
        self.local: dict[bytes, int] = {}
        self.docs, self.marks, self.sizes, self.bases, self.parts, self.end = [], [], [], [], [], 0

    def add(self, doc, mark: int, text: bytes | None) -> None:
        words = words_of(text)
        known = self.local
        codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))
        self.docs.append(doc), self.marks.append(mark), self.sizes.append(len(words)), self.bases.append(self.end)
        self.parts.append(codes)
        self.end += len(words) + 1

    def row(self, name: str, id_type: pa.DataType) -> pa.RecordBatch:
        codes = np.concatenate(self.parts)
        place = np.concatenate([np.arange(b, b + n, dtype=np.int32) for b, n in zip(self.bases, self.sizes)])
        hashes = _hash_terms(list(self.local))
        by_hash = np.argsort(hashes)
        rank = np.empty(len(hashes), np.int32)
        rank[by_hash] = np.arange(len(hashes), dtype=np.int32)
        order = np.argsort(rank[codes], kind="stable")
        counts = np.bincount(rank[codes], minlength=len(hashes))
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([name]), one(self.docs, id_type), one(self.marks, pa.int64()), one(self.sizes, pa.int64()),
                *[pa.array([b], pa.binary()) for b in (_planes(np.array(self.bases)), hashes[by_hash].tobytes(), _planes(counts), _planes(place[order]))],
            ],
            ["seg", "docs", "marks", "sizes", "bases", "terms", "counts", "places"],
        )


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Stored index of all rows, one row per segment. A document is never split over segments."""
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("txt"))
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, segment = TaskContext.get().partitionId(), 0, _Segment()
        for batch in batches:
            id_type = batch.column(0).type
            texts = batch.column(2).cast(pa.binary())
            for at in range(batch.num_rows):
                segment.add(batch.column(0)[at].as_py(), batch.column(1)[at].as_py(), texts[at].as_py())
                if segment.end >= segment_words:
                    yield segment.row(f"{task}-{made}", id_type)
                    made, segment = made + 1, _Segment()
        if segment.docs:
            yield segment.row(f"{task}-{made}", id_type)

    schema = (
        f"seg string, docs array<{kind}>, marks array<bigint>, sizes array<bigint>, bases binary, "
        "terms binary, counts binary, places binary"
    )
    return materialize(texts.mapInArrow(run, schema), "postings", STORED)


@dataclass
class Block:
    """A part of the query set: words of all items in a row, as numbers of distinct terms."""

    names: list[str]
    terms: np.ndarray  # hashes of the distinct terms
    words: np.ndarray  # numbers into terms
    ends: np.ndarray  # end of each item in words


def query_table(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The query set as a stored table ``(block, name, text)``: blocks of at least one item and about ``block_words`` words.

    Items without words are left out, a null id goes by the empty name.
    """
    words = F.regexp_count(F.lower(text_col), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.col(text_col).alias("text"), words.alias("words"))
    counted = running(rows.where("words > 0"), [], [F.xxhash64("name", "text"), "name", "text"], sums={"upto": F.col("words")})
    block = F.floor((F.col("upto") - F.col("words")) / block_words)  # by the words before an item
    return materialize(counted.select(block.alias("block"), "name", "text"), "queries")


def query_blocks(queries: DataFrame) -> Iterator[Block]:
    """Blocks of a stored query table, each read when its turn comes: one at a time is in the driver's memory."""
    for row in queries.groupBy("block").count().select("block").orderBy("block").toLocalIterator():
        names, local, codes, ends = [], {}, [], []
        table = queries.where(F.col("block") == row["block"]).orderBy("name", "text").toArrow()
        for name, text in zip(table["name"].to_pylist(), table["text"].to_pylist()):
            names.append(name)
            codes += [local.setdefault(w, len(local)) for w in words_of(text.encode())]
            ends.append(len(codes))
        yield Block(names, _hash_terms(list(local)), np.array(codes, np.int32), np.array(ends))


def windows_of(block: Block, width: int) -> dict[tuple[int, ...], list[int]]:
    """Distinct windows (term numbers) with the items that hold them; an item shorter than ``width`` is one window."""
    found: dict[tuple[int, ...], list[int]] = {}
    for item, (lo, hi) in enumerate(zip(np.r_[0, block.ends[:-1]].tolist(), block.ends.tolist())):
        words = block.words[lo:hi].tolist()
        for at in range(max(1, len(words) - width + 1)):
            held = found.setdefault(tuple(words[at : at + width]), [])
            if not held or held[-1] != item:
                held.append(item)
    return found


class _Postings:
    """One stored segment, seen from the terms of one block."""

    def __init__(self, row: dict, terms: np.ndarray):
        self.bases = row["bases"]
        self.starts, self.places = row["starts"], row["places"]
        at = np.searchsorted(row["terms"], terms)
        safe = np.minimum(at, max(len(row["terms"]) - 1, 0))
        there = row["terms"][safe] == terms if len(row["terms"]) else np.zeros(len(terms), bool)
        self.local = np.where(there, safe, -1).tolist()
        self.count = np.where(there, self.starts[safe + 1] - self.starts[safe], 0).tolist() if len(row["terms"]) else [0] * len(terms)

    def list_of(self, term: int) -> np.ndarray:
        at = self.local[term]
        return self.places[self.starts[at] : self.starts[at + 1]]

    def phrase(self, terms: tuple[int, ...]) -> np.ndarray:
        """Start positions of the exact phrase: intersect from the rarest term on."""
        count = self.count
        if not all(count[t] for t in terms):
            return np.empty(0, np.int32)
        order = sorted(range(len(terms)), key=lambda i: count[terms[i]])
        starts = self.list_of(terms[order[0]]) - order[0]
        for i in order[1:]:
            held = self.list_of(terms[i])
            wanted = starts + i
            at = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
            starts = starts[held[at] == wanted]
            if not len(starts):
                break
        return starts

    def near(self, terms: tuple[int, ...], within: int) -> np.ndarray:
        """Positions of the rarest term that have every other term of the window within ``within`` words."""
        count, wanted = self.count, set(terms)
        if not all(count[t] for t in wanted):
            return np.empty(0, np.int32)
        order = sorted(wanted, key=lambda t: count[t])
        anchors = self.list_of(order[0])
        owner = np.searchsorted(self.bases, anchors, side="right")
        low = np.maximum(anchors - within, self.bases[owner - 1])
        high = np.minimum(anchors + within, np.r_[self.bases[1:], np.iinfo(np.int32).max][owner - 1] - 1)
        keep = np.ones(len(anchors), bool)
        for t in order[1:]:
            held = self.list_of(t)
            keep &= np.searchsorted(held, low) < np.searchsorted(held, high, side="right")
        return anchors[keep]


_HIT = "seg string, row int, starts array<int>, ends array<int>, items array<string>"


def _segments(batch: pa.RecordBatch) -> Iterator[dict]:
    names = batch.schema.names
    for at in range(batch.num_rows):
        row = {n: batch.column(names.index(n))[at].as_py() for n in names}
        row |= {n: _from_planes(row[n]) for n in ("bases", "counts", "places")}
        row["terms"] = np.frombuffer(row["terms"], np.int64)
        row["starts"] = np.concatenate([[0], np.cumsum(row.pop("counts"))])
        yield row


def _search(index: DataFrame, block: Block, width: int, within: int | None) -> DataFrame:
    """Spans (document positions, end exclusive) and items per document with a match in ``block``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = windows_of(block, width)
        for batch in batches:
            for row in _segments(batch):
                postings, found = _Postings(row, block.terms), {}
                for terms, items in windows.items():
                    places = postings.phrase(terms) if within is None else postings.near(terms, within)
                    if len(places):
                        owner = np.searchsorted(row["bases"], places, side="right") - 1
                        size = len(terms) if within is None else 1
                        for doc, place in zip(owner.tolist(), (places - row["bases"][owner]).tolist()):
                            spans, held = found.setdefault(doc, ([], set()))
                            spans.append((place, place + size))
                            held.update(items)
                if found:
                    joined = {doc: (_union(spans), held) for doc, (spans, held) in found.items()}
                    yield pa.RecordBatch.from_pydict(
                        {
                            "seg": [row["seg"]] * len(joined),
                            "row": pa.array(list(joined), pa.int32()),
                            "starts": pa.array([[a for a, _ in s] for s, _ in joined.values()], pa.list_(pa.int32())),
                            "ends": pa.array([[b for _, b in s] for s, _ in joined.values()], pa.list_(pa.int32())),
                            "items": pa.array([[block.names[i] for i in sorted(h)] for _, h in joined.values()], pa.list_(pa.string())),
                        }
                    )

    return index.select("seg", "bases", "terms", "counts", "places").mapInArrow(run, _HIT)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _covered(starts: str, ends: str) -> Column:
    @F.arrow_udf("bigint")
    def run(starts: pa.Array, ends: pa.Array) -> pa.Array:
        pairs = zip(starts.to_pylist(), ends.to_pylist())
        return pa.array([sum(b - a for a, b in _union(list(zip(s or (), e or ())))) for s, e in pairs], pa.int64())

    return run(starts, ends)


def contamination(index: DataFrame, items: DataFrame, item_col: str = "item_id", item_text: str = "text", width: int = WINDOW, within: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(id, mark, n_words, n_hit, items)`` for every indexed row.

    ``n_hit`` counts words inside any occurrence of a window of ``width`` words of an item (an item with fewer
    words is one window), ``items`` holds the ids of the items with an occurring window, once each, sorted as text.
    With ``within`` a window matches where all its terms lie within that many words of its rarest one, in any
    order; ``n_hit`` then counts those places. Null texts have no words. Items without words match nothing, an
    item with a null id goes by the empty name, repeated items count once. ``mark`` is the hash of the text.
    """
    flat = "filter(flatten(collect_list({0})), x -> x is not null)"
    listed = index.select("seg", F.posexplode(F.arrays_zip("docs", "marks", "sizes")).alias("row", "doc")).select(
        "seg", "row", F.col("doc.docs").alias("id"), F.col("doc.marks").alias("mark"), F.col("doc.sizes").alias("n_words")
    )
    # Blocks are searched one after the other, and the hits of each are stored before the next is read.
    spark, path = index.sparkSession, scratch_path(index.sparkSession, "hits")
    # The first, empty part is no list of Python rows, which would start further Python workers on every executor.
    spark.range(0).selectExpr(*["CAST(NULL AS {1}) AS {0}".format(*c.split()) for c in _HIT.split(", ")]).write.parquet(path)
    # They are few, so they move into few files: else each block would leave one for every file of the index.
    for block in query_blocks(query_table(items, item_col, item_text, block_words)):
        _search(index, block, width, within).hint("rebalance").write.mode("append").parquet(path)
    merged = (
        spark.read.schema(_HIT).parquet(path)
        .groupBy("seg", "row")
        .agg(*[F.expr(flat.format(c)).alias(c) for c in ("starts", "ends", "items")])
        .select("seg", "row", _covered("starts", "ends").alias("hit"), F.array_sort(F.array_distinct("items")).alias("items"))
    )
    return listed.join(merged, ["seg", "row"], "left").select(
        "id", "mark", "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def is_contaminated():
    """At least a word is hit, and the hit words make up a twentieth or more."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated rows. Rows are told apart by id and text, null ids included."""
    found = contamination(build_index(docs, id_col, text_col), items)
    bad = found.where(is_contaminated()).select(F.col("id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    same = docs[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text_col]) == F.col("__mark"))
    return docs.join(bad, same, "left_anti")
