"""Near-duplicate documents by SimHash fingerprints and covering locality-sensitive hashing.

Every bit position of a 64-bit fingerprint gets one of the seven non-zero vectors of three bits. Table v of the
seven keeps the positions whose vector has an odd product with v. Two differing positions span at most a plane, and
some v is orthogonal to it, so a pair within two bits agrees on all kept positions of that table: no pair is missed.

A bucket of two fingerprints is compared from its minimum and maximum. In a larger bucket every member is
posted under itself and under each fingerprint one flip away (flips of positions that vary in the bucket only).
Members that share such a posting are within two bits, and every pair within two bits shares one, so the links
of a bucket come out exactly from a number of rows in proportion to its members, not to their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from tabulon.llm import similar
from tabulon.llm.graph import components
from tabulon.scale.storage import materialize

BITS = 64
RADIUS = 2
SEED = 42
_CHUNK = 1 << 16  # shingles whose bits are unpacked at once


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words, repeats included; of all words if there are fewer."""
    words = text.lower().split()  # on bytes: A-Z only, and the six ASCII white space characters only
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    spans = zip(starts[: 1 - width].tolist() if width > 1 else starts.tolist(), ends[width - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[i:j], SEED) for i, j in spans), np.uint64, len(words) - width + 1)


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """Bits set in more than half of the shingle hashes, as a signed 64-bit number; 0 without words."""
    hashes = shingle_hashes(text or b"", width)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint_udf(width: int = 3):
    @F.arrow_udf("bigint")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([fingerprint(t, width) for t in texts.cast(pa.binary()).to_pylist()], pa.int64())

    return run


def covering_masks(radius: int = RADIUS) -> list[int]:
    """Signed 64-bit masks, such that two fingerprints within ``radius`` bits agree under at least one."""
    vectors = range(1, 1 << (radius + 1))
    masks = []
    for v in vectors:
        bits = sum(1 << i for i in range(BITS) if ((i % len(vectors) + 1) & v).bit_count() % 2)
        masks.append(bits - (1 << BITS) if bits >> (BITS - 1) else bits)
    return masks


def links(fingerprints: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` that connect all pairs of distinct ``fp`` values within two bits."""
    keyed = fingerprints.select(
        "fp",
        F.explode(F.array(*[
            F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
            for t, m in enumerate(covering_masks())
        ])).alias("at"),
    ).select("fp", "at.t", "at.key")
    buckets = (
        keyed.groupBy("t", "key")
        .agg(
            F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"),
            F.expr("bit_or(fp) ^ bit_and(fp)").alias("free"),
        )
        .where("n > 1")
    )
    buckets = materialize(buckets, "buckets")
    two = buckets.where(f"n = 2 and bit_count(lo ^ hi) <= {RADIUS}").select(F.col("hi").alias("a"), F.col("lo").alias("b"))
    crowded = keyed.join(buckets.where("n > 2").select("t", "key", "free"), ["t", "key"])
    flips = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.expr("free").bitwiseAND(_bit(i)) != 0),
        lambda i: F.col("fp").bitwiseXOR(_bit(i)),
    )
    posted = crowded.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("near"))
    shared = posted.groupBy("near").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)  # at most 65
    stars = shared.select(F.explode("all").alias("a"), F.array_min("all").alias("b")).where("a != b")
    return two.unionByName(stars).distinct()


def _bit(i):
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, alike: float | None = None) -> DataFrame:
    """``(id, fp, component, root, mark)`` for every row: ``component`` is the smallest id linked to it, directly or in steps.

    ``root`` is a fingerprint that names the component whatever its ids, ``mark`` a hash of the text.

    With ``alike``, texts whose five-word shingles have at least that Jaccard coefficient are linked as well.
    Texts without words (null, empty, white space only) have fingerprint 0, which links like any other. A row
    with a null id keeps its row; ids that are null never name a component unless all of its ids are null.
    Repeated rows give repeated results. Other columns are not read. An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("txt"))
    columns = ["id", fingerprint_udf(width)("txt").alias("fp"), F.xxhash64("txt").alias("mark")]
    if alike is not None:
        columns += [F.xxhash64("id").alias("tag"), similar.band_keys_udf()("txt").alias("keys")]
    signed = materialize(texts.select(*columns), "fingerprints")
    distinct = materialize(signed.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    edges = links(distinct.select("fp"))
    if alike is not None:
        marked = texts.select(F.xxhash64("txt").alias("mark"), F.xxhash64("id").alias("tag"), "txt")
        edges = edges.unionByName(similar.similar_links(signed, marked, threshold=alike))
    grouped = components(edges)
    firsts = distinct.join(grouped, distinct["fp"] == grouped["node"])
    smallest = firsts.groupBy("root").agg(F.min("first").alias("least"))
    linked = grouped.join(smallest, "root").select(F.col("node").alias("fp"), "least", "root")
    names = [F.coalesce("least", "first").alias("component"), F.coalesce("root", "fp").alias("root")]
    classes = distinct.join(linked, "fp", "left").select("fp", *names)
    classes = materialize(classes, "classes")  # so that the next join reads two plain shuffles and can split a hot one
    return signed.join(classes, "fp").select("id", "fp", "component", "root", "mark")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, alike: float | None = None) -> DataFrame:
    """One row of ``docs`` of each group: the one with the smallest id, of those with that id the one of the smallest text hash.

    Ids need not be unique: rows with one id and unlinked texts are groups of their own. A null id counts as the
    greatest, so a row without id stays only where its whole group has none. Of equal rows one stays.
    """
    marked = near_duplicates(docs, id_col, text_col, width, alike)
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "mark")).alias("first")
    kept = marked.groupBy("root").agg(first).select(F.col("first.id").alias("__id"), F.col("first.mark").alias("__mark"))
    # Survivors grow with the data: no broadcast. Each has an id and hash of its own, so no key is hot but by equal rows.
    named = docs.withColumn("__hash", F.xxhash64(text_col))
    named = named.join(kept.hint("merge"), named[id_col].eqNullSafe(kept["__id"]) & (named["__hash"] == kept["__mark"]))
    plain = [f.name for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    order = W.partitionBy(id_col, "__hash").orderBy(F.xxhash64(*plain))
    return named.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").select(*docs.columns)
