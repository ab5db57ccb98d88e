"""Trie of conversation prefixes with count-min screening.

The digest of a prefix is the sum of the hashes of its turns and their places, so that it comes from a running sum
and two prefixes of one depth are equal if their digests are. A count-min sketch over all digests never counts too few:
an estimate of one proves that no other conversation has the prefix, nor any longer one. Such tails become nodes where
they are; only prefixes that may be shared are shuffled and grouped by depth and digest.

Sums over subtrees use members instead of a walk: every node counts for its smallest member, a sum from the last shared turn of that
conversation back to each of its prefixes collects the nodes it counts for, and the sums of a node's members add up to its subtree.
Depth never costs a pass, and no conversation or node is gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabulon.scale.ordering import row_index, running
from tabulon.scale.skew import attach, hot_keys
from tabulon.scale.storage import materialize

SKETCH_ROWS = 3
LEAST_WIDTH, MOST_WIDTH = 1 << 16, 1 << 24  # cells of a sketch row; the widest takes SKETCH_ROWS * 2 MB in a worker
HEAD_TURNS = 4  # a rebuilt conversation borrows fewer turns than this
FAMILY = 20
PIECE = 4096  # ids joined to one string before they are hashed
KEY = ["depth", "p", "q"]
_WORDS = r"[^\x20\x09-\x0D]+"


def numbered(turns: DataFrame) -> DataFrame:
    """``(conv_id, nth, a, b, words)``: place from 0 in order of turn, 120 bits of the turn's hash, words of its text.

    Null roles and texts count as empty. Null turns come first, ties go by the hash of role and text. Rows without
    conv_id belong to no conversation and are left out. Other columns are not read. An empty table gives an empty result.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    mark = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    part = lambda at: F.conv(F.substring(mark, at, 15), 16, 10).cast("long")
    slim = turns.where("conv_id is not null").select(
        "conv_id", "turn", part(1).alias("a"), part(16).alias("b"), F.regexp_count(text, F.lit(_WORDS)).cast("long").alias("words")
    )
    order = [F.col("turn").asc_nulls_first(), "a", "b"]
    counted = running(slim, ["conv_id"], order, sums={"upto": F.lit(1)})
    return counted.select("conv_id", (F.col("upto") - 1).alias("nth"), "a", "b", "words")


def borrowed(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its family: the CRC-32 of its decimal id, modulo 4."""
    return (F.crc32(conv.cast("string").cast("binary")) % HEAD_TURNS).cast("long")


def rebuilt(turns: DataFrame) -> DataFrame:
    """``(conv_id, depth, a, b, words, n)`` of conversations whose first turns are those of ``conv_id - conv_id % 20``.

    The row of depth 0 stands for the conversation itself, so one without turns has a row as well; ``n`` is its length.
    """
    lengths = materialize(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "lengths")
    convs = lengths.withColumn("h", borrowed(F.col("conv_id"))).withColumn("donor", F.col("conv_id") - F.col("conv_id") % FAMILY)
    donors = lengths.select(F.col("conv_id").alias("donor"), F.col("n").alias("has"))
    known = convs.join(donors, "donor", "left").withColumn("lent", F.least("h", F.coalesce("has", F.lit(0))))
    known = materialize(
        known.select("conv_id", "donor", "h", "lent", (F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")), "known"
    )
    own = turns.where(F.col("nth") >= borrowed(F.col("conv_id"))).join(known.select("conv_id", "h", "lent", "size"), "conv_id")
    own = own.select("conv_id", (F.col("nth") - F.col("h") + F.col("lent") + 1).alias("depth"), "a", "b", "words", F.col("size").alias("n"))
    heads = turns.where(F.col("nth") < HEAD_TURNS - 1).where(F.col("conv_id") % FAMILY == 0).withColumnRenamed("conv_id", "donor")
    lent = known.where("lent > 0").select("conv_id", "donor", "lent", "size").join(heads, "donor").where("nth < lent")
    lent = lent.select("conv_id", (F.col("nth") + 1).alias("depth"), "a", "b", "words", F.col("size").alias("n"))
    zero = F.lit(0).cast("long")
    roots = known.select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("words"), F.col("size").alias("n"))
    return roots.unionByName(own).unionByName(lent)


def prefixes(rows: DataFrame) -> DataFrame:
    """Adds the digest ``p, q`` of every prefix and ``pp, pq``, that of the prefix one turn shorter."""
    wide = "decimal(20,0)"
    term = lambda seed: F.when(F.col("depth") > 0, F.xxhash64(F.lit(seed), "depth", "a", "b")).otherwise(F.lit(0).cast("long")).cast(wide)
    termed = rows.select("conv_id", "depth", "words", "n", term(1).alias("t"), term(2).alias("u"))
    summed = running(termed, ["conv_id"], ["depth"], sums={"sp": F.col("t"), "sq": F.col("u")})
    # Any one-to-one form of the sums will do; two 64-bit hashes of both are short.
    digest = lambda seed, *c: F.xxhash64(F.lit(seed), *[x.cast("decimal(38,0)") for x in c])
    now, before = (F.col("sp"), F.col("sq")), (F.col("sp") - F.col("t"), F.col("sq") - F.col("u"))
    return materialize(
        summed.select(
            "conv_id", "depth", "words", "n", digest(1, *now).alias("p"), digest(2, *now).alias("q"),
            digest(1, *before).alias("pp"), digest(2, *before).alias("pq"),
        ),
        "prefixes",
    )


def _cells(p: np.ndarray, q: np.ndarray, depth: np.ndarray, width: int) -> list[np.ndarray]:
    """Cell of every prefix in each row of the sketch: double hashing of its digest."""
    p, q, depth = p.view(np.uint64), q.view(np.uint64), depth.astype(np.uint64)
    with np.errstate(over="ignore"):
        step = (q ^ (depth * np.uint64(0x9E3779B97F4A7C15))) | np.uint64(1)
        return [(((p + np.uint64(r) * step) >> np.uint64(17)) % np.uint64(width)).astype(np.int64) for r in range(SKETCH_ROWS)]


def crowded_cells(rows: DataFrame, width: int) -> np.ndarray:
    """Bits of a count-min sketch: set where a cell counts two or more prefixes.

    Tasks send the counts of their cells, at most SKETCH_ROWS * width each; the driver gets the crowded cells only,
    as bits packed by 64, at most SKETCH_ROWS * width / 64 rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SKETCH_ROWS * width, np.uint8)  # 0, 1 or 2, which stands for more
        for batch in batches:
            p, q, depth = (batch.column(n).to_numpy() for n in ("p", "q", "depth"))
            for r, cells in enumerate(_cells(p, q, depth, width)):
                at, n = np.unique(cells + r * width, return_counts=True)
                seen[at] = np.minimum(seen[at] + np.minimum(n, 2), 2)
        at = np.flatnonzero(seen)
        for low in range(0, len(at), 1 << 16):
            part = at[low : low + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(seen[part].astype(np.int64))], ["cell", "n"])

    counts = rows.select("p", "q", "depth").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("cell") % 64).cast("int"))
    words = counts.where("n > 1").groupBy(F.floor(F.col("cell") / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))
    table = words.toArrow()
    bits = np.zeros(-(-SKETCH_ROWS * width // 64), "<i8")
    bits[table["word"].to_numpy()] = table["bits"].to_numpy()
    return bits


def sketch_width(n_prefixes: int) -> int:
    """Four cells a prefix, within the bounds that keep the sketch small enough for every worker.

    Beyond MOST_WIDTH cells the sketch fills up and proves less: more prefixes are grouped exactly, none is lost.
    """
    return min(MOST_WIDTH, max(LEAST_WIDTH, 1 << (4 * n_prefixes - 1).bit_length()))


def screened(rows: DataFrame, width: int | None = None) -> DataFrame:
    """Adds ``alone``: the sketch proves that no other conversation has this prefix, or a shorter one of it."""
    width = width or sketch_width(rows.count())
    shared = rows.sparkSession.sparkContext.broadcast(crowded_cells(rows, width).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowded = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            p, q, depth = (batch.column(n).to_numpy() for n in ("p", "q", "depth"))
            alone = np.zeros(batch.num_rows, bool)
            for r, cells in enumerate(_cells(p, q, depth, width)):
                at = cells + r * width
                alone |= (crowded[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(alone)], [*batch.schema.names, "proved"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    proved = materialize(rows.mapInArrow(run, f"{kinds}, proved boolean"), "proved")
    first = proved.where("proved").groupBy("conv_id").agg(F.min("depth").alias("cut"))
    # One row per conversation; adaptive execution splits the rows of a long one.
    return materialize(proved.join(first, "conv_id", "left").withColumn("alone", F.coalesce(F.col("depth") >= F.col("cut"), F.lit(False))), "screened")


def _ends_hashes(members: DataFrame) -> DataFrame:
    """``(depth, p, q, ends_sha256)`` for nodes at which conversations end, ids joined in pieces and then hashed in order."""
    ends = row_index(members.where("depth = n").select(*KEY, "conv_id"), [*KEY, "conv_id"], "at")
    piece = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy(*KEY, F.floor(F.col("at") / PIECE).alias("nth")).agg(piece.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        row = lambda: pa.RecordBatch.from_arrays([*[pa.array([k], pa.int64()) for k in key], pa.array([sha.hexdigest()])], [*KEY, "ends_sha256"])
        for batch in batches:
            for *k, ids in zip(*(batch.column(n).to_pylist() for n in [*KEY, "ids"])):
                if k != key:
                    if key is not None:
                        yield row()
                    key, sha = k, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
        if key is not None:
            yield row()

    ordered = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "nth")
    return ordered.mapInArrow(run, "depth long, p long, q long, ends_sha256 string")


def trie(rows: DataFrame, width: int | None = None) -> DataFrame:
    """Nodes of the trie of ``rows(conv_id, depth, a, b, words, n)``, one row of depth 0 for each conversation.

    Returns ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``. An empty table gives an empty result. ``width`` sets the cells of a sketch row; results do not depend on it.
    """
    marked = screened(prefixes(rows), width)
    no_ids = F.sha2(F.lit(""), 256)
    tails = marked.where("alone")
    edges = tails.where("depth = cut").select("conv_id", "depth", "pp", "pq")
    members = marked.where("not alone").select("conv_id", *KEY, "pp", "pq", "words", "n")
    one = [F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("rep")]
    groups = materialize(members.groupBy(*KEY).agg(*one, F.any_value("words").alias("words"), F.any_value("pp").alias("pp"), F.any_value("pq").alias("pq")), "groups")
    links = groups.select("depth", "pp", "pq").unionByName(edges.select("depth", "pp", "pq")).where("depth > 0")
    kids = links.groupBy((F.col("depth") - 1).alias("depth"), F.col("pp").alias("p"), F.col("pq").alias("q")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(groups.join(kids, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")

    # Every conversation has the root, and many share a first turn: rows of such hot nodes are salted.
    known = nodes.select(*KEY, "rep", "n_convs", "n_children")
    joined = materialize(attach(members, known, KEY, hot=hot_keys(members, KEY)), "members")
    own = F.col("rep") == F.col("conv_id")
    weights = joined.select(
        "conv_id", *KEY, F.when(own, (F.col("n_convs") - 1) * F.col("words")).otherwise(0).alias("weight"),
        F.when(own & (F.col("n_children") == 0), 1).otherwise(0).cast("long").alias("leaf"),
    )
    none, zero, lone = F.lit(None).cast("long"), F.lit(0).cast("long"), F.lit(1).cast("long")
    cut = edges.select("conv_id", "depth", none.alias("p"), none.alias("q"), zero.alias("weight"), lone.alias("leaf"))
    back = running(weights.unionByName(cut), ["conv_id"], [F.col("depth").desc()], sums={"saved_tokens": F.col("weight"), "n_leaves": F.col("leaf")})
    sums = back.where("p is not null").groupBy(*KEY).agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))

    shared = nodes.join(sums, KEY).join(_ends_hashes(members), KEY, "left").select(
        F.col("rep").alias("conv_id"), "depth", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", no_ids).alias("ends_sha256"), (F.col("depth") > 0).alias("asks"),
    )
    alone = tails.select(
        "conv_id", "depth", F.lit(1).cast("long").alias("n_convs"), F.when(F.col("depth") < F.col("n"), 1).otherwise(0).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("depth") < F.col("n"), no_ids).otherwise(F.sha2(F.col("conv_id").cast("string"), 256)).alias("ends_sha256"),
        (F.col("depth") == F.col("cut")).alias("asks"), 
    )
    inner = alone.where("not asks").select(*[c for c in alone.columns if c != "asks"], F.col("conv_id").alias("parent_conv_id"))
    asking = shared.unionByName(alone.where("asks"))
    # A parent is the node of the same conversation one turn before: one row for each key on both sides.
    parents = joined.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("rep").alias("parent_conv_id"))
    asked = asking.drop("asks").join(parents, ["conv_id", "depth"], "left")
    return asked.unionByName(inner)
