"""Near copies, connected components and repeated line runs against brute force."""

import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tabulon.llm import line_runs, simhash
from tabulon.llm.graph import components
from tabulon.llm.queries import load
from verify import compare

SMALL = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()


def roots(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(1, i) for i in range(2, 60)]
    pairs = chain[::-1] + star + [(7, 7), (500, 501), (501, 500), (500, 501)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: v for k, v in roots([p for p in pairs if p[0] != p[1]]).items()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_masks_cover_every_pair_of_bits():
    masks = [m & (1 << 64) - 1 for m in simhash.covering_masks()]
    assert all(any(not m & (1 << i | 1 << j) for m in masks) for i in range(64) for j in range(64))


def test_links_keep_every_pair_within_two_bits(spark):
    base = 0x0123456789ABCDEF
    values = {base} | {base ^ 1 << i for i in range(0, 64, 3)} | {base ^ 1 << i ^ 1 << (i * 7 + 5) % 64 for i in range(64)}
    values |= {base ^ 0b10101, base ^ 0xFFFF, 0, 1, 6, (1 << 64) - 1, (1 << 64) - 4}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    table = spark.createDataFrame([(v,) for v in signed], "fp long")
    edges = [(r["a"], r["b"]) for r in simhash.links(table).collect()]
    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
    assert all(near(a, b) for a, b in edges)
    assert roots(edges) == roots([(a, b) for a in signed for b in signed if a < b and near(a, b)])


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op1_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    prints = {i: _fingerprint(t) for i, t in docs.items()}
    linked = roots([(i, i) for i in docs] + [(i, j) for i in docs for j in docs if i < j and (prints[i] ^ prints[j]).bit_count() <= 2])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op1_simhash"](spark, SMALL).collect()}
    assert got == {i: (f"{prints[i]:016x}", linked[i]) for i in docs}


def test_near_copies_of_odd_rows(spark, table):
    schema = "doc_id long, text string, fp string, id int, component string, node long, key string"
    odd = lambda i, t: (i, t, "x", 1, None, 2, "k")
    same = "one two three four five six"
    docs = table(schema, odd(5, None), odd(6, ""), odd(7, " \t\n"), odd(9, same), odd(8, same.upper()), odd(8, same.upper()), odd(None, same), odd(3, "w" * 200_000))
    got = Counter((r["id"], r["component"]) for r in simhash.near_duplicates(docs).collect())
    assert got == Counter([(5, 5), (6, 5), (7, 5), (9, 8), (8, 8), (8, 8), (None, 8), (3, 3)])
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 5, 8]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_first(docs.limit(0)).count() == 0


def test_stage_drops_similar_texts_beyond_two_bits(spark, table):
    import corpus_pipeline

    base = [f"w{i}" for i in range(200)]
    edit = lambda *at: " ".join(f"new{i}" if i in at else w for i, w in enumerate(base))
    texts = {1: " ".join(base), 2: edit(10, 70), 3: edit(20, 90, 150), 4: edit(*range(0, 200, 8)), 5: " ".join(base[:190]), 6: "a few words"}
    prints = {i: _fingerprint(t) for i, t in texts.items()}
    assert all((prints[1] ^ prints[i]).bit_count() > 2 for i in (2, 3, 4))
    docs = table("doc_id long, text string", *texts.items(), (7, None), (8, " "))
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, SMALL).collect()) == [1, 4, 6, 7]
    assert simhash.keep_first(docs.limit(0), alike=0.8).count() == 0


def test_groups_without_any_id_keep_one_row(spark, table):
    same, other = "one two three four five six", "seven eight nine ten eleven twelve"
    docs = table("doc_id long, text string", (None, same), (None, same), (None, other), (4, "a b c d e f"), (None, "a b c d e f"))
    assert Counter(tuple(r) for r in simhash.keep_first(docs).collect()) == Counter([(None, same), (None, other), (4, "a b c d e f")])


def test_fingerprint_of_long_and_short_texts():
    long = " ".join(f"w{i % 997}" for i in range(200_000))
    assert simhash.fingerprint(long[:4000].encode()) & (1 << 64) - 1 == _fingerprint(long[:4000])
    assert len(simhash.shingle_hashes(long.encode(), 3)) == 199_998
    assert [simhash.fingerprint(t) for t in (None, b"", b" \n")] == [0, 0, 0]


@pytest.mark.parametrize("name", ["op4_line_runs", "op8_decontamination", "op10_licence_scan"])
def test_queries_match_sql(spark, name):
    note, ok = compare(spark, SMALL, QUERIES[name], ORACLES[name])
    assert ok, note


def _runs_removed(docs, min_words):
    """Line numbers of every document's later copies, by comparing texts of runs."""
    seen, gone = set(), {}
    for key, text in sorted(docs.items()):
        lines = [(i, x) for i, x in enumerate((text or "").split("\n")) if x.split()]
        for at in range(len(lines)):
            size, words = 0, 0
            while words < min_words and at + size < len(lines):
                words += len(lines[at + size][1].split())
                size += 1
            if words < min_words:
                break
            run = tuple(x for _, x in lines[at : at + size])
            if run in seen:
                gone.setdefault(key, set()).update(i for i, _ in lines[at : at + size])
            seen.add(run)
    return gone


def test_line_runs_of_many_depths(spark, table):
    lines = [f"line {i} of it" for i in range(30)]
    docs = {
        1: "\n".join(lines), 2: "\n".join(["start here now"] + lines[3:20] + ["", "  "] + lines[20:25]),
        3: "\n".join(["a b c d"] * 12), 4: "\n".join(lines[:2]), 5: "", 6: "\n".join(lines[5:9] + ["x y z q"] + lines[9:13]),
        7: "\n".join(lines), 8: "one\n\n" + "\n".join(lines[28:]),
    }
    rows = table("doc_id long, text string, gone string, mark int, seq int", *[(k, v, "g", 1, 2) for k, v in docs.items()], (9, None, "g", 1, 2))
    for min_words in (1, 4, 9, 20, 60, 1000):
        cut = {r["doc_id"]: r for r in line_runs.drop_repeated(rows, min_words=min_words).collect()}
        gone = _runs_removed(docs, min_words)
        assert {k: cut[k]["lines_removed"] for k in docs} == {k: len(gone.get(k, ())) for k in docs}
        assert all(cut[k]["text"] == "\n".join(x for i, x in enumerate(docs[k].split("\n")) if i not in gone.get(k, ())) for k in docs)
        assert cut[9]["text"] is None and cut[9]["gone"] == "g"


def test_line_runs_of_repeated_rows_and_null_ids(spark, table):
    text = "\n".join(f"some words stand in line {i}" for i in range(12))
    docs = table("doc_id long, text string", (1, text), (1, text), (None, text), (2, text), (2, "short"))
    got = Counter((r["doc_id"], r["lines_removed"]) for r in line_runs.drop_repeated(docs).collect())
    assert got == Counter({(None, 0): 1, (1, 12): 2, (2, 12): 1, (2, 0): 1})  # a null id comes first in corpus order
    assert line_runs.drop_repeated(docs.limit(0)).count() == 0
