"""Decontamination, sharding, mixing and the pipeline against brute force."""

import heapq
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabulon.llm import decontaminate, language, mixing, shards, simhash
from tabulon.llm.queries import load

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
QUERIES, _ = load()
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated(docs, items):
    windows = defaultdict(set)
    for name, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add(str(name) if name is not None else "")
    sizes, out = {len(w) for w in windows}, []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[tuple(w[i : i + size])]
        out.append((key, len(w), len(hit), tuple(sorted(found))))
    return Counter(out)


@pytest.mark.parametrize("segment,block", [(10, 3), (40, 30), (500_000, 200_000)])
def test_decontamination_of_odd_rows(spark, table, segment, block):
    item = " ".join(f"t{i}" for i in range(20))
    items = [(1, item), (2, "short one"), (3, None), (4, " .,- "), (None, "T3 t4"), (2, "short one"), (5, "Ünïcode wörds")]
    docs = [(1, item.upper()), (2, None), (3, ""), (4, "a short-one, b"), (5, " ".join(f"t{i}" for i in range(12))), (6, "x " * 50 + item), (None, "t3 t4 t3 t4"), (4, "a short-one, b"), (7, "short"), (8, "one short"), (9, "ünïcode wörds ünïcode")]
    table_docs = table("doc_id long, text string, mark long, items string, seg string, hit int", *[(*d, 1, "i", "s", 2) for d in docs])
    table_items = table("item_id long, text string, doc_id long", *[(*i, 1) for i in items])
    index = decontaminate.build_index(table_docs, segment_words=segment)
    got = decontaminate.contamination(index, table_items, block_words=block).collect()
    assert Counter((r["id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == contaminated(docs, items)
    clean = decontaminate.drop_contaminated(table_docs, table_items)
    assert clean.columns == table_docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [2, 3, 7, 8, 9]  # only A-Z goes to lower case
    assert decontaminate.drop_contaminated(table_docs.limit(0), table_items).count() == 0
    assert decontaminate.drop_contaminated(table_docs, table_items.limit(0)).count() == len(docs)


def test_proximity_matches(spark, table):
    docs = table("doc_id long, text string", (1, "alpha x x gamma beta"), (2, "alpha x x x x x x beta gamma"), (3, "alpha beta"), (4, "gamma"), (5, "alpha beta"))
    items = table("item_id long, text string", (1, "alpha beta gamma"))
    got = {r["id"]: r["n_hit"] for r in decontaminate.contamination(decontaminate.build_index(docs), items, within=4).collect()}
    assert got == {1: 1, 2: 0, 3: 0, 4: 0, 5: 0}  # never across the border of two documents


def _least_capacity(sizes, parts):
    def need(c):
        n, a = 1, 0
        for s in sizes:
            if s > c:
                return len(sizes) + 1
            n, a = (n + 1, s) if a + s > c else (n, a + s)
        return n

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if need(mid) <= parts else (mid + 1, high)
    return low


def test_op7_is_a_minimax_partition_of_groups(spark):
    rows = QUERIES["op7_sharding"](spark, MIDDLE).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    where, sizes, groups, slots = {}, Counter(), {}, defaultdict(list)
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), None)
        assert where.setdefault(data, r["shard"]) == r["shard"]
        groups[data] = groups.get(data, 0) + r["size"]
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))
    total, left, rest = sum(groups.values()), 40, dict(groups)
    for data, size in sorted(groups.items(), key=lambda g: -g[1]):
        if left > 1 and size * left > total:
            total, left = total - size, left - 1
            del rest[data]
    assert max(sizes[s] for s in range(left)) == _least_capacity(list(rest.values()), left)


def test_shards_of_odd_rows(spark, table):
    schema = "doc_id long, text string, shard string, size string, key int, slot string, bytes int"
    texts = [(1, None), (2, ""), (3, "same"), (4, "same"), (4, "same"), (None, "é" * 1000), (6, "x" * 100_000), (7, "y")]
    docs = table(schema, *[(*t, "s", "z", 1, "o", 2) for t in texts])
    for n in (1, 2, 3, 40):
        got = shards.shard_rows(docs, n).collect()
        place = {r["id"]: r["shard"] for r in got}
        assert len(got) == len(texts) and place[1] == place[2] and place[3] == place[4] and set(place.values()) <= set(range(n))
        for s in set(place.values()):
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
        wide = shards.with_shards(docs, n)
        assert set(wide.columns) == set(docs.columns) and {r["doc_id"]: r["shard"] for r in wide.collect()} == place
    assert shards.shard_rows(docs.limit(0), 4).count() == 0
    with pytest.raises(ValueError):
        shards.shard_rows(docs, 0)


@pytest.mark.parametrize("weights", [{"a": 0.5, **{f"s{i}": 0.01 for i in range(50)}}, {"a": 0.9, "b": 0.1}, {"a": 1 / 3, "b": 2 / 3}, {"a": 1e-9, "b": 1}, {"a": 1}])
def test_one_period_keeps_every_source_within_a_block(weights):
    quota = mixing.quotas(weights, 100)
    assert sum(quota.values()) == 100 and min(quota.values()) >= 1
    given = Counter()
    for s, j, slot in mixing.one_period(quota):
        assert j == given[s] and j * 100 // quota[s] <= slot < -(-(j + 1) * 100 // quota[s])
        given[s] += 1
        assert all(abs(100 * given[x] - quota[x] * (slot + 1)) < 100 for x in quota)
    with pytest.raises(ValueError):
        mixing.quotas({str(i): 1 for i in range(101)}, 100)


def _whole_schedule(blocks, quota, period):
    """Slots by a plain simulation over all blocks, until a due source has none left."""
    done, out, slot = Counter(), {}, 0
    while True:
        ready = [(-(-(done[s] + 1) * period // quota[s]), s) for s in quota if done[s] * period // quota[s] <= slot]
        _, s = min(ready)
        if done[s] == blocks[s]:
            return out
        out[s, done[s]] = slot
        done[s] += 1
        slot += 1


def test_mix_of_a_table_equals_a_simulation(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("case when id % 3 = 0 then 'big' when id % 7 = 1 then null else concat('s', id % 5) end").alias("source"), F.lit(1).alias("slot"))
    rows = mixing.mix(docs, block_rows=4, period=100).collect()
    counts = Counter(r["source"] for r in rows)
    quota = mixing.quotas({s: n**mixing.TEMPER for s, n in counts.items()}, 100)
    want = _whole_schedule({s: -(-n // 4) for s, n in counts.items()}, quota, 100)
    chosen = {(r["source"], r["block"]): r["slot"] for r in rows if r["selected"]}
    assert len(rows) == 3000 and chosen == want
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in rows)
    assert Counter(Counter((r["source"], r["block"]) for r in rows).values())[4] >= 3000 // 4 - len(counts)


def test_mix_of_odd_rows(spark, table):
    docs = table("doc_id long, source string, block int, slot string, quota int, n int, nth int", (1, "a", 1, "s", 1, 1, 1), (None, "a", 1, "s", 1, 1, 1), (2, None, 1, "s", 1, 1, 1), (2, None, 1, "s", 1, 1, 1), (3, "", 1, "s", 1, 1, 1))
    got = mixing.mix(docs).collect()
    assert Counter((r["id"], r["source"]) for r in got) == Counter({(1, "a"): 1, (None, "a"): 1, (2, ""): 2, (3, ""): 1})
    one = mixing.mix(docs, {"a": 1.0, "elsewhere": 0.0}).collect()
    assert {r["source"]: r["selected"] for r in one} == {"a": True, "": False}
    assert mixing.take_mix(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.take_mix(docs.limit(0)).count() == 0


def test_schedule_holds_the_given_weights_over_many_periods():
    sizes = {"third": 100_000, **{f"s{i}": 10_526 for i in range(19)}}
    for given in ({s: n**mixing.TEMPER for s, n in sizes.items()}, {"a": 1e-6, "b": 0.3, "c": 0.7 - 1e-6}):
        weight = mixing.whole_weights(given)
        whole, done = sum(weight.values()), Counter()
        for source, block, release, deadline, slot, strict in mixing.schedule(weight, dict.fromkeys(given, 30_000)):
            if not strict:
                break
            assert block == done[source] and release <= slot < deadline
            done[source] += 1
            assert all(abs(done[s] * whole - w * (slot + 1)) < whole for s, w in weight.items())
        assert slot > 40_000


def test_mix_of_more_sources_than_a_period_has_slots(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 1500).alias("source"))
    rows = mixing.mix(docs).collect()
    assert len(rows) == 6000 and len({r["slot"] for r in rows}) == 1500 and all(r["selected"] for r in rows)


def test_mix_keeps_all_rows_when_a_small_source_runs_dry(spark):
    sizes = {"tiny": 3, "": 1, "big": 1500, "other": 700}
    docs = spark.createDataFrame([(f"{s}{i}", s or None) for s, n in sizes.items() for i in range(n)], "doc_id string, source string")
    rows = mixing.mix(docs, block_rows=4).collect()
    slots = {(r["source"], r["block"]): r["slot"] for r in rows}
    assert sorted(slots.values()) == list(range(sum(-(-n // 4) for n in sizes.values())))  # a slot each, none empty
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in rows)
    late = [s for (s, _), slot in sorted(slots.items(), key=lambda x: x[1]) if slot >= 100]
    share = 1500**0.5 / (1500**0.5 + 700**0.5)
    assert all(abs(late[:n].count("big") - share * n) < 2 for n in range(1, 200))  # the weight of the small ones is spread
    taken = mixing.take_mix(docs, block_rows=4)
    ids = [r["doc_id"] for r in taken.collect()]
    at = {r["id"]: (r["slot"], r["place"]) for r in rows}
    assert len(ids) == len(rows) and ids == sorted(ids, key=at.get)
    given = mixing.take_mix(docs, {"big": 0.9, "other": 0.1, "": 0.0}).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in given} == {"big": 1500, "other": 700}


def _five_word_sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _plain_groups(rows):
    """Smallest id of every row's group: fingerprints within two bits, or five-word Jaccard of 0.8 and more, over all pairs."""
    prints = {i: simhash.fingerprint((t or "").encode()) & (1 << 64) - 1 for i, t in rows.items()}
    sets = {i: _five_word_sets(t) for i, t in rows.items()}
    up = {i: i for i in rows}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(rows)
    for at, i in enumerate(ids):
        for j in ids[at + 1 :]:
            both = len(sets[i] & sets[j])
            if (prints[i] ^ prints[j]).bit_count() <= 2 or (both and both / len(sets[i] | sets[j]) >= 0.8):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: find(i) for i in ids}


def test_pipeline_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    profiles, letter = language.learn_profiles(docs.where(language.fold() != 2)), language.letter_table()
    kept = {i: r for i, r in rows.items() if (g := profiles.nearest(r["text"], letter))[0] != "und" and g[1] >= language.MIN_SCORE}
    group = _plain_groups({i: r["text"] for i, r in kept.items()})
    kept = {i: r for i, r in kept.items() if group[i] == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    judged = contaminated([(i, r["text"]) for i, r in kept.items()], items)
    dirty = {i for i, n, hit, _ in judged if hit and 20 * hit >= n}
    kept = {i: r for i, r in kept.items() if i not in dirty}  # the mix orders all of them and drops none
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(kept) and len(kept) > 100
    assert all(r["text"] == kept[r["doc_id"]]["text"] and 0 <= r["shard"] < 40 for r in got)
    assert set(got[0].asDict()) == {*docs.columns, "shard"}
    size = Counter()
    for r in got:
        size[r["shard"]] += len((r["text"] or "").encode()) + 16
    largest = max(len((r["text"] or "").encode()) + 16 for r in got)
    assert max(size.values()) <= sum(size.values()) / 40 + largest


def test_unlinked_texts_of_one_id_both_stay(spark, table):
    long, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    docs = table("doc_id long, text string, component int, mark string, m map<string,int>", (1, long, 1, "a", {"k": 1}), (1, other, 2, "b", None), (1, long, 1, "c", None), (2, other, 3, "d", None), (None, other, 4, "e", None), (None, "alone here", 5, "f", None), (None, None, 6, "g", None), (3, "", 7, "h", None))
    for alike in (None, 0.8):
        got = simhash.keep_first(docs, alike=alike)
        assert got.columns == docs.columns
        assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == sorted([("1", long), ("1", other), ("3", ""), ("None", "alone here")])
    assert simhash.keep_first(docs.limit(0), alike=0.8).count() == 0


def test_pipeline_stages_take_odd_and_empty_tables(spark, table):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(None, None, None, None, None), (1, "", "en", None, 0), (2, "the cat and the dog sat down", "en", "a", 3), (2, "the cat and the dog sat down", "en", "a", 3), (3, "word " * 50_000, None, "b", None)]
    for docs in (table(schema, *odd), table(schema)):
        for _, stage in corpus_pipeline.STAGES:
            before = docs.columns
            docs = stage(spark, docs, SMALL)
            assert docs.columns[: len(before)] == before
            docs.collect()
