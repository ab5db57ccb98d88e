"""Row-wise operators: extraction, tokens, language, quality, licences."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import html_text, language, licences, quality, token_counts
from tabulon.llm.queries import load

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
QUERIES, _ = load()


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("seed", range(3))
def test_token_counts_equal_the_library(vocabulary, seed):
    import random
    from pathlib import Path

    from tokenizers import Tokenizer

    rnd = random.Random(seed)
    pool = "aaabbb  \n\t'sre<|endoftext|>ñéß漢字한글😀  \x1c\x1d\x85​123½²ⅣÀ'LL"
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    texts += ["a" * 5000, "<|endoftext|>" * 3 + " x <|endoftext|> y", "ab" * 3000, "", "   ", "it's we'll"]
    texts += [f"x{chr(c)}y {chr(c)} 1{chr(c)}" for c in range(1, 0x30000, 7 + seed) if not 0xD800 <= c < 0xE000]
    counter = token_counts.Counter(token_counts.Vocabulary(Path(vocabulary).read_text()))
    library = Tokenizer.from_file(vocabulary)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert list(counter.counts(texts)) == want


def test_token_counts_in_parts_and_afresh(vocabulary, monkeypatch):
    from pathlib import Path

    vocab = token_counts.Vocabulary(Path(vocabulary).read_text())
    text = "The quick brown fox's 12 jumps -- over   lazy dogs.\n" * 50
    whole = token_counts.Counter(vocab).count(text)
    monkeypatch.setattr(token_counts, "_LONG", 100)
    monkeypatch.setattr(token_counts, "_KNOWN", 5)
    assert token_counts.Counter(vocab).count(text) == whole
    assert list(token_counts.Counter(vocab).counts([text, None, "x", text])) == [whole, 0, 1, whole]


def test_op3_on_a_table(spark, vocabulary):
    from tokenizers import Tokenizer

    got = {r["doc_id"]: r for r in QUERIES["op3_token_counts"](spark, SMALL).collect()}
    library = Tokenizer.from_file(vocabulary)
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        mine = got[r["doc_id"]]
        assert (mine["n_tokens"], mine["n_bytes"], mine["over_limit"]) == (n, len((r["text"] or "").encode()), n > 1024)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="home menu">
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">First</a></li><li><a href="/b">Second</a></li></ul></nav>
<div class="cookie-notice">We use cookies. <button>Fine</button></div><!-- ad 1 --><div class="ad">Buy one now</div>
<article><h1>A &amp; B</h1><p><b>First   paragraph,<br>still &lt;first&gt;<p>Short.</p><p>a &am</p><aside><p>Not this one, aside.</p></aside>
<form><p>Sign up here</p><input></form><p>Last words of the article come here at some length.</p></article>
<section id="comments"><div class="comment"><p>I liked this a lot, thank you for writing it all down.</p></div></section>
<footer>&copy; somebody</footer></body></html>"""


def test_html_page_with_all_kinds_of_boilerplate():
    tree = html_text.grow(*html_text.labelled_blocks())
    want = "A & B\nFirst paragraph, still <first>\nShort.\na &am\nLast words of the article come here at some length."
    assert html_text.main_text(PAGE, tree) == want
    assert [html_text.main_text(x, tree) for x in (None, "", "   ", "<p>", "<!-- never closed", "<script>x")] == [""] * 6
    cut = PAGE[: PAGE.index("Last words") + 10]
    assert html_text.main_text(cut, tree).endswith("Last words")


def _words(n, word="keep"):
    return " ".join([word] * n)


LAYOUTS = {
    "short title in the article's header": (f"<article><header><h1>{_words(4)}</h1></header><p>{_words(40)}</p></article>", (4, 40)),
    "the site's own title": (f"<header><h1>{_words(5, 'x')}</h1></header><article><h1>{_words(6)}</h1><p>{_words(40)}</p></article>", (6, 40)),
    "paragraph that is mostly link": (f"<article><p>{_words(40)}</p><p>{_words(8)} <a href=x>{_words(12)}</a></p><p>{_words(30)}</p></article>", (40, 20, 30)),
    "an article about reviews": (f'<article><h1>{_words(5)}</h1><div class="reviews-body"><p>{_words(40)}</p><p>{_words(3)}</p></div></article>', (5, 40, 3)),
    "short first paragraph, no markup": (f"<h1>{_words(6)}</h1><p>{_words(12)}</p><p>{_words(60)}</p><p>{_words(45)}</p>", (6, 12, 60, 45)),
    "advert before the title, no markup": (f"<div>{_words(13, 'x')}</div><h1>{_words(6)}</h1><p>{_words(25)}</p><p>{_words(60)}</p><p>{_words(45)}</p>", (6, 25, 60, 45)),
}


@pytest.mark.parametrize("layout", list(LAYOUTS))
def test_html_layouts_outside_the_table(layout):
    source, kept = LAYOUTS[layout]
    got = html_text.main_text(f"<html><body>{source}</body></html>", html_text.grow(*html_text.labelled_blocks()))
    assert got == "\n".join(_words(n) for n in kept)


def test_html_blocks_of_pages_left_out_of_the_table():
    pages = []
    for page in html_text.PAGES:
        source = re.sub(r"([\[{])(\d+)[\]}]", lambda m: _words(int(m[2]), "keep" if m[1] == "{" else "drop"), page)
        found = html_text.blocks(source)
        pages.append((html_text.describe(found), np.array([float(b.text.startswith("keep")) for b in found])))
    right = []
    for i, (x, y) in enumerate(pages):
        rest = [p for j, p in enumerate(pages) if j != i]
        tree = html_text.grow(np.vstack([a for a, _ in rest]), np.concatenate([b for _, b in rest]))
        right += [html_text.is_main(tree, row) == bool(label) for row, label in zip(x.tolist(), y)]
    assert sum(right) / len(right) > 0.97  # 423 of 432


def test_html_table_of_odd_rows(spark, table):
    pages = table("page_id long, url string, html string, text string, n_chars int", (1, "u", None, "t", 1), (1, "u", "", "t", 1), (None, None, "<article><p>a &amp; b</p></article>", "t", 1), (1, "u", "<p>" + "w " * 200_000, "t", 1))
    got = pages.select("page_id", html_text.extract(F.col("html")).alias("got")).collect()
    assert [(r["page_id"], len(r["got"])) for r in got] == [(1, 0), (1, 0), (None, 5), (1, 399_999)]
    assert pages.limit(0).select(html_text.extract(F.col("html")).alias("got")).count() == 0


def test_quality_sample_holds_with_repeated_ids(spark, table, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows, fold, **k: seen.append(rows) or quality.Model(np.zeros(quality.KINDS * quality.BUCKETS)))
    docs = spark.range(5000).selectExpr("1L as doc_id", "concat('text ', id) as text").unionByName(table("doc_id long, text string", (2, "b"), (2, "b"), (3, None)))
    labels = table("doc_id long, quality int", (1, 1), (1, 0), (2, 1), (2, 1), (3, 1))
    quality.learn(docs, labels)
    assert sorted(r[2] for r in seen[0]) == [0, 1]  # one row an id, the smaller label
    quality.learn(docs, labels, sample_rows=1)
    assert len(seen[1]) == 1
    quality.learn(docs.limit(0), labels)
    assert seen[2] == []


def test_html_labelled_blocks_are_learned():
    x, y = html_text.labelled_blocks()
    tree = html_text.grow(x, y)
    right = [html_text.is_main(tree, row) == bool(label) for row, label in zip(x.tolist(), y)]
    assert sum(right) / len(right) > 0.98


def test_html_odd_markup_is_read_in_linear_time():
    for source in ('<a "' * 30_000, "<div>" * 30_000, "<script>" * 20_000, "<p" * 30_000, "</div>" * 30_000, "<" * 100_000):
        html_text.blocks(source)


def test_op2_on_whole_pages(spark):
    rows = QUERIES["op2_html_text"](spark, SMALL).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r["page_id"]], re.S)[1]
        import html

        parts = re.split(r"<[^>]*>", re.sub(r"</?b>|<br>", " ", inner))
        want = "\n".join(p for p in (" ".join(html.unescape(x).split()) for x in parts) if p)
        assert (r["text"], r["n_chars"]) == (want, len(want))


def test_language_on_held_out_rows(spark):
    rows = QUERIES["op5_language_id"](spark, MIDDLE)
    true = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang")
    held = rows.where("held_out").join(true, "doc_id").collect()
    assert len(held) > 200 and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.99
    assert all(0 <= r["score"] <= 1 for r in held)


def test_ngrams_by_hand_and_in_parts(monkeypatch):
    letter = language.letter_table()
    code = lambda s: sum((1 if c == "_" else ord(c) + 1) << 21 * (len(s) - 1 - i) for i, c in enumerate(s))
    grams, counts = language.with_shorter(*language.trigram_counts("Ab, a1B", letter))
    want = Counter()
    for w in ("_ab_", "_a_", "_b_"):
        want.update(c for c in w if c != "_")
        want.update(w[i : i + 2] for i in range(len(w) - 1))
        want.update(w[i : i + 3] for i in range(len(w) - 2))
    assert dict(zip(grams.tolist(), counts.tolist())) == {code(k): n for k, n in want.items()}
    text = "Zwei Wörter, drei; und 12 mehr " * 20
    whole = language.trigram_counts(text, letter)
    monkeypatch.setattr(language, "_PART", 17)
    parts = language.trigram_counts(text, letter)
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_language_of_odd_rows(spark, table):
    schema = "doc_id long, text string, lang string, score double, rank int, gram long"
    texts = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "", "de"), (5, "12 !?", None), (None, "the dog", None), (1, "the cat and the dog", "en"), (6, "Съешь ещё", None)]
    docs = table(schema, *[(*t, 0.5, 1, 2) for t in texts])
    profiles = language.learn_profiles(docs)
    got = docs.select("doc_id", language.identify(F.col("text"), profiles).alias("x")).select("doc_id", "x.*").collect()
    assert [r["lang"] for r in got] == ["en", "de", "und", "und", "und", "en", "en", "de"] and got[7]["score"] == 0
    kept = language.keep_known(docs, profiles)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "2", "None"]
    nothing = language.learn_profiles(docs.limit(0))
    assert docs.select(language.identify(F.col("text"), nothing)["lang"]).distinct().first()[0] == "und"
    assert language.keep_known(docs.limit(0), profiles).count() == 0


def _base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)


def test_quality_base_counts():
    texts = ["", " \n\t", "a b c d e a b c d e", "x " * 50, "é#ß|漢 <b>\n\nline\nline\n line\n", "\x1c \x85   w", "a b c d e f a b c d e g a b c d"]
    texts.append(" ".join(str(i * i % 9001) for i in range(20_000)))  # too many distinct words for one number
    assert [quality.base_counts(t.encode()) for t in texts] == [_base(t) for t in texts]


def test_op6_verdicts_and_counts(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    rows = QUERIES["op6_quality_rules"](spark, MIDDLE).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = _base(docs[r["doc_id"]])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base
        assert r["base_failed"] == (base[0] < 10 or 100 * base[4] > 20 * base[0]) and not (r["base_failed"] and r["kept"])
    judged = [(r["kept"], truth[r["doc_id"]] == 1) for r in rows if r["doc_id"] in truth and not r["base_failed"]]
    assert sum(a == b for a, b in judged) / len(judged) > 0.97


def test_quality_on_rows_outside_the_sample(spark):
    docs, labels = spark.read.parquet(f"{MIDDLE}/documents.parquet"), spark.read.parquet(f"{MIDDLE}/labels.parquet")
    model = quality.learn(docs, labels.where("doc_id % 2 = 0"))
    held = docs.join(labels.where("doc_id % 2 = 1"), "doc_id").select("quality", quality.judge(F.col("text"), model).alias("q")).select("quality", "q.*")
    failed = quality.base_failed(F.col("n_words"), F.col("n_repeat_words"))
    pairs = held.where(~failed).select("quality", "prob").collect()
    assert sum((r["prob"] >= quality.THRESHOLD) == (r["quality"] == 1) for r in pairs) / len(pairs) > 0.94
    assert abs(sum(r["prob"] - r["quality"] for r in pairs) / len(pairs)) < 0.1  # calibrated


def test_quality_without_usable_labels(spark, table):
    docs = table("doc_id long, text string, prob string, y int, mark int", (1, None, "p", 1, 1), (None, "some text", "p", 1, 1), (1, "", "p", 1, 1))
    for labels in (table("doc_id long, quality int"), table("doc_id long, quality int", (1, None), (None, 1), (7, 0)), table("doc_id long, quality int", (1, 1), (1, 1))):
        model = quality.learn(docs, labels)
        got = docs.select(quality.judge(F.col("text"), model).alias("q")).select("q.*").collect()
        assert len(got) == 3 and all(0 <= r["prob"] <= 1 for r in got) and got[0]["n_words"] == 0


def test_licences_of_odd_rows(spark, table):
    schema = "doc_id long, text string, licence string, gram long, line int, size int, a int, best string"
    mit = "Released under the MIT License."
    texts = [(1, mit), (1, mit), (2, None), (3, ""), (4, "word"), (None, f"x\n{mit.upper()}\n{mit}"), (5, "released under the mit licence"), (6, "w " * 100_000), (7, "Licensed under CC BY-NC 4.0.")]
    got = licences.scan(table(schema, *[(*t, "z", 1, 2, 3, 4, "b") for t in texts])).collect()
    found = Counter((r["id"], r["licence"], r["line"], r["n_notices"]) for r in got)
    assert found == Counter({(1, "MIT", 0, 1): 2, (2, None, None, 0): 1, (3, None, None, 0): 1, (4, None, None, 0): 1, (None, "MIT", 1, 2): 1, (5, None, None, 0): 1, (6, None, None, 0): 1, (7, "CC-BY-NC-4.0", 0, 1): 1})
    assert licences.scan(table(schema)).count() == 0
    with pytest.raises(ValueError):
        licences.scan(table(schema), [("X", " ".join(f"w{i}" for i in range(licences.TEMPLATE_BIGRAMS + 5)))])
