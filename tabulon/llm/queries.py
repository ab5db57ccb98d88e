"""Contract queries: each applies one operator to its whole table and derives the agreed columns."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulon.llm import decontaminate, html_text, language, licences, line_runs, mixing, quality, secret_scan, shards, simhash, token_counts
from tabulon.llm.registry import ORACLES, QUERIES, query


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return near.select(F.col("id").alias("doc_id"), hexed.alias("fingerprint"), F.col("component").alias("component_id"))


@query("op2_html_text")
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    found = pages.select("page_id", "url", html_text.extract(F.col("html")).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    import public_tokenizers

    source = Path(public_tokenizers.path(vocabulary)).read_text(encoding="utf-8")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        token_counts.token_count(F.col("text"), source).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


@query(
    "op4_line_runs",
    f"""
    WITH s AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    e AS (SELECT doc_id, unnest(ls) AS t, generate_subscripts(ls, 1) - 1 AS line FROM s),
    w AS (SELECT *, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS n FROM e),
    q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS seq,
              sum(n) OVER (PARTITION BY doc_id ORDER BY line) AS upto FROM w WHERE n > 0),
    r AS (SELECT a.doc_id, a.seq, min(b.seq) AS last FROM q a JOIN q b ON a.doc_id = b.doc_id AND b.seq >= a.seq
          AND b.upto - a.upto + a.n >= {line_runs.MIN_WORDS} GROUP BY ALL),
    k AS (SELECT r.doc_id, r.seq, r.last, string_agg(q.t, chr(10) ORDER BY q.seq) AS run FROM r JOIN q
          ON r.doc_id = q.doc_id AND q.seq BETWEEN r.seq AND r.last GROUP BY ALL),
    c AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, seq) AS nth FROM k),
    g AS (SELECT DISTINCT q.doc_id, q.line FROM c JOIN q ON c.doc_id = q.doc_id AND q.seq BETWEEN c.seq AND c.last WHERE c.nth > 1),
    o AS (SELECT e.doc_id, count(g.line) AS n_removed, coalesce(string_agg(e.t, chr(10) ORDER BY e.line) FILTER (WHERE g.line IS NULL), '') AS kept
          FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.line = g.line GROUP BY e.doc_id)
    SELECT doc_id, n_removed::BIGINT AS n_removed, length(kept)::BIGINT AS n_chars_kept, sha256(kept) AS kept_sha256 FROM o
    """,
)
def op4_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_runs.drop_repeated(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce("text", F.lit(""))
    return cut.select(
        "doc_id", F.col("lines_removed").cast("long").alias("n_removed"), F.length(kept).cast("long").alias("n_chars_kept"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    profiles = language.learn_profiles(docs.where(language.fold() != 2))
    found = docs.select(
        "doc_id", (language.fold() == 2).alias("held_out"), language.identify(F.col("text"), profiles).alias("got")
    )
    return found.select("doc_id", "held_out", F.col("got.lang").alias("lang_pred"), F.col("got.score").alias("score"))


@query("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.learn(docs, _table(spark, sf_dir, "labels"))
    judged = docs.select("doc_id", quality.judge(F.col("text"), model).alias("q")).select("doc_id", "q.*")
    failed = quality.base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return judged.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("prob") >= quality.THRESHOLD)
    )


@query("op7_sharding")
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard_rows(_table(spark, sf_dir, "documents"), 40)
    return placed.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCH_WORDS = f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op8_decontamination",
    f"""
    WITH i AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, {_BENCH_WORDS} AS w FROM benchmark),
    k AS (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(0, greatest(len(w) - 12, 1))) AS b FROM i WHERE len(w) > 0),
    win AS (SELECT DISTINCT item_id, n, array_to_string(w[b + 1 : b + n], ' ') AS t FROM k),
    d AS (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents),
    p AS (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS b FROM d, (SELECT DISTINCT n FROM win)),
    g AS (SELECT doc_id, n, b, array_to_string(w[b + 1 : b + n], ' ') AS t FROM p),
    h AS (SELECT g.doc_id, g.n, g.b, win.item_id FROM g JOIN win USING (n, t)),
    c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(b, b + n)) AS pos FROM h) GROUP BY doc_id),
    l AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
          FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
    SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
        sha256(coalesce(items, '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
    FROM d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)
    """,
)
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontaminate.build_index(_table(spark, sf_dir, "documents"))
    found = decontaminate.contamination(index, _table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.is_contaminated().alias("contaminated"),
    )


@query("op9_mixing")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), *[c for c in mixed.columns if c != "id"])


_TEMPLATE_ROWS = ", ".join("({}, '{}', '{}')".format(n, a, b.replace("'", "''")) for n, (a, b) in enumerate(licences.TEMPLATES))
_COMMON = ", ".join(f"'{w}'" for w in licences.COMMON)


def _kept_bigrams(source: str, key: str, text: str) -> str:
    """SQL rows ``(key, pos, gram, line, n)`` of the kept bigrams of a text column, from words by lines."""
    return f"""SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY line, i) - 1 AS pos, w || ' ' || v AS gram, line, count(*) OVER (PARTITION BY {key}) AS n FROM (
        SELECT *, lead(w) OVER (PARTITION BY {key} ORDER BY line, i) AS v FROM (
            SELECT {key}, line, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
                SELECT {key}, line, regexp_extract_all(l, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM (
                    SELECT {key}, unnest(string_split(lower(coalesce({text}, '')), chr(10))) AS l,
                        generate_subscripts(string_split(lower(coalesce({text}, '')), chr(10)), 1) - 1 AS line FROM {source}))))
        WHERE v IS NOT NULL AND NOT (w IN ({_COMMON}) AND v IN ({_COMMON}))"""


@query(
    "op10_licence_scan",
    f"""
    WITH tr(template, licence, wording) AS (VALUES {_TEMPLATE_ROWS}),
    tg AS ({_kept_bigrams("tr", "template", "wording")}),
    t AS (SELECT template, licence, pos AS place, gram, n AS size, count(*) OVER (PARTITION BY template, gram) = 1 AS once, greatest(2, n // 4) AS width FROM tg JOIN tr USING (template)),
    g AS ({_kept_bigrams("documents", "doc_id", "text")}),
    h AS (SELECT doc_id, n, pos, line, t.*, pos - place AS away FROM g JOIN t USING (gram)),
    b AS (SELECT *, half, floor((away + half * (width // 2)) / width::DOUBLE) AS band FROM h, (VALUES (0), (1)) v(half)),
    p AS (SELECT doc_id, n, template, licence, size, half, band, gram, least(count(DISTINCT pos), count(DISTINCT place)) AS hits, min(pos) AS pos, arg_min(line, pos) AS line,
          min(away) AS low, max(away) AS high, min(away) FILTER (WHERE once) AS low1, max(away) FILTER (WHERE once) AS high1 FROM b GROUP BY ALL),
    w AS (SELECT doc_id, n, template, licence, size, sum(hits) AS hits, arg_min(line, pos) AS line, coalesce(min(low1), min(low)) AS low, coalesce(max(high1), max(high)) AS high
          FROM p GROUP BY doc_id, n, template, licence, size, half, band),
    s AS (SELECT *, least(1.0::DOUBLE, 2 * hits::DOUBLE / (least(n - 1, high + size - 1) - greatest(0, low) + 1 + size)) AS dice FROM w),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, dice DESC, licence, line) AS nth FROM s WHERE dice > {licences.THRESHOLD}::DOUBLE),
    c AS (SELECT doc_id, count(DISTINCT line) AS n_notices, array_to_string(list_sort(list(DISTINCT licence)), ',') AS licences FROM k GROUP BY doc_id)
    SELECT d.doc_id, k.licence, k.dice, k.line::INTEGER AS line, coalesce(n_notices, 0)::BIGINT AS n_notices, coalesce(licences, '') AS licences
    FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id AND nth = 1 LEFT JOIN c ON d.doc_id = c.doc_id
    """,
)
def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "licence", "dice", "line", "n_notices", "licences")


def _found(kind: str) -> str:
    """SQL rows ``(doc_id, kind, s, e)`` of all fitting matches of a pattern, counted from 0, from ``d(doc_id, text)``."""
    plain = {"access": ("AKIA[A-Z0-9]+", 20), "hex": ("[0-9a-f]+", 24)}
    pattern, n = plain.get(kind, (secret_scan.PATTERNS[kind].replace("'", "''"), secret_scan.LEAST.get(kind, 0)))
    least = f"length(v) >= {secret_scan.LEAST_ASSIGNED}" if kind == "assign" else f"length(m) >= {n}"
    if kind == "key":
        least += " AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')"
    value = f"regexp_extract_all(text, '{pattern}', {2 if kind == 'assign' else 0})"
    return f"""SELECT doc_id, '{kind}' AS kind, (upto - length(m))::INT AS s, upto::INT AS e FROM (
        SELECT doc_id, m, v, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM (
        SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}')) AS m, unnest({value}) AS v, generate_subscripts(regexp_extract_all(text, '{pattern}'), 1) AS i,
            unnest(list_slice(string_split_regex(text, '{pattern}'), 1, len(regexp_extract_all(text, '{pattern}')))) AS gap FROM d)) WHERE {least}"""


_NEAR = f"a.doc_id = b.doc_id AND a.scope = b.scope AND b.s - a.e <= {secret_scan.REACH} AND a.s - b.e <= {secret_scan.REACH}"


@query(
    "op11_secret_scan",
    f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    f AS ({" UNION ALL ".join(_found(k) for k in secret_scan.KINDS)}),
    p AS (SELECT f.*, (length(left(text, s)) - length(replace(left(text, s), chr(10) || chr(10), ''))) // 2 AS scope,
          list_position({list(secret_scan.KINDS)}, kind) AS rank FROM f JOIN d USING (doc_id)),
    q AS (SELECT * FROM p a WHERE rank <= 3 OR NOT EXISTS (SELECT 1 FROM p b WHERE a.doc_id = b.doc_id AND b.rank <= 3 AND b.s < a.e AND a.s < b.e)),
    a AS (SELECT * FROM q a WHERE kind IN ('access', 'ident') AND EXISTS (SELECT 1 FROM q b WHERE {_NEAR} AND b.kind IN ('assign', 'hex', 'key'))),
    k AS (SELECT * FROM q a WHERE kind IN ('key', 'endpoint') AND EXISTS (SELECT 1 FROM a b WHERE {_NEAR})),
    r AS (SELECT * FROM q WHERE rank <= 3 UNION ALL SELECT * FROM a WHERE rank > 3 UNION ALL SELECT * FROM k),
    g AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
          count(*) FILTER (WHERE kind = 'hex') AS n_hex, string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, rank) AS spans,
          string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, rank) FILTER (WHERE rank <= 3) AS base FROM r GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN g USING (doc_id)
    """,
)
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("id").alias("doc_id"), *[count(k) for k in secret_scan.BASE],
        F.sha2(secret_scan.spans_text(F.col("spans"), secret_scan.BASE), 256).alias("base_sha256"),
        secret_scan.spans_text(F.col("spans")).alias("spans"),
    )


def load() -> tuple[dict, dict]:
    from tabulon.llm import conversation_queries  # noqa: F401  registers its own

    return QUERIES, ORACLES
