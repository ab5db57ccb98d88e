"""Contract queries over ``conversations``: damage and repair, rebuilt conversations and their prefix trie."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulon.llm import prefix_trie, turn_repair
from tabulon.llm.registry import query
from tabulon.scale.ordering import join_null_safe

# CRC-32 of an ASCII string, by the table of its polynomial (a column ``tab`` of the table beside it).
_CRC_TABLE = """(SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) t(i)))"""
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)),
    lambda s, b: xor(s >> 8, tab[(xor(s, b) & 255) + 1])))"""


@query(
    "op12_turn_repair",
    f"""
    WITH RECURSIVE tabs AS {_CRC_TABLE},
    raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            {_CRC.format("concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' '))")} % 20 AS fate FROM conversations, tabs),
    dam AS (SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
            CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
            unnest(range(CASE fate WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM raw WHERE fate > 0),
    num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM dam),
    r AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS init,
          concat(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i), left(role, 1)) AS pair,
          CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 3
               WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
               WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 1 ELSE 0 END AS fault FROM num),
    fit(st, upto, name) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (3, 2, 'user'), (2, 3, 'assistant')),
    keep(st, init, upto) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3), (0, '', 0), (1, '', 1), (2, '', 2), (3, '', 3)),
    ins AS (SELECT st, st AS upto, 0 AS cost, '' AS l, []::VARCHAR[] AS t FROM (VALUES (0), (1), (2), (3)) v(st)
            UNION ALL SELECT st, upto, 2, 'I', [name || ':'] FROM fit
            UNION ALL SELECT a.st, b.upto, 4, 'II', [a.name || ':', b.name || ':'] FROM fit a JOIN fit b ON a.upto = b.st),
    act AS (SELECT conv_id, i, st.st, st.st AS upto, 3 AS cost, 'D' AS l, []::VARCHAR[] AS t FROM r, (VALUES (0), (1), (2), (3)) st(st)
            UNION ALL SELECT conv_id, i, st, upto, CASE fault WHEN 1 THEN 1 ELSE 0 END, 'K', [role || ':' || text] FROM r JOIN keep USING (init) WHERE fault < 2
            UNION ALL SELECT conv_id, i, st, upto, CASE fault WHEN 1 THEN 3 ELSE 2 END, 'R', [name || ':' || text] FROM r, fit WHERE fault < 2),
    best AS (
        SELECT c.conv_id, 0::BIGINT AS i, ins.upto AS st, {{'cost': ins.cost, 'l': ins.l, 't': ins.t}} AS x
        FROM (SELECT DISTINCT conv_id FROM r) c, ins WHERE ins.st = 0
        UNION ALL
        SELECT conv_id, i, st, x FROM (
            SELECT b.conv_id, act.i, ins.upto AS st,
                min({{'cost': (b.x).cost + act.cost + ins.cost, 'l': (b.x).l || act.l || ins.l, 't': list_concat(list_concat((b.x).t, act.t), ins.t)}}) AS x
            FROM best b JOIN act ON act.conv_id IS NOT DISTINCT FROM b.conv_id AND act.i = b.i + 1 AND act.st = b.st JOIN ins ON ins.st = act.upto
            GROUP BY ALL)),
    n AS (SELECT conv_id, max(i) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps,
          count(*) FILTER (WHERE fault = 3) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 1) AS truncated,
          count(*) FILTER (WHERE i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
    z AS (SELECT n.conv_id, min(x) AS x FROM n JOIN best b ON b.conv_id IS NOT DISTINCT FROM n.conv_id AND b.i = n.n WHERE b.st IN (0, 3) GROUP BY n.conv_id)
    SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
        coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce((z.x).cost, 0)::BIGINT AS cost,
        coalesce((z.x).l, '') AS audit, sha256(coalesce(array_to_string((z.x).t, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM o.conv_id
    """,
)
def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair_report(original, turn_repair.repair(turn_repair.damaged(original)))


def repair_report(original: DataFrame, edits: DataFrame) -> DataFrame:
    """One row per conversation of ``original``: gaps, faults, cost, audit and hash; zeros where no rows are left."""
    number = lambda c: F.sum(F.when(c, 1).otherwise(0))
    fault = {name: number(F.col("fault").eqNullSafe(name)).alias(name) for name in ("blank", "duplicate", "truncated")}
    turns = edits.groupBy("conv_id", "turn").agg(
        *fault.values(), number(F.col("illegal")).alias("illegal"), F.sum(turn_repair.edit_cost()).alias("cost")
    )
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    names = ["blank", "duplicate", "truncated", "illegal", "cost"]
    counted = turns.groupBy("conv_id").agg(span.alias("gaps"), *[F.sum(c).alias(c) for c in names])
    found = join_null_safe(original.select("conv_id").distinct(), counted, ["conv_id"], "left")
    found = join_null_safe(found, turn_repair.digests(edits), ["conv_id"], "left")
    return found.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ["gaps", *names]],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


_TURNS = """SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS nth
    FROM conversations WHERE conv_id IS NOT NULL"""


@query(
    "op13_prefix_trie",
    f"""
    WITH tabs AS {_CRC_TABLE}, t AS ({_TURNS}),
    l AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY nth) AS own FROM t GROUP BY conv_id),
    c AS (SELECT l.*, ({_CRC.format("conv_id::VARCHAR")} % 4)::BIGINT AS h FROM l, tabs),
    b AS (SELECT c.conv_id, list_concat(coalesce(d.own[1 : c.h], []), c.own[c.h + 1 :]) AS seq FROM c LEFT JOIN l d ON d.conv_id = c.conv_id - c.conv_id % 20),
    p AS (SELECT conv_id, seq, unnest(range(len(seq) + 1)) AS depth FROM b),
    q AS (SELECT conv_id, depth, len(seq) AS n, seq[1 : depth] AS path FROM p),
    g AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs,
          coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '') AS ends,
          CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all((path[depth]).text, '[^\\x20\\x09-\\x0D]+')) END AS words FROM q GROUP BY depth, path),
    k AS (SELECT depth - 1 AS depth, path[1 : depth - 1] AS path, count(*) AS n FROM g WHERE depth > 0 GROUP BY ALL),
    w AS (SELECT g.*, coalesce(k.n, 0) AS n_children FROM g LEFT JOIN k ON k.depth = g.depth AND k.path = g.path),
    s AS (SELECT q.depth, q.path, count(*) FILTER (WHERE w.n_children = 0) AS n_leaves, sum((w.n_convs - 1) * w.words) AS saved
          FROM w JOIN q ON q.conv_id = w.conv_id AND q.depth <= w.depth GROUP BY ALL)
    SELECT w.conv_id, w.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, w.n_convs::BIGINT AS n_convs, w.n_children::BIGINT AS n_children,
        s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(w.ends) AS ends_sha256
    FROM w JOIN s ON s.depth = w.depth AND s.path = w.path
    LEFT JOIN g u ON u.depth = w.depth - 1 AND u.path = w.path[1 : w.depth - 1]
    """,
)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    nodes = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.numbered(turns)))
    return nodes.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
