"""Secret scan with linking of multipart credentials.

Patterns find parts of three roles: access identifiers, secrets and endpoints. Assigned secrets, long access keys and long hex runs are
reported as they stand. The others are weak: a mixed run of characters, a user or client id or an address alone is no
secret. Weak parts are reported only where complementary parts co-occur within a scope: REACH characters around, and no
empty line between. An access identifier needs a secret, a secret an access identifier, an endpoint a linked access identifier.

Scopes meet parts in interval joins over cells of REACH characters, as semi-joins: a part is kept or not, pairs are never listed.
A cell has room for a bounded number of parts, so long texts with many parts spread over many keys.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabulon.scale.storage import materialize

REACH = 300
BASE = ("assign", "access", "hex")
WEAK = ("ident", "key", "endpoint")
KINDS = BASE + WEAK
ROLE = {"access": "access", "ident": "access", "assign": "secret", "hex": "secret", "key": "secret", "endpoint": "endpoint"}


def any_case(*words: str) -> str:
    """Pattern of the words, ASCII letters in either case."""
    return "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in words)


_GIVEN = r"""["']?\x20*[:=]\x20*["']?"""
PATTERNS = {
    "assign": f"({any_case('password', 'passwd', 'secret', 'token', 'api_?key')}){_GIVEN}([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]{16,}",
    "hex": "[0-9a-f]{24,}",
    "ident": f"({any_case('user_?name', 'user', 'login', 'account', 'client_?id', 'key_?id')}){_GIVEN}[A-Za-z0-9_.@+-]+|A(SIA|ROA|IDA)[A-Z0-9]+",
    "key": "[A-Za-z0-9+/=_-]{20,}",
    "endpoint": "[a-z]{2,12}://[^\\x00-\\x20\"'<>]+",
}
LEAST = {"ident": 8, "endpoint": 10}
LEAST_ASSIGNED = 6
SCOPE_END = "\n\n"
_PART = "array<struct<kind:string,start:int,end:int,scope:int>>"
_TRIGGER = {"endpoint": "://", "access": "AKIA"}  # texts without it have no such part


def parts_of(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, scope number) of every part of a text; those of the base kinds first."""
    found = []
    for kind, pattern in _COMPILED.items():
        if _TRIGGER.get(kind, "") not in text:
            continue
        for m in pattern.finditer(text):
            if kind == "assign":
                fits = m.end(2) - m.start(2) >= LEAST_ASSIGNED
            else:
                fits = m.end() - m.start() >= LEAST.get(kind, 0) and (kind != "key" or _mixed(m[0]))
            if fits:
                found.append((kind, m.start(), m.end()))
    base = sorted((s, e) for k, s, e in found if k in BASE)
    starts, reach = [s for s, _ in base], list(accumulate((e for _, e in base), max))
    kept = []
    for kind, start, end in sorted(found, key=lambda p: p[1]):
        before = bisect_left(starts, end)  # base spans that start before this part ends
        if kind in BASE or not before or reach[before - 1] <= start:
            kept.append((kind, start, end))
    ends = [m.start() for m in re.finditer(SCOPE_END, text)] if kept else []
    return [(kind, start, end, bisect_right(ends, start - len(SCOPE_END))) for kind, start, end in kept]


def _mixed(run: str) -> bool:
    """Upper and lower case letters and digits, all three."""
    return run != run.lower() and run != run.upper() and any(c.isdigit() for c in run)


_COMPILED = {k: re.compile(p) for k, p in PATTERNS.items()}


def find_parts(text: Column) -> Column:
    @F.arrow_udf(_PART)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = ("kind", "start", "end", "scope")
        kind = pa.list_(pa.struct([("kind", pa.string()), *[(n, pa.int32()) for n in names[1:]]]))
        for texts in batches:
            yield pa.array([[dict(zip(names, p)) for p in parts_of(t or "")] for t in texts.to_pylist()], kind)

    return run(text)


def _within_reach(probe: DataFrame, build: DataFrame) -> DataFrame:
    """Rows of ``probe`` that have a row of ``build`` in their text and scope, REACH characters away at most."""
    last = F.floor((F.col("end") - 1 + REACH) / REACH)
    spread = build.select(
        F.col("row").alias("b_row"), F.col("scope").alias("b_scope"), F.col("start").alias("b_start"), F.col("end").alias("b_end"),
        F.explode(F.sequence(F.floor((F.col("start") - REACH) / REACH), last)).alias("b_cell"),
    )
    # The cell of the probe's start decides, unless the probe reaches far beyond it: then each of its cells asks.
    asked = probe.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / REACH), F.floor((F.col("end") - 1) / REACH))))
    near = (
        (F.col("row") == F.col("b_row")) & (F.col("cell") == F.col("b_cell")) & (F.col("scope") == F.col("b_scope"))
        & (F.col("b_start") - F.col("end") <= REACH) & (F.col("start") - F.col("b_end") <= REACH)
    )
    return asked.join(spread, near, "left_semi").drop("cell").distinct()


def linked_parts(parts: DataFrame) -> DataFrame:
    """Weak rows of ``parts(row, kind, start, end, scope)`` that complementary parts of their scope confirm."""
    role = F.create_map(*[F.lit(x) for pair in ROLE.items() for x in pair])[F.col("kind")]
    parts = materialize(parts.withColumn("role", role), "parts")
    of = lambda name: parts.where(F.col("role") == name)
    access = materialize(_within_reach(of("access"), of("secret")), "access")
    secrets = _within_reach(of("secret").where(F.col("kind").isin(*WEAK)), access)
    endpoints = _within_reach(of("endpoint"), access)
    return access.where(F.col("kind").isin(*WEAK)).unionByName(secrets).unionByName(endpoints).drop("role")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, spans)`` for every row: reported spans ``(start, rank, kind, end)`` by start, then by kind as in KINDS.

    ``rank`` is the place of the kind in KINDS, ``start`` and ``end`` count code points. Null and empty texts have no
    spans. Rows with null or repeated ids keep their own result each. Other columns are not read. An empty table gives an
    empty result.
    """
    found = docs.select(F.col(id_col).alias("id"), find_parts(F.col(text_col)).alias("parts"))
    stored = materialize(found.withColumn("row", F.monotonically_increasing_id()), "found")
    has = lambda names: F.exists("parts", lambda p: p["kind"].isin(*names))
    whole = has([k for k in KINDS if ROLE[k] == "access"]) & has([k for k in KINDS if ROLE[k] == "secret"]) & has(WEAK)
    parts = stored.where(whole).select("row", F.explode("parts").alias("p")).select("row", "p.*")
    rank = lambda kind: F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int")
    span = lambda p: F.struct(p["start"].alias("start"), rank(p["kind"]).alias("rank"), p["kind"].alias("kind"), p["end"].alias("end"))
    # What is gathered here comes from one text.
    weak = linked_parts(parts).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("weak"))
    base = F.transform(F.filter("parts", lambda p: p["kind"].isin(*BASE)), span)
    more = F.coalesce(F.transform("weak", span), F.filter(base, lambda _: F.lit(False)))
    return stored.join(weak, "row", "left").select("id", F.array_sort(F.concat(base, more)).alias("spans"))


def spans_text(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end`` of the spans of some kinds, comma-joined."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
