"""Licence scan on wrapped notices, whole licences and notices inside other text."""

import textwrap
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tabulon.llm import licences
from tabulon.llm.queries import load
from verify import rows_of

QUERIES, ORACLES = load()


def longest(name):
    return max((w for n, w in licences.TEMPLATES if n == name), key=len)


def commented(text, width=70, mark=" * "):
    return "\n".join(mark + line for p in text.split("\n") for line in textwrap.wrap(p, width))


FOUND = {
    "wrapped permission": ("MIT", commented(longest("MIT").split("\n")[0], 78, "")),
    "whole text, commented": ("MIT", "/*\n * Copyright (c) 2020 Some Body\n *\n" + commented(longest("MIT")) + "\n */\nint main() {}"),
    "whole text on one line": ("BSD-3-Clause", "Copyright 2021 Some Body. " + longest("BSD-3-Clause").replace("\n", " ")),
    "two clauses": ("BSD-2-Clause", textwrap.fill(longest("BSD-2-Clause"), 60)),
    "header": ("Apache-2.0", commented(longest("Apache-2.0"), 74, "# ") + "\nimport os\n"),
    "header of another": ("GPL-3.0", commented(longest("GPL-3.0"), 66, "// ")),
    "short notice in a line": ("Apache-2.0", "Copyright 2020 Example Inc. Licensed under the Apache License, Version 2.0. More words follow here."),
    "tag": ("MIT", "// SPDX-License-Identifier: MIT"),
    "a few words changed": ("ISC", longest("ISC").replace("THE AUTHOR BE LIABLE", "THE COMPANY OR ITS STAFF BE LIABLE")),
    "among other text": ("MIT", "some words of a page " * 40 + longest("MIT") + " and other words after it" * 40),
}
CLEAN = ["SPDX-License-Identifier: Proprietary", "the software is provided by the company to you", "permission is granted to park here", "word " * 3000, "", None, "of the and in the to of", longest("MIT")[:90]]


def test_whole_texts_wrapped_headers_and_notices_in_lines(spark, tmp_path):
    texts = [t for _, t in FOUND.values()] + CLEAN
    pq.write_table(pa.table({"doc_id": list(range(len(texts))), "text": texts, "n": [1] * len(texts), "line": ["x"] * len(texts)}), tmp_path / "documents.parquet")
    df = QUERIES["op10_licence_scan"](spark, str(tmp_path))
    got = {r["doc_id"]: r for r in df.collect()}
    for i, (what, (name, _)) in enumerate(FOUND.items()):
        assert got[i]["licence"] == name, what
    assert [texts[i] for i in range(len(FOUND), len(texts)) if got[i]["licence"]] == []
    assert got[2]["dice"] > 0.98 and got[3]["dice"] > 0.98
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    cur = con.execute(ORACLES["op10_licence_scan"])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_licences_keep_rows_and_name_all(spark, table):
    both = longest("ISC") + "\n\n" + commented(longest("Apache-2.0"), 60)
    docs = table("doc_id long, text string, grams int, template string", (1, both, 1, "t"), (1, both, 1, "t"), (None, both, 1, "t"), (2, "x " * 200_000, 1, "t"))
    got = Counter((r["id"], r["licences"], r["n_notices"]) for r in licences.scan(docs).collect())
    assert {k[:2]: n for k, n in got.items()} == {(1, "Apache-2.0,ISC"): 2, (None, "Apache-2.0,ISC"): 1, (2, ""): 1}
    assert licences.scan(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licences.scan(docs, [("X", " ".join(f"w{i}" for i in range(licences.TEMPLATE_BIGRAMS + 5)))])
