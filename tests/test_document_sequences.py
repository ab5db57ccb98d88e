"""JSON documents: one per file, or many in a file with a separator between them."""

import json

import pytest

from tabulon.checks import load
from tabulon.sources import documents as S

QUERIES, _ = load()


@pytest.mark.parametrize("pretty", [None, 2])
def test_many_documents_in_one_file(spark, tmp_path, pretty):
    docs = [[{"a": 1, "b": "x\x1ey\n"}, {"a": 2}], {"a": 3, "b": "é"}, [], [{"b": "only"}]]
    (tmp_path / "docs.json").write_text("".join("\x1e" + json.dumps(d, indent=pretty) + "\n" for d in docs))
    got = [(r["a"], r["b"]) for r in S.read_json_document(spark, str(tmp_path), "a bigint, b string", S.SEQUENCE).collect()]
    assert sorted(got, key=str) == sorted([(1, "x\x1ey\n"), (2, None), (3, "é"), (None, "only")], key=str)


def test_pages_of_a_feed_in_one_file(spark, tmp_path):
    pages = [{"@odata.nextLink": "p2", "value": [{"k": 1, "n": "a"}, {"k": 2}]}, {"value": []}, {"k": 3, "n": "alone"}]
    (tmp_path / "feed.json").write_text("\x1e".join(json.dumps(p, indent=1) for p in pages))
    got = S.read_odata(spark, str(tmp_path), separator=S.SEQUENCE).collect()
    assert sorted((r["k"], r["n"]) for r in got) == [(1, "a"), (2, None), (3, "alone")]


@pytest.mark.parametrize("name", ["src_odata", "src_json"])
def test_files_read_do_not_grow_with_the_documents(spark, name):
    assert len(QUERIES[name](spark, "/root/testdata/sf0.01").inputFiles()) <= 8  # 15 pages, 75 documents
