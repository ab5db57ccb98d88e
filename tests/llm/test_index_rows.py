"""The stored postings of op8: row groups and files stay small however much text a task reads."""

import glob
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from tabulon.llm import decontaminate
from tabulon.scale import storage


def _files(df):
    return [pq.ParquetFile(f.removeprefix("file:")).metadata for f in df.inputFiles()]


def test_packed_numbers_come_back():
    for values in ([], [0], [1, 255, 256, 65_535, 2**24, 2**31 - 1, -1]):
        assert decontaminate._from_planes(decontaminate._planes(np.array(values, np.int64))).tolist() == values


def test_row_groups_of_postings_stay_small(spark):
    """90 segments of one task, about 21 MB: one row group, of any length up to 100 rows, would be held whole by writer and reader."""
    docs = spark.range(0, 90, 1, 1).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 20000), i -> 'w' || (id * 7 + i))) AS text")
    index = decontaminate.build_index(docs, segment_words=20_000)
    groups = [m.row_group(i) for m in _files(index) for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 90 and len(groups) > 1
    row = max(g.total_byte_size / g.num_rows for g in groups)
    assert max(g.total_byte_size for g in groups) <= 2 * decontaminate.STORED["parquet.block.size"] + row
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(600, 620)))], "item_id long, text string")
    got = Counter((r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontaminate.contamination(index, items).collect())
    # Document d holds w(7 d + 1) to w(7 d + 20000): the item's words from 600 on, or from 7 d + 1 on if 13 of them are left.
    want = Counter()
    for d in range(90):
        left = 620 - max(600, 7 * d + 1)
        want[20_000, left if left >= 13 else 0, ("1",) if left >= 13 else ()] += 1
    assert got == want


def test_hits_of_a_block_share_files(spark):
    """Forty tasks find hits of two blocks: not one file for each task and block, but a few for each block."""
    docs = spark.range(0, 80, 1, 40).selectExpr("id AS doc_id", "'a b c d e f g h i j k l m' AS text")
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l m"), (2, "c d e")], "item_id long, text string")
    index = decontaminate.build_index(docs)
    assert len(index.inputFiles()) == 40
    got = Counter((r["n_hit"], tuple(r["items"])) for r in decontaminate.contamination(index, items, block_words=3).collect())
    assert got == Counter({(13, ("1", "2")): 80})
    hits = [p for p in storage._written if "/hits-" in p][-1].removeprefix("file:")
    assert len([f for f in glob.glob(f"{hits}/part-*") if pq.read_metadata(f).num_rows]) <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
