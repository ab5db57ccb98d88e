"""The mix decides which documents share a shard, and their order in it."""

from pyspark.sql import functions as F

import corpus_pipeline

STAGES = dict(corpus_pipeline.STAGES)


def test_shards_are_stretches_of_the_mix(spark):
    # Ids run source by source, so shards cut by id would hold one source each.
    docs = spark.range(4800).select(
        F.col("id").alias("doc_id"), F.format_string("text number %05d", "id").alias("text"), F.lit("en").alias("lang"),
        F.when(F.col("id") < 2400, "a").otherwise("b").alias("source"), F.lit(17).alias("n_chars"),
    )
    out = STAGES["sharded"](spark, STAGES["mixed"](spark, docs, ""), "")
    rows = out.collect()
    assert len(rows) == 4800 and out.columns[:5] == docs.columns
    held = {n: [r for r in rows if r["shard"] == n] for n in range(40)}
    for shard in held.values():
        assert abs(sum(r["source"] == "a" for r in shard) - 60) <= 16  # half, up to one block
    places = [r["mix_place"] for n in range(40) for r in held[n]]
    assert places == sorted(places)  # as stored: shard by shard in the order of the mix
