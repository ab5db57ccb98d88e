"""Corpus pipeline: language ID, near-copy removal, benchmark decontamination, source mixing, sharding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import tabulon
from tabulon.llm import decontaminate, language, mixing, shards, similar, simhash
from tabulon.scale.storage import materialize

# Functions that run in Python workers travel with their tasks, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(tabulon)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts that no learned language fits; the rest stays as it is."""
    return language.keep_known(docs, language.learn_profiles(docs.where(language.fold() != 2)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id.

    Near are fingerprints within two bits, and texts with a Jaccard coefficient of 0.8 or more over five words.
    """
    return simhash.keep_first(docs, alike=similar.THRESHOLD)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more lies in 13-word windows of a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mix, in which each source weighs its size to the power 1/2 while it lasts."""
    return mixing.with_places(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard, 0 to 39, near equal in bytes; equal texts share a shard.

    The shards are consecutive stretches of the mix and hold their documents in its order.
    """
    return shards.with_shards(docs, 40, order_col=mixing.PLACE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("near_copies", near_copies),
    ("decontaminated", decontaminated),
    ("mixed", mixed),
    ("sharded", sharded),
]

# Fingerprints, profiles and the schedule are out of SQL's reach; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; every stage is stored and read back before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs.drop(mixing.PLACE)
