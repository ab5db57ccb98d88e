"""Shared scratch storage.

Order-dependent operators need row positions that do not move when a lost executor makes Spark
recompute a stage, so they write their sorted rows once to the folder named by
``spark.checkpoint.dir`` and read them back. Columnar files beat an RDD checkpoint here: the follow-up
count per block reads one column instead of whole rows.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
_fallback: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder visible to every executor; a local temp folder only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    if not _fallback:  # the setting itself is fixed once a session runs
        _fallback.append(tempfile.mkdtemp(prefix="spark-"))
    return _fallback[0]


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/tabulon/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame, label: str, options: dict | None = None) -> DataFrame:
    """Write ``df`` once, with ``options`` of the writer, and continue from the stored copy."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> int:
    """Delete every scratch table this process wrote; call when results are no longer needed."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        removed += bool(path.getFileSystem(conf).delete(path, True))
    return removed
