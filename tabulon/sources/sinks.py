"""Loading results into tables and refreshing them."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from tabulon.sources.naming import table_name


def target_table(spark: SparkSession, query: str) -> str | None:
    """Existing table for a query: its exact name first, then the sanitised one."""
    for name in dict.fromkeys((query, table_name(query))):
        if "`" not in name and " " not in name and spark.catalog.tableExists(f"`{name}`"):
            return name
    return None


def load_table(df: DataFrame, query: str) -> int:
    """Replace the query's table with the result; returns the rows it now holds.

    Rows go to a new folder of the warehouse, and the table is a view that one catalog change points at it, whatever the
    schema: a reader sees the old rows or the new ones. A failing job leaves the old content alone. The folder before the
    last one is removed; readers that began before the change keep theirs. A stored table of that name, not made by
    this function, is replaced by the view once.
    """
    spark = df.sparkSession
    target = target_table(spark, query) or table_name(query)
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{target}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    rows = spark.read.parquet(folder).count()
    shown = _folders(spark, target)
    if shown is None and spark.catalog.tableExists(f"`{target}`"):
        spark.sql(f"DROP TABLE `{target}`")
    before = (shown or [""])[0]
    spark.sql(f"CREATE OR REPLACE VIEW `{target}` TBLPROPERTIES ('{_NOW}' = '{folder}', '{_BEFORE}' = '{before}') AS SELECT * FROM parquet.`{folder}`")
    for old in (shown or [])[1:]:
        if re.search(rf"/{re.escape(target)}-[0-9a-f]{{32}}/?$", old):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return rows


_NOW, _BEFORE = "tabulon.folder", "tabulon.folder.before"


def _folders(spark: SparkSession, target: str) -> list[str] | None:
    """Folders that a loaded view shows and showed before; None if there is no such view."""
    if not spark.catalog.tableExists(f"`{target}`") or spark.catalog.getTable(f"`{target}`").tableType != "VIEW":
        return None
    found = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES `{target}`").collect()}
    return [found[k] for k in (_NOW, _BEFORE) if found.get(k)]


def refresh(
    spark: SparkSession, queries: Mapping[str, Callable[[], object]], flagged: Sequence[str] | None = None
) -> DataFrame:
    """Re-run queries in order into their tables; one row per query with ``status``, ``rows``, ``detail``.

    Statuses are ``ok``, ``notTable`` (the query did not give a table), ``noTarget`` (nothing to load into)
    and ``failed`` (its old table stays).
    """
    lines = []
    for name in flagged if flagged is not None else list(queries):
        try:
            result = queries[name]()
            if not isinstance(result, DataFrame):
                lines.append((name, "notTable", None, type(result).__name__))
            elif target_table(spark, name) is None:
                lines.append((name, "noTarget", None, table_name(name)))
            else:
                lines.append((name, "ok", load_table(result, name), None))
        except Exception as e:  # one failing query must not stop the others
            lines.append((name, "failed", None, type(e).__name__))
    return spark.createDataFrame(lines, "query string, status string, rows bigint, detail string")
