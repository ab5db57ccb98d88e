"""Run registered queries next to their SQL on DuckDB: ``python verify.py [prefix ...]``."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

from tabulon.checks import load

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(v):
    """One comparable form per value; integers and floats stay distinct."""
    if isinstance(v, bool) or v is None or isinstance(v, (str, int)):
        return repr(v)
    if isinstance(v, float):
        return "None" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return f"D{v.normalize()}"
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(plain(x) for x in v.values()) + "}"
    return repr(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, folder, fn, sql):
    df = fn(spark, folder)
    a_names, a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows {len(a)}", len(a) >= 0
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    cur = con.execute(sql)
    b_names, b = rows_of([d[0] for d in cur.description], cur.fetchall())
    if a_names != b_names:
        return f"columns {a_names} vs {b_names}", False
    if a == b:
        return f"match {len(a)}", True
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    return f"rows {len(a)} vs {len(b)}, differing {len(diff)}: {diff[:2]}", False


def main():
    queries, oracles = load()
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    names = [n for n in queries if not wanted or any(n.startswith(w) for w in wanted)]
    spark = session()
    bad = []
    for n in names:
        start = time.time()
        try:
            note, ok = compare(spark, folder, queries[n], oracles.get(n))
        except Exception as e:
            note, ok = f"{type(e).__name__}: {str(e)[:700]}" if "-v" not in wanted else traceback.format_exc(), False
        print(f"{'ok  ' if ok else 'FAIL'} {n:24} {time.time() - start:6.2f}s {note if not ok else note[:60]}", flush=True)
        if not ok:
            bad.append(n)
    print(f"{len(names) - len(bad)}/{len(names)} ok; failing: {bad}")


if __name__ == "__main__":
    main()
