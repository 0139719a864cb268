"""Runs registered queries on Spark and their SQL in DuckDB, and compares rows, column names and values.

    python -m tests.oracle [sf] [name-prefix ...]
"""

from __future__ import annotations

import os
import sys
import time
from decimal import Decimal

import duckdb
from pyspark.sql import SparkSession

DATA = os.environ.get("TESTDATA", "/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def make_spark(cores: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def _value(v):
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, (float, Decimal)):
        return ("f", round(float(v), 9) + 0.0)
    return ("s", str(v)) if v is not None else ("", "")


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_value(r[i]) for i in order) for r in rows)


def compare(spark, name, sf_dir, queries, oracles):
    df = queries[name](spark, sf_dir)
    got = table_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in oracles:
        return len(got[1]), None
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    result = con.execute(oracles[name])
    want = table_of([d[0] for d in result.description], result.fetchall())
    if got[0] != want[0]:
        return len(got[1]), f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        have, need = set(got[1]), set(want[1])
        extra, miss = sorted(have - need)[:2], sorted(need - have)[:2]
        return len(got[1]), f"rows {len(got[1])} vs {len(want[1])}\n   spark {str(extra)[:700]}\n   sql   {str(miss)[:700]}"
    return len(got[1]), ""


def main(sf="0.01", *prefixes):
    import __spark_entry__ as entry

    spark = make_spark()
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for name in sorted(queries):
        if prefixes and not name.startswith(tuple(prefixes)):
            continue
        start = time.time()
        try:
            n, problem = compare(spark, name, f"{DATA}/sf{sf}", queries, oracles)
        except Exception as error:  # report and go on
            n, problem = 0, f"{type(error).__name__}: {str(error)[:1500]}"
        state = "rows" if problem is None else "ok" if problem == "" else "FAIL"
        print(f"{state:5}{name:34}{n:8} rows {time.time() - start:6.2f}s {problem or ''}", flush=True)
        if state == "FAIL":
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main(*sys.argv[1:])
