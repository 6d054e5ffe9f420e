"""Run registered queries and their SQL side by side: ``python -m checks.compare DIR [key ...]``."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

from checks.catalog import QUERIES
from checks.oracle import ORACLE

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, datetime.datetime) and v.time() == datetime.time():
        return v.date()
    return v


def _sorted(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_value(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def mismatch(spark, con, sf_dir: str, key: str) -> str | None:
    """None if Spark and SQL agree in names, types, row count and every value."""
    if key not in ORACLE:
        return "no SQL"
    df = QUERIES[key](spark, sf_dir)
    got = _sorted([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(ORACLE[key])
    names = [d[0] for d in cur.description]
    want = _sorted(cur.fetchall(), names)
    if sorted(df.columns) != sorted(names):
        return f"columns differ: {sorted(set(df.columns) ^ set(names))}"
    plain = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "date": "DATE", "boolean": "BOOLEAN"}
    types = {d[0]: str(d[1]) for d in cur.description}
    other = {c: (t, types[c]) for c, t in df.dtypes if plain.get(t) != types[c]}
    if other:
        return f"types differ: {other}"
    if len(got) != len(want):
        return f"{len(got)} rows, SQL has {len(want)}"
    cols = sorted(names)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        cells = [(c, a, b) for c, a, b in zip(cols, g, w) if a != b][:4]
        return f"{len(bad)} rows differ, first: {g[:3]} {cells}"
    return None


def main() -> None:
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, keys = sys.argv[1], sys.argv[2:] or list(QUERIES)
    con = connect(sf_dir)
    for key in keys:
        start = time.time()
        try:
            problem = mismatch(spark, con, sf_dir, key)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        state = "ok" if problem is None else "FAIL " + problem
        oracle = "sql" if key in ORACLE else "rows"
        print(f"{key:26s} {oracle:4s} {time.time() - start:6.2f}s {state}", flush=True)


if __name__ == "__main__":
    main()
