"""Compares queries with their SQL: python -m tests.compare SF_DIR [NAME...]"""

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def bag(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differ(spark, con, sf_dir, query, sql):
    """None if rows and column names are the same, else what differs."""
    df = query(spark, sf_dir)
    got, rel = bag(df.columns, df.collect()), con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    want = bag(rel.columns, rel.fetchall())
    if got != want:
        return f"{sum(got.values())} and {sum(want.values())} rows; only ours {list((got - want).items())[:3]}, only theirs {list((want - got).items())[:3]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, names = sys.argv[1], sys.argv[2:]
    con, queries, oracles = connect(sf_dir), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or [n for n in queries if not n.startswith("op") and n != "pipeline"]:
        began = time.time()
        try:
            why = differ(spark, con, sf_dir, queries[name], oracles[name]) if name in oracles else f"rows only: {queries[name](spark, sf_dir).count()}"
        except Exception as e:
            why = f"{type(e).__name__}: {str(e)[:300]}"
        bad += bool(why) and not why.startswith("rows only")
        print(f"{name} {time.time() - began:.1f}s {why or 'same'}", flush=True)
    print(len(queries), "queries,", bad, "bad")
