"""Regions: sets of half-open extents [start, stop) by row, with union, subtraction, intersection and flood fill."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union(df: DataFrame, key: list[str], start: str = "x0", stop: str = "x1") -> DataFrame:
    """Extents that overlap or touch become one; empty ones vanish."""
    w = Window.partitionBy(*key).orderBy(start, stop)
    before = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = df.filter(F.col(stop) > F.col(start)).withColumn("__new", F.coalesce(F.col(start) > before, F.lit(True)).cast("long"))
    d = d.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*key, "__run").agg(F.min(start).alias(start), F.max(stop).alias(stop)).drop("__run")


def sweep(a: DataFrame, b: DataFrame, key: list[str], keep, start: str = "x0", stop: str = "x1") -> DataFrame:
    """A boundary sweep: keep(in_a, in_b) tells which stretches between ends stay; touching ones become one."""
    ends = lambda d, side: d.filter(F.col(stop) > F.col(start)).select(*key, F.explode(F.array(F.struct(F.col(start).alias("x"), F.lit(1).alias("d")), F.struct(F.col(stop).alias("x"), F.lit(-1).alias("d")))).alias("e")).select(*key, "e.x", *[(F.col("e.d") if s == side else F.lit(0)).alias(s) for s in ("a", "b")])
    at = ends(a, "a").unionByName(ends(b, "b")).groupBy(*key, "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = Window.partitionBy(*key).orderBy("x")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = at.select(*key, F.col("x").alias(start), F.lead("x").over(w).alias(stop), (F.sum("a").over(run) > 0).alias("a"), (F.sum("b").over(run) > 0).alias("b"))
    return union(d.filter(keep(F.col("a"), F.col("b")) & F.col(stop).isNotNull()).select(*key, start, stop), key, start, stop)


def subtract(a: DataFrame, b: DataFrame, key: list[str], start: str = "x0", stop: str = "x1") -> DataFrame:
    return sweep(a, b, key, lambda x, y: x & ~y, start, stop)


def intersect(a: DataFrame, b: DataFrame, key: list[str], start: str = "x0", stop: str = "x1") -> DataFrame:
    return sweep(a, b, key, lambda x, y: x & y, start, stop)


def flood(allowed: DataFrame, seed: DataFrame, row: str = "y", start: str = "x0", stop: str = "x1") -> DataFrame:
    """Extents of `allowed` connected with the seed across overlapping extents of neighbouring rows. Each round joins
    rows y - 1, y and y + 1 on the row (an equi-join); lineage is cut where spark.checkpoint.dir names a folder for it."""
    spark = allowed.sparkSession
    ext = union(allowed, [row], start, stop)
    if spark.conf.get("spark.checkpoint.dir", None):
        ext = ext.checkpoint()
    touch = lambda a, b: (F.col(f"{a}.{start}") < F.col(f"{b}.{stop}")) & (F.col(f"{b}.{start}") < F.col(f"{a}.{stop}"))
    got = ext.alias("e").join(seed.alias("s"), (F.col(f"e.{row}") == F.col(f"s.{row}")) & touch("e", "s"), "left_semi")
    front, n = got, got.count()
    while n:
        near = front.select(F.explode(F.array(F.col(row) - 1, F.col(row) + 1)).alias(row), start, stop)
        front = ext.alias("e").join(near.alias("s"), (F.col(f"e.{row}") == F.col(f"s.{row}")) & touch("e", "s"), "left_semi").join(got, [row, start, stop], "left_anti")
        if spark.conf.get("spark.checkpoint.dir", None):
            front = front.checkpoint()
        n = front.count()
        got = got.unionByName(front)
    return got


def free_gaps(df: DataFrame, key: list[str], start: str, stop: str) -> DataFrame:
    """Gaps between allocated extents: key, start, stop."""
    merged = union(df, key, start, stop)
    w = Window.partitionBy(*key).orderBy(start)
    return merged.select(*key, F.col(stop).alias(start), F.lead(start).over(w).alias(stop)).filter(F.col(stop).isNotNull())


def first_fit(df: DataFrame, key: list[str], size: int, start: str = "x0", stop: str = "x1") -> DataFrame:
    """Where `size` units go among each key's allocated extents: the first gap that holds them, else behind the last."""
    merged = union(df, key, start, stop)
    w = Window.partitionBy(*key).orderBy(start)
    room = merged.select(*key, F.col(stop).alias(start), F.lead(start).over(w).alias("__next"))
    return room.filter(F.col("__next").isNull() | (F.col("__next") - F.col(start) >= size)).groupBy(*key).agg(F.min(start).alias(start))
