"""The engine's views of the given tables: events as streams of frames, embeddings as 8 x 8 blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, n (dense from 0 by time), v, t, event_id, ts."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    return e.select("user_id", (F.row_number().over(w) - 1).cast("long").alias("n"), F.col("value").alias("v"), F.col("event_type").alias("t"), "event_id", "ts")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x: vectors as planes of 64 values in 0..255."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: F.floor((v.cast("double") + 0.6) * 212)).alias("x"), "label")


def neighbours(b: DataFrame, k: int) -> DataFrame:
    """Each block with the k that follow it by id: id, x, x1 .. xk. The id goes out once per role and meets in one
    grouping, so a chain of k joins is one shuffle."""
    if k == 1:
        return b.select("id", "x").join(b.select((F.col("id") - 1).alias("id"), F.col("x").alias("x1")), "id")
    parts = F.explode(F.array(*[F.struct((F.col("id") - i).alias("id"), F.lit(i).alias("i"), "x") for i in range(k + 1)])).alias("p")
    pick = [F.max(F.when(F.col("i") == i, F.col("x"))).alias(f"x{i or ''}") for i in range(k + 1)]
    return b.select(parts).select("p.*").groupBy("id").agg(F.count("*").alias("__n"), *pick).filter(F.col("__n") == k + 1).drop("__n")


def cells(df: DataFrame, plane, key: str = "id") -> DataFrame:
    """id, i, x of each value of a plane."""
    return df.select(key, F.posexplode(plane).alias("i", "x")).select(key, F.col("i").cast("long").alias("i"), F.col("x").cast("long").alias("x"))
