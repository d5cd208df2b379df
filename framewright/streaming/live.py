"""Structured Streaming forms of the frame operators.

The reference model is one ordered stream at a time, so state is keyed by stream: the last frame and counters, nothing
that grows with the input. Sources are directories of frame records (Parquet or JSON), checkpoints lie where the caller
says. Windowed sums with a watermark are an extension.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_frames(spark: SparkSession, path: str, schema: str, files_at_once: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def _stateful(df: DataFrame, key: str, out: str, state: str, step) -> DataFrame:
    """step(state or None, sorted pandas frame) -> (rows, new state)."""

    def run(k, batches: Iterator[pd.DataFrame], group: GroupState):
        rows = pd.concat(list(batches), ignore_index=True)
        got, new = step(group.get if group.exists else None, rows)
        group.update(new)
        if len(got):
            yield got

    return df.groupBy(key).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def lost_frames(df: DataFrame, key: str, seq: str) -> DataFrame:
    """key, seq, lost: gaps before each frame, across micro-batches too. Frames behind the last one seen are late: lost
    is -1 and the state stays."""

    def step(state, p):
        last = state[0] if state else None
        out = []
        for k, s in p.sort_values(seq)[[key, seq]].itertuples(index=False, name=None):
            if last is not None and s <= last:
                out.append((k, s, -1))
                continue
            out.append((k, s, 0 if last is None else s - last - 1))
            last = s
        return pd.DataFrame(out, columns=[key, seq, "lost"]), (last,)

    kind = dict(df.dtypes)[key]
    return _stateful(df, key, f"{key} {kind}, {seq} long, lost long", "last long", step)


def scene_cuts(df: DataFrame, key: str, order: str, value: str, threshold: float) -> DataFrame:
    """key, order, scene: a new scene where the value leaves the last frame's by more than the threshold."""

    def step(state, p):
        scene, last = state if state else (-1, None)
        out = []
        for k, n, v in p.sort_values(order)[[key, order, value]].itertuples(index=False, name=None):
            if last is None or abs(v - last) > threshold:
                scene += 1
            last = float(v)
            out.append((k, n, scene))
        return pd.DataFrame(out, columns=[key, order, "scene"]), (scene, last)

    kind = dict(df.dtypes)[key]
    return _stateful(df, key, f"{key} {kind}, {order} long, scene long", "scene long, last double", step)


def stabilise(df: DataFrame, key: str, order: str, motion: str, alpha: float = 0.95) -> DataFrame:
    """key, order, gs: the decayed sum of motions, carried from batch to batch."""

    def step(state, p):
        gs = state[0] if state else 0.0
        out = []
        for k, n, v in p.sort_values(order)[[key, order, motion]].itertuples(index=False, name=None):
            gs = gs * alpha + v / 2
            out.append((k, n, gs))
        return pd.DataFrame(out, columns=[key, order, "gs"]), (gs,)

    kind = dict(df.dtypes)[key]
    return _stateful(df, key, f"{key} {kind}, {order} long, gs double", "gs double", step)


def segments(df: DataFrame, key: str, order: str, size: str, limit: int) -> DataFrame:
    """key, order, segment: whole limits in the bytes before each unit."""

    def step(state, p):
        total = state[0] if state else 0
        out = []
        for k, n, b in p.sort_values(order)[[key, order, size]].itertuples(index=False, name=None):
            out.append((k, n, total // limit))
            total += int(b)
        return pd.DataFrame(out, columns=[key, order, "segment"]), (total,)

    kind = dict(df.dtypes)[key]
    return _stateful(df, key, f"{key} {kind}, {order} long, segment long", "total long", step)


def rates(df: DataFrame, key: str, stamp: str, size: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Extension: units and bytes by tumbling window, behind a watermark."""
    return df.withWatermark(stamp, late).groupBy(F.window(stamp, window), key).agg(F.count("*").alias("units"), F.sum(size).alias("bytes"))
