"""Operators that combine frames of two or three streams, as expressions over joined planes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.planes import at, bound, cdiv, clip, pixels, zipped

BLACK, WHITE = 16, 235


def interleave(a: DataFrame, b: DataFrame, frame: str, compat: bool = False) -> DataFrame:
    """Frames of a and b by turns: out_frame and the columns of both, as long as both last (compat: and one more of a
    where a is longer). An equi-join on the frame number; nothing is ordered."""
    both = a.select(frame).join(b.select(frame), frame, "left_semi")
    ends = both.agg(F.max(frame).alias("__last"))
    a2 = a.join(F.broadcast(ends), F.col(frame) <= F.col("__last") + int(compat)).drop("__last")  # one row
    left = a2.withColumn("out_frame", F.col(frame) * 2)
    right = b.join(a.select(frame), frame, "left_semi").withColumn("out_frame", F.col(frame) * 2 + 1)
    return left.unionByName(right)


def interleave_keyed(a: DataFrame, b: DataFrame, key: str, frame: str) -> DataFrame:
    """Alternate reading of two inputs of every key, up to the end of the shorter: out_frame beside the columns."""
    on = [key, frame]
    left = a.join(b.select(*on), on, "left_semi").withColumn("out_frame", F.col(frame) * 2)
    return left.unionByName(b.join(a.select(*on), on, "left_semi").withColumn("out_frame", F.col(frame) * 2 + 1))


def zip_streams(streams: list[tuple[DataFrame, int]], frame: str) -> DataFrame:
    """Positional zip: each (df, offset) gives its row at frame - offset; columns of the k-th get the suffix _k."""
    out = None
    for k, (df, offset) in enumerate(streams):
        one = df.withColumn(frame, F.col(frame) + offset).select(frame, *[F.col(c).alias(f"{c}_{k}") for c in df.columns if c != frame])
        out = one if out is None else out.join(one, frame)
    return out


def blend(a: Column, b: Column, opacity) -> Column:
    return zipped(a, b, lambda x, y: F.shiftright((256 - opacity) * x + opacity * y, 8))


def ramp(frame: Column, first: int, last: int, duration: int) -> Column:
    """Opacity on its way from first to last over a transition; one frame long, it is first."""
    return F.lit(first) + cdiv(frame * (last - first), duration - 1) if duration > 1 else F.lit(first)


def matte_blend(a: Column, b: Column, matte: Column) -> Column:
    m = F.transform(matte, lambda v: clip(v, BLACK, WHITE))
    both = F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    return F.zip_with(both, m, lambda p, v: cdiv((WHITE - v) * p.a + (v - BLACK) * p.b, WHITE - BLACK))


def _freeze(x, y):
    return F.when(y < BLACK, F.lit(BLACK).cast("long")).otherwise(F.greatest(WHITE - cdiv((WHITE - x) * (WHITE - x), y), F.lit(BLACK).cast("long")))


#: Ways of multi_blend: luma of a (x) under luma of b (y).
MODES = {
    1: lambda x, y: clip(x + 2 * y - WHITE, BLACK, WHITE),
    2: lambda x, y: F.greatest(x + y - WHITE, F.lit(BLACK).cast("long")),
    3: lambda x, y: F.shiftright(x * y, 8),
    4: lambda x, y: clip(F.coalesce(cdiv(x * y, 255 - y), F.lit(BLACK).cast("long")), BLACK, WHITE),
    5: lambda x, y: F.abs(x - y),
    6: lambda x, y: WHITE - F.abs(WHITE - x - y),
    7: _freeze,
    8: lambda x, y: _freeze(y, x),
    9: lambda x, y: F.when(y < 128, F.shiftright(x * y, 7)).otherwise(F.greatest(WHITE - F.shiftright((WHITE - y) * (WHITE - x), 7), F.lit(BLACK).cast("long"))),
    10: lambda x, y: F.greatest(x, y),
}


def multi_blend(a: Column, b: Column, mode: int) -> Column:
    return zipped(a, b, MODES[mode])


def fade_factor(frame: Column, duration: int) -> Column:
    """1 at the start, 1/256 at the end of a fade."""
    return F.exp(frame * (-math.log(256) / (duration + 1)))


def fade(plane: Column, colour: int, factor: Column) -> Column:
    """From the plane towards a constant, truncated to whole values. Samples of sound fade alike, towards 0."""
    return F.transform(plane, lambda p: ((1 - factor) * colour + factor * p).cast("long"))


@bound
def wipe(a: Column, b: Column, w: int, h: int, direction: int, columns: int, phase: float, reposition: int = 0) -> Column:
    """A transition front runs through `columns` stripes: direction 1 right, 2 left, 3 down, 4 up. reposition 1 moves
    the leaving picture (a), 2 the coming one (b), 3 both."""
    side = h if direction > 2 else w
    stripe = side // columns
    step = w if direction > 2 else 1
    front, back = int(stripe * phase) * step, int(stripe * (1 - phase)) * step
    edge = stripe * (phase if direction % 2 else 1 - phase)
    va, vb = reposition % 2, reposition >= 2

    def pixel(i):
        before = ((cdiv(i, w) if direction > 2 else i % w) % stripe) < edge
        if direction % 2:
            return F.when(before, at(b, i + back * vb)).otherwise(at(a, i - front * va))
        return F.when(before, at(a, i + front * va)).otherwise(at(b, i - back * vb))

    return pixels(w * h, pixel)


@bound
def overlay(a: Column, b: Column, w: int, h: int, x: int, y: int, bw: int, bh: int) -> Column:
    """Picture b, of bw x bh, over a at (x, y)."""

    def pixel(i):
        col, row = i % w - x, cdiv(i, w) - y
        inside = (col >= 0) & (col < bw) & (row >= 0) & (row < bh)
        return F.when(inside, at(b, row * bw + col)).otherwise(at(a, i))

    return pixels(w * h, pixel)
