"""Filters of one frame: shifts, borders, smoothing, resampling, colour.

Each is a Column over a plane (row-major ARRAY<BIGINT>, width w, height h). `map_planes` runs a numpy kernel in Arrow
batches, for planes too large to gather by index.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.planes import at, bound, cdiv, clip, gathered, in_rectangle, let, neighbour, pixels, total, zipped
from ..functions.scalar import fir_taps, gaussian_taps, resample_weights

BLACK, GREY = 16, 128


def map_planes(df: DataFrame, column: str, kernel: Callable[[np.ndarray], np.ndarray], w: int) -> DataFrame:
    """Applies kernel(2-d int64 array) -> 2-d array to a plane column, batch by batch. Null planes stay null."""
    index, schema = df.columns.index(column), df.schema

    def run(batches):
        for b in batches:
            out = []
            for p in b.column(index).to_pylist():
                out.append(None if p is None else np.asarray(kernel(np.array(p, np.int64).reshape(-1, w)), np.int64).ravel().tolist())
            cols = list(b.columns)
            cols[index] = pa.array(out, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return df.mapInArrow(run, schema)


def long(v: int) -> Column:
    return F.lit(v).cast("long")


@bound
def shift(p: Column, w: int, h: int, dx: int, dy: int = 0, fill: int = BLACK) -> Column:
    """Moves the picture right and down; what comes in is fill."""
    return p if not (dx or dy) else pixels(w * h, lambda i: F.coalesce(neighbour(p, i, w, h, -dx, -dy, "none"), long(fill)))


@bound
def border(p: Column, w: int, h: int, x: int, y: int, bw: int, bh: int, fill: int = BLACK) -> Column:
    """Black outside a rectangle. A rectangle that leaves the picture changes nothing."""
    if x < 0 or y < 0 or x + bw > w or y + bh > h:
        return p
    return pixels(w * h, lambda i: F.when(in_rectangle(i, w, x, y, bw, bh), at(p, i)).otherwise(fill))


@bound
def fill_area(p: Column, w: int, h: int, x: int, y: int, rw: int, rh: int, colour: int) -> Column:
    return pixels(w * h, lambda i: F.when(in_rectangle(i, w, x, y, rw, rh), colour).otherwise(at(p, i)))


def darken(p: Column, percent: int, centre: int = BLACK) -> Column:
    """Towards the centre by a percentage, truncated; luma (centre 16) is held at 16 at least."""
    f = 1 - 0.01 * percent
    out = lambda v: centre + ((v - centre) * f).cast("long")
    return F.transform(p, lambda v: F.greatest(out(v), long(BLACK)) if centre == BLACK else out(v))


@bound
def copy_area(p: Column, w: int, h: int, y: int, rh: int, n: int, from_above: bool = True) -> Column:
    """Rows y..y+rh-1 repeat the n rows above (or below) them."""

    def pixel(i):
        row = cdiv(i, w)
        src = (row - y) % n + (y - n if from_above else y + rh)
        return F.when((row >= y) & (row < y + rh), at(p, clip(src, 0, h - 1) * w + i % w)).otherwise(at(p, i))

    return pixels(w * h, pixel)


@bound
def average_area(p: Column, w: int, h: int, n: int) -> Column:
    """Each n x n block becomes its whole mean; blocks at the right and bottom may be smaller."""

    def pixel(i):
        x0, y0 = cdiv(i % w, n) * n, cdiv(cdiv(i, w), n) * n
        cells = F.array_compact(F.array(*[F.when((x0 + dx < w) & (y0 + dy < h), at(p, (y0 + dy) * w + x0 + dx)) for dy in range(n) for dx in range(n)]))
        return let(cells, lambda c: cdiv(total(c), F.size(c)))

    return pixels(w * h, pixel)


def mono(p: Column) -> Column:
    return F.array_repeat(long(GREY), F.size(p))


@bound
def swap_fields(p: Column, w: int, h: int) -> Column:
    """Exchanges each even row with the odd one below it; an odd last row stays."""

    def pixel(i):
        row = cdiv(i, w)
        to = F.when(row % 2 == 1, row - 1).when(row + 1 < h, row + 1).otherwise(row)
        return at(p, to * w + i % w)

    return pixels(w * h, pixel)


@bound
def field(p: Column, w: int, h: int, odd: bool) -> Column:
    """The rows of one field."""
    n = h // 2 if odd else (h + 1) // 2
    return pixels(w * n, lambda i: at(p, (cdiv(i, w) * 2 + int(odd)) * w + i % w))


@bound
def weave(top: Column, bottom: Column, w: int, h: int) -> Column:
    return pixels(w * h, lambda i: F.when(cdiv(i, w) % 2 == 0, at(top, cdiv(cdiv(i, w), 2) * w + i % w)).otherwise(at(bottom, cdiv(cdiv(i, w), 2) * w + i % w)))


# Taps of the diamond filter as (dx, dy, weight); they sum to 20.
DIAMOND = [(-2, 0, 1), (-1, -1, 1), (-1, 0, 2), (-1, 1, 1), (0, -2, 1), (0, -1, 2), (0, 0, 4), (0, 1, 2), (0, 2, 1), (1, -1, 1), (1, 0, 2), (1, 1, 1), (2, 0, 1)]
AROUND = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy]


@bound
def diamond_blur(p: Column, w: int, h: int, t: int) -> Column:
    """Thirteen taps over 20, blended with the source by t of 256; borders replicate."""
    if t == 0:
        return p

    def pixel(i):
        v = sum((neighbour(p, i, w, h, dx, dy) * k for dx, dy, k in DIAMOND), long(0))
        return cdiv(at(p, i) * (256 - t) + cdiv(v, 20) * t, 256)

    return pixels(w * h, pixel)


@bound
def clamp_outliers(p: Column, w: int, h: int) -> Column:
    """Holds each value within the range of its neighbours inside the plane."""

    def pixel(i):
        near = gathered(p, i, w, h, AROUND, "none")
        return let(near, lambda n: F.least(F.greatest(at(p, i), F.array_min(n)), F.array_max(n)))

    return pixels(w * h, pixel)


@bound
def similar_mean(p: Column, w: int, h: int, level: int) -> Column:
    """5 x 5 mean weighted by max(0, level - |difference|), the centre by level, rounded to nearest."""
    if level == 0:
        return p

    def pixel(i):
        r = at(p, i)
        near = gathered(p, i, w, h, [(dx, dy) for dy in range(-2, 3) for dx in range(-2, 3) if dx or dy], "none")
        weighted = F.transform(near, lambda v: let(F.greatest(level - F.abs(v - r), long(0)), lambda k: F.struct(k.alias("k"), (k * v).alias("v"))))
        start = F.struct(long(level).alias("k"), (r * level).alias("v"))
        sums = F.aggregate(weighted, start, lambda s, e: F.struct((s.k + e.k).alias("k"), (s.v + e.v).alias("v")))
        return let(sums, lambda s: cdiv(cdiv(s.v * 2, s.k) + 1, 2))

    return pixels(w * h, pixel)


@bound
def threshold_mean(p: Column, w: int, h: int, radius: int, threshold: int, cutoff: float = 1 / 3, weight: int = 1) -> Column:
    """Mean of the values around that lie within a threshold, the centre counting `weight` times, rounded to nearest;
    where they are too few, a 3 x 3 mean whose centre counts eightfold. The outer `radius` values stay."""
    if threshold == 0:
        return p
    least = math.ceil((2 * radius + 1) ** 2 * cutoff)
    span = range(-radius, radius + 1)

    def pixel(i):
        col, row, r = i % w, cdiv(i, w), at(p, i)
        near = F.filter(gathered(p, i, w, h, [(dx, dy) for dy in span for dx in span]), lambda v: F.abs(v - r) < threshold)
        few = cdiv(total(gathered(p, i, w, h, AROUND)) + 8 * r + 8, 16)

        def mean_of(near):
            n = F.size(near).cast("long")
            all_n = n + weight - 1
            return F.when(n <= least, few).otherwise(r + F.floor((2 * (total(near) - n * r) + all_n) / (2 * all_n)))

        mean = let(near, mean_of)
        return F.when((col >= radius) & (col < w - radius) & (row >= radius) & (row < h - radius), mean).otherwise(r)

    return pixels(w * h, pixel)


@bound
def box_mean(p: Column, w: int, h: int, radius: int) -> Column:
    """Plain mean over a square, cut at the borders, rounded to nearest."""
    span = range(-radius, radius + 1)

    def pixel(i):
        near = gathered(p, i, w, h, [(dx, dy) for dy in span for dx in span], "none")
        return let(near, lambda n: cdiv(total(n) + cdiv(F.size(n), 2), F.size(n)))

    return pixels(w * h, pixel)


def _rows_then_columns(p: Column, w: int, h: int, across, down) -> Column:
    """A separable filter: across(plane) then down(plane), both of doubles."""
    return let(F.transform(p, lambda v: v.cast("double")), lambda q: let(across(q, w, h), lambda r: down(r, w, h)))


def _taps(t: list[float], vertical: bool):
    def run(p, w, h):
        def pixel(i):
            out = at(p, i) * t[0]
            for k in range(1, len(t)):
                a, b = ((0, -k), (0, k)) if vertical else ((-k, 0), (k, 0))
                out = out + (neighbour(p, i, w, h, *a) + neighbour(p, i, w, h, *b)) * t[k]
            return out

        return pixels(w * h, pixel)

    return run


@bound
def unsharp(p: Column, w: int, h: int, radius: float, amount: float, threshold: int) -> Column:
    """Adds back what a Gaussian blur takes away, where twice the difference reaches the threshold."""
    t = gaussian_taps(radius)
    blurred = _rows_then_columns(p, w, h, _taps(t, False), _taps(t, True))

    def sharp(v, b):
        # a millionth decides nothing, so that sums of doubles in any order round alike
        return let(F.round(v - b, 6), lambda d: F.when(F.abs(2 * d) < threshold, v).otherwise(clip(F.floor(F.round(v + amount * d, 6) + 0.5), 0, 255)))

    return zipped(p, blurred, sharp)


@bound
def low_pass(p: Column, w: int, h: int, length: int, bandwidth: float) -> Column:
    """Symmetric FIR along rows, then columns; near an edge the longest filter that fits is used."""
    taps = fir_taps(length, bandwidth)

    def one(vertical):
        def run(q, w, h):
            def pixel(i):
                pos, n = (cdiv(i, w), h) if vertical else (i % w, w)
                room = F.least(pos, F.lit(n - 1) - pos, F.lit(length))
                step = w if vertical else 1
                out = F.lit(None).cast("double")
                for k in range(length, -1, -1):
                    v = at(q, i) * taps[k][0]
                    for j in range(1, k + 1):
                        v = v + (at(q, i - j * step) + at(q, i + j * step)) * taps[k][j]
                    out = F.when(room == k, v).otherwise(out)
                return out

            return pixels(w * h, pixel)

        return run

    # a millionth decides nothing, as in unsharp()
    return F.transform(_rows_then_columns(p, w, h, one(False), one(True)), lambda v: F.floor(F.round(F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0)), 6) + 0.5))


@bound
def resample(p: Column, w: int, h: int, ow: int, oh: int, kernel: str = "cubic") -> Column:
    """Separable resampling; the axis that shrinks most goes first. Weights are literals made when planning."""

    def axis(q, n, m, lines, vertical):
        weights = resample_weights(n, m, kernel)
        table = F.array(*[F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in row]) for row in weights])

        def pixel(i, table):
            line, k = (i % lines, cdiv(i, lines)) if vertical else (cdiv(i, m), i % m)
            row = F.get(table, k.cast("int"))
            where = (lambda e: e.i * lines + line) if vertical else (lambda e: line * n + e.i)
            return let(row, lambda r: F.aggregate(r, F.lit(0.0), lambda s, e: s + e.v * at(q, where(e))))

        # the table is a variable too: made once, not for each pixel
        return let(table, lambda t: pixels(m * lines, lambda i: pixel(i, t)))

    across = lambda lines: lambda q: axis(q, w, ow, lines, False)
    down = lambda lines: lambda q: axis(q, h, oh, lines, True)
    q = F.transform(p, lambda v: v.cast("double"))
    if oh == h:  # an axis that keeps its size is not filtered
        q = q if ow == w else let(q, across(h))
    elif ow == w:
        q = let(q, down(w))
    else:
        first, second = (across(h), down(ow)) if ow / w <= oh / h else (down(w), across(oh))
        q = let(q, lambda p: let(first(p), second))
    return F.transform(q, lambda v: clip(F.floor(F.round(v, 6) + 0.5), 0, 255))  # a millionth decides nothing


@bound
def area_average(p: Column, w: int, h: int, kx: int, ky: int) -> Column:
    """Whole mean of kx x ky cells, rounded to nearest."""
    ow, n = w // kx, kx * ky
    return pixels(ow * (h // ky), lambda i: cdiv(sum((at(p, (cdiv(i, ow) * ky + dy) * w + (i % ow) * kx + dx) for dy in range(ky) for dx in range(kx)), long(0)) + n // 2, n))


@bound
def smooth_edges(p: Column, w: int, h: int) -> Column:
    """Of seven slopes, the one along which three values of the rows above and below fit best (ties to the leftmost) is
    mixed in: between slopes of 1 as a quarter above, a quarter below, else with the values beside them; then the mean with
    the source. Two values at each border stay. Places count on through the rows."""

    def pixel(i):
        misfit = lambda dx: sum((F.abs(at(p, i + dx + k - w) - at(p, i + k)) + F.abs(at(p, i - dx + k + w) - at(p, i + k)) for k in (-1, 0, 1)), long(0))

        def mixed(slope):
            line = lambda at_: at(p, at_ - 1) + 2 * at(p, at_) + at(p, at_ + 1)
            up, down = i + slope - w, i - slope + w
            steep = cdiv(2 * at(p, i) + at(p, up) + at(p, down), 4)
            return F.when(F.abs(slope) <= 1, steep).otherwise(cdiv(2 * line(i) + line(up) + line(down), 16))

        slopes = F.array(*[F.struct(misfit(dx).alias("misfit"), long(dx).alias("dx")) for dx in range(-3, 4)])
        smooth = let(F.array_min(slopes)["dx"], mixed)
        return F.when(in_rectangle(i, w, 2, 2, w - 4, h - 4), cdiv(at(p, i) + smooth, 2)).otherwise(at(p, i))

    return pixels(w * h, pixel)


@bound
def cut(p: Column, w: int, h: int, x: int, y: int, cw: int, ch: int) -> Column:
    """The rectangle of cw x ch at (x, y)."""
    return pixels(cw * ch, lambda i: at(p, (cdiv(i, cw) + y) * w + i % cw + x))


@bound
def place(p: Column, w: int, h: int, ow: int, oh: int, anchor: str = "CC", fill: int = BLACK) -> Column:
    """On a canvas of ow x oh, held at an anchor of T, C or B and L, C or R; what is beyond is cut, the rest is fill."""
    room = lambda spare, side: {"T": 0, "L": 0, "C": int(spare / 2)}.get(side, spare)
    dx, dy = room(ow - w, anchor[1]), room(oh - h, anchor[0])
    return pixels(ow * oh, lambda i: F.when(in_rectangle(i, ow, dx, dy, w, h), at(p, (cdiv(i, ow) - dy) * w + i % ow - dx)).otherwise(long(fill)))


# Colour. Shares of red, green and blue in luma and in the two differences.
LUMA = (0.299, 0.587, 0.114)
BLUE_DIFFERENCE = (-0.168736, -0.331264, 0.5)
RED_DIFFERENCE = (0.5, -0.418688, -0.081312)
POINT = 18  # bits behind the point


def _fixed(v: float) -> int:
    return int(math.floor(v + 0.5)) if v >= 0 else -int(math.floor(0.5 - v))


def rgb_to_ycbcr(r: Column, g: Column, b: Column) -> Column:
    """STRUCT<y, cb, cr> of 8-bit values in fixed point: each product is rounded by itself, the sum shifted down."""
    one = 1 << POINT

    def part(shares, span, base):
        terms = [F.round(F.lit(k * span / 255 * one) * c.cast("double")).cast("long") for k, c in zip(shares, (r, g))]
        last = F.round(F.lit(shares[2] * span / 255 * one) * b.cast("double") + float(one // 2 + base * one)).cast("long")
        return F.shiftright(terms[0] + terms[1] + last, POINT)

    return F.struct(part(LUMA, 219, 16).alias("y"), part(BLUE_DIFFERENCE, 224, 128).alias("cb"), part(RED_DIFFERENCE, 224, 128).alias("cr"))


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> Column:
    """STRUCT<r, g, b>: luma is held to 16..235, differences to 16..240, results to 0..255."""
    one = 1 << POINT
    luma = (clip(y, 16, 235) - 16) * _fixed(255 / 219 * one) + one // 2
    u, v = clip(cb, 16, 240) - 128, clip(cr, 16, 240) - 128
    k = 255 / 224 * one
    out = lambda e: clip(F.shiftright(e, POINT), 0, 255)
    return F.struct(out(luma + v * _fixed(1.402 * k)).alias("r"), out(luma - u * _fixed(0.344136 * k) - v * _fixed(0.714136 * k)).alias("g"), out(luma + u * _fixed(1.772 * k)).alias("b"))


def full_to_video(v: Column) -> Column:
    """0..255 -> 16..235."""
    return F.round(v * (219 / 255) + 16).cast("long")


def video_to_full(v: Column) -> Column:
    return clip(F.round((v - 16) * (255 / 219)).cast("long"), 0, 255)


@bound
def supersample(p: Column, w: int, h: int) -> Column:
    """Twice the size by a triangle filter: each new value is 9, 3, 3 and 1 sixteenths of the four around it."""

    def pixel(i):
        x, y = i % (2 * w), cdiv(i, 2 * w)
        cx, cy = cdiv(x, 2), cdiv(y, 2)
        nx, ny = clip(cx + F.when(x % 2 == 0, -1).otherwise(1), 0, w - 1), clip(cy + F.when(y % 2 == 0, -1).otherwise(1), 0, h - 1)
        v = 9 * at(p, cy * w + cx) + 3 * at(p, cy * w + nx) + 3 * at(p, ny * w + cx) + at(p, ny * w + nx)
        return F.shiftright(v + 8, 4)

    return pixels(4 * w * h, pixel)


@bound
def unpack_yuyv(p: Column) -> Column:
    """Packed y u y v -> STRUCT<y, u, v> planes."""
    pick = lambda start, step: F.transform(F.sequence(long(start), F.size(p).cast("long") - 1, long(step)), lambda i: at(p, i))
    return F.struct(pick(0, 2).alias("y"), pick(1, 4).alias("u"), pick(3, 4).alias("v"))


@bound
def pack_yuyv(y: Column, u: Column, v: Column) -> Column:
    return F.flatten(F.transform(F.sequence(long(0), F.size(u).cast("long") - 1), lambda i: F.array(at(y, 2 * i), at(u, i), at(y, 2 * i + 1), at(v, i))))
