"""Statistics of frames, blocks and packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.planes import at, bound, cdiv, pixels, total, zipped


def histogram(df: DataFrame, plane: str, *by: str) -> DataFrame:
    """Counts of values: by, x, n. The partial count runs before the one shuffle, which carries 256 rows a task and group."""
    return df.select(*by, F.explode(plane).alias("x")).groupBy(*by, "x").agg(F.count("*").alias("n"))


def histogram_delta(cumulative: DataFrame, order: str, *by: str) -> DataFrame:
    """Counts of a frame from counts since the start."""
    w = Window.partitionBy(*by).orderBy(order)
    return cumulative.withColumn("n", F.col("n") - F.coalesce(F.lag("n").over(w), F.lit(0)))


def histogram_peak(hist: DataFrame, *by: str, compat: bool = False) -> DataFrame:
    """The most frequent value, the lowest on ties: by, peak, n. compat: 255 is left out."""
    h = hist.filter("x < 255") if compat else hist
    return h.groupBy(*by).agg(F.max_by("x", F.struct("n", -F.col("x"))).alias("peak"), F.max("n").alias("n"))


def histogram_percent(hist: DataFrame, *by: str) -> DataFrame:
    """Each count against a hundredth of the largest, in whole numbers; null where that hundredth is 0."""
    top = F.max("n").over(Window.partitionBy(*by)) if by else F.max("n").over(Window.partitionBy(F.lit(0)))
    return hist.withColumn("percent", cdiv(F.col("n"), cdiv(top, 100)))


def occupancy(df: DataFrame, u: str, v: str, scale: int) -> DataFrame:
    """Which cells of the scaled (u, v) plane occur."""
    pair = F.explode(F.arrays_zip(F.col(u).alias("u"), F.col(v).alias("v"))).alias("p")
    return df.select(pair).select(cdiv(F.col("p.u"), scale).alias("u"), cdiv(F.col("p.v"), scale).alias("v")).distinct()


@bound
def sampled_mean(plane: Column, n: int, step: int) -> Column:
    """Whole mean of every step-th value."""
    taken = list(range(0, n, step))
    return cdiv(total(F.transform(F.array(*[F.lit(i).cast("long") for i in taken]), lambda i: at(plane, i))), len(taken))


# How far the samples of a frame's brightness lie apart, and which values each takes.
SAMPLE_STEP, SAMPLE_TAKES = 31, [(0, 0), (1, 0), (-3, 1), (-2, 1)]


def luminance_mean(planes: list[tuple[Column, int, int]]) -> Column:
    """Whole mean of four values at every 31st place of each plane (plane, w, h) up to its last row: two from there on, and
    two beside the place below."""
    long = lambda v: F.lit(v).cast("long")

    def taken(p, w, h):
        starts = F.sequence(long(0), long(w * (h - 1) - 1), long(SAMPLE_STEP))
        return total(F.transform(starts, lambda s: sum((at(p, s + dx + dy * w) for dx, dy in SAMPLE_TAKES), long(0))))

    count = sum(len(SAMPLE_TAKES) * len(range(0, w * (h - 1), SAMPLE_STEP)) for _, w, h in planes)
    return cdiv(sum((taken(*p) for p in planes), long(0)), count)


def mean(plane: Column) -> Column:
    return cdiv(total(plane), F.size(plane))


@bound
def variance(plane: Column) -> Column:
    """Sum of squares less the square of the sum over the count, in whole numbers, not divided by the count."""
    s = total(plane)
    return total(F.transform(plane, lambda v: v * v)) - cdiv(s * s, F.size(plane))


def sad(a: Column, b: Column) -> Column:
    return total(zipped(a, b, lambda x, y: F.abs(x - y)))


def ssd(a: Column, b: Column) -> Column:
    return total(zipped(a, b, lambda x, y: (x - y) * (x - y)))


def average(a: Column, b: Column) -> Column:
    """Rounded mean of two references."""
    return zipped(a, b, lambda x, y: F.shiftright(x + y + 1, 1))


def bidirectional_sad(a: Column, before: Column, after: Column) -> Column:
    return sad(a, average(before, after))


def bidirectional_ssd(a: Column, before: Column, after: Column) -> Column:
    return ssd(a, average(before, after))


@bound
def subsample(plane: Column, w: int, h: int) -> Column:
    """Means of 2 x 2 blocks, rounded down."""
    half = w // 2

    def mean4(i):
        o = cdiv(i, half) * (2 * w) + (i % half) * 2
        return F.shiftright(at(plane, o) + at(plane, o + 1) + at(plane, o + w) + at(plane, o + w + 1), 2)

    return pixels(half * (h // 2), mean4)


@bound
def half_pel(plane: Column, w: int, h: int, dx: int, dy: int) -> Column:
    """The plane moved by half a value right and/or down: rounded means of 2 or 4 neighbours inside it."""
    near = lambda i, x, y: at(plane, F.least(cdiv(i, w) + y, F.lit(h - 1)) * w + F.least(i % w + x, F.lit(w - 1)))
    if dx and dy:
        return pixels(w * h, lambda i: F.shiftright(near(i, 0, 0) + near(i, 1, 0) + near(i, 0, 1) + near(i, 1, 1) + 2, 2))
    return pixels(w * h, lambda i: F.shiftright(near(i, 0, 0) + near(i, dx, dy) + 1, 1)) if dx or dy else plane


def snr(a: Column, b: Column) -> Column:
    """STRUCT<variance, mse, db>: decibels of a's variance over the mean squared error, the error held at 1e-5 at least."""
    n = F.size(a).cast("double")
    m = total(a) / n
    var = total(F.transform(a, lambda v: v * v)) / n - m * m
    mse = F.greatest(ssd(a, b) / n, F.lit(1e-5))
    return F.struct(var.alias("variance"), mse.alias("mse"), F.when(var > 0, 10 * F.log10(var / mse)).alias("db"))


def activity(coefficients: Column, weights: list[int], floor: float = 12.0) -> Column:
    """Weighted sum of absolute coefficients, at least floor."""
    w = F.array(*[F.lit(v).cast("long") for v in weights])
    return F.greatest(total(zipped(coefficients, w, lambda c, k: F.abs(c) * k)).cast("double"), F.lit(floor))


@bound
def field_difference(a: Column, b: Column, w: int, noise: int) -> Column:
    """STRUCT<even, odd, cross>: squared differences beyond a noise gate, >> 4, by field, and of b's even rows against
    a's odd ones."""

    def summed(rows, shift):
        d = lambda x, y: F.greatest(F.abs(x - y) - noise, F.lit(0))
        i = F.sequence(F.lit(0).cast("long"), F.size(a).cast("long") - 1)
        mine = F.filter(i, lambda k: cdiv(k, w) % 2 == rows)
        return total(F.transform(mine, lambda k: F.shiftright(d(at(a, k), at(b, k + shift)) * d(at(a, k), at(b, k + shift)), 4)))

    return F.struct(summed(0, 0).alias("even"), summed(1, 0).alias("odd"), summed(1, -w).alias("cross"))


def packet_summary(df: DataFrame, ids: list[str], size: str) -> DataFrame:
    """Packets and bytes of each stream and sub-stream."""
    return df.groupBy(*ids).agg(F.count("*").alias("packets"), F.sum(size).cast("long").alias("bytes"))


def error_summary(df: DataFrame, a: str, b: str) -> DataFrame:
    """Largest and mean absolute error, and mean square error, between two planes over all rows."""
    e = F.explode(zipped(F.col(a), F.col(b), lambda x, y: x - y))
    return df.select(e.alias("e")).agg(F.max(F.abs("e")).alias("worst"), F.avg(F.abs("e")).alias("mean_error"), F.avg(F.col("e") * F.col("e")).alias("mean_square"))
