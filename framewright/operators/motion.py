"""Block matching: candidate tables, thinning, argmin. Candidates are bounded by the search window, never by the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.planes import at, bound, cdiv, let, total
from .stats import bidirectional_ssd, half_pel, sad, ssd, variance

WEIGHT_CAP = 65025


def candidates(block: Column, bw: int, bh: int, ref: Column, w: int, h: int, x: int, y: int, radius: int, step: int = 1) -> Column:
    """ARRAY<STRUCT<weight, dx, dy>>: sums of absolute differences of a block against places of a reference that lie
    inside it, each capped at 255 x 255."""
    return _candidates(block, ref, bw, bh, w, h, x, y, radius, step)


@bound
def _candidates(block: Column, ref: Column, bw: int, bh: int, w: int, h: int, x: int, y: int, radius: int, step: int) -> Column:
    away = lambda base: lambda v, i: F.abs(v - at(ref, base + cdiv(i, bw) * w + i % bw))
    out = []
    for dy in range(-radius, radius + 1, step):
        for dx in range(-radius, radius + 1, step):
            if 0 <= x + dx and x + dx + bw <= w and 0 <= y + dy and y + dy + bh <= h:
                base = (y + dy) * w + x + dx
                diff = F.transform(block, away(base))
                out.append(F.struct(F.least(total(diff), F.lit(WEIGHT_CAP).cast("long")).alias("weight"), F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy")))
    return F.array(*out)


def thinned(found: Column, times: int) -> tuple[Column, Column]:
    """Keeps, `times` times over, the candidates that weigh no more than the whole mean; also the last mean. One
    candidate or none is left alone."""
    mean = lambda c: cdiv(total(F.transform(c, lambda e: e.weight)), F.size(c))
    kept = lambda c: F.when(F.size(c) <= 1, c).otherwise(let(mean(c), lambda m: F.filter(c, lambda e: e.weight <= m)))
    for _ in range(times):
        found = let(found, kept)
    return found, F.coalesce(mean(found), F.lit(100000).cast("long"))


def best(found: Column) -> Column:
    """The lightest candidate; ties go to the least dx, then dy."""
    return F.array_min(found)


def block_of(plane: Column, w: int, x: int, y: int, bw: int, bh: int) -> Column:
    return F.flatten(F.array(*[F.slice(plane, (y + r) * w + x + 1, bw) for r in range(bh)]))


def median_motion(df: DataFrame, key: list[str], motion: str, values: range) -> DataFrame:
    """The least motion at which the running histogram passes half of all points: key, median. Sums of a bounded
    histogram, so one hot key is a partial sum in every task."""
    counts = df.groupBy(*key, motion).agg(F.count("*").alias("n"))
    hist = counts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(motion).alias("m"), "n"))).alias("h"), F.sum("n").alias("t"))
    walk = F.aggregate("h", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("long").alias("m")), lambda s, e: F.struct((s.sum + e.n).alias("sum"), F.when(s.m.isNull() & (2 * (s.sum + e.n) >= F.col("t")), e.m.cast("long")).otherwise(s.m).alias("m")), lambda s: s.m)
    return hist.select(*key, walk.alias("median"))


@bound
def half_candidates(block: Column, ref: Column, bw: int, bh: int, w: int, h: int, x: int, y: int) -> Column:
    """ARRAY<STRUCT<weight, dx, dy>> of the nine places within half a value of (x, y), dx and dy in halves."""

    def weighed(planes):
        out = []
        for plane, right, down in ((p, i % 2, i // 2) for i, p in enumerate(planes)):
            for dy in (-1, 1) if down else (0,):
                for dx in (-1, 1) if right else (0,):
                    px, py = x + dx // 2, y + dy // 2
                    if px >= 0 and py >= 0 and px + bw + right <= w and py + bh + down <= h:
                        out.append(F.struct(sad(block, block_of(plane, w, px, py, bw, bh)).alias("weight"), F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy")))
        return F.array(*out)

    moved = F.array(*[half_pel(ref, w, h, i % 2, i // 2) for i in range(4)])
    return let(moved, lambda m: weighed([F.get(m, i) for i in range(4)]))


# Fixed value: what intra coding weighs beyond its variance, since it can't be left out.
INTRA_PENALTY = 3 * 3 * 256


def coding_mode(x: Column, before: Column, after: Column) -> Column:
    """STRUCT<score, place, mode>: how a block is coded best, by the squares that are left; ties in this order."""
    scores = {"intra": variance(x) + INTRA_PENALTY, "forward": ssd(x, before), "backward": ssd(x, after), "both": bidirectional_ssd(x, before, after)}
    return F.array_min(F.array(*[F.struct(s.cast("long").alias("score"), F.lit(i).alias("place"), F.lit(m).alias("mode")) for i, (m, s) in enumerate(scores.items())]))
