"""Operators over neighbouring frames of a stream: one window, keyed by stream and ordered by frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.planes import cdiv


def ordered(key: str, order: str):
    return Window.partitionBy(key).orderBy(order)


def scene_cuts(df: DataFrame, key: str, order: str, mean: Column, file: str | None, threshold: int = 4) -> DataFrame:
    """Adds scene: a new one where the mean leaves the one before by more than the threshold, the file changes, or a
    frame is not the one before plus 1."""
    w = ordered(key, order)
    d = df.withColumn("__m", mean)
    cut = (F.abs(F.col("__m") - F.lag("__m").over(w)) > threshold) | (F.col(order) != F.lag(order).over(w) + 1)
    if file:
        cut |= F.col(file) != F.lag(file).over(w)
    d = d.withColumn("__cut", F.coalesce(cut, F.lit(True)).cast("long"))
    return d.withColumn("scene", F.sum("__cut").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("__m", "__cut")


def scene_list(df: DataFrame, key: str, order: str, mean: Column, file: str, threshold: int = 4) -> DataFrame:
    """Scenes with first_frame, last_frame and joined: whether one only begins since the file or the frame number jumps,
    while the picture stays (the first of a stream is not)."""
    w = ordered(key, order)
    d = df.withColumn("__m", mean)
    same = F.coalesce(F.abs(F.col("__m") - F.lag("__m").over(w)) <= threshold, F.lit(False))
    d = scene_cuts(d.withColumn("__same", same), key, order, F.col("__m"), file, threshold)
    return d.groupBy(key, "scene").agg(F.min(order).alias("first_frame"), F.max(order).alias("last_frame"), F.min_by("__same", order).alias("joined"))


def scenes(df: DataFrame, key: str, order: str, mean: Column, file: str | None = None, threshold: int = 4) -> DataFrame:
    cut = scene_cuts(df, key, order, mean, file, threshold)
    return cut.groupBy(key, "scene").agg(F.min(order).alias("first_frame"), F.max(order).alias("last_frame"))


def conceal(df: DataFrame, key: str, order: str, payload: str, corrupt: Column) -> DataFrame:
    """A corrupt frame repeats the last good one (null before the first)."""
    w = ordered(key, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(payload, F.last(F.when(~corrupt, F.col(payload)), ignorenulls=True).over(w))


def denoise7(df: DataFrame, key: str, order: str, value: str, t: int) -> DataFrame:
    """Mean over frames n-3..n+3 weighted by max(0, t - |difference|), the centre by t + 1, rounded to nearest; frames
    beyond the ends have no weight."""
    w = ordered(key, order)
    r = F.col(value)
    top, bottom = r * (t + 1), F.lit(t + 1).cast("long")
    for k in range(1, 4):
        for f in (F.lag(value, k).over(w), F.lead(value, k).over(w)):
            weight = F.coalesce(F.greatest(F.lit(t) - F.abs(r - f), F.lit(0)), F.lit(0))
            top, bottom = top + weight * F.coalesce(f, F.lit(0)), bottom + weight
    d = df.withColumn("__top", top).withColumn("__bottom", bottom)
    return d.withColumn(value, cdiv(cdiv(F.col("__top") * 2, F.col("__bottom")) + 1, 2)).drop("__top", "__bottom")


def stabilise(df: DataFrame, key: str, order: str, motion: str, alpha: float = 0.95) -> DataFrame:
    """Decayed sum of motions, gs = alpha * gs + motion / 2, and the whole shift that undoes it: key, order, gs, shift.

    A recurrence in doubles, so it folds over each stream in order; a stream is one row of (order, motion) pairs."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("n"), F.col(motion).alias("v"))))
    start = F.array().cast("array<struct<n:bigint,gs:double>>")
    last = lambda s: F.coalesce(F.get(s, F.size(s) - 1)["gs"], F.lit(0.0))
    step = lambda s, x: F.array_append(s, F.struct(x.n.cast("long").alias("n"), (last(s) * alpha + x.v / 2).alias("gs")))
    folded = df.groupBy(key).agg(rows.alias("rows")).select(key, F.explode(F.aggregate("rows", start, step)).alias("r"))
    return folded.select(key, F.col("r.n").alias(order), F.col("r.gs").alias("gs"), (-F.round("r.gs")).cast("long").alias("shift"))


def stabilise_arrow(df: DataFrame, key: str, order: str, motion: str, alpha: float = 0.95) -> DataFrame:
    """The same for long streams: linear in their length."""
    schema = f"{key} {dict(df.dtypes)[key]}, {order} long, gs double, shift long"

    def run(p):
        p = p.sort_values(order)
        gs, out = 0.0, []
        for v in p[motion]:
            gs = gs * alpha + v / 2
            out.append(gs)
        p = p[[key, order]].assign(gs=out)
        # half away from zero, as F.round does
        p["shift"] = [-int(abs(g) + 0.5) if g >= 0 else int(abs(g) + 0.5) for g in out]
        return p

    return df.select(key, order, motion).groupBy(key).applyInPandas(run, schema)


def telecine_inverse(df: DataFrame, key: str, frame: str, value: str, top_first: bool = False) -> DataFrame:
    """Five frames of fields become four: the first two, one of the fields of the third and fourth, and the fifth.
    Incomplete groups go. Columns: key, out_frame, top, bottom; `value` stands for the fields of a frame. No window:
    groups of five are keys, and each has at most five rows."""
    k, g = F.col(frame) % 5, cdiv(F.col(frame), 5)
    pick = lambda i: F.max(F.when(k == i, F.col(value)))
    five = df.groupBy(key, g.alias("__g")).agg(F.count("*").alias("__n"), *[pick(i).alias(f"f{i}") for i in range(5)]).filter("__n = 5")
    mixed = ("f3", "f2") if top_first else ("f2", "f3")
    pairs = [("f0", "f0"), ("f1", "f1"), mixed, ("f4", "f4")]
    fields = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.col(a).alias("top"), F.col(b).alias("bottom")) for i, (a, b) in enumerate(pairs)])
    return five.select(key, "__g", F.explode(fields).alias("o")).select(key, (F.col("__g") * 4 + F.col("o.i")).alias("out_frame"), F.col("o.top").alias("top"), F.col("o.bottom").alias("bottom"))


def interlace(df: DataFrame, key: str, frame: str, value: str, top_first: bool = True) -> DataFrame:
    """Two progressive frames become the fields of one; an odd last frame goes."""
    k, g = F.col(frame) % 2, cdiv(F.col(frame), 2)
    a, b = (F.max(F.when(k == i, F.col(value))) for i in ((0, 1) if top_first else (1, 0)))
    return df.groupBy(key, g.alias("out_frame")).agg(F.count("*").alias("__n"), a.alias("top"), b.alias("bottom")).filter("__n = 2").drop("__n")


def cadence(df: DataFrame, key: str, frame: str, difference: Column, period: int = 5) -> DataFrame:
    """Which frame of each `period` differs least from the one before (the repeat that a pulldown adds): key, group,
    drop_frame. The first frame of a stream has no difference; ties go to the earlier frame."""
    w = ordered(key, frame)
    d = df.select(key, frame, difference.alias("__v")).withColumn("__d", F.abs(F.col("__v") - F.lag("__v").over(w)))
    return d.filter("__d IS NOT NULL").groupBy(key, cdiv(F.col(frame), period).alias("group")).agg(F.min_by(frame, F.struct("__d", frame)).alias("drop_frame"))


def lost_frames(df: DataFrame, key: str, order: str, seq: str) -> DataFrame:
    """Adds lost: how many sequence numbers are missing just before each frame (0 for the first)."""
    return df.withColumn("lost", F.coalesce(F.col(seq) - F.lag(seq).over(ordered(key, order)) - 1, F.lit(0)).cast("long"))


def pulldown_fields(df: DataFrame, key: str, order: str, repeat: Column) -> DataFrame:
    """Adds first_field and fields: a frame with the repeat flag shows three fields, others two."""
    w = ordered(key, order)
    d = df.withColumn("fields", F.when(repeat, 3).otherwise(2).cast("long"))
    return d.withColumn("first_field", (F.sum("fields").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("fields")).cast("long"))


def time_stamps(df: DataFrame, key: str, decode: str, shown: Column, rate_n: int, rate_d: int, clock: int = 27_000_000, skew: int = 2) -> DataFrame:
    """Adds dts and pts in ticks: a frame takes two fields; presentation runs `skew` fields late."""
    fields = lambda f: cdiv(f * (clock // 2) * rate_d, rate_n)
    return df.withColumn("dts", fields(F.col(decode) * 2)).withColumn("pts", fields(shown * 2 + skew))


def group_structure(df: DataFrame, frame: str, n: int, m: int) -> DataFrame:
    """Adds group, kind (I, P, B) and temporal_reference of display-order frames: groups of n, references every m."""
    k = F.col(frame) % n
    kind = F.when(k == 0, "I").when((k % m == 0) | (k == n - 1), "P").otherwise("B")
    return df.withColumn("group", cdiv(F.col(frame), n)).withColumn("kind", kind).withColumn("temporal_reference", k)


def split_groups(df: DataFrame, key: str, order: str, kind: str, intra_share: Column, limit: float = 0.6) -> DataFrame:
    """A P frame with more than `limit` of its blocks intra starts a group of its own: kind and group follow."""
    w = ordered(key, order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn(kind, F.when((F.col(kind) == "P") & (intra_share > limit), "I").otherwise(F.col(kind)))
    return d.withColumn("group", F.sum(F.when(F.col(kind) == "I", 1).otherwise(0)).over(w))


def released(df: DataFrame, key: str, order: str, reference: Column) -> DataFrame:
    """Adds released: the frame whose coding lets a frame leave the first pass's queue. A frame goes when nothing can refer
    to it any more, at the second reference after it; what is left goes with the last frame."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    later = w.rowsBetween(Window.unboundedPreceding, -1)
    near = lambda v: F.last(F.when(reference, v), ignorenulls=True).over(later)
    d = df.withColumn("__next", near(F.col(order)))
    d = d.withColumn("__second", near(F.col("__next"))).withColumn("__last", F.first(order).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn("released", F.coalesce("__second", "__last")).drop("__next", "__second", "__last")


def audio_range(frame: Column, rate: int, fps_n: int, fps_d: int) -> tuple[Column, Column]:
    """First and last + 1 sample of a video frame."""
    first = lambda n: cdiv(n * rate * fps_d, fps_n)
    return first(frame), first(frame + 1)


def crosstalk(df: DataFrame, key: str, order: str, value: str, threshold: int) -> DataFrame:
    """A rule of our own against noise that alternates: where a frame and the one before differ by less than the threshold and the one
    two before agrees with it better, it takes their mean."""
    w = ordered(key, order)
    a, b, r = F.lag(value, 1).over(w), F.lag(value, 2).over(w), F.col(value)
    noisy = (F.abs(r - a) < threshold) & (F.abs(r - b) <= F.abs(r - a))
    return df.withColumn(value, F.when(F.coalesce(noisy, F.lit(False)), F.shiftright(r + a + 1, 1)).otherwise(r))


def interpolated(from_: Column, to: Column, step: Column, steps: int) -> Column:
    """A parameter on its way over a range of frames."""
    return from_ + (to - from_) * step / max(steps - 1, 1)


def clip_samples(runs: DataFrame, key: str, order: str, frames: str, rate: int, fps_n: int, fps_d: int) -> DataFrame:
    """Clips one behind the other: the first and last + 1 sample of each, so that sound follows the frames before it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(frames).over(w)
    sample = lambda n: cdiv(n * rate * fps_d, fps_n)
    return runs.withColumn("first_sample", sample(end - F.col(frames))).withColumn("last_sample", sample(end))


def framed_samples(samples: DataFrame, key: str, at: str, value: str, rate: int, fps_n: int, fps_d: int) -> DataFrame:
    """The samples of each video frame, as far as a stream has any: key, frame, n, total; a frame without is silence."""
    top = samples.groupBy(key).agg(F.max(at).alias("__top"))
    frame = lambda s: cdiv((s + 1) * fps_n - 1, rate * fps_d)  # noqa: E731  the frame whose range holds sample s
    grid = top.select(key, F.explode(F.sequence(F.lit(0).cast("long"), frame(F.col("__top")))).alias("frame"))
    got = samples.groupBy(key, frame(F.col(at)).alias("frame")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return grid.join(got, [key, "frame"], "left").fillna(0, ["n", "total"])
