"""Timeline algebra: edit lists as tables, with all edits closed-form on positions.

A timeline is (list key, pos, file, frame), pos dense from 0 in each list. Every operator is one window or one join
keyed by the list, so lists spread over the cluster and no edit reads another list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compress(df: DataFrame, key: str, pos: str, file: str, frame: str) -> DataFrame:
    """Runs in which the file stays and the frame goes up by one: key, run, file, first, last, n."""
    w = Window.partitionBy(key).orderBy(pos)
    fresh = F.coalesce((F.col(file) != F.lag(file).over(w)) | (F.col(frame) != F.lag(frame).over(w) + 1), F.lit(True))
    marked = df.select(key, pos, file, frame, fresh.cast("long").alias("__new"))
    runs = marked.withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return runs.groupBy(key, "run").agg(F.first(file).alias(file), F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"), F.count("*").alias("n"))


def expand(df: DataFrame, first: str, last: str, out: str = "frame_no", length: Column | None = None, compat: bool = False) -> DataFrame:
    """One row per frame of inclusive ranges. Starts below 0 become 0; with a length, ends are cut to length - 1
    (compat: to length, one phantom frame); ranges that end before they start vanish."""
    lo, hi = F.greatest(F.col(first), F.lit(0)), F.col(last)
    if length is not None:
        hi = F.least(hi, length if compat else length - 1)
    return df.withColumn("__lo", lo).withColumn("__hi", hi).filter("__hi >= __lo").withColumn(out, F.explode(F.sequence("__lo", "__hi"))).drop("__lo", "__hi")


def renumber(df: DataFrame, file: str, out: str = "file_no") -> DataFrame:
    """The files in use, with dense numbers in name order. The list is a dimension: one row per file."""
    return df.select(file).distinct().withColumn(out, F.dense_rank().over(Window.orderBy(file)).cast("long") - 1)


def copy(df: DataFrame, pos: str, start: int, end: int) -> DataFrame:
    return df.filter(F.col(pos).between(start, end)).withColumn(pos, F.col(pos) - start)


def delete(df: DataFrame, pos: str, start: int, end: int) -> DataFrame:
    """Positions behind the range close up; no window is needed, since positions are dense."""
    return df.filter(~F.col(pos).between(start, end)).withColumn(pos, F.when(F.col(pos) > end, F.col(pos) - (end - start + 1)).otherwise(F.col(pos)))


def cut(df: DataFrame, pos: str, start: int, end: int) -> tuple[DataFrame, DataFrame]:
    return copy(df, pos, start, end), delete(df, pos, start, end)


def paste(df: DataFrame, clip: DataFrame, key: str, pos: str, dest: int, append: bool = True) -> DataFrame:
    """Inserts each list's clip before position dest; what stood there moves on. dest beyond a list's end appends
    (append=False: such lists stay as they are)."""
    sizes = df.groupBy(key).agg(F.count("*").alias("__size"))
    clips = clip.groupBy(key).agg(F.count("*").alias("__n"))
    meta = sizes.join(clips, key, "left").withColumn("__n", F.coalesce("__n", F.lit(0))).withColumn("__at", F.least(F.lit(dest), F.col("__size")))
    if not append:
        meta = meta.withColumn("__n", F.when(F.lit(dest) < F.col("__size"), F.col("__n")).otherwise(0))
    old = df.join(meta, key).withColumn(pos, F.when(F.col(pos) >= F.col("__at"), F.col(pos) + F.col("__n")).otherwise(F.col(pos)))
    new = clip.join(meta.filter("__n > 0"), key).withColumn(pos, F.col(pos) + F.col("__at"))
    return old.unionByName(new).drop("__size", "__n", "__at")


def move(df: DataFrame, pos: str, start: int, end: int, dest: int) -> DataFrame:
    """Moves a range before dest: dest is a position of the old list; one inside the range leaves it where it is."""
    n = end - start + 1
    to = dest - n if dest > end else start if dest >= start else dest
    p = F.col(pos)
    moved = p - start + to
    rest = p - F.when(p > end, n).otherwise(0)  # place among what stays
    return df.withColumn(pos, F.when(p.between(start, end), moved).otherwise(F.when(rest >= to, rest + n).otherwise(rest)).cast("long"))


def insert(df: DataFrame, movie: DataFrame, key: str, pos: str, dest: int, compat: bool = False) -> DataFrame:
    """Adds a movie at dest; frames from dest on move behind it (compat: to the end of the list, in place of a shift:
    as many frames as the movie has leave dest for the end)."""
    if not compat:
        return paste(df, movie, key, pos, dest)
    sizes = df.groupBy(key).agg(F.count("*").alias("__size"))
    n = movie.groupBy(key).agg(F.count("*").alias("__n"))
    meta = sizes.join(n, key)
    p = F.col(pos)
    old = df.join(meta, key).withColumn(pos, F.when((p >= dest) & (p < dest + F.col("__n")), p - dest + F.greatest(F.col("__size"), F.lit(dest) + F.col("__n"))).otherwise(p))
    new = movie.join(meta.drop("__n"), key).withColumn(pos, p + F.least(F.lit(dest), F.col("__size"))).drop("__size")
    return old.drop("__size", "__n").unionByName(new)


def frame_at(df: DataFrame, key: str, pos: str, n: int) -> DataFrame:
    """Each list's row at n, clamped to the list."""
    return df.filter(F.col(pos) <= n).groupBy(key).agg(F.max_by(F.struct(*df.columns), pos).alias("__r")).select("__r.*")


def offset_count(df: DataFrame, key: str, pos: str, offset: int = 0, count: int = 0) -> DataFrame:
    """A range of each list: a negative offset counts from the end, a count of 0 takes all that follows."""
    sized = df.withColumn("__size", F.count("*").over(Window.partitionBy(key)))
    lo = F.greatest(F.col("__size") + offset, F.lit(0)) if offset < 0 else F.lit(offset)
    keep = F.col(pos) >= lo
    if count:
        keep &= F.col(pos) < lo + count
    return sized.filter(keep).drop("__size")


def every_nth(df: DataFrame, pos: str, n: int) -> DataFrame:
    return df.filter(F.col(pos) % n == 0)


def step_through(sizes: DataFrame, size: str, start: int, speed: int, steps: int) -> DataFrame:
    """Playback positions after 0..steps steps at a speed, held inside each list: adds step, pos."""
    stepped = sizes.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps).cast("long"))))
    at = F.greatest(F.least(F.lit(start) + F.col("step") * speed, F.col(size) - 1), F.lit(0))
    return stepped.withColumn("pos", at.cast("long"))


def rotate(df: DataFrame, pos: str, start: int, end: int, by: int) -> DataFrame:
    """Rotates the positions of a range."""
    n, p = end - start + 1, F.col(pos)
    return df.withColumn(pos, F.when(p.between(start, end), F.pmod(p - start + by, F.lit(n)) + start).otherwise(p))


def exchange(df: DataFrame, pos: str, a: int, b: int) -> DataFrame:
    p = F.col(pos)
    return df.withColumn(pos, F.when(p == a, b).when(p == b, a).otherwise(p).cast("long"))


def duplicate(df: DataFrame, pos: str, start: int, end: int, times: int) -> DataFrame:
    """A range follows itself `times` more; the rest moves on."""
    n, p = end - start + 1, F.col(pos)
    copies = F.when(p.between(start, end), F.sequence(F.lit(0), F.lit(times))).otherwise(F.array(F.lit(0)))
    out = df.withColumn("__k", F.explode(copies))
    return out.withColumn(pos, p + F.when(p > end, n * times).otherwise(F.col("__k") * n)).drop("__k")


def locate(segments: DataFrame, key: str, order: str, count: str, offset: int) -> DataFrame:
    """Where a plan's offset falls: key, segment (row order), frame in segment. Lists that end before it have no row."""
    w = Window.partitionBy(key).orderBy(order)
    end = F.sum(count).over(w.rowsBetween(Window.unboundedPreceding, 0))
    placed = segments.select(key, (F.row_number().over(w) - 1).cast("long").alias("segment"), (end - F.col(count)).alias("__lo"), end.alias("__hi"))
    return placed.filter((F.col("__lo") <= offset) & (offset < F.col("__hi"))).select(key, "segment", (F.lit(offset) - F.col("__lo")).cast("long").alias("frame_in_segment"))


def pipe_frames(plan: DataFrame) -> DataFrame:
    """A composition plan (seg_no, frame_count, inputs array<struct<src,off>>, output) -> one row per output frame and
    input: out_pos, seg_no, slot, src, frame_no. Sources are then joined on (src, frame_no)."""
    w = Window.orderBy("seg_no").rowsBetween(Window.unboundedPreceding, -1)  # a plan is a small list
    placed = plan.withColumn("__base", F.coalesce(F.sum("frame_count").over(w), F.lit(0)))
    frames = placed.filter("frame_count > 0").withColumn("__f", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frame_count") - 1)))
    return frames.select((F.col("__base") + F.col("__f")).alias("out_pos"), "seg_no", "__f", F.posexplode("inputs").alias("slot", "input")).select("out_pos", "seg_no", "slot", F.col("input.src").alias("src"), (F.col("input.off") + F.col("__f")).alias("frame_no"))


def transitions(clips: DataFrame, length: int) -> DataFrame:
    """Clips (clip, src, first, count) in order -> plan segments: each clip alone, and `length` frames that overlap it
    with the next."""
    w = Window.orderBy("clip")
    n, nxt = F.col("count"), F.lead("src").over(w)
    head = F.when(F.lag("src").over(w).isNotNull(), length).otherwise(0)
    tail = F.when(nxt.isNotNull(), length).otherwise(0)
    own = F.struct((n - head - tail).alias("frame_count"), F.array(F.struct(F.col("src"), (F.col("first") + head).cast("long").alias("off"))).alias("inputs"), F.lit("-").alias("output"))
    mix = F.struct(F.lit(length).cast("long").alias("frame_count"), F.array(F.struct(F.col("src"), (F.col("first") + n - tail).cast("long").alias("off")), F.struct(nxt.alias("src"), F.lead("first").over(w).cast("long").alias("off"))).alias("inputs"), F.lit("blend").alias("output"))
    parts = clips.select("clip", own.alias("a"), F.when(nxt.isNotNull(), mix).alias("b"))
    rows = parts.select("clip", F.posexplode(F.array_compact(F.array("a", "b"))).alias("k", "s")).filter("s.frame_count > 0")
    return rows.select((F.row_number().over(Window.orderBy("clip", "k")) - 1).alias("seg_no"), "s.*")


def apply_edits(df: DataFrame, key: str, pos: str, commands: list[str]) -> DataFrame:
    """Edits as text, run in order on a clipboard: 'eo a b' copy, 'eu a b' cut, 'ep d' paste, 'em a b d' move,
    'ed a b' delete, 'es a b' keep only a..b. Anything else raises ValueError."""
    clip = df.limit(0)
    for c in commands:
        name, *args = c.split()
        v = list(map(int, args))
        if name == "eo":
            clip = copy(df, pos, *v)
        elif name == "eu":
            clip, df = cut(df, pos, *v)
        elif name == "ep":
            df = paste(df, clip, key, pos, *v)
        elif name == "em":
            df = move(df, pos, *v)
        elif name == "ed":
            df = delete(df, pos, *v)
        elif name == "es":
            df = copy(df, pos, *v)
        else:
            raise ValueError(f"no such edit: {c}")
    return df
