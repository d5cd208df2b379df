"""Text formats: edit lists, pipe lists and clip lists, read and written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import timeline

# The first lines of the two formats.
EDIT_LIST, PIPE_LIST = "LAV Edit List", "LAV Pipe List"


def parse_edit_list(text: str) -> tuple[str, list[str], list[tuple[int, int, int]]]:
    """(norm, file names, (file, first, last) entries). Lines that begin with ':' are passed over; broken lists raise
    ValueError."""
    lines = text.splitlines()
    if len(lines) < 3 or lines[0] != EDIT_LIST:
        raise ValueError("no edit list")
    if lines[1][:1].lower() not in ("n", "p") or not lines[1]:
        raise ValueError("the norm is neither NTSC nor PAL")
    n = int(lines[2])
    names, entries = lines[3 : 3 + n], []
    if len(names) < n:
        raise ValueError("file names are missing")
    for line in lines[3 + n :]:
        if line and not line.startswith(":"):
            f, a, z = map(int, line.split()[:3])
            if not 0 <= f < n:
                raise ValueError("wrong file number")
            entries.append((f, a, z))
    return lines[1][0].lower(), names, entries


def read_edit_list(spark: SparkSession, path: str, lengths: dict[str, int] | None = None, compat: bool = False) -> DataFrame:
    """list_id, pos, file, frame_no of every edit list under a path. A list is a small text, read whole in one task."""
    schema = "array<struct<file:string,first:long,last:long,length:long>>"
    known = dict(lengths or {})

    @F.udf(schema)
    def entries(text):
        _, names, found = parse_edit_list(text)
        return [(names[f], a, z, known.get(names[f])) for f, a, z in found]

    lists = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("list_id"), F.posexplode(entries("value")).alias("seg_no", "e")).select("list_id", "seg_no", "e.*")
    end = F.coalesce(F.col("length"), F.col("last") + 1)
    rows = timeline.expand(lists, "first", "last", length=end, compat=compat)
    w = Window.partitionBy("list_id").orderBy("seg_no", "frame_no")
    return rows.select("list_id", (F.row_number().over(w) - 1).cast("long").alias("pos"), "file", "frame_no")


def edit_list_text(df: DataFrame, key: str, pos: str, file: str, frame: str, norm: str = "PAL") -> DataFrame:
    """Timelines -> key, text: run-length entries, with only the files in use, numbered in name order."""
    runs = timeline.compress(df, key, pos, file, frame)
    runs = runs.withColumn("__no", F.dense_rank().over(Window.partitionBy(key).orderBy(file)) - 1)
    line = F.concat_ws(" ", "__no", "first_frame", "last_frame")
    made = runs.groupBy(key).agg(F.array_sort(F.collect_set(file)).alias("__names"), F.array_sort(F.collect_list(F.struct("run", line.alias("line")))).alias("__lines"))
    text = F.concat_ws("\n", F.lit(EDIT_LIST), F.lit(norm), F.size("__names").cast("string"), F.concat_ws("\n", "__names"), F.concat_ws("\n", F.transform("__lines", lambda e: e.line)))
    return made.select(key, F.concat(text, F.lit("\n")).alias("text"))


def parse_pipe_list(text: str):
    """(norm, commands, segments (frame_count, [(src, off)], output))."""
    lines = [x for x in text.splitlines()]
    if not lines or lines[0] != PIPE_LIST:
        raise ValueError("no pipe list")
    n = int(lines[2])
    commands, at, segments = lines[3 : 3 + n], 3 + n, []
    while at < len(lines) and lines[at].strip():
        count, inputs = int(lines[at]), int(lines[at + 1])
        if count < 1:
            raise ValueError("a segment has no frame")
        pairs = [tuple(map(int, x.split()[:2])) for x in lines[at + 2 : at + 2 + inputs]]
        if any(not 0 <= s < n for s, _ in pairs):
            raise ValueError("wrong source number")
        segments.append((count, pairs, lines[at + 2 + inputs]))
        at += 3 + inputs
    return lines[1][:1].lower(), commands, segments


def pipe_plan(spark: SparkSession, text: str) -> DataFrame:
    """The segments of a pipe list as a plan table for timeline.pipe_frames()."""
    rows = [(i, c, [tuple(p) for p in pairs], out) for i, (c, pairs, out) in enumerate(parse_pipe_list(text)[2])]
    return spark.createDataFrame(rows, "seg_no int, frame_count long, inputs array<struct<src:int,off:long>>, output string")


def pipe_list_text(norm: str, commands: list[str], segments) -> str:
    out = [PIPE_LIST, norm, str(len(commands)), *commands]
    for count, pairs, output in segments:
        out += [str(count), str(len(pairs)), *[f"{s} {o}" for s, o in pairs], output]
    return "\n".join(out) + "\n"


def parse_clips(text: str) -> list[tuple[str, int, int]]:
    """Clip definitions 'file offset length'; '#' begins a comment, '$' a directive."""
    rows = (x.split("#")[0].strip() for x in text.splitlines())
    return [(f, int(a), int(n)) for f, a, n in (x.split() for x in rows if x and not x.startswith("$"))]
