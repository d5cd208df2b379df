"""Multiplexing: deadline order, decoder buffers, late units, segments, padding; the exact loop as grouped Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.planes import cdiv


def deadline_order(df: DataFrame, group: list[str], deadline: str, ties: list[str], size: str) -> DataFrame:
    """Adds seq and pos (bytes before it): units of a multiplex by deadline, ties by the given order, then the larger first,
    so that no position rests on the order in which rows arrive."""
    w = Window.partitionBy(*group).orderBy(deadline, *ties, F.desc(size))
    return df.withColumn("seq", F.row_number().over(w).cast("long") - 1).withColumn("pos", (F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)).cast("long"))


def occupancy(df: DataFrame, stream: str, arrives: Column, leaves: Column, size: Column) -> DataFrame:
    """Bytes held after each moment at which any arrive or leave: stream, at, used. Sums of each moment come before the
    window, so what the window sorts is moments, not units."""
    e = F.explode(F.array(F.struct(arrives.alias("at"), size.alias("d")), F.struct(leaves.alias("at"), (-size).alias("d")))).alias("e")
    moments = df.select(stream, e).groupBy(stream, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(stream).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return moments.select(stream, "at", F.sum("d").over(w).cast("long").alias("used"))


def late_units(df: DataFrame, sent: Column, deadline: Column) -> DataFrame:
    """Adds late: units that are sent no earlier than their deadline."""
    return df.withColumn("late", sent >= deadline)


def underruns(df: DataFrame, stream: str, turn: str, late: Column, grace: int = 300, most: int = 10) -> DataFrame:
    """Late turns that count: after one, those within `grace` turns do not. Columns: stream, underruns, stopped_at (the
    turn whose count exceeds `most`, else null; nothing is counted after it). Each count rests on the one before, so a
    stream's late turns fold in order; the fold keeps three numbers."""
    turns = df.filter(late).groupBy(stream).agg(F.array_sort(F.collect_list(F.col(turn).cast("long"))).alias("__t"))
    whole = F.lit(None).cast("long")
    start = F.struct(whole.alias("last"), F.lit(0).cast("long").alias("n"), whole.alias("stop"))

    def step(s, t):
        counts = s.stop.isNull() & (s["last"].isNull() | (t >= s["last"] + grace))
        n = s.n + counts.cast("long")
        return F.struct(F.when(counts, t).otherwise(s["last"]).alias("last"), n.alias("n"), F.when(counts & (n > most), t).otherwise(s.stop).alias("stop"))

    return turns.select(stream, F.aggregate("__t", start, step).alias("__s")).select(stream, F.col("__s.n").alias("underruns"), F.col("__s.stop").alias("stopped_at"))


def segments(df: DataFrame, stream: str, order: list[str], size: str, limit: int) -> DataFrame:
    """Adds segment: the number of whole limits in the bytes before a unit."""
    w = Window.partitionBy(stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("segment", cdiv((F.sum(size).over(w) - F.col(size)).cast("long"), limit))


def padding(df: DataFrame, stream: str, start: str, stop: str) -> DataFrame:
    """Gaps in which a stream sends nothing: stream, start, stop."""
    w = Window.partitionBy(stream).orderBy(start, stop)
    d = df.withColumn("__end", F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__next", F.lead(start).over(w))
    return d.filter("__next > __end").select(stream, F.col("__end").alias(start), F.col("__next").alias(stop))


def packets(df: DataFrame, stream: str, order: list[str], size: str, packet: int) -> DataFrame:
    """Which packets of fixed size a unit's bytes fall in: adds first_packet, last_packet, packet_offset."""
    w = Window.partitionBy(stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("__end", F.sum(size).over(w).cast("long")).withColumn("__start", F.col("__end") - F.col(size).cast("long"))
    return d.withColumn("first_packet", cdiv(F.col("__start"), packet)).withColumn("last_packet", cdiv(F.greatest(F.col("__end") - 1, F.col("__start")), packet)).withColumn("packet_offset", F.col("__start") % packet).drop("__start", "__end")


def align(df: DataFrame, stream: str, stamp: str) -> DataFrame:
    """Adds aligned: a stream's stamps moved so that each stream begins at 0."""
    first = F.min(stamp).over(Window.partitionBy(stream))
    return df.withColumn("aligned", F.col(stamp) - first)


def align_to_base(df: DataFrame, stamp: str) -> DataFrame:
    """Adds aligned: time since the first stamp of all streams, so that streams keep their distances."""
    return df.withColumn("aligned", F.col(stamp) - F.lit(df.agg(F.min(stamp)).first()[0]))


def still_times(df: DataFrame, key: str, order: str, frames: Column, transfer: int, rate_n: int, rate_d: int, clock: int = 27_000_000) -> DataFrame:
    """Adds dts and pts of stills: each is loaded for `transfer` ticks once the one before is shown, and is shown when its
    own interval of frames is over."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    interval = cdiv(frames * clock * rate_d, rate_n)
    return df.withColumn("pts", F.sum(interval + transfer).over(w)).withColumn("dts", F.col("pts") - interval)


def access_units(df: DataFrame, key: str, text: str, token: str) -> DataFrame:
    """Cuts each payload where a start token stands: key, unit, start (characters from 0), length. What stands before
    the first token is unit 0 if there is any; null holds no unit. One pass over each text, no shuffle."""
    import pyarrow as pa

    kind = dict(df.dtypes)[key]

    def run(batches):
        for b in batches:
            for k, t in zip(b.column(0), b.column(1).to_pylist()):
                first, *rest = (t or "").split(token)
                sizes = ([len(first)] if first else []) + [len(p) + len(token) for p in rest]
                if not sizes:
                    continue
                starts = [0]
                for n in sizes[:-1]:
                    starts.append(starts[-1] + n)
                keys = pa.array([k.as_py()] * len(sizes), b.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([keys, pa.array(range(len(sizes)), pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], names=[key, "unit", "start", "length"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, unit long, start long, length long")


def schedule(df: DataFrame, group: str, stream: str, dts: str, size: str, rate: float, buffer: int, order: str) -> DataFrame:
    """The exact loop for multiplexes that fit a task: at each turn buffers drain what is due before the clock, and of the
    ready streams (room for the unit) the one whose next unit is due first sends it; if none is ready the clock moves to
    the next drain. Units of a stream go by dts, then order, then size. Rows: group, stream, order, sent, late. Grouped
    Python over Arrow columns; a group is one multiplex."""
    kinds = dict(df.dtypes)
    schema = f"{group} {kinds[group]}, {stream} {kinds[stream]}, {order} {kinds[order]}, sent double, late boolean"

    def run(t):
        import pyarrow as pa

        t = t.sort_by([(c, "ascending") for c in (stream, dts, order, size)])
        names, due, sizes = (t[c].to_pylist() for c in (stream, dts, size))
        # Each stream is a stretch of these lists; of it, what lies before held is drained, and before todo is sent.
        starts = [k for k in range(len(names)) if k == 0 or names[k] != names[k - 1]]
        ends = [*starts[1:], len(names)]
        held, todo, used = list(starts), list(starts), [0] * len(starts)
        clock = min(due[k] for k in starts) - buffer / rate
        rows, sent, late = [], [], []
        while len(rows) < len(names):
            turn = first = drain = None
            for s, end in enumerate(ends):
                h, k = held[s], todo[s]
                while h < k and due[h] < clock:
                    used[s] -= sizes[h]
                    h += 1
                held[s] = h
                if k < end and (h == k or used[s] + sizes[k] <= buffer) and (turn is None or due[k] < first):
                    turn, first = s, due[k]
                if h < k and (drain is None or due[h] < drain):
                    drain = due[h]
            if turn is None:
                clock = drain + 1e-9
                continue
            k = todo[turn]
            rows.append(k)
            sent.append(clock)
            late.append(clock >= first)
            todo[turn] = k + 1
            used[turn] += sizes[k]
            clock += sizes[k] / rate
        out = t.select([group, stream, order]).take(pa.array(rows, pa.int64()))
        return out.append_column("sent", pa.array(sent, pa.float64())).append_column("late", pa.array(late, pa.bool_()))

    return df.select(group, stream, order, dts, size).groupBy(group).applyInArrow(run, schema)
