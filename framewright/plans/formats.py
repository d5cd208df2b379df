"""More named queries: audio frames, frame streams as bytes, geometry, edges, modes, stills, the first pass's queue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import filters, motion, mux, rate, stats, temporal
from ..sources import containers, frames as y4m
from .catalog import BLK, FR, PAIR, of_block, query, scene_sql, values
from .tables import blocks, frames, neighbours, table

UNITS = ["unit", "start", "length"]


def streams(d, head: str, length: str, times: str):
    """Each part's stream: `times` frames that begin with the hex of head and end in zeros, `length` bytes each."""
    return d.select("p_partkey", F.expr(f"unhex(repeat(rpad({head}, CAST(2 * ({length}) AS INT), '0'), CAST({times} AS INT)))").alias("payload"))


@query("ac3_units", f"""WITH t AS (SELECT p_partkey, p_partkey % 3 AS f, p_partkey % 38 AS c, p_size % 3 + 1 AS k, {containers.AC3_RATES}[CAST(p_partkey % 38 // 2 + 1 AS INTEGER)] AS r FROM part),
n AS (SELECT p_partkey, f, k, CAST(2 * CASE f WHEN 0 THEN r * 2 WHEN 1 THEN r * 320 // 147 + c % 2 ELSE r * 3 END AS BIGINT) AS n FROM t), u AS (SELECT *, unnest(range(0, k)) AS unit FROM n)
SELECT p_partkey, unit, unit * n AS start, n AS length, CAST(CASE f WHEN 0 THEN 48000 WHEN 1 THEN 44100 ELSE 32000 END AS BIGINT) AS rate FROM u""")
def ac3_units(spark, sf):
    d = table(spark, sf, "part").selectExpr("p_partkey", "p_size", "p_partkey % 3 AS f", "p_partkey % 38 AS c", f"array({', '.join(map(str, containers.AC3_RATES))})[CAST(p_partkey % 38 div 2 AS INT)] AS r")
    d = streams(d, "concat('0B770000', lpad(hex(f * 64 + c), 2, '0'))", "2 * CASE f WHEN 0 THEN r * 2 WHEN 1 THEN r * 320 div 147 + c % 2 ELSE r * 3 END", "p_size % 3 + 1")
    return containers.scan_payloads(d, "p_partkey", "payload", containers.ac3_units, [*UNITS, "rate"])


@query("dts_units", """WITH t AS (SELECT p_partkey, 96 + p_partkey % 1000 AS n, 32 * (p_size % 20 + 6) AS samples, unnest(range(0, p_size % 3 + 1)) AS unit FROM part)
SELECT p_partkey, unit, unit * n AS start, n AS length, CAST(samples AS BIGINT) AS samples FROM t""")
def dts_units(spark, sf):
    head = "concat('7FFE8001', lpad(hex((p_size % 20 + 5) * 16384 + 95 + p_partkey % 1000), 7, '0'), '0')"
    d = streams(table(spark, sf, "part"), head, "96 + p_partkey % 1000", "p_size % 3 + 1")
    return containers.scan_payloads(d, "p_partkey", "payload", containers.dts_units, [*UNITS, "samples"])


RATES = values((v, layer, i, r) for (v, layer), rates in containers.AUDIO_RATES.items() for i, r in enumerate(rates))


@query("mpeg_audio_units", f"""WITH a(v, layer, i, r) AS (VALUES {RATES}), t AS (SELECT p_partkey, p_size % 2 AS pad, p_partkey // 3 % 3 + 1 AS layer, p_partkey % 14 + 1 AS i, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END AS v, [44100, 48000, 32000][p_size % 3 + 1] // [1, 2, 4][CAST(p_partkey % 3 + 1 AS INTEGER)] AS rate FROM part),
n AS (SELECT p_partkey, CAST(rate AS BIGINT) AS rate, CAST(CASE WHEN layer = 1 THEN 4 * (r * 12000 // rate + pad) ELSE r * 144000 // rate + pad END AS BIGINT) AS n FROM t JOIN a USING (v, layer, i)), u AS (SELECT *, unnest(range(0, 3)) AS unit FROM n)
SELECT p_partkey, unit, unit * n AS start, n AS length, rate FROM u""")
def mpeg_audio_units(spark, sf):
    rates = f"map_from_entries(array({', '.join(f'struct({v * 10 + layer}, array({', '.join(map(str, r))}))' for (v, layer), r in containers.AUDIO_RATES.items())}))"
    d = table(spark, sf, "part").selectExpr("p_partkey", "p_size % 2 AS pad", "p_size % 3 AS f", "p_partkey div 3 % 3 + 1 AS layer", "p_partkey % 14 + 1 AS i", "p_partkey % 3 AS low")
    d = d.selectExpr("*", f"{rates}[CAST(IF(low = 0, 10, 20) + layer AS INT)][CAST(i AS INT)] AS r", "array(44100, 48000, 32000)[f] div array(1, 2, 4)[CAST(low AS INT)] AS rate")
    head = "concat('FF', hex(224 + array(3, 2, 0)[CAST(low AS INT)] * 8 + (4 - layer) * 2 + 1), hex(i * 16 + f * 4 + pad * 2), '00')"
    d = streams(d, head, "CASE WHEN layer = 1 THEN 4 * (r * 12000 div rate + pad) ELSE r * 144000 div rate + pad END", "3")
    return containers.scan_payloads(d, "p_partkey", "payload", containers.audio_units, [*UNITS, "rate"])


GREY_HEAD = b"P5\n8 8\n255\n"
HEX = "h AS (SELECT id, string_agg(printf('%02x', x), '' ORDER BY i) AS h FROM blk GROUP BY id)"


@query("raw_planes", f"WITH {BLK}, {HEX} SELECT id, md5(unhex(h)) AS digest FROM h")
def raw_planes(spark, sf):
    return blocks(spark, sf).select("id", F.md5(y4m.raw_bytes(F.col("x"))).alias("digest"))


@query("grey_images", f"WITH {BLK}, {HEX} SELECT id, md5(unhex('{GREY_HEAD.hex()}' || h)) AS digest FROM h")
def grey_images(spark, sf):
    return blocks(spark, sf).select("id", F.md5(y4m.grey_image(F.col("x"), 8, 8)).alias("digest"))


@query("stream_round_trip", f"""WITH {BLK}, s AS (SELECT id, CAST(sum(x * (i + 1)) AS BIGINT) AS s FROM blk GROUP BY id)
SELECT 'clip' || id % 20 AS path, row_number() OVER (PARTITION BY id % 20 ORDER BY id) - 1 AS frame_no, CASE WHEN id % 3 > 0 THEN 'tpp' END AS tag, 't' AS interlace, '25:' || (id % 20 + 1) AS fps, '1:1' AS sar, 'a|b=' || id % 20 AS xtags, CASE WHEN id % 2 = 0 THEN 'n=' || id ELSE '' END AS frame_xtags, s AS sum FROM s""")
def stream_round_trip(spark, sf):
    """Written as streams and read back: nothing of a frame or its tags is lost."""
    k, none = F.col("id") % 20, F.lit(None).cast("array<long>")
    order = Window.partitionBy(k).orderBy("id")
    d = blocks(spark, sf).select(
        F.concat(F.lit("clip"), k).alias("path"), (F.row_number().over(order) - 1).cast("long").alias("frame_no"), F.when(F.col("id") % 3 > 0, "tpp").alias("tag"),
        F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit("mono").alias("chroma"), F.col("x").alias("y"), none.alias("u"), none.alias("v"), none.alias("a"),
        F.lit("t").alias("interlace"), F.concat(F.lit("25:"), k + 1).alias("fps"), F.lit("1:1").alias("sar"), F.array(F.lit("a"), F.concat(F.lit("b="), k)).alias("xtags"),
        F.when(F.col("id") % 2 == 0, F.array(F.concat(F.lit("n="), F.col("id")))).alias("frame_xtags"),
    )
    back = y4m.parse_streams(y4m.write_stream(d))
    weighted = F.aggregate(F.transform("y", lambda v, i: v * (i + 1)), F.lit(0).cast("long"), lambda s, v: s + v)
    return back.select("path", "frame_no", "tag", "interlace", "fps", "sar", F.array_join("xtags", "|").alias("xtags"), F.array_join("frame_xtags", "|").alias("frame_xtags"), weighted.alias("sum"))


of_block("smooth_edges", lambda p: filters.smooth_edges(p, 8, 8), """, l AS MATERIALIZED (SELECT id, list(x ORDER BY i) AS l FROM blk GROUP BY id), p AS (SELECT id, l, unnest(range(0, 64)) AS i FROM l),
e AS (SELECT *, i % 8 BETWEEN 2 AND 5 AND i // 8 BETWEEN 2 AND 5 AS inside FROM p),
m AS (SELECT *, list_transform(range(-3, 4), lambda d: list_sum([abs(l[i + d + k - 7] - l[i + k + 1]) + abs(l[i - d + k + 9] - l[i + k + 1]) FOR k IN [-1, 0, 1]])) AS f FROM e WHERE inside),
v AS (SELECT *, list_position(f, list_min(f)) - 4 AS d FROM m),
q AS (SELECT id, i, (l[i + 1] + CASE WHEN abs(d) <= 1 THEN (2 * l[i + 1] + l[i + d - 7] + l[i - d + 9]) // 4 ELSE (2 * l[i] + 4 * l[i + 1] + 2 * l[i + 2] + l[i + d - 8] + 2 * l[i + d - 7] + l[i + d - 6] + l[i - d + 8] + 2 * l[i - d + 9] + l[i - d + 10]) // 16 END) // 2 AS x FROM v)
SELECT e.id, e.i, coalesce(q.x, e.l[e.i + 1]) AS x FROM e LEFT JOIN q ON q.id = e.id AND q.i = e.i""")
of_block("cut_out", lambda p: filters.cut(p, 8, 8, 1, 2, 5, 4), "SELECT id, (y - 2) * 5 + c - 1 AS i, x FROM blk WHERE c BETWEEN 1 AND 5 AND y BETWEEN 2 AND 5")
PLACED = ", g AS MATERIALIZED (SELECT DISTINCT id, unnest(range(0, {n})) AS i FROM blk) SELECT g.id, g.i, coalesce(b.x, 16) AS x FROM g LEFT JOIN blk b ON b.id = g.id AND b.c = g.i % {w} - {dx} AND b.y = g.i // {w} - {dy}"
of_block("place_padded", lambda p: filters.place(p, 8, 8, 13, 10), PLACED.format(n=130, w=13, dx=2, dy=1))
of_block("place_bottom_left", lambda p: filters.place(p, 8, 8, 6, 11, "BL"), PLACED.format(n=66, w=6, dx=0, dy=3))
of_block("place_clipped", lambda p: filters.place(p, 8, 8, 5, 4, "TR"), PLACED.format(n=20, w=5, dx=-3, dy=0))


@query("coding_mode", f"""WITH {BLK}, t AS (SELECT a.id, a.x, b.x AS f, c.x AS k FROM blk a JOIN blk b ON b.id = a.id + 1 AND b.i = a.i JOIN blk c ON c.id = a.id + 2 AND c.i = a.i),
s AS (SELECT id, CAST(sum(x * x) AS BIGINT) - CAST(sum(x) AS BIGINT) * CAST(sum(x) AS BIGINT) // 64 + 2304 AS i, CAST(sum((x - f) * (x - f)) AS BIGINT) AS f, CAST(sum((x - k) * (x - k)) AS BIGINT) AS k, CAST(sum((x - ((f + k + 1) >> 1)) * (x - ((f + k + 1) >> 1))) AS BIGINT) AS b FROM t GROUP BY id)
SELECT id, least(i, f, k, b) AS score, CASE least(i, f, k, b) WHEN i THEN 'intra' WHEN f THEN 'forward' WHEN k THEN 'backward' ELSE 'both' END AS mode FROM s""")
def coding_mode(spark, sf):
    d = neighbours(blocks(spark, sf), 2)
    return d.select("id", motion.coding_mode(F.col("x"), F.col("x1"), F.col("x2")).alias("m")).select("id", "m.score", "m.mode")


@query("still_times", f"WITH {FR}, s AS (SELECT user_id, n, (n % 7 + 1) * 27000000 * 1001 // 30000 AS d FROM fr), p AS (SELECT user_id, n, d, CAST(sum(d + 90000) OVER (PARTITION BY user_id ORDER BY n) AS BIGINT) AS pts FROM s) SELECT user_id, n AS still, pts - d AS dts, pts FROM p")
def still_times(spark, sf):
    d = mux.still_times(frames(spark, sf), "user_id", "n", F.col("n") % 7 + 1, 90000, 30000, 1001)
    return d.select("user_id", F.col("n").alias("still"), "dts", "pts")


@query("first_pass_queue", f"""WITH {FR}, r AS (SELECT user_id, n, lead(n) OVER (PARTITION BY user_id ORDER BY n) AS nx FROM fr WHERE n % 3 = 0 OR t = 'error'), z AS (SELECT user_id, max(n) AS last FROM fr GROUP BY 1)
SELECT fr.user_id, fr.n AS frame_no, coalesce(r.nx, z.last) AS released FROM fr JOIN z ON z.user_id = fr.user_id ASOF LEFT JOIN r ON r.user_id = fr.user_id AND fr.n < r.n""")
def first_pass_queue(spark, sf):
    d = temporal.released(frames(spark, sf), "user_id", "n", (F.col("n") % 3 == 0) | (F.col("t") == "error"))
    return d.select("user_id", F.col("n").alias("frame_no"), "released")


@query("luminance_mean", f"WITH {PAIR} SELECT id, CAST(sum(v) AS BIGINT) // 12 AS mean FROM (SELECT id, a AS v FROM pr WHERE i IN (0, 1, 5, 6, 31, 32, 36, 37) UNION ALL SELECT id, b FROM pr WHERE i IN (0, 1, 5, 6)) GROUP BY id")
def luminance_mean(spark, sf):
    """An 8 x 8 plane of luma and the upper half of the next block as a plane of 8 x 4."""
    d = neighbours(blocks(spark, sf), 1)
    return d.select("id", stats.luminance_mean([(F.col("x"), 8, 8), (F.slice("x1", 1, 32), 8, 4)]).alias("mean"))


@query("scene_list", scene_sql("user_id", "AND t = lag(t) OVER w", 20).replace("FROM fr WINDOW", ", coalesce(abs(floor(v) - lag(floor(v)) OVER w) <= 20, false) AS same FROM fr WINDOW") + " SELECT user_id, CAST(scene AS BIGINT) AS scene, min(n) AS first_frame, max(n) AS last_frame, arg_min(same, n) AS joined FROM k GROUP BY user_id, scene")
def scene_list(spark, sf):
    return temporal.scene_list(frames(spark, sf), "user_id", "n", F.floor("v"), "t", 20)


@query("underruns", """WITH RECURSIVE l AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS turn, l_discount >= 0.07 AS late FROM lineitem),
c AS (SELECT l_suppkey, min(turn) AS turn, CAST(1 AS BIGINT) AS n FROM l WHERE late GROUP BY 1 UNION ALL SELECT c.l_suppkey, (SELECT min(l.turn) FROM l WHERE late AND l.l_suppkey = c.l_suppkey AND l.turn >= c.turn + 20), n + 1 FROM c WHERE n < 11 AND c.turn IS NOT NULL)
SELECT l_suppkey, CAST(max(n) AS BIGINT) AS underruns, max(CASE WHEN n = 11 THEN turn END) AS stopped_at FROM c WHERE turn IS NOT NULL GROUP BY 1""")
def underruns(spark, sf):
    """Lines of a supplier by date are its turns; those of a high discount are late."""
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    d = table(spark, sf, "lineitem").select("l_suppkey", F.row_number().over(w).alias("turn"), "l_discount")
    return mux.underruns(d, "l_suppkey", "turn", F.col("l_discount") >= 0.07, 20)


@query("half_match", f"""WITH {PAIR}, l AS MATERIALIZED (SELECT id, list(a ORDER BY i) AS p, list(b ORDER BY i) AS r FROM pr GROUP BY id), o AS (SELECT id, p, r, unnest(range(-1, 2)) AS dx FROM l), q AS (SELECT *, unnest(range(-1, 2)) AS dy FROM o),
b AS (SELECT *, unnest([18, 19, 20, 21, 26, 27, 28, 29, 34, 35, 36, 37, 42, 43, 44, 45]) AS i FROM q),
s AS (SELECT id, dx, dy, CAST(sum(abs(p[i + 1] - CASE WHEN dx <> 0 AND dy <> 0 THEN (r[i + 1] + r[i + 1 + dx] + r[i + 1 + 8 * dy] + r[i + 1 + 8 * dy + dx] + 2) >> 2 ELSE (r[i + 1] + r[i + 1 + 8 * dy + dx] + 1) >> 1 END)) AS BIGINT) AS weight FROM b GROUP BY id, dx, dy)
SELECT id, weight, dx, dy FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY weight, dx, dy) = 1""")
def half_match(spark, sf):
    d = neighbours(blocks(spark, sf), 1)
    found = motion.half_candidates(motion.block_of(F.col("x"), 8, 2, 2, 4, 4), F.col("x1"), 4, 4, 8, 8, 2, 2)
    return d.select("id", motion.best(found).alias("m")).select("id", "m.*")


@query("nearest_buckets", """WITH RECURSIVE e AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1),
c AS (SELECT event_type, least(CAST(floor(coalesce((value - lo) / nullif(hi - lo, 0) * 128, 0)) AS BIGINT), 127) AS cell, value FROM events JOIN e USING (event_type)),
f AS (SELECT event_type, count(*) AS n, min(value) AS lo, max(value) AS hi, sum(value) AS s FROM c GROUP BY event_type, cell),
g AS (SELECT event_type, list({'n': n, 'lo': lo, 'hi': hi, 's': s} ORDER BY lo) AS l FROM f GROUP BY 1
UNION ALL SELECT event_type, l[1:k - 1] || [{'n': l[k].n + l[k + 1].n, 'lo': l[k].lo, 'hi': l[k + 1].hi, 's': l[k].s + l[k + 1].s}] || l[k + 2:] FROM (SELECT *, list_position(d, list_min(d)) AS k FROM (SELECT *, [(l[i + 1].lo - l[i].hi) * ln(l[i].n + l[i + 1].n) FOR i IN range(1, len(l))] AS d FROM g WHERE len(l) > 16))),
u AS (SELECT event_type, l, unnest(range(0, len(l))) AS bucket FROM g WHERE len(l) <= 16)
SELECT event_type, bucket, l[bucket + 1].n AS samples, l[bucket + 1].lo AS lo, l[bucket + 1].hi AS hi, CAST(round(l[bucket + 1].s / l[bucket + 1].n * 10000) AS BIGINT) AS mean FROM u""")
def nearest_buckets(spark, sf):
    d = rate.nearest_sketch(table(spark, sf, "events"), "value", 16, "event_type", cells=128)
    return d.withColumn("mean", F.round(F.round(F.col("mean") * 10000, 6)).cast("long"))  # a millionth decides nothing
