"""Named queries over the given tables, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.planes import cdiv
from ..operators import coding, combine, filters, guide, motion, mux, rate, regions, stats, temporal, timeline
from ..sources import containers
from .tables import blocks, cells, frames, neighbours, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

FR = "fr AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, value AS v, event_type AS t, event_id, ts FROM events)"
# Planes are made once: a plan that joins the vectors themselves may be turned into a product of all of them.
BLK = "blk AS MATERIALIZED (SELECT id, i - 1 AS i, (i - 1) % 8 AS c, (i - 1) // 8 AS y, CAST(floor((CAST(v AS DOUBLE) + 0.6) * 212) AS BIGINT) AS x, label FROM (SELECT vec_id AS id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM embeddings))"
PAIR = BLK + ", pr AS MATERIALIZED (SELECT a.id, a.i, a.c, a.y, a.x AS a, b.x AS b FROM blk a JOIN blk b ON b.id = a.id + 1 AND b.i = a.i)"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# Timelines.

RUNS = FR + """, m AS (SELECT *, CASE WHEN t = lag(t) OVER w AND n = lag(n) OVER w + 1 THEN 0 ELSE 1 END AS b FROM fr WINDOW w AS (PARTITION BY user_id ORDER BY n)),
k AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY n) - 1 AS run FROM m),
runs AS (SELECT user_id, CAST(run AS BIGINT) AS run, min(t) AS event_type, min(n) AS first_frame, max(n) AS last_frame, count(*) AS n FROM k GROUP BY user_id, run)"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.compress(frames(spark, sf).withColumn("frame", F.col("n")), "user_id", "n", "t", "frame").withColumnRenamed("t", "event_type")


query("edl_compress", f"WITH {RUNS} SELECT * FROM runs")(runs)


@query("edl_expand", f"WITH {FR} SELECT user_id, t AS event_type, n AS frame_no FROM fr")
def edl_expand(spark, sf):
    return timeline.expand(runs(spark, sf), "first_frame", "last_frame").select("user_id", "event_type", "frame_no")


@query("edl_renumber", "SELECT event_type, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS BIGINT) AS file_no FROM (SELECT DISTINCT event_type FROM events)")
def edl_renumber(spark, sf):
    return timeline.renumber(table(spark, sf, "events"), "event_type")


def positions(spark, sf):
    return frames(spark, sf).select("user_id", F.col("n").alias("pos"), F.col("n").alias("frame_no"))


@query("edl_copy", f"WITH {FR} SELECT user_id, n - 3 AS pos, n AS frame_no FROM fr WHERE n BETWEEN 3 AND 12")
def edl_copy(spark, sf):
    return timeline.copy(positions(spark, sf), "pos", 3, 12)


@query("edl_delete", f"WITH {FR} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY n) - 1 AS pos, n AS frame_no FROM fr WHERE n NOT BETWEEN 10 AND 19")
def edl_delete(spark, sf):
    return timeline.delete(positions(spark, sf), "pos", 10, 19)


@query("edl_cut", f"WITH {FR} SELECT user_id, 'kept' AS part, row_number() OVER (PARTITION BY user_id ORDER BY n) - 1 AS pos, n AS frame_no FROM fr WHERE n NOT BETWEEN 4 AND 8 UNION ALL SELECT user_id, 'clip', n - 4, n FROM fr WHERE n BETWEEN 4 AND 8")
def edl_cut(spark, sf):
    clip, kept = timeline.cut(positions(spark, sf), "pos", 4, 8)
    return kept.withColumn("part", F.lit("kept")).unionByName(clip.withColumn("part", F.lit("clip"))).select("user_id", "part", "pos", "frame_no")


@query("edl_paste", f"""WITH {FR}, z AS (SELECT user_id, count(*) AS s, least(count(*), 5) AS k FROM fr GROUP BY 1)
SELECT fr.user_id, CASE WHEN n >= least(10, s) THEN n + k ELSE n END AS pos, n AS frame_no FROM fr JOIN z USING (user_id)
UNION ALL SELECT fr.user_id, n + least(10, s), n FROM fr JOIN z USING (user_id) WHERE n <= 4""")
def edl_paste(spark, sf):
    p = positions(spark, sf)
    return timeline.paste(p, timeline.copy(p, "pos", 0, 4), "user_id", "pos", 10)


@query("edl_move", f"""WITH {FR}, b AS (SELECT user_id FROM fr GROUP BY 1 HAVING count(*) > 21),
o AS (SELECT user_id, n, CASE WHEN n BETWEEN 5 AND 9 THEN 19.5 + n / 1000.0 ELSE n END AS k FROM fr WHERE user_id IN (SELECT user_id FROM b))
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY k) - 1 AS pos, n AS frame_no FROM o""")
def edl_move(spark, sf):
    p = positions(spark, sf)
    long = p.groupBy("user_id").agg(F.count("*").alias("size")).filter("size > 21").select("user_id")
    return timeline.move(p.join(long, "user_id", "left_semi"), "pos", 5, 9, 20)


@query("edl_insert", f"""WITH {FR}, a AS (SELECT user_id, event_id, CASE WHEN t = 'purchase' THEN 1 ELSE 0 END AS m, n FROM fr),
l AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, m ORDER BY n) - 1 AS p, m FROM a),
z AS (SELECT user_id, count(*) FILTER (m = 0) AS s FROM l GROUP BY 1),
o AS (SELECT l.user_id, event_id, CASE WHEN m = 1 THEN least(7, s) - 0.5 ELSE p END AS k, p FROM l JOIN z USING (user_id) WHERE s > 0)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY k, p) - 1 AS pos, event_id FROM o""")
def edl_insert(spark, sf):
    f = frames(spark, sf)
    dense = lambda d: d.select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("n")) - 1).cast("long").alias("pos"), "event_id")
    return timeline.insert(dense(f.filter("t <> 'purchase'")), dense(f.filter("t = 'purchase'")), "user_id", "pos", 7)


@query("edl_frame_at", f"WITH {FR} SELECT user_id, min(n) AS pos, arg_max(event_id, n) AS event_id FROM (SELECT user_id, n, event_id FROM fr QUALIFY n = least(40, max(n) OVER (PARTITION BY user_id))) GROUP BY 1")
def edl_frame_at(spark, sf):
    return timeline.frame_at(frames(spark, sf).select("user_id", F.col("n").alias("pos"), "event_id"), "user_id", "pos", 40)


@query("every_nth", f"WITH {FR} SELECT user_id, n AS frame_no, v AS value FROM fr WHERE n % 4 = 0")
def every_nth(spark, sf):
    return timeline.every_nth(frames(spark, sf).select("user_id", F.col("n").alias("frame_no"), F.col("v").alias("value")), "frame_no", 4)


@query("playable_range", f"WITH {FR} SELECT user_id, n AS pos, event_id FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS s FROM fr) WHERE n >= greatest(s - 30, 0) AND n < greatest(s - 30, 0) + 10")
def playable_range(spark, sf):
    return timeline.offset_count(frames(spark, sf).select("user_id", F.col("n").alias("pos"), "event_id"), "user_id", "pos", -30, 10)


@query("play_speed", f"WITH {FR}, z AS (SELECT user_id, count(*) AS s FROM fr GROUP BY 1) SELECT user_id, k AS step, least(greatest(30 - 7 * k, 0), s - 1) AS pos FROM z, range(0, 9) r(k)")
def play_speed(spark, sf):
    sizes = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("s"))
    return timeline.step_through(sizes, "s", 30, -7, 8).drop("s")


@query("rotate_range", f"WITH {FR} SELECT user_id, CASE WHEN n BETWEEN 2 AND 8 THEN (n - 2 + 3) % 7 + 2 ELSE n END AS pos, n AS frame_no FROM fr")
def rotate_range(spark, sf):
    return timeline.rotate(positions(spark, sf), "pos", 2, 8, 3)


@query("exchange_frames", f"WITH {FR} SELECT user_id, CASE n WHEN 3 THEN 11 WHEN 11 THEN 3 ELSE n END AS pos, n AS frame_no FROM fr")
def exchange_frames(spark, sf):
    return timeline.exchange(positions(spark, sf), "pos", 3, 11)


@query("duplicate_range", f"WITH {FR} SELECT user_id, CASE WHEN n > 5 THEN n + 8 ELSE n + k * 4 END AS pos, n AS frame_no FROM fr, range(0, 3) r(k) WHERE k = 0 OR n BETWEEN 2 AND 5")
def duplicate_range(spark, sf):
    return timeline.duplicate(positions(spark, sf), "pos", 2, 5, 2)


@query("concat_streams", f"WITH {FR} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, n) - 1 AS pos, t AS event_type, n AS frame_no FROM fr")
def concat_streams(spark, sf):
    w = Window.partitionBy("user_id").orderBy("t", "n")
    return frames(spark, sf).select("user_id", (F.row_number().over(w) - 1).cast("long").alias("pos"), F.col("t").alias("event_type"), F.col("n").alias("frame_no"))


@query("pipe_segments", """WITH s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS segment, 1 + coalesce(length(text), 0) % 50 AS c, turn, role, text FROM conversations),
p AS (SELECT conv_id, segment, c, sum(c) OVER (PARTITION BY conv_id ORDER BY segment) - c AS lo FROM s)
SELECT conv_id, segment, CAST(20 - lo AS BIGINT) AS frame_in_segment FROM p WHERE lo <= 20 AND 20 < lo + c""")
def pipe_segments(spark, sf):
    c = table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = c.select("conv_id", F.row_number().over(w).alias("at"), (1 + F.coalesce(F.length("text"), F.lit(0)) % 50).cast("long").alias("c"))
    return timeline.locate(c, "conv_id", "at", "c", 20)


# Listings.

LIST = "li AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderdate AS start, o_orderdate + to_days(CAST(1 + o_custkey % 7 AS INTEGER)) AS stop, CAST(epoch(o_orderdate) AS BIGINT) AS s0, CAST(epoch(o_orderdate) AS BIGINT) + (1 + o_custkey % 7) * 86400 AS s1 FROM orders)"
T0, T1 = 852076800, 852249600  # two days from 1997-01-01


def listings(spark, sf):
    o = table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))
    start = guide.seconds("o_orderdate")
    return o.withColumn("s0", start).withColumn("s1", start + (1 + F.col("o_custkey") % 7) * 86400)


@query("guide_overlap", f"WITH {LIST} SELECT o_orderkey, s0 AS start, s1 AS stop FROM li WHERE (s0 < {T0} + 1 AND s1 > {T0} - 1) OR (s0 > {T0} - 1 AND s0 < {T1} + 1801)")
def guide_overlap(spark, sf):
    return guide.overlap_search(listings(spark, sf), F.col("s0"), F.col("s1"), T0, T1).select("o_orderkey", F.col("s0").alias("start"), F.col("s1").alias("stop"))


@query("guide_next", f"WITH {LIST} SELECT o_custkey, o_orderkey, s0 AS start FROM li WHERE s0 < {T0} + 1800 AND s1 > {T0} QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY s0, o_orderkey) = 1")
def guide_next(spark, sf):
    d = listings(spark, sf).select("o_custkey", "o_orderkey", "s0", "s1")
    return guide.next_listing(d, "o_custkey", F.col("s0"), F.col("s1"), T0, "o_orderkey").select("o_custkey", "o_orderkey", F.col("s0").alias("start"))


@query("guide_coalesce", """WITH li AS (SELECT DISTINCT c_nationkey % 5 AS station, epoch(date_trunc('day', o_orderdate)) // 86400 AS a, epoch(date_trunc('day', o_orderdate)) // 86400 + 1 + o_orderkey % 3 AS z FROM orders JOIN customer ON o_custkey = c_custkey),
m AS (SELECT *, CASE WHEN a = lag(z) OVER w THEN 0 ELSE 1 END AS b FROM li WINDOW w AS (PARTITION BY station ORDER BY a, z)),
k AS (SELECT *, sum(b) OVER (PARTITION BY station ORDER BY a, z) AS g FROM m)
SELECT CAST(station AS BIGINT) AS station, CAST(min(a) AS BIGINT) AS start, CAST(max(z) AS BIGINT) AS stop, count(*) AS n FROM k GROUP BY station, g""")
def guide_coalesce(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("long")
    d = o.select((F.col("c_nationkey") % 5).cast("long").alias("station"), day.alias("start"), (day + 1 + F.col("o_orderkey") % 3).alias("stop"))
    return guide.coalesce_listings(d, ["station"], "start", "stop")


def rule():
    p = F.substring("o_orderpriority", 1, 1)
    return F.when(p == "1", "once").when(p == "2", "daily").when(p == "3", "weekly").otherwise("weekdays")


@query("repeat_schedule", f"WITH {LIST} SELECT o_orderkey, k AS step, start + to_days(CAST(k * CASE WHEN o_orderpriority LIKE '3%' THEN 7 ELSE 1 END AS INTEGER)) AS start FROM li, range(1, 4) r(k) WHERE o_orderpriority NOT LIKE '1%'")
def repeat_schedule(spark, sf):
    return guide.repeats(listings(spark, sf).select("o_orderkey", F.col("o_orderdate").alias("start"), "o_orderpriority"), rule(), "start", 3).select("o_orderkey", "step", "start")


@query("slot_grid", f"WITH {LIST} SELECT o_orderkey, unnest(range((s0 // 43200) * 43200, s1, 43200)) AS slot FROM li")
def slot_grid(spark, sf):
    return guide.slot_grid(listings(spark, sf), F.col("s0"), F.col("s1"), 43200).select("o_orderkey", "slot")


@query("recording_due", f"WITH {LIST} SELECT o_orderkey, CASE WHEN s1 <= {T0} THEN 'expired' WHEN s0 - 30 <= {T0} THEN 'due' ELSE 'waiting' END AS state FROM li")
def recording_due(spark, sf):
    return guide.due(listings(spark, sf), F.col("s0"), F.col("s1"), T0).select("o_orderkey", "state")


@query("device_conflict", f"WITH {LIST} SELECT o_custkey, o_orderkey, coalesce(s0 < max(s1) OVER (PARTITION BY o_custkey ORDER BY s0, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS conflict FROM li")
def device_conflict(spark, sf):
    return guide.device_conflicts(listings(spark, sf), "o_custkey", "s0", "s1", "o_orderkey").select("o_custkey", "o_orderkey", "conflict")


@query("guide_append", f"""WITH {LIST}, d AS (SELECT o_custkey % 97 AS station, substr(o_orderpriority, 1, 1) AS title_id, o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN '..' ELSE '' END AS title, s0 // 86400 AS a, s1 // 86400 AS z, (s1 // 86400 - s0 // 86400) * 1440 AS length, o_orderkey FROM li),
o AS (SELECT * EXCLUDE o_orderkey FROM d WHERE o_orderkey % 2 = 0), w AS (SELECT * EXCLUDE o_orderkey FROM d WHERE o_orderkey % 2 = 1),
f AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.station = w.station AND o.title_id = w.title_id AND o.a = w.a) AND NOT EXISTS (SELECT 1 FROM o WHERE o.station = w.station AND o.title_id = w.title_id AND o.z = w.z)
QUALIFY row_number() OVER (PARTITION BY station, title_id, a ORDER BY z, title) = 1 AND row_number() OVER (PARTITION BY station, title_id, z ORDER BY a, title) = 1),
u AS (SELECT *, 0 AS fresh FROM o UNION ALL SELECT *, 1 FROM f),
m AS (SELECT *, row_number() OVER x AS n, CASE WHEN fresh = 1 AND a = lag(z) OVER x THEN 0 ELSE 1 END AS b FROM u WINDOW x AS (PARTITION BY station, title_id ORDER BY a, z, fresh, title)),
k AS (SELECT *, sum(b) OVER (PARTITION BY station, title_id ORDER BY n) AS g FROM m)
SELECT station, title_id, min(a) AS a, max(z) AS z, CAST(sum(length) AS BIGINT) AS length, coalesce(arg_min(title, n) FILTER (instr(title, '..') <= 1), arg_max(title, n)) AS title FROM k GROUP BY station, title_id, g""")
def guide_append(spark, sf):
    """Orders with an odd key are new. Every third title is cut short."""
    title = F.concat("o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, "..").otherwise("")).alias("title")
    d = listings(spark, sf).select((F.col("o_custkey") % 97).alias("station"), F.substring("o_orderpriority", 1, 1).alias("title_id"), title, cdiv(F.col("s0"), 86400).alias("a"), cdiv(F.col("s1"), 86400).alias("z"), "o_orderkey")
    d = d.withColumn("length", (F.col("z") - F.col("a")) * 1440)
    return guide.append_entries(d.filter("o_orderkey % 2 = 0"), d.filter("o_orderkey % 2 = 1"), ["station", "title_id"], "a", "z", "length", "title")


@query("station_fallback", "SELECT s_suppkey, CAST(s_suppkey % 40 AS VARCHAR) AS key, coalesce(n_name, r_name, CAST(s_suppkey % 40 AS VARCHAR)) AS name FROM supplier LEFT JOIN nation ON n_nationkey = s_suppkey % 40 LEFT JOIN region ON r_regionkey = s_suppkey % 40 - 25")
def station_fallback(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % 40).cast("string").alias("key"))
    late = table(spark, sf, "region").select((F.col("r_regionkey") + 25).alias("k"), "r_name")
    return guide.with_fallback(s, "key", [(table(spark, sf, "nation"), "n_nationkey", "n_name"), (late, "k", "r_name")], "name")


@query("time_code", f"WITH {FR} SELECT user_id, n AS frame_no, (n * 997) // 108000 AS h, (n * 997) // 1800 % 60 AS m, (n * 997) // 30 % 60 AS s, (n * 997) % 30 AS f FROM fr")
def time_code(spark, sf):
    return frames(spark, sf).select("user_id", F.col("n").alias("frame_no"), scalar.time_code(F.col("n") * 997).alias("c")).select("user_id", "frame_no", "c.*")


@query("time_code_drop", f"""WITH {FR}, g AS (SELECT user_id, n, n * 997 AS f FROM fr),
d AS (SELECT user_id, n, f + 18 * (f // 17982) + CASE WHEN f % 17982 >= 1800 THEN 2 * (1 + (f % 17982 - 1800) // 1798) ELSE 0 END AS l FROM g)
SELECT user_id, n AS frame_no, l // 108000 AS h, l // 1800 % 60 AS m, l // 30 % 60 AS s, l % 30 AS f FROM d""")
def time_code_drop(spark, sf):
    return frames(spark, sf).select("user_id", F.col("n").alias("frame_no"), scalar.time_code_drop(F.col("n") * 997).alias("c")).select("user_id", "frame_no", "c.*")


@query("ratio_reduce", "SELECT p_partkey, p_size * 12 // gcd(p_size * 12, p_partkey) AS n, p_partkey // gcd(p_size * 12, p_partkey) AS d FROM part")
def ratio_reduce(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", scalar.ratio_reduce((F.col("p_size") * 12).cast("long"), F.col("p_partkey")).alias("r")).select("p_partkey", "r.*")


# Statistics.


@query("plane_histogram", f"WITH {BLK} SELECT x, count(*) AS n FROM blk GROUP BY x")
def plane_histogram(spark, sf):
    return stats.histogram(blocks(spark, sf), "x").select("x", "n")


@query("histogram_delta", f"WITH {BLK}, h AS (SELECT i, x // 32 AS x, count(*) AS n FROM blk GROUP BY 1, 2) SELECT i, x, n FROM h")
def histogram_delta(spark, sf):
    """Counts by place differ from the running counts that a stream would show: they are taken back from those."""
    c = cells(blocks(spark, sf), "x").groupBy("i", cdiv(F.col("x"), 32).alias("x")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("x").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return stats.histogram_delta(c.withColumn("n", F.sum("n").over(w)), "i", "x").select("i", "x", "n")


@query("histogram_peak", f"WITH {BLK}, h AS (SELECT label, x, count(*) AS n FROM blk GROUP BY 1, 2) SELECT CAST(label AS BIGINT) AS label, x AS peak, n FROM h QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, x) = 1")
def histogram_peak(spark, sf):
    return stats.histogram_peak(stats.histogram(blocks(spark, sf), "x", "label"), "label").withColumn("label", F.col("label").cast("long"))


@query("histogram_percent", f"WITH {BLK}, h AS (SELECT label, x, count(*) AS n FROM blk GROUP BY 1, 2) SELECT CAST(label AS BIGINT) AS label, x, n, n // nullif(max(n) OVER (PARTITION BY label) // 100, 0) AS percent FROM h")
def histogram_percent(spark, sf):
    return stats.histogram_percent(stats.histogram(blocks(spark, sf), "x", "label"), "label").withColumn("label", F.col("label").cast("long"))


@query("vectorscope", f"WITH {PAIR} SELECT DISTINCT a // 8 AS u, b // 8 AS v FROM pr")
def vectorscope(spark, sf):
    return stats.occupancy(neighbours(blocks(spark, sf), 1), "x", "x1", 8)


@query("sampled_mean", f"WITH {BLK} SELECT id, CAST(sum(x) AS BIGINT) // 13 AS mean FROM blk WHERE i % 5 = 0 GROUP BY id")
def sampled_mean(spark, sf):
    return blocks(spark, sf).select("id", stats.sampled_mean(F.col("x"), 64, 5).alias("mean"))


@query("block_variance", f"WITH {BLK}, s AS (SELECT id, CAST(sum(x) AS BIGINT) AS s, CAST(sum(x * x) AS BIGINT) AS s2 FROM blk GROUP BY id) SELECT id, s // 64 AS mean, s2 - (s * s) // 64 AS var FROM s")
def block_variance(spark, sf):
    return blocks(spark, sf).select("id", stats.mean(F.col("x")).alias("mean"), stats.variance(F.col("x")).alias("var"))


@query("block_distance", f"WITH {PAIR} SELECT id, CAST(sum(abs(a - b)) AS BIGINT) AS sad, CAST(sum((a - b) * (a - b)) AS BIGINT) AS ssd FROM pr GROUP BY id")
def block_distance(spark, sf):
    return neighbours(blocks(spark, sf), 1).select("id", stats.sad(F.col("x"), F.col("x1")).alias("sad"), stats.ssd(F.col("x"), F.col("x1")).alias("ssd"))


@query("bidirectional_distance", f"WITH {BLK} SELECT a.id, CAST(sum(abs(a.x - ((b.x + c.x + 1) >> 1))) AS BIGINT) AS sad, CAST(sum((a.x - ((b.x + c.x + 1) >> 1)) * (a.x - ((b.x + c.x + 1) >> 1))) AS BIGINT) AS ssd FROM blk a JOIN blk b ON b.id = a.id + 1 AND b.i = a.i JOIN blk c ON c.id = a.id + 2 AND c.i = a.i GROUP BY a.id")
def bidirectional_distance(spark, sf):
    x, a, b = (F.col(c) for c in ("x", "x1", "x2"))
    return neighbours(blocks(spark, sf), 2).select("id", stats.bidirectional_sad(x, a, b).alias("sad"), stats.bidirectional_ssd(x, a, b).alias("ssd"))


@query("subsample", f"WITH {BLK} SELECT id, (y // 2) * 4 + c // 2 AS i, CAST(sum(x) AS BIGINT) >> 2 AS x FROM blk GROUP BY id, y // 2, c // 2")
def subsample(spark, sf):
    return cells(blocks(spark, sf), stats.subsample(F.col("x"), 8, 8))


@query("subsampled_distance", f"WITH {BLK}, s AS (SELECT id, (y // 2) * 4 + c // 2 AS i, CAST(sum(x) AS BIGINT) >> 2 AS x FROM blk GROUP BY id, y // 2, c // 2) SELECT a.id, CAST(sum(abs(a.x - b.x)) AS BIGINT) AS sad FROM s a JOIN s b ON b.id = a.id + 1 AND b.i = a.i GROUP BY a.id")
def subsampled_distance(spark, sf):
    b = blocks(spark, sf).select("id", stats.subsample(F.col("x"), 8, 8).alias("x"))
    return neighbours(b, 1).select("id", stats.sad(F.col("x"), F.col("x1")).alias("sad"))


@query("half_pel", f"""WITH {BLK} SELECT a.id, a.i, (a.x + b.x + d.x + e.x + 2) >> 2 AS x FROM blk a JOIN blk b ON b.id = a.id AND b.y = a.y AND b.c = least(a.c + 1, 7)
JOIN blk d ON d.id = a.id AND d.y = least(a.y + 1, 7) AND d.c = a.c JOIN blk e ON e.id = a.id AND e.y = d.y AND e.c = b.c""")
def half_pel(spark, sf):
    return cells(blocks(spark, sf), stats.half_pel(F.col("x"), 8, 8, 1, 1))


@query("signal_to_noise", f"WITH {PAIR}, s AS (SELECT id, sum(a) / 64.0 AS m, sum(a * a) / 64.0 AS q, sum((a - b) * (a - b)) / 64.0 AS e FROM pr GROUP BY id) SELECT id, CAST(round(10000 * 10 * log10((q - m * m) / greatest(e, 1e-5))) AS BIGINT) AS db FROM s")
def signal_to_noise(spark, sf):
    return neighbours(blocks(spark, sf), 1).select("id", F.round(stats.snr(F.col("x"), F.col("x1")).db * 10000).cast("long").alias("db"))


@query("field_difference", f"""WITH {PAIR}, d AS (SELECT id, y % 2 AS f, greatest(abs(a - b) - 5, 0) AS g FROM pr),
k AS (SELECT p.id, greatest(abs(p.a - q.b) - 5, 0) AS g FROM pr p JOIN pr q ON q.id = p.id AND q.i = p.i - 8 WHERE p.y % 2 = 1)
SELECT d.id, CAST(sum((g * g) >> 4) FILTER (f = 0) AS BIGINT) AS even, CAST(sum((g * g) >> 4) FILTER (f = 1) AS BIGINT) AS odd, any_value(k.s) AS "cross" FROM d JOIN (SELECT id, CAST(sum((g * g) >> 4) AS BIGINT) AS s FROM k GROUP BY id) k ON k.id = d.id GROUP BY d.id""")
def field_difference(spark, sf):
    return neighbours(blocks(spark, sf), 1).select("id", stats.field_difference(F.col("x"), F.col("x1"), 8, 5).alias("d")).select("id", "d.*")


@query("packet_summary", "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS packets, CAST(sum(l_quantity) AS BIGINT) AS bytes FROM lineitem GROUP BY 1, 2")
def packet_summary(spark, sf):
    return stats.packet_summary(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_quantity"), ["flag", "status"], "l_quantity")


@query("units_by_type", "SELECT event_type, count(*) AS units, CAST(sum(length(props)) AS BIGINT) // count(*) AS mean_length FROM events GROUP BY 1")
def units_by_type(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("units"), cdiv(F.sum(F.length("props")), F.count("*")).alias("mean_length"))


@query("activity", f"WITH {BLK} SELECT id, CAST(greatest(12.0, sum(abs(x - 127) * (i % 8 + 1))) AS BIGINT) AS act FROM blk GROUP BY id")
def activity(spark, sf):
    return blocks(spark, sf).select("id", stats.activity(F.transform("x", lambda v: v - 127), [i % 8 + 1 for i in range(64)]).cast("long").alias("act"))


# Time.


def scene_sql(key: str, change: str, threshold: int) -> str:
    return f"""WITH {FR}, m AS (SELECT *, CASE WHEN abs(floor(v) - lag(floor(v)) OVER w) <= {threshold} AND n = lag(n) OVER w + 1 {change} THEN 0 ELSE 1 END AS b FROM fr WINDOW w AS (PARTITION BY {key} ORDER BY n)),
k AS (SELECT *, sum(b) OVER (PARTITION BY {key} ORDER BY n) - 1 AS scene FROM m)"""


@query("scene_cut", scene_sql("user_id", "AND t = lag(t) OVER w", 4) + " SELECT user_id, CAST(scene AS BIGINT) AS scene, min(n) AS first_frame, max(n) AS last_frame FROM k GROUP BY user_id, scene")
def scene_cut(spark, sf):
    return temporal.scenes(frames(spark, sf), "user_id", "n", F.floor("v"), "t")


@query("scene_cut_typed", scene_sql("user_id, t", "", 20) + " SELECT user_id || ':' || t AS stream, CAST(scene AS BIGINT) AS scene, min(n) AS first_frame, max(n) AS last_frame FROM k GROUP BY user_id, t, scene")
def scene_cut_typed(spark, sf):
    f = frames(spark, sf).withColumn("stream", F.concat_ws(":", F.col("user_id").cast("string"), "t"))
    return temporal.scenes(f, "stream", "n", F.floor("v"), None, 20)


@query("conceal", f"WITH {FR} SELECT user_id, n AS frame_no, last_value(CASE WHEN t <> 'error' THEN v END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM fr")
def conceal(spark, sf):
    return temporal.conceal(frames(spark, sf), "user_id", "n", "v", F.col("t") == "error").select("user_id", F.col("n").alias("frame_no"), F.col("v").alias("value"))


@query("temporal7", f"""WITH {FR}, c AS (SELECT user_id, n, CAST(round(v * 100) AS BIGINT) AS v FROM fr),
p AS (SELECT a.user_id, a.n, a.v AS r, b.v AS f, CASE WHEN a.n = b.n THEN 201 ELSE greatest(0, 200 - abs(a.v - b.v)) END AS w FROM c a JOIN c b ON a.user_id = b.user_id AND b.n BETWEEN a.n - 3 AND a.n + 3)
SELECT user_id, n AS frame_no, (CAST(sum(w * f) AS BIGINT) * 2 // CAST(sum(w) AS BIGINT) + 1) // 2 AS value FROM p GROUP BY user_id, n""")
def temporal7(spark, sf):
    f = frames(spark, sf).select("user_id", F.col("n").alias("frame_no"), F.round(F.col("v") * 100).cast("long").alias("value"))
    return temporal.denoise7(f, "user_id", "frame_no", "value", 200)


@query("stabilise", f"""WITH RECURSIVE {FR}, s AS (SELECT user_id, n, v / 2 AS gs FROM fr WHERE n = 0 UNION ALL SELECT fr.user_id, fr.n, s.gs * 0.95 + fr.v / 2 FROM s JOIN fr ON fr.user_id = s.user_id AND fr.n = s.n + 1)
SELECT user_id, n AS frame_no, CAST(-round(gs) AS BIGINT) AS shift FROM s""")
def stabilise(spark, sf):
    f = frames(spark, sf).select("user_id", F.col("n").alias("frame_no"), "v")
    return temporal.stabilise_arrow(f, "user_id", "frame_no", "v").select("user_id", "frame_no", "shift")


@query("ivtc", f"""WITH {FR}, g AS (SELECT user_id, n // 5 AS g, n % 5 AS k, v FROM fr),
w AS (SELECT user_id, g, max(v) FILTER (k = 0) AS a, max(v) FILTER (k = 1) AS b, max(v) FILTER (k = 2) AS c, max(v) FILTER (k = 3) AS d, max(v) FILTER (k = 4) AS e FROM g GROUP BY 1, 2 HAVING count(*) = 5)
SELECT user_id, g * 4 AS out_frame, a AS top, a AS bottom FROM w UNION ALL SELECT user_id, g * 4 + 1, b, b FROM w UNION ALL SELECT user_id, g * 4 + 2, c, d FROM w UNION ALL SELECT user_id, g * 4 + 3, e, e FROM w""")
def ivtc(spark, sf):
    return temporal.telecine_inverse(frames(spark, sf), "user_id", "n", "v")


@query("interlace", f"WITH {FR} SELECT a.user_id, a.n // 2 AS out_frame, a.v AS top, b.v AS bottom FROM fr a JOIN fr b ON a.user_id = b.user_id AND b.n = a.n + 1 WHERE a.n % 2 = 0")
def interlace(spark, sf):
    return temporal.interlace(frames(spark, sf), "user_id", "n", "v")


@query("cadence", f"""WITH {FR}, d AS (SELECT user_id, n, abs(floor(v) - lag(floor(v)) OVER (PARTITION BY user_id ORDER BY n)) AS d FROM fr)
SELECT user_id, n // 5 AS "group", n AS drop_frame FROM d WHERE d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, n // 5 ORDER BY d, n) = 1""")
def cadence(spark, sf):
    return temporal.cadence(frames(spark, sf), "user_id", "n", F.floor("v")).withColumnRenamed("n", "drop_frame")


@query("lost_frames", f"WITH {FR} SELECT user_id, n AS frame_no, coalesce(event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY n) - 1, 0) AS lost FROM fr")
def lost_frames(spark, sf):
    return temporal.lost_frames(frames(spark, sf), "user_id", "n", "event_id").select("user_id", F.col("n").alias("frame_no"), "lost")


@query("pulldown_fields", f"WITH {FR}, f AS (SELECT user_id, n, CASE WHEN n % 4 IN (0, 2) THEN 3 ELSE 2 END AS k FROM fr) SELECT user_id, n AS frame_no, CAST(sum(k) OVER (PARTITION BY user_id ORDER BY n) - k AS BIGINT) AS first_field, CAST(k AS BIGINT) AS fields FROM f")
def pulldown_fields(spark, sf):
    return temporal.pulldown_fields(frames(spark, sf), "user_id", "n", F.col("n") % 2 == 0).select("user_id", F.col("n").alias("frame_no"), "first_field", "fields")


@query("time_stamps", f"WITH {FR} SELECT user_id, n AS frame_no, n * 2 * 13500000 * 1001 // 30000 AS dts, ((n + 1) * 2 + 2) * 13500000 * 1001 // 30000 AS pts FROM fr")
def time_stamps(spark, sf):
    return temporal.time_stamps(frames(spark, sf), "user_id", "n", F.col("n") + 1, 30000, 1001).select("user_id", F.col("n").alias("frame_no"), "dts", "pts")


@query("group_structure", f"""WITH {FR} SELECT user_id, n AS frame_no, n // 12 AS "group", CASE WHEN n % 12 = 0 THEN 'I' WHEN n % 12 % 3 = 0 OR n % 12 = 11 THEN 'P' ELSE 'B' END AS kind, n % 12 AS temporal_reference FROM fr""")
def group_structure(spark, sf):
    return temporal.group_structure(frames(spark, sf), "n", 12, 3).select("user_id", F.col("n").alias("frame_no"), "group", "kind", "temporal_reference")


@query("group_split", f"""WITH {FR}, k AS (SELECT user_id, n, CASE WHEN n % 12 = 0 OR ((n % 12 % 3 = 0 OR n % 12 = 11) AND t = 'error') THEN 'I' WHEN n % 12 % 3 = 0 OR n % 12 = 11 THEN 'P' ELSE 'B' END AS kind FROM fr)
SELECT user_id, n AS frame_no, kind, CAST(sum(CASE WHEN kind = 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY n) AS BIGINT) AS "group" FROM k""")
def group_split(spark, sf):
    g = temporal.group_structure(frames(spark, sf), "n", 12, 3)
    return temporal.split_groups(g, "user_id", "n", "kind", F.when(F.col("t") == "error", 1.0).otherwise(0.0)).select("user_id", F.col("n").alias("frame_no"), "kind", "group")


@query("audio_ranges", f"WITH {FR} SELECT user_id, n AS frame_no, n * 44100 * 1001 // 30000 AS first, (n + 1) * 44100 * 1001 // 30000 AS last FROM fr")
def audio_ranges(spark, sf):
    first, last = temporal.audio_range(F.col("n"), 44100, 30000, 1001)
    return frames(spark, sf).select("user_id", F.col("n").alias("frame_no"), first.alias("first"), last.alias("last"))


# Combinations.


@query("ypipe", f"""WITH {FR} SELECT a.user_id, a.n * 2 AS out_frame, a.event_id FROM fr a JOIN fr b ON b.user_id = a.user_id + 1 AND b.n = a.n
UNION ALL SELECT a.user_id, b.n * 2 + 1, b.event_id FROM fr a JOIN fr b ON b.user_id = a.user_id + 1 AND b.n = a.n""")
def ypipe(spark, sf):
    """Each stream with that of the next user."""
    f = frames(spark, sf).select("user_id", "n", "event_id")
    return combine.interleave_keyed(f, f.withColumn("user_id", F.col("user_id") - 1), "user_id", "n").select("user_id", "out_frame", "event_id")


@query("zip_streams", f"WITH {FR} SELECT a.user_id, a.n, a.event_id AS event_id_0, b.event_id AS event_id_1, c.event_id AS event_id_2 FROM fr a JOIN fr b ON b.user_id = a.user_id AND b.n = a.n - 2 JOIN fr c ON c.user_id = a.user_id AND c.n = a.n - 5")
def zip_streams(spark, sf):
    """Three inputs of one segment: the stream, and itself 2 and 5 frames late. The key holds stream and frame."""
    f = frames(spark, sf).select("user_id", "n", "event_id")
    late = lambda k, c: f.select("user_id", (F.col("n") + k).alias("n"), F.col("event_id").alias(c))
    return late(0, "event_id_0").join(late(2, "event_id_1"), ["user_id", "n"]).join(late(5, "event_id_2"), ["user_id", "n"])


def of_pair(f):
    return lambda spark, sf: cells(neighbours(blocks(spark, sf), 1), f(F.col("x"), F.col("x1")))


for _op in (0, 128, 200):
    query(f"blend_{_op}", f"WITH {PAIR} SELECT id, i, ((256 - {_op}) * a + {_op} * b) >> 8 AS x FROM pr")(of_pair(lambda a, b, op=_op: combine.blend(a, b, op)))


@query("blend_ramp", f"WITH {PAIR} SELECT id, i, ((256 - (id % 16) * 255 // 15) * a + ((id % 16) * 255 // 15) * b) >> 8 AS x FROM pr")
def blend_ramp(spark, sf):
    d = neighbours(blocks(spark, sf), 1).withColumn("op", combine.ramp(F.col("id") % 16, 0, 255, 16))
    return cells(d, combine.blend(F.col("x"), F.col("x1"), F.col("op")))


@query("matte_blend", f"WITH {BLK} SELECT a.id, a.i, ((235 - m) * a.x + (m - 16) * b.x) // 219 AS x FROM blk a JOIN blk b ON b.id = a.id + 1 AND b.i = a.i JOIN (SELECT id - 2 AS id, i, least(greatest(x, 16), 235) AS m FROM blk) c ON c.id = a.id AND c.i = a.i")
def matte_blend(spark, sf):
    return cells(neighbours(blocks(spark, sf), 2), combine.matte_blend(F.col("x"), F.col("x1"), F.col("x2")))


MODE_SQL = {
    1: "least(greatest(a + 2 * b - 235, 16), 235)",
    2: "greatest(a + b - 235, 16)",
    3: "(a * b) >> 8",
    4: "CASE WHEN b = 255 THEN 16 ELSE least(greatest((a * b) // nullif(255 - b, 0), 16), 235) END",
    5: "abs(a - b)",
    6: "235 - abs(235 - a - b)",
    7: "CASE WHEN b < 16 THEN 16 ELSE greatest(235 - ((235 - a) * (235 - a)) // b, 16) END",
    8: "CASE WHEN a < 16 THEN 16 ELSE greatest(235 - ((235 - b) * (235 - b)) // a, 16) END",
    9: "CASE WHEN b < 128 THEN (a * b) >> 7 ELSE greatest(235 - (((235 - b) * (235 - a)) >> 7), 16) END",
    10: "greatest(a, b)",
}
for _m, _s in MODE_SQL.items():
    query(f"multiblend_{_m}", f"WITH {PAIR} SELECT id, i, {_s} AS x FROM pr")(of_pair(lambda a, b, m=_m: combine.multi_blend(a, b, m)))


@query("fade", f"WITH {BLK} SELECT id, i, CAST(trunc((1 - exp((id % 25) * (-ln(256) / 25))) * 16 + exp((id % 25) * (-ln(256) / 25)) * x) AS BIGINT) AS x FROM blk")
def fade(spark, sf):
    d = blocks(spark, sf).withColumn("f", combine.fade_factor(F.col("id") % 25, 24))
    return cells(d, combine.fade(F.col("x"), 16, F.col("f")))


query("wipe", f"WITH {PAIR} SELECT id, i, CASE WHEN c % 8 < 4 THEN b ELSE a END AS x FROM pr")(of_pair(lambda a, b: combine.wipe(a, b, 8, 8, 1, 1, 0.5)))
query("wipe_up", f"WITH {PAIR} SELECT id, i, CASE WHEN y % 4 < 3 THEN a ELSE b END AS x FROM pr")(of_pair(lambda a, b: combine.wipe(a, b, 8, 8, 4, 2, 0.25)))
query("overlay", f"WITH {PAIR} SELECT p.id, p.i, CASE WHEN p.c BETWEEN 3 AND 6 AND p.y BETWEEN 2 AND 5 THEN q.b ELSE p.a END AS x FROM pr p LEFT JOIN pr q ON q.id = p.id AND q.i = (p.y - 2) * 4 + (p.c - 3) AND p.c BETWEEN 3 AND 6 AND p.y BETWEEN 2 AND 5")(of_pair(lambda a, b: combine.overlay(a, b, 8, 8, 3, 2, 4, 4)))


# Filters of one block.


def of_block(name: str, f, sql: str | None = None):
    query(name, sql and f"WITH {BLK} {sql}")(lambda spark, sf: cells(blocks(spark, sf), f(F.col("x"))))


def near_sql(condition: str, expression: str) -> str:
    """Each value with its neighbours q inside the block."""
    return f"SELECT p.id, p.i, {expression} AS x FROM blk p JOIN blk q ON q.id = p.id AND {condition} GROUP BY p.id, p.i"


AROUND = "abs(q.c - p.c) <= 1 AND abs(q.y - p.y) <= 1"
of_block("shift", lambda p: filters.shift(p, 8, 8, 2), "SELECT a.id, a.i, coalesce(b.x, 16) AS x FROM blk a LEFT JOIN blk b ON b.id = a.id AND b.y = a.y AND b.c = a.c - 2")
of_block("shift_down", lambda p: filters.shift(p, 8, 8, -1, 3), "SELECT a.id, a.i, coalesce(b.x, 16) AS x FROM blk a LEFT JOIN blk b ON b.id = a.id AND b.y = a.y - 3 AND b.c = a.c + 1")
of_block("border", lambda p: filters.border(p, 8, 8, 1, 1, 6, 6), "SELECT id, i, CASE WHEN c BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 THEN x ELSE 16 END AS x FROM blk")
of_block("fill_area", lambda p: filters.fill_area(p, 8, 8, 2, 3, 4, 2, 77), "SELECT id, i, CASE WHEN c BETWEEN 2 AND 5 AND y BETWEEN 3 AND 4 THEN 77 ELSE x END AS x FROM blk")
of_block("darken", lambda p: filters.darken(p, 30), "SELECT id, i, greatest(16, 16 + CAST(trunc((x - 16) * (1 - 0.01::DOUBLE * 30)) AS BIGINT)) AS x FROM blk")
of_block("copy_area", lambda p: filters.copy_area(p, 8, 8, 4, 3, 2), "SELECT a.id, a.i, b.x FROM blk a JOIN blk b ON b.id = a.id AND b.c = a.c AND b.y = CASE WHEN a.y BETWEEN 4 AND 6 THEN (a.y - 4) % 2 + 2 ELSE a.y END")
of_block("average_area", lambda p: filters.average_area(p, 8, 8, 3), near_sql("q.c // 3 = p.c // 3 AND q.y // 3 = p.y // 3", "CAST(sum(q.x) AS BIGINT) // count(*)"))
of_block("mono", filters.mono, "SELECT id, i, 128 AS x FROM blk")
of_block("swap_fields", lambda p: filters.swap_fields(p, 8, 8), "SELECT a.id, a.i, b.x FROM blk a JOIN blk b ON b.id = a.id AND b.c = a.c AND b.y = CASE WHEN a.y % 2 = 1 THEN a.y - 1 ELSE a.y + 1 END")
of_block("field_top", lambda p: filters.field(p, 8, 8, False), "SELECT id, (y // 2) * 8 + c AS i, x FROM blk WHERE y % 2 = 0")
of_block("field_bottom", lambda p: filters.field(p, 8, 8, True), "SELECT id, (y // 2) * 8 + c AS i, x FROM blk WHERE y % 2 = 1")
of_block("outlier_clamp", lambda p: filters.clamp_outliers(p, 8, 8), near_sql(AROUND, "least(greatest(any_value(p.x), min(q.x) FILTER (q.i <> p.i)), max(q.x) FILTER (q.i <> p.i))"))
of_block("similar_mean", lambda p: filters.similar_mean(p, 8, 8, 24), near_sql("abs(q.c - p.c) <= 2 AND abs(q.y - p.y) <= 2", "(CAST(sum(greatest(0, 24 - abs(q.x - p.x)) * q.x) AS BIGINT) * 2 // CAST(sum(greatest(0, 24 - abs(q.x - p.x))) AS BIGINT) + 1) // 2"))
of_block("box_mean", lambda p: filters.box_mean(p, 8, 8, 1), near_sql(AROUND, "(CAST(sum(q.x) AS BIGINT) + count(*) // 2) // count(*)"))
of_block(
    "threshold_mean",
    lambda p: filters.threshold_mean(p, 8, 8, 1, 30),
    f"""SELECT p.id, p.i, CASE WHEN any_value(p.c) NOT BETWEEN 1 AND 6 OR any_value(p.y) NOT BETWEEN 1 AND 6 THEN any_value(p.x)
WHEN count(*) FILTER (abs(q.x - p.x) < 30) <= 3 THEN (CAST(sum(q.x) AS BIGINT) + 7 * any_value(p.x) + 8) // 16
ELSE any_value(p.x) + CAST(floor((2 * sum(q.x - p.x) FILTER (abs(q.x - p.x) < 30) + count(*) FILTER (abs(q.x - p.x) < 30)) / (2 * count(*) FILTER (abs(q.x - p.x) < 30))) AS BIGINT) END AS x
FROM blk p JOIN blk q ON q.id = p.id AND {AROUND} GROUP BY p.id, p.i""",
)
of_block(
    "diamond_blur",
    lambda p: filters.diamond_blur(p, 8, 8, 128),
    """, o(dx, dy, k) AS (SELECT d.dx, d.dy, CASE WHEN abs(d.dx) + abs(d.dy) = 0 THEN 4 WHEN abs(d.dx) + abs(d.dy) = 1 THEN 2 ELSE 1 END FROM (SELECT a.v - 2 AS dx, b.v - 2 AS dy FROM range(0, 5) a(v), range(0, 5) b(v)) d WHERE abs(d.dx) + abs(d.dy) <= 2)
SELECT p.id, p.i, (any_value(p.x) * 128 + CAST(sum(k * q.x) AS BIGINT) // 20 * 128) // 256 AS x FROM blk p, o JOIN blk q ON q.id = p.id AND q.c = least(greatest(p.c + dx, 0), 7) AND q.y = least(greatest(p.y + dy, 0), 7) GROUP BY p.id, p.i""",
)
of_block("area_average", lambda p: filters.area_average(p, 8, 8, 4, 2), "SELECT id, (y // 2) * 2 + c // 4 AS i, (CAST(sum(x) AS BIGINT) + 4) // 8 AS x FROM blk GROUP BY id, y // 2, c // 4")
of_block("supersample", lambda p: filters.supersample(p, 8, 8), """, o AS (SELECT s.v AS v, t.v AS u, s.v // 2 AS cy, t.v // 2 AS cx, least(greatest(s.v // 2 + CASE WHEN s.v % 2 = 0 THEN -1 ELSE 1 END, 0), 7) AS ny, least(greatest(t.v // 2 + CASE WHEN t.v % 2 = 0 THEN -1 ELSE 1 END, 0), 7) AS nx FROM range(0, 16) s(v), range(0, 16) t(v))
SELECT a.id, o.v * 16 + o.u AS i, (9 * a.x + 3 * b.x + 3 * d.x + e.x + 8) >> 4 AS x FROM o JOIN blk a ON a.y = cy AND a.c = cx JOIN blk b ON b.id = a.id AND b.y = cy AND b.c = nx JOIN blk d ON d.id = a.id AND d.y = ny AND d.c = cx JOIN blk e ON e.id = a.id AND e.y = ny AND e.c = nx""")
of_block("full_to_video", lambda p: F.transform(p, filters.full_to_video), "SELECT id, i, CAST(round(x * (CAST(219 AS DOUBLE) / 255) + 16) AS BIGINT) AS x FROM blk")
of_block("video_to_full", lambda p: F.transform(p, filters.video_to_full), "SELECT id, i, least(greatest(CAST(round((x - 16) * (CAST(255 AS DOUBLE) / 219)) AS BIGINT), 0), 255) AS x FROM blk")


def values(rows) -> str:
    return ", ".join("(" + ", ".join(f"{v!r}::DOUBLE" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)


def resample_sql(kernel: str) -> str:
    """8 x 8 to 12 x 6 as one weighted sum. A millionth decides nothing, so that sums of doubles in any order round alike."""
    x, y = (values((q, p, w) for q, row in enumerate(scalar.resample_weights(8, m, kernel)) for p, w in row) for m in (12, 6))
    return f""", h(q, p, k) AS (VALUES {x}), v(q, p, k) AS (VALUES {y})
SELECT blk.id, v.q * 12 + h.q AS i, CAST(least(greatest(floor(round(sum(blk.x * h.k * v.k), 6) + 0.5), 0), 255) AS BIGINT) AS x FROM blk JOIN h ON h.p = blk.c JOIN v ON v.p = blk.y GROUP BY blk.id, v.q, h.q"""


_G = scalar.gaussian_taps(1.0)
of_block(
    "unsharp",
    lambda p: filters.unsharp(p, 8, 8, 1.0, 1.5, 6),
    f""", t(d, k) AS (VALUES {values((d, _G[abs(d)]) for d in range(1 - len(_G), len(_G)))}),
m AS (SELECT p.id, p.i, any_value(p.x) AS x, round(any_value(p.x) - sum(q.x * a.k * b.k), 6) AS d FROM blk p, t a, t b JOIN blk q ON q.id = p.id AND q.c = least(greatest(p.c + a.d, 0), 7) AND q.y = least(greatest(p.y + b.d, 0), 7) GROUP BY p.id, p.i)
SELECT id, i, CASE WHEN abs(2 * d) < 6 THEN x ELSE CAST(least(greatest(floor(round(x + 1.5 * d, 6) + 0.5), 0), 255) AS BIGINT) END AS x FROM m""",
)
of_block(
    "low_pass",
    lambda p: filters.low_pass(p, 8, 8, 3, 0.5),
    f""", t(n, d, k) AS (VALUES {values((n, d, row[abs(d)]) for n, row in enumerate(scalar.fir_taps(3, 0.5)) for d in range(-n, n + 1))})
SELECT p.id, p.i, CAST(floor(round(least(greatest(sum(q.x * a.k * b.k), 0.0), 255.0), 6) + 0.5) AS BIGINT) AS x FROM blk p JOIN t a ON a.n = least(p.c, 7 - p.c, 3) JOIN t b ON b.n = least(p.y, 7 - p.y, 3) JOIN blk q ON q.id = p.id AND q.c = p.c + a.d AND q.y = p.y + b.d GROUP BY p.id, p.i""",
)
for _k in scalar.KERNELS:
    of_block(f"resample_{_k}", lambda p, k=_k: filters.resample(p, 8, 8, 12, 6, k), resample_sql(_k))
of_block("resample_linear_half", lambda p: filters.resample(p, 8, 8, 4, 8, "box"), "SELECT id, y * 4 + c // 2 AS i, CAST(floor(sum(x) * 0.5 + 0.5) AS BIGINT) AS x FROM blk GROUP BY id, y, c // 2")


@query("rgb_to_ycbcr", f"""WITH {BLK}, t AS (SELECT a.id, a.i, a.x AS r, b.x AS g, c.x AS b FROM blk a JOIN blk b ON b.id = a.id + 1 AND b.i = a.i JOIN blk c ON c.id = a.id + 2 AND c.i = a.i)
SELECT id, i, (CAST(round(0.299::DOUBLE * 219 / 255 * 262144 * r) AS BIGINT) + CAST(round(0.587::DOUBLE * 219 / 255 * 262144 * g) AS BIGINT) + CAST(round(0.114::DOUBLE * 219 / 255 * 262144 * b + 131072 + 16 * 262144) AS BIGINT)) >> 18 AS y,
(CAST(round(-0.168736::DOUBLE * 224 / 255 * 262144 * r) AS BIGINT) + CAST(round(-0.331264::DOUBLE * 224 / 255 * 262144 * g) AS BIGINT) + CAST(round(0.5::DOUBLE * 224 / 255 * 262144 * b + 131072 + 128 * 262144) AS BIGINT)) >> 18 AS cb,
(CAST(round(0.5::DOUBLE * 224 / 255 * 262144 * r) AS BIGINT) + CAST(round(-0.418688::DOUBLE * 224 / 255 * 262144 * g) AS BIGINT) + CAST(round(-0.081312::DOUBLE * 224 / 255 * 262144 * b + 131072 + 128 * 262144) AS BIGINT)) >> 18 AS cr FROM t""")
def rgb_to_ycbcr(spark, sf):
    d = neighbours(blocks(spark, sf), 2).select("id", F.posexplode(F.arrays_zip("x", "x1", "x2")).alias("i", "p"))
    return d.select("id", F.col("i").cast("long").alias("i"), filters.rgb_to_ycbcr(F.col("p.x"), F.col("p.x1"), F.col("p.x2")).alias("c")).select("id", "i", "c.*")


@query("ycbcr_to_rgb", f"""WITH {BLK}, t AS (SELECT a.id, a.i, least(greatest(a.x, 16), 235) - 16 AS y, least(greatest(b.x, 16), 240) - 128 AS u, least(greatest(c.x, 16), 240) - 128 AS v FROM blk a JOIN blk b ON b.id = a.id + 1 AND b.i = a.i JOIN blk c ON c.id = a.id + 2 AND c.i = a.i),
k AS (SELECT CAST(round(255::DOUBLE / 219 * 262144) AS BIGINT) AS ky, CAST(round(1.402::DOUBLE * (255::DOUBLE / 224 * 262144)) AS BIGINT) AS rv, CAST(round(0.344136::DOUBLE * (255::DOUBLE / 224 * 262144)) AS BIGINT) AS gu, CAST(round(0.714136::DOUBLE * (255::DOUBLE / 224 * 262144)) AS BIGINT) AS gv, CAST(round(1.772::DOUBLE * (255::DOUBLE / 224 * 262144)) AS BIGINT) AS bu)
SELECT id, i, least(greatest((y * ky + v * rv + 131072) >> 18, 0), 255) AS r, least(greatest((y * ky - u * gu - v * gv + 131072) >> 18, 0), 255) AS g, least(greatest((y * ky + u * bu + 131072) >> 18, 0), 255) AS b FROM t, k""")
def ycbcr_to_rgb(spark, sf):
    d = neighbours(blocks(spark, sf), 2).select("id", F.posexplode(F.arrays_zip("x", "x1", "x2")).alias("i", "p"))
    return d.select("id", F.col("i").cast("long").alias("i"), filters.ycbcr_to_rgb(F.col("p.x"), F.col("p.x1"), F.col("p.x2")).alias("c")).select("id", "i", "c.*")


@query("unpack_yuyv", f"WITH {BLK} SELECT id, CASE i % 4 WHEN 1 THEN 'u' WHEN 3 THEN 'v' ELSE 'y' END AS plane, CASE WHEN i % 2 = 0 THEN i // 2 ELSE i // 4 END AS i, x FROM blk")
def unpack_yuyv(spark, sf):
    d = blocks(spark, sf).select("id", filters.unpack_yuyv(F.col("x")).alias("p"))
    planes = F.explode(F.array(*[F.struct(F.lit(c).alias("plane"), F.col(f"p.{c}").alias("x")) for c in "yuv"])).alias("q")
    return d.select("id", planes).select("id", "q.plane", F.posexplode("q.x").alias("i", "x")).select("id", "plane", F.col("i").cast("long").alias("i"), "x")


# Coding. Doubles that meet a half to the last bit may round either way, so the SQL works at 1e-6 of the value first.

of_block("dct8", lambda p: coding.dct(F.transform(p, lambda v: v - 128)), """, k AS (SELECT u.v AS u, x.v AS x, sqrt(CASE WHEN u.v = 0 THEN 0.125 ELSE 0.25 END) * cos(pi() / 8 * u.v * (x.v + 0.5)) AS c FROM range(0, 8) u(v), range(0, 8) x(v))
SELECT id, v.u * 8 + h.u AS i, CAST(round(round(sum((x - 128) * h.c * v.c), 6)) AS BIGINT) AS x FROM blk JOIN k h ON h.x = blk.c JOIN k v ON v.x = blk.y GROUP BY id, v.u, h.u""".replace("SELECT id", "SELECT blk.id").replace("sum((x - 128)", "sum((blk.x - 128)").replace("GROUP BY id", "GROUP BY blk.id"))
DCT_K = "k AS (SELECT u.v AS u, x.v AS x, sqrt(CASE WHEN u.v = 0 THEN 0.125 ELSE 0.25 END) * cos(pi() / 8 * u.v * (x.v + 0.5)) AS c FROM range(0, 8) u(v), range(0, 8) x(v))"
of_block("idct8", lambda p: coding.idct(coding.dct(p)), f""", {DCT_K}, f AS MATERIALIZED (SELECT blk.id, v.u AS v, h.u AS u, CAST(round(round(sum(blk.x * h.c * v.c), 6)) AS BIGINT) AS x FROM blk JOIN k h ON h.x = blk.c JOIN k v ON v.x = blk.y GROUP BY blk.id, v.u, h.u)
SELECT f.id, v.x * 8 + h.x AS i, CAST(round(round(sum(f.x * h.c * v.c), 6)) AS BIGINT) AS x FROM f JOIN k h ON h.u = f.u JOIN k v ON v.u = f.v GROUP BY f.id, v.x, h.x""")
of_block("quantise_inter", lambda p: coding.quantise_inter(F.transform(p, lambda v: (v - 128) * 9), 5), "SELECT id, i, sign(x - 128) * least((abs((x - 128) * 9) * 16) // 80, 2047) AS x FROM blk")
of_block("dequantise_inter", lambda p: coding.dequantise_inter(F.transform(p, lambda v: v - 128), 5), """, d AS (SELECT id, i, sign(x - 128) * least(((abs(x - 128) * 2 + 1) * 80) // 32, 2047) AS x FROM blk), s AS (SELECT id, sum(x) AS s FROM d GROUP BY id)
SELECT id, i, CASE WHEN i = 63 AND s % 2 = 0 THEN xor(CAST(x AS BIGINT), 1) ELSE CAST(x AS BIGINT) END AS x FROM d JOIN s USING (id)""")
of_block("quantise_intra", lambda p: coding.quantise_intra(F.transform(p, lambda v: (v - 128) * 9), 6), f""", m(i, m) AS (VALUES {values(enumerate(coding.INTRA))}), d AS (SELECT id, i, (x - 128) * 9 AS v FROM blk)
SELECT id, i, CAST(sign(v) AS BIGINT) * CASE WHEN i = 0 THEN (abs(v) * 2 + 8) // 16 ELSE least((abs(v) * 32 + m * 6) // (m * 12), 2047) END AS x FROM d JOIN m USING (i)""")


def zigzag_sql(level: str) -> str:
    """Nonzero levels past the first along the zigzag, each with the zeros before it; `level` is made of blk's x."""
    return f"""WITH {BLK}, z(k, i) AS (VALUES {values(enumerate(coding.zigzag()))}), {level},
nz AS (SELECT id, k, x FROM q JOIN z USING (i) WHERE k > 0 AND x <> 0), rl AS (SELECT id, k - coalesce(lag(k) OVER (PARTITION BY id ORDER BY k), 0) - 1 AS run, x AS level FROM nz)"""


BITS_SQL = zigzag_sql(f"{DCT_K}, f AS MATERIALIZED (SELECT blk.id, v.u * 8 + h.u AS i, CAST(round(round(sum((blk.x - 128) * h.c * v.c), 6)) AS BIGINT) AS x FROM blk JOIN k h ON h.x = blk.c JOIN k v ON v.x = blk.y GROUP BY blk.id, v.u, h.u), q AS (SELECT id, i, CAST(sign(x) AS BIGINT) * least(abs(x) * 16 // 64, 2047) AS x FROM f)")


@query("coded_bits", f"""{BITS_SQL}, t(run, level, bits) AS (VALUES {values((r, k + 1, b) for r, row in enumerate(coding.CODE_BITS) for k, b in enumerate(row))}),
s AS (SELECT rl.id, coalesce(t.bits + 1, 24) AS bits FROM rl LEFT JOIN t ON t.run = rl.run AND t.level = abs(rl.level))
SELECT b.id, CAST(coalesce(sum(bits), 0) + 2 AS BIGINT) AS bits, count(bits) AS pairs FROM (SELECT DISTINCT id FROM blk) b LEFT JOIN s ON s.id = b.id GROUP BY b.id""")
def coded_bits(spark, sf):
    q = coding.quantise_inter(coding.dct(F.transform("x", lambda v: v - 128)), 4)
    return blocks(spark, sf).select("id", coding.coded_bits(q).alias("bits"), F.size(coding.run_levels(q)).cast("long").alias("pairs"))


@query("eliminate_singles", f"""{zigzag_sql("q AS (SELECT id, i, (x - 128) // 30 AS x FROM blk)")}, w AS (SELECT id, sum(CASE WHEN run = 0 THEN 3 WHEN run < 3 THEN 2 WHEN run < 24 THEN 1 ELSE 0 END) AS s, max(abs(level)) AS most FROM rl GROUP BY id),
o AS (SELECT q.id FROM q LEFT JOIN w ON w.id = q.id WHERE q.i = 0 AND q.x <= 1 AND coalesce(most, 0) <= 1 AND coalesce(s, 0) < 40)
SELECT q.id, q.i, CASE WHEN q.i > 0 AND o.id IS NOT NULL THEN 0 ELSE q.x END AS x FROM q LEFT JOIN o ON o.id = q.id""")
def eliminate_singles(spark, sf):
    return cells(blocks(spark, sf), coding.eliminate_singles(F.transform("x", lambda v: cdiv(v - 128, 30)), 40))


# Multiplexing.


@query("mux_order", "SELECT l_returnflag, l_orderkey, l_linenumber, l_linestatus, row_number() OVER w - 1 AS seq, CAST(sum(l_quantity) OVER w - l_quantity AS BIGINT) AS pos FROM lineitem WINDOW w AS (PARTITION BY l_linestatus, year(l_shipdate) ORDER BY l_shipdate, l_returnflag, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING)")
def mux_order(spark, sf):
    """A multiplex is the lines of one status and year."""
    d = table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_linestatus", "l_shipdate", "l_quantity", F.year("l_shipdate").alias("year"))
    return mux.deadline_order(d, ["l_linestatus", "year"], "l_shipdate", ["l_returnflag", "l_orderkey", "l_linenumber"], "l_quantity").select("l_returnflag", "l_orderkey", "l_linenumber", "l_linestatus", "seq", "pos")


@query("buffer_occupancy", """WITH e AS (SELECT l_returnflag AS flag, epoch(date_trunc('day', l_shipdate)) // 86400 AS day, l_quantity AS d FROM lineitem UNION ALL SELECT l_returnflag, epoch(date_trunc('day', l_shipdate)) // 86400 + 30, -l_quantity FROM lineitem),
m AS (SELECT flag, day, sum(d) AS d FROM e GROUP BY 1, 2) SELECT flag, CAST(day AS BIGINT) AS day, CAST(sum(d) OVER (PARTITION BY flag ORDER BY day) AS BIGINT) AS used FROM m""")
def buffer_occupancy(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date")).cast("long").alias("day"), "l_quantity")
    return mux.occupancy(d, "flag", F.col("day"), F.col("day") + 30, F.col("l_quantity")).withColumnRenamed("at", "day")


@query("late_units", "SELECT l_orderkey, l_linenumber, l_shipdate >= o_orderdate + INTERVAL 60 DAY AS late FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def late_units(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return mux.late_units(d, F.col("l_shipdate"), F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).select("l_orderkey", "l_linenumber", "late")


@query("segment_split", """WITH c AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) - l_quantity AS p FROM lineitem)
SELECT l_suppkey, CAST(p AS BIGINT) // 500 AS segment, min(l_orderkey) AS first, max(l_orderkey) AS last, CAST(sum(l_quantity) AS BIGINT) AS bytes FROM c GROUP BY 1, 2""")
def segment_split(spark, sf):
    s = mux.segments(table(spark, sf, "lineitem"), "l_suppkey", ["l_shipdate", "l_orderkey", "l_linenumber"], "l_quantity", 500)
    return s.groupBy("l_suppkey", "segment").agg(F.min("l_orderkey").alias("first"), F.max("l_orderkey").alias("last"), F.sum("l_quantity").cast("long").alias("bytes"))


DAYS = "d AS (SELECT l_suppkey, CAST(epoch(date_trunc('day', l_shipdate)) // 86400 AS BIGINT) AS a, CAST(epoch(date_trunc('day', l_shipdate)) // 86400 AS BIGINT) + 1 + l_linenumber AS z FROM lineitem)"


def days(spark, sf):
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date")).cast("long")
    return table(spark, sf, "lineitem").select("l_suppkey", day.alias("a"), (day + 1 + F.col("l_linenumber")).alias("z"))


@query("padding_gaps", f"""WITH {DAYS}, m AS (SELECT l_suppkey, max(z) OVER (PARTITION BY l_suppkey ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS e, lead(a) OVER (PARTITION BY l_suppkey ORDER BY a, z) AS nx FROM d)
SELECT l_suppkey, e AS a, nx AS z FROM m WHERE nx > e""")
def padding_gaps(spark, sf):
    return mux.padding(days(spark, sf), "l_suppkey", "a", "z")


@query("packetise", "WITH c AS (SELECT l_suppkey, l_orderkey, l_linenumber, CAST(sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e, CAST(l_quantity AS BIGINT) AS q FROM lineitem) SELECT l_orderkey, l_linenumber, (e - q) // 64 AS first_packet, (e - 1) // 64 AS last_packet, (e - q) % 64 AS packet_offset FROM c")
def packetise(spark, sf):
    return mux.packets(table(spark, sf, "lineitem"), "l_suppkey", ["l_shipdate", "l_orderkey", "l_linenumber"], "l_quantity", 64).select("l_orderkey", "l_linenumber", "first_packet", "last_packet", "packet_offset")


@query("align_streams", f"WITH {DAYS} SELECT l_suppkey, a, z, a - min(a) OVER (PARTITION BY l_suppkey) AS aligned FROM d")
def align_streams(spark, sf):
    return mux.align(days(spark, sf), "l_suppkey", "a")


@query("mux_schedule")
def mux_schedule(spark, sf):
    """Each supplier is a multiplex of its lines by return flag, with one buffer size."""
    line = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line")
    d = table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date")).cast("double").alias("dts"), "l_quantity", line)
    return mux.schedule(d, "l_suppkey", "l_returnflag", "dts", "l_quantity", 100.0, 80, "line")


@query("au_scan", """WITH p AS (SELECT doc_id, string_split(text, '. ') AS a FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, generate_subscripts(a, 1) AS k, unnest(a) AS s FROM p),
l AS (SELECT doc_id, k, length(s) + CASE WHEN k = 1 THEN 0 ELSE 2 END AS n FROM u), f AS (SELECT * FROM l WHERE n > 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS unit, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY k) - n AS BIGINT) AS start, n AS length FROM f""")
def au_scan(spark, sf):
    return mux.access_units(table(spark, sf, "documents"), "doc_id", "text", ". ")


@query("page_listings")
def page_listings(spark, sf):
    return containers.listings(table(spark, sf, "pages"), "page_id", "html")


# Regions, search, rate.


@query("region_union", f"""WITH {DAYS}, m AS (SELECT *, CASE WHEN a <= max(z) OVER (PARTITION BY l_suppkey ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS b FROM d),
k AS (SELECT *, sum(b) OVER (PARTITION BY l_suppkey ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT l_suppkey, min(a) AS a, max(z) AS z FROM k GROUP BY l_suppkey, g""")
def region_union(spark, sf):
    return regions.union(days(spark, sf), ["l_suppkey"], "a", "z")


def point_sql(condition: str) -> str:
    """Sets of days, point by point, from the definition."""
    return f"""WITH {DAYS}, a AS (SELECT DISTINCT l_suppkey // 2 AS k, unnest(range(a, z)) AS p FROM d WHERE l_suppkey % 2 = 0), b AS (SELECT DISTINCT l_suppkey // 2 AS k, unnest(range(a, z)) AS p FROM d WHERE l_suppkey % 2 = 1),
s AS (SELECT * FROM a WHERE {condition}), r AS (SELECT k, p, p - row_number() OVER (PARTITION BY k ORDER BY p) AS g FROM s) SELECT k, min(p) AS x0, max(p) + 1 AS x1 FROM r GROUP BY k, g"""


def two_regions(spark, sf):
    """The days of every supplier of an even number, and of the one after it."""
    d = days(spark, sf)
    side = lambda m: d.filter(F.col("l_suppkey") % 2 == m).select(cdiv(F.col("l_suppkey"), 2).alias("k"), F.col("a").alias("x0"), F.col("z").alias("x1"))
    return side(0), side(1)


@query("region_subtract", point_sql("NOT EXISTS (SELECT 1 FROM b WHERE b.k = a.k AND b.p = a.p)"))
def region_subtract(spark, sf):
    return regions.subtract(*two_regions(spark, sf), ["k"])


@query("region_intersect", point_sql("EXISTS (SELECT 1 FROM b WHERE b.k = a.k AND b.p = a.p)"))
def region_intersect(spark, sf):
    return regions.intersect(*two_regions(spark, sf), ["k"])


@query("best_match", f"""WITH {BLK}, o AS (SELECT a.v - 2 AS dx, b.v - 2 AS dy FROM range(0, 5) a(v), range(0, 5) b(v)),
s AS (SELECT p.id, dx, dy, least(CAST(sum(abs(p.x - q.x)) AS BIGINT), 65025) AS weight FROM blk p, o JOIN blk q ON q.id = p.id + 1 AND q.c = p.c + dx AND q.y = p.y + dy WHERE p.c BETWEEN 2 AND 5 AND p.y BETWEEN 2 AND 5 GROUP BY ALL)
SELECT id, weight, dx, dy FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY weight, dx, dy) = 1""")
def best_match(spark, sf):
    d = neighbours(blocks(spark, sf), 1)
    found = motion.candidates(motion.block_of(F.col("x"), 8, 2, 2, 4, 4), 4, 4, F.col("x1"), 8, 8, 2, 2, 2)
    return d.select("id", motion.best(found).alias("m")).select("id", "m.*")


@query("sub_mean", f"""WITH {BLK}, o AS (SELECT a.v - 2 AS dx, b.v - 2 AS dy FROM range(0, 5) a(v), range(0, 5) b(v)),
s AS (SELECT p.id, dx, dy, CAST(sum(abs(p.x - q.x)) AS BIGINT) AS weight FROM blk p, o JOIN blk q ON q.id = p.id + 1 AND q.c = p.c + dx AND q.y = p.y + dy WHERE p.c BETWEEN 2 AND 5 AND p.y BETWEEN 2 AND 5 GROUP BY ALL),
t AS (SELECT * FROM s QUALIFY weight <= CAST(sum(weight) OVER (PARTITION BY id) AS BIGINT) // count(*) OVER (PARTITION BY id)),
u AS (SELECT * FROM t QUALIFY count(*) OVER (PARTITION BY id) = 1 OR weight <= CAST(sum(weight) OVER (PARTITION BY id) AS BIGINT) // count(*) OVER (PARTITION BY id))
SELECT id, count(*) AS kept, CAST(sum(weight) AS BIGINT) // count(*) AS mean FROM u GROUP BY id""")
def sub_mean(spark, sf):
    d = neighbours(blocks(spark, sf), 1)
    d = d.withColumn("found", motion.candidates(motion.block_of(F.col("x"), 8, 2, 2, 4, 4), 4, 4, F.col("x1"), 8, 8, 2, 2, 2))
    kept, mean = motion.thinned(F.col("found"), 2)
    return d.select("id", F.size(kept).cast("long").alias("kept"), mean.alias("mean"))


@query("median_motion", f"WITH {BLK}, h AS (SELECT id, x - 128 AS m, count(*) AS n FROM blk GROUP BY 1, 2), c AS (SELECT id, m, sum(n) OVER (PARTITION BY id ORDER BY m) AS s, sum(n) OVER (PARTITION BY id) AS t FROM h) SELECT id, min(m) AS median FROM c WHERE 2 * s >= t GROUP BY id")
def median_motion(spark, sf):
    c = cells(blocks(spark, sf), F.transform("x", lambda v: v - 128))
    return motion.median_motion(c, ["id"], "x", range(-128, 128))


@query("bucket_sketch", """WITH e AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1),
b AS (SELECT event_type, least(CAST(floor(coalesce((value - lo) / nullif(hi - lo, 0) * 16, 0)) AS BIGINT), 15) AS bucket, value FROM events JOIN e USING (event_type))
SELECT event_type, bucket, count(*) AS samples, min(value) AS lo, max(value) AS hi, CAST(round(avg(value) * 10000) AS BIGINT) AS mean FROM b GROUP BY 1, 2""")
def bucket_sketch(spark, sf):
    return rate.sketch(table(spark, sf, "events"), "value", 16, "event_type").withColumn("mean", F.round(F.round(F.col("mean") * 10000, 6)).cast("long"))  # a millionth decides nothing


@query("rate_control")
def rate_control(spark, sf):
    """The control rate of the whole table's sketch, for a few targets."""
    s = rate.sketch(table(spark, sf, "events").filter("value > 0"), "value", 64)
    got = [(t, rate.control_rate(s, float(t), 0.6, 4000.0)) for t in (100, 500, 1000)]
    return spark.createDataFrame(got, "target int, control double")


from . import formats, more  # noqa: E402, F401  register their queries here
