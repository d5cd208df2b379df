"""Operators against hand-made cases and plain models."""

import io
import math
import random
import tarfile
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import scalar
from framewright.operators import coding, combine, filters, rate, regions, temporal, timeline
from framewright.sources import containers, frames, lists
from framewright.streaming import live


def plane(spark, x):
    return spark.createDataFrame([(1, [int(v) for v in x])], "id long, x array<bigint>")


def one(spark, x, f):
    return plane(spark, x).select(f(F.col("x")).alias("r")).first().r


def timeline_of(spark, letters):
    return spark.createDataFrame([(1, i, c) for i, c in enumerate(letters)], "k long, pos long, f string")


def spelled(df):
    return "".join(r.f for r in df.orderBy("pos").collect())


def test_edits(spark):
    t = timeline_of(spark, "ABCDEF")
    assert spelled(timeline.move(t, "pos", 1, 2, 5)) == "ADEBCF"
    assert spelled(timeline.move(t, "pos", 3, 4, 1)) == "ADEBCF" and spelled(timeline.move(t, "pos", 1, 3, 2)) == "ABCDEF"
    assert spelled(timeline.apply_edits(t, "k", "pos", ["eu 1 2", "ep 3"])) == "ADEBCF"
    assert spelled(timeline.paste(t, timeline.copy(t, "pos", 0, 1), "k", "pos", 9)) == "ABCDEFAB"
    assert spelled(timeline.paste(t, timeline.copy(t, "pos", 0, 1), "k", "pos", 9, append=False)) == "ABCDEF"
    assert spelled(timeline.duplicate(t, "pos", 1, 2, 1)) == "ABCBCDEF"
    m = timeline_of(spark, "xy")
    assert spelled(timeline.insert(t, m, "k", "pos", 2)) == "ABxyCDEF"
    assert spelled(timeline.insert(t, m, "k", "pos", 2, compat=True)) == "ABxyEFCD"
    with pytest.raises(ValueError):
        timeline.apply_edits(t, "k", "pos", ["zz 1"])


def test_runs(spark):
    rows = [(0, 5), (0, 6), (0, 7), (1, 0), (1, 1), (0, 9)]
    df = spark.createDataFrame([(1, i, f, n) for i, (f, n) in enumerate(rows)], "k long, pos long, file long, frame long")
    runs = timeline.compress(df, "k", "pos", "file", "frame")
    assert sorted((r.run, r.file, r.first_frame, r.last_frame) for r in runs.collect()) == [(0, 0, 5, 7), (1, 1, 0, 1), (2, 0, 9, 9)]
    assert sorted((r.file, r.frame_no) for r in timeline.expand(runs, "first_frame", "last_frame").collect()) == sorted(rows)
    e = spark.createDataFrame([(-2, 1), (3, 9), (5, 4)], "a long, z long")
    assert sorted(r.frame_no for r in timeline.expand(e, "a", "z", length=F.lit(5)).collect()) == [0, 1, 3, 4]
    assert sorted(r.frame_no for r in timeline.expand(e, "a", "z", length=F.lit(5), compat=True).collect()) == [0, 1, 3, 4, 5]


def test_plans(spark):
    clips = spark.createDataFrame([(0, 0, 10, 6), (1, 1, 0, 5)], "clip long, src int, first long, count long")
    plan = timeline.transitions(clips, 2)
    assert [(r.frame_count, [tuple(i) for i in r.inputs]) for r in plan.orderBy("seg_no").collect()] == [(4, [(0, 10)]), (2, [(0, 14), (1, 0)]), (3, [(1, 2)])]
    assert timeline.pipe_frames(plan).count() == 4 + 4 + 3
    text = lists.pipe_list_text("PAL", ["a $o", "b"], [(2, [(0, 1), (1, 0)], "mix"), (3, [(1, 2)], "-")])
    assert lists.parse_pipe_list(text) == ("p", ["a $o", "b"], [(2, [(0, 1), (1, 0)], "mix"), (3, [(1, 2)], "-")])
    assert lists.pipe_plan(spark, text).count() == 2


def test_edit_list_files(spark, tmp_path):
    t = spark.createDataFrame([("l", i, f, n) for i, (f, n) in enumerate([("b", 3), ("b", 4), ("a", 0), ("b", 5)])], "k string, pos long, file string, n long")
    text = lists.edit_list_text(t, "k", "pos", "file", "n").first().text
    assert text.splitlines()[1:] == ["PAL", "2", "a", "b", "1 3 4", "0 0 0", "1 5 5"]
    (tmp_path / "x.eli").write_text(text + ": a remark\n")
    got = lists.read_edit_list(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.file, r.frame_no) for r in got] == [("b", 3), ("b", 4), ("a", 0), ("b", 5)]
    for bad in ("x", "LAV Edit List\nX\n0\n", "LAV Edit List\nPAL\n1\na\n3 0 0\n"):
        with pytest.raises(ValueError):
            lists.parse_edit_list(bad)


def test_streams(spark, tmp_path):
    made = frames.constant_frames(spark, 3, 4, 2).selectExpr("'s' AS path", "frame_no", "string(null) AS tag", "4 AS width", "2 AS height", "'420jpeg' AS chroma", "y", "u", "v").withColumn("a", F.lit(None).cast("array<bigint>"))
    content = bytes(frames.write_stream(made).first().content)
    assert content.startswith(b"YUV4MPEG2 W4 H2 C420jpeg\nFRAME\n") and len(content) == len(b"YUV4MPEG2 W4 H2 C420jpeg\n") + 3 * (6 + 8 + 2 + 2)
    (tmp_path / "x.y4m").write_bytes(content)
    back = frames.read_streams(spark, str(tmp_path)).orderBy("frame_no").collect()
    assert [r.frame_no for r in back] == [0, 1, 2] and back[1].y == [16] * 8 and back[1].u == [128] * 2 and back[1].a is None
    for bad in (b"x", content[:-1], b"YUV4MPEG2 W0 H2\n"):
        with pytest.raises((ValueError, KeyError)):
            list(frames.scan_stream(bad)[1])
    heads = spark.createDataFrame([("YUV4MPEG2 W4 H2 F30000:1001 It Xa",), ("YUV4MPEG2 W4",), ("YUV4MPEG2 W4 H2 C444",), ("junk",)], "h string").select(frames.parse_header(F.col("h")).alias("p")).collect()
    assert [r.p.problem for r in heads] == [None, "width or height is missing", "needs the extended format", "no stream header"]
    assert tuple(heads[0].p.fps) == (30000, 1001) and heads[0].p.xtags == ["a"] and heads[0].p.chroma == "420jpeg"
    bars = frames.colour_bars(spark, 14, 12)
    assert bars.count() == 168 and bars.filter("row = 0 AND x < 2").select("r").distinct().collect()[0].r == 191


def test_containers(spark):
    bits = containers.BitReader(b"\xa5\x0f\0\0\1\xb3")
    assert bits.bits(4) == 10 and bits.peek(8) == 0x50 and bits.bits(8) == 0x50 and bits.seek(b"\0\0\1", 100) and bits.at == 16
    pic = lambda kind, ref: b"\0\0\1\0" + ((ref << 22) | (kind << 19)).to_bytes(4, "big") + b"abc"
    data = b"\0\0\1\xb3seq" + pic(1, 0) + pic(3, 1) + b"\0\0\1\xb7"
    units = list(containers.video_units(data))
    assert [(u[0], u[3], u[4], u[5], u[6]) for u in units] == [(0, "I", 0, True, False), (1, "B", 1, False, True)]
    assert sum(u[2] for u in units) == len(data)
    frame = bytes([0xFF, 0xFD, 0x80, 0]) + bytes(144000 * 160 // 44100 - 4)
    assert [u[1] for u in containers.audio_units(b"x" + frame * 2)] == [1, 1 + len(frame)]
    assert list(containers.fixed_units(10, 4)) == [(0, 0, 4), (1, 4, 4), (2, 8, 2)]
    img = containers.to_netpbm(2, 1, 3, [1, 2, 3, 4, 5, 6]) + containers.to_netpbm(2, 2, 1, [9, 8, 7, 6])
    assert [x[1:] for x in containers.netpbm(img)] == [(2, 1, 3, [1, 2, 3, 4, 5, 6]), (2, 2, 1, [9, 8, 7, 6])]
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as t:
        for n, b in (("a", b"xyz"), ("b", b"q" * 600)):
            i = tarfile.TarInfo(n)
            i.size = len(b)
            t.addfile(i, io.BytesIO(b))
    raw = out.getvalue()
    assert [(n, raw[o : o + s]) for n, o, s in containers.tar_index(raw)] == [("a", b"xyz"), ("b", b"q" * 600)]
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000), w.writeframes(b"1234" * 5)
    head = containers.wav_header(out.getvalue())
    assert (head["channels"], head["rate"], head["bits"], head["length"]) == (2, 8000, 16, 20)
    assert containers.markers(b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\2x") == [(0xE0, 2, 4), (0xDA, 8, 2)]
    assert containers.guide_rows("<h1>A</h1><a href=x>t &amp; u</a>") == [("A", "x", "t & u")] and containers.guide_rows(None) == []
    kinds = spark.createDataFrame([(bytearray(b"\0\0\1\xb3"),), (bytearray(b"\x0b\x77xx"),), (bytearray(b""),)], "b binary").select(containers.sniff(F.col("b")).alias("k")).collect()
    assert [r.k for r in kinds] == ["video", "ac3", "unknown"]
    n = spark.createDataFrame([("a_0012.jpg",), ("a_3.jpg",), ("x",)], "f string")
    assert tuple(containers.number_range(n, "f").first()) == (3, 12, 2)


def test_scalars(spark):
    d = spark.createDataFrame([(60000, 2002)], "n long, d long").select(scalar.ratio_reduce(F.col("n"), F.col("d")).alias("r")).first()
    assert tuple(d.r) == (30000, 1001)
    t = spark.createDataFrame([(1799,), (1800,), (17981,), (17982,), (107892,)], "f long").select(scalar.time_code_drop(F.col("f")).alias("c")).collect()
    assert [tuple(r.c) for r in t] == [(0, 0, 59, 29), (0, 1, 0, 2), (0, 9, 59, 29), (0, 10, 0, 0), (1, 0, 0, 0)]
    p = spark.createDataFrame([("1:02:03.4",), ("5",), ("x",)], "t string").select(scalar.parse_time_code(F.col("t"), 25).alias("n")).collect()
    assert [r.n for r in p] == [3723 * 25 + 4, 125, None]
    crc = spark.createDataFrame([([0x31, 0x32, 0x33],)], "b array<bigint>").select(scalar.crc16(F.col("b")).alias("c")).first().c
    want = 0xFFFF
    for b in b"123":
        want ^= b << 8
        for _ in range(8):
            want = (want << 1 ^ 0x8005) & 0xFFFF if want & 0x8000 else want << 1 & 0xFFFF
    assert crc == want
    for name in scalar.KERNELS:
        for row in scalar.resample_weights(8, 12, name) + scalar.resample_weights(8, 3, name):
            assert math.isclose(sum(v for _, v in row), 1)
    s = spark.createDataFrame([(0x1234, 0x12345678, 59)], "a long, b long, c long").select(scalar.swap16(F.col("a")), scalar.swap32(F.col("b")), scalar.to_bcd(F.col("c")), scalar.from_bcd(scalar.to_bcd(F.col("c")))).first()
    assert tuple(s) == (0x3412, 0x78563412, 0x59, 59)


def test_transforms(spark):
    x = np.random.default_rng(1).integers(-128, 128, 64)
    c = np.array([[math.sqrt(0.125 if u == 0 else 0.25) * math.cos(math.pi / 8 * u * (k + 0.5)) for k in range(8)] for u in range(8)])
    got = one(spark, x, coding.dct)
    assert np.abs(np.array(got) - (c @ x.reshape(8, 8) @ c.T).ravel()).max() <= 0.5001
    assert np.abs(np.array(one(spark, x, lambda p: coding.idct(coding.dct(p)))) - x).max() <= 2
    assert sorted(coding.zigzag()) == list(range(64)) and coding.zigzag()[:6] == [0, 1, 8, 16, 9, 2]
    block = [5] + [0] * 63
    block[8], block[2] = -3, 1
    assert [tuple(r) for r in one(spark, block, coding.run_levels)] == [(1, -3), (2, 1)]
    assert one(spark, [7, 1] + [0] * 62, lambda p: coding.eliminate_singles(p, 4)) == [7, 1] + [0] * 62  # a first coefficient over 1 keeps all
    assert one(spark, [1, 1] + [0] * 62, lambda p: coding.eliminate_singles(p, 4)) == [1] + [0] * 63
    assert one(spark, [1, 1] + [0] * 62, lambda p: coding.eliminate_singles(p, 3)) == [1, 1] + [0] * 62
    assert one(spark, [7, 2] + [0] * 62, lambda p: coding.eliminate_singles(p, 4)) == [7, 2] + [0] * 62


def test_smoothing(spark):
    flat = [50] * 64
    for f in (lambda p: filters.unsharp(p, 8, 8, 2.0, 1.0, 0), lambda p: filters.low_pass(p, 8, 8, 3, 0.5), lambda p: filters.diamond_blur(p, 8, 8, 256), lambda p: filters.similar_mean(p, 8, 8, 9)):
        assert one(spark, flat, f) == flat
    for k in scalar.KERNELS:
        assert one(spark, flat, lambda p, k=k: filters.resample(p, 8, 8, 5, 11, k)) == [50] * 55
    x = np.random.default_rng(2).integers(0, 256, 64)
    w = np.zeros((8, 4))
    for q, row in enumerate(scalar.resample_weights(8, 4, "cubic")):
        for p, v in row:
            w[p, q] += v
    want = np.clip(np.floor(x.reshape(8, 8) @ w + 0.5), 0, 255).astype(int).ravel().tolist()
    assert one(spark, x, lambda p: filters.resample(p, 8, 8, 4, 8, "cubic")) == want
    got = filters.map_planes(plane(spark, x), "x", lambda a: a[::-1], 8).first().x
    assert got == x.reshape(8, 8)[::-1].ravel().tolist()
    woven = plane(spark, x).select(filters.weave(filters.field(F.col("x"), 8, 8, False), filters.field(F.col("x"), 8, 8, True), 8, 8).alias("r")).first().r
    assert woven == x.tolist()
    packed = plane(spark, x).select(filters.unpack_yuyv(F.col("x")).alias("p")).select(filters.pack_yuyv(F.col("p.y"), F.col("p.u"), F.col("p.v")).alias("r")).first().r
    assert packed == x.tolist()


def test_temporal(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([3, -8, 20, 0, 7])], "k long, n long, v double")
    a = [tuple(r) for r in temporal.stabilise(df, "k", "n", "v").orderBy("n").collect()]
    assert a == [tuple(r) for r in temporal.stabilise_arrow(df, "k", "n", "v").orderBy("n").collect()]
    five = spark.createDataFrame([(1, i, str(i + 1)) for i in range(7)], "k long, n long, v string")
    assert [(r.top, r.bottom) for r in temporal.telecine_inverse(five, "k", "n", "v").orderBy("out_frame").collect()] == [("1", "1"), ("2", "2"), ("3", "4"), ("5", "5")]
    b = spark.createDataFrame([(i, i) for i in range(3)], "n long, v long")
    assert combine.interleave(df.select("n", "v"), b.withColumn("v", F.col("v").cast("double")), "n").count() == 6
    assert combine.interleave(df.select("n", "v"), b.withColumn("v", F.col("v").cast("double")), "n", compat=True).count() == 7


def test_regions(spark):
    ext = lambda rows: spark.createDataFrame(rows, "y long, x0 long, x1 long")
    as_set = lambda df: {(r.y, r.x0, r.x1) for r in df.collect()}
    assert as_set(regions.union(ext([(1, 1, 4), (1, 4, 5), (1, 9, 9)]), ["y"])) == {(1, 1, 5)}
    assert as_set(regions.subtract(ext([(1, 10, 20)]), ext([(1, 15, 17)]), ["y"])) == {(1, 10, 15), (1, 17, 20)}
    rng = random.Random(3)
    a, b = ([(rng.randint(0, 2), x, x + rng.randint(0, 6)) for x in (rng.randint(0, 40) for _ in range(25))] for _ in range(2))
    points = lambda rows: {(y, p) for y, s, e in rows for p in range(s, e)}
    for f, want in ((regions.subtract, points(a) - points(b)), (regions.intersect, points(a) & points(b))):
        assert points(as_set(f(ext(a), ext(b), ["y"]))) == want
    room = ext([(0, 0, 3), (1, 2, 6), (2, 5, 9), (2, 0, 2), (3, 20, 22)])
    assert as_set(regions.flood(room, ext([(0, 0, 1)]))) == {(0, 0, 3), (1, 2, 6), (2, 5, 9)}
    assert as_set(regions.free_gaps(ext([(0, 1, 3), (0, 2, 5), (0, 8, 9)]), ["y"], "x0", "x1")) == {(0, 5, 8)}


def test_rate(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 101)], "v double")
    s = rate.sketch(df, "v", 10)
    c = rate.control_rate(s, 40.0, 0.5, 1000.0)
    assert abs(rate.predicted_rate(s, c, 0.5, 1000.0) - 40) < 0.01 and rate.control_rate(s, 2000.0, 0.5, 1000.0) == math.inf
    assert rate.control_rate(s.limit(0), 1.0, 0.5, 1.0) == 0.0


def test_streaming_equals_batch(spark, tmp_path):
    rows = [(k, n, float((n * 7 + k) % 13), n + n // 4) for k in (1, 2) for n in range(20)]
    schema = "k long, n long, v double, seq long"
    src = tmp_path / "in"
    for i in range(4):
        spark.createDataFrame([r for r in rows if i * 5 <= r[1] < i * 5 + 5], schema).coalesce(1).write.mode("append").parquet(str(src))
    whole = spark.createDataFrame(rows, schema)

    # files come in any order here, so one trigger takes all of them
    q = live.lost_frames(live.read_frames(spark, str(src), schema, 100), "k", "seq").writeStream.format("memory").queryName("lost").option("checkpointLocation", str(tmp_path / "lost")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = sorted((r.k, r.seq, r.lost) for r in temporal.lost_frames(whole, "k", "n", "seq").collect())
    assert sorted(map(tuple, spark.table("lost").collect())) == want


def test_stream_tags(spark, tmp_path):
    content = b"YUV4MPEG2 W2 H1 Ib F30000:1001 A10:11 Cmono Xone X\nFRAME It12 Xlate\n\x10\xffFRAME\n\x00\x01"
    (tmp_path / "x.y4m").write_bytes(content)
    got = frames.read_streams(spark, str(tmp_path)).orderBy("frame_no").collect()
    assert [(r.interlace, r.fps, r.sar, r.xtags, r.tag, r.frame_xtags) for r in got] == [("b", "30000:1001", "10:11", ["one", ""], "t12", ["late"]), ("b", "30000:1001", "10:11", ["one", ""], None, [])]
    again = bytes(frames.write_stream(frames.read_streams(spark, str(tmp_path))).first().content)
    head, *rest = frames.scan_stream(again)
    assert head == (2, 1, "mono", "b", "30000:1001", "10:11", ["one", ""]) and [t for t, _ in rest[0]] == [["It12", "Xlate"], []]


def test_streams_keep_values_that_no_byte_holds(spark):
    rows = [("s", 0, None, 2, 1, "mono", [-5, 300], None), ("s", 1, None, 2, 1, "mono", [0, 255], ["own"])]
    made = spark.createDataFrame(rows, "path string, frame_no long, tag string, width int, height int, chroma string, y array<long>, frame_xtags array<string>")
    made = made.select("*", *[F.lit(None).cast("array<long>").alias(c) for c in "uva"])
    files = frames.write_stream(made)
    assert bytes(files.first().content) == b"YUV4MPEG2 W2 H1 Cmono\nFRAME XWIDE=0:0:-5,0:1:300\n\x00\xffFRAME Xown\n\x00\xff"
    got = frames.parse_streams(files).orderBy("frame_no").collect()
    assert [(r.y, r.frame_xtags) for r in got] == [([-5, 300], []), ([0, 255], ["own"])]
    with pytest.raises(ValueError):
        frames.widened(["XWIDE=0:2:9"], [b"ab"])


def test_raw_bytes_cut_no_value(spark):
    got = lambda x: bytes(one(spark, x, frames.raw_bytes))
    assert got([0, 15, 16, 255]) == b"\x00\x0f\x10\xff"
    assert got([7, -5, 7]) == b"\x07" + (2**64 - 5).to_bytes(8, "big") + b"\x07" and got([4097]) == b"\x10\x01"
    assert bytes(one(spark, [-1, 1], lambda p: frames.grey_image(p, 2, 1))) == b"P5\n2 1\n255\n" + b"\xff" * 8 + b"\x01"


def test_a_millionth_under_a_half_rounds_up(spark):
    """Exact results: 112.49999985 and 85.49999964."""
    x = [140, 137, 123, 165, 120, 134, 153, 86, 83, 185, 153, 99, 117, 113, 129, 125, 171, 132, 78, 109, 135, 102, 165, 159, 136, 93, 126, 133, 123, 78, 143, 159, 127, 103, 149, 126, 145, 141, 165, 127, 149, 117, 91, 98, 123, 130, 123, 113, 141, 121, 110, 116, 144, 124, 79, 126, 120, 123, 134, 115, 30, 125, 140, 169]
    assert one(spark, x, lambda p: filters.low_pass(p, 8, 8, 3, 0.5))[33] == 113
    x = [134, 136, 101, 121, 173, 138, 106, 136, 87, 127, 140, 145, 115, 144, 152, 108, 166, 135, 95, 151, 183, 143, 134, 99, 144, 140, 152, 179, 103, 157, 126, 139, 132, 59, 81, 143, 122, 135, 121, 87, 119, 164, 128, 136, 166, 133, 160, 104, 138, 137, 65, 130, 129, 101, 110, 124, 101, 81, 106, 143, 83, 147, 104, 133]
    assert one(spark, x, lambda p: filters.unsharp(p, 8, 8, 1.0, 1.5, 6))[12] == 86


def test_audio_frames_that_are_broken():
    ac3 = bytes.fromhex("0b77000041") + bytes(2 * 70 - 5)  # 44.1 kHz, an odd code
    assert list(containers.ac3_units(ac3 * 2 + ac3[:20])) == [(0, 0, 140, 44100), (1, 140, 140, 44100)]
    dts = bytes.fromhex("7ffe8001") + (((7 << 14) | 99) << 4).to_bytes(4, "big") + bytes(92)
    assert list(containers.dts_units(dts + dts[:50])) == [(0, 0, 100, 256)]
    for scan, data in ((containers.ac3_units, ac3 + b"12345678"), (containers.dts_units, dts + b"12345678")):
        with pytest.raises(ValueError):
            list(scan(data))
    assert not list(containers.ac3_units(b"")) and not list(containers.dts_units(b"")) and not list(containers.audio_units(b""))


def test_scan_payloads_of_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, bytearray(b""))], "k int, p binary")
    got = containers.scan_payloads(df, "k", "p", containers.audio_units, ["unit", "start", "length", "rate"])
    assert got.dtypes[0] == ("k", "int") and got.count() == 0


def test_append_entries(spark):
    from framewright.operators import guide

    kind = "s string, a long, z long, n long, t string"
    old = spark.createDataFrame([("x", 0, 10, 10, "news.."), ("x", 10, 20, 10, "late"), ("y", 0, 5, 5, "y")], kind)
    new = spark.createDataFrame([("x", 20, 30, 7, "more"), ("x", 20, 40, 9, "repeat"), ("x", 5, 10, 5, "stop is known"), ("y", 5, 8, 3, "y2"), ("z", 1, 2, 1, "..z"), ("z", 2, 3, 1, "q")], kind)
    got = sorted(tuple(r) for r in guide.append_entries(old, new, ["s"], "a", "z", "n", "t").collect())
    # old listings that touch stay apart; the new one extends the second
    assert got == [("x", 0, 10, 10, "news.."), ("x", 10, 30, 17, "late"), ("y", 0, 8, 8, "y"), ("z", 1, 3, 2, "..z")]
    cut = guide.append_entries(spark.createDataFrame([("x", 0, 1, 1, "a..")], kind), spark.createDataFrame([("x", 1, 2, 1, "b..x"), ("x", 2, 3, 1, "whole")], kind), ["s"], "a", "z", "n", "t")
    assert [tuple(r) for r in cut.collect()] == [("x", 0, 3, 3, "whole")]


def test_append_equal_entries(spark):
    from framewright.operators import guide

    new = spark.createDataFrame([("x", i // 2, i // 2 + 1, 1, "t") for i in range(400)], "s string, a long, z long, n long, t string")
    joined = guide.append_entries(new.limit(0), new, ["s"], "a", "z", "n", "t")
    # sorts that spill do not keep the order of equal rows
    conf, spill = spark._jvm.org.apache.spark.SparkEnv.get().conf(), "spark.shuffle.spill.numElementsForceSpillThreshold"
    conf.set(spill, "3")
    try:
        assert [tuple(r) for r in joined.collect()] == [("x", 0, 200, 200, "t")]
    finally:
        conf.remove(spill)


def test_place_and_cut(spark):
    x = range(6)  # 3 x 2
    assert one(spark, x, lambda p: filters.cut(p, 3, 2, 1, 0, 2, 2)) == [1, 2, 4, 5]
    assert one(spark, x, lambda p: filters.place(p, 3, 2, 2, 3, "BR", 9)) == [9, 9, 1, 2, 4, 5]
    assert one(spark, x, lambda p: filters.place(p, 3, 2, 2, 1, "CC")) == [0, 1]


# The extents of the reference's own check, half-open, all on one row.
BASE = [(1, 4), (5, 7), (10, 20)]
ADDED = [(4, 5), (15, 16), (6, 10), (8, 9), (6, 9), (9, 21), (9, 18), (10, 15), (25, 30)]
TAKEN = [(0, 2), (1, 2), (3, 5), (3, 6), (4, 6), (3, 12), (0, 12), (22, 25), (15, 17), (5, 7)]


def test_region_cases(spark):
    def rows(cases):
        return spark.createDataFrame([(k, a, z) for k, ext in enumerate(cases) for a, z in ext], "k int, x0 int, x1 int")

    def extents(points):
        return {(p, next(q for q in range(p, 99) if q not in points)) for p in points if p - 1 not in points}

    def got(df):
        out = {}
        for r in df.collect():
            out.setdefault(r.k, set()).add((r.x0, r.x1))
        return out

    base = {p for a, z in BASE for p in range(a, z)}
    both = got(regions.union(rows([[*BASE, e] for e in ADDED]), ["k"]))
    assert both == {k: extents(base | set(range(*e))) for k, e in enumerate(ADDED)}
    assert both[0] == {(1, 7), (10, 20)} and both[2] == {(1, 4), (5, 20)}  # touching extents are one
    left = got(regions.subtract(rows([BASE] * len(TAKEN)), rows([[e] for e in TAKEN]), ["k"]))
    assert left == {k: extents(base - set(range(*e))) for k, e in enumerate(TAKEN)}
    many = lambda ext: spark.createDataFrame(ext, "y int, x0 int, x1 int")
    a, b = [(0, 24, 26), (1, 24, 26)], [(y, *e) for y in (0, 1) for e in ((10, 12), (24, 26))]
    assert not regions.subtract(many(a), many(b), ["y"]).collect()


def test_nearest_sketch(spark):
    rng = random.Random(5)
    values = [rng.gauss(c, 0.2) for c in (0, 0, 0, 10, 50) for _ in range(40)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    got = rate.nearest_sketch(df, "v", 3, cells=64).orderBy("bucket").collect()
    assert [r.samples for r in got] == [120, 40, 40] and sum(r.mean * r.samples for r in got) == pytest.approx(sum(values))
    assert got[0].lo == min(values) and got[2].hi == max(values) and got[0].hi < got[1].lo
    few = rate.nearest_sketch(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v", 3).collect()
    assert [(r.bucket, r.samples, r.lo, r.hi) for r in few] == [(0, 2, 2.0, 2.0)]
    assert not rate.nearest_sketch(df.limit(0), "v", 3).collect()


def test_sketches_whatever_the_order_of_values(spark):
    """Means that lie on a half: sums of doubles as they come go under or over it."""
    values = [0.1, 0.2, 0.3, 0.7, 1e-9, 412.37, 0.01, 0.02]
    means = lambda d: [r.mean for r in d.orderBy("bucket").collect()]
    for xs in (values, values[::-1], sorted(values, reverse=True), sorted(values)):
        df = spark.createDataFrame([(v,) for v in xs], "v double").coalesce(1)
        assert means(rate.sketch(df, "v", 1)) == means(rate.nearest_sketch(df, "v", 1, cells=1)) == [413.700000001 / 8]
    odd = spark.createDataFrame([(1e300,), (2.0,), (None,)], "v double").coalesce(1)
    assert means(rate.sketch(odd, "v", 1)) == [5e299]
    assert means(rate.sketch(spark.createDataFrame([(None,)], "v double"), "v", 1)) == [None]


def test_means_on_a_half_round_up(spark, tmp_path):
    from framewright.plans import catalog

    spark.createDataFrame([("a", 589.46125), ("b", 2.00005)], "event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    for name in ("bucket_sketch", "nearest_buckets"):
        assert sorted((r.event_type, r["mean"]) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()) == [("a", 5894613), ("b", 20001)]


def test_deadline_order_of_ties(spark):
    from framewright.operators import mux

    units = [("m", 1, 7, 3.0), ("m", 1, 7, 5.0), ("m", 1, 6, 2.0), ("m", 2, 7, 4.0)]
    for rows in (units, units[::-1]):
        df = spark.createDataFrame(rows, "g string, due long, key long, size double").coalesce(1)
        got = mux.deadline_order(df, ["g"], "due", ["key"], "size").orderBy("seq").select("size", "pos").collect()
        assert [tuple(r) for r in got] == [(2.0, 0), (5.0, 2), (3.0, 7), (4.0, 10)]


def test_put_events_under_number_0_and_repeated_numbers(spark, tmp_path):
    from datetime import datetime

    from framewright.plans import catalog, more  # noqa: F401
    from tests.compare import connect, differ

    day = datetime(1997, 1, 15)
    rows = [(0, "2-HIGH"), (1, "1-URGENT"), (2, "3-MEDIUM"), (2, "1-URGENT"), (3, "2-HIGH"), (-3, "5-LOW"), (None, "1-URGENT"), (None, "5-LOW")]
    d = spark.createDataFrame([(k, 7, "F", 1.0, day, p) for k, p in rows], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")
    d.write.parquet(str(tmp_path / "orders.parquet"))
    con = connect(tmp_path)
    assert differ(spark, con, str(tmp_path), catalog.QUERIES["put_events"], catalog.ORACLES["put_events"]) is None
    assert catalog.QUERIES["put_events"](spark, str(tmp_path)).count() == len(rows) + 2


def test_schedule_of_ties(spark):
    from framewright.operators import mux

    units = [("m", "a", 5.0, 7, 30.0), ("m", "a", 5.0, 7, 60.0), ("m", "b", 5.0, 1, 50.0), ("m", None, 1.0, 1, 90.0), ("n", "a", 2.0, 1, 10.0)]
    for rows in (units, units[::-1]):
        df = spark.createDataFrame(rows, "g string, s string, dts double, n long, size double").coalesce(1)
        got = [tuple(r) for r in mux.schedule(df, "g", "s", "dts", "size", 10.0, 80, "n").collect()]
        assert [r for r in got if r[0] == "n"] == [("n", "a", 1, -6.0, False)]
        # the smaller of the two first; the larger waits until that has left the buffer
        assert [r for r in got if r[0] == "m"] == [("m", None, 1, -7.0, False), ("m", "a", 7, 2.0, False), ("m", "b", 1, 5.0, True), ("m", "a", 7, 10.0, True)]


def test_underruns_and_release(spark):
    from framewright.operators import mux

    turns = spark.createDataFrame([("a", t, t % 2 == 0) for t in range(60)] + [("b", 1, False)], "s string, t int, late boolean")
    got = mux.underruns(turns, "s", "t", F.col("late"), 5, 3).collect()
    assert [tuple(r) for r in got] == [("a", 4, 18)]  # 0, 6, 12 and the fourth at 18
    kinds = spark.createDataFrame([(1, i, c) for i, c in enumerate("IBBPBBPB")], "k int, n int, c string")
    out = temporal.released(kinds, "k", "n", F.col("c") != "B").orderBy("n").collect()
    assert [r.released for r in out] == [6, 6, 6, 7, 7, 7, 7, 7]
