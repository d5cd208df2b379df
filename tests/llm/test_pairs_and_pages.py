"""Near-duplicates and archives against plain forms."""

import hashlib
import random

import pytest

from framewright.llm import neardup, warc


def brute_components(docs, k):
    sets = {}
    for d, t in docs:
        ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        m = min(k, len(ws))
        sets[d] = {tuple(ws[i : i + m]) for i in range(len(ws) - m + 1)} if ws else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(d, len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("block", [512, 8])
def test_near_duplicates(spark, block):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(50)]
    docs = [(0, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one  TWO"), (5, "one two three"), (6, "x " * 3000)]
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 30)):
            w = [rng.choice(vocab) if rng.random() < rng.choice([0, 0.01, 0.03, 0.08]) else x for x in base]
            docs.append((len(docs), " ".join(w)))
    df = spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id long, text string, rep string")
    got = {tuple(r) for r in neardup.near_duplicates(df, 4, block=block).collect()}
    assert got == brute_components(docs, 4)


def test_near_duplicates_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "A b c d e")], "doc_id long, text string")
    got = sorted((tuple(r) for r in neardup.near_duplicates(df, 4).collect()), key=str)
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None)]
    assert neardup.near_duplicates(df.limit(0), 4).count() == 0
    assert sorted((r.doc_id for r in neardup.keep_one(df).collect()), key=str) == [1, None]


def test_other_texts_under_one_id_stay(spark):
    t = {c: " ".join(f"{c}{i}" for i in range(40)) for c in "abc"}
    rows = [(1, t["a"]), (1, t["b"]), (1, t["a"]), (2, t["b"] + " end"), (0, t["c"]), (9, t["c"] + " end"), (3, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in neardup.keep_one(df).collect()), key=str)
    assert got == sorted([(1, t["a"]), (1, t["b"]), (0, t["c"]), (3, None), (3, "")], key=str)


def test_odd_sketch_estimates():
    import numpy as np

    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    a, b = np.unique(pool[:900]), np.unique(pool[100:])  # 800 of 1000 shared
    odd = int(np.bitwise_count(neardup.odd_sketch(neardup.minhash(a)) ^ neardup.odd_sketch(neardup.minhash(b))).sum())
    assert odd <= neardup.most_odd_bits(80, 100)
    c = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    assert np.bitwise_count(neardup.odd_sketch(neardup.minhash(a)) ^ neardup.odd_sketch(neardup.minhash(np.unique(c)))).sum() > neardup.most_odd_bits(80, 100)


def test_warc_round_trip(spark):
    big = "é<p>\r\n\r\n0\r\n" * 20_000
    rows = [(1, "u", "x" * 1000, 1), (2, "u\r\nv", "x" * 1000, 1), (3, None, "x" * 999, 1), (4, "u", "x" * 999, 1), (5, "u", None, 1), (6, "u", "", 1), (7, "u", big, 1), (8, "u", big, 1), (9, "u", big + "!", 1), (2, "u\r\nv", "x" * 1000, 1), (None, "n", "x" * 1000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = sorted((tuple(r) for r in warc.read_archives(warc.write_archives(df), payloads=True).collect()), key=str)
    heads = {"x" * 1000: 2, big: 8}
    want = []
    for p, _, h, _ in rows:
        body = (h or "").encode()
        head = heads.get(h) if p is not None else None
        seen = head in (None, p)
        want.append((p, len(body), hashlib.sha1(body).hexdigest(), "response" if seen else "revisit", None if seen else head, bytearray(body) if seen else None))
    assert got == sorted(want, key=str)
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_warc_refuses_broken_segments(spark):
    recs = list(warc.records(1, "u", b"y" * 100_000, "00" * 20, None, "0"))
    assert len(recs) > 3
    bad = spark.createDataFrame([("a", b"".join(recs[:-1]))], "archive string, content binary")
    with pytest.raises(Exception, match="missing, repeated or short"):
        warc.read_archives(bad).collect()
    assert warc.dechunked(b"3;x=1\r\nabc\r\n0\r\nT: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")
