"""Substring operators against counts of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from framewright.llm import bytedup, recompress, repeats


def brute(seqs, width):
    seen = Counter(tuple(s[i : i + width]) for s in seqs for i in range(len(s) - width + 1))
    masks = []
    for s in seqs:
        m = [False] * len(s)
        for i in range(len(s) - width + 1):
            if seen[tuple(s[i : i + width])] > 1:
                m[i : i + width] = [True] * width
        masks.append(m)
    return masks


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["é,"]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    passages = [text(rng.randint(30, 90)) for _ in range(5)] + [["z"] * 80, ["x", "y"] * 50]
    docs = [None, "", " ", " ".join(passages[0])]
    for _ in range(50):
        d = text(rng.randint(0, 100))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 20)
            d += p[a : a + rng.randint(20, 90)] + text(rng.randint(0, 30))
        docs.append(" ".join(d))
    docs += [docs[7], docs[9] + " tail", "q\n\t" + docs[11], docs[7]]
    return docs


@pytest.mark.parametrize("group", [2048, 1])
def test_words(spark, group, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", group)
    docs = corpus(3)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, doc int")
    seqs = [(t or "").split() for t in docs]
    want = {}
    for i, (s, m) in enumerate(zip(seqs, brute(seqs, 35))):
        kept = [w for w, x in zip(s, m) if not x]
        want[i] = (len(s), sum(m), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in recompress.digest(df).collect()} == want
    assert recompress.digest(df.limit(0)).count() == 0


@pytest.mark.parametrize("group", [2048, 1])
def test_bytes(spark, group, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", group)
    docs = corpus(4)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, runs int")
    seqs = [(t or "").encode() for t in docs]
    want = {}
    for i, (s, m) in enumerate(zip(seqs, brute(seqs, 200))):
        kept = bytes(b for b, x in zip(s, m) if not x)
        want[i] = (len(s), sum(m), sum(x and not y for x, y in zip(m, [False, *m])), hashlib.sha256(kept).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in bytedup.digest(df).collect()} == want


def test_interior_symbols_are_local():
    """A symbol whose range lies inside a window is named alike wherever the window stands."""
    rng = np.random.default_rng(0)
    for _ in range(30):
        core = rng.integers(0, 4, 60).astype(np.uint64)
        found = []
        for _ in range(2):
            left, right = rng.integers(0, 4, rng.integers(0, 20)).astype(np.uint64), rng.integers(0, 4, rng.integers(0, 20)).astype(np.uint64)
            s = np.concatenate([left, core, right])
            lo = np.arange(len(s))
            args = (s, lo, lo + 1, np.zeros(len(s), np.int64))
            for _ in range(recompress.ROUNDS):
                args = recompress.rename(*args)
            a = len(left)
            found.append({(int(x), int(l) - a, int(h) - a) for x, l, h, _ in zip(*args) if l >= a and h <= a + 60})
        assert found[0] == found[1]


def test_same_id_other_text(spark):
    t = " ".join(f"a{i}" for i in range(40))
    df = spark.createDataFrame([(1, t), (1, "b"), (None, t + " c")], "doc_id long, text string")
    assert sorted(r.n_removed for r in recompress.digest(df).collect()) == [0, 40, 40]


@pytest.mark.parametrize("n_docs", [1, 7, 300])
def test_suffix_order(n_docs):
    """The column-wise construction against sorted suffixes; 300 texts need counters of more than a byte."""
    rng = np.random.default_rng(n_docs)
    texts = [rng.integers(97, 99 + i % 3, rng.integers(1, 40)).astype(np.uint8) for i in range(n_docs)] + [np.full(30, 97, np.uint8)] * 2
    starts, common = bytedup.suffix_order(texts)
    base = np.cumsum([0] + [len(t) + 1 for t in texts])
    suffix = {int(base[d]) + j: t.tobytes()[j:] for d, t in enumerate(texts) for j in range(len(t) + 1)}
    got = [suffix[int(s)] for s in starts]
    assert sorted(starts.tolist()) == sorted(suffix) and got == sorted(got)
    for a, b, c in zip(got, got[1:], common[1:].tolist()):
        assert c == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_more_parts_than_the_session(spark, monkeypatch):
    """Parts follow the bytes of the texts; results do not depend on them."""
    docs = corpus(5)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    want = sorted(map(tuple, recompress.digest(df).collect()))
    monkeypatch.setattr(repeats, "PART_BYTES", 2000)
    assert sorted(map(tuple, recompress.digest(df).collect())) == want
