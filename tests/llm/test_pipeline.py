"""The corpus pipeline and query functions without SQL, on a small folder of planted cases."""

import hashlib
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from framewright.llm import queries
from tests.llm.test_pairs_and_pages import brute_components
from tests.llm.test_row_ops import brute_hits
from tests.llm.test_substrings import brute

RNG = random.Random(11)


def text(n):
    return " ".join("".join(RNG.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(n))


CLEAN = [(i, text(60)) for i in range(90)]
TOXIC = [(100 + i, f"{text(8)} zorgle {text(2)}") for i in range(90)] + [(300, f"{text(8)} “zorgle”… {text(2)}"), (301, f"{text(8)}—Z0rgle— {text(2)}")]
NEAR, SAME, PASSAGE, LEAKS = text(60), (text(40), text(40)), text(40), (text(12), text(12))
AROUND = [(text(100), text(100)) for _ in range(4)]
ODD = [(800, None), (801, ""), (None, text(30))]
BEFORE = CLEAN + TOXIC + ODD + [(500, NEAR), (501, NEAR + " end"), (502, SAME[0]), (502, SAME[1])]
BEFORE += [(600 + i, f"{a} {x} {z}") for i, ((a, z), x) in enumerate(zip(AROUND, (PASSAGE, PASSAGE, *LEAKS)))]
AFTER = CLEAN + ODD + [(500, NEAR), (502, SAME[0]), (502, SAME[1])] + [(600 + i, f"{a} {z}") for i, (a, z) in enumerate(AROUND)]
ITEMS = [(1, LEAKS[0]), (None, LEAKS[1]), (2, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("planted"))
    docs = [(i, t, "en", "s", None if t is None else len(t)) for i, t in BEFORE]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in CLEAN] + [(i, 0, 1) for i, _ in TOXIC[:90]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def packed(docs):
    tok = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    ids = [(d, tok.encode(t or "", add_special_tokens=False).ids + [0]) for d, t in docs]
    return Counter((d, 0, 0, len(x), zlib.crc32(b"".join(v.to_bytes(4, "little") for v in x))) for d, x in ids)


def pieces(df):
    return Counter(tuple(r) for r in df.select("doc_id", "piece", "start", "length", "ids_crc32").collect())


def test_run(spark, folder):
    assert pieces(corpus_pipeline.run(spark, folder)) == packed(AFTER)


def test_op9(spark, folder):
    assert pieces(queries.op9_best_fit_packing(spark, folder)) == packed(BEFORE)


def test_op2(spark, folder):
    got = {tuple(r) for r in queries.op2_near_duplicates(spark, folder).collect() if r.doc_id not in (502, None)}
    assert got == {(d, n, c, d == c) for d, n, c in brute_components([x for x in BEFORE if x[0] not in (502, None)], 4)}


def test_op5(spark, folder):
    seqs = [(t or "").split() for _, t in BEFORE]
    kept = [[w for w, x in zip(s, m) if not x] for s, m in zip(seqs, brute(seqs, 35))]
    want = Counter((d, len(s), len(s) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for (d, _), s, k in zip(BEFORE, seqs, kept))
    assert Counter(tuple(r) for r in queries.op5_substring_dedup(spark, folder).collect()) == want


def test_op8(spark, folder):
    got = Counter((r.doc_id, r.predicted) for r in queries.op8_toxicity(spark, folder).collect())
    toxic = {i for i, _ in TOXIC}
    assert got == Counter((i, int(i in toxic)) for i, _ in BEFORE)


def test_op10(spark, folder):
    want = Counter()
    for d, t in BEFORE:
        n, hit, _, _ = brute_hits(t, ITEMS)
        want[d, n, hit, *brute_hits(t, [x for x in ITEMS if x[0] is not None])[2:], hit > 0] += 1
    assert Counter(tuple(r) for r in queries.op10_decontaminate(spark, folder).collect()) == want


def test_op3(spark, folder):
    """One language is learnt, so every text has it and what has no text has none."""
    got = Counter((r.doc_id, r.held_out, r.lang_pred) for r in queries.op3_language_id(spark, folder).collect())
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    assert got == Counter((i, held(i), "en" if t else "und") for i, t in BEFORE)


def test_op4(spark, folder):
    want = Counter()
    for (d, _, _, n, _), times in packed(BEFORE).items():
        want[d, n - 1] += times
    got = queries.op4_token_counts(spark, folder).collect()
    assert Counter((r[0], r[2]) for r in got) == want
    assert Counter((r[0], r[1]) for r in got) == Counter((d, len((t or "").encode())) for d, t in BEFORE)


def test_op6(spark, folder):
    want = Counter()
    for (d, _), s, m in zip(BEFORE, seqs := [(t or "").encode() for _, t in BEFORE], brute(seqs, 200)):
        kept = bytes(b for b, x in zip(s, m) if not x)
        want[d, len(s), sum(m), sum(x and not y for x, y in zip(m, [False, *m])), hashlib.sha256(kept).hexdigest()] += 1
    assert Counter(tuple(r) for r in queries.op6_byte_dedup(spark, folder).collect()) == want
