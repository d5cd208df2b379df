"""Operators that look at a document at a time, against plain forms and on odd inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framewright.llm.common import shared_dir
from framewright.llm import bpe_count, decontaminate, langid, packing, topk, toxicity

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a", "  two  spaces \n\n x\t", "I'm don't we'll <|endoftext|> b", "naïve ½ ② Ωmega 12345 \x1c \x85", "zz " * 5000, "same", "same", "🙂🙂"]


def odd_docs(spark):
    rows = [(i, t, "en", "s", "clash") for i, t in enumerate(ODD)]
    rows.append(rows[-1])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words string")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(VOCAB)


def test_token_counts(spark, sf, tok):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(odd_docs(spark).select(F.col("doc_id") + 10**6, "text"))
    want = Counter()
    for r in docs.collect():
        t = r.text or ""
        n = len(tok.encode(t, add_special_tokens=False).ids)
        want[(r[0], len(t.encode()), n, n > 1024)] += 1
    assert Counter(tuple(r) for r in bpe_count.token_counts(docs.toDF("doc_id", "text"), VOCAB).collect()) == want
    assert bpe_count.token_counts(odd_docs(spark).limit(0), VOCAB).count() == 0


def test_packing(spark, sf, tok):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(odd_docs(spark).select(F.col("doc_id") + 10**6, "text")).toDF("doc_id", "text")
    rows = packing.pack_documents(docs, VOCAB).collect()
    ids = {r.doc_id: tok.encode(r.text or "", add_special_tokens=False).ids + [0] for r in docs.collect()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        want = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(want) and 1 <= r.length <= 2048
    copies = Counter(r.doc_id for r in docs.collect())
    for d, ps in by_doc.items():
        assert sum(p.length for p in ps) == len(ids[d]) * copies[d]
        if copies[d] == 1:
            ps.sort(key=lambda p: p.piece)
            assert [p.piece for p in ps] == list(range(len(ps))) and all(p.length == 2048 for p in ps[1:])
            assert len(ps) == -(-len(ids[d]) // 2048)
    for ps in by_seq.values():
        ps.sort(key=lambda p: p.offset)
        at = 0
        for p in ps:
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert len(by_seq) <= -(-sum(r.length for r in rows) // 2048) + 1
    assert packing.pack_documents(docs.limit(0), VOCAB).count() == 0


def best_fit_decreasing(lengths, size):
    gaps, out = [], 0
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            out += 1
            fit = size
        else:
            gaps.remove(fit)
        gaps.append(fit - n)
    return out


@pytest.mark.parametrize("ranges", [1, 7])
def test_packing_rounds(spark, monkeypatch, ranges):
    rng = np.random.default_rng(3)
    lengths = [min(64, max(1, int(x))) for x in rng.lognormal(2.5, 1, 1500)] + [64] * 20 + [33] * 5 + [2] * 900
    rows = [(i, 0, 0, n, 0, i * 7) for i, n in enumerate(lengths)]
    monkeypatch.setattr(packing, "ITEMS_A_RANGE", -(-len(rows) // ranges))
    sent = []
    monkeypatch.setattr(packing, "one_round", lambda items, *a, f=packing.one_round: sent.append(1) or f(items, *a))
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, uid long"), 64).collect()
    assert sorted((r.doc_id, r.length) for r in got) == list(enumerate(lengths))
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for ps in by.values():
        at = 0
        for o, n in sorted(ps):
            assert o == at
            at += n
        assert at <= 64
    assert len(by) <= best_fit_decreasing(lengths, 64) + ranges - 1
    assert len(sent) <= 8  # each round is a Spark job over all that waits


def test_sweep_takes_the_successor():
    placed, gaps, left, least = packing.sweep([(10, 0, "a"), (10, 1, 1), (9, 0, "b"), (7, 0, "c"), (7, 1, 2), (5, 1, 3), (5, 1, 4), (3, 1, 5)], 12)
    assert placed == [(1, "a", 2), (2, "c", 5), (3, "b", 3), (5, "b", 8)] and gaps == [("b", 1)] and left == [(4, 5)] and least == 3


def test_leftovers_meet_by_rank():
    assert packing.meet([(0, 3, 9, 0, 0), (1, 1, 8, 2, 8), (2, 0, 0, 5, 7)]) == [(1, 0, 2, 0, 2, 1), (2, 0, 1, 1, 0, 1), (2, 1, 2, 0, 0, 1)]
    assert packing.meet([(0, 3, 9, 0, 0), (1, 0, 0, 9, 4)]) == [(1, 0, 6, 0, 2, 2)]
    assert packing.meet([(0, 3, 9, 0, 0), (1, 0, 0, 3, 4), (2, 0, 0, 4, 1)]) == [(1, 0, 3, 0, 2, 2), (2, 0, 4, 0, 0, 9)]


def test_ranges_hold_whole_sizes_or_parts_of_one():
    got = packing.ranges({(9, 0): 2, (9, 1): 3, (5, 1): 25, (4, 0): 1, (4, 1): 4, (3, 1): 6}, 10)
    assert got == [(9, 0, 0, 1), (9, 1, 0, 1), (5, 1, 1, 3), (4, 0, 4, 1), (4, 1, 4, 1), (3, 1, 5, 1)]


def brute_hits(text, items):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: find.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    ws, hit, of = low(text), set(), set()
    for name, t in items:
        iw = low(t)
        n = min(10, len(iw))
        for i in range(len(iw) - n + 1 if n else 0):
            for j in range(len(ws) - n + 1):
                if ws[j : j + n] == iw[i : i + n]:
                    hit |= set(range(j, j + n))
                    of.add(str(name))
    return len(ws), len(hit), len(of), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest()


def test_decontaminate(spark):
    rng = np.random.default_rng(1)
    w = lambda n, k=4: " ".join(np.array(["Aa", "b", "c", "É", "é"])[rng.integers(0, k + 1, n)])
    items = [(i, w(n)) for i, n in enumerate([12, 15, 30, 3, 7, 10, 11])] + [(7, None), (8, "..."), (9, "b c b c")]
    items.append((10, items[0][1]))
    docs = [(i, w(int(n))) for i, n in enumerate(rng.integers(0, 60, 40))] + [(98, None), (99, ""), (100, "x " + items[2][1].replace(" ", "--") + "!")]
    ddf = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, hits string")
    idf = spark.createDataFrame(items, "item_id long, text string")
    for limit in (10**6, 10):
        marked = decontaminate.mark(ddf, decontaminate.automata(idf, max_words=limit)).select("doc_id", "n_words", decontaminate.n_hit().alias("h"), F.size("items"), F.sha2(F.array_join("items", ","), 256))
        got = {r[0]: tuple(r)[1:] for r in marked.collect()}
        assert got == {i: brute_hits(t, items) for i, t in docs}
    assert decontaminate.mark(ddf, decontaminate.automata(idf.limit(0))).filter("size(hits) > 0").count() == 0
    out = {r.doc_id: r for r in decontaminate.clean(ddf, idf).collect()}
    assert out[98].text is None and out[99].text == "" and out[100].text == "x " and out[100].hits == "clash"


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(v) for v in rng.normal(0, 0.2, 8)]) for i in range(300)]
    rows += [(int(i), rows[5][1]) for i in range(300, 420)] + [(420, None), (440, [1.0, None] * 4), (460, [float("nan")] * 8), (480, [float("inf")] * 8), (500, [0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = topk.quantised(df)
    vs = {r.id: r.v for r in v.collect()}
    assert not {420, 440, 460, 480} & set(vs) and 500 in vs
    got = defaultdict(list)
    for r in topk.top_k(v, v.filter("id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = {}
    for q in vs:
        if q % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(vs[q], vs[c])), c) for c in vs if c != q)
            want[q] = [(c, -x) for x, c in s[:20]]
    assert got == want
    few = v.filter("id < 5")
    assert topk.top_k(few, few.filter("id % 20 = 0"), 20).count() == 4
    assert topk.top_k(v.limit(0), v.limit(0), 20).count() == 0


def test_top_k_bounds_hold_the_score():
    rng = np.random.default_rng(4)
    x = rng.integers(-10, 10, (4000, 4)).astype(float)
    q = np.array([[5.0, 1, 0, 0], [-3, 0, 2, -1]])
    order = np.argsort(x, axis=0, kind="stable")
    for depth in (1, 1000, 4000):
        lo, up = topk.bounds(q, x, topk.marks(x, order, depth))
        assert (lo <= q @ x.T).all() and (q @ x.T <= up).all()


def test_top_k_stops_early(monkeypatch):
    """A few large components decide: lists are read to a small depth, and only a few candidates are resolved."""
    rng = np.random.default_rng(6)
    x = rng.integers(-2, 3, (4000, 8)).astype(float)
    x[rng.permutation(4000)[:40], 0] += 500
    depths = []
    monkeypatch.setattr(topk, "marks", lambda x, order, depth, f=topk.marks: depths.append(depth) or f(x, order, depth))
    q = np.array([[5.0, 1, 0, 0, 1, 0, 0, 0]])
    live, cols, opened = topk.read(np.array([-1]), q, x, {}, 20, np.array([-np.inf]))
    assert opened.sum() <= 40 and len(cols) <= 40 and depths[0] == 250
    found = list(topk.search(np.array([-1]), q.astype(int), np.arange(4000), x.astype(int), 20, np.array([-np.inf])))
    assert [int(s) for _, _, ss in found for s in ss] == sorted((q @ x.T)[0].astype(int).tolist(), reverse=True)[:20]
    above = float(sorted((q @ x.T)[0])[-1]) + 1
    assert not len(topk.read(np.array([-1]), q, x, {}, 20, np.array([above]))[0])  # no outsider can reach a higher floor


def test_top_k_odd_vectors(spark):
    """Empty vectors are zeros, a repeated query id is asked once, extra columns are ignored."""
    df = spark.createDataFrame([(0, [], 1), (20, [1.0], 2), (20, [0.5], 3), (1, [1.0, 1.0], 4), (2, [-1.0], 5)], "vec_id long, embedding array<float>, rank int")
    v = topk.quantised(df)
    got = sorted(tuple(r) for r in topk.top_k(v, v.filter("id % 20 = 0"), 3).collect())
    assert got == [(0, 1, 1, 0), (0, 2, 2, 0), (0, 3, 20, 0), (20, 1, 1, 2048), (20, 2, 0, 0), (20, 3, 2, -2048)]


def test_new_columns_take_the_place_of_old_ones(spark):
    df = spark.createDataFrame([(1, "a text", "x")], "doc_id long, text string, __text string")
    assert toxicity.score(df, toxicity.Lexicon({"text ": 5.0}, (), (0, 1, 0))).columns == [*df.columns, "toxicity"]
    assert langid.predict(df, langid.fit(df.selectExpr("doc_id", "text", "'en' AS lang"))).first().lang_pred == "en"
    assert decontaminate.mark(df, decontaminate.automata(df.selectExpr("doc_id AS item_id", "text"))).first().hits == [0, 2]
    old = df.withColumnRenamed("__text", "score")
    assert toxicity.score(old, toxicity.Lexicon({}), out="score").first().score == 0
    assert langid.predict(old, langid.fit(df.limit(0).selectExpr("doc_id", "text", "'en' AS lang"))).columns == ["doc_id", "text", "lang_pred", "score"]
    assert decontaminate.mark(old, decontaminate.automata(df.selectExpr("doc_id AS item_id", "text")), names=("score", "hits", "items")).first().score == 2


def test_no_folder_of_a_machine_on_a_cluster():
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://somewhere:7077"})

    with pytest.raises(ValueError):
        shared_dir(Session)


def test_language_scores_by_hand(spark, sf):
    """Batches of many texts against one sum for each text, n-gram by n-gram."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    langs, m = langid.fit(docs)
    texts = [r.text for r in docs.filter("text IS NOT NULL").limit(40).collect()] + ["x", "", "é ü"]
    for t, got in zip(texts, langid.scores(m, texts)):
        want = m[langid.SLOTS].astype(float) + sum((m[int(i)].astype(float) for part in langid.grams(t) for i in part), np.zeros(len(langs)))
        assert np.allclose(got, want)
    n = {r.lang: r.n for r in docs.filter("lang IS NOT NULL AND text IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert np.allclose(np.exp(m[langid.SLOTS]), [(n[g] + 0.5) / sum(c + 0.5 for c in n.values()) for g in langs], atol=1e-6)


def test_toxicity_scores_by_hand(spark, sf):
    """The automaton against every term at every word of the folded text."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    lex = toxicity.fit_tables(docs, labels)
    for t in [r.text for r in docs.collect()] + ["", None]:
        ws, weight = toxicity.words(t), 0.0
        line = " " + " ".join(ws) + " "
        spared = {i for e in lex.exceptions for i in range(len(line)) if line.startswith(f" {e} ", i)}
        starts = [i for i, c in enumerate(line) if c == " "][:-1]
        for i in starts:
            inside = any(j <= i < j + len(e) + 1 for e in lex.exceptions for j in spared if line.startswith(f" {e} ", j))
            if not inside:
                weight += max((w for term, w in lex.terms.items() if line.startswith(" " + term, i)), default=0.0)
        total, dense = lex.evidence(t)
        assert abs(total - weight) < 1e-6 and abs(dense - 100 * weight / max(1, len(ws))) < 1e-6


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.fit(docs.filter(~held))
    got = langid.predict(docs.filter(held), model)
    assert got.filter("lang = lang_pred").count() / got.count() > 0.97
    odd = {r.doc_id: r for r in langid.predict(odd_docs(spark), model).collect()}
    assert odd[0].lang_pred == odd[1].lang_pred == odd[10].lang_pred == "und" and odd[3].lang_pred != "und" and 0 <= odd[3].score <= 1
    none = langid.predict(odd_docs(spark), langid.fit(docs.limit(0)))
    assert none.filter("lang_pred <> 'und'").count() == 0


def test_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    lex = toxicity.fit_tables(docs, labels)
    held = docs.join(labels, "doc_id").filter(toxicity.held_out())
    got = toxicity.score(held.select("doc_id", "text", "toxic"), lex).selectExpr("toxic", "int(toxicity >= 0.7) AS p").groupBy("toxic", "p").count().collect()
    n = {(r.toxic, r.p): r["count"] for r in got}
    assert n[(1, 1)] / (n[(1, 1)] + n.get((1, 0), 0)) > 0.9 and n.get((0, 1), 0) / n[(0, 0)] < 0.01
    odd = toxicity.score(odd_docs(spark), lex).collect()
    assert len(odd) == len(ODD) + 1 and all(0 <= r.toxicity < 0.7 for r in odd)
    assert toxicity.fit_tables(docs.limit(0), labels).score("anything") == 0


def test_lexicon_folding_and_exceptions():
    lex = toxicity.Lexicon({"idiot ": 4.0, "mor": 3.0}, ["no idiot"], (-3.0, 2.0, 0.5))
    assert lex.evidence("You 1d10t!")[0] == lex.evidence("You idiоt")[0] == 4.0
    assert lex.evidence("no, IDIOT here")[0] == 0 and lex.evidence("idiotic")[0] == 0 and lex.evidence("morons")[0] == 3.0
    assert lex.score("idiot " * 3) > lex.score(None) == lex.score("")


def test_words_beside_signs_outside_ascii():
    lex = toxicity.Lexicon({"idiot ": 4.0, "mor": 3.0}, ["no idiot"], (-3.0, 2.0, 0.5))
    for t in ("You “idiot”!", "you—idiot", "you idiot…", "‘Idiot’", "«idiot»", "¿idiot?", "you！idiot！"):
        assert lex.evidence(t) == lex.evidence(" ".join(toxicity.words(t))) and lex.evidence(t)[0] == 4.0, t
        assert lex.score(t) > lex.score("")
    assert lex.evidence("“morons”")[0] == 3.0 and lex.evidence("“no… idiot”")[0] == 0 and lex.evidence("“idiotic”")[0] == 0


def test_item_without_id_marks_words(spark):
    long, short = " ".join(f"w{i}" for i in range(14)), "only these four words"
    ddf = spark.createDataFrame([(1, f"before {long} after"), (2, f"x {short} y"), (3, "w0 w1 w2")], "doc_id long, text string")
    idf = spark.createDataFrame([(None, long), (None, short), (5, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12")], "item_id long, text string")
    for limit in (10**6, 1):
        got = {r.doc_id: r for r in decontaminate.mark(ddf, decontaminate.automata(idf, max_words=limit)).collect()}
        assert {i: (r.hits, r["items"]) for i, r in got.items()} == {1: ([1, 15], ["5"]), 2: ([1, 5], []), 3: ([], [])}
    assert {r.doc_id: r.text for r in decontaminate.clean(ddf, idf).collect()} == {1: "before after", 2: "x y", 3: "w0 w1 w2"}


def test_top_k_closes_single_candidates():
    rng = np.random.default_rng(5)
    x = rng.integers(-10, 10, (2000, 8))
    x[:, 0] = np.floor(10 / rng.uniform(0.01, 1, 2000)) * rng.choice([-1, 1], 2000)
    q, cids = rng.integers(1, 3, (6, 8)) * np.array([40, 1, 1, 1, 1, 1, 1, 1]), np.arange(2000)
    qids, k = np.array([0, 1, 2, -1, -2, -3]), 20
    live, cols, opened = topk.read(qids, q.astype(float), x.astype(float), {i: [i] for i in range(2000)}, k, np.full(6, -np.inf))
    assert live.tolist() == list(range(6)) and opened.sum() < 0.5 * 6 * 2000
    for i, at, scores in topk.search(qids, q, cids, x, k, np.full(6, -np.inf)):
        want = sorted((-int(q[i] @ x[j]), j) for j in range(2000) if j != qids[i])[:k]
        assert [(-int(v), int(j)) for j, v in zip(at, scores)] == want and opened[i, np.searchsorted(cols, at)].all()
