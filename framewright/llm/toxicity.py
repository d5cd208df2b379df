"""Toxicity: a learnt weighted lexicon, matched by Aho-Corasick on folded text.

Text is lower-cased, homoglyphs and digit substitutions are folded, other signs become spaces. The lexicon (word
beginnings with log-odds weights, and exception phrases that cancel a match inside them) is learnt from a bounded sample
of labelled rows; its size is bounded by MAX_TERMS. A document's evidence is the summed weight of its matches, plus the
same normalised by its length in words; a logistic curve fitted on the same sample turns both into a score.

Defined cases: null and empty texts have no match and get the base score; with no toxic or no clean labelled row the
lexicon is empty and every score is 0; repeated rows are each scored; other columns are kept untouched, but the
score takes the place of a column of its name.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import tidied

#: Bounds of what is learnt.
MAX_TRAIN_ROWS, MAX_TERMS, MAX_EXCEPTIONS = 20_000, 2_000, 2_000
THRESHOLD = 0.7
PREFIXES = range(4, 13)

HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ո": "n", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ӏ": "l",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
FOLD = {ord(k): v for k, v in (HOMOGLYPHS | SUBSTITUTES).items()}
FOLD |= {c: chr(c - 0xFF41 + 97) for c in range(0xFF41, 0xFF5B)}  # full-width letters
FOLD |= {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}  # invisible separators
FOLD |= {c: " " for c in range(128) if not chr(c).isalnum() and chr(c) not in SUBSTITUTES}
SPACES = re.compile(r"[^\w]+")


def fold(text: str) -> str:
    """Folded text, each word with a space before it."""
    return " " + text.lower().translate(FOLD) + " "


def words(text: str | None) -> list[str]:
    return SPACES.sub(" ", fold(text)).split() if text else []


class Lexicon:
    """terms: word beginnings (or whole words, ending in a space) -> weight; exceptions: phrases that cancel matches."""

    def __init__(self, terms: dict[str, float], exceptions: list[str] = (), curve=(0.0, 0.0, 0.0)):
        self.terms, self.exceptions, self.curve = dict(terms), sorted(exceptions), tuple(curve)
        self.find = ahocorasick.Automaton()
        for t, w in self.terms.items():
            self.find.add_word(" " + t, (len(t), w))
        if self.terms:
            self.find.make_automaton()
        self.spare = ahocorasick.Automaton()
        for t in self.exceptions:
            self.spare.add_word(f" {t} ", len(t) + 2)
        if self.exceptions:
            self.spare.make_automaton()

    def evidence(self, text: str | None) -> tuple[float, float]:
        """Summed weight of the matches outside exception phrases; the same per 100 words."""
        if not text or not self.terms:
            return 0.0, 0.0
        t = SPACES.sub(" ", fold(text))
        best: dict[int, float] = {}
        for end, (n, w) in self.find.iter(t):
            at = end - n
            best[at] = max(best.get(at, 0.0), w)
        if best and self.exceptions:
            for end, n in self.spare.iter(t):
                for at in [a for a in best if end - n < a + 1 <= end]:
                    del best[at]
        total = sum(best.values())
        return total, 100 * total / max(1, t.count(" ") - 1)

    def score(self, text: str | None) -> float:
        if not self.terms:
            return 0.0
        a, b, c = self.curve
        total, dense = self.evidence(text)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, a + b * math.log1p(total) + c * math.log1p(dense)))))

    def dump(self) -> str:
        return json.dumps([self.terms, self.exceptions, self.curve])


@functools.lru_cache(4)
def load(dumped: str) -> Lexicon:
    return Lexicon(*json.loads(dumped))


def _logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Ridge logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -50, 50)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (y - p) - 0.5 * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in b]


def fit(labelled: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", max_rows: int = MAX_TRAIN_ROWS) -> Lexicon:
    """Learns the lexicon from rows with a text and a 0/1 label."""
    from .common import bounded_sample, discard, stash

    rows = labelled.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).cast("int").alias("y"))
    rows = stash(bounded_sample(rows, "k", max_rows), "toxic-sample")
    totals = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        discard(rows)
        return Lexicon({})

    def grams(batches):
        seen = {0: Counter(), 1: Counter()}
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = set(words(t))
                out = {w + " " for w in ws}
                for w in ws:
                    out.update(w[:n] for n in PREFIXES if n <= len(w))
                seen[1 if y else 0].update(out)
        both = sorted(seen[0].keys() | seen[1].keys())
        for at in range(0, len(both), 50_000):
            part = both[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([seen[1][g] for g in part], pa.int64()), pa.array([seen[0][g] for g in part], pa.int64())], names=["g", "bad", "good"])

    least = max(3, bad // 500)
    odds = F.log(((F.col("bad") + 0.5) / (bad + 1)) / ((F.col("good") + 0.5) / (good + 1)))
    found = rows.select("t", "y").mapInArrow(tidied(grams), "g string, bad long, good long").groupBy("g").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    found = found.filter(f"bad >= {least}").withColumn("w", odds).filter("w >= 3").orderBy(F.desc(F.col("w") * F.col("bad")), "g").limit(20 * MAX_TERMS).collect()
    terms: dict[str, float] = {}
    for r in sorted(found, key=lambda r: (-r.w * r.bad, len(r.g), r.g)):
        if len(terms) < MAX_TERMS and not any(r.g.startswith(t) for n in range(1, len(r.g)) if (t := r.g[:n]) in terms):
            terms[r.g] = round(r.w, 6)
    # A longer beginning that is covered by a kept shorter one adds nothing.
    terms = {t: w for t, w in terms.items() if not any(t[:n] in terms for n in range(1, len(t)))}
    plain = Lexicon(terms)
    dumped = plain.dump()

    def contexts(batches):
        import pyarrow as pa

        lex = load(dumped)
        for b in batches:
            g, y, tot, den = [], [], [], []
            for t, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total, dense = lex.evidence(t)
                near: list[str] = []
                if total:
                    ws = words(t)
                    hit = [i for i, w in enumerate(ws) if any((w + " ")[:n] in lex.terms for n in range(1, len(w) + 2))]
                    near = sorted({" ".join(ws[max(0, i + a) : i + c]) for i in hit for a, c in ((-1, 1), (0, 2))})
                g.append(near)
                y.append(label)
                tot.append(total)
                den.append(dense)
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.list_(pa.string())), pa.array(y, pa.int32()), pa.array(tot, pa.float64()), pa.array(den, pa.float64())], names=["g", "y", "total", "dense"])

    marked = stash(rows.select("t", "y").mapInArrow(tidied(contexts), "g array<string>, y int, total double, dense double"), "toxic-marked")
    spare = marked.select("y", F.explode("g").alias("g")).groupBy("g").agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("bad"), F.sum(F.when(F.col("y") == 1, 0).otherwise(1)).alias("good"))
    spare = [r.g for r in spare.filter("good >= 3 and good >= 10 * bad").orderBy(F.desc("good"), "g").limit(MAX_EXCEPTIONS).collect() if " " in r.g]
    if spare:
        dumped = Lexicon(terms, spare).dump()
        discard(marked)
        marked = stash(rows.select("t", "y").mapInArrow(tidied(contexts), "g array<string>, y int, total double, dense double"), "toxic-marked")
    data = marked.select("total", "dense", "y").toPandas()  # at most MAX_TRAIN_ROWS small rows
    curve = _logistic(np.log1p(data[["total", "dense"]].to_numpy()), data["y"].to_numpy() == 1) if len(data) else (0, 0, 0)
    discard(marked)
    discard(rows)
    return Lexicon(terms, spare, curve)


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", out: str = "toxicity") -> DataFrame:
    """docs with the score as column `out`, in place of one of that name."""
    docs = docs.drop(out)
    dumped = lexicon.dump()
    at = docs.columns.index(text)

    def run(batches):
        lex = load(dumped)
        for b in batches:
            s = pa.array([lex.score(t) for t in b.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, s], names=[*b.schema.names, out])

    return docs.mapInArrow(tidied(run), StructType([*docs.schema.fields]).add(out, DoubleType()))


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def fit_tables(docs: DataFrame, labels: DataFrame) -> Lexicon:
    known = labels.filter(~held_out() & F.col("doc_id").isNotNull()).select("doc_id", "toxic").dropDuplicates(["doc_id"])
    return fit(docs.select("doc_id", "text").join(known, "doc_id"))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lex = fit_tables(docs, labels)
    out = score(docs.select("doc_id", held_out().alias("held_out"), "text"), lex, out="score")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
