"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts per (language, hashed 1- to 3-gram), and of documents per language for the prior, are summed by Spark over a
bounded sample of labelled rows; the log-probability matrix (3 * 2**15 slots and the prior x languages, float32, so a few
hundred kB a language) is broadcast. The n-grams of many whole texts form one sparse batch, whose scores are one
gathering of matrix rows and segment sums by text.

Defined cases: null text or no letter -> lang_pred 'und', score 0; no labelled row -> every prediction 'und', score 0;
repeated rows are each scored; of languages with equal scores the first by name is taken; other columns are kept
untouched, but lang_pred and score take the place of columns of these names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied

BITS = 15
SLOTS = 3 << BITS
CHUNK = 1 << 18
#: Bound on the labelled rows from which the model is fitted.
MAX_TRAIN_ROWS = 40_000


def grams(text: str):
    """Hashed 1-, 2- and 3-grams of the lower-cased text, in pieces of bounded size."""
    t = text.lower()
    for at in range(0, max(len(t), 1), CHUNK):
        c = np.frombuffer(t[at : at + CHUNK + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        last = at + CHUNK >= len(t)
        mask, n = np.uint32((1 << BITS) - 1), len(c) if last else CHUNK
        one = (c * np.uint32(0x9E3779B1)) >> np.uint32(7)
        two = (one[:-1] * np.uint32(31) + c[1:]) * np.uint32(0x85EBCA77)
        three = (two[:-1] * np.uint32(37) + c[2:]) * np.uint32(0xC2B2AE3D)
        yield np.concatenate([one[:n] & mask, ((two[:n] >> np.uint32(9)) & mask) + np.uint32(1 << BITS), ((three[:n] >> np.uint32(9)) & mask) + np.uint32(2 << BITS)])


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_rows: int = MAX_TRAIN_ROWS):
    """(languages, matrix): log-probabilities, float32 [SLOTS + 1, languages]; the last row is the prior."""
    from .common import bounded_sample

    rows = bounded_sample(labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("g")), "k", max_rows)

    def count(batches):
        by: dict[str, np.ndarray] = {}
        for b in batches:
            for t, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = by.setdefault(g, np.zeros(SLOTS + 1, np.int64))
                c[SLOTS] += 1  # documents
                for i in grams(t):
                    np.add.at(c, i, 1) if len(i) < 2000 else c.__iadd__(np.bincount(i, minlength=SLOTS + 1))
        for g, c in by.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(at)), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["g", "slot", "n"])

    got = rows.select("t", "g").mapInArrow(tidied(count), "g string, slot int, n long").groupBy("g", "slot").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got.column(0).to_pylist()))
    m = np.full((SLOTS + 1, len(langs)), 0.5, np.float64)
    if langs:
        at = {g: i for i, g in enumerate(langs)}
        np.add.at(m, (got.column(1).to_numpy(), np.array([at[g] for g in got.column(0).to_pylist()])), got.column(2).to_numpy())
    for o in range(3):
        part = m[o << BITS : (o + 1) << BITS]
        part /= part.sum(axis=0, keepdims=True) if langs else 1
    m[SLOTS] /= m[SLOTS].sum() if langs else 1
    return langs, np.log(m).astype(np.float32)


def scores(matrix: np.ndarray, texts: list[str]) -> np.ndarray:
    """Log-probabilities [texts, languages]: sparse batches of at most about two CHUNKs of n-grams."""
    total = np.tile(matrix[SLOTS].astype(np.float64), (len(texts), 1))
    slots, who, size = [], [], 0

    def add():
        starts = np.cumsum([0, *map(len, slots[:-1])])
        np.add.at(total, who, np.add.reduceat(matrix[np.concatenate(slots)], starts, axis=0, dtype=np.float64))

    for j, text in enumerate(texts):
        for i in grams(text):
            if len(i):
                slots.append(i)
                who.append(j)
                size += len(i)
            if size >= CHUNK:
                add()
                slots, who, size = [], [], 0
    if size:
        add()
    return total


def predict(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (the posterior probability of that language) added."""
    langs, matrix = model
    shared = docs.sparkSession.sparkContext.broadcast((langs, matrix))
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index(text)

    def run(batches):
        names, m = shared.value
        for b in batches:
            texts = b.column(at).to_pylist()
            pred, conf = ["und"] * len(texts), [0.0] * len(texts)
            told = [i for i, t in enumerate(texts) if names and t is not None and any(map(str.isalpha, t))]
            for i, s in zip(told, scores(m, [texts[i] for i in told]) if told else ()):
                j = int(s.argmax())
                pred[i], conf[i] = names[j], float(1 / np.exp(s - s[j]).sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(conf, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    return docs.mapInArrow(tidied(run), StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType()))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit(docs.filter(~held & F.col("doc_id").isNotNull()))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
