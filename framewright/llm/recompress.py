"""Substring dedup by recompression.

Rounds name runs of equal symbols and then pairs of neighbours; a name is the hash of what it stands for, so that all
documents agree on it without a dictionary. A hash bit of each symbol tells whether it may begin or end a pair, so a
symbol depends on nothing but a few neighbours, and that range is tracked: a symbol whose range lies inside a window is
the same in every equal window. Of these interior symbols the one of least hash is the window's anchor, its range the
core. Shared cores reveal repeats, which are then verified (repeats.py). A window without interior symbol is its own core.

Defined cases: null, empty and short texts hold no window and stay whole; repeated rows repeat each other's windows;
extra columns are ignored by the query and kept by remove(); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PrefixHash, WORDS, as_bytes, mix, tidied
from .repeats import Cutter, covered, with_runs

ROUNDS = 3
_U = np.uint64


def rename(sym, lo, hi, doc):
    """One round over symbols with dependence ranges [lo, hi) and document numbers; also returns where each begins.

    A range that reaches past a document's end leaves it by one place, so no window holds it."""
    # runs
    same = (sym[1:] == sym[:-1]) & (doc[1:] == doc[:-1])
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    k = np.diff(np.append(first, len(sym)))
    last = first + k - 1
    sym2 = np.where(k > 1, mix(sym[first] * _U(3) + k.astype(_U)), sym[first])
    d = doc[first]
    prev = np.concatenate([[False], d[1:] == d[:-1]])
    nxt = np.concatenate([d[1:] == d[:-1], [False]])
    lo2 = np.where(prev, lo[np.maximum(first - 1, 0)], lo[first] - 1)
    hi2 = np.where(nxt, hi[np.minimum(last + 1, len(sym) - 1)], hi[last] + 1)
    # pairs
    begins = (mix(sym2 ^ _U(0x51ED27)) >> _U(40)) & _U(1) == 1
    pair = begins[:-1] & ~begins[1:] & (d[1:] == d[:-1])
    start = np.concatenate([pair, [False]])
    taken = np.concatenate([[False], pair])
    nlo = np.where(begins, lo2, np.where(prev, np.concatenate([lo2[:1], lo2[:-1]]), lo2 - 1))
    nhi = np.where(begins, np.where(nxt, np.concatenate([hi2[1:], hi2[-1:]]), hi2 + 1), hi2)
    at = np.flatnonzero(~taken)
    two = start[at]
    right = np.minimum(at + 1, len(sym2) - 1)
    out = np.where(two, mix(mix(sym2[at]) * _U(5) + sym2[right]), sym2[at])
    return out, np.where(two, lo2[at], nlo[at]), np.where(two, hi2[right], nhi[at]), d[at]


class WordCutter(Cutter):
    symbols_at_once = 400_000

    def __init__(self, width: int):
        self.width = width

    def symbols(self, text):
        return WORDS.array(text.split()) if text else np.zeros(0, _U)

    def pack(self, part):
        return part.tobytes()

    def unpack(self, raw):
        return np.frombuffer(raw, _U)

    def anchors(self, sym, ph: PrefixHash, starts, windows):
        w, n = self.width, len(sym)
        doc = np.zeros(n, np.int64)
        doc[starts[1:]] = 1
        s, d = sym, np.cumsum(doc)
        lo = np.arange(n)
        hi = lo + 1
        for _ in range(ROUNDS):
            s, lo, hi, d = rename(s, lo, hi, d)
        # interior symbols of a window: range inside it
        below = np.cumsum(np.bincount(np.maximum(lo + 1, 0), minlength=n + 2))  # [i]: symbols with lo + 1 <= i
        jlo = below[windows]
        upto = np.cumsum(np.bincount(np.minimum(hi, n + 1), minlength=n + 2))  # [i]: symbols with hi <= i
        jhi = upto[windows + w]
        size = jhi - jlo
        best = np.full(len(windows), -1)
        prio, arg, step = mix(s ^ _U(0xA5A5)), np.arange(len(s)), 1
        while True:
            pick = np.flatnonzero((size >= step) & (size < 2 * step))
            if len(pick):
                a, b = arg[jlo[pick]], arg[jhi[pick] - step]
                best[pick] = np.where(prio[a] <= prio[b], a, b)
            if not (size >= 2 * step).any():
                break
            a, b = arg[:-step], arg[step:]
            arg = np.concatenate([np.where(prio[a] <= prio[b], a, b), arg[len(arg) - step :]])
            step *= 2
        none = best < 0
        return np.where(none, windows, lo[best]), np.where(none, windows + w, hi[best])


def spans(docs: DataFrame, width: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs plus __runs of repeated windows of `width` words."""
    return with_runs(docs, WordCutter(width), "recompress", text, key)


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return digest(table(spark, sf_dir, "documents"))


def digest(docs: DataFrame, width: int = 35) -> DataFrame:
    def run(batches):
        for b in batches:
            n, gone, sha = [], [], []
            for t, runs in zip(as_bytes(b.column(1)), b.column(2).to_pylist()):
                ws = t.split() if t else []
                mask = covered(len(ws), width, runs) if runs else None
                kept = ws if mask is None else [w for w, m in zip(ws, mask.tolist()) if not m]
                n.append(len(ws))
                gone.append(len(ws) - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    found = spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width)
    return found.select("doc_id", "text", "__runs").mapInArrow(tidied(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def remove(docs: DataFrame, width: int = 35, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Takes repeated windows out of the texts, each word with the white space behind it, wherever they stand.
    Documents that repeat nothing stay byte for byte."""
    found = spans(docs, width, text, key)
    at = docs.columns.index(text)
    schema = docs.schema

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            for i, runs in enumerate(b.column(b.num_columns - 1).to_pylist()):
                if runs:
                    raw = texts[i].encode("utf-8", "surrogatepass")
                    ws = [m.span() for m in WORD.finditer(raw)]
                    mask = covered(len(ws), width, runs)
                    lead = raw[: ws[0][0]]
                    texts[i] = (lead + b"".join(raw[s:e] for (s, e), m in zip(ws, mask.tolist()) if not m)).decode("utf-8", "surrogatepass")
            cols = list(b.columns[:-1])
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return found.mapInArrow(tidied(run), schema)


OP5_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS MATERIALIZED (SELECT r, k, sha256(array_to_string(w[k:k + 34], ' ')) AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS k FROM d)),
rep AS MATERIALIZED (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
hit AS MATERIALIZED (SELECT DISTINCT r, k + j AS k FROM (SELECT r, k, unnest(range(0, 35)) AS j FROM win WHERE s IN (SELECT s FROM rep))),
word AS MATERIALIZED (SELECT r, generate_subscripts(w, 1) AS k, unnest(w) AS x FROM d),
kept AS MATERIALIZED (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY k) AS t FROM word ANTI JOIN hit USING (r, k) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
