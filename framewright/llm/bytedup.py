"""Byte-level substring dedup (200-byte strings that start anywhere else) by column-wise suffix ordering.

The texts around shared cores (of the Q-byte grams inside a window, the one of least hash is the core; repeats.py) make
bounded collections. A collection's Burrows-Wheeler transform and common prefixes grow column by column: each round puts
one symbol of every document before its suffix, finds the suffix's new place by a pass over the transform, and writes
transform, common prefixes and starts anew in order. Windows whose suffix shares `width` bytes or more with a neighbour
in the order are repeated. The method's sequential files are arrays of the task: a collection holds whole cores of at most
GROUP extents each, so its size is bounded, and no machine's local folder is used. Equal extents are one document of
a collection with a count; cores with more extents than GROUP are compared by hashes of single windows (repeats.py).

Defined cases: null is an empty text; texts under `width` bytes hold no window and stay whole; repeated rows repeat each
other's windows; overlaps within one text count; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PrefixHash, as_bytes, mix, tidied
from .repeats import Cutter, covered, with_runs

Q = 64
_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def suffix_order(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Column-wise construction over several byte texts, none empty and without the byte 255: (starts, common) of all
    suffixes in order, empty ones first; common[i] is what suffix i shares with i - 1. Starts count through all texts,
    each of which has one place more, for its end."""
    n_docs = len(texts)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes + 1) - 1  # place of each text's end
    flat = np.zeros(ends[-1] + 1, np.uint8)  # 0 stands before a text
    for t, e in zip(texts, ends.tolist()):
        flat[e - len(t) : e] = t
    flat += 1
    flat[ends] = 0
    before = np.concatenate([[0], flat[:-1]]).astype(np.int64) << 32  # the symbol before each place
    # The transform, kept by symbol: sorted (symbol << 32 | position). An entry's rank is its suffix's next place.
    low32 = (1 << 32) - 1
    bwt = np.sort(before[ends] | np.arange(n_docs))
    common = np.zeros(n_docs + 1, np.uint16)
    place, at, live = np.arange(n_docs), ends.copy(), np.arange(n_docs)
    count = np.arange(n_docs + 1, dtype=np.min_scalar_type(n_docs))  # small, so that gathers stay in the cache
    for column in range(1, int(sizes.max()) + 1):
        keep = sizes[live] >= column
        live, place, at = live[keep], place[keep], at[keep]
        up = np.argsort(place)
        live, place, at = live[up], place[up], at[up]
        n, k = len(common) - 1, len(live)
        symbol = before[at]
        at = at - 1
        asked = symbol | place
        rise = np.argsort(asked)
        found = np.searchsorted(bwt, asked[rise])  # in order, which is faster
        t = np.empty(k, np.int64)
        t[rise] = found
        new = n_docs + t
        lower, higher = bwt[np.maximum(t - 1, 0)], bwt[np.minimum(t + 1, len(bwt) - 1)]
        has_low = (t > 0) & (lower >> 32 << 32 == symbol)
        has_high = (t < len(bwt) - 1) & (higher >> 32 << 32 == symbol)
        low = np.where(has_low, lower & low32, place - 1)
        high = np.where(has_high, higher & low32, place)
        span = lambda a, z: np.minimum.reduceat(common, np.stack([a, z], 1).ravel())[::2]
        shared_low = np.where(has_low, span(low + 1, place + 1) + 1, 0)
        shared_high = np.where(has_high, span(np.minimum(place + 1, n), np.minimum(high + 1, n)) + 1, 0)
        # write transform and common prefixes anew, in order, with the new suffixes between the old ones
        old = np.ones(n + k, bool)
        old[new] = False
        further = np.repeat(count[: k + 1], np.diff(np.concatenate([[0], found + n_docs - np.arange(k), [n]])))
        bwt += further[bwt & low32]
        goes_on = sizes[live] > column
        keys = np.sort((before[at] | new)[goes_on])
        grown = np.ones(len(bwt) + len(keys), bool)
        slots = np.searchsorted(bwt, keys) + np.arange(len(keys))
        grown[slots] = False
        whole = np.empty(len(grown), np.int64)
        whole[grown] = bwt
        whole[slots] = keys
        bwt = whole
        wide = np.zeros(n + k + 1, np.uint16)
        wide[:-1][old] = common[:-1]
        wide[new] = shared_low
        wide[new[has_high] + 1] = shared_high[has_high]
        common, place = wide, new
    # where each suffix stands: from the end of every text, rank by rank
    n = len(common) - 1
    step = np.zeros(n, np.int64)
    step[bwt & low32] = n_docs + np.arange(len(bwt))
    starts, place = np.zeros(n, np.int64), np.arange(n_docs)
    starts[place] = ends
    for column in range(1, int(sizes.max()) + 1):
        live = np.flatnonzero(sizes >= column)
        place[live] = step[place[live]]
        starts[place[live]] = ends[live] - column
    return starts, common[:-1]


class ByteCutter(Cutter):
    symbols_at_once = 1_500_000
    compared_at_once = 150_000

    def repeated(self, group):
        texts = [np.frombuffer(r[4], np.uint8) for r in group]
        starts, common = suffix_order(texts)
        long = common >= self.width
        long[:-1] |= long[1:]
        found = np.sort(starts[long])
        base = np.cumsum([0] + [len(t) + 1 for t in texts])
        row = np.searchsorted(base, found, "right") - 1
        return row, np.array([r[1] for r in group])[row] + found - base[row]

    def __init__(self, width: int):
        self.width = width

    def symbols(self, text):
        return _CODES[np.frombuffer(text, np.uint8)] if text else np.zeros(0, np.uint64)

    def pack(self, part):
        return _BACK(part)

    def unpack(self, raw):
        return _CODES[np.frombuffer(raw, np.uint8)]

    def anchors(self, sym, ph: PrefixHash, starts, windows):
        n = len(sym) - Q + 1
        bits = np.uint64(max(1, n.bit_length()))
        place = np.arange(n)
        key = (ph.range(place, place + Q) >> bits << bits) | place.astype(np.uint64)
        span, step = self.width - Q + 1, 1
        while 2 * step <= span:  # key[i]: least of the next `step` grams
            key = np.concatenate([np.minimum(key[:-step], key[step:]), key[len(key) - step :]])
            step *= 2
        last = np.minimum(windows + span - step, n - 1)
        best = (np.minimum(key[windows], key[last]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        return best, best + Q


_ORDER = np.argsort(_CODES)
_SORTED = _CODES[_ORDER]


def _BACK(part: np.ndarray) -> bytes:
    return _ORDER[np.searchsorted(_SORTED, part)].astype(np.uint8).tobytes()


def digest(docs: DataFrame, width: int = 200) -> DataFrame:
    def run(batches):
        for b in batches:
            n, gone, spans, sha = [], [], [], []
            for t, runs in zip(as_bytes(b.column(1)), b.column(2).to_pylist()):
                raw = t or b""
                n.append(len(raw))
                if runs:
                    mask = covered(len(raw), width, runs)
                    gone.append(int(mask.sum()))
                    spans.append(int((np.diff(np.concatenate([[0], mask.view(np.int8)])) == 1).sum()))
                    raw = np.frombuffer(raw, np.uint8)[~mask].tobytes()
                else:
                    gone.append(0)
                    spans.append(0)
                sha.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = with_runs(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ByteCutter(width), "bytes")
    return found.select("doc_id", "text", "__runs").mapInArrow(tidied(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op6_byte_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return digest(table(spark, sf_dir, "documents"))
