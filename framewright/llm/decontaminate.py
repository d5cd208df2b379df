"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

Items are lower-cased (A-Z) and cut into words; an automaton over word ids (all items in one; beyond MAX_WORDS words in
shards by item id, each a pass of its own, so that what is broadcast and held stays bounded) reads each document's words,
keeping the longest matching length. A match of at least `window` words, or of a whole shorter item, marks its words as hit. Runs of words
that no item holds reset the automaton and are skipped as a whole.

Defined cases: null texts have no words; items without words never match; repeated documents and items are rows of
their own (an item id that repeats counts once); an item with a null id marks words like any other and is not among the
items counted; no items -> nothing is hit; other columns are kept untouched, but marks take the
place of columns of their names.
"""

from __future__ import annotations

import functools
import pickle
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from .common import as_bytes, free_name, stash, tidied

WINDOW = 10
#: Words of the items in one automaton.
MAX_WORDS = 1_000_000

TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or b > 0x7F or 97 <= b <= 122 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton of word-id sequences, with the windows that tell which items occur."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window, self.ids = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items_of: dict[tuple, set[str]] = {}
        ends = []
        for name, ws in items:
            seq = [self.ids.setdefault(w, len(self.ids)) for w in ws]
            if not seq:
                continue
            last = 0
            for c in seq:
                last = self._extend(last, c)
            n = min(window, len(seq))
            for i in range(len(seq) - n + 1):
                of = self.items_of.setdefault(tuple(seq[i : i + n]), set())
                if name is not None:
                    of.add(name)
            if len(seq) < window:
                ends.append(seq)
        self.short_lengths = sorted({len(s) for s in ends})
        self.least = min([window, *self.short_lengths]) if self.ids else window

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:  # the sequence is known already: reuse or split its state
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = self._state({}, 0, length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _state(self, to: dict, link: int, length: int) -> int:
        self.next.append(to)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        new = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def spans(self, seq: list[int]):
        """(start, end, items) of every window occurrence in a run of known word ids."""
        nxt, link, length, w = self.next, self.link, self.length, self.window
        state = size = 0
        for i, c in enumerate(seq):
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            state = nxt[state].get(c, 0)
            size = size + 1 if state else 0
            if size >= w:
                yield i + 1 - w, i + 1, self.items_of[tuple(seq[i + 1 - w : i + 1])]
            for n in self.short_lengths:
                if n <= size and (items := self.items_of.get(tuple(seq[i + 1 - n : i + 1]))) is not None:
                    yield i + 1 - n, i + 1, items

    def match(self, ws: list[bytes]):
        """(mask of hit words or None, items)."""
        n = len(ws)
        if n < self.least:
            return None, ()
        ids = np.fromiter(map(self.ids.get, ws, repeat(-1)), np.int32, n)
        known = np.concatenate([[0], (ids >= 0).view(np.int8), [0]])
        turn = np.flatnonzero(np.diff(known))
        lo, hi = turn[::2], turn[1::2]
        keep = hi - lo >= self.least
        mask, items = None, set()
        for a, z in zip(lo[keep].tolist(), hi[keep].tolist()):
            for s, e, of in self.spans(ids[a:z].tolist()):
                if mask is None:
                    mask = np.zeros(n, bool)
                mask[a + s : a + e] = True
                items |= of
        return mask, items


@functools.lru_cache(1)
def _load(packed: bytes) -> SuffixAutomaton:
    return SuffixAutomaton(*pickle.loads(zlib.decompress(packed)))


def automata(items: DataFrame, text: str = "text", key: str = "item_id", window: int = WINDOW, max_words: int = MAX_WORDS) -> Iterator[bytes]:
    """Packed item shards of about max_words words at most, one at a time on the driver; each becomes an automaton."""
    items = items.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).filter("t is not null")
    size = items.agg(F.sum(F.length("t"))).first()[0] or 0
    shards = -(-size // (4 * max_words)) or 1
    for s in range(shards):
        part = items if shards == 1 else items.filter(F.pmod(F.xxhash64(F.coalesce("k", "t")), F.lit(shards)) == s)
        rows = [(r.k, words(r.t.encode("utf-8", "surrogatepass"))) for r in part.orderBy("k", "t").toLocalIterator()]
        yield zlib.compress(pickle.dumps((rows, window)))


def mark(docs: DataFrame, shards: Iterable[bytes], text: str = "text", names=("n_words", "hits", "items")) -> DataFrame:
    """docs plus n_words, hits (word spans [start, end) that any item covers, flattened) and items, in place of columns of
    these names.
    Each shard of items is a pass over all documents, written before the next begins: one automaton lives at a time."""
    return _marked(docs.drop(*names), shards, text, names)


def _marked(docs: DataFrame, shards: Iterable[bytes], text: str, names, finish=None) -> DataFrame:
    width, rest = len(docs.columns), iter(shards)
    shard = next(rest)
    while (later := next(rest, None)) is not None:
        docs, shard = stash(_pass(docs, shard, text, names, width), "marked"), later
    return _pass(docs, shard, text, names, width, finish)


def _pass(docs: DataFrame, shard: bytes, text: str, names, width: int, finish=None) -> DataFrame:
    """One shard's pass over documents of `width` columns, with the marks of the passes before it behind them. finish:
    makes the columns of documents anew from those and the marks, in place of adding the marks."""
    shared = docs.sparkSession.sparkContext.broadcast(shard)
    schema = StructType(docs.schema.fields[:width])
    if finish is None:
        schema = schema.add(names[0], LongType()).add(names[1], ArrayType(LongType())).add(names[2], ArrayType(StringType()))
    at = docs.columns.index(text)
    marked = len(docs.columns) > width

    def run(batches):
        find = _load(shared.value)
        for b in batches:
            n, hits, items = [], [], []
            before = zip(b.column(width + 1).to_pylist(), b.column(width + 2).to_pylist()) if marked else repeat(((), ()))
            for t, (old, of) in zip(as_bytes(b.column(at)), before):
                ws = words(t)
                mask, more = find.match(ws)
                if mask is not None:
                    for a, z in zip(old[::2], old[1::2]):
                        mask[a:z] = True
                    old, of = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).tolist(), {*of, *more}
                n.append(len(ws))
                hits.append(old)
                items.append(sorted(of))
            if finish is not None:
                yield pa.RecordBatch.from_arrays(finish(list(b.columns[:width]), n, hits), names=b.schema.names[:width])
                continue
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=[*b.schema.names[:width], *names])

    return docs.mapInArrow(tidied(run), schema)


def n_hit():
    """Words covered, from `hits`: ends minus starts."""
    return F.aggregate(F.transform("hits", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)


def clean(docs: DataFrame, items: DataFrame, max_words: int = 0, max_share: float = 0.0, text: str = "text") -> DataFrame:
    """Removes hit spans, with the signs that follow each removed word, from documents with more than max_words hit
    words and more than the share max_share of their words hit; documents without hits stay byte for byte."""
    at = docs.columns.index(text)
    find = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def cut(columns, counts, spans):
        texts = columns[at].to_pylist()
        for i, (h, n) in enumerate(zip(spans, counts)):
            hit = sum(h[1::2]) - sum(h[::2])
            if not hit or hit <= max_words or hit <= max_share * n:
                continue
            raw = texts[i].encode("utf-8", "surrogatepass")
            low = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
            starts = [m.start() for m in find.finditer(low)] + [len(raw)]
            keep, last = [], 0
            for a, z in zip(h[::2], h[1::2]):
                keep.append(raw[last : starts[a]])
                last = starts[z]
            texts[i] = b"".join([*keep, raw[last:]]).decode("utf-8", "surrogatepass")
        columns[at] = pa.array(texts, pa.string())
        return columns

    names = tuple(free_name(docs.columns, c) for c in ("__n", "__hits", "__items"))
    return _marked(docs, automata(items, text), text, names, cut)


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    from .common import table

    marked = mark(table(spark, sf_dir, "documents").select("doc_id", "text"), automata(table(spark, sf_dir, "benchmark")))
    return marked.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated")
    )


OP10_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS MATERIALIZED (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
dw AS MATERIALIZED (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d JOIN (SELECT DISTINCT n FROM bw) z ON len(w) >= z.n)),
m AS MATERIALIZED (SELECT r, dw.n, k, item_id FROM dw JOIN bw ON bw.n = dw.n AND bw.s = dw.s),
h AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, k + unnest(range(0, n)) AS k FROM m) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""
