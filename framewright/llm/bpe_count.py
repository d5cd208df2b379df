"""Token counts by heap-and-linked-list byte-pair merging.

Each pre-token's bytes form a doubly linked list; a heap yields the lowest-rank adjacent pair (leftmost on ties), which
is merged in place; the count is the initial symbols minus the merges, and no identifier is produced. Texts are cut at
single spaces between two non-spaces, which no pre-token of the byte-level pattern crosses; counts of such pieces and of
pre-tokens are remembered in bounded tables.

Defined cases: null text counts as empty (0 bytes, 0 tokens); the vocabulary's special strings inside a text count one
token each, the library's default; repeated rows are each counted; other columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import json
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied

#: White space as the vocabulary's library knows it (Python's \s has four control characters more).
WS = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+"


class Untidy(Exception):
    """A piece has white space at an end, so it can't be cut off from its neighbours."""


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte, as byte-level vocabularies write them."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = [""] * 256, 0
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + n)
            n += 1
    return out


class Pieces(dict):
    """What `value` gives for ' ' + piece, remembered for the first LIMIT short pieces (frequent ones come early)."""

    LIMIT = 150_000

    def __init__(self, value):
        super().__init__()
        self.value = value

    def __missing__(self, piece):
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise Untidy
        v = self.value(" " + piece)
        if len(self) < self.LIMIT and len(piece) <= 64:
            self[piece] = v
        return v


class BpeCounter:
    TOKENS = 150_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        pre = j.get("pre_tokenizer") or {}
        if j["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or j.get("normalizer"):
            raise ValueError("this counter takes byte-level BPE vocabularies without normaliser or added prefix space")
        ids = j["model"]["vocab"]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for i, m in enumerate(j["model"]["merges"]):
            x, y = m.split(" ") if isinstance(m, str) else m
            self.rank[ids[x] << 24 | ids[y]] = i
            self.made.append(ids[x + y])
        self.first = [ids[c] for c in byte_symbols()]
        self.special = sorted((a["content"] for a in j.get("added_tokens", [])), key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.find = regex.compile(PATTERN).findall
        self.pieces = Pieces(self.piece_count)
        self.tokens: dict[str, int] = {}

    def merge_count(self, token: str) -> int:
        sym = [self.first[b] for b in token.encode("utf-8", "surrogatepass")]
        n = len(sym)
        get, made = self.rank.get, self.made
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        due = [get(a << 24 | b, -1) for a, b in zip(sym, sym[1:])]  # rank of the pair that starts here
        bits = n.bit_length()
        low = (1 << bits) - 1
        heap = [r << bits | i for i, r in enumerate(due) if r >= 0]
        due.append(-1)
        heapq.heapify(heap)
        merges = 0
        while heap:
            e = heapq.heappop(heap)
            i, r = e & low, e >> bits
            if due[i] != r:
                continue  # one side has been merged meanwhile
            j = nxt[i]
            sym[i] = made[r]
            due[j] = due[i] = -1
            nxt[i] = k = nxt[j]
            merges += 1
            if k < n:
                prv[k] = i
                if (r := get(sym[i] << 24 | sym[k], -1)) >= 0:
                    due[i] = r
                    heapq.heappush(heap, r << bits | i)
            h = prv[i]
            if h >= 0:
                due[h] = r = get(sym[h] << 24 | sym[i], -1)
                if r >= 0:
                    heapq.heappush(heap, r << bits | h)
        return n - merges

    def piece_count(self, piece: str) -> int:
        total, known = 0, self.tokens
        if piece[1:].isalpha():
            found = (piece,)
        elif piece[1:-1].isalpha() and piece[-1] in ".,;:!?":
            found, total = (piece[:-1],), 1
        else:
            found = self.find(piece)
        for t in found:
            n = known.get(t)
            if n is None:
                n = self.merge_count(t)
                if len(known) < self.TOKENS and len(t) <= 64:
                    known[t] = n
            total += n
        return total

    def plain(self, text: str) -> int:
        first, *rest = text.split(" ")
        try:
            if not first or first[-1].isspace():
                raise Untidy
            return sum(map(self.pieces.__getitem__, rest)) + sum(map(self.piece_count, self.find(first)))
        except Untidy:
            return sum(map(self.piece_count, BORDER.split(text)))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.cut is None or not any(s in text for s in self.special):
            return self.plain(text)
        return sum(1 if i % 2 else self.plain(t) for i, t in enumerate(self.cut.split(text)) if t)


@functools.lru_cache(2)
def counter_for(path: str) -> BpeCounter:
    """One counter, with its tables, for all tasks of a Python worker."""
    return BpeCounter(path)


#: Before each single space between two non-spaces; no pre-token crosses it.
BORDER = re.compile(r"(?<=\S)(?= \S)")


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", limit: int = 1024) -> DataFrame:
    def run(batches):
        counter = counter_for(vocabulary)
        for b in batches:
            texts = b.column(1).to_pylist()
            sizes = [0 if t is None else len(t.encode("utf-8", "surrogatepass")) for t in texts]
            counts = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(tidied(run, keep="bpe"), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
