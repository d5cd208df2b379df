"""Best-fit packing in bulk-synchronous rounds.

Documents are tokenised once; a document longer than the sequence length is cut into full pieces behind a shorter first
one. A piece of more than half a sequence begins a sequence of its own; all others wait. Each round counts waiting pieces
and open gaps by size and sorts them together into ranges of falling size. A task sweeps its range: a piece takes the smallest gap that holds
it (its successor), and what is left of the gap stays open. Pieces and gaps that a range leaves over meet across ranges:
from one count of each a range, runs say which leftover piece, by rank, takes which leftover gap of a range before it.
Then gaps are updated and the next round follows; sequences are opened for what the gaps can't hold in sum, or for all
that wait if a round placed nothing.

Defined cases: null or empty text is a document of the end id alone; repeated rows are packed as rows of their own;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import re
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe_count import BORDER, PATTERN, Pieces
from .common import discard, stash, tidied

SEQUENCE = 2048
#: Pieces and gaps that one task sweeps.
ITEMS_A_RANGE = 500_000


class IdEncoder:
    """Ids of a byte-level BPE vocabulary as little-endian 32-bit bytes, remembered by space-delimited piece."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        from .bpe_count import byte_symbols

        self.slow = Tokenizer.from_file(path)
        back = {c: b for b, c in enumerate(byte_symbols())}
        added = {t.content for t in self.slow.get_added_tokens_decoder().values()}
        ranks = {bytes(back[c] for c in k): v for k, v in self.slow.get_vocab().items() if k not in added}
        self.fast = tiktoken.Encoding("pack", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.added = {t.content: struct.pack("<I", i) for i, t in self.slow.get_added_tokens_decoder().items()}
        self.pieces = Pieces(self.ids)

    def ids(self, text: str) -> bytes:
        got = self.fast.encode_ordinary(text)
        return struct.pack(f"<{len(got)}I", *got)

    def plain(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            if not rest or not first or first[-1].isspace():
                return self.ids(text)
            return self.ids(first) + b"".join(map(self.pieces.__getitem__, rest))
        except Exception as e:
            if type(e).__name__ != "Untidy":
                raise
            return b"".join(map(self.ids, BORDER.split(text)))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not any(s in text for s in self.added):
            return self.plain(text)
        return b"".join(self.added[t] if i % 2 else self.plain(t) for i, t in enumerate(self.cut.split(text)) if t)


@functools.lru_cache(2)
def encoder_for(path: str) -> IdEncoder:
    return IdEncoder(path)


def cut_pieces(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", size: int = SEQUENCE, end: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, uid (a number of its own once the rows are written)."""

    def run(batches):
        from pyspark import TaskContext

        uids = itertools.count(TaskContext.get().partitionId() << 40)
        enc, tail = encoder_for(vocabulary), struct.pack("<I", end)
        for b in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = enc.encode(t) + tail
                n = len(ids) // 4
                at, i, step = 0, 0, n % size or size
                while at < n:
                    doc.append(d)
                    piece.append(i)
                    start.append(at)
                    length.append(step)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + step)]))
                    at, i, step = at + step, i + 1, size
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(list(itertools.islice(uids, len(doc))), pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "uid"])

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(tidied(run, keep="bpe"), "doc_id long, piece int, start long, length long, ids_crc32 long, uid long")


def sweep(rows, size: int):
    """One range's best fit. rows: (size, kind, id) by falling size, gaps (kind 0) before pieces (kind 1) of their size.
    Returns placements (id, sequence, offset), gaps left (sequence, gap) by falling size, pieces left (id, length), and
    the least size of the range."""
    open_: list[list[int]] = [[] for _ in range(size + 1)]
    have, least = 0, size  # bits of the gap sizes that are open
    placed, left = [], []
    for n, kind, who in rows:
        least = n
        if kind == 0:
            open_[n].append(who)
            have |= 1 << n
        elif fits := have >> n:
            g = n + (fits & -fits).bit_length() - 1
            seq = open_[g].pop()
            if not open_[g]:
                have ^= 1 << g
            placed.append((who, seq, size - g))
            if g > n:
                open_[g - n].append(seq)
                have |= 1 << (g - n)
        else:
            left.append((who, n))
    gaps = [(seq, g) for g in range(size, 0, -1) for seq in open_[g]]
    return placed, gaps, left, least


def meet(counts: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """counts: (range, leftover gaps that any later range may use, the least of them, leftover pieces, the longest of
    them), by range. Runs (range, first rank, end, range of the gaps, rank of the first one's gap, pieces for a gap):
    pieces take the gaps nearest before them, the last first, as many to a gap as fit at the longest."""
    stack: list[list[int]] = []
    runs = []
    for part, gaps, least, pieces, longest in sorted(counts):
        at = 0
        while at < pieces and stack:
            of, n, room = stack[-1]
            each = max(1, room // longest)
            k = min(pieces - at, n * each)
            runs.append((part, at, at + k, of, n - 1, each))
            at += k
            stack[-1][1] -= -(-k // each)
            if not stack[-1][1]:
                stack.pop()
        if gaps:
            stack.append([part, gaps, least])
    return runs


def ranges(counts: dict[tuple[int, int], int], each: int) -> list[tuple[int, int, int, int]]:
    """counts: (size, kind) -> items. (size, kind, first range, ranges) by falling size, gaps first: a range holds whole
    sizes up to about `each` items; a size of more is dealt over ranges of its own."""
    out, at, held = [], 0, 0
    for (n, kind), c in sorted(counts.items(), key=lambda x: (-x[0][0], x[0][1])):
        split = -(-c // each)
        if held and held + c > each:
            at, held = at + 1, 0
        out.append((n, kind, at, split))
        held += c
        if split > 1:
            at, held = at + split, 0
    return out


_SWEPT = "what string, part int, at long, id long, seq long, n long"


def one_round(items: DataFrame, counts: dict[tuple[int, int], int], size: int) -> tuple[DataFrame, DataFrame]:
    """items (n, kind, id), counted by (n, kind) -> (placements (id, seq, offset), state (n, kind, id) of what stays open)."""
    spark = items.sparkSession

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3))))
        placed, gaps, left, least = sweep(rows, size)
        out = [("placed", 0, w, q, o) for w, q, o in placed]
        out += [("gap" if g >= least else "rest", i, 0, q, g) for i, (q, g) in enumerate(gaps)]  # by falling size: offered gaps come first
        out += [("piece", i, w, 0, n) for i, (w, n) in enumerate(left)]
        for i in range(0, len(out), 100_000):
            what, at, who, seq, n = zip(*out[i : i + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array(what), pa.array([part] * len(what), pa.int32()), *[pa.array(c, pa.int64()) for c in (at, who, seq, n)]], names=["what", "part", "at", "id", "seq", "n"])

    cut = ranges(counts, ITEMS_A_RANGE)
    cuts = F.broadcast(spark.createDataFrame(cut, "n long, kind int, first int, split int"))  # at most two rows a size
    ranged = items.join(cuts, ["n", "kind"]).withColumn("part", F.col("first") + F.pmod(F.xxhash64("id"), F.col("split")).cast("int"))
    ranged = ranged.repartitionById(cut[-1][2] + cut[-1][3], F.col("part")).select("n", "kind", "id").sortWithinPartitions(F.desc("n"), "kind", "id")
    swept = stash(ranged.mapInArrow(tidied(run, keep="bpe"), _SWEPT), "swept")
    left: dict[int, list[int]] = {}
    for r in swept.filter("what IN ('gap', 'piece')").groupBy("part", "what").agg(F.count("*").alias("c"), F.min("n").alias("lo"), F.max("n").alias("hi")).collect():  # two rows a range at most
        at = left.setdefault(r.part, [0, 0, 0, 0])
        at[slice(2, 4) if r.what == "piece" else slice(0, 2)] = [r.c, r.hi if r.what == "piece" else r.lo]
    runs = F.broadcast(spark.createDataFrame(meet([(p, *c) for p, c in left.items()]), "part int, lo long, hi long, gap_part int, gap_at long, each long"))  # two for each range at most
    pieces = swept.filter("what = 'piece'").alias("w").join(runs.alias("r"), (F.col("w.part") == F.col("r.part")) & (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")), "left")
    pieces = pieces.select("id", "n", "at", "gap_part", F.expr("gap_at - (at - lo) div each").alias("gap_at"))
    gaps = swept.filter("what = 'gap'").select(F.col("part").alias("gap_part"), F.col("at").alias("gap_at"), "seq", F.col("n").alias("gap"))
    before = F.sum("n").over(Window.partitionBy("gap_part", "gap_at").orderBy("at")) - F.col("n")  # at most `size` pieces a gap
    met = stash(pieces.filter("gap_part IS NOT NULL").join(gaps, ["gap_part", "gap_at"]).select("id", "seq", (size - F.col("gap") + before).alias("offset"), "n"), "met")
    placed = swept.filter("what = 'placed'").select("id", "seq", F.col("n").alias("offset")).union(met.select("id", "seq", "offset"))
    gaps = swept.filter("what IN ('gap', 'rest')").select("seq", "n").union(met.select("seq", -F.col("n"))).groupBy("seq").agg(F.sum("n").alias("n")).filter("n > 0")
    state = gaps.select("n", F.lit(0).alias("kind"), F.col("seq").alias("id")).union(pieces.filter("gap_part IS NULL").select("n", F.lit(1), "id"))
    return placed, stash(state, "open")


def pack(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Adds sequence_id and offset to the rows of cut_pieces(), which must stay the same when read again."""
    spark = pieces.sparkSession
    alone = F.col("length") > size // 2
    state = pieces.filter(~alone | (F.col("length") < size)).select(F.when(alone, size - F.col("length")).otherwise(F.col("length")).alias("n"), F.when(alone, 0).otherwise(1).alias("kind"), F.col("uid").alias("id"))
    placements, opened, last = [], 0, 0
    while True:
        w = state.groupBy("kind", "n").count().collect()  # at most two rows a size
        wait = {r.n: r["count"] for r in w if r.kind == 1}
        if not wait:
            break
        least, need = min(wait), sum(n * c for n, c in wait.items())
        room = sum(r.n * r["count"] for r in w if r.kind == 0 and r.n >= least)
        stuck = last == sum(wait.values())
        fresh = -(-(need if stuck else max(0, need - room)) // size)
        new = spark.range(opened, opened + fresh).select(F.lit(size).cast("long").alias("n"), F.lit(0).alias("kind"), (-1 - F.col("id")).alias("id"))
        opened, last = opened + fresh, sum(wait.values())
        items = state.filter(F.col("n") >= least).union(new)
        counts = {(r.n, r.kind): r["count"] for r in w if r.n >= least}
        counts[size, 0] = counts.get((size, 0), 0) + fresh
        placed, after = one_round(items, counts, size)
        placements.append(placed)
        discard(state)
        state = after
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    out = pieces.filter(alone).select(*columns, F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if placements:
        at = functools.reduce(DataFrame.union, placements).select(F.col("id").alias("uid"), F.col("seq").alias("sequence_id"), "offset")
        out = out.union(pieces.filter(~alone).join(at, "uid").select(*columns, "sequence_id", "offset"))
    return out


def pack_documents(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", size: int = SEQUENCE) -> DataFrame:
    return pack(stash(cut_pieces(docs, vocabulary, text, key, size), "pieces"), size)


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
