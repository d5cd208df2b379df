"""Long repeats, exactly: what the two substring operators share.

A document is a sequence of symbols (words or bytes). A window is `width` consecutive symbols; it is repeated if an equal
one starts anywhere else. A cutter chooses for each window an anchor from the window's own content, so equal windows have
equal anchors at equal places. Neighbouring windows with one anchor are an occurrence: its core lies inside each of
its windows, its full extent is their union. Then, in Spark:

1. A core that occurs once holds no repeated window. Each task sends its cores packed, by hash bucket; a core that it holds
   several times is known to be shared, so it sends one marker and the occurrences go past the buckets: a passage that a
   third of all documents hold is one entry a task.
2. A full extent that occurs twice makes all its windows repeated.
3. One occurrence of each distinct extent of a shared core (ends of repeats, edits) is compared with the others of its
   core, window by window; a core with more than GROUP distinct extents is compared by rows of single windows.
4. The runs of repeated windows of each document are joined back to its text.

Extents are named by two 64-bit hashes, of their core and of the whole; windows by that of their core and their own. A
document is named by two hashes of its id and text (doc, twin): rows that repeat both share their runs. Buckets and joins
have as many parts as the bytes of all texts ask for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PrefixHash, as_bytes, discard, mix, parts_for, stash, tidied

#: Extents of one core that a task compares at once.
GROUP = 2048
#: Bytes of text whose occurrences go to one part of a shuffle.
PART_BYTES = 16 << 20

_KIND = np.dtype([("core", "u8"), ("full", "u8"), ("doc", "i8"), ("twin", "i8"), ("at", "i4"), ("n", "i4"), ("anchor", "i4"), ("many", "i4")])
_OCC = "doc long, twin long, at int, n int, anchor int, core long, full long"


class Cutter:
    """What an operator gives: symbols of a text, and anchors of a row of concatenated documents."""

    width: int
    symbols_at_once: int
    compared_at_once = 200_000  # symbols of contexts

    def repeated(self, group):
        """(rows, starts) of the windows of some contexts (doc, at, n, anchor, context, core, twin) that occur several times.
        The contexts of a core come together."""
        row, at, key = windows(self, group)
        # Windows are compared within a core; its hash is part of the key.
        key = mix(key ^ np.array([r[5] for r in group], np.int64).view(np.uint64)[row])
        order = np.argsort(key, kind="stable")
        k = key[order]
        edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        hit = order[np.repeat(np.diff(np.append(edge, len(k))) > 1, np.diff(np.append(edge, len(k))))]
        return row[hit], at[hit]

    def symbols(self, text: bytes | None) -> np.ndarray:  # uint64
        raise NotImplementedError

    def anchors(self, sym: np.ndarray, ph: PrefixHash, starts: np.ndarray, windows: np.ndarray):
        """For each window start: (core start, core end); for windows without anchor the window itself."""
        raise NotImplementedError


def windows(cutter: Cutter, group):
    """(row, window start, hash of window and its place) of all windows of some contexts."""
    w = cutter.width
    syms = [cutter.unpack(r[4]) for r in group]
    sizes = np.array([len(s) for s in syms])
    ph = PrefixHash(np.concatenate(syms))
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    n = np.array([r[2] for r in group])
    row = np.repeat(np.arange(len(group)), n)
    j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    lo = base[row] + j
    at = np.array([r[1] for r in group])[row] + j
    place = np.array([r[3] for r in group])[row] - at
    return row, at, mix(ph.range(lo, lo + w) ^ mix(place.astype(np.uint64) + np.uint64(11)))


def extent(ph: PrefixHash, at, n, anchor, width):
    return mix(ph.range(at, at + n - 1 + width) ^ mix((anchor - at).astype(np.uint64) << np.uint64(32) | n.astype(np.uint64)))


def cut(cutter: Cutter, docs: list[tuple[int, int]], syms: list[np.ndarray]) -> np.ndarray:
    """The occurrences of some documents."""
    w = cutter.width
    sizes = np.array([len(s) for s in syms])
    keep = sizes >= w
    docs, sizes = np.array(docs, np.int64).reshape(-1, 2)[keep], sizes[keep]
    if not len(docs):
        return np.zeros(0, _KIND)
    sym = np.concatenate([s for s, k in zip(syms, keep) if k])
    ph = PrefixHash(sym)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    windows = np.repeat(starts, sizes - w + 1) + np.arange((sizes - w + 1).sum()) - np.repeat(np.concatenate([[0], np.cumsum(sizes - w + 1)[:-1]]), sizes - w + 1)
    a, z = cutter.anchors(sym, ph, starts, windows)
    new = np.ones(len(windows), bool)
    new[1:] = (a[1:] != a[:-1]) | (z[1:] != z[:-1]) | (windows[1:] != windows[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(windows)))
    at, a, z = windows[first], a[first], z[first]
    d = np.searchsorted(starts, at, "right") - 1
    out = np.zeros(len(first), _KIND)
    out["core"], out["full"] = ph.range(a, z), extent(ph, at, n, a, w)
    out["doc"], out["twin"] = docs[d].T
    out["at"], out["n"], out["anchor"] = at - starts[d], n, a - starts[d]
    return out


def shared_occurrences(docs: DataFrame, cutter: Cutter, parts: int, label: str) -> DataFrame:
    """docs (doc, twin, text) -> the occurrences whose core occurs anywhere else."""

    def emit(batches):
        def out(ids, syms):
            occ = cut(cutter, ids, syms)
            if not len(occ):
                return
            occ = occ[np.argsort(occ["core"], kind="stable")]
            edge = np.flatnonzero(np.concatenate([[True], occ["core"][1:] != occ["core"][:-1]]))
            times = np.diff(np.append(edge, len(occ)))
            here = np.repeat(times > 1, times)
            local, sent = occ[here], occ[edge]
            sent["many"] = times > 1
            bucket = (mix(sent["core"]) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            sent, bucket = sent[order], bucket[order]
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            ends = np.append(cuts[1:], len(sent))
            b = bucket[cuts].tolist()
            packed = [sent[x:y].tobytes() for x, y in zip(cuts.tolist(), ends.tolist())]
            for i in range(0, len(local), 4096):
                b.append(int(mix(local["full"][i : i + 1] ^ local["doc"][i : i + 1].view(np.uint64))[0] % np.uint64(parts)))  # anywhere
                packed.append(local[i : i + 4096].tobytes())
            kind = [True] * len(cuts) + [False] * (len(b) - len(cuts))
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(kind), pa.array(packed, pa.binary())], names=["bucket", "asks", "packed"])

        ids, syms, size = [], [], 0
        for batch in batches:
            for *d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
                s = cutter.symbols(t)
                if len(s) < cutter.width:
                    continue
                ids.append(d)
                syms.append(s)
                size += len(s)
                if size >= cutter.symbols_at_once:
                    yield from out(ids, syms)
                    ids, syms, size = [], [], 0
        if ids:
            yield from out(ids, syms)

    def rows(occ):
        for i in range(0, len(occ), 100_000):
            o = occ[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(o[c]) for c in ("doc", "twin", "at", "n", "anchor")] + [pa.array(o[c].view(np.int64)) for c in ("core", "full")], names=["doc", "twin", "at", "n", "anchor", "core", "full"])

    def answer(batches):
        asked = []
        for b in batches:
            for asks, packed in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                occ = np.frombuffer(packed, _KIND)
                if asks:
                    asked.append(occ)
                else:
                    yield from rows(occ.copy())
        if asked:
            occ = np.concatenate(asked)
            asked.clear()
            order = np.argsort(occ["core"], kind="stable")
            core = occ["core"][order]
            edge = np.flatnonzero(np.concatenate([[True], core[1:] != core[:-1]]))
            times = np.diff(np.append(edge, len(core)))
            occ = occ[order[np.repeat(times > 1, times)]]
            yield from rows(occ[occ["many"] == 0])  # markers have gone past the buckets already

    sent = docs.mapInArrow(tidied(emit), "bucket long, asks boolean, packed binary")
    return stash(sent.repartition(parts, "bucket").mapInArrow(tidied(answer), _OCC), label + "-shared")


def spread(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """Into `parts` parts by the keys, where the session's own number is too small."""
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def repeated_runs(docs: DataFrame, cutter: Cutter, parts: int, label: str) -> DataFrame:
    """docs (doc, twin, text) -> (doc, twin, runs array<struct<at,n>>): the repeated windows of each document that has any."""
    w = cutter.width
    name = ["doc", "twin"]
    occ = shared_occurrences(docs, cutter, parts, label)
    kinds = stash(occ.groupBy("core", "full").agg(F.count("*").alias("times"), F.min(F.struct(*name, "at", "n", "anchor")).alias("one")), label + "-extents")
    sure = occ.join(kinds.filter("times > 1").select("core", "full"), ["core", "full"], "left_semi").select(*name, "at", "n")
    cores = kinds.groupBy("core").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    todo = kinds.join(cores, "core").select("core", "kinds", "one.*")
    todo = stash(todo.groupBy(*name).agg(F.collect_list(F.struct("core", "kinds", "at", "n", "anchor")).alias("todo")), label + "-todo")

    def contexts(batches):
        for b in batches:
            out = [[] for _ in range(8)]
            for d, twin, t, runs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), b.column(3).to_pylist()):
                s = cutter.symbols(t)
                for r in runs:
                    part = s[r["at"] : r["at"] + r["n"] - 1 + w]
                    for c, v in zip(out, (r["core"], r["kinds"], d, r["at"], r["n"], r["anchor"], cutter.pack(part), twin)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64()))], names=["core", "kinds", "doc", "at", "n", "anchor", "context", "twin"])

    found = spread(docs, parts, *name).join(todo, name).select(*name, "text", "todo").mapInArrow(tidied(contexts), "core long, kinds long, doc long, at int, n int, anchor int, context binary, twin long")
    found = stash(found, label + "-contexts")

    def runs_of(docs, at):
        if not len(at):
            return
        order = np.lexsort((at, docs[:, 1], docs[:, 0]))
        docs, at = docs[order], at[order]
        new = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]).any(axis=1) | (at[1:] != at[:-1] + 1)]))
        n = np.diff(np.append(new, len(at)))
        yield pa.RecordBatch.from_arrays([*map(pa.array, docs[new].T.copy()), pa.array(at[new], pa.int32()), pa.array(n, pa.int32())], names=["doc", "twin", "at", "n"])

    def compare(batches):
        group, symbols = [], 0

        def out():
            row, at = cutter.repeated(group)
            yield from runs_of(np.array([(r[0], r[6]) for r in group], np.int64).reshape(-1, 2)[row], at)

        now = None
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(7))):
                if r[5] != now:  # whole cores only
                    if symbols > cutter.compared_at_once:
                        yield from out()
                        group, symbols = [], 0
                    now = r[5]
                group.append(r)
                symbols += r[2] + w
        if group:
            yield from out()

    def single(batches):
        for b in batches:
            group = list(zip(*(b.column(i).to_pylist() for i in range(7))))
            for i in range(0, len(group), 1000):
                part = group[i : i + 1000]
                row, at, key = windows(cutter, part)
                core, docs = np.array([r[5] for r in part], np.int64)[row], np.array([(r[0], r[6]) for r in part], np.int64)[row]
                # A window that this task holds several times is known to be repeated; one of its rows asks for the others.
                order = np.lexsort((core, key))
                core, docs, at, key = core[order], docs[order], at[order], key[order]
                asks = np.concatenate([[True], (key[1:] != key[:-1]) | (core[1:] != core[:-1])])
                sure = ~asks
                sure[:-1] |= sure[1:]
                yield pa.RecordBatch.from_arrays([*map(pa.array, docs.T.copy()), pa.array(at, pa.int32()), pa.array(core), pa.array(key.view(np.int64)), pa.array(sure), pa.array(asks)], names=["doc", "twin", "at", "core", "key", "sure", "asks"])

    cols = ["doc", "at", "n", "anchor", "context", "core", "twin"]
    few = found.filter(F.col("kinds") <= GROUP).select(*cols).repartition(parts, "core").sortWithinPartitions("core").mapInArrow(tidied(compare), "doc long, twin long, at int, n int")
    many = found.filter(F.col("kinds") > GROUP).select(*cols).mapInArrow(tidied(single), "doc long, twin long, at int, core long, key long, sure boolean, asks boolean")
    many = stash(many, label + "-windows")
    again = many.filter("asks").groupBy("core", "key").agg(F.count("*").alias("c")).filter("c > 1").select("core", "key")
    open_ = many.filter("NOT sure").join(again, ["core", "key"], "left_semi")
    many = many.filter("sure").select(*name, "at").union(open_.select(*name, "at")).withColumn("n", F.lit(1))
    runs = sure.union(few).union(many).groupBy(*name).agg(F.collect_set(F.struct("at", "n")).alias("runs"))
    runs = stash(runs, label + "-runs")
    for x in (occ, kinds, todo, found):
        discard(x)
    return runs


def covered(n: int, width: int, runs) -> np.ndarray:
    """Mask of the symbols that the windows of (at, n) runs cover."""
    d = np.zeros(n + 1, np.int32)
    for r in runs:
        d[r["at"]] += 1
        d[min(n, r["at"] + r["n"] - 1 + width)] -= 1
    return np.cumsum(d[:-1]) > 0


def names(key: Column, text: Column) -> list[Column]:
    return [F.xxhash64(key, text).alias("doc"), F.xxhash64(F.lit("twin"), text, key).alias("twin")]


def with_runs(docs: DataFrame, cutter: Cutter, label: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs plus __runs (null where nothing repeats)."""
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    parts = parts_for(docs.sparkSession, size, PART_BYTES)
    name = names(F.col(key).cast("string"), F.col(text))
    runs = repeated_runs(docs.filter(F.col(text).isNotNull()).select(*name, F.col(text).alias("text")), cutter, parts, label)
    whole = docs.select(*name, F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    return spread(whole, parts, "doc", "twin").join(runs, ["doc", "twin"], "left").select("row.*", F.col("runs").alias("__runs"))
