"""Near-duplicate documents: MinHash bands give candidates, odd sketches screen them, full shingle sets confirm them.

A document's set is its distinct k-word shingles (64-bit hashes). BANDS bands of ROWS MinHash values each give buckets; at
similarity 0.8 a pair shares no bucket with probability (1 - 0.8**ROWS)**BANDS = 4e-8. Sets are named by 64 bits of their
digest, so documents with equal sets fall into one in every bucket. A task packs what it has for a part of the buckets
into one value, each bucket once: sets that share a bucket within the task leave it as links at once, so a bucket that
a third of all documents share is one entry a task, and all buckets travel in one shuffle. Buckets chain sets into
clusters (stars, no pairs), and each cluster's texts are compared block by block: the XOR of two odd sketches (parity
bitmaps of the MinHash samples) estimates the similarity, pairs more than five standard deviations below the
threshold are passed over, all others that are not yet connected are confirmed on their full sets. Only spanning links
leave a block. A cluster of more than BLOCK sets is cut into chunks, each with the cluster's first set; what a chunk does
not connect to that first set is compared with all other chunks of its cluster, in units of at most 2 * BLOCK sets.

Defined cases: null or empty text and text without words has an empty set and is linked with nothing; fewer than k words
make one shingle; rows that repeat id and text share a component, other texts under one id have the component of their
own set; rows with a null id are linked with nothing, have a null component and are kept; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, as_bytes, discard, free_name, mix, parts_for, stash, tidied
from .components import AT_ONCE, components, forest

BANDS, ROWS, SKETCH_BITS, BLOCK = 56, 6, 1024, 512
N = BANDS * ROWS
#: Documents whose buckets a task packs at once, and bucket entries that a task answers.
DOCS_AT_ONCE, ENTRIES_A_PART = 20_000, 2_000_000
_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 32, N, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, N, dtype=np.uint64).astype(np.uint32)
_SALT = _rng.integers(0, 1 << 64, N, dtype=np.uint64)
_C = _rng.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles."""
    ws = text.lower().split() if text else []
    if not ws:
        return np.zeros(0, np.uint64)
    ids = WORDS.array(ws)
    m = min(k, len(ids))
    h = np.full(len(ids) - m + 1, np.uint64(m))
    for j in range(m):
        h = mix(h * np.uint64(3) + ids[j : len(ids) - m + 1 + j] * _C[j % 64])
    return np.unique(h)


def minhash(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(N, np.uint32(0xFFFFFFFF))
    for at in range(0, len(x), 1 << 13):
        part = x[at : at + (1 << 13)]
        for i in range(0, N, 48):
            np.minimum(out[i : i + 48], (_A[i : i + 48, None] * part + _B[i : i + 48, None]).min(axis=1), out=out[i : i + 48])
    return out


def odd_sketch(mins: np.ndarray) -> np.ndarray:
    """Parity bitmap of the MinHash samples, as uint64 words."""
    at = mix(mins.astype(np.uint64) ^ _SALT) % np.uint64(SKETCH_BITS)
    bits = (np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.uint64)


def band_keys(mins: np.ndarray) -> np.ndarray:
    m = mins.reshape(BANDS, ROWS).astype(np.uint64)
    h = mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(77))
    for j in range(ROWS):
        h = mix(h * np.uint64(5) + m[:, j])
    return h.view(np.int64)


def most_odd_bits(num: int, den: int) -> int:
    """XOR bits beyond which a pair lies more than five standard deviations under the threshold."""
    j = num / den
    gone = N * (1 - j) + 5 * np.sqrt(N * j * (1 - j))
    mean = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * gone))
    return int(mean + 5 * np.sqrt(SKETCH_BITS / 16))


class Linker:
    """Confirms links inside a block of sets, up to what connects them."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.most = num, den, most_odd_bits(num, den)

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        if len(a) > len(b):
            a, b = b, a
        if self.den * len(a) < self.num * len(b):
            return False
        at = np.searchsorted(b, a)
        at[at == len(b)] = len(b) - 1
        both = int((b[at] == a).sum())
        return self.den * both >= self.num * (len(a) + len(b) - both)

    def links(self, sets: list[np.ndarray], sketches: np.ndarray, group: np.ndarray):
        """Spanning links (i, j) and the root of each set; sets with equal group >= 0 are known to be connected already."""
        n, found = len(sets), []
        root = np.arange(n)
        for g in np.unique(group[group >= 0]):
            same = np.flatnonzero(group == g)
            root[same] = same[0]
        sizes = np.array([len(s) for s in sets])
        for i in range(n):
            rest = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
            if not len(rest):
                continue
            lo, hi = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
            rest = rest[self.den * lo >= self.num * hi]
            if not len(rest):
                continue
            odd = np.bitwise_count(sketches[rest] ^ sketches[i]).sum(axis=1)
            near = np.flatnonzero(odd <= self.most)
            for j in rest[near[np.argsort(odd[near], kind="stable")]].tolist():
                if root[i] != root[j] and self.linked(sets[i], sets[j]):
                    root[root == root[j]] = root[i]
                    found.append((i, j))
        return found, root


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(id, text) -> id, n_shingles, and for sets that are not empty: setkey (digest), node (64 bits of it), bands, sketch."""

    def run(batches):
        for b in batches:
            n, key, node, bands, sketch = [], [], [], [], []
            for t in as_bytes(b.column(1)):
                s = shingles(t, k)
                n.append(len(s))
                if not len(s):
                    for c in (key, node, bands, sketch):
                        c.append(None)
                    continue
                mins = minhash(s)
                digest = set_digest(s)
                key.append(digest)
                node.append(int.from_bytes(digest[:8], "big", signed=True))
                bands.append(band_keys(mins).tobytes())
                sketch.append(odd_sketch(mins).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(node, pa.int64()), pa.array(bands, pa.binary()), pa.array(sketch, pa.binary())], names=["id", "n_shingles", "setkey", "node", "bands", "sketch"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(tidied(run), f"id {kind}, n_shingles long, setkey binary, node long, bands binary, sketch binary")


def set_digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def stars(bucket: np.ndarray, node: np.ndarray):
    """Of (bucket, node) entries: each bucket once, with its least node, and the links of its other nodes to that one."""
    order = np.lexsort((node, bucket))
    bucket, node = bucket[order], node[order]
    first = np.concatenate([[True], bucket[1:] != bucket[:-1]])
    heads = node[first]
    head = np.repeat(heads, np.diff(np.append(np.flatnonzero(first), len(node))))
    other = node != head
    return bucket[first], heads, np.unique(np.stack([node[other], head[other]], 1), axis=0)


def candidates(sig: DataFrame, parts: int) -> DataFrame:
    """Signatures -> links (u, v) of the nodes of each bucket to its least node."""

    def pack(batches):
        def out(nodes, bands):
            node, at = np.unique(np.concatenate(nodes), return_index=True)  # copies within the task count once
            bucket, node, links = stars(np.frombuffer(b"".join(bands), np.int64).reshape(-1, BANDS)[at].ravel(), np.repeat(node, BANDS))
            part = (mix(bucket.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, cells = part[order], np.stack([bucket, node], 1)[order]
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            packed = [cells[a:z].tobytes() for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(part)])]
            to, asks = part[cut].tolist(), [True] * len(cut)
            for i in range(0, len(links), 4096):  # links go anywhere
                to.append(int(links[i, 0] % parts))
                asks.append(False)
                packed.append(links[i : i + 4096].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(asks), pa.array(packed, pa.binary())], names=["part", "asks", "packed"])

        nodes, bands, size = [], [], 0
        for b in batches:
            nodes.append(b.column(0).to_numpy())
            bands += b.column(1).to_pylist()
            size += len(nodes[-1])
            if size >= DOCS_AT_ONCE:
                yield out(nodes, bands)
                nodes, bands, size = [], [], 0
        if size:
            yield out(nodes, bands)

    def answer(batches):
        def links(pairs):
            for i in range(0, len(pairs), AT_ONCE):
                yield pa.RecordBatch.from_arrays([*forest(pa.array(pairs[i : i + AT_ONCE, 0]), pa.array(pairs[i : i + AT_ONCE, 1]))], names=["u", "v"])

        cells, held = [], []
        for b in batches:
            for asks, packed in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                got = np.frombuffer(packed, np.int64).reshape(-1, 2)
                if asks:
                    cells.append(got)
                else:
                    held.append(got)
                    if sum(map(len, held)) >= AT_ONCE:
                        yield from links(np.concatenate(held))
                        held.clear()
        if cells:
            all_ = np.concatenate(cells)
            cells.clear()
            held.append(stars(all_[:, 0], all_[:, 1])[2])
        if held:
            yield from links(np.concatenate(held))

    sent = sig.select("node", "bands").mapInArrow(pack, "part int, asks boolean, packed binary")
    return sent.repartitionById(parts, F.col("part")).mapInArrow(tidied(answer), "u long, v long")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, text: str = "text", key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked id), one row per row of docs. Links: den * |a & b| >= num * |a | b|.
    The id may be of any type that has an order."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    sig = stash(signatures(rows, k), "signatures")
    named = sig.filter("setkey IS NOT NULL AND id IS NOT NULL")
    links = candidates(named, parts_for(sig.sparkSession, named.count() * BANDS, ENTRIES_A_PART))
    clusters = stash(components(links), "clusters")
    reps = stash(named.groupBy("setkey").agg(F.min(F.struct("id", "node", "sketch")).alias("r")).select("setkey", "r.*"), "sets")
    confirmed = verified(rows, clusters, reps, k, num, den, block)
    labels = components(confirmed.select("u", "v"))
    found = reps.join(labels, "id", "left").select("setkey", F.coalesce("label", "id").alias("component"))
    out = sig.select("id", "n_shingles", "setkey").join(found, "setkey", "left")
    discard(clusters)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def verified(rows: DataFrame, clusters: DataFrame, reps: DataFrame, k: int, num: int, den: int, block: int) -> DataFrame:
    """Spanning links (u, v) of ids, confirmed on full sets inside the clusters (id: node, label: least node)."""
    kind = rows.schema["id"].dataType.simpleString()
    sizes = clusters.groupBy("label").agg(F.count("*").alias("size"))
    nodes = clusters.join(sizes, "label").withColumnRenamed("id", "node").join(reps.select("id", "node", "sketch"), "node")
    # texts are the large side at any size; a hash of the few nodes of a partition spares their sorting
    placed = stash(rows.join(nodes.hint("shuffle_hash"), "id").select("id", "node", "label", "size", "sketch", "text"), "cluster-texts")
    chunks = F.when(F.col("size") > block, F.ceil(F.col("size") / block)).otherwise(F.lit(1)).cast("long")
    mine = F.when(F.col("node") == F.col("label"), F.sequence(F.lit(0).cast("long"), chunks - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), chunks)))
    units = placed.select("id", "node", "sketch", "text", "label", (F.col("size") > block).alias("large"), F.explode(mine).alias("c"))
    units = units.repartition("label", "c").sortWithinPartitions("label", "c", "node", "id")  # the label is the least node: it comes first

    def sets_of(batches, unit_at):
        """(unit, rows [(id, node, set, sketch, known)]) of rows that come sorted by unit. A node's own text is told from
        others under its id by its digest."""
        now, rows = None, []
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
            texts = as_bytes(b.column(3))
            for i, unit in enumerate(zip(*(cols[j] for j in unit_at))):
                if unit != now:
                    if rows:
                        yield now, rows
                    now, rows = unit, []
                s = shingles(texts[i], k)
                if len(s) and set_digest(s)[:8] == cols[1][i].to_bytes(8, "big", signed=True) and not any(r[0] == cols[0][i] and r[1] == cols[1][i] for r in rows[-1:]):
                    rows.append((cols[0][i], cols[1][i], s, np.frombuffer(cols[2][i], np.uint64), cols[4][i]))
        if rows:
            yield now, rows

    id_type = _arrow(rows, "id")

    def compare(batches):
        """Links of each unit; and of a large cluster's chunk the nodes with whether they hang on its first node."""
        link = Linker(num, den)
        for (label, _, large), rows in sets_of(batches, (4, 6, 5)):
            got, root = link.links([r[2] for r in rows], np.stack([r[3] for r in rows]), np.full(len(rows), -1))
            u, v = [rows[i][0] for i, _ in got], [rows[j][0] for _, j in got]
            if large and rows[0][1] != label:
                raise AssertionError("a chunk without the first node of its cluster")
            state = [(r[1], label, bool(root[i] == root[0])) for i, r in enumerate(rows)] if large else []
            none = [None] * len(state)
            yield pa.RecordBatch.from_arrays(
                [pa.array(u + none, id_type), pa.array(v + none, id_type), pa.array([None] * len(u) + [s[0] for s in state], pa.int64()), pa.array([None] * len(u) + [s[1] for s in state], pa.int64()), pa.array([None] * len(u) + [s[2] for s in state], pa.bool_())],
                names=["u", "v", "node", "label", "near"],
            )

    first = stash(units.select("id", "node", "sketch", "text", "label", "large", "c").mapInArrow(tidied(compare), f"u {kind}, v {kind}, node long, label long, near boolean"), "links")
    links = first.filter("u IS NOT NULL").select("u", "v")
    state = first.filter("node IS NOT NULL AND node <> label").select("node", "label", "near")
    counts = state.groupBy("label").agg(F.sum(F.col("near").cast("long")).alias("n1"), F.sum((~F.col("near")).cast("long")).alias("n0")).filter("n0 > 0")
    if not counts.take(1):
        discard(placed)
        return links
    open_ = state.join(counts, "label").withColumn("c0", F.ceil(F.col("n0") / block)).withColumn("c1", F.ceil(F.col("n1") / block))
    open_ = open_.withColumn("c", F.pmod(F.xxhash64("node"), F.when(F.col("near"), F.col("c1")).otherwise(F.col("c0"))))
    unit = lambda a, b, what: F.concat_ws(".", F.col("label").cast("string"), F.lit(what), a.cast("string"), b.cast("string"))
    zero = F.lit(0).cast("long")
    others = F.transform(F.sequence(zero, F.col("c0") - 1), lambda x: unit(F.least(x, F.col("c")), F.greatest(x, F.col("c")), "u"))
    beyond = F.when(F.col("c1") > 0, F.transform(F.sequence(zero, F.greatest(F.col("c1") - 1, zero)), lambda x: unit(F.col("c"), x, "n"))).otherwise(F.array().cast("array<string>"))
    near = F.transform(F.sequence(zero, F.col("c0") - 1), lambda x: unit(x, F.col("c"), "n"))
    at = open_.select("node", F.col("near").alias("known"), F.explode(F.when(F.col("near"), near).otherwise(F.concat(others, beyond))).alias("unit"))
    pairs = placed.select("id", "node", "sketch", "text").join(at.hint("shuffle_hash"), "node").select("id", "node", "sketch", "text", "known", "unit")

    def across(batches):
        link = Linker(num, den)
        for _, rows in sets_of(batches, (5,)):
            got, _ = link.links([r[2] for r in rows], np.stack([r[3] for r in rows]), np.where([r[4] for r in rows], 1, -1))
            yield pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i, _ in got], id_type), pa.array([rows[j][0] for _, j in got], id_type)], names=["u", "v"])

    more = stash(pairs.repartition("unit").sortWithinPartitions("unit", "node", "id").mapInArrow(tidied(across), f"u {kind}, v {kind}"), "links")
    discard(placed)
    return links.union(more)


def _arrow(df: DataFrame, column: str):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def op2_near_duplicates(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = near_duplicates(docs, k=4)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def row_name(key: str, text: str):
    """A name of a row's id and text that sorts by id first: the id's bytes, then a digest of the text."""
    by_id = F.unhex(F.lpad(F.hex(F.col(key).cast("long").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))), 16, "0"))
    return F.concat(by_id, F.unhex(F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("0" * 32))))


def keep_one(docs: DataFrame, k: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One document of each group stays (the smallest id); rows with a null id stay; a repeated row stays once. Other
    texts under one id are documents of their own."""
    name = free_name(docs.columns, "__name")
    named = docs.filter(F.col(key).isNotNull()).withColumn(name, row_name(key, text))
    groups = near_duplicates(named, k, text=text, key=name)
    first = groups.filter("doc_id = component_id").select(F.col("doc_id").alias(name))
    some = named.join(first.hint("shuffle_hash"), name, "left_semi").dropDuplicates([name]).drop(name)
    return some.unionByName(docs.filter(F.col(key).isNull())).select(*docs.columns)
