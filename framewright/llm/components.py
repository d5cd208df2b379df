"""Connected components by alternating large-star and small-star rounds, all in Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash

#: Edges that a task contracts at once.
AT_ONCE = 1_000_000


def forest(u, v):
    """Arrow arrays of edge ends -> (nodes, least nodes that these edges connect them to), without nodes that are their own."""
    u, v = (pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x for x in (u, v))
    codes = pa.concat_arrays([u, v]).dictionary_encode()
    names = codes.dictionary
    order = pc.sort_indices(names)
    rank = np.empty(len(names), np.int64)
    rank[order.to_numpy()] = np.arange(len(names))
    ends = rank[codes.indices.to_numpy()]
    a, z = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(names))
    while True:
        ra, rz = root[a], root[z]
        apart = ra != rz
        if not apart.any():
            break
        a, z, ra, rz = a[apart], z[apart], ra[apart], rz[apart]
        np.minimum.at(root, np.maximum(ra, rz), np.minimum(ra, rz))
        while (far := root[root] != root).any():
            root[far] = root[root[far]]
    names = names.take(order)
    other = np.flatnonzero(root != np.arange(len(root)))
    return names.take(pa.array(other)), names.take(pa.array(root[other]))


def contracted(edges: DataFrame) -> DataFrame:
    """Each task's edges as stars: as many edges at most as it has nodes, and the same components."""

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= AT_ONCE:
                yield out(held)
                held, size = [], 0
        if size:
            yield out(held)

    def out(held):
        t = pa.Table.from_batches(held)
        return pa.RecordBatch.from_arrays([*forest(t.column(0), t.column(1))], names=["u", "v"])

    return edges.mapInArrow(run, edges.schema)


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v), in any direction -> (id, label): label is the smallest id reachable. Ids without edges are absent,
    and so are edges with a null end."""
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    e = stash(contracted(e.distinct()), "cc")
    mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(e)
    while True:
        # large star: what is larger than u goes to the smallest neighbour of u
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours of u, and u, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("u", "m")).distinct()
        new = stash(small, "cc")
        discard(e)
        e, now = new, mark(new)
        if now == before:
            return e.select(F.col("u").alias("id"), F.col("v").alias("label")).union(e.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
        before = now
