"""Exact top-k inner products without random access (NRA).

Each dimension of a block of candidates is a sorted list. For a query, list d is read from its largest product on: from
the top where the query's component is positive, from the bottom where it is negative. Rounds read all lists of a block
to the next depth together. What has been read gives each candidate a lower bound (read components plus the list minimum
for unread ones) and an upper bound (the last value read for unread ones). When a candidate's upper bound falls below a
query's k-th lower bound it is out for that query; candidates that are out for all queries and queries without open
candidates are read no further, and the scores of what is still open after the last round are resolved. Both bounds are
sums over dimensions of clipped values, so a round is a few matrix products for all queries of a block.

Candidates travel as packed blocks, queries as smaller ones; each query block meets each candidate block once and keeps
k rows from it. Defined cases: vectors that are null or hold null or non-finite components take no part; shorter vectors count as ending
in zeros, an empty one as zeros alone; ties go to the smaller id; a candidate with the query's id is its own row and
skipped; repeated candidate rows are candidates of their own, a repeated query id is asked once, with the least of its
vectors; fewer candidates than k give fewer rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = (16, 8, 4, 2)  # parts of its depth to which a block is read before what is open is resolved
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 4096


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Packs (id, v) rows into rows (n, dim, ids, data) of at most `size` vectors, without a shuffle."""

    def run(batches):
        def out(ids, vs):
            dim = max(map(len, vs))
            m = np.zeros((len(vs), dim), np.int64)
            for i, v in enumerate(vs):
                m[i, : len(v)] = v
            return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int32()), pa.array([dim], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], names=["n", "dim", "ids", "data"])

        ids, vs = [], []
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                vs.append(v)
                if len(ids) == size:
                    yield out(ids, vs)
                    ids, vs = [], []
        if ids:
            yield out(ids, vs)

    return rows.mapInArrow(run, "n int, dim int, ids binary, data binary")


def marks(x: np.ndarray, order: np.ndarray, depth: int):
    """Of each list: the last value read from its upper and its lower end at `depth`, its least and its greatest value."""
    cols = np.arange(x.shape[1])
    return x[order[len(x) - depth], cols], x[order[depth - 1], cols], x[order[0], cols], x[order[-1], cols]


def bounds(q: np.ndarray, x: np.ndarray, at):
    """Lower and upper scores of every (query, candidate) when each list is read to its marks."""
    top, bottom, least, most = at
    pos, neg = np.maximum(q, 0), np.minimum(q, 0)
    upper = pos @ np.maximum(x, top).T + neg @ np.minimum(x, bottom).T
    lower = pos @ np.where(x >= top, x, least).T + neg @ np.where(x <= bottom, x, most).T
    return lower, upper


def read(qids, q, x, own: dict, k: int, floor: np.ndarray):
    """Reads a block's lists in rounds: (queries with open candidates, candidates open for any, which are open for each).
    A candidate is out for a query once its upper bound is below the query's k-th lower bound, and read no further once
    it is out for all. `floor` is raised in place."""
    n = len(x)
    live, cols = np.arange(len(qids)), np.arange(n)
    opened = np.ones((len(qids), n), bool)
    order = np.argsort(x, axis=0, kind="stable")
    for part in ROUNDS:
        lower, upper = bounds(q[live], x[cols], marks(x, order, max(1, n // part)))
        for a, i in enumerate(live.tolist()):
            for j in own.get(int(qids[i]), ()):
                lower[a, cols == j] = upper[a, cols == j] = -np.inf
        kth = np.partition(lower, len(cols) - k, axis=1)[:, len(cols) - k] if len(cols) >= k else np.full(len(live), -np.inf)
        np.maximum(floor[live], kth, out=kth)
        floor[live] = kth
        opened &= upper >= kth[:, None]
        some, still = opened.any(axis=1), opened.any(axis=0)  # queries that no outsider can reach; candidates out for all
        live, cols, opened = live[some], cols[still], opened[np.ix_(some, still)]
        if not len(live):
            break
    return live, cols, opened


def search(qids, q, cids, x, k: int, floor: np.ndarray):
    """Top k of one candidate block for each query: rows (query index, candidate index, score). `floor` holds each
    query's k-th best score so far; it is raised in place."""
    n = len(cids)
    dim = max(q.shape[1], x.shape[1])
    q, x = (np.pad(m, ((0, 0), (0, dim - m.shape[1]))) for m in (q, x))
    big = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * dim
    kind = np.float32 if big < 1 << 24 else np.float64 if big < 1 << 53 else object
    q, x = q.astype(kind), x.astype(kind)
    own = {}
    for j, c in enumerate(cids.tolist()):
        own.setdefault(c, []).append(j)
    live, cols = np.arange(len(qids)), np.arange(n)
    opened = None
    if kind is not object:
        live, cols, opened = read(qids, q, x, own, k, floor)
        if not len(live):
            return
    full = q[live].dot((x if len(cols) == n else x[cols]).T)  # resolves the open ones
    if opened is not None:
        full[~opened] = -np.inf
    for a, i in enumerate(live.tolist()):
        s, t = full[a], floor[i]
        at = np.flatnonzero(s >= t)
        if (mine := own.get(int(qids[i]))) is not None:
            at = at[~np.isin(cols[at], mine)]
        best = sorted(range(len(at)), key=lambda z: (-s[at[z]], cids[cols[at[z]]])) if kind is object else np.lexsort((cids[cols[at]], -s[at]))
        at = at[best[:k]]
        if len(at) == k:
            floor[i] = max(t, s[at[-1]])
        yield i, cols[at], s[at]


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """Both inputs: id long, v array<long>. Returns query_id, rank, vec_id, score."""
    from .common import stash

    qb = stash(blocks(queries.groupBy("id").agg(F.min("v").alias("v")).repartition(max(1, -(-queries.count() // QUERY_BLOCK))), QUERY_BLOCK).withColumn("qb", F.expr("uuid()")), "topk-queries")
    names = sorted(r.qb for r in qb.select("qb").collect())  # one id for each QUERY_BLOCK queries
    if not names:
        return candidates.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cb = blocks(candidates, CANDIDATE_BLOCK).withColumn("qb", F.explode(F.array(*map(F.lit, names))))
    pairs = cb.join(qb.select("qb", F.col("n").alias("qn"), F.col("dim").alias("qdim"), F.col("ids").alias("qids"), F.col("data").alias("qdata")), "qb")

    def run(batches):
        floors: dict[str, np.ndarray] = {}
        for b in batches:
            for r in b.to_pylist():
                qids, cids = np.frombuffer(r["qids"], np.int64), np.frombuffer(r["ids"], np.int64)
                q = np.frombuffer(r["qdata"], np.int64).reshape(r["qn"], r["qdim"])
                x = np.frombuffer(r["data"], np.int64).reshape(r["n"], r["dim"])
                if len(floors) > 64:
                    floors.clear()
                floor = floors.setdefault(r["qb"], np.full(len(qids), -np.inf))
                out = list(search(qids, q, cids, x, k, floor))
                if out:
                    who = np.concatenate([np.full(len(c), qids[i]) for i, c, _ in out])
                    yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(cids[np.concatenate([c for _, c, _ in out])]), pa.array([int(v) for _, _, s in out for v in s], pa.int64())], names=["query_id", "vec_id", "score"])

    found = pairs.select("qb", "qn", "qdim", "qids", "qdata", "n", "dim", "ids", "data").mapInArrow(run, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id, v: floor(64 * component) of every whole vector of finite components."""
    d = F.col(column).cast("array<double>")
    fine = d.isNotNull() & F.forall(d, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vectors.filter(fine & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.transform(d, lambda x: F.floor(x * 64)).alias("v"))


def op1_exact_top_k(spark, sf_dir: str) -> DataFrame:
    from .common import table

    v = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(v, v.filter("id % 20 = 0"), 20)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(coalesce(list_sum([p[1] * p[2] FOR p IN list_zip(a.q, b.q)]), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
