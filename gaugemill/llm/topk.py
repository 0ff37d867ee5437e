"""Exact top-k inner products by columnar branch and bound.

Components become integers floor(256 * x). The queries go to all tasks in rounds of at most ROUND components, which is the size of what is
broadcast; in a round every task scans its own candidates where they lie, block by block in vertical layout (dimension by dimension), so no
candidate is ever shuffled. Scores grow block of dimensions by block of dimensions. After each, a candidate stays only if for
some query of the block its score so far, plus the product of the norms that both have left (Cauchy-Schwarz), can reach that query's bound;
the survivors are compacted before the next dimensions are read. A query's bound is its k-th best score so far: a
few candidates are scored first to begin with, and a task carries it from block to block. Each task gives at
most k rows for a query, of those that reach the first bound, and a grouped aggregation merges them.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part. Only vectors of equal length are
compared. A query's own row is told by its id, so rows that repeat a query's id are never its candidates; a repeated
query id is answered from its first row (the smallest vector), and repeated candidates each take a rank. Null ids are
candidates of no query and no queries themselves. Ties go to the smaller id. An empty table gives an empty result.
Sums are exact: in doubles while they stay below 2**53, otherwise in Python integers. Ranks follow the exact scores; a score
beyond the range of a long is given as the nearest long. Extra columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugemill.llm.common import materialize, table, tidy

TOP = 5
QUERY_BLOCK = 64
DIMENSIONS = 8
EVERY = 50
#: Components of the queries of one round: 16 MB as doubles.
ROUND = 1 << 21
#: Candidates that give the first bounds.
FIRST = 2048
LONG = 2**63 - 1


def taking_part(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, v (array of doubles) of the rows that take part."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    ok = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(ok & F.col("vec_id").isNotNull()).select("vec_id", F.size("embedding").alias("dim"), wide.alias("v"))


def quantised(v: np.ndarray) -> np.ndarray:
    """floor(256 * x): doubles where these are exact, else Python integers (dtype object)."""
    if np.abs(v).max(initial=0) < 2**44:
        return np.floor(v * 256.0)
    whole = lambda x: math.floor(x * 256) if abs(x) < 2**44 else int(x) * 256
    return np.array([[whole(x) for x in row] for row in v.tolist()], dtype=object).reshape(v.shape)


def integers(a: np.ndarray) -> np.ndarray:
    return a if a.dtype == object else np.array([[int(x) for x in row] for row in a.tolist()], dtype=object).reshape(a.shape)


class Queries:
    """The queries of one dimension, dimension-major, with the norms of what is left after each block of dimensions."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, step: int) -> None:
        self.ids, self.data, self.step = ids, np.ascontiguousarray(quantised(v).T), step
        self.exact = self.data.dtype == object
        self.largest = 0 if self.exact else np.abs(self.data).max(initial=0)
        self.left = None if self.exact else left_norms(self.data, step)


def left_norms(data: np.ndarray, step: int) -> np.ndarray:
    """Norm of each column from each block of dimensions on, rounded up."""
    starts = np.arange(0, data.shape[0], step)
    return np.sqrt(np.add.reduceat(data**2, starts, axis=0)[::-1].cumsum(axis=0)[::-1]) * (1 + 1e-12)


class Best:
    """The k best of each query so far: places of queries, ids, scores; and the bound that a candidate has to reach."""

    def __init__(self, k: int, bound: np.ndarray) -> None:
        self.k, self.bound = k, bound.copy()
        self.query, self.id, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if score.dtype == object and self.bound.dtype != object:
            self.score = np.array([int(x) for x in self.score], object)
            self.bound = np.array([x if math.isinf(x) else int(x) for x in self.bound.tolist()], object)
        if score.dtype != object and self.bound.dtype == object:
            score = np.array([int(x) for x in score], object)
        q, i, s = np.concatenate((self.query, query)), np.concatenate((self.id, ids)), np.concatenate((self.score, score))
        order = np.array(sorted(range(q.size), key=lambda j: (q[j], -s[j], i[j])), np.int64) if s.dtype == object else np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        rank = np.arange(q.size) - np.searchsorted(q, q)
        keep = rank < self.k
        self.query, self.id, self.score = q[keep], i[keep], s[keep]
        last = np.flatnonzero(rank[keep] == self.k - 1)
        self.bound[self.query[last]] = np.maximum(self.bound[self.query[last]], self.score[last])


def scan(q: Queries, best: Best, ids: np.ndarray, v: np.ndarray, block: int = QUERY_BLOCK) -> None:
    """Take the candidates ids, v (rows) into the best of each query."""
    data = np.ascontiguousarray(quantised(v).T)
    exact = q.exact or data.dtype == object or float(q.largest) * float(np.abs(data).max(initial=0)) * len(data) >= 2**53
    step = len(data) if exact else q.step
    left = None if exact else left_norms(data, step)
    for at in range(0, q.ids.size, block):
        mine = slice(at, at + block)
        queries, candidates = (integers(x) if exact else x for x in (q.data[:, mine], data))
        alive = np.arange(ids.size)
        score = queries[:step].T.dot(candidates[:step])
        for b in range(step, len(data), step):
            reach = score + q.left[b // step][mine][:, None] * left[b // step][alive][None, :]
            keep = (reach >= best.bound[mine][:, None]).any(axis=0)
            alive, score = alive[keep], score[:, keep]
            if not alive.size:
                break
            score = score + queries[b : b + step].T.dot(candidates[b : b + step][:, alive])
        x, y = np.nonzero((score >= best.bound[mine][:, None]) & (q.ids[mine][:, None] != ids[alive][None, :]))
        if x.size:
            best.add(x + at, ids[alive[y]], score[x, y])


def beyond(score: int) -> str | None:
    """For a score that is no long: a text that sorts among such as the score does."""
    if -LONG - 1 <= score <= LONG:
        return None
    digits = str(abs(score))
    if score > 0:
        return f"1{len(digits):05d}{digits}"
    return f"0{99999 - len(digits):05d}{digits.translate(str.maketrans('0123456789', '9876543210'))}"


def scanned(vectors: DataFrame, sent) -> DataFrame:
    """query_id, vec_id, score, beyond: the best of each task among vectors; sent: dimension -> (Queries, Best to begin with)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Best] = {}
        for batch in batches:
            ids, dims = batch.column("vec_id").to_numpy(), batch.column("dim").to_numpy()
            flat, starts = batch.column("v").flatten().to_numpy(), np.cumsum(dims) - dims
            for dim in np.unique(dims).tolist():
                if dim in sent.value:
                    q, first = sent.value[dim]
                    of = np.flatnonzero(dims == dim)
                    best = found.setdefault(dim, Best(first.k, first.bound))
                    scan(q, best, ids[of], flat[starts[of][:, None] + np.arange(dim)])
        for dim, best in found.items():
            scores = [int(x) for x in best.score]
            columns = [pa.array(sent.value[dim][0].ids[best.query]), pa.array(best.id), pa.array([max(-LONG - 1, min(LONG, x)) for x in scores], pa.int64()), pa.array([beyond(x) for x in scores], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score", "beyond"])

    return vectors.mapInArrow(tidy(work), "query_id long, vec_id long, score long, beyond string")


def first_bounds(q: Queries, k: int, sample: list) -> Best:
    """Bounds from some of the candidates; they are candidates again afterwards."""
    best = Best(k, np.full(q.ids.size, -np.inf))
    rows = [r for r in sample if r.dim == len(q.data)]
    if rows:
        scan(q, best, np.array([r.vec_id for r in rows], np.int64), np.array([r.v for r in rows], np.float64))
    return Best(k, best.bound)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP, step: int = DIMENSIONS, round_: int = ROUND, first: int = FIRST) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries(vec_id, embedding) the k best of vectors(vec_id, embedding)."""
    spark, candidates = vectors.sparkSession, taking_part(vectors)
    q = F.transform("v", lambda x: F.floor(x * 256.0))  # only to choose among rows of one id
    asked = taking_part(queries).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.struct("dim", q.alias("q"), "v")).alias("x")).select("vec_id", "x.dim", "x.v")
    asked = materialize(asked, "topk-queries")
    total, widest = asked.agg(F.sum("dim"), F.max("dim")).first()
    rounds = -(-(total or 0) // round_)
    sample = candidates.take(max(k + 1, min(first, 64 * first // widest))) if rounds else []  # bounded by 64 * first components
    found = []
    for r in range(rounds):
        mine = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == r).toArrow().combine_chunks()  # about round_ components
        ids, dims, flat = mine["vec_id"].to_numpy(), mine["dim"].to_numpy(), mine["v"].combine_chunks().flatten().to_numpy() if len(mine) else np.empty(0)
        starts, by_dim = np.cumsum(dims) - dims, {}
        for dim in np.unique(dims).tolist():
            of = np.flatnonzero(dims == dim)
            of_dim = Queries(ids[of], flat[starts[of][:, None] + np.arange(dim)], step)
            by_dim[dim] = (of_dim, first_bounds(of_dim, k, sample))
        sent = spark.sparkContext.broadcast(by_dim)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.when(F.col("score") > 0, F.col("beyond")).desc_nulls_last(), F.col("beyond").desc_nulls_first(), "vec_id"))
        best = scanned(candidates.withColumn("vec_id", F.col("vec_id").cast("long")), sent).withColumn("rank", rank).where(F.col("rank") <= k)
        found.append(materialize(best.select("query_id", "rank", "vec_id", "score"), "topk-round"))
        sent.destroy()
    out = found[0] if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


OP8_SQL = """
WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
