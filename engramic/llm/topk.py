"""Exact top-k inner products by norm-bucketed retrieval.

The vectors are dealt out in ranges of descending length (norm); a task splits its range into
buckets. A query carries a threshold, its k-th best score so far, that starts from the products with
the longest vectors of all. For a bucket the threshold becomes a local cosine threshold: theta
divided by the query's length and the bucket's greatest. Above 1 the bucket is pruned for the query
(length pruning); above ``COORDINATE_FROM`` only vectors whose coordinate on the query's strongest
axis lies in the range that the threshold allows remain (coordinate pruning); what remains is
verified by exact integer products. Queries are broadcast in slices of at most ``SLICE_BYTES``, one
pass over the vectors for each slice; a slice's results are written and its broadcast is dropped
before the next, so what is held has a fixed bound. A task keeps k rows of each query of a slice.

Components are integers held as doubles, which hold every floor(scale * x) exactly. Where all partial
sums of a bucket are below 2 to the 53rd, products in doubles are exact; beyond it products select
candidates within their rounding error, and Python integers decide.

Defined results: vectors that are null, empty, or hold null or non-finite components (also after
scaling) take no part; a query meets the vectors of its own dimension; rows with a null vec_id are no
queries and no candidates; of equal scores the smaller vec_id ranks first; every row other than the
query's vec_id is a candidate, repeated rows each count; a query that stands in several rows is
answered once for its first by components; fewer than k candidates give as many ranks; a score among
the k best that a 64-bit integer can't hold raises OverflowError; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import record_batch, spread, staged

K, SCALE = 10, 1024
#: Bytes of the queries of one pass, candidates that seed the thresholds, vectors of one bucket.
SLICE_BYTES, SEEDS, BUCKET = 32 << 20, 4096, 2048
#: Local cosine threshold from which coordinates are looked at before products are taken.
COORDINATE_FROM = 0.8
#: Sums of products below it are exact in doubles.
EXACT = 2.0**53
_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantized(vectors: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, q array<double>, dim, norm2) of the rows that take part; q holds whole numbers."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col(column), lambda v: v.cast("double") * scale).alias("x"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    x = x.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)).where(~bad)
    # from 2 to the 53rd on every double is whole; floor() would go through a 64-bit integer
    q = x.select("vec_id", F.transform("x", lambda v: F.when(F.abs(v) < EXACT, F.floor(v).cast("double")).otherwise(v)).alias("q"))
    return q.select("vec_id", "q", F.size("q").alias("dim"), F.aggregate("q", F.lit(0).cast("double"), lambda s, v: s + v * v).alias("norm2"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, dim)


def _lengths(m: np.ndarray) -> np.ndarray:
    """Euclidean lengths of the rows, without overflow."""
    top = np.abs(m).max(axis=1)
    unit = np.divide(m, top[:, None], out=np.zeros_like(m), where=top[:, None] > 0)
    return top * np.sqrt((unit * unit).sum(axis=1))


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores, then smaller ids."""
    if len(score) > 4 * k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= floor)
    else:
        near = np.arange(len(score))
    return near[np.lexsort((ids[near], -score[near]))[:k]]


class Queries:
    """A slice of queries with their running k best."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.norm, self.most = _lengths(q), np.abs(q).max(axis=1)
        self.axis = np.abs(q).argmax(axis=1)
        self.floor = floor.copy()
        #: of each query the k best (score, vec_id) that were visited
        self.best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(ids)

    def visit(self, ids: np.ndarray, v: np.ndarray, norm: np.ndarray) -> None:
        """Takes the vectors of one bucket in."""
        top = float(norm.max())
        bound = self.norm * top
        live = np.flatnonzero(bound * (1 + 1e-9) >= self.floor)  # length pruning
        cosine = np.divide(self.floor[live], bound[live], out=np.full(len(live), -1.0), where=bound[live] > 0)
        sharp, vast = cosine >= COORDINATE_FROM, np.abs(v).max() * self.most[live] * v.shape[1] >= EXACT
        for i in live[sharp | vast].tolist():
            near = np.arange(len(ids))
            if self.floor[i] > 0 and self.floor[i] >= COORDINATE_FROM * bound[i] > 0:
                c, f = min(1.0, self.floor[i] / (self.norm[i] * top)), self.q[i, self.axis[i]] / self.norm[i]
                slack = np.sqrt(max(0.0, 1 - c * c)) * np.sqrt(max(0.0, 1 - f * f)) + 1e-9
                unit = np.divide(v[:, self.axis[i]], norm, out=np.zeros(len(norm)), where=norm > 0)
                # of vectors with cosine c or more the coordinate lies in [c f - slack, c f + slack], or nearer the query
                near = np.flatnonzero((unit >= c * f - slack) if f >= 0 else (unit <= c * f + slack))
            if len(near):
                self._take(i, ids[near], v[near] @ self.q[i], v[near])
        rows = live[~(sharp | vast)]
        for lo in range(0, len(rows), 512):
            part = rows[lo : lo + 512]
            scores = v @ self.q[part].T
            for j, i in enumerate(part.tolist()):
                self._take(i, ids, scores[:, j], v)

    def _take(self, i: int, ids: np.ndarray, s: np.ndarray, v: np.ndarray) -> None:
        exact = np.abs(v).max() * self.most[i] * v.shape[1] < EXACT
        # what rounding may have moved a product by
        off = 0.0 if exact else 2.0**-50 * v.shape[1] * self.most[i] * float(np.abs(v).max()) * v.shape[1]
        near = np.flatnonzero((s >= self.floor[i] - off) & (ids != self.ids[i]))
        if not len(near):
            return
        if exact:
            got = near[best_of(s[near], ids[near], self.k)]
            score, vec = s[got].astype(np.int64), ids[got]
        else:
            if len(near) > self.k:
                floor = np.partition(s[near], len(near) - self.k)[len(near) - self.k]
                near = near[s[near] >= floor - 2 * off]
            own = [int(x) for x in self.q[i].tolist()]
            score, vec = np.array([sum(a * int(b) for a, b in zip(own, v[r].tolist(), strict=True)) for r in near.tolist()], object), ids[near]
        if self.best[i] is not None:
            score, vec = np.concatenate([self.best[i][0], score]), np.concatenate([self.best[i][1], vec])
        if score.dtype == object:
            order = np.array(sorted(range(len(vec)), key=lambda r: (-score[r], vec[r]))[: self.k])
        else:
            order = np.lexsort((vec, -score))[: self.k]
        self.best[i] = (score[order], vec[order])
        if len(order) == self.k:
            self.floor[i] = max(self.floor[i], np.nextafter(float(score[order[-1]]), -np.inf))

    def found(self) -> pa.RecordBatch:
        has = [i for i, b in enumerate(self.best) if b is not None]
        score = [int(s) for i in has for s in self.best[i][0]]
        if any(not -(2**63) <= s < 2**63 for s in score):
            raise OverflowError("a score of the k best exceeds 64 bits")
        number = [len(self.best[i][1]) for i in has]
        vec = np.concatenate([self.best[i][1] for i in has]) if has else np.zeros(0, np.int64)
        return record_batch({"query_id": np.repeat(self.ids[has], number) if has else vec, "vec_id": vec, "score": score}, _OUT)


def _first_floors(ids: np.ndarray, q: np.ndarray, seed_ids: np.ndarray, seed: np.ndarray, k: int) -> np.ndarray:
    """A lower bound of each query's k-th best score, from its products with the seeds."""
    floor = np.full(len(ids), -np.inf)
    off = 2.0**-50 * q.shape[1] ** 2 * float(np.abs(q).max()) * float(np.abs(seed).max())
    off = off if off >= 1 else 0.0  # smaller sums of whole numbers are exact
    for lo in range(0, len(ids), 1024):
        s = q[lo : lo + 1024] @ seed.T
        s[ids[lo : lo + 1024][:, None] == seed_ids[None, :]] = -np.inf
        if s.shape[1] >= k:
            floor[lo : lo + 1024] = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - off
    return floor


def _top_of_dimension(every: DataFrame, queries: DataFrame, dim: int, k: int, slice_rows: int) -> DataFrame:
    """(query_id, vec_id, score): of each task's vectors the k best of each query."""
    spark = every.sparkSession
    seeds = every.orderBy(F.desc("norm2"), "vec_id").limit(SEEDS).select("vec_id", "q").toArrow().combine_chunks()  # SEEDS rows
    seed_ids, seed = np.asarray(seeds.column("vec_id")), _matrix(seeds.column("q").combine_chunks(), dim)
    ranged = staged(every.repartitionByRange(spread(spark), F.desc("norm2"), "vec_id").sortWithinPartitions(F.desc("norm2"), "vec_id").select("vec_id", "q"), "by-length")
    slices = max(1, -(-queries.count() // slice_rows))
    parts = []
    for number in range(slices):
        mine = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(slices)) == number) if slices > 1 else queries
        t = mine.select("vec_id", "q").toArrow().combine_chunks()  # about slice_rows rows
        if not t.num_rows:
            continue
        ids, q = np.asarray(t.column("vec_id")), _matrix(t.column("q").combine_chunks(), dim)
        order = np.argsort(ids)
        ids, q = ids[order], q[order]
        sent = spark.sparkContext.broadcast((ids, q, _first_floors(ids, q, seed_ids, seed, k)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            state = None
            for batch in batches:
                state = state or Queries(*sent.value, k)
                vec, m = np.asarray(batch.column("vec_id")), _matrix(batch.column("q"), dim)
                norm = _lengths(m)
                for lo in range(0, len(vec), BUCKET):
                    cut = slice(lo, lo + BUCKET)
                    state.visit(vec[cut], m[cut], norm[cut])
            if state is not None:
                yield state.found()

        found = ranged.mapInArrow(run, "query_id long, vec_id long, score long")
        if slices > 1:
            found = staged(found, "slice")
            sent.destroy()
        parts.append(found)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = K, column: str = "embedding", scale: int = SCALE, query_slice: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows. ``query_slice``: queries of one
    pass, else as many as ``SLICE_BYTES`` hold."""
    spark = vectors.sparkSession
    every = staged(quantized(vectors, column, scale), "quantized")
    queries = staged(every.where(is_query).groupBy("vec_id").agg(F.min(F.struct("q", "dim")).alias("q")).select("vec_id", "q.q", "q.dim"), "queries")
    # a table has one dimension as a rule; each further one is a search of its own
    dims = [r["dim"] for r in queries.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect()]
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = None
    for dim in dims:
        part = _top_of_dimension(every.where(F.col("dim") == dim), queries.where(F.col("dim") == dim), dim, k, query_slice or max(1, SLICE_BYTES // (8 * dim)))
        found = part if found is None else found.unionByName(part)
    # k rows of each query and task: ranked by a window that takes its limit before the exchange
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
