"""Similarity search: exact k nearest, thresholds, routing by centroid, re-ranking.

Cosines are inner products of unit vectors, taken for a batch of rows against a chunk of the other side
at once. A chunk has at most ``CHUNK_BYTES`` of vectors, so what is broadcast or held has a fixed bound;
a larger side is several chunks. Pairs within a group meet in pairs of blocks of ``BLOCK_ROWS`` rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import mean_abs

#: Bytes of the vectors of one chunk; rows of one block of a group.
CHUNK_BYTES, BLOCK_ROWS = 32 << 20, 2048
#: Rows of a batch that are multiplied at once.
BATCH_ROWS = 4096


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of unit length, which rows have ``dim`` components and no null): others, and zero vectors, are
    all zero, so their similarity is 0."""
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    ok = sizes == dim
    out = np.zeros((len(sizes), dim))
    if ok.all():
        flat = column.flatten()
        raw = np.asarray(flat.cast(pa.float64()).fill_null(np.nan)).reshape(-1, dim)
        out[:] = raw
    else:
        for i in np.flatnonzero(ok).tolist():
            out[i] = [np.nan if x is None else x for x in column[i].as_py()]
    ok &= np.isfinite(out).all(axis=1)
    out[~ok] = 0.0
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    np.divide(out, length, out=out, where=length > 0)
    return out, ok


def chunks(points: DataFrame, key: str, vector: str, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """(dimension, ids, vectors) of ``points``, by dimension, in chunks of at most about ``chunk_bytes``."""
    p = points.select(F.col(key).alias("_key"), F.col(vector).alias("_v")).where(F.col("_key").isNotNull())
    for r in p.groupBy(F.size("_v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy("d").collect():
        dim, rows = r["d"], max(1, chunk_bytes // (8 * max(1, r["d"] or 1)))
        if dim is None or dim < 1:
            continue
        mine, parts = p.where(F.size("_v") == dim), -(-r["n"] // rows)
        for k in range(parts):
            t = (mine if parts == 1 else mine.where(F.pmod(F.xxhash64("_key"), F.lit(parts)) == k)).toArrow().combine_chunks()
            if t.num_rows:
                yield dim, np.asarray(t.column("_key")), t.column("_v").combine_chunks()


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores, then smaller ids."""
    if len(score) > 4 * k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= floor)
    else:
        near = np.arange(len(score))
    return near[np.lexsort((ids[near], -score[near]))[:k]]


_FOUND = "query_id long, id long, similarity double"
_FOUND_SCHEMA = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("similarity", pa.float64())])


def scored(queries: DataFrame, rows: DataFrame, k: int | None = None, threshold: float | None = None, digits: int | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(query_id, id, similarity) of ``queries(query_id, query)`` against ``rows(id, vector)``: what reaches
    the threshold, and of each task's rows only the k best of each query. Vectors of unlike lengths, zero
    vectors and nulls have similarity 0."""
    names = rows.select(F.col("id").cast("long").alias("id"), "vector")
    spark, parts = rows.sparkSession, []
    for dim, ids, vectors in chunks(queries.select(F.col("query_id").cast("long").alias("query_id"), "query"), "query_id", "query", chunk_bytes):
        sent = spark.sparkContext.broadcast((ids, unit_rows(vectors, dim)[0]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, dim=dim) -> Iterator[pa.RecordBatch]:
            q_ids, q = sent.value
            held = [(np.zeros(0), np.zeros(0, np.int64))] * len(q_ids)
            for batch in batches:
                for lo in range(0, batch.num_rows, BATCH_ROWS):
                    part = batch.slice(lo, BATCH_ROWS)
                    ids, u = np.asarray(part.column("id")), unit_rows(part.column("vector"), dim)[0]
                    s = q @ u.T
                    if digits is not None:
                        s = np.round(s, digits)
                    near = ids[None, :] != q_ids[:, None]
                    if threshold is not None:
                        near &= s >= threshold
                    if k is None:
                        i, j = np.nonzero(near)
                        yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(ids[j]), pa.array(s[i, j])], schema=_FOUND_SCHEMA)
                        continue
                    for i in range(len(q_ids)):
                        at = np.flatnonzero(near[i])
                        if len(at):
                            at = at[_best(s[i, at], ids[at], k)]
                            score, who = np.concatenate([held[i][0], s[i, at]]), np.concatenate([held[i][1], ids[at]])
                            top = _best(score, who, k)
                            held[i] = (score[top], who[top])
            if k is not None:
                n = [len(x[1]) for x in held]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, n)), pa.array(np.concatenate([x[1] for x in held])), pa.array(np.concatenate([x[0] for x in held]))], schema=_FOUND_SCHEMA)

        parts.append(names.mapInArrow(run, _FOUND))
    if not parts:
        return spark.createDataFrame([], _FOUND)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scored_pairs(queries: DataFrame, rows: DataFrame, blocks: int | None = None) -> DataFrame:
    """All pairs of ``scored``; ``blocks``: in how many chunks the queries go (else by their bytes)."""
    if not blocks:
        return scored(queries, rows)
    total = queries.agg(F.sum(F.size("query") * 8)).first()[0] or 0
    return scored(queries, rows, chunk_bytes=max(1, total // blocks))


def knn(queries: DataFrame, rows: DataFrame, k: int, threshold: float | None = None, digits: int | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(query_id, id, similarity, rank): each query's k best rows; ties to the smaller id."""
    return top_k(scored(queries, rows, k, threshold, digits, chunk_bytes), k)


def top_k(pairs: DataFrame, k: int, threshold: float | None = None, digits: int | None = None) -> DataFrame:
    """(query_id, id, similarity, rank): each query's k best; ties to the smaller id. The limit is taken
    in every task before the shuffle."""
    p = pairs if threshold is None else pairs.where(F.col("similarity") >= threshold)
    if digits is not None:
        p = p.withColumn("similarity", F.round("similarity", digits))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return p.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def merge_results(results: DataFrame, k: int) -> DataFrame:
    """Results of several partitions: the best similarity of each id, then the k best of each query."""
    return top_k(results.groupBy("query_id", "id").agg(F.max("similarity").alias("similarity")), k)


def neural_rerank(results: DataFrame, weights: DataFrame) -> DataFrame:
    """similarity * (0.8 + 0.2 * mean |w|) for rows of ``weights(id, neural_weights)``, ranked anew."""
    j = results.drop("rank").join(weights, "id", "left")
    s = F.when(F.col("neural_weights").isNull(), F.col("similarity")).otherwise(F.col("similarity") * (0.8 + 0.2 * mean_abs("neural_weights")))
    r = j.withColumn("similarity", s).drop("neural_weights")
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")))


def pairs_within(rows: DataFrame, group: str, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(group, id_a, id_b, similarity), id_a < id_b: pairs of a group at or above the threshold.

    A group's rows are dealt into blocks by hash, and each pair of blocks is one product of matrices: a
    task holds two blocks however large the group is, and emits what reaches the threshold."""
    r = rows.select(group, F.col("id").cast("long").alias("id"), "vector")
    n = r.groupBy(F.col(group).alias("_g")).agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("long").alias("_c"))
    j = r.join(n, F.col(group) == F.col("_g")).drop("_g")
    j = j.withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_c"))).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_c") - 1)))
    j = j.withColumn("_unit", F.least("_own", "_o") * F.col("_c") + F.greatest("_own", "_o")).select(group, "_unit", "_own", "_c", "id", "vector")
    kind = dict(rows.dtypes)[group]

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, own, col = np.asarray(t.column("id")), np.asarray(t.column("_own")), t.column("vector").combine_chunks()
        low, high = divmod(t.column("_unit")[0].as_py(), t.column("_c")[0].as_py())
        sizes, a, b, s = np.asarray(col.value_lengths().fill_null(-1)), [], [], []
        for dim in np.unique(sizes[sizes > 0]).tolist():
            at = np.flatnonzero(sizes == dim)
            u, _ = unit_rows(col.take(pa.array(at)), dim)
            who, x, y = ids[at], np.flatnonzero(own[at] == low), np.flatnonzero(own[at] == high)
            score = u[x] @ u[y].T
            i, k = np.nonzero((score >= threshold) & (who[x][:, None] != who[y][None, :]))
            i, k, score = x[i], y[k], score[i, k]
            a.append(np.minimum(who[i], who[k]))
            b.append(np.maximum(who[i], who[k]))
            s.append(score)
        if not a or not sum(map(len, a)):
            return pa.table({group: t.column(group).slice(0, 0), "id_a": pa.array([], pa.int64()), "id_b": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        a, b, s = np.concatenate(a), np.concatenate(b), np.concatenate(s)
        _, first = np.unique(np.stack([a, b]), axis=1, return_index=True)  # a block against itself finds a pair twice
        return pa.table({group: pa.array([t.column(group)[0].as_py()] * len(first), t.column(group).type), "id_a": a[first], "id_b": b[first], "similarity": s[first]})

    return j.groupBy(group, "_unit").applyInArrow(run, f"`{group}` {kind}, id_a long, id_b long, similarity double")


def centroids(rows: DataFrame, group: str, vector: str = "vector") -> DataFrame:
    """(group, centroid, n): the mean of each component; one partial aggregate by group and place."""
    e = rows.select(group, F.posexplode(vector).alias("pos", "x")).groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count(F.lit(1)).alias("n"))
    return e.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"), F.max("n").alias("n"))


_NEAR = "id long, place int, similarity double"


def nearest(rows: DataFrame, points: DataFrame, key: str, threshold: float | None = None, same: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, key, similarity): the nearest of ``points(key, centroid)`` for each row, the smaller key on
    ties; not above the threshold the key is null (the row asks for a partition of its own). With ``same``
    only points of the row's value in that column count; rows without a point are left out."""
    keys, parts = points.schema[key].dataType, []
    for dim, t in _point_chunks(points, key, same, chunk_bytes):
        sent = rows.sparkSession.sparkContext.broadcast((unit_rows(t.column("centroid").combine_chunks(), dim)[0], t.column("same").to_pylist()))
        names = t.column(key).to_pylist()
        number = rows.sparkSession.createDataFrame([(i, k) for i, k in enumerate(names)], f"place int, `{key}` {keys.simpleString()}")

        def run(batches: Iterator[pa.RecordBatch], sent=sent, dim=dim) -> Iterator[pa.RecordBatch]:
            u, kinds = sent.value
            of = {s: np.array([i for i, x in enumerate(kinds) if x == s]) for s in set(kinds)}
            for batch in batches:
                ids, s = np.asarray(batch.column("id")), unit_rows(batch.column("vector"), dim)[0] @ u.T
                own, best, place = batch.column("same").to_pylist(), np.full(len(ids), -np.inf), np.full(len(ids), -1, np.int32)
                for kind, at in of.items():
                    mine = np.array([x == kind for x in own], bool)
                    if mine.any():
                        part = s[np.ix_(mine, at)]
                        top = part.argmax(axis=1)
                        best[mine], place[mine] = part[np.arange(len(part)), top], at[top]
                has = place >= 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(place[has]), pa.array(best[has])], names=["id", "place", "similarity"])

        r = rows.select(F.col("id").cast("long").alias("id"), "vector", (F.col(same).cast("string") if same else F.lit("")).alias("same"))
        parts.append(r.mapInArrow(run, _NEAR).join(F.broadcast(number), "place").select("id", key, "similarity"))  # a chunk's rows
    if not parts:
        best = rows.limit(0).select(F.col("id").cast("long").alias("id"), F.lit(None).cast(keys).alias(key), F.lit(None).cast("double").alias("similarity"))
    else:
        best = parts[0]
        for p in parts[1:]:
            best = best.unionByName(p)
        if len(parts) > 1:
            best = best.groupBy("id").agg(F.max_by(F.struct(key, "similarity"), F.struct("similarity", -F.col(key))).alias("b")).select("id", "b.*")
    return best if threshold is None else best.withColumn(key, F.when(F.col("similarity") > threshold, F.col(key)))


def _point_chunks(points: DataFrame, key: str, same: str | None, chunk_bytes: int) -> Iterator[tuple[int, pa.Table]]:
    """Tables (key, centroid, same) of points in the order of their keys, of at most about ``chunk_bytes``."""
    p = points.select(key, "centroid", (F.col(same).cast("string") if same else F.lit("")).alias("same")).where(F.col(key).isNotNull())
    for r in p.groupBy(F.size("centroid").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy("d").collect():
        rows = max(1, chunk_bytes // (8 * max(1, r["d"] or 1)))
        if r["d"] is None or r["d"] < 1:
            continue
        mine, parts = p.where(F.size("centroid") == r["d"]), -(-r["n"] // rows)
        for k in range(parts):
            t = (mine if parts == 1 else mine.where(F.pmod(F.xxhash64(key), F.lit(parts)) == k)).toArrow().combine_chunks()
            if t.num_rows:
                yield r["d"], t.sort_by(key)


def route(queries: DataFrame, points: DataFrame, key: str, kind: str, threshold: float, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(query_id, key): the partitions of a type that a query must visit; a query without a vector (a
    text) visits all of them."""
    p = points.where(F.col("type") == kind)
    keys, spark, parts = p.schema[key].dataType.simpleString(), queries.sparkSession, []
    for dim, t in _point_chunks(p, key, None, chunk_bytes):
        sent = spark.sparkContext.broadcast(unit_rows(t.column("centroid").combine_chunks(), dim)[0])
        number = spark.createDataFrame(list(enumerate(t.column(key).to_pylist())), f"place int, `{key}` {keys}")

        def run(batches: Iterator[pa.RecordBatch], sent=sent, dim=dim) -> Iterator[pa.RecordBatch]:
            u = sent.value
            for batch in batches:
                ids, text = np.asarray(batch.column("query_id")), np.asarray(batch.column("query").is_null())
                i, j = np.nonzero((unit_rows(batch.column("query"), dim)[0] @ u.T > threshold) | text[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(j.astype(np.int32))], names=["query_id", "place"])

        got = queries.select(F.col("query_id").cast("long").alias("query_id"), "query").mapInArrow(run, "query_id long, place int")
        parts.append(got.join(F.broadcast(number), "place").select("query_id", key))
    if not parts:
        return spark.createDataFrame([], f"query_id long, `{key}` {keys}")
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
