"""An approximate index: inverted lists of the nearest of k centroids.

The centroids are fitted on a bounded sample (at most ``SAMPLE_ROWS`` rows, those with the least hashes
of their ids); every row is indexed. A search visits the ``probes`` lists whose centroids are nearest to
the query and ranks their rows exactly. A list may hold any share of the rows: within it rows are read
in batches like any others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import _FOUND, _FOUND_SCHEMA, _best, _point_chunks, nearest, top_k, unit_rows

SAMPLE_ROWS = 50_000
#: Queries of one pass.
QUERY_ROWS = 20_000


def fit_centroids(rows: DataFrame, k: int, iterations: int = 10, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(list_id int, centroid) from k-means on unit vectors of the sample; seeds are spread by distance."""
    got = rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0)).orderBy(F.xxhash64("id"), "id").select("vector").limit(sample_rows).toArrow().combine_chunks()
    schema = "list_id int, centroid array<double>"
    if not got.num_rows:
        return rows.sparkSession.createDataFrame([], schema)
    column = got.column("vector").combine_chunks()
    u, _ = unit_rows(column, int(np.asarray(column.value_lengths())[0]))
    rng, at = np.random.default_rng(7), [0]
    near = u @ u[0]
    for _ in range(min(k, len(u)) - 1):
        gap = np.maximum(1 - near, 0)
        at.append(int(rng.choice(len(u), p=gap / gap.sum())) if gap.sum() > 0 else int(rng.integers(len(u))))
        near = np.maximum(near, u @ u[at[-1]])
    c = u[at]
    for _ in range(iterations):
        own = (u @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, u)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        c = np.where(length > 0, np.divide(sums, length, out=np.zeros_like(sums), where=length > 0), c)
    return rows.sparkSession.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], schema)


def index(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """Every row of ``rows(id, vector)`` with the list_id of its nearest centroid."""
    return rows.join(nearest(rows, lists, "list_id").select("id", "list_id"), "id")


def search(queries: DataFrame, indexed: DataFrame, lists: DataFrame, k: int, probes: int, digits: int | None = None) -> DataFrame:
    """(query_id, id, similarity, rank): of the rows in the ``probes`` nearest lists of each query the k best.
    Rows of a query's own id are left out."""
    spark = queries.sparkSession
    tables = list(_point_chunks(lists, "list_id", None, 1 << 30))
    if not tables:
        return top_k(spark.createDataFrame([], _FOUND), k)
    dim, t = tables[0]
    names, c = np.asarray(t.column("list_id")), unit_rows(t.column("centroid").combine_chunks(), dim)[0]
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), "query").where(F.size("query") == dim)
    slices, parts = max(1, -(-q.count() // QUERY_ROWS)), []
    for number in range(slices):
        got = (q if slices == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == number)).toArrow().combine_chunks()
        if not got.num_rows:
            continue
        u = unit_rows(got.column("query").combine_chunks(), dim)[0]
        visit = np.argsort(-np.round(u @ c.T, 9), axis=1, kind="stable")[:, :probes]
        wanted = {int(names[j]): np.flatnonzero((visit == j).any(axis=1)) for j in np.unique(visit).tolist()}
        sent = spark.sparkContext.broadcast((np.asarray(got.column("query_id")), u, wanted))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, u, wanted = sent.value
            held = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
            for batch in batches:
                own, rows, v = np.asarray(batch.column("list_id")), np.asarray(batch.column("id")), unit_rows(batch.column("vector"), dim)[0]
                for j in np.unique(own).tolist():
                    mine, at = wanted.get(j, ()), np.flatnonzero(own == j)
                    if not len(mine):
                        continue
                    s = u[mine] @ v[at].T
                    s = s if digits is None else np.round(s, digits)
                    for i, score in zip(mine.tolist(), s, strict=True):
                        ok = rows[at] != ids[i]
                        both, who = np.concatenate([held[i][0], score[ok]]), np.concatenate([held[i][1], rows[at][ok]])
                        top = _best(both, who, k)
                        held[i] = (both[top], who[top])
            n = [len(x[1]) for x in held]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(np.concatenate([x[1] for x in held])), pa.array(np.concatenate([x[0] for x in held]))], schema=_FOUND_SCHEMA)

        # lists that no query of the slice visits are not read
        mine = indexed.where(F.col("list_id").isin(sorted(wanted))).select("list_id", F.col("id").cast("long").alias("id"), "vector")
        parts.append(mine.mapInArrow(run, _FOUND))
    found = parts[0] if parts else spark.createDataFrame([], _FOUND)
    for p in parts[1:]:
        found = found.unionByName(p)
    return top_k(found, k)
