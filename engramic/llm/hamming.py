"""Links between fingerprints that share a bucket key, verified exactly by Hamming distance.

The key tables come from a caller (segment-count cells or permuted blocks). A bucket of more than
``UNIT_ROWS`` rows is dealt out as pairs of chunks, so that no task ever holds more than two chunks
of one key however hot it is; within a unit the links are found without emitting all pairs. A lower
bound of the distance that is cheaper to join by, if the caller has one, is taken first. Where a key
alone makes a link (``equal_links``), each row is linked to the least of its key: no pairs at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import popcount, record_batch, salted, spread, staged
from .components import local_forest

#: Rows of one bucket that one chunk holds; a unit of work has one chunk or a pair of chunks.
UNIT_ROWS = 4096
#: Buckets of up to so many rows are compared together by shifts; larger ones by a search of their own.
SMALL = 48
#: Cells that rows are counted in before keys are.
CELLS = 1 << 14
#: Hot keys are broadcast up to so many rows; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 100_000


def hot_keys(rows: DataFrame, unit_rows: int, cells: int = CELLS) -> DataFrame:
    """(key, table, _n, _least) of the keys with more than ``unit_rows`` rows: their number and least id.

    Rows are first counted by cells of many keys, which leaves a few rows of each task to shuffle; only
    the keys of cells with that many rows can be hot, and are counted themselves.
    """
    cell = F.pmod(F.xxhash64("key", "table"), F.lit(cells))
    full = staged(rows.groupBy(cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > unit_rows).select("_cell"), "cells")
    suspects = rows.select("key", "table", "id", cell.alias("_cell")).join(F.broadcast(full), "_cell", "left_semi")  # cells rows at most
    return staged(suspects.groupBy("key", "table").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_least")).where(F.col("_n") > unit_rows), "hot")


def equal_links(rows: DataFrame, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """Edges (u, v) that connect all ids of ``rows(key, table, id)`` that share a key of a table: each to
    the key's least id. Work and edges are linear in the rows; a hot key's least id is joined to its
    rows wherever they are, so they never meet in one task."""
    rows = rows.select("key", "table", "id")
    hot = hot_keys(rows, unit_rows)
    n = hot.count()
    few = hot.select("key", "table", "_least")
    few = F.broadcast(few) if n <= BROADCAST_ROWS else few
    cold = rows.join(few, ["key", "table"], "left_anti") if n else rows
    # windows of at most unit_rows rows
    least = F.min("id").over(Window.partitionBy("key", "table"))
    edges = cold.withColumn("v", least).select(F.col("id").alias("u"), "v")
    if n:
        edges = edges.unionByName(rows.join(few, ["key", "table"]).select(F.col("id").alias("u"), F.col("_least").alias("v")))
    return edges.where("u <> v")


def deal_units(rows: DataFrame, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """``rows(key, table, id, ...)`` with a column ``unit``: 0, or for hot keys one row for each pair
    of chunks that the row's chunk takes part in."""
    hot = hot_keys(rows, unit_rows)
    n = hot.count()
    if not n:
        return rows.withColumn("unit", F.lit(0).cast("long"))
    dealt = rows.join(F.broadcast(hot) if n <= BROADCAST_ROWS else hot, ["key", "table"], "left")
    chunks = F.greatest(F.lit(1), F.ceil(F.coalesce("_n", F.lit(0)) / unit_rows)).cast("long")
    own = salted(F.col("key"), F.coalesce("_n", F.lit(0)), unit_rows, F.col("id"))
    dealt = dealt.withColumn("_c", chunks).withColumn("_own", own).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_c") - 1)))
    return dealt.withColumn("unit", F.least("_own", "_o") * F.col("_c") + F.greatest("_own", "_o")).drop("_n", "_least", "_c", "_own", "_o")


class Metric:
    """Fingerprints (a column for each 64-bit word) under the Hamming distance. ``embed`` maps them to
    a grid and ``bound`` gives a distance there that is never above the Hamming distance: it is taken
    first, and only what it leaves is compared bit by bit."""

    def __init__(self, fp: np.ndarray, radius: int, embed: Callable | None = None, bound: Callable | None = None):
        self.fp, self.radius, self.bound = fp, radius, bound
        self.grid = embed(fp) if embed else None

    def rows(self, at) -> Metric:
        out = Metric(self.fp[at], self.radius)
        out.grid, out.bound = None if self.grid is None else self.grid[at], self.bound
        return out

    def near(self, i, j: np.ndarray) -> np.ndarray:
        """Which of the rows j are within the radius of row i (or of the rows i, one by one)."""
        if self.grid is None:
            return self._within(i, j)
        out = self.bound(self.grid[i], self.grid[j]) <= self.radius
        some = np.flatnonzero(out)
        out[some] = self._within(i if np.isscalar(i) else i[some], j[some])
        return out

    def _within(self, i, j: np.ndarray) -> np.ndarray:
        x, y = self.fp[i], self.fp[j]
        d = popcount(x[..., 0] ^ y[..., 0]).astype(np.int16)
        for k in range(1, y.shape[-1]):
            d = d + popcount(x[..., k] ^ y[..., k])
        return d <= self.radius


def small_pairs(metric: Metric, resident: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of positions i < j within runs; end[i]: where the run of i ends."""
    at, d = np.arange(len(resident)), 1
    while True:
        at = at[at + d < end[at]]
        if not len(at):
            return
        pair = at[resident[at] | resident[at + d]]
        hit = pair[metric.near(pair, pair + d)]
        if len(hit):
            yield hit, hit + d
        d += 1


def search(metric: Metric, resident: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of one bucket: each found row is compared only with rows not yet
    reached, so that a bucket full of near copies takes about one pass."""
    left, a, b = np.arange(len(resident)), [], []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = metric.near(i, left)
            if not resident[i]:
                hit &= resident[left]
            if hit.any():
                got = left[hit]
                a.append(np.full(len(got), i))
                b.append(got)
                queue += got.tolist()
                left = left[~hit]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold whole runs of (key, table, unit) from batches sorted by them."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        k, b, u = (t.column(c).to_numpy() for c in ("key", "table", "unit"))
        change = np.flatnonzero((k[1:] != k[:-1]) | (b[1:] != b[:-1]) | (u[1:] != u[:-1]))
        cut = int(change[-1]) + 1 if len(change) else 0
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest


def _forest_of(words: list[str], radius: int, embed: Callable | None, bound: Callable | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_runs(batches):
            k, b, u, ids = (t.column(c).to_numpy() for c in ("key", "table", "unit", "id"))
            metric = Metric(np.stack([t.column(w).to_numpy().view(np.uint64) for w in words], axis=1), radius, embed, bound)
            resident = t.column("resident").to_numpy(zero_copy_only=False)
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (b[1:] != b[:-1]) | (u[1:] != u[:-1])])
            begin = np.flatnonzero(new)
            size = np.diff(np.concatenate([begin, [len(k)]]))
            end = np.repeat(begin + size, size)
            is_small = np.repeat(size <= SMALL, size)
            keep = np.flatnonzero(is_small & np.repeat(size > 1, size))
            pos = np.cumsum(np.concatenate([[0], is_small & (np.repeat(size > 1, size))]))
            a, c = [], []
            for i, j in small_pairs(metric.rows(keep), resident[keep], pos[end[keep]]):
                a.append(ids[keep[i]])
                c.append(ids[keep[j]])
            for s, n in zip(begin[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
                i, j = search(metric.rows(slice(s, s + n)), resident[s : s + n])
                a.append(ids[s + i])
                c.append(ids[s + j])
            if a and sum(map(len, a)):
                one, two = local_forest(np.concatenate(a), np.concatenate(c))
                yield record_batch({"u": one, "v": two}, schema)

    return run


def linked(rows: DataFrame, words: list[str], radius: int, unit_rows: int = UNIT_ROWS, embed: Callable | None = None, bound: Callable | None = None) -> DataFrame:
    """Edges (u, v) of ids whose fingerprints differ in at most ``radius`` bits, of the pairs that share
    a bucket: enough of them that they connect all that is linked there.

    ``rows``: key long, table int, id long, resident boolean, and the fingerprint's 64-bit words. Two
    rows of a bucket are compared where at least one is resident. ``embed`` and ``bound``: see ``Metric``.
    """
    dealt = deal_units(rows, unit_rows).repartition(spread(rows.sparkSession), "key", "table", "unit").sortWithinPartitions("key", "table", "unit")
    return dealt.mapInArrow(_forest_of(words, radius, embed, bound), "u long, v long")
