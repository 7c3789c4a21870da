"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _least_neighbours(pairs: DataFrame) -> DataFrame:
    """(u, m): the smallest neighbour of u. Staged, so that the join with it has an exchange of its
    own on each side and adaptive execution can split a hot u."""
    return staged(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``: component is the smallest node reachable.

    Works on the edge table alone: nothing is collected. Every round is written to the shared
    folder. Rows with a null end and loops are ignored; an empty edge table gives an empty result.
    """
    e = edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    e = staged(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = lambda t: t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least_neighbours(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = staged(large, "large")
        least = _least_neighbours(large)
        small = large.join(least, "u").where("v <> m").select("v", F.col("m").alias("w"))
        small = small.select(F.greatest("v", "w").alias("u"), F.least("v", "w").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = staged(small.distinct(), "edges")
        after = mark(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links a[i] - b[i] (ids): for every id but the smallest of its group, (id, smallest)."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]
