"""The life cycle of partitions: assignment within capacity, splits, merges, rebalancing.

A partition's name is a string; the halves of a split add a digit to it, a merge takes the least name
of what it joins. Everything is a keyed table: members(id, type, vector, partition_id) and
parts(partition_id, type, centroid, size).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import euclidean
from ..params import Partitions
from ..scratch import staged
from .clusters import imbalanced, merge_targets
from .search import centroids, nearest

P = Partitions()


def partition_table(members: DataFrame) -> DataFrame:
    """(partition_id, type, centroid, size)."""
    kinds = members.groupBy("partition_id").agg(F.min("type").alias("type"), F.count(F.lit(1)).alias("size"))
    return centroids(members, "partition_id").drop("n").join(kinds, "partition_id")


def assign(rows: DataFrame, parts: DataFrame, p: Partitions = P) -> DataFrame:
    """``rows(id, type, vector)`` with partition_id, similarity and created: the most similar partition of
    the type that has room and is more similar than the threshold, else a new one named by the row."""
    room = parts.where(F.col("size") < p.max_size)
    near = nearest(rows, room, "partition_id", p.similarity, same="type")
    j = rows.join(near, "id", "left")
    own = F.concat(F.lit("new_"), F.col("id").cast("string"))
    return j.withColumn("created", F.col("partition_id").isNull()).withColumn("partition_id", F.coalesce("partition_id", own))


def split_oversize(members: DataFrame, max_size: int = P.max_size) -> DataFrame:
    """``members`` with every partition above ``max_size`` in two: seeds are the member of the least id and
    the one farthest from it, and each member goes to the nearer seed (the first on ties)."""
    big = members.groupBy("partition_id").agg(F.count(F.lit(1)).alias("_n"), F.min_by("vector", "id").alias("_one")).where(F.col("_n") > max_size).drop("_n")
    own = members.join(big, "partition_id")
    far = own.withColumn("_d", euclidean("vector", "_one")).groupBy("partition_id").agg(F.max_by("vector", F.struct("_d", -F.col("id"))).alias("_two"))
    own = own.join(far, "partition_id")
    side = F.when(euclidean("vector", "_one") <= euclidean("vector", "_two"), "0").otherwise("1")
    halves = own.withColumn("partition_id", F.concat("partition_id", F.lit("."), side)).select(*members.columns)
    return members.join(big, "partition_id", "left_anti").select(*members.columns).unionByName(halves)


def merge_undersize(members: DataFrame, min_size: int = P.min_size, similarity: float = P.similarity, small: DataFrame | None = None) -> DataFrame:
    """``members`` with every partition below ``min_size`` (or of ``small(partition_id)``) joined to the most
    similar other one of its type, if that is more similar than the threshold. Partitions that are joined
    through others become one, named by the least of them."""
    parts = staged(partition_table(members), "parts")
    small = parts.where(F.col("size") < min_size).select("partition_id") if small is None else small
    targets = merge_targets(_numbered(parts).select(F.col("n").alias("partition_id"), "type", "centroid"), similarity)
    names = staged(_numbered(parts).select("n", "partition_id"), "names")
    edges = targets.join(names.select(F.col("n"), F.col("partition_id").alias("a")), targets["partition_id"] == F.col("n")).drop("n")
    edges = edges.join(names.select(F.col("n"), F.col("partition_id").alias("b")), F.col("target") == F.col("n")).select("a", "b")
    edges = edges.join(small.select(F.col("partition_id").alias("a")), "a", "left_semi")
    both = staged(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    label = staged(parts.select("partition_id", F.col("partition_id").alias("to")), "labels")
    while True:  # a step halves what is left of the longest chain of merges, or ends
        near = both.join(label, F.col("a") == F.col("partition_id")).groupBy(F.col("b").alias("partition_id")).agg(F.min("to").alias("_m"))
        new = label.join(near, "partition_id", "left").select("partition_id", F.least("to", F.coalesce("_m", "to")).alias("_t"))
        hop = label.select(F.col("partition_id").alias("_t"), F.col("to").alias("_h"))
        new = staged(new.join(hop, "_t").select("partition_id", F.least("_t", "_h").alias("to")), "labels")
        moved = new.join(label.withColumnRenamed("to", "_o"), "partition_id").where("to <> _o").limit(1).count()
        label = new
        if not moved:
            break
    return members.join(label, "partition_id").withColumn("partition_id", F.col("to")).select(*members.columns)


def _numbered(parts: DataFrame) -> DataFrame:
    """A number for each name: pairs are found by numbers."""
    return parts.withColumn("n", F.xxhash64("partition_id"))


def rebalance(members: DataFrame, p: Partitions = P) -> DataFrame:
    """``members`` after the imbalanced partitions that are too large are split and those too small merged."""
    sizes = staged(members.groupBy("partition_id").agg(F.count(F.lit(1)).alias("size")), "sizes")
    off = staged(imbalanced(sizes, p.imbalance).select("partition_id", "size"), "off")
    big = off.where(F.col("size") > p.max_size).select("partition_id")
    small = off.where(F.col("size") < p.min_size).select("partition_id")
    split = split_oversize(members.join(big, "partition_id", "left_semi").select(*members.columns), p.max_size)
    whole = staged(members.join(big, "partition_id", "left_anti").select(*members.columns).unionByName(split), "members")
    return merge_undersize(whole, p.min_size, p.similarity, small)
