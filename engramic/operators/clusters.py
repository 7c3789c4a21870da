"""Clusters and partitions: quality, dynamics, assignment, merging and splitting, and the view's rows.

Pairwise cosine sums never build the pairs: the sum over all pairs of two groups is the inner product
of the groups' sums of unit vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ms, safe_div
from ..functions.vectors import euclidean, norm
from ..params import Partitions
from ..scratch import staged
from .search import centroids, nearest, pairs_within

P = Partitions()


def unit_sums(rows: DataFrame, group: str) -> DataFrame:
    """(group, pos, s, n): sums of the unit vectors; zero vectors add nothing."""
    unit = rows.withColumn("_n", norm("vector")).select(group, F.posexplode("vector").alias("pos", "x"), "_n")
    n = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return unit.groupBy(group, "pos").agg(F.sum(safe_div(F.col("x"), F.col("_n"))).alias("s")).join(n, group)


def coherence(rows: DataFrame, group: str, exclude_self: bool = False) -> DataFrame:
    """(group, n, coherence): the sum of all pairs' cosines, each row with itself counted too unless
    ``exclude_self``, over n (n - 1); 1 for single rows and for a sum of zero."""
    g = unit_sums(rows, group).groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("_q"), F.max("n").alias("n"))
    total = F.col("_q") - (F.col("n") if exclude_self else F.lit(0))
    c = safe_div(total, F.col("n") * (F.col("n") - 1), None)
    return g.select(group, "n", F.when((F.col("n") < 2) | c.isNull() | (c == 0), 1.0).otherwise(c).alias("coherence"))


def isolation(rows: DataFrame, group: str) -> DataFrame:
    """One row: 1 - the mean over pairs of groups of the mean cosine between their members; 1 for fewer
    than two groups. Sum over i < j of u_i . u_j is (|sum u|^2 - sum |u|^2) / 2 for the groups' mean unit
    vectors u, so no pairs of groups are made either."""
    u = unit_sums(rows, group).withColumn("u", F.col("s") / F.col("n"))
    by_pos = u.groupBy("pos").agg(F.sum("u").alias("t"), F.sum(F.col("u") * F.col("u")).alias("q"), F.count(F.lit(1)).alias("k"))
    g = by_pos.agg(F.sum((F.col("t") * F.col("t") - F.col("q")) / 2).alias("pairs"), F.max("k").alias("k"))
    return g.select(F.when(F.coalesce("k", F.lit(0)) < 2, 1.0).otherwise(1 - safe_div(F.col("pairs"), F.col("k") * (F.col("k") - 1) / 2)).alias("isolation"))


def density(rows: DataFrame, group: str, dims: int | None = None) -> DataFrame:
    """(group, density): members over the volume of their bounding box (a range of zero counts as 1; the
    volume is at least 1e-10); 1 for single rows."""
    v = rows.select(group, F.posexplode(F.slice("vector", 1, dims) if dims else F.col("vector")).alias("pos", "x"))
    r = v.groupBy(group, "pos").agg((F.max("x").cast("double") - F.min("x").cast("double")).alias("r"), F.count(F.lit(1)).alias("n"))
    r = r.withColumn("r", F.when(F.col("r") == 0, 1.0).otherwise(F.col("r")))
    g = r.groupBy(group).agg(F.greatest(F.exp(F.sum(F.log("r"))), F.lit(1e-10)).alias("_v"), F.max("n").alias("n"))
    return g.select(group, F.when(F.col("n") < 2, 1.0).otherwise(F.col("n") / F.col("_v")).alias("density"))


def stability(history: DataFrame, group: str, order: str, size: str, change: float = 0.1) -> DataFrame:
    """(group, stability): max(0, 1 - changes of size above ``change`` / states)."""
    h = history.withColumn("_p", F.lag(size).over(Window.partitionBy(group).orderBy(order)))
    moved = F.coalesce(F.abs(F.try_divide(F.col(size) - F.col("_p"), F.col("_p"))) > change, (F.col("_p") == 0) & (F.col(size) > 0), F.lit(False))
    return h.groupBy(group).agg(F.greatest(F.lit(0.0), 1 - F.sum(moved.cast("int")) / F.count(F.lit(1))).alias("stability"))


def growth(history: DataFrame, group: str, order: str, size: str) -> DataFrame:
    """(group, rate): the last change of size relative to the state before."""
    w = Window.partitionBy(group).orderBy(order)
    h = history.withColumn("_p", F.lag(size).over(w)).withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order))))
    return h.where("_r = 1").select(group, safe_div(F.col(size) - F.col("_p"), F.col("_p")).alias("rate"))


def merge_recommendations(points: DataFrame, key: str, threshold: float = 0.8) -> DataFrame:
    """(cluster1, cluster2, similarity) of centroid pairs at or above the threshold: blocks of centroids
    against blocks, no product of rows."""
    rows = points.select(F.lit(0).alias("all"), F.col(key).alias("id"), F.col("centroid").alias("vector"))
    kind = points.schema[key].dataType
    pairs = pairs_within(rows, "all", threshold)
    return pairs.select(F.col("id_a").cast(kind).alias("cluster1"), F.col("id_b").cast(kind).alias("cluster2"), "similarity")


def metadata(memories: DataFrame, top: int = 3) -> DataFrame:
    """(cluster_id, size, average_strength, start, end, dominant_emotions)."""
    base = memories.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.avg("strength").alias("average_strength"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    e = memories.select("cluster_id", F.explode("emotions").alias("e")).groupBy("cluster_id", "e").agg(F.count(F.lit(1)).alias("n"))
    e = e.withColumn("_r", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("n"), "e"))).where(F.col("_r") <= top)
    names = e.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "e"))), lambda s: s["e"]).alias("dominant_emotions"))
    return base.join(names, "cluster_id", "left")


def history_by_day(memories: DataFrame) -> DataFrame:
    """(cluster_id, day, size): members that each day added."""
    return memories.groupBy("cluster_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("size"))


def points(memories: DataFrame, stab: DataFrame, rates: DataFrame) -> DataFrame:
    """The view's rows: each member with its cluster's metadata, and stability and growth where known."""
    j = memories.join(metadata(memories), "cluster_id").join(stab, "cluster_id", "left").join(rates, "cluster_id", "left")
    return j.select("id", F.col("vector")[0].cast("double").alias("x"), F.col("vector")[1].cast("double").alias("y"), "size", F.col("cluster_id").alias("cluster"), "strength", F.coalesce("stability", F.lit(0.0)).alias("stability"), F.coalesce("rate", F.lit(0.0)).alias("growth_rate"), "start", "end")


def in_time_range(pts: DataFrame, which: str, as_of, days: int = 7) -> DataFrame:
    """all, recent (the range starts less than ``days`` ago) or old."""
    age = (ms(as_of) - ms("start")) / 86_400_000.0
    return pts if which == "all" else pts.where(age < days if which == "recent" else age >= days)


def global_stats(pts: DataFrame, unstable: float = 0.3) -> DataFrame:
    """Clusters, members, clusters that grow, clusters below the stability limit."""
    return pts.agg(F.countDistinct("cluster").alias("clusters"), F.count(F.lit(1)).alias("memories"), F.countDistinct(F.when(F.col("growth_rate") > 0, F.col("cluster"))).alias("active"), F.countDistinct(F.when(F.col("stability") < unstable, F.col("cluster"))).alias("unstable"))


# ---------------------------------------------------------------- commands and partitions


def merge(members: DataFrame, a: int, b: int) -> DataFrame:
    """Cluster b becomes part of a."""
    if a == b or members.where(F.col("cluster_id").isin(a, b)).select("cluster_id").distinct().count() != 2:
        raise ValueError("Invalid cluster IDs")
    return members.withColumn("cluster_id", F.when(F.col("cluster_id") == b, F.lit(a).cast("int")).otherwise(F.col("cluster_id")))


def split(members: DataFrame, cluster: int, new_id: int) -> DataFrame:
    """Cluster in two near equal halves: seeds are the member farthest from the centroid and the one
    farthest from it; members are ordered by the difference of their distances and cut at the median."""
    own = members.where(F.col("cluster_id") == cluster)
    c = centroids(own, "cluster_id").first()
    if c is None:
        raise ValueError("Invalid cluster ID")
    far = lambda v: own.select("id", "vector", euclidean("vector", F.array(*[F.lit(float(x)) for x in v])).alias("d")).agg(F.max_by("vector", F.struct("d", -F.col("id"))).alias("v")).first()["v"]
    one = far(c["centroid"])
    two = far(one)
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    gap = own.select("id", (euclidean("vector", lit(one)) - euclidean("vector", lit(two))).alias("g"))
    cut = gap.agg(F.percentile("g", 0.5)).first()[0]
    moved = gap.where(F.col("g") > cut).select(F.col("id").alias("_id"))
    j = members.join(moved, (members["id"] == F.col("_id")) & (members["cluster_id"] == cluster), "left")
    return j.withColumn("cluster_id", F.when(F.col("_id").isNotNull(), F.lit(new_id).cast("int")).otherwise(F.col("cluster_id"))).drop("_id")


def dissolve(members: DataFrame, cluster: int) -> DataFrame:
    """Every member goes to the nearest of the other clusters' centroids."""
    others = centroids(members.where(F.col("cluster_id") != cluster), "cluster_id").drop("n")
    own = members.where(F.col("cluster_id") == cluster)
    to = nearest(own.drop("cluster_id"), others, "cluster_id").select("id", "cluster_id")
    return members.where(F.col("cluster_id") != cluster).unionByName(own.drop("cluster_id").join(to, "id").select(*members.columns))


def imbalanced(sizes: DataFrame, threshold: float = P.imbalance) -> DataFrame:
    """Partitions whose size is off the mean by more than the threshold: (.., size, ratio)."""
    mean = sizes.agg(F.avg("size").alias("_m"))
    return sizes.join(F.broadcast(mean), F.lit(True)).withColumn("ratio", safe_div(F.col("size"), F.col("_m"))).where(F.abs(1 - F.col("ratio")) > threshold).drop("_m")


def rebalance_plan(sizes: DataFrame, p: Partitions = P) -> DataFrame:
    """What to do with each imbalanced partition: split, merge or keep."""
    return imbalanced(sizes, p.imbalance).withColumn("action", F.when(F.col("size") > p.max_size, "split").when(F.col("size") < p.min_size, "merge").otherwise("keep"))


def merge_targets(parts: DataFrame, threshold: float = P.similarity) -> DataFrame:
    """(partition_id, target, similarity): the most similar other partition of the type, if above the
    threshold; ``parts(partition_id, type, centroid)``."""
    rows = parts.select("type", F.col("partition_id").alias("id"), F.col("centroid").alias("vector"))
    kind = parts.schema["partition_id"].dataType
    pairs = pairs_within(rows, "type", threshold).where(F.col("similarity") > threshold)
    both = pairs.select(F.col("id_a").alias("p"), F.col("id_b").alias("target"), "similarity").unionByName(pairs.select(F.col("id_b").alias("p"), F.col("id_a").alias("target"), "similarity"))
    best = both.groupBy("p").agg(F.max_by(F.struct("target", "similarity"), F.struct("similarity", -F.col("target"))).alias("b"))
    return best.select(F.col("p").cast(kind).alias("partition_id"), F.col("b.target").cast(kind).alias("target"), F.col("b.similarity").alias("similarity"))


def density_metrics(sizes: DataFrame) -> DataFrame:
    """One row: members per partition and accesses per member."""
    return sizes.agg(safe_div(F.sum("size"), F.count(F.lit(1))).alias("density"), safe_div(F.sum("access_count"), F.sum("size")).alias("access_rate"))


def kmeans(rows: DataFrame, k: int, iterations: int = 10) -> DataFrame:
    """``rows`` with cluster_id 0..k-1 by spherical k-means: the first seed is the vector of the least id,
    each further one the vector least similar to its nearest seed (the least id on ties); then
    ``iterations`` rounds of assignment to the most similar mean. The same rows give the same clusters."""
    base = staged(rows.drop("cluster_id"), "rows")
    first = base.where(F.col("vector").isNotNull()).orderBy("id").select("vector").head()
    if first is None:
        return base.withColumn("cluster_id", F.lit(None).cast("int"))
    spark, seeds = base.sparkSession, [first["vector"]]
    table = lambda vs: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vs)], "cluster_id int, centroid array<double>")
    for _ in range(k - 1):
        far = nearest(base, table(seeds), "cluster_id").orderBy("similarity", "id").select("id").head()
        seeds.append(base.where(F.col("id") == far["id"]).select("vector").head()["vector"])
    means = table(seeds)
    for _ in range(iterations):
        own = staged(base.join(nearest(base, means, "cluster_id").select("id", "cluster_id"), "id"), "assigned")
        unit = own.withColumn("_n", norm("vector")).withColumn("vector", F.transform("vector", lambda x: safe_div(x.cast("double"), F.col("_n"))))
        means = staged(centroids(unit, "cluster_id").drop("n"), "means")  # k rows
    return base.join(nearest(base, means, "cluster_id").select("id", "cluster_id"), "id")
