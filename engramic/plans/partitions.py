"""Queries over the life cycle of partitions, the approximate index and commands on clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import cosine_fixed
from ..operators import ann, cache, clusters, partitions, search
from ..operators import memories as mem
from ..params import Partitions
from .common import CENT, r6, rounded, table


def vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("cluster_id"))


def queries(s, d):
    return vectors(s, d).where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))


def _members(s, d):
    kind = F.element_at(F.array(*[F.lit(t) for t in mem.TYPES]), (F.col("cluster_id") % 4 + 1).cast("int"))
    return vectors(s, d).select("id", kind.alias("type"), "vector", F.col("cluster_id").cast("string").alias("partition_id"))


def _mean(m) -> int:
    """The mean number of members, rounded down."""
    return m.count() // max(1, m.select("partition_id").distinct().count())


def _stats(s, d):
    p = partitions.partition_table(_members(s, d))
    return p.select("partition_id", "type", "size", r6(F.col("centroid")[0]).alias("first"))


def _capacity(s, d):
    m = _members(s, d)
    rows = m.where("id % 7 = 0").drop("partition_id")
    got = partitions.assign(rows, partitions.partition_table(m), Partitions(max_size=_mean(m), similarity=0.1))
    return got.select("id", "partition_id", r6("similarity").alias("similarity"), "created")


def _split(s, d):
    m = _members(s, d)
    return partitions.split_oversize(m, _mean(m)).select("id", "partition_id")


def _merge(s, d):
    m = _members(s, d)
    return partitions.merge_undersize(m, _mean(m), -0.05).select("id", "partition_id")


def _ann(s, d):
    v = vectors(s, d).drop("cluster_id")
    lists = search.centroids(vectors(s, d), "cluster_id").drop("n").withColumnRenamed("cluster_id", "list_id")
    return ann.search(queries(s, d), ann.index(v, lists), lists, 5, 3, digits=6).withColumn("similarity", r6("similarity"))


def _cached(s, d):
    q, v = queries(s, d).withColumn("type", F.lit("semantic")), vectors(s, d).drop("cluster_id")
    run = lambda x: search.knn(x, v, 5, digits=6)
    known = q.where("query_id % 40 = 0")
    stored = run(known).join(known.select("query_id", cache.query_key(F.col("query"), F.col("type"), 5).alias("key")), "query_id")
    return cache.remembered(q, stored, 5, run)[0].select("query_id", "id", r6("similarity").alias("similarity"), "rank")


def _fixed(s, d):
    v = vectors(s, d)
    cut = F.when(F.col("id") % 3 == 0, F.slice("vector", 1, 60)).otherwise(F.col("vector"))
    c = cosine_fixed(cut, "vector", 64)
    return v.select("id", r6(F.nanvl(c, F.lit(-9.0))).alias("similarity"))


QUERIES = {
    "partition_stats": _stats,
    "partition_capacity": _capacity,
    "partition_split": _split,
    "partition_merge": _merge,
    "ann_search": _ann,
    "cached_search": _cached,
    "fixed_cosine": _fixed,
    "cluster_members": lambda s, d: mem.members(_members(s, d).withColumn("cluster_id", F.col("partition_id").cast("int")), "procedural", 2).select("id"),
    "merge_clusters": lambda s, d: clusters.merge(vectors(s, d), 0, 4).select("id", "cluster_id"),
    "split_cluster": lambda s, d: clusters.split(vectors(s, d), 2, 100).select("id", "cluster_id"),
    "dissolve_cluster": lambda s, d: clusters.dissolve(vectors(s, d), 3).select("id", "cluster_id"),
    "kmeans_clusters": lambda s, d: clusters.kmeans(vectors(s, d), 4, 2).select("id", "cluster_id"),
    "rebalance_plan": lambda s, d: _rebalance_plan(s, d),
}


def _rebalance_plan(s, d):
    m = _members(s, d)
    sizes = m.groupBy("partition_id", "type").agg(F.count(F.lit(1)).alias("size"))
    mean = _mean(m)
    return rounded(clusters.rebalance_plan(sizes, Partitions(max_size=mean + 2, min_size=mean - 2, imbalance=0.005)), "ratio")


_PM = "pm AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, list_extract(['episodic','semantic','procedural','emotional'], label % 4 + 1) AS type, label::VARCHAR AS pid FROM embeddings)"
_PC = "pc AS (SELECT pid, min(type) AS type, count(*) AS n FROM pm GROUP BY 1), av AS (SELECT (SELECT count(*) FROM pm) // (SELECT count(*) FROM pc) AS m)"
_PV = "pv AS (SELECT pc.*, centroid FROM pc JOIN cent ON cluster_id::VARCHAR = pid)"
_HALF = "big AS (SELECT pid FROM pc, av WHERE n > m), one AS (SELECT pid, arg_min(v, id) AS one FROM pm JOIN big USING (pid) GROUP BY 1), two AS (SELECT pid, v AS two FROM pm JOIN one USING (pid) QUALIFY row_number() OVER (PARTITION BY pid ORDER BY list_distance(v, one) DESC, id) = 1)"
_BEST = "best AS (SELECT a.pid AS a, b.pid AS b FROM pv a JOIN pv b ON a.type = b.type AND a.pid <> b.pid, av WHERE a.n < m AND list_cosine_similarity(a.centroid, b.centroid) > -0.05 QUALIFY row_number() OVER (PARTITION BY a.pid ORDER BY list_cosine_similarity(a.centroid, b.centroid) DESC) = 1)"
_KNN5 = "knn AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) + 0.0 AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id) AS rank FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)"
_COS = "list_cosine_similarity({}, {})"


def _kmeans_sql(k: int, rounds: int) -> str:
    ctes = ["b AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)", "s0 AS (SELECT v FROM b ORDER BY id LIMIT 1)"]
    for j in range(1, k):
        near = ", ".join(f"list_cosine_similarity(b.v, (SELECT v FROM s{i}))" for i in range(j))
        ctes.append(f"s{j} AS (SELECT v FROM b ORDER BY greatest({near}), id LIMIT 1)")
    ctes.append("c0 AS (" + " UNION ALL ".join(f"SELECT {i} AS cluster_id, v AS c FROM s{i}" for i in range(k)) + ")")
    for r in range(rounds + 1):
        ctes.append(f"a{r} AS (SELECT id, v, cluster_id FROM b, c{r} QUALIFY row_number() OVER (PARTITION BY id ORDER BY list_cosine_similarity(v, c) DESC, cluster_id) = 1)")
        if r < rounds:
            ctes.append(f"c{r + 1} AS (SELECT cluster_id, list(x ORDER BY pos) AS c FROM (SELECT cluster_id, pos, avg(v[pos] / sqrt(list_dot_product(v, v))) AS x FROM a{r}, range(1, 65) t(pos) GROUP BY ALL) GROUP BY 1)")
    return "WITH " + ", ".join(ctes) + f" SELECT id, cluster_id FROM a{rounds}"


ORACLE_SQL = {
    "partition_stats": f"WITH {CENT}, {_PM}, {_PC}, {_PV} SELECT pid AS partition_id, type, n AS size, round(centroid[1], 6) + 0.0 AS first FROM pv",
    "partition_capacity": f"WITH {CENT}, {_PM}, {_PC}, {_PV}, t AS (SELECT pm.id, pv.pid, list_cosine_similarity(v, centroid) AS s FROM pm JOIN pv USING (type), av WHERE pm.id % 7 = 0 AND pv.n < m QUALIFY row_number() OVER (PARTITION BY pm.id ORDER BY list_cosine_similarity(v, centroid) DESC, pv.pid) = 1) SELECT id, CASE WHEN s > 0.1 THEN t.pid ELSE 'new_' || id END AS partition_id, round(s, 6) + 0.0 AS similarity, coalesce(s <= 0.1, true) AS created FROM (SELECT id FROM pm WHERE id % 7 = 0) LEFT JOIN t USING (id)",
    "partition_split": f"WITH {_PM}, {_PC}, {_HALF} SELECT id, CASE WHEN one IS NULL THEN pid WHEN list_distance(v, one) <= list_distance(v, two) THEN pid || '.0' ELSE pid || '.1' END AS partition_id FROM pm LEFT JOIN one USING (pid) LEFT JOIN two USING (pid)",
    "partition_merge": f"WITH RECURSIVE {CENT}, {_PM}, {_PC}, {_PV}, {_BEST}, und AS (SELECT a, b FROM best UNION SELECT b, a FROM best), r AS (SELECT pid AS x, pid AS y FROM pc UNION SELECT r.x, und.b FROM r JOIN und ON und.a = r.y), lab AS (SELECT x AS pid, min(y) AS dest FROM r GROUP BY 1) SELECT id, dest AS partition_id FROM pm JOIN lab USING (pid)",
    "ann_search": f"WITH {CENT}, near AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, cluster_id FROM embeddings, cent QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_cosine_similarity(embedding::DOUBLE[], centroid) DESC, cluster_id) = 1), visit AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q, cluster_id FROM embeddings, cent WHERE vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], centroid), 9) DESC, cluster_id) <= 3) SELECT query_id, id, round(list_cosine_similarity(q, v), 6) + 0.0 AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(q, v), 6) DESC, id) AS rank FROM visit JOIN near USING (cluster_id) WHERE id <> query_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(q, v), 6) DESC, id) <= 5",
    "cached_search": f"WITH {_KNN5} SELECT * FROM knn WHERE rank <= 5",
    "fixed_cosine": "SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN -9.0 ELSE round(list_cosine_similarity(embedding::DOUBLE[], embedding::DOUBLE[]), 6) + 0.0 END::DOUBLE AS similarity FROM embeddings",
    "cluster_members": "SELECT vec_id AS id FROM embeddings WHERE label = 2",
    "merge_clusters": "SELECT vec_id AS id, CASE WHEN label = 4 THEN 0 ELSE label END AS cluster_id FROM embeddings",
    "split_cluster": f"WITH {CENT}, o AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE label = 2), one AS (SELECT v FROM o ORDER BY list_distance(v, (SELECT centroid FROM cent WHERE cluster_id = 2)) DESC, id LIMIT 1), two AS (SELECT v FROM o ORDER BY list_distance(v, (SELECT v FROM one)) DESC, id LIMIT 1), g AS (SELECT id, list_distance(v, (SELECT v FROM one)) - list_distance(v, (SELECT v FROM two)) AS g FROM o) SELECT vec_id AS id, CASE WHEN g > (SELECT quantile_cont(g, 0.5) FROM g) THEN 100 ELSE label END AS cluster_id FROM embeddings LEFT JOIN g ON id = vec_id",
    "dissolve_cluster": f"WITH {CENT}, n3 AS (SELECT vec_id AS id, c.cluster_id FROM embeddings v, cent c WHERE v.label = 3 AND c.cluster_id <> 3 QUALIFY row_number() OVER (PARTITION BY v.vec_id ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], c.centroid) DESC, c.cluster_id) = 1) SELECT vec_id AS id, label AS cluster_id FROM embeddings WHERE label <> 3 UNION ALL SELECT * FROM n3",
    "kmeans_clusters": _kmeans_sql(4, 2),
    "rebalance_plan": f"WITH {_PM}, {_PC}, a AS (SELECT avg(n) AS a FROM pc) SELECT pid AS partition_id, type, n AS size, round(n / a, 6) + 0.0 AS ratio, CASE WHEN n > m + 2 THEN 'split' WHEN n < m - 2 THEN 'merge' ELSE 'keep' END AS action FROM pc, av, a WHERE abs(1 - n / a) > 0.005",
}
