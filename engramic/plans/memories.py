"""Queries over memories: search, clusters, metrics, relevance, lifecycle, cache, pool."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import scores as X
from ..functions.numeric import age_days
from ..functions.vectors import cosine, euclidean, jaccard
from ..operators import cache, clusters, lifecycle, listing, metrics, pool, predict, search, series, statistics
from ..operators import memories as mem
from .common import AS_OF_TEXT, CENT, ENTRIES, LOG, MEM, TASKS, as_of, cache_entries, edges, log, memories, r6, rounded, table, tasks
from .common import ms as sms

K = 5
_m = memories


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("cluster_id"))


def _queries(s, d):
    return _vectors(s, d).where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))


def _knn(s, d):
    return search.knn(_queries(s, d), _vectors(s, d), K, digits=6).withColumn("similarity", r6("similarity"))


def _cent(s, d):
    return search.centroids(_vectors(s, d), "cluster_id")


def _weights(s, d):
    """Deterministic weights: the first 8 components of the vector."""
    return _vectors(s, d).select("id", F.slice("vector", 1, 8).alias("neural_weights"))


def _history(s, d):
    return clusters.history_by_day(_m(s, d))


def _points(s, d):
    h = _history(s, d)
    return clusters.points(_m(s, d), clusters.stability(h, "cluster_id", "day", "size"), clusters.growth(h, "cluster_id", "day", "size"))


def _route(s, d):
    c = _cent(s, d).withColumn("type", F.element_at(F.array(*[F.lit(t) for t in mem.TYPES]), (F.col("cluster_id") % 4 + 1).cast("int")))
    return search.route(_queries(s, d), c, "cluster_id", "semantic", 0.1)


def _sizes(s, d):
    m = _m(s, d)
    return m.groupBy("cluster_id", "type").agg(F.count(F.lit(1)).alias("size"), F.sum("access_count").alias("access_count"))


def _relevance(s, d, depth=1):
    m = _m(s, d)
    return predict.predicted_relevance(m, edges(m), as_of(), None, depth)


def _pattern(s, d):
    m = _m(s, d)
    rel = m.select("id", (F.col("strength")).alias("relevance"))
    return predict.historical_pattern(m, predict.history_of(m, rel, edges(m)), edges(m), 0.5)


def _with_history(s, d):
    m = _m(s, d)
    past = predict.history_of(m, m.select("id", F.col("strength").alias("relevance")), edges(m))
    r = predict.predicted_relevance(m, edges(m), as_of(), past, 1).withColumn("factors", F.array_join("factors", ","))
    return rounded(r.select("id", "relevance", "confidence", "factors"), "relevance", "confidence")


def _full_context(s, d):
    """Context with a place, company and a history of the type."""
    m = _m(s, d)
    place = F.struct(F.when(F.col("id") % 3 == 0, "home").otherwise("work").alias("type"), F.when(F.col("id") % 2 == 0, "quiet").alias("context"))
    wide = m.withColumn("location", place).withColumn("social_context", F.when(F.col("id") % 5 == 0, "family"))
    past = predict.history_of(m, m.select("id", F.col("strength").alias("relevance")), edges(m))
    return predict.context_insights(wide, edges(m), as_of(), past, 0.05).withColumn("insights", F.array_join("insights", ","))


def _enriched(s, d):
    m = _m(s, d)
    return m.select("id", "type", "strength", "access_count", "last_accessed", (F.lit(0.2) + F.col("strength") / 2).alias("importance"), F.lit(0.1).alias("decay_rate"), "ts", "cluster_id", "vector")


def _decayed(s, d):
    return lifecycle.apply_decay(_enriched(s, d), as_of())


def _composite(s, d):
    m = _m(s, d).select("id", "cluster_id", "vector", "emotions", F.split(X.day_part("ts"), ",").alias("ctx"), F.slice("vector", 1, 8).alias("w"))
    p = search.pairs_within(m, "cluster_id", 0.3)
    side = lambda k: m.select(F.col("id").alias(f"id_{k}"), F.col("emotions").alias(f"e{k}"), F.col("ctx").alias(f"c{k}"), F.col("w").alias(f"w{k}"))
    j = p.join(side("a"), "id_a").join(side("b"), "id_b")
    return j.select("id_a", "id_b", r6(X.composite_similarity(F.col("similarity"), jaccard("ea", "eb"), jaccard("ca", "cb"), cosine("wa", "wb"))).alias("score"))


def _tags(s, d):
    m = _m(s, d)
    return predict.ranked_tags(predict.tag_candidates(m, edges(m), as_of())).select("id", "tag", r6("confidence").alias("confidence"), "rank")


def _labels(s, d):
    return _m(s, d).select("id", X.day_part("ts").alias("part"), X.day_context("ts").alias("context"), X.day_kind("ts").alias("kind"), F.array_join(X.access_labels("access_count", "last_accessed", as_of()), ",").alias("access"), X.date_label("ts").alias("date"), X.preview("content", 20).alias("preview"), F.array_join(X.keywords("content"), "|").alias("keywords"), X.cluster_colour(F.col("strength"), F.lit(0.25)).alias("colour"))


def _memory_metrics(s, d):
    m = _m(s, d).withColumn("size", F.length("content")).withColumn("consolidated", F.col("id") % 3 == 0).withColumn("access_history", F.array("last_accessed", "ts"))
    return rounded(metrics.memory_metrics(m, as_of(), ("type",), 7 * 86_400_000), "average_strength", "decay_rate", "consolidation_rate", "access_frequency")


def _health(s, d):
    m, h = _m(s, d), _history(s, d)
    strength = m.agg(F.avg("strength").alias("strength"))
    stab = clusters.stability(h, "cluster_id", "day", "size").agg(F.avg("stability").alias("stability"))
    err = metrics.system_metrics(tasks(s, d)).select("error_rate")
    score, status = metrics.health(F.col("strength"), F.col("stability"), F.col("error_rate"), 0.5, 0.7)
    return strength.join(stab, F.lit(True)).join(err, F.lit(True)).select(r6(score).alias("score"), status.alias("status"))


def _cluster_metrics(s, d):
    v, h = _vectors(s, d), _history(s, d)
    coh = clusters.coherence(v, "cluster_id").agg(F.count(F.lit(1)).alias("count"), F.avg("n").alias("average_size"), F.avg("coherence").alias("coherence"))
    den = clusters.density(v, "cluster_id", 4).agg(F.avg("density").alias("density"))
    stab = clusters.stability(h, "cluster_id", "day", "size").agg(F.avg("stability").alias("stability"))
    return rounded(coh.join(clusters.isolation(v, "cluster_id"), F.lit(True)).join(den, F.lit(True)).join(stab, F.lit(True)), "average_size", "coherence", "isolation", "density", "stability")



def _pool_workers(s, d):
    t = pool.telemetry(tasks(s, d), ("worker_id",))
    return t.select("worker_id", F.lit(False).alias("busy"), (1000 / F.col("avg_latency")).alias("efficiency"), (1 - F.col("error_rate") / 2).alias("health"), (F.col("processed") % 10 / 20.0).alias("cpu"), F.lit(0.3).alias("memory"))


QUERIES = {
    "knn_topk": _knn,
    "pairwise_similarity": lambda s, d: rounded(search.pairs_within(_vectors(s, d), "cluster_id", 0.3), "similarity"),
    "merge_search_results": lambda s, d: search.merge_results(_knn(s, d).drop("rank").unionByName(_knn(s, d).drop("rank").withColumn("similarity", r6(F.col("similarity") * 0.9))), 3),
    "neural_rerank": lambda s, d: rounded(search.neural_rerank(_knn(s, d), _weights(s, d)), "similarity"),
    "composite_similarity": _composite,
    "nearest_centroid": lambda s, d: rounded(search.nearest(_vectors(s, d).drop("cluster_id"), _cent(s, d).drop("n"), "cluster_id"), "similarity"),
    "partition_assign": lambda s, d: rounded(search.nearest(_vectors(s, d).drop("cluster_id"), _cent(s, d).drop("n"), "cluster_id", 0.3), "similarity"),
    "partition_routing": _route,
    "cluster_centroid": lambda s, d: _cent(s, d).select("cluster_id", "n", F.posexplode("centroid").alias("pos", "x")).withColumn("x", r6("x")),
    "centroid_distance": lambda s, d: _vectors(s, d).join(_cent(s, d), "cluster_id").select("id", r6(euclidean("vector", "centroid")).alias("distance")),
    "cluster_coherence": lambda s, d: rounded(clusters.coherence(_vectors(s, d), "cluster_id"), "coherence"),
    "cluster_isolation": lambda s, d: rounded(clusters.isolation(_vectors(s, d), "cluster_id"), "isolation"),
    "cluster_density": lambda s, d: rounded(clusters.density(_vectors(s, d), "cluster_id", 4), "density"),
    "cluster_stability": lambda s, d: rounded(clusters.stability(_history(s, d), "cluster_id", "day", "size"), "stability"),
    "cluster_growth": lambda s, d: rounded(clusters.growth(_history(s, d), "cluster_id", "day", "size"), "rate"),
    "cluster_metadata": lambda s, d: rounded(clusters.metadata(_m(s, d)).withColumn("dominant_emotions", F.array_join("dominant_emotions", ",")), "average_strength"),
    "cluster_metrics": _cluster_metrics,
    "merge_recommendations": lambda s, d: rounded(clusters.merge_recommendations(_cent(s, d), "cluster_id", 0.1), "similarity"),
    "partition_imbalance": lambda s, d: rounded(clusters.imbalanced(_sizes(s, d), 0.05), "ratio"),
    "merge_targets": lambda s, d: rounded(clusters.merge_targets(_cent(s, d).select(F.col("cluster_id").alias("partition_id"), (F.col("cluster_id") % 4).alias("type"), "centroid"), 0.0), "similarity"),
    "partition_density": lambda s, d: rounded(clusters.density_metrics(_sizes(s, d)), "density", "access_rate"),
    "cluster_points": lambda s, d: rounded(_points(s, d), "x", "y", "strength", "stability", "growth_rate"),
    "recent_points": lambda s, d: clusters.in_time_range(_points(s, d), "recent", F.lit("2024-01-05 00:00:00").cast("timestamp")).select("id", "cluster"),
    "global_stats": lambda s, d: clusters.global_stats(_points(s, d)),
    "cluster_entropy": lambda s, d: rounded(statistics.entropy(_m(s, d).select("cluster_id", F.explode("emotions").alias("e")), ["cluster_id"], "e"), "entropy"),
    "emotion_histogram": lambda s, d: statistics.label_histogram(_m(s, d), ["type"], "emotions"),
    "age_distribution": lambda s, d: rounded(_m(s, d).groupBy("cluster_id").agg(F.min(age_days("ts", as_of())).alias("youngest"), F.max(age_days("ts", as_of())).alias("oldest"), F.avg(age_days("ts", as_of())).alias("mean")), "youngest", "oldest", "mean"),
    "memory_metrics": _memory_metrics,
    "system_metrics": lambda s, d: rounded(metrics.system_metrics(tasks(s, d)), "operations_per_second", "latency", "error_rate"),
    "health_score": _health,
    "dynamic_thresholds": lambda s, d: rounded(metrics.dynamic_thresholds(log(s, d)), "normal", "warning", "critical"),
    "metric_summary": lambda s, d: rounded(metrics.metric_summary(log(s, d)), "current", "average"),
    "predicted_metric": lambda s, d: rounded(metrics.predicted_metric(log(s, d)), "predicted"),
    "metric_window": lambda s, d: metrics.in_window(log(s, d).withColumn("ts", F.col("ts").cast("timestamp")), as_of(), 5 * 86_400_000).select("metric", "value"),
    "first_anomaly_time": lambda s, d: metrics.first_of_value(series.rolling_z(table(s, d, "events").select(F.col("event_type").alias("metric"), "ts", "event_id", "value"), ["metric"], ["ts", "event_id"], "value").select("metric", "event_id", "value"), table(s, d, "events").select(F.col("event_type").alias("metric"), "ts", "value")).select("event_id", "first_ts"),
    "maintenance_triggers": lambda s, d: rounded(metrics.maintenance_triggers(_m(s, d), F.lit("2024-01-30 12:00:00").cast("timestamp"), as_of(), 0.3, 50.0).withColumn("anomalies", F.array_join("anomalies", ",")), "mean_strength", "mean_access"),
    "adapted_base_rate": lambda s, d: rounded(metrics.adapted_base_rate(_enriched(s, d)), "base_rate"),
    "store_telemetry": lambda s, d: metrics.store_telemetry(_m(s, d), "semantic").select("id", "memory_count", r6("strength").alias("strength")),
    "decay": lambda s, d: _decayed(s, d).select("id", r6("strength").alias("strength"), "archived"),
    "archive_split": lambda s, d: lifecycle.split_archive(_decayed(s, d))[1].groupBy("type").agg(F.count(F.lit(1)).alias("archived")),
    "importance": lambda s, d: _m(s, d).select("id", r6(X.importance(F.col("strength"), F.col("strength"), F.col("access_count"), F.size("emotions"))).alias("importance")),
    "relevance_factors": lambda s, d: rounded(predict.relevance_factors(_m(s, d), predict.relationship_score(_m(s, d), edges(_m(s, d)), None), as_of()).withColumn("factors", F.array_join("factors", ",")), "score"),
    "coherence_parts": lambda s, d: rounded(predict.coherence_parts(_m(s, d), edges(_m(s, d))), "semantic", "temporal", "emotional"),
    "contextual_relevance": lambda s, d: rounded(predict.contextual_relevance(_m(s, d), edges(_m(s, d)), as_of()).withColumn("factors", F.array_join("factors", ",")), "score"),
    "historical_pattern": lambda s, d: rounded(_pattern(s, d).withColumn("factors", F.array_join("factors", ",")), "score", "confidence"),
    "predicted_relevance": lambda s, d: rounded(_relevance(s, d).withColumn("factors", F.array_join("factors", ",")), "relevance", "confidence", "entropy"),
    "relevance_with_history": _with_history,
    "full_context": _full_context,
    "network_depth": lambda s, d: predict.network_depth(edges(_m(s, d)), _m(s, d), 5),
    "tag_rank": _tags,
    "memory_labels": _labels,
    "context_insights": lambda s, d: predict.context_insights(_m(s, d), edges(_m(s, d)), as_of()).withColumn("insights", F.array_join("insights", ",")),
    "analysis_trend": lambda s, d: predict.trend_of(table(s, d, "events").select(F.col("user_id").alias("id"), "ts", (F.col("value") / 100).alias("relevance"))).groupBy("trend").agg(F.count(F.lit(1)).alias("n")),
    "consolidation_groups": lambda s, d: lifecycle.greedy_groups(_m(s, d), 0.15),
    "merged_memories": lambda s, d: lifecycle.merge_groups(_m(s, d), _m(s, d).select("id", F.col("cluster_id").cast("long").alias("seed"))).select("seed", F.length("content").alias("chars"), r6("strength").alias("strength"), "members"),
    "cache_value": lambda s, d: cache.with_value(cache_entries(s, d), as_of()).select("key", r6("value").alias("value")),
    "ttl_expiry": lambda s, d: cache.live(cache_entries(s, d), as_of(), 29.95 * 86_400_000).select("key"),
    "lru_eviction": lambda s, d: cache.evict_lru(cache_entries(s, d), as_of(), 100, 40_000, 60 * 86_400_000).select("key", "size"),
    "value_trim": lambda s, d: cache.trim_by_value(cache_entries(s, d), as_of(), 60_000).select("key", "size"),
    "cache_stats": lambda s, d: rounded(cache.stats(cache_entries(s, d)), "hit_rate").withColumn("mean_access_ms", F.round("mean_access_ms", 1)),
    "priority_queue": lambda s, d: pool.queue_order(tasks(s, d)).select("id", "priority", "place"),
    "pool_telemetry": lambda s, d: rounded(pool.telemetry(tasks(s, d), ("worker_id",)).withColumn("total_latency", F.col("avg_latency") * F.col("processed")).drop("avg_latency"), "total_latency", "min_latency", "max_latency", "error_rate"),
    "worker_probability": lambda s, d: pool.probabilities(_pool_workers(s, d)).select("worker_id", r6("weight").alias("weight")),
    "least_healthy": lambda s, d: pool.least_healthy(_pool_workers(s, d), 5).select("worker_id", r6("health").alias("health")),
    "state_times": lambda s, d: rounded(pool.state_times(table(s, d, "events").select(F.col("user_id").alias("worker_id"), "ts", F.col("event_type").alias("to"))), "ms"),
    "task_estimates": lambda s, d: tasks(s, d).select("id", r6(X.task_cpu(F.col("priority"), F.lit(3))).alias("cpu"), r6(X.task_memory(F.col("priority"), F.lit(None).cast("int"))).alias("memory"), r6(X.predicted_completion(F.col("priority"))).alias("done_ms"), r6(X.efficiency_after(F.lit(0.5), F.col("latency"))).alias("efficiency"), r6(X.health_after(F.lit(0.9), F.col("failed"), F.lit(False))).alias("health"), X.scaled_pool(F.lit(4), F.col("priority"), F.lit(0.5), F.lit(0.4)).alias("pool")),
    "page_slice": lambda s, d: listing.page(table(s, d, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), "c_custkey"], 40, 25),
    "first_rows": lambda s, d: listing.first_rows(table(s, d, "supplier"), ["s_nationkey"], ["s_suppkey"], 2).select("s_nationkey", "s_suppkey"),
    "type_scan": lambda s, d: mem.of_type(_m(s, d), "emotional").select("id", "type"),
    "key_lookup": lambda s, d: mem.lookup(_m(s, d), _m(s, d).where("strength > 0.5").select("type", "id")).select("id", r6("strength").alias("strength")),
}

_W = f"WITH {MEM}"
_H = "hist AS (SELECT cluster_id, ts::DATE AS day, count(*) AS size FROM mem GROUP BY ALL), hl AS (SELECT *, lag(size) OVER (PARTITION BY cluster_id ORDER BY day) AS p, row_number() OVER (PARTITION BY cluster_id ORDER BY day DESC) AS rd FROM hist), stab AS (SELECT cluster_id, greatest(0.0::DOUBLE, 1 - count(*) FILTER (abs(size - p) / p > 0.1) / count(*)) AS stability FROM hl GROUP BY 1), grow AS (SELECT cluster_id, coalesce((size - p) / p, 0) AS rate FROM hl WHERE rd = 1)"
_META = "meta AS (SELECT cluster_id, count(*) AS size, avg(strength) AS average_strength, min(ts) AS start, max(ts) AS \"end\" FROM mem GROUP BY 1)"
_PTS = f"pts AS (SELECT m.id, m.vector[1] AS x, m.vector[2] AS y, meta.size, m.cluster_id AS cluster, m.strength, coalesce(stability, 0) AS stability, coalesce(rate, 0) AS growth_rate, start, \"end\" FROM mem m JOIN meta USING (cluster_id) LEFT JOIN stab USING (cluster_id) LEFT JOIN grow USING (cluster_id))"
_COS = "list_cosine_similarity({a}, {b})"
_KNN = "knn AS (SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) + 0.0 AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id) AS rank FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0) WHERE rank <= 5)"
_NEAR = "near AS (SELECT v.vec_id AS id, c.cluster_id, list_cosine_similarity(v.embedding::DOUBLE[], c.centroid) AS similarity FROM embeddings v, cent c QUALIFY row_number() OVER (PARTITION BY v.vec_id ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], c.centroid) DESC, c.cluster_id) = 1)"
_UNIT = "unit AS (SELECT label AS cluster_id, vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings)"
_SUMS = f"{_UNIT}, us AS (SELECT cluster_id, pos, sum(u[pos]) AS s, count(*) AS n FROM unit, range(1, 65) t(pos) GROUP BY ALL)"
_COH = f"{_SUMS}, coh AS (SELECT cluster_id, any_value(n) AS n, sum(s * s) / (any_value(n) * (any_value(n) - 1)) AS coherence FROM us GROUP BY 1)"
_ISO = "iso AS (SELECT 1 - sum(d) / (count(*)) AS isolation FROM (SELECT a.cluster_id AS i, b.cluster_id AS j, sum(a.s / a.n * b.s / b.n) AS d FROM us a JOIN us b ON a.pos = b.pos AND a.cluster_id < b.cluster_id GROUP BY ALL))"
_DEN = "den AS (SELECT cluster_id, n / greatest(v, 1e-10) AS density FROM (SELECT cluster_id, product(r) AS v, any_value(n) AS n FROM (SELECT label AS cluster_id, pos, max(embedding[pos]::DOUBLE) - min(embedding[pos]::DOUBLE) AS r, count(*) AS n FROM embeddings, range(1, 5) t(pos) GROUP BY ALL) GROUP BY 1))"
_AGE = f"((SELECT t FROM now) - {sms('ts')})"
_REC = "greatest(0.0::DOUBLE, 1 - ((SELECT t FROM now) - {c}) / {h})"
_HZ = "604800000.0::DOUBLE"
_R_TS, _R_LAST = _REC.format(c=sms("ts"), h=_HZ), _REC.format(c=sms("coalesce(last_accessed, ts)"), h=_HZ)
_ACC = f"(({_R_LAST} + least(1.0::DOUBLE, coalesce(access_count, 0) / 100.0)) / 2)"
_EMO = "(CASE WHEN coalesce(len(emotions), 0) = 0 THEN 0.3 ELSE (least(1.0::DOUBLE, len(emotions) / 5.0) + len(list_distinct(emotions)) / len(emotions)) / 2 END)"
_TMP = f"(0.7 * {_R_TS} + 0.3 * {_REC.format(c=sms('coalesce(last_accessed, (SELECT TIMESTAMP ' + chr(39) + AS_OF_TEXT + chr(39) + '))'), h='302400000.0::DOUBLE')})"
_REL = "rs AS (SELECT m.id, coalesce(avg((0.5 + CASE WHEN r.strength = 0 THEN 0.5 ELSE r.strength END) / 2), 0.3) AS relationship FROM mem m LEFT JOIN edges e ON e.src = m.id LEFT JOIN mem r ON r.id = e.dst GROUP BY m.id)"
_FAC = f"SELECT id, 0.3 * {_R_TS} + 0.2 * {_ACC} + 0.25 * relationship + 0.25 * {_EMO} AS score, list_filter([CASE WHEN {_R_TS} > 0.7 THEN 'high_recency' END, CASE WHEN {_ACC} > 0.7 THEN 'frequent_access' END, CASE WHEN relationship > 0.7 THEN 'strong_relationships' END, CASE WHEN {_EMO} > 0.7 THEN 'high_emotional_significance' END], lambda x: x IS NOT NULL) AS factors FROM mem JOIN {{r}} USING (id)"
_CP = f"cp AS (SELECT e.src AS id, avg(list_cosine_similarity(m.vector, r.vector)) AS semantic, greatest(0.0::DOUBLE, 1 - (max({sms('r.ts')}) - min({sms('r.ts')})) / {_HZ}) AS temporal, CASE WHEN sum(len(r.emotions)) = 0 THEN 0.5 ELSE sum(len(list_filter(r.emotions, lambda x: list_contains(m.emotions, x)))) / sum(len(r.emotions)) END AS emotional FROM edges e JOIN mem m ON m.id = e.src JOIN mem r ON r.id = e.dst GROUP BY 1)"
_CTX = f"{_CP}, cx AS (SELECT id, coalesce(semantic, 0.5) AS s, {_TMP} AS t, coalesce(0.4 * semantic + 0.3 * temporal + 0.3 * emotional, 0.5) AS c FROM mem LEFT JOIN cp USING (id)), ctx AS (SELECT id, 0.4 * s + 0.3 * t + 0.3 * c AS score, list_filter([CASE WHEN s > 0.7 THEN 'high_semantic_relevance' END, CASE WHEN t > 0.7 THEN 'temporal_significance' END, CASE WHEN c > 0.7 THEN 'strong_contextual_coherence' END], lambda x: x IS NOT NULL) AS factors FROM cx)"
_R0 = f"z AS (SELECT id, 0.3 AS relationship FROM mem), f0 AS ({_FAC.format(r='z')}), p0 AS (SELECT f0.id, 0.4 * f0.score + 0.3 * 0.5 + 0.3 * ctx.score AS relevance FROM f0 JOIN ctx USING (id)), r1 AS (SELECT m.id, coalesce(avg((p0.relevance + CASE WHEN r.strength = 0 THEN 0.5 ELSE r.strength END) / 2), 0.3) AS relationship FROM mem m LEFT JOIN edges e ON e.src = m.id LEFT JOIN mem r ON r.id = e.dst LEFT JOIN p0 ON p0.id = e.dst GROUP BY m.id), f1 AS ({_FAC.format(r='r1')}), p1 AS (SELECT f1.id, 0.4 * f1.score + 0.15 + 0.3 * ctx.score AS relevance, f1.factors || ctx.factors AS factors FROM f1 JOIN ctx USING (id))"
_PART = "CASE WHEN hour({c}) < 6 THEN 'night' WHEN hour({c}) < 12 THEN 'morning' WHEN hour({c}) < 18 THEN 'afternoon' ELSE 'evening' END".format(c="ts")
_CONTEXT = "CASE WHEN hour(ts) BETWEEN 5 AND 11 THEN 'morning_context' WHEN hour(ts) BETWEEN 12 AND 16 THEN 'afternoon_context' WHEN hour(ts) BETWEEN 17 AND 21 THEN 'evening_context' ELSE 'night_context' END"
_KIND = "CASE WHEN dayofweek(ts) IN (0, 6) THEN 'weekend' ELSE 'weekday' END"
_DAYS = f"(((SELECT t FROM now) - {sms('last_accessed')}) / 86400000.0)"
_ACCESS = f"list_filter([CASE WHEN access_count > 100 THEN 'high_frequency' WHEN access_count > 50 THEN 'medium_frequency' ELSE 'low_frequency' END, CASE WHEN {_DAYS} < 1 THEN 'recently_accessed' WHEN {_DAYS} < 7 THEN 'weekly_access' WHEN {_DAYS} < 30 THEN 'monthly_access' END], lambda x: x IS NOT NULL)"
_DEPTH = "walk AS (SELECT src AS id, dst, 1 AS k FROM edges UNION SELECT w.id, e.dst, w.k + 1 FROM walk w JOIN edges e ON e.src = w.dst WHERE w.k < 5), d AS (SELECT m.id, coalesce(max(k), 0) AS depth FROM mem m LEFT JOIN walk USING (id) GROUP BY 1)"
_DEC = f"decd AS (SELECT id, type, greatest(0.1::DOUBLE, strength - 0.1 * (((SELECT t FROM now) - {sms('last_accessed')}) / 86400000.0) * exp(-access_count * 0.05::DOUBLE) / ((0.2 + strength / 2) * 1.5)) AS s FROM mem)"
_VAL = f"val AS (SELECT key, size, 0.4 * access_count + 0.3 / ln({_AGE.replace('ts)', 'last_accessed)', 1)} + 1) + 0.2 / ln({_AGE} + 1) + 0.1 / ln(size + 1.0) AS value FROM entries)"
_NOW = "now AS (SELECT epoch_us(TIMESTAMP '2024-01-31 00:00:00') / 1000.0 AS t)"
_TEL = "tel AS (SELECT worker_id, count(*) AS processed, avg(latency) AS avg_latency, min(latency) AS min_latency, max(latency) AS max_latency, avg(failed::INT) AS error_rate FROM tasks GROUP BY 1)"
_DT = "dt AS (SELECT metric, count(*) AS n, CASE WHEN count(*) >= 10 THEN avg(value) ELSE 0.5 END AS normal, CASE WHEN count(*) >= 10 THEN avg(value) + stddev_pop(value) ELSE 0.7 END AS warning, CASE WHEN count(*) >= 10 THEN avg(value) + 2 * stddev_pop(value) ELSE 0.9 END AS critical, avg(value) AS average FROM log GROUP BY 1)"


#: The pattern history: the last 20 memories of each type; similar ones are folded into the gated state.
_HIST = (
    "hist AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY ts DESC, id DESC) AS r FROM mem) WHERE r <= 20), nr AS (SELECT src AS id, count(*) AS n FROM edges GROUP BY 1), "
    "hp AS (SELECT m.id, h.ts AS hts, h.id AS hid, h.{relevance} AS rel FROM mem m LEFT JOIN nr a ON a.id = m.id JOIN hist h ON h.type = m.type LEFT JOIN nr b ON b.id = h.id "
    "WHERE (least(1.0::DOUBLE, coalesce(m.access_count, 0) / (CASE WHEN coalesce(h.access_count, 0) = 0 THEN 1.0::DOUBLE ELSE h.access_count END)) + greatest(0.0::DOUBLE, 1 - abs(epoch_us(m.ts) - epoch_us(h.ts)) / 1000.0 / 604800000.0) + CASE WHEN a.n IS NULL OR b.n IS NULL THEN 0.5 ELSE least(1.0::DOUBLE, a.n / b.n) END) / 3 > {limit}), "
    "hg AS (SELECT id, list(rel ORDER BY hts, hid) AS v FROM hp GROUP BY 1), "
    "hc AS (SELECT id, coalesce(v, []) AS v, list_transform(coalesce(v, [])[-5:], lambda x: 0.5 * tanh(0.3 * tanh(CASE WHEN x = 0 THEN 0.5 ELSE x END))) AS h, coalesce(v, [])[-3:] AS t FROM mem LEFT JOIN hg USING (id)), "
    "hs AS (SELECT id, CASE WHEN len(h) = 0 THEN 0.5 ELSE list_avg(h) END AS score, least(1.0::DOUBLE, len(v) / 10.0) * CASE WHEN len(h) = 0 THEN 1.0 ELSE least(1.0::DOUBLE, len(h) / 5.0) END AS confidence, "
    "list_filter([CASE WHEN len(v) > 0 THEN 'recurring_pattern' END, CASE WHEN len(v) >= 2 AND list_var_pop(t) > 0.1 THEN 'pattern_change' END, CASE WHEN len(h) > 0 AND abs(list_avg(h) - 0.5) > 0.5 THEN 'long_term_pattern' END], lambda x: x IS NOT NULL) AS factors FROM hc)"
)


WALK = _DEPTH
_R1 = "{p} AS (SELECT f{k}.id, 0.4 * f{k}.score + 0.3 * {h} + 0.3 * ctx.score AS relevance, f{k}.factors || {hf} ctx.factors AS factors FROM f{k} JOIN ctx USING (id){j})"
_RSTEP = "r{k} AS (SELECT m.id, coalesce(avg((p{b}.relevance + CASE WHEN r.strength = 0 THEN 0.5 ELSE r.strength END) / 2), 0.3) AS relationship FROM mem m LEFT JOIN edges e ON e.src = m.id LEFT JOIN mem r ON r.id = e.dst LEFT JOIN p{b} ON p{b}.id = e.dst GROUP BY m.id)"


def _levels(depth: int, history: bool = False) -> str:
    """f0, p0, r1, f1, p1, ...: relevance by levels of references."""
    more = {"h": "hs.score", "hf": "hs.factors ||", "j": " JOIN hs USING (id)"} if history else {"h": "0.5", "hf": "", "j": ""}
    parts = ["z AS (SELECT id, 0.3 AS relationship FROM mem)", f"f0 AS ({_FAC.format(r='z')})", _R1.format(p="p0", k=0, **more)]
    for k in range(1, depth + 1):
        parts += [_RSTEP.format(k=k, b=k - 1), f"f{k} AS ({_FAC.format(r=f'r{k}')})", _R1.format(p=f"p{k}", k=k, **more)]
    return ", ".join(parts)


_TAGS = f"tg AS (SELECT id, unnest(emotions) AS tag FROM mem UNION SELECT id, unnest(string_split(content, ' ')[1:5]) FROM mem UNION SELECT id, unnest([{_PART}, {_KIND}]) FROM mem UNION SELECT src, 'rel_' || type FROM edges JOIN mem ON id = dst UNION SELECT src, 'shared_' || e FROM (SELECT src, unnest(emotions) AS e FROM edges JOIN mem ON id = dst)), tn AS (SELECT id, count(DISTINCT tag) AS tags FROM tg GROUP BY 1)"
ENRICHED_CTES = f"WITH {MEM}, {_CTX}, {_levels(2)}, {_TAGS}"
ENRICHED = f"{ENRICHED_CTES} SELECT id, round(relevance, 6) + 0.0 AS predicted_relevance, coalesce(tags, 0)::INT AS tags, round(0.4 * relevance + 0.3 * strength + 0.2 * (coalesce(access_count, 0) / 100.0) + 0.1 * (coalesce(tags, 0) / 10.0), 6) + 0.0 AS importance, 128::INT AS weights, 0.1::DOUBLE AS decay_rate FROM mem JOIN p2 USING (id) LEFT JOIN tn USING (id)"


def _q(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " " + body


def _r(c: str, a: str | None = None) -> str:
    return f"round({c}, 6) + 0.0 AS {a or c}"


ORACLE_SQL = {
    "knn_topk": _q("SELECT query_id, id, similarity, rank FROM knn", _KNN),
    "pairwise_similarity": "SELECT a.label AS cluster_id, a.vec_id AS id_a, b.vec_id AS id_b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0 AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3",
    "merge_search_results": _q("SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM (SELECT query_id, id, max(similarity) AS similarity FROM knn GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 3", _KNN),
    "neural_rerank": _q("SELECT query_id, id, round(s, 6) + 0.0 AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM (SELECT query_id, id, similarity * (0.8 + 0.2 * list_sum(list_transform(embedding[1:8]::DOUBLE[], lambda x: abs(x))) / 8) AS s FROM knn JOIN embeddings v ON v.vec_id = knn.id)", _KNN),
    "composite_similarity": _q("SELECT id_a, id_b, round(0.4 * c + 0.3 * (len(list_intersect(ea, eb)) / len(list_distinct(ea || eb))) + 0.2 * (CASE WHEN pa = pb THEN 1 ELSE 0 END) + 0.1 * nc, 6) + 0.0 AS score FROM (SELECT a.id AS id_a, b.id AS id_b, list_cosine_similarity(a.vector[1:8], b.vector[1:8]) AS nc, list_cosine_similarity(a.vector, b.vector) AS c, a.emotions AS ea, b.emotions AS eb, a.p AS pa, b.p AS pb FROM mp a JOIN mp b ON a.cluster_id = b.cluster_id AND a.id < b.id) WHERE c >= 0.3", MEM, f"mp AS (SELECT *, {_PART} AS p FROM mem)"),
    "nearest_centroid": _q("SELECT id, cluster_id, round(similarity, 6) + 0.0 AS similarity FROM near", CENT, _NEAR),
    "partition_assign": _q("SELECT id, CASE WHEN similarity > 0.3 THEN cluster_id END AS cluster_id, round(similarity, 6) + 0.0 AS similarity FROM near", CENT, _NEAR),
    "partition_routing": _q("SELECT vec_id AS query_id, cluster_id FROM embeddings v, cent c WHERE vec_id % 20 = 0 AND cluster_id % 4 = 1 AND list_cosine_similarity(embedding::DOUBLE[], centroid) > 0.1", CENT),
    "cluster_centroid": "SELECT label AS cluster_id, count(*) AS n, pos - 1 AS pos, round(avg(embedding[pos]::DOUBLE), 6) + 0.0 AS x FROM embeddings, range(1, 65) t(pos) GROUP BY ALL",
    "centroid_distance": _q("SELECT vec_id AS id, round(list_distance(embedding::DOUBLE[], centroid), 6) + 0.0 AS distance FROM embeddings JOIN cent ON label = cluster_id", CENT),
    "cluster_coherence": _q("SELECT cluster_id, n, round(coherence, 6) + 0.0 AS coherence FROM coh", _COH),
    "cluster_isolation": _q("SELECT round(isolation, 6) + 0.0 AS isolation FROM iso", _SUMS, _ISO),
    "cluster_density": _q("SELECT cluster_id, round(density, 6) + 0.0 AS density FROM den", _DEN),
    "cluster_stability": _q("SELECT cluster_id, round(stability, 6) + 0.0 AS stability FROM stab", MEM, _H),
    "cluster_growth": _q("SELECT cluster_id, round(rate, 6) + 0.0 AS rate FROM grow", MEM, _H),
    "cluster_metadata": _q("SELECT cluster_id, size, round(average_strength, 6) + 0.0 AS average_strength, start, \"end\", array_to_string(list(e ORDER BY r), ',') AS dominant_emotions FROM meta JOIN e3 USING (cluster_id) GROUP BY ALL", MEM, _META, "e1 AS (SELECT cluster_id, unnest(emotions) AS e FROM mem)", "e3 AS (SELECT cluster_id, e, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, e) AS r FROM e1 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, e) <= 3)"),
    "cluster_metrics": _q("SELECT count(*) AS count, round(avg(n), 6) + 0.0 AS average_size, round(avg(coherence), 6) + 0.0 AS coherence, round((SELECT isolation FROM iso), 6) + 0.0 AS isolation, round((SELECT avg(density) FROM den), 6) + 0.0 AS density, round((SELECT avg(stability) FROM stab), 6) + 0.0 AS stability FROM coh", MEM, _H, _COH, _ISO, _DEN),
    "merge_recommendations": _q("SELECT a.cluster_id AS cluster1, b.cluster_id AS cluster2, round(list_cosine_similarity(a.centroid, b.centroid), 6) + 0.0 AS similarity FROM cent a JOIN cent b ON a.cluster_id < b.cluster_id WHERE list_cosine_similarity(a.centroid, b.centroid) >= 0.1", CENT),
    "partition_imbalance": _q("SELECT cluster_id, type, size, access_count, round(size / m, 6) + 0.0 AS ratio FROM sz, (SELECT avg(size) AS m FROM sz) WHERE abs(1 - size / m) > 0.05", MEM, "sz AS (SELECT cluster_id, type, count(*) AS size, sum(access_count) AS access_count FROM mem GROUP BY ALL)"),
    "merge_targets": _q("SELECT partition_id, target, round(s, 6) + 0.0 AS similarity FROM (SELECT a.cluster_id AS partition_id, b.cluster_id AS target, list_cosine_similarity(a.centroid, b.centroid) AS s FROM cent a JOIN cent b ON a.cluster_id <> b.cluster_id AND a.cluster_id % 4 = b.cluster_id % 4 QUALIFY row_number() OVER (PARTITION BY a.cluster_id ORDER BY list_cosine_similarity(a.centroid, b.centroid) DESC, b.cluster_id) = 1) WHERE s > 0", CENT),
    "partition_density": _q("SELECT round(sum(size) / count(*), 6) + 0.0 AS density, round(sum(access_count) / sum(size), 6) + 0.0 AS access_rate FROM sz", MEM, "sz AS (SELECT cluster_id, type, count(*) AS size, sum(access_count) AS access_count FROM mem GROUP BY ALL)"),
    "cluster_points": _q("SELECT id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, size, cluster, round(strength, 6) + 0.0 AS strength, round(stability, 6) + 0.0 AS stability, round(growth_rate, 6) + 0.0 AS growth_rate, start, \"end\" FROM pts", MEM, _H, _META, _PTS),
    "recent_points": _q("SELECT id, cluster FROM pts WHERE epoch_us(TIMESTAMP '2024-01-05') - epoch_us(start) < 7 * 86400000000", MEM, _H, _META, _PTS),
    "global_stats": _q("SELECT count(DISTINCT cluster) AS clusters, count(*) AS memories, count(DISTINCT CASE WHEN growth_rate > 0 THEN cluster END) AS active, count(DISTINCT CASE WHEN stability < 0.3 THEN cluster END) AS unstable FROM pts", MEM, _H, _META, _PTS),
    "cluster_entropy": _q("SELECT cluster_id, round(-sum(n / t * log2(n / t)), 6) + 0.0 AS entropy FROM (SELECT cluster_id, e, count(*) AS n, sum(count(*)) OVER (PARTITION BY cluster_id) AS t FROM (SELECT cluster_id, unnest(emotions) AS e FROM mem) GROUP BY 1, 2) GROUP BY 1", MEM),
    "emotion_histogram": _q("SELECT type, label, count(*) AS n FROM (SELECT type, unnest(emotions) AS label FROM mem) GROUP BY 1, 2", MEM),
    "age_distribution": _q(f"SELECT cluster_id, {_r(f'min({_AGE} / 86400000.0)', 'youngest')}, {_r(f'max({_AGE} / 86400000.0)', 'oldest')}, {_r(f'avg({_AGE} / 86400000.0)', 'mean')} FROM mem GROUP BY 1", MEM),
    "memory_metrics": _q(f"SELECT type, sum(coalesce(length(content), 0))::BIGINT AS total_size, count(*) FILTER (strength > 0.1) AS active, {_r('avg(strength)', 'average_strength')}, {_r(f'avg((1 - CASE WHEN strength = 0 THEN 1 ELSE strength END) / ({_AGE} / 86400000.0))', 'decay_rate')}, coalesce(round(count(*) FILTER (id % 3 = 0) / nullif(count(*) FILTER ({_AGE} < 604800000), 0), 6), 0) + 0.0 AS consolidation_rate, {_r(f'sum(({_AGE} < 604800000)::INT + (((SELECT t FROM now) - {sms(chr(108) + "ast_accessed")}) < 604800000)::INT) / 7.0', 'access_frequency')} FROM mem GROUP BY 1", MEM),
    "system_metrics": _q("SELECT round(count(*) / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000.0), 6) + 0.0 AS operations_per_second, round(avg(latency), 6) + 0.0 AS latency, round(avg(failed::INT), 6) + 0.0 AS error_rate FROM tasks", TASKS),
    "health_score": _q("SELECT round(s, 6) + 0.0 AS score, CASE WHEN s >= 0.7 THEN 'healthy' WHEN s >= 0.5 THEN 'warning' ELSE 'critical' END AS status FROM (SELECT 0.3 * (SELECT avg(strength) FROM mem) + 0.4 * (SELECT avg(stability) FROM stab) + 0.3 * (1 - (SELECT avg(failed::INT) FROM tasks)) AS s)", MEM, _H, TASKS),
    "dynamic_thresholds": _q("SELECT metric, round(normal, 6) + 0.0 AS normal, round(warning, 6) + 0.0 AS warning, round(critical, 6) + 0.0 AS critical FROM dt", LOG, _DT),
    "metric_summary": _q("SELECT metric, round(v[1], 6) + 0.0 AS current, round(average, 6) + 0.0 AS average, CASE WHEN len(v) < 2 OR abs((v[1] - v[-1]) / (len(v) - 1)) < 0.1 THEN 'stable' WHEN v[1] > v[-1] THEN 'increasing' ELSE 'decreasing' END AS trend, CASE WHEN v[1] >= critical THEN 'critical' WHEN v[1] >= warning THEN 'warning' ELSE 'normal' END AS status FROM dt JOIN t USING (metric)", LOG, _DT, "t AS (SELECT metric, list(value ORDER BY ts DESC)[1:5] AS v FROM log GROUP BY 1)"),
    "predicted_metric": f"WITH RECURSIVE {LOG}, s AS (SELECT metric, value, row_number() OVER (PARTITION BY metric ORDER BY ts) AS i FROM log), e AS (SELECT metric, i, value AS l FROM s WHERE i = 1 UNION ALL SELECT s.metric, s.i, 0.1 * s.value + 0.9 * e.l FROM e JOIN s ON s.metric = e.metric AND s.i = e.i + 1) SELECT metric, round(arg_max(l, i), 6) + 0.0 AS predicted FROM e GROUP BY 1",
    "metric_window": _q("SELECT metric, value FROM log WHERE ts >= DATE '2024-01-26'", LOG),
    "first_anomaly_time": _q("SELECT z.event_id, f.first_ts FROM z JOIN (SELECT event_type, value, min(ts) AS first_ts FROM events GROUP BY 1, 2) f USING (event_type, value)", "z AS (SELECT event_id, event_type, value FROM (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s, count(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) WHERE n = 30 AND s > 0 AND abs(value - m) / s > 2)"),
    "maintenance_triggers": _q("SELECT round(s, 6) + 0.0 AS mean_strength, round(a, 6) + 0.0 AS mean_access, array_to_string(list_filter([CASE WHEN s < 0.3 THEN 'low_strength' END, CASE WHEN a > 50 THEN 'high_access' END], lambda x: x IS NOT NULL), ',') AS anomalies, s < 0.3 OR a > 50 AS due FROM (SELECT avg(strength) AS s, avg(access_count) AS a FROM mem)", MEM),
    "adapted_base_rate": _q("SELECT round(greatest(0.05, 0.1 * (1 - 0.01 * (avg(0.2 + strength / 2) + avg(access_count) / 100))), 6) + 0.0 AS base_rate FROM mem", MEM),
    "store_telemetry": _q("SELECT id, count(*) OVER () AS memory_count, round(strength, 6) + 0.0 AS strength FROM mem WHERE type = 'semantic'", MEM),
    "decay": _q("SELECT id, round(s, 6) + 0.0 AS strength, s <= 0.1 AS archived FROM decd", MEM, _DEC),
    "archive_split": _q("SELECT type, count(*) AS archived FROM decd WHERE s <= 0.1 GROUP BY 1", MEM, _DEC),
    "importance": _q("SELECT id, round(0.7 * strength + 0.2 * access_count / 100 + 0.1 * len(emotions) / 10, 6) + 0.0 AS importance FROM mem", MEM),
    "relevance_factors": _q(f"SELECT id, round(score, 6) + 0.0 AS score, 0.8::DOUBLE AS confidence, array_to_string(factors, ',') AS factors FROM ({_FAC.format(r='rs')})", MEM, _REL),
    "coherence_parts": _q("SELECT id, round(semantic, 6) + 0.0 AS semantic, round(temporal, 6) + 0.0 AS temporal, round(emotional, 6) + 0.0 AS emotional FROM cp", MEM, _CP),
    "contextual_relevance": _q("SELECT id, round(score, 6) + 0.0 AS score, 0.75::DOUBLE AS confidence, array_to_string(factors, ',') AS factors FROM ctx", MEM, _CTX),
    "predicted_relevance": _q("SELECT id, round(relevance, 6) + 0.0 AS relevance, round((0.8 + 0 + 0.75) / 3, 6) + 0.0 AS confidence, array_to_string(factors, ',') AS factors, CASE WHEN len(factors) = 0 THEN 0.0::DOUBLE ELSE round(log2(len(factors)), 6) + 0.0 END AS entropy FROM p1", MEM, _CTX, _R0),
    "network_depth": "WITH RECURSIVE " + MEM + ", " + _DEPTH + " SELECT id, depth::INT AS depth FROM d",
    "tag_rank": _q("SELECT id, tag, confidence, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, tag) AS rank FROM (SELECT id, tag, max(c)::DOUBLE AS confidence FROM t GROUP BY 1, 2)", MEM, f"t AS (SELECT id, unnest(emotions) AS tag, 0.8 AS c FROM mem UNION ALL SELECT id, unnest(string_split(content, ' ')[1:5]), 0.8 FROM mem UNION ALL SELECT id, unnest([{_PART}, {_KIND}]), 0.7 FROM mem UNION ALL SELECT src, 'rel_' || type, 0.7 FROM edges JOIN mem ON id = dst UNION ALL SELECT src, 'shared_' || e, 0.7 FROM (SELECT src, unnest(emotions) AS e FROM edges JOIN mem ON id = dst))"),
    "memory_labels": _q(f"SELECT id, {_PART} AS part, {_CONTEXT} AS context, {_KIND} AS kind, array_to_string({_ACCESS}, ',') AS access, month(ts) || '/' || day(ts) AS date, CASE WHEN length(content) > 20 THEN content[1:20] || '...' ELSE content END AS preview, array_to_string(string_split(content, ' ')[1:5], '|') AS keywords, printf('rgb(%d, %d, %d)', floor(255 * (1 - strength))::INT, floor(255 * greatest(strength, 0.25))::INT, floor(255 * 0.75)::INT) AS colour FROM mem", MEM),
    "context_insights": _q(f"SELECT id, array_to_string(list_sort(list_distinct([{_CONTEXT}, {_KIND} || '_context', {_PART}, {_KIND}] || {_ACCESS})), ',') AS insights FROM mem", MEM),
    "analysis_trend": "SELECT CASE WHEN d IS NULL OR abs(d) < 0.1 THEN 'stable' WHEN d > 0 THEN 'increasing' ELSE 'decreasing' END AS trend, count(*) AS n FROM (SELECT value / 100 - lag(value / 100) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events) GROUP BY 1",
    "consolidation_groups": "WITH RECURSIVE " + MEM + ", r AS (SELECT cluster_id, id, vector AS v, row_number() OVER (PARTITION BY cluster_id ORDER BY id) AS i FROM mem), g AS (SELECT cluster_id, i, id, id AS seed, [{'id': id, 'v': v}] AS seeds FROM r WHERE i = 1 UNION ALL SELECT cluster_id, i, id, coalesce(hit, id) AS seed, CASE WHEN hit IS NULL THEN list_append(seeds, {'id': id, 'v': v}) ELSE seeds END AS seeds FROM (SELECT r.cluster_id, r.i, r.id, r.v, g.seeds, list_filter(g.seeds, lambda s: 0.4 * list_cosine_similarity(s.v, r.v) >= 0.15)[1].id AS hit FROM g JOIN r ON r.cluster_id = g.cluster_id AND r.i = g.i + 1)) SELECT cluster_id, id, seed FROM g",
    "historical_pattern": _q("SELECT id, round(score, 6) + 0.0 AS score, round(confidence, 6) + 0.0 AS confidence, array_to_string(factors, ',') AS factors FROM hs", MEM, _HIST.format(limit="0.5", relevance="strength")),
    "relevance_with_history": _q("SELECT p1.id, round(relevance, 6) + 0.0 AS relevance, round((0.8 + confidence + 0.75) / 3, 6) + 0.0 AS confidence, array_to_string(p1.factors, ',') AS factors FROM p1 JOIN hs USING (id)", MEM, _CTX, _HIST.format(limit="0.6", relevance="strength"), _levels(1, True)),
    "full_context": _q(f"SELECT id, array_to_string(list_sort(list_distinct([{_CONTEXT}, {_KIND} || '_context', {_PART}, {_KIND}] || {_ACCESS} || list_filter(['location_' || CASE WHEN id % 3 = 0 THEN 'home' ELSE 'work' END, CASE WHEN id % 2 = 0 THEN 'context_quiet' END, CASE WHEN id % 5 = 0 THEN 'social_family' END], lambda x: x IS NOT NULL) || coalesce(sem, []))), ',') AS insights FROM mem LEFT JOIN sm USING (id)", MEM, "hist AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY ts DESC, id DESC) AS r FROM mem) WHERE r <= 20)", "sm AS (SELECT m.id, list_distinct(flatten(list(list_transform(h.emotions, lambda e: 'semantic_' || e)))) AS sem FROM mem m JOIN hist h ON h.type = m.type WHERE list_cosine_similarity(m.vector, h.vector) > 0.05 GROUP BY 1)"),
    "merged_memories": _q("SELECT cluster_id::BIGINT AS seed, sum(length(content)) + 3 * (count(content) - 1) AS chars, round(max(strength), 6) + 0.0 AS strength, count(*) AS members FROM mem GROUP BY 1", MEM),
    "cache_value": _q("SELECT key, round(value, 6) + 0.0 AS value FROM val", ENTRIES, _NOW, _VAL),
    "ttl_expiry": _q(f"SELECT key FROM entries WHERE {_AGE} <= 29.95 * 86400000", ENTRIES, _NOW),
    "lru_eviction": _q("SELECT key, size FROM (SELECT key, size, sum(size) OVER (ORDER BY last_accessed DESC, key DESC ROWS UNBOUNDED PRECEDING) AS run FROM entries) WHERE run + 100 <= 40000", ENTRIES),
    "value_trim": _q("SELECT key, size FROM (SELECT key, size, sum(size) OVER () AS total, sum(size) OVER (ORDER BY value DESC, key DESC ROWS UNBOUNDED PRECEDING) AS run FROM val) WHERE total <= 48000 OR run <= 36000", ENTRIES, _NOW, _VAL),
    "cache_stats": _q(f"SELECT count(*) AS entries, sum(size) AS bytes, round(avg({sms('last_accessed')} - {sms('ts')}), 1) AS mean_access_ms, round(sum(access_count - 1) / sum(access_count), 6) + 0.0 AS hit_rate FROM entries", ENTRIES),
    "priority_queue": _q("SELECT id, least(10, greatest(0, priority)) AS priority, row_number() OVER (ORDER BY CASE WHEN least(10, priority) >= 5 THEN least(10, priority) ELSE -1 END DESC, created, id) AS place FROM tasks", TASKS),
    "pool_telemetry": _q("SELECT worker_id, processed, round(avg_latency * processed, 6) + 0.0 AS total_latency, round(min_latency, 6) + 0.0 AS min_latency, round(max_latency, 6) + 0.0 AS max_latency, round(error_rate, 6) + 0.0 AS error_rate FROM tel", TASKS, _TEL),
    "worker_probability": _q("SELECT worker_id, round(1000 / avg_latency / (SELECT count(*) FROM tel) * (1 - error_rate / 2) * (1 - (processed % 10 / 20.0 + 0.3) / 2), 6) + 0.0 AS weight FROM tel", TASKS, _TEL),
    "least_healthy": _q("SELECT worker_id, round(1 - error_rate / 2, 6) + 0.0 AS health FROM tel ORDER BY 1 - error_rate / 2, worker_id LIMIT 5", TASKS, _TEL),
    "state_times": "SELECT user_id AS worker_id, event_type AS state, round(sum(n), 6) + 0.0 AS ms FROM (SELECT user_id, event_type, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) - epoch_us(ts)) / 1000.0 AS n FROM events) WHERE n IS NOT NULL GROUP BY 1, 2",
    "task_estimates": _q("SELECT id, round((0.05 * priority + 0.03)::DOUBLE, 6) + 0.0 AS cpu, round((0.02 * priority + 0.03)::DOUBLE, 6) + 0.0 AS memory, round((15000 * (1 - 0.05 * priority))::DOUBLE, 6) + 0.0 AS done_ms, round(0.45 + 0.1 * 1000 / latency, 6) + 0.0 AS efficiency, round((CASE WHEN failed THEN 0.81 ELSE 0.95 END)::DOUBLE, 6) + 0.0 AS health, least(8, greatest(2, floor(4 * (1 + 0.5 * (priority / 4 + 0.45 - 1)) + 0.5)))::INT AS pool FROM tasks", TASKS),
    "page_slice": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 40",
    "first_rows": "SELECT s_nationkey, s_suppkey FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) <= 2",
    "type_scan": _q("SELECT id, type FROM mem WHERE type = 'emotional'", MEM),
    "key_lookup": _q("SELECT id, round(strength, 6) + 0.0 AS strength FROM mem WHERE strength > 0.5", MEM),
}
