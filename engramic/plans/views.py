"""Charts, forecasts, registries, pool states and the seams for user functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scores as X
from ..operators import cache, lifecycle, listing, metrics, pool, predict, search, series, statistics
from ..params import Metrics, Partitions
from ..sources.embedding import embedded
from ..sources.store import from_json, to_json
from .common import ENTRIES, LOG, MEM, TASKS, as_of, cache_entries, edges, log, memories, r6, rounded, table, tasks
from .memories import ENRICHED_CTES
from .statistics import _FITS, EV, ORD

M10 = Metrics(anomaly_window=10)


def _events(s, d):
    return table(s, d, "events")


def _levels(s, d, alpha=0.3):
    return series.smooth(_events(s, d), EV, ORD, "value", alpha)


def _forecast_curve(s, d):
    fits = statistics.distribution_fits(_events(s, d), EV, "value").where("kind = 'normal'")
    level = _levels(s, d)
    return rounded(series.forecast_curve(level, EV, fits, series.distribution_shift(level, EV)), "x", "y")


def _history(s, d):
    m = memories(s, d)
    return predict.history_of(m, m.select("id", F.col("strength").alias("relevance")), edges(m))


def _tag_confidence(s, d):
    m = memories(s, d).where("id % 7 = 0")
    return rounded(predict.tag_confidence(m.select("id", "type", F.explode("emotions").alias("tag")), _history(s, d)), "confidence")


def _tasks(s, d):
    return tasks(s, d).select("id", "priority", F.col("created").cast("timestamp").alias("created"))


def _workers(s, d):
    """Workers by their tasks: even ones hold their first task."""
    g = tasks(s, d).groupBy("worker_id").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("int")).alias("errors"), F.sum("latency").alias("total"))
    even = F.col("worker_id") % 2 == 0
    return g.select("worker_id", F.when(even, F.col("first")).alias("task_id"), even.alias("busy"), (1 / (1 + F.col("worker_id") % 8)).alias("health"), (F.col("errors") % 8).alias("errors"), (F.col("worker_id") % 10 / 5.0).alias("efficiency"), (F.col("worker_id") % 4 / 4.0).alias("cpu"), F.lit(0.25).alias("memory"))


def _measure(texts: list[str]) -> list[list[float]]:
    """A function in the place of a model: the characters and words of a text."""
    return [[float(len(t)), float(len(t.split(" ")))] for t in texts]


def _embedded(s, d):
    m = memories(s, d).select("id", "content")
    return embedded(m, _measure).select("id", F.col("vector")[0].alias("chars"), F.col("vector")[1].alias("words"))


def _json(s, d):
    m = memories(s, d).select("id", "type", "strength", "emotions")
    back = from_json(to_json(m), T.StructType([*m.schema.fields[:2], T.StructField("strength", T.DoubleType()), m.schema["emotions"]]))
    return back.select("id", "type", r6("strength").alias("strength"), F.array_join("emotions", ",").alias("emotions"))


def _run_tasks(s, d):
    t = tasks(s, d).select("id", F.when(F.col("id") % 3 == 0, "square").when(F.col("id") % 3 == 1, "half").otherwise("other").alias("type"), F.col("priority").cast("double").alias("value"))
    return pool.run_tasks(t, {"square": lambda v: v * v, "half": lambda v: v / 2})


def _ingested(s, d):
    m = memories(s, d)
    cent = search.centroids(m, "cluster_id").drop("n")
    parts = m.groupBy("cluster_id").agg(F.min("type").alias("type"), F.count(F.lit(1)).alias("size")).join(cent, "cluster_id").withColumn("partition_id", F.col("cluster_id").cast("string")).drop("cluster_id")
    got = lifecycle.ingest(m, edges(m), as_of(), parts, cent.withColumnRenamed("cluster_id", "list_id"), Partitions(similarity=0.1))
    return got.select("id", r6("predicted_relevance").alias("predicted_relevance"), "partition_id", "created", "list_id")


def _merged_tags(s, d):
    m = memories(s, d).withColumn("ai_generated_tags", F.col("emotions"))
    got = lifecycle.merge_groups(m, m.select("id", F.col("cluster_id").cast("long").alias("seed")))
    return got.select("seed", F.array_join("tags", ",").alias("tags"), "members")


def _idle(s, d):
    g = tasks(s, d).groupBy("worker_id").agg(F.max("created").alias("last"))
    w = g.select("worker_id", (F.col("worker_id") % 2 == 0).alias("busy"), F.col("last").cast("timestamp").alias("last_active"))
    return pool.idle_to_stop(w, F.lit("2002-01-01").cast("timestamp"), 60_000, 70).select("worker_id")


def _doubled(f: pd.DataFrame) -> pd.DataFrame:
    return f.assign(value=f["value"] * 2)


def _latency(s, d):
    return tasks(s, d).groupBy(F.col("ts").alias("ts")).agg(F.round(F.avg("latency"), 4).alias("value"))


QUERIES = {
    "ema_events": lambda s, d: rounded(_levels(s, d), "x", "level"),
    "forecast_tail": lambda s, d: rounded(series.forecast_tail(_levels(s, d, 0.1), EV), "value"),
    "forecast_curve": _forecast_curve,
    "stats_view": lambda s, d: rounded(series.stats_view(_events(s, d), EV, ORD, "value"), "x", "y"),
    "metric_view": lambda s, d: rounded(metrics.metric_view(log(s, d), M10).drop("ts"), "value", "level"),
    "prediction_view": lambda s, d: rounded(predict.prediction_view(_history(s, d)).drop("ts"), "relevance", "level"),
    "tag_confidence": _tag_confidence,
    "metric_registry": lambda s, d: rounded(metrics.registry(log(s, d)), "normal", "warning", "critical"),
    "metric_history": lambda s, d: rounded(metrics.history(log(s, d), "click"), "value"),
    "latency_spikes": lambda s, d: rounded(pool.latency_spikes(_latency(s, d), 40, 1.0).drop("ts"), "value"),
    "task_assignments": lambda s, d: pool.assignments(_tasks(s, d), _workers(s, d)).select("id", "worker_id"),
    "timed_out_tasks": lambda s, d: pool.timed_out(_tasks(s, d), _workers(s, d), F.lit("1998-06-01").cast("timestamp"), 365 * 86_400_000),
    "health_actions": lambda s, d: pool.health_actions(_workers(s, d)),
    "scaling_target": lambda s, d: pool.scaling_target(_tasks(s, d).where("id % 50 = 0"), _workers(s, d)),
    "pool_state": lambda s, d: pool.pool_state(_tasks(s, d), _workers(s, d)),
    "rejected_tasks": lambda s, d: pool.terminated(_tasks(s, d).where("priority > 9")),
    "workers_to_stop": lambda s, d: pool.resize(_workers(s, d), 2, 60)[1],
    "embedded_texts": _embedded,
    "json_rows": _json,
    "run_tasks": _run_tasks,
    "pool_resources": lambda s, d: rounded(pool.resource_usage(_workers(s, d)), "cpu", "memory", "least_efficiency", "greatest_efficiency"),
    "idle_workers": _idle,
    "ingested_memories": _ingested,
    "merged_tags": _merged_tags,
    "pattern_history": lambda s, d: _history(s, d).select("type", F.col("h_id").alias("id"), r6("h_relevance").alias("relevance")),
    "telemetry_bundle": lambda s, d: rounded(metrics.telemetry_bundle(memories(s, d), log(s, d).withColumn("ts", F.col("ts").cast("timestamp")), as_of(), Metrics(anomaly_window=5, window_ms=20 * 86_400_000)), "value"),
    "cache_delete": lambda s, d: cache.delete(cache_entries(s, d), cache_entries(s, d).where("key % 3 = 0")).select("key", "size"),
    "entry_bytes": lambda s, d: cache_entries(s, d).select("key", X.entry_bytes(F.struct("key", "access_count", "size")).alias("bytes")),
    "batched_rows": lambda s, d: listing.process_batches(_events(s, d).select("event_id", "value"), _doubled, "event_id long, value double", 50).withColumn("value", r6("value")),
}

_E = "s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx FROM events), e AS (SELECT event_type, idx, value AS x, value AS level FROM s WHERE idx = 0 UNION ALL SELECT s.event_type, s.idx, s.value, {a} * s.value + (1 - {a}) * e.level FROM e JOIN s ON s.event_type = e.event_type AND s.idx = e.idx + 1)"
_SHIFT = "z AS (SELECT event_type, arg_max(level, idx) AS m, max(idx) AS k, min(level) AS lo, max(level) AS hi FROM e GROUP BY 1), sd AS (SELECT event_type, sqrt(sum(pow(level - m, 2)) / (count(*) + 4)) AS sd FROM e JOIN z USING (event_type) WHERE idx > k - 45 GROUP BY 1)"
_NORMAL = "exp(-0.5 * pow((x - {m}) / {s}, 2)) / ({s} * sqrt(2 * pi()))"
_HIST = "hist AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY ts, id) - 1 AS idx, count(*) OVER (PARTITION BY type) AS n FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY ts DESC, id DESC) AS r FROM mem) WHERE r <= 20)"
_W = "w AS (SELECT worker_id, CASE WHEN worker_id % 2 = 0 THEN min(id) END AS task_id, worker_id % 2 = 0 AS busy, 1 / (1 + worker_id % 8) AS health, sum(failed::INT) % 8 AS errors, worker_id % 10 / 5.0::DOUBLE AS efficiency, worker_id % 4 / 4.0::DOUBLE AS cpu, 0.25::DOUBLE AS memory FROM tasks GROUP BY worker_id)"

ORACLE_SQL = {
    "ema_events": f"WITH RECURSIVE {_E.format(a='0.3')} SELECT event_type, idx::INT AS idx, round(x, 6) + 0.0 AS x, round(level, 6) + 0.0 AS level FROM e",
    "forecast_tail": f"WITH RECURSIVE {_E.format(a='0.1')}, n AS (SELECT event_type, max(idx) AS k FROM e GROUP BY 1) SELECT event_type, (idx - greatest(k - 4, 0) + 1)::INT AS step, round(level, 6) + 0.0 AS value FROM e JOIN n USING (event_type) WHERE idx > k - 5",
    "forecast_curve": f"WITH RECURSIVE {_E.format(a='0.3')}, {_SHIFT}, c AS (SELECT event_type, i AS step, lo + (hi - lo) * i / 100 AS x, m, sd FROM z JOIN sd USING (event_type), range(0, 101) t(i)) SELECT event_type, step::INT AS step, round(x, 6) + 0.0 AS x, round({_NORMAL.format(m='m', s='sd')}, 6) + 0.0 AS y FROM c",
    "stats_view": f"WITH RECURSIVE {_E.format(a='0.3')}, {_SHIFT}, {_FITS}, hw AS (SELECT event_type, (max(value) - min(value)) / 20 AS w, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1), d AS (SELECT event_type, lo + (hi - lo) * i / 100 AS x, kind, p1, p2 FROM hw JOIN best USING (event_type), range(0, 101) t(i)), fc AS (SELECT event_type, lo + (hi - lo) * i / 100 AS x, m, sd, kind FROM z JOIN sd USING (event_type) JOIN best USING (event_type), range(0, 101) t(i)), ro AS (SELECT event_type, idx, value, avg(value) OVER w AS m, stddev_samp(value) OVER w AS sd, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY event_type ORDER BY idx ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)), u AS (SELECT event_type, 'histogram' AS part, floor(value / w) * w AS x, count(*)::DOUBLE AS y FROM events JOIN hw USING (event_type) GROUP BY ALL UNION ALL SELECT event_type, 'density', x, coalesce(CASE WHEN kind = 'normal' THEN {_NORMAL.format(m='p1', s='p2')} WHEN kind = 'lognormal' AND x > 0 THEN exp(-0.5 * pow((ln(greatest(x, 1e-300)) - p1) / p2, 2)) / (p2 * sqrt(2 * pi()) * x) WHEN kind = 'exponential' AND x >= 0 THEN p1 * exp(-p1 * x) END, 0) FROM d UNION ALL SELECT event_type, 'outlier', idx, value FROM ro WHERE n = 50 AND abs(value - m) > 2 * sd UNION ALL SELECT event_type, 'forecast', x, CASE WHEN kind = 'normal' AND sd > 0 THEN {_NORMAL.format(m='m', s='sd')} ELSE 0 END FROM fc) SELECT event_type, part, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM u",
    "metric_view": f"WITH RECURSIVE {LOG}, s AS (SELECT metric, value, row_number() OVER (PARTITION BY metric ORDER BY ts) - 1 AS idx, count(*) OVER (PARTITION BY metric) AS k, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd, count(*) OVER w AS n FROM log WINDOW w AS (PARTITION BY metric ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)), e AS (SELECT metric, idx, value AS level FROM s WHERE idx = 0 UNION ALL SELECT s.metric, s.idx, 0.1 * s.value + 0.9 * e.level FROM e JOIN s ON s.metric = e.metric AND s.idx = e.idx + 1) SELECT metric, idx, round(value, 6) + 0.0 AS value, round(level, 6) + 0.0 AS level, coalesce(n = 10 AND sd > 0 AND abs(value - m) / sd > 2, false) AS anomaly, idx >= k - 5 AS forecast FROM s JOIN e USING (metric, idx)",
    "prediction_view": f"WITH RECURSIVE {MEM}, {_HIST}, e AS (SELECT type, idx, strength AS level FROM hist WHERE idx = 0 UNION ALL SELECT h.type, h.idx, 0.2 * h.strength + 0.8 * e.level FROM e JOIN hist h ON h.type = e.type AND h.idx = e.idx + 1), c AS (SELECT type, avg(strength) AS m, stddev_pop(strength) AS sd FROM hist WHERE idx >= n - 10 GROUP BY 1 HAVING count(*) >= 10) SELECT type, idx, round(strength, 6) + 0.0 AS relevance, round(level, 6) + 0.0 AS level, idx >= n - 5 AS forecast, coalesce(abs(strength - m) > 2 * sd, false) AS anomaly FROM hist JOIN e USING (type, idx) LEFT JOIN c USING (type)",
    "tag_confidence": f"WITH {MEM}, {_HIST}, t AS (SELECT id, type, unnest(emotions) AS tag FROM mem WHERE id % 7 = 0) SELECT id, tag, round((SELECT count(*) FILTER (list_contains(h.emotions, t.tag)) / count(*) FROM hist h WHERE h.type = t.type), 6) + 0.0 AS confidence FROM t",
    "metric_registry": f"WITH {LOG}, k AS (SELECT unnest(['memoryUsage', 'clusterStability', 'systemPerformance', 'errorRate', 'accessLatency', 'operationsCount', 'cpuUsage']) AS metric UNION SELECT metric FROM log) SELECT metric, count(value) AS n, CASE WHEN count(value) >= 10 THEN round(avg(value), 6) + 0.0 ELSE 0.5 END AS normal, CASE WHEN count(value) >= 10 THEN round(avg(value) + stddev_pop(value), 6) + 0.0 ELSE 0.7 END AS warning, CASE WHEN count(value) >= 10 THEN round(avg(value) + 2 * stddev_pop(value), 6) + 0.0 ELSE 0.9 END AS critical FROM k LEFT JOIN log USING (metric) GROUP BY 1",
    "metric_history": f"WITH {LOG} SELECT ts, round(value, 6) + 0.0 AS value FROM log WHERE metric = 'click'",
    "latency_spikes": f"WITH {TASKS}, l AS (SELECT ts, round(avg(latency), 4) AS value FROM tasks GROUP BY 1 ORDER BY ts DESC LIMIT 40), a AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM l) SELECT 'latency_spike' AS kind, round(value, 6) + 0.0 AS value FROM l, a WHERE abs(value - m) > s",
    "task_assignments": f"WITH {TASKS}, {_W} SELECT tasks.id, w.worker_id FROM tasks LEFT JOIN w ON w.task_id = tasks.id",
    "timed_out_tasks": f"WITH {TASKS}, {_W} SELECT tasks.id, w.worker_id, 'Task timeout' AS error FROM tasks JOIN w ON w.task_id = tasks.id WHERE epoch_us(TIMESTAMP '1998-06-01') - epoch_us(created::TIMESTAMP) > 365 * 86400000000",
    "health_actions": f"WITH {TASKS}, {_W} SELECT worker_id, CASE WHEN health < 0.2 THEN 'replace' ELSE 'heal' END AS action FROM w WHERE health < 0.5 OR errors > 5 OR efficiency < 0.5",
    "scaling_target": f"WITH {TASKS}, {_W}, q AS (SELECT count(*) AS queued FROM tasks WHERE id % 50 = 0 AND id NOT IN (SELECT task_id FROM w WHERE task_id IS NOT NULL)) SELECT count(*) AS active, any_value(queued) AS queued, least(8, greatest(2, floor(count(*) * (1 + 0.5 * (any_value(queued) / count(*) + (avg(cpu) + avg(memory)) / 2 - 1)) + 0.5)))::INT AS target FROM w, q",
    "pool_state": f"WITH {TASKS}, {_W} SELECT (SELECT count(*) FROM tasks) AS queue_length, count(*) FILTER (busy) AS busy, false AS idle FROM w",
    "rejected_tasks": f"WITH {TASKS} SELECT id, 'Worker pool terminated' AS error FROM tasks WHERE priority > 9",
    "workers_to_stop": f"WITH {TASKS}, {_W} SELECT worker_id FROM w WHERE NOT busy ORDER BY health, worker_id LIMIT greatest(0, (SELECT count(*) FROM w) - 60)",
    "embedded_texts": f"WITH {MEM} SELECT id, length(content)::DOUBLE AS chars, len(string_split(content, ' '))::DOUBLE AS words FROM mem",
    "run_tasks": f"WITH {TASKS} SELECT id, CASE id % 3 WHEN 0 THEN priority * priority WHEN 1 THEN priority / 2 END::DOUBLE AS result, CASE WHEN id % 3 = 2 THEN 'Unknown task type: other' END AS error FROM tasks",
    "pool_resources": f"WITH {TASKS}, {_W} SELECT count(*) AS workers, round(avg(cpu), 6) + 0.0 AS cpu, round(avg(memory), 6) + 0.0 AS memory, round(min(efficiency), 6) + 0.0 AS least_efficiency, round(max(efficiency), 6) + 0.0 AS greatest_efficiency FROM w",
    "idle_workers": f"WITH {TASKS}, i AS (SELECT worker_id, max(created) AS last FROM tasks GROUP BY 1) SELECT worker_id FROM i WHERE worker_id % 2 <> 0 ORDER BY last, worker_id LIMIT greatest(0, (SELECT count(*) FROM i) - 70)",
    "ingested_memories": f"{ENRICHED_CTES}, mc AS (SELECT cluster_id, list(x ORDER BY pos) AS centroid FROM (SELECT cluster_id, pos, avg(vector[pos]) AS x FROM mem, range(1, 65) t(pos) GROUP BY ALL) GROUP BY 1), own AS (SELECT m.id, c.cluster_id, list_cosine_similarity(m.vector, c.centroid) AS s FROM mem m JOIN mc c ON c.cluster_id % 4 = m.cluster_id % 4 QUALIFY row_number() OVER (PARTITION BY m.id ORDER BY list_cosine_similarity(m.vector, c.centroid) DESC, c.cluster_id::VARCHAR) = 1), ls AS (SELECT m.id, c.cluster_id AS list_id FROM mem m, mc c QUALIFY row_number() OVER (PARTITION BY m.id ORDER BY list_cosine_similarity(m.vector, c.centroid) DESC, c.cluster_id) = 1) SELECT id, round(relevance, 6) + 0.0 AS predicted_relevance, CASE WHEN s > 0.1 THEN cluster_id::VARCHAR ELSE 'new_' || id END AS partition_id, s <= 0.1 AS created, list_id FROM p2 JOIN own USING (id) JOIN ls USING (id)",
    "merged_tags": f"WITH {MEM} SELECT cluster_id::BIGINT AS seed, array_to_string(list_sort(list_distinct(flatten(list(emotions)))), ',') AS tags, count(*) AS members FROM mem GROUP BY 1",
    "pattern_history": f"WITH {MEM}, {_HIST} SELECT type, id, round(strength, 6) + 0.0 AS relevance FROM hist",
    "telemetry_bundle": f"WITH {MEM}, {LOG}, z AS (SELECT metric, ts, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd, count(*) OVER w AS n FROM log WINDOW w AS (PARTITION BY metric ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)), u AS (SELECT 'count' AS part, 'memories' AS key, count(*)::DOUBLE AS value FROM mem UNION ALL SELECT 'partition', type, count(*) FROM mem GROUP BY type UNION ALL SELECT 'strength', type, avg(strength) FROM mem GROUP BY type UNION ALL SELECT 'anomaly', metric, value FROM z WHERE n = 5 AND sd > 0 AND abs(value - m) / sd > 2 AND ts >= DATE '2024-01-11') SELECT part, key, round(value, 6) + 0.0 AS value FROM u",
    "cache_delete": f"WITH {ENTRIES} SELECT key, size FROM entries WHERE key % 3 <> 0",
    "entry_bytes": f"WITH {ENTRIES} SELECT key, length(to_json({{'key': key, 'access_count': access_count, 'size': size::BIGINT}})::VARCHAR) * 2 AS bytes FROM entries",
    "batched_rows": "SELECT event_id, round(value * 2, 6) + 0.0 AS value FROM events",
    "json_rows": f"WITH {MEM} SELECT id, type, round(strength, 6) + 0.0 AS strength, array_to_string(emotions, ',') AS emotions FROM mem",
}
