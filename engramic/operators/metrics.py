"""Operational metrics of memories, clusters and the system, over explicit ``as_of`` times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import age_days, ms, or_default, safe_div
from ..functions.scores import health_status, threshold_status, trend_label
from ..params import DAY_MS, Decay, Metrics
from .ordering import numbered
from .series import last_level, rolling_z, smooth

M, D = Metrics(), Decay()


def memory_metrics(memories: DataFrame, as_of: Column, keys: tuple[str, ...] = (), window_ms: int = M.window_ms) -> DataFrame:
    """Total size, active memories, mean strength, mean decay rate ((1 - strength) per day of age; a
    strength of zero counts as 1, an age of zero gives 0), consolidation rate (all consolidated over
    those of the window) and accesses in the window per day.

    ``memories``: strength, ts, and optionally size, consolidated, access_history.
    """
    has = lambda c, d: F.col(c) if c in memories.columns else d
    recent = (ms(as_of) - ms("ts")) < window_ms
    size = F.coalesce(has("size", F.lit(0)).cast("long"), F.lit(0).cast("long"))
    rate = safe_div(1 - or_default("strength", 1.0), age_days("ts", as_of))
    consolidated = F.coalesce(has("consolidated", F.lit(False)), F.lit(False))
    hits = F.size(F.filter(has("access_history", F.array().cast("array<timestamp>")), lambda t: (ms(as_of) - F.unix_micros(t) / 1000.0) < window_ms))
    return memories.groupBy(*keys).agg(
        F.sum(size).alias("total_size"),
        F.count_if(F.col("strength") > 0.1).alias("active"),
        F.avg(F.coalesce("strength", F.lit(0.0))).alias("average_strength"),
        F.avg(rate).alias("decay_rate"),
        safe_div(F.count_if(consolidated), F.count_if(recent)).alias("consolidation_rate"),
        (F.coalesce(F.sum(F.greatest(hits, F.lit(0))), F.lit(0)) / (window_ms / DAY_MS)).alias("access_frequency"),
    )


def system_metrics(tasks: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Operations per second over the span of the log, mean latency, error ratio; processor and memory
    use are averaged from input columns where the log has them."""
    span = (F.max(ms("ts")) - F.min(ms("ts"))) / 1000
    extra = [F.avg(c).alias(c) for c in ("cpu", "memory") if c in tasks.columns]
    return tasks.groupBy(*keys).agg(safe_div(F.count(F.lit(1)), span).alias("operations_per_second"), F.avg("latency").alias("latency"), F.avg(F.col("failed").cast("double")).alias("error_rate"), *extra)


def health(strength: Column, stability: Column, error_rate: Column, warning: float = M.warning, critical: float = M.critical) -> tuple[Column, Column]:
    """(score, status)."""
    score = 0.3 * strength + 0.4 * stability + 0.3 * (1 - error_rate)
    return score, health_status(score, warning, critical)


def dynamic_thresholds(log: DataFrame, least: int = 10, m: Metrics = M) -> DataFrame:
    """(metric, normal, warning, critical): mean, + 1 and + 2 population deviations from ``least`` values
    on, the configured ones before. ``log(metric, ts, value)``."""
    g = log.groupBy("metric").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"), F.count(F.lit(1)).alias("_n"))
    ok = F.col("_n") >= least
    return g.select("metric", *[F.when(ok, F.col("_m") + k * F.col("_s")).otherwise(F.lit(d)).alias(n) for n, k, d in (("normal", 0, m.normal), ("warning", 1, m.warning), ("critical", 2, m.critical))])


def metric_summary(log: DataFrame, tail: int = 5, least: int = 10) -> DataFrame:
    """(metric, current, average, trend of the last ``tail`` values, status)."""
    w = Window.partitionBy("metric").orderBy(F.desc("ts"), F.desc("value"))
    r = log.withColumn("_r", F.row_number().over(w))
    g = r.groupBy("metric").agg(F.max(F.when(F.col("_r") == 1, F.col("value"))).alias("current"), F.avg("value").alias("average"), F.max(F.when(F.col("_r") <= tail, F.col("_r"))).alias("_k"), F.max_by("value", F.when(F.col("_r") <= tail, F.col("_r"))).alias("_old"))
    j = g.join(dynamic_thresholds(log, least), "metric")
    # the mean of consecutive changes is the last value less the first, over their number
    change = F.try_divide(F.col("current") - F.col("_old"), F.col("_k") - 1)
    return j.select("metric", "current", "average", trend_label(change).alias("trend"), threshold_status(F.col("current"), F.col("warning"), F.col("critical")).alias("status"))


def predicted_metric(log: DataFrame, alpha: float = M.smoothing) -> DataFrame:
    """(metric, predicted): the last smoothed level."""
    return last_level(smooth(log, ["metric"], ["ts"], "value", alpha), ["metric"]).select("metric", F.col("level").alias("predicted"))


def in_window(log: DataFrame, as_of: Column, window_ms: int = M.window_ms) -> DataFrame:
    """Rows no older than the window."""
    return log.where((ms(as_of) - ms("ts")) <= window_ms)


def first_of_value(anomalies: DataFrame, log: DataFrame, key: str = "metric") -> DataFrame:
    """Each anomaly's value with the first time that the value occurred at all."""
    first = log.groupBy(key, "value").agg(F.min("ts").alias("first_ts"))
    return anomalies.join(first, [key, "value"])


def maintenance_triggers(memories: DataFrame, last_run: Column, as_of: Column, low_strength: float = 0.3, high_access: float = 100.0) -> DataFrame:
    """One row: mean strength, mean accesses, which anomalies they are, and whether maintenance is due."""
    g = memories.agg(F.avg("strength").alias("mean_strength"), F.avg("access_count").alias("mean_access"))
    weak, busy = F.col("mean_strength") < low_strength, F.col("mean_access") > high_access
    kinds = F.array_compact(F.array(F.when(weak, "low_strength"), F.when(busy, "high_access")))
    return g.select("*", kinds.alias("anomalies"), (weak | busy | ((ms(as_of) - ms(last_run)) > DAY_MS)).alias("due"))


def adapted_base_rate(memories: DataFrame, d: Decay = D) -> DataFrame:
    g = memories.agg(F.avg("importance").alias("i"), F.avg("access_count").alias("a"))
    return g.select(F.greatest(F.lit(0.05), d.base_rate * (1 - d.adaptive_factor * (F.col("i") + F.col("a") / 100))).alias("base_rate"))


def store_telemetry(memories: DataFrame, kind: str) -> DataFrame:
    """(last_accessed, strength) of a type in the order of access, with its number of memories."""
    t = memories.where(F.col("type") == kind)
    n = t.agg(F.count(F.lit(1)).alias("memory_count"))
    return t.select("id", "last_accessed", "strength").join(F.broadcast(n), F.lit(True)).orderBy("last_accessed", "id")


#: The metrics that a new log knows. Fixed values.
REGISTRY = ("memoryUsage", "clusterStability", "systemPerformance", "errorRate", "accessLatency", "operationsCount", "cpuUsage")


def registry(log: DataFrame, names: tuple[str, ...] = REGISTRY, m: Metrics = M) -> DataFrame:
    """(metric, n, normal, warning, critical) of every registered metric and every other one of the log;
    those without values have the configured thresholds."""
    known = log.sparkSession.createDataFrame([(x,) for x in names], "metric string")
    counted = log.groupBy("metric").agg(F.count(F.lit(1)).alias("n"))
    every = known.join(counted, "metric", "full_outer").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    limits = every.join(dynamic_thresholds(log, m=m), "metric", "left")
    return limits.select("metric", "n", *[F.coalesce(c, F.lit(d)).alias(c) for c, d in (("normal", m.normal), ("warning", m.warning), ("critical", m.critical))])


def history(log: DataFrame, metric: str) -> DataFrame:
    """(ts, value) of one metric in the order of time."""
    return log.where(F.col("metric") == metric).select("ts", "value").orderBy("ts")


def metric_view(log: DataFrame, m: Metrics = M) -> DataFrame:
    """(metric, idx, ts, value, level, anomaly, forecast): the rows of a metric's chart. level is smoothed,
    an anomaly is far from the window before it, and the last ``horizon`` levels stand for the forecast."""
    level = smooth(log, ["metric"], ["ts"], "value", m.smoothing)
    last = level.groupBy("metric").agg(F.max("idx").alias("_last"))
    odd = rolling_z(log, ["metric"], ["ts"], "value", m.anomaly_window).select("metric", "ts", F.lit(True).alias("_a"))
    rows = numbered(log.select("metric", "ts", "value"), ["metric"], [F.col("ts")], "idx")
    j = rows.join(level.select("metric", "idx", "level"), ["metric", "idx"]).join(odd, ["metric", "ts"], "left").join(last, "metric")
    return j.select("metric", "idx", "ts", "value", "level", F.coalesce("_a", F.lit(False)).alias("anomaly"), (F.col("idx") > F.col("_last") - m.horizon).alias("forecast"))


def telemetry_bundle(memories: DataFrame, log: DataFrame, as_of: Column, m: Metrics = M) -> DataFrame:
    """(part, key, value): the number of memories, the members and mean strength of each type, and the values of the
    window that are far from those before them."""
    count = memories.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("count").alias("part"), F.lit("memories").alias("key"), "value")
    g = memories.groupBy("type").agg(F.count(F.lit(1)).cast("double").alias("size"), F.avg("strength").alias("strength"))
    sizes = g.select(F.lit("partition").alias("part"), F.col("type").alias("key"), F.col("size").alias("value"))
    curve = g.select(F.lit("strength").alias("part"), F.col("type").alias("key"), F.col("strength").alias("value"))
    odd = in_window(rolling_z(log, ["metric"], ["ts"], "value", m.anomaly_window), as_of, m.window_ms)
    return count.unionByName(sizes).unionByName(curve).unionByName(odd.select(F.lit("anomaly").alias("part"), F.col("metric").alias("key"), F.col("value").cast("double").alias("value")))
