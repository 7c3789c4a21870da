"""Scores and labels of memories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import Cache, Decay, Pool, Prediction
from .numeric import clamp, half_up, ms, num, safe_div

P, D, Q, C = Prediction(), Decay(), Pool(), Cache()


def recency(ts: Column | str, as_of: Column, horizon_ms: float = P.horizon_ms) -> Column:
    return F.greatest(F.lit(0.0), 1 - (ms(as_of) - ms(ts)) / horizon_ms)


def access(count: Column | str, last: Column | str, as_of: Column, horizon_ms: float = P.horizon_ms) -> Column:
    return (recency(last, as_of, horizon_ms) + F.least(F.lit(1.0), F.coalesce(num(count), F.lit(0)) / 100.0)) / 2


def emotional(emotions: Column | str) -> Column:
    n = F.size(F.coalesce(num(emotions), F.array().cast("array<string>")))
    return F.when(n == 0, 0.3).otherwise((F.least(F.lit(1.0), n / 5.0) + safe_div(F.size(F.array_distinct(num(emotions))), n)) / 2)


def temporal_relevance(ts: Column | str, last: Column | str, as_of: Column, horizon_ms: float = P.horizon_ms) -> Column:
    return 0.7 * recency(ts, as_of, horizon_ms) + 0.3 * recency(F.coalesce(num(last), as_of), as_of, horizon_ms / 2)


def importance(relevance: Column, strength: Column, count: Column, tags: Column) -> Column:
    return 0.4 * relevance + 0.3 * strength + 0.2 * (count / 100.0) + 0.1 * (tags / 10.0)


def decayed(strength: Column, rate: Column, days: Column, count: Column, imp: Column, d: Decay = D) -> Column:
    """Strength after ``days`` without access; an importance of zero decays at once."""
    amount = F.try_divide(rate * days * F.exp(-count * d.access_boost), imp * d.importance_multiplier)
    return F.greatest(F.lit(d.min_strength), strength - F.coalesce(amount, F.when(days > 0, F.lit(1e300)).otherwise(0.0)))


def composite_similarity(cos: Column, tags: Column, context: Column, boost: Column) -> Column:
    return 0.4 * cos + 0.3 * tags + 0.2 * context + 0.1 * boost


def day_part(ts: Column | str) -> Column:
    h = F.hour(num(ts))
    return F.when(h < 6, "night").when(h < 12, "morning").when(h < 18, "afternoon").otherwise("evening")


def day_context(ts: Column | str) -> Column:
    h = F.hour(num(ts))
    return F.when(h.between(5, 11), "morning_context").when(h.between(12, 16), "afternoon_context").when(h.between(17, 21), "evening_context").otherwise("night_context")


def day_kind(ts: Column | str) -> Column:
    return F.when(F.dayofweek(num(ts)).isin(1, 7), "weekend").otherwise("weekday")


def access_labels(count: Column | str, last: Column | str, as_of: Column) -> Column:
    """Array of a frequency label and, within 30 days, a recency label."""
    days = (ms(as_of) - ms(F.coalesce(num(last), as_of))) / 86_400_000.0
    n = F.coalesce(num(count), F.lit(0))
    freq = F.when(n > 100, "high_frequency").when(n > 50, "medium_frequency").otherwise("low_frequency")
    seen = F.when(days < 1, "recently_accessed").when(days < 7, "weekly_access").when(days < 30, "monthly_access")
    return F.array_compact(F.array(freq, seen))


def keywords(content: Column | str, k: int = 5) -> Column:
    return F.slice(F.split(num(content), " "), 1, k)


def labels_above(limit: float, **scores: Column) -> Column:
    """The names whose score exceeds the limit, in the given order."""
    return F.array_compact(F.array(*[F.when(s > limit, F.lit(n)) for n, s in scores.items()]))


def strength_label(r: Column) -> Column:
    a = F.abs(r)
    return F.when(a >= 0.7, "strong").when(a >= 0.3, "moderate").when(a >= 0.1, "weak").otherwise("none")


def direction_label(r: Column, limit: float) -> Column:
    return F.when(r > limit, "positive").when(r < -limit, "negative").otherwise("none")


def trend_label(delta: Column, flat: float = 0.1) -> Column:
    return F.when(delta.isNull() | (F.abs(delta) < flat), "stable").when(delta > 0, "increasing").otherwise("decreasing")


def threshold_status(x: Column, warning: Column, critical: Column) -> Column:
    return F.when(x >= critical, "critical").when(x >= warning, "warning").otherwise("normal")


def health_status(score: Column, warning: float, critical: float) -> Column:
    return F.when(score >= critical, "healthy").when(score >= warning, "warning").otherwise("critical")


# ---------------------------------------------------------------- cache and workers


def entry_bytes(row: Column) -> Column:
    """Two bytes for each character of the row's JSON."""
    return F.length(F.to_json(row)) * 2


def cache_value(count: Column, recency_ms: Column, age_ms: Column, size: Column) -> Column:
    """0.4 accesses + 0.3 / ln(recency + 1) + 0.2 / ln(age + 1) + 0.1 / ln(size + 1); a term over ln(1)
    counts as the largest number: an entry touched just now is never the first to go."""
    part = lambda w, x: F.coalesce(F.try_divide(F.lit(w), F.log(x + 1)), F.lit(1e300))
    return 0.4 * count + part(0.3, recency_ms) + part(0.2, age_ms) + part(0.1, size)


def clamped_priority(p: Column) -> Column:
    return clamp(p, 0, 10)


def worker_probability(efficiency: Column, pool_size: Column, health: Column, cpu: Column, memory: Column) -> Column:
    return safe_div(efficiency, pool_size) * health * (1 - (cpu + memory) / 2)


def task_cpu(priority: Column, fields: Column) -> Column:
    """fields: how many fields the task's data has (null: it is no object)."""
    return 0.05 * priority + F.coalesce(0.01 * fields, F.lit(0.02))


def task_memory(priority: Column, items: Column) -> Column:
    """items: how many items the task's data has (null: it is no array)."""
    return 0.02 * priority + F.coalesce(0.01 * items, F.lit(0.03))


def predicted_completion(priority: Column, timeout_ms: float = Q.timeout_ms) -> Column:
    """Milliseconds until a task is done; higher priorities are sooner."""
    return timeout_ms / 2 * (1 - 0.05 * priority)


def efficiency_after(efficiency: Column, latency_ms: Column) -> Column:
    return 0.9 * efficiency + 0.1 * safe_div(F.lit(1000.0), latency_ms)


def health_after(health: Column, failed: Column, crashed: Column) -> Column:
    return F.when(crashed, 0.8 * health).when(failed, 0.9 * health).otherwise(F.least(F.lit(1.0), health + 0.05))


def scaled_pool(active: Column, queued: Column, cpu: Column, memory: Column, lo: int = Q.min_workers, hi: int = Q.max_workers, factor: float = Q.scaling_factor) -> Column:
    """The pool size that load and resources ask for, within its bounds."""
    load = queued / F.greatest(active, F.lit(1))
    return clamp(half_up(active * (1 + factor * (load + (cpu + memory) / 2 - 1))), lo, hi).cast("int")


# ---------------------------------------------------------------- the view


def cluster_colour(stability: Column, growth: Column) -> Column:
    part = lambda x: F.floor(255 * x).cast("int")
    return F.format_string("rgb(%d, %d, %d)", part(1 - stability), part(F.greatest(stability, growth)), part(1 - growth))


def date_label(ts: Column | str) -> Column:
    return F.date_format(num(ts), "M/d")


def percent(x: Column) -> Column:
    return F.concat(F.format_string("%.1f", x * 100), F.lit("%"))


def scroll_percent(top: Column, total: Column, visible: Column) -> Column:
    return safe_div(top, total - visible)


def preview(text: Column | str, n: int = 100) -> Column:
    t = num(text)
    return F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n)), F.lit("..."))).otherwise(t)

