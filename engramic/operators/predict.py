"""Relevance, tags and context of memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as X
from ..functions.numeric import ms, or_default, safe_div
from ..functions.vectors import cosine
from ..params import Prediction
from ..scratch import staged
from .ordering import numbered
from .series import context_anomalies, smooth

P = Prediction()
NO_TEXT = "array<string>"
#: Rows of a history that are broadcast; more are joined by type.
HISTORY_ROWS = 100_000


def relationship_score(memories: DataFrame, edges: DataFrame, relevance: DataFrame | None) -> DataFrame:
    """(id, relationship): the mean over what a memory refers to of (relevance + strength or 0.5) / 2; 0.3
    without references."""
    target = memories.select(F.col("id").alias("dst"), or_default("strength", 0.5).alias("_s"))
    if relevance is not None:
        target = target.join(relevance.select(F.col("id").alias("dst"), "relevance"), "dst", "left")
    r = F.coalesce("relevance", F.lit(0.5)) if relevance is not None else F.lit(0.5)
    g = edges.join(target, "dst").groupBy("src").agg(F.avg((r + F.col("_s")) / 2).alias("relationship"))
    return memories.select("id").join(g.withColumnRenamed("src", "id"), "id", "left").select("id", F.coalesce("relationship", F.lit(0.3)).alias("relationship"))


def relevance_factors(memories: DataFrame, relationship: DataFrame, as_of: Column) -> DataFrame:
    """(id, score, confidence, factors) of recency, access, relationships and emotions."""
    m = memories.join(relationship, "id")
    last = F.coalesce("last_accessed", "ts")
    parts = {"high_recency": X.recency("ts", as_of), "frequent_access": X.access("access_count", last, as_of), "strong_relationships": F.col("relationship"), "high_emotional_significance": X.emotional("emotions")}
    a, b, c, d = parts.values()
    return m.select("id", (0.3 * a + 0.2 * b + 0.25 * c + 0.25 * d).alias("score"), F.lit(0.8).alias("confidence"), X.labels_above(0.7, **parts).alias("factors"))


def coherence_parts(memories: DataFrame, edges: DataFrame, horizon_ms: float = P.horizon_ms) -> DataFrame:
    """(id, semantic, temporal, emotional): of a memory and what it refers to; null without references."""
    own = memories.select(F.col("id").alias("src"), F.col("vector").alias("_v"), F.col("emotions").alias("_e"))
    ref = memories.select(F.col("id").alias("dst"), "vector", "ts", "emotions")
    j = edges.join(ref, "dst").join(own, "src")
    shared = F.when(F.col("emotions").isNull(), 0).otherwise(F.size(F.filter("emotions", lambda e: F.array_contains("_e", e))))
    g = j.groupBy("src").agg(
        F.avg(F.when(F.col("vector").isNotNull() & F.col("_v").isNotNull(), cosine("_v", "vector"))).alias("semantic"),
        F.greatest(F.lit(0.0), 1 - (F.max(ms("ts")) - F.min(ms("ts"))) / horizon_ms).alias("temporal"),
        F.sum(shared).alias("_shared"),
        F.sum(F.when(F.col("emotions").isNull(), 0).otherwise(F.size("emotions"))).alias("_all"),
    )
    e = F.when(F.col("_all") == 0, 0.5).otherwise(safe_div(F.col("_shared"), F.col("_all")))
    return g.select(F.col("src").alias("id"), F.coalesce("semantic", F.lit(0.5)).alias("semantic"), "temporal", e.alias("emotional"))


def contextual_relevance(memories: DataFrame, edges: DataFrame, as_of: Column) -> DataFrame:
    """(id, score, confidence, factors) of semantics, time and coherence with the references."""
    j = memories.join(coherence_parts(memories, edges), "id", "left")
    semantic = F.coalesce("semantic", F.lit(0.5))
    coherent = F.coalesce(0.4 * F.col("semantic") + 0.3 * F.col("temporal") + 0.3 * F.col("emotional"), F.lit(0.5))
    time = X.temporal_relevance("ts", "last_accessed", as_of)
    parts = {"high_semantic_relevance": semantic, "temporal_significance": time, "strong_contextual_coherence": coherent}
    return j.select("id", (0.4 * semantic + 0.3 * time + 0.3 * coherent).alias("score"), F.lit(0.75).alias("confidence"), X.labels_above(0.7, **parts).alias("factors"))


def history_of(memories: DataFrame, relevance: DataFrame, edges: DataFrame, keep: int = 2 * P.context_window) -> DataFrame:
    """The last ``keep`` memories of each type with their relevance: at most ``keep`` rows for each type."""
    refs = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n_refs"))
    w = Window.partitionBy("type").orderBy(F.desc("ts"), F.desc("id"))
    last = memories.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep)
    return last.join(relevance.select("id", "relevance"), "id").join(refs, "id", "left").select(F.coalesce("type", F.lit("default")).alias("type"), F.col("id").alias("h_id"), F.col("ts").alias("h_ts"), F.col("access_count").alias("h_access"), F.col("n_refs").alias("h_refs"), F.col("vector").alias("h_vector"), F.col("emotions").alias("h_emotions"), F.col("relevance").alias("h_relevance"))


def pattern_similarity(horizon_ms: float = P.horizon_ms) -> Column:
    """Of a memory (access_count, ts, n_refs) and a history row (h_*)."""
    access = F.least(F.lit(1.0), F.coalesce("access_count", F.lit(0)) / or_default("h_access", 1.0))
    time = F.greatest(F.lit(0.0), 1 - F.abs(ms("ts") - ms("h_ts")) / horizon_ms)
    refs = F.when(F.col("n_refs").isNull() | F.col("h_refs").isNull(), 0.5).otherwise(F.least(F.lit(1.0), F.col("n_refs") / F.col("h_refs")))
    return (access + time + refs) / 3


def gate_state(values: Column, hidden: Column | None = None, cell: Column | None = None, window: int = P.state_window) -> Column:
    """The gated state after the last ``window`` values: struct(score, confidence, significance, hidden,
    cell), with gates 0.7 (forget), 0.3 (input) and 0.5 (output) and the state before it."""
    none = F.array().cast("array<double>")
    hidden, cell = hidden if hidden is not None else none, cell if cell is not None else none
    v = F.when(F.size(values) > window, F.slice(values, -window, window)).otherwise(values)
    at = F.sequence(F.lit(0), F.size(v) - 1)
    new = F.when(F.size(v) == 0, none).otherwise(F.transform(at, lambda i: 0.7 * F.coalesce(F.get(cell, i), F.lit(0.0)) + 0.3 * F.tanh(or_value(F.get(v, i)))))
    out = F.transform(new, lambda c: 0.5 * F.tanh(c))
    mean = lambda a: safe_div(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a), None)
    score, before = F.coalesce(mean(out), F.lit(0.5)), F.coalesce(mean(hidden), F.lit(0.5))
    return F.struct(score.alias("score"), F.least(F.lit(1.0), F.size(v) / float(window)).alias("confidence"), F.abs(score - before).alias("significance"), out.alias("hidden"), new.alias("cell"))


def or_value(x: Column) -> Column:
    return F.when(x.isNull() | (x == 0), 0.5).otherwise(x)


def historical_pattern(memories: DataFrame, history: DataFrame, edges: DataFrame, threshold: float = P.relevance_threshold) -> DataFrame:
    """(id, score, confidence, factors): the memory's type history, similar rows folded into the gated
    state in order of time."""
    refs = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n_refs"))
    m = memories.select("id", F.coalesce("type", F.lit("default")).alias("type"), "ts", "access_count").join(refs, "id", "left")
    # a bounded number of rows for each type, without their vectors
    small = history.drop("h_vector", "h_emotions")
    j = m.join(F.broadcast(small) if small.limit(HISTORY_ROWS + 1).count() <= HISTORY_ROWS else small, "type").withColumn("_s", pattern_similarity()).where(F.col("_s") > threshold)
    g = j.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("h_ts", "h_id", "h_relevance"))), lambda s: s["h_relevance"]).alias("_v"))
    r = m.select("id").join(g, "id", "left").withColumn("_v", F.coalesce("_v", F.array().cast("array<double>"))).withColumn("_g", gate_state(F.col("_v")))
    n = F.size("_v")
    last = F.when(n > 3, F.slice("_v", -3, 3)).otherwise(F.col("_v"))
    mean = lambda a: safe_div(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a), 0.0)
    var = mean(F.transform(last, lambda x: (x - mean(last)) * (x - mean(last))))
    labels = F.array_compact(F.array(F.when(n > 0, "recurring_pattern"), F.when((n >= 2) & (var > 0.1), "pattern_change"), F.when(F.col("_g.significance") > 0.5, "long_term_pattern")))
    return r.select("id", F.col("_g.score").alias("score"), (F.least(F.lit(1.0), n / 10.0) * or_default(F.col("_g.confidence"), 1.0)).alias("confidence"), labels.alias("factors"))


def label_entropy(labels: Column) -> Column:
    """Shannon entropy (bits) of an array of labels."""
    n = F.size(labels)
    p = lambda x: F.size(F.filter(labels, lambda y: y == x)) / n
    return F.when(n == 0, 0.0).otherwise(-F.aggregate(F.array_distinct(labels), F.lit(0.0), lambda s, x: s + p(x) * F.log2(p(x))))


def predicted_relevance(memories: DataFrame, edges: DataFrame, as_of: Column, history: DataFrame | None = None, depth: int = P.reference_depth) -> DataFrame:
    """(id, relevance, confidence, factors, entropy): 0.4 factors + 0.3 history + 0.3 context.

    What a memory refers to counts with its own relevance, down to ``depth`` references (cycles end
    there): each level is one keyed join. Without a history its score is 0.5.
    """
    context = staged(contextual_relevance(memories, edges, as_of), "context") if depth > 1 else contextual_relevance(memories, edges, as_of)
    past = historical_pattern(memories, history, edges) if history is not None else memories.select("id", F.lit(0.5).alias("score"), F.lit(0.0).alias("confidence"), F.array().cast(NO_TEXT).alias("factors"))
    rel = None
    for level in range(depth + 1):
        if level > 1:  # each level rests on the one before it as a table
            rel = staged(rel, "relevance")
        own = relevance_factors(memories, relationship_score(memories, edges if rel is not None else edges.limit(0), rel), as_of)
        f, h, c = own.alias("f"), past.alias("h"), context.alias("c")
        j = f.join(h, F.col("f.id") == F.col("h.id")).join(c, F.col("f.id") == F.col("c.id"))
        labels = F.concat("f.factors", "h.factors", "c.factors")
        rel = j.select(
            F.col("f.id").alias("id"), (0.4 * F.col("f.score") + 0.3 * F.col("h.score") + 0.3 * F.col("c.score")).alias("relevance"), ((F.col("f.confidence") + F.col("h.confidence") + F.col("c.confidence")) / 3).alias("confidence"), labels.alias("factors"), label_entropy(labels).alias("entropy")
        )
    return rel


def network_depth(edges: DataFrame, nodes: DataFrame, cap: int = 5) -> DataFrame:
    """(id, depth): the longest chain of references from a memory, up to ``cap`` (cycles end there)."""
    depth = nodes.select("id", F.lit(1).alias("depth"))
    depth = depth.join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_semi")
    for _ in range(cap - 1):
        step = edges.join(depth.select(F.col("id").alias("dst"), "depth"), "dst").groupBy(F.col("src").alias("id")).agg((F.max("depth") + 1).alias("d"))
        depth = depth.join(step, "id", "left").select("id", F.least(F.greatest("depth", F.coalesce("d", F.lit(0))), F.lit(cap)).alias("depth"))
    return nodes.select("id").join(depth, "id", "left").select("id", F.coalesce("depth", F.lit(0)).alias("depth"))


def relationship_labels(memories: DataFrame, edges: DataFrame, many: int = 5, cap: int = 5) -> DataFrame:
    """(id, labels): strong_<type>_connections for more than ``many`` references of a type, and the
    network's depth (over 3 deep, over 1 shallow)."""
    kinds = memories.select(F.col("id").alias("dst"), "type").where("type is not null")
    counted = edges.join(kinds, "dst").groupBy(F.col("src").alias("id"), "type").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > many)
    strong = counted.groupBy("id").agg(F.array_sort(F.collect_list(F.concat(F.lit("strong_"), "type", F.lit("_connections")))).alias("_s"))
    d = network_depth(edges, memories, cap).withColumn("_d", F.when(F.col("depth") > 3, "deep_network").when(F.col("depth") > 1, "shallow_network"))
    return d.join(strong, "id", "left").select("id", F.array_compact(F.concat(F.coalesce("_s", F.array().cast(NO_TEXT)), F.array("_d"))).alias("labels"))


def tag_candidates(memories: DataFrame, edges: DataFrame, as_of: Column) -> DataFrame:
    """(id, tag, confidence, source): content .8 (emotions, first words), context .7 (time, references),
    pattern .6 (access, relations)."""
    none = F.array().cast(NO_TEXT)
    content = memories.select("id", F.explode(F.concat(F.coalesce("emotions", none), F.coalesce(X.keywords("content"), none))).alias("tag"), F.lit(0.8).alias("confidence"), F.lit("content").alias("source"))
    time = memories.select("id", F.explode(F.array(X.day_part("ts"), X.day_kind("ts"))).alias("tag"))
    ref = edges.join(memories.select(F.col("id").alias("dst"), "type", "emotions"), "dst")
    rel = ref.select(F.col("src").alias("id"), F.explode(F.concat(F.array_compact(F.array(F.concat(F.lit("rel_"), "type"))), F.transform(F.coalesce("emotions", none), lambda e: F.concat(F.lit("shared_"), e)))).alias("tag"))
    context = time.unionByName(rel).select("id", "tag", F.lit(0.7).alias("confidence"), F.lit("context").alias("source"))
    pattern = memories.select("id", F.explode(X.access_labels("access_count", "last_accessed", as_of)).alias("tag"))
    pattern = pattern.unionByName(relationship_labels(memories, edges).select("id", F.explode("labels").alias("tag"))).select("id", "tag", F.lit(0.6).alias("confidence"), F.lit("pattern").alias("source"))
    return content.unionByName(context).unionByName(pattern)


def ranked_tags(candidates: DataFrame, min_confidence: float = P.min_confidence, damped: DataFrame | None = None) -> DataFrame:
    """(id, tag, confidence, rank): the greatest confidence of each tag, those below the minimum dropped;
    ids of ``damped(id)`` (with a recent anomaly) count 0.9 of it."""
    c = candidates
    if damped is not None:
        mark = damped.select("id").distinct().withColumn("_d", F.lit(True))
        c = c.join(mark, "id", "left").withColumn("confidence", F.when(F.col("_d"), F.col("confidence") * 0.9).otherwise(F.col("confidence"))).drop("_d")
    best = c.groupBy("id", "tag").agg(F.max("confidence").alias("confidence")).where(F.col("confidence") >= min_confidence)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("confidence"), "tag")))


def context_insights(memories: DataFrame, edges: DataFrame, as_of: Column, history: DataFrame | None = None, similar: float = 0.7) -> DataFrame:
    """(id, insights): distinct temporal, location, social, access and semantic labels, sorted."""
    none = F.array().cast(NO_TEXT)
    parts = [F.array(X.day_context("ts"), F.concat(X.day_kind("ts"), F.lit("_context")), X.day_part("ts"), X.day_kind("ts")), X.access_labels("access_count", "last_accessed", as_of)]
    if "location" in memories.columns:
        parts.append(F.array_compact(F.array(F.concat(F.lit("location_"), "location.type"), F.concat(F.lit("context_"), "location.context"))))
    if "social_context" in memories.columns:
        parts.append(F.array_compact(F.array(F.concat(F.lit("social_"), "social_context"))))
    own = memories.select("id", F.concat(*parts).alias("_own"))
    if history is None:
        return own.select("id", F.array_sort(F.array_distinct("_own")).alias("insights"))
    j = memories.select("id", F.coalesce("type", F.lit("default")).alias("type"), "vector").join(history, "type").where(cosine("vector", "h_vector") > similar)
    semantic = j.select("id", F.explode("h_emotions").alias("e")).groupBy("id").agg(F.collect_set(F.concat(F.lit("semantic_"), "e")).alias("_sem"))
    return own.join(semantic, "id", "left").select("id", F.array_sort(F.array_distinct(F.concat("_own", F.coalesce("_sem", none)))).alias("insights"))


def prediction_view(history: DataFrame, p: Prediction = P) -> DataFrame:
    """(type, idx, ts, relevance, level, forecast, anomaly) of a history as ``history_of`` gives it, in order of
    time: level is smoothed, the last levels stand for the forecast, and an anomaly is far from the
    mean of the last rows."""
    h = history.select("type", F.col("h_ts").alias("ts"), F.col("h_id").alias("id"), F.col("h_relevance").alias("relevance"))
    order = ["ts", "id"]
    level = smooth(h, ["type"], order, "relevance", p.smoothing)
    last = level.groupBy("type").agg(F.max("idx").alias("_last"))
    odd = context_anomalies(h, ["type"], order, "relevance", p.context_window).select("type", "id", F.lit(True).alias("_a"))
    rows = numbered(h, ["type"], [F.col(c) for c in order], "idx").join(level.select("type", "idx", "level"), ["type", "idx"])
    j = rows.join(odd, ["type", "id"], "left").join(last, "type")
    return j.select("type", "idx", "ts", "relevance", "level", (F.col("idx") > F.col("_last") - p.forecast_steps).alias("forecast"), F.coalesce("_a", F.lit(False)).alias("anomaly"))


def tag_confidence(tags: DataFrame, history: DataFrame) -> DataFrame:
    """(id, tag, confidence) of ``tags(id, type, tag)``: the share of the type's history rows that carry the tag."""
    n = history.groupBy("type").agg(F.count(F.lit(1)).alias("_n"))
    seen = history.select("type", F.explode(F.array_distinct("h_emotions")).alias("tag")).groupBy("type", "tag").agg(F.count(F.lit(1)).alias("_k"))
    j = tags.join(n, "type", "left").join(seen, ["type", "tag"], "left")
    return j.select("id", "tag", safe_div(F.coalesce("_k", F.lit(0)), F.col("_n")).alias("confidence"))


def trend_of(analyses: DataFrame) -> DataFrame:
    """(id, ts, relevance, trend): each analysis against the one before it of the same memory."""
    d = F.col("relevance") - F.lag("relevance").over(Window.partitionBy("id").orderBy("ts"))
    return analyses.select("id", "ts", "relevance", d.alias("_d")).select("id", "ts", "relevance", X.trend_label(F.col("_d")).alias("trend"))
