"""Ingest, decay, consolidation, archive and maintenance of memories."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as X
from ..functions.numeric import age_days
from ..functions.vectors import neural_weights
from ..params import Decay, Partitions
from ..scratch import staged
from . import predict
from .ordering import numbered
from .partitions import assign
from .search import nearest

D = Decay()


def enrich(memories: DataFrame, edges: DataFrame, as_of: Column, history: DataFrame | None = None, rates: dict[str, float] | None = None, d: Decay = D) -> DataFrame:
    """``memories`` with predicted_relevance, ai_generated_tags, semantic_context, importance,
    neural_weights and decay_rate, each from those before it."""
    rel = predict.predicted_relevance(memories, edges, as_of, history).select("id", F.col("relevance").alias("predicted_relevance"))
    tags = predict.ranked_tags(predict.tag_candidates(memories, edges, as_of)).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))), lambda s: s["tag"]).alias("ai_generated_tags"))
    context = predict.context_insights(memories, edges, as_of, history).withColumnRenamed("insights", "semantic_context")
    m = memories.join(rel, "id").join(tags, "id", "left").join(context, "id", "left").withColumn("ai_generated_tags", F.coalesce("ai_generated_tags", F.array().cast("array<string>")))
    m = m.withColumn("importance", X.importance(F.col("predicted_relevance"), F.col("strength"), F.coalesce("access_count", F.lit(0)), F.size("ai_generated_tags")))
    m = m.withColumn("neural_weights", neural_weights(F.col("predicted_relevance"), F.col("importance"), F.col("id")))
    rate = F.lit(d.base_rate)
    for kind, r in (rates or {}).items():
        rate = F.when(F.col("type") == kind, F.lit(r)).otherwise(rate)
    return m.withColumn("decay_rate", rate)


def apply_decay(memories: DataFrame, as_of: Column, d: Decay = D) -> DataFrame:
    """``memories`` with their strength after the days since their last access; ``archived`` marks those
    at the least strength."""
    s = X.decayed(F.col("strength"), F.col("decay_rate"), age_days("last_accessed", as_of), F.col("access_count"), F.col("importance"), d)
    return memories.withColumn("strength", s).withColumn("archived", F.col("strength") <= d.min_strength)


def split_archive(decayed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(active, archive)."""
    return decayed.where(~F.col("archived")).drop("archived"), decayed.where("archived").drop("archived")


#: Rows of one cluster that a single greedy pass may hold.
GREEDY_ROWS = 20_000


def _sets(column: pd.Series) -> list[set]:
    return [set(x) if x is not None else set() for x in column]


def _unit(column: pd.Series) -> np.ndarray:
    a = np.array([np.asarray(x, float) for x in column])
    length = np.linalg.norm(a, axis=1, keepdims=True)
    return np.divide(a, length, out=np.zeros_like(a), where=length > 0)


class _Rows:
    """The parts of the composite similarity of some memories."""

    def __init__(self, f: pd.DataFrame):
        self.v = _unit(f["vector"])
        self.w = _unit(f["neural_weights"]) if "neural_weights" in f else None
        self.tags = _sets(f["ai_generated_tags"]) if "ai_generated_tags" in f else None
        self.context = _sets(f["semantic_context"]) if "semantic_context" in f else None

    def similarity(self, at: np.ndarray, other: _Rows, i: int) -> np.ndarray:
        """Of the rows ``at`` to row i of ``other``."""
        jaccard = lambda one, many: np.array([len(one & many[k]) / len(one | many[k]) if one | many[k] else 0.0 for k in at.tolist()])
        s = 0.4 * (self.v[at] @ other.v[i])
        if self.tags is not None:
            s = s + 0.3 * jaccard(other.tags[i], self.tags)
        if self.context is not None:
            s = s + 0.2 * jaccard(other.context[i], self.context)
        if self.w is not None:
            s = s + 0.1 * (self.w[at] @ other.w[i])
        return s


def _taken(rows: _Rows, seeds: _Rows, left: np.ndarray, threshold: float) -> np.ndarray:
    """For each row the first seed that takes it, or -1; seeds in order."""
    out, at = np.full(len(left), -1), np.arange(len(left))
    for i in range(len(seeds.v)):
        if not len(at):
            break
        hit = rows.similarity(left[at], seeds, i) >= threshold
        out[at[hit]] = i
        at = at[~hit]
    return out


def greedy_groups(memories: DataFrame, threshold: float = 0.8, group: str = "cluster_id", block_rows: int = GREEDY_ROWS) -> DataFrame:
    """(group, id, seed): in order of id, a memory not yet taken seeds a group and takes every later one
    whose composite similarity to it reaches the threshold. Tags and context may be missing.

    The pass is sequential by nature. A cluster of more than ``block_rows`` rows goes block by block: the
    first block of rows not yet taken is passed over by one task, and its seeds take from all later rows,
    which are dealt into chunks; every round settles a block at least, with the same result.
    """
    cols = [c for c in ("ai_generated_tags", "semantic_context", "neural_weights") if c in memories.columns]
    kind = dict(memories.dtypes)[group]
    schema = f"`{group}` {kind}, id long, seed long"
    rows = memories.select(group, "id", "vector", *cols)

    def one_pass(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id").reset_index(drop=True)
        r, seed = _Rows(f), np.full(len(f), -1)
        for i in range(len(f)):
            if seed[i] >= 0:
                continue
            seed[i] = i
            left = np.flatnonzero(seed < 0)
            if not len(left):
                break
            seed[left[r.similarity(left, r, i) >= threshold]] = i
        return pd.DataFrame({group: f[group], "id": f["id"], "seed": f["id"].to_numpy()[seed]})

    def take(rest: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
        if not len(rest) or not len(seeds):
            return pd.DataFrame({group: [], "id": [], "seed": []})
        seeds = seeds.sort_values("id").reset_index(drop=True)
        got = _taken(_Rows(rest), _Rows(seeds), np.arange(len(rest)), threshold)
        mine = rest[got >= 0]
        return pd.DataFrame({group: mine[group], "id": mine["id"], "seed": seeds["id"].to_numpy()[got[got >= 0]]})

    most = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= block_rows:
        return rows.groupBy(group).applyInPandas(one_pass, schema)
    left, done = staged(rows, "left"), []
    while left.limit(1).count():
        placed = staged(numbered(left, [group], [F.col("id")], "_i"), "placed")
        head = staged(placed.where(F.col("_i") < block_rows).drop("_i").groupBy(group).applyInPandas(one_pass, schema), "head")
        done.append(head)
        rest = staged(placed.where(F.col("_i") >= block_rows).withColumn("_chunk", F.floor(F.col("_i") / block_rows)).drop("_i"), "rest")
        chunks = rest.select(group, "_chunk").distinct()
        seeds = placed.drop("_i").join(head.where("id = seed").select("id"), "id", "left_semi").join(chunks, group)
        seeds = staged(seeds.select(group, "_chunk", "id", "vector", *cols), "seeds")
        got = rest.groupBy(group, "_chunk").cogroup(seeds.groupBy(group, "_chunk")).applyInPandas(take, schema)
        got = staged(got, "taken")
        done.append(got)
        left = staged(rest.drop("_chunk").join(got.select("id"), "id", "left_anti").select(*rows.columns), "left")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def merge_groups(memories: DataFrame, groups: DataFrame) -> DataFrame:
    """One row for each seed: contents joined by ' | ' in order of id, the union of tags, the greatest
    importance and strength, and how many rows it stands for (the others go to the archive)."""
    j = memories.join(groups.select("id", "seed"), "id")
    tags = F.array_sort(F.array_distinct(F.flatten(F.collect_list("ai_generated_tags")))) if "ai_generated_tags" in memories.columns else F.array().cast("array<string>")
    imp = F.max("importance") if "importance" in memories.columns else F.lit(None).cast("double")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "content"))), lambda s: s["content"]), " | ")
    return j.groupBy("seed").agg(text.alias("content"), tags.alias("tags"), imp.alias("importance"), F.max("strength").alias("strength"), F.count(F.lit(1)).alias("members"))


def ingest(new: DataFrame, edges: DataFrame, as_of: Column, parts: DataFrame, lists: DataFrame, p: Partitions = Partitions()) -> DataFrame:
    """New memories on their way in: enriched, with the partition_id that takes each and the list_id of the
    index; append them to the store by type."""
    rich = staged(enrich(new, edges, as_of), "enriched")
    placed = assign(rich.select("id", "type", "vector"), parts, p).select("id", "partition_id", "created")
    listed = nearest(rich.select("id", "vector"), lists, "list_id").select("id", "list_id")
    return rich.join(placed, "id").join(listed, "id", "left")


def maintain(memories: DataFrame, edges: DataFrame, as_of: Column, history: DataFrame | None = None, threshold: float = 0.8) -> dict[str, DataFrame]:
    """One maintenance run as a batch: decay, archive, consolidation, fresh predictions; the parts of the
    next snapshot."""
    enriched = enrich(memories, edges, as_of, history)
    active, archive = split_archive(apply_decay(enriched, as_of))
    groups = greedy_groups(active, threshold)
    merged = merge_groups(active, groups)
    return {"active": active.join(groups.where("id = seed").select("id"), "id", "left_semi"), "archive": archive, "merged": merged, "groups": groups}
