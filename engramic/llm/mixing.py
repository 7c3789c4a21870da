"""Mixing sources to target token shares by entropy balancing.

The mix minimises the sum over documents of size * (r * ln r - r + 1), the divergence of the
documents' rates r from 1 measured in tokens, under one token constraint for each value of each
margin (the source, and any other categorical columns) and 0 <= r <= ``max_copies``. The dual is
convex, and its solution tilts the rates exponentially: r = min(max_copies, exp(sum of the
multipliers of the document's values)). Newton steps on the dual run over the cells (distinct
combinations of margin values) with their summed sizes, which stay distributed tables: for a
multiplier the gradient is target - mass and the curvature the mass that the bound doesn't hold; the
steps are taken on the logarithm of both, where the bound makes no step overshoot.
Rates become whole copies by error diffusion within salted groups of a source: from the largest
document to the smallest each gets the copies that bring the words taken so far nearest to those due.
What is left then (a few words, or more where one document is most of a source) is a part copy of one
document.

Defined results: a null text has size 0; documents of size 0 take nothing; a null source is a source
of its own, ordered last; repeated rows are documents of their own, counted before they are
planned; very long documents are taken 0 to ``max_copies`` times; a source without words has target
0; targets that no rates can meet together raise; an empty table gives an empty result; other columns
are ignored, or travel along with the copies.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered_times, row_names, salted, scratch, staged

WEIGHTS, SHARE, MAX_COPIES = (5.0, 2.0, 1.0), 1.5, 2
#: Distinct documents of one source that one rounding group holds (a few numbers each).
GROUP_ROWS = 8192
TOLERANCE, MAX_STEPS = 1e-9, 60


def word_counts(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, source, text, ...) with the column size in place of the text."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"))


def water_filled_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) of ``sizes(source, source_size)``.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` of all
    sizes; no target passes ``cap`` times its source's size, and the excess goes to the others by
    weight until none is above. The sources are ranked by ratio of capacity to weight: those up to
    some rank are at their cap, the rest share what is left, so one sorted pass finds the fixed point.
    """
    rank = _global_rank(sizes, F.col("source").isNull(), F.col("source").cast("binary"))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_rank"), F.lit(len(weights))) + 1).cast("int"))
    s = rank.select("source", "source_size", pick.alias("w"), (F.col("source_size") * float(cap)).alias("capacity"))
    total = s.agg(F.sum("source_size").alias("t"), F.sum("w").alias("w")).first()
    budget = float(total["t"] or 0) * share
    left_w = float(total["w"] or 0.0)
    full = 0.0
    level = 0.0
    while left_w > 0:  # each round fills at least one more source; rounds are few as levels only rise
        level = max(level, (budget - full) / left_w)
        row = s.agg(F.sum(F.when(F.col("capacity") <= F.col("w") * level, F.col("capacity"))).alias("full"), F.sum(F.when(F.col("capacity") > F.col("w") * level, F.col("w"))).alias("left")).first()
        now_full, now_left = float(row["full"] or 0.0), float(row["left"] or 0.0)
        if (now_full, now_left) == (full, left_w):
            break
        full, left_w = now_full, now_left
    return s.select("source", "source_size", F.least(F.col("capacity"), F.col("w") * F.lit(level)).alias("target"))


def _global_rank(t: DataFrame, *by) -> DataFrame:
    """``t`` (a row for each source) with _rank from 0, by ranges: a count for each range goes to the
    driver, never the rows."""
    placed = staged(t.repartitionByRange(*by).sortWithinPartitions(*by).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "ranked")
    counts = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    base, pairs = 0, []
    for p in sorted(counts):
        pairs += [F.lit(p), F.lit(base)]
        base += counts[p]
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_at")) - 1
    ranked = placed.withColumn("_rank", within + (F.element_at(F.create_map(*pairs), F.col("_part")) if pairs else F.lit(0)))
    return ranked.drop("_part", "_at")


def balance(cells: DataFrame, margins: dict[str, DataFrame], cap: float = MAX_COPIES, tolerance: float = TOLERANCE) -> dict[str, DataFrame]:
    """The multipliers of each margin's values by Newton steps on the dual.

    ``cells``: the margin columns and mass; ``margins``: for each column a table of its values with
    their target. A value whose target reaches cap times its mass gets the bound itself.
    """
    solved = {c: t.select(c, "target", F.lit(0.0).alias("lam")) for c, t in margins.items()}
    for _ in range(MAX_STEPS):
        worst = 0.0
        for column in margins:
            t = cells
            for c, m in solved.items():
                t = t.join(m.select(F.col(c).alias(f"_{c}"), F.col("lam").alias(f"lam_{c}")), F.col(c).eqNullSafe(F.col(f"_{c}")), "left").drop(f"_{c}")
            tilt = sum((F.col(f"lam_{c}") for c in solved), F.lit(0.0))
            rate = F.least(F.lit(float(cap)), F.exp(F.least(tilt, F.lit(50.0))))
            free = F.when(rate < cap, F.col("mass") * rate).otherwise(0.0)
            sums = t.withColumn("_got", F.col("mass") * rate).withColumn("_free", free).groupBy(column).agg(F.sum("_got").alias("_got"), F.sum("_free").alias("_free"), F.sum("mass").alias("_mass"))
            sums = sums.withColumnRenamed(column, "_value")
            # Newton on the logarithm of the mass: it is concave in the multiplier, so steps from the
            # left never pass the solution, and one from the right lands left of it
            step = F.coalesce(F.try_divide(F.log(F.col("target")) - F.log(F.col("_got")), F.try_divide(F.col("_free"), F.col("_got"))), F.signum(F.col("target") - F.col("_got")))
            step = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), step))
            full = F.col("target") >= F.col("_mass") * cap
            j = solved[column].join(sums, F.col(column).eqNullSafe(F.col("_value")), "left")
            off = F.when(F.coalesce("_mass", F.lit(0.0)) == 0, 0.0).otherwise(F.abs(F.col("target") - F.col("_got")) / F.greatest(F.col("target"), F.lit(1.0)))
            new = F.when(F.coalesce("_mass", F.lit(0.0)) == 0, 0.0).when(full, F.log(F.lit(float(cap))) if len(margins) == 1 else F.greatest(F.col("lam") + step, F.lit(0.0))).when(off <= tolerance, F.col("lam")).otherwise(F.col("lam") + step)
            done = staged(j.select(column, "target", new.alias("lam"), off.alias("off")), "newton")
            solved[column] = done.select(column, "target", "lam")
            worst = max(worst, done.agg(F.max("off")).first()[0] or 0.0)
        if worst <= tolerance:
            return solved
    raise RuntimeError(f"the multipliers did not settle within {MAX_STEPS} steps: {worst:.3g} off")


def _diffuse(group: pd.DataFrame) -> pd.DataFrame:
    """Copies of the documents of one group, largest first, carrying the error on; a row stands for
    ``_rows`` equal documents and gets the copies of all of them. What whole copies leave over goes to
    part_words: the smallest document that can takes so many words more or less."""
    g = group.sort_values(["size", "_order", "doc_id", "_tie"], ascending=[False, True, True, True])
    due, taken, copies = 0.0, 0, []
    size, rows, most = (g[c].to_numpy() for c in ("size", "_rows", "_most"))
    for n, m, rate, top in zip(size.tolist(), rows.tolist(), g["rate"].tolist(), most.tolist(), strict=True):
        due += m * n * rate
        k = min(m * top, max(0, int(np.floor((due - taken) / n + 0.5)))) if n else 0
        taken += k * n
        copies.append(k)
    made = np.array(copies, np.int64)
    rest, part = int(np.floor(due + 0.5)) - taken, np.zeros(len(g), np.int64)
    # of equal documents the one with the fewest copies can take more, the one with the most give most
    room = (most - made // rows) * size if rest > 0 else -(-made // rows) * size
    while rest and room.any():
        fits = np.flatnonzero(room >= abs(rest))
        at = int(fits[room[fits].argmin()]) if len(fits) else int(room.argmax())
        step = int(min(abs(rest), room[at])) * (1 if rest > 0 else -1)
        part[at] += step
        rest -= step
        room[at] = 0
    return g.assign(copies=made, part_words=part)[["_at", "copies", "part_words"]]


def plan_copies(counted: DataFrame, targets: DataFrame, source: str = "source", margins: dict[str, DataFrame] | None = None, cap: int = MAX_COPIES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``counted`` (distinct rows with doc_id, size, source, any margin columns, and _rows: how many
    documents a row stands for) with rate, copies and part_words of them together."""
    margins = {source: targets.select(source, "target")} | (margins or {})
    cells = staged(counted.groupBy(*margins).agg(F.sum(F.col("size") * F.col("_rows")).cast("double").alias("mass"), F.count(F.lit(1)).alias("_n")), "cells")
    solved = balance(cells, margins, cap)
    rates = cells.withColumn("_lam", F.lit(0.0))
    for c, m in solved.items():
        rates = rates.join(m.select(F.col(c).alias("_value"), F.col("lam").alias("_add")), F.col(c).eqNullSafe(F.col("_value")), "left").withColumn("_lam", F.col("_lam") + F.coalesce("_add", F.lit(0.0))).drop("_value", "_add")
    rates = staged(rates.select(*[F.col(c).alias(f"_{c}") for c in margins], F.least(F.lit(float(cap)), F.exp("_lam")).alias("rate"), "_n"), "rates")
    on = [counted[c].eqNullSafe(F.col(f"_{c}")) for c in margins]
    joined = counted.join(rates, on, "left").drop(*[f"_{c}" for c in margins])
    key = F.concat_ws("\x00", *[F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in margins])
    names = [F.col(f"`{c}`") for c in counted.columns]
    joined = joined.withColumn("_key", F.xxhash64(key)).withColumn("_order", F.xxhash64("doc_id", "size")).withColumn("_tie", F.xxhash64(*names)).withColumn("_most", F.lit(int(cap)).cast("long"))
    joined = joined.withColumn("_salt", salted(F.col("_key"), F.col("_n"), group_rows, F.col("_order")))
    # a long with nulls would become a double in pandas
    joined = joined.withColumn("_none", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0).cast("long")))
    keep = [*counted.columns, "rate", "_none"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group["_at"] = np.arange(len(group))
        done = _diffuse(group).set_index("_at").reindex(group["_at"])
        return group.assign(copies=done["copies"].to_numpy(), part_words=done["part_words"].to_numpy())[[*keep, "copies", "part_words"]]

    schema = ", ".join(f"`{n}` {t}" for n, t in joined.select(*keep).dtypes) + ", copies long, part_words long"
    planned = joined.groupBy("_key", "_salt").applyInPandas(run, schema)
    return planned.withColumn("doc_id", F.when(~F.col("_none"), F.col("doc_id"))).drop("_none")


def one_by_one(planned: DataFrame) -> DataFrame:
    """The documents that the rows of ``plan_copies`` stand for, each with its own copies and part_words."""
    at = numbered_times(planned, F.col("_rows"), "_i")
    own = F.floor(F.col("copies") / F.col("_rows")) + (F.col("_i") < F.pmod(F.col("copies"), F.col("_rows"))).cast("long")
    # the last has the fewest copies, the first the most
    takes = F.when(F.col("part_words") > 0, F.col("_i") == F.col("_rows") - 1).otherwise(F.col("_i") == 0)
    return at.withColumn("copies", own).withColumn("part_words", F.when(takes, F.col("part_words")).otherwise(0)).drop("_i", "_rows")


def mix(docs: DataFrame, targets: DataFrame, source: str = "source", margins: dict[str, DataFrame] | None = None, cap: int = MAX_COPIES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``docs`` (doc_id, size, source and any margin columns) with rate, copies and part_words.

    ``targets(source, target)`` is the token constraint of each source; ``margins`` may hold more of
    them, by column.
    """
    counted = staged(docs.groupBy(*docs.columns).agg(F.count(F.lit(1)).alias("_rows")), "counted")
    return one_by_one(plan_copies(counted, targets, source, margins, cap, group_rows))


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, cap: int) -> DataFrame:
    """(source, source_size, target) of ``sized(source, size, _rows)``."""
    sources = staged(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("_rows")).alias("source_size")), "sources")
    return staged(water_filled_targets(sources, weights, share, cap), "targets")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: int = MAX_COPIES) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, part_words, taken for every row of ``docs``."""
    sized = word_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")).drop("text")
    counted = staged(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("_rows")), "counted")
    targets = source_targets(counted, weights, share, cap)
    got = one_by_one(plan_copies(counted, targets, cap=cap))
    names = targets.select(F.col("source").alias("_s"), "source_size", "target")
    return got.join(names, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumn("taken", F.col("copies") * F.col("size") + F.col("part_words"))


def mixed_copies(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: int = MAX_COPIES) -> DataFrame:
    """``docs`` with each row as many times as the mix takes it whole (part copies aside); documents
    without words, which take no part in a token mix, stay once each. Rows equal in all columns are
    planned together. Columns of any name travel along."""
    named = word_counts(row_names(docs).withColumn("source", F.col("row.source"))).drop("text")
    on = ["doc_id", "text_hash", "row_hash"]
    # the names of a row that joins can compare
    own = [F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.col("doc_id").isNull().alias("none"), "text_hash", "row_hash"]
    with scratch(docs.sparkSession) as keep:
        counted = staged(named.groupBy(*on, "source", "size").agg(F.count(F.lit(1)).alias("_rows")), "counted")
        planned = plan_copies(counted, source_targets(counted, weights, share, cap), cap=cap)
        taken = F.when(F.col("size") == 0, F.col("_rows")).otherwise(F.col("copies")).alias("taken")
        plan = keep(staged(planned.select(*own, taken).where("taken > 0"), "copies"))
    # one exchange of the texts: equal rows are dropped where the plan meets them
    on = ["doc_id", "none", "text_hash", "row_hash"]
    met = named.select(*own, "row").join(plan.hint("merge"), on).dropDuplicates(on)
    return numbered_times(met, F.col("taken"), "copy").select("row.*")
