"""Places of rows in an order, however many rows a key has.

Up to ``KEY_ROWS`` rows of a key they are a window by key. Beyond it the rows are dealt into ranges of
(key, order), numbered within a range, and moved on by the number of the key's rows in the ranges before:
a hot key, or a table without keys, is never sorted in one task. Both ways give equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import staged

#: Rows of one key that a window may sort.
KEY_ROWS = 1_000_000
#: A table of counts by key and range is broadcast up to so many rows.
BROADCAST_ROWS = 200_000


def most_rows(df: DataFrame, keys: list[str]) -> int:
    """The rows of the largest key."""
    if not keys:
        return df.count()
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0


def _same(keys: list[str]) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]


def ranges(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` sorted by ranges of (keys, order), with _part (the range) and _at (the place in it); staged,
    so that counts and rows come from one evaluation."""
    by = [*[F.col(k) for k in keys], *order]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by)
    return staged(placed.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "ranges")


def carried(placed: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """``placed`` with the sum of ``value`` over all rows of the same keys before each row."""
    per = placed.groupBy(*keys, "_part").agg(F.sum(value).alias("_v"))
    before = F.sum("_v").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # a row for each key and range that has it
    base = staged(per.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_b")), "carried")
    base = F.broadcast(base) if base.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else base
    on = F.col("_part") == F.col("_p")
    for c in _same(keys):
        on = on & c
    inside = F.sum(value).over(Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    joined = placed.withColumn("_in", F.coalesce(inside, F.lit(0))).join(base, on)
    return joined.withColumn(name, F.col("_b") + F.col("_in")).drop("_in", "_b", "_p", *[f"_k{i}" for i in range(len(keys))])


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "i", key_rows: int | None = None, total: str | None = None, most: int | None = None) -> DataFrame:
    """``df`` with each row's place among the rows of its keys, from 0, and in ``total`` how many those are.
    ``most``: a bound of the rows of a key, where it is known."""
    if (most_rows(df, keys) if most is None else most) <= (KEY_ROWS if key_rows is None else key_rows):
        w = Window.partitionBy(*(keys or [F.lit(0)]))
        out = df.withColumn(name, (F.row_number().over(w.orderBy(*order)) - 1).cast("long"))
        return out.withColumn(total, F.count(F.lit(1)).over(w)) if total else out
    out = carried(ranges(df, keys, order), keys, F.lit(1).cast("long"), name).drop("_part", "_at")
    if total is None:
        return out
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(total)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], total)
    on = F.lit(True)
    for c in _same(keys):
        on = on & c
    return out.join(n, on).drop(*[f"_k{i}" for i in range(len(keys))])


def exact_quantiles(df: DataFrame, keys: list[str], x: str, qs: list[float], key_rows: int | None = None) -> DataFrame:
    """(keys, q0, q1, ...): linear-interpolated quantiles of ``x``. Up to ``key_rows`` rows of a key they are
    one aggregate; beyond it the rows at the two places around each quantile are picked by their numbers,
    and no task holds a key's values."""
    if most_rows(df, keys) <= (KEY_ROWS if key_rows is None else key_rows):
        g = df.groupBy(*keys).agg(F.percentile(x, F.array(*[F.lit(float(q)) for q in qs])).alias("_q"))
        return g.select(*keys, *[F.col("_q")[k].alias(f"q{k}") for k in range(len(qs))])
    j = numbered(df.select(*keys, x), keys, [F.col(x)], "_i", 0, "_n")
    place = lambda q: (F.col("_n") - 1) * F.lit(float(q))
    picked = [F.max(F.when(F.col("_i") == f(place(q)), F.col(x))).alias(f"_{s}{k}") for k, q in enumerate(qs) for s, f in (("l", F.floor), ("h", F.ceil))]
    wanted = F.lit(False)
    for q in qs:
        wanted = wanted | (F.col("_i") == F.floor(place(q))) | (F.col("_i") == F.ceil(place(q)))
    g = j.where(wanted).groupBy(*keys).agg(F.max("_n").alias("_n"), *picked)
    part = lambda q: place(q) - F.floor(place(q))
    return g.select(*keys, *[(F.col(f"_l{k}") + (F.col(f"_h{k}") - F.col(f"_l{k}")) * part(q)).alias(f"q{k}") for k, q in enumerate(qs)])


def in_blocks(df: DataFrame, keys: list[str], order: list[Column], before: int, block: int, key_rows: int | None = None, place: str | None = None) -> tuple[DataFrame, list[str]]:
    """(rows, keys of blocks): for windows over the ``before`` rows ahead of each row. Up to ``key_rows`` rows
    of a key the blocks are the keys; beyond it a key is cut into blocks, each with the last ``before`` rows
    of the one before it, marked _own false; ``place`` then holds the row's place in its key."""
    if most_rows(df, keys) <= (KEY_ROWS if key_rows is None else key_rows):
        return df.withColumn("_own", F.lit(True)), keys
    # a name that no column of the caller has: its own places travel along
    at = place or max(df.columns, key=len) + "_i"
    t = numbered(df, keys, order, at, 0)
    own = F.floor(F.col(at) / block)
    also = F.when(F.pmod(F.col(at), F.lit(block)) >= block - before, F.array(own, own + 1)).otherwise(F.array(own))
    t = t.withColumn("_block", F.explode(also)).withColumn("_own", F.col("_block") == own)
    return t if place else t.drop(at), [*keys, "_block"]
