"""Cache policies as relational queries over entries(key, ts, last_accessed, access_count, size)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ms, safe_div
from ..functions.scores import cache_value
from ..params import Cache
from .ordering import carried, ranges

C = Cache()


def expired(entries: DataFrame, as_of: Column, ttl_ms: float = C.ttl_ms) -> Column:
    return (ms(as_of) - ms("ts")) > ttl_ms


def live(entries: DataFrame, as_of: Column, ttl_ms: float = C.ttl_ms) -> DataFrame:
    return entries.where(~expired(entries, as_of, ttl_ms))


def _kept_sums(entries: DataFrame, *order: Column) -> DataFrame:
    """``entries`` with _left: the bytes of all entries that stand after it in the order of eviction, and
    _total. Prefix sums by ranges, so no task sorts the whole table."""
    t = carried(ranges(entries, [], list(order)), [], F.col("size"), "_before").drop("_part", "_at")
    total = t.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("_total"))
    return t.join(F.broadcast(total), F.lit(True)).withColumn("_left", F.col("_total") - F.col("_before") - F.col("size")).drop("_before")


def evict_lru(entries: DataFrame, as_of: Column, required: int = 0, max_bytes: int = C.max_bytes, ttl_ms: float = C.ttl_ms) -> DataFrame:
    """The entries left after room for ``required`` bytes is made: expired ones go, then the least
    recently used until the rest fits."""
    k = _kept_sums(live(entries, as_of, ttl_ms), F.col("last_accessed").asc(), F.col("key").asc())
    # an entry goes while what is left with it is too large
    return k.where(F.col("_left") + F.col("size") + required <= max_bytes).drop("_left", "_total")


def with_value(entries: DataFrame, as_of: Column) -> DataFrame:
    return entries.withColumn("value", cache_value(F.col("access_count"), ms(as_of) - ms("last_accessed"), ms(as_of) - ms("ts"), F.col("size")))


def trim_by_value(entries: DataFrame, as_of: Column, max_bytes: int = C.max_bytes, high: float = C.high_water, low: float = C.low_water) -> DataFrame:
    """Above the high-water mark the least valuable entries go until the low-water mark is reached."""
    k = _kept_sums(with_value(entries, as_of), F.col("value").asc(), F.col("key").asc())
    stay = (F.col("_total") <= max_bytes * high) | (F.col("_left") + F.col("size") <= max_bytes * low)
    return k.where(stay).drop("_left", "_total")


def stats(entries: DataFrame) -> DataFrame:
    """Entries, bytes, mean access time (ms between first and last access) and hit rate (accesses after
    the first over all accesses)."""
    return entries.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.avg(ms("last_accessed") - ms("ts")).alias("mean_access_ms"), safe_div(F.sum(F.greatest(F.col("access_count") - 1, F.lit(0))), F.sum("access_count")).alias("hit_rate"))


def delete(entries: DataFrame, keys: DataFrame) -> DataFrame:
    return entries.join(keys.select("key"), "key", "left_anti")


def query_key(vector: Column, kind: Column, k: int) -> Column:
    """What a similarity result is remembered by: the query's vector, type and number of results."""
    return F.xxhash64(vector, kind, F.lit(k))


def remembered(queries: DataFrame, results: DataFrame, k: int, search: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(results of all ``queries(query_id, query, type)``, rows to remember). Queries whose key is in
    ``results(key, query_id, id, similarity, rank)`` are answered from it, the others by ``search``."""
    keyed = queries.withColumn("key", query_key(F.col("query"), F.col("type"), k))
    old = keyed.select("key", "query_id").join(results.drop("query_id"), "key")
    fresh = keyed.join(results.select("key").distinct(), "key", "left_anti")
    new = search(fresh.drop("key")).join(fresh.select("query_id", "key"), "query_id")
    names = ["key", "query_id", "id", "similarity", "rank"]
    return old.select(*names).unionByName(new.select(*names)), new.select(*names)
