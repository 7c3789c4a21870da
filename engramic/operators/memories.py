"""The memory table: one row for each record with its embedding, times, access counts and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = ("episodic", "semantic", "procedural", "emotional")

SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("cluster_id", T.IntegerType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("strength", T.DoubleType()),
        T.StructField("last_accessed", T.TimestampType()),
        T.StructField("access_count", T.LongType()),
        T.StructField("emotions", T.ArrayType(T.StringType())),
    ]
)


def from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories out of the embeddings, events and documents tables (keyed joins; the users' access
    profiles are aggregated before they are joined)."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    events = read("events")
    users = events.groupBy("user_id").agg(F.max("ts").alias("last_accessed"), F.count(F.lit(1)).alias("access_count"), F.array_sort(F.collect_set("event_type")).alias("emotions"))
    one = events.select(F.col("event_id").alias("id"), "user_id", "ts", "value")
    names = F.array(*[F.lit(t) for t in TYPES])
    v = read("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("cluster_id"))
    texts = read("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    m = v.join(one, "id").join(users, "user_id", "left").join(texts, "id", "left")
    return m.select("id", F.element_at(names, (F.col("cluster_id") % 4 + 1).cast("int")).alias("type"), "content", "vector", "cluster_id", F.col("ts").cast("timestamp").alias("ts"), F.least(F.lit(1.0), F.col("value") / 500).alias("strength"), F.col("last_accessed").cast("timestamp").alias("last_accessed"), "access_count", "emotions")


def of_type(memories: DataFrame, kind: str | None = None) -> DataFrame:
    """A scan, with the type pushed down."""
    return memories if kind is None else memories.where(F.col("type") == kind)


def lookup(memories: DataFrame, keys: DataFrame) -> DataFrame:
    """The memories of ``keys(type, id)``, whichever exist."""
    return memories.join(keys, ["type", "id"])


def members(memories: DataFrame, kind: str, cluster: int) -> DataFrame:
    return memories.where((F.col("type") == kind) & (F.col("cluster_id") == cluster))


def references(memories: DataFrame, back: int = 2) -> DataFrame:
    """(src, dst): each memory refers to the ``back`` ones before it in its cluster."""
    w = Window.partitionBy("cluster_id").orderBy("id")
    lags = memories.select(F.col("id").alias("src"), *[F.lag("id", k).over(w).alias(f"_{k}") for k in range(1, back + 1)])
    return lags.select("src", F.explode(F.array_compact(F.array(*[f"_{k}" for k in range(1, back + 1)]))).alias("dst"))


def with_references(memories: DataFrame, edges: DataFrame) -> DataFrame:
    """``memories`` with ``refs``: an array of what it refers to (id, type, ts, strength, emotions, vector)."""
    target = memories.select(F.col("id").alias("dst"), F.struct("id", "type", "ts", "strength", "emotions", "vector").alias("_r"))
    refs = edges.join(target, "dst").groupBy("src").agg(F.sort_array(F.collect_list("_r")).alias("refs"))
    return memories.join(refs.withColumnRenamed("src", "id"), "id", "left")
