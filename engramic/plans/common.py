"""Inputs of the queries, on either side: Spark frames and DuckDB table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import memories as mem

AS_OF_TEXT = "2024-01-31 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF_TEXT).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mem.from_tables(spark, sf_dir)


def edges(m: DataFrame) -> DataFrame:
    return mem.references(m)


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric log: daily mean value by event type."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("metric"), F.to_date("ts").alias("ts")).agg(F.round(F.avg("value"), 6).alias("value"))


def cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache entries: a row for each user of the events, sized by a first payload."""
    e = table(spark, sf_dir, "events")
    g = e.groupBy(F.col("user_id").alias("key")).agg(F.min("ts").alias("ts"), F.max("ts").alias("last_accessed"), F.count(F.lit(1)).alias("access_count"), (F.sum(F.length("props")) * 2).alias("size"))
    return g


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks: a row for each order, with a priority of 1 to 5 by its text."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("_p"), F.col("o_orderdate").alias("created"), (F.col("o_totalprice") / 1000).alias("latency"), (F.col("o_orderstatus") == "F").alias("failed"), F.pmod("o_custkey", F.lit(97)).alias("worker_id"), F.col("o_orderdate").alias("ts")).withColumn("priority", (F.col("_p") * 3 - 3)).drop("_p")


MEM = """users AS (SELECT user_id, max(ts) AS last_accessed, count(*) AS access_count, list_sort(list(DISTINCT event_type)) AS emotions FROM events GROUP BY user_id),
mem AS (SELECT v.vec_id AS id, list_extract(['episodic','semantic','procedural','emotional'], v.label % 4 + 1) AS type, d.text AS content, v.embedding::DOUBLE[] AS vector, v.label AS cluster_id, e.ts AS ts, least(1.0::DOUBLE, e.value / 500) AS strength, u.last_accessed, u.access_count, u.emotions
 FROM embeddings v JOIN events e ON e.event_id = v.vec_id LEFT JOIN users u USING (user_id) LEFT JOIN documents d ON d.doc_id = v.vec_id),
edges AS (SELECT src, dst FROM (SELECT id AS src, unnest([lag(id, 1) OVER w, lag(id, 2) OVER w]) AS dst FROM mem WINDOW w AS (PARTITION BY cluster_id ORDER BY id)) WHERE dst IS NOT NULL),
now AS (SELECT epoch_us(TIMESTAMP '2024-01-31 00:00:00') / 1000.0 AS t)"""
CENT = """cent AS (SELECT label AS cluster_id, list(x ORDER BY pos) AS centroid FROM (SELECT label, pos, avg(embedding[pos]::DOUBLE) AS x FROM embeddings, range(1, 65) t(pos) GROUP BY ALL) GROUP BY label)"""
LOG = "log AS (SELECT event_type AS metric, ts::DATE AS ts, round(avg(value), 6) AS value FROM events GROUP BY ALL)"
ENTRIES = "entries AS (SELECT user_id AS key, min(ts) AS ts, max(ts) AS last_accessed, count(*) AS access_count, sum(length(props)) * 2 AS size FROM events GROUP BY user_id)"
TASKS = "tasks AS (SELECT o_orderkey AS id, substr(o_orderpriority, 1, 1)::INT * 3 - 3 AS priority, o_orderdate AS created, o_totalprice / 1000 AS latency, o_orderstatus = 'F' AS failed, o_custkey % 97 AS worker_id, o_orderdate AS ts FROM orders)"


def ms(c: str) -> str:
    return f"(epoch_us({c}) / 1000.0)"


#: The coefficients of functions.numeric below the highest, in falling order.
ERFC_HIGH_TO_LOW = (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)


def erf_sql(x: str) -> str:
    """The error function as SQL text."""
    t = f"(1 / (1 + 0.5 * abs({x})))"
    poly = "0.17087277"
    for c in ERFC_HIGH_TO_LOW:
        poly = f"({poly} * {t} + ({c}))"
    return f"(CASE WHEN {x} >= 0 THEN 1 - {t} * exp({poly} - {x} * {x}) ELSE {t} * exp({poly} - {x} * {x}) - 1 END)"


def cdf_sql(x: str, mean: str = "0", sd: str = "1") -> str:
    return f"(0.5 * (1 + {erf_sql(f'(({x} - {mean}) / ({sd} * sqrt(2.0::DOUBLE)))')}))"
