"""Queries that run as streams to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import lifecycle, predict
from ..operators import memories as mem
from ..scratch import delete_at_exit, scratch_path
from ..streaming import metrics as stream
from .common import MEM, as_of, edges, memories, r6, rounded, table
from .memories import ENRICHED, WALK


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _finished(df: DataFrame, mode: str) -> DataFrame:
    """What the stream has produced once all input there is now is read: each batch is written to the shared
    folder under its number, so a repeated batch leaves one copy; of a complete result the last counts."""
    spark, root = df.sparkSession, scratch_path(df.sparkSession, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/{mode}/batch={number}")

    query = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    delete_at_exit(spark, root)
    done = query.lastProgress
    if done is None:
        return spark.createDataFrame([], df.schema)
    out = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{root}/{mode}")
    if mode == "complete":
        out = out.where(F.col("batch") == out.agg(F.max("batch")).first()[0])
    return out.drop("batch")


def _windows(spark, sf_dir):
    w = stream.windowed_metrics(_events(spark, sf_dir))
    return rounded(_finished(w, "complete").withColumn("day", F.to_date("start")).drop("start"), "mean", "std_dev")


def _gates(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("event_type").alias("type"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") / 500).alias("relevance"))
    return rounded(_finished(stream.gated_state(e), "append"), "score", "significance")


def _enriched(spark, sf_dir):
    m = memories(spark, sf_dir)
    e = lifecycle.enrich(m, edges(m), as_of())
    return e.select("id", r6("predicted_relevance").alias("predicted_relevance"), F.size("ai_generated_tags").alias("tags"), r6("importance").alias("importance"), F.size("neural_weights").alias("weights"), "decay_rate")


def _with_references(spark, sf_dir):
    m = memories(spark, sf_dir)
    return mem.with_references(m, edges(m)).select("id", F.coalesce(F.size("refs"), F.lit(0)).alias("n_refs"))


def _relationship_labels(spark, sf_dir):
    m = memories(spark, sf_dir)
    return predict.relationship_labels(m, edges(m), 1).withColumn("labels", F.array_join("labels", ","))


def _thresholds(spark, sf_dir):
    return rounded(_finished(stream.streaming_thresholds(_events(spark, sf_dir)), "complete"), "normal", "warning", "critical")


QUERIES = {"stream_windows": _windows, "stream_thresholds": _thresholds, "stream_gates": _gates, "enriched_memories": _enriched, "memory_references": _with_references, "relationship_labels": _relationship_labels}

ORACLE_SQL = {
    "stream_thresholds": "SELECT event_type, count(*) AS n, round(avg(value), 6) + 0.0 AS normal, round(avg(value) + stddev_pop(value), 6) + 0.0 AS warning, round(avg(value) + 2 * stddev_pop(value), 6) + 0.0 AS critical FROM events GROUP BY 1 HAVING count(*) >= 10",
    "stream_windows": "SELECT event_type, ts::DATE AS day, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) + 0.0 AS std_dev FROM events GROUP BY 1, 2",
    "stream_gates": "WITH RECURSIVE s AS (SELECT event_type AS type, ts, value / 500 AS x, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS i FROM events), g AS (SELECT type, 0::BIGINT AS i, NULL::TIMESTAMP AS ts, []::DOUBLE[] AS vals, []::DOUBLE[] AS cell, []::DOUBLE[] AS hid, 0.0::DOUBLE AS score, 0.0::DOUBLE AS significance FROM (SELECT DISTINCT type FROM s) UNION ALL SELECT type, i, ts, vals, cell, hid, score, abs(score - was) AS significance FROM (SELECT *, CASE WHEN coalesce(list_sum(hid), 0) = 0 THEN 0.5 ELSE list_avg(hid) END AS score FROM (SELECT *, list_transform(cell, lambda c: 0.5 * tanh(c)) AS hid FROM (SELECT *, list_transform(range(1, len(vals) + 1), lambda k: 0.7 * coalesce(old[k], 0) + 0.3 * tanh(CASE WHEN vals[k] = 0 THEN 0.5 ELSE vals[k] END)) AS cell FROM (SELECT s.type, s.i, s.ts, list_append(g.vals, s.x)[-5:] AS vals, g.cell AS old, CASE WHEN coalesce(list_sum(g.hid), 0) = 0 THEN 0.5 ELSE list_avg(g.hid) END AS was FROM g JOIN s ON s.type = g.type AND s.i = g.i + 1))))) SELECT type, ts, round(score, 6) + 0.0 AS score, round(significance, 6) + 0.0 AS significance FROM g WHERE i > 0",
    "enriched_memories": ENRICHED,
    "memory_references": f"WITH {MEM} SELECT id, count(dst)::INT AS n_refs FROM mem LEFT JOIN edges ON src = id GROUP BY 1",
    "relationship_labels": f"WITH RECURSIVE {MEM}, {WALK}, k AS (SELECT src AS id, type, count(*) AS n FROM edges JOIN mem ON id = dst GROUP BY 1, 2 HAVING count(*) > 1), t AS (SELECT id, list(DISTINCT 'strong_' || type || '_connections' ORDER BY 'strong_' || type || '_connections') AS l FROM k GROUP BY 1) SELECT id, array_to_string(coalesce(l, []) || list_filter([CASE WHEN depth > 3 THEN 'deep_network' WHEN depth > 1 THEN 'shallow_network' END], lambda x: x IS NOT NULL), ',') AS labels FROM d LEFT JOIN t USING (id)",
}
