"""Reading and writing memories, anomalies, partitions and prediction state as Parquet."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.memories import SCHEMA

ANOMALIES = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("type", T.StringType()), T.StructField("value", T.DoubleType())])


class MemoryStore:
    """A folder of tables: memories (by type), archive, partitions, anomalies, cache."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def append(self, memories: DataFrame) -> None:
        """Inserts; partitioned by type, so that a scan of one type reads that type alone."""
        memories.write.mode("append").partitionBy("type").parquet(self._path("memories"))

    def save(self, table: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self._path(table))

    def load(self, table: str, schema: T.StructType | None = None) -> DataFrame:
        """A table; a missing one is empty where its schema is known."""
        try:
            r = self.spark.read
            return (r.schema(schema) if schema else r).parquet(self._path(table))
        except AnalysisException:
            if schema is None:
                raise
            return self.spark.createDataFrame([], schema)

    def memories(self, kind: str | None = None) -> DataFrame:
        m = self.load("memories", SCHEMA)
        return m if kind is None else m.where(m["type"] == kind)

    def anomalies(self) -> DataFrame:
        return self.load("anomalies", ANOMALIES)

    def log_anomaly(self, rows: DataFrame) -> None:
        rows.select("ts", "type", "value").write.mode("append").parquet(self._path("anomalies"))

    def save_state(self, history: DataFrame, analyses: DataFrame, gates: DataFrame, config: dict | None = None) -> None:
        """The predictive state: the pattern history, the last analyses, the gates of each type, and the
        configuration as JSON."""
        for name, df in (("pattern_history", history), ("analyses", analyses), ("gates", gates)):
            self.save(f"state/{name}", df)
        self.save("state/config", self.spark.createDataFrame([(json.dumps(config or {}, sort_keys=True),)], "config string"))

    def load_state(self) -> dict[str, object]:
        """What ``save_state`` wrote; raises where there is none."""
        out: dict[str, object] = {name: self.load(f"state/{name}") for name in ("pattern_history", "analyses", "gates")}
        return out | {"config": json.loads(self.load("state/config").first()["config"])}

    def archive(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self._path("archive"))


def to_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON string."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def from_json(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of JSON strings by a declared schema; what does not parse is null."""
    return rows.select(F.from_json("json", schema).alias("r")).select("r.*")
