"""Tables written to the folder that the driver and all executors share: they cut the lineage, so a
lost executor never forces what stands before them to run again."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only on a single machine (a local master, as in tests) may
    it be unset: then it is a temporary folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def delete_at_exit(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def write_scratch(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    delete_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back; it goes at the end of the application."""
    return write_scratch(df, scratch_path(df.sparkSession, tag))
