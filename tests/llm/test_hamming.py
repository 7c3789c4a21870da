from __future__ import annotations

from pyspark.sql import functions as F

from engramic.llm import hamming


def test_hot_keys_are_exact(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 60, 7).when(F.col("id") < 69, 8).otherwise(F.col("id")).alias("key"), F.lit(0).alias("table"), "id")
    for cells in (1, 16, 1 << 14):
        assert [(r["key"], r["_n"]) for r in hamming.hot_keys(rows, 10, cells).collect()] == [(7, 60)]
    dealt = hamming.deal_units(rows, 10)
    units = {r["unit"]: r["n"] for r in dealt.where("key = 7").groupBy("unit").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(units) == 21 and sum(units.values()) == 60 * 6 and max(units.values()) < 60
    pairs = dealt.where("key = 7").alias("a").join(dealt.where("key = 7").alias("b"), "unit").select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).distinct().count()
    assert pairs == 3600
    assert dealt.where("key <> 7").count() == 940 and hamming.deal_units(rows.limit(0), 10).count() == 0
