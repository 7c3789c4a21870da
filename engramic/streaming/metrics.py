"""Structured Streaming forms: windowed metrics with late data, and the gated state of each type."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..params import Prediction

P = Prediction()


def windowed_metrics(events: DataFrame, key: str = "event_type", value: str = "value", width: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(key, start, n, mean, std_dev) of each window; rows later than ``late`` are left out. The time
    column is read as UTC, since a watermark needs a zoned timestamp."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = e.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std_dev"))
    return g.select(key, F.col("w.start").alias("start"), "n", "mean", "std_dev")


def streaming_thresholds(events: DataFrame, key: str = "event_type", value: str = "value", least: int = 10) -> DataFrame:
    """(key, n, normal, warning, critical) of a stream, refreshed by each batch: mean, and one and two population
    deviations above it, for keys with ``least`` values."""
    g = events.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return g.where(F.col("n") >= least).select(key, "n", F.col("_m").alias("normal"), (F.col("_m") + F.col("_s")).alias("warning"), (F.col("_m") + 2 * F.col("_s")).alias("critical"))


def on_update(stream: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update", every: str | None = "60 seconds") -> StreamingQuery:
    """Calls ``callback(rows, batch)`` with what each batch of a stream changed; without ``every`` once for all
    input there is now. A repeated batch comes with the same number."""
    w = stream.writeStream.foreachBatch(callback).outputMode(mode).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def gate_step(hidden: list[float], cell: list[float], values: list[float]) -> tuple[list[float], list[float], float, float]:
    """One step of the gated state: (hidden, cell, score, significance)."""
    new = [0.7 * (cell[i] if i < len(cell) else 0.0) + 0.3 * math.tanh(v or 0.5) for i, v in enumerate(values)]
    out = [0.5 * math.tanh(c) for c in new]
    mean = lambda a: sum(a) / len(a) if a and sum(a) else 0.5
    return out, new, mean(out), abs(mean(out) - mean(hidden))


def gated_state(rows: DataFrame, key: str = "type", order: str = "ts", value: str = "relevance", window: int = P.state_window) -> DataFrame:
    """A stream of (key, order, value) as (key, order, score, significance): the state of each key holds its
    last ``window`` values and the gates, and takes the rows of a batch in their order."""
    out = f"`{key}` string, `{order}` timestamp, score double, significance double"
    state = "values array<double>, hidden array<double>, cell array<double>"

    def run(keys: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        values, hidden, cell = ([*x] for x in held.get) if held.exists else ([], [], [])
        got = pd.concat(list(frames)).sort_values(order)
        made = []
        for t, v in zip(got[order], got[value], strict=True):
            values = [*values, float(v)][-window:]
            hidden, cell, score, significance = gate_step(hidden, cell, values)
            made.append((keys[0], t, score, significance))
        held.update((values, hidden, cell))
        yield pd.DataFrame(made, columns=[key, order, "score", "significance"])

    return rows.select(key, order, value).groupBy(key).applyInPandasWithState(run, out, state, "append", "NoTimeout")
