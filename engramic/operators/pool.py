"""Workers and tasks as tables: queue order, dispatch, telemetry, state times."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ms
from ..functions.scores import clamped_priority, scaled_pool, worker_probability
from ..params import Pool
from .ordering import numbered

P = Pool()


def queue_order(tasks: DataFrame, threshold: int = P.priority_threshold, keys: tuple[str, ...] = ()) -> DataFrame:
    """``tasks(id, priority, created)`` with their place in the queue: a task at or above the threshold
    stands before all of lower priority, the others in order of arrival behind them."""
    p = clamped_priority(F.col("priority"))
    band = F.when(p >= threshold, p).otherwise(F.lit(-1))
    t = numbered(tasks.withColumn("_band", band), list(keys), [F.desc("_band"), F.col("created"), F.col("id")], "place")
    return t.withColumn("priority", p.cast("int")).withColumn("place", F.col("place") + 1).drop("_band")


def probabilities(workers: DataFrame) -> DataFrame:
    """Idle workers with the weight that dispatch gives them."""
    n = workers.agg(F.count(F.lit(1)).alias("_n"))
    w = workers.where("not busy").join(F.broadcast(n), F.lit(True))
    return w.withColumn("weight", worker_probability(F.col("efficiency"), F.col("_n"), F.col("health"), F.col("cpu"), F.col("memory"))).drop("_n")


def telemetry(tasks: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Processed, mean, least and greatest latency, error rate."""
    return tasks.groupBy(*keys).agg(F.count(F.lit(1)).alias("processed"), F.avg("latency").alias("avg_latency"), F.min("latency").alias("min_latency"), F.max("latency").alias("max_latency"), F.avg(F.col("failed").cast("double")).alias("error_rate"))


def least_healthy(workers: DataFrame, n: int) -> DataFrame:
    """The n workers to remove first."""
    return workers.orderBy("health", "worker_id").limit(n)


def assignments(tasks: DataFrame, workers: DataFrame) -> DataFrame:
    """Tasks with the worker that holds them, if any."""
    return tasks.join(workers.select("worker_id", F.col("task_id").alias("id")), "id", "left")


def state_times(transitions: DataFrame) -> DataFrame:
    """(worker_id, state, ms): how long each worker was in each state between its transitions."""
    w = Window.partitionBy("worker_id").orderBy("ts")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    t = transitions.withColumn("_ms", (F.lead(us).over(w) - us) / 1000.0)
    return t.where("_ms is not null").groupBy("worker_id", F.col("to").alias("state")).agg(F.sum("_ms").alias("ms"))


def latency_spikes(log: DataFrame, n: int = 10, limit: float = 2.0) -> DataFrame:
    """(ts, kind, value): of the last ``n`` telemetry rows of ``log(ts, value)`` those further than ``limit``
    population deviations from their mean; none for fewer than two rows."""
    last = log.orderBy(F.desc("ts"), F.desc("value")).limit(n)
    stats = last.agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"), F.count(F.lit(1)).alias("_n"))
    far = last.join(F.broadcast(stats), F.lit(True)).where((F.col("_n") >= 2) & (F.abs(F.col("value") - F.col("_m")) > limit * F.col("_s")))
    return far.select("ts", F.lit("latency_spike").alias("kind"), "value")


def timed_out(tasks: DataFrame, workers: DataFrame, as_of: Column, timeout_ms: float = P.timeout_ms) -> DataFrame:
    """(id, worker_id, error) of the tasks that a worker holds for longer than allowed: the task is rejected
    and the worker replaced."""
    held = tasks.join(workers.select("worker_id", F.col("task_id").alias("id")), "id")
    return held.where((ms(as_of) - ms("created")) > timeout_ms).select("id", "worker_id", F.lit("Task timeout").alias("error"))


def health_actions(workers: DataFrame, least_efficiency: float = 0.5) -> DataFrame:
    """(worker_id, action): replace below a health of 0.2; heal below 0.5, above five errors or below the
    least efficiency; workers that need nothing are left out."""
    ill = (F.col("health") < 0.5) | (F.col("errors") > 5) | (F.col("efficiency") < least_efficiency)
    action = F.when(ill & (F.col("health") < 0.2), "replace").when(ill, "heal")
    return workers.select("worker_id", action.alias("action")).where("action is not null")


def scaling_target(tasks: DataFrame, workers: DataFrame, p: Pool = P) -> DataFrame:
    """One row: active workers, queued tasks (that no worker holds) and the size the pool should have."""
    queued = tasks.join(workers.select(F.col("task_id").alias("id")), "id", "left_anti").agg(F.count(F.lit(1)).alias("queued"))
    w = workers.agg(F.count(F.lit(1)).alias("active"), F.coalesce(F.avg("cpu"), F.lit(0.0)).alias("_c"), F.coalesce(F.avg("memory"), F.lit(0.0)).alias("_m"))
    j = w.join(F.broadcast(queued), F.lit(True))
    return j.select("active", "queued", scaled_pool(F.col("active"), F.col("queued"), F.col("_c"), F.col("_m"), p.min_workers, p.max_workers, p.scaling_factor).alias("target"))


def resize(workers: DataFrame, least: int, most: int) -> tuple[int, DataFrame]:
    """(workers to create, workers to stop): the idle ones of least health go first."""
    n = workers.count()
    return max(0, least - n), least_healthy(workers.where(~F.col("busy")), max(0, n - most)).select("worker_id")


def pool_state(tasks: DataFrame, workers: DataFrame) -> DataFrame:
    """One row: tasks in the queue, busy workers, and whether the pool is idle."""
    q = tasks.agg(F.count(F.lit(1)).alias("queue_length"))
    b = workers.agg(F.count_if(F.col("busy")).alias("busy"))
    return q.join(F.broadcast(b), F.lit(True)).withColumn("idle", (F.col("queue_length") == 0) & (F.col("busy") == 0))


def terminated(tasks: DataFrame) -> DataFrame:
    """(id, error) of all tasks that a pool rejects when it ends."""
    return tasks.select("id", F.lit("Worker pool terminated").alias("error"))


def resource_usage(workers: DataFrame) -> DataFrame:
    """One row: workers, mean processor and memory use, least and greatest efficiency."""
    return workers.agg(F.count(F.lit(1)).alias("workers"), F.coalesce(F.avg("cpu"), F.lit(0.0)).alias("cpu"), F.coalesce(F.avg("memory"), F.lit(0.0)).alias("memory"), F.min("efficiency").alias("least_efficiency"), F.max("efficiency").alias("greatest_efficiency"))


def run_tasks(tasks: DataFrame, functions: dict[str, Callable[[pd.Series], pd.Series]]) -> DataFrame:
    """(id, result, error) of ``tasks(id, type, value)``: each task's value through the function of its type,
    wherever the task is; a type without a function is an error of the task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = pd.DataFrame({"id": f["id"], "result": np.full(len(f), np.nan), "error": pd.Series([None] * len(f), index=f.index, dtype=object)})
            for kind, rows in f.groupby("type", dropna=False):
                fn = functions.get(kind)
                if fn is None:
                    out.loc[rows.index, "error"] = f"Unknown task type: {kind}"
                else:
                    out.loc[rows.index, "result"] = fn(rows["value"]).astype(float)
            yield out

    return tasks.select("id", "type", "value").mapInPandas(run, "id long, result double, error string").withColumn("result", F.nanvl("result", F.lit(None).cast("double")))


def idle_to_stop(workers: DataFrame, as_of: Column, idle_ms: float = 60_000, least: int = P.min_workers) -> DataFrame:
    """Workers idle for longer than allowed, the longest idle first, as long as ``least`` remain."""
    n = workers.count()
    return workers.where(~F.col("busy") & ((ms(as_of) - ms("last_active")) > idle_ms)).orderBy("last_active", "worker_id").limit(max(0, n - least))
