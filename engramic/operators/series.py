"""Ordered series: rolling scores, smoothing, trends, cycles, lags, recurring runs.

A series is a key and its rows in the order of given columns. Rolling frames and lags are window
functions by key, and by blocks of a key where that has too many rows for one task; folds that need
every earlier value run over sorted rows, by ranges beyond ``FOLD_ROWS`` rows of a key, with equal
results up to the rounding of sums.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_up, normal_pdf
from ..params import Correlation, Metrics, Statistics
from ..scratch import staged
from .ordering import in_blocks, numbered
from .statistics import best_fit, density_curve, distribution_fits, histogram, iqr_outliers, pearson, sigma_anomalies

M, S, C = Metrics(), Statistics(), Correlation()
#: Rows of one key that one task folds; rows of one block of a rolling frame.
FOLD_ROWS, BLOCK_ROWS = 1_000_000, 200_000


def rolling_z(df: DataFrame, keys: list[str], order: list[str], value: str, rows: int = M.anomaly_window, sample: bool = False, limit: float = 2.0, key_rows: int | None = None) -> DataFrame:
    """Rows whose distance from the mean of the ``rows`` before them exceeds ``limit`` deviations of those.

    Population deviation, and 0 for a flat window; with ``sample`` the sample deviation, and a flat
    window makes any other value infinitely far. The first ``rows`` rows are never flagged. A key with
    too many rows for one task goes in blocks that carry the rows before them.
    """
    r, by = in_blocks(df, keys, [F.col(c) for c in order], rows, max(rows, BLOCK_ROWS), key_rows)
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-rows, -1)
    x = F.col(value).cast("double")
    sd = (F.stddev_samp if sample else F.stddev_pop)(x).over(w)
    r = r.withColumn("_m", F.avg(x).over(w)).withColumn("_s", sd).withColumn("_n", F.count(x).over(w)).where("_own")
    off = F.abs(x - F.col("_m"))
    flat = F.when(off > 0, F.lit(float("inf"))).otherwise(0.0) if sample else F.lit(0.0)
    z = F.when(F.col("_s") == 0, flat).otherwise(F.try_divide(off, F.col("_s")))
    return r.withColumn("z", z).where((F.col("_n") == rows) & (F.col("z") > limit) & ~F.isnan("z")).select(*df.columns, "z")


def latest(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def context_anomalies(df: DataFrame, keys: list[str], order: list[str], value: str, window: int = 10, limit: float = 2.0) -> DataFrame:
    """All rows further than ``limit`` population deviations from the mean of the key's last ``window``
    rows; keys with fewer rows have none."""
    last = latest(df, keys, order, window).groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= window)
    return df.join(last, keys).where(F.abs(F.col(value) - F.col("_m")) > limit * F.col("_s")).drop("_m", "_s", "_n")


def trend_change(df: DataFrame, keys: list[str], order: list[str], value: str, limit: float = 0.1) -> DataFrame:
    """(keys, changed): whether the population variance of the last three values exceeds the limit."""
    return latest(df, keys, order, 3).groupBy(*keys).agg((F.coalesce(F.var_pop(value), F.lit(0.0)) > limit).alias("changed"))


def mean_change(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    d = df.withColumn("_d", F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))
    return d.groupBy(*keys).agg(F.coalesce(F.avg("_d"), F.lit(0.0)).alias("mean_change"))


def smooth(df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float = S.smoothing, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Exponential smoothing s0 = x0, si = alpha xi + (1 - alpha) s(i-1): (keys, idx, x, level).

    Up to ``fold_rows`` rows a key is folded in one task. Beyond it a key goes in blocks, each folded from
    so many rows before it that what stood before those has faded below the last bit of a level."""
    base = df.select(*keys, *order, F.col(value).cast("double").alias("x"))
    fade = math.ceil(60 * math.log(2) / -math.log1p(-alpha)) if 0 < alpha < 1 else 1
    t, by = in_blocks(base, keys, [F.col(c) for c in order], fade, max(fade, BLOCK_ROWS), fold_rows, "_i")
    if "_i" not in t.columns:
        t = t.withColumn("_i", F.lit(None).cast("long"))
    kinds = dict(t.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "idx int", "x double", "level double"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, level, idx = None, 0.0, 0
        for f in frames:
            if not len(f):
                continue
            own = list(f[by].itertuples(index=False, name=None))
            edge = [0, *[i for i in range(1, len(own)) if own[i] != own[i - 1]], len(own)]
            xs, levels, places = f["x"].to_numpy(), np.empty(len(f)), np.empty(len(f), np.int64)
            for a, b in zip(edge, edge[1:], strict=False):
                if own[a] != key:
                    # the first value is a level itself: as if one equal to it stood before
                    key, level, idx = own[a], xs[a], 0
                    levels[a] = level
                    rest = list(itertools.accumulate(xs[a + 1 : b].tolist(), lambda s, x: alpha * x + (1 - alpha) * s, initial=level))
                    levels[a:b] = rest
                else:
                    levels[a:b] = list(itertools.accumulate(xs[a:b].tolist(), lambda s, x: alpha * x + (1 - alpha) * s, initial=level))[1:]
                level = levels[b - 1]
                places[a:b] = np.arange(idx, idx + b - a)
                idx += b - a
            if len(by) > len(keys):
                places = f["_i"].to_numpy()
            out = f[keys].assign(idx=places, x=xs, level=levels)
            yield out[f["_own"].to_numpy(bool)]

    sort = [*by, "_i"] if len(by) > len(keys) else [*keys, *order]
    rows = t.repartition(*by) if by else t.coalesce(1)
    return rows.sortWithinPartitions(*sort).mapInPandas(run, schema)


def last_level(smoothed: DataFrame, keys: list[str]) -> DataFrame:
    return smoothed.groupBy(*keys).agg(F.max_by("level", "idx").alias("level"), F.max("idx").alias("last"))


def forecast_tail(smoothed: DataFrame, keys: list[str], steps: int = 5) -> DataFrame:
    """(keys, step, value): the last ``steps`` levels, in order, from 1."""
    last = smoothed.groupBy(*keys).agg(F.max("idx").alias("_last"))
    j = smoothed.join(last, keys).where(F.col("idx") > F.col("_last") - steps)
    first = F.greatest(F.col("_last") - steps + 1, F.lit(0))
    return j.select(*keys, (F.col("idx") - first + 1).cast("int").alias("step"), F.col("level").alias("value"))


def forecast_curve(smoothed: DataFrame, keys: list[str], best: DataFrame, shift: DataFrame, steps: int = 100) -> DataFrame:
    """(keys, step, x, y): the shifted normal density at steps + 1 places over the range of the levels; 0 for
    series whose best fit is not normal."""
    span = smoothed.groupBy(*keys).agg(F.min("level").alias("_a"), F.max("level").alias("_b"))
    j = span.join(best.select(*keys, "kind"), keys).join(shift.select(*keys, "mean", "std_dev"), keys)
    j = j.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("x", F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("step") / steps)
    y = F.when((F.col("kind") == "normal") & (F.col("std_dev") > 0), normal_pdf(F.col("x"), F.col("mean"), F.col("std_dev"))).otherwise(0.0)
    return j.select(*keys, "step", "x", y.alias("y"))


def stats_view(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, part, x, y): the points of a distribution's chart: histogram bins, the density of the best fit,
    outliers by place, and the forecast curve."""
    hist = histogram(df, keys, value).select(*keys, F.lit("histogram").alias("part"), F.col("bin").alias("x"), F.col("n").cast("double").alias("y"))
    best = staged(best_fit(distribution_fits(df, keys, value), keys), "best")
    curve = density_curve(df, keys, value, best).select(*keys, F.lit("density").alias("part"), "x", "y")
    placed = numbered(df.select(*keys, *order, F.col(value).cast("double").alias("x")), keys, [F.col(c) for c in order], "_i")
    out = rolling_z(placed, keys, order, "x", S.rolling, sample=True).select(*keys, F.lit("outlier").alias("part"), F.col("_i").cast("double").alias("_x"), F.col("x").alias("y")).withColumnRenamed("_x", "x")
    level = staged(smooth(df, keys, order, value), "levels")
    ahead = forecast_curve(level, keys, best, distribution_shift(level, keys)).select(*keys, F.lit("forecast").alias("part"), "x", "y")
    return hist.unionByName(curve).unionByName(out).unionByName(ahead)


def forecast(smoothed: DataFrame, keys: list[str], steps: int = 5) -> DataFrame:
    """(keys, step, value): the flat continuation of the last level."""
    return last_level(smoothed, keys).select(*keys, F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"), F.col("level").alias("value"))


def distribution_shift(smoothed: DataFrame, keys: list[str], rows: int = S.rolling, steps: int = 5) -> DataFrame:
    """(keys, mean, std_dev): the last level, and the root of sum (s - mean)^2 / (n - 1) over the last
    ``rows`` levels, the forecast's flat steps counted with them."""
    last = last_level(smoothed, keys)
    tail = smoothed.join(last.select(*keys, F.col("level").alias("_l"), "last"), keys).where(F.col("idx") > F.col("last") - (rows - steps))
    g = tail.groupBy(*keys).agg(F.first("_l").alias("mean"), F.sum((F.col("level") - F.col("_l")) ** 2).alias("_q"), (F.count(F.lit(1)) + steps).alias("_n"))
    return g.select(*keys, "mean", F.sqrt(F.col("_q") / (F.col("_n") - 1)).alias("std_dev"))


def linear_trend(df: DataFrame, keys: list[str], order: list[str], value: str, limit: float = C.min_correlation) -> DataFrame:
    """(keys, n, r, trend): correlation of the value with its place."""
    r = numbered(df, keys, [F.col(c) for c in order], "_i").withColumn("_i", (F.col("_i") + 1).cast("double"))
    return pearson(r, keys, "_i", value).withColumn("trend", F.when(F.col("r") > limit, "increasing").when(F.col("r") < -limit, "decreasing").otherwise("stable"))


def recurring_runs(df: DataFrame, keys: list[str], order: list[str], value: str, longest: int = 10, least: int = 2) -> DataFrame:
    """(keys, run, length, support, confidence): runs of 2 to min(longest, n/2) values that occur at least
    ``least`` times; confidence is their share of the places that a run of the length has."""
    w = Window.partitionBy(*keys).orderBy(*order)
    r = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    r = r.withColumn("_run", F.collect_list(F.col(value).cast("string")).over(w.rowsBetween(0, longest - 1)))
    r = r.select(*keys, "_n", "_run", F.explode(F.sequence(F.lit(2), F.greatest(F.lit(2), F.least(F.size("_run"), F.floor(F.col("_n") / 2).cast("int"), F.lit(longest))))).alias("length"))
    r = r.where((F.col("length") <= F.size("_run")) & (F.col("length") <= F.col("_n") / 2))
    g = r.groupBy(*keys, F.array_join(F.slice("_run", 1, F.col("length")), ",").alias("run"), "length").agg(F.count(F.lit(1)).alias("support"), F.first("_n").alias("_n"))
    return g.where(F.col("support") >= least).select(*keys, "run", "length", "support", (F.col("support") / (F.col("_n") - F.col("length") + 1)).alias("confidence"))


def indexed(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    return numbered(df, keys, [F.col(c) for c in order], "i").select(*keys, "i", F.col(value).cast("double").alias("x"))


def spectrum(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, frequency, magnitude): the discrete Fourier transform up to n / 2, by numpy's FFT over one
    key's series (an aggregated series: days, hours)."""
    base = df.select(*keys, *order, F.col(value).cast("double").alias("x"))
    schema = ", ".join([f"`{n}` {t}" for n, t in base.select(*keys).dtypes] + ["n int", "frequency int", "magnitude double"])

    def run(f: pd.DataFrame) -> pd.DataFrame:
        x = f.sort_values(order)["x"].to_numpy()
        m = np.abs(np.fft.rfft(x))[: -(-len(x) // 2)] / len(x)
        return pd.DataFrame({**{k: f[k].iloc[0] for k in keys}, "n": len(x), "frequency": np.arange(len(m)), "magnitude": m})

    return base.groupBy(*keys).applyInPandas(run, schema)


def dominant_cycle(spec: DataFrame, keys: list[str], compat: bool = False) -> DataFrame:
    """(keys, frequency, magnitude, period): the strongest frequency but the constant one, period n / f;
    ``compat`` lets the constant win and divides the number of frequencies instead."""
    s = spec if compat else spec.where("frequency > 0")
    g = s.groupBy(*keys).agg(F.max_by(F.struct("frequency", "magnitude"), F.struct("magnitude", -F.col("frequency"))).alias("b"), F.first("n").alias("n"), F.count(F.lit(1)).alias("bins"))
    return g.select(*keys, "b.*", half_up(F.try_divide(F.col("bins") if compat else F.col("n"), F.col("b.frequency"))).alias("period"))


def seasonality(cycle: DataFrame, keys: list[str], limit: float = 0.1) -> DataFrame:
    return cycle.select(*keys, (F.col("magnitude") > limit).alias("seasonal"), F.when(F.col("magnitude") > limit, F.col("period")).alias("period"))


def decompose(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    trend = linear_trend(df, keys, order, value).select(*keys, "trend")
    out = iqr_outliers(df, keys, value).groupBy(*keys).agg(F.count(F.lit(1)).alias("outliers"))
    season = seasonality(dominant_cycle(spectrum(df, keys, order, value), keys), keys)
    return trend.join(season, keys).join(out, keys, "left").withColumn("outliers", F.coalesce("outliers", F.lit(0)))


def find_patterns(df: DataFrame, keys: list[str], order: list[str], value: str, limit: float = C.min_correlation) -> DataFrame:
    """(keys, pattern, confidence, support) of the linear, cyclical, recurring and anomaly detectors."""
    line = linear_trend(df, keys, order, value, limit).where(F.abs("r") >= limit)
    line = line.select(*keys, F.when(F.col("r") > 0, "increasing_linear").otherwise("decreasing_linear").alias("pattern"), F.abs("r").alias("confidence"), F.col("n").cast("long").alias("support"))
    spec = spectrum(df, keys, order, value)
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("support"))
    cycle = dominant_cycle(spec, keys).join(n, keys).select(*keys, F.lit("cyclical").alias("pattern"), F.col("magnitude").alias("confidence"), "support")
    runs = recurring_runs(df, keys, order, value).select(*keys, F.concat(F.lit("recurring_"), "run").alias("pattern"), "confidence", "support")
    odd = sigma_anomalies(df, keys, value, order).select(*keys, F.lit("anomaly").alias("pattern"), "confidence", "support")
    return line.unionByName(cycle).unionByName(runs).unionByName(odd)


def lagged_pairs(a: DataFrame, b: DataFrame, low: int, high: int) -> DataFrame:
    """(lag, x, y): rows of two indexed series (i, x) with j = i + lag, for all lags of the range."""
    lags = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("lag")
    left = a.select(F.col("i").alias("_i"), F.col("x").alias("x"), lags)
    right = b.select(F.col("i").alias("_j"), F.col("x").alias("y"))
    return left.withColumn("_j", F.col("_i") + F.col("lag")).join(right, "_j").select("lag", "x", "y")


def cross_correlation(a: DataFrame, b: DataFrame, max_lag: int = C.max_lag) -> DataFrame:
    """(lag, value): the mean product over the overlap at each lag, 0 where there is none."""
    lags = a.sparkSession.range(-max_lag, max_lag + 1).select(F.col("id").cast("int").alias("lag"))
    got = lagged_pairs(a, b, -max_lag, max_lag).groupBy("lag").agg(F.avg(F.col("x") * F.col("y")).alias("value"))
    return lags.join(got, "lag", "left").select("lag", F.coalesce("value", F.lit(0.0)).alias("value"))


def optimal_lag(a: DataFrame, b: DataFrame, max_lag: int = C.max_lag) -> DataFrame:
    """(lag, r): the lag from 0 with the greatest |r| between a shifted forward and b; the first wins."""
    pairs = lagged_pairs(b, a, 0, max_lag)
    r = pearson(pairs, ["lag"], "x", "y").withColumn("_r", F.abs("r"))
    best = r.agg(F.max_by(F.struct("lag", "r"), F.struct("_r", -F.col("lag"))).alias("b"))
    return best.select(F.col("b.lag").alias("lag"), F.col("b.r").alias("r"))


