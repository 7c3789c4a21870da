"""Descriptive and inferential statistics of a numeric column, by group.

Every operator takes ``keys`` (columns of groups; none: the whole table) and the value column; nulls
are left out. Sums are partial before the shuffle; exact order statistics sort within a group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import erf_inv, normal_cdf, normal_pdf, safe_div
from ..functions.scores import direction_label, strength_label
from ..params import Correlation, Statistics
from .ordering import exact_quantiles, most_rows, numbered

S, C = Statistics(), Correlation()


def _values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("x"))


def _joined(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, keys) if keys else out.join(p, F.lit(True))
    return out


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, median, variance and std_dev (sample), skewness = m3 / s^3 and kurtosis = m4 / s^4 - 3 with
    the sample deviation s, min and max."""
    x, n, v = F.col("x"), F.count("x"), _values(df, keys, value)
    middle = exact_quantiles(v, keys, "x", [0.5]).withColumnRenamed("q0", "median")
    rest = v.groupBy(*keys).agg(
        n.alias("n"),
        F.avg(x).alias("mean"),
        F.var_samp(x).alias("variance"),
        F.stddev_samp(x).alias("std_dev"),
        (F.skewness(x) * F.pow(safe_div(n - 1, n), F.lit(1.5))).alias("skewness"),
        ((F.kurtosis(x) + 3) * F.pow(safe_div(n - 1, n), F.lit(2.0)) - 3).alias("kurtosis"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )
    return _joined([rest, middle], keys).select(*keys, "n", "mean", "median", *rest.columns[len(keys) + 2 :])


def modes(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """All values of the greatest count: (keys, mode, n)."""
    counted = _values(df, keys, value).groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("n"))
    top = counted.groupBy(*keys).agg(F.max("n").alias("n"))
    return counted.join(top, [*keys, "n"]).select(*keys, F.col("x").alias("mode"), "n")


def half_quartiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """q1, q2, q3: medians of the halves, the middle row left out of both for odd counts."""
    v = _values(df, keys, value)
    r = numbered(v, keys, [F.col("x")], "_i", total="_n")
    half, i = F.floor(F.col("_n") / 2), F.col("_i")
    # the median of h values from place a on: the mean of the places a + (h - 1) / 2, rounded down and up
    middle = lambda a, h: F.avg(F.when((i == a + F.floor((h - 1) / 2)) | (i == a + F.ceil((h - 1) / 2)), F.col("x")))
    return r.groupBy(*keys).agg(middle(F.lit(0), half).alias("q1"), middle(F.lit(0), F.col("_n")).alias("q2"), middle(F.col("_n") - half, half).alias("q3"))


def quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float], exact: bool = True) -> DataFrame:
    """Linear-interpolated quantiles (exact), or approximate ones that keep a bounded sketch each."""
    v, names = _values(df, keys, value), [f"q{round(q * 100)}" for q in qs]
    if not exact:
        return v.groupBy(*keys).agg(*[F.percentile_approx("x", q, 10_000).alias(n) for q, n in zip(qs, names, strict=True)])
    return exact_quantiles(v, keys, "x", qs).select(*keys, *[F.col(f"q{k}").alias(n) for k, n in enumerate(names)])


def iqr_outliers(df: DataFrame, keys: list[str], value: str, k: float = 1.5) -> DataFrame:
    """Rows outside [q1 - k iqr, q3 + k iqr]: (keys, x, lower, upper)."""
    q = quantiles(df, keys, value, [0.25, 0.75])
    iqr = F.col("q75") - F.col("q25")
    bounds = q.select(*keys, (F.col("q25") - k * iqr).alias("lower"), (F.col("q75") + k * iqr).alias("upper"))
    return _joined([_values(df, keys, value), bounds], keys).where("x < lower or x > upper")


def sigma_anomalies(df: DataFrame, keys: list[str], value: str, order: list[str], k: float = 2.0, examples: int = 5) -> DataFrame:
    """Rows further than k population deviations from the mean, as one row: their number, their share of
    all (confidence) and the first examples by ``order``."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("x"), F.struct(*order).alias("_o"))
    stats = rows.groupBy(*keys).agg(F.avg("x").alias("_m"), F.stddev_pop("x").alias("_s"), F.count(F.lit(1)).alias("_n"))
    far = _joined([rows, stats], keys).where(F.abs(F.col("x") - F.col("_m")) > k * F.col("_s"))
    # the first examples by a window that takes its limit before the exchange, the share by an aggregate
    rank = F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_o"))
    first = far.select(*keys, "_o", "x").withColumn("_r", rank).where(F.col("_r") <= examples)
    first = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "x"))), lambda e: e["x"]).alias("examples"))
    share = far.groupBy(*keys).agg(F.count(F.lit(1)).alias("support"), F.max(F.lit(1.0) / F.col("_n")).alias("_w"))
    return _joined([share, first], keys).select(*keys, "support", (F.col("support") * F.col("_w")).alias("confidence"), "examples")


def pearson(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, n, r): 0 where either side has no variance; rows with a null on either side left out."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), safe_div(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("r"))


def correlation_p_value(r: Column, n: Column, compat: bool = False) -> Column:
    """Two-sided, by the normal tail of t; ``compat`` takes the tail for the distribution function, as some
    implementations do (values from 1 to 2)."""
    t = F.abs(r) * F.sqrt(F.coalesce(F.try_divide(n - 2, 1 - r * r), F.lit(1e300)))
    tail = 1 - normal_cdf(F.least(t, F.lit(1e6)))
    return 2 * (1 - tail) if compat else 2 * tail


def correlation_report(df: DataFrame, keys: list[str], x: str, y: str, significance: float = S.significance, limit: float = C.min_correlation) -> DataFrame:
    r = pearson(df, keys, x, y).withColumn("p_value", correlation_p_value(F.col("r"), F.col("n")))
    return r.select(*keys, "n", "r", "p_value", strength_label(F.col("r")).alias("strength"), direction_label(F.col("r"), limit).alias("direction"), (F.col("p_value") < significance).alias("significant"))


def t_test(df: DataFrame, value: str, first: Column, second: Column, significance: float = S.significance) -> DataFrame:
    """Pooled two-sample test of the rows of two predicates: one row."""
    x = F.col(value).cast("double")
    a = df.agg(*[f(F.when(side, x)).alias(n + str(i)) for i, side in enumerate((first, second)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    n0, n1, m0, m1, v0, v1 = (F.col(c) for c in ("n0", "n1", "m0", "m1", "v0", "v1"))
    pooled = safe_div(v0 * (n0 - 1) + v1 * (n1 - 1), n0 + n1 - 2)
    t = safe_div(m0 - m1, F.sqrt(pooled * (safe_div(F.lit(1.0), n0) + safe_div(F.lit(1.0), n1))))
    p = lambda s: 2 * (1 - normal_cdf(F.abs(s)))
    effect = safe_div(F.abs(m0 - m1), F.sqrt((v0 + v1) / 2))
    shift = effect * F.sqrt(safe_div(n0 * n1, n0 + n1))
    return a.select(t.alias("statistic"), p(t).alias("p_value"), (p(t) < significance).alias("significant"), (1 - p(t - shift)).alias("power"))


def confidence_interval(df: DataFrame, keys: list[str], value: str, confidence: float = S.confidence, two_sided: bool = False) -> DataFrame:
    """mean +- z * standard error; z is the one-sided quantile unless ``two_sided``."""
    level = confidence if two_sided else 2 * confidence - 1
    z = math.sqrt(2) * erf_inv(F.lit(level))
    g = _values(df, keys, value).groupBy(*keys).agg(F.avg("x").alias("m"), F.sqrt(safe_div(F.var_samp("x"), F.count("x"), None)).alias("se"))
    return g.select(*keys, (F.col("m") - z * F.col("se")).alias("lower"), (F.col("m") + z * F.col("se")).alias("upper"))


def bayes_update(df: DataFrame, keys: list[str], value: str, prior_mean: float = 0.0, prior_variance: float = 1.0, likelihood_variance: float = 1.0) -> DataFrame:
    g = _values(df, keys, value).groupBy(*keys).agg(F.count("x").alias("n"), F.avg("x").alias("m"))
    var = 1 / (F.lit(1 / prior_variance) + F.col("n") / likelihood_variance)
    return g.select(*keys, (var * (prior_mean / prior_variance + F.col("n") * F.col("m") / likelihood_variance)).alias("mean"), var.alias("variance"))


def histogram(df: DataFrame, keys: list[str], value: str, bins: int = 20) -> DataFrame:
    """(keys, bin, n): floor(x / width) * width with width = range / bins, bins anchored at zero."""
    v = _values(df, keys, value)
    width = v.groupBy(*keys).agg(((F.max("x") - F.min("x")) / bins).alias("_w"))
    cell = F.coalesce(F.floor(F.try_divide(F.col("x"), F.col("_w"))) * F.col("_w"), F.col("x"))
    return _joined([v, width], keys).groupBy(*keys, cell.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def distribution_fits(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, kind, p1, p2, fit) for normal, lognormal and exponential: fit = 1 - max |i/n - F(x_i)| over
    the sorted values of the kind's domain (0 for an empty one)."""
    v = _values(df, keys, value)
    g = v.groupBy(*keys).agg(
        F.avg("x").alias("nm"), F.stddev_samp("x").alias("ns"), F.avg(F.when(F.col("x") > 0, F.log("x"))).alias("lm"), F.stddev_samp(F.when(F.col("x") > 0, F.log("x"))).alias("ls"), F.avg(F.when(F.col("x") >= 0, F.col("x"))).alias("em")
    )
    g = g.withColumn("lam", safe_div(F.lit(1.0), F.col("em")))
    j = _joined([v, g], keys)
    domain = {"normal": F.lit(True), "lognormal": F.col("x") > 0, "exponential": F.col("x") >= 0}
    cdf = {"normal": normal_cdf("x", F.col("nm"), F.col("ns")), "lognormal": normal_cdf(F.log("x"), F.col("lm"), F.col("ls")), "exponential": 1 - F.exp(-F.col("lam") * F.col("x"))}
    params = {"normal": ("nm", "ns"), "lognormal": ("lm", "ls"), "exponential": ("lam", None)}
    out, most = None, most_rows(v, keys)
    for k, inside in domain.items():
        r = numbered(j.where(inside), keys, [F.col("x")], "_i", total="_n", most=most).withColumn("_i", F.col("_i") + 1)
        far = r.groupBy(*keys).agg((1 - F.max(F.abs(F.col("_i") / F.col("_n") - cdf[k]))).alias("fit"))
        a, b = params[k]
        rows = g.select(*keys, F.lit(k).alias("kind"), F.col(a).alias("p1"), (F.col(b) if b else F.lit(None).cast("double")).alias("p2"))
        rows = rows.join(far, keys, "left") if keys else rows.join(far, F.lit(True), "left")
        rows = rows.withColumn("fit", F.coalesce("fit", F.lit(0.0)))
        out = rows if out is None else out.unionByName(rows)
    return out


def best_fit(fits: DataFrame, keys: list[str]) -> DataFrame:
    """The kind of the greatest fit; of equal ones normal, then lognormal."""
    rank = F.when(F.col("kind") == "normal", 2).when(F.col("kind") == "lognormal", 1).otherwise(0)
    return fits.groupBy(*keys).agg(F.max_by(F.struct("kind", "p1", "p2", "fit"), F.struct("fit", rank)).alias("b")).select(*keys, "b.*")


def density_curve(df: DataFrame, keys: list[str], value: str, best: DataFrame, steps: int = 100) -> DataFrame:
    """(keys, step, x, y): the density of the best fit at steps + 1 places from min to max."""
    span = _values(df, keys, value).groupBy(*keys).agg(F.min("x").alias("_a"), F.max("x").alias("_b"))
    j = _joined([span, best], keys).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    j = j.withColumn("x", F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("step") / steps)
    x, a, b = F.col("x"), F.col("p1"), F.col("p2")
    y = F.when(F.col("kind") == "normal", normal_pdf(x, a, b)).when((F.col("kind") == "lognormal") & (x > 0), safe_div(normal_pdf(F.log(F.greatest(x, F.lit(1e-300))), a, b), x)).when((F.col("kind") == "exponential") & (x >= 0), a * F.exp(-a * x))
    return j.select(*keys, "step", "x", F.coalesce(y, F.lit(0.0)).alias("y"))


def entropy(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Shannon entropy (bits) of a label column by group."""
    counted = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    total = counted.groupBy(*keys).agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    return _joined([counted, total], keys).groupBy(*keys).agg((-F.sum(p * F.log2(p))).alias("entropy"))


def label_histogram(df: DataFrame, keys: list[str], labels: str) -> DataFrame:
    """(keys, label, n) of an array column."""
    return df.select(*keys, F.explode(labels).alias("label")).groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))


def weighted_pick(df: DataFrame, keys: list[str], weight: str, order: list[str], point: float) -> DataFrame:
    """The first row of each group, by ``order``, whose running weight reaches ``point`` of the total."""
    w = Window.partitionBy(*keys)
    r = df.withColumn("_run", F.sum(weight).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum(weight).over(w))
    ok = r.where(F.col("_run") >= F.col("_all") * point)
    return ok.withColumn("_k", F.row_number().over(w.orderBy(*order))).where("_k = 1").drop("_run", "_all", "_k")
