"""Queries over numeric columns and series."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import series, statistics
from .common import ERFC_HIGH_TO_LOW, LOG, cdf_sql, erf_sql, log, r6, rounded, table

EV = ["event_type"]
ORD = ["ts", "event_id"]
_ev = lambda s, d: table(s, d, "events")
_li = lambda s, d: table(s, d, "lineitem")
_fits = lambda s, d: statistics.distribution_fits(_ev(s, d), EV, "value")


def _daily(s, d):
    return log(s, d).withColumnRenamed("metric", "event_type")


def _two(s, d):
    day = _daily(s, d)
    side = lambda k: series.indexed(day.where(F.col("event_type") == k), [], ["ts"], "value")
    return side("click"), side("view")


def _curve(s, d):
    e = _ev(s, d)
    fits = statistics.distribution_fits(e, EV, "value")
    return rounded(statistics.density_curve(e, EV, "value", statistics.best_fit(fits, EV)), "x", "y")


def _erf(s, d):
    q = _li(s, d).groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n"))
    x = (F.col("l_quantity") - 25) / 20
    return q.select("l_quantity", "n", r6(N.erf(x)).alias("erf"), r6(N.erf_compat(x)).alias("erf_coarse"), r6(N.erf_inv(F.col("l_quantity") / 51)).alias("erf_inv"))


QUERIES = {
    "descriptive_stats": lambda s, d: rounded(statistics.moments(_ev(s, d), EV, "value"), "mean", "median", "variance", "std_dev", "skewness", "kurtosis", "min", "max"),
    "mode_all": lambda s, d: statistics.modes(_li(s, d), ["l_returnflag"], "l_quantity"),
    "tukey_quartiles": lambda s, d: rounded(statistics.half_quartiles(_ev(s, d), EV, "value"), "q1", "q2", "q3"),
    "linear_quantiles": lambda s, d: rounded(statistics.quantiles(_li(s, d), ["l_returnflag"], "l_extendedprice", [0.05, 0.25, 0.5, 0.75, 0.95]), "q5", "q25", "q50", "q75", "q95"),
    "iqr_outliers": lambda s, d: rounded(statistics.iqr_outliers(_ev(s, d), EV, "value"), "x", "lower", "upper"),
    "sigma_anomalies": lambda s, d: rounded(statistics.sigma_anomalies(_ev(s, d), EV, "value", ORD).withColumn("examples", F.array_join(F.transform("examples", lambda x: F.format_string("%.2f", x)), ",")), "confidence"),
    "pearson": lambda s, d: rounded(statistics.pearson(_li(s, d), ["l_returnflag", "l_linestatus"], "l_quantity", "l_extendedprice"), "r"),
    "correlation_report": lambda s, d: rounded(statistics.correlation_report(_li(s, d), ["l_returnflag"], "l_quantity", "l_discount"), "r", "p_value"),
    "t_test": lambda s, d: rounded(statistics.t_test(_ev(s, d), "value", F.col("event_type") == "click", F.col("event_type") == "view"), "statistic", "p_value", "power"),
    "confidence_interval": lambda s, d: rounded(statistics.confidence_interval(_ev(s, d), EV, "value"), "lower", "upper"),
    "bayes_update": lambda s, d: rounded(statistics.bayes_update(_ev(s, d), EV, "value", 10.0, 4.0, 25.0), "mean", "variance"),
    "histogram20": lambda s, d: rounded(statistics.histogram(_ev(s, d), EV, "value"), "bin"),
    "distribution_fits": lambda s, d: rounded(_fits(s, d), "p1", "p2", "fit"),
    "best_fit": lambda s, d: rounded(statistics.best_fit(_fits(s, d), EV), "p1", "p2", "fit"),
    "density_curve": _curve,
    "entropy": lambda s, d: rounded(statistics.entropy(_li(s, d), ["l_returnflag"], "l_linestatus"), "entropy"),
    "error_functions": _erf,
    "weighted_pick": lambda s, d: statistics.weighted_pick(table(s, d, "customer").where("c_acctbal > 0"), ["c_nationkey"], "c_acctbal", ["c_custkey"], 0.5).select("c_nationkey", "c_custkey"),
    "rolling_z30": lambda s, d: rounded(series.rolling_z(_ev(s, d), EV, ORD, "value"), "z").select("event_id", "z"),
    "rolling_z50": lambda s, d: rounded(series.rolling_z(_ev(s, d), EV, ORD, "value", 50, True), "z").select("event_id", "z"),
    "context_anomalies": lambda s, d: series.context_anomalies(_ev(s, d), EV, ORD, "value").select("event_id", "value"),
    "latest_rows": lambda s, d: series.latest(_ev(s, d), ["user_id"], ORD, 20).select("user_id", "event_id"),
    "trend_change": lambda s, d: series.trend_change(_ev(s, d), ["user_id"], ORD, "value"),
    "mean_change": lambda s, d: rounded(series.mean_change(_ev(s, d), EV, ORD, "value"), "mean_change"),
    "ema": lambda s, d: rounded(series.smooth(_daily(s, d), EV, ["ts"], "value"), "x", "level"),
    "flat_forecast": lambda s, d: rounded(series.forecast(series.smooth(_daily(s, d), EV, ["ts"], "value", 0.1), EV), "value"),
    "distribution_shift": lambda s, d: rounded(series.distribution_shift(series.smooth(_daily(s, d), EV, ["ts"], "value"), EV), "mean", "std_dev"),
    "linear_trend": lambda s, d: rounded(series.linear_trend(_ev(s, d), EV, ORD, "value"), "r"),
    "recurring_runs": lambda s, d: rounded(series.recurring_runs(_daily(s, d).withColumn("level", F.floor("value").cast("int")), EV, ["ts"], "level"), "confidence"),
    "dft_spectrum": lambda s, d: rounded(series.spectrum(_daily(s, d), EV, ["ts"], "value"), "magnitude"),
    "dft_dominant": lambda s, d: rounded(series.dominant_cycle(series.spectrum(_daily(s, d), EV, ["ts"], "value"), EV), "magnitude"),
    "decompose": lambda s, d: series.decompose(_daily(s, d), EV, ["ts"], "value"),
    "find_patterns": lambda s, d: rounded(series.find_patterns(_daily(s, d), EV, ["ts"], "value"), "confidence"),
    "cross_corr": lambda s, d: rounded(series.cross_correlation(*_two(s, d)), "value"),
    "optimal_lag": lambda s, d: rounded(series.optimal_lag(*_two(s, d), max_lag=10), "r"),
}

_DAY = LOG.replace("metric", "event_type")
_Z = "SELECT event_id, round(z, 6) + 0.0 AS z FROM (SELECT *, {z} AS z FROM (SELECT event_id, value, avg(value) OVER w AS m, {sd}(value) OVER w AS s, count(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)) WHERE n = {k}) WHERE z > 2"
_FITS = f"""g AS (SELECT event_type, avg(value) AS nm, stddev_samp(value) AS ns, avg(CASE WHEN value > 0 THEN ln(value) END) AS lm, stddev_samp(CASE WHEN value > 0 THEN ln(value) END) AS ls, 1 / avg(CASE WHEN value >= 0 THEN value END) AS lam FROM events GROUP BY 1),
a AS (SELECT event_type, value AS x, row_number() OVER w / count(*) OVER v AS e FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value), v AS (PARTITION BY event_type)),
l AS (SELECT event_type, value AS x, row_number() OVER w / count(*) OVER v AS e FROM events WHERE value > 0 WINDOW w AS (PARTITION BY event_type ORDER BY value), v AS (PARTITION BY event_type)),
p AS (SELECT event_type, value AS x, row_number() OVER w / count(*) OVER v AS e FROM events WHERE value >= 0 WINDOW w AS (PARTITION BY event_type ORDER BY value), v AS (PARTITION BY event_type)),
fits AS (SELECT event_type, 'normal' AS kind, any_value(nm) AS p1, any_value(ns) AS p2, 1 - max(abs(e - {cdf_sql('x', 'nm', 'ns')})) AS fit, 2 AS o FROM a JOIN g USING (event_type) GROUP BY 1
 UNION ALL SELECT event_type, 'lognormal', any_value(lm), any_value(ls), 1 - max(abs(e - {cdf_sql('ln(x)', 'lm', 'ls')})), 1 FROM l JOIN g USING (event_type) GROUP BY 1
 UNION ALL SELECT event_type, 'exponential', any_value(lam), NULL, 1 - max(abs(e - (1 - exp(-lam * x)))), 0 FROM p JOIN g USING (event_type) GROUP BY 1),
best AS (SELECT * FROM fits QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY fit DESC, o DESC) = 1)"""
_EMA = f"WITH RECURSIVE {_DAY}, s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS idx FROM log), e AS (SELECT event_type, idx, value AS x, value AS level FROM s WHERE idx = 0 UNION ALL SELECT s.event_type, s.idx, s.value, {{a}} * s.value + (1 - {{a}}) * e.level FROM e JOIN s ON s.event_type = e.event_type AND s.idx = e.idx + 1)"
_IDX = f"WITH {_DAY}, a AS (SELECT row_number() OVER (ORDER BY ts) - 1 AS i, value AS x FROM log WHERE event_type = 'click'), b AS (SELECT row_number() OVER (ORDER BY ts) - 1 AS i, value AS x FROM log WHERE event_type = 'view')"
_SPEC = f"""{_DAY}, s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS t, count(*) OVER (PARTITION BY event_type) AS n FROM log),
spec AS (SELECT event_type, any_value(n) AS n, f AS frequency, sqrt(pow(sum(value * cos(2 * pi() * f * t / n)), 2) + pow(sum(value * sin(2 * pi() * f * t / n)), 2)) / any_value(n) AS magnitude FROM s, range(0, 400) r(f) WHERE f < n / 2.0 GROUP BY event_type, f)"""
_DOM = "dom AS (SELECT event_type, frequency, magnitude, floor(n / frequency + 0.5) AS period, n FROM spec WHERE frequency > 0 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY magnitude DESC, frequency) = 1)"
_RUNS = """r AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS i, count(*) OVER (PARTITION BY event_type) AS n, {v} AS v FROM log),
w AS (SELECT event_type, n, len, list(v::VARCHAR) OVER (PARTITION BY event_type, len ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS vs FROM r, range(2, 11) l(len) WHERE len <= n / 2.0),
runs AS (SELECT event_type, array_to_string(vs[1:len], ',') AS run, len AS length, count(*) AS support, count(*) / (any_value(n) - len + 1) AS confidence FROM w WHERE length(vs) >= len GROUP BY event_type, len, array_to_string(vs[1:len], ',') HAVING count(*) >= 2)"""
_R = "CASE WHEN stddev_pop({x}) * stddev_pop({y}) = 0 THEN 0 ELSE coalesce(covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})), 0) END"
_IQR = "q AS (SELECT event_type, quantile_cont({v}, 0.25) AS a, quantile_cont({v}, 0.75) AS b FROM {t} GROUP BY 1)"
_SIG = "st AS (SELECT event_type, avg({v}) AS m, stddev_pop({v}) AS s, count(*) AS n FROM {t} GROUP BY 1), far AS (SELECT event_type, {v} AS x, n, row_number() OVER (PARTITION BY event_type ORDER BY {o}) AS r FROM {t} JOIN st USING (event_type) WHERE abs({v} - m) > 2 * s)"
_TREND = "CASE WHEN r > 0.3 THEN 'increasing' WHEN r < -0.3 THEN 'decreasing' ELSE 'stable' END"
_Z95 = "(sqrt(2.0::DOUBLE) * sqrt(sqrt(pow(2 / (pi() * 0.147) + ln(1 - 0.81) / 2, 2) - ln(1 - 0.81) / 0.147) - (2 / (pi() * 0.147) + ln(1 - 0.81) / 2)))"
_TT = "m AS (SELECT avg(value) FILTER (event_type = 'click') AS m0, avg(value) FILTER (event_type = 'view') AS m1, var_samp(value) FILTER (event_type = 'click') AS v0, var_samp(value) FILTER (event_type = 'view') AS v1, count(value) FILTER (event_type = 'click') AS n0, count(value) FILTER (event_type = 'view') AS n1 FROM events), t AS (SELECT *, (m0 - m1) / sqrt((v0 * (n0 - 1) + v1 * (n1 - 1)) / (n0 + n1 - 2) * (1.0::DOUBLE / n0 + 1.0::DOUBLE / n1)) AS t, abs(m0 - m1) / sqrt((v0 + v1) / 2) * sqrt(n0::DOUBLE * n1 / (n0 + n1)) AS shift FROM m)"
_erf_inv = "(sign(z) * sqrt(sqrt(pow(2 / (pi() * 0.147) + ln(1 - z * z) / 2, 2) - ln(1 - z * z) / 0.147) - (2 / (pi() * 0.147) + ln(1 - z * z) / 2)))"


def _coarse(x: str) -> str:
    """The coarser variant: the same coefficients at a point of another formula, odd in x."""
    t = f"(1 / (1 + 0.47047 * abs({x})))"
    poly = "0.17087277"
    for c in ERFC_HIGH_TO_LOW:
        poly = f"({poly} * {t} + ({c}))"
    return f"(sign({x}) * (1 - {t} * exp({poly} - {x} * {x})) + CASE WHEN {x} = 0 THEN 1 - exp({poly.replace(t, '1')}) ELSE 0 END)"


ORACLE_SQL = {
    "descriptive_stats": "WITH c AS (SELECT event_type, count(value) AS n, avg(value) AS mean, median(value) AS median, var_samp(value) AS variance, stddev_samp(value) AS std_dev, min(value) AS mn, max(value) AS mx FROM events GROUP BY 1), d AS (SELECT event_type, avg(pow(value - mean, 3)) AS m3, avg(pow(value - mean, 4)) AS m4 FROM events JOIN c USING (event_type) GROUP BY 1) SELECT event_type, n, round(mean, 6) + 0.0 AS mean, round(median, 6) + 0.0 AS median, round(variance, 6) + 0.0 AS variance, round(std_dev, 6) + 0.0 AS std_dev, round(m3 / pow(std_dev, 3), 6) + 0.0 AS skewness, round(m4 / pow(std_dev, 4) - 3, 6) + 0.0 AS kurtosis, round(mn, 6) + 0.0 AS min, round(mx, 6) + 0.0 AS max FROM c JOIN d USING (event_type)",
    "mode_all": "SELECT l_returnflag, l_quantity AS mode, count(*) AS n FROM lineitem GROUP BY 1, 2 QUALIFY rank() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC) = 1",
    "tukey_quartiles": "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, round(median(value) FILTER (i <= n // 2), 6) + 0.0 AS q1, round(median(value), 6) + 0.0 AS q2, round(median(value) FILTER (i > n - n // 2), 6) + 0.0 AS q3 FROM r GROUP BY 1",
    "linear_quantiles": "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q / 100}), 6) + 0.0 AS q{q}" for q in (5, 25, 50, 75, 95)) + " FROM lineitem GROUP BY 1",
    "iqr_outliers": f"WITH {_IQR.format(v='value', t='events')} SELECT event_type, round(value, 6) + 0.0 AS x, round(a - 1.5 * (b - a), 6) + 0.0 AS lower, round(b + 1.5 * (b - a), 6) + 0.0 AS upper FROM events JOIN q USING (event_type) WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)",
    "sigma_anomalies": f"WITH {_SIG.format(v='value', t='events', o='ts, event_id')} SELECT event_type, count(*) AS support, round(count(*) / any_value(n), 6) + 0.0 AS confidence, array_to_string(list(printf('%.2f', x) ORDER BY r) FILTER (r <= 5), ',') AS examples FROM far GROUP BY 1",
    "pearson": f"SELECT l_returnflag, l_linestatus, count(*) AS n, round({_R.format(x='l_quantity', y='l_extendedprice')}, 6) + 0.0 AS r FROM lineitem GROUP BY 1, 2",
    "correlation_report": f"WITH c AS (SELECT l_returnflag, count(*) AS n, {_R.format(x='l_quantity', y='l_discount')} AS r FROM lineitem GROUP BY 1), t AS (SELECT *, abs(r) * sqrt((n - 2) / (1 - r * r)) AS t FROM c), p AS (SELECT *, 2 * (1 - {cdf_sql('t')}) AS p FROM t) SELECT l_returnflag, n, round(r, 6) + 0.0 AS r, round(p, 6) + 0.0 AS p_value, CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.3 THEN 'moderate' WHEN abs(r) >= 0.1 THEN 'weak' ELSE 'none' END AS strength, CASE WHEN r > 0.3 THEN 'positive' WHEN r < -0.3 THEN 'negative' ELSE 'none' END AS direction, p < 0.05 AS significant FROM p",
    "t_test": f"WITH {_TT} SELECT round(t, 6) + 0.0 AS statistic, round(2 * (1 - {cdf_sql('abs(t)')}), 6) + 0.0 AS p_value, 2 * (1 - {cdf_sql('abs(t)')}) < 0.05 AS significant, round(1 - 2 * (1 - {cdf_sql('abs(t - shift)')}), 6) + 0.0 AS power FROM t",
    "confidence_interval": f"SELECT event_type, round(avg(value) - {_Z95} * sqrt(var_samp(value) / count(*)), 6) + 0.0 AS lower, round(avg(value) + {_Z95} * sqrt(var_samp(value) / count(*)), 6) + 0.0 AS upper FROM events GROUP BY 1",
    "bayes_update": "SELECT event_type, round((10.0 / 4 + count(*) * avg(value) / 25) / (0.25 + count(*) / 25.0::DOUBLE), 6) + 0.0 AS mean, round(1 / (0.25 + count(*) / 25.0::DOUBLE), 6) + 0.0 AS variance FROM events GROUP BY 1",
    "histogram20": "WITH w AS (SELECT event_type, (max(value) - min(value)) / 20 AS w FROM events GROUP BY 1) SELECT event_type, round(floor(value / w) * w, 6) + 0.0 AS bin, count(*) AS n FROM events JOIN w USING (event_type) GROUP BY 1, 2",
    "distribution_fits": f"WITH {_FITS} SELECT event_type, kind, round(p1, 6) + 0.0 AS p1, round(p2, 6) + 0.0 AS p2, round(fit, 6) + 0.0 AS fit FROM fits",
    "best_fit": f"WITH {_FITS} SELECT event_type, kind, round(p1, 6) + 0.0 AS p1, round(p2, 6) + 0.0 AS p2, round(fit, 6) + 0.0 AS fit FROM best",
    "density_curve": f"WITH {_FITS}, b AS (SELECT event_type, min(value) AS a, max(value) AS b FROM events GROUP BY 1), c AS (SELECT event_type, s AS step, a + (b - a) * s / 100 AS x, kind, p1, p2 FROM b JOIN best USING (event_type), range(0, 101) t(s)) SELECT event_type, step::INT AS step, round(x, 6) + 0.0 AS x, round(coalesce(CASE WHEN kind = 'normal' THEN exp(-0.5 * pow((x - p1) / p2, 2)) / (p2 * sqrt(2 * pi())) WHEN kind = 'lognormal' AND x > 0 THEN exp(-0.5 * pow((ln(greatest(x, 1e-300)) - p1) / p2, 2)) / (p2 * sqrt(2 * pi()) * x) WHEN kind = 'exponential' AND x >= 0 THEN p1 * exp(-p1 * x) END, 0), 6) + 0.0 AS y FROM c",
    "entropy": "WITH c AS (SELECT l_returnflag, count(*) AS n, sum(count(*)) OVER (PARTITION BY l_returnflag) AS t FROM lineitem GROUP BY l_returnflag, l_linestatus) SELECT l_returnflag, round(-sum(n / t * log2(n / t)), 6) + 0.0 AS entropy FROM c GROUP BY 1",
    "error_functions": f"WITH q AS (SELECT l_quantity, count(*) AS n, (l_quantity - 25) / 20 AS x, l_quantity / 51 AS z FROM lineitem GROUP BY 1) SELECT l_quantity, n, round({erf_sql('x')}, 6) + 0.0 AS erf, round({_coarse('x')}, 6) + 0.0 AS erf_coarse, round({_erf_inv}, 6) + 0.0 AS erf_inv FROM q",
    "weighted_pick": "WITH r AS (SELECT c_nationkey, c_custkey, sum(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS UNBOUNDED PRECEDING) AS run, sum(c_acctbal) OVER (PARTITION BY c_nationkey) AS t FROM customer WHERE c_acctbal > 0) SELECT c_nationkey, min(c_custkey) AS c_custkey FROM r WHERE run >= t * 0.5 GROUP BY 1",
    "rolling_z30": _Z.format(k=30, sd="stddev_pop", z="CASE WHEN s = 0 THEN 0 ELSE abs(value - m) / s END"),
    "rolling_z50": _Z.format(k=50, sd="stddev_samp", z="CASE WHEN s = 0 THEN CASE WHEN abs(value - m) > 0 THEN 'inf'::DOUBLE ELSE 0 END ELSE abs(value - m) / s END"),
    "context_anomalies": "WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 10), s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM l GROUP BY 1 HAVING count(*) >= 10) SELECT event_id, value FROM events JOIN s USING (event_type) WHERE abs(value - m) > 2 * s",
    "latest_rows": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20",
    "trend_change": "WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3) SELECT user_id, var_pop(value) > 0.1 AS changed FROM l GROUP BY 1",
    "mean_change": "WITH l AS (SELECT event_type, value - lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS c FROM events) SELECT event_type, round(avg(c), 6) + 0.0 AS mean_change FROM l GROUP BY 1",
    "ema": _EMA.format(a="0.3") + " SELECT event_type, idx::INT AS idx, round(x, 6) + 0.0 AS x, round(level, 6) + 0.0 AS level FROM e",
    "flat_forecast": _EMA.format(a="0.1") + " SELECT event_type, s::INT AS step, round(arg_max(level, idx), 6) + 0.0 AS value FROM e, range(1, 6) t(s) GROUP BY event_type, s",
    "distribution_shift": _EMA.format(a="0.3") + ", z AS (SELECT event_type, arg_max(level, idx) AS m, max(idx) AS k FROM e GROUP BY 1), t AS (SELECT event_type, any_value(m) AS m, sum(pow(level - m, 2)) AS q, count(*) + 5 AS n FROM e JOIN z USING (event_type) WHERE idx > k - 45 GROUP BY 1) SELECT event_type, round(m, 6) + 0.0 AS mean, round(sqrt(q / (n - 1)), 6) + 0.0 AS std_dev FROM t",
    "linear_trend": f"WITH i AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)::DOUBLE AS i FROM events), c AS (SELECT event_type, count(*) AS n, {_R.format(x='i', y='value')} AS r FROM i GROUP BY 1) SELECT event_type, n, round(r, 6) + 0.0 AS r, {_TREND} AS trend FROM c",
    "recurring_runs": f"WITH {_DAY}, {_RUNS.format(v='floor(value)::INT')} SELECT event_type, run, length::INT AS length, support, round(confidence, 6) + 0.0 AS confidence FROM runs",
    "dft_spectrum": f"WITH {_SPEC} SELECT event_type, n::INT AS n, frequency::INT AS frequency, round(magnitude, 6) + 0.0 AS magnitude FROM spec",
    "dft_dominant": f"WITH {_SPEC}, {_DOM} SELECT event_type, frequency::INT AS frequency, round(magnitude, 6) + 0.0 AS magnitude, period::BIGINT AS period FROM dom",
    "decompose": f"WITH {_SPEC}, {_DOM}, {_IQR.format(v='value', t='log')}, o AS (SELECT event_type, count(*) AS outliers FROM log JOIN q USING (event_type) WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) GROUP BY 1), c AS (SELECT event_type, {_R.format(x='t', y='value')} AS r FROM s GROUP BY 1) SELECT event_type, {_TREND} AS trend, magnitude > 0.1 AS seasonal, CASE WHEN magnitude > 0.1 THEN period::BIGINT END AS period, coalesce(outliers, 0) AS outliers FROM c JOIN dom USING (event_type) LEFT JOIN o USING (event_type)",
    "find_patterns": f"WITH {_SPEC}, {_DOM}, {_RUNS.format(v='value')}, {_SIG.format(v='value', t='log', o='ts')}, c AS (SELECT event_type, count(*) AS n, {_R.format(x='t', y='value')} AS r FROM s GROUP BY 1), u AS (SELECT event_type, CASE WHEN r > 0 THEN 'increasing_linear' ELSE 'decreasing_linear' END AS pattern, abs(r) AS confidence, n AS support FROM c WHERE abs(r) >= 0.3 UNION ALL SELECT event_type, 'cyclical', magnitude, n FROM dom UNION ALL SELECT event_type, 'recurring_' || run, confidence, support FROM runs UNION ALL SELECT event_type, 'anomaly', count(*) / any_value(n), count(*) FROM far GROUP BY 1) SELECT event_type, pattern, round(confidence, 6) + 0.0 AS confidence, support FROM u",
    "cross_corr": _IDX + " SELECT l::INT AS lag, round(coalesce(avg(a.x * b.x), 0), 6) + 0.0 AS value FROM range(-30, 31) t(l) LEFT JOIN a ON true LEFT JOIN b ON b.i = a.i + l GROUP BY l",
    "optimal_lag": _IDX + f", c AS (SELECT l AS lag, {_R.format(x='b.x', y='a.x')} AS r FROM range(0, 11) t(l), b JOIN a ON a.i = b.i + l GROUP BY l) SELECT lag::INT AS lag, round(r, 6) + 0.0 AS r FROM c ORDER BY abs(r) DESC, lag LIMIT 1",
}
