from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from engramic.operators import cache, clusters, lifecycle, listing, metrics, pool, predict, search, series, statistics
from engramic.operators import memories as mem
from engramic.sources.store import MemoryStore
from engramic.streaming import metrics as stream

DATA = [1.0, 2, 2, 3, 4, 5, 5, 6, 7, 100]
NOW = dt.datetime(2024, 1, 31)


def nums(spark, xs, key="k"):
    return spark.createDataFrame([(key, i, float(x)) for i, x in enumerate(xs)], "k string, i int, x double")


def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def test_descriptive(spark):
    r = statistics.moments(nums(spark, DATA), ["k"], "x").first()
    assert (r["mean"], r["median"]) == (13.5, 4.5)
    assert r["variance"] == pytest.approx(927.388889, abs=1e-6)
    assert (r["skewness"], r["kurtosis"]) == (pytest.approx(2.260052, abs=1e-6), pytest.approx(3.520451, abs=1e-6))
    assert sorted(x["mode"] for x in statistics.modes(nums(spark, DATA), ["k"], "x").collect()) == [2, 5]
    q = statistics.half_quartiles(nums(spark, DATA), ["k"], "x").first()
    assert (q["q1"], q["q2"], q["q3"]) == (2, 4.5, 6)


def test_outliers(spark):
    o = statistics.iqr_outliers(nums(spark, DATA), [], "x").collect()
    assert [r["x"] for r in o] == [100.0]
    s = statistics.sigma_anomalies(nums(spark, DATA), [], "x", ["i"]).first()
    assert (s["support"], s["confidence"], s["examples"]) == (1, pytest.approx(0.1), [100.0])


def test_histogram_is_anchored_at_zero(spark):
    got = {round(r["bin"], 6): r["n"] for r in statistics.histogram(nums(spark, DATA), [], "x").collect()}
    assert got == {0.0: 5, 4.95: 4, 99.0: 1}


def test_inference(spark):
    d = nums(spark, [1, 2, 3], "a").union(nums(spark, [2, 3, 4], "b"))
    t = statistics.t_test(d, "x", F.col("k") == "a", F.col("k") == "b").first()
    assert (t["statistic"], t["p_value"]) == (pytest.approx(-1.224745, abs=1e-6), pytest.approx(0.220671, abs=1e-5))
    c = statistics.confidence_interval(nums(spark, [1, 2, 3]), [], "x").first()
    assert (c["lower"], c["upper"]) == (pytest.approx(1.050449, abs=1e-6), pytest.approx(2.949551, abs=1e-6))
    b = statistics.bayes_update(nums(spark, [1, 2, 3]), [], "x").first()
    assert (b["mean"], b["variance"]) == (1.5, 0.25)


def test_correlation(spark):
    p = spark.createDataFrame([(float(i), 2.0 * i, 0.0) for i in range(1, 6)], "a double, b double, z double")
    assert statistics.pearson(p, [], "a", "b").first()["r"] == pytest.approx(1.0)
    assert statistics.pearson(p, [], "a", "z").first()["r"] == 0.0
    assert statistics.correlation_report(p, [], "a", "b").first()["strength"] == "strong"
    r = spark.range(1).select(statistics.correlation_p_value(F.lit(0.5), F.lit(10), True).alias("p")).first()["p"]
    assert 1 <= r <= 2


def test_empty_input(spark):
    e = nums(spark, [])
    assert statistics.moments(e, ["k"], "x").count() == 0
    assert statistics.moments(e, [], "x").first()["n"] == 0
    assert series.smooth(e, ["k"], ["i"], "x").count() == 0
    assert series.recurring_runs(e, ["k"], ["i"], "x").count() == 0


def test_smoothing_both_ways(spark):
    a = series.smooth(nums(spark, [1, 2, 3]), ["k"], ["i"], "x").orderBy("idx").collect()
    assert [round(r["level"], 6) for r in a] == [1, 1.3, 1.81]
    b = series.smooth(nums(spark, [1, 2, 3]), ["k"], ["i"], "x", fold_rows=1).orderBy("idx").collect()
    assert a == b
    f = series.forecast(series.smooth(nums(spark, [1, 2, 3]), ["k"], ["i"], "x"), ["k"], 2).collect()
    assert [round(r["value"], 6) for r in f] == [1.81, 1.81]


def test_cross_correlation(spark):
    a = series.indexed(nums(spark, [1, 2, 3, 4, 5]), [], ["i"], "x")
    b = series.indexed(nums(spark, [0, 1, 2, 3, 4]), [], ["i"], "x")
    got = {r["lag"]: r["value"] for r in series.cross_correlation(a, b).collect()}
    assert len(got) == 61 and got[30] == 0
    assert [round(got[k], 6) for k in (-2, -1, 0, 1, 2)] == [4.666667, 6.5, 8, 7.5, 6.666667]


def test_recurring_runs(spark):
    r = series.recurring_runs(nums(spark, [1, 2, 3, 2, 1, 2, 3, 2, 1]), ["k"], ["i"], "x").collect()
    by = {n: [round(x["confidence"], 6) for x in r if x["length"] == n] for n in (2, 3, 4)}
    assert len(r) == 9 and by == {2: [0.25] * 4, 3: [0.285714] * 3, 4: [0.333333] * 2}


def test_spectrum(spark):
    xs = [math.sin(i / 10) + i / 50 + (100 if i == 50 else 0) for i in range(100)]
    spec = series.spectrum(nums(spark, xs), ["k"], ["i"], "x")
    d = series.dominant_cycle(spec, ["k"]).first()
    assert spec.count() == 50 and d["frequency"] > 0 and d["period"] == math.floor(100 / d["frequency"] + 0.5)
    assert series.dominant_cycle(spec, ["k"], True).first()["frequency"] == 0


def test_rolling(spark):
    flat = [1.0] * 30 + [5.0, 1.0]
    assert series.rolling_z(nums(spark, flat), ["k"], ["i"], "x").count() == 0
    assert [r["i"] for r in series.rolling_z(nums(spark, flat), ["k"], ["i"], "x", 30, True).collect()] == [30]
    assert series.rolling_z(nums(spark, DATA), ["k"], ["i"], "x", 50, True).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id long, vector array<float>, cluster_id int")


def test_cluster_quality(spark):
    v = vectors(spark, [(i, [0.1, 0.2], 1) for i in range(10)] + [(10 + i, [0.3, 0.4], 2) for i in range(5)])
    c = {r["cluster_id"]: r["coherence"] for r in clusters.coherence(v, "cluster_id").collect()}
    assert sum(c.values()) / 2 == pytest.approx(1.180556, abs=1e-6)
    assert clusters.isolation(v, "cluster_id").first()["isolation"] == pytest.approx(0.016130, abs=1e-5)
    assert {r["density"] for r in clusters.density(v, "cluster_id").collect()} == {10.0, 5.0}
    one = vectors(spark, [(1, [1.0, 1.0], 1)])
    assert clusters.coherence(one, "cluster_id").first()["coherence"] == 1.0
    assert clusters.isolation(one, "cluster_id").first()["isolation"] == 1.0


def test_cluster_commands(spark):
    v = vectors(spark, [(i, [math.cos(i), math.sin(i)], i % 2) for i in range(20)])
    assert clusters.merge(v, 0, 1).select("cluster_id").distinct().count() == 1
    with pytest.raises(ValueError, match="Invalid cluster IDs"):
        clusters.merge(v, 0, 9)
    with pytest.raises(ValueError, match="Invalid cluster ID"):
        clusters.split(v, 9, 3)
    sizes = sorted(r["count"] for r in clusters.split(v, 0, 7).groupBy("cluster_id").count().collect())
    assert sizes == [5, 5, 10]
    assert clusters.dissolve(v, 1).select("cluster_id").distinct().count() == 1


def test_search_with_blocks_and_broadcast(spark):
    v = vectors(spark, [(i, [math.cos(i * i), math.sin(i * i), 0.1 * (i % 7)], 0) for i in range(60)])
    q = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    a = search.top_k(search.scored_pairs(q, v), 3, digits=9)
    b = search.top_k(search.scored_pairs(q, v, blocks=3), 3, digits=9)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() == 9
    text = spark.createDataFrame([(1, None)], "query_id long, query array<float>")
    parts = spark.createDataFrame([(1, "semantic", [1.0, 0.0]), (2, "episodic", [1.0, 0.0])], "p int, type string, centroid array<double>")
    assert [r["p"] for r in search.route(text, parts, "p", "semantic", 0.9).collect()] == [1]


def test_greedy_groups_follow_ids(spark):
    v = vectors(spark, [(1, [1.0, 0.0], 0), (2, [0.9, 0.1], 0), (3, [0.0, 1.0], 0), (4, [1.0, 0.0], 1)])
    got = {r["id"]: r["seed"] for r in lifecycle.greedy_groups(v, 0.39).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    m = spark.createDataFrame([(1, "test1", 0.5), (2, "test2", 0.9)], "id long, content string, strength double")
    g = spark.createDataFrame([(1, 1), (2, 1)], "id long, seed long")
    r = lifecycle.merge_groups(m, g).first()
    assert (r["content"], r["strength"], r["members"]) == ("test1 | test2", 0.9, 2)


def test_network_depth_ends_in_cycles(spark):
    n = spark.range(1, 5).select("id")
    e = spark.createDataFrame([(2, 1), (3, 2)], "src long, dst long")
    assert {r["id"]: r["depth"] for r in predict.network_depth(e, n).collect()} == {1: 0, 2: 1, 3: 2, 4: 0}
    loop = spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long")
    assert {r["depth"] for r in predict.network_depth(loop, n, 4).where("id < 3").collect()} == {4}


def test_gates_agree_with_the_stream(spark):
    v = [0.2, 0.9, 0.0]
    hidden, cell, score, sig = stream.gate_step([], [], v)
    g = spark.range(1).select(predict.gate_state(F.array(*[F.lit(x) for x in v])).alias("g")).first()["g"]
    assert (g["score"], g["significance"]) == (pytest.approx(score), pytest.approx(sig)) and g["hidden"] == pytest.approx(hidden)
    again = spark.range(1).select(predict.gate_state(F.array(F.lit(0.4)), F.array(*map(F.lit, hidden)), F.array(*map(F.lit, cell))).alias("g")).first()["g"]
    assert again["score"] == pytest.approx(stream.gate_step(hidden, cell, [0.4])[2])


def test_tags_and_damping(spark):
    c = spark.createDataFrame([(1, "joy", 0.8, "content"), (1, "joy", 0.7, "context"), (1, "x", 0.7, "context"), (1, "p", 0.6, "pattern")], "id long, tag string, confidence double, source string")
    assert [(r["tag"], r["rank"]) for r in predict.ranked_tags(c).orderBy("rank").collect()] == [("joy", 1), ("x", 2)]
    damped = spark.createDataFrame([(1,)], "id long")
    assert [r["tag"] for r in predict.ranked_tags(c, 0.7, damped).collect()] == ["joy"]


def test_metrics(spark):
    m = spark.createDataFrame([(1, 0.8, NOW, 10), (2, 0.6, NOW - dt.timedelta(days=1), 15)], "id long, strength double, ts timestamp, size long")
    r = metrics.memory_metrics(m, now()).first()
    assert (r["total_size"], r["active"], r["average_strength"]) == (25, 2, pytest.approx(0.7))
    log = spark.createDataFrame([("a", i, float(i)) for i in range(12)] + [("b", 1, 0.95)], "metric string, ts int, value double")
    t = {x["metric"]: x for x in metrics.dynamic_thresholds(log).collect()}
    assert t["a"]["normal"] == 5.5 and t["b"]["critical"] == 0.9
    s = {x["metric"]: x for x in metrics.metric_summary(log).collect()}
    assert (s["a"]["current"], s["a"]["trend"], s["b"]["trend"], s["b"]["status"]) == (11, "increasing", "stable", "critical")


def test_cache(spark):
    e = spark.createDataFrame([(i, NOW - dt.timedelta(minutes=i), NOW - dt.timedelta(minutes=i), 1, 10) for i in range(1, 6)], "key int, ts timestamp, last_accessed timestamp, access_count int, size int")
    assert cache.live(e, now(), 3 * 60_000).count() == 3
    assert sorted(r["key"] for r in cache.evict_lru(e, now(), 10, 40, 1e12).collect()) == [1, 2, 3]
    assert cache.trim_by_value(e, now(), 1000).count() == 5
    assert sorted(r["key"] for r in cache.trim_by_value(e, now(), 50).collect()) == [1, 2, 3]
    assert cache.evict_lru(e.limit(0), now()).count() == 0


def test_queue(spark):
    t = spark.createDataFrame([(1, 1, 1), (2, 9, 2), (3, 4, 3), (4, 9, 4)], "id int, priority int, created int")
    assert [r["id"] for r in pool.queue_order(t).orderBy("place").collect()] == [2, 4, 1, 3]


def test_listing(spark):
    assert listing.visible_range(1000, 100) == (17, 31)
    assert [r["id"] for r in listing.page(spark.range(20), ["id"], 5, 3).collect()] == [5, 6, 7]
    got = listing.process_batches(spark.range(10), lambda f: f.assign(id=f["id"] * 2), "id long", 3)
    assert sorted(r["id"] for r in got.collect()) == list(range(0, 20, 2))


def test_store_round_trip(spark, small, tmp_path):
    m = mem.from_tables(spark, small)
    store = MemoryStore(spark, str(tmp_path / "store"))
    assert store.anomalies().count() == 0 and store.memories().count() == 0
    store.append(m)
    assert store.memories("semantic").count() == m.where("type = 'semantic'").count()
    assert store.memories().select("vector").first()["vector"] is not None
    store.log_anomaly(spark.createDataFrame([(NOW, "low_strength", 0.1)], "ts timestamp, type string, value double"))
    assert store.anomalies().first()["type"] == "low_strength"


def test_maintenance(spark, small):
    m = mem.from_tables(spark, small).where("cluster_id < 2")
    parts = lifecycle.maintain(m, mem.references(m), now(), threshold=0.5)
    kept, gone = parts["active"].count(), parts["archive"].count()
    assert parts["merged"].agg(F.sum("members")).first()[0] + gone == m.count() and kept == parts["merged"].count()
