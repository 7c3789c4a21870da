"""Both ways of the operators that go by blocks or ranges where a key has too many rows for one task."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from engramic.operators import ann, cache, clusters, lifecycle, ordering, partitions, pool, search, series, statistics
from engramic.params import Partitions
from engramic.sources.embedding import embedded
from engramic.sources.store import MemoryStore


def vectors(spark, n, dim=6, groups=3, seed=1, odd=True):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dim)) * 2
    rows = [(i, [float(x) for x in centre[i % groups] + rng.normal(size=dim)], i % groups) for i in range(n)]
    if odd:
        rows += [(n, None, 0), (n + 1, [0.0] * dim, 0), (n + 2, [1.0] * (dim - 1), 0), (n + 3, [1.0, None, *[0.0] * (dim - 2)], 1)]
    return rows, spark.createDataFrame(rows, "id long, vector array<float>, cluster_id int")


def cos(a, b):
    if a is None or b is None or len(a) != len(b) or any(x is None for x in [*a, *b]):
        return 0.0
    a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
    return float(a @ b / np.sqrt((a @ a) * (b @ b))) if a.any() and b.any() else 0.0


def test_places(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.random(), i) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, x double, id long").repartition(5)
    for keys in (["k"], []):
        one = ordering.numbered(df, keys, [F.col("x"), F.col("id")])
        two = ordering.numbered(df, keys, [F.col("x"), F.col("id")], key_rows=1)
        pick = lambda t: sorted((r["id"], r["i"]) for r in t.collect())
        assert pick(one) == pick(two) and len(pick(two)) == 700
        a = ordering.exact_quantiles(df, keys, "x", [0, 0.25, 0.5, 0.99, 1]).collect()
        b = ordering.exact_quantiles(df, keys, "x", [0, 0.25, 0.5, 0.99, 1], 1).collect()
        flat = lambda t: sorted((str(r["k"]) if keys else "", *[round(r[f"q{i}"], 12) for i in range(5)]) for r in t)
        assert flat(a) == flat(b)
    assert ordering.numbered(df.limit(0), ["k"], [F.col("x")], key_rows=0).count() == 0


def test_stats_view_by_ranges(spark, monkeypatch):
    rng = random.Random(12)
    rows = [("ab"[i % 3 == 0], i // 2, i, rng.choice([0.5, 1.0, 2.0, 40.0]) * rng.random()) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, ts long, id long, v double").repartition(5)
    monkeypatch.setattr(series, "BLOCK_ROWS", 64)

    def view():
        got = series.stats_view(df, ["k"], ["ts", "id"], "v").collect()
        return sorted((r["k"], r["part"], round(r["x"], 6), round(r["y"], 6)) for r in got)

    one = view()
    monkeypatch.setattr(ordering, "KEY_ROWS", 1)
    monkeypatch.setattr(series, "FOLD_ROWS", 1)
    two = view()
    assert one == two and {p for _, p, _, _ in one} == {"histogram", "density", "outlier", "forecast"}


def test_rolling_frames_and_folds_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(series, "BLOCK_ROWS", 64)
    rng = random.Random(3)
    rows = [("a" if i % 5 else "b", i, rng.gauss(0, 1) + (9 if i % 97 == 0 else 0)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, i long, x double")
    for sample in (True, False):
        one = series.rolling_z(df, ["k"], ["i"], "x", 20, sample).collect()
        two = series.rolling_z(df, ["k"], ["i"], "x", 20, sample, key_rows=1).collect()
        pick = lambda t: sorted((r["k"], r["i"], round(r["z"], 9)) for r in t)
        assert pick(one) == pick(two) and len(one) > 5
    one = series.smooth(df, ["k"], ["i"], "x", 0.6).orderBy("k", "idx").collect()
    two = series.smooth(df, ["k"], ["i"], "x", 0.6, fold_rows=1).orderBy("k", "idx").collect()
    assert one == two and len(one) == 900
    level = {}
    for k, _, x in sorted(rows):
        level[k] = x if k not in level else 0.6 * x + 0.4 * level[k]
    last = {r["k"]: r["level"] for r in series.last_level(series.smooth(df, ["k"], ["i"], "x", 0.6), ["k"]).collect()}
    assert last == pytest.approx(level)


def test_knn_in_chunks(spark):
    rows, df = vectors(spark, 150)
    q = df.where("id % 10 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    want = set()
    for i, v, _ in rows:
        if i % 10 == 0 and v is not None:
            best = sorted((-round(cos(v, w), 9), j) for j, w, _ in rows if j != i)[:4]
            want |= {(i, j, -s, r + 1) for r, (s, j) in enumerate(best)}
    for size in (1 << 20, 100):
        got = {(r["query_id"], r["id"], round(r["similarity"], 9), r["rank"]) for r in search.knn(q, df, 4, digits=9, chunk_bytes=size).collect()}
        assert {g[:3] for g in got} == {w[:3] for w in want}


def test_pairs_in_blocks(spark):
    rows, df = vectors(spark, 90)
    want = {(g, i, j) for i, v, g in rows for j, w, h in rows if i < j and g == h and cos(v, w) >= 0.7}
    for block in (2048, 7):
        got = [(r["cluster_id"], r["id_a"], r["id_b"]) for r in search.pairs_within(df, "cluster_id", 0.7, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_nearest_in_chunks(spark):
    rows, df = vectors(spark, 60, odd=False)
    points = spark.createDataFrame([(k, [float(x) for x in np.random.default_rng(k).normal(size=6)], "a" if k % 2 else "b") for k in range(9)], "p int, centroid array<double>, type string")
    typed = df.withColumn("type", F.when(F.col("id") % 2 == 0, "a").otherwise("b"))
    for same in (None, "type"):
        one = search.nearest(typed, points, "p", 0.2, same).orderBy("id").collect()
        two = search.nearest(typed, points, "p", 0.2, same, chunk_bytes=64).orderBy("id").collect()
        assert [(r["id"], r["p"], round(r["similarity"], 12)) for r in one] == [(r["id"], r["p"], round(r["similarity"], 12)) for r in two]
    assert search.nearest(typed, points.limit(0), "p").count() == 0


def test_approximate_index_recall(spark):
    rows, df = vectors(spark, 3000, 16, 40, odd=False)
    lists = ann.fit_centroids(df, 30)
    q = df.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    found = ann.search(q, ann.index(df, lists), lists, 10, 6)
    exact = {(r["query_id"], r["id"]) for r in search.knn(q, df, 10).collect()}
    got = {(r["query_id"], r["id"]) for r in found.collect()}
    assert len(exact & got) >= 0.9 * len(exact)
    assert ann.search(q, ann.index(df, lists), lists, 10, 30).count() == len(exact)


def test_greedy_groups_in_blocks(spark):
    rows, df = vectors(spark, 160, odd=False)
    df = df.withColumn("ai_generated_tags", F.array(F.concat(F.lit("t"), (F.col("id") % 3).cast("string"))))
    one = {(r["id"], r["seed"]) for r in lifecycle.greedy_groups(df, 0.5).collect()}
    for block in (7, 40):
        two = {(r["id"], r["seed"]) for r in lifecycle.greedy_groups(df, 0.5, block_rows=block).collect()}
        assert one == two
    assert 3 < len({s for _, s in one}) < 160


def test_partition_life_cycle(spark):
    rows, df = vectors(spark, 90, groups=4, odd=False)
    m = df.select("id", F.lit("semantic").alias("type"), "vector", F.col("cluster_id").cast("string").alias("partition_id"))
    m = m.where("partition_id <> '3' or id < 24")
    p = Partitions(max_size=22, min_size=10, similarity=-1.0, imbalance=0.05)
    out = partitions.rebalance(m, p)
    assert out.count() == m.count() and out.select("id").distinct().count() == m.count()
    names = {r["partition_id"] for r in out.select("partition_id").distinct().collect()}
    assert not any(n == "3" for n in names) and any(n.endswith((".0", ".1")) for n in names)
    # a chain of merges ends in one partition
    line = spark.createDataFrame([(i, "t", [float(np.cos(i / 9)), float(np.sin(i / 9))], f"p{i}") for i in range(8)], "id long, type string, vector array<double>, partition_id string")
    joined = partitions.merge_undersize(line, 5, 0.9)
    assert joined.select("partition_id").distinct().count() < 8 and joined.count() == 8
    full = partitions.assign(line.drop("partition_id"), partitions.partition_table(line), Partitions(max_size=1, similarity=0.0))
    assert full.where("created").count() == 8


def test_kmeans_repeats(spark):
    _, df = vectors(spark, 120, odd=False)
    a = {(r["id"], r["cluster_id"]) for r in clusters.kmeans(df, 3).collect()}
    b = {(r["id"], r["cluster_id"]) for r in clusters.kmeans(df.repartition(7), 3).collect()}
    assert a == b and len({c for _, c in a}) == 3


def test_result_cache(spark):
    _, df = vectors(spark, 50, odd=False)
    q = df.where("id < 6").select(F.col("id").alias("query_id"), F.col("vector").alias("query"), F.lit("t").alias("type"))
    asked = []

    def run(x):
        asked.append(x.count())
        return search.knn(x, df, 3)

    empty = spark.createDataFrame([], "key long, query_id long, id long, similarity double, rank int")
    every, new = cache.remembered(q, empty, 3, run)
    again, none = cache.remembered(q, new, 3, run)
    assert asked == [6, 0] and none.count() == 0
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, again.collect()))


def test_pool_and_state(spark, tmp_path):
    workers = spark.createDataFrame([(1, 5, True, 0.9, 0, 0.9, 0.5, 0.5), (2, None, False, 0.1, 9, 0.9, 0.5, 0.5), (3, None, False, 0.4, 0, 0.9, 0.5, 0.5)], "worker_id long, task_id long, busy boolean, health double, errors int, efficiency double, cpu double, memory double")
    assert {(r["worker_id"], r["action"]) for r in pool.health_actions(workers).collect()} == {(2, "replace"), (3, "heal")}
    create, stop = pool.resize(workers, 2, 2)
    assert create == 0 and [r["worker_id"] for r in stop.collect()] == [2]
    assert pool.resize(workers, 5, 8)[0] == 2
    store = MemoryStore(spark, f"file://{tmp_path}")
    table = spark.createDataFrame([("t", 1.0)], "type string, relevance double")
    store.save_state(table, table, table, {"window": 10})
    state = store.load_state()
    assert state["config"] == {"window": 10} and state["gates"].collect() == table.collect()
    texts = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "id long, content string")
    got = {r["id"]: r["vector"] for r in embedded(texts, lambda ts: [[len(t)] for t in ts], batch_rows=1).collect()}
    assert got == {1: [3.0], 2: None, 3: [0.0]}


def test_statistics_by_ranges(spark, monkeypatch):
    rng = random.Random(5)
    df = spark.createDataFrame([(rng.choice("ab"), rng.choice([rng.gauss(5, 2), 3.0])) for _ in range(400)], "k string, x double")
    ways = []
    for rows in (10**6, 1):
        monkeypatch.setattr(ordering, "KEY_ROWS", rows)
        parts = [statistics.half_quartiles(df, ["k"], "x"), statistics.quantiles(df, ["k"], "x", [0.1, 0.5]), statistics.moments(df, ["k"], "x"), statistics.iqr_outliers(df, ["k"], "x"), series.linear_trend(df, ["k"], ["x"], "x")]
        ways.append([sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in p.collect()) for p in parts])
    assert ways[0] == ways[1]


def test_selection_and_updates(spark, tmp_path):
    from engramic.operators.listing import toggled
    from engramic.streaming.metrics import on_update, windowed_metrics

    assert toggled((), 1) == (1,) and toggled((1, 2, 3), 4) == (1, 2, 3) and toggled((1, 2, 3), 2) == (1, 3)
    spark.createDataFrame([(f"2024-01-0{1 + i % 3} 00:00:00", "a", float(i)) for i in range(30)], "ts string, event_type string, value double").selectExpr("cast(ts as timestamp) ts", "event_type", "value").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{tmp_path}/in")
    seen = []
    on_update(windowed_metrics(stream), lambda rows, batch: seen.extend(rows.collect()), f"{tmp_path}/checkpoint", "update", None).awaitTermination()
    assert sorted(r["n"] for r in seen) == [10, 10, 10]
