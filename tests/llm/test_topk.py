from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from engramic.llm import topk


def brute(rows, k):
    ok = [(i, np.floor(1024 * np.array(v, float)).astype(np.int64)) for i, v, _ in rows if i is not None and v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    seen = set()
    for i, q in ok:
        if i % 5 == 0 and i not in seen:
            seen.add(i)
            best = sorted(((-int(q @ v), j) for j, v in ok if j != i))[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


def fixture(spread):
    rng = np.random.default_rng(4)
    v = (rng.normal(size=(300, 4)) * rng.choice([0.1, 1, 8], (300, 1)) if spread else rng.normal(size=(300, 4))).astype(np.float32)
    rows = [(i, [float(x) for x in v[i]], 0) for i in range(300)]
    rows += [(300 + i, rows[10][1], 0) for i in range(40)]
    return [*rows, (400, None, 0), (405, [1.0, None, 0.0, 0.0], 0), (410, [float("nan")] * 4, 0), (415, [float("inf"), 0.0, 0.0, 0.0], 0), (420, [], 0), (425, [0.0] * 4, 0), (None, [1.0] * 4, 0), rows[20]]


@pytest.mark.parametrize("spread", [True, False])
@pytest.mark.parametrize("query_slice", [100_000, 20])
def test_against_brute_force(spark, monkeypatch, spread, query_slice):
    monkeypatch.setattr(topk, "SEEDS", 16)
    monkeypatch.setattr(topk, "BUCKET", 32)
    rows = fixture(spread)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = topk.top_k(df, F.col("vec_id") % 5 == 0, 7, query_slice=query_slice)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, 7))


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, 512 * 1024 + 512 * 2048)]
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_coordinate_pruning_loses_nothing():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(500, 8)).round() * 4
    q = v[:20] + 1
    s = q @ v.T
    floor = np.sort(s, axis=1)[:, -3]
    state = topk.Queries(np.arange(1000, 1020), q, floor, 3)
    state.visit(np.arange(500), v, np.sqrt((v * v).sum(axis=1)))
    best = {}
    for r in state.found().to_pylist():
        best[r["query_id"]] = max(best.get(r["query_id"], r["score"]), r["score"])
    assert [best[1000 + i] for i in range(20)] == s.max(axis=1).tolist()


def exactly(rows, k):
    q = [(i, [math.floor(1024 * Fraction(x)) for x in v]) for i, v in rows]
    out = set()
    for i, a in q:
        best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), j) for j, b in q if j != i and len(b) == len(a))[:k]
        out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


@pytest.mark.parametrize("top", [3e6, 7e6, 5e7])
def test_large_components_are_exact(spark, monkeypatch, top):
    monkeypatch.setattr(topk, "BUCKET", 16)
    rng = np.random.default_rng(8)
    rows = [(0, [top, 1.0]), (1, [1.0, 1.0]), (2, [2.0, 1.0])]
    rows += [(3 + i, [float(x) for x in rng.normal(size=2) * rng.choice([1e-3, 1, 30, 1e3])]) for i in range(60)]
    # products that differ by one beyond 2 to the 53rd
    rows += [(100, [100_000.5, 0.0]), (101, [99_999.0, 3 / 1024]), (102, [99_999.0, 2 / 1024]), (103, [1.0, 2.0, 3.0]), (104, [2.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for query_slice in (None, 9):
        assert sorted(map(tuple, topk.top_k(df, F.lit(True), 5, query_slice=query_slice).collect())) == sorted(exactly(rows, 5))


def test_a_score_beyond_64_bits_is_an_error(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="exceeds 64 bits"):
        topk.top_k(df, F.lit(True)).collect()
