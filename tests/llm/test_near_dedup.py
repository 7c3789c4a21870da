from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from engramic.llm import near_dedup
from engramic.llm.common import WordTable, xxh64_spans
from engramic.llm.components import connected_components, local_forest


def fingerprint(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, radius=4):
    known = [(i, fingerprint(t)) for i, t, *_ in rows if i is not None]
    label = {i: i for i, _ in known}
    changed = True
    while changed:
        changed = False
        for i, f in known:
            for j, g in known:
                if bin(f ^ g).count("1") <= radius and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return {i: (f, label[i]) for i, f in known}


@pytest.mark.parametrize("layout", [near_dedup.COARSE, near_dedup.FINE])
@pytest.mark.parametrize("unit_rows", [4096, 3])
def test_against_brute_force(docs, rows, layout, unit_rows):
    got = near_dedup.near_duplicates(docs, layout=layout, unit_rows=unit_rows).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["fp"] % 2**64, r["component_id"]) == want[r["doc_id"]]


@pytest.mark.parametrize("layout", [near_dedup.COARSE, near_dedup.FINE])
@pytest.mark.parametrize("unit_rows", [4096, 8])
def test_dense_fingerprints(spark, layout, unit_rows):
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    fps = {centre}
    for _ in range(150):
        f = centre
        for _ in range(rng.randint(1, 5)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    fps |= {rng.getrandbits(64) for _ in range(100)}
    reps = [(f - 2**64 if f >= 2**63 else f, i) for i, f in enumerate(sorted(fps))]
    df = spark.createDataFrame(reps, "fp long, id long")
    got = {r["node"]: r["component"] for r in connected_components(near_dedup.fingerprint_links(df, layout, unit_rows=unit_rows)).collect()}
    label = list(range(len(reps)))
    for _ in range(len(reps)):
        new = [min(label[j] for j in range(len(reps)) if bin((reps[i][0] ^ reps[j][0]) % 2**64).count("1") <= 4) for i in range(len(reps))]
        if new == label:
            break
        label = new
    assert got == {i: x for i, x in enumerate(label) if label.count(x) > 1}


def test_layout_must_cover(spark):
    with pytest.raises(ValueError):
        near_dedup.fingerprint_links(spark.createDataFrame([(1, 1)], "fp long, id long"), ((16, 1), (16, 1)))


def test_layout_follows_the_size():
    assert near_dedup.choose_layout(1000) == near_dedup.COARSE and near_dedup.choose_layout(10**10) == near_dedup.FINE


def test_empty_and_keep_one(docs, nothing):
    assert near_dedup.near_duplicates(nothing).count() == 0
    kept = near_dedup.keep_one(docs)
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert kept.columns == docs.columns and len(ids) == len(set(ids)) and None in ids and 0 in ids and 40 not in ids


def test_keep_one_finds_edited_copies(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    texts = []
    for _ in range(120):
        own = [word() for _ in range(rng.randint(60, 400))]
        edited = list(own)
        for _ in range(rng.randint(1, max(1, len(own) // 30))):
            edited[rng.randrange(len(own))] = word()
        texts += [own, edited]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    same = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"] for r in near_dedup.keep_one(d).collect()}
    assert sum(s >= 0.8 for s in same) > 20 and sum(s < 0.8 for s in same) > 20
    assert got == {2 * i for i in range(120)} | {2 * i + 1 for i, s in enumerate(same) if s < 0.8}
    # most of the pairs that go are further apart than operator 1's radius
    far = sum(bin(fingerprint(" ".join(texts[2 * i])) ^ fingerprint(" ".join(texts[2 * i + 1]))).count("1") > 4 for i, s in enumerate(same) if s >= 0.8)
    assert far > 10


def test_keep_one_goes_by_simhash(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    texts = []
    for _ in range(150):
        own = [word() for _ in range(rng.randint(60, 300))]
        edited, at = list(own), rng.randrange(len(own))
        edited[at : at + 1] = [word() for _ in range(rng.randint(1, max(1, len(own) // 10)))]
        texts += [own, edited]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    same = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    # without the bands beside them the fingerprints' links find nearly all
    monkeypatch.setattr(near_dedup, "tuned_bands", lambda *_: 0)
    got = {r["doc_id"] for r in near_dedup.keep_one(d).collect()}
    wanted = {2 * i + 1 for i, s in enumerate(same) if s >= 0.8}
    assert got >= {2 * i for i in range(150)} | {2 * i + 1 for i, s in enumerate(same) if s < 0.8}
    assert len(wanted) > 100 and len(wanted - got) >= 0.97 * len(wanted)


@pytest.mark.parametrize("unit_rows", [4096, 6])
def test_set_fingerprint_links(spark, unit_rows):
    rng = np.random.default_rng(4)
    near = [rng.integers(0, 2**64, 2, dtype=np.uint64) for _ in range(30)]
    fps = []
    for f in near:
        bits = np.unpackbits(f.view(np.uint8))
        bits[rng.choice(128, 10, replace=False)] ^= 1
        fps += [f, np.packbits(bits).view(np.uint64)]
    fps = np.array(fps).view(np.int64).tolist()
    df = spark.createDataFrame([(i, *f) for i, f in enumerate(fps)], "id long, f0 long, f1 long")
    edges = near_dedup.set_fingerprint_links(df, unit_rows=unit_rows).collect()
    far = near_dedup.set_fingerprint_links(df, 9, unit_rows).collect()
    assert {tuple(sorted((r["u"], r["v"]))) for r in edges} == {(2 * i, 2 * i + 1) for i in range(30)} and not far
    x, y = (rng.integers(0, 2**64, (300, 2), dtype=np.uint64) for _ in range(2))
    bound = near_dedup.wide_manhattan(near_dedup.wide_counts(x), near_dedup.wide_counts(y))
    assert (bound <= np.bitwise_count(x ^ y).sum(axis=1)).all() and bound.max() > 28


def test_drawn_groups_follow_the_size():
    assert near_dedup.drawn_groups(0).shape == (48, 4) and near_dedup.drawn_groups(200_000).shape == (48, 10) and near_dedup.drawn_groups(10**9).shape[1] == 18


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (3, 2), (5, 6), (7, 7), (None, 1), (9, 8), (8, 10), (10, 1)], "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 1, 9: 1, 10: 1, 5: 5, 6: 5}
    chain = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert connected_components(chain).select("component").distinct().collect()[0]["component"] == 0
    a, b = local_forest(np.array([1, 3, 5]), np.array([2, 2, 6]))
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {2: 1, 3: 1, 6: 5}


def test_hashes():
    texts = [b"a", b"one two  three four five six", b"", b"\x0b x", "né " .encode() * 40, b"q" * 100]
    w = WordTable(texts)
    s, n, first = w.shingles(4)
    h = xxh64_spans(w.joined, s, n)
    want = []
    for t in texts:
        x = t.lower().split()
        want += [xxhash.xxh64_intdigest(b" ".join(x[i : i + 4]), 42) for i in range(max(1, len(x) - 3))] if x else []
    assert h.tolist() == want and first[-1] == len(want)


def test_hot_groups_of_sets_lose_no_link(spark):
    from engramic.llm import passages

    rng = np.random.default_rng(6)
    sets, base = [], [np.unique(rng.integers(0, 2**63, 60, dtype=np.uint64)) for _ in range(6)]
    for i in range(240):
        b = base[0] if i < 140 else base[rng.integers(1, 6)]
        s = np.unique(np.concatenate([b[rng.random(len(b)) > rng.choice([0.02, 0.1, 0.3])], rng.integers(0, 2**63, rng.integers(0, 6), dtype=np.uint64)]))
        sets.append(s)
    rows = [(7, 0, 1000 + i, s.astype("<u8").tobytes()) for i, s in enumerate(sets)] + [(8, 0, 1, sets[0].tobytes()), (8, 0, 2, sets[0].tobytes())]
    df = spark.createDataFrame(rows, "key long, table int, id long, shingles binary")
    label = list(range(240))
    for i in range(240):
        for j in range(i):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    want = {1000 + i: 1000 + x for i, x in enumerate(label) if label.count(x) > 1} | {1: 1, 2: 1}
    for unit_rows in (4096, 50, 7):
        got = {r["node"]: r["component"] for r in connected_components(passages.set_links(df, 0.8, unit_rows)).collect()}
        assert got == want
    hot = {r["u"] for r in passages.set_links(df, 0.8, 7).collect()}
    assert len(set(label)) > 10 and hot


def test_equal_links_are_linear(spark):
    from engramic.llm.hamming import equal_links

    rows = spark.range(500).select(F.when(F.col("id") < 300, 1).otherwise(F.col("id") % 50 + 10).cast("long").alias("key"), F.lit(0).alias("table"), "id")
    for unit_rows in (4096, 20):
        e = equal_links(rows, unit_rows).collect()
        assert len(e) == 299 + 150
        assert all(r["v"] == 0 for r in e if r["u"] < 300)


def test_manhattan_bounds_hamming():
    rng = np.random.default_rng(2)
    x, y = (rng.integers(0, 2**64, (500, 1), dtype=np.uint64) for _ in range(2))
    counts = near_dedup.segment_counts
    plain = np.abs(counts(x[:, 0]).astype(int) - counts(y[:, 0]).astype(int)).sum(axis=1)
    fast = near_dedup.manhattan(near_dedup.packed_counts(x), near_dedup.packed_counts(y))
    assert (plain == fast).all() and (fast <= np.bitwise_count(x ^ y)[:, 0]).all()
