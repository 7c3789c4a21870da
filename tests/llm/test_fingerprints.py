from __future__ import annotations

import hashlib
import random

import pytest

from engramic.llm import fingerprints


def test_edits_and_order(docs, rows):
    got = fingerprints.fingerprint_documents(docs).collect()
    assert len(got) == len(rows)
    order = sorted(((i, t or "") for i, t, *_ in rows if i is not None), reverse=True)
    want = {}
    for k, (i, t) in enumerate(order):
        e = fingerprints.edited(t, order[(k + 1) % len(order)][1])
        want.setdefault(i, []).append((len(t), hashlib.sha256(e.encode()).hexdigest()))
    for i, w in want.items():
        assert sorted((r["n_chars"], r["edited_sha256"]) for r in got if r["doc_id"] == i) == sorted(w)
    lone = next(r for r in got if r["doc_id"] is None)
    assert lone["edited_sha256"] == hashlib.sha256(fingerprints.edited("no id here at all", order[0][1]).encode()).hexdigest()
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    by = {}
    for r in got:
        by.setdefault(next((t or "" for i, t, *_ in rows if i == r["doc_id"]), None), set()).add((r["f0"], r["f1"]))
    assert all(len(v) == 1 for v in by.values())


def test_likeness_falls_with_edits():
    rng = random.Random(3)
    w = ["w%d" % rng.randrange(500) for _ in range(400)]
    sims = []
    for k in (0, 40, 120, 400):
        other = ["z%d" % rng.randrange(500) for _ in range(k)] + w[k:]
        a = fingerprints.fingerprints_of([" ".join(w).encode(), " ".join(other).encode()])
        sims.append(float(fingerprints.likeness(a[:1], a[1:])[0]))
    assert sims[0] == 1 and sims == sorted(sims, reverse=True) and sims[-1] < 0.4


@pytest.mark.parametrize("lead", [1, 2])
def test_block_tables_find_all(spark, lead):
    rng = random.Random(2)
    base = [rng.getrandbits(128) for _ in range(30)]
    fps = list(base)
    for f in base[:10]:
        for d in (3, 6, 9):
            g = f
            for b in rng.sample(range(128), d):
                g ^= 1 << b
            fps.append(g)
    sign = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(i, sign(f % 2**64), sign(f >> 64)) for i, f in enumerate(fps)], "id long, f0 long, f1 long")
    rows = fingerprints.block_rows(df, fingerprints.RADIUS + lead, lead)
    from engramic.llm.components import connected_components
    from engramic.llm.hamming import linked

    got = {r["node"]: r["component"] for r in connected_components(linked(rows, ["f0", "f1"], fingerprints.RADIUS, 7)).collect()}
    label = list(range(len(fps)))
    for _ in range(len(fps)):
        label = [min(label[j] for j in range(len(fps)) if bin(fps[i] ^ fps[j]).count("1") <= 6) for i in range(len(fps))]
    assert got == {i: x for i, x in enumerate(label) if label.count(x) > 1}


def test_classes_and_empty(docs, nothing):
    got = {r["doc_id"]: r["class_id"] for r in fingerprints.fingerprint_classes(docs).collect()}
    assert got[40] == 0 and got[45] == 5 and got[0] == 0
    assert fingerprints.fingerprint_classes(nothing).count() == 0
    one = docs.where("doc_id = 0")
    r = fingerprints.fingerprint_documents(one).first()
    assert r["near_next"] == 1.0
