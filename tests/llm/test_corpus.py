from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from engramic.llm import mixing, near_dedup, packing, passages


def test_mix(docs, rows):
    got = mixing.mixed_documents(docs).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode().split())
    totals = {}
    for _, t, _, s, *_ in rows:
        totals[s] = totals.get(s, 0) + size(t)
    names = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: [5, 2, 1][i % 3] for i, s in enumerate(names)}
    left, budget, target = set(names), 1.5 * sum(totals.values()), {}
    while True:
        w = sum(weight[s] for s in left)
        over = [s for s in left if budget * weight[s] / w > 2 * totals[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * totals[s]
            budget -= target[s]
            left.discard(s)
    target |= {s: budget * weight[s] / w for s in left}
    taken = {}
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    again = mixing.mixed_documents(docs).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in got) == sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in again)


def test_mix_in_salted_groups_and_margins(spark):
    rng = random.Random(0)
    d = spark.createDataFrame([(i, "hot" if i % 3 else "b", rng.choice("xy"), rng.randint(1, 400)) for i in range(3000)], "doc_id long, source string, lang string, size long")
    sums = {r["source"]: r["s"] for r in d.groupBy("source").agg(F.sum("size").alias("s")).collect()}
    t = spark.createDataFrame([("hot", sums["hot"] * 0.6), ("b", sums["b"] * 1.97)], "source string, target double")
    got = mixing.mix(d, t, group_rows=100)
    taken = {r["source"]: r["s"] for r in got.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("s")).collect()}
    assert taken["hot"] == pytest.approx(sums["hot"] * 0.6, rel=0.005) and taken["b"] == pytest.approx(sums["b"] * 1.97, rel=0.005)
    total = sums["hot"] * 0.6 + sums["b"] * 1.97
    lang = spark.createDataFrame([("x", total * 0.55), ("y", total * 0.45)], "lang string, target double")
    solved = mixing.mix(d, t.withColumn("target", F.col("target") * 0.9), margins={"lang": lang.withColumn("target", F.col("target") * 0.9)})
    by = {r["lang"]: r["s"] for r in solved.groupBy("lang").agg(F.sum(F.col("size") * F.col("rate")).alias("s")).collect()}
    assert by["x"] == pytest.approx(total * 0.9 * 0.55, rel=1e-3)


def test_mix_empty(nothing):
    assert mixing.mixed_documents(nothing).count() == 0
    assert mixing.mixed_copies(nothing).count() == 0


def test_mixed_copies_follow_the_plan(docs):
    plan = {}
    for r in mixing.mixed_documents(docs).collect():
        plan[r["doc_id"]] = plan.get(r["doc_id"], 0) + (r["copies"] if r["size"] else 1)
    got = {r["doc_id"]: r["count"] for r in mixing.mixed_copies(docs).groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in plan.items() if v}


@pytest.mark.parametrize("seed", range(6))
def test_boundaries_are_optimal(seed):
    rng = np.random.default_rng(seed)
    x = rng.choice(30, 8, replace=False) + 1
    c = rng.integers(0, 9, 8)
    for k in (1, 2, 3, 9):
        edges, cost = packing.optimal_boundaries(x, c, k)
        used = sorted(x[c > 0].tolist())
        best = min((sum(n * (min(e for e in cut if e >= v) - v) for v, n in zip(x.tolist(), c.tolist(), strict=True) if n) for r in range(1, k + 1) for cut in itertools.combinations(used, r) if cut[-1] == used[-1]), default=0)
        assert cost == best and len(edges) <= k and edges[-1] == used[-1]


def test_packing(docs, rows, nothing):
    from engramic.llm.queries import tokenizer_path
    from engramic.llm.token_index import Encoder

    e = Encoder(tokenizer_path())
    got = packing.packed_documents(docs, tokenizer_path(), 500, 4, 1000).collect()
    real = [r for r in got if r["piece"] is not None]
    sizes = {}
    for r in real:
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["n_tokens"]
    want = {}
    for i, t, *_ in rows:
        want[i] = want.get(i, 0) + len(e._ids(t or ""))
    assert sizes == {i: n for i, n in want.items() if n}
    batches = {}
    for r in real:
        assert r["n_tokens"] <= r["boundary"] <= 500 and r["padding"] == r["boundary"] - r["n_tokens"]
        batches.setdefault((r["boundary"], r["group"], r["batch"]), []).append(r["row_in_batch"])
    for (b, _, _), at in batches.items():
        assert len(at) <= 1000 // b and sorted(at) == list(range(len(at)))
    assert {r["doc_id"] for r in got} == {i for i, *_ in rows}
    assert packing.packed_documents(nothing, tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        packing.packed_documents(docs, tokenizer_path(), 500, 4, 100)


def test_repeated_rows_are_spread(spark):
    # a third of all rows are one row, and copies of a document do not stand side by side
    d = spark.range(2000).selectExpr("id as doc_id", "10 as size").union(spark.range(1000).selectExpr("cast(null as long)", "10"))
    d = d.union(spark.range(2000).selectExpr("id as doc_id", "10 as size"))
    got = packing.pack(d, 100, 4, 100, group_rows=100).collect()
    assert len(got) == 5000
    hot = {}
    for r in got:
        if r["doc_id"] is None:
            hot[r["group"]] = hot.get(r["group"], 0) + 1
    assert len(hot) > 30 and max(hot.values()) < 60
    at = {}
    for r in got:
        at.setdefault((r["group"], r["batch"]), []).append(r["doc_id"])
    twice = sum(len(b) - len(set(b)) for b in ([x for x in b if x is not None] for b in at.values()))
    assert twice < 20


def test_mix_of_repeated_rows(spark):
    d = spark.createDataFrame([(None, "w " * 7, "a", 1)] * 60 + [(i, "w " * (1 + i % 9), "b", 1) for i in range(200)] + [(2**60 + 1, "x y", "a", 1)], "doc_id long, text string, source string, extra int")
    got = mixing.mixed_documents(d).collect()
    assert len(got) == d.count() and {r["doc_id"] for r in got if r["source"] == "a"} == {None, 2**60 + 1}
    taken, target = {}, {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    copies = {}
    for r in got:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + r["copies"]
    out = {r["doc_id"]: r["count"] for r in mixing.mixed_copies(d).groupBy("doc_id").count().collect()}
    assert out == {k: v for k, v in copies.items() if v}


INTERNAL = ["_head", "_cut", "_cut_id", "_copies", "_rows", "_n", "_key", "_take", "_copy", "cut", "row", "text_hash", "row_hash", "none", "copy", "taken", "name", "class", "component", "node", "head", "start", "end", "span", "bands", "payload", "_i", "_last", "_block", "set_hash", "ID", "Key"]


@pytest.mark.parametrize("k", range(4))
def test_extra_columns_travel_along(spark, docs, small, k):
    """Every name that an operator uses inside, as a column of the documents."""
    wide = docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in INTERNAL])
    _, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, wide, small)
    assert out.columns == wide.columns
    rows = out.collect()
    assert rows
    for r in rows:
        assert all(r[n] == f"{n}{'-' if r['doc_id'] is None else r['doc_id']}" for n in INTERNAL)


def test_rows_that_repeat_a_doc_id(spark):
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage, one, two = text(60), text(80), text(90)
    d = spark.createDataFrame([(1, one), (1, two), (1, two), (2, passage + " " + text(30)), (3, text(20) + " " + passage), (3, text(200))], "doc_id long, text string")
    kept = near_dedup.keep_one(d).collect()
    assert sorted((r["doc_id"], r["text"][:10]) for r in kept) == sorted({(r["doc_id"], r["text"][:10]) for r in d.collect()})
    cut = {(r["doc_id"], len(r["text"].split())) for r in passages.without_repeats(d).collect()}
    assert cut == {(1, 80), (1, 90), (2, 90), (3, 20), (3, 200)}


def test_stages_leave_other_results_alone(spark, docs, small):
    groups = near_dedup.near_duplicates(docs)
    corpus_pipeline.STAGES[3][1](spark, docs, small).count()
    corpus_pipeline.STAGES[1][1](spark, docs, small).count()
    assert groups.count() == docs.count()


def planted(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(55)
    line = text(90).split()
    near = list(line)
    near[40] = "changed"
    docs = [(i, text(150)) for i in range(30)]
    docs += [(100 + i, f"{text(40)} {passage} {text(25)}") for i in range(4)]
    docs += [(200, text(10) + "\n" + " ".join(line) + "\n" + text(10)), (201, text(10) + "\n" + " ".join(near) + "\n" + text(10))]
    docs += [(300, "short line here\n" + text(60)), (301, "short line here\n" + text(60)), (302, None), (303, ""), (None, passage)]
    return passage, spark.createDataFrame([(i, t, "en", "s", len(t) if t else 0, 1) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long, start int")


@pytest.mark.parametrize("unit_rows", [4096, 2])
def test_planted_passages(spark, unit_rows):
    passage, d = planted(spark)
    got = {r["doc_id"]: r for r in passages.repeated_passages(d, unit_rows=unit_rows).collect()}
    assert set(got) == {100, 101, 102, 103, 200, 201}
    assert {got[i]["component_id"] for i in range(100, 104)} == {100} and got[201]["component_id"] == 200
    assert not got[100]["removed"] and all(got[i]["removed"] for i in (101, 102, 103, 201))
    assert all((got[i]["start_word"], got[i]["n_words"]) == (40, 55) for i in range(100, 104))


def longest_runs(a, b, least):
    """All maximal equal runs of at least ``least`` words: (start in b, length)."""
    out, prior = set(), {}
    for i, x in enumerate(a):
        now = {}
        for j, y in enumerate(b):
            if x == y:
                now[j] = prior.get(j - 1, 0) + 1
                if now[j] >= least and (i + 1 == len(a) or j + 1 == len(b) or a[i + 1] != b[j + 1]):
                    out.add((j - now[j] + 1, now[j]))
        prior = now
    return out


def test_spans_against_all_substrings(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    shared = [[word() for _ in range(rng.randint(30, 140))] for _ in range(12)]
    texts = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += [word() for _ in range(rng.randint(1, 40))]
            p = rng.choice(shared)
            lo = rng.randint(0, max(0, len(p) - 30)) if rng.random() < 0.4 else 0
            parts += p[lo : rng.randint(min(len(p), lo + 30), len(p))] if rng.random() < 0.5 else p
        texts.append(parts + [word()])
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {}
    for r in passages.repeated_passages(d).where("removed").collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["start_word"] + r["n_words"]))
    missed = over = total = 0
    for j in range(60):
        want, any_run = set(), set()
        for i in range(j):
            for s, n in longest_runs(texts[i], texts[j], 27):
                any_run.update(range(s, s + n))
                if n >= 51:
                    want.update(range(s, s + n))
        mine = got.get(j, set())
        total += len(want)
        missed += len(want - mine)
        over += len(mine - any_run)
    # no word is cut that no earlier document has; what may stay (0.05 here) is an end of a passage that a
    # third document has and the first has not
    assert total > 2000 and over == 0 and missed <= 0.06 * total


def test_cut_text(spark):
    passage, d = planted(spark)
    out = {r["doc_id"]: r for r in passages.without_repeats(d).collect()}
    assert len(out) == d.count() and out[100]["text"].count(passage) == 1
    for i in (101, 102, 103):
        assert passage not in out[i]["text"] and out[i]["n_chars"] == len(out[i]["text"])
    before = {r["doc_id"]: r["text"] for r in d.collect()}
    assert all(out[i]["text"] == before[i] for i in (*range(30), 200, 300, 301, 302, 303, None))
    again = passages.repeated_passages(spark.createDataFrame(list(out.values()), d.schema))
    assert again.count() == 0
    assert passages.cut_words(b" a b\nc d e ", [(1, 3)]) == b" a d e " and passages.cut_words(b"a b", [(0, 2)]) == b""


def test_odd_documents_and_bands(docs, nothing):
    assert passages.repeated_passages(nothing).count() == 0 and passages.without_repeats(nothing).count() == 0
    out = passages.without_repeats(docs)
    assert out.columns == docs.columns
    b = passages.tuned_bands(0.8, 0.998, 4)
    assert 1 - (1 - 0.8**4) ** b >= 0.998 > 1 - (1 - 0.8**4) ** (b - 1)


def test_anchors_reach_every_run():
    rng = np.random.default_rng(0)
    for h in (rng.integers(0, 2**63, 400).astype(np.uint64), np.full(100, 7 << 40, np.uint64)):
        at = passages.anchors(h, np.zeros(len(h), np.int64))
        assert np.diff(np.concatenate([[-1], at, [len(h)]])).max() <= passages.ANCHOR_RUN


def first_of_near_copies(rows):
    """The smallest doc_id of each component of the pairs at a 5-word Jaccard similarity of 0.8, by all pairs."""
    sets = {}
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    for i, j in itertools.combinations(sorted(sets), 2):
        a, b = sets[i], sets[j]
        if a == b or 5 * len(a & b) >= 4 * len(a | b):
            low, high = sorted((label[i], label[j]))
            label = {k: low if x == high else x for k, x in label.items()}
    return set(label.values())


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, small).cache()
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == before.columns
        if k == 1:
            assert {r["doc_id"] for r in docs.collect()} == first_of_near_copies(before.collect())
    assert counts[0] > counts[1] > counts[2] >= counts[3]
    assert corpus_pipeline.run(spark, small).count() == counts[-1]


def test_line_recall_against_all_pairs(spark):
    """Of all pairs of different lines of sf0.01 at 0.8, those in one class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {}
    for r in docs.select("text").collect():
        for line in (r["text"] or "").encode().lower().split(b"\n"):
            w = line.split()
            if len(w) >= passages.MIN_WORDS:
                sets.setdefault(b" ".join(w), {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)})
    by = {}
    for k, (_, grams) in enumerate(sets.items()):
        for g in grams:
            by.setdefault(g, []).append(k)
    shared = {}
    for ks in by.values():
        for i, j in itertools.combinations(ks, 2):
            shared[i, j] = shared.get((i, j), 0) + 1
    lines = list(sets)
    near = [(i, j) for (i, j), n in shared.items() if 5 * n >= 4 * (len(sets[lines[i]]) + len(sets[lines[j]]) - n)]
    assert len(near) > 20
    own = spark.createDataFrame([(i, line.decode()) for i, line in enumerate(lines)], "doc_id long, text string")
    units = passages.paragraph_units(own, passages.tuned_bands()).where("kind = 0").cache()
    classes = {r["unit_hash"]: r["class"] for r in passages.line_classes(own, units).collect()}
    label = {r["doc_id"]: classes.get(r["unit_hash"], r["unit_hash"]) for r in units.select("doc_id", "unit_hash").collect()}
    assert sum(label[i] == label[j] for i, j in near) >= 0.99 * len(near)
    exact = list(range(len(lines)))
    for i, j in near:
        if exact[i] != exact[j]:
            low, high = sorted((exact[i], exact[j]))
            exact = [low if x == high else x for x in exact]
    # and none are joined that no chain of pairs joins
    first = {}
    for i, c in label.items():
        first.setdefault(c, set()).add(exact[i])
    assert all(len(x) == 1 for x in first.values())
