from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from engramic.llm import language_id, license_scan, quality

NAMES = {"aa": "the and with house stone", "bb": "und der nicht haus stein", "cc": "les avec maison pierre été"}


def corpus(spark, n=240):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(NAMES))
        rows.append((i, " ".join(rng.choice(NAMES[lang].split()) for _ in range(rng.randint(4, 60))), lang, "s", 1))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int")


def test_languages(spark):
    d = corpus(spark)
    odd = spark.createDataFrame([(1000, None, None, None, None), (1001, "", "aa", None, None), (1002, "123 !!", "bb", None, None), (None, "the house", None, None, None), (1004, "die " * 30_000, None, None, None)], d.schema)
    got = {r["doc_id"]: r for r in language_id.predicted_languages(d.union(odd)).collect()}
    truth = {r["doc_id"]: r["lang"] for r in d.collect()}
    held = [i for i in truth if got[i]["held_out"]]
    assert held and sum(got[i]["lang_pred"] == truth[i] for i in held) >= 0.97 * len(held)
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000]["score"] == 0 and got[1000]["rejected"]
    assert got[None]["lang_pred"] == "aa" and all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.predicted_languages(d.limit(0)).count() == 0
    blind = language_id.predicted_languages(d.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in blind.collect()} == {"und"}


def test_a_rare_language_keeps_its_grams(spark):
    # 650,000 n-grams of one language with greater counts than any of the other's
    rng = np.random.default_rng(4)
    hot = ["".join(map(chr, rng.integers(0x4E00, 0x9F00, 65_000))) for _ in range(10)]
    rare = "the and with house stone"
    d = spark.createDataFrame([(i, t, "hot") for i, t in enumerate(hot * 2)] + [(100, rare, "rare")], "doc_id long, text string, lang string")
    model = language_id.fit_languages(d, F.lit(True))
    assert model.langs == ["hot", "rare"] and sum(len(language_id.LanguageModels.load(model.root, k).hashes[-1].table) for k in range(model.shards)) > 650_000
    assert language_id.identify(d.where("doc_id = 100"), model).first()["lang_pred"] == "rare"


def test_counts_cover_every_text(spark):
    d = spark.createDataFrame([("abc abc", "x"), ("abc", "x"), ("Zé!", "y")], "text string, lang string")
    got = {(r["lang"], r["gram"]): r["n"] for r in language_id.gram_counts(d).collect()}
    assert got[("x", "    a")] == 2 and got[("x", "c abc")] == 1 and got[("x", " abc ")] == 3 and got[("y", "  zé ")] == 1


def plain_kneser_ney(counts, order=5):
    """log2 p(c | context) by the textbook recursion over dictionaries, for one language."""
    from collections import defaultdict

    types = {order: dict(counts)}
    for n in range(order - 1, 0, -1):
        types[n] = defaultdict(int)
        for g in types[n + 1]:
            types[n][g[1:]] += 1
    d = {}
    for n, t in types.items():
        one, two = sum(c == 1 for c in t.values()), sum(c == 2 for c in t.values())
        d[n] = one / (one + 2 * two) if one and two else 0.75
    followers = {n: defaultdict(list) for n in types}
    for n, t in types.items():
        for g, c in t.items():
            followers[n][g[:-1]].append(c)

    def p(context, c):
        n = len(context) + 1
        below = p(context[1:], c) if n > 1 else language_id.FLOOR
        cs = followers[n].get(context)
        if not cs:
            return below
        return max(types[n].get(context + c, 0) - d[n], 0) / sum(cs) + d[n] * len(cs) / sum(cs) * below

    return p


def test_against_plain_kneser_ney(spark):
    rng = random.Random(12)
    syllables = {"x": ["ba", "ko", "zu", "né", "ri "], "y": ["th", "er", "in ", "gon", "a"], "z": ["ba ", "er", "日本", "語 ", "к"]}
    texts = [(lang, "".join(rng.choices(syllables[lang], k=rng.randint(5, 60)))) for lang in "xyz" for _ in range(30)]
    d = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string")
    counts = {lang: {} for lang in "xyz"}
    for r in language_id.gram_counts(d).collect():
        counts[r["lang"]][r["gram"]] = r["n"]
    plain = [plain_kneser_ney(counts[lang]) for lang in "xyz"]
    probes = [t for _, t in texts[::7]] + ["unseen wörter q", "日 ba", "x", "ererer in gon"]
    want = []
    for t in probes:
        s = "    " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
        want.append([-sum(math.log2(p(s[i - 4 : i], s[i])) for i in range(4, len(s))) / (len(s) - 4) for p in plain])
    for cells in (10**9, 60):  # one shard, and many
        fitted = language_id.fit_languages(d, F.lit(True), cells)
        assert (fitted.shards == 1) == (cells > 60)
        got, _ = fitted.entropies([t.encode() for t in probes])
        assert np.abs(got - np.array(want)).max() < 1e-4
        assert got.argmin(axis=1).tolist() == np.array(want).argmin(axis=1).tolist()


def test_sorted_hashes():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 1000):
        h = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
        t = language_id.SortedHashes(h)
        assert t.find(h[::-1].copy()).tolist() == list(range(n))[::-1]
        assert (t.find(rng.integers(0, 2**64, 50, dtype=np.uint64)) == -1).all()


def test_kneser_ney_sums_to_one():
    text = "abracadabra alakazam abra".encode()
    chars, _, real = language_id.sequences([text])
    at = np.flatnonzero(real)
    grams, n = np.unique(chars[at[:, None] + np.arange(-4, 1)], axis=0, return_counts=True)
    m = language_id.kneser_ney(["x"], np.zeros(len(grams), np.int64), grams.astype(np.uint32), n)
    letters = np.unique(chars)
    for context in ("    ", "abra", " ala", "zzzz"):
        seq = np.concatenate([[ord(c) for c in context], [0]]).astype(np.uint32)
        p = 0.0
        for c in letters:
            seq[-1] = c
            p += 2 ** float(m.log_probs(seq, np.array([4]))[0, 0])
        # what is left of one is the floor's share of letters that never occurred
        assert 0.5 < p <= 1 + 1e-5


def test_quality(spark, docs):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    good = lambda: " ".join(word() for _ in range(30)).capitalize() + "."
    bad = lambda: " ".join(word() + rng.choice(["###", "$$$"]) for _ in range(30))
    rows = [(i, good() if i % 4 else bad(), int(bool(i % 4))) for i in range(400)]
    d = spark.createDataFrame([(i, t, "en", "s", 7) for i, t, _ in rows], "doc_id long, text string, lang string, source string, score int")
    lab = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 0), (3, None, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality_scores(d, lab).collect()}
    held = [i for i in got if got[i]["held_out"]]
    truth = {i: y for i, _, y in rows}
    assert held and sum(got[i]["predicted"] == truth[i] for i in held) >= 0.98 * len(held)
    kept = quality.accepted(d, lab)
    assert kept.columns == d.columns and 290 <= kept.count() <= 310
    # every text of the odd fixture gets a score, and constant models do too
    s = quality.quality_scores(docs, spark.createDataFrame([(i, 1, 0) for i in range(5)], lab.schema))
    assert s.count() == docs.count() and {r["score"] for r in s.collect()} == {1.0}
    both = quality.quality_scores(docs, spark.createDataFrame([(i, i % 2, 0) for i in range(30)], lab.schema))
    assert all(0 <= r["score"] <= 1 for r in both.collect())
    assert quality.quality_scores(d.limit(0), lab).count() == 0


def test_equal_texts_have_equal_scores(spark):
    rng = random.Random(4)
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    rows = [(i, " ".join(rng.choices(["a", "bb", "Ccc", "d#", "e1"], k=rng.randint(0, 50)))) for i in range(60)]
    same = "the one text, which stands 2000 times; and 3 numbers"
    d = spark.createDataFrame(rows + [(1000 + i, same) for i in range(2000)], "doc_id long, text string")
    got = quality.quality_scores(d.orderBy(F.hash("doc_id")), lab).where("doc_id >= 1000").select("score").distinct().collect()
    assert len(got) == 1


def test_sum_of_squares_identity():
    m = quality.FactorisationMachine(20, 3, 1)
    m.w[:] = np.arange(20) / 10
    col, val = np.array([1, 4, 7, 9]), np.array([0.5, 1.0, 2.0, -1.0])
    pairs = sum(m.v[col[i]] @ m.v[col[j]] * val[i] * val[j] for i in range(4) for j in range(i + 1, 4))
    got = m.margin(np.array([0, 4]), col, val)[0]
    assert got == pytest.approx(m.w0 + m.w[col] @ val + pairs)


def test_licenses(spark, docs):
    texts = [
        ("Licensed under the GNU General Public License, version 3.", 1, "gpl", "gpl,gpl-3.0"),
        ("Licensed under CC BY-NC 4.0.", 1, "cc-by", "cc-by,cc-by-nc-4.0"),
        ("Apache-License apache LICENSE mit license", 3, "apache,mit", "apache,mit"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", 0, "", "mit"),
        ("SPDX-License-Identifier: MPL-2.0", 0, "", "mpl-2.0"),
        ("the general gnu public licence of nothing", 0, "", ""),
        (None, 0, "", ""),
        ("ccé by", 0, "", ""),
    ]
    d = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(d).collect()}
    for i, (_, n, base, labels) in enumerate(texts):
        assert (got[i]["n_base"], got[i]["base_labels"], got[i]["labels"]) == (n, base, labels), i
        assert 0 <= got[i]["score"] <= 1 and (got[i]["score"] > 0) == bool(labels)
    assert (got[2]["first_word"], got[2]["last_word"]) == (0, 4) and got[6]["first_word"] is None
    assert license_scan.scan_licenses(docs).count() == docs.count() and license_scan.scan_licenses(docs.limit(0)).count() == 0


def sample(rng, parsed):
    """A random string that a parsed pattern matches."""
    out = ""
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "IN":
            item = rng.choice([x for x in arg if str(x[0]) != "NEGATE"])
            kind = str(item[0])
            out += chr(item[1]) if kind == "LITERAL" else chr(rng.randint(*item[1])) if kind == "RANGE" else {"CATEGORY_SPACE": rng.choice(" \n\t"), "CATEGORY_DIGIT": rng.choice("0123456789"), "CATEGORY_WORD": rng.choice("abz09")}[str(item[1])]
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            out += "".join(sample(rng, inner) for _ in range(rng.randint(low, min(int(high), low + 2))))
        elif name == "SUBPATTERN":
            out += sample(rng, arg[3])
        elif name == "BRANCH":
            out += sample(rng, rng.choice(arg[1]))
        elif name not in ("ASSERT", "ASSERT_NOT", "AT"):
            raise AssertionError(name)
    return out


def ungated(scan, text):
    return license_scan.suppress([x for i in range(len(scan.rules)) for x in scan.matches(i, text)])


def test_keywords_hide_no_rule():
    rng = random.Random(1)
    scan = license_scan.Scanner()
    filler = ["the", "of", "cc", "gpl", "version 2", "license", "software\nis", "copyright 2001", "x" * 30]
    for i, rule in enumerate(scan.rules):
        assert rule.keyword and not any(c.isspace() for c in rule.keyword)
        for _ in range(4):
            found = sample(rng, re._parser.parse(rule.pattern.pattern))
            assert rule.keyword in found and scan.matches(i, f"( {found} )"), (rule.pattern.pattern, found)
            text = " ".join([*rng.choices(filler, k=3), found, *rng.choices(filler, k=3)])
            assert scan.detections(text) == ungated(scan, text), text


def test_wrapped_license_texts():
    texts = [
        "permission is hereby granted, free of charge, to any person obtaining a copy", "mit no attribution",
        "permission to use, copy, modify, and distribute this software for any purpose with or without fee", "all advertising materials mentioning features or use of this software",
        "simplified bsd license", "bsd 2-clause", "modified bsd license", "revised bsd license", "new bsd license",
        "altered source versions must be plainly marked as such", "published by the free software foundation",
        "either version 2 of the license, or (at your option) any later version", "public domain dedication", "placed in the public domain",
        "all rights reserved", "unless required by applicable law or agreed to in writing", "this source code form is subject to the terms of the mozilla public license",
        "licensed under the gnu lesser general public license, version 2.1", "creative commons attribution share alike license 4.0", "do what the fun you want to public license",
    ]
    scan = license_scan.Scanner()
    for text in texts:
        want = [x[2].label for x in scan.detections(text)]
        for gap in (" ", "  ", "\n", "\n\t "):
            got = scan.detections(text.replace(" ", gap))
            assert got and [x[2].label for x in got] == want and got == ungated(scan, text.replace(" ", gap)), text


def test_every_detection_counts(spark):
    many = "see license for details. " * 60 + "spdx-license-identifier: mpl-2.0"
    few = "see license for details. " * 60
    got = [r["score"] for r in license_scan.scan_licenses(spark.createDataFrame([(0, few), (1, many)], "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [1.0, 1.0]
    scan = license_scan.Scanner()
    assert len(scan.detections(many)) == 61 and {x[2].label for x in scan.detections(many)} == {"see-license", "mpl-2.0"}


def test_suppression_and_rules():
    rules = license_scan.build_rules()
    assert len(rules) > 300 and license_scan.tag_label("gpl-2.0-or-later") == "gpl-2.0" and [r.priority for r in rules] == sorted((r.priority for r in rules), reverse=True)
    for r in rules:
        assert r.keyword
    wide, narrow = (license_scan.Rule(n, p, 0.5, "k", None) for n, p in (("wide", 5), ("narrow", 9)))
    assert [x[2].label for x in license_scan.suppress([(0, 10, wide, 1), (2, 5, narrow, 0)])] == ["wide", "narrow"]
    assert [x[2].label for x in license_scan.suppress([(0, 10, narrow, 0), (2, 5, wide, 1)])] == ["narrow"]


def test_held_out_accuracy_on_the_tables(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in d.select("doc_id", "lang").collect()}
    got = [r for r in language_id.predicted_languages(d).collect() if r["held_out"] and truth[r["doc_id"]] and r["lang_pred"] != "und"]
    assert len(got) > 100 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) >= 0.97 * len(got)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = [r for r in quality.quality_scores(d, labels).collect() if r["held_out"] and marks.get(r["doc_id"]) is not None]
    assert len(got) > 20 and sum(r["predicted"] == marks[r["doc_id"]] for r in got) >= 0.9 * len(got)
