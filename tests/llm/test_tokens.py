from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from engramic.llm import token_index
from engramic.llm.queries import tokenizer_path

ODD = ["<|endoftext|> a<|x", "ﬁne Ångström", "日本語 text İstanbul", "á b", "''s don't 'LL \x0b x\x1cy", "", "  ", "µ ª º × ÷ ²", "a b\xa0c", "Σίσυφος", "x_y-z 12.5% it's"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name, rows):
    e = token_index.Encoder(tokenizer_path(name))
    texts = ODD + [t or "" for _, t, *_ in rows]
    want = [x.ids for x in e.tok.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, e.dtype).tolist() for b in e(texts)] == want
    forgetful = token_index.Encoder(tokenizer_path(name), 20)
    for _ in range(3):
        assert [np.frombuffer(b, e.dtype).tolist() for b in forgetful(texts)] == want
    assert e.counts(texts) == [len(x) for x in want]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 500])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).choice(2**40, n, replace=False).astype(np.uint64)
    shift, slots = token_index.build_mph(keys)
    assert sorted(slots.tolist()) == list(range(n))
    stored = np.empty(n, np.uint64)
    stored[slots] = token_index.mix64(keys)
    assert token_index.find_slots(keys, shift, stored).tolist() == slots.tolist()
    foreign = np.arange(2**41, 2**41 + 50, dtype=np.uint64)
    assert (token_index.find_slots(foreign, shift, stored) == -1).all()


def test_round_trip(spark, docs, rows):
    root, manifest = token_index.write_tokens(docs, tokenizer_path(), shards=3)
    got = token_index.read_tokens(spark, root, with_ids=True).collect()
    e = token_index.Encoder(tokenizer_path())
    order = sorted(((i, t or "") for i, t, *_ in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    start, want = 0, []
    for i, t in order:
        ids = e._ids(t) + [token_index.END_ID]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    keys = spark.createDataFrame([(5,), (3,), (999,), (None,)], "doc_id long")
    found = {r["doc_id"]: r["ids"] for r in token_index.lookup_tokens(spark, root, keys).collect()}
    assert found == {i: ids for i, _, _, _, ids in want if i in (3, 5)}
    assert manifest.agg({"n_docs": "sum"}).first()[0] == len(rows)


def test_empty(spark, nothing):
    root, _ = token_index.write_tokens(nothing, tokenizer_path(), shards=2)
    assert token_index.read_tokens(spark, root).count() == 0
    assert token_index.lookup_tokens(spark, root, spark.createDataFrame([(1,)], "doc_id long")).count() == 0


def test_a_lookup_reads_a_bounded_number_of_bytes(spark, docs):
    more = spark.range(1000, 9000).selectExpr("id as doc_id", "concat('word ', repeat('more words ', 40), id) as text")
    root, _ = token_index.write_tokens(docs.select("doc_id", "text").union(more), tokenizer_path(), shards=1)
    s = token_index.Shard(root, 0)
    e = token_index.Encoder(tokenizer_path())
    for key in (1000, 4321, 8999):
        before = s.bytes_read
        assert s[key].tolist() == [*e._ids("word " + "more words " * 40 + str(key)), token_index.END_ID]
        assert s.bytes_read - before <= 24 + 4 * len(s[key])
    with pytest.raises(KeyError):
        s[123456]


def test_random_strings_equal_the_library():
    rng = random.Random(6)
    alphabet = "abzAZ09 \t\n\r'\x0b\x1c\x85\xa0éÉßİıſΣς日語<|>_-.,!?\u2019\u200b\ufeff¼²ºª"
    e = token_index.Encoder(tokenizer_path())
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(3000)]
    assert [np.frombuffer(b, e.dtype).tolist() for b in e(texts)] == [x.ids for x in e.tok.encode_batch(texts, add_special_tokens=False)]
