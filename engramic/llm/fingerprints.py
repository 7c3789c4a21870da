"""Document fingerprints: 128-bit SimHash with weighted terms, and permuted block tables.

Terms are the words of at least four bytes (weight 1) and the pairs of neighbouring words (weight
2), A-Z lower-cased, each occurrence voting; a text of one word has the word as its pair. The
likeness of two fingerprints is the cosine that their differing bits estimate, max(0, cos(pi * d /
128)), and 1 for two without terms.

Defined results: a null text counts as empty; a text without words has the all-zero fingerprint;
equal texts have equal fingerprints; repeated rows each give a row; documents of equal doc_id stand
in descending order of their text; documents without doc_id stand outside the order, and the first
document is the next of each; in a table of one document it is its own next; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, bit_votes, mix64, pack_bits, popcount, range_of, range_splits, record_batch, spread, staged, xxh64_spans
from .components import connected_components
from .hamming import UNIT_ROWS, linked

BITS, RADIUS, LONG_WORD = 128, 6, 4
WORD_WEIGHT, PAIR_WEIGHT = 1, 2
_SECOND = np.uint64(0xA0761D6478BD642F)


def fingerprints_of(texts: list[bytes]) -> np.ndarray:
    """A row of two 64-bit words for each text."""
    w = WordTable(texts)
    n = np.diff(w.first)
    h = xxh64_spans(w.joined, w.start, w.size, seed=0)
    doc = np.repeat(np.arange(len(n)), n)
    long_word = w.size >= LONG_WORD
    first_long = np.concatenate([[0], np.cumsum(np.bincount(doc[long_word], minlength=len(n)))])
    pairs = np.where(n > 1, n - 1, n)
    first_pair = np.concatenate([[0], np.cumsum(pairs)])
    left = np.arange(first_pair[-1]) - np.repeat(first_pair[:-1] - w.first[:-1], pairs)
    right = np.where(np.repeat(n, pairs) > 1, left + 1, left)
    with np.errstate(over="ignore"):
        pair = mix64(h[left] * np.uint64(3) + ((h[right] << np.uint64(17)) | (h[right] >> np.uint64(47))))
    total = WORD_WEIGHT * np.diff(first_long) + PAIR_WEIGHT * pairs
    out = np.empty((len(n), 2), np.uint64)
    for k, salt in enumerate((np.uint64(0), _SECOND)):
        words = h[long_word] if k == 0 else mix64(h[long_word] ^ salt)
        twos = pair if k == 0 else mix64(pair ^ salt)
        votes = WORD_WEIGHT * bit_votes(words, first_long) + PAIR_WEIGHT * bit_votes(twos, first_pair)
        out[:, k] = pack_bits(2 * votes > total[:, None])
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = popcount(a ^ b).sum(axis=1)
    return np.where(d == 0, 1.0, np.maximum(0.0, np.cos(np.pi * d / BITS)))


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many first code points of ``following`` (or all)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string())]
    + [(c, pa.int64()) for c in ("f0", "f1", "e0", "e1")]
    + [("near_edited", pa.float64()), ("near_next", pa.float64())]
)
_DDL = "doc_id long, n_chars long, edited_sha256 string, f0 long, f1 long, e0 long, e1 long, near_edited double, near_next double"
_SLICE_CHARS = 2_000_000


def _compare(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    texts, nexts = [t for _, t, _ in rows], [x for _, _, x in rows]
    made = [edited(t, x).encode() for t, x in zip(texts, nexts, strict=True)]
    own, changed, after = fingerprints_of([t.encode() for t in texts]), fingerprints_of(made), fingerprints_of([nexts[-1].encode()])
    # in a slice the next document of most rows is the row below
    step = [i + 1 if i + 1 < len(rows) and nexts[i] is texts[i + 1] else -1 for i in range(len(rows))]
    other = np.stack([own[j] if j >= 0 else after[0] if i + 1 == len(rows) else fingerprints_of([nexts[i].encode()])[0] for i, j in enumerate(step)])
    signed = lambda x, k: x[:, k].copy().view(np.int64)
    return record_batch(
        {"doc_id": [i for i, _, _ in rows], "n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(m).hexdigest() for m in made], "f0": signed(own, 0), "f1": signed(own, 1), "e0": signed(changed, 0), "e1": signed(changed, 1), "near_edited": likeness(own, changed), "near_next": likeness(own, other)},
        _SCHEMA,
    )


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of documents, then the guest (the first document of the range below), then
    those without doc_id: each but the guest is compared with the next."""
    rows: list[tuple[int | None, str, str]] = []
    size, last, guest = 0, None, ""
    for batch in batches:
        for kind, doc_id, text in zip(batch.column("kind").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            text = text or ""
            if last is not None:
                rows.append((*last, text))
                size += len(last[1])
                last = None
            if kind == 0:
                last = (doc_id, text)
            elif kind == 1:
                guest = text
            else:
                rows.append((None, text, guest))
                size += len(text)
            if size >= _SLICE_CHARS:
                yield _compare(rows)
                rows, size = [], 0
    if last is not None:
        rows.append((*last, ""))
    if rows:
        yield _compare(rows)


def with_next_document(docs: DataFrame) -> DataFrame:
    """(bucket, kind, doc_id, text): ranges of doc_id, each with the first document of the next lower
    range as its guest (below the lowest: the first of all). One exchange of the texts."""
    spark, n = docs.sparkSession, spread(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    splits = range_splits(docs, "doc_id", n)
    bucket = range_of(F.col("doc_id"), splits)
    tops = {r["b"]: r["top"] for r in docs.where("doc_id is not null").groupBy(bucket.alias("b")).agg(F.max("doc_id").alias("top")).collect()}
    placed = docs.select(bucket.alias("bucket"), F.when(F.col("doc_id").isNull(), 2).otherwise(0).alias("kind"), "doc_id", "text")
    if tops:  # as many rows as there are ranges at most
        order = sorted(tops)
        guests = {b: tops[order[i - 1]] for i, b in enumerate(order) if i} | {order[0]: tops[order[-1]], 0: tops[order[-1]]}
        where = spark.createDataFrame(list(guests.items()), "bucket int, doc_id long")
        texts = docs.where(F.col("doc_id").isin(sorted(set(guests.values())))).groupBy("doc_id").agg(F.max("text").alias("text"))
        placed = placed.unionByName(texts.join(F.broadcast(where), "doc_id").select("bucket", F.lit(1).alias("kind"), "doc_id", "text"))
    return placed.repartitionById(n, F.pmod(F.col("bucket"), F.lit(n)).cast("int")).sortWithinPartitions("bucket", "kind", F.desc("doc_id"), F.desc("text"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """For each document: doc_id, n_chars, edited_sha256, its fingerprint (f0, f1), that of its edited
    text (e0, e1), near_edited and near_next."""
    return with_next_document(docs).mapInArrow(_with_next, _DDL)


def block_layout(n: int, radius: int = RADIUS) -> tuple[int, int]:
    """(blocks, key blocks): the tables for the least expected work over n fingerprints. A table for
    each choice of key blocks among ``blocks`` = radius + key blocks finds every pair in the radius."""
    work = lambda lead: len(list(itertools.combinations(range(radius + lead), lead))) * (100.0 * n + 0.5 * n * n / 2.0 ** (BITS // (radius + lead) * lead))
    lead = min((1, 2, 3), key=work)
    return radius + lead, lead


def block_rows(fps: DataFrame, blocks: int, lead: int) -> DataFrame:
    """Rows of the permuted tables of ``fps(f0, f1, id)``: table t has the t-th choice of ``lead`` of
    the ``blocks`` blocks in front, as its key."""
    edge = [BITS * i // blocks for i in range(blocks + 1)]
    schema = pa.schema([("key", pa.int64()), ("table", pa.int32()), ("id", pa.int64()), ("resident", pa.bool_()), ("f0", pa.int64()), ("f1", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word = [batch.column(c).to_numpy().view(np.uint64) for c in ("f0", "f1")]
            for t, chosen in enumerate(itertools.combinations(range(blocks), lead)):
                mask = sum(((1 << (edge[b + 1] - edge[b])) - 1) << edge[b] for b in chosen)
                key = mix64(mix64(word[0] & np.uint64(mask & (2**64 - 1))) ^ (word[1] & np.uint64(mask >> 64)))
                n = len(key)
                yield record_batch({"key": key.view(np.int64), "table": np.full(n, t, np.int32), "id": batch.column("id"), "resident": np.ones(n, bool), "f0": batch.column("f0"), "f1": batch.column("f1")}, schema)

    return fps.select("f0", "f1", "id").mapInArrow(run, "key long, table int, id long, resident boolean, f0 long, f1 long")


def near_classes(fps: DataFrame, radius: int = RADIUS, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """(f0, f1, class_id) for each distinct fingerprint of ``fps(doc_id, f0, f1)``: the smallest doc_id
    reachable by links of at most ``radius`` bits."""
    reps = staged(fps.groupBy("f0", "f1").agg(F.min("doc_id").alias("id")), "blocks")
    known = reps.where("id is not null")
    rows = block_rows(known, *block_layout(known.count(), radius))
    comps = staged(connected_components(linked(rows, ["f0", "f1"], radius, unit_rows)), "components")
    return staged(reps.join(comps, reps.id == comps.node, "left").select("f0", "f1", F.coalesce("component", "id").alias("class_id")), "classes")


def fingerprint_classes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fingerprint_documents`` with the near-duplicate class of each document's fingerprint."""
    fps = staged(fingerprint_documents(docs), "fingerprints")
    return fps.join(near_classes(fps, radius), ["f0", "f1"])


def hex_of(a: str, b: str):
    return F.lower(F.concat(F.lpad(F.hex(F.col(a)), 16, "0"), F.lpad(F.hex(F.col(b)), 16, "0")))
