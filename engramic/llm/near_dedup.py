"""SimHash near-duplicate groups by segment bit counts.

A fingerprint's 64 bits are 32 segments of two bits; the bit counts of the segments embed it in a
grid whose Manhattan distance never exceeds the Hamming distance. Fingerprints within the radius
are therefore within it in the grid, and by the pigeonhole principle close in at least one group of
coordinates: a layout deals the segments into groups with a reach each, where the sum of
(reach + 1) exceeds the radius. The grid range join goes by equal cells: reach 0 joins equal cells,
reach 1 also sends each row up by one step in every coordinate, reach 2 sends both sides to all
cells one step away, so that they meet halfway. Of pairs that meet the Manhattan distance of all
segments is taken first, as the lower bound that it is; what it leaves is verified on the fingerprints.

The pipeline's stage (``keep_one``) has a contract of its own: a pair at 0.8 of the 5-word shingles
differs in about 10 of 64 bits, where chance pairs are too many. It takes 128-bit SimHash of the sets of
shingles, whose grid has 64 coordinates, and a radius of 28 bits. No groups of coordinates cover that
radius by the pigeonhole principle, so its range join goes by equal cells of drawn groups, whose
size follows the size of the table; Manhattan and Hamming distances are taken as above. What the draw
leaves out is brought together by MinHash bands beside it, and the whole shingle sets decide.

Defined results: null or empty texts and texts of white space have fingerprint 0 and link like any
other; equal fingerprints are one class; repeated rows share a class; rows with a null doc_id keep
their fingerprint and have the class of its smallest doc_id (null if none); an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, bit_votes, collect_garbage, mix64, pack_bits, popcount, record_batch, row_names, scratch, staged, text_slices, xxh64_spans
from .components import connected_components
from .hamming import UNIT_ROWS, equal_links, linked
from .passages import set_links, tuned_bands

SHINGLE_WORDS, RADIUS, SEED = 4, 4, 42
#: The pipeline's stage: exact Jaccard similarity of 5-word shingles; bands that bring pairs at it together.
SET_WORDS, SIMILARITY, RECALL, BAND_ROWS = 5, 0.8, 0.9995, 4
#: Bits of 128 that a pair at SIMILARITY hardly exceeds (19 on average); groups of coordinates that are
#: drawn, and the rows that chance alone brings to the cell of a row.
SET_RADIUS, SET_GROUPS, CELL_ROWS = 28, 48, 24
SEGMENTS = 32
#: (segments, reach) of each group.
COARSE = ((11, 1), (11, 1), (10, 0))
FINE = ((16, 2), (16, 1))


def simhash_fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp long): bit b is 1 if it is set in over half of the XXH64 values of the shingles."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            words = WordTable(texts)
            start, size, first = words.shingles(shingle_words)
            votes = bit_votes(xxh64_spans(words.joined, start, size, seed), first)
            fp = pack_bits(2 * votes > np.diff(first)[:, None])
            yield record_batch({"doc_id": batch.column("doc_id"), "fp": fp.view(np.int64)}, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """Bit counts (0 to 2) of the 32 two-bit segments."""
    shift = np.arange(SEGMENTS, dtype=np.uint64) * np.uint64(2)
    pair = (fp[:, None] >> shift) & np.uint64(3)
    return ((pair & np.uint64(1)) + (pair >> np.uint64(1))).astype(np.uint8)


_LOW = np.uint64(0x5555555555555555)


def packed_counts(fp: np.ndarray) -> np.ndarray:
    """The bit counts of all segments in one word, two bits each, of the first column of ``fp``."""
    x = fp[:, 0]
    return x - ((x >> np.uint64(1)) & _LOW)


def manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The Manhattan distance of packed bit counts. Counts 0, 1, 2 differ by one where the low bits of
    their two-bit fields differ, and by two where only the high ones do."""
    z = x ^ y
    low, high = z & _LOW, (z >> np.uint64(1)) & _LOW
    return popcount(low) + 2 * popcount(high & ~low)


def cell_keys(fp: np.ndarray, layout: tuple[tuple[int, int], ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(group, rows, cell keys, resident) of all rows that the layout sends to cells."""
    counts, at = segment_counts(fp).astype(np.uint64), 0
    everyone = np.arange(len(fp))
    for g, (n, reach) in enumerate(layout):
        own = counts[:, at : at + n]
        at += n
        weight = np.uint64(3) ** np.arange(n, dtype=np.uint64)
        cell = (own * weight).sum(axis=1, dtype=np.uint64)
        yield g, everyone, cell, True
        for k in range(n if reach else 0):
            up = np.flatnonzero(own[:, k] < 2)
            yield g, up, cell[up] + weight[k], reach == 2
            if reach == 2:
                down = np.flatnonzero(own[:, k] > 0)
                yield g, down, cell[down] - weight[k], True


def choose_layout(n: int) -> tuple[tuple[int, int], ...]:
    """The layout with the least expected work for n distinct fingerprints: rows sent, and pairs that
    chance alone brings together (both are exact; a row weighs about as much as 100 comparisons)."""

    def work(layout: tuple[tuple[int, int], ...]) -> float:
        total = 0.0
        for k, reach in layout:
            ball = 1 + (k * 4 / 3 if reach else 0) + (k * (k - 1) / 2 * 16 / 9 + k / 3 if reach == 2 else 0)
            total += 100.0 * n * (1 + (0.75 * k if reach else 0) * reach) + 0.5 * n * n * 0.375**k * ball
        return total

    return min((COARSE, FINE), key=work)


def fingerprint_links(reps: DataFrame, layout: tuple[tuple[int, int], ...], radius: int = RADIUS, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """Edges (u, v) between the ids of ``reps(fp, id)`` that connect all fingerprints within the radius."""
    if sum(reach + 1 for _, reach in layout) <= radius or sum(n for n, _ in layout) != SEGMENTS:
        raise ValueError("the groups' reaches do not cover the radius")
    schema = pa.schema([("key", pa.int64()), ("table", pa.int32()), ("id", pa.int64()), ("resident", pa.bool_()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, ids = batch.column("fp").to_numpy(), batch.column("id").to_numpy()
            for g, rows, cell, resident in cell_keys(fps.view(np.uint64), layout):
                n = len(rows)
                yield record_batch({"key": mix64(cell).view(np.int64), "table": np.full(n, g, np.int32), "id": ids[rows], "resident": np.full(n, resident), "fp": fps[rows]}, schema)

    return linked(reps.select("fp", "id").mapInArrow(run, "key long, table int, id long, resident boolean, fp long"), ["fp"], radius, unit_rows, packed_counts, manhattan)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle_words: int = SHINGLE_WORDS, layout: tuple[tuple[int, int], ...] | None = None, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp long, component_id (the smallest doc_id reachable by
    links of at most ``radius`` differing bits)."""
    with scratch(docs.sparkSession) as keep:
        fps = keep(staged(simhash_fingerprints(docs, shingle_words), "fingerprints"))
        reps = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("id")), "representatives")
        known = reps.where("id is not null")
        edges = fingerprint_links(known, layout or choose_layout(known.count()), radius, unit_rows)
        comps = staged(connected_components(edges), "components")
        named = keep(staged(reps.join(comps, reps.id == comps.node, "left").select("fp", F.coalesce("component", "id").alias("component_id")), "named"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


# ---------------------------------------------------------------- the pipeline's stage


def _sets_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Hashes of all 5-word shingles, the first of each text, each text's sorted distinct ones and the
    hash of that set (a text without words: no shingles and 0)."""
    words = WordTable(texts)
    start, size, first = words.shingles(SET_WORDS)
    h = xxh64_spans(words.joined, start, size, SEED)
    sets = [np.unique(h[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    whole = mix64(np.array([mix64(x).sum(dtype=np.uint64) for x in sets], np.uint64))
    whole[np.diff(first) == 0] = 0
    return h, first, sets, whole


def set_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """128-bit SimHash of sets of hashes, a row of two words each: bit b is 1 if it is set in over half."""
    size = np.array([len(x) for x in sets], np.int64)
    h, first = np.concatenate([np.zeros(0, np.uint64), *sets]), np.concatenate([[0], np.cumsum(size)])
    return np.stack([pack_bits(2 * bit_votes(w, first) > size[:, None]) for w in (h, mix64(h))], axis=1)


def drawn_groups(n: int, groups: int = SET_GROUPS) -> np.ndarray:
    """A row of coordinates for each group, of the 64 of a 128-bit fingerprint: so many that about ``CELL_ROWS``
    of n rows share a cell by chance, whose coordinates are equal with a chance of 3/8."""
    size = int(np.clip(np.ceil(np.log(max(n, 1) / CELL_ROWS) / np.log(8 / 3)), 4, 40))
    rng = np.random.default_rng(SEED)
    return np.stack([rng.choice(2 * SEGMENTS, size, replace=False) for _ in range(groups)])


def wide_counts(fp: np.ndarray) -> np.ndarray:
    """``packed_counts`` of every column of ``fp``."""
    return np.stack([packed_counts(fp[:, k : k + 1]) for k in range(fp.shape[1])], axis=1)


def wide_manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return manhattan(x, y).sum(axis=-1, dtype=np.int16)


def set_fingerprint_links(sets: DataFrame, radius: int = SET_RADIUS, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """Edges (u, v) between the ids of ``sets(id, f0, f1)`` that connect what is within the radius, of the
    fingerprints that share a cell of a drawn group."""
    groups = drawn_groups(sets.count())
    weight = np.uint64(3) ** np.arange(groups.shape[1], dtype=np.uint64)
    schema = pa.schema([("key", pa.int64()), ("table", pa.int32()), ("id", pa.int64()), ("resident", pa.bool_()), ("f0", pa.int64()), ("f1", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, words = batch.num_rows, {c: batch.column(c) for c in ("id", "f0", "f1")}
            counts = np.concatenate([segment_counts(words[c].to_numpy().view(np.uint64)) for c in ("f0", "f1")], axis=1)
            for g, own in enumerate(groups):
                cell = (counts[:, own] * weight).sum(axis=1, dtype=np.uint64)
                yield record_batch({"key": mix64(cell).view(np.int64), "table": np.full(n, g, np.int32), "resident": np.full(n, True), **words}, schema)

    rows = sets.select("id", "f0", "f1").mapInArrow(run, "key long, table int, id long, resident boolean, f0 long, f1 long")
    return linked(rows, ["f0", "f1"], radius, unit_rows, wide_counts, wide_manhattan)


def shingle_signatures(docs: DataFrame, bands: int, band_rows: int = BAND_ROWS) -> DataFrame:
    """(doc_id, text_hash, row_hash, set_hash, f0, f1, bands) of ``docs(doc_id, text, text_hash, row_hash)``:
    the hash of the set of 5-word shingles, its SimHash and its MinHash band keys."""
    keep = ("doc_id", "text_hash", "row_hash")
    schema = pa.schema([(c, pa.int64()) for c in (*keep, "set_hash", "f0", "f1")] + [("bands", pa.list_(pa.int64()))])
    rng = np.random.default_rng(SEED)
    salt = rng.integers(0, 2**63, bands * band_rows, dtype=np.uint64)
    odd = rng.integers(0, 2**63, bands * band_rows, dtype=np.uint64) | np.uint64(1)

    def signed(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        h, first, sets, whole = _sets_of(texts)
        fp = set_fingerprints(sets).view(np.int64)
        some = np.flatnonzero(np.diff(first))
        keys = np.zeros((len(some), bands), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(bands * band_rows if len(some) else 0):
                least = np.minimum.reduceat((h ^ salt[k]) * odd[k], first[some])
                keys[:, k // band_rows] = mix64(keys[:, k // band_rows] ^ least)
            keys = mix64(keys ^ np.arange(1, bands + 1, dtype=np.uint64))
        ends = np.concatenate([[0], np.cumsum(np.where(np.diff(first) > 0, bands, 0))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64).ravel()))
        return record_batch({c: batch.column(c) for c in keep} | {"set_hash": whole.view(np.int64), "f0": fp[:, 0], "f1": fp[:, 1], "bands": lists}, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            yield signed(batch, texts)

    return docs.mapInArrow(run, "doc_id long, text_hash long, row_hash long, set_hash long, f0 long, f1 long, bands array<long>")


def first_copies(named: DataFrame, threshold: float = SIMILARITY, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """(doc_id, text_hash, row_hash): of each component of documents that are linked by a Jaccard
    similarity of their 5-word shingles at or above the threshold, the row with the smallest doc_id
    (then the smallest hashes).

    Equal sets are one; sets whose fingerprints are linked or that collide in a band are gathered, and only
    their documents are read again for the exact similarities.
    """
    docs = named.select("doc_id", "text", "text_hash", "row_hash").where("doc_id is not null")
    schema = pa.schema([("key", pa.int64()), ("table", pa.int32()), ("id", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            _, _, sets, whole = _sets_of(texts)
            yield record_batch({"key": batch.column("component"), "table": np.zeros(len(texts), np.int32), "id": whole.view(np.int64), "shingles": [x.tobytes() for x in sets]}, schema)

    head = F.struct("doc_id", "text_hash", "row_hash")
    with scratch(docs.sparkSession) as keep:
        signed = shingle_signatures(docs, tuned_bands(threshold, RECALL, BAND_ROWS))
        sets = staged(signed.groupBy("set_hash").agg(F.min(head).alias("head"), *[F.first(c).alias(c) for c in ("f0", "f1", "bands")]), "sets")
        # texts without words are one set
        near = staged(set_fingerprint_links(sets.where("set_hash <> 0").select(F.col("set_hash").alias("id"), "f0", "f1"), unit_rows=unit_rows), "near")
        rows = sets.select("set_hash", F.posexplode("bands").alias("table", "key")).select("key", "table", F.col("set_hash").alias("id"))
        coarse = staged(connected_components(near.unionByName(equal_links(rows, unit_rows))), "coarse")
        collect_garbage(docs.sparkSession)
        # neither side of these joins has a bound: they are merged, not broadcast, at any size
        where = sets.select("set_hash", "head").join(coarse.hint("merge"), F.col("set_hash") == F.col("node")).select("head.*", "component")
        texts = docs.join(where.hint("merge"), ["doc_id", "text_hash", "row_hash"]).select("component", "text")
        groups = staged(texts.mapInArrow(run, "key long, table int, id long, shingles binary").dropDuplicates(["id"]), "collided")
        comps = staged(connected_components(set_links(groups, threshold, unit_rows, "<u8")), "components")
        grouped = sets.select("set_hash", "head").join(comps.hint("merge"), F.col("set_hash") == F.col("node"), "left")
        return keep(staged(grouped.groupBy(F.coalesce("component", "set_hash").alias("class")).agg(F.min("head").alias("head")).select("head.*"), "heads"))


def keep_one(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one with the smallest doc_id; groups
    are those of ``first_copies``. Rows that repeat a doc_id are documents of their own by their texts
    (rows equal in all columns count as one). Rows with a null doc_id stay. Columns of any name
    travel along."""
    named = row_names(docs)
    heads = first_copies(named, threshold)
    on = ["doc_id", "text_hash", "row_hash"]
    kept = named.drop("text").join(heads.hint("merge"), on, "left_semi").dropDuplicates(on)
    return kept.unionByName(named.drop("text").where("doc_id is null")).select("row.*")
