"""Repeated passages: paragraph MinHash banding, exact verification, removals by component.

Two kinds of paragraphs of a document's words (A-Z lower-cased, split at the six ASCII white-space
bytes) are compared. Lines of at least ``MIN_WORDS`` words get MinHash signatures over their 5-word
shingles; the bands are tuned so that a pair at the threshold collides with ``RECALL`` probability,
colliding lines are gathered, and their exact Jaccard similarities decide. Passages that stand inside
other text have no line of their own: words that are least by hash in a run of ``ANCHOR_RUN``
neighbours start a window of ``WINDOW_WORDS`` words, which depend on the words around them only. By
their sizes every passage of 51 words or more holds a whole window wherever it stands; equal windows
collide in one band over the whole of it, at every place of every document. Of each class of units
the first document keeps the text. Runs of overlapping units that an earlier document has are spans;
the windows at their ends are compared word by word with the place that is kept, so that a span
reaches as far as the repetition does, and spans of fewer than ``MIN_SPAN`` words are let go. Spans
that share a unit class are one component, and the words of those that are not kept are removed.

Words beyond a window are compared by 16 bits of their hashes, so one end in 65,536 may reach a word
too far.

Defined results: a null or empty text has no units; documents without doc_id take no part and stay as
they are; rows that repeat a doc_id are one document when repetitions are looked for, and each is cut
by its own text; a repetition inside one document alone is left; of documents with one passage the
smallest doc_id keeps it; very long texts are read whole; an empty table gives an empty result;
columns of any name travel along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordTable, collect_garbage, mix64, record_batch, row_names, scratch, spread, staged, text_slices, xxh64_spans
from .components import connected_components, local_forest
from .hamming import BROADCAST_ROWS, UNIT_ROWS, _whole_runs, equal_links, hot_keys

SHINGLE_WORDS, THRESHOLD, RECALL, MIN_WORDS = 5, 0.8, 0.998, 50
#: The least words of a span: passages of over 50 words, of which marks that stand at a word without a
#: space between may hide a few at either end.
MIN_SPAN = 45
#: ANCHOR_RUN + ANCHOR_WORDS - 1 + WINDOW_WORDS = 51.
ANCHOR_RUN, ANCHOR_WORDS, WINDOW_WORDS = 23, 2, 27
#: Words beyond a span's first and last window that can belong to it: with one more there would be an anchor.
REACH = ANCHOR_RUN + ANCHOR_WORDS - 2
BAND_ROWS, SEED = 3, 11
#: An odd base, and its inverse modulo 2 to the 64th.
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
#: The sets of pivots are broadcast up to so many bytes.
PIVOT_BYTES = 8 << 20
#: The kinds of rows that documents give: lines, windows, and the tags of all their words.
LINE, WINDOW, TAGS = 0, 1, 2
#: The column of a row's cuts, found by its place; no other has this name.
_CUT = "\x00cut"


def tuned_bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = BAND_ROWS) -> int:
    """The fewest bands of ``rows`` values that bring a pair at the threshold together with that recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n + 1, base, np.uint64)
    p[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(p)


class Rolling:
    """Hashes of runs of words by prefix sums: the polynomial of their hashes, wherever they stand."""

    def __init__(self, h: np.ndarray):
        self.n, self.back = len(h), _powers(_INVERSE, len(h))
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(_ODD, self.n)[: self.n], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[start]) * self.back[start])


def anchors(h: np.ndarray, doc: np.ndarray, run: int = ANCHOR_RUN) -> np.ndarray:
    """Ascending places that have the least hash (then the least place) of some ``run`` neighbours in
    their document."""
    if len(h) < run:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 28) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while width < run:
        step = min(width, run - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    inside = doc[: len(least)] == doc[run - 1 :]
    return np.unique((least[inside] & low).astype(np.int64))


_UNITS = "kind int, unit_hash long, doc_id long, text_hash long, start int, n_words int, more array<int>, bands array<long>, payload binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("unit_hash", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()), ("n_words", pa.int32()), ("more", pa.list_(pa.int32())), ("bands", pa.list_(pa.int64())), ("payload", pa.binary())])


def _once(keys: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(places of the first of each key, in order; for each of them the other starts of its key or null)."""
    _, first, group, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    other = np.ones(len(keys), bool)
    other[first] = False
    rest = np.flatnonzero(other)
    rest = rest[np.argsort(rank[group[rest]], kind="stable")]
    number = np.zeros(len(first), np.int64)
    number[rank] = count - 1
    ends = pa.array(np.concatenate([[0], np.cumsum(number)]).astype(np.int32))
    return np.sort(first), pa.ListArray.from_arrays(ends, pa.array(starts[rest].astype(np.int32)), mask=pa.array(number == 0))


def paragraph_units(docs: DataFrame, bands: int, band_rows: int = BAND_ROWS, min_words: int = MIN_WORDS) -> DataFrame:
    """Lines with their band keys, windows (once for each document, with the places of their repetitions
    in it), and for each document with a window the 16-bit tags of its words."""
    rng = np.random.default_rng(SEED)
    salt = rng.integers(0, 2**63, bands * band_rows, dtype=np.uint64)
    odd = rng.integers(0, 2**63, bands * band_rows, dtype=np.uint64) | np.uint64(1)

    def lines_of(texts: list[bytes], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) in the slice's words of all lines that are long enough."""
        counts = [[len(x.split()) for x in t.split(b"\n")] if len(t) > 2 * min_words - 2 else [] for t in texts]
        number = np.array([len(c) for c in counts])
        size = np.array([n for c in counts for n in c], np.int64)
        before = np.cumsum(size) - size
        base = np.concatenate([[0], np.cumsum([sum(c) for c in counts])])[:-1]
        start = before + np.repeat(first[:-1] - base, number)
        keep = size >= min_words
        return start[keep], start[keep] + size[keep]

    def windows_of(roll: Rolling, w: WordTable, doc: np.ndarray) -> np.ndarray:
        n = roll.n
        two = roll.of(np.arange(n - ANCHOR_WORDS + 1), np.arange(ANCHOR_WORDS, n + 1)) if n >= ANCHOR_WORDS else np.zeros(0, np.uint64)
        at = anchors(two, doc[: len(two)])
        return at[at + WINDOW_WORDS <= w.first[doc[at] + 1]]

    def units(batch: pa.RecordBatch, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        w = WordTable(texts)
        if not len(w.start):
            return
        ids, named = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_hash"))
        words = xxh64_spans(w.joined, w.start, w.size, 0)
        roll, doc = Rolling(words), np.repeat(np.arange(len(texts)), np.diff(w.first))
        place = lambda at: {"doc_id": ids[doc[at]], "text_hash": named[doc[at]], "start": (at - w.first[doc[at]]).astype(np.int32)}
        at = windows_of(roll, w, doc)
        if len(at):
            h = roll.of(at, at + WINDOW_WORDS)
            first, more = _once(mix64(h ^ mix64(doc[at].astype(np.uint64))), at - w.first[doc[at]])
            at, h, k = at[first], h[first], len(first)
            yield record_batch({"kind": np.full(k, WINDOW, np.int32), "unit_hash": h.view(np.int64), **place(at), "n_words": np.full(k, WINDOW_WORDS, np.int32), "more": more, "bands": pa.nulls(k, pa.list_(pa.int64())), "payload": pa.nulls(k, pa.binary())}, _SCHEMA)
            some, tags = np.unique(doc[at]), (words >> np.uint64(48)).astype("<u2")
            k = len(some)
            own = [tags[w.first[d] : w.first[d + 1]].tobytes() for d in some.tolist()]
            yield record_batch({"kind": np.full(k, TAGS, np.int32), "unit_hash": np.zeros(k, np.int64), **place(w.first[some]), "n_words": np.diff(w.first)[some].astype(np.int32), "more": pa.nulls(k, pa.list_(pa.int32())), "bands": pa.nulls(k, pa.list_(pa.int64())), "payload": own}, _SCHEMA)
        a, b = lines_of(texts, w.first)
        if not len(a):
            return
        number = np.maximum(b - a - SHINGLE_WORDS + 1, 1)
        begin = np.cumsum(number) - number
        s = np.arange(number.sum()) - np.repeat(begin - a, number)
        sh = roll.of(s, np.minimum(s + SHINGLE_WORDS, np.repeat(b, number)))
        keys = np.zeros((len(a), bands), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(bands * band_rows):
                least = np.minimum.reduceat((sh ^ salt[k]) * odd[k], begin)
                keys[:, k // band_rows] = mix64(keys[:, k // band_rows] ^ least)
            keys = mix64(keys ^ np.arange(1, bands + 1, dtype=np.uint64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(a) * bands + 1, bands, dtype=np.int32)), pa.array(keys.view(np.int64).ravel()))
        yield record_batch({"kind": np.full(len(a), LINE, np.int32), "unit_hash": roll.of(a, b).view(np.int64), **place(a), "n_words": (b - a).astype(np.int32), "more": pa.nulls(len(a), pa.list_(pa.int32())), "bands": lists, "payload": pa.nulls(len(a), pa.binary())}, _SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            yield from units(batch, texts)

    return _known(docs).mapInArrow(run, _UNITS)


def _known(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").where("doc_id is not null")


def jaccard_search(sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of sets at or above the threshold; sets are sorted arrays."""
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    begin = np.cumsum(size) - size
    left, a, b = np.arange(len(sets)), [], []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            # a pair's similarity is at most the ratio of its sizes
            fit = left[(size[left] >= threshold * size[i] - 1e-9) & (threshold * size[left] <= size[i] + 1e-9)]
            if not len(fit):
                continue
            at = np.arange(size[fit].sum()) + np.repeat(begin[fit] - (np.cumsum(size[fit]) - size[fit]), size[fit])
            own, place = sets[i], np.searchsorted(sets[i], flat[at])
            same = own[np.minimum(place, len(own) - 1)] == flat[at]
            shared = np.add.reduceat(same, np.cumsum(size[fit]) - size[fit])
            hit = fit[shared >= threshold * (size[i] + size[fit] - shared) - 1e-9]
            if len(hit):
                a.append(np.full(len(hit), i))
                b.append(hit)
                queue += hit.tolist()
                left = np.setdiff1d(left, hit, assume_unique=True)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


#: Rounds in which the rows of a hot key are compared with one of them before they meet in chunks.
PIVOTS = 3


def set_links(groups: DataFrame, threshold: float, unit_rows: int = UNIT_ROWS, width: str = "<u8") -> DataFrame:
    """Edges (u, v) that connect all pairs of ``groups(key, table, id, shingles)`` of one key at or above
    the threshold; shingles: sorted hashes of that width.

    A key of more than ``unit_rows`` rows is first compared with its least row, and what is not similar
    to that with its own least row, ``PIVOTS`` times: rows similar to one pivot are linked by it and
    need not meet. The rest goes in chunks: pairs of chunks meet but for those of one pivot, so a large
    group of near copies is linear in its rows, and no pair that the pivots leave open is lost.
    """
    hot = hot_keys(groups, unit_rows)
    n = hot.count()
    if not n:
        return _unit_links(groups.withColumn("unit", F.lit(0).cast("long")), threshold, width)
    few = hot.select("key", "table")
    few = F.broadcast(few) if n <= BROADCAST_ROWS else few
    cold = groups.join(few, ["key", "table"], "left_anti").withColumn("unit", F.lit(0).cast("long"))
    names = ["key", "table", "id", "shingles"]
    rows = staged(groups.join(few, ["key", "table"]).select(*names, F.lit(None).cast("long").alias("pivot")), "hot-sets")
    for _ in range(PIVOTS):
        rows = staged(_near_pivots(rows, threshold, width), "hot-sets")
    # chunks are numbered by key, those of a pivot next to each other
    sizes = rows.groupBy("key", "table", "pivot").agg(F.ceil(F.count(F.lit(1)) / F.lit(unit_rows)).cast("long").alias("c"))
    by_key = Window.partitionBy("key", "table")
    first = F.coalesce(F.sum("c").over(by_key.orderBy(F.col("pivot").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    sizes = sizes.select(F.col("key").alias("k"), F.col("table").alias("t"), F.col("pivot").alias("p"), "c", first.alias("first"), F.sum("c").over(by_key).alias("all"))
    dealt = rows.join(sizes, (F.col("key") == F.col("k")) & (F.col("table") == F.col("t")) & F.col("pivot").eqNullSafe(F.col("p")))
    own = F.col("first") + F.pmod(F.xxhash64("key", "id"), F.col("c"))
    other = F.filter(F.sequence(F.lit(0).cast("long"), F.col("all") - 1), lambda o: F.col("pivot").isNull() | (o < F.col("first")) | (o >= F.col("first") + F.col("c")))
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(other))
    dealt = dealt.withColumn("unit", F.least("own", "other") * F.col("all") + F.greatest("own", "other")).select(*names, "unit")
    stars = rows.where("pivot is not null and pivot <> id").select(F.col("id").alias("u"), F.col("pivot").alias("v"))
    return _unit_links(cold.select(*names, "unit").unionByName(dealt), threshold, width).unionByName(stars)


def _near_pivots(rows: DataFrame, threshold: float, width: str) -> DataFrame:
    """``rows`` with the pivot of those that had none and are similar to the least such row of their key."""
    names = ["key", "table", "id", "shingles"]
    least = rows.where("pivot is null").groupBy("key", "table").agg(F.min_by(F.struct("id", "shingles"), "id").alias("l"))
    least = staged(least.select("key", "table", F.col("l.id").alias("least"), F.col("l.shingles").alias("set")), "pivots")  # a row for each hot key
    size = least.agg(F.sum(F.length("set"))).first()[0] or 0
    free = rows.where("pivot is null").select(*names).join(F.broadcast(least) if size <= PIVOT_BYTES else least, ["key", "table"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two, ids = batch.column("shingles").to_pylist(), batch.column("set").to_pylist(), batch.column("least").to_pylist()
            pivot = []
            for x, y, i in zip(one, two, ids, strict=True):
                x, y = np.frombuffer(x, width), np.frombuffer(y, width)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                pivot.append(i if shared >= threshold * (len(x) + len(y) - shared) - 1e-9 else None)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(pivot, pa.int64())], names=[*names, "pivot"])

    return rows.where("pivot is not null").unionByName(free.mapInArrow(run, "key long, table int, id long, shingles binary, pivot long"))


def _unit_links(rows: DataFrame, threshold: float, width: str) -> DataFrame:
    """Edges of ``rows(key, table, id, shingles, unit)`` within each unit of a key."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_runs(batches):
            key, unit, ids = (t.column(c).to_numpy() for c in ("key", "unit", "id"))
            sets = [np.frombuffer(x, width) for x in t.column("shingles").to_pylist()]
            cut = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (unit[1:] != unit[:-1])) + 1).tolist(), len(key)]
            u, v = [], []
            for lo, hi in zip(cut, cut[1:], strict=False):
                i, j = jaccard_search(sets[lo:hi], threshold)
                u.append(ids[lo + i])
                v.append(ids[lo + j])
            if sum(map(len, u)):
                one, two = local_forest(np.concatenate(u), np.concatenate(v))
                yield record_batch({"u": one, "v": two}, schema)

    dealt = rows.repartition(spread(rows.sparkSession), "key", "table", "unit").sortWithinPartitions("key", "table", "unit")
    return dealt.mapInArrow(run, "u long, v long")


def line_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, table, id, shingles) of the lines of ``wanted(doc_id, text_hash, start, n_words, id, key)``: the
    sorted hashes of their shingles, from the texts, which are read again for them."""
    schema = pa.schema([("key", pa.int64()), ("table", pa.int32()), ("id", pa.int64()), ("shingles", pa.binary())])
    line = F.struct("start", "n_words", "id", "key")
    by_text = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list(line).alias("lines"))  # no more than a document has
    texts = _known(docs).join(by_text.hint("merge"), ["doc_id", "text_hash"]).select("text", "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            w = WordTable(texts)
            roll, out = Rolling(xxh64_spans(w.joined, w.start, w.size, 0)), {c: [] for c in schema.names}
            for base, lines in zip(w.first.tolist(), batch.column("lines").to_pylist(), strict=False):
                for x in lines:
                    a, n = base + x["start"], x["n_words"]
                    s = np.arange(a, a + max(n - SHINGLE_WORDS + 1, 1))
                    sets = np.unique(roll.of(s, np.minimum(s + SHINGLE_WORDS, a + n))).astype("<u8").tobytes()
                    for c, v in zip(schema.names, (x["key"], 0, x["id"], sets), strict=True):
                        out[c].append(v)
            yield record_batch(out, schema)

    return texts.mapInArrow(run, "key long, table int, id long, shingles binary").dropDuplicates(["id"])


def line_classes(docs: DataFrame, lines: DataFrame, threshold: float = THRESHOLD, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """(unit_hash, class) of the lines that have a near duplicate of other text: class is the smallest
    unit_hash of their component of verified pairs."""
    distinct = staged(lines.select("unit_hash", "bands").dropDuplicates(["unit_hash"]), "lines")
    rows = distinct.select("unit_hash", F.posexplode("bands").alias("table", "key")).select("key", "table", F.col("unit_hash").alias("id"))
    # colliding lines as one coarse group each: a line then carries its shingles once, not by band
    coarse = staged(connected_components(equal_links(rows, unit_rows)), "coarse")
    collect_garbage(lines.sparkSession)
    place = lines.select("doc_id", "text_hash", "start", "n_words", F.col("unit_hash").alias("node")).join(coarse.hint("merge"), "node")
    first = place.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash", "start", "n_words")).alias("p"), F.min("component").alias("key"))
    groups = staged(line_sets(docs, first.select("p.*", F.col("node").alias("id"), "key")), "collided")
    links = set_links(groups, threshold, unit_rows)
    return connected_components(links).select(F.col("node").alias("unit_hash"), F.col("component").alias("class"))


_PLACE = ["doc_id", "text_hash", "start"]


def repeated_units(docs: DataFrame, units: DataFrame, threshold: float = THRESHOLD, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """(doc_id, text_hash, start, n_words, kind, class, first_doc): every place of the ``units`` of ``docs`` that
    lie in two documents or more."""
    with scratch(units.sparkSession) as keep:
        lines = units.where(F.col("kind") == LINE)
        classes = staged(line_classes(docs, lines, threshold, unit_rows), "classes")
        place = [*_PLACE, "n_words", "kind", "more"]
        # neither side of these joins has a bound: they are merged, not broadcast, at any size
        named = lines.select("unit_hash", *place).join(classes.hint("merge"), "unit_hash", "left").select(F.coalesce("class", "unit_hash").alias("class"), *place)
        every = named.unionByName(units.where(F.col("kind") == WINDOW).select(F.col("unit_hash").alias("class"), *place))
        # few classes repeat; their extremes are found from the keys alone, then the rows are picked
        repeats = staged(every.groupBy("class").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc").drop("last_doc"), "repeats")
        found = every.join(repeats.hint("merge"), "class")
        starts = F.concat(F.array("start"), F.coalesce("more", F.array().cast("array<int>")))
        found = keep(staged(found.withColumn("start", F.explode(starts)).drop("more"), "repeated"))
    collect_garbage(units.sparkSession)
    return found


def _merged(rows: DataFrame, name: str, by: list[str]) -> DataFrame:
    """``rows`` with the number of their run of overlapping (start, end) among those of the same ``by``."""
    order = Window.partitionBy(*by).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = rows.withColumn(name, (before.isNull() | (F.col("start") > before)).cast("int"))
    return fresh.withColumn(name, F.sum(name).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def _neighbours(units: DataFrame, places: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, left, right) of ``places``: the tags of the REACH words on each side of
    the window there, fewer at a text's ends."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()), ("left", pa.binary()), ("right", pa.binary())])
    wanted = places.groupBy("doc_id", "text_hash").agg(F.collect_set("start").alias("starts"))  # no more than a document has words
    tags = units.where(F.col("kind") == TAGS).select("doc_id", "text_hash", F.col("payload").alias("tags"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in schema.names}
            for d, h, tags, starts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "tags", "starts")), strict=True):
                for s in starts:
                    end = 2 * (s + WINDOW_WORDS)
                    for c, v in zip(schema.names, (d, h, s, tags[max(0, 2 * (s - REACH)) : 2 * s], tags[end : end + 2 * REACH]), strict=True):
                        out[c].append(v)
            yield record_batch(out, schema)

    found = tags.join(wanted.hint("merge"), ["doc_id", "text_hash"]).mapInArrow(run, "doc_id long, text_hash long, start int, left binary, right binary")
    return found.dropDuplicates(_PLACE)  # equal rows of a document


def common_words(a: list[bytes], b: list[bytes], backwards: bool) -> np.ndarray:
    """How many tags the pairs have in common, from their ends if ``backwards``, else from their starts."""
    if not a:
        return np.zeros(0, np.int32)
    turn = (lambda x: x[::-1]) if backwards else (lambda x: x)
    pad = lambda xs: np.array([np.pad(turn(np.frombuffer(x, "<u2")), (0, REACH - len(x) // 2)) for x in xs])
    same = np.logical_and.accumulate(pad(a) == pad(b), axis=1).sum(axis=1)
    return np.minimum(same, [min(len(x), len(y)) // 2 for x, y in zip(a, b, strict=True)]).astype(np.int32)


def _reaches(units: DataFrame, borders: DataFrame) -> DataFrame:
    """``borders`` (a place, side -1 or 1, first_doc, first_text, first_start) with ``reach``: how many
    words beyond the window its text and the kept one have in common on that side."""
    first = [F.col(c).alias(n) for c, n in zip(("first_doc", "first_text", "first_start"), _PLACE, strict=True)]
    words = staged(_neighbours(units, borders.select(*_PLACE).unionByName(borders.select(*first))), "neighbours")
    side = lambda c: F.when(F.col("side") < 0, F.col(f"{c}_left")).otherwise(F.col(f"{c}_right"))
    own = words.select(*_PLACE, F.col("left").alias("own_left"), F.col("right").alias("own_right"))
    other = words.select(*[F.col(n).alias(c) for c, n in zip(("first_doc", "first_text", "first_start"), _PLACE, strict=True)], F.col("left").alias("kept_left"), F.col("right").alias("kept_right"))
    both = borders.join(own.hint("merge"), _PLACE).withColumn("own", side("own")).drop("own_left", "own_right")
    both = both.join(other.hint("merge"), ["first_doc", "first_text", "first_start"]).withColumn("kept", side("kept")).drop("kept_left", "kept_right")
    names = borders.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left = batch.column("own").to_pylist(), batch.column("kept").to_pylist(), batch.column("side").to_numpy() < 0
            reach = np.where(left, common_words(a, b, True), common_words(a, b, False)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(reach)], names=[*names, "reach"])

    return both.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in borders.dtypes) + ", reach int")


def passage_spans(units: DataFrame, repeated: DataFrame, unit_rows: int = UNIT_ROWS, min_span: int = MIN_SPAN) -> DataFrame:
    """(doc_id, text_hash, start_word, n_words, removed, component_id): runs of overlapping units that an
    earlier document has (removed), and the places that are kept for them; component_id is the smallest
    doc_id that shares a passage of the component."""
    text = ["doc_id", "text_hash"]
    with scratch(repeated.sparkSession) as keep:
        whole = repeated.withColumn("end", F.col("start") + F.col("n_words"))
        late = staged(_merged(whole.where("first_doc < doc_id"), "span", text).select(*text, "span", "start", "end", "kind", "class"), "late")
        first = F.min(F.struct("text_hash", "start", "end", "doc_id"))  # of the first document's places the first
        kept = staged(whole.where("first_doc = doc_id").groupBy("class").agg(first.alias("f")).select("class", F.col("f.doc_id").alias("first_doc"), F.col("f.text_hash").alias("first_text"), F.col("f.start").alias("first_start"), F.col("f.end").alias("first_end")), "kept")
        # the outermost units of each run; where a line ends a run it ends there
        outer = staged(late.groupBy(*text, "span").agg(F.min(F.struct("start", "kind", "class")).alias("l"), F.max(F.struct("end", (-F.col("kind")).alias("kind"), "start", "class")).alias("r")), "outer")
        left = outer.where(F.col("l.kind") == WINDOW).select(*text, "span", F.col("l.start").alias("start"), F.col("l.class").alias("class"), F.lit(-1).alias("side"))
        right = outer.where(F.col("r.kind") == -WINDOW).select(*text, "span", F.col("r.start").alias("start"), F.col("r.class").alias("class"), F.lit(1).alias("side"))
        borders = left.unionByName(right).join(kept.hint("merge"), "class")
        reaches = staged(_reaches(units, staged(borders, "borders")), "reaches")
        far = lambda side: F.coalesce(F.max(F.when(F.col("side") == side, F.col("reach"))), F.lit(0))
        moved = outer.join(reaches.groupBy(*text, "span").agg(far(-1).alias("before"), far(1).alias("after")).hint("merge"), [*text, "span"], "left")
        moved = moved.select(*text, "span", (F.col("l.start") - F.coalesce("before", F.lit(0))).alias("start"), (F.col("r.end") + F.coalesce("after", F.lit(0))).alias("end"))
        # runs that now touch are one; short ones are let go
        joined = _merged(moved, "passage", text)
        passage = Window.partitionBy(*text, "passage")
        low, high = F.min("start").over(passage), F.max("end").over(passage)
        collect_garbage(repeated.sparkSession)
        long = staged(joined.select(*text, "span", low.alias("start"), high.alias("end")).where(F.col("end") - F.col("start") >= min_span).withColumn("node", F.xxhash64(*text, "start", "end", F.lit("removed"))), "long")
        # what is kept for them: the first place of each class, as far as the outermost ones reach
        # a span has a class once, at however many places of it
        classes = late.select(*text, "span", "class").distinct()
        inside = staged(classes.join(long.select(*text, "span", "node").hint("merge"), [*text, "span"]).select("class", "node").distinct(), "inside")
        wide = reaches.join(long.select(*text, "span").hint("merge"), [*text, "span"], "left_semi")
        wide = wide.groupBy("class").agg(far(-1).alias("before"), far(1).alias("after"))
        held = kept.join(inside.select("class").distinct().hint("merge"), "class", "left_semi").join(wide.hint("merge"), "class", "left")
        held = held.select("class", F.col("first_doc").alias("doc_id"), F.col("first_text").alias("text_hash"), (F.col("first_start") - F.coalesce("before", F.lit(0))).alias("start"), (F.col("first_end") + F.coalesce("after", F.lit(0))).alias("end"))
        held = _merged(held, "passage", text)
        low, high = F.min("start").over(passage), F.max("end").over(passage)
        held = staged(held.select("class", *text, low.alias("start"), high.alias("end")).withColumn("node", F.xxhash64(*text, "start", "end", F.lit("kept"))), "held")
        spans = staged(long.select("node", *text, "start", "end", F.lit(True).alias("removed")).unionByName(held.select("node", *text, "start", "end", F.lit(False).alias("removed"))).distinct(), "spans")
        rows = inside.unionByName(held.select("class", "node").distinct()).select(F.col("class").alias("key"), F.lit(0).alias("table"), F.col("node").alias("id"))
        comps = staged(connected_components(equal_links(rows, unit_rows)), "components")
        named = keep(staged(spans.join(comps.hint("merge"), "node").drop("node"), "named"))
        heads = keep(staged(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "heads"))
    return named.join(heads.hint("merge"), "component").select(*text, F.col("start").alias("start_word"), (F.col("end") - F.col("start")).alias("n_words"), "removed", "component_id")


def repeated_passages(docs: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """The repeated spans of all documents (see ``passage_spans``)."""
    with scratch(docs.sparkSession) as keep:
        units = staged(paragraph_units(docs, tuned_bands(threshold), min_words=min_words), "units")
        spans = passage_spans(units, repeated_units(docs, units, threshold, unit_rows), unit_rows)
        return keep(staged(spans, "passages"))


def cut_words(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """``text`` without the words whose numbers lie in the ranges [start, end); a space stands for what
    goes from between two words."""
    raw = np.frombuffer(text, np.uint8)
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    starts = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
    keep, at = [], 0
    for a, b in sorted(ranges):
        lo = int(starts[a]) if a < len(starts) else len(text)
        hi = int(starts[b]) if b < len(starts) else len(text)
        if hi > at:
            keep.append(text[at : max(at, lo)])
            at = hi
    keep.append(text[at:])
    parts = [keep[0]]
    for before, after in zip(keep, keep[1:], strict=False):
        if before and after and not before[-1:].isspace():
            parts.append(b" ")
        parts.append(after)
    return b"".join(parts)


def without_repeats(docs: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with every repeated passage cut out but where it is kept; documents that lose all their
    words go, others keep their columns, n_chars by the text left."""
    removed = repeated_passages(docs, threshold, min_words).where("removed")
    span = F.struct(F.col("start_word").alias("start"), (F.col("start_word") + F.col("n_words")).alias("end"))
    cuts = removed.groupBy("doc_id", "text_hash").agg(F.collect_list(span).alias("cut"))
    named = row_names(docs).drop("text", "row_hash")
    joined = named.join(cuts.hint("merge"), ["doc_id", "text_hash"], "left").select("row.*", F.col("cut").alias(_CUT))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = batch.column(len(names)).to_pylist()
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            made = [t if not c or t is None else cut_words(t, [(x["start"], x["end"]) for x in c]) for t, c in zip(texts, cuts, strict=True)]
            keep = [not c or bool(m and m.strip()) for c, m in zip(cuts, made, strict=True)]
            columns = {n: batch.column(n) for n in names} | {"text": pa.array(made, pa.binary()).cast(pa.string())}
            if "n_chars" in columns:
                old = batch.column("n_chars").to_pylist()
                columns["n_chars"] = pa.array([len(m.decode()) if c else o for m, c, o in zip(made, cuts, old, strict=True)], batch.column("n_chars").type)
            out = pa.RecordBatch.from_arrays([columns[n].cast(batch.schema.field(n).type) for n in names], names=names)
            yield out.filter(pa.array(keep))

    return joined.mapInArrow(run, docs.schema)
