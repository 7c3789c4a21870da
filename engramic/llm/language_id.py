"""Language identification by interpolated Kneser-Ney character models.

A text becomes a string of lower-case letters with one space between words (all else parts words).
For each language the counts of all strings of ``ORDER`` characters over all training documents give
an interpolated Kneser-Ney model: absolute discounts, the highest order from counts and the lower
ones from continuation counts, down to a uniform floor. For each order the n-grams that any language
has seen stand in one sorted array of 64-bit hashes, beside it a row of log probabilities by
language; contexts stand likewise beside their back-off weights, so one search serves all languages.
The prediction is the language of the least cross-entropy per character. Its score is the posterior
of the languages at a temperature, and it is rejected beyond the cross-entropy that all but
``REJECT_SHARE`` of documents of that language keep; both are calibrated on all training documents,
from the cross-entropies of the one pass that scores every document.

The models grow with the training texts and nothing is dropped from them, so they are neither
collected nor broadcast: the n-grams are dealt into shards by their last character but one, which all
that a place looks up shares with its contexts. A task builds each shard and writes it to the shared
folder; a worker holds one shard at a time and scores the places of a slice that belong to it. What
is sent out is the list of languages and of characters with their shards.

Defined results: a text that is null or has no letters is ``und`` with score 0 and cross-entropy
null; ties of two languages go to the first by code point; repeated rows each give a row and count
as often in training; very long texts are read whole; with no training document all is ``und``; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import io
import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import delete_at_exit, scratch_path
from .common import Sent, mix64, open_file, put_file, record_batch, staged, text_slices
from .quality import remainder

ORDER = 5
#: The bound of a task's table of counts; cells (n-grams times languages) that a shard is to hold.
TASK_GRAMS, SHARD_CELLS = 1_500_000, 6_000_000
#: Places that are scored at a time; temperatures that are tried.
BLOCK, TEMPERATURES = 1 << 16, tuple(2.0 ** (k / 2) for k in range(-8, 8))
REJECT_SHARE, FLOOR = 0.001, 1 / 400
UNKNOWN = "und"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LETTER: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def sequences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, document of each, whether it is one to predict) of all texts: each is ORDER - 1
    spaces, then its letters with single spaces between and after words. Texts without letters give
    none."""
    joined = np.frombuffer("\x00".join(t.decode().lower().replace("\x00", " ") for t in texts).encode("utf-32-le"), np.uint32)
    end = joined == 0
    doc = np.cumsum(end)
    doc = np.where(end, doc - 1, doc)
    letter = letters()[joined]
    char = np.where(letter, joined, 32)
    before = np.concatenate([[False], letter[:-1]])
    before[1:] &= doc[1:] == doc[:-1]
    keep = letter | before
    # a word that ends its text has its space at the separator; that of the last text is added
    char, doc = char[keep], doc[keep]
    if len(joined) and letter[-1]:
        char, doc = np.append(char, np.uint32(32)), np.append(doc, doc[-1])
    if not len(char):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, bool)
    start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    place = np.arange(len(char)) + (ORDER - 1) * np.repeat(np.arange(1, len(start) + 1), np.diff(np.append(start, len(char))))
    out, owner, real = np.full(place[-1] + 1, 32, np.uint32), np.empty(place[-1] + 1, np.int64), np.zeros(place[-1] + 1, bool)
    out[place], real[place] = char, True
    owner[:] = np.repeat(doc[start], np.diff(np.append(start, len(char))) + ORDER - 1)
    return out, owner, real


def gram_hashes(chars: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n characters that end at each place (places before n - 1: meaningless)."""
    h = np.zeros(len(chars), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n - 1, -1, -1):
            shifted = np.zeros_like(h)
            shifted[k:] = chars[: len(chars) - k] if k else chars
            h = h * _BASE + shifted
    return mix64(h)


# ---------------------------------------------------------------- counting


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of ``docs(text, lang)``: each task counts what it reads before
    anything is shuffled."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])

    def emit(tables: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for lang, parts in tables.items():
            h, c, g = _merged(parts)
            texts = g.astype("<u4").tobytes().decode("utf-32-le")
            yield record_batch({"lang": [lang] * len(h), "gram": [texts[i : i + ORDER] for i in range(0, len(texts), ORDER)], "n": c}, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, list] = {}
        for batch, texts in text_slices(batches):
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                chars, _, real = sequences([t for t, of in zip(texts, langs, strict=True) if of == lang])
                at = np.flatnonzero(real)
                if not len(at):
                    continue
                h, first, c = np.unique(gram_hashes(chars, ORDER)[at], return_index=True, return_counts=True)
                g = chars[at[first][:, None] + np.arange(1 - ORDER, 1)]
                parts = tables.setdefault(lang, [])
                parts.append((h, c, g))
                if len(parts) > 6:
                    tables[lang] = [_merged(parts)]
            if sum(len(p[0]) for ps in tables.values() for p in ps) > TASK_GRAMS:
                yield from emit(tables)
                tables = {}
        yield from emit(tables)

    counted = docs.select("text", "lang").mapInArrow(run, "lang string, gram string, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h = np.concatenate([p[0] for p in parts])
    kept, first, back = np.unique(h, return_index=True, return_inverse=True)
    return kept, np.bincount(back, np.concatenate([p[1] for p in parts]), len(kept)).astype(np.int64), np.concatenate([p[2] for p in parts])[first]


# ---------------------------------------------------------------- the model


class SortedHashes:
    """A sorted array of hashes; a directory by their first bits leads to the few that share them."""

    def __init__(self, table: np.ndarray):
        self.table, self.bits = table, max(1, len(table).bit_length())
        first = (table >> np.uint64(64 - self.bits)).astype(np.int64)
        self.edge = np.concatenate([[0], np.cumsum(np.bincount(first, minlength=1 << self.bits))])

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where it is not in the table."""
        first = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.edge[first], self.edge[first + 1]
        out = np.full(len(h), -1, np.int64)
        left = np.flatnonzero(at < end)
        while len(left):
            here = at[left]
            same = self.table[here] == h[left]
            out[left[same]] = here[same]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


@dataclass
class LanguageModels:
    """One shard. hashes[n - 1] and logp[n - 1]: the n-grams and their log2 probabilities by language;
    contexts[n - 1] and backoff[n - 1]: the contexts of n characters and the log2 weights they leave."""

    langs: list[str]
    hashes: list[SortedHashes] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    contexts: list[SortedHashes] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)
    #: log2 of the weight that single characters leave to the floor, by language.
    rest: np.ndarray | None = None

    def log_probs(self, chars: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log2 p of the characters at places ``at`` (with ORDER - 1 before each), by language."""
        span = chars[at[:, None] + np.arange(1 - ORDER, 1)].astype(np.uint64)
        out, left, carried = np.empty((len(at), len(self.langs)), np.float32), np.arange(len(at)), None
        for n in range(ORDER, 0, -1):
            row = self.hashes[n - 1].find(_hash_rows(span[:, ORDER - n :]))
            hit = row >= 0
            got = self.logp[n - 1][row[hit]]
            out[left[hit]] = got if carried is None else got + carried[hit]
            if hit.all():
                return out
            miss = ~hit
            left, span = left[miss], span[miss]
            carried = np.zeros((len(left), len(self.langs)), np.float32) if carried is None else carried[miss]
            if n > 1:
                context = self.contexts[n - 2].find(_hash_rows(span[:, ORDER - n : ORDER - 1]))
                seen = context >= 0
                carried[seen] += self.backoff[n - 2][context[seen]]
        # characters that no language has: the uniform floor, at the weight left for it
        out[left] = np.log2(FLOOR) + self.rest + carried
        return out

    def save(self, root: str, shard: int) -> None:
        arrays = {"langs": np.array(self.langs), "rest": self.rest}
        for n, (h, p) in enumerate(zip(self.hashes, self.logp, strict=True)):
            arrays |= {f"h{n}": h.table, f"p{n}": p}
        for n, (h, w) in enumerate(zip(self.contexts, self.backoff, strict=True)):
            arrays |= {f"c{n}": h.table, f"w{n}": w}
        raw = io.BytesIO()
        np.savez(raw, **arrays)
        with put_file(root, f"shard-{shard:06d}.npz") as f:
            f.write(raw.getbuffer())

    @staticmethod
    def load(root: str, shard: int) -> LanguageModels:
        with open_file(root, f"shard-{shard:06d}.npz") as f:
            a = np.load(io.BytesIO(f.read()))
        take = lambda k: [a[f"{k}{n}"] for n in range(ORDER) if f"{k}{n}" in a]
        return LanguageModels(a["langs"].tolist(), [SortedHashes(h) for h in take("h")], take("p"), [SortedHashes(h) for h in take("c")], take("w"), a["rest"])


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows.shape[1]):
            h = h * _BASE + rows[:, k].astype(np.uint64)
    return mix64(h)


def discount_of(one: float, two: float) -> float:
    """The absolute discount from how many counts are one and two."""
    return one / (one + 2 * two) if one and two else 0.75


def shorter(of: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (language, n-gram) one character shorter, with how many go on to the left."""
    key = mix64(_hash_rows(g[:, 1:]) ^ mix64(of.astype(np.uint64)))
    _, first, c = np.unique(key, return_index=True, return_counts=True)
    return of[first], g[first, 1:], c.astype(np.float64)


def kneser_ney(langs: list[str], lang: np.ndarray, grams: np.ndarray, counts: np.ndarray, discounts: np.ndarray | None = None, single: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> LanguageModels:
    """The models of all languages from the counts of ORDER-grams (rows of code points). For a shard of
    them ``discounts`` (by order and language) and the single characters (language, character,
    continuations) come from all n-grams."""
    model = LanguageModels(langs)
    # kinds_of[n]: distinct (language, n-gram) with their counts, the lower orders by distinct extensions
    kinds_of = {ORDER: (lang, grams, counts.astype(np.float64))}
    for n in range(ORDER - 1, 0, -1):
        kinds_of[n] = shorter(*kinds_of[n + 1][:2])
    if single is not None:
        kinds_of[1] = single
    size = len(langs)
    lower: tuple[np.ndarray, np.ndarray] | None = None
    for n in range(1, ORDER + 1):
        of, g, c = kinds_of[n]
        h = _hash_rows(g)
        table, first = np.unique(h, return_index=True)
        row = np.searchsorted(table, h)
        discount = np.array([discount_of((c[of == k] == 1).sum(), (c[of == k] == 2).sum()) for k in range(size)]) if discounts is None else discounts[n - 1]
        # sums over the contexts, by language
        ctx = _hash_rows(g[:, :-1]) if n > 1 else np.zeros(len(g), np.uint64)
        names, back = np.unique(ctx, return_inverse=True)
        cell = back * size + of
        total, kinds = np.bincount(cell, c, len(names) * size).reshape(-1, size), np.bincount(cell, minlength=len(names) * size).reshape(-1, size)
        weight = np.divide(discount * kinds, total, out=np.ones_like(total), where=total > 0)
        if n > 1:
            model.contexts.append(SortedHashes(names))
            model.backoff.append(np.log2(weight).astype(np.float32))
        else:
            model.rest = np.log2(weight[0]).astype(np.float32)
        own = np.zeros((len(table), size))
        own[row, of] = np.maximum(c - discount[of], 0)
        where = np.searchsorted(names, _hash_rows(g[first][:, :-1])) if n > 1 else np.zeros(len(table), np.int64)
        own = np.divide(own, total[where], out=np.zeros_like(own), where=total[where] > 0)
        if n == 1:
            below = np.full((len(table), size), FLOOR)
        else:
            below = np.exp2(lower[1][np.searchsorted(lower[0], _hash_rows(g[first][:, 1:]))])
        p = own + weight[where] * below
        lower = (table, np.log2(p))
        model.hashes.append(SortedHashes(table))
        model.logp.append(np.log2(p).astype(np.float32))
    return model


def _rows_of(grams: list[str], n: int = ORDER) -> np.ndarray:
    return np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).reshape(-1, n)


@dataclass
class Fitted:
    """Where the shards are: ``place[i]`` is the shard of the i-th of the ascending characters ``known``
    (others: shard 0). With what the calibration found."""

    langs: list[str]
    root: str
    known: np.ndarray
    place: np.ndarray
    shards: int
    limit: np.ndarray | None = None
    temperature: float = 1.0

    def shard(self, number: int) -> LanguageModels:
        """A process holds one shard."""
        held = sys.modules.setdefault("_engramic_languages", types.ModuleType("_engramic_languages")).__dict__
        if held.get("name") != (self.root, number):
            held.pop("model", None)
            held["model"], held["name"] = LanguageModels.load(self.root, number), (self.root, number)
        return held["model"]

    def entropies(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per character by language, number of characters) of each text."""
        chars, doc, real = sequences(texts)
        n = np.bincount(doc[real], minlength=len(texts)) if len(chars) else np.zeros(len(texts), np.int64)
        total, places = np.zeros((len(texts), len(self.langs))), np.flatnonzero(real)
        if self.shards > 1 and len(places):
            before = chars[places - 1]
            at = np.minimum(np.searchsorted(self.known, before), len(self.known) - 1)
            of = np.where(self.known[at] == before, self.place[at], 0)
            parts = [(s, places[of == s]) for s in np.unique(of).tolist()]
        else:
            parts = [(0, places)] if len(places) else []
        for s, mine in parts:
            model = self.shard(s)
            for lo in range(0, len(mine), BLOCK):
                at = mine[lo : lo + BLOCK]
                lp, d = model.log_probs(chars, at), doc[at]
                low = int(d[0])
                for k in range(len(self.langs)):
                    part = np.bincount(d - low, lp[:, k])
                    total[low : low + len(part), k] -= part
        return total / np.maximum(n, 1)[:, None], n

    def posterior(self, entropy: np.ndarray, n: np.ndarray, temperature: float | None = None) -> np.ndarray:
        """The posterior of the least cross-entropy: evidence grows with the root of the length."""
        gap = (entropy - entropy.min(axis=1, keepdims=True)) * np.sqrt(np.maximum(n, 1))[:, None] * (temperature or self.temperature)
        return 1 / np.exp2(-np.minimum(gap, 200)).sum(axis=1)


def _global_figures(counts: DataFrame) -> tuple[list[str], np.ndarray, DataFrame]:
    """(languages, discounts by order and language, single characters with their continuations): from all
    n-grams, order by order."""
    t, shares = counts, []
    for n in range(ORDER, 0, -1):
        if n < ORDER:
            t = staged(t.groupBy("lang", F.substring("gram", 2, n).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "types")
        shares.append({r["lang"]: discount_of(r["one"] or 0, r["two"] or 0) for r in t.groupBy("lang").agg(F.sum((F.col("n") == 1).cast("int")).alias("one"), F.sum((F.col("n") == 2).cast("int")).alias("two")).collect()})
    langs = sorted(shares[0])
    return langs, np.array([[s[x] for x in langs] for s in reversed(shares)]), t


def fit_languages(docs: DataFrame, train: Column, shard_cells: int = SHARD_CELLS) -> Fitted | None:
    """Models from the rows of ``docs(text, lang)`` that ``train`` holds for."""
    spark = docs.sparkSession
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    counts = staged(gram_counts(rows), "grams")
    # a row for each character: as many as there are letters at most
    middle = F.substring("gram", ORDER - 1, 1)
    share = [(ord(r["c"]), r["n"]) for r in counts.groupBy(middle.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()]
    if not share:
        return None
    langs, discounts, ones = _global_figures(counts)
    single = ones.toArrow().combine_chunks()  # languages times letters
    single = (np.searchsorted(np.array(langs, object), single.column("lang").to_numpy()), _rows_of(single.column("gram").to_pylist(), 1), np.asarray(single.column("n")).astype(np.float64))
    shards = max(1, -(-sum(n for _, n in share) * len(langs) // shard_cells))
    fill, place = np.zeros(shards, np.int64), {}
    for c, n in sorted(share, key=lambda x: (-x[1], x[0])):  # the largest first, each to the emptiest
        place[c] = int(fill.argmin())
        fill[place[c]] += n
    known = np.array(sorted(place), np.uint32)
    fitted = Fitted(langs, scratch_path(spark, "languages"), known, np.array([place[c] for c in known.tolist()]), shards)
    delete_at_exit(spark, fitted.root)
    sent = Sent(spark, (fitted, discounts, single))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t, (fit, discount, one) = pa.Table.from_batches(got), sent.value
        lang = np.searchsorted(np.array(fit.langs, object), t.column("lang").to_numpy())
        grams = _rows_of(t.column("gram").to_pylist())
        number = int(fit.place[np.searchsorted(fit.known, grams[0, ORDER - 2])])
        kneser_ney(fit.langs, lang, grams, np.asarray(t.column("n")), discount, one).save(fit.root, number)
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32())], names=["shard"])

    # dealt by a table of the characters, which has a row for each letter at most
    where = spark.createDataFrame([(chr(c), s) for c, s in place.items()], "c string, shard int")
    dealt = counts.withColumn("c", middle).join(F.broadcast(where), "c").drop("c").repartitionById(shards, F.col("shard"))
    made = dealt.select("lang", "gram", "n").mapInArrow(build, "shard int").collect()
    if len(made) < len(set(place.values())):
        raise RuntimeError("a shard of the language models was not written")
    return fitted


def text_entropies(docs: DataFrame, fitted: Fitted, *keep: str) -> DataFrame:
    """(doc_id, ``keep``, n, entropy by language) of every row of ``docs(doc_id, text, keep)``."""
    kinds = {c: t for c, t in docs.dtypes if c in keep}
    sent = Sent(docs.sparkSession, fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            e, n = sent.value.entropies(texts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, e.size + 1, e.shape[1], dtype=np.int32)), pa.array(e.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[batch.column(c) for c in keep], pa.array(n, pa.int64()), lists], names=["doc_id", *keep, "n", "entropy"])

    schema = "doc_id long, " + "".join(f"{c} {kinds[c]}, " for c in keep) + "n long, entropy array<double>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep).mapInArrow(run, schema)


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.asarray(batch.column("entropy").flatten()).reshape(-1, width)


def calibrate(scored: DataFrame, fitted: Fitted) -> Fitted:
    """``fitted`` with its temperature and limits from ``scored(lang, n, entropy)``, rows of known language."""
    langs, tried = fitted.langs, TEMPERATURES
    sent = Sent(scored.sparkSession, fitted)

    def fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(tried))
        for batch in batches:
            if batch.num_rows:
                e, n, fit = _matrix(batch, len(langs)), np.asarray(batch.column("n")), sent.value
                right = e.argmin(axis=1) == np.searchsorted(np.array(langs, object), batch.column("lang").to_numpy(zero_copy_only=False))
                for k, t in enumerate(tried):
                    p = np.clip(fit.posterior(e, n, t), 1e-6, 1 - 1e-6)
                    sums[k] += np.where(right, np.log(p), np.log1p(-p)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(tried)), pa.int32()), pa.array(sums)], names=["k", "fit"])

    known = scored.where(F.col("lang").isin(langs) & (F.col("n") > 0))
    total = known.select("lang", "n", "entropy").mapInArrow(fits, "k int, fit double").groupBy("k").agg(F.sum("fit").alias("fit")).collect()
    fitted.temperature = tried[max(total, key=lambda r: (round(r["fit"], 6), -r["k"]))["k"]] if total else 1.0
    own = F.element_at("entropy", (F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang"))).cast("int"))
    limits = {r["lang"]: r["top"] for r in known.groupBy("lang").agg(F.percentile_approx(own, 1 - REJECT_SHARE, 100_000).alias("top")).collect()}
    fitted.limit = np.array([limits.get(x, np.inf) for x in langs])
    return fitted


def decided(scored: DataFrame, fitted: Fitted) -> DataFrame:
    """(doc_id, lang_pred, score, entropy, rejected) of every row of ``scored(doc_id, n, entropy)``."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("entropy", pa.float64()), ("rejected", pa.bool_())])
    sent = Sent(scored.sparkSession, fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit, n = sent.value, np.asarray(batch.column("n"))
            e = _matrix(batch, len(fit.langs))
            best, none = e.argmin(axis=1), n == 0
            least = e[np.arange(len(n)), best]
            score = np.where(none, 0.0, fit.posterior(e, n))
            rejected = none | (least > (fit.limit[best] if fit.limit is not None else np.inf))
            names = [UNKNOWN if x else fit.langs[b] for x, b in zip(none.tolist(), best.tolist(), strict=True)]
            yield record_batch({"doc_id": batch.column("doc_id"), "lang_pred": names, "score": score, "entropy": pa.array(least, mask=none), "rejected": rejected}, schema)

    return scored.select("doc_id", "n", "entropy").mapInArrow(run, "doc_id long, lang_pred string, score double, entropy double, rejected boolean")


def identify(docs: DataFrame, fitted: Fitted | None) -> DataFrame:
    """(doc_id, lang_pred, score, entropy, rejected) of every row of ``docs(doc_id, text)``."""
    if fitted is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("entropy"), F.lit(True).alias("rejected"))
    return decided(text_entropies(docs, fitted), fitted)


def predicted_languages(docs: DataFrame, folds: int = 4, held: int = 2, shard_cells: int = SHARD_CELLS) -> DataFrame:
    """doc_id, held_out, lang_pred, score and more of every row; the held-out remainder isn't learned from."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    train = F.coalesce(remainder(folds) != held, F.lit(True))
    fitted = fit_languages(docs, train, shard_cells)
    if fitted is None:
        out = identify(docs, None)
    else:
        scored = staged(text_entropies(docs, fitted, "lang"), "entropies")
        out = decided(scored, calibrate(scored.where(train), fitted))
    return out.withColumn("held_out", F.coalesce(remainder(folds) == held, F.lit(False)))
