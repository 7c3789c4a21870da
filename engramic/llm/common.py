"""Shared helpers: staged tables, text batches, hashes, salts and key ranges."""

from __future__ import annotations

import contextlib
import contextvars
import gc
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch_path, write_scratch

#: At most about so many bytes of text are held at once by the vectorised kernels.
CHUNK_BYTES = 1 << 20


#: The paths staged in the innermost scope of this thread, if there is one.
_SCOPE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scope", default=None)


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts the lineage, so a lost
    executor never forces what stands before it to run again. The scope around the call deletes it,
    or else the end of the application."""
    scope, path = _SCOPE.get(), scratch_path(df.sparkSession, tag)
    if scope is not None:
        scope.append(path)
    return write_scratch(df, path)


def delete_paths(spark: SparkSession, paths: Iterable[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes, at its end, what was staged inside it but the tables given to ``keep``. What leaves the
    scope must rest on kept tables alone; those belong to the scope around it."""
    own: list[str] = []
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(own[-1])  # the table staged last
        return df

    token = _SCOPE.set(own)
    try:
        yield keep
    finally:
        _SCOPE.reset(token)
        outer = _SCOPE.get()
        if outer is not None:
            outer.extend(kept)
        delete_paths(spark, [p for p in own if p not in kept])


class Run:
    """The staged tables of a chain of stages: what a stage staged is deleted when the chain's next
    stage begins, since its result is written by then. Each thread has a chain of its own."""

    def __init__(self):
        self._held = threading.local()

    @contextlib.contextmanager
    def stage(self, spark: SparkSession) -> Iterator[None]:
        self.clear(spark)
        token = _SCOPE.set(self._held.paths)
        try:
            yield
        finally:
            _SCOPE.reset(token)

    def clear(self, spark: SparkSession) -> None:
        delete_paths(spark, getattr(self._held, "paths", []))
        self._held.paths = []


def collect_garbage(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of jobs whose results are staged: it does so only when
    the driver has collected their plans. Called between the steps of long operators."""
    gc.collect()
    spark._jvm.System.gc()


def numbered_times(rows: DataFrame, times: Column, name: str, block: int = 1 << 16) -> DataFrame:
    """Each row ``times`` times (a row of 0: not at all), numbered from 0 in column ``name``. Numbers are
    made in blocks, so that no array grows with ``times``."""
    many = rows.withColumn(name, times.cast("long")).where(F.col(name) > 0)
    many = many.withColumn("_last", F.col(name) - 1).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / block))))
    low = F.col("_block") * block
    return many.withColumn(name, F.explode(F.sequence(low, F.least(F.col("_last"), low + (block - 1))))).drop("_last", "_block")


def row_names(docs: DataFrame) -> DataFrame:
    """``docs`` as one column ``row``, so that columns of any name travel along, with what names a row:
    doc_id, its text, and hashes of its text and of all its other columns."""
    others = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if f.dataType.typeName() == "map" else F.col(f"`{f.name}`") for f in docs.schema if f.name not in ("doc_id", "text")]
    row_hash = F.xxhash64(*others) if others else F.lit(0).cast("long")
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"), row_hash.alias("row_hash"))


def open_file(root: str, name: str) -> pa.NativeFile:
    fs, path = pafs.FileSystem.from_uri(root)
    return fs.open_input_file(f"{path}/{name}")


@contextlib.contextmanager
def put_file(root: str, name: str) -> Iterator[pa.NativeFile]:
    """A file to write, under a temporary name that becomes ``name`` if all went well: a repeated or
    lost task leaves a whole file or none."""
    fs, path = pafs.FileSystem.from_uri(root)
    fs.create_dir(path, recursive=True)
    temporary = f"{path}/.{name}.{uuid.uuid4().hex}"
    try:
        with fs.open_output_stream(temporary) as f:
            yield f
    except BaseException:
        with contextlib.suppress(OSError):
            fs.delete_file(temporary)
        raise
    fs.move(temporary, f"{path}/{name}")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spread(spark: SparkSession) -> int:
    """Partitions for tables whose rows are dealt out by the operators themselves."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def salted(key: Column, rows: Column, bound: int | Column, *by: Column) -> Column:
    """A salt in 0..ceil(rows / bound) - 1, from the hash of ``by``: splits a hot key into groups
    of about ``bound`` rows. The same row gets the same salt in every run."""
    n = F.greatest(F.lit(1), F.ceil(rows / (bound if isinstance(bound, Column) else F.lit(bound)))).cast("long")
    return F.pmod(F.xxhash64(key, *by), n)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about CHUNK_BYTES of text, and their texts as UTF-8 (null: empty).
    Only a slice at a time is copied out of its batch."""
    pool = pa.default_memory_pool()
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, side="right")))
            part = batch.slice(at, end - at)
            yield part, [t or b"" for t in part.column(column).cast(pa.binary()).to_pylist()]
            at = end
        pool.release_unused()


def record_batch(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for f, c in ((f, columns[f.name]) for f in schema)], schema=schema
    )


# ---------------------------------------------------------------- words and XXH64, in numpy

#: Fixed values of the public XXH64 algorithm.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(0x9E3779B185EBCA87),
    np.uint64(0xC2B2AE3D27D4EB4F),
    np.uint64(0x165667B19E3779F9),
    np.uint64(0x85EBCA77C2B2AE63),
    np.uint64(0x27D4EB2F165667C5),
)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64_spans(buf: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of every span ``buf[start : start + length]``; spans of one length are hashed together."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    w64 = np.lib.stride_tricks.as_strided(padded[: len(buf)].view(np.uint8), shape=(len(buf),), strides=(1,)) if not len(buf) else np.ndarray((len(buf) + 1,), "<u8", padded.data, 0, (1,))
    out = np.empty(len(start), np.uint64)
    if not len(start):
        return out
    order = np.argsort(length, kind="stable")
    cuts = np.flatnonzero(np.diff(length[order])) + 1
    s = np.uint64(seed)
    with np.errstate(over="ignore"):
        for rows in np.split(order, cuts):
            n, at = int(length[rows[0]]), start[rows].astype(np.int64)
            done = 0
            if n >= 32:
                acc = [np.full(len(rows), v, np.uint64) for v in (s + _P1 + _P2, s + _P2, s, s - _P1)]
                while done + 32 <= n:
                    acc = [_round(a, w64[at + (done + 8 * k)]) for k, a in enumerate(acc)]
                    done += 32
                h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
                for a in acc:
                    h = (h ^ _round(np.zeros_like(a), a)) * _P1 + _P4
            else:
                h = np.full(len(rows), s + _P5, np.uint64)
            h = h + np.uint64(n)
            while done + 8 <= n:
                h = _rotl(h ^ _round(np.zeros_like(h), w64[at + done]), 27) * _P1 + _P4
                done += 8
            if done + 4 <= n:
                h = _rotl(h ^ ((w64[at + done] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
                done += 4
            while done < n:
                h = _rotl(h ^ (padded[at + done].astype(np.uint64) * _P5), 11) * _P1
                done += 1
            h ^= h >> np.uint64(33)
            h *= _P2
            h ^= h >> np.uint64(29)
            h *= _P3
            out[rows] = h ^ (h >> np.uint64(32))
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class WordTable:
    """The words of a slice of texts, A-Z lower-cased, split at the six ASCII white-space bytes.

    ``joined`` holds all words with one space after each; word i is at ``start[i]``, of ``size[i]``
    bytes; text t has the words ``first[t] : first[t + 1]``.
    """

    def __init__(self, texts: list[bytes]):
        lists = [t.lower().split() for t in texts]
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        words = [w for x in lists for w in x]
        self.joined = np.frombuffer(b" ".join(words) + b" ", np.uint8)
        end = np.flatnonzero(self.joined == 32)[: len(words)]
        self.start = np.concatenate([[0], end[:-1] + 1]).astype(np.int64) if len(words) else np.zeros(0, np.int64)
        self.size = end - self.start if len(words) else np.zeros(0, np.int64)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and length in ``joined`` of all k-word shingles (a text of fewer words: all its
        words as one; of none: none), and the first shingle of each text (one more at the end)."""
        n = np.diff(self.first)
        count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        first = np.concatenate([[0], np.cumsum(count)])
        word = np.arange(first[-1]) - np.repeat(first[:-1] - self.first[:-1], count)
        last = word + np.repeat(np.minimum(k, n) - 1, count)
        return self.start[word], self.start[last] + self.size[last] - self.start[word], first


def bit_votes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text the number of hashes with bit b set (columns: bits from the lowest)."""
    out = np.zeros((len(first) - 1, 64), np.int64)
    for t, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        for lo in range(a, b, 60_000):
            out[t] += np.add.reduce(np.unpackbits(hashes[lo : min(b, lo + 60_000)].view(np.uint8), bitorder="little").reshape(-1, 64), axis=0, dtype=np.uint16)
    return out


def pack_bits(bits: np.ndarray) -> np.ndarray:
    """Rows of 64 booleans (lowest first) as unsigned 64-bit integers."""
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


# ---------------------------------------------------------------- key ranges


def range_splits(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 ascending split points of the integer column ``key`` (approximate quantiles): a
    list as long as the partition count, which is all that reaches the driver."""
    if n < 2:
        return []
    got = df.select(F.percentile_approx(F.col(key).cast("long"), [i / n for i in range(1, n)], 20_000)).first()[0]
    return sorted(set(got or []))


def range_of(key: Column, splits: list[int]) -> Column:
    """How many of the ascending splits are not above the key (null: 0): a binary search in a literal."""
    if not splits:
        return F.lit(0)
    points = F.array(*[F.lit(s).cast("long") for s in splits])
    hops = F.array(*[F.lit(1 << k) for k in reversed(range(len(splits).bit_length()))])
    found = F.aggregate(hops, F.lit(0), lambda lo, hop: F.when((lo + hop <= len(splits)) & (F.try_element_at(points, lo + hop) <= key), lo + hop).otherwise(lo))
    return F.when(key.isNull(), F.lit(0)).otherwise(found)


class Sent:
    """A small object for all tasks. It travels with the code of its classes, so executors need not
    have the package; each task unpacks it once."""

    def __init__(self, spark: SparkSession, thing: object):
        self._raw = spark.sparkContext.broadcast(cloudpickle.dumps(thing))
        self._thing: list[object] = []

    @property
    def value(self):
        if not self._thing:
            self._thing.append(cloudpickle.loads(self._raw.value))
        return self._thing[0]

    def __getstate__(self):
        return {"_raw": self._raw, "_thing": []}
