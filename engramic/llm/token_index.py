"""Token ids as raw binary shards with a minimal perfect hash index.

A dataset is a folder of shards, one for each range of doc_id, and a manifest. A shard is two files:
``shard-NNNNNN.ids``, the ids of its documents one after the other as little-endian unsigned 16-bit
integers (32-bit if the vocabulary needs them), and ``shard-NNNNNN.mph``, its index. The index is a
minimal perfect hash (hash and displace): a key's bucket has a displacement that sends it to one of
exactly as many slots as there are keys; the slot stores the key's 64-bit fingerprint (a bijection
of the key, so that a foreign key is never taken for a stored one), the shard offset and the id
count. A lookup reads one displacement and one slot. Files are written under a temporary name and
moved into place, so a repeated or lost task leaves whole files or none.

Defined results: a null text counts as empty; an empty text has the end id alone; documents of equal
doc_id stand in ascending order of their text, and the index leads to the first; documents without
doc_id come first and have no key; very long texts are encoded whole; an empty table gives an empty
dataset; other columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import re
import sys
import types
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import delete_at_exit, scratch_path
from .common import mix64, open_file, put_file, range_of, range_splits, record_batch, spread, text_slices

END_ID = 1
MAGIC, VERSION = b"EGTOKIDX", 1
KEYS_PER_BUCKET = 4
#: Text of one shard, the most shards, documents whose ids are read at a time.
SHARD_BYTES, MAX_SHARDS, READ_ROWS = 256 << 20, 1 << 16, 4096
#: Pieces that an encoder remembers.
CACHE_PIECES = 400_000
#: Texts without these are cut into pieces here; of others the words that have them go to the library.
_OTHER = re.compile(r"[^\t\n\r -~À-ÖØ-öø-ÿ]|<\|")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


class Remembered(dict):
    """What ``make`` gives for a key, kept for the first ``most`` keys; starts anew when so many others
    were made that the keys kept have become stale."""

    def __init__(self, make: Callable[[str], bytes | int], most: int):
        self.make, self.most, self.missed = make, most, 0

    def __missing__(self, key: str) -> bytes | int:
        made = self.make(key)
        if len(self) >= self.most:
            self.missed += 1
            if self.missed < 4 * self.most:
                return made
            self.clear()
            self.missed = 0
        self[key] = made
        return made


def _byte_letters() -> dict[int, int]:
    """The letter that a byte-level vocabulary has for each byte: printable bytes stand for themselves,
    the others for the code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: b if b in plain else 256 + b - sum(x < b for x in plain) for b in range(256)}


class Encoder:
    """Encodes with the tokenizers library, remembering the pieces that it has met.

    The library encodes each piece that its pre-tokeniser makes by itself, and no piece has white
    space in it, so a text's ids are those of its pieces in turn. Which pieces a plain text has, and
    that the vocabulary's model gives their ids, is checked against the library when the encoder is
    made; a vocabulary with another pre-tokeniser, and words with characters beyond the plain ones,
    are left to the library alone.
    """

    def __init__(self, path: str, most: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model, self.letters = self.tok.model, _byte_letters()
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.pieces = Remembered(self._piece, most or CACHE_PIECES)
        self.words = Remembered(self._word, most or CACHE_PIECES // 8)
        self.sizes = Remembered(lambda p: len(self._piece(p)) // self.dtype.itemsize, most or CACHE_PIECES)
        probe = "It's  we'LL 4th c'est\tÉtÉ -- (a_b) x9.y\n'tis $1,200! naïve ''s ÿþà anderebungschließlichkeit"
        want = [np.array(x, self.dtype).tobytes() for x in self._by_word(probe)] if self.tok.pre_tokenizer is not None else None
        self.plain = want == [self._piece(p) for p in _PIECES.findall(probe.lower())]

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _by_word(self, text: str) -> list[list[int]]:
        e = self.tok.encode(text, add_special_tokens=False)
        out: dict[int, list[int]] = {}
        for word, i in zip(e.word_ids, e.ids, strict=True):
            out.setdefault(word, []).append(i)
        return list(out.values())

    def _piece(self, piece: str) -> bytes:
        spelt = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(spelt)], self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        if _OTHER.search(word):
            return np.array(self._ids(word), self.dtype).tobytes()
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(word.lower())))

    def _text(self, text: str) -> bytes:
        if not _OTHER.search(text):
            return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text.lower())))
        # these four spaces part words in any text, so words of other characters are encoded by themselves
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.words.__getitem__, words))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes."""
        if not self.plain:
            return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch(texts, add_special_tokens=False)]
        return [self._text(t) for t in texts]

    def counts(self, texts: list[str]) -> list[int]:
        """The number of ids of each text."""
        size, known = self.dtype.itemsize, self.sizes.__getitem__
        if not self.plain:
            return [len(b) // size for b in self(texts)]
        return [len(self._text(t)) // size if _OTHER.search(t) else sum(map(known, _PIECES.findall(t.lower()))) for t in texts]


def encoder(path: str, most: int = CACHE_PIECES) -> Encoder:
    """One encoder for each process and vocabulary: a task does not load it anew."""
    held = sys.modules.setdefault("_engramic_encoders", types.ModuleType("_engramic_encoders")).__dict__
    if (path, most) not in held:
        held[path, most] = Encoder(path, most)
    return held[path, most]


# ---------------------------------------------------------------- minimal perfect hash


def _slot_hash(fp: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(fp ^ (displacement.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))) % np.uint64(n)).astype(np.int64)


def build_mph(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displacements, slots) of distinct 64-bit keys: every key gets a slot of its own in 0..n-1."""
    n = len(keys)
    if not n:
        return np.zeros(1, np.uint32), np.zeros(0, np.int64)
    fp = mix64(keys)
    buckets = max(1, -(-n // KEYS_PER_BUCKET))
    bucket = (fp >> np.uint64(32)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    size = np.bincount(bucket, minlength=buckets)
    begin = np.cumsum(size) - size
    shift, slots, taken = np.zeros(buckets, np.uint32), np.empty(n, np.int64), np.zeros(n, bool)
    for b in np.argsort(-size, kind="stable").tolist():
        rows = order[begin[b] : begin[b] + size[b]]
        if not len(rows):
            break
        for block in itertools.count():
            d = np.arange(block * 64, block * 64 + 64, dtype=np.uint64)
            at = _slot_hash(fp[rows][None, :], d[:, None], n)
            free = ~taken[at].any(axis=1)
            for k in np.flatnonzero(free):
                if len(set(at[k].tolist())) == len(rows):
                    break
            else:
                continue
            shift[b], slots[rows], taken[at[k]] = d[k], at[k], True
            break
    return shift, slots


def find_slots(keys: np.ndarray, shift: np.ndarray, stored: np.ndarray) -> np.ndarray:
    """The slot of each key, or -1 for keys that are not stored."""
    n = len(stored)
    if not n:
        return np.full(len(keys), -1, np.int64)
    fp = mix64(keys)
    at = _slot_hash(fp, shift[(fp >> np.uint64(32)).astype(np.int64) % len(shift)], n)
    return np.where(stored[at] == fp, at, -1)


# ---------------------------------------------------------------- shards


#: The sections of an index after its header: the documents in file order, then the hash.
_SECTIONS = (("doc_id", "<i8", "rows"), ("known", "u1", "rows"), ("count", "<u4", "rows"), ("shift", "<u4", "buckets"), ("stored", "<u8", "keys"), ("where", "<u8", "keys"), ("many", "<u4", "keys"))
_HEAD = 8 + 5 * 8


def index_bytes(doc_ids: np.ndarray, known: np.ndarray, offset: np.ndarray, count: np.ndarray, width: int) -> bytes:
    """Header, all doc_ids in file order with their validity, the displacements, then the slots."""
    first = np.flatnonzero(known)
    keys, at = np.unique(doc_ids[first], return_index=True)
    rows = first[at]
    shift, slots = build_mph(keys.view(np.uint64))
    stored, where, many = np.empty(len(keys), "<u8"), np.empty(len(keys), "<u8"), np.empty(len(keys), "<u4")
    stored[slots], where[slots], many[slots] = mix64(keys.view(np.uint64)), offset[rows], count[rows]
    head = np.array([VERSION, width, len(doc_ids), len(keys), len(shift)], "<u8").tobytes()
    return b"".join([MAGIC, head, doc_ids.astype("<i8").tobytes(), known.astype(np.uint8).tobytes(), count.astype("<u4").tobytes(), shift.astype("<u4").tobytes(), stored.tobytes(), where.tobytes(), many.tobytes()])


class Shard:
    """One shard, opened for keyed access. A lookup seeks: it reads one displacement, one slot and the
    document's ids, whatever the size of the shard. ``bytes_read`` counts what was read."""

    def __init__(self, root: str, shard: int):
        self.index, self.data, self.bytes_read = open_file(root, f"shard-{shard:06d}.mph"), open_file(root, f"shard-{shard:06d}.ids"), 0
        head = self._at(self.index, 0, _HEAD)
        if head[:8] != MAGIC:
            raise ValueError(f"shard {shard} of {root} is not a token index")
        _, width, self.rows, self.keys, buckets = np.frombuffer(head, "<u8", 5, 8).tolist()
        self.width, sizes, at = np.dtype(f"<u{width}"), {"rows": self.rows, "keys": self.keys, "buckets": buckets}, _HEAD
        self.section: dict[str, tuple[int, np.dtype, int]] = {}
        for name, kind, size in _SECTIONS:
            dtype = np.dtype(kind)
            self.section[name] = (at, dtype, sizes[size])
            at += dtype.itemsize * sizes[size]

    def _at(self, file: pa.NativeFile, at: int, size: int) -> bytes:
        file.seek(at)
        self.bytes_read += size
        return file.read(size)

    def read(self, name: str, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Entries lo to hi of a section."""
        at, dtype, n = self.section[name]
        hi = n if hi is None else min(hi, n)
        return np.frombuffer(self._at(self.index, at + lo * dtype.itemsize, (hi - lo) * dtype.itemsize), dtype)

    def read_ids(self, offset: int, n: int) -> np.ndarray:
        return np.frombuffer(self._at(self.data, offset * self.width.itemsize, n * self.width.itemsize), self.width)

    def find(self, doc_id: int) -> tuple[int, int] | None:
        """(offset, number) of the document's ids, None if the shard does not have it."""
        if not self.keys:
            return None
        fp = mix64(np.array([doc_id], np.int64).view(np.uint64))
        bucket = int((fp[0] >> np.uint64(32)) % np.uint64(self.section["shift"][2]))
        slot = int(_slot_hash(fp, self.read("shift", bucket, bucket + 1), self.keys)[0])
        if self.read("stored", slot, slot + 1)[0] != fp[0]:
            return None
        return int(self.read("where", slot, slot + 1)[0]), int(self.read("many", slot, slot + 1)[0])

    def __getitem__(self, doc_id: int) -> np.ndarray:
        found = self.find(doc_id)
        if found is None:
            raise KeyError(doc_id)
        return self.read_ids(*found)

    def lookup(self, keys: np.ndarray, shift: np.ndarray, stored: np.ndarray) -> np.ndarray:
        """The slots of many keys, with the sections of the hash in memory (-1: not stored)."""
        return find_slots(keys.astype(np.int64).view(np.uint64), shift, stored)

    def close(self) -> None:
        self.index.close()
        self.data.close()


def write_tokens(docs: DataFrame, tokenizer: str, root: str | None = None, shards: int | None = None, end_id: int = END_ID) -> tuple[str, DataFrame]:
    """Writes the dataset and returns its folder and manifest (shard, first_key, n_docs, n_ids, base):
    a row for each shard; base counts the ids of all shards before it. Without ``root`` the dataset is a
    scratch table that goes at the end of the application. A task writes ids as it makes
    them; it keeps a doc_id and a count for each of its documents."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own, n = root is None, shards or shard_count(docs)
    root = root or scratch_path(spark, "tokens")
    splits = range_splits(docs, "doc_id", n)
    placed = docs.withColumn("shard", range_of(F.col("doc_id"), splits).cast("int"))
    placed = placed.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "text")
    schema = pa.schema([("shard", pa.int32()), ("first_key", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = text_slices(batches)
        got = next(slices, None)
        if got is None:
            return
        shard, encode, ids, counts = got[0].column("shard")[0].as_py(), encoder(tokenizer), [], []
        end, width = np.array([end_id], encode.dtype).tobytes(), encode.dtype.itemsize
        with put_file(root, f"shard-{shard:06d}.ids") as f:
            while got is not None:
                made = encode([t.decode() for t in got[1]])
                f.write(end.join([*made, b""]))
                counts.append(np.array([len(x) for x in made], np.int64) // width + 1)
                ids.append(got[0].column("doc_id"))
                got = next(slices, None)
        count, column = np.concatenate(counts), pa.chunked_array(ids)
        valid, keys = np.asarray(column.is_valid()), np.asarray(column.fill_null(0))
        with put_file(root, f"shard-{shard:06d}.mph") as f:
            f.write(index_bytes(keys, valid, np.cumsum(count) - count, count, width))
        yield record_batch({"shard": [shard], "first_key": [int(keys[valid][0]) if valid.any() else None], "n_docs": [len(keys)], "n_ids": [int(count.sum())]}, schema)

    rows = sorted(placed.mapInArrow(run, "shard int, first_key long, n_docs long, n_ids long").collect(), key=lambda r: r["shard"])
    base = itertools.accumulate([0, *(r["n_ids"] for r in rows)])
    manifest = spark.createDataFrame([(*r, b) for r, b in zip(rows, base, strict=False)], "shard int, first_key long, n_docs long, n_ids long, base long")
    manifest.coalesce(1).write.parquet(f"{root}/manifest")
    if own:
        delete_at_exit(spark, root)
    return root, manifest


def shard_count(docs: DataFrame) -> int:
    """Shards of about SHARD_BYTES of text, no fewer than there are tasks at a time."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(spread(docs.sparkSession), min(-(-size // SHARD_BYTES), MAX_SHARDS))


def token_counts(docs: DataFrame, tokenizer: str, pieces: int = CACHE_PIECES // 2) -> DataFrame:
    """(doc_id, size): the number of ids of every row's whole text (null: 0), without an end id."""
    schema = pa.schema([("doc_id", pa.int64()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            yield record_batch({"doc_id": batch.column("doc_id"), "size": encoder(tokenizer, pieces).counts([t.decode() for t in texts])}, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, size long")


def read_tokens(spark, root: str, with_ids: bool = False) -> DataFrame:
    """Per document of a dataset, from its files: doc_id, start, n_tokens, ids_crc32 (and the ids).
    Documents with a key are found through the index, the others by their place. A task holds the
    index of one shard and the ids of READ_ROWS documents."""
    manifest = spark.read.parquet(f"{root}/manifest")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(batch.column("shard").to_pylist(), batch.column("base").to_pylist(), strict=True):
                s = Shard(root, shard)
                shift, stored, where, many = (s.read(x) for x in ("shift", "stored", "where", "many"))
                at, before = 0, None
                for lo in range(0, s.rows, READ_ROWS):
                    key, valid, count = s.read("doc_id", lo, lo + READ_ROWS), s.read("known", lo, lo + READ_ROWS).astype(bool), s.read("count", lo, lo + READ_ROWS).astype(np.int64)
                    offset = at + np.cumsum(count) - count
                    at += int(count.sum())
                    # of rows that repeat a doc_id the index leads to the first
                    new = valid & np.concatenate([[key[0] != before], (key[1:] != key[:-1]) | ~valid[:-1]])
                    before = int(key[-1]) if valid[-1] else None
                    slot = s.lookup(key[new], shift, stored)
                    if (slot < 0).any():
                        raise ValueError(f"shard {shard} of {root}: its index lacks documents")
                    if len(slot):
                        offset[new], count[new] = where[slot], many[slot]
                    low = int(offset.min())
                    raw = s.read_ids(low, int((offset + count).max()) - low)
                    ids = [raw[o : o + c].astype("<u4") for o, c in zip((offset - low).tolist(), count.tolist(), strict=True)]
                    out = {"doc_id": pa.array(key, mask=~valid), "start": base + offset, "n_tokens": count, "ids_crc32": [zlib.crc32(x) for x in ids]}
                    yield record_batch(out | ({"ids": [x.tolist() for x in ids]} if with_ids else {}), schema)
                s.close()

    n = max(1, manifest.count())
    return manifest.select("shard", "base").repartitionById(n, F.pmod(F.col("shard"), F.lit(n)).cast("int")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def lookup_tokens(spark, root: str, keys: DataFrame) -> DataFrame:
    """(doc_id, ids) of the documents of ``keys(doc_id)`` that the dataset has: each key goes to the
    shard of its range and is found there in constant time."""
    shards = [(r["first_key"], r["shard"]) for r in spark.read.parquet(f"{root}/manifest").orderBy("shard").collect() if r["first_key"] is not None]
    if not shards:
        return spark.createDataFrame([], "doc_id long, ids array<long>")
    place = range_of(F.col("doc_id"), [k for k, _ in shards])
    at = F.element_at(F.array(*[F.lit(s) for _, s in shards]), F.greatest(place, F.lit(1)).cast("int"))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, None
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "ids": []}
            for shard, key in zip(batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist(), strict=True):
                if shard != number:
                    if held is not None:
                        held.close()
                    number, held = shard, Shard(root, shard)
                found = held.find(key)
                if found is not None:
                    out["doc_id"].append(key)
                    out["ids"].append(held.read_ids(*found).astype(np.int64).tolist())
            yield record_batch(out, schema)

    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("shard", at)
    return wanted.repartition("shard").sortWithinPartitions("shard", "doc_id").mapInArrow(run, "doc_id long, ids array<long>")
