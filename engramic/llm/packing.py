"""Packing sequences into token-budget batches by optimal length buckets.

Documents are cut into pieces of at most ``max_len`` tokens (no token is lost), so the global length
histogram has ``max_len`` bins however many documents there are. Dynamic programming over it chooses
the bucket boundaries that minimise the padding: boundary b_j pads every piece of length (b_{j-1},
b_j] to b_j. Inside each bucket batches of budget // boundary pieces are formed, in salted groups
of a bounded number of pieces, so that no bucket is ever sorted in one task. Pieces stand in the order
of a hash that has the number of the copy in it, so copies of a document lie apart.

Defined results: a null or empty text has no pieces and gives one row with piece null (it takes no
room); ties of the programme go to the smaller boundary; repeated rows are pieces of their own, told
apart by ``copy``; very long texts give many pieces; an empty table gives an empty result; other
columns are kept out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered_times, salted, staged
from .token_index import token_counts

MAX_LEN, BUCKETS, BUDGET = 4096, 16, 65_536
#: Pieces that one group of a bucket holds on the average.
GROUP_ROWS = 65_536


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> tuple[list[int], int]:
    """(ascending boundaries, padding) for a histogram with at most ``buckets`` buckets.

    cost(i, j) = sum over bins i < k <= j of counts[k] * (lengths[j] - lengths[k]).
    """
    order = np.argsort(lengths)
    x, c = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    x, c = x[c > 0], c[c > 0]
    n = len(x)
    if not n:
        return [], 0
    number, mass = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * x)])
    best = np.full(n + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    back = []
    for _ in range(min(buckets, n)):
        new, cut = np.full(n + 1, np.iinfo(np.int64).max // 4), np.zeros(n + 1, np.int64)
        new[0] = 0
        for j in range(1, n + 1):
            cost = best[:j] + x[j - 1] * (number[j] - number[:j]) - (mass[j] - mass[:j])
            i = int(cost.argmin())
            new[j], cut[j] = cost[i], i
        back.append(cut)
        best = new
    edges, j = [], n
    for cut in reversed(back):
        if j == 0:
            break
        edges.append(int(x[j - 1]))
        j = int(cut[j])
    return edges[::-1], int(best[n])


def pieces_of(docs: DataFrame, max_len: int = MAX_LEN, length: str = "size") -> DataFrame:
    """(doc_id, copy, piece, start_token, n_tokens): each document in pieces of at most ``max_len`` tokens.
    Rows that are equal in doc_id and length are counted before anything else, and numbered by copy."""
    last = F.ceil(F.col(length) / max_len).cast("long") - 1
    p = docs.groupBy("doc_id", length).agg(F.count(F.lit(1)).alias("_rows"))
    p = numbered_times(p, F.col("_rows"), "copy").select("doc_id", length, "copy", F.explode_outer(F.when(F.col(length) > 0, F.sequence(F.lit(0).cast("long"), last))).alias("piece"))
    return p.select("doc_id", "copy", "piece", (F.col("piece") * max_len).alias("start_token"), F.when(F.col("piece").isNotNull(), F.least(F.lit(max_len).cast("long"), F.col(length) - F.col("piece") * max_len)).alias("n_tokens"))


def pack(docs: DataFrame, max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET, group_rows: int = GROUP_ROWS, length: str = "size") -> DataFrame:
    """Every piece with its bucket's boundary, its padding and the batch it is in.

    ``docs(doc_id, size)``. Columns: doc_id, copy, piece, start_token, n_tokens, boundary, padding,
    group, batch (unique with boundary and group), row_in_batch.
    """
    if budget < max_len:
        raise ValueError("a batch must hold at least one piece of the greatest length")
    pieces = staged(pieces_of(docs, max_len, length), "pieces")
    hist = pieces.where("n_tokens is not null").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()  # max_len rows at most
    edges, _ = optimal_boundaries(np.array([r["n_tokens"] for r in hist], np.int64), np.array([r["n"] for r in hist], np.int64), buckets)
    rows_in = {e: 0 for e in edges}
    for r in hist:
        rows_in[min(e for e in edges if e >= r["n_tokens"])] += r["n"]
    boundary, number = F.lit(None).cast("long"), F.lit(None).cast("long")
    for e in reversed(edges):
        boundary = F.when(F.col("n_tokens") <= e, F.lit(e).cast("long")).otherwise(boundary)
        number = F.when(F.col("n_tokens") <= e, F.lit(rows_in[e]).cast("long")).otherwise(number)
    room = F.floor(F.lit(budget) / F.col("boundary"))
    t = pieces.withColumn("boundary", boundary).withColumn("_n", number)
    # a group holds about group_rows pieces, or one batch where that is more
    names = ["doc_id", "piece", "copy"]
    t = t.withColumn("group", salted(F.col("boundary"), F.col("_n"), F.greatest(F.lit(group_rows), room), *[F.col(c) for c in names]))
    at = F.row_number().over(Window.partitionBy("boundary", "group").orderBy(F.xxhash64(*names), *names)) - 1
    packed = t.where("n_tokens is not null").withColumn("_at", at).withColumn("batch", F.floor(F.col("_at") / room)).withColumn("row_in_batch", F.pmod(F.col("_at"), room).cast("long"))
    packed = packed.withColumn("padding", F.col("boundary") - F.col("n_tokens"))
    cols = ["doc_id", "copy", "piece", "start_token", "n_tokens", "boundary", "padding", "group", "batch", "row_in_batch"]
    nothing = [F.col(c) if c in cols[:5] else F.lit(None).cast("long").alias(c) for c in cols]
    return packed.select(*cols).unionByName(t.where("n_tokens is null").select(*nothing))


def packed_documents(docs: DataFrame, tokenizer: str, max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """``pack`` for the lengths of the whole texts in ids of the vocabulary at ``tokenizer``."""
    return pack(token_counts(docs, tokenizer), max_len, buckets, budget)
