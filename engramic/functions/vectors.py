"""Vector functions over ARRAY columns, in double precision; null for null input where none is defined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import num, safe_div


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(num(a), num(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 for a zero vector, null components or unlike lengths."""
    same = F.size(num(a)) == F.size(num(b))
    na, nb = norm_a if norm_a is not None else norm(a), norm_b if norm_b is not None else norm(b)
    return F.when(same, safe_div(dot(a, b), na * nb)).otherwise(F.lit(0.0))


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(num(a), num(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))


def mean_abs(a: Column | str) -> Column:
    return safe_div(F.aggregate(num(a), F.lit(0.0), lambda s, v: s + F.abs(v.cast("double"))), F.size(num(a)))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of the sets of two arrays; 0 where both are empty or null."""
    return safe_div(F.size(F.array_intersect(num(a), num(b))), F.size(F.array_union(num(a), num(b))))


def neural_weights(relevance: Column, importance: Column, key: Column, size: int = 128) -> Column:
    """tanh(relevance * +-1 + importance * u), u in [0, 1) by a hash of the key and the place: the same
    row has the same weights in every run."""
    u = lambda i: F.pmod(F.xxhash64(key, i), F.lit(1_000_000)) / F.lit(1_000_000.0)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.tanh(relevance * F.when(i % 2 == 0, 1.0).otherwise(-1.0) + importance * u(i)))


def cosine_fixed(a: Column | str, b: Column | str, size: int) -> Column:
    """Cosine similarity over the first ``size`` components without any guard: NaN where either vector is
    shorter or has length zero."""
    first = lambda v: F.slice(num(v), 1, size)
    whole = (F.size(num(a)) >= size) & (F.size(num(b)) >= size)
    c = F.try_divide(dot(first(a), first(b)), norm(first(a)) * norm(first(b)))
    return F.coalesce(F.when(whole, c), F.lit(float("nan")))
