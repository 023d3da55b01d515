"""Vector and scoring expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def to_text(vector: Column) -> Column:
    """``[x,y,...]``."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), F.lit("]"))


def from_text(text: Column) -> Column:
    """The vector of ``[x,y,...]``; null if it isn't one."""
    return F.from_json(text, "array<double>")


def head(vector: Column, n: int) -> Column:
    """First ``n`` dimensions, not normalised again."""
    return F.slice(vector, 1, n)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.sqrt(_sum(F.transform(vector.cast("array<double>"), lambda x: x * x)))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y))


def cosine_distance(a: Column, b: Column) -> Column:
    """Null where either vector is zero."""
    return 1.0 - F.try_divide(dot(a, b), norm(a) * norm(b))


def bm25(tf: Column, df: Column, dl: Column, avgdl: Column, n: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """Score of one term; 0 where it doesn't occur."""
    idf = F.ln((n - df + 0.5) / (df + 0.5) + 1.0)
    return F.when(tf > 0, idf * bm25_gain(tf, dl, avgdl, k1, b)).otherwise(F.lit(0.0))


def bm25_gain(tf: Column, dl: Column, avgdl: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """What a term's frequency counts for, before its rarity."""
    return tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl / avgdl))


def reciprocal_rank(rank: Column, k: int = 60) -> Column:
    """Share of a 0-based rank in a fused score."""
    return 1.0 / (k + rank + 1.0)


def hashed_embedding(term_list: Column, dims: int) -> Column:
    """Deterministic bag-of-hashed-terms vector, a local stand-in for a model."""
    buckets = F.transform(term_list, lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % dims).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.size(F.filter(buckets, lambda b: b == d)).cast("double"))


def coverage(query_terms: Sequence[str], term_list: Column) -> Column:
    """Share of the query's terms that occur, a local stand-in for a cross-encoder."""
    wanted = F.array(*[F.lit(t) for t in query_terms])
    return F.size(F.array_intersect(wanted, term_list)) / F.lit(float(len(set(query_terms))))
