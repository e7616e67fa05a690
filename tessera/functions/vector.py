"""Vector functions over array<double>. Lists go through higher-order functions, which suit a few
vectors a row; whole tables against one query are cheap too, as the query is a literal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.scalars import col


def vector(x) -> Column:
    """As array<double>; Python numbers become a literal."""
    if isinstance(x, Sequence) and not isinstance(x, str):
        return F.lit([float(v) for v in x]) if len(x) else F.array().cast("array<double>")
    return col(x).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(vector(a), vector(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(vector(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a, b) -> Column:
    """Null for a zero vector, so that a gate on it stays shut."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_distance(a, b) -> Column:
    return 1 - cosine(a, b)


def l2_distance(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(vector(a), vector(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def hashed_vector(tokens, dim: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: signed hash buckets of tokens, unit length."""
    slots = F.sequence(F.lit(0), F.lit(dim - 1))

    def at(i: Column) -> Column:
        return F.aggregate(
            col(tokens),
            F.lit(0.0),
            lambda s, t: s + F.when(F.pmod(F.xxhash64(t), F.lit(dim)) == i, F.when(F.xxhash64(F.lit(1), t) % 2 == 0, 1.0).otherwise(-1.0)).otherwise(0.0),
        )

    raw = F.transform(slots, at)
    return F.element_at(F.transform(F.array(raw), lambda v: F.transform(v, lambda x: F.coalesce(F.try_divide(x, norm(v)), F.lit(0.0)))), 1)


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_vector(text) -> Column:
    """A deterministic stand-in for an embedding model: how often each letter from a to z occurs."""
    return F.array(*((F.length(col(text)) - F.length(F.replace(col(text), F.lit(c)))).cast("double") for c in LETTERS))
