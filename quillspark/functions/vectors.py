"""Vector expressions on array columns; sums are taken in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 1e-12  # squared norms up to this count as zero


def dot(a: Column, b: Column) -> Column:
    terms = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def normalised(v: Column) -> Column:
    """The vector over its length; zeros for a zero vector."""
    n2 = squared_norm(v)
    return F.when(n2 > ZERO, F.transform(v, lambda x: x.cast("double") / F.sqrt(n2))).otherwise(F.transform(v, lambda x: F.lit(0.0)))


def cosine(v: Column, query: list[float]) -> Column:
    """Cosine similarity to a fixed query vector, 0 for a zero vector on either side."""
    length = sum(x * x for x in query) ** 0.5
    if length * length <= ZERO:
        return F.lit(0.0)
    q = F.array(*[F.lit(float(x / length)) for x in query])
    n2 = squared_norm(v)
    return F.when(n2 > ZERO, dot(v, q) / F.sqrt(n2)).otherwise(0.0)


def is_unit(v: Column, tolerance: float = 1e-4) -> Column:
    return F.abs(squared_norm(v) - 1) < tolerance


def encoded(v: Column) -> Column:
    """A vector as text: ``[a, b, c]``."""
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ", "), F.lit("]"))


def decoded(text: Column) -> Column:
    """The vector of a text; blanks and empty places are passed over."""
    bare = F.regexp_replace(F.btrim(text), r"^\[|\]$", "")
    parts = F.filter(F.transform(F.split(bare, ","), lambda x: F.btrim(x)), lambda x: x != "")
    return F.transform(parts, lambda x: x.cast("float"))
