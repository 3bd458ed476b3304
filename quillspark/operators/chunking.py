"""Chunkers that stay in built-in expressions: lines, sentences and overlapping windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sentences(text: Column) -> Column:
    """Pieces that end in a full stop, exclamation or question mark before white space."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.length(F.btrim(s)) > 0)


def packed(pieces: Column, limit: int, joiner: str = " ") -> Column:
    """Pieces joined in order as long as the joint length stays within ``limit``; a longer piece stands alone."""

    def step(acc: Column, x: Column) -> Column:
        n = F.size(acc)
        last = F.when(n > 0, F.element_at(acc, F.greatest(n, F.lit(1))))
        fits = (n > 0) & (F.length(last) + len(joiner) + F.length(x) <= limit)
        return F.when(fits, F.concat(F.slice(acc, 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(last, F.lit(joiner), x)))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(pieces, F.array().cast("array<string>"), step)


def windows(df: DataFrame, lines: str, size: int, overlap: int) -> DataFrame:
    """``df`` with (start, end, content) for windows of ``size`` lines that share ``overlap`` lines (start from 0)."""
    step = max(1, size - overlap)
    last = F.greatest(F.size(lines) - overlap - 1, F.lit(0))
    starts = F.when(F.size(lines) > 0, F.sequence(F.lit(0), last, F.lit(step)))
    return df.select("*", F.explode(starts).alias("start")).select(
        "*", F.least(F.col("start") + size, F.size(lines)).alias("end"), F.array_join(F.slice(lines, F.col("start") + 1, size), "\n").alias("content")
    )
