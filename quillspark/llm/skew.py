"""Joins of a table in which one key may hold a third of the rows.

A key is heavy if it holds more than 1 / ``most_keys`` of the rows, so there are at most ``most_keys`` of them at any
size of the table. Their rows on the other side, one for each key, are broadcast; all other keys are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import written

MOST_KEYS, LEAST_ROWS = 100_000, 1_000


def heavy_keys(counts: DataFrame, keys: list[str], total: int, most_keys: int = MOST_KEYS, least: int = LEAST_ROWS) -> DataFrame | None:
    """The heavy keys of a table of ``total`` rows, of which ``counts`` has ``n`` for each key; None if there is none."""
    bound = max(least, total // most_keys)
    if total <= bound:
        return None
    found = written(counts.filter(F.col("n") > bound).select(*keys), "heavy-keys")
    return None if found.isEmpty() else found


def heavy_of(table: DataFrame, keys: list[str], **how) -> DataFrame | None:
    """The heavy keys of a written table."""
    return heavy_keys(table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, table.count(), **how)


def skew_join(many: DataFrame, one: DataFrame, keys: list[str], heavy: DataFrame | None, how: str = "inner") -> DataFrame:
    """``many`` joined to ``one``, which has at most one row for each of the non-null ``keys``; ``how`` is inner or left."""
    if heavy is None:
        return many.join(one, keys, how)
    few = one.join(F.broadcast(heavy), keys, "left_semi")  # one row for each heavy key
    spread = many.join(F.broadcast(heavy), keys, "left_semi").join(F.broadcast(few), keys, how)
    return spread.unionByName(many.join(F.broadcast(heavy), keys, "left_anti").join(one, keys, how))
