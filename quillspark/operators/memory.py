"""Conversation memory: totals, pruning and summarising to a budget."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pruned(messages: DataFrame, most: int) -> DataFrame:
    """The newest messages of each task that fit in ``most`` tokens together."""
    later = F.sum("tokens").over(W.partitionBy("task_id").orderBy(F.desc("ts")).rowsBetween(W.unboundedPreceding, 0))
    return messages.withColumn("suffix", later).filter(F.col("suffix") <= most)


def summarised(messages: DataFrame, most: int, share: float = 0.35, keep: int = 3) -> DataFrame:
    """Histories fitted to ``most`` tokens: the oldest ``share`` becomes one SUMMARY row, again while more than ``keep`` rows are left; then the oldest go.

    A summary counts a quarter of what it stands for, one token at least. A history within the budget is left as it is; the others are folded, a
    task's messages in one array. Every summary takes ``share`` of the rows, two at least, so the steps are bounded by the logarithm of their number.
    """
    key, tokens = "task_id", F.coalesce(F.col("tokens").cast("long"), F.lit(0).cast("long"))
    row = F.struct(F.col("ts").cast("long").alias("ts"), "role", tokens.alias("tokens"))
    histories = messages.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("all"), F.sum(tokens).alias("total"))
    total = lambda rows: F.aggregate(rows, F.lit(0).cast("long"), lambda acc, r: acc + r["tokens"])

    def step(rows: Column, _: Column) -> Column:
        n = F.greatest(F.lit(2), F.floor(F.size(rows) * share)).cast("int")
        oldest = F.slice(rows, F.lit(1), n)
        summary = F.struct(F.element_at(rows, 1)["ts"].alias("ts"), F.lit("SUMMARY").alias("role"), F.greatest(F.lit(1).cast("long"), F.floor(total(oldest) / 4)).alias("tokens"))
        shorter = F.concat(F.array(summary), F.slice(rows, n + 1, F.greatest(F.size(rows) - n, F.lit(0))))
        return F.when((F.size(rows) > keep) & (total(rows) > most), shorter).otherwise(rows)

    steps = math.ceil(31 * math.log(2) / -math.log(1 - min(share, 0.9))) + 8  # an array has fewer than 2**31 rows
    folded = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("all"), step)
    long = histories.filter(F.col("total") > most).select(key, F.explode(F.array(folded)).alias("all"))
    each = histories.filter(F.col("total") <= most).select(key, "all").unionByName(long).select(key, F.posexplode("all").alias("at", "r"))
    later = F.sum("r.tokens").over(W.partitionBy(key).orderBy(F.desc("at")).rowsBetween(W.unboundedPreceding, 0))
    return each.withColumn("__later", later).filter(F.col("__later") <= most).select(key, "r.ts", "r.role", "r.tokens")
