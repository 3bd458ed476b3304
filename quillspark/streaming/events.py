"""Structured Streaming forms of the event operators; each also runs on a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DELAY = "10 minutes"


def timed(events: DataFrame, column: str = "ts", delay: str = DELAY) -> DataFrame:
    """Event time as a zoned timestamp, which watermarks need, with the watermark set."""
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def debounced(events: DataFrame, key: str, gap: str) -> DataFrame:
    """One row for each burst of events of a key with less than ``gap`` between them: the last event counts."""
    session = F.session_window("ts", gap).alias("session")
    return events.groupBy(key, session).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))


def batched(events: DataFrame, width: str, key: str) -> DataFrame:
    """Different keys of each tumbling window."""
    return events.groupBy(F.window("ts", width).alias("window")).agg(F.array_sort(F.collect_set(key)).alias("keys"))


def of_type(events: DataFrame, *types: str) -> DataFrame:
    return events.filter(F.col("event_type").isin(list(types)))


def running_totals(events: DataFrame, key: str, value: str, threshold: float) -> DataFrame:
    """Running total of each key, and whether it has reached the threshold (update or complete mode)."""
    return events.groupBy(key).agg(F.sum(value).alias("total")).withColumn("alert", F.col("total") >= threshold)


def newest(events: DataFrame, capacity: int, key: str | None = None) -> DataFrame:
    """A bounded buffer that drops the oldest: the ``capacity`` newest events, of each key if one is named. For batches and micro-batches."""
    order = [F.desc("ts"), F.desc("event_id")]
    if key is None:
        return events.orderBy(*order).limit(capacity)
    return events.withColumn("__k", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("__k") <= capacity).drop("__k")


def server_sent(name: Column, payload: Column) -> Column:
    """An event as server-sent text: its name and its payload as JSON."""
    return F.concat(F.lit("event: "), name, F.lit("\ndata: "), F.to_json(payload), F.lit("\n\n"))
