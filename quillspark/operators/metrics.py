"""Metrics: aggregates by name and time bucket, rates, bottlenecks, calibration, alerts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.operators.catalog import numbered
from quillspark.session import bounded_broadcast, small_table

AGGREGATES = {
    "COUNT": lambda c: F.count(c).cast("double"),
    "SUM": F.sum,
    "AVG": F.avg,
    "MIN": F.min,
    "MAX": F.max,
}


def in_range(start: str, end: str) -> Column:
    """Both ends count."""
    return F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))


def aggregate(metrics: DataFrame, kinds: list[str], by: list[Column] = ()) -> DataFrame:
    """Aggregates of ``value`` for each group of ``by``; discrete percentiles (P50, P90, P99 and so on) come from counts, see ``percentile_by``."""
    plain, exact = [k for k in kinds if k in AGGREGATES], [k for k in kinds if k not in AGGREGATES]
    keyed = metrics.select(*by, "value")
    names = keyed.columns[:-1]
    out = keyed.groupBy(*names).agg(*[AGGREGATES[k](F.col("value")).alias(k.lower()) for k in plain]) if plain else keyed.select(*names).distinct()
    for k in exact:
        if not names:
            out = out.join(F.broadcast(exact_percentile(metrics, int(k[1:]) / 100)), how="left") if plain else exact_percentile(metrics, int(k[1:]) / 100)  # one row each
            continue
        found = percentile_by(keyed, int(k[1:]) / 100, names)
        same = [out[n].eqNullSafe(found[n]) for n in names]
        out = out.join(found, same, "left").select(*(out[c] for c in out.columns), k.lower())
    return out.select(*names, *(k.lower() for k in kinds))


#: Equal parts of a range of values that are counted at once; values that are sorted at the end.
PARTS, LEFT = 4096, 10_000


def exact_percentile(metrics: DataFrame, q: float) -> DataFrame:
    """The discrete percentile of ``value`` over all rows, one row; null if there is no value.

    Counts by parts of the range of values tell which part holds the rank; the search goes on in that part, between the least and the largest value
    it has, until it holds one value or few rows. Only counts are shuffled, ``PARTS`` of them; infinities are ranges of their own, NaN is the largest.
    """
    column, value = f"p{round(100 * q)}", F.col("value").cast("double")
    rows = metrics.select(value.alias("value")).filter(F.col("value").isNotNull())
    is_nan, sign = F.isnan("value"), F.when(F.col("value") == float("inf"), 1).when(F.col("value") == float("-inf"), -1).otherwise(0)
    place = F.when(is_nan, 2).otherwise(sign).alias("place")
    facts = sorted((r.place, r.n, r.lo, r.hi) for r in rows.groupBy(place).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect())
    answer, rank = None, max(math.ceil(q * sum(f[1] for f in facts)), 1)  # the rank, from 1
    for _, n, lo, hi in facts:
        if rank <= n:
            answer = _ranked(rows, rank, n, lo, hi)
            break
        rank -= n
    return small_table(metrics.sparkSession, [(None if answer is None else repr(answer),)], f"{column} string").select(F.col(column).cast("double").alias(column))


def _ranked(rows: DataFrame, rank: int, n: int, lo: float, hi: float) -> float:
    """The value at ``rank`` of the ``n`` rows from ``lo`` to ``hi``."""
    while lo < hi and n > LEFT:
        inside = rows.filter(F.col("value").between(lo, hi))
        part = F.least(F.width_bucket("value", F.lit(lo), F.lit(hi), F.lit(PARTS)), F.lit(PARTS)) if math.isfinite(hi - lo) else F.when(F.col("value") < 0, 0).otherwise(1)
        counted = inside.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        for r in sorted(counted.collect()):  # PARTS rows
            if rank <= r.n:
                n, lo, hi = r.n, r.lo, r.hi
                break
            rank -= r.n
    if not lo < hi:
        return lo
    return sorted(r.value for r in rows.filter(F.col("value").between(lo, hi)).collect())[rank - 1]  # LEFT rows


def percentile_by(metrics: DataFrame, q: float, by: list[str], parts: int = 256) -> DataFrame:
    """The discrete percentile of ``value`` for each group: counts by parts of the group's range, then counts by value in the part that holds the rank.

    Both are summed before they are shuffled, so no task holds a group's rows, and a window sees the different values of one part of a group. NaN is the largest value.
    """
    keys = [f"__g{k}" for k in range(len(by))]
    renamed = [F.col(n).alias(k) for n, k in zip(by, keys, strict=True)]
    rows = metrics.select(*by, F.col("value").cast("double").alias("value")).filter(F.col("value").isNotNull())
    number = F.when(~F.isnan("value"), F.col("value"))
    same = F.lit(True)
    for key, name in zip(keys, by, strict=True):
        same = same & F.col(name).eqNullSafe(F.col(key))
    ends = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.min(number).alias("__lo"), F.max(number).alias("__hi")).select(*renamed, "__n", "__lo", "__hi")
    width = F.col("__hi") - F.col("__lo")
    part = F.when(F.isnan("value"), parts + 1).when((width > 0) & (width < float("inf")), F.floor((F.col("value") - F.col("__lo")) / width * parts)).otherwise(0)
    counted = rows.join(ends, same).groupBy(*by, "value", part.alias("__part"), "__n").agg(F.count(F.lit(1)).alias("__c"))
    sums = counted.groupBy(*by, "__part").agg(F.sum("__c").alias("__c"), F.max("__n").alias("__n"))
    upto = F.sum("__c").over(W.partitionBy(*by).orderBy("__part"))
    rank = F.greatest(F.ceil(F.lit(q) * F.col("__n")), F.lit(1)) - (upto - F.col("__c"))
    held = sums.withColumn("__rank", rank).filter((F.col("__rank") >= 1) & (F.col("__rank") <= F.col("__c"))).select(*renamed, F.col("__part").alias("__at"), "__rank")
    left = counted.join(held, same & (F.col("__part") == F.col("__at")))
    reached = left.withColumn("__upto", F.sum("__c").over(W.partitionBy(*by).orderBy("value"))).filter(F.col("__upto") >= F.col("__rank"))
    return reached.groupBy(*by).agg(F.min("value").alias(f"p{round(100 * q)}"))


def finite(value: Column) -> Column:
    """The value, null if it is not a number or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def recent(metrics: DataFrame, names: list[str], kind: str = "SUM", hours: int = 24) -> DataFrame:
    """(metric_name, value) of the named metrics in the ``hours`` up to the newest row; the sum unless another aggregate is asked for."""
    last = F.broadcast(metrics.agg(F.max("ts").alias("__last")))  # one row
    rows = metrics.filter(F.col("metric_name").isin(names)).join(last, F.col("ts") > F.col("__last") - F.make_dt_interval(hours=F.lit(hours)))
    return rows.groupBy("metric_name").agg(finite(AGGREGATES[kind](F.col("value"))).alias("value"))


def snapshots(metrics: DataFrame, every: str = "5 minutes") -> DataFrame:
    """Count, sum and largest value of each metric in every interval: what a periodic snapshot writes. Also runs on a stream with a watermark."""
    w = F.window("ts", every)
    return metrics.groupBy(w.alias("w"), "metric_name").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("sum"), F.max("value").alias("max"))


def retained(alerts: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Alerts but those acknowledged ``days`` ago or earlier."""
    return alerts.filter(~(F.coalesce(F.col("acknowledged"), F.lit(False)) & (F.col("ts") < now - F.make_dt_interval(days=F.lit(days)))))


def success_rates(records: DataFrame) -> DataFrame:
    """(level, key, rate, n): overall, by task and by agent, in one pass over the records."""
    levels = F.array(
        F.struct(F.lit("overall").alias("level"), F.lit("").alias("key")), F.struct(F.lit("task").alias("level"), F.col("task_id").cast("string").alias("key")),
        F.struct(F.lit("agent").alias("level"), F.col("agent_id").cast("string").alias("key")),
    )
    each = records.select(F.explode(levels).alias("l"), "success")
    return each.groupBy("l.level", "l.key").agg(rate(F.col("success")).alias("rate"), F.count(F.lit(1)).alias("n"))


def before_after(metrics: DataFrame, by: str, order: list[str]) -> DataFrame:
    """(by, before, after): the mean value of the earlier half of each group's rows, one at least, and of the later half, by ranks of one sort."""
    ranked = numbered(metrics, [F.asc_nulls_first(by), *(F.asc(c) for c in order)], "__k")
    sizes = ranked.groupBy(F.col(by).alias("__by")).agg(F.min("__k").alias("__first"), F.count(F.lit(1)).alias("__n"))
    half = F.col("__first") + F.greatest(F.lit(1), F.floor(F.col("__n") / 2))
    met = ranked.join(bounded_broadcast(sizes, 100_000), F.col(by).eqNullSafe(F.col("__by")))
    mean = lambda keep: F.avg(F.when(keep, F.col("value")))
    return met.groupBy(by).agg(mean(F.col("__k") < half).alias("before"), mean(F.col("__k") >= half).alias("after"))


def bucket(unit: str) -> Column:
    return F.date_trunc(unit, "ts").alias("bucket")


def rate(ok: Column) -> Column:
    """Successes over all, 0 for none."""
    return F.coalesce(F.avg(ok.cast("double")), F.lit(0.0))


def bottlenecks(records: DataFrame, least: int = 3, slow_ms: float = 5000, failing: float = 0.2) -> DataFrame:
    """Operations and agents with ``least`` records or more that are slow or fail too often."""

    def of(kind: str, column: str) -> DataFrame:
        g = records.groupBy(F.col(column).cast("string").alias("name")).agg(
            F.count(F.lit(1)).alias("n"), F.avg("duration_ms").alias("mean_ms"), F.avg((~F.col("success")).cast("double")).alias("failure_rate")
        )
        return g.filter((F.col("n") >= least) & ((F.col("mean_ms") > slow_ms) | (F.col("failure_rate") > failing))).select(F.lit(kind).alias("kind"), "*")

    return of("operation", "operation").unionByName(of("agent", "agent_id"))


def strategies(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("failed"),
        F.avg(F.col("success").cast("double")).alias("success_rate"), F.avg("confidence").alias("mean_confidence"),
    )


def calibration(outcomes: DataFrame, bins: int = 5, closed_top: bool = False) -> DataFrame:
    """(bin, n, predicted, actual, error) by confidence; confidence 1.0 is in no bin unless ``closed_top``."""
    b = F.floor(F.col("confidence") * bins).cast("int")
    b = F.least(b, F.lit(bins - 1)) if closed_top else b
    g = outcomes.withColumn("bin", b).filter(F.col("bin").between(0, bins - 1)).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("success").cast("double")).alias("actual"))
    predicted = (F.col("bin") + 0.5) / bins
    return g.select("bin", "n", predicted.alias("predicted"), "actual", F.abs(predicted - F.col("actual")).alias("error"))


def alerts(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Metric rows at or above their name's enabled threshold."""
    few = bounded_broadcast(thresholds.filter("enabled"), 100_000)
    return metrics.join(few, "metric_name").filter(F.col("value") >= F.col("threshold"))
