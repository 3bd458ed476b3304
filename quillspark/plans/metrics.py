"""Queries of the metrics half."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.operators import metrics as M
from quillspark.operators.catalog import numbered
from quillspark.plans.registry import Registry

REGISTRY = Registry()
add = REGISTRY.add

_SERIES_SQL = "m AS (SELECT event_id AS id, event_type AS metric_name, user_id AS agent_id, ts, value FROM events)"


def _series(t):
    return t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("metric_name"), F.col("user_id").alias("agent_id"), "ts", "value")


@add("metric_range", f"WITH {_SERIES_SQL} SELECT id, ts, value FROM m WHERE metric_name = 'click' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' ORDER BY ts, id")
def metric_range(t):
    return _series(t).filter((F.col("metric_name") == "click") & M.in_range("2024-01-05 00:00:00", "2024-01-12 00:00:00")).select("id", "ts", "value").orderBy("ts", "id")


@add("metric_by_agent", f"WITH {_SERIES_SQL} SELECT id, metric_name, ts FROM m WHERE agent_id = 7 AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20' ORDER BY ts, id")
def metric_by_agent(t):
    return _series(t).filter((F.col("agent_id") == 7) & M.in_range("2024-01-03 00:00:00", "2024-01-20 00:00:00")).select("id", "metric_name", "ts").orderBy("ts", "id")


_AGG_SQL = {
    "COUNT": "count(value)::DOUBLE", "SUM": "round(sum(value), 4)", "AVG": "round(avg(value), 6)", "MIN": "min(value)", "MAX": "max(value)",
    "P50": "quantile_disc(value, 0.5)", "P90": "quantile_disc(value, 0.9)", "P99": "quantile_disc(value, 0.99)",
}


def _scalar(kind: str):
    low = kind.lower()

    @add(f"metric_scalar_{low}", f"SELECT {_AGG_SQL[kind]} AS {low} FROM events WHERE event_type = 'purchase'")
    def body(t):
        rows = _series(t).filter("metric_name = 'purchase'")
        if kind.startswith("P"):
            return M.exact_percentile(rows, int(kind[1:]) / 100)
        out = M.aggregate(rows, [kind])
        return out.withColumn(low, F.round(low, {"SUM": 4, "AVG": 6}[kind])) if kind in ("SUM", "AVG") else out


for _kind in _AGG_SQL:
    _scalar(_kind)


def _bucketed(unit: str):
    @add(f"metric_bucket_{unit}", f"""SELECT date_trunc('{unit}', ts)::TIMESTAMP AS bucket, round(sum(value), 4) AS sum, count(value)::DOUBLE AS count, quantile_disc(value, 0.9) AS p90
FROM events WHERE event_type = 'view' GROUP BY 1 ORDER BY 1""")
    def body(t):
        out = M.aggregate(_series(t).filter("metric_name = 'view'"), ["SUM", "COUNT", "P90"], [M.bucket(unit)])
        return out.withColumn("sum", F.round("sum", 4)).withColumn("bucket", F.col("bucket").cast("timestamp_ntz")).orderBy("bucket")


for _unit in ("minute", "hour", "day"):
    _bucketed(_unit)


@add("metrics_multi", """
SELECT event_type AS metric_name, date_trunc('day', ts)::TIMESTAMP AS bucket, round(sum(value), 4) AS sum, count(*)::DOUBLE AS count, max(value) AS max FROM events
WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1, 2""")
def metrics_multi(t):
    rows = _series(t).filter(F.col("metric_name").isin("click", "view", "purchase"))
    out = M.aggregate(rows, ["SUM", "COUNT", "MAX"], [F.col("metric_name"), M.bucket("day")])
    return out.withColumn("sum", F.round("sum", 4)).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@add("token_report", """
SELECT conv_id, role, sum(length(text) // 4)::BIGINT AS tokens, grouping(conv_id, role)::BIGINT AS level FROM conversations GROUP BY GROUPING SETS ((), (conv_id), (role))""")
def token_report(t):
    c = t.conversations.select("conv_id", "role", F.floor(F.length("text") / 4).alias("n"))
    c.createOrReplaceTempView("quillspark_token_report")
    return t.spark.sql("SELECT conv_id, role, sum(n) AS tokens, grouping_id() AS level FROM quillspark_token_report GROUP BY GROUPING SETS ((), (conv_id), (role))").select("conv_id", "role", "tokens", F.col("level").cast("long").alias("level"))


_RECORDS_SQL = "r AS (SELECT event_type AS operation, user_id AS agent_id, event_id % 100 AS task_id, (value * 100)::BIGINT AS duration_ms, event_id % 5 <> 0 AS success FROM events)"


def _records(t):
    return t.events.select(
        F.col("event_type").alias("operation"), F.col("user_id").alias("agent_id"), (F.col("event_id") % 100).alias("task_id"),
        F.round(F.col("value") * 100).cast("long").alias("duration_ms"), (F.col("event_id") % 5 != 0).alias("success"),
    )


@add("success_rates", f"""WITH {_RECORDS_SQL}, l AS (SELECT 'overall' AS level, '' AS key, success FROM r UNION ALL SELECT 'task', task_id::VARCHAR, success FROM r UNION ALL SELECT 'agent', agent_id::VARCHAR, success FROM r)
SELECT level, key, round(avg(success::INT), 6) AS rate, count(*)::BIGINT AS n FROM l GROUP BY level, key""")
def success_rates(t):
    return M.success_rates(_records(t)).withColumn("rate", F.round("rate", 6))


@add("metrics_recent", """
SELECT event_type AS metric_name, round(sum(value), 4) AS value FROM events WHERE event_type IN ('click', 'view', 'purchase') AND ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY 1""")
def metrics_recent(t):
    return M.recent(_series(t), ["click", "view", "purchase"]).withColumn("value", F.round("value", 4))


@add("metrics_not_finite", "SELECT event_type AS metric_name, CASE WHEN event_type = 'view' THEN NULL ELSE round(max(value), 4) END AS value FROM events GROUP BY 1")
def metrics_not_finite(t):
    odd = F.when(F.col("metric_name") == "view", F.lit(float("inf"))).otherwise(F.col("value"))
    return _series(t).withColumn("value", odd).groupBy("metric_name").agg(F.round(M.finite(F.max("value")), 4).alias("value"))


@add("metric_snapshots", """
SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS started, event_type AS metric_name, count(*)::BIGINT AS n, round(sum(value), 4) AS sum, max(value) AS max FROM events GROUP BY 1, 2""")
def metric_snapshots(t):
    s = M.snapshots(_series(t).withColumn("ts", F.col("ts").cast("timestamp")))
    return s.select(F.col("w.start").cast("timestamp_ntz").alias("started"), "metric_name", "n", F.round("sum", 4).alias("sum"), "max")


@add("alert_retention", """
SELECT event_id AS id FROM events WHERE NOT (event_id % 3 = 0 AND ts < TIMESTAMP '2024-01-20' - INTERVAL 7 DAY)""")
def alert_retention(t):
    a = t.events.select(F.col("event_id").alias("id"), "ts", (F.col("event_id") % 3 == 0).alias("acknowledged"))
    return M.retained(a, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("id")


@add("mean_duration", f"WITH {_RECORDS_SQL} SELECT task_id, trunc(avg(duration_ms))::BIGINT AS mean_ms FROM r GROUP BY task_id")
def mean_duration(t):
    return _records(t).groupBy("task_id").agg(F.avg("duration_ms").cast("long").alias("mean_ms"))


@add("bottlenecks", f"""
WITH {_RECORDS_SQL}, g AS (SELECT 'operation' AS kind, operation AS name, * EXCLUDE (operation) FROM r UNION ALL SELECT 'agent', agent_id::VARCHAR, * EXCLUDE (operation) FROM r)
SELECT kind, name, count(*)::BIGINT AS n, round(avg(duration_ms), 4) AS mean_ms, round(avg((NOT success)::INT), 6) AS failure_rate FROM g GROUP BY kind, name
HAVING count(*) >= 3 AND (avg(duration_ms) > 5000 OR avg((NOT success)::INT) > 0.2)""")
def bottlenecks(t):
    return M.bottlenecks(_records(t)).withColumn("mean_ms", F.round("mean_ms", 4)).withColumn("failure_rate", F.round("failure_rate", 6))


_OUTCOMES_SQL = """o AS (SELECT l.doc_id AS decision_id, d.lang AS task_type, CASE d.n_chars % 4 WHEN 0 THEN 'SOLO' WHEN 1 THEN 'CONSENSUS' WHEN 2 THEN 'SEQUENTIAL' ELSE 'PARALLEL' END AS strategy,
  (d.n_chars % 101) / 100.0::DOUBLE AS confidence, quality = 1 AS success FROM labels l JOIN documents d USING (doc_id))"""


def _outcomes(t):
    names = F.array(*[F.lit(x) for x in ("SOLO", "CONSENSUS", "SEQUENTIAL", "PARALLEL")])
    return t.labels.join(t.documents, "doc_id").select(
        F.col("doc_id").alias("decision_id"), F.col("lang").alias("task_type"), F.get(names, (F.col("n_chars") % 4).cast("int")).alias("strategy"),
        (F.col("n_chars") % 101 / 100.0).alias("confidence"), (F.col("quality") == 1).alias("success"),
    )


@add("strategy_metrics", f"""WITH {_OUTCOMES_SQL} SELECT strategy, count(*)::BIGINT AS n, count(*) FILTER (success)::BIGINT AS ok, count(*) FILTER (NOT success)::BIGINT AS failed,
  round(avg(success::INT), 6) AS success_rate, round(avg(confidence), 6) AS mean_confidence FROM o GROUP BY strategy""")
def strategy_metrics(t):
    return M.strategies(_outcomes(t)).withColumn("success_rate", F.round("success_rate", 6)).withColumn("mean_confidence", F.round("mean_confidence", 6))


@add("routing_accuracy", f"WITH {_OUTCOMES_SQL} SELECT round(avg(success::INT), 6) AS accuracy FROM o")
def routing_accuracy(t):
    return _outcomes(t).agg(F.round(M.rate(F.col("success")), 6).alias("accuracy"))


_CAL_SQL = """c AS (SELECT floor(confidence * 5)::INT AS bin, count(*)::BIGINT AS n, avg(success::INT) AS actual FROM o WHERE confidence < 1 GROUP BY 1),
e AS (SELECT bin, n, (bin + 0.5::DOUBLE) / 5 AS predicted, actual, abs((bin + 0.5::DOUBLE) / 5 - actual) AS error FROM c)"""


@add("confidence_calibration", f"WITH {_OUTCOMES_SQL}, {_CAL_SQL} SELECT bin, n, round(predicted, 6) AS predicted, round(actual, 6) AS actual, round(error, 6) AS error FROM e")
def confidence_calibration(t):
    c = M.calibration(_outcomes(t))
    return c.select("bin", "n", *[F.round(x, 6).alias(x) for x in ("predicted", "actual", "error")])


@add("calibrator_weighted_error", f"""WITH {_OUTCOMES_SQL}, {_CAL_SQL}, w AS (SELECT sum(error * n) / sum(n) AS e FROM e)
SELECT round(e, 6) AS weighted_error, round(greatest(0.05::DOUBLE, least(1.0::DOUBLE, 0.25::DOUBLE * (0.7::DOUBLE + 0.3::DOUBLE * greatest(0.0::DOUBLE, 1 - e)))), 3) AS weight FROM w""")
def calibrator_weighted_error(t):
    e = M.calibration(_outcomes(t)).agg((F.sum(F.col("error") * F.col("n")) / F.sum("n")).alias("e"))
    factor = F.greatest(F.lit(0.0), 1 - F.col("e"))
    return e.select(F.round("e", 6).alias("weighted_error"), F.round(F.greatest(F.lit(0.05), F.least(F.lit(1.0), 0.25 * (0.7 + 0.3 * factor))), 3).alias("weight"))


@add("calibrator_adjustments", f"""WITH {_OUTCOMES_SQL}, s AS (SELECT strategy, count(*) AS n, avg(success::INT) AS r FROM o GROUP BY 1)
SELECT strategy, round(CASE WHEN n < 10 THEN 0.2::DOUBLE ELSE greatest(0.05::DOUBLE, least(0.4::DOUBLE, 0.2::DOUBLE * (1 + (r - 0.75::DOUBLE) * 0.5::DOUBLE))) END, 3) AS adjustment FROM s""")
def calibrator_adjustments(t):
    s = M.strategies(_outcomes(t))
    scaled = 0.2 * (1 + (F.col("success_rate") - 0.75) * 0.5)
    return s.select("strategy", F.round(F.when(F.col("n") < 10, 0.2).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(0.4), scaled))), 3).alias("adjustment"))


@add("optimal_strategy", f"""WITH {_OUTCOMES_SQL}, s AS (SELECT task_type, strategy, count(*) FILTER (success)::BIGINT AS ok FROM o GROUP BY 1, 2)
SELECT task_type, strategy, ok FROM (SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY ok DESC, strategy) AS k FROM s) WHERE k = 1""")
def optimal_strategy(t):
    s = _outcomes(t).groupBy("task_type", "strategy").agg(F.count_if("success").alias("ok"))
    k = F.row_number().over(W.partitionBy("task_type").orderBy(F.desc("ok"), "strategy"))
    return s.withColumn("k", k).filter("k = 1").drop("k")


@add("decision_patterns", f"""WITH {_OUTCOMES_SQL}, {_CAL_SQL}, s AS (SELECT strategy, count(*) AS n, avg(success::INT) AS r, avg(confidence) AS c FROM o GROUP BY 1)
SELECT 'high_success' AS pattern, strategy AS subject FROM s WHERE n >= 10 AND r > 0.8 UNION ALL SELECT 'low_success', strategy FROM s WHERE n >= 10 AND r < 0.5
UNION ALL SELECT 'overconfident', strategy FROM s WHERE n >= 5 AND c > r UNION ALL SELECT 'miscalibrated', bin::VARCHAR FROM e WHERE n >= 5 AND error > 0.2""")
def decision_patterns(t):
    o = _outcomes(t)
    s, c = M.strategies(o), M.calibration(o)
    pick = lambda df, name, cond, subject: df.filter(cond).select(F.lit(name).alias("pattern"), F.col(subject).cast("string").alias("subject"))
    return (
        pick(s, "high_success", "n >= 10 AND success_rate > 0.8", "strategy")
        .unionByName(pick(s, "low_success", "n >= 10 AND success_rate < 0.5", "strategy"))
        .unionByName(pick(s, "overconfident", "n >= 5 AND mean_confidence > success_rate", "strategy"))
        .unionByName(pick(c, "miscalibrated", "n >= 5 AND error > 0.2", "bin"))
    )


_ALERTS_SQL = f"""{_SERIES_SQL}, th(metric_name, threshold, severity, enabled) AS (VALUES ('click', 90.0::DOUBLE, 'WARNING', TRUE), ('purchase', 95.0::DOUBLE, 'CRITICAL', TRUE), ('view', 10.0::DOUBLE, 'INFO', FALSE)),
a AS (SELECT m.*, severity, threshold FROM m JOIN th USING (metric_name) WHERE enabled AND value >= threshold)"""


def _alerts(t):
    rows = [("click", 90.0, "WARNING", True), ("purchase", 95.0, "CRITICAL", True), ("view", 10.0, "INFO", False)]
    return M.alerts(_series(t), t.spark.createDataFrame(rows, "metric_name string, threshold double, severity string, enabled boolean"))


@add("alert_eval", f"WITH {_ALERTS_SQL} SELECT row_number() OVER (ORDER BY ts, id) AS alert_no, id, metric_name, severity, value FROM a")
def alert_eval(t):
    return numbered(_alerts(t), [F.asc("ts"), F.asc("id")], "alert_no").select("alert_no", "id", "metric_name", "severity", "value")


@add("alert_summary", f"WITH {_ALERTS_SQL} SELECT severity, metric_name, count(*)::BIGINT AS n FROM a GROUP BY GROUPING SETS ((severity), (metric_name))")
def alert_summary(t):
    a = _alerts(t)
    none = F.lit(None).cast("string")
    by = lambda s, m, key: a.groupBy(key).agg(F.count(F.lit(1)).alias("n")).select(s.alias("severity"), m.alias("metric_name"), "n")
    return by(F.col("severity"), none, "severity").unionByName(by(none, F.col("metric_name"), "metric_name"))


@add("alert_query", f"WITH {_ALERTS_SQL} SELECT id, ts, agent_id FROM a WHERE severity = 'WARNING' ORDER BY ts DESC, id")
def alert_query(t):
    return _alerts(t).filter("severity = 'WARNING'").orderBy(F.desc("ts"), "id").select("id", "ts", "agent_id")


@add("before_after_delta", """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, round(avg(value) FILTER (k <= greatest(1, n // 2)), 6) AS before, round(avg(value) FILTER (k > greatest(1, n // 2)), 6) AS after FROM r GROUP BY event_type""")
def before_after_delta(t):
    out = M.before_after(t.events.select("event_type", "ts", "event_id", "value"), "event_type", ["ts", "event_id"])
    return out.select("event_type", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))


@add("usage_stats", "SELECT count(*)::BIGINT AS n, coalesce(sum(n_chars // 4), 0)::BIGINT AS tokens, round(coalesce(avg(n_chars), 0), 4) AS mean FROM documents")
def usage_stats(t):
    return t.documents.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.floor(F.col("n_chars") / 4)), F.lit(0)).alias("tokens"), F.round(F.coalesce(F.avg("n_chars"), F.lit(0.0)), 4).alias("mean"))


@add("recent_activity", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 15")
def recent_activity(t):
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(15).select("event_id", "ts", "event_type")


@add("batch_index_stats", "SELECT count(*)::BIGINT AS files, sum(n_chars)::BIGINT AS chars, round(count(*) / 12.5::DOUBLE, 4) AS per_second, count(*) / 12.5 < 100 AS slow FROM documents")
def batch_index_stats(t):
    n = F.count(F.lit(1))
    return t.documents.agg(n.alias("files"), F.sum("n_chars").alias("chars"), F.round(n / 12.5, 4).alias("per_second"), (n / 12.5 < 100).alias("slow"))


@add("metric_tags", """SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY 1""")
def metric_tags(t):
    k = F.from_json("props", "k long")["k"]
    return t.events.groupBy("event_type").agg(F.sum(k).alias("k"))


# ---- what the streaming operators compute, over the whole table ----

@add("debounce_sessions", """
WITH l AS (SELECT user_id, ts, event_id, event_type, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
s AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM l)
SELECT user_id, min(ts) AS started, count(*)::BIGINT AS n, max(event_id) FILTER (TRUE)::BIGINT AS last_id FROM s GROUP BY user_id, k""")
def debounce_sessions(t):
    from quillspark.streaming.events import debounced

    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return debounced(e, "user_id", "30 minutes").select("user_id", F.col("session.start").cast("timestamp_ntz").alias("started"), "n", "last_id")


@add("tumbling_counts", "SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def tumbling_counts(t):
    w = F.window(F.col("ts").cast("timestamp"), "15 minutes")
    return t.events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@add("running_tokens_alert", """
WITH c AS (SELECT conv_id, turn, sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS running FROM conversations) SELECT conv_id, turn, running FROM c WHERE running >= 200""")
def running_tokens_alert(t):
    n = F.sum(F.floor(F.length("text") / 4)).over(W.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.select("conv_id", "turn", n.alias("running")).filter("running >= 200")


@add("newest_events", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 5")
def newest_events(t):
    from quillspark.streaming.events import newest

    return newest(t.events, 5, "user_id").select("event_id", "user_id")


@add("server_sent_events", """SELECT event_id, 'event: ' || event_type || chr(10) || 'data: {"id":' || event_id || ',"user":' || user_id || '}' || chr(10) || chr(10) AS text FROM events""")
def server_sent_events(t):
    from quillspark.streaming.events import server_sent

    return t.events.select("event_id", server_sent(F.col("event_type"), F.struct(F.col("event_id").alias("id"), F.col("user_id").alias("user"))).alias("text"))
