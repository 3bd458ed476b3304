"""Queries of the task, consensus, routing and memory half."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import routing as RT
from quillspark.functions import values as VL
from quillspark.functions import vectors as VC
from quillspark.operators import completion as CP
from quillspark.operators import consensus as CS
from quillspark.operators import fileops as FO
from quillspark.operators import memory as MM
from quillspark.operators import tasks as TK
from quillspark.plans.registry import Registry

REGISTRY = Registry()
add = REGISTRY.add

_TASKS_SQL = """tasks AS (SELECT o_orderkey AS id, 'Order ' || o_orderkey AS title, CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'F' THEN 'COMPLETED' ELSE 'IN_PROGRESS' END AS status,
  o_orderpriority AS type, o_custkey AS assignee, o_orderdate AS created_at, (1 + o_orderkey % 10)::INT AS risk, (1 + o_custkey % 10)::INT AS complexity FROM orders)"""


def _tasks(t):
    status = F.when(F.col("o_orderstatus") == "O", "PENDING").when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("IN_PROGRESS")
    return t.orders.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), status.alias("status"), F.col("o_orderpriority").alias("type"),
        F.array("o_custkey").alias("assignee_ids"), F.col("o_orderdate").alias("created_at"), (1 + F.col("o_orderkey") % 10).cast("int").alias("risk"), (1 + F.col("o_custkey") % 10).cast("int").alias("complexity"),
    )


@add("tasks_filtered", f"WITH {_TASKS_SQL} SELECT id, status, created_at FROM tasks WHERE status = 'PENDING' AND assignee IN (7, 11, 13) AND created_at BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '2030-01-01'")
def tasks_filtered(t):
    keep = TK.matching(status=["PENDING"], assignees=[7, 11, 13], since="1995-01-01", until="2030-01-01")
    return _tasks(t).filter(keep).select("id", "status", "created_at")


@add("tasks_rich_filter", f"WITH {_TASKS_SQL} SELECT id, type FROM tasks WHERE status IN ('PENDING', 'COMPLETED') AND risk BETWEEN 3 AND 6 AND complexity BETWEEN 2 AND 9 AND (contains(id::VARCHAR, '12') OR contains(lower(title), '12'))")
def tasks_rich_filter(t):
    return _tasks(t).filter(TK.matching(status=["PENDING", "COMPLETED"], risk=(3, 6), complexity=(2, 9), search="12")).select("id", "type")


@add("tasks_page", f"WITH {_TASKS_SQL} SELECT id, status, type FROM tasks ORDER BY created_at DESC, id LIMIT 50 OFFSET 100")
def tasks_page(t):
    return TK.page(_tasks(t), [F.desc("created_at"), F.asc("id")], 3, 50).select("id", "status", "type")


@add("tasks_page_total", f"WITH {_TASKS_SQL} SELECT status, count(*)::BIGINT AS total FROM tasks GROUP BY status")
def tasks_page_total(t):
    return _tasks(t).groupBy("status").agg(F.count(F.lit(1)).alias("total"))


@add("tasks_enum_sort", f"WITH {_TASKS_SQL} SELECT id, type FROM tasks ORDER BY list_position(['PENDING', 'IN_PROGRESS', 'COMPLETED'], status), type, id LIMIT 40")
def tasks_enum_sort(t):
    place = F.array_position(F.array(*map(F.lit, ("PENDING", "IN_PROGRESS", "COMPLETED"))), F.col("status"))
    return _tasks(t).orderBy(place, "type", "id").limit(40).select("id", "type")


@add("pending_priority", f"WITH {_TASKS_SQL} SELECT id, (risk * 10 + complexity)::INT AS priority, title AS preview FROM tasks WHERE status = 'PENDING' ORDER BY risk * 10 + complexity DESC, created_at, id LIMIT 25")
def pending_priority(t):
    p = _tasks(t).filter("status = 'PENDING'").withColumn("priority", TK.priority(F.col("risk"), F.col("complexity")))
    return p.orderBy(F.desc("priority"), "created_at", "id").limit(25).select("id", "priority", TK.preview(F.col("title")).alias("preview"))


@add("agent_tasks", f"WITH {_TASKS_SQL} SELECT id FROM tasks WHERE assignee = 42")
def agent_tasks(t):
    return _tasks(t).filter(F.array_contains("assignee_ids", F.lit(42).cast("long"))).select("id")


@add("active_tasks", f"WITH {_TASKS_SQL} SELECT id, status FROM tasks WHERE status IN ('PENDING', 'IN_PROGRESS', 'WAITING_INPUT') ORDER BY created_at, id")
def active_tasks(t):
    return _tasks(t).filter(TK.matching(status=TK.ACTIVE)).orderBy("created_at", "id").select("id", "status")


@add("home_stats", f"WITH {_TASKS_SQL} SELECT count(*)::BIGINT AS total, count(*) FILTER (status = 'PENDING')::BIGINT AS pending, count(*) FILTER (status = 'COMPLETED')::BIGINT AS completed, count(DISTINCT assignee)::BIGINT AS agents FROM tasks")
def home_stats(t):
    x = _tasks(t).withColumn("assignee", F.get("assignee_ids", F.lit(0)))
    return x.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "PENDING").alias("pending"), F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.countDistinct("assignee").alias("agents"))


@add("activity_feed", f"""WITH {_TASKS_SQL}, f AS (SELECT id, 'created' AS what, created_at AS moment FROM tasks UNION ALL SELECT id, 'completed', created_at + INTERVAL 1 DAY FROM tasks WHERE status = 'COMPLETED')
SELECT id, what, moment FROM f ORDER BY moment DESC, id, what LIMIT 30""")
def activity_feed(t):
    row = lambda what, at: F.struct(F.lit(what).alias("what"), at.alias("moment"))
    done = row("completed", F.col("created_at") + F.expr("INTERVAL 1 DAY"))
    both = F.when(F.col("status") == "COMPLETED", F.array(row("created", F.col("created_at")), done)).otherwise(F.array(row("created", F.col("created_at"))))
    return _tasks(t).select("id", F.explode(both).alias("e")).select("id", "e.what", "e.moment").orderBy(F.desc("moment"), "id", "what").limit(30)


@add("cas_status", f"""WITH {_TASKS_SQL} SELECT id, CASE WHEN status = 'PENDING' AND type = '1-URGENT' THEN 'IN_PROGRESS' ELSE status END AS status, status = 'PENDING' AND type = '1-URGENT' AS changed FROM tasks""")
def cas_status(t):
    x = _tasks(t)
    return TK.compare_and_set(x.select("id", "status"), x.filter("type = '1-URGENT'").select("id", F.lit("PENDING").alias("expected"), F.lit("IN_PROGRESS").alias("next")))


@add("dependency_check", "SELECT o_orderkey AS id, u.dep AS missing FROM orders, LATERAL (SELECT unnest([o_custkey, o_custkey * 11]) AS dep) u WHERE u.dep NOT IN (SELECT c_custkey FROM customer)")
def dependency_check(t):
    o = t.orders.select(F.col("o_orderkey").alias("id"), F.array(F.col("o_custkey"), F.col("o_custkey") * 11).alias("deps"))
    return TK.broken_references(o, "deps", t.customer, "c_custkey")


@add("state_transitions", """
WITH s AS (SELECT user_id, ts, event_id, CASE event_id % 5 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'IN_PROGRESS' WHEN 2 THEN 'WAITING_INPUT' WHEN 3 THEN 'COMPLETED' ELSE 'FAILED' END AS state FROM events),
l AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM s)
SELECT event_id, state, (prev IS NULL AND state = 'PENDING') OR (prev = 'PENDING' AND state IN ('IN_PROGRESS', 'FAILED')) IS TRUE OR (prev = 'IN_PROGRESS' AND state IN ('WAITING_INPUT', 'COMPLETED', 'FAILED')) IS TRUE
  OR (prev = 'WAITING_INPUT' AND state IN ('IN_PROGRESS', 'COMPLETED', 'FAILED')) IS TRUE AS ok FROM l""")
def state_transitions(t):
    state = F.get(F.array(*map(F.lit, TK.TRANSITIONS)), F.when(F.col("event_id") % 5 == 2, 2).otherwise(F.col("event_id") % 5).cast("int"))
    s = t.events.select("event_id", "user_id", "ts", state.alias("state"))
    prev = F.lag("state").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return s.select("event_id", "state", prev.alias("prev")).select("event_id", "state", TK.allowed(F.col("prev"), F.col("state")).alias("ok"))


_PROPOSALS_SQL = """p AS (SELECT l_orderkey AS task_id, l_orderkey * 10 + l_linenumber AS id, l_suppkey AS agent_id, l_returnflag || l_linestatus AS content, 1 - l_discount * 5 AS confidence, l_quantity::BIGINT AS tokens,
  l_shipdate AS created_at FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem) WHERE k = 1)"""


def _proposals(t):
    k = F.row_number().over(W.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    return t.lineitem.withColumn("k", k).filter("k = 1").select(
        F.col("l_orderkey").alias("task_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("agent_id"), F.concat("l_returnflag", "l_linestatus").alias("content"),
        (1 - F.col("l_discount") * 5).alias("confidence"), F.col("l_quantity").cast("long").alias("tokens"), F.col("l_shipdate").alias("created_at"),
    )


_VOTING_SQL = """v AS (SELECT task_id, content, count(*) AS n, arg_max(id, (confidence, -id)) AS best FROM p GROUP BY 1, 2), tp AS (SELECT *, max(n) OVER (PARTITION BY task_id) AS top FROM v),
vt AS (SELECT task_id, sum(n)::BIGINT AS total, max(top)::BIGINT AS votes, count(*) FILTER (n = top)::BIGINT AS leaders, max(best) FILTER (n = top) AS best FROM tp GROUP BY 1),
vote AS (SELECT task_id, total, votes, leaders, leaders = 1 AND votes >= 0.75::DOUBLE * total AS agreed, CASE WHEN leaders = 1 AND votes >= 0.75::DOUBLE * total THEN best END AS winner FROM vt)"""


@add("voting_consensus", f"WITH {_PROPOSALS_SQL}, {_VOTING_SQL} SELECT * FROM vote")
def voting_consensus(t):
    return CS.voting(_proposals(t))


_WIN_SQL = "w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY confidence / tokens DESC, confidence DESC, created_at, id) AS k FROM p) WHERE k = 1)"


def _scored_winner(t):
    return CS.winners(_proposals(t).withColumn("score", F.col("confidence") / F.col("tokens")), "score")


@add("voting_structure", f"""WITH {_PROPOSALS_SQL.replace("l_returnflag || l_linestatus AS content", "l_returnflag AS content")}, {_VOTING_SQL} SELECT * FROM vote""")
def voting_structure(t):
    """Proposals that write one JSON value in different ways: order of names, blanks, 1 and 1.0."""
    flag, n = F.substring("content", 1, 1), F.col("id") % 3
    one = F.concat(F.lit('{"v": "'), flag, F.lit('", "n": [1, {"b": 2, "a": null}]}'))
    two = F.concat(F.lit('{"n":[1.0,{"a":null,"b":2.00}],"v":"'), flag, F.lit('"}'))
    three = F.concat(F.lit('\n{ "v":"'), flag, F.lit('","n":[ 1,{"b":2.0,"a":null} ] }'))
    return CS.voting(_proposals(t).withColumn("content", F.when(n == 0, one).when(n == 1, two).otherwise(three)), by_structure=True)


@add("consensus_winner", f"WITH {_PROPOSALS_SQL}, {_WIN_SQL} SELECT task_id, id, round(confidence, 6) AS confidence FROM w")
def consensus_winner(t):
    return _scored_winner(t).select("task_id", "id", F.round("confidence", 6).alias("confidence"))


@add("tie_aware_pick", f"""WITH {_PROPOSALS_SQL}, g AS (SELECT task_id, max(confidence) AS c, min(tokens) AS t FROM p GROUP BY 1),
j AS (SELECT p.task_id, count(*) FILTER (confidence = c) AS nc, max(id) FILTER (confidence = c) AS wc, count(*) FILTER (tokens = t) AS nt, max(id) FILTER (tokens = t) AS wt, arg_min(id, (-confidence, tokens, id)) AS f FROM p JOIN g USING (task_id) GROUP BY 1)
SELECT task_id, CASE WHEN nc = 1 THEN wc WHEN nt = 1 THEN wt ELSE f END AS winner, CASE WHEN nc = 1 THEN 'confidence' WHEN nt = 1 THEN 'tokens' ELSE 'order' END AS rule FROM j""")
def tie_aware_pick(t):
    return CS.tie_aware(_proposals(t))


@add("strategy_cascade", f"WITH {_PROPOSALS_SQL}, {_VOTING_SQL}, {_WIN_SQL} SELECT w.task_id, coalesce(v.winner, w.id) AS winner, CASE WHEN v.winner IS NOT NULL THEN 'VOTING' ELSE 'REASONING_QUALITY' END AS strategy FROM w LEFT JOIN (SELECT * FROM vote WHERE agreed) v USING (task_id)")
def strategy_cascade(t):
    return CS.cascade(CS.voting(_proposals(t)), _scored_winner(t))


_QUALITY_SQL = """CASE WHEN length(text) = 0 THEN 0.0 ELSE least(1.0::DOUBLE, least(0.85::DOUBLE, ln(1.0::DOUBLE + length(text)) / ln(2001.0::DOUBLE)) + least(0.15::DOUBLE, (""" + " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in CS.QUALITY_WORDS) + ") * 0.03::DOUBLE)) END"


@add("token_value_ratio", f"SELECT conv_id, turn, round({_QUALITY_SQL} * (0.5::DOUBLE + 0.5::DOUBLE * (turn % 10) / 10) / greatest(1, length(text) // 4), 6) AS ratio FROM conversations")
def token_value_ratio(t):
    value = CS.text_quality(F.col("text")) * (0.5 + 0.5 * (F.col("turn") % 10) / 10)
    return t.conversations.select("conv_id", "turn", F.round(value / F.greatest(F.lit(1), F.floor(F.length("text") / 4)), 6).alias("ratio"))


@add("token_savings", f"""WITH {_PROPOSALS_SQL}, {_WIN_SQL}, a AS (SELECT task_id, avg(tokens) AS mean, max(tokens) AS most, min(tokens) AS least FROM p GROUP BY 1)
SELECT task_id, round_even((mean - tokens) * 1000, 0) / 1000 AS vs_mean, (most - tokens)::BIGINT AS vs_most, least::BIGINT AS least FROM w JOIN a USING (task_id)""")
def token_savings(t):
    a = _proposals(t).groupBy("task_id").agg(F.avg("tokens").alias("mean"), F.max("tokens").alias("most"), F.min("tokens").alias("least"))
    j = _scored_winner(t).join(a, "task_id")
    return j.select("task_id", (F.rint((F.col("mean") - F.col("tokens")) * 1000) / 1000).alias("vs_mean"), (F.col("most") - F.col("tokens")).alias("vs_most"), "least")


@add("decision_savings", f"""WITH {_PROPOSALS_SQL}, {_WIN_SQL}, s AS (SELECT p.task_id, sum(p.tokens) AS considered, sum(p.tokens) FILTER (p.confidence >= 0.9 OR p.id = w.id) AS selected FROM p JOIN w USING (task_id) GROUP BY 1)
SELECT task_id, considered::BIGINT AS considered, selected::BIGINT AS selected, greatest(0, considered - selected)::BIGINT AS saved, round(CASE WHEN considered > 0 THEN greatest(0, considered - selected) / considered::DOUBLE ELSE 0 END, 6) AS share FROM s""")
def decision_savings(t):
    w = _scored_winner(t).select("task_id", F.col("id").alias("won"))
    s = _proposals(t).join(w, "task_id").groupBy("task_id").agg(F.sum("tokens").alias("considered"), F.sum(F.when((F.col("confidence") >= 0.9) | (F.col("id") == F.col("won")), F.col("tokens"))).alias("selected"))
    saved = F.greatest(F.lit(0), F.col("considered") - F.col("selected"))
    return s.select("task_id", "considered", "selected", saved.alias("saved"), F.round(F.coalesce(F.try_divide(saved, F.col("considered")), F.lit(0.0)), 6).alias("share"))


@add("consensus_mean_savings", f"WITH {_PROPOSALS_SQL} SELECT task_id, (sum(tokens) // count(*) * (count(*) - 1))::BIGINT AS saved FROM p GROUP BY task_id")
def consensus_mean_savings(t):
    n = F.count(F.lit(1))
    return _proposals(t).groupBy("task_id").agg((F.floor(F.sum("tokens") / n) * (n - 1)).cast("long").alias("saved"))


@add("proposal_bundle", f"""WITH {_PROPOSALS_SQL}, {_TASKS_SQL} SELECT tasks.id, count(p.id)::BIGINT AS n, coalesce(string_agg(p.id::VARCHAR, ',' ORDER BY p.id), '') AS proposals FROM tasks LEFT JOIN p ON p.task_id = tasks.id GROUP BY tasks.id""")
def proposal_bundle(t):
    p = _proposals(t).groupBy(F.col("task_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("proposals"))
    return _tasks(t).select("id").join(p, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("proposals", F.lit("")).alias("proposals"))


@add("decision_validation", f"WITH {_PROPOSALS_SQL} SELECT p.id FROM p WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = p.task_id AND o_orderstatus <> 'P')")
def decision_validation(t):
    return _proposals(t).join(t.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("task_id")), "task_id", "left_anti").select("id")


@add("latest_decision", "SELECT o_custkey AS task_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS decision_id FROM orders GROUP BY 1")
def latest_decision(t):
    return t.orders.groupBy(F.col("o_custkey").alias("task_id")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("decision_id"))


_AGENT_NEEDS = ("CODE_GENERATION", "CODE_REVIEW", "DEBUGGING", "PLANNING")


@add("agent_selection", """
WITH a AS (SELECT s_suppkey AS agent_id, CASE s_suppkey % 7 WHEN 0 THEN 'OFFLINE' WHEN 1 THEN 'BUSY' ELSE 'ONLINE' END AS status, (s_suppkey % 4)::INT AS c1, ((s_suppkey // 4) % 4)::INT AS c2,
  50.0::DOUBLE + s_suppkey * 37 % 50 AS strength, s_suppkey % 3 AS load FROM supplier),
tk AS (SELECT o_orderkey AS task_id, (o_orderkey % 4)::INT AS n1, ((o_orderkey // 4) % 4)::INT AS n2 FROM orders), w AS (SELECT DISTINCT n1, n2 FROM tk),
m AS (SELECT n1, n2, agent_id, strength - CASE WHEN status = 'BUSY' THEN 10 ELSE 0 END - load AS score FROM w JOIN a ON n1 IN (c1, c2) AND n2 IN (c1, c2) WHERE status <> 'OFFLINE'),
r AS (SELECT *, row_number() OVER (PARTITION BY n1, n2 ORDER BY score DESC, agent_id) AS rank FROM m)
SELECT task_id, agent_id, score, rank::INT AS rank FROM tk JOIN r USING (n1, n2) WHERE rank <= 2""")
def agent_selection(t):
    """Suppliers are agents; every order needs one skill or two."""
    names = F.array(*map(F.lit, _AGENT_NEEDS))
    pick = lambda c, by: F.get(names, (F.floor(c / by) % 4).cast("int"))
    k, o = F.col("s_suppkey"), F.col("o_orderkey")
    caps, strength = F.array_distinct(F.array(pick(k, 1), pick(k, 4))), F.lit(50.0) + k * 37 % 50
    a = t.supplier.select(
        k.alias("agent_id"), F.when(k % 7 == 0, "OFFLINE").when(k % 7 == 1, "BUSY").otherwise("ONLINE").alias("status"), (k % 3).alias("load"),
        caps.alias("capabilities"), F.map_from_arrays(caps, F.transform(caps, lambda x: strength)).alias("strengths"),
    )
    tasks = t.orders.select(o.alias("task_id"), F.array(pick(o, 1), pick(o, 4)).alias("needs"))
    return RT.selected_agents(tasks, a, most=2)


@add("agent_load", "SELECT user_id AS agent_id, count(*)::BIGINT AS load FROM events WHERE event_type = 'click' AND ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1")
def agent_load(t):
    last = t.events.agg(F.max("ts").alias("last"))
    recent = t.events.join(F.broadcast(last), F.col("ts") > F.col("last") - F.expr("INTERVAL 1 DAY"))  # one row
    return recent.filter("event_type = 'click'").groupBy(F.col("user_id").alias("agent_id")).agg(F.count(F.lit(1)).alias("load"))


_MSG_SQL = "m AS (SELECT conv_id AS task_id, turn AS ts, role, (length(text) // 4)::BIGINT AS tokens FROM conversations)"


def _msgs(t):
    return t.conversations.select(F.col("conv_id").alias("task_id"), F.col("turn").alias("ts"), "role", F.floor(F.length("text") / 4).cast("long").alias("tokens"))


@add("message_totals", f"WITH {_MSG_SQL} SELECT task_id, coalesce(sum(tokens), 0)::BIGINT AS tokens, count(*)::BIGINT AS n FROM m GROUP BY 1")
def message_totals(t):
    return _msgs(t).groupBy("task_id").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("n"))


@add("prune_oldest", f"WITH {_MSG_SQL}, s AS (SELECT *, sum(tokens) OVER (PARTITION BY task_id ORDER BY ts DESC)::BIGINT AS suffix FROM m) SELECT task_id, ts, suffix FROM s WHERE suffix <= 150")
def prune_oldest(t):
    return MM.pruned(_msgs(t), 150).select("task_id", "ts", "suffix")


@add("history_window", f"WITH {_MSG_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts DESC) AS k FROM m) SELECT task_id, ts, role FROM s WHERE k <= 3")
def history_window(t):
    k = F.row_number().over(W.partitionBy("task_id").orderBy(F.desc("ts")))
    return _msgs(t).withColumn("k", k).filter("k <= 3").select("task_id", "ts", "role")


@add("history_summarise", f"""
WITH RECURSIVE {_MSG_SQL},
h AS (SELECT task_id, 0 AS step, list({{'ts': ts::BIGINT, 'role': role, 'tokens': coalesce(tokens, 0)}} ORDER BY ts, role, tokens) AS r FROM m GROUP BY task_id),
f AS (
  SELECT * FROM h
  UNION ALL
  SELECT task_id, step + 1, list_concat([{{'ts': r[1].ts, 'role': 'SUMMARY', 'tokens': greatest(1, list_sum(list_transform(r[1:n], lambda x: x.tokens))::BIGINT // 4)}}], r[n + 1:])
  FROM (SELECT *, greatest(2, floor(len(r) * 0.35::DOUBLE))::INT AS n FROM f) WHERE len(r) > 3 AND list_sum(list_transform(r, lambda x: x.tokens)) > 200
),
e AS (SELECT task_id, unnest(r) AS x, generate_subscripts(r, 1) AS place FROM (SELECT task_id, arg_max(r, step) AS r FROM f GROUP BY task_id)),
k AS (SELECT task_id, x, sum(x.tokens) OVER (PARTITION BY task_id ORDER BY place DESC) AS later FROM e)
SELECT task_id, x.ts AS ts, x.role AS role, x.tokens AS tokens FROM k WHERE later <= 200""")
def history_summarise(t):
    return MM.summarised(_msgs(t), 200)


def _sum_sql(table: dict[str, int], low: str = "low") -> str:
    return "(" + " + ".join(f"CASE WHEN contains({low}, '{w}') THEN {v} ELSE 0 END" for w, v in table.items()) + ")"


_CLASSIFY_SQL = f"""l AS (SELECT key, lower(trim(text)) AS low FROM src), c AS (SELECT key, low, len(regexp_extract_all(low, '\\S+')) AS n, {_sum_sql(RT.COMPLEXITY)} AS cs, {_sum_sql(RT.RISK)} AS rs, {_sum_sql(dict.fromkeys(RT.CRITICAL, 1))} AS k FROM l),
cl AS (SELECT key, low, k, greatest(1, least(10, 1 + CASE WHEN n <= 5 THEN 1 WHEN n <= 12 THEN 2 WHEN n <= 25 THEN 3 WHEN n <= 40 THEN 4 WHEN n <= 70 THEN 5 WHEN n <= 110 THEN 6 WHEN n <= 170 THEN 7 ELSE 8 END + cs + least(k, 2)))::INT AS complexity,
  greatest(1, least(10, 1 + CASE k WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END + rs + CASE WHEN n <= 12 THEN 0 WHEN n <= 40 THEN 1 WHEN n <= 100 THEN 2 ELSE 3 END))::INT AS risk,
  0.45::DOUBLE / (1 + exp(-cs::DOUBLE)) + 0.45::DOUBLE / (1 + exp(-rs::DOUBLE)) + 0.10::DOUBLE / (1 + exp(-(n // 20)::DOUBLE)) AS confidence FROM c)"""

_PHRASES = ("drop the database token", "need consensus please", "skip review quick fix", "urgent production down", "maybe ask codex about the index", "refactor multiple parallel caches", "", "no consensus")
_REQUESTS_SQL = "src AS (SELECT doc_id AS key, ([" + ", ".join(f"'{p}'" for p in _PHRASES) + "])[1 + doc_id % 8] || ' ' || text AS text FROM documents)"


def _requests(t):
    phrase = F.get(F.array(*map(F.lit, _PHRASES)), (F.col("doc_id") % 8).cast("int"))
    return t.spread("documents").select(F.col("doc_id").alias("key"), F.concat(phrase, F.lit(" "), "text").alias("text"))


@add("classify_text", f"WITH {_REQUESTS_SQL}, {_CLASSIFY_SQL} SELECT key, complexity, risk, k::INT AS n_critical, round(confidence, 6) AS confidence FROM cl")
def classify_text(t):
    c = RT.classified(_requests(t), "text")
    return c.select("key", "complexity", "risk", F.size("critical").alias("n_critical"), F.round("confidence", 6).alias("confidence"))


def _hits_sql(table: dict[str, float]) -> str:
    return " + ".join(f"len(regexp_extract_all(t, '(?i)\\b{p.replace(chr(39), chr(39) * 2)}\\b')) * {w}::DOUBLE" for p, w in table.items())


@add("directive_scores", f"""WITH {_REQUESTS_SQL}, n AS (SELECT key, regexp_replace(trim(text), '\\s+', ' ', 'g') AS t FROM src),
s AS (SELECT key, {_hits_sql(RT.PREVENT)} AS p, {_hits_sql(RT.EMERGENCY)} AS e FROM n) SELECT key, e > 0 AS emergency, round(1 - exp(-e), 6) AS emergency_confidence FROM s""")
def directive_scores(t):
    d = RT.directives(_requests(t), "text", ["codex", "claude", "gemini"])
    return d.select("key", "emergency", F.round("emergency_confidence", 6).alias("emergency_confidence"))


@add("directive_flags")
def directive_flags(t):
    d = RT.directives(_requests(t), "text", ["codex", "claude", "gemini"])
    return d.select("key", "force", "prevent", "agent", F.round("force_confidence", 6).alias("force_confidence"), F.round("prevent_confidence", 6).alias("prevent_confidence"))


@add("strategy_pick", f"""WITH {_REQUESTS_SQL}, {_CLASSIFY_SQL}, q AS (SELECT *, (['ARCHITECTURE', 'REVIEW', 'TESTING', 'BUGFIX'])[1 + key % 4] AS kind FROM cl)
SELECT key, CASE WHEN risk >= 8 OR k > 0 THEN 'CONSENSUS' WHEN kind = 'ARCHITECTURE' AND complexity >= 7 THEN 'SEQUENTIAL' WHEN kind = 'REVIEW' THEN 'CONSENSUS' WHEN kind = 'TESTING' AND risk <= 4 AND complexity >= 5 THEN 'PARALLEL'
  WHEN contains(low, 'parallel') OR contains(low, 'concurrent') OR contains(low, 'multiple') THEN 'PARALLEL' WHEN complexity >= 8 AND risk BETWEEN 4 AND 7 THEN 'SEQUENTIAL' ELSE 'SOLO' END AS strategy FROM q""")
def strategy_pick(t):
    c = RT.classified(_requests(t), "text")
    kind = F.get(F.array(*map(F.lit, ("ARCHITECTURE", "REVIEW", "TESTING", "BUGFIX"))), (F.col("key") % 4).cast("int"))
    s = RT.strategy(kind, F.col("complexity"), F.col("risk"), F.size("critical") > 0, F.lower(F.btrim("text")), F.lit(0.0), F.lit(0.0))
    return c.select("key", s.alias("strategy"))


@add("alias_fuzzy", """
WITH n AS (SELECT c_custkey, lower(left(n_name, length(n_name) - 1)) || (c_custkey % 3)::VARCHAR AS w FROM customer JOIN nation ON n_nationkey = c_nationkey), a AS (SELECT lower(n_name) AS alias FROM nation),
d AS (SELECT c_custkey, alias, levenshtein(w, alias) AS d FROM n, a) SELECT c_custkey, arg_min(alias, (d, alias)) AS alias, min(d)::INT AS distance FROM d GROUP BY c_custkey HAVING min(d) <= 2""")
def alias_fuzzy(t):
    names = sorted(r[0].lower() for r in t.nation.select("n_name").collect())  # a fixed list of 25
    c = t.customer.join(F.broadcast(t.nation.withColumnRenamed("n_nationkey", "c_nationkey")), "c_nationkey")
    w = F.concat(F.lower(F.substring("n_name", F.lit(1), F.length("n_name") - 1)), (F.col("c_custkey") % 3).cast("string"))
    best = F.array_min(F.array(*[F.struct(F.levenshtein(w, F.lit(x)).alias("d"), F.lit(x).alias("a")) for x in names]))
    return c.select("c_custkey", best.alias("b")).filter("b.d <= 2").select("c_custkey", F.col("b.a").alias("alias"), F.col("b.d").alias("distance"))


@add("budget_formula", f"""WITH {_TASKS_SQL}, b AS (SELECT id, complexity, risk, least(8192, CASE WHEN risk > 5 THEN floor(greatest(4000, complexity * complexity * 64) * 1.1::DOUBLE) ELSE greatest(4000, complexity * complexity * 64) END)::INT AS m FROM tasks)
SELECT id, m AS max_tokens, least(500, m // 2)::INT AS reserve, (m - least(500, m // 2))::INT AS available, CASE WHEN complexity > 8 THEN 0.8 ELSE 0.3 END::DOUBLE AS diversity FROM b""")
def budget_formula(t):
    kind = F.when(F.col("complexity") > 8, "ARCHITECTURE").otherwise("BUGFIX")
    return _tasks(t).select("id", RT.token_budget(F.col("complexity"), F.col("risk") > 5, kind).alias("b")).select("id", "b.*")


@add("rebuild_eta", "SELECT o_orderkey AS job, (o_orderkey % 100)::INT AS percent, CASE WHEN o_orderkey % 100 > 0 THEN (o_totalprice / (o_orderkey % 100) * (100 - o_orderkey % 100))::BIGINT END AS eta FROM (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders)")
def rebuild_eta(t):
    p = F.col("o_orderkey") % 100
    return t.orders.select(F.col("o_orderkey").alias("job"), p.cast("int").alias("percent"), F.when(p > 0, F.bround(F.try_divide(F.floor("o_totalprice"), p) * (100 - p))).cast("long").alias("eta"))


@add("parallel_aggregate", f"""WITH {_PROPOSALS_SQL} SELECT task_id, count(*) FILTER (confidence >= 0.8)::BIGINT AS ok, count(*) FILTER (confidence < 0.8)::BIGINT AS failed, sum(tokens)::BIGINT AS tokens, coalesce(string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (confidence >= 0.8), '') AS ids FROM p GROUP BY 1""")
def parallel_aggregate(t):
    good = F.col("confidence") >= 0.8
    ids = F.transform(F.array_sort(F.collect_list(F.when(good, F.col("id")))), lambda x: x.cast("string"))
    return _proposals(t).groupBy("task_id").agg(F.count_if(good).alias("ok"), F.count_if(~good).alias("failed"), F.sum("tokens").alias("tokens"), F.array_join(ids, ",").alias("ids"))


@add("reasoning_quality")
def reasoning_quality(t):
    c = t.conversations.select(F.col("conv_id").alias("task_id"), F.col("turn").alias("id"), F.col("turn").alias("created_at"), (F.col("turn") % 10 / 10.0).alias("confidence"), "text")
    return CS.winners(c.withColumn("score", CS.reasoning_quality(F.col("text"), F.col("confidence"))), "score").select("task_id", "id", F.round("score", 6).alias("score"))


@add("snapshot_roundtrip", "SELECT o_orderkey, sha256('{\"id\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}') AS digest FROM orders")
def snapshot_roundtrip(t):
    from quillspark.sources import snapshots

    body = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")))
    packed = snapshots.packed(t.orders.select("o_orderkey", body.alias("body")), "body")
    return snapshots.unpacked(packed, "body").select("o_orderkey", F.sha2(F.col("body").cast("binary"), 256).alias("digest"))


@add("relative_times", """
WITH m AS (SELECT event_id, epoch_ms(TIMESTAMP '2024-01-20') - epoch_ms(ts) AS ms FROM events), a AS (SELECT *, abs(ms) // 1000 AS s FROM m),
u AS (SELECT *, CASE WHEN s >= 31536000 THEN 31536000 WHEN s >= 2592000 THEN 2592000 WHEN s >= 86400 THEN 86400 WHEN s >= 3600 THEN 3600 ELSE 60 END AS unit FROM a),
w AS (SELECT *, (s // unit) || ' ' || CASE unit WHEN 31536000 THEN 'year' WHEN 2592000 THEN 'month' WHEN 86400 THEN 'day' WHEN 3600 THEN 'hour' ELSE 'minute' END || CASE WHEN s // unit = 1 THEN '' ELSE 's' END AS words FROM u)
SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN ms < 0 THEN 'in ' || words ELSE words || ' ago' END AS age FROM w""")
def relative_times(t):
    zoned = lambda c: c.cast("timestamp")
    return t.events.select("event_id", VL.relative_time(zoned(F.col("ts")), zoned(F.lit("2024-01-20 00:00:00"))).alias("age"))


@add("epoch_instants", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE make_timestamp(event_id * 1000003 // 1000) END AS at FROM events")
def epoch_instants(t):
    ns = F.when(F.col("event_id") % 9 == 0, 0).otherwise(F.col("event_id") * 1000003)
    return t.events.select("event_id", VL.from_epoch_ns(ns).cast("timestamp_ntz").alias("at"))


@add("ordered_ids")
def ordered_ids(t):
    return t.orders.select("o_orderkey", VL.ordered_id("task", F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey")).alias("id"))


@add("mean_pooling", """
SELECT vec_id, round((embedding[9]::DOUBLE + embedding[17] + embedding[33] + embedding[41] + embedding[57]) / 5, 6) AS first,
  round((embedding[16]::DOUBLE + embedding[24] + embedding[40] + embedding[48] + embedding[64]) / 5, 6) AS last FROM embeddings""")
def mean_pooling(t):
    """Each vector as eight of eight dimensions, pooled but for every third."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("embedding", k * 8 + 1, F.lit(8)))
    pooled = t.embeddings.select("vec_id", VL.mean_pooled(parts, F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: k % 3)).alias("p"))
    return pooled.select("vec_id", F.round(F.get("p", F.lit(0)), 6).alias("first"), F.round(F.get("p", F.lit(7)), 6).alias("last"))


@add("hashed_token_ids", r"""
WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')[1:510] AS ws FROM benchmark),
i AS (SELECT item_id, list_transform(ws, lambda w: list_reduce(list_prepend(0::BIGINT, list_transform(string_split(w, ''), lambda c: unicode(c)::BIGINT)), lambda a, c: (a * 31 + c) % 4294967296) % 2147483648 % 29522 + 1000) AS ids FROM w)
SELECT item_id, (len(ids) + 2)::INT AS n, array_to_string(list_concat([101], ids, [102]), ',') AS ids FROM i""")
def hashed_token_ids(t):
    ids = t.benchmark.select("item_id", VL.hashed_ids(F.col("text")).alias("ids"))
    return ids.select("item_id", F.size("ids").alias("n"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@add("file_operations")
def file_operations(t):
    kinds = F.get(F.array(*[F.lit(k) for k in ("CREATE", "UPDATE", "DELETE", "CREATE", "RENAME")]), (F.col("event_id") % 5).cast("int"))
    path = lambda c: F.concat(F.lit("f"), (c % 3).cast("string"))
    ops = t.events.select(
        F.col("user_id").cast("string").alias("task_id"), F.col("event_id").alias("seq"), path(F.col("event_id")).alias("path"), kinds.alias("kind"), "props",
        F.lit(None).cast("string").alias("base_hash"), path(F.col("event_id") + 1).alias("rename_to"),
    ).withColumnRenamed("props", "content")
    return FO.history(ops)


@add("latest_config", "SELECT scope, config_id FROM (SELECT c_mktsegment AS scope, c_custkey AS config_id, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey DESC) AS k FROM customer) WHERE k = 1")
def latest_config(t):
    from quillspark.sources import config

    c = t.customer.select(F.col("c_mktsegment").alias("scope"), F.col("c_custkey").alias("config_id"), F.col("c_acctbal").alias("updated_at"))
    return config.latest_snapshots(c).select("scope", "config_id")


@add("tasks_sorted", f"""WITH {_TASKS_SQL}, x AS (SELECT *, CASE WHEN id % 3 = 0 THEN created_at + INTERVAL 5 DAY END AS updated_at FROM tasks)
SELECT 'status' AS sort, id FROM (SELECT * FROM x ORDER BY list_position(['PENDING', 'IN_PROGRESS', 'COMPLETED'], status) DESC, id LIMIT 30)
UNION ALL SELECT 'agents', id FROM (SELECT * FROM x ORDER BY assignee, id LIMIT 30) UNION ALL SELECT 'nothing known', id FROM (SELECT * FROM x ORDER BY coalesce(updated_at, created_at) DESC, id LIMIT 30)""")
def tasks_sorted(t):
    x = _tasks(t).withColumn("updated_at", F.when(F.col("id") % 3 == 0, F.col("created_at") + F.expr("INTERVAL 5 DAY")))
    enums = {"status": ("PENDING", "IN_PROGRESS", "COMPLETED")}
    page = lambda by, down: x.orderBy(*TK.sort_order(by, down, enums)).limit(30).select(F.lit(by).alias("sort"), "id")
    return page("status", True).unionByName(page("agents", False)).unionByName(page("nothing known", False))


_DECISIONS_SQL = "d AS (SELECT l_orderkey AS task_id, max(l_orderkey * 10 + l_linenumber) AS decision_id FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1)"


def _decisions(t):
    some = t.lineitem.filter("l_linenumber <= 2")
    return some.select(F.col("l_orderkey").alias("task_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("decision_id"), F.col("l_linenumber").alias("decided_at")).distinct()


@add("task_bundle", f"""WITH {_PROPOSALS_SQL}, {_TASKS_SQL}, {_MSG_SQL}, {_DECISIONS_SQL},
pp AS (SELECT task_id, string_agg(id::VARCHAR, ',' ORDER BY created_at, id) AS proposals FROM p GROUP BY 1), mm AS (SELECT task_id, count(*) AS n, sum(tokens) AS tokens FROM m GROUP BY 1)
SELECT tasks.id, status, coalesce(proposals, '') AS proposals, decision_id, coalesce(n, 0)::BIGINT AS n_messages, coalesce(tokens, 0)::BIGINT AS context_tokens
FROM tasks LEFT JOIN pp ON pp.task_id = tasks.id LEFT JOIN d ON d.task_id = tasks.id LEFT JOIN mm ON mm.task_id = tasks.id""")
def task_bundle(t):
    b = TK.bundles(_tasks(t).select("id", "status"), _proposals(t), _decisions(t), _msgs(t))
    return b.withColumn("proposals", F.array_join(F.transform("proposals", lambda x: x.cast("string")), ","))


@add("task_creation", f"""WITH {_REQUESTS_SQL}, {_CLASSIFY_SQL}, q AS (SELECT cl.*, text, (['ARCHITECTURE', 'REVIEW', 'TESTING', 'BUGFIX'])[1 + key % 4] AS kind FROM cl JOIN src USING (key))
SELECT key, CASE WHEN length(text) <= 60 THEN text ELSE left(text, 59) || '…' END AS title, 'PENDING' AS status, kind AS type, complexity, risk,
  CASE WHEN risk >= 8 OR k > 0 THEN 'CONSENSUS' WHEN kind = 'ARCHITECTURE' AND complexity >= 7 THEN 'SEQUENTIAL' WHEN kind = 'REVIEW' THEN 'CONSENSUS' WHEN kind = 'TESTING' AND risk <= 4 AND complexity >= 5 THEN 'PARALLEL'
  WHEN contains(low, 'parallel') OR contains(low, 'concurrent') OR contains(low, 'multiple') THEN 'PARALLEL' WHEN complexity >= 8 AND risk BETWEEN 4 AND 7 THEN 'SEQUENTIAL' ELSE 'SOLO' END AS routing FROM q""")
def task_creation(t):
    kind = F.get(F.array(*map(F.lit, ("ARCHITECTURE", "REVIEW", "TESTING", "BUGFIX"))), (F.col("key") % 4).cast("int"))
    return TK.created(_requests(t), kind)


@add("task_submission", f"""WITH {_TASKS_SQL}, i AS (SELECT DISTINCT l_orderkey AS task_id FROM lineitem WHERE l_linenumber = 1)
SELECT id, CASE WHEN status = 'IN_PROGRESS' AND task_id IS NOT NULL THEN 'WAITING_INPUT' ELSE status END AS status, (status = 'IN_PROGRESS' AND task_id IS NOT NULL) AS changed FROM tasks LEFT JOIN i ON i.task_id = id""")
def task_submission(t):
    inputs = t.lineitem.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("task_id"), F.col("l_suppkey").alias("agent_id"), F.col("l_returnflag").alias("content"), F.col("l_discount").alias("confidence"))
    return TK.submitted(_tasks(t).select("id", "status"), inputs)[1]


@add("task_continuation", f"""WITH {_PROPOSALS_SQL}, {_TASKS_SQL}, {_MSG_SQL}, {_DECISIONS_SQL}, s AS (SELECT *, sum(tokens) OVER (PARTITION BY task_id ORDER BY ts DESC)::BIGINT AS suffix FROM m),
mm AS (SELECT task_id, count(*) AS n, sum(tokens) AS tokens FROM s WHERE suffix <= 150 GROUP BY 1), pp AS (SELECT task_id, count(*) AS n FROM p GROUP BY 1)
SELECT tasks.id, 'IN_PROGRESS' AS status, coalesce(pp.n, 0)::INT AS n_proposals, decision_id, coalesce(mm.n, 0)::BIGINT AS n_messages, coalesce(tokens, 0)::BIGINT AS context_tokens
FROM tasks LEFT JOIN pp ON pp.task_id = tasks.id LEFT JOIN d ON d.task_id = tasks.id LEFT JOIN mm ON mm.task_id = tasks.id WHERE status = 'PENDING'""")
def task_continuation(t):
    b = TK.continued(_tasks(t).select("id", "status"), _proposals(t), _decisions(t), _msgs(t), 150)
    return b.withColumn("n_proposals", F.size("proposals")).drop("proposals")


@add("task_completion", f"""WITH {_PROPOSALS_SQL}, {_TASKS_SQL}, dd AS (SELECT o_orderkey AS task_id, o_orderkey * 10 + o_custkey % 4 AS proposal_id FROM orders WHERE o_orderkey % 2 = 0),
v AS (SELECT dd.*, p.id IS NOT NULL AS known FROM dd LEFT JOIN p ON p.task_id = dd.task_id AND p.id = dd.proposal_id), j AS (SELECT t.id, status, proposal_id, coalesce(known AND status = 'IN_PROGRESS', FALSE) AS done FROM tasks t LEFT JOIN v ON v.task_id = t.id)
SELECT id, CASE WHEN done THEN 'COMPLETED' ELSE status END AS status, CASE WHEN done THEN proposal_id END AS selected, proposal_id IS NOT NULL AND NOT done AS refused FROM j""")
def task_completion(t):
    d = t.orders.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("task_id"), (F.col("o_orderkey") * 10 + F.col("o_custkey") % 4).alias("proposal_id"))
    return TK.completed(_tasks(t).select("id", "status"), _proposals(t).select("task_id", "id"), d)


_REQUESTS_DONE_SQL = """rt AS (SELECT id, CASE WHEN status = 'COMPLETED' AND id % 2 = 0 THEN 'FAILED' ELSE status END AS status, CASE WHEN risk >= 8 THEN 'CONSENSUS' ELSE 'SOLO' END AS routing FROM tasks),
g AS (SELECT task_id, list_sort(list(id)) AS ids FROM p GROUP BY task_id),
rq AS (SELECT rt.id AS task_id, CASE WHEN rt.id % 11 = 0 OR g.ids IS NULL THEN NULL WHEN rt.id % 13 = 0 THEN list_append(g.ids, 5) WHEN rt.id % 17 = 0 THEN list_append(g.ids, -1) ELSE g.ids END AS considered,
  CASE WHEN rt.id % 3 = 0 THEN g.ids[1:1] ELSE [] END AS selected, CASE WHEN rt.id % 19 = 0 THEN 7 ELSE g.ids[1] END AS winner, CASE WHEN rt.id % 23 = 0 THEN 1.5 ELSE 0.5 END::DOUBLE AS agreement,
  CASE WHEN rt.id % 2 = 0 THEN rt.id END AS input_tokens, CASE WHEN rt.id % 5 = 0 THEN rt.id * 2 END AS output_tokens, CASE WHEN rt.id % 4 = 0 THEN repeat('s', (rt.id % 50)::INT) END AS summary
  FROM rt LEFT JOIN g ON g.task_id = rt.id WHERE rt.id % 10 < 9 UNION ALL SELECT -1, NULL, NULL, NULL, NULL, NULL, NULL, NULL),
mt AS (SELECT task_id, count(*) FILTER (o IS NULL) AS unknown, count(*) FILTER (o <> task_id) AS foreign_, coalesce(sum(tokens), 0) AS considered_tokens,
    coalesce(sum(tokens) FILTER (CASE WHEN len(coalesce(selected, [])) > 0 THEN list_contains(selected, q.pid) ELSE q.pid = winner END), 0) AS selected_tokens
  FROM (SELECT task_id, selected, winner, unnest(list_distinct(considered)) AS pid FROM rq) q LEFT JOIN (SELECT id AS pid, task_id AS o, tokens FROM p) w USING (pid) GROUP BY task_id),
jd AS (SELECT rq.*, rt.status, CASE WHEN rt.status IS NULL THEN 'task not found' WHEN rt.status = 'COMPLETED' THEN 'already completed' WHEN routing = 'CONSENSUS' AND len(coalesce(considered, [])) = 0 THEN 'consensus needs considered proposals'
    WHEN coalesce(unknown, 0) > 0 THEN 'proposal not found' WHEN coalesce(foreign_, 0) > 0 THEN 'proposal of another task' WHEN winner IS NOT NULL AND NOT list_contains(coalesce(considered, []), winner) THEN 'winner not considered'
    WHEN len(list_filter(coalesce(selected, []), lambda x: NOT list_contains(coalesce(considered, []), x))) > 0 THEN 'selected not considered' WHEN NOT coalesce(agreement BETWEEN 0 AND 1, TRUE) THEN 'agreement rate out of range' END AS refused,
    greatest(considered_tokens - selected_tokens, 0) AS saved, considered_tokens FROM rq LEFT JOIN rt ON rt.id = rq.task_id LEFT JOIN mt ON mt.task_id = rq.task_id)"""


def _completions(t):
    """Tasks, proposals, messages and one request for most tasks: some without considered proposals, some with one too many, some with a foreign winner."""
    tasks = _tasks(t).select("id", F.when((F.col("status") == "COMPLETED") & (F.col("id") % 2 == 0), "FAILED").otherwise(F.col("status")).alias("status"), F.when(F.col("risk") >= 8, "CONSENSUS").otherwise("SOLO").alias("routing"))
    proposals = _proposals(t).select("id", "task_id", "tokens")
    ids, n, none = proposals.groupBy("task_id").agg(F.array_sort(F.collect_list("id")).alias("ids")), F.col("id"), F.array().cast("array<bigint>")
    more = lambda x: F.array_append("ids", F.lit(x).cast("long"))
    requests = tasks.filter("id % 10 < 9").join(ids.withColumnRenamed("task_id", "id"), "id", "left").select(
        n.alias("task_id"), F.concat(F.lit("agent"), (n % 3).cast("string")).alias("completed_by"), F.when(n % 11 == 0, None).when(n % 13 == 0, more(5)).when(n % 17 == 0, more(-1)).otherwise(F.col("ids")).alias("considered"),
        F.when(n % 3 == 0, F.slice("ids", 1, 1)).otherwise(none).alias("selected"), F.when(n % 19 == 0, 7).otherwise(F.get("ids", F.lit(0))).alias("winner"), F.when(n % 23 == 0, 1.5).otherwise(0.5).alias("agreement"), F.lit("best").alias("rationale"),
        F.when(n % 2 == 0, n).alias("input_tokens"), F.when(n % 5 == 0, n * 2).alias("output_tokens"), F.when(n % 4 == 0, F.repeat(F.lit("s"), (n % 50).cast("int"))).alias("summary"), F.when(n % 7 == 0, '{"a": 1}').alias("artifacts"),
    )
    lost = requests.sparkSession.range(1).select(F.lit(-1).cast("long").alias("task_id"), *(F.lit(None).cast(kind).alias(c) for c, kind in requests.dtypes if c != "task_id"))
    return CP.judged(tasks, proposals, requests.unionByName(lost))


@add("completion_outcomes", f"WITH {_PROPOSALS_SQL}, {_TASKS_SQL}, {_REQUESTS_DONE_SQL} SELECT task_id, refused, CASE WHEN refused IS NULL AND status = 'FAILED' THEN 'was FAILED' END AS warning FROM jd")
def completion_outcomes(t):
    return _completions(t).select("task_id", "refused", "warning")


@add("completion_metrics", f"""WITH {_PROPOSALS_SQL}, {_TASKS_SQL}, {_MSG_SQL}, {_REQUESTS_DONE_SQL}, d AS (SELECT jd.*, b.before, CASE WHEN length(trim(coalesce(summary, ''))) > 0 THEN greatest(length(summary) // 4, 1) END AS said
  FROM jd LEFT JOIN (SELECT task_id, sum(tokens) AS before FROM m GROUP BY 1) b USING (task_id) WHERE refused IS NULL)
SELECT task_id, 'decision.token_savings.absolute' AS name, coalesce(saved, 0)::DOUBLE AS value FROM d WHERE considered IS NOT NULL
UNION ALL SELECT task_id, 'decision.token_savings.percent', round(CASE WHEN considered_tokens > 0 THEN saved / considered_tokens::DOUBLE ELSE 0 END, 9) FROM d WHERE considered IS NOT NULL
UNION ALL SELECT task_id, 'task.tokens.input', input_tokens::DOUBLE FROM d WHERE input_tokens IS NOT NULL UNION ALL SELECT task_id, 'task.tokens.output', output_tokens::DOUBLE FROM d WHERE output_tokens IS NOT NULL
UNION ALL SELECT task_id, 'task.tokens.total', (coalesce(input_tokens, 0) + coalesce(output_tokens, 0))::DOUBLE FROM d WHERE input_tokens IS NOT NULL OR output_tokens IS NOT NULL
UNION ALL SELECT task_id, 'task.conversation.tokens.total', (coalesce(before, 0) + coalesce(said, 0))::DOUBLE FROM d""")
def completion_metrics(t):
    return CP.rows(_completions(t), _msgs(t))["metrics"].withColumn("value", F.round("value", 9))


@add("completion_records", f"""WITH {_PROPOSALS_SQL}, {_TASKS_SQL}, {_REQUESTS_DONE_SQL}
SELECT 'decision' AS kind, task_id, coalesce(list_aggregate(list_sort(list_distinct(considered)), 'string_agg', ','), '') || '|' || coalesce(list_aggregate(list_sort(selected), 'string_agg', ','), '') || '|' || winner AS detail FROM jd WHERE refused IS NULL AND considered IS NOT NULL
UNION ALL SELECT 'message', task_id, summary FROM jd WHERE refused IS NULL AND length(trim(coalesce(summary, ''))) > 0 UNION ALL SELECT 'snapshot', task_id, '{{"a": 1}}' FROM jd WHERE refused IS NULL AND task_id % 7 = 0""")
def completion_records(t):
    """The decision, message and snapshot rows that completing leaves."""
    r, text = CP.rows(_completions(t), _msgs(t)), lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    decisions = r["decisions"].select(F.lit("decision").alias("kind"), "task_id", F.concat(text("considered"), F.lit("|"), text("selected"), F.lit("|"), F.col("winner").cast("string")).alias("detail"))
    messages = r["messages"].select(F.lit("message").alias("kind"), "task_id", F.col("content").alias("detail"))
    return decisions.unionByName(messages).unionByName(r["snapshots"].select(F.lit("snapshot").alias("kind"), "task_id", F.col("snapshot").alias("detail")))


@add("submitted_proposals", f"""WITH {_TASKS_SQL} SELECT l_orderkey AS task_id, l_suppkey AS agent_id, l_returnflag AS content, l_discount AS confidence FROM lineitem JOIN tasks ON tasks.id = l_orderkey AND status <> 'COMPLETED'""")
def submitted_proposals(t):
    """The proposals that inputs to unfinished tasks become."""
    inputs = t.lineitem.select(F.col("l_orderkey").alias("task_id"), F.col("l_suppkey").alias("agent_id"), F.col("l_returnflag").alias("content"), F.col("l_discount").alias("confidence"))
    return TK.submitted(_tasks(t).select("id", "status"), inputs)[0]


@add("agreement_rates", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN least(1.0::DOUBLE, value / 50.0::DOUBLE) WHEN event_id % 3 = 1 THEN least(1.0::DOUBLE, value / 100.0::DOUBLE) END AS rate
FROM (SELECT event_id, round(value, 3) AS value FROM events)""")
def agreement_rates(t):
    """Strategies report a ratio, a percentage or neither in the JSON of their details."""
    v, k = F.round("value", 3), F.col("event_id") % 3
    details = F.to_json(F.struct(F.when(k == 0, v / 50.0).alias("winningOptionRatio"), F.when(k == 1, v).alias("agreementPct")))
    read = F.from_json(details, "winningOptionRatio double, agreementPct double")
    d = t.events.select("event_id", read.alias("d"))
    return d.select("event_id", CS.agreement_rate(F.col("d.winningOptionRatio"), F.col("d.agreementPct")).alias("rate"))


@add("vector_codec", "SELECT vec_id, len(embedding)::INT AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total, TRUE AS same FROM embeddings")
def vector_codec(t):
    d = t.embeddings.select("vec_id", "embedding", VC.decoded(VC.encoded(F.col("embedding"))).alias("back"))
    total = F.aggregate("back", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return d.select("vec_id", F.size("back").alias("n"), F.round(total, 5).alias("total"), (F.col("back") == F.col("embedding")).alias("same"))


@add("reasoning_quality_json")
def reasoning_quality_json(t):
    """Proposals that are JSON: a conversation's texts as reasoning, steps, risks and alternatives."""
    lines = F.split("text", "\\. ")
    doc = F.to_json(F.struct(F.col("text").alias("reasoning"), F.struct(lines.alias("Steps"), F.slice(lines, 1, 2).alias("risks")).alias("plan"), F.slice(lines, 1, F.lit(1)).alias("alternatives")))
    c = t.conversations.select(F.col("conv_id").alias("task_id"), F.col("turn").alias("id"), F.col("turn").alias("created_at"), (F.col("turn") % 10 / 10.0).alias("confidence"), CS.json_features(doc).alias("f"))
    return CS.winners(c.withColumn("score", CS.reasoning_score(F.col("f"), F.col("confidence"))), "score").select("task_id", "id", F.round("score", 6).alias("score"))
