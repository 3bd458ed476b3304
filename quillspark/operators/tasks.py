"""Task tables: filters, pages, queues, transitions and status changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIVE = ("PENDING", "IN_PROGRESS", "WAITING_INPUT")
# The status changes that are allowed.
TRANSITIONS = {
    "PENDING": ("IN_PROGRESS", "FAILED"), "IN_PROGRESS": ("WAITING_INPUT", "COMPLETED", "FAILED"), "WAITING_INPUT": ("IN_PROGRESS", "COMPLETED", "FAILED"),
    "COMPLETED": (), "FAILED": (),
}


def matching(status=(), kinds=(), assignees=(), since=None, until=None, risk=None, complexity=None, search: str | None = None) -> Column:
    """One predicate for all task filters; what is not given does not restrict."""
    keep = F.lit(True)
    if status:
        keep = keep & F.col("status").isin(list(status))
    if kinds:
        keep = keep & F.col("type").isin(list(kinds))
    if assignees:
        keep = keep & F.arrays_overlap("assignee_ids", F.array(*map(F.lit, assignees)))
    if since or until:
        keep = keep & F.col("created_at").between(F.lit(since or "0001-01-01").cast("timestamp_ntz"), F.lit(until or "9999-12-31").cast("timestamp_ntz"))
    for name, bounds in (("risk", risk), ("complexity", complexity)):
        if bounds:
            keep = keep & F.col(name).between(*bounds)
    if search:
        low = search.lower()
        keep = keep & (F.lower(F.col("id").cast("string")).contains(low) | F.lower("title").contains(low))
    return keep


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` from 1 of a total order."""
    return df.orderBy(*order).offset((min(number, 10_000) - 1) * min(size, 200)).limit(min(size, 200))


def priority(risk: Column, complexity: Column) -> Column:
    return risk * 10 + complexity


def preview(text: Column, n: int = 160) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n - 1), F.lit("…")))


def allowed(before: Column, after: Column) -> Column:
    """Whether a status change is in the table; a first status must be PENDING."""
    ok = F.coalesce(before, F.lit("")).eqNullSafe(F.lit("")) & (after == "PENDING")
    for a, targets in TRANSITIONS.items():
        if targets:
            ok = ok | ((before == a) & after.isin(list(targets)))
    return F.coalesce(ok, F.lit(False))


def compare_and_set(tasks: DataFrame, changes: DataFrame) -> DataFrame:
    """Tasks with the changes (id, expected, next) whose expected status they have; ``changed`` tells which."""
    joined = tasks.join(changes, "id", "left")
    hit = F.coalesce(F.col("status") == F.col("expected"), F.lit(False))
    return joined.select(*[c for c in tasks.columns if c != "status"], F.when(hit, F.col("next")).otherwise(F.col("status")).alias("status"), hit.alias("changed"))


def broken_references(rows: DataFrame, references: str, known: DataFrame, key: str) -> DataFrame:
    """(id, missing): references of an array column that no row of ``known`` has."""
    each = rows.select("id", F.explode(references).alias(key))
    return each.join(known.select(key), key, "left_anti").select("id", F.col(key).alias("missing"))


def sort_order(column: str, descending: bool, enums: dict[str, tuple[str, ...]] | None = None) -> list[Column]:
    """The order of a task list by a named column; columns in ``enums`` sort by the place of their value. Unknown names: last update first."""
    updated = F.coalesce("updated_at", "created_at")
    if enums and column in enums:
        by = F.array_position(F.array(*map(F.lit, enums[column])), F.col(column))
    else:
        by = {"agents": F.get("assignee_ids", F.lit(0)), "updated_at": updated, **{c: F.col(c) for c in ("id", "title", "risk", "complexity", "created_at")}}.get(column)
    if by is None:
        by, descending = updated, True
    return [by.desc_nulls_last() if descending else by.asc_nulls_first(), F.asc("id")]


def bundles(tasks: DataFrame, proposals: DataFrame, decisions: DataFrame, messages: DataFrame) -> DataFrame:
    """Each task with its proposals oldest first, its latest decision and the size of its context."""
    p = proposals.groupBy(F.col("task_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("created_at", F.col("id").alias("p")))), lambda x: x["p"]).alias("proposals"))
    d = decisions.groupBy(F.col("task_id").alias("id")).agg(F.max_by("decision_id", F.struct("decided_at", "decision_id")).alias("decision_id"))
    m = messages.groupBy(F.col("task_id").alias("id")).agg(F.count(F.lit(1)).alias("n_messages"), F.sum("tokens").alias("context_tokens"))
    joined = tasks.join(p, "id", "left").join(d, "id", "left").join(m, "id", "left")
    return joined.select(
        *(F.col(c) for c in tasks.columns), F.coalesce("proposals", F.array().cast("array<bigint>")).alias("proposals"), "decision_id",
        F.coalesce("n_messages", F.lit(0)).alias("n_messages"), F.coalesce("context_tokens", F.lit(0)).alias("context_tokens"),
    )


def created(requests: DataFrame, kind: Column, directives: DataFrame | None = None) -> DataFrame:
    """New tasks of requests (key, text): pending, with complexity, risk, and the strategy that these and the directives pick."""
    from quillspark.functions import routing as RT

    c = RT.classified(requests, "text").withColumn("type", kind)
    if directives is not None:
        c = c.join(directives.select("key", "force_confidence", "prevent_confidence"), "key", "left")
    force, prevent = (F.coalesce(n, F.lit(0.0)) for n in ("force_confidence", "prevent_confidence")) if directives is not None else (F.lit(0.0), F.lit(0.0))
    routed = RT.strategy(F.col("type"), F.col("complexity"), F.col("risk"), F.size("critical") > 0, F.lower(F.btrim("text")), force, prevent)
    return c.select("key", preview(F.col("text"), 60).alias("title"), F.lit("PENDING").alias("status"), "type", "complexity", "risk", routed.alias("routing"))


def submitted(tasks: DataFrame, inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Proposals of inputs (task_id, agent_id, content, confidence) to tasks that are not finished, and the tasks, those in progress now waiting for input."""
    live = tasks.filter(F.col("status").isin(list(ACTIVE)))
    proposals = inputs.join(live.select(F.col("id").alias("task_id")), "task_id", "left_semi")
    moves = proposals.select(F.col("task_id").alias("id")).distinct().select("id", F.lit("IN_PROGRESS").alias("expected"), F.lit("WAITING_INPUT").alias("next"))
    return proposals, compare_and_set(tasks, moves)


def continued(tasks: DataFrame, proposals: DataFrame, decisions: DataFrame, messages: DataFrame, max_tokens: int) -> DataFrame:
    """Bundles of pending tasks, which are in progress now, with the newest messages that fit ``max_tokens``."""
    from quillspark.operators.memory import pruned

    moved = compare_and_set(tasks, tasks.select("id", F.lit("PENDING").alias("expected"), F.lit("IN_PROGRESS").alias("next"))).filter("changed").drop("changed")
    return bundles(moved, proposals, decisions, pruned(messages, max_tokens))


def completed(tasks: DataFrame, proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Tasks with the outcome of decisions (task_id, proposal_id): done if the proposal is one of the task's and the task may be completed."""
    own = proposals.select("task_id", F.col("id").alias("proposal_id"), F.lit(True).alias("known"))
    valid = decisions.join(own, ["task_id", "proposal_id"], "left").select(F.col("task_id").alias("id"), "proposal_id", F.coalesce("known", F.lit(False)).alias("known"))
    joined = tasks.join(valid, "id", "left")
    done = F.coalesce(F.col("known") & allowed(F.col("status"), F.lit("COMPLETED")), F.lit(False))
    return joined.select("id", F.when(done, "COMPLETED").otherwise(F.col("status")).alias("status"), F.when(done, F.col("proposal_id")).alias("selected"), (F.col("proposal_id").isNotNull() & ~done).alias("refused"))
