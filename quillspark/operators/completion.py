"""Completing tasks in full: who may be completed, and every row that doing so leaves in other tables.

All requests of a batch are judged together by joins; a refused one leaves nothing and says why.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns of a request.
REQUEST = (
    "task_id long, completed_by string, considered array<long>, selected array<long>, winner long, agreement double, rationale string, "
    "input_tokens long, output_tokens long, summary string, artifacts string"
)


def judged(tasks: DataFrame, proposals: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests with ``refused`` (null if they may be done), ``warning``, and the considered tokens and those of what was selected.

    ``tasks`` has id, status, routing; ``proposals`` id, task_id, tokens. A task is completed once: of several requests for one task in a batch
    the one of the smallest ``completed_by`` and summary is taken. A consensus task needs considered proposals; considered proposals have to be the
    task's own, winner and selection considered, the agreement rate from 0 to 1.
    """
    one = requests.filter(F.col("task_id").isNotNull()).groupBy("task_id").agg(F.min(F.struct("completed_by", "summary", *(c for c in requests.columns if c not in ("task_id", "completed_by", "summary")))).alias("r")).select("task_id", "r.*")
    named = one.select("task_id", F.coalesce("selected", F.array().cast("array<bigint>")).alias("sel"), "winner", F.explode(F.array_distinct("considered")).alias("proposal_id"))
    own = proposals.select(F.col("id").alias("proposal_id"), F.col("task_id").alias("of"), "tokens")
    chosen = F.when(F.size("sel") > 0, F.array_contains("sel", F.col("proposal_id"))).otherwise(F.col("proposal_id") == F.col("winner"))
    met = named.join(own, "proposal_id", "left").groupBy("task_id").agg(
        F.count_if(F.col("of").isNull()).alias("unknown"), F.count_if(F.col("of") != F.col("task_id")).alias("foreign"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("considered_tokens"), F.coalesce(F.sum(F.when(chosen, F.col("tokens"))), F.lit(0)).alias("selected_tokens"),
    )
    known = one.join(tasks.select(F.col("id").alias("task_id"), "status", "routing"), "task_id", "left").join(met, "task_id", "left")
    considered, none = F.coalesce("considered", F.array().cast("array<bigint>")), F.array().cast("array<bigint>")
    refused = (
        F.when(F.col("status").isNull(), "task not found").when(F.col("status") == "COMPLETED", "already completed")
        .when((F.col("routing") == "CONSENSUS") & (F.size(considered) == 0), "consensus needs considered proposals")
        .when(F.coalesce("unknown", F.lit(0)) > 0, "proposal not found").when(F.coalesce("foreign", F.lit(0)) > 0, "proposal of another task")
        .when(F.col("winner").isNotNull() & ~F.array_contains(considered, F.col("winner")), "winner not considered")
        .when(F.size(F.array_except(F.coalesce("selected", none), considered)) > 0, "selected not considered")
        .when(~F.coalesce(F.col("agreement").between(0, 1), F.lit(True)), "agreement rate out of range")
    )
    return known.withColumn("refused", refused).withColumn("warning", F.when(F.col("refused").isNull() & (F.col("status") == "FAILED"), "was FAILED"))


def _metric(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.struct(F.lit(name).alias("name"), value.cast("double").alias("value")))


def rows(outcomes: DataFrame, messages: DataFrame) -> dict[str, DataFrame]:
    """What the accepted requests leave: ``tasks`` (id, status, completed_by), ``decisions``, ``metrics``, ``messages`` and ``snapshots`` by task.

    The conversation's tokens are counted after the summary is added; a summary counts a quarter of its characters, one at least. A savings metric is
    the considered tokens less those of the selection, and its share, 0 at least.
    """
    done = outcomes.filter(F.col("refused").isNull())
    decided = F.col("considered").isNotNull()
    saved = F.greatest(F.col("considered_tokens") - F.col("selected_tokens"), F.lit(0))
    said = F.when(F.length(F.btrim(F.coalesce("summary", F.lit("")))) > 0, F.greatest(F.floor(F.length("summary") / 4), F.lit(1)))
    before = messages.join(done.select("task_id"), "task_id", "left_semi").groupBy("task_id").agg(F.sum("tokens").alias("before"))
    both = F.coalesce(F.col("input_tokens") + F.col("output_tokens"), F.col("input_tokens"), F.col("output_tokens"))
    each = F.array(
        _metric("decision.token_savings.absolute", F.when(decided, F.coalesce(saved, F.lit(0)))),
        _metric("decision.token_savings.percent", F.when(decided, F.coalesce(F.try_divide(saved, F.col("considered_tokens")), F.lit(0.0)))),
        _metric("task.tokens.input", F.col("input_tokens")), _metric("task.tokens.output", F.col("output_tokens")), _metric("task.tokens.total", both),
        _metric("task.conversation.tokens.total", F.coalesce("before", F.lit(0)) + F.coalesce(said, F.lit(0))),
    )
    return {
        "tasks": done.select(F.col("task_id").alias("id"), F.lit("COMPLETED").alias("status"), F.coalesce("completed_by", F.lit("unknown")).alias("completed_by")),
        "decisions": done.filter(decided).select("task_id", F.array_sort(F.array_distinct("considered")).alias("considered"), F.array_sort(F.array_distinct(F.coalesce("selected", F.array().cast("array<bigint>")))).alias("selected"), "winner", "agreement", "rationale", "completed_by"),
        "metrics": done.join(before, "task_id", "left").select("task_id", F.explode(F.filter(each, lambda m: m.isNotNull())).alias("m")).select("task_id", "m.name", "m.value"),
        "messages": done.filter(said.isNotNull()).select("task_id", F.lit("system").alias("role"), F.col("summary").alias("content"), said.cast("long").alias("tokens"), F.col("completed_by").alias("agent_id")),
        "snapshots": done.filter(F.col("artifacts").isNotNull()).select("task_id", F.lit("final_artifacts").alias("label"), F.col("artifacts").alias("snapshot")),
    }


#: The tables that completing changes, and the key of those in which a later row replaces an earlier one.
TABLES = {
    "tasks": "id long, status string, routing string, completed_by string",
    "decisions": "task_id long, considered array<long>, selected array<long>, winner long, agreement double, rationale string, completed_by string",
    "metrics": "task_id long, name string, value double",
    "messages": "task_id long, role string, content string, tokens long, agent_id string",
    "snapshots": "task_id long, label string, snapshot string",
}
KEYS = {"tasks": "id"}


def complete(ledger, proposals: DataFrame, requests: DataFrame) -> int:
    """Complete the tasks of a ledger with ``TABLES``: decision, metrics, message, snapshot and status appear together or not at all."""

    def make(view) -> dict[str, DataFrame]:
        tasks = view.table("tasks")
        new = rows(judged(tasks, proposals, requests), view.table("messages"))
        moved = new["tasks"].join(tasks.select("id", "routing"), "id").select("id", "status", "routing", "completed_by")
        return {**new, "tasks": moved}

    return ledger.change(make)
