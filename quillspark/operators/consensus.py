"""Consensus over proposals: voting, scored winners, tie-aware picks and the cascade."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.session import ship

ship(__name__)

# Words that raise the quality of a proposal's text.
QUALITY_WORDS = ("reasoning", "analysis", "steps", "edge", "risk", "limitation", "trade-off", "tradeoff", "pros", "cons", "alternative")
EDGE_TERMS = ("edge case", "edge-case", "risk", "limitation", "failure mode", "pitfall")
TRADE_TERMS = ("trade-off", "tradeoff", "pros", "cons", "alternative", "compare", "versus")


def canonical(content: Column) -> Column:
    """A JSON text in one form, names in order and numbers without zeros behind the point; any other text as it stands."""
    value = F.try_parse_json(content)
    return F.when(value.isNotNull(), F.concat(F.lit("json "), F.to_json(value))).otherwise(F.concat(F.lit("text "), content))


def voting(proposals: DataFrame, threshold: float = 0.75, by_structure: bool = False) -> DataFrame:
    """(task_id, total, votes, leaders, agreed, winner): the content most propose, if alone and at ``threshold`` of all.

    The winner is the content's proposal of highest confidence, then earliest id. With ``by_structure`` JSON contents are one vote if they are the same
    value, however it is written.
    """
    if by_structure:
        proposals = proposals.withColumn("content", canonical(F.col("content")))
    best = F.max_by("id", F.struct(F.col("confidence"), -F.col("id")))
    votes = proposals.groupBy("task_id", "content").agg(F.count(F.lit(1)).alias("n"), best.alias("best"))
    top = F.max("n").over(W.partitionBy("task_id"))
    ranked = votes.withColumn("top", top)
    out = ranked.groupBy("task_id").agg(
        F.sum("n").alias("total"), F.max("top").alias("votes"), F.count_if(F.col("n") == F.col("top")).alias("leaders"), F.max(F.when(F.col("n") == F.col("top"), F.col("best"))).alias("best")
    )
    agreed = (F.col("leaders") == 1) & (F.col("votes") >= threshold * F.col("total"))
    return out.select("task_id", "total", "votes", "leaders", agreed.alias("agreed"), F.when(agreed, F.col("best")).alias("winner"))


def winners(proposals: DataFrame, score: str) -> DataFrame:
    """The first proposal of each task by score, confidence, then earliest creation and id."""
    order = W.partitionBy("task_id").orderBy(F.desc(score), F.desc("confidence"), F.asc("created_at"), F.asc("id"))
    return proposals.withColumn("k", F.row_number().over(order)).filter("k = 1").drop("k")


def tie_aware(proposals: DataFrame) -> DataFrame:
    """(task_id, winner, rule): the only one of highest confidence, else the only one of fewest tokens, else the first by id."""
    top, few = F.max("confidence"), F.min("tokens")
    g = proposals.groupBy("task_id").agg(top.alias("c"), few.alias("t"))
    joined = proposals.join(g, "task_id").groupBy("task_id").agg(
        F.count_if(F.col("confidence") == F.col("c")).alias("nc"), F.max(F.when(F.col("confidence") == F.col("c"), F.col("id"))).alias("wc"),
        F.count_if(F.col("tokens") == F.col("t")).alias("nt"), F.max(F.when(F.col("tokens") == F.col("t"), F.col("id"))).alias("wt"),
        F.min_by("id", F.struct(-F.col("confidence"), F.col("tokens"), F.col("id"))).alias("first"),
    )
    rule = F.when(F.col("nc") == 1, "confidence").when(F.col("nt") == 1, "tokens").otherwise("order")
    winner = F.when(F.col("nc") == 1, F.col("wc")).when(F.col("nt") == 1, F.col("wt")).otherwise(F.col("first"))
    return joined.select("task_id", winner.alias("winner"), rule.alias("rule"))


def cascade(first: DataFrame, then: DataFrame) -> DataFrame:
    """Voting where it agreed, else the scored winner; (task_id, winner, strategy)."""
    a, b = first.filter("agreed").select("task_id", F.col("winner").alias("v")), then.select("task_id", F.col("id").alias("w"))
    joined = b.join(a, "task_id", "full_outer")
    return joined.select("task_id", F.coalesce("v", "w").alias("winner"), F.when(F.col("v").isNotNull(), "VOTING").otherwise("REASONING_QUALITY").alias("strategy"))


def text_quality(text: Column) -> Column:
    """Length on a log scale to 0.85, and 0.03 for each quality word to 0.15."""
    hits = F.lit(0)
    for w in QUALITY_WORDS:
        hits = hits + F.when(F.lower(text).contains(w), 1).otherwise(0)
    length = F.least(F.lit(0.85), F.log1p(F.length(text).cast("double")) / F.log1p(F.lit(2000.0)))
    return F.when(F.length(text) == 0, 0.0).otherwise(F.least(F.lit(1.0), length + F.least(F.lit(0.15), hits * 0.03)))


def reasoning_quality(text: Column, confidence: Column) -> Column:
    """Depth 0.5, edge cases 0.25 and trade-offs 0.25 of a plain-text proposal, weighted by confidence."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.btrim(x))
    steps = F.least(F.lit(20), F.size(F.filter(lines, lambda x: x.rlike(r"^(?:[-*•]|\d+\.) .*$"))))
    heads = F.size(F.filter(lines, lambda x: x.endswith(":") & F.length(x).between(3, 80))) + F.size(F.filter(lines, lambda x: x.rlike(r"^[A-Z][A-Za-z ]{2,30}$")))
    has = lambda terms: F.lower(text).rlike("|".join(terms).replace("-", r"\-"))
    part = lambda x: F.least(F.lit(1.0), x)
    depth = 0.7 * part(F.length(text) / 1200.0) + 0.2 * part(steps / 10.0) + 0.1 * part(F.least(F.lit(20), heads) / 6.0)
    edge, trade = F.when(has(EDGE_TERMS), 0.15).otherwise(0.0), F.when(has(TRADE_TERMS), 0.15).otherwise(0.0)
    return (0.5 * depth + 0.25 * edge + 0.25 * trade) * (0.5 + 0.5 * confidence)


# Names of lists whose items count, by what they count as, and names of texts that count twice.
ITEM_LISTS = {
    "steps": "steps", "edgecases": "edges", "edge_cases": "edges", "risks": "edges", "limitations": "edges", "failuremodes": "edges", "failure_modes": "edges",
    "tradeoffs": "trades", "trade_offs": "trades", "pros": "trades", "cons": "trades", "alternatives": "trades",
}
TEXT_NAMES = ("reasoning", "analysis", "justification", "summary", "explanation")
_STEP, _HEADING, _NEWLINE = re.compile(r"(?:[-*•]|\d+\.) .*"), re.compile(r"[A-Z][A-Za-z ]{2,30}"), re.compile(r"\r\n|\n|\r")
FEATURES = "chars int, steps int, sections int, edges int, trades int, has_edge boolean, has_trade boolean"


def proposal_features(content: object) -> dict:
    """What a proposal, any JSON value, shows of its reasoning.

    Named lists count their items, once under their name and once as a list; a list of lists hands its name on. Texts of certain
    names, and texts in lists, are read twice. Every object adds its number of names to the sections.
    """
    found, texts = dict.fromkeys(("steps", "sections", "edges", "trades"), 0), []
    todo: list[tuple[object, str | None]] = [(content, None)]
    while todo:
        value, name = todo.pop()
        if isinstance(value, str):
            texts.append(value)
            lines = [x.strip() for x in _NEWLINE.split(value)]
            found["steps"] += min(20, sum(bool(_STEP.fullmatch(x)) for x in lines))
            found["sections"] += min(20, sum((x.endswith(":") and 3 <= len(x) <= 80) + bool(_HEADING.fullmatch(x)) for x in lines))
        elif isinstance(value, list):
            items = [x for x in value if x is not None]
            if name in ITEM_LISTS:
                found[ITEM_LISTS[name]] += len(items)
            texts += [x for x in items if isinstance(x, str)]
            todo += [(x, name) for x in items]
        elif isinstance(value, dict):
            found["sections"] += len(value)
            for key, part in value.items():
                low = key.lower()
                if low in ITEM_LISTS and isinstance(part, list):
                    found[ITEM_LISTS[low]] += len(part)
                if low in TEXT_NAMES and isinstance(part, str):
                    texts.append(part)
                todo.append((part, low))
    whole = "\n".join(texts)
    low = whole.lower()
    return {"chars": len(whole), **found, "has_edge": any(t in low for t in EDGE_TERMS), "has_trade": any(t in low for t in TRADE_TERMS)}


def json_features(content: Column) -> Column:
    """Struct of the features of a JSON text; a text that is not JSON counts as it stands."""

    def read(text: str | None) -> dict:
        try:
            return proposal_features(json.loads(text) if text is not None else None)
        except ValueError:
            return proposal_features(text)

    @F.pandas_udf(FEATURES)
    def features(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(t) for t in texts], columns=[f.split()[0] for f in FEATURES.split(", ")])

    return features(content)


def reasoning_score(features: Column, confidence: Column) -> Column:
    """Depth 0.5, edge cases 0.25 and trade-offs 0.25, weighted by confidence."""
    part = lambda name, most: F.least(F.lit(1.0), features[name] / most)
    depth = 0.7 * part("chars", 1200.0) + 0.2 * part("steps", 10.0) + 0.1 * part("sections", 6.0)
    edge = 0.7 * part("edges", 5.0) + F.when(features["has_edge"], 0.15).otherwise(0.0)
    trade = 0.7 * part("trades", 6.0) + F.when(features["has_trade"], 0.15).otherwise(0.0)
    return (0.5 * depth + 0.25 * edge + 0.25 * trade) * (0.5 + 0.5 * confidence)


def agreement_rate(ratio: Column, percent: Column) -> Column:
    """The winner's share as a strategy reports it: a ratio, else a percentage, from 0 to 1; null for neither."""
    clamp = lambda x: F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    return F.coalesce(clamp(ratio), clamp(percent / 100.0))
