"""Task routing: complexity, risk, directives, strategies, budgets and agent scores."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.session import bounded_broadcast

# Words that make a task critical.
CRITICAL = (
    "security", "vulnerability", "xss", "csrf", "injection", "auth", "authentication", "authorization", "oauth", "jwt", "payment", "payments", "checkout", "pci",
    "encryption", "cryptography", "crypto", "gdpr", "pii", "secrets", "token", "admin", "privilege", "rce", "dos", "ddos",
)

# Weights of words that speak for complexity and for risk.
COMPLEXITY = {
    "refactor": 1, "architecture": 2, "migrate": 2, "integration": 2, "multiple": 1, "consensus": 1, "parallel": 1, "optimize": 1, "performance": 1,
    "scal": 2, "concurrent": 2, "distributed": 2, "protocol": 1, "kafka": 1, "database": 1, "index": 1, "cache": 1, "latency": 1,
}
RISK = {
    "delete": 1, "drop": 1, "migration": 2, "billing": 2, "payout": 2, "production": 2, "outage": 2, "hotfix": 1, "critical": 1, "incident": 1,
    "compliance": 2, "legal": 2, "sla": 1, "downtime": 2,
}

# Weights of the phrases of user directives.
FORCE = {r"need\s+consensus": 1.2, r"consensus\s+required": 1.2, r"consensus\s+please": 0.8}
FORCE_AGENT = {  # the first group names an agent: weight, and what the agent gets
    r"get\s+([a-z0-9_'-]+)\s*'?s?\s+input": (1.0, 0.9), r"want\s+([a-z0-9_'-]+)\s+to\s+review": (1.0, 0.9), r"check\s+with\s+([a-z0-9_'-]+)": (0.9, 0.8),
    r"ask\s+([a-z0-9_'-]+)\s+about": (0.9, 0.8), r"have\s+([a-z0-9_'-]+)\s+look\s+at": (0.9, 0.8), r"need\s+([a-z0-9_'-]+)\s*'?s?\s+opinion": (0.9, 0.8),
    r"ask\s+([a-z0-9_'-]+)\s+to\s+review": (1.0, 0.9),
}
PREVENT = {
    "solo": 1.1, r"no\s+consensus": 1.2, r"skip\s+consensus": 1.2, r"skip\s+review": 1.0, r"just\s+implement": 0.9, r"quick\s+fix": 0.9, "hotfix": 1.0,
    r"i'?ll\s+handle\s+this": 0.8,
}
EMERGENCY = {"emergency": 0.9, r"production\s+down": 1.4, "urgent": 0.8, "asap": 0.8, "immediately": 0.9, "critical": 0.9, "sev[0-1]": 1.3}
NEGATION = r"(?i)\b(don't|dont|do\s+not|no|not|never)\s+(really\s+)?(need|want|require|do\s+we\s+need)\s+(a\s+)?consensus\b"
SOFTENER = r"(?i)\b(maybe|might|could|can you|possible|if you can)\b"
AGENT_PHRASES = {  # %s is the agent's name
    r"ask\s+%s\b": 1.3, r"%s\s*,": 1.1, r"have\s+%s\b": 1.2, r"get\s+%s\s+to\b": 1.2, r"%s\s+should\b": 1.1, r"need\s+%s\b": 1.0, r"let\s+%s\s+handle\b": 1.3,
    r"pass\s+to\s+%s\b": 1.2, r"%s\s+can\s+do\b": 1.0,
}
MENTION, CONJUNCTION, SEVERAL_AGENTS = 0.9, 0.6, 0.6
MIN_CONFIDENCE, ADVANTAGE, EMERGENCY_FORCE, ALIAS_DISTANCE = 0.35, 0.2, 0.2, 2

# The capability that each task type needs.
CAPABILITY = {
    "IMPLEMENTATION": "CODE_GENERATION", "ARCHITECTURE": "ARCHITECTURE", "REVIEW": "CODE_REVIEW", "RESEARCH": "DATA_ANALYSIS", "TESTING": "TEST_WRITING",
    "DOCUMENTATION": "DOCUMENTATION", "PLANNING": "PLANNING", "BUGFIX": "DEBUGGING",
}


def _weights(low: Column, table: dict[str, int]) -> Column:
    out = F.lit(0)
    for word, w in table.items():
        out = out + F.when(low.contains(word), w).otherwise(0)
    return out


def _step(n: Column, edges: list[int], values: list[int]) -> Column:
    out = F.when(n <= edges[0], values[0])
    for edge, v in zip(edges[1:], values[1:], strict=False):
        out = out.when(n <= edge, v)
    return out.otherwise(values[-1])


def _clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def classified(df: DataFrame, text: str) -> DataFrame:
    """``df`` plus complexity and risk from 1 to 10, the critical words found and a confidence."""
    low = F.lower(F.btrim(F.col(text)))
    out = df.withColumn("__low", low).withColumn("__n", F.regexp_count("__low", F.lit(r"\S+")))
    found = F.filter(F.array(*map(F.lit, CRITICAL)), lambda w: F.contains(F.col("__low"), w))
    out = out.withColumn("critical", found).withColumn("__c", _weights(F.col("__low"), COMPLEXITY)).withColumn("__r", _weights(F.col("__low"), RISK))
    k, n, empty = F.size("critical"), F.col("__n"), F.col("__low") == ""
    complexity = _clamp(1 + _step(n, [5, 12, 25, 40, 70, 110, 170], [1, 2, 3, 4, 5, 6, 7, 8]) + F.col("__c") + F.least(k, F.lit(2)), 1, 10)
    risk = _clamp(1 + _step(k, [0, 1, 2], [0, 2, 3, 4]) + F.col("__r") + _step(n, [12, 40, 100], [0, 1, 2, 3]), 1, 10)
    confidence = 0.45 * sigmoid(F.col("__c")) + 0.45 * sigmoid(F.col("__r")) + 0.10 * sigmoid(F.floor(n / 20))
    return (
        out.withColumn("complexity", F.when(empty, 1).otherwise(complexity)).withColumn("risk", F.when(empty, 1).otherwise(risk))
        .withColumn("confidence", F.when(empty, 0.2).otherwise(_clamp(confidence, 0.0, 1.0))).drop("__low", "__n", "__c", "__r")
    )


def words_of(pattern: str) -> list[str]:
    """Runs of letters that every match of a pattern of the tables above holds, the longest first: what is optional, a group or a class is left out."""
    bare = re.sub(r"\([^)]*\)|\[[^\]]*\]|\\.[+*?]?|.[?*]", " ", pattern)
    return sorted(set(re.findall("[a-z]{2,}", bare)), key=lambda w: (-len(w), w))


def _holds(low: Column, pattern: str) -> Column:
    """Whether a lower-cased text holds the words without which a pattern has no match: far cheaper than the pattern."""
    return reduce(and_, [F.contains(low, F.lit(w)) for w in words_of(pattern)])


def _hits(text: Column, low: Column, patterns: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for p, w in patterns.items():
        out = out + F.when(~_holds(low, p), 0.0).otherwise(F.regexp_count(text, F.lit(rf"(?i)\b{p}\b")) * w)  # null for a null text
    return out


def _confidence(score: Column) -> Column:
    return _clamp(1 - F.exp(-score), 0.0, 1.0)


def directives(df: DataFrame, text: str, agents: list[str]) -> DataFrame:
    """``df`` plus the directive of each request: force, prevent and emergency with confidences, and the agent it names.

    Names count if they are ``agents`` or within an edit distance of two of one.
    """
    joined = F.regexp_replace(F.btrim(F.col(text)), r"\s+", " ")
    # made once for each row: expressions above a generator do not repeat it
    out = df.select("*", F.explode(F.array(joined)).alias("__t")).select("*", F.explode(F.array(F.lower("__t"))).alias("__low"))
    t, low = F.col("__t"), F.col("__low")
    names = F.array(*map(F.lit, agents))
    none = F.array().cast("array<struct<a:string,force:double,own:double>>")

    def known(name: Column) -> Column:
        close = F.transform(names, lambda a: F.struct(F.levenshtein(name, a).alias("d"), a.alias("a")))
        best = F.array_min(close)
        return F.when((F.length(name) >= 2) & (best["d"] <= ALIAS_DISTANCE), best["a"])

    def captured(pattern: str, weight: float, own: float) -> Column:
        raw = F.regexp_extract_all(t, F.lit(rf"(?i)\b{pattern}\b"), F.lit(1))
        clean = F.transform(raw, lambda x: known(F.regexp_replace(F.lower(x), r"('s|[',.!?:])+$", "")))
        found = F.transform(F.filter(clean, lambda a: a.isNotNull()), lambda a: F.struct(a.alias("a"), F.lit(weight).alias("force"), F.lit(own).alias("own")))
        return F.when(_holds(low, pattern), found)

    mentions = [captured(p, w, own) for p, (w, own) in FORCE_AGENT.items()]
    shortest, longest = min(map(len, agents), default=0) - ALIAS_DISTANCE, max(map(len, agents), default=0) + ALIAS_DISTANCE
    mention = lambda pattern, w: F.transform(
        F.filter(F.transform(F.filter(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda x: F.length(x).between(shortest, longest)), lambda x: known(F.lower(x))), lambda a: a.isNotNull()),
        lambda a: F.struct(a.alias("a"), F.lit(0.0).alias("force"), F.lit(w).alias("own")),
    )
    mentions += [F.when(F.contains(low, F.lit("@")), mention(r"(?i)@([a-z0-9_-]+)", MENTION)), mention(r"(?i)\b(?:and|&)\s+([a-z0-9_'-]+)\b", CONJUNCTION)]
    for a in agents:
        said = []
        for phrase, w in AGENT_PHRASES.items():
            n = F.regexp_count(t, F.lit(r"(?i)\b" + phrase % a))
            said.append(F.array_repeat(F.struct(F.lit(a).alias("a"), F.lit(0.0).alias("force"), F.lit(w).alias("own")), n))
        mentions.append(F.when(F.contains(low, F.lit(a.lower())), F.concat(*said)))
    # a null text has no mentions, and its array stays null
    out = out.withColumn("__m", F.when(t.isNotNull(), F.concat(*(F.coalesce(m, none) for m in mentions))))
    total = lambda field: F.aggregate("__m", F.lit(0.0), lambda acc, x: acc + x[field])

    def assigned(a: str) -> Column:
        return F.aggregate("__m", F.lit(0.0), lambda acc, x: acc + F.when(x["a"] == a, x["own"]).otherwise(0.0))

    by_agent = F.array(*[F.struct(assigned(a).alias("s"), F.lit(a).alias("a")) for a in agents])
    out = out.withColumn("__best", F.array_max(by_agent)).withColumn("__force", _hits(t, low, FORCE) + total("force")).withColumn("__prevent", _hits(t, low, PREVENT)).withColumn("__emergency", _hits(t, low, EMERGENCY))
    negated, soft = F.contains(low, F.lit("consensus")) & t.rlike(NEGATION), F.when(t.rlike(SOFTENER), 0.9).otherwise(1.0)
    several = F.size(F.array_distinct(F.transform("__m", lambda x: x["a"]))) >= 2
    force = F.col("__force") * F.when(negated, 0.25).otherwise(1.0) * soft + F.when(several, SEVERAL_AGENTS).otherwise(0.0)
    prevent = (F.col("__prevent") + F.when(negated, 0.9).otherwise(0.0)) * soft
    out = out.withColumn("__force", force).withColumn("__prevent", prevent)
    urgent, f, p = F.col("__emergency") > 0, F.col("__force"), F.col("__prevent")
    return out.select(
        *df.columns,
        F.when(urgent, f > EMERGENCY_FORCE).otherwise((f - p >= ADVANTAGE) & (_confidence(f) >= MIN_CONFIDENCE)).alias("force"),
        F.when(urgent, f <= EMERGENCY_FORCE).otherwise((f - p <= -ADVANTAGE) & (_confidence(p) >= MIN_CONFIDENCE)).alias("prevent"),
        urgent.alias("emergency"),
        _confidence(f).alias("force_confidence"), _confidence(p).alias("prevent_confidence"), _confidence(F.col("__emergency")).alias("emergency_confidence"),
        F.when(F.col("__best.s") > 0, F.col("__best.a")).alias("agent"), F.when(F.col("__best.s") > 0, _confidence(F.col("__best.s"))).otherwise(0.0).alias("agent_confidence"),
    )


def strategy(kind: Column, complexity: Column, risk: Column, critical: Column, low: Column, force: Column, prevent: Column, least: float = 0.5) -> Column:
    """The routing strategy: strong directives, then risk, task type, words for parallel work, complexity."""
    parallel = low.contains("parallel") | low.contains("concurrent") | low.contains("multiple")
    return (
        F.when(force >= least, "CONSENSUS").when(prevent >= least, "SOLO").when((risk >= 8) | critical, "CONSENSUS")
        .when(kind.isin("ARCHITECTURE", "PLANNING") & (complexity >= 7), "SEQUENTIAL").when(kind == "REVIEW", "CONSENSUS")
        .when(kind.isin("TESTING", "RESEARCH") & (risk <= 4) & (complexity >= 5), "PARALLEL").when(parallel, "PARALLEL")
        .when((complexity >= 8) & risk.between(4, 7), "SEQUENTIAL").otherwise("SOLO")
    )


def token_budget(complexity: Column, consensus: Column, kind: Column, base: int = 4000, reserve: int = 500) -> Column:
    """Struct (max_tokens, reserve, available, diversity): the larger of the base and 64 c^2, a tenth more for consensus, 8192 at most."""
    c = _clamp(F.coalesce(complexity, F.lit(5)), 1, 10)
    grown = F.greatest(F.lit(base), (c * c * 64).cast("int"))
    most = F.least(F.lit(8192), F.when(consensus, F.floor(grown * 1.1)).otherwise(grown)).cast("int")
    held = F.least(F.lit(reserve), F.floor(most / 2)).cast("int")
    return F.struct(most.alias("max_tokens"), held.alias("reserve"), (most - held).alias("available"), F.when(kind == "ARCHITECTURE", 0.8).when(kind == "RESEARCH", 0.6).otherwise(0.3).alias("diversity"))


def selected_agents(tasks: DataFrame, agents: DataFrame, most: int = 1, broadcast_rows: int = 100_000) -> DataFrame:
    """The best agents of each task (task_id, needs): all needs met, not offline; strength - 10 if busy - load.

    Agents are ranked once for each different set of needs, and tasks take the ranks of theirs.
    """
    asked = tasks.select("task_id", F.array_sort(F.array_distinct("needs")).alias("needs"))
    skills = agents.filter("status <> 'OFFLINE'").select("agent_id", "status", "load", "strengths", F.explode("capabilities").alias("need"))
    met = asked.select("needs").distinct().withColumn("need", F.explode("needs")).join(bounded_broadcast(skills, broadcast_rows), "need")
    mean = F.avg(F.coalesce(F.try_element_at("strengths", F.col("need")), F.lit(50.0)))
    scored = met.groupBy("needs", "agent_id").agg(F.count(F.lit(1)).alias("k"), mean.alias("strength"), F.first("status").alias("status"), F.first("load").alias("load"))
    score = F.col("strength") - F.when(F.col("status") == "BUSY", 10.0).otherwise(0.0) - F.col("load")
    rank = F.row_number().over(W.partitionBy("needs").orderBy(F.desc("score"), "agent_id"))
    best = scored.filter("k = size(needs)").withColumn("score", score).withColumn("rank", rank).filter(F.col("rank") <= most)
    return asked.join(bounded_broadcast(best.select("needs", "agent_id", "score", "rank"), broadcast_rows), "needs").select("task_id", "agent_id", "score", "rank")
