"""Text expressions: keywords, lexical scores, token estimates, globs and symbols."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that a keyword query drops.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "will", "with",
)
ALNUM = r"[\p{L}\p{Nd}]"

# Characters for each token by model, and the punctuation of the estimate.
CHARS_PER_TOKEN = {"DEFAULT": 4.0, "OPENAI": 4.0, "CLAUDE": 4.3, "CODEX": 3.3}
CJK = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]"

# The four patterns that find symbols in a query.
SYMBOL_PATTERNS = (
    r"\b(?:[A-Za-z_][A-Za-z0-9_]*\.)+[A-Za-z_][A-Za-z0-9_]*\b",
    r"\b[A-Z][A-Za-z0-9]{2,}\b",
    r"\b[a-z]+_[a-z0-9_]+\b",
    r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\(",
)

# A path and a file's name in a query.
PATH_PATTERN = r"(?:\.{0,2}/)?(?:[a-zA-Z0-9_-]+/)*[a-zA-Z0-9_-]+\.[a-zA-Z]{1,5}"
FILE_NAME_PATTERN = r"\b([A-Z][a-zA-Z0-9_]*\.[a-z]{1,5})\b"

# Shapes of secrets that scrubbing replaces.
SECRET_PATTERNS = (
    (r"AKIA[0-9A-Z]{16}", "[AWS_KEY]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "[IP]"),
)


def keywords(query: str) -> list[str]:
    """Different lower-case words of two or more characters that are not stop words, in order."""
    words = re.split(r"[^A-Za-z0-9_]+", query.lower())
    return list(dict.fromkeys(w for w in words if len(w) >= 2 and w not in STOPWORDS))


def keyword_column(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), r"\W+"), lambda w: F.length(w) >= 2)
    return F.array_distinct(F.array_except(words, F.array(*map(F.lit, STOPWORDS))))


def contains_all(text: Column, words: list[str]) -> Column:
    found = F.lit(True)
    for w in words:
        found = found & F.lower(text).contains(w)
    return found


def _bounded(low: Column, at: Column, n: Column) -> Column:
    """Whether the ``n`` characters at ``at`` have no letter or digit on either side."""
    before = F.when(at <= 1, False).otherwise(F.substring(low, F.greatest(at - 1, F.lit(1)), F.lit(1)).rlike(ALNUM))
    return ~before & ~F.substring(low, at + n, F.lit(1)).rlike(ALNUM)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lexical_score(text: Column, words: list[str]) -> Column:
    """0.95: all words in order, each the first found after the last, within 50 characters; 0.7: all
    words somewhere; else half the occurrences for each word, 0.5 at most. Words must stand alone.

    In the ordered scan the first occurrence counts even if it is part of a longer word, which ends it.
    """
    if not words:
        return F.lit(0.0)
    alone = lambda low, w: F.regexp_count(low, F.lit(f"(?<!{ALNUM}){re.escape(w)}(?!{ALNUM})")).cast("int")

    def score(s: Column) -> Column:
        low, counts = s["low"], s["counts"]
        total = F.aggregate(counts, F.lit(0), lambda acc, x: acc + x)
        partial = F.least(F.lit(0.5), total / (2.0 * len(words)))
        if len(words) < 2:
            return F.when(total == 0, 0.0).otherwise(partial)

        def step(acc: Column, w: Column) -> Column:
            return let(
                F.when(acc["ok"], F.call_function("locate", w, low, acc["at"])).otherwise(0),
                lambda found: F.struct(
                    (found + F.length(w)).alias("at"), ((found > 0) & _bounded(low, found, F.length(w))).alias("ok"), F.when(acc["first"] == 0, found).otherwise(acc["first"]).alias("first")
                ),
            )

        start = F.struct(F.lit(1).alias("at"), F.lit(True).alias("ok"), F.lit(0).alias("first"))
        phrase = let(F.aggregate(F.array(*map(F.lit, words)), start, step), lambda p: p["ok"] & (p["at"] - p["first"] <= 50))
        return F.when(total == 0, 0.0).when(phrase, 0.95).when(F.forall(counts, lambda c: c > 0), 0.7).otherwise(partial)

    counted = let(F.lower(text), lambda low: F.struct(low.alias("low"), F.array(*(alone(low, w) for w in words)).alias("counts")))
    return let(counted, score)


def length_idf(words: list[str]) -> float:
    """A factor by mean word length, which stands in for rarity."""
    if not words:
        return 1.0
    mean = sum(map(len, words)) / len(words)
    return 1.15 if mean >= 8 else 1.05 if mean >= 6 else 1.0 if mean >= 4 else 0.95


def length_idf_column(mean: Column) -> Column:
    return F.when(mean >= 8, 1.15).when(mean >= 6, 1.05).when(mean >= 4, 1.0).otherwise(0.95)


def keyword_relevance(text: Column, words: list[str]) -> Column:
    """Lexical score with the length factor, and 0.3 of it for chunks below 50 characters; 0 for a null text."""
    text = F.coalesce(text, F.lit(""))
    boosted = F.least(F.lit(1.0), lexical_score(text, words) * length_idf(words))
    return boosted * F.when(F.length(text) < 50, 0.3).otherwise(1.0)


def simple_tokens(text: Column) -> Column:
    return F.expr("1").cast("int") * F.floor(F.length(text) / 4).cast("int")


def blended_tokens(text: Column) -> Column:
    """Characters over 4.1 or a blend with 0.75 tokens a word, whichever is more; 0 only for empty texts."""
    chars = F.length(text) / 4.1
    words = F.regexp_count(text, F.lit(r"\S+")) * 0.75
    estimate = F.greatest(chars, chars * 0.6 + words * 0.4)
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(120000), F.floor(estimate + 0.5)))).cast("int")


def char_counts(text: Column) -> Column:
    """Struct of how many characters the text has (n, carriage returns folded into line ends) and how many of each class.

    A class is counted by one pass that takes runs of it out. Select it as a column of its own and estimate from that column, so that
    no pass is repeated.
    """
    def counts(t: Column) -> Column:
        n = F.length(t)
        rest = lambda pattern: n - F.length(F.regexp_replace(t, pattern, ""))
        return F.struct(
            n.alias("n"), rest(r"\p{L}+").alias("letters"), rest(f"{CJK}+").alias("cjk"), rest("\n+").alias("lines"), rest(r"[ \t]+").alias("blanks"),
            rest(r"[.,;:!?'\"]+").alias("points"), rest(r"[#$%&()*+\-/0-9<=>@\[\\\]^_`{|}~]+").alias("symbols"),
        )

    plain = F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)
    return F.element_at(F.transform(F.array(plain), counts), 1)


def model_tokens(counts: Column, model: str = "DEFAULT") -> Column:
    """Characters over a ratio that falls for CJK, symbols, punctuation and line ends, from ``char_counts``."""
    base, n = CHARS_PER_TOKEN[model], counts["n"]
    share = lambda name: counts[name] / n
    cjk = share("cjk")
    ratio = F.when(cjk > 0.3, F.least(F.lit(base), F.lit(1.7))).when(cjk > 0.1, 1.7 + (base - 1.7) * (1.0 - (cjk - 0.1) / 0.2)).otherwise(base)
    if model == "CODEX":
        less = F.least(F.lit(0.10), share("symbols") * 0.5 + (1 - share("letters")) * 0.05)
    elif model == "CLAUDE":
        less = F.least(F.lit(0.05), share("points") * 0.5 + share("lines") * 0.5)
    else:
        less = F.least(F.lit(0.03), share("points") * 0.3 + share("lines") * 0.3 + share("blanks") * 0.05)
    ratio = F.greatest(F.lit(1.5), F.least(F.lit(8.0), ratio * (1.0 - less)))
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0).otherwise(F.ceil(n / ratio)).cast("int")


def glob_regex(glob: str) -> str:
    """A path glob as an anchored regular expression: ``**`` any path, ``*`` and ``?`` within a name."""
    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**", k):
            out, k = out + ".*", k + 2
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(glob[k], re.escape(glob[k]))
        k += 1
    return f"^{out}$"


def symbols_in(query: str) -> list[str]:
    """Qualified names, CamelCase words, snake_case words and called names, each once."""
    return list(dict.fromkeys(m for p in SYMBOL_PATTERNS for m in re.findall(p, query)))


def paths_in(query: str) -> list[str]:
    """Paths named in a query, each once."""
    return list(dict.fromkeys(re.findall(PATH_PATTERN, query)))


def file_names_in(query: str) -> list[str]:
    """Capitalised file names in a query, to be resolved as the end of a path."""
    return list(dict.fromkeys(re.findall(FILE_NAME_PATTERN, query)))


def path_column(text: Column) -> Column:
    """Paths named in each text, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(PATH_PATTERN), F.lit(0)))


def symbol_column(text: Column) -> Column:
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(int("([A" in p and k == 3))) for k, p in enumerate(SYMBOL_PATTERNS)]
    return F.array_distinct(F.concat(*found))


def scrubbed(text: Column) -> Column:
    for pattern, name in SECRET_PATTERNS:
        text = F.regexp_replace(text, pattern, name)
    return text


def human_size(n: Column) -> Column:
    """Bytes as B, KB, MB or GB with one decimal."""
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024**2, F.format_string("%.1f KB", n / 1024.0))
        .when(n < 1024**3, F.format_string("%.1f MB", n / 1024.0**2))
        .otherwise(F.format_string("%.1f GB", n / 1024.0**3))
    )
