"""Quality rules with adaptive thresholds from mergeable quantile sketches.

A sketch is a table of log-linear buckets: integers below 64 have a bucket each,
larger ones one bucket for each of 32 steps between powers of two (an error of
3 % at most). Sketches merge by adding counts, so those of a language are sums
of those of its sources. A group of language and source with fewer than
``min_group`` documents takes the sketch of its language, a small language that
of the corpus. A measure fails above q75 + ``fence`` * (q75 - q25) + a tolerance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.words import SPACE, let, words_of
from quillspark.session import bounded_broadcast, quoted, written

#: Measures (integers): name, the expression, and the tolerance above the fence.
MEASURES = {
    "symbol_pm": ("n_symbols * 1000 div greatest(word_chars, 1)", 20),
    "dup_line_pm": ("n_dup_lines * 1000 div greatest(n_text_lines, 1)", 400),
    "repeat_pm": ("n_repeat_words * 1000 div greatest(n_words, 1)", 200),
    "word_length": ("word_chars * 100 div greatest(n_words, 1)", 200),
}


#: The base measures and the verdict on them.
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_text_lines", "n_repeat_words", "base_failed")


def repeated_words(words: Column, window: int = 8) -> Column:
    """How many words lie in a ``window`` of words that the text has twice or more.

    Windows are compared by 64-bit hashes built by doubling. Only texts with a
    repeat sort their windows; all steps are n log n at most.
    """
    n = F.size(words)

    def doubled(grams: Column, step: int) -> Column:
        return F.zip_with(grams, F.slice(grams, step + 1, F.greatest(F.size(grams), F.lit(1))), lambda a, b: F.xxhash64(a, b))

    def measure(grams: Column) -> Column:
        def covered(s: Column) -> Column:
            same = lambda x, i: (x["g"] == F.get(s, i - 1)["g"]) | (x["g"] == F.get(s, i + 1)["g"])
            flagged = F.filter(s, lambda x, i: F.coalesce(same(x, i), F.lit(False)))
            return let(F.sort_array(F.transform(flagged, lambda x: x["i"])), spread)

        def spread(p: Column) -> Column:
            later = F.slice(p, 2, F.greatest(F.size(p), F.lit(1)))
            steps = F.zip_with(p, later, lambda a, b: F.coalesce(F.least(F.lit(window), b - a), F.lit(window)))
            return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

        pairs = F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(let(F.sort_array(pairs), covered))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    two = let(hashed, lambda g: doubled(g, 1))
    four = let(two, lambda g: doubled(g, 2))
    eight = let(four, lambda g: F.slice(doubled(g, 4), 1, F.greatest(F.size(g) - window + 1, F.lit(0))))
    return F.when(n < window + 1, 0).otherwise(let(eight, measure)).cast("long")


def with_features(docs: DataFrame) -> DataFrame:
    """``docs`` plus the base measures; input columns of the same names are replaced."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = docs.drop(*NAMES)
    out = kept.withColumn("__w", words_of(F.col("text"))).withColumn(
        "__l", F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    )
    return out.select(
        *map(quoted, kept.columns),
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size("__l").cast("long").alias("n_text_lines"),
        repeated_words(F.col("__w")).alias("n_repeat_words"),
    ).withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words"))


def bucket_of(v: Column) -> Column:
    """The sketch bucket of a non-negative integer."""
    shift = F.length(F.bin(v)) - 6
    return F.when(v < 64, v).otherwise(shift * 32 + F.call_function("shiftright", v, shift.cast("int")))


def bucket_top(b: Column) -> Column:
    """The smallest integer of a bucket."""
    shift = ((b - 32) / 32).cast("int")
    return F.when(b < 64, b).otherwise(F.call_function("shiftleft", b - shift * 32, shift))


def sketches(features: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): one sketch for each language, source and measure."""
    values = features.select(
        "lang", "source",
        F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.expr(e).cast("long").alias("v")) for k, (e, _) in MEASURES.items()])).alias("m"),
    )
    return values.groupBy("lang", "source", F.col("m.measure").alias("measure"), bucket_of(F.col("m.v")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def thresholds(sketch: DataFrame, fence: int = 3, min_group: int = 100) -> DataFrame:
    """(lang, source, t_<measure>...) for every group of the sketch table."""

    def limits(level: DataFrame, by: list[str]) -> DataFrame:
        keys = [*by, "measure"]
        summed = level.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
        run = summed.withColumn("c", F.sum("n").over(W.partitionBy(*keys).orderBy("bucket"))).withColumn("all", F.sum("n").over(W.partitionBy(*keys)))
        at = lambda q: F.min(F.when(F.col("c") * 100 >= F.col("all") * q, bucket_top(F.col("bucket"))))
        q = run.groupBy(*keys).agg(at(25).alias("q1"), at(75).alias("q3"), F.max("all").alias("all"))
        slack = F.create_map(*[F.lit(x) for k, (_, t) in MEASURES.items() for x in (k, t)])[F.col("measure")]
        return q.select(*keys, "all", (F.col("q3") + fence * (F.col("q3") - F.col("q1")) + slack).alias("t"))

    own, by_lang, whole = limits(sketch, ["lang", "source"]), limits(sketch, ["lang"]), limits(sketch, [])
    lang = by_lang.select(F.col("lang").alias("l2"), F.col("measure").alias("m2"), F.col("all").alias("n2"), F.col("t").alias("t2"))
    every = whole.select(F.col("measure").alias("m3"), F.col("t").alias("t3"))
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("l2")) & (F.col("measure") == F.col("m2"))).join(every, F.col("measure") == F.col("m3"))
    t = F.when(F.col("all") >= min_group, F.col("t")).when(F.col("n2") >= min_group, F.col("t2")).otherwise(F.col("t3"))
    picked = [F.max(F.when(F.col("measure") == k, F.col("tt"))).alias(f"t_{k}") for k in MEASURES]
    return joined.withColumn("tt", t).groupBy("lang", "source").agg(*picked)


def quality_rules(
    docs: DataFrame, fence: int = 3, min_group: int = 100, max_groups: int = 100_000, keep_text: bool = True
) -> DataFrame:
    """``docs`` plus the base measures, the thresholds ``t_<measure>`` of its group and ``kept``.

    Nulls in ``lang`` or ``source`` make groups of their own; a null text has no
    words and fails; texts may be of any length; rows that are repeated, and ties with a threshold, are judged alike: a measure fails above it; an empty table
    gives an empty result. Input columns with a result's name are replaced, others pass through; names that begin with two underscores are reserved. The
    measures are written once to the shared folder; the sketch and the filter read them from there, with the text only if
    ``keep_text``.
    """
    docs = docs.drop("kept", *(f"t_{k}" for k in MEASURES))
    measured = with_features(docs)
    features = written(measured if keep_text else measured.drop("text"), "quality-features")
    limits = written(thresholds(sketches(features), fence, min_group), "quality-limits")
    few = bounded_broadcast(limits.withColumnsRenamed({"lang": "__lang", "source": "__source"}), max_groups)
    joined = features.join(few, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    passes = F.lit(True)
    for k, (e, _) in MEASURES.items():
        passes = passes & (F.expr(e) <= F.col(f"t_{k}"))
    return joined.drop("__lang", "__source").withColumn("kept", ~F.col("base_failed") & passes)
