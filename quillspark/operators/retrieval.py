"""Ranked retrieval: providers, rank fusion, boosts, budgets, diversity and neighbours.

A provider gives hits with at least (provider, chunk_id, file_path, score,
tokens). Every order is total: score down, then path, then chunk_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import vectors as V
from quillspark.operators.catalog import numbered
from quillspark.session import written

# Type weights of symbols, and the chunk kind that a symbol stands for.
SYMBOL_WEIGHT = {"CLASS": 1.0, "INTERFACE": 1.0, "ENUM": 1.0, "METHOD": 0.85, "FUNCTION": 0.85, "PROPERTY": 0.75, "VARIABLE": 0.75, "CONSTANT": 0.75}
SYMBOL_KIND = {
    "CLASS": "CODE_CLASS", "INTERFACE": "CODE_INTERFACE", "ENUM": "CODE_ENUM", "METHOD": "CODE_METHOD", "FUNCTION": "CODE_FUNCTION",
    "CONSTRUCTOR": "CODE_CONSTRUCTOR", "PROPERTY": "CODE_BLOCK", "VARIABLE": "CODE_BLOCK", "FIELD": "CODE_BLOCK", "CONSTANT": "CODE_BLOCK",
}


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once for each row: filters on it stay above, as they cannot pass a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def by_rank() -> list[Column]:
    return [F.desc("score"), F.asc("file_path"), F.asc("chunk_id")]


def scope(paths=(), languages=(), kinds=(), exclude=(), path: str = "file_path", language: str = "language", kind: str = "kind") -> Column:
    """One scope filter for all providers: path prefixes, languages without case, kinds, globs to leave out."""
    keep = F.lit(True)
    if paths:
        starts = F.lit(False)
        for p in paths:
            starts = starts | F.col(path).startswith(p.strip())
        keep = keep & starts
    if languages:
        keep = keep & F.coalesce(F.lower(language).isin([x.lower() for x in languages]), F.lit(False))
    if kinds:
        keep = keep & F.col(kind).isin(list(kinds))
    for glob in exclude:
        keep = keep & ~F.col(path).rlike(T.glob_regex(glob))
    return keep


def keyword_match(words: list[str], *texts: str) -> Column:
    """Whether each word is in one of the texts, without case."""
    keep = F.lit(bool(words))
    for w in words:
        found = F.lit(False)
        for text in texts:
            found = found | F.coalesce(F.lower(text).contains(w), F.lit(False))
        keep = keep & found
    return keep


def full_text(chunks: DataFrame, files: DataFrame, query: str, where: Column | None = None, summary: bool = False) -> DataFrame:
    """Chunks that hold all keywords of the query, in their summary too if ``summary``, by the lexical score of their content."""
    words = T.keywords(query)
    found = chunks.filter(keyword_match(words, *(["content", "summary"] if summary else ["content"])))
    scored = once(found, "score", T.keyword_relevance(F.col("content"), words)).filter("score > 0")
    hits = scored.join(files.filter(~F.col("is_deleted")), "file_id").withColumn("file_path", F.col("abs_path"))
    return (hits.filter(where) if where is not None else hits).select(
        F.lit("full_text").alias("provider"), "chunk_id", "file_id", "ordinal", "file_path", "language", F.col("content").alias("text"), F.col("token_count").alias("tokens"), "score"
    )


def semantic(
    vectors: DataFrame, query: list[float], k: int = 64, least: float = 0.3, document_boost: float = 1.35, model: str | None = None, where: Column | None = None
) -> DataFrame:
    """The ``k`` rows of (chunk_id, vector, language) nearest to the query; documents get a boost, 0.99 at most.

    Vectors of another length, or of another ``model`` if one is named, are left out.
    """
    v = F.col("vector")
    close = vectors.filter(F.size(v) == len(query))
    for rule in ([F.col("model") == model] if model else []) + ([where] if where is not None else []):
        close = close.filter(rule)
    raw = once(close, "cosine", V.cosine(v, query))
    boosted = F.when(F.col("language") == "document", F.least(F.lit(0.99), F.col("cosine") * document_boost)).otherwise(F.col("cosine"))
    ranked = raw.withColumn("score", boosted).filter((F.col("score") >= least) & ~F.isnan("score")).drop("cosine")
    return ranked.orderBy(F.desc(F.round("score", 9)), "chunk_id").limit(k)


def symbol(symbols: DataFrame, query: str, where: Column | None = None) -> DataFrame:
    """Symbols that match every symbol of the query; scored by type, matches and exactness."""
    wanted = [s.lower() for s in T.symbols_in(query)]
    name, qualified = F.lower("name"), F.coalesce(F.lower("qualified_name"), F.lit(""))
    keep, matched, exact = F.lit(bool(wanted)), F.lit(0), F.lit(False)
    for s in wanted:
        keep = keep & ((name == s) | qualified.contains(s))
        matched = matched + F.when(name.contains(s) | qualified.contains(s), 1).otherwise(0)
        exact = exact | (name == s) | (qualified == s)
    weights = F.create_map(*[F.lit(x) for kv in SYMBOL_WEIGHT.items() for x in kv])
    weight = F.coalesce(F.try_element_at(weights, F.upper("symbol_type")), F.lit(0.6))
    score = weight * 0.7 + F.least(F.lit(5), matched) / 5.0 * 0.3 + F.when(exact, 0.15).otherwise(0.0)
    found = symbols.filter(keep)
    return (found.filter(where) if where is not None else found).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def symbol_kind(symbol_type: Column) -> Column:
    """The chunk kind that stands for a symbol type."""
    kinds = F.create_map(*[F.lit(x) for kv in SYMBOL_KIND.items() for x in kv])
    return F.coalesce(F.try_element_at(kinds, F.upper(symbol_type)), F.lit("CODE_BLOCK"))


def containing_chunks(symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """Symbols with the chunks of their file whose lines hold theirs: a hash join with a range left over."""
    s, c = symbols.alias("s"), chunks.alias("c")
    inside = (F.col("c.start_line") <= F.coalesce("s.start_line", "c.start_line")) & (F.col("c.end_line") >= F.coalesce("s.end_line", "c.end_line"))
    return s.join(c, (F.col("s.file_id") == F.col("c.file_id")) & inside, "left")


def fuse(hits: DataFrame, by: list[str] = (), k: int = 60, weights: dict[str, float] | None = None, limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of (provider, chunk_id, file_path, score): the sum of weight / (k + rank) over all hits of each provider.

    Ranks come from one sort by ranges, so no task holds a provider's hits. With a ``limit`` that the providers state themselves, every
    task keeps its own best ``limit`` of a provider, which are ranked in a window.
    """
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("provider") == name, w).otherwise(weight)
    if limit is not None:
        rank = F.row_number().over(W.partitionBy(*by, "provider").orderBy(*by_rank()))
        ranked = hits.withColumn("rank", rank).filter(F.col("rank") <= limit)
    else:
        few = [*by, "provider"]
        placed = numbered(hits.select(*few, "chunk_id", "file_path", "score"), [*(F.asc_nulls_first(c) for c in few), *by_rank()], "__k")
        first = F.broadcast(placed.groupBy(*few).agg(F.min("__k").alias("__first"))) if not by else placed.groupBy(*few).agg(F.min("__k").alias("__first"))  # a row for each provider
        ranked = placed.join(first, few).withColumn("rank", F.col("__k") - F.col("__first") + 1)
    return ranked.withColumn("part", weight / (k + F.col("rank"))).groupBy(*by, "chunk_id", "file_path").agg(
        F.sum("part").alias("score"), F.countDistinct("provider").alias("agreement"), F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("sources")
    )


def deduped(hits: DataFrame, *keep: str) -> DataFrame:
    """The best hit of each chunk with its columns ``keep``, and the names of all providers that found it."""
    best = F.max_by(F.struct("score", "tokens", *keep), F.struct("score", "provider"))
    return hits.groupBy("chunk_id", "file_path").agg(best.alias("b"), F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("sources")).select(
        "chunk_id", "file_path", F.col("b.score").alias("score"), F.col("b.tokens").alias("tokens"), *(F.col(f"b.{c}").alias(c) for c in keep), "sources"
    )


def boosted(score: Column, path: Column, language: Column, paths: dict[str, float], languages: dict[str, float]) -> Column:
    """Score times the factor of the longest matching part of the path and that of the language, from 0 to 1."""
    factor = F.lit(1.0)
    for part in sorted(paths, key=lambda p: (len(p), p)):  # the last when is tried first
        factor = F.when(path.contains(part), paths[part]).otherwise(factor)
    by_language = F.lit(1.0)
    for name, f in languages.items():
        by_language = F.when(F.lower(language) == name.lower(), f).otherwise(by_language)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score * factor * by_language))


def budget_prefix(hits: DataFrame, limit: int | Column, by: list[str], order: list[Column]) -> DataFrame:
    """Hits in order up to the first that would exceed the token limit."""
    total = F.sum("tokens").over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return hits.withColumn("used", total).filter(F.col("used") <= limit)


def within_budget(snippets: DataFrame, limit: int) -> DataFrame:
    """The best snippets (score, file_path, chunk_id, tokens, ...) up to the first that would exceed ``limit`` tokens; each has one token or more, so ``limit`` rows are enough."""
    return budget_prefix(snippets.orderBy(*by_rank()).limit(limit), limit, [F.lit(0)], by_rank())


def context_xml(snippets: DataFrame) -> DataFrame:
    """(file_path, xml): the snippets of each file as an element, the best first."""
    text = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    lines = F.concat_ws("-", F.col("start_line").cast("string"), F.coalesce("end_line", "start_line").cast("string"))
    one = F.concat(
        F.lit('<snippet label="'), text(F.coalesce("label", F.lit(""))), F.lit('" kind="'), "kind", F.lit('" score="'), F.format_string("%.3f", "score"), F.lit('" lines="'), lines,
        F.lit('" token_estimate="'), F.col("tokens").cast("string"), F.lit('"><content><![CDATA['), F.replace("text", F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]></content></snippet>"),
    )
    files = snippets.groupBy("file_path").agg(F.min("language").alias("language"), F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "chunk_id", one.alias("x")))).alias("all"))
    language = F.when(F.coalesce("language", F.lit("")) != "", F.concat(F.lit(' language="'), text(F.col("language")), F.lit('"'))).otherwise("")
    return files.select("file_path", F.concat(F.lit('<file path="'), text(F.col("file_path")), F.lit('"'), language, F.lit(">"), F.array_join("all.x", ""), F.lit("</file>")).alias("xml"))


def context_statistics(snippets: DataFrame) -> DataFrame:
    """One row: snippets, files, tokens and bytes of text."""
    return snippets.agg(F.count(F.lit(1)).alias("snippets"), F.countDistinct("file_path").alias("files"), F.sum("tokens").alias("tokens"), F.sum(F.octet_length("text")).alias("bytes"))


def budget_greedy(hits: DataFrame, limit: int, by: list[str], order: list[str]) -> DataFrame:
    """Hits in order, leaving out those that do not fit and going on: a fold over the sorted group.

    The group is one query's hits, bounded by the providers' k. The fold carries the tokens used and a mark for each hit.
    """
    folded = hits.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order, "tokens"))).alias("all"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["tokens"] <= limit
        return F.struct(
            (acc["used"] + F.when(fits, x["tokens"]).otherwise(0)).cast("long").alias("used"), F.concat(acc["marks"], F.when(fits, "1").otherwise("0")).alias("marks")
        )

    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit("").alias("marks"))
    marked = folded.select(*by, "all", F.aggregate("all", start, step)["marks"].alias("marks"))
    kept = F.filter("all", lambda x, i: F.substring(F.col("marks"), i + 1, F.lit(1)) == "1")
    return marked.select(*by, F.explode(kept).alias("x")).select(*by, "x.*")


def mmr(hits: DataFrame, by: str, k: int, weight: float, budget: int) -> DataFrame:
    """Maximal marginal relevance over (by, chunk_id, score, tokens, vector), at most ``k`` for each group.

    The first is the best that fits; each next one has the largest weight * score - (1 - weight) * (largest dot product to those chosen), to nine
    decimals, ties by score and chunk_id. A group is one query's candidates, bounded by the providers' limits: a table of their dot products, and a fold that
    keeps for each candidate its largest product to those chosen.
    """
    norm = F.greatest(F.sqrt(V.squared_norm(F.col("vector"))), F.lit(1e-12))
    one = hits.withColumn("__norm", norm).select(
        by, F.struct((-F.col("score")).alias("s"), "chunk_id", "score", F.col("tokens").cast("long").alias("tokens"), F.transform("vector", lambda x: x.cast("double") / F.col("__norm")).alias("u")).alias("x")
    )
    groups = one.groupBy(by).agg(F.sort_array(F.collect_list("x")).alias("all"))
    alike = F.transform("all", lambda a: F.transform("all", lambda b: V.dot(a["u"], b["u"])))
    table = groups.select(by, F.transform("all", lambda x: x.dropFields("u", "s")).alias("rows"), F.explode(F.array(alike)).alias("alike"))

    def step(state: Column, _: Column) -> Column:
        def value(x: Column, i: Column) -> Column:
            marginal = F.when(F.size(state["chosen"]) == 0, x["score"]).otherwise(weight * x["score"] - (1 - weight) * F.get(state["near"], i))
            free = ~F.array_contains(state["chosen"], i) & (state["used"] + x["tokens"] <= budget)
            return F.when(free, F.struct(F.round(marginal, 9).alias("value"), x["score"].alias("score"), (-i).alias("back")))

        def taken(best: Column) -> Column:
            at = -best["back"]
            return F.when(best.isNull(), state).otherwise(
                F.struct(
                    F.array_append(state["chosen"], at).alias("chosen"), (state["used"] + F.get(F.col("rows"), at)["tokens"]).alias("used"),
                    F.zip_with(state["near"], F.get(F.col("alike"), at), lambda a, b: F.greatest(a, b)).alias("near"),
                )
            )

        return T.let(F.array_max(F.transform("rows", value)), taken)

    start = F.struct(F.array().cast("array<int>").alias("chosen"), F.lit(0).cast("long").alias("used"), F.transform("rows", lambda x: F.lit(float("-inf"))).alias("near"))
    chosen = table.select(by, "rows", F.aggregate(F.sequence(F.lit(1), F.lit(k)), start, step)["chosen"].alias("chosen"))
    each = chosen.select(by, "rows", F.posexplode("chosen").alias("rank", "at"))
    return each.select(by, F.get(F.col("rows"), F.col("at")).alias("x"), (F.col("rank") + 1).cast("long").alias("rank")).select(by, "x.chunk_id", "x.score", "rank")


def neighbours(hits: DataFrame, chunks: DataFrame, width: int = 1, factor: float = 0.5) -> DataFrame:
    """Hits and the chunks within ``width`` ordinals of one in its file, at ``factor`` of its score.

    A hit stays a hit; a neighbour of several takes the best score.
    """
    around = F.explode(F.sequence(F.col("ordinal") - width, F.col("ordinal") + width))
    near = hits.select("file_id", around.alias("o"), F.col("score").alias("s"), F.col("ordinal").alias("own"))
    best = near.groupBy("file_id", F.col("o").alias("ordinal")).agg(
        F.max(F.when(F.col("o") == F.col("own"), F.col("s"))).alias("hit"), F.max(F.col("s") * factor).alias("beside")
    )
    return best.join(chunks, ["file_id", "ordinal"]).select(
        "file_id", "ordinal", "chunk_id", F.coalesce("hit", "beside").alias("score"), F.col("hit").isNotNull().alias("is_hit")
    )


#: Files of a commit that meet as many others in one task.
TILE = 1000


def co_changes(changes: DataFrame, least: int = 2) -> DataFrame:
    """(file, other, n): files that at least ``least`` commits of (commit, file) change together, both ways round.

    Files in fewer than ``least`` commits go first. With ``least`` above 1 a pair shares more than one commit, so it shares one that is not the largest commit
    of either file: each file leaves its largest out when pairs are made, and it is looked up for the pairs that were made. A commit of many files is dealt in tiles
    of pairs. Nulls are in no pair; repeated rows count once.
    """
    rows = changes.filter("commit IS NOT NULL AND file IS NOT NULL").select("commit", "file").distinct()
    often = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("file")
    kept = rows.join(often, "file", "left_semi")
    sized = kept.groupBy("commit").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    live = written(kept.join(sized, "commit"), "co-changes")
    made, largest = live, None
    if least > 1:
        largest = live.groupBy("file").agg(F.max(F.struct("size", "commit")).alias("top")).select("file", F.col("top.commit").alias("left_out"))  # a row for each file
        made = live.join(largest, "file").filter(F.col("commit") != F.col("left_out"))
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    tile = F.pmod(F.xxhash64("file"), tiles).cast("int")
    every = F.sequence(F.lit(0), tiles - 1)
    one = made.select("commit", F.col("file").alias("a"), tile.alias("x"), F.explode(every).alias("y"))
    two = made.select("commit", F.col("file").alias("b"), F.explode(every).alias("x"), tile.alias("y"))
    pairs = one.join(two, ["commit", "x", "y"]).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    if largest is not None:
        out = lambda c: largest.select(F.col("file").alias(c), F.col("left_out").alias(f"out_{c}"))
        has = lambda c, o: live.select(F.col("commit").alias(f"out_{c}"), F.col("file").alias(o), F.lit(1).alias(f"has_{o}"))
        known = pairs.join(out("a"), "a").join(out("b"), "b")
        met = known.join(has("a", "b"), ["out_a", "b"], "left").join(has("b", "a"), ["out_b", "a"], "left")
        once_more = F.coalesce("has_b", F.lit(0)) + F.when(F.col("out_a") != F.col("out_b"), F.coalesce("has_a", F.lit(0))).otherwise(0)
        pairs = met.select("a", "b", (F.col("n") + once_more).alias("n"))
    ways = F.array(F.struct(F.col("a").alias("file"), F.col("b").alias("other")), F.struct(F.col("b").alias("file"), F.col("a").alias("other")))
    return pairs.filter(F.col("n") >= least).select(F.explode(ways).alias("p"), "n").select("p.file", "p.other", "n")


def co_changed_with(changes: DataFrame, paths: DataFrame, recent: int = 20, least: int = 2) -> DataFrame:
    """(file, other, n) for the files of ``paths`` (a bounded set): those in ``least`` of each one's ``recent`` commits (commit, at, file)."""
    newest = F.row_number().over(W.partitionBy("file").orderBy(F.desc("at"), F.desc("commit")))
    mine = changes.join(F.broadcast(paths.select("file").distinct()), "file", "left_semi").withColumn("k", newest).filter(F.col("k") <= recent)
    few = F.broadcast(mine.select("commit", F.col("file").alias("of")))  # ``recent`` commits for each path
    met = changes.join(few, "commit").filter(F.col("file") != F.col("of")).groupBy(F.col("of").alias("file"), F.col("file").alias("other"))
    return met.agg(F.countDistinct("commit").alias("n")).filter(F.col("n") >= least)
