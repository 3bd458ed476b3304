"""Context queries: providers by name, one scope for all, and what is done with their hits.

A corpus has chunks (chunk_id, file_id, ordinal, kind, summary, content, token_count, start_line, end_line), files (file_id, abs_path,
language, is_deleted), vectors (chunk_id, vector, model), symbols and commits (commit, at, file_id). A provider takes a corpus and
a request and gives hits (provider, chunk_id, file_path, score, tokens, file_id, ordinal), ``limit`` at most, so that all that comes after works on
few rows, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import retrieval as R
from quillspark.operators import terms as TT


@dataclass
class Scope:
    paths: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()

    def column(self, kinds: bool = True) -> Column:
        return R.scope(self.paths, self.languages, self.kinds if kinds else (), self.exclude)


@dataclass
class Corpus:
    chunks: DataFrame
    files: DataFrame
    vectors: DataFrame | None = None
    symbols: DataFrame | None = None
    commits: DataFrame | None = None
    terms: TT.TermTable | None = None  # with it, full text reads postings and not all texts

    def located(self, chunks: DataFrame | None = None) -> DataFrame:
        """Chunks with the path and language of their live files."""
        live = self.files.filter(~F.col("is_deleted")).select("file_id", F.col("abs_path").alias("file_path"), "language")
        return (self.chunks if chunks is None else chunks).join(live, "file_id")


@dataclass
class Request:
    query: str
    vector: list[float] | None = None
    scope: Scope = field(default_factory=Scope)
    providers: tuple[str, ...] = ("semantic", "symbol", "full_text", "git_history")
    k: int = 10
    max_tokens: int = 4000
    limit: int = 64
    least: float = 0.3
    path_boosts: dict[str, float] = field(default_factory=dict)
    language_boosts: dict[str, float] = field(default_factory=dict)
    window: int = 0
    diversity: float | None = None


#: name -> provider; ``register`` adds to it.
PROVIDERS: dict[str, Callable[[Corpus, Request], DataFrame]] = {}
HIT = ("provider", "chunk_id", "file_path", "score", "tokens", "file_id", "ordinal")


def register(name: str):
    def add(body):
        PROVIDERS[name] = body
        return body

    return add


def _hits(df: DataFrame, name: str, limit: int, order: list[Column] | None = None) -> DataFrame:
    """``limit`` hits of a provider in their order; the score to nine decimals, so that sums in another order rank alike."""
    rounded = df.withColumn("score", F.round("score", 9)).withColumn("tokens", F.col("tokens").cast("long")).withColumn("provider", F.lit(name))
    return rounded.orderBy(*(order or R.by_rank())).limit(limit).select(*HIT)


@register("full_text")
def full_text(corpus: Corpus, request: Request) -> DataFrame:
    if corpus.terms is not None:
        return _hits(TT.full_text(corpus.terms, corpus.files, request.query, request.scope.column(kinds=False), summary=True, kinds=request.scope.kinds), "full_text", request.limit)
    found = R.full_text(corpus.chunks.filter(F.col("kind").isin(list(request.scope.kinds)) if request.scope.kinds else F.lit(True)), corpus.files, request.query, summary=True)
    return _hits(found.filter(request.scope.column(kinds=False)), "full_text", request.limit)


@register("semantic")
def semantic(corpus: Corpus, request: Request) -> DataFrame:
    owned = corpus.vectors.join(corpus.located().drop("content", "summary"), "chunk_id").withColumn("tokens", F.col("token_count"))
    return _hits(R.semantic(owned, request.vector, k=request.limit, least=0.0, where=request.scope.column()), "semantic", request.limit)


@register("symbol")
def symbol(corpus: Corpus, request: Request) -> DataFrame:
    """Symbols and the chunks that hold them; a symbol without lines stands for its file's first chunk. Kinds do not restrict."""
    paths = corpus.files.select("file_id", F.col("abs_path").alias("file_path"), "is_deleted").filter(~F.col("is_deleted")).drop("is_deleted")
    found = R.symbol(corpus.symbols.join(paths, "file_id"), request.query, request.scope.column(kinds=False))
    best = found.orderBy(F.desc("score"), "file_path", "symbol_id").limit(request.limit).withColumnRenamed("start_line", "s0").withColumnRenamed("end_line", "s1")
    inside = F.when(F.col("s0").isNull(), F.col("ordinal") == 0).otherwise((F.col("start_line") <= F.col("s0")) & (F.col("end_line") >= F.coalesce("s1", "s0")))
    few = F.broadcast(best.select("file_id", "file_path", "score", "s0", "s1"))  # ``limit`` rows
    held = corpus.chunks.join(few, "file_id").filter(inside).withColumn("tokens", F.col("token_count"))
    shortest = [F.desc("score"), F.asc("tokens"), F.asc(F.lower("summary")), F.asc("file_path"), F.asc("chunk_id")]
    return _hits(held, "symbol", request.limit, shortest)


def named_files(files: DataFrame, query: str, paths: tuple[str, ...] = ()) -> DataFrame:
    """Live files that a query names by path, or by the end of their path, and those of scope paths."""
    whole, names = [*paths, *T.paths_in(query)], T.file_names_in(query)
    hit = F.lit(False)
    for p in whole:
        hit = hit | (F.col("abs_path") == p)
    for n in names:
        hit = hit | F.col("abs_path").endswith(n)
    return files.filter(~F.col("is_deleted") & hit)


@register("git_history")
def git_history(corpus: Corpus, request: Request, recent: int = 10, others: int = 5) -> DataFrame:
    """First chunks of the files that the query names, by the age of their commits, and of files that often change with them."""
    named = named_files(corpus.files, request.query, request.scope.paths).select("file_id").limit(request.limit)
    log = corpus.commits.withColumnRenamed("file_id", "file")
    paths = F.broadcast(named.select(F.col("file_id").alias("file")))  # ``limit`` rows
    one = W.partitionBy("file")
    mine = log.join(paths, "file", "left_semi").withColumn("k", F.row_number().over(one.orderBy(F.desc("at"), F.desc("commit")))).filter(F.col("k") <= recent)
    aged = mine.withColumn("n", F.count(F.lit(1)).over(one)).select(F.col("file").alias("file_id"), (1.0 - (F.col("k") - 1) / (F.col("n") * 2.0)).alias("score"))
    beside = R.co_changed_with(log, paths, recent * 2).withColumn("k", F.row_number().over(one.orderBy(F.desc("n"), "other"))).filter(F.col("k") <= others)
    candidates = aged.unionByName(beside.select(F.col("other").alias("file_id"), F.lit(0.7).alias("score")))
    best = F.broadcast(candidates.groupBy("file_id").agg(F.max("score").alias("score")))  # ``limit`` files and their ``others``
    first = corpus.located(corpus.chunks.filter("ordinal = 0").join(best, "file_id")).withColumn("tokens", F.col("token_count"))
    return _hits(first.filter(request.scope.column(kinds=False)), "git_history", request.limit)


@register("hybrid")
def hybrid(corpus: Corpus, request: Request, over: tuple[str, ...] = ("semantic", "symbol", "full_text", "git_history")) -> DataFrame:
    """The other providers' hits by reciprocal rank fusion."""
    hits = gathered(corpus, request, over)
    place = hits.groupBy("chunk_id").agg(F.max("tokens").alias("tokens"), F.max("file_id").alias("file_id"), F.max("ordinal").alias("ordinal"))
    return _hits(R.fuse(hits, limit=request.limit).join(place, "chunk_id"), "hybrid", request.limit)


def gathered(corpus: Corpus, request: Request, names: tuple[str, ...] | None = None) -> DataFrame:
    """The hits of all providers of the request; unknown names are an error."""
    out = None
    for name in names or request.providers:
        if name not in PROVIDERS:
            raise KeyError(f"no provider {name}; there are {sorted(PROVIDERS)}")
        hits = PROVIDERS[name](corpus, request)
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        raise ValueError("a request needs a provider")
    return out


def optimised(corpus: Corpus, hits: DataFrame, request: Request) -> DataFrame:
    """The ``k`` most relevant and diverse hits, at least 0.3 in score; hits without a vector are like none."""
    top = hits.filter("score >= 0.3").orderBy(*R.by_rank()).limit(request.k)
    vectors = corpus.vectors.select("chunk_id", "vector").join(F.broadcast(top.select("chunk_id")), "chunk_id")
    own = top.join(vectors, "chunk_id", "left").withColumn("query", F.lit("q"))
    blank = F.array_repeat(F.lit(0.0), len(request.vector))
    chosen = R.mmr(own.withColumn("vector", F.coalesce(F.col("vector").cast("array<double>"), blank)), "query", request.k, request.diversity, request.max_tokens)
    return top.join(F.broadcast(chosen.select("chunk_id", "rank")), "chunk_id")


def snippets(corpus: Corpus, hits: DataFrame, window: int = 0, factor: float = 0.5) -> DataFrame:
    """Hits, and neighbours within ``window`` chunks at ``factor`` of the best hit's score, with their chunk's text, label, kind and lines."""
    around = F.explode(F.sequence(F.col("ordinal") - window, F.col("ordinal") + window))
    near = hits.select("file_id", "sources", "score", F.col("ordinal").alias("own"), around.alias("ordinal"))
    is_hit = F.col("own") == F.col("ordinal")
    best = near.groupBy("file_id", "ordinal").agg(
        F.max(F.when(is_hit, F.col("score"))).alias("hit"), F.max(F.when(is_hit, F.col("sources"))).alias("sources"), F.max(F.col("score") * factor).alias("beside")
    )
    met = corpus.located(corpus.chunks.join(F.broadcast(best), ["file_id", "ordinal"]))  # the hits and 2 * window for each
    return met.select(
        "chunk_id", F.round(F.coalesce("hit", "beside"), 9).alias("score"), "file_path", F.col("summary").alias("label"), "kind", F.col("content").alias("text"), "language",
        "start_line", F.coalesce("end_line", "start_line").alias("end_line"), "ordinal", F.coalesce("token_count", F.floor(F.length("content") / 4)).cast("long").alias("tokens"),
        F.coalesce("sources", F.lit("")).alias("sources"), F.col("hit").isNotNull().alias("is_hit"),
    )


def query_context(corpus: Corpus, request: Request) -> DataFrame:
    """Snippets of all providers: best hit of each chunk, boosts, threshold, diversity, neighbours, token budget, k.

    With neighbours the order is that of the documents, else that of the scores; the budget stops at the first snippet that does not fit.
    """
    if not request.query.strip():
        raise ValueError("a request needs a query")
    best = R.deduped(gathered(corpus, request), "file_id", "ordinal")
    languages = corpus.files.select("file_id", F.col("language").alias("of"))
    known = languages.join(F.broadcast(best), "file_id")  # the providers' limits
    score = R.boosted(F.col("score"), F.col("file_path"), F.col("of"), request.path_boosts, request.language_boosts)
    kept = known.withColumn("score", F.round(score, 9)).drop("of").filter(F.col("score") >= request.least)
    if request.diversity is not None:
        kept = optimised(corpus, kept, request)
    found = snippets(corpus, kept, request.window)
    order = [F.asc("file_path"), F.asc("ordinal")] if request.window else R.by_rank()
    everything = W.partitionBy(F.lit(0)).orderBy(*order)
    ranked = found.withColumn("rank", F.row_number().over(everything)).withColumn("used", F.sum("tokens").over(everything.rowsBetween(W.unboundedPreceding, 0)))
    return ranked.filter((F.col("used") <= request.max_tokens) & (F.col("rank") <= request.k))
