"""Queries of the retrieval half."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import vectors as V
from quillspark.operators import cells as CT
from quillspark.operators import context as X
from quillspark.operators import retrieval as R
from quillspark.operators import terms as TT
from quillspark.plans.registry import Registry, Tables
from quillspark.sources import corpus as C

REGISTRY = Registry()
add = REGISTRY.add

ASKED = T.keywords("this is the thing")

_Q = "(SELECT list_transform(embedding, lambda x: x::DOUBLE) FROM embeddings WHERE vec_id = 0)"
_COS = f"list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), {_Q})"


def _query_vector(t: Tables) -> list[float]:
    return [float(x) for x in t.embeddings.filter("vec_id = 0").select("embedding").first()[0]]


@add("semantic_topk", f"""
WITH s AS (SELECT vec_id, label, {_COS} AS c FROM embeddings),
top AS (SELECT vec_id AS chunk_id, label, round(c, 6) AS score FROM s WHERE c >= 0.3 ORDER BY round(c, 9) DESC, vec_id LIMIT 10)
SELECT chunk_id, label, score FROM top""")
def semantic_topk(t):
    v = t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label", F.lit("vector").alias("language"))
    return R.semantic(v, _query_vector(t), k=10).select("chunk_id", "label", F.round("score", 6).alias("score"))


@add("semantic_filtered", f"""
WITH s AS (SELECT vec_id, label, CASE WHEN label % 2 = 0 THEN least(0.99, {_COS} * 1.35) ELSE {_COS} END AS c FROM embeddings WHERE label IN (0, 1, 2, 3))
SELECT vec_id AS chunk_id, round(c, 6) AS score FROM s WHERE c >= 0.2 ORDER BY round(c, 9) DESC, vec_id LIMIT 20""")
def semantic_filtered(t):
    v = t.embeddings.filter("label IN (0, 1, 2, 3)").select(
        F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.when(F.col("label") % 2 == 0, "document").otherwise("code").alias("language")
    )
    return R.semantic(v, _query_vector(t), k=20, least=0.2).select("chunk_id", F.round("score", 6).alias("score"))


@add("semantic_cells", f"""
WITH s AS (SELECT vec_id, CASE WHEN label % 2 = 0 THEN least(0.99, {_COS} * 1.35) ELSE {_COS} END AS c FROM embeddings)
SELECT vec_id AS chunk_id, round(c, 6) AS score FROM s WHERE c >= 0.3 ORDER BY round(c, 9) DESC, vec_id LIMIT 64""")
def semantic_cells(t):
    """The scan's result from the cells that can hold it."""
    table = _cells(t.embeddings)
    return CT.semantic(table, _query_vector(t), k=64).select("chunk_id", F.round("score", 6).alias("score"))


def _cells(embeddings):
    v = embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.when(F.col("label") % 2 == 0, "document").otherwise("code").alias("language"))
    return CT.build_cells(v, 64)


@add("nearest_vectors", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_cosine_similarity(q.e, v.e) AS c FROM v q, v WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, chunk_id) AS rank FROM s)
SELECT query_id, chunk_id, rank::INT AS rank, round(c, 6) AS cosine FROM r WHERE rank <= 10""")
def nearest_vectors(t):
    """The ten nearest vectors of every twentieth one, among all."""
    asked = t.embeddings.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return CT.nearest(_cells(t.embeddings), asked, 10).select("query_id", "chunk_id", "rank", F.round("cosine", 6).alias("cosine"))


@add("vector_norms", """
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings""")
def vector_norms(t):
    return t.embeddings.select("vec_id", F.round(F.sqrt(V.squared_norm(F.col("embedding"))), 6).alias("norm"))


@add("vector_unit_check", """
SELECT vec_id, abs(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) - 1) < 1e-4 AS is_unit FROM embeddings""")
def vector_unit_check(t):
    return t.embeddings.select("vec_id", V.is_unit(F.col("embedding")).alias("is_unit"))


@add("vector_normalised", """
WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS l FROM embeddings)
SELECT vec_id, round(embedding[1]::DOUBLE / l, 6) AS first, round(embedding[64]::DOUBLE / l, 6) AS last FROM n""")
def vector_normalised(t):
    unit = t.embeddings.select("vec_id", V.normalised(F.col("embedding")).alias("u"))
    return unit.select("vec_id", F.round(F.get("u", F.lit(0)), 6).alias("first"), F.round(F.get("u", F.lit(63)), 6).alias("last"))


@add("embedding_join_meta", f"""
WITH {C.FILES_SQL} SELECT e.vec_id AS embedding_id, len(e.embedding)::INT AS dimensions, f.abs_path, f.language
FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id JOIN files f ON f.file_id = d.doc_id""")
def embedding_join_meta(t):
    e = t.embeddings.select(F.col("vec_id").alias("embedding_id"), F.col("vec_id").alias("doc_id"), F.size("embedding").alias("dimensions"))
    return e.join(t.documents.select("doc_id"), "doc_id").join(C.files(t.documents).withColumnRenamed("file_id", "doc_id"), "doc_id").select("embedding_id", "dimensions", "abs_path", "language")


@add("scope_scan", f"""
WITH {C.FILES_SQL} SELECT file_id, abs_path FROM files
WHERE lower(language) IN ('de', 'fr') AND NOT regexp_matches(abs_path, '^src1/.*$') AND NOT regexp_matches(abs_path, '^.*/[^/]*5\\.txt$') AND NOT is_deleted
ORDER BY abs_path""")
def scope_scan(t):
    keep = R.scope(languages=("DE", "fr"), exclude=("src1/**", "**/*5.txt"), path="abs_path")
    return C.files(t.documents).filter(keep & ~F.col("is_deleted")).select("file_id", "abs_path").orderBy("abs_path")


@add("scope_prefix", f"""
WITH {C.FILES_SQL} SELECT file_id, abs_path, language FROM files WHERE starts_with(abs_path, 'src1/en') OR starts_with(abs_path, 'src2/')""")
def scope_prefix(t):
    return C.files(t.documents).filter(R.scope(paths=("src1/en", "src2/"), path="abs_path")).select("file_id", "abs_path", "language")


@add("file_lookup", f"""
WITH {C.FILES_SQL} SELECT file_id, abs_path, size_bytes FROM files WHERE abs_path LIKE '%/7.txt' OR file_id IN (3, 5) ORDER BY abs_path""")
def file_lookup(t):
    return C.files(t.documents).filter(F.col("abs_path").endswith("/7.txt") | F.col("file_id").isin(3, 5)).select("file_id", "abs_path", "size_bytes").orderBy("abs_path")


@add("chunk_lookup", f"""
WITH {C.CHUNKS_SQL} SELECT chunk_id, file_id, ordinal, token_count FROM chunks WHERE file_id IN (1, 2, 3) ORDER BY file_id, ordinal""")
def chunk_lookup(t):
    return C.chunks(t.spread("documents").filter("doc_id IN (1, 2, 3)")).select("chunk_id", "file_id", "ordinal", "token_count").orderBy("file_id", "ordinal")


@add("first_chunk_of_file", f"""
WITH {C.CHUNKS_SQL} SELECT file_id, arg_min(chunk_id, ordinal) AS chunk_id, arg_min(content, ordinal) AS content FROM chunks GROUP BY file_id""")
def first_chunk_of_file(t):
    return C.chunks(t.spread("documents")).groupBy("file_id").agg(F.min_by("chunk_id", "ordinal").alias("chunk_id"), F.min_by("content", "ordinal").alias("content"))


@add("keyword_and", f"""
WITH {C.CHUNKS_SQL} SELECT chunk_id FROM chunks WHERE """ + " AND ".join(f"contains(lower(content), '{w}')" for w in ASKED))
def keyword_and(t):
    return C.chunks(t.spread("documents")).filter(T.contains_all(F.col("content"), ASKED)).select("chunk_id")


def _lexical_sql(words: list[str], content: str = "content") -> str:
    """The score's tiers over a subquery ``base`` with columns chunk_id, low, length and padded."""
    n = {w: f"((length(pad) - length(replace(pad, ' {w} ', ''))) // {len(w) + 2})" for w in words}
    total = " + ".join(n.values())
    steps, at = [], "1"
    oks = []
    for k, w in enumerate(words):
        p = f"p{k}"
        steps.append(f"CASE WHEN {at} > length(low) THEN 0 WHEN strpos(substr(low, {at}), '{w}') = 0 THEN 0 ELSE strpos(substr(low, {at}), '{w}') + {at} - 1 END AS {p}")
        oks.append(f"{p} > 0 AND NOT ({p} > 1 AND regexp_matches(substr(low, greatest({p} - 1, 1), 1), '[\\p{{L}}\\p{{Nd}}]')) AND NOT regexp_matches(substr(low, {p} + {len(w)}, 1), '[\\p{{L}}\\p{{Nd}}]')")
        at = f"({p} + {len(w)})"
    lateral = "base"
    for s in steps:
        lateral = f"(SELECT *, {s} FROM {lateral})"
    ok = " AND ".join(oks)
    idf = T.length_idf(words)
    every = " AND ".join(f"{x} > 0" for x in n.values())
    score = f"CASE WHEN {ok} AND {at} - p0 <= 50 THEN 0.95 WHEN {total} = 0 THEN 0.0 WHEN {every} THEN 0.7 ELSE least(0.5, ({total}) / {2.0 * len(words)}) END"
    return f"""(SELECT *, CASE WHEN length(low) < 50 THEN least(1.0, lex * {idf}::DOUBLE) * 0.3::DOUBLE ELSE least(1.0, lex * {idf}::DOUBLE) END AS score
      FROM (SELECT *, ({score})::DOUBLE AS lex FROM {lateral}))"""


_BASE_SQL = r"""base AS (SELECT chunk_id, file_id, ordinal, token_count, content, summary, lower(content) AS low,
  '  ' || regexp_replace(lower(content), '[^\p{L}\p{Nd}]', '  ', 'g') || '  ' AS pad FROM chunks)"""


@add("lexical_score", f"""WITH {C.CHUNKS_SQL}, {_BASE_SQL} SELECT chunk_id, round(score, 6) AS score FROM {_lexical_sql(ASKED)} WHERE score > 0""")
def lexical_score(t):
    scored = C.chunks(t.spread("documents")).select("chunk_id", T.keyword_relevance(F.col("content"), ASKED).alias("score"))
    return scored.filter("score > 0").select("chunk_id", F.round("score", 6).alias("score"))


_FULLTEXT_SQL = f"""{C.CHUNKS_SQL}, {C.FILES_SQL}, {_BASE_SQL}, ft AS (
  SELECT 'full_text' AS provider, x.chunk_id, x.file_id, x.ordinal, abs_path AS file_path, language, token_count AS tokens, score
  FROM {_lexical_sql(["this", "of"][:1] + ["ing"])} x JOIN files USING (file_id) WHERE contains(low, 'this') AND contains(low, 'ing') AND score > 0 AND NOT is_deleted)"""


def _terms(t) -> TT.TermTable:
    """Stored chunks, postings and terms of the documents; made once for each state of the table."""
    return TT.terms_of_table(t.documents, f"{t.folder}/documents", C.chunks)


def _full_text(t):
    return R.full_text(C.chunks(t.spread("documents")), C.files(t.documents), "this ing")


@add("fulltext_topk", f"""WITH {_FULLTEXT_SQL} SELECT chunk_id, file_path, round(score, 6) AS score FROM ft ORDER BY score DESC, file_path, chunk_id LIMIT 50""")
def fulltext_topk(t):
    return _full_text(t).orderBy(*R.by_rank()).limit(50).select("chunk_id", "file_path", F.round("score", 6).alias("score"))


@add("fulltext_indexed", f"""WITH {_FULLTEXT_SQL} SELECT chunk_id, file_path, round(score, 6) AS score FROM ft ORDER BY score DESC, file_path, chunk_id LIMIT 50""")
def fulltext_indexed(t):
    """The same by the term table: postings are read, and no text."""
    return TT.full_text(_terms(t), C.files(t.documents), "this ing").orderBy(*R.by_rank()).limit(50).select("chunk_id", "file_path", F.round("score", 6).alias("score"))


@add("length_idf", r"""
WITH k AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\W+'),
  lambda w: length(w) >= 2 AND w NOT IN ('a','an','and','are','as','at','be','by','for','from','has','in','is','it','of','on','or','that','the','to','was','will','with'))) AS ks FROM benchmark),
m AS (SELECT item_id, len(ks) AS n, list_avg(list_transform(ks, lambda x: length(x))) AS mean FROM k)
SELECT item_id, n::INT AS n, CASE WHEN mean >= 8 THEN 1.15 WHEN mean >= 6 THEN 1.05 WHEN mean >= 4 THEN 1.0 ELSE 0.95 END::DOUBLE AS idf FROM m""")
def length_idf(t):
    k = t.benchmark.select("item_id", T.keyword_column(F.col("text")).alias("ks"))
    mean = F.aggregate("ks", F.lit(0), lambda a, x: a + F.length(x)) / F.size("ks")
    return k.select("item_id", F.size("ks").alias("n"), T.length_idf_column(mean).alias("idf"))


@add("symbol_candidates", r"""
SELECT page_id, list_sort(list_distinct(list_concat(
  regexp_extract_all(h, '\b(?:[A-Za-z_][A-Za-z0-9_]*\.)+[A-Za-z_][A-Za-z0-9_]*\b'), regexp_extract_all(h, '\b[A-Z][A-Za-z0-9]{2,}\b'),
  regexp_extract_all(h, '\b[a-z]+_[a-z0-9_]+\b'), regexp_extract_all(h, '\b([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1))))  AS symbols
FROM (SELECT page_id, regexp_replace(html, '[^\x00-\x7F]', ' ', 'g') AS h FROM pages)""")
def symbol_candidates(t):
    return t.pages.select("page_id", F.array_sort(T.symbol_column(F.regexp_replace("html", r"[^\x00-\x7F]", " "))).alias("symbols"))


_SYMBOLS_SQL = """symbols AS (SELECT p_partkey AS symbol_id, p_name AS name, p_brand || '.' || p_name AS qualified_name,
  CASE p_size % 4 WHEN 0 THEN 'CLASS' WHEN 1 THEN 'METHOD' WHEN 2 THEN 'VARIABLE' ELSE 'FILE' END AS symbol_type FROM part)"""


def _symbols(t):
    kind = F.when(F.col("p_size") % 4 == 0, "CLASS").when(F.col("p_size") % 4 == 1, "METHOD").when(F.col("p_size") % 4 == 2, "VARIABLE").otherwise("FILE")
    return t.part.select(F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"), kind.alias("symbol_type"))


@add("symbol_score", f"""
WITH {_SYMBOLS_SQL} SELECT symbol_id, name, round(least(1.0::DOUBLE, CASE symbol_type WHEN 'CLASS' THEN 1.0 WHEN 'METHOD' THEN 0.85 WHEN 'VARIABLE' THEN 0.75 ELSE 0.6 END::DOUBLE * 0.7::DOUBLE
  + 0.2::DOUBLE * 0.3::DOUBLE + CASE WHEN lower(name) = 'brand' OR lower(qualified_name) = 'brand' THEN 0.15 ELSE 0.0 END::DOUBLE), 6) AS score
FROM symbols WHERE lower(name) = 'brand' OR contains(lower(qualified_name), 'brand') ORDER BY score DESC, symbol_id LIMIT 25""")
def symbol_score(t):
    return R.symbol(_symbols(t), "find Brand now").select("symbol_id", "name", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "symbol_id").limit(25)


@add("symbol_containment_join", """
WITH s AS (SELECT l_orderkey AS file_id, l_linenumber AS symbol_id, l_quantity::INT AS start_line, l_quantity::INT + 2 AS end_line FROM lineitem),
c AS (SELECT l_orderkey AS file_id, l_linenumber AS chunk_no, l_quantity::INT - 5 AS start_line, l_quantity::INT + 5 AS end_line FROM lineitem WHERE l_returnflag = 'R')
SELECT s.file_id, s.symbol_id, c.chunk_no FROM s LEFT JOIN c ON c.file_id = s.file_id AND c.start_line <= coalesce(s.start_line, c.start_line) AND c.end_line >= coalesce(s.end_line, c.end_line)""")
def symbol_containment_join(t):
    l, q = t.lineitem, F.col("l_quantity").cast("int")
    s = l.select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("symbol_id"), q.alias("start_line"), (q + 2).alias("end_line"))
    c = l.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("chunk_no"), (q - 5).alias("start_line"), (q + 5).alias("end_line"))
    return R.containing_chunks(s, c).select("s.file_id", "s.symbol_id", "c.chunk_no")


# three providers over files, for the fusion queries
_HITS_SQL = """hits AS (
  SELECT 'length' AS provider, doc_id AS chunk_id, source AS file_path, n_chars::DOUBLE AS score, (n_chars // 4)::INT AS tokens FROM documents WHERE lang = 'en'
  UNION ALL SELECT 'recent', doc_id, source, doc_id::DOUBLE, (n_chars // 4)::INT FROM documents WHERE n_chars > 500
  UNION ALL SELECT 'labelled', d.doc_id, source, quality::DOUBLE, (n_chars // 4)::INT FROM labels JOIN documents d USING (doc_id))"""


def _hits(t):
    d = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("file_path"), "lang", "n_chars", F.floor(F.col("n_chars") / 4).cast("int").alias("tokens"))
    pick = lambda df, name, score: df.select(F.lit(name).alias("provider"), "chunk_id", "file_path", score.cast("double").alias("score"), "tokens")
    marked = d.join(t.labels.withColumnRenamed("doc_id", "chunk_id"), "chunk_id")
    return pick(d.filter("lang = 'en'"), "length", F.col("n_chars")).unionByName(pick(d.filter("n_chars > 500"), "recent", F.col("chunk_id"))).unionByName(pick(marked, "labelled", F.col("quality")))


def _rrf_sql(weights: str) -> str:
    return f"""WITH {_HITS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY score DESC, file_path, chunk_id) AS rank FROM hits)
SELECT chunk_id, file_path, round(sum({weights} / (60 + rank)), 9) AS score, count(DISTINCT provider)::BIGINT AS agreement, string_agg(DISTINCT provider, ',' ORDER BY provider) AS sources
FROM r GROUP BY chunk_id, file_path"""


@add("rrf_fusion", _rrf_sql("1.0::DOUBLE"))
def rrf_fusion(t):
    return R.fuse(_hits(t)).withColumn("score", F.round("score", 9))


@add("rrf_weighted", _rrf_sql("CASE provider WHEN 'length' THEN 2.0 WHEN 'labelled' THEN 0.5 ELSE 1.0 END::DOUBLE"))
def rrf_weighted(t):
    return R.fuse(_hits(t), weights={"length": 2.0, "labelled": 0.5}).withColumn("score", F.round("score", 9))


@add("dedupe_sources", f"""WITH {_HITS_SQL} SELECT chunk_id, file_path, max(score) AS score, max(tokens)::INT AS tokens, string_agg(DISTINCT provider, ',' ORDER BY provider) AS sources
FROM hits GROUP BY chunk_id, file_path""")
def dedupe_sources(t):
    return R.deduped(_hits(t))


@add("merge_source_lists", """
SELECT a.doc_id, list_aggregate(list_sort(list_distinct(string_split(a.lang || ',' || a.source || ',' || b.lang, ','))), 'string_agg', ',') AS sources
FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1""")
def merge_source_lists(t):
    b = t.documents.select((F.col("doc_id") - 1).alias("doc_id"), F.col("lang").alias("other"))
    return t.documents.join(b, "doc_id").select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.split(F.concat_ws(",", "lang", "source", "other"), ","))), ",").alias("sources"))


@add("score_boost", f"""
WITH {C.FILES_SQL} SELECT file_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (size_bytes % 100) / 100.0::DOUBLE * CASE WHEN contains(abs_path, 'src1/en') THEN 1.5 WHEN contains(abs_path, 'src1') THEN 1.1 WHEN contains(abs_path, '/de/') THEN 0.8 ELSE 1.0 END::DOUBLE
  * CASE lower(language) WHEN 'fr' THEN 1.2 WHEN 'es' THEN 0.5 ELSE 1.0 END::DOUBLE)), 6) AS score FROM files""")
def score_boost(t):
    score = R.boosted(F.col("size_bytes") % 100 / 100.0, F.col("abs_path"), F.col("language"), {"src1": 1.1, "/de/": 0.8, "src1/en": 1.5}, {"fr": 1.2, "es": 0.5})
    return C.files(t.documents).select("file_id", F.round(score, 6).alias("score"))


@add("min_score_filter", f"""WITH {_HITS_SQL} SELECT provider, count(*)::BIGINT AS n FROM hits WHERE score >= 1000 GROUP BY provider""")
def min_score_filter(t):
    return _hits(t).filter("score >= 1000").groupBy("provider").agg(F.count(F.lit(1)).alias("n"))


_MESSAGES_SQL = "m AS (SELECT conv_id, turn, role, (length(text) // 4)::BIGINT AS tokens FROM conversations)"


def _messages(t):
    return t.conversations.select("conv_id", "turn", "role", F.floor(F.length("text") / 4).cast("long").alias("tokens"))


@add("budget_break", f"""WITH {_MESSAGES_SQL} SELECT conv_id, turn, used FROM (
  SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS used FROM m) WHERE used <= 150""")
def budget_break(t):
    return R.budget_prefix(_messages(t), 150, ["conv_id"], [F.asc("turn")]).select("conv_id", "turn", "used")


@add("budget_skip", f"""
WITH RECURSIVE {_MESSAGES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM m),
g AS (SELECT conv_id, turn, k, tokens, CASE WHEN tokens <= 120 THEN tokens ELSE 0 END AS used, tokens <= 120 AS kept FROM o WHERE k = 1
  UNION ALL SELECT o.conv_id, o.turn, o.k, o.tokens, CASE WHEN g.used + o.tokens <= 120 THEN g.used + o.tokens ELSE g.used END, g.used + o.tokens <= 120
  FROM g JOIN o ON o.conv_id = g.conv_id AND o.k = g.k + 1)
SELECT conv_id, turn, tokens FROM g WHERE kept""")
def budget_skip(t):
    return R.budget_greedy(_messages(t), 120, ["conv_id"], ["turn"])


_MMR_SQL = """cand AS (SELECT *, (row_number() OVER (ORDER BY score DESC, chunk_id))::INT AS i FROM top),
alike AS (SELECT a.i AS a, b.i AS b, list_inner_product(a.u, b.u) AS s FROM cand a, cand b),
pick AS (
  SELECT 0 AS rank, []::INT[] AS chosen, 0::BIGINT AS used
  UNION ALL
  SELECT rank + 1, list_append(chosen, arg_max(i, ord)), used + arg_max(tokens, ord)
  FROM (SELECT rank, chosen, used, c.i, c.tokens, {{'v': round(CASE WHEN len(chosen) = 0 THEN c.score ELSE {w}::DOUBLE * c.score - {v}::DOUBLE * max(s) END, 9), 's': c.score, 'b': -c.i}} AS ord
    FROM pick JOIN cand c ON NOT list_contains(chosen, c.i) AND used + c.tokens <= {budget} LEFT JOIN alike ON alike.a = c.i AND list_contains(chosen, alike.b)
    WHERE rank < {k} GROUP BY rank, chosen, used, c.i, c.tokens, c.score)
  GROUP BY rank, chosen, used),
chosen AS (SELECT rank, chosen[rank] AS i FROM pick WHERE rank > 0)"""


@add("mmr_rerank", f"""
WITH RECURSIVE s AS (SELECT vec_id AS chunk_id, {_COS} AS score, (vec_id % 50 + 10)::BIGINT AS tokens, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
top AS (SELECT chunk_id, score, tokens, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS u FROM s WHERE score >= 0 ORDER BY round(score, 9) DESC, chunk_id LIMIT 64),
{_MMR_SQL.format(w=0.5, v=0.5, budget=400, k=10)}
SELECT 'q0' AS query, chunk_id, round(score, 6) AS score, rank::BIGINT AS rank FROM chosen JOIN cand USING (i)""")
def mmr_rerank(t):
    q = _query_vector(t)
    v = t.embeddings.select(F.lit("q0").alias("query"), F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.lit("v").alias("language"), (F.col("vec_id") % 50 + 10).cast("long").alias("tokens"))
    return R.mmr(R.semantic(v, q, k=64, least=0.0), "query", k=10, weight=0.5, budget=400).withColumn("score", F.round("score", 6))


@add("neighbour_expand", """
WITH h AS (SELECT conv_id, turn, length(text) / 1000.0::DOUBLE AS score FROM conversations WHERE length(text) > 300),
n AS (SELECT c.conv_id, c.turn, max(CASE WHEN h.turn = c.turn THEN h.score END) AS hit, max(h.score * 0.5::DOUBLE) AS beside
  FROM conversations c JOIN h ON h.conv_id = c.conv_id AND abs(h.turn - c.turn) <= 1 GROUP BY c.conv_id, c.turn)
SELECT conv_id AS file_id, turn AS ordinal, conv_id * 1000 + turn AS chunk_id, round(coalesce(hit, beside), 6) AS score, hit IS NOT NULL AS is_hit FROM n""")
def neighbour_expand(t):
    c = t.conversations.select(F.col("conv_id").alias("file_id"), F.col("turn").alias("ordinal"), (F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), "text")
    hits = c.filter(F.length("text") > 300).withColumn("score", F.length("text") / 1000.0)
    return R.neighbours(hits, c.drop("text")).withColumn("score", F.round("score", 6))


@add("commit_recency", """
WITH c AS (SELECT l_partkey AS file, l_orderkey AS commit_id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber) - 1 AS idx, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem)
SELECT file, commit_id, round(1 - idx / (2.0::DOUBLE * n), 6) AS score FROM c WHERE idx < 5""")
def commit_recency(t):
    w = W.partitionBy("l_partkey")
    c = t.lineitem.select(F.col("l_partkey").alias("file"), F.col("l_orderkey").alias("commit_id"), (F.row_number().over(w.orderBy(F.desc("l_orderkey"), "l_linenumber")) - 1).alias("idx"), F.count(F.lit(1)).over(w).alias("n"))
    return c.filter("idx < 5").select("file", "commit_id", F.round(1 - F.col("idx") / (2.0 * F.col("n")), 6).alias("score"))


@add("co_change", """
WITH c AS (SELECT DISTINCT l_orderkey AS commit, l_partkey % 50 AS file FROM lineitem)
SELECT a.file, b.file AS other, count(*)::BIGINT AS n FROM c a JOIN c b ON a.commit = b.commit AND a.file <> b.file GROUP BY a.file, b.file HAVING count(*) >= 2""")
def co_change(t):
    return R.co_changes(t.lineitem.select(F.col("l_orderkey").alias("commit"), (F.col("l_partkey") % 50).alias("file")))


@add("provider_merge_fallback", f"""
WITH {_HITS_SQL}, strong AS (SELECT * FROM hits WHERE provider = 'labelled' AND score >= 2), f AS (SELECT * FROM hits WHERE provider = 'recent' ORDER BY score DESC LIMIT 20)
SELECT provider, chunk_id, score FROM strong UNION ALL SELECT provider, chunk_id, score FROM f WHERE NOT EXISTS (SELECT 1 FROM strong)""")
def provider_merge_fallback(t):
    hits = _hits(t)
    strong = hits.filter("provider = 'labelled' AND score >= 2")
    weak = hits.filter("provider = 'recent'").orderBy(F.desc("score")).limit(20)
    some = strong.limit(1).select(F.lit(1).alias("one"))  # at most one row
    return strong.unionByName(weak.join(F.broadcast(some), F.lit(True), "left_anti")).select("provider", "chunk_id", "score")


_HYBRID_SQL = f"""WITH {_FULLTEXT_SQL}, q AS (SELECT {_Q} AS v),
sem AS (SELECT 'semantic' AS provider, c.chunk_id, c.file_id, c.ordinal, f.abs_path AS file_path, f.language, c.token_count AS tokens,
    list_cosine_similarity(list_transform(e.embedding, lambda x: x::DOUBLE), (SELECT v FROM q)) AS score
  FROM embeddings e JOIN chunks c ON c.file_id = e.vec_id AND c.ordinal = 0 JOIN files f ON f.file_id = c.file_id),
sem_top AS (SELECT * FROM sem WHERE score >= 0.1 ORDER BY round(score, 9) DESC, chunk_id LIMIT 64),
ft_top AS (SELECT * FROM ft WHERE score >= 0.1 ORDER BY score DESC, file_path, chunk_id LIMIT 64),
al AS (SELECT provider, chunk_id, file_path, language, tokens, round(score, 9) AS score FROM sem_top UNION ALL SELECT provider, chunk_id, file_path, language, tokens, round(score, 9) FROM ft_top),
boosted AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, score * CASE WHEN contains(file_path, 'src1') THEN 1.2 ELSE 1.0 END::DOUBLE)) AS b FROM al),
r AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY b DESC, file_path, chunk_id) AS rank FROM boosted),
fused AS (SELECT chunk_id, file_path, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, max(tokens) AS tokens, string_agg(DISTINCT provider, ',' ORDER BY provider) AS sources FROM r GROUP BY chunk_id, file_path),
top AS (SELECT * FROM fused ORDER BY score DESC, file_path, chunk_id LIMIT 30),
b AS (SELECT *, sum(tokens) OVER (ORDER BY score DESC, file_path, chunk_id)::BIGINT AS used, row_number() OVER (ORDER BY score DESC, file_path, chunk_id) AS rank FROM top)
SELECT rank::INT AS rank, chunk_id, file_path, score, sources, used FROM b WHERE used <= 4000"""


@add("hybrid_context", _HYBRID_SQL)
def hybrid_context(t):
    """Two providers by rank fusion: thresholds, boosts, top k and the token budget in one plan."""
    chunks, files = C.chunks(t.spread("documents")), C.files(t.documents)
    first = chunks.filter("ordinal = 0").join(files, "file_id")
    vectors = t.embeddings.select(F.col("vec_id").alias("file_id"), F.col("embedding").alias("vector")).join(first, "file_id").select("vector", "chunk_id", F.col("abs_path").alias("file_path"), "language", F.col("token_count").alias("tokens"))
    sem = R.semantic(vectors, _query_vector(t), k=64, least=0.1).withColumn("provider", F.lit("semantic"))
    lex = _full_text(t).filter("score >= 0.1").orderBy(*R.by_rank()).limit(64)
    cols = ["provider", "chunk_id", "file_path", "language", "tokens", F.round("score", 9).alias("score")]
    hits = sem.select(*cols).unionByName(lex.select(*cols))
    hits = hits.withColumn("score", R.boosted(F.col("score"), F.col("file_path"), F.col("language"), {"src1": 1.2}, {}))
    fused = R.fuse(hits, limit=64).withColumn("score", F.round("score", 9)).join(hits.groupBy("chunk_id").agg(F.max("tokens").alias("tokens")), "chunk_id")
    top = fused.orderBy(*R.by_rank()).limit(30)
    kept = R.budget_prefix(top, 4000, [F.lit(0)], R.by_rank())
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*R.by_rank()))
    return kept.withColumn("rank", rank).select("rank", "chunk_id", "file_path", "score", "sources", "used")


_ASKED = X.Request(
    "The this src7/en/7.txt", k=40, max_tokens=4000, limit=64, least=0.1, path_boosts={"src1": 1.2, "src7/en": 1.5}, language_boosts={"fr": 1.1}, window=1
)


def _corpus(t, indexed: bool = False) -> X.Corpus:
    vectors = t.embeddings.select((F.col("vec_id") * 100000).alias("chunk_id"), F.col("embedding").alias("vector"), F.lit("m").alias("model"))
    symbols = C.symbols(t.documents).drop("language").join(C.files(t.documents).select("file_id", "language"), "file_id")
    terms = _terms(t) if indexed else None
    chunks = terms.chunks.drop("n_chars") if indexed else C.chunks(t.spread("documents"))
    return X.Corpus(chunks, C.files(t.documents), vectors, symbols, C.commits(t.lineitem), terms)


def _asked(t, **changes) -> X.Request:
    return dataclasses.replace(_ASKED, vector=_query_vector(t), **changes)


_WORDS = T.keywords(_ASKED.query)
_PROVIDERS_SQL = f"""{C.CHUNKS_SQL}, {C.FILES_SQL}, {_BASE_SQL}, {C.DOC_SYMBOLS_SQL}, {C.COMMITS_SQL}, live AS (SELECT * FROM files WHERE NOT is_deleted), q AS (SELECT {_Q} AS v),
ft AS (SELECT 'full_text' AS provider, x.chunk_id, abs_path AS file_path, round(score, 9) AS score, token_count::BIGINT AS tokens, x.file_id, x.ordinal
  FROM {_lexical_sql(_WORDS)} x JOIN live USING (file_id) WHERE {" AND ".join(f"(contains(low, '{w}') OR contains(lower(summary), '{w}'))" for w in _WORDS)} AND score > 0 AND NOT is_deleted
  ORDER BY 4 DESC, 3, 2 LIMIT 64),
sem_all AS (SELECT c.chunk_id, f.abs_path AS file_path, list_cosine_similarity(list_transform(e.embedding, lambda x: x::DOUBLE), (SELECT v FROM q)) AS s, c.token_count::BIGINT AS tokens, c.file_id, c.ordinal
  FROM embeddings e JOIN chunks c ON c.chunk_id = e.vec_id * 100000 JOIN live f ON f.file_id = c.file_id),
sem AS (SELECT 'semantic' AS provider, chunk_id, file_path, round(s, 9) AS score, tokens, file_id, ordinal FROM sem_all WHERE s >= 0 ORDER BY round(s, 9) DESC, chunk_id LIMIT 64),
sy_all AS (SELECT s.*, abs_path, least(1.0::DOUBLE, CASE symbol_type WHEN 'CLASS' THEN 1.0 WHEN 'METHOD' THEN 0.85 ELSE 0.75 END::DOUBLE * 0.7::DOUBLE + 0.2::DOUBLE * 0.3::DOUBLE
    + CASE WHEN lower(name) = 'the' OR lower(qualified_name) = 'the' THEN 0.15 ELSE 0.0 END::DOUBLE) AS score
  FROM doc_symbols s JOIN live f USING (file_id) WHERE lower(name) = 'the' OR contains(lower(qualified_name), 'the')),
sy_top AS (SELECT * FROM sy_all ORDER BY score DESC, abs_path, symbol_id LIMIT 64),
sy AS (SELECT 'symbol' AS provider, c.chunk_id, abs_path AS file_path, round(score, 9) AS score, c.token_count::BIGINT AS tokens, c.file_id, c.ordinal FROM sy_top s JOIN chunks c ON c.file_id = s.file_id
  AND CASE WHEN s.start_line IS NULL THEN c.ordinal = 0 ELSE c.start_line <= s.start_line AND c.end_line >= coalesce(s.end_line, s.start_line) END),
named AS (SELECT file_id FROM live WHERE abs_path IN ({", ".join(f"'{p}'" for p in T.paths_in(_ASKED.query))})),
log AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY moment DESC, "commit" DESC) AS k FROM commits WHERE file_id IN (SELECT file_id FROM named)),
aged AS (SELECT file_id, 1.0::DOUBLE - (k - 1) / (count(*) OVER (PARTITION BY file_id) * 2.0::DOUBLE) AS score FROM log WHERE k <= 10),
together AS (SELECT l.file_id AS of, c.file_id, count(DISTINCT c."commit") AS n FROM commits c JOIN log l ON l."commit" = c."commit" AND l.k <= 20 AND l.file_id <> c.file_id GROUP BY 1, 2 HAVING count(DISTINCT c."commit") >= 2),
beside AS (SELECT file_id, 0.7::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY of ORDER BY n DESC, file_id) AS k FROM together) WHERE k <= 5),
git AS (SELECT 'git_history' AS provider, c.chunk_id, abs_path AS file_path, round(score, 9) AS score, c.token_count::BIGINT AS tokens, c.file_id, c.ordinal
  FROM (SELECT file_id, max(score) AS score FROM (SELECT file_id, score FROM aged UNION ALL SELECT * FROM beside) GROUP BY 1) g JOIN chunks c ON c.file_id = g.file_id AND c.ordinal = 0 JOIN live f ON f.file_id = c.file_id
  ORDER BY 4 DESC, 3, 2 LIMIT 64),
al AS (SELECT * FROM sem UNION ALL SELECT * FROM sy UNION ALL SELECT * FROM ft UNION ALL SELECT * FROM git)"""

_QUERY_SQL = f"""WITH {_PROVIDERS_SQL},
best AS (SELECT chunk_id, file_path, max(score) AS score, min(file_id) AS file_id, min(ordinal) AS ordinal, string_agg(DISTINCT provider, ',' ORDER BY provider) AS sources FROM al GROUP BY 1, 2),
kept AS (SELECT * FROM (SELECT b.* EXCLUDE (score), round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, b.score * CASE WHEN contains(file_path, 'src7/en') THEN 1.5 WHEN contains(file_path, 'src1') THEN 1.2 ELSE 1.0 END::DOUBLE
  * CASE WHEN language = 'fr' THEN 1.1 ELSE 1.0 END::DOUBLE)), 9) AS score FROM best b JOIN live USING (file_id)) WHERE score >= 0.1),
near AS (SELECT file_id, ordinal + d AS ordinal, max(CASE WHEN d = 0 THEN score END) AS hit, max(CASE WHEN d = 0 THEN sources END) AS sources, max(score * 0.5::DOUBLE) AS beside
  FROM kept, (VALUES (-1), (0), (1)) v(d) GROUP BY 1, 2),
found AS (SELECT c.chunk_id, round(coalesce(hit, beside), 9) AS score, f.abs_path AS file_path, c.summary AS label, c.kind, c.content AS text, f.language, c.start_line, c.end_line, c.ordinal,
  c.token_count::BIGINT AS tokens, coalesce(n.sources, '') AS sources, hit IS NOT NULL AS is_hit FROM near n JOIN chunks c ON c.file_id = n.file_id AND c.ordinal = n.ordinal JOIN live f ON f.file_id = c.file_id),
ranked AS (SELECT *, (row_number() OVER (ORDER BY file_path, ordinal))::INT AS rank, (sum(tokens) OVER (ORDER BY file_path, ordinal))::BIGINT AS used FROM found)
SELECT * FROM ranked WHERE used <= 4000 AND rank <= 40"""


@add("query_context", _QUERY_SQL)
def query_context(t):
    """Four providers, the best hit of each chunk, boosts, threshold, neighbours, budget and k, with the snippets' text."""
    return X.query_context(_corpus(t), _asked(t))


_MMR_QUERY_SQL = f"""WITH RECURSIVE {_PROVIDERS_SQL},
best AS (SELECT chunk_id, file_path, max(score) AS score, max(tokens) AS tokens, string_agg(DISTINCT provider, ',' ORDER BY provider) AS sources FROM al GROUP BY 1, 2),
vecs AS (SELECT vec_id * 100000 AS chunk_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
top AS (SELECT b.*, CASE WHEN e IS NULL THEN list_transform(range(64), lambda x: 0.0::DOUBLE) ELSE list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) END AS u
  FROM (SELECT * FROM best WHERE score >= 0.3 ORDER BY score DESC, file_path, chunk_id LIMIT 10) b LEFT JOIN vecs USING (chunk_id)),
{_MMR_SQL.format(w=0.5, v=0.5, budget=4000, k=10)},
found AS (SELECT * FROM chosen JOIN cand USING (i)),
ranked AS (SELECT *, row_number() OVER w AS place, sum(tokens) OVER w AS used FROM found WINDOW w AS (ORDER BY score DESC, file_path, chunk_id))
SELECT place::INT AS rank, chunk_id, score, file_path, sources, used::BIGINT AS used FROM ranked WHERE used <= 4000 AND place <= 10"""


@add("query_context_mmr", _MMR_QUERY_SQL)
def query_context_mmr(t):
    """The same with the diversity step instead of neighbours."""
    found = X.query_context(_corpus(t), _asked(t, window=0, diversity=0.5, k=10, path_boosts={}, language_boosts={}))
    return found.select("rank", "chunk_id", "score", "file_path", "sources", "used")


_PROVIDER_SQL = f"""WITH {_PROVIDERS_SQL} SELECT provider, chunk_id, file_path, score, tokens, file_id, ordinal FROM al"""


@add("provider_hits", _PROVIDER_SQL)
def provider_hits(t):
    """What each provider gives on its own, full text by one scan: a term table pays for many searches, and this is one."""
    return X.gathered(_corpus(t), _asked(t))


@add("hybrid_provider", f"""WITH {_PROVIDERS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY score DESC, file_path, chunk_id) AS rank FROM al)
SELECT chunk_id, file_path, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, max(tokens)::BIGINT AS tokens FROM r GROUP BY 1, 2 ORDER BY 3 DESC, 2, 1 LIMIT 64""")
def hybrid_provider(t):
    return X.gathered(_corpus(t), _asked(t), ("hybrid",)).select("chunk_id", "file_path", "score", "tokens")


@add("scoped_context", f"""WITH {C.CHUNKS_SQL}, {C.FILES_SQL}, {_BASE_SQL}, x AS (SELECT l.*, k.kind FROM {_lexical_sql(["this", "ing"])} l JOIN chunks k USING (chunk_id))
SELECT chunk_id, abs_path AS file_path, round(score, 9) AS score FROM x JOIN files USING (file_id)
WHERE NOT is_deleted AND contains(low, 'this') AND contains(low, 'ing') AND score > 0 AND starts_with(abs_path, 'src1') AND language = 'en' AND kind = 'PARAGRAPH' AND NOT regexp_matches(abs_path, '^.*/[^/]*7[.]txt$')
ORDER BY 3 DESC, 2, 1 LIMIT 64""")
def scoped_context(t):
    """One scope for a provider: path prefix, language, kind, glob."""
    scope = X.Scope(paths=("src1",), languages=("EN",), kinds=("PARAGRAPH",), exclude=("**/*7.txt",))
    return X.gathered(_corpus(t), _asked(t, query="this ing", scope=scope), ("full_text",)).select("chunk_id", "file_path", "score")


@add("paths_in_query", r"""
SELECT doc_id, list_distinct(regexp_extract_all(t, '(?:\.{0,2}/)?(?:[a-zA-Z0-9_-]+/)*[a-zA-Z0-9_-]+\.[a-zA-Z]{1,5}')).list_sort() AS paths
FROM (SELECT doc_id, 'see ./' || source || '/' || lang || '/' || doc_id || '.txt and Main' || doc_id || '.kt, not ' || left(text, 40) AS t FROM documents)""")
def paths_in_query(t):
    """Paths that each of many queries names."""
    asked = F.concat(F.lit("see ./"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt and Main"), F.col("doc_id").cast("string"), F.lit(".kt, not "), F.substring("text", 1, 40))
    return t.documents.select("doc_id", F.array_sort(T.path_column(asked)).alias("paths"))
