"""The registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import chat, clusters, decontam, langid, linededup, mixing, quality, simhash, spelling, substrings, tokens, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rest = F.expr("crc32(encode(cast(doc_id AS string), 'UTF-8')) % 4")
    dictionaries = langid.train_dictionaries(docs.filter(rest != 2).select("doc_id", "text", "lang"))
    found = langid.identify(docs.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "text"), dictionaries)
    return found.select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "first_shard")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    judged = quality.quality_rules(docs, keep_text=False)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op5_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), size=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.read_tokens(spark, tokens.write_tokens(docs, tokenizer_path()))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.contaminated(docs, _table(spark, sf_dir, "benchmark"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read_warc(warc.write_warc(_table(spark, sf_dir, "pages")))
    lost = F.raise_error(F.concat_ws(" ", F.lit("quarantined:"), "path", "offset", "gap_end", "reason"))
    return found.withColumn("kind", F.when(F.col("kind") == "record", F.col("kind")).otherwise(lost)).filter("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    fixed = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text")
    )
    return chat.read_chats(chat.format_chats(chat.streamed_log(rows.unionByName(fixed))))


def op10_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"), shingle=3, radius=3)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rest = _table(spark, sf_dir, "documents"), lambda i: F.crc32(F.encode(i.cast("string"), "UTF-8")) % 5
    rows = docs.select("doc_id", F.coalesce(rest(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "text")
    return toxicity.score_toxicity(rows, _table(spark, sf_dir, "labels").select("doc_id", "toxic"), lambda i: rest(i) != 0)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(_table(spark, sf_dir, "documents"), least=6, occurrences=5, every=199, ratio=5)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_vectors(_table(spark, sf_dir, "embeddings"), k=16, rounds=3, size=64, scale=64, seed=1)


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_line_dedup": op2_line_dedup,
    "op3_source_mixing": op3_source_mixing,
    "op4_quality_rules": op4_quality_rules,
    "op5_repeated_substrings": op5_repeated_substrings,
    "op6_token_files": op6_token_files,
    "op7_decontamination": op7_decontamination,
    "op8_warc": op8_warc,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_simhash_near_dup": op10_simhash_near_dup,
    "op11_toxicity": op11_toxicity,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_centroid_clustering": op13_centroid_clustering,
}

#: Every row is a document, so rows are numbered: ids may repeat or be null.
_OP2_SQL = r"""
WITH rows AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents
), lines AS (
  SELECT row_id, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM rows
), keyed AS (
  SELECT row_id, doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), frequent AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT row_id) >= 10
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(f.k)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f ON keyed.k = f.k GROUP BY row_id, doc_id
"""

_FEATURE_SQL = r"""
w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), grams AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), twice AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c >= 2
), rep AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n_repeat_words FROM twice GROUP BY doc_id
), feat AS (
  SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_text_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         n_symbols * 1000 // greatest(word_chars, 1) AS m_symbol, n_dup_lines * 1000 // greatest(n_text_lines, 1) AS m_dup,
         n_repeat_words * 1000 // greatest(n_words, 1) AS m_repeat, word_chars * 100 // greatest(n_words, 1) AS m_length
  FROM feat
), vals AS (
  UNPIVOT (SELECT doc_id, coalesce(lang, chr(1)) AS lang, coalesce(source, chr(1)) AS source,
                  m_symbol, m_dup, m_repeat, m_length FROM judged)
  ON m_symbol, m_dup, m_repeat, m_length INTO NAME measure VALUE v
), bucketed AS (
  SELECT *, CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END AS top FROM vals
), own AS (
  SELECT lang, source, measure, count(*) AS n, quantile_disc(top, 0.25) AS q1, quantile_disc(top, 0.75) AS q3
  FROM bucketed GROUP BY ALL
), by_lang AS (
  SELECT lang, measure, count(*) AS n, quantile_disc(top, 0.25) AS q1, quantile_disc(top, 0.75) AS q3
  FROM bucketed GROUP BY ALL
), whole AS (
  SELECT measure, quantile_disc(top, 0.25) AS q1, quantile_disc(top, 0.75) AS q3 FROM bucketed GROUP BY ALL
), lim AS (
  SELECT own.lang, own.source, own.measure,
         CASE WHEN own.n >= 100 THEN own.q3 + 3 * (own.q3 - own.q1)
              WHEN by_lang.n >= 100 THEN by_lang.q3 + 3 * (by_lang.q3 - by_lang.q1)
              ELSE whole.q3 + 3 * (whole.q3 - whole.q1) END
         + CASE own.measure WHEN 'm_symbol' THEN 20 WHEN 'm_dup' THEN 400 ELSE 200 END AS t
  FROM own JOIN by_lang ON own.lang = by_lang.lang AND own.measure = by_lang.measure
       JOIN whole ON own.measure = whole.measure
), verdict AS (
  SELECT doc_id, bool_and(v <= t) AS passes
  FROM vals JOIN lim ON vals.lang = lim.lang AND vals.source = lim.source AND vals.measure = lim.measure GROUP BY doc_id
)
"""

_OP4_SQL = f"""
WITH {_FEATURE_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND passes AS kept
FROM judged JOIN verdict USING (doc_id)
"""

_OP8_SQL = """
WITH own AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), first AS (
  SELECT payload_digest, min(page_id) AS least FROM own WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, own.payload_digest,
       CASE WHEN least IS NULL OR page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> least THEN least END AS refers_to
FROM own LEFT JOIN first ON own.payload_digest = first.payload_digest
"""

_OP9_SQL = r"""
WITH events AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS esc,
         replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') AS who FROM events
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(who) + 2 + length(esc) + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def _op13_sql(k: int = 16, rounds: int = 3) -> str:
    """Inner products of integers below 2**53 are exact in doubles; ``s - mod`` is divided without a rest, which gives the floor."""
    parts = [f"""v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS p FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS (
  SELECT row_number() OVER (ORDER BY h, p) - 1 AS c, p
  FROM (SELECT coalesce(sha256('1:' || vec_id), 'null') AS h, p FROM v ORDER BY h, p LIMIT {k})
)"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS (
  SELECT rid, vec_id, p, m.d AS d, m.c AS c
  FROM (SELECT rid, any_value(v.vec_id) AS vec_id, any_value(v.p) AS p,
               min({{'d': (list_inner_product(v.p, v.p) - 2 * list_inner_product(v.p, c{r}.p) + list_inner_product(c{r}.p, c{r}.p))::BIGINT, 'c': c{r}.c}}) AS m
        FROM v CROSS JOIN c{r} GROUP BY rid)
)""")
        if r < rounds:
            parts.append(f"""m{r} AS (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY dim)::DOUBLE[] AS p
  FROM (SELECT c, dim, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(p)::BIGINT AS x, unnest(range(64)) AS dim FROM a{r}) GROUP BY c, dim) GROUP BY c
), c{r + 1} AS (
  SELECT c{r}.c, coalesce(m{r}.p, c{r}.p) AS p FROM c{r} LEFT JOIN m{r} ON c{r}.c = m{r}.c
)""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, a{rounds}.c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY a{rounds}.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(list_transform(c{rounds}.p, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON a{rounds}.c = c{rounds}.c"""


ORACLES = {
    "op2_line_dedup": _OP2_SQL,
    "op4_quality_rules": _OP4_SQL,
    "op8_warc": _OP8_SQL,
    "op9_chat_formatting": _OP9_SQL,
    "op13_centroid_clustering": _op13_sql(),
}
