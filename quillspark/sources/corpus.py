"""Adapters from the stored tables to the engine's logical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


SYMBOL_TYPES = ("CLASS", "METHOD", "VARIABLE")


def _path():
    return F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))


def files(documents: DataFrame) -> DataFrame:
    """file_state: one file for each document; every 97th is marked as deleted, and indexing took a minute for each."""
    return documents.select(
        F.col("doc_id").alias("file_id"),
        _path().alias("abs_path"),
        F.col("lang").alias("language"),
        F.col("n_chars").alias("size_bytes"),
        (F.col("doc_id") % 97 == 13).alias("is_deleted"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias("indexed_at"),
    )


def chunks(documents: DataFrame) -> DataFrame:
    """One chunk for each line that is not blank, numbered within its file; its summary is the file's path, its kind goes by cells of a table."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("content")))
    kept = F.filter(lines, lambda x: x["content"].rlike(r"\S"))
    flat = documents.select(F.col("doc_id").alias("file_id"), _path().alias("summary"), F.posexplode(kept).alias("ordinal", "x"))
    return flat.select(
        (F.col("file_id") * 100000 + F.col("ordinal")).alias("chunk_id"),
        "file_id",
        "ordinal",
        F.col("x.line").alias("start_line"),
        F.col("x.line").alias("end_line"),
        F.greatest(F.lit(1), F.floor(F.length("x.content") / 4)).cast("int").alias("token_count"),
        F.col("x.content").alias("content"),
        "summary",
        F.when(F.contains("x.content", F.lit(" | ")), "TABLE").otherwise("PARAGRAPH").alias("kind"),
    )


def symbols(documents: DataFrame) -> DataFrame:
    """A symbol for each file whose first line begins with a word of ASCII letters: the word, by a type that goes by the file's id."""
    name = F.regexp_extract("text", r"^[A-Za-z]+", 0)
    kind = F.element_at(F.array(*map(F.lit, SYMBOL_TYPES)), (F.col("doc_id") % 3 + 1).cast("int"))
    found = documents.select(
        F.col("doc_id").alias("symbol_id"), F.col("doc_id").alias("file_id"), name.alias("name"), F.concat_ws(".", "source", name).alias("qualified_name"),
        kind.alias("symbol_type"), F.when(F.col("doc_id") % 5 > 0, 1).alias("start_line"), F.when(F.col("doc_id") % 5 > 0, 1).alias("end_line"), F.col("lang").alias("language"),
    )
    return found.filter("name <> ''")


def commits(lineitem: DataFrame) -> DataFrame:
    """(commit, at, file_id): an order is a commit of its day that changes a file for each of its parts."""
    return lineitem.groupBy(F.col("l_orderkey").alias("commit"), (F.col("l_partkey") % 200).alias("file_id")).agg(F.max("l_shipdate").alias("at"))


FILES_SQL = """files AS (
  SELECT doc_id AS file_id, source || '/' || lang || '/' || doc_id || '.txt' AS abs_path, lang AS language,
         n_chars AS size_bytes, doc_id % 97 = 13 AS is_deleted, TIMESTAMP '2024-01-01' + to_minutes(doc_id::INT) AS indexed_at FROM documents)"""

CHUNKS_SQL = r"""chunks AS (
  SELECT doc_id * 100000 + ordinal AS chunk_id, doc_id AS file_id, ordinal::INT AS ordinal, line::INT AS start_line, line::INT AS end_line,
         greatest(1, length(content) // 4)::INT AS token_count, content, path AS summary, CASE WHEN contains(content, ' | ') THEN 'TABLE' ELSE 'PARAGRAPH' END AS kind
  FROM (SELECT doc_id, line, content, path, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS ordinal
        FROM (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
        WHERE regexp_matches(content, '\S')))"""

DOC_SYMBOLS_SQL = """doc_symbols AS (
  SELECT doc_id AS symbol_id, doc_id AS file_id, regexp_extract(text, '^[A-Za-z]+') AS name, source || '.' || regexp_extract(text, '^[A-Za-z]+') AS qualified_name,
         CASE doc_id % 3 WHEN 0 THEN 'CLASS' WHEN 1 THEN 'METHOD' ELSE 'VARIABLE' END AS symbol_type, CASE WHEN doc_id % 5 > 0 THEN 1 END AS start_line,
         CASE WHEN doc_id % 5 > 0 THEN 1 END AS end_line, lang AS language FROM documents WHERE regexp_extract(text, '^[A-Za-z]+') <> '')"""

COMMITS_SQL = """commits AS (SELECT l_orderkey AS "commit", l_partkey % 200 AS file_id, max(l_shipdate) AS moment FROM lineitem GROUP BY 1, 2)"""
