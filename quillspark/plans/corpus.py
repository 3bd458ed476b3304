"""Queries of the catalogue, the chunkers and the sources."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import catalog as K
from quillspark.operators import chunkers as CK
from quillspark.operators import chunking as CH
from quillspark.operators import embedding as E
from quillspark.operators import retrieval as R
from quillspark.plans.registry import Registry
from quillspark.sources import corpus as C
from quillspark.sources import html as H

REGISTRY = Registry()
add = REGISTRY.add

#: A word-piece vocabulary by rule: the marks, some words and endings, then every ASCII character as a piece and as a part of one.
PIECES = {p: k for k, p in enumerate(dict.fromkeys(("[UNK]", "[CLS]", "[SEP]", "the", "what", "is", "##ing", "##s", *map(chr, range(33, 127)), *(f"##{chr(c)}" for c in range(33, 127)))))}


@add("chunk_lines", f"WITH {C.CHUNKS_SQL} SELECT chunk_id, file_id, ordinal, start_line, end_line, token_count, md5(content) AS digest FROM chunks")
def chunk_lines(t):
    return C.chunks(t.spread("documents")).select("chunk_id", "file_id", "ordinal", "start_line", "end_line", "token_count", F.md5(F.col("content").cast("binary")).alias("digest"))


@add("chunk_sentences", r"""
WITH s AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(trim(x)) > 0)) AS s FROM documents)
SELECT doc_id, count(*)::BIGINT AS n, max(length(s))::INT AS longest, sum(length(s))::BIGINT AS chars FROM s GROUP BY doc_id""")
def chunk_sentences(t):
    s = t.documents.select("doc_id", F.explode(CH.sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("s")).alias("longest"), F.sum(F.length("s")).alias("chars"))


@add("chunk_packed_sentences")
def chunk_packed_sentences(t):
    packed = t.documents.select("doc_id", F.posexplode(CH.packed(CH.sentences(F.col("text")), 2400)).alias("ordinal", "content"))
    return packed.select("doc_id", "ordinal", F.length("content").alias("chars"), T.blended_tokens(F.col("content")).alias("tokens"))


@add("chunk_overlap_windows", """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, ls, unnest(range(0, greatest(len(ls) - 1 - 1, 0) + 1, 4)) AS start FROM l)
SELECT doc_id, start::INT AS start, least(start + 5, len(ls))::INT AS "end", md5(array_to_string(ls[start + 1:start + 5], chr(10))) AS digest FROM w""")
def chunk_overlap_windows(t):
    d = t.documents.select("doc_id", F.split("text", "\n").alias("ls"))
    return CH.windows(d, "ls", 5, 1).select("doc_id", "start", "end", F.md5(F.col("content").cast("binary")).alias("digest"))


@add("token_estimate_simple", "SELECT doc_id, (length(text) // 4)::INT AS tokens FROM documents")
def token_estimate_simple(t):
    return t.documents.select("doc_id", T.simple_tokens(F.col("text")).alias("tokens"))


@add("token_estimate_blended", r"""
SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, least(120000, floor(greatest(length(text) / 4.1::DOUBLE,
  length(text) / 4.1::DOUBLE * 0.6::DOUBLE + len(regexp_extract_all(text, '\S+')) * 0.75::DOUBLE * 0.4::DOUBLE) + 0.5::DOUBLE))) END::INT AS tokens FROM documents""")
def token_estimate_blended(t):
    return t.documents.select("doc_id", T.blended_tokens(F.col("text")).alias("tokens"))


_MODEL_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS text FROM documents),
c AS (SELECT doc_id, length(text)::DOUBLE AS n, len(regexp_extract_all(text, '\p{L}')) AS le, len(regexp_extract_all(text, chr(10))) AS nl,
  len(regexp_extract_all(text, '[ \t]')) AS ws, len(regexp_extract_all(text, '[.,;:!?''"]')) AS pu, len(regexp_extract_all(text, '[#$%&()*+\-/0-9<=>@\[\\\]^_`{|}~]')) AS sy,
  len(regexp_extract_all(text, '[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]')) / length(text)::DOUBLE AS cjk FROM t),
f AS (SELECT *, CASE WHEN cjk > 0.3 THEN 0.0 WHEN cjk > 0.1 THEN 1.0::DOUBLE - (cjk - 0.1::DOUBLE) / 0.2::DOUBLE ELSE 1.0 END::DOUBLE AS own FROM c),
r AS (SELECT *, least(0.03::DOUBLE, pu / n * 0.3::DOUBLE + nl / n * 0.3::DOUBLE + ws / n * 0.05::DOUBLE) AS lo, least(0.05::DOUBLE, pu / n * 0.5::DOUBLE + nl / n * 0.5::DOUBLE) AS lc,
  least(0.10::DOUBLE, sy / n * 0.5::DOUBLE + (1 - le / n) * 0.05::DOUBLE) AS lx FROM f)
SELECT doc_id, """ + ", ".join(
    f"CASE WHEN n = 0 THEN 0 ELSE ceil(n / greatest(1.5::DOUBLE, least(8.0::DOUBLE, CASE WHEN own = 1 THEN {base}::DOUBLE ELSE 1.7::DOUBLE + ({base}::DOUBLE - 1.7::DOUBLE) * own END * (1.0::DOUBLE - {less})))) END::INT AS {name}"
    for name, base, less in (("openai", 4.0, "lo"), ("claude", 4.3, "lc"), ("codex", 3.3, "lx"))
) + " FROM r"


@add("token_estimate_model", _MODEL_SQL)
def token_estimate_model(t):
    counted = t.spread("documents").select("doc_id", T.char_counts(F.col("text")).alias("c"))
    return counted.select("doc_id", *(T.model_tokens(F.col("c"), m).alias(m.lower()) for m in ("OPENAI", "CLAUDE", "CODEX")))


@add("html_source_extract", r"""
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, 'href="([^"]*)"', 1))::INT AS n_links,
  md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM pages""")
def html_source_extract(t):
    h = F.col("html")
    return t.pages.select("page_id", H.title(h).alias("title"), F.size(H.links(h)).alias("n_links"), F.md5(H.readable(h).cast("binary")).alias("digest"))


def _scrub_sql() -> str:
    x = "text"
    for pattern, name in T.SECRET_PATTERNS:
        x = f"regexp_replace({x}, '{pattern}', '{name}', 'g')"
    return x


@add("scrub_secrets", f"SELECT doc_id, md5({_scrub_sql()}) AS digest, length(text) <> length({_scrub_sql()}) AS changed FROM documents")
def scrub_secrets(t):
    s = T.scrubbed(F.col("text"))
    return t.spread("documents").select("doc_id", F.md5(s.cast("binary")).alias("digest"), (F.length("text") != F.length(s)).alias("changed"))


@add("language_distribution", "SELECT coalesce(lang, 'unknown') AS language, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def language_distribution(t):
    return t.documents.groupBy(F.coalesce("lang", F.lit("unknown")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


@add("storage_stats", """
SELECT (SELECT count(*) FROM documents)::BIGINT AS files, (SELECT count(*) FROM embeddings)::BIGINT AS embeddings, (SELECT coalesce(sum(n_chars), 0) FROM documents)::BIGINT AS bytes""")
def storage_stats(t):
    d = t.documents.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("bytes"))
    return d.join(F.broadcast(t.embeddings.agg(F.count(F.lit(1)).alias("embeddings"))), F.lit(True))  # one row each


@add("chunk_count_per_file", f"WITH {C.CHUNKS_SQL} SELECT d.doc_id AS file_id, count(c.chunk_id)::BIGINT AS n FROM documents d LEFT JOIN chunks c ON c.file_id = d.doc_id GROUP BY 1")
def chunk_count_per_file(t):
    n = C.chunks(t.spread("documents")).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    return t.documents.select(F.col("doc_id").alias("file_id")).join(n, "file_id", "left").select("file_id", F.coalesce("n", F.lit(0)).alias("n"))


_STATUS_SQL = """files AS (SELECT doc_id, CASE WHEN lang = 'es' THEN 'OUTDATED' ELSE 'INDEXED' END AS status FROM documents WHERE lang <> 'fr'),
progress AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'FAILED' WHEN toxic = 1 THEN 'PENDING' ELSE 'COMPLETED' END AS status FROM labels),
merged AS (SELECT coalesce(f.doc_id, p.doc_id) AS path, CASE WHEN p.status = 'FAILED' THEN 'ERROR' WHEN f.status IS NOT NULL THEN f.status WHEN p.status IN ('PENDING', 'PROCESSING') THEN 'PENDING' ELSE 'INDEXED' END AS status
  FROM files f FULL JOIN progress p ON f.doc_id = p.doc_id)"""


def _statuses(t):
    files = t.documents.filter("lang <> 'fr'").select(F.col("doc_id").alias("path"), F.when(F.col("lang") == "es", "OUTDATED").otherwise("INDEXED").alias("status"))
    state = F.when(F.col("quality") == 0, "FAILED").when(F.col("toxic") == 1, "PENDING").otherwise("COMPLETED")
    return K.overlaid(files, t.labels.select(F.col("doc_id").alias("path"), state.alias("status")))


@add("index_status", f"WITH {_STATUS_SQL} SELECT path, status FROM merged")
def index_status(t):
    return _statuses(t)


@add("index_health", f"""WITH {_STATUS_SQL}, c AS (SELECT count(*)::BIGINT AS total, count(*) FILTER (status = 'INDEXED')::BIGINT AS indexed, count(*) FILTER (status = 'OUTDATED')::BIGINT AS outdated,
  count(*) FILTER (status = 'PENDING')::BIGINT AS pending, count(*) FILTER (status = 'ERROR')::BIGINT AS error FROM merged)
SELECT *, CASE WHEN error > 0 THEN 'CRITICAL' WHEN outdated + pending > 0 THEN 'DEGRADED' ELSE 'HEALTHY' END AS health FROM c""")
def index_health(t):
    return K.health(_statuses(t))


@add("file_status", """
SELECT doc_id, CASE WHEN source = 'src3' THEN 'error' WHEN n_chars < 100 THEN 'pending' WHEN doc_id % 7 > 3 THEN 'outdated' ELSE 'indexed' END AS status FROM documents""")
def file_status(t):
    s = K.file_status(F.col("source") == "src3", F.when(F.col("n_chars") < 100, "").otherwise("h"), F.col("doc_id") % 7, F.lit(3))
    return t.documents.select("doc_id", s.alias("status"))


@add("bootstrap_progress", """
SELECT count(*) FILTER (s = 0)::BIGINT AS pending, count(*) FILTER (s = 1)::BIGINT AS processing, count(*) FILTER (s = 2)::BIGINT AS completed, count(*) FILTER (s = 3)::BIGINT AS failed
FROM (SELECT doc_id % 4 AS s FROM documents)""")
def bootstrap_progress(t):
    s = t.documents.select((F.col("doc_id") % 4).alias("s"))
    return s.agg(*[F.count_if(F.col("s") == k).alias(n) for k, n in enumerate(("pending", "processing", "completed", "failed"))])


@add("bootstrap_remaining", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def bootstrap_remaining(t):
    return K.without(t.documents.select("doc_id"), t.labels.filter("quality = 1"), "doc_id")


@add("change_detection", """
WITH i AS (SELECT o_custkey AS path, max(o_totalprice) AS h, count(*) AS n FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1),
s AS (SELECT o_custkey AS path, max(o_totalprice) AS h, count(*) FILTER (o_orderpriority <> '1-URGENT') AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT coalesce(i.path, s.path) AS path, CASE WHEN i.path IS NULL THEN 'new' WHEN s.path IS NULL THEN 'deleted' WHEN i.h <> s.h OR i.n <> s.n THEN 'modified' ELSE 'unchanged' END AS status
FROM i FULL JOIN s ON i.path = s.path""")
def change_detection(t):
    o = t.orders.withColumnRenamed("o_custkey", "path")
    i = o.filter("o_orderpriority <> '1-URGENT'").groupBy("path").agg(F.max("o_totalprice").alias("h"), F.count(F.lit(1)).alias("n"))
    s = o.filter("o_orderstatus = 'O'").groupBy("path").agg(F.max("o_totalprice").alias("h"), F.count_if(F.col("o_orderpriority") != "1-URGENT").alias("n"))
    return K.changes(i, s, "path", ["h", "n"])


@add("reconcile_missing", "SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders")
def reconcile_missing(t):
    return K.only_left(t.customer.select(F.col("c_custkey").alias("key")), t.orders.select(F.col("o_custkey").alias("key")), "key")


@add("reconcile_orphaned", "SELECT o_custkey AS key FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'")
def reconcile_orphaned(t):
    return K.only_left(t.orders.select(F.col("o_custkey").alias("key")), t.customer.filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("key")), "key")


@add("set_union_distinct", "SELECT o_custkey AS key FROM orders WHERE o_orderstatus = 'P' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def set_union_distinct(t):
    return t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key")).union(t.customer.filter("c_acctbal < 0").select("c_custkey")).distinct()


@add("artifacts_assembly", f"""
WITH {C.CHUNKS_SQL}, j AS (SELECT c.*, e.vec_id AS embedding_id FROM chunks c LEFT JOIN embeddings e ON e.vec_id * 100000 = c.chunk_id)
SELECT file_id, count(*)::INT AS n_chunks, count(embedding_id)::INT AS n_embedded, array_to_string(list(chunk_id::VARCHAR ORDER BY ordinal), ',') AS chunks FROM j GROUP BY file_id""")
def artifacts_assembly(t):
    e = t.embeddings.select((F.col("vec_id") * 100000).alias("chunk_id"), F.col("vec_id").alias("embedding_id"))
    a = K.artifacts(C.chunks(t.spread("documents")).select("file_id", "chunk_id", "ordinal"), e)
    return a.select(
        "file_id", F.size("chunks").alias("n_chunks"), F.size(F.filter("chunks", lambda x: x["embedding_id"].isNotNull())).alias("n_embedded"),
        F.array_join(F.transform("chunks", lambda x: x["chunk_id"].cast("string")), ",").alias("chunks"),
    )


@add("replace_artifacts", """
SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, quality::BIGINT FROM labels""")
def replace_artifacts(t):
    return K.replaced(t.documents.select("doc_id", "n_chars"), t.labels.select("doc_id", F.col("quality").cast("long").alias("n_chars")), "doc_id")


@add("delete_artifacts", f"WITH {C.CHUNKS_SQL} SELECT chunk_id FROM chunks WHERE file_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_artifacts(t):
    gone = t.labels.filter("toxic = 1").select(F.col("doc_id").alias("file_id"))
    return K.without(C.chunks(t.spread("documents")), gone, "file_id").select("chunk_id")


@add("surrogate_keys", "SELECT 1000 + row_number() OVER (ORDER BY page_id) AS id, url FROM pages")
def surrogate_keys(t):
    return K.numbered(t.pages.select("page_id", "url"), [F.asc("page_id"), F.asc("url")], "id", 1001).select("id", "url")


@add("content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(t):
    return t.documents.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))


@add("file_grid", f"""
WITH {C.FILES_SQL} SELECT file_id, abs_path, CASE WHEN size_bytes < 1024 THEN size_bytes || ' B' ELSE printf('%.1f KB', floor(size_bytes / 1024.0::DOUBLE * 10 + 0.5) / 10) END AS size
FROM files WHERE contains(lower(abs_path), 'src1') AND language IN ('en', 'de') ORDER BY size_bytes DESC, abs_path LIMIT 20 OFFSET 20""")
def file_grid(t):
    f = C.files(t.documents).filter(F.lower("abs_path").contains("src1") & F.col("language").isin("en", "de"))
    page = f.orderBy(F.desc("size_bytes"), "abs_path").offset(20).limit(20)
    return page.select("file_id", "abs_path", T.human_size(F.col("size_bytes")).alias("size"))


_EXT_SQL = "CASE doc_id % 6 WHEN 0 THEN 'py' WHEN 1 THEN 'md' WHEN 2 THEN 'json' WHEN 3 THEN 'sql' WHEN 4 THEN 'ipynb' ELSE 'bin' END"
_EXT = ("py", "md", "json", "sql", "ipynb", "bin")


def _ext():
    return F.element_at(F.array(*map(F.lit, _EXT)), (F.col("doc_id") % 6 + 1).cast("int"))


@add("file_priority", f"""
WITH f AS (SELECT doc_id, n_chars * 100 AS size, {_EXT_SQL} AS ext FROM documents)
SELECT doc_id, CASE WHEN size > 2097152 THEN 11 WHEN size < 10240 THEN 1 WHEN ext = 'py' THEN 2 WHEN ext = 'md' THEN 3 WHEN ext = 'json' THEN 4 WHEN ext = 'sql' THEN 5 WHEN ext = 'ipynb' THEN 8
  WHEN size <= 262144 THEN 9 ELSE 10 END::INT AS priority FROM f""")
def file_priority(t):
    return t.documents.select("doc_id", K.priority(F.col("n_chars") * 100, _ext()).alias("priority"))


@add("path_validation", f"""
WITH p AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '../' ELSE '' END || source || '/' || lang || '/' || doc_id || '.' || {_EXT_SQL} AS path FROM documents)
SELECT doc_id, CASE WHEN contains(path, '..') THEN 'traversal' WHEN regexp_matches(path, '^src7/.*$') THEN 'ignored' WHEN NOT regexp_matches(path, '\\.(py|md|sql)$') THEN 'extension'
  WHEN regexp_matches(path, '^.*/[^/]*3\\.md$') THEN 'skipped' ELSE 'ok' END AS verdict FROM p""")
def path_validation(t):
    path = F.concat(F.when(F.col("doc_id") % 11 == 0, "../").otherwise(""), F.concat_ws("/", "source", "lang", F.concat_ws(".", "doc_id", _ext())))
    return t.documents.select("doc_id", K.path_verdict(path, ["py", "md", "sql"], ["src7/**"], ["**/*3.md"]).alias("verdict"))


@add("language_by_extension", f"""
SELECT doc_id, CASE {_EXT_SQL} WHEN 'py' THEN 'python' WHEN 'md' THEN 'markdown' WHEN 'json' THEN 'json' WHEN 'sql' THEN 'sql' ELSE 'unknown' END AS language FROM documents""")
def language_by_extension(t):
    return t.documents.select("doc_id", K.language_of(F.concat_ws(".", "doc_id", _ext())).alias("language"))


@add("config_diff", """
WITH a AS (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_regionkey <> 0), b AS (SELECT n_nationkey AS k, CASE WHEN n_regionkey = 2 THEN lower(n_name) ELSE n_name END AS v FROM nation WHERE n_regionkey <> 4)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v <> b.v""")
def config_diff(t):
    a = t.nation.filter("n_regionkey <> 0").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    b = t.nation.filter("n_regionkey <> 4").select(F.col("n_nationkey").alias("k"), F.when(F.col("n_regionkey") == 2, F.lower("n_name")).otherwise(F.col("n_name")).alias("v"))
    return K.config_diff(a, b, "k", "v")


@add("files_per_root", f"""
WITH {C.FILES_SQL} SELECT CASE WHEN starts_with(abs_path, 'src1') THEN 'src1' WHEN starts_with(abs_path, 'src2') THEN 'src2' ELSE 'src1' END AS root, count(*)::BIGINT AS n FROM files GROUP BY 1""")
def files_per_root(t):
    root = F.when(F.col("abs_path").startswith("src1"), "src1").when(F.col("abs_path").startswith("src2"), "src2").otherwise("src1")
    return C.files(t.documents).groupBy(root.alias("root")).agg(F.count(F.lit(1)).alias("n"))


@add("unified_diff", """
WITH a AS (SELECT item_id, string_split(text, chr(10)) AS x FROM benchmark), b AS (SELECT doc_id AS item_id, string_split(text, chr(10)) AS y FROM documents), j AS (SELECT item_id, x, y, unnest(range(1, greatest(len(x), len(y)) + 1)) AS i FROM a JOIN b USING (item_id)),
l AS (SELECT item_id, i, CASE WHEN x[i] IS NOT DISTINCT FROM y[i] THEN ' ' || x[i] WHEN x[i] IS NULL THEN '+' || y[i] WHEN y[i] IS NULL THEN '-' || x[i] ELSE '-' || x[i] || chr(10) || '+' || y[i] END AS s FROM j)
SELECT item_id, string_agg(s, chr(10) ORDER BY i) AS diff FROM l GROUP BY item_id""")
def unified_diff(t):
    b = t.documents.select(F.col("doc_id").alias("item_id"), F.col("text").alias("after"))
    return t.benchmark.join(b, "item_id").select("item_id", K.unified_diff(F.col("text"), F.col("after")).alias("diff"))


@add("line_diff", """
WITH a AS (SELECT item_id, string_split(text, chr(10)) AS x FROM benchmark), b AS (SELECT doc_id AS item_id, string_split(text, chr(10)) AS y FROM documents)
SELECT item_id, list_sum(list_transform(range(1, greatest(len(x), len(y)) + 1), lambda i: CASE WHEN x[i] IS DISTINCT FROM y[i] THEN 1 ELSE 0 END))::BIGINT AS changed, greatest(len(x), len(y))::INT AS lines FROM a JOIN b USING (item_id)""")
def line_diff(t):
    a = t.benchmark.select("item_id", F.split("text", "\n").alias("x"))
    b = t.documents.select(F.col("doc_id").alias("item_id"), F.split("text", "\n").alias("y"))
    changed = F.size(F.filter(F.zip_with("x", "y", lambda p, q: ~p.eqNullSafe(q)), lambda c: c))
    return a.join(b, "item_id").select("item_id", changed.cast("long").alias("changed"), F.greatest(F.size("x"), F.size("y")).alias("lines"))


_SNIPPETS_SQL = f"""{C.CHUNKS_SQL}, {C.FILES_SQL}, s AS (SELECT chunk_id, summary AS label, kind, content AS text, start_line, end_line, token_count::BIGINT AS tokens, abs_path AS file_path, language, (token_count % 50) / 50.0::DOUBLE AS score
  FROM chunks JOIN files USING (file_id) WHERE contains(content, 'ing') AND NOT is_deleted),
kept AS (SELECT * FROM (SELECT *, sum(tokens) OVER (ORDER BY score DESC, file_path, chunk_id) AS used FROM s) WHERE used <= 20000)"""


def _snippets(t):
    c = C.chunks(t.spread("documents")).filter(F.contains("content", F.lit("ing"))).join(C.files(t.documents).filter(~F.col("is_deleted")), "file_id")
    return c.select(
        "chunk_id", F.col("summary").alias("label"), "kind", F.col("content").alias("text"), "start_line", "end_line", F.col("token_count").cast("long").alias("tokens"),
        F.col("abs_path").alias("file_path"), "language", (F.col("token_count") % 50 / 50.0).alias("score"),
    )


@add("task_context_stats", f"""
WITH {_SNIPPETS_SQL} SELECT count(*)::BIGINT AS snippets, count(DISTINCT file_path)::BIGINT AS files, sum(tokens)::BIGINT AS tokens, sum(strlen(text))::BIGINT AS bytes FROM kept""")
def task_context_stats(t):
    return R.context_statistics(R.within_budget(_snippets(t), 20000))


@add("task_context_xml", f"""
WITH {_SNIPPETS_SQL}, x AS (SELECT file_path, language, score, chunk_id, '<snippet label="' || label || '" kind="' || kind || '" score="' || printf('%.3f', score) || '" lines="' || start_line || '-' || end_line || '" token_estimate="' || tokens
  || '"><content><![CDATA[' || replace(text, ']]>', ']]]]><![CDATA[>') || ']]></content></snippet>' AS e FROM kept)
SELECT file_path, '<file path="' || file_path || '" language="' || any_value(language) || '">' || string_agg(e, '' ORDER BY score DESC, chunk_id) || '</file>' AS xml FROM x GROUP BY file_path""")
def task_context_xml(t):
    return R.context_xml(R.within_budget(_snippets(t), 20000))


@add("row_invariants", f"""
WITH {C.CHUNKS_SQL} SELECT count(*)::BIGINT AS n, count(*) FILTER (ordinal < 0)::BIGINT AS bad_ordinal, count(*) FILTER (start_line > end_line)::BIGINT AS bad_lines, count(*) FILTER (token_count < 1)::BIGINT AS bad_tokens FROM chunks""")
def row_invariants(t):
    return C.chunks(t.spread("documents")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ordinal") < 0).alias("bad_ordinal"), F.count_if(F.col("start_line") > F.col("end_line")).alias("bad_lines"), F.count_if(F.col("token_count") < 1).alias("bad_tokens"))


@add("chunk_formats")
def chunk_formats(t):
    """Markdown made of documents, and JSON made of pages, through the chunkers by extension."""
    text = F.concat(F.lit("# Doc "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"))
    md = CK.with_path(t.documents.withColumn("text", text), "doc_id", "text", "md")
    js = CK.with_path(t.pages.select((-F.col("page_id") - 1).alias("page_id"), F.to_json(F.struct("url", "html")).alias("j")), "page_id", "j", "json")
    return CK.chunk_files(md.unionByName(js)).select("file_id", "ordinal", "kind", "label", "start_line", "end_line", "tokens")


@add("symbol_extraction")
def symbol_extraction(t):
    return CK.symbols(CK.with_path(t.documents, "doc_id", "text", "txt")).select("file_id", "symbol_type", "name")


@add("files_modified_since", f"WITH {C.FILES_SQL} SELECT file_id, abs_path, indexed_at FROM files WHERE indexed_at >= TIMESTAMP '2024-01-01 01:40:00' ORDER BY indexed_at, file_id")
def files_modified_since(t):
    return K.modified_since(C.files(t.documents), F.lit("2024-01-01 01:40:00").cast("timestamp_ntz")).select("file_id", "abs_path", "indexed_at")


@add("live_files", f"WITH {C.FILES_SQL} SELECT file_id, abs_path FROM files WHERE NOT is_deleted")
def live_files(t):
    return C.files(t.documents).filter(~F.col("is_deleted")).select("file_id", "abs_path")


@add("chunks_by_kind", f"WITH {C.CHUNKS_SQL} SELECT chunk_id, file_id, ordinal, kind, summary FROM chunks WHERE kind = 'TABLE' AND summary LIKE 'src1%' ORDER BY file_id, ordinal")
def chunks_by_kind(t):
    found = C.chunks(t.spread("documents")).filter((F.col("kind") == "TABLE") & F.col("summary").startswith("src1"))
    return found.select("chunk_id", "file_id", "ordinal", "kind", "summary").orderBy("file_id", "ordinal")


@add("embeddings_by_chunks", """
WITH e AS (SELECT vec_id * 100000 AS chunk_id, CASE WHEN vec_id % 3 = 0 THEN 'm1' ELSE 'm2' END AS model, len(embedding)::INT AS dimensions FROM embeddings),
wanted AS (SELECT (doc_id * 100000) AS chunk_id FROM labels WHERE toxic = 1) SELECT chunk_id, model, dimensions FROM e WHERE model = 'm1' AND chunk_id IN (SELECT chunk_id FROM wanted)""")
def embeddings_by_chunks(t):
    """A list of ids of any length is a semi join."""
    e = t.embeddings.select((F.col("vec_id") * 100000).alias("chunk_id"), F.when(F.col("vec_id") % 3 == 0, "m1").otherwise("m2").alias("model"), F.size("embedding").alias("dimensions"))
    return e.filter("model = 'm1'").join(t.labels.filter("toxic = 1").select((F.col("doc_id") * 100000).alias("chunk_id")), "chunk_id", "left_semi")


_FILE_SYMBOLS_SQL = "fs AS (SELECT l_suppkey % 50 AS file_id, l_orderkey * 10 + l_linenumber AS symbol_id, l_returnflag || l_linenumber AS name, CASE WHEN l_linenumber <= 5 THEN l_linenumber::INT END AS start_line FROM lineitem)"


def _file_symbols(t):
    return t.lineitem.select(
        (F.col("l_suppkey") % 50).alias("file_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("symbol_id"),
        F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("name"), F.when(F.col("l_linenumber") <= 5, F.col("l_linenumber").cast("int")).alias("start_line"),
    )


@add("symbols_by_file", f"WITH {_FILE_SYMBOLS_SQL} SELECT file_id, name, start_line FROM fs WHERE file_id IN (3, 7) ORDER BY file_id, start_line NULLS FIRST, name")
def symbols_by_file(t):
    return K.symbols_of(_file_symbols(t), 3, 7).select("file_id", "name", "start_line")


@add("replace_symbols", f"WITH {_FILE_SYMBOLS_SQL} SELECT file_id, symbol_id, name FROM fs WHERE file_id NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT n_nationkey, n_regionkey, n_name FROM nation")
def replace_symbols(t):
    """New symbols of some files replace all that these files had."""
    new = t.nation.select(F.col("n_nationkey").alias("file_id"), F.col("n_regionkey").alias("symbol_id"), F.col("n_name").alias("name"))
    return K.replaced(_file_symbols(t).select("file_id", "symbol_id", "name"), new, "file_id")


@add("discovery_filters", f"""
WITH {C.FILES_SQL}, f AS (SELECT file_id, replace(abs_path, '.txt', CASE WHEN file_id % 4 = 0 THEN '.LOG' ELSE '.txt' END) AS path, size_bytes FROM files)
SELECT file_id, path = 'src2' OR starts_with(path, 'src2/') OR path = 'src1/en' OR starts_with(path, 'src1/en/') AS included, NOT (ends_with(lower(path), '.log') OR ends_with(lower(path), '.tmp')) AS allowed,
  size_bytes <= 2000 OR regexp_matches(path, '^src2/.*$') AS small FROM f""")
def discovery_filters(t):
    """Include list, blocked extensions, and a size limit with exceptions."""
    f = C.files(t.documents).withColumn("path", F.replace("abs_path", F.lit(".txt"), F.when(F.col("file_id") % 4 == 0, ".LOG").otherwise(".txt")))
    path = F.col("path")
    return f.select(
        "file_id", K.included(path, ["src2", "src1/en/"]).alias("included"), K.extension_allowed(path, block=["log", ".tmp"]).alias("allowed"),
        K.small_enough(path, F.col("size_bytes"), 2000, ["src2/**"]).alias("small"),
    )


@add("file_grid_sorted", f"""
WITH {C.FILES_SQL}, {C.CHUNKS_SQL}, n AS (SELECT file_id, count(*) AS n FROM chunks GROUP BY 1),
g AS (SELECT f.file_id, abs_path, coalesce(n, 0)::BIGINT AS n_chunks, CASE WHEN is_deleted THEN 'error' WHEN size_bytes < 100 THEN 'pending' WHEN f.file_id % 7 > 3 THEN 'outdated' ELSE 'indexed' END AS status FROM files f LEFT JOIN n USING (file_id))
SELECT 'status' AS sort, file_id, status, n_chunks FROM (SELECT * FROM g ORDER BY list_position(['error', 'outdated', 'pending', 'indexed'], status), abs_path LIMIT 50)
UNION ALL SELECT 'chunks', file_id, status, n_chunks FROM (SELECT * FROM g ORDER BY n_chunks DESC, abs_path LIMIT 50)""")
def file_grid_sorted(t):
    """Pages of the grid by status and by chunk count."""
    n = C.chunks(t.spread("documents")).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    status = K.file_status(F.col("is_deleted"), F.when(F.col("size_bytes") < 100, "").otherwise("h"), F.col("file_id") % 7, F.lit(3))
    g = C.files(t.documents).join(n, "file_id", "left").withColumn("n_chunks", F.coalesce("n", F.lit(0))).withColumn("status", status)
    page = lambda by, down: g.orderBy(*K.grid_order(by, down)).limit(50).select(F.lit(by).alias("sort"), "file_id", "status", "n_chunks")
    return page("status", False).unionByName(page("chunks", True))


# small files of every language, Foo standing for a part's name, and the chunks (kind, label, first and last line) and symbols (type, name, qualified name, line) that they have
_SOURCES = {
    "py": (
        "import os\n\nclass Foo:\n    \"\"\"Doc.\"\"\"\n\n    def bar(self):\n        return 1\n\ndef free(x):\n    return x\n",
        [("CODE_BLOCK", None, 1, 2), ("CODE_CLASS", "Foo", 3, 7), ("DOCSTRING", None, 4, 4), ("CODE_FUNCTION", "bar", 6, 7), ("CODE_FUNCTION", "free", 9, 10)],
        [("IMPORT", "os", "os", 1), ("CLASS", "Foo", "Foo", 3), ("METHOD", "bar", "Foo.bar", 6), ("FUNCTION", "free", "free", 9)],
    ),
    "java": (
        "package a;\n\nimport b.C;\n\npublic class Foo {\n    private int n;\n\n    public int bar() {\n        return n;\n    }\n}\n",
        [("CODE_HEADER", None, 1, 3), ("CODE_CLASS", "Foo", 5, 11), ("CODE_METHOD", "bar", 8, 10)],
        [("IMPORT", "b.C", "b.C", 3), ("CLASS", "Foo", "Foo", 5), ("METHOD", "bar", "Foo.bar", 8)],
    ),
    "kt": (
        "package a\n\nimport b.C\n\nclass Foo(val n: Int) {\n    fun bar(): Int {\n        return n\n    }\n}\n\nfun free(x: Int) = x\n",
        [("CODE_HEADER", None, 1, 3), ("CODE_CLASS", "Foo", 5, 9), ("CODE_METHOD", "bar", 6, 8), ("CODE_FUNCTION", "free", 11, 11)],
        [("IMPORT", "b.C", "b.C", 3), ("CLASS", "Foo", "Foo", 5), ("METHOD", "bar", "Foo.bar", 6), ("FUNCTION", "free", "free", 11)],
    ),
    "cs": (
        "using System;\n\nnamespace A {\n    public class Foo {\n        public int Bar() {\n            return 1;\n        }\n    }\n}\n",
        [("CODE_HEADER", None, 1, 3), ("CODE_CLASS", "Foo", 4, 8), ("CODE_METHOD", "Bar", 5, 7)],
        [("VARIABLE", n, n, 1) for n in ("using", "System", "namespace", "public", "class", "Foo", "int", "Bar", "return")],
    ),
    "ts": (
        "import { C } from './c';\n\nexport class Foo {\n  bar(): number {\n    return 1;\n  }\n}\n\nexport function free(x: number) {\n  return x;\n}\n\nexport interface Shape {\n  side: number;\n}\n",
        [("CODE_CLASS", "Foo", 3, 7), ("CODE_FUNCTION", "free", 9, 11), ("CODE_INTERFACE", "Shape", 13, 15)],
        [("IMPORT", "./c", "./c", 1), ("CLASS", "Foo", "Foo", 3), ("FUNCTION", "free", "free", 9), ("INTERFACE", "Shape", "Shape", 13)],
    ),
    "sql": (
        "-- about it\nCREATE TABLE Foo (id INT);\n\nINSERT INTO Foo VALUES (1);\n",
        [("SQL_STATEMENT", "CREATE TABLE Foo", 1, 2), ("SQL_STATEMENT", "INSERT INTO Foo", 4, 4)],
        [("VARIABLE", n, n, 1) for n in ("about", "CREATE", "TABLE", "Foo", "INT", "INSERT", "INTO", "VALUES")],
    ),
    "yaml": (
        "name: Foo\nsteps:\n  - one\n  - two\nother:\n  key: value\n",
        [("YAML_BLOCK", "name", 1, 1), ("YAML_BLOCK", "steps", 2, 4), ("YAML_BLOCK", "other", 5, 6)],
        [("VARIABLE", n, n, 1) for n in ("name", "Foo", "steps", "one", "two", "other", "key", "value")],
    ),
    "json": (
        '{"name": "Foo", "steps": [1, 2], "other": {"key": "value"}}',
        [("JSON_BLOCK", "name", 1, 1), ("JSON_BLOCK", "steps", 1, 1), ("JSON_BLOCK", "other", 1, 1)],
        [("VARIABLE", n, n, 1) for n in ("name", "Foo", "steps", "other", "key", "value")],
    ),
    "md": (
        "# Foo\n\nIntro text.\n\n## Bar\n\n```py\nx = 1\n```\n\nEnd.\n",
        [("MARKDOWN_SECTION", "Foo", 1, 4), ("MARKDOWN_SECTION", "Bar", 5, 6), ("CODE_BLOCK", "Bar", 7, 9), ("MARKDOWN_SECTION", "Bar", 10, 12)],
        [("VARIABLE", n, n, 1) for n in ("Foo", "Intro", "text", "Bar", "End")],
    ),
    "txt": (
        "First paragraph\nof two lines.\n\nFoo is next.\n",
        [("PARAGRAPH", None, 1, 2), ("PARAGRAPH", None, 4, 4)],
        [("VARIABLE", n, n, 1) for n in ("First", "paragraph", "two", "lines", "Foo", "next")],
    ),
}


def _source_files(t):
    """A part is a file of the language that its key picks, with a name of its own."""
    kind, name = (F.col("p_partkey") % len(_SOURCES)).cast("int"), F.concat(F.lit("Foo"), F.col("p_partkey").cast("string"))
    text = F.get(F.array(*(F.lit(s[0]) for s in _SOURCES.values())), kind)
    path = F.concat(name, F.lit("."), F.get(F.array(*map(F.lit, _SOURCES)), kind))
    parts = t.part.select("p_partkey").repartition(t.spark.sparkContext.defaultParallelism)  # a row is short, its parsing is not: a file of a few MB would be one task
    return parts.select(F.col("p_partkey").alias("file_id"), path.alias("path"), F.replace(text, F.lit("Foo"), name).alias("content"))


def _expected_sql(which: int, names: str) -> str:
    value = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'"
    rows = [f"({k}, {i}, {', '.join(map(value, row))})" for k, s in enumerate(_SOURCES.values()) for i, row in enumerate(s[which])]
    return f"e(kind_no, ordinal, {names}) AS (VALUES {', '.join(rows)}), p AS (SELECT p_partkey AS file_id, p_partkey % {len(_SOURCES)} AS kind_no, 'Foo' || p_partkey AS name FROM part)"


@add("chunk_languages", f"""WITH {_expected_sql(1, "kind, label, start_line, end_line")}
SELECT file_id, ordinal::INT AS ordinal, kind, replace(label, 'Foo', name) AS label, start_line::INT AS start_line, end_line::INT AS end_line FROM p JOIN e USING (kind_no)""")
def chunk_languages(t):
    """Files of ten languages through the chunkers by extension."""
    return CK.chunk_files(_source_files(t)).select("file_id", "ordinal", "kind", "label", "start_line", "end_line")


@add("symbols_by_language", f"""WITH {_expected_sql(2, "symbol_type, symbol, qualified, start_line")}
SELECT file_id, symbol_type, replace(symbol, 'Foo', name) AS name, replace(qualified, 'Foo', name) AS qualified_name, start_line::INT AS start_line FROM p JOIN e USING (kind_no)""")
def symbols_by_language(t):
    return CK.symbols(_source_files(t))


@add("sequence_diagrams", """
SELECT conv_id AS task_id, 'sequenceDiagram' || chr(10) || string_agg('    ' || role || '->>' || CASE role WHEN 'user' THEN 'assistant' ELSE 'user' END || ': ' || regexp_replace(left(text, 40), '[;\r\n]+', ' ', 'g'), chr(10) ORDER BY turn) AS diagram
FROM conversations GROUP BY 1""")
def sequence_diagrams(t):
    other = F.when(F.col("role") == "user", "assistant").otherwise("user")
    return K.sequence_diagram(t.conversations.select(F.col("conv_id").alias("task_id"), F.col("turn").alias("seq"), F.col("role").alias("sender"), other.alias("receiver"), F.substring("text", 1, 40).alias("message")))


@add("word_pieces")
def word_pieces(t):
    """Benchmark items as word pieces of a vocabulary of single letters, digits and a few words."""
    return t.benchmark.select("item_id", E.word_piece_ids(F.col("text"), PIECES).alias("ids"))


@add("embedded_chunks")
def embedded_chunks(t):
    """Chunks through a model that hashes words, in Arrow batches."""
    return E.embedded(C.chunks(t.spread("documents")), "chunk_id", "content", lambda: E.hashing_model(32), "hashing")


_TYPES = ("text/x-java", "application/json", "image/png", "application/pdf", "video/mp4", "application/unknown", None)


@add("binary_files", f"""
WITH f AS (SELECT doc_id, source || '/a.b/' || doc_id || CASE WHEN doc_id % 7 = 6 THEN '' ELSE '.' || (['PNG', 'txt', 'db', 'md', 'Jar', 'svg'])[1 + doc_id % 7] END AS path, (['text/x-java', 'application/json', 'image/png', 'application/pdf', 'video/mp4', 'application/unknown'])[1 + doc_id % 8] AS type FROM documents)
SELECT doc_id, doc_id % 7 IN (0, 2, 4) AS by_name, coalesce(type IN ('image/png', 'application/pdf', 'video/mp4'), FALSE) AS by_type FROM f""")
def binary_files(t):
    ends = F.get(F.array(*map(F.lit, (".PNG", ".txt", ".db", ".md", ".Jar", ".svg", ""))), (F.col("doc_id") % 7).cast("int"))
    path, kind = F.concat("source", F.lit("/a.b/"), F.col("doc_id").cast("string"), ends), F.get(F.array(*map(F.lit, _TYPES)), (F.col("doc_id") % 8).cast("int"))
    return t.documents.select("doc_id", K.binary_by_name(path).alias("by_name"), K.binary_by_type(kind).alias("by_type"))
