"""File catalogue: change detection, reconciliation, status, artifacts and discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.text import glob_regex
from quillspark.session import written

# Languages by file extension.
LANGUAGES = {
    "kt": "kotlin", "kts": "kotlin", "java": "java", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript",
    "cs": "csharp", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "swift": "swift",
    "scala": "scala", "sql": "sql", "md": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "xml": "xml", "html": "html", "css": "css",
    "sh": "shell", "toml": "toml", "txt": "text", "pdf": "document", "doc": "document", "docx": "document",
}


def changes(indexed: DataFrame, scanned: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """(key, status): new, modified, unchanged or deleted, by a full outer join on the key."""
    a, b = indexed.alias("a"), scanned.alias("b")
    differs = F.lit(False)
    for c in compare:
        differs = differs | ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    status = (
        F.when(F.col(f"a.{key}").isNull(), "new").when(F.col(f"b.{key}").isNull(), "deleted").when(differs, "modified").otherwise("unchanged")
    )
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), status.alias("status"))


def only_left(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def file_status(deleted: Column, content_hash: Column, modified: Column, indexed: Column) -> Column:
    """error for deleted files, pending without a hash, outdated if changed since indexing, else indexed."""
    return F.when(deleted, "error").when(content_hash == "", "pending").when(modified > indexed, "outdated").otherwise("indexed")


def overlaid(files: DataFrame, progress: DataFrame) -> DataFrame:
    """File status with bootstrap progress over it: FAILED becomes ERROR, waiting paths fill what is absent."""
    joined = files.alias("f").join(progress.alias("p"), F.col("f.path") == F.col("p.path"), "full_outer")
    status = (
        F.when(F.col("p.status") == "FAILED", "ERROR")
        .when(F.col("f.status").isNotNull(), F.col("f.status"))
        .when(F.col("p.status").isin("PENDING", "PROCESSING"), "PENDING")
        .otherwise("INDEXED")
    )
    return joined.select(F.coalesce("f.path", "p.path").alias("path"), status.alias("status"))


def health(statuses: DataFrame) -> DataFrame:
    """One row: counts by status and CRITICAL, DEGRADED or HEALTHY."""
    count = lambda s: F.count_if(F.col("status") == s)
    counted = statuses.agg(F.count(F.lit(1)).alias("total"), *[count(s).alias(s.lower()) for s in ("INDEXED", "OUTDATED", "PENDING", "ERROR")])
    state = F.when(F.col("error") > 0, "CRITICAL").when(F.col("outdated") + F.col("pending") > 0, "DEGRADED").otherwise("HEALTHY")
    return counted.withColumn("health", state)


def replaced(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Stored rows with those of the incoming keys replaced: an anti join and a union."""
    return stored.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def without(stored: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return stored.join(gone.select(key).distinct(), key, "left_anti")


def artifacts(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Each file's chunks in order, with the ids of their embeddings."""
    joined = chunks.join(embeddings, "chunk_id", "left")
    entry = F.struct("ordinal", "chunk_id", "embedding_id")
    return joined.groupBy("file_id").agg(F.sort_array(F.collect_list(entry)).alias("chunks"))


def numbered(df: DataFrame, order: list[Column], name: str = "number", start: int = 1) -> DataFrame:
    """``df`` with consecutive numbers in ``order`` (a total order): sorted by ranges, numbered inside each, offsets added.

    The sorted rows are written once, as ranges are drawn anew whenever a plan runs.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    kept = written(sorted_, "numbered").withColumn("__part", F.shiftright("__at", 33)).withColumn("__in", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = kept.groupBy("__part").agg((F.max("__in") + 1).alias("__n"))  # a row for each range
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("__part", before.alias("__before")))
    return kept.join(offsets, "__part").withColumn(name, F.col("__before") + F.col("__in") + start).drop("__at", "__part", "__in", "__before")


def included(path: Column, roots: list[str]) -> Column:
    """Whether a path is one of the roots or below one; without roots every path is."""
    keep = F.lit(not roots)
    for r in roots:
        keep = keep | (path == r.rstrip("/")) | path.startswith(r.rstrip("/") + "/")
    return keep


def extension_allowed(path: Column, allow: list[str] = (), block: list[str] = ()) -> Column:
    """Whether a path ends in an allowed extension, or in no blocked one; both lists at once are an error."""
    if allow and block:
        raise ValueError("extensions are allowed or blocked, not both")
    ends = F.lit(False)
    for e in allow or block:
        ends = ends | F.lower(path).endswith("." + e.lower().lstrip("."))
    return ends if allow else ~ends


def small_enough(path: Column, size: Column, max_bytes: int, exceptions: list[str] = ()) -> Column:
    """Whether a file is within the limit, or its path matches a glob of the exceptions."""
    keep = size <= max_bytes
    for g in exceptions:
        keep = keep | path.rlike(glob_regex(g))
    return keep


def modified_since(files: DataFrame, moment: Column) -> DataFrame:
    return files.filter(F.col("indexed_at") >= moment).orderBy("indexed_at", "file_id")


def symbols_of(symbols: DataFrame, *file_ids: int) -> DataFrame:
    """Symbols of files by line, those without a line first, then by name."""
    return symbols.filter(F.col("file_id").isin(list(file_ids))).orderBy("file_id", F.asc_nulls_first("start_line"), "name")


# The order of file states in a grid.
STATUS_ORDER = ("error", "outdated", "pending", "indexed")


def grid_order(column: str, descending: bool) -> list[Column]:
    """The order of a file grid by path, size, language, status, chunks or indexed_at; unknown columns fall back to the path."""
    by = {
        "path": F.lower("abs_path"), "size": F.col("size_bytes"), "language": F.coalesce(F.lower("language"), F.lit("")), "chunks": F.col("n_chunks"),
        "indexed_at": F.col("indexed_at"), "status": F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col("status")),
    }.get(column, F.lower("abs_path"))
    return [by.desc_nulls_last() if descending else by.asc_nulls_first(), F.asc("abs_path")]


def path_verdict(path: Column, extensions: list[str], ignore: list[str], skip: list[str]) -> Column:
    """Why a path is left out, tried in this order: traversal, ignored, extension, skipped; or ok."""
    any_of = lambda globs: F.coalesce(*[F.when(path.rlike(glob_regex(g)), True) for g in globs], F.lit(False))
    ends = F.lit(False)
    for e in extensions:
        ends = ends | path.endswith(f".{e}")
    return F.when(path.contains(".."), "traversal").when(any_of(ignore), "ignored").when(~ends, "extension").when(any_of(skip), "skipped").otherwise("ok")


def language_of(path: Column) -> Column:
    """Language by extension, ``unknown`` without a known one."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))), F.lit("unknown"))


# Extensions and media types of files that are not text, and the application types that are.
BINARY_EXTENSIONS = (
    "exe", "dll", "so", "dylib", "bin", "dat", "class", "jar", "war", "ear", "zip", "gz", "gzip", "tgz", "tar", "bz2", "7z", "jpg", "jpeg", "png", "gif", "bmp", "svgz", "ico", "heic",
    "pdf", "mp3", "wav", "flac", "aac", "ogg", "mp4", "mkv", "avi", "mov", "wmv", "sqlite", "db", "duckdb",
)
TEXT_TYPES = (
    "application/json", "application/xml", "application/javascript", "application/x-javascript", "application/x-sh", "application/x-shellscript", "application/x-yaml", "application/yaml",
)
BINARY_PREFIXES = ("image/", "audio/", "video/", "font/", "model/")
BINARY_TYPES = (
    "application/octet-stream", "application/pdf", "application/zip", "application/x-zip-compressed", "application/x-tar", "application/gzip", "application/x-gzip",
    "application/x-7z-compressed", "application/vnd.ms-excel", "application/vnd.ms-powerpoint", "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/x-msdownload",
)


def binary_by_name(path: Column) -> Column:
    """Whether the extension is that of a file that is not text."""
    name = F.lower(F.substring_index(path, "/", -1))
    return F.contains(name, F.lit(".")) & F.substring_index(name, ".", -1).isin(list(BINARY_EXTENSIONS))


def binary_by_type(media_type: Column) -> Column:
    """Whether a media type is that of a file that is not text; unknown types are text."""
    low = F.lower(media_type)
    prefixed = F.lit(False)
    for p in BINARY_PREFIXES:
        prefixed = prefixed | low.startswith(p)
    return F.coalesce(~(low.startswith("text/") | low.isin(list(TEXT_TYPES))) & (low.isin(list(BINARY_TYPES)) | prefixed), F.lit(False))


def is_binary(content: Column) -> Column:
    """A NUL in the first 8 KiB, more than 5 % undecodable characters, or 85 % or less printable ones."""
    text = F.make_valid_utf8(F.substring(content, 1, 8192).cast("string"))
    n = F.greatest(F.length(text), F.lit(1))
    bad, printable = F.regexp_count(text, F.lit("\uFFFD")), F.regexp_count(text, F.lit(r"[^\p{Cc}\x{FFFD}]|[\t\n\r\f]"))
    return text.contains("\0") | (bad / n > 0.05) | ((F.length(text) > 0) & (printable / n <= 0.85))


# The extensions of each priority class.
PRIORITY_CLASSES = {
    2: ("kt", "kts", "py", "ts", "js", "jsx", "tsx", "java", "go", "rs", "c", "cpp", "cc", "h", "hpp", "cs", "swift", "v", "f90", "rb", "php", "scala", "pl", "clj"),
    3: ("md", "rst", "adoc", "txt", "docx", "pdf", "tex", "org"),
    4: ("yaml", "toml", "json", "ini", "env", "cfg", "conf", "xml", "properties"),
    5: ("sql", "ddl", "avsc", "proto", "thrift", "graphql", "xsd", "csv", "parquet", "orc", "arrow", "tsv"),
    6: ("html", "htm", "css", "scss", "sass", "less", "svg", "vue", "svelte"),
    7: ("sh", "bash", "zsh", "ps1", "cmd", "bat", "make", "mk", "dockerfile", "compose", "yml", "gradle", "maven", "nushell"),
    8: ("ipynb",),
}


def priority(size: Column, extension: Column) -> Column:
    """11 above 2 MB or unknown, 1 below 10 KB, else by extension class, else 9 to 256 KB and 10 beyond."""
    out = F.when(size > 2 << 20, 11).when(size < 10 << 10, 1)
    for rank, names in PRIORITY_CLASSES.items():
        out = out.when(F.lower(extension).isin(list(names)), rank)
    return out.when(size <= 256 << 10, 9).when(size.isNotNull(), 10).otherwise(11)


def config_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change) for keys that are added, removed or modified."""
    a, b = before.alias("a"), after.alias("b")
    change = F.when(F.col(f"a.{key}").isNull(), "added").when(F.col(f"b.{key}").isNull(), "removed").when(~F.col(f"a.{value}").eqNullSafe(F.col(f"b.{value}")), "modified")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), change.alias("change")).filter("change IS NOT NULL")


def unified_diff(before: Column, after: Column) -> Column:
    """The lines of two texts held against each other by position: ``-`` and ``+`` lines where they differ, others behind a blank."""
    same = lambda p, q: F.array(F.concat(F.lit(" "), p))
    changed = lambda p, q: F.filter(F.array(F.concat(F.lit("-"), p), F.concat(F.lit("+"), q)), lambda x: x.isNotNull())
    lines = F.zip_with(F.split(before, "\n"), F.split(after, "\n"), lambda p, q: F.when(p.eqNullSafe(q), same(p, q)).otherwise(changed(p, q)))
    return F.array_join(F.flatten(lines), "\n")


def referring(tables: dict[str, DataFrame], column: str) -> list[tuple[str, str]]:
    """(table, column) of every column that names another table's key: the key itself or a name that ends in it."""
    return sorted((t, c) for t, df in tables.items() for c in df.columns if c == column or c.endswith(f"_{column}"))


def compacted(df: DataFrame, path: str, rows_a_file: int = 5_000_000) -> None:
    """Write a table to a new folder in few files of bounded size: what vacuum and checkpoint are to Parquet."""
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)


def sequence_diagram(events: DataFrame) -> DataFrame:
    """(task_id, diagram): a Mermaid sequence of each task's events (task_id, seq, sender, receiver, message) in order."""
    clean = F.regexp_replace(F.col("message"), r"[;\r\n]+", " ")
    line = F.concat(F.lit("    "), "sender", F.lit("->>"), "receiver", F.lit(": "), clean)
    drawn = events.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("seq", line.alias("x")))).alias("all"))
    return drawn.select("task_id", F.concat(F.lit("sequenceDiagram\n"), F.array_join("all.x", "\n")).alias("diagram"))
