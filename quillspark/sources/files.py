"""Files of a folder as a table: scan, validation, metadata."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import catalog as K


def scan(spark: SparkSession, *roots: str) -> DataFrame:
    """(path, modified, size, content) of all files below the roots, each once, read by Spark's own reader; roots that are missing are left out, but not all may be."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = [r for r in dict.fromkeys(roots) if (p := jvm.org.apache.hadoop.fs.Path(r)).getFileSystem(conf).exists(p)]
    if not there:
        raise FileNotFoundError(f"none of {list(roots)} is there")
    inside = lambda r: any(r != o and r.startswith(o.rstrip("/") + "/") for o in there)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([r for r in there if not inside(r)])
    return raw.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def resolved(path: str, roots: list[str], depth: int = 10) -> str | None:
    """Where a local path's symbolic links lead; None if that is outside the roots, a loop, or more than ``depth`` links away."""
    at = path
    for _ in range(depth + 1):
        if not os.path.islink(at):
            real = os.path.realpath(at)
            return real if any(os.path.commonpath([real, os.path.realpath(r)]) == os.path.realpath(r) for r in roots) else None
        at = os.path.join(os.path.dirname(at), os.readlink(at))
    return None


def indexable(files: DataFrame, extensions: list[str], ignore: list[str] = (), skip: list[str] = (), max_bytes: int = 5 << 20, root: str = "", exceptions: list[str] = ()) -> DataFrame:
    """Files that pass the path rules, are no larger than ``max_bytes`` or match an exception, and are text, with metadata.

    Paths are matched relative to ``root``.
    """
    relative = F.regexp_replace("path", f"^.*?{root.rstrip('/')}/", "") if root else F.col("path")
    kept = files.withColumn("relative", relative).filter(K.path_verdict(F.col("relative"), list(extensions), list(ignore), list(skip)) == "ok")
    kept = kept.filter(K.small_enough(F.col("relative"), F.col("size"), max_bytes, exceptions) & ~K.is_binary(F.col("content")))
    return kept.select(
        "path", "relative", "modified", "size", F.sha2("content", 256).alias("content_hash"), K.language_of(F.col("relative")).alias("language"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
    )


def commits(log: DataFrame, path: str, n: int = 10) -> DataFrame:
    """The newest ``n`` commits of (commit, at, message, files) that touch a path."""
    return log.filter(F.array_contains("files", path)).orderBy(F.desc("at"), "commit").limit(n)


def blame(lines: DataFrame, log: DataFrame) -> DataFrame:
    """Blame rows (path, line, commit) with their commit's time and message."""
    return lines.join(log.select("commit", "at", "message"), "commit", "left")
