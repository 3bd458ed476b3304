"""Line dedup by levelled sorted runs of line hashes.

Every document's line keys become 128-bit hashes. Documents arrive in batches;
a batch counts, for each hash, the documents that hold it, meets every run in a merge
join, drops the hashes that the runs together already know to be frequent (an anti-join, written as outer joins, as it goes by the
sum over the runs), and adds the rest as a new
run of level 0. Runs are bucketed and sorted by hash, each bucket one file, so that merges read them in order, without a shuffle or a sort.
``fanout`` runs of a level are compacted by an outer merge into one run of
the next. After the last batch all runs are merged once; what reaches the threshold is frequent.
"""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.skew import heavy_keys, heavy_of, skew_join
from quillspark.llm.words import BLANKS, let
from quillspark.session import quoted, removed, shared_dir, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_hashes(text: Column) -> Column:
    """One struct (h1, h2) for each line of ``text``; null for an empty key.

    A key is the line without blanks at its ends and with A-Z in lower case.
    ``lower`` also changes other letters, so the hash takes the lower-cased line
    and the line's non-ASCII characters as they are: together they are equal for
    two lines exactly if the keys are. Only U+212A and U+0130, whose lower case
    holds ASCII letters, need the slower ``translate``.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    keys = F.transform(lines, lambda x: F.btrim(x, F.lit(BLANKS)))

    def parts(k: Column) -> Column:
        ascii_only = F.octet_length(k) == F.length(k)
        odd = k.contains("K") | k.contains("İ")
        low = F.when(ascii_only | ~odd, F.lower(k)).otherwise(F.translate(k, UPPER, LOWER))
        rest = F.when(ascii_only, "").otherwise(F.regexp_replace(k, r"[\x00-\x7F]+", ""))
        return F.struct(low.alias("low"), rest.alias("rest"))

    def hashes(p: Column) -> Column:
        both = F.struct(
            F.xxhash64(p["low"], p["rest"]).alias("h1"), F.xxhash64(F.lit(1), p["low"], p["rest"]).alias("h2")
        )
        return F.when(p["low"] != "", both)

    return F.transform(F.transform(keys, parts), hashes)


def distinct_hashes(hashes: Column) -> Column:
    """The different non-null hashes of one document, in n log n."""
    ordered = F.sort_array(F.filter(hashes, lambda h: h.isNotNull()))
    return let(ordered, lambda s: F.filter(s, lambda h, i: (i == 0) | (h != F.get(s, i - 1))))


@contextlib.contextmanager
def _ordered_scans(spark):
    """Scans of bucketed tables tell their order, which holds as each bucket is one file."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class LineRuns:
    """The levelled runs; ``add`` takes the hashes of a batch, ``frequent`` gives the final set."""

    def __init__(self, spark, min_docs: int, fanout: int = 2):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[tuple[str, str]]] = []
        # as many buckets as a shuffle has partitions, so that a batch meets the runs as its sums are dealt
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _keep(self, df: DataFrame) -> tuple[str, str]:
        """Write a run (h1, h2, n); its table and its folder."""
        path, table = shared_dir(self.spark, "line-run"), f"line_run_{uuid.uuid4().hex}"
        with _ordered_scans(self.spark):
            df.write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(table)
        return table, path

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for table, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            removed(self.spark, path)

    def _merged(self, runs: list[tuple[str, str]]) -> tuple[str, str]:
        out = self.spark.table(runs[0][0])
        for table, _ in runs[1:]:
            more = self.spark.table(table).withColumnRenamed("n", "m").hint("merge")
            out = out.join(more, ["h1", "h2"], "outer").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        kept = self._keep(out)
        self._drop(runs)
        return kept

    def batch(self, batch: DataFrame) -> DataFrame:
        """What a batch adds: (h1, h2, n) of its hashes that the runs do not know to be frequent yet."""
        flat = batch.select(F.explode("h").alias("h")).select("h.h1", "h.h2")
        counts = flat.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.lit(0).cast("long"))
        for table, _ in (run for level in self.levels for run in level):
            run = self.spark.table(table).withColumnRenamed("n", "m").hint("merge")
            counts = counts.join(run, ["h1", "h2"], "left").select("h1", "h2", "n", (F.col("before") + F.coalesce("m", F.lit(0))).alias("before"))
        return counts.filter(F.col("before") < self.min_docs).select("h1", "h2", "n")

    def add(self, batch: DataFrame) -> None:
        """``batch`` has one array column ``h`` of different hashes for each document."""
        run, level = self._keep(self.batch(batch)), 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            run, self.levels[level] = self._merged(self.levels[level]), []
            level += 1

    def frequent(self) -> tuple[DataFrame, DataFrame | None]:
        """(h1, h2) of every key found in at least ``min_docs`` documents, and those of them that are heavy; the runs are removed."""
        runs = [run for level in self.levels for run in level]
        last = self._merged(runs) if len(runs) > 1 else runs[0]
        table = self.spark.table(last[0])
        out = written(table.filter(F.col("n") >= self.min_docs), "line-frequent")
        heavy = heavy_keys(out, ["h1", "h2"], table.agg(F.sum("n")).first()[0] or 0)
        self._drop([last])
        return out.select("h1", "h2"), heavy


def dedup_lines(
    docs: DataFrame, min_docs: int = 10, batches: int = 4, fanout: int = 2, broadcast_rows: int = 100_000
) -> DataFrame:
    """``docs`` plus ``kept`` (text of the lines that stay), ``n_lines`` and ``n_dropped``.

    Every row of ``docs`` counts as a document, whether its id is null or repeated. A null text is one empty line;
    an empty key is never dropped; rows repeated with the same id and text each
    count and get the same result; texts may be of any length; a key in just ``min_docs`` documents goes; other columns pass
    through, but for those named as a result column, which it replaces; names that begin with two underscores are reserved. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    d1 = F.xxhash64("doc_id", "text")
    d2 = F.xxhash64(F.lit(1), "doc_id", "text")
    hashed = docs.select(
        d1.alias("d1"), d2.alias("d2"), F.pmod(d1, F.lit(batches)).cast("int").alias("batch"), line_hashes(F.col("text")).alias("h")
    )
    keys = written(hashed, "line-keys", ("batch",))
    runs = LineRuns(spark, min_docs, fanout)
    for b in range(batches):
        runs.add(keys.filter(F.col("batch") == b).select(distinct_hashes(F.col("h")).alias("h")))
    frequent, heavy = runs.frequent()
    flat = keys.select("d1", "d2", F.posexplode("h").alias("pos", "h")).select("d1", "d2", "pos", "h.h1", "h.h2")
    if frequent.limit(broadcast_rows + 1).count() <= broadcast_rows:
        met = flat.join(F.broadcast(frequent), ["h1", "h2"])
    else:
        met = skew_join(flat, frequent, ["h1", "h2"], heavy)
    hits = met.groupBy("d1", "d2").agg(F.collect_set("pos").alias("_drop"))
    passed = [quoted(c) for c in docs.columns if c not in ("text", "kept", "n_lines", "n_dropped")]
    # the lines are split below the join, so that the lambda reads a finished column
    split = docs.select(
        *passed, d1.alias("__d1"), d2.alias("__d2"), F.split(F.coalesce("text", F.lit("")), "\n").alias("__lines")
    )
    hits = hits.withColumnsRenamed({"d1": "__d1", "d2": "__d2", "_drop": "__drop"})
    repeated = heavy_of(keys.select(F.col("d1").alias("__d1"), F.col("d2").alias("__d2")), ["__d1", "__d2"])
    joined = skew_join(split, hits, ["__d1", "__d2"], repeated, "left")
    every = F.sequence(F.lit(0), F.size("__lines") - 1)
    lines = F.when(F.col("__drop").isNull(), F.col("__lines")).otherwise(
        F.transform(F.array_except(every, F.col("__drop")), lambda i: F.get(F.col("__lines"), i))
    )
    return joined.select(
        *passed,
        F.array_join(lines, "\n").alias("kept"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.when(F.col("__drop").isNull(), 0).otherwise(F.size("__drop")).cast("long").alias("n_dropped"),
    )
