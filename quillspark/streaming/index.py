"""Incremental indexing: a stream of file changes folded into a catalogue, its chunks and its symbols."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import catalog as K
from quillspark.operators.chunkers import chunk_files, symbols
from quillspark.session import recorded_dirs, removed, shared_dir, written

#: The tables of an index and their columns.
TABLES = {
    "files": "file_id long, path string, content_hash string, indexed_at timestamp",
    "chunks": "file_id long, ordinal int, kind string, label string, start_line int, end_line int, tokens int, content string",
    "symbols": "file_id long, symbol_type string, name string, qualified_name string, start_line int",
}


def latest(changes: DataFrame) -> DataFrame:
    """The last event of each path of a micro-batch: (path, kind, content, at)."""
    return changes.groupBy("path").agg(F.max_by(F.struct("kind", "content"), "at").alias("e"), F.max("at").alias("at")).select("path", "e.kind", "e.content", "at")


class Index:
    """Tables in ``slots`` parts by file; a batch writes anew the parts that it touches, and then a list of where every part is.

    The list's folder is written last and named by the batch, so an index that is opened again on its ``folder`` goes on after the last
    whole batch, and a batch that is repeated after a failure gives the same again. Parts that neither of the last two lists names are removed.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, slots: int = 16):
        self.spark, self.folder, self.slots = spark, (folder or shared_dir(spark, "index")).rstrip("/"), slots

    def _names(self, folder: str) -> list[str]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []

    def versions(self) -> list[int]:
        """The batches that are whole, in order."""
        done = [int(n) for n in self._names(f"{self.folder}/lists") if re.fullmatch(r"\d+", n)]
        return sorted(v for v in done if "_SUCCESS" in self._names(f"{self.folder}/lists/{v}"))

    def _parts(self, version: int | None) -> dict[str, dict[int, int]]:
        """Table -> slot -> the version that wrote it; a slot without rows has none."""
        parts: dict[str, dict[int, int]] = {name: {} for name in TABLES}
        for r in [] if version is None else self.spark.read.parquet(f"{self.folder}/lists/{version}").collect():  # a row for each table and slot
            parts[r.name][r.slot] = r.version
        return parts

    def _table(self, name: str, parts: dict[int, int]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*(f"{self.folder}/{name}/{v}/slot={s}" for s, v in sorted(parts.items())))

    def table(self, name: str) -> DataFrame:
        done = self.versions()
        return self._table(name, self._parts(done[-1] if done else None)[name])

    def files(self) -> DataFrame:
        return self.table("files")

    def chunks(self) -> DataFrame:
        return self.table("chunks")

    def symbols(self) -> DataFrame:
        return self.table("symbols")

    def _slot(self):
        return F.pmod("file_id", F.lit(self.slots)).cast("int")

    def _write(self, version: int, tables: dict[str, DataFrame], touched: list[int], before: dict[str, dict[int, int]]) -> None:
        """Each table's touched parts in one job, then the list, then the removal of parts that are in no list that is kept."""
        parts = {name: {s: v for s, v in before.get(name, {}).items() if s not in touched} for name in TABLES}
        for name, df in tables.items():
            df.withColumn("slot", self._slot()).write.partitionBy("slot").mode("overwrite").parquet(f"{self.folder}/{name}/{version}")
            parts[name] |= {int(n[5:]): version for n in self._names(f"{self.folder}/{name}/{version}") if n.startswith("slot=")}
        rows = [(name, s, v) for name, own in parts.items() for s, v in sorted(own.items())]
        self.spark.createDataFrame(rows, "name string, slot int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/lists/{version}")
        used = {(name, s, v) for kept in self.versions()[-2:] for name, own in self._parts(kept).items() for s, v in own.items()}
        for name in TABLES:
            for v in self._names(f"{self.folder}/{name}"):
                for part in self._names(f"{self.folder}/{name}/{v}"):
                    if part.startswith("slot=") and (name, int(part[5:]), int(v)) not in used:
                        removed(self.spark, f"{self.folder}/{name}/{v}/{part}")

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Fold a batch of (path, kind, content, at) in: changed files replace their chunks and symbols, deleted ones lose them."""
        version = batch_id + 1
        older = [v for v in self.versions() if v < version]
        before = self._parts(older[-1] if older else None)
        last = latest(batch).withColumn("content_hash", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256)).withColumn("file_id", F.xxhash64("path"))
        known = self._table("files", before["files"]).select("path", F.col("content_hash").alias("old"))
        differs = F.when(F.col("kind") == "DELETED", F.col("old").isNotNull()).otherwise(~F.col("old").eqNullSafe(F.col("content_hash")))
        with recorded_dirs() as made:
            changed = written(last.join(known, "path", "left").filter(differs), "index-batch")  # read, hashed and compared once
        touched = sorted(r[0] for r in changed.select(self._slot().alias("s")).distinct().collect())  # ``slots`` numbers at most
        live = changed.filter("kind <> 'DELETED'")
        new = {"files": live.select("file_id", "path", "content_hash", F.col("at").alias("indexed_at")), "chunks": chunk_files(live), "symbols": symbols(live)}
        held = {n: {s: v for s, v in before[n].items() if s in touched} for n in new}
        tables = {n: K.without(self._table(n, held[n]), changed, "file_id").unionByName(df) for n, df in new.items()}
        self._write(version, tables, touched, before)
        for folder in made:
            removed(self.spark, folder)

    def rebuild(self, files: DataFrame) -> None:
        """Replace all by the files of (path, content, at), as a batch after the last."""
        done = self.versions()
        rows = files.withColumn("file_id", F.xxhash64("path"))
        hashed = F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256)
        tables = {"files": rows.select("file_id", "path", hashed.alias("content_hash"), F.col("at").alias("indexed_at")), "chunks": chunk_files(rows), "symbols": symbols(rows)}
        self._write((done[-1] if done else 0) + 1, tables, list(range(self.slots)), {})

    def follow(self, stream: DataFrame, checkpoint: str):
        """Fold in what a stream of changes has now; the index and the checkpoint belong together."""
        return stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
