"""Several tables that change together or not at all, with writers that cannot overwrite each other.

A table is a list of folders of Parquet rows. A change writes new folders, and then one small file, the next version, which lists every table's
folders: it is created only if no other writer has created it. A writer that comes second judges its change anew on the version that won. What a
failed or beaten change has written is in no list, so no reader sees it. A keyed table takes its newest row for each key.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import removed, shared_dir


class Conflict(Exception):
    """Other writers were first as often as was tried."""


class View:
    """All tables as one version has them."""

    def __init__(self, ledger: Ledger, version: int, folders: dict[str, list[list]]):
        self.ledger, self.version, self.folders = ledger, version, folders

    def table(self, name: str) -> DataFrame:
        """The rows of a table; of a keyed table the last written row of each key."""
        schema, key = self.ledger.schemas[name], self.ledger.keys.get(name)
        spark, parts = self.ledger.spark, self.folders.get(name, [])
        if not parts:
            return spark.createDataFrame([], schema)
        stated = spark.createDataFrame([], schema).schema
        rows = None
        for version in sorted({v for v, _ in parts}):
            part = spark.read.schema(stated).parquet(*(f"{self.ledger.folder}/data/{p}" for v, p in parts if v == version)).withColumn("__version", F.lit(version))
            rows = part if rows is None else rows.unionByName(part)
        if key is None:
            return rows.drop("__version")
        newest = rows.groupBy(key).agg(F.max_by(F.struct(*stated.fieldNames()), "__version").alias("__row"))
        return newest.select("__row.*")


class Ledger:
    """Tables of given schemas below one folder; ``keys`` names the key of those in which a later row replaces an earlier one."""

    def __init__(self, spark: SparkSession, schemas: dict[str, str], keys: dict[str, str] | None = None, folder: str | None = None):
        self.spark, self.schemas, self.keys = spark, schemas, keys or {}
        self.folder = (folder or shared_dir(spark, "ledger")).rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path, self._conf = jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.folder).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(f"{self.folder}/log"))

    def version(self) -> int:
        """The newest version, 0 before the first change."""
        names = (f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.folder}/log")))
        return max((int(n.removesuffix(".json")) for n in names if re.fullmatch(r"\d+\.json", n)), default=0)

    def view(self, version: int | None = None) -> View:
        """All tables as of a version, the newest unless one is named: they fit together."""
        at = self.version() if version is None else version
        if not at:
            return View(self, 0, {})
        stream = self._fs.open(self._path(f"{self.folder}/log/{at}.json"))
        try:
            return View(self, at, json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()

    def table(self, name: str) -> DataFrame:
        return self.view().table(name)

    def _create(self, version: int, text: str) -> bool:
        """Whether the file of a version could be created: it is written under another name, then renamed, which fails if the name is taken."""
        jvm = self.spark.sparkContext._jvm
        draft, final = self._path(f"{self.folder}/log/.{uuid.uuid4().hex}"), self._path(f"{self.folder}/log/{version}.json")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf).rename(draft, final, options)
            return True
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e) or self._fs.exists(final):
                return False
            raise

    def change(self, make: Callable[[View], dict[str, DataFrame]], tries: int = 5) -> int:
        """Add the rows that ``make`` gives for the tables of a view, all or none; the new version.

        If another writer is first, the rows are dropped and ``make`` judges the version that won.
        """
        for _ in range(tries):
            view, mark = self.view(), uuid.uuid4().hex[:12]
            folders = {name: list(parts) for name, parts in view.folders.items()}
            for name, df in make(view).items():
                stated = self.spark.createDataFrame([], self.schemas[name]).schema
                part = f"{mark}/{name}"
                df.select(*(F.col(f.name).cast(f.dataType) for f in stated.fields)).write.parquet(f"{self.folder}/data/{part}")
                folders.setdefault(name, []).append([view.version + 1, part])
            if self._create(view.version + 1, json.dumps(folders)):
                return view.version + 1
            removed(self.spark, f"{self.folder}/data/{mark}")
        raise Conflict(f"{tries} versions were created by others meanwhile")

    def compact(self, name: str) -> int:
        """Write a table's rows anew in one folder, as one version; readers of earlier versions keep theirs."""
        for _ in range(5):
            view, part = self.view(), f"{uuid.uuid4().hex[:12]}/{name}"
            view.table(name).write.parquet(f"{self.folder}/data/{part}")
            if self._create(view.version + 1, json.dumps(view.folders | {name: [[view.version + 1, part]]})):
                return view.version + 1
            removed(self.spark, f"{self.folder}/data/{part}")
        raise Conflict("others were first")
