"""What happens in a folder as a stream: files created, modified and deleted, from one listing to the next.

An offset is the number of a listing. Listings are kept as small files in a folder of their own, beside the stream's checkpoint, so a batch that is
read again after a restart is the difference of the same two listings, and deletions are seen that happened while no stream ran. Spark's own file
source sees new files only.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from quillspark.session import ship

ship(__name__)

CHANGES = "path string, kind string, content string, at timestamp"


def _opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class Files(InputPartition):
    """Changes of a task: (path, kind, time in nanoseconds)."""

    def __init__(self, changes: list[tuple[str, str, int]]):
        self.changes = changes


class FolderReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.state = options["folder"].rstrip("/"), options["listings"].rstrip("/")
        self.size, self.match = int(options.get("files_per_task", "1000")), re.compile(options.get("match", ""))

    def _list(self) -> dict[str, list[int]]:
        """Path below the folder -> time and size, of the files that match."""
        fs, top = _opened(self.folder)
        found = fs.get_file_info(pyarrow.fs.FileSelector(top, recursive=True, allow_not_found=True))
        inside = lambda f: f.path[len(top.rstrip("/")) + 1 :]
        return {inside(f): [f.mtime_ns or 0, f.size] for f in found if f.is_file and self.match.search(inside(f))}

    def _kept(self) -> list[int]:
        fs, top = _opened(self.state)
        names = (f.base_name for f in fs.get_file_info(pyarrow.fs.FileSelector(top, allow_not_found=True)))
        return sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d+\.json", n))

    def _listing(self, number: int) -> dict[str, list[int]]:
        if not number:
            return {}
        fs, top = _opened(self.state)
        with fs.open_input_stream(f"{top}/{number}.json") as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self, *_) -> dict:
        kept = self._kept()
        last, now = (kept[-1] if kept else 0), self._list()
        if now == self._listing(last):
            return {"listing": last}
        fs, top = _opened(self.state)
        fs.create_dir(top, recursive=True)
        with fs.open_output_stream(f"{top}/{last + 1}.part") as f:
            f.write(json.dumps(now).encode())
        fs.move(f"{top}/{last + 1}.part", f"{top}/{last + 1}.json")
        return {"listing": last + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, after = self._listing(start["listing"]), self._listing(end["listing"])
        changes = [(p, "MODIFIED" if p in before else "CREATED", after[p][0]) for p in sorted(after) if before.get(p) != after[p]]
        newest = max((t for t, _ in after.values()), default=0)
        changes += [(p, "DELETED", max(before[p][0] + 1, newest)) for p in sorted(before.keys() - after.keys())]
        return [Files(changes[k : k + self.size]) for k in range(0, len(changes), self.size)]

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, top = _opened(self.folder)
        for path, kind, ns in partition.changes:
            content = None
            if kind != "DELETED":
                try:
                    with fs.open_input_stream(f"{top}/{path}") as f:
                        content = f.read().decode("utf-8", "replace")
                except FileNotFoundError:
                    continue  # gone since: the next listing tells
            yield path, kind, content, datetime.fromtimestamp(ns / 1e9, UTC)

    def commit(self, end: dict) -> None:
        """Listings before the last two committed are not needed again."""
        fs, top = _opened(self.state)
        for n in self._kept():
            if n < end["listing"] - 1:
                fs.delete_file(f"{top}/{n}.json")


class FolderChanges(DataSource):
    """Options: ``folder``, ``listings`` (where listings are kept), ``match`` (a pattern of paths), ``files_per_task``."""

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FolderReader(dict(self.options))


def folder_changes(spark: SparkSession, folder: str, listings: str, match: str = "", files_per_task: int = 1000) -> DataFrame:
    """A stream of (path, kind, content, at): what ``Index.follow`` takes."""
    spark.dataSource.register(FolderChanges)
    return spark.readStream.format("folder_changes").options(folder=folder, listings=listings, match=match, files_per_task=files_per_task).load()
