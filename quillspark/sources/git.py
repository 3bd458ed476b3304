"""Commits and blame of a repository as tables: a data source whose tasks each read a range of the history, or some of the files.

The repository lies in a folder that every executor reaches. The driver asks git for the number of commits or files only; rows are made by tasks.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillspark.session import ship

ship(__name__)

LOG = "commit string, at timestamp, author string, email string, message string, files array<string>"
BLAME = "path string, line int, commit string, author string, at timestamp, text string"
_FORMAT = "%x1e%H%x1f%ct%x1f%an%x1f%ae%x1f%s"


def _git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, "-c", "core.quotePath=false", *args], capture_output=True, check=True, text=True, encoding="utf-8", errors="replace").stdout


def _at(seconds: str) -> datetime:
    return datetime.fromtimestamp(int(seconds), UTC)


def parsed_log(text: str) -> Iterator[tuple]:
    """Rows of LOG from ``git log --name-only`` in this module's format."""
    for entry in text.split("\x1e")[1:]:
        head, _, names = entry.partition("\n")
        commit, at, author, email, message = head.split("\x1f")
        yield commit, _at(at), author, email, message, [n for n in names.split("\n") if n]


def parsed_blame(path: str, text: str) -> Iterator[tuple]:
    """Rows of BLAME from ``git blame --line-porcelain``."""
    commit = author = at = line = None
    for row in text.split("\n"):
        if m := re.match(r"([0-9a-f]{40}) \d+ (\d+)", row):
            commit, line = m[1], int(m[2])
        elif row.startswith("author "):
            author = row[7:]
        elif row.startswith("committer-time "):
            at = _at(row[15:])
        elif row.startswith("\t"):
            yield path, line, commit, author, at, row[1:]


class Share(InputPartition):
    """A task's part: commits ``first`` to ``first + n - 1``, or every ``n``-th file from ``first``."""

    def __init__(self, first: int, n: int):
        self.first, self.n = first, n


class LogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.repo, self.path, self.size = options["repo"], options.get("path"), int(options.get("commits_per_task", "10000"))
        self.limit = int(options["limit"]) if options.get("limit") else None

    def _of(self) -> list[str]:
        return ["--full-diff", "--", self.path] if self.path else []

    def partitions(self) -> list[InputPartition]:
        total = int(_git(self.repo, "rev-list", "--count", "HEAD", *(["--", self.path] if self.path else [])))
        total = total if self.limit is None else min(total, self.limit)
        return [Share(at, min(self.size, total - at)) for at in range(0, total, self.size)]

    def read(self, partition: Share) -> Iterator[tuple]:
        yield from parsed_log(_git(self.repo, "log", f"--format={_FORMAT}", "--name-only", f"--skip={partition.first}", f"-n{partition.n}", *self._of()))


class BlameReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.repo, self.path, self.size = options["repo"], options.get("path", "."), int(options.get("files_per_task", "500"))

    def _files(self) -> list[str]:
        return [f for f in _git(self.repo, "ls-tree", "-r", "-z", "--name-only", "HEAD", "--", self.path).split("\0") if f]

    def partitions(self) -> list[InputPartition]:
        n = -(-len(self._files()) // self.size)
        return [Share(k, n) for k in range(n)]

    def read(self, partition: Share) -> Iterator[tuple]:
        for path in self._files()[partition.first :: partition.n]:
            yield from parsed_blame(path, _git(self.repo, "blame", "--line-porcelain", "HEAD", "--", path))


class GitLog(DataSource):
    """Options: ``repo``, ``path``, ``limit``, ``commits_per_task``."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return LOG

    def reader(self, schema) -> DataSourceReader:
        return LogReader(dict(self.options))


class GitBlame(DataSource):
    """Options: ``repo``, ``path`` (a file or a folder, all by default), ``files_per_task``."""

    @classmethod
    def name(cls) -> str:
        return "git_blame"

    def schema(self) -> str:
        return BLAME

    def reader(self, schema) -> DataSourceReader:
        return BlameReader(dict(self.options))


def log(spark: SparkSession, repo: str, path: str | None = None, limit: int | None = None, commits_per_task: int = 10_000) -> DataFrame:
    """The repository's commits; those that touch ``path`` alone, and the newest ``limit``, if given."""
    spark.dataSource.register(GitLog)
    more = {k: v for k, v in (("path", path), ("limit", limit)) if v is not None}
    return spark.read.format("git_log").options(repo=repo, commits_per_task=commits_per_task, **more).load()


def blame(spark: SparkSession, repo: str, path: str = ".", files_per_task: int = 500) -> DataFrame:
    """The commit behind every line of a file, or of all files below a folder."""
    spark.dataSource.register(GitBlame)
    return spark.read.format("git_blame").options(repo=repo, path=path, files_per_task=files_per_task).load()
