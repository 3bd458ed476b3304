"""Configuration: TOML files with environment references, project roots, stored snapshots."""

from __future__ import annotations

import os
import re
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Files that mark a project, and folders of which two make one likely.
MANIFESTS = ("package.json", "pom.xml", "build.gradle", "build.gradle.kts", "Cargo.toml", "pyproject.toml", "setup.py", "go.mod")
FOLDERS = ("src", "tests", "test", "lib")


def load(text: str, env: dict[str, str] | None = None) -> dict:
    """A TOML text with ``${NAME}`` and ``${NAME:-default}`` filled in; an unknown name without a default is an error."""
    env = dict(os.environ) if env is None else env

    def fill(m: re.Match) -> str:
        value = env.get(m[1], m[3])
        if value is None:
            raise KeyError(f"{m[1]} is not set")
        return value

    return tomllib.loads(re.sub(r"\$\{(\w+)(:-([^}]*))?\}", fill, text))


def project_root(start: Path) -> tuple[Path, str]:
    """The project's root above ``start`` and how sure that is: HIGH by .git, MEDIUM by a manifest, LOW by folders or by nothing at all."""
    up = [start, *start.parents]
    for level, is_root in (
        ("HIGH", lambda p: (p / ".git").exists()),
        ("MEDIUM", lambda p: any((p / m).exists() for m in MANIFESTS)),
        ("LOW", lambda p: sum((p / f).is_dir() for f in FOLDERS) >= 2),
    ):
        for p in up:
            if is_root(p):
                return p, level
    return start, "LOW"


def latest_snapshots(configs: DataFrame) -> DataFrame:
    """The newest stored configuration of each scope."""
    k = F.row_number().over(W.partitionBy("scope").orderBy(F.desc("updated_at"), F.desc("config_id")))
    return configs.withColumn("k", k).filter("k = 1").drop("k")
