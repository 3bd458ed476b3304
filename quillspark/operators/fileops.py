"""File operations of tasks: conflicts, versions and hashes, folded in order."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame

from quillspark.session import ship

ship(__name__)

SCHEMA = "task_id string, seq long, path string, kind string, version int, content_hash string, conflict string"


def apply(state: dict, kind: str, path: str, content: str | None, base: str | None, target: str | None) -> tuple[int, str | None, str | None]:
    """(version, hash, conflict) of one operation on ``state`` (path -> content, version, hash); conflicts change nothing."""
    now, digest = state.get(path), lambda t: hashlib.sha256(t.encode()).hexdigest()
    conflict = None
    if kind == "CREATE":
        conflict = "File already exists" if now else None
    elif kind == "RENAME":
        conflict = "renameTo not provided" if target is None else "Source does not exist" if not now else "Destination already exists" if target in state else None
    elif not now:
        conflict = "File does not exist"
    elif base is not None and base != now[2]:
        conflict = "Base hash mismatch"
    text = (content or "") if kind == "CREATE" else content if content is not None else (now[0] if now else "")
    own = None if kind == "DELETE" else (now[2] if now else None) if kind == "RENAME" else digest(text)
    if conflict:
        return (now[1] if now else 0), own, conflict
    if kind == "RENAME":
        state[target] = state.pop(path)
        return now[1], own, None
    version = 1 if kind == "CREATE" else now[1] + 1
    if kind == "DELETE":
        del state[path]
    else:
        state[path] = (text, version, own)
    return version, own, None


def history(operations: DataFrame) -> DataFrame:
    """The outcome of each of (task_id, seq, path, kind, content, base_hash, rename_to), in order of seq by task.

    Renames tie the paths of a task together, so a task's operations are one group.
    """

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        state, out = {}, []
        clean = lambda x: None if pd.isna(x) else x
        for r in g.sort_values("seq").itertuples():
            version, digest, conflict = apply(state, r.kind, r.path, clean(r.content), clean(r.base_hash), clean(r.rename_to))
            out.append((r.task_id, r.seq, r.path, r.kind, version, digest, conflict))
        return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return operations.groupBy("task_id").applyInPandas(fold, SCHEMA)
