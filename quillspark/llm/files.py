"""File systems of Spark's shared folder as Python workers reach them: pyarrow's, under the schemes that Hadoop has for them."""

from __future__ import annotations

import re

import pyarrow.fs

from quillspark.session import ship

ship(__name__)


def arrow_uri(uri: str) -> str:
    """``uri`` under a scheme that pyarrow knows: s3a and s3n are s3, dbfs is the folder that every node mounts, a bare path is a file.

    Hadoop's own settings (keys, endpoints) are not seen here; object stores take theirs from the environment or the machine's role.
    """
    if uri.startswith("/"):
        return f"file://{uri}"
    uri = re.sub(r"^s3[an]://", "s3://", uri)
    uri = re.sub(r"^dbfs:/+", "file:///dbfs/", uri)
    return re.sub(r"^file:/(?!/)", "file:///", uri)


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of ``uri`` and the path within it."""
    return pyarrow.fs.FileSystem.from_uri(arrow_uri(uri))
