"""Schemes of Hadoop's file systems, as Python workers open them."""

import pytest

from quillspark.llm.files import arrow_uri, filesystem


@pytest.mark.parametrize(
    "given,want",
    [
        ("s3a://bucket/a b/c", "s3://bucket/a b/c"), ("s3n://bucket/x", "s3://bucket/x"), ("dbfs:/tmp/x", "file:///dbfs/tmp/x"), ("dbfs:///tmp/x", "file:///dbfs/tmp/x"),
        ("file:/tmp/x", "file:///tmp/x"), ("file:///tmp/x", "file:///tmp/x"), ("/tmp/x", "file:///tmp/x"), ("hdfs://name:8020/x", "hdfs://name:8020/x"), ("gs://b/x", "gs://b/x"),
    ],
)
def test_schemes(given, want):
    assert arrow_uri(given) == want


def test_local_folders(tmp_path):
    fs, path = filesystem(f"file:{tmp_path}/x.bin")
    with fs.open_output_stream(path) as out:
        out.write(b"abc")
    assert (tmp_path / "x.bin").read_bytes() == b"abc"
