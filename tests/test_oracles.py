"""Every registered query of the library proper equals its SQL; those without SQL give rows."""

import pytest
from compare import assert_same
from conftest import DATA

from quillspark import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, duck):
    df = catalogue.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name in catalogue.ORACLES:
        assert_same(rows, df.columns, duck.execute(catalogue.ORACLES[name]))
    else:
        assert rows


def test_contract(spark):
    import __spark_entry__ as entry

    assert {"rank", "chunk_id", "file_path", "text", "score", "sources", "used"} <= set(entry.entry(spark).columns)
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_llm_is_apart():
    from pathlib import Path

    root = Path(catalogue.__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "quillspark.llm" in p.read_text()]
