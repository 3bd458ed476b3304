"""Runs of line hashes: merges without shuffles, batches that leave out what is known, and the SQL on rows with repeated ids."""

import re

import duckdb
from compare import assert_same
from pyspark.sql import functions as F

from quillspark.llm import entries, linededup


def hashes(spark, docs):
    """Documents as lists of numbers, which stand for hashes."""
    rows = [([(k, -k) for k in doc],) for doc in docs]
    return spark.createDataFrame(rows, "h array<struct<h1:long,h2:long>>")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merges_read_runs_in_order(spark):
    runs = linededup.LineRuns(spark, 3)
    runs.add(hashes(spark, [range(50), range(40)]))
    with linededup._ordered_scans(spark):
        plan = plan_of(runs.batch(hashes(spark, [range(60)])))
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1  # the batch's own sums
    run_side = plan[plan.index("SortMergeJoin") :]
    assert len(re.findall(r"Sort \[", run_side)) <= 1  # the run comes sorted
    before = {r.h1: r.n for r in spark.table(runs.levels[0][0][0]).collect()}
    assert before == {k: 1 + (k < 40) for k in range(50)}


def test_batches_leave_out_what_the_runs_know(spark):
    runs = linededup.LineRuns(spark, 3, fanout=9)
    for docs in ([range(3), range(2)], [range(3), [9]]):
        runs.add(hashes(spark, docs))
    left = {r.h1: r.n for r in runs.batch(hashes(spark, [[0, 1, 2, 9], [9]])).collect()}
    assert left == {2: 1, 9: 2}  # 0 and 1 were in three documents before
    runs.add(hashes(spark, [[0, 1, 2, 9], [9]]))
    assert len(runs.levels[0]) == 3
    tables = [t for t, _ in runs.levels[0]]
    found, heavy = runs.frequent()
    assert {r.h1 for r in found.collect()} == {0, 1, 2, 9} and heavy is None
    assert not [t for t in tables if spark.catalog.tableExists(t)]


def test_levels(spark):
    runs = linededup.LineRuns(spark, 5, fanout=2)
    for k in range(7):
        runs.add(hashes(spark, [[k, 100]]))
    assert [len(level) for level in runs.levels] == [1, 1, 1]
    assert {r.h1 for r in runs.frequent()[0].collect()} == {100}


def test_sql_counts_rows(spark):
    """Ids that repeat or are null do not make one document of several."""
    rows = [(1, "Twice\nthe SAME\n")] * 5 + [(None, " twice\nother")] * 4 + [(2, "the same"), (3, "twice"), (4, None), (4, ""), (None, None)]
    rows += [(5, "\n".join(["lone line"] * 20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = linededup.dedup_lines(docs, 10).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert_same(out.collect(), out.columns, con.execute(entries.ORACLES["op2_line_dedup"]))
    assert {(r.doc_id, r.n_dropped) for r in out.collect() if r.n_dropped} == {(1, 1), (None, 1), (3, 1)}


def test_heavy_lines_and_rows(spark, monkeypatch):
    from quillspark.llm import skew

    heavy = skew.heavy_keys
    monkeypatch.setattr(linededup, "heavy_keys", lambda c, k, n: heavy(c, k, n, 5, 2))
    monkeypatch.setattr(linededup, "heavy_of", lambda t, k: skew.heavy_of(t, k, most_keys=5, least=2))
    rows = [(1, "a\nb")] * 30 + [(k, f"a\nline {k}") for k in range(2, 30)] + [(None, "a\nzz"), (90, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("d1", F.lit(1)).withColumn("a.b", F.lit(2))
    got = linededup.dedup_lines(docs, 10, broadcast_rows=0).collect()
    assert sorted((r.doc_id or 0, r.kept, r.n_dropped) for r in got) == sorted([(1, "", 2)] * 30 + [(k, f"line {k}", 1) for k in range(2, 30)] + [(0, "zz", 1), (90, "", 0)])
    assert {r["a.b"] for r in got} == {2}
