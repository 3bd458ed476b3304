"""Streaming forms against their batch equivalents."""

from datetime import datetime, timedelta

from conftest import DATA
from pyspark.sql import functions as F

from quillspark.streaming import events as ev
from quillspark.streaming import state as st
from quillspark.streaming.index import Index

T0 = datetime(2024, 1, 1)


def test_debounce_last_event_wins(spark):
    rows = [("a", T0, 1, "CREATED"), ("a", T0 + timedelta(milliseconds=50), 2, "MODIFIED"), ("b", T0, 3, "CREATED"), ("a", T0 + timedelta(seconds=5), 4, "DELETED")]
    e = spark.createDataFrame(rows, "path string, ts timestamp, event_id long, event_type string")
    got = sorted((r.path, r.n, r.last_type) for r in ev.debounced(e, "path", "500 milliseconds").collect())
    assert got == [("a", 1, "DELETED"), ("a", 2, "MODIFIED"), ("b", 1, "CREATED")]


def test_running_totals_stream_equals_batch(spark, tmp_path):
    table = spark.read.parquet(f"{DATA}/events.parquet")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ev.running_totals(stream, "user_id", "value", 500).writeStream.outputMode("complete").format("memory").queryName("totals").trigger(availableNow=True).start()
    q.awaitTermination()
    rounded = lambda df: sorted((r.user_id, round(r.total, 4), r.alert) for r in df.collect())
    assert rounded(spark.table("totals")) == rounded(ev.running_totals(table, "user_id", "value", 500))


def test_windows_with_watermark(spark, tmp_path):
    table = spark.read.parquet(f"{DATA}/events.parquet")
    table.write.parquet(str(tmp_path / "in"))
    stream = ev.timed(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")))
    q = ev.batched(ev.of_type(stream, "click"), "1 hour", "user_id").writeStream.outputMode("update").format("memory").queryName("wins").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = ev.batched(ev.of_type(table.withColumn("ts", F.col("ts").cast("timestamp")), "click"), "1 hour", "user_id")
    assert spark.table("wins").count() == batch.count()


def test_incremental_index(spark, tmp_path):
    schema = "path string, kind string, content string, at timestamp"
    batch = lambda rows: spark.createDataFrame(rows, schema)
    folder = str(tmp_path / "changes")
    batch([("a.md", "CREATED", "# A\nx", T0), ("b.txt", "CREATED", "one\n\ntwo", T0)]).write.parquet(folder)
    index = Index(spark)
    stream = lambda: spark.readStream.schema(schema).parquet(folder)
    index.follow(stream(), str(tmp_path / "cp")).awaitTermination()
    assert (index.files().count(), index.chunks().count()) == (2, 3)
    later = T0 + timedelta(hours=1)
    batch([("b.txt", "MODIFIED", "one", later), ("a.md", "MODIFIED", "# B", later), ("a.md", "DELETED", None, later + timedelta(1))]).write.mode("append").parquet(folder)
    index.follow(stream(), str(tmp_path / "cp")).awaitTermination()
    assert [r.path for r in index.files().collect()] == ["b.txt"] and [r.content for r in index.chunks().collect()] == ["one"]


def test_index_goes_on_after_a_restart(spark, tmp_path):
    """A new Index on the same folder and checkpoint; a batch that comes twice; symbols follow their files; a rebuild replaces all."""
    schema, folder, home = "path string, kind string, content string, at timestamp", str(tmp_path / "changes"), str(tmp_path / "index")
    batch = lambda rows: spark.createDataFrame(rows, schema)
    stream = lambda: spark.readStream.schema(schema).parquet(folder)
    batch([("a.py", "CREATED", "class A:\n    pass\n", T0), ("b.txt", "CREATED", "one\n\ntwo", T0)]).write.parquet(folder)
    Index(spark, home, 4).follow(stream(), str(tmp_path / "cp")).awaitTermination()
    batch([("c.txt", "CREATED", "three", T0), ("b.txt", "MODIFIED", "four", T0 + timedelta(hours=1))]).write.mode("append").parquet(folder)
    again = Index(spark, home, 4)
    again.follow(stream(), str(tmp_path / "cp")).awaitTermination()
    paths = lambda index: sorted(r.path for r in index.files().collect())
    assert paths(again) == ["a.py", "b.txt", "c.txt"] and again.versions() == [1, 2]
    assert {r.content for r in again.chunks().collect() if "class" not in r.content} == {"three", "four"}
    assert [(r.symbol_type, r.name) for r in again.symbols().filter("symbol_type = 'CLASS'").collect()] == [("CLASS", "A")]
    repeated = batch([("a.py", "DELETED", None, T0 + timedelta(hours=2))])
    again.merge(repeated, 2)
    again.merge(repeated, 2)
    assert paths(again) == ["b.txt", "c.txt"] and again.symbols().filter("symbol_type = 'CLASS'").count() == 0 and again.versions() == [1, 2, 3]
    again.rebuild(spark.createDataFrame([("z.txt", "all new", T0)], "path string, content string, at timestamp"))
    assert paths(Index(spark, home, 4)) == ["z.txt"] and [r.content for r in again.chunks().collect()] == ["all new"]


def followed(spark, df, tmp_path, body, name, watermark=None):
    df.coalesce(1).write.parquet(str(tmp_path / name))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
    stream = stream.withWatermark("ts", watermark) if watermark else stream
    q = body(stream).writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_awaited_proposals(spark, tmp_path):
    rows = [(1, T0), (1, T0 + timedelta(minutes=1)), (2, T0), (3, T0 + timedelta(hours=2))]
    got = followed(spark, spark.createDataFrame(rows, "task_id long, ts timestamp"), tmp_path, lambda s: st.awaited(s, 2), "awaited", "1 minute")
    assert {(r.task_id, r.n, r.outcome) for r in got} == {(1, 2, "complete"), (2, 1, "timeout")}


def test_workflow_states(spark, tmp_path):
    rows = [(1, k, s) for k, s in enumerate(("PENDING", "COMPLETED", "IN_PROGRESS", "COMPLETED", "PENDING"))] + [(2, 0, "FAILED")]
    got = followed(spark, spark.createDataFrame(rows, "task_id long, seq long, status string"), tmp_path, st.workflow_states, "flows")
    assert {(r.task_id, r.seq): r.accepted for r in got} == {(1, 0): True, (1, 1): False, (1, 2): True, (1, 3): True, (1, 4): False, (2, 0): False}


def test_folder_changes_with_deletions_and_a_restart(spark, tmp_path):
    from quillspark.sources.changes import folder_changes

    home = tmp_path / "repo"
    (home / "sub").mkdir(parents=True)
    put = lambda name, text: (home / name).write_text(text)
    put("a.txt", "one"), put("sub/b.md", "# two"), put("skip.bin", "x")
    index = Index(spark, str(tmp_path / "index"), 4)
    run = lambda ix: ix.follow(folder_changes(spark, str(home), str(tmp_path / "listings"), r"[.](txt|md)$", 1), str(tmp_path / "cp")).awaitTermination()
    names = lambda ix: sorted(r.path for r in ix.files().collect())
    run(index)
    assert names(index) == ["a.txt", "sub/b.md"]
    put("a.txt", "one changed"), (home / "sub/b.md").unlink(), put("c.txt", "three")
    again = Index(spark, str(tmp_path / "index"), 4)
    run(again)
    assert names(again) == ["a.txt", "c.txt"] and {r.content for r in again.chunks().collect()} == {"one changed", "three"}
    run(again)
    assert names(again) == ["a.txt", "c.txt"]
    (home / "c.txt").unlink(), (home / "a.txt").unlink()
    run(again)
    assert names(again) == []


def test_a_batch_of_the_index_is_read_once(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    schema = "path string, kind string, content string, at timestamp"
    batch = spark.createDataFrame([(f"f{n}.txt", "CREATED", "x", T0) for n in range(50)], schema).mapInArrow(counted, schema)
    index = Index(spark, str(tmp_path / "index"))
    index.merge(batch, 0)
    assert reads.value == 50 and index.files().count() == 50
