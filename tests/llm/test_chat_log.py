"""The streamed log of a conversation folds back into its texts, and only a right fold does it."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def sample():
    rnd = random.Random(3)
    words = ["\\", "###", "</turn>", "é", "a", "\n", " ", "bb"]
    rows = [(c, t, rnd.choice(["user", "assistant"]), "".join(rnd.choices(words, k=rnd.randint(0, 12)))) for c in range(6) for t in range(rnd.randint(1, 9))]
    return [*rows, (3, 0, "user", "same turn"), (3, 0, "user", "same turn"), (None, None, None, None), (None, 1, "assistant", "x" * 20_000), (9, None, "assistant", "no turn")]


def said(out):
    rows = sorted(out.collect(), key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.pos))
    return [(r.conv_id, *m) for r in rows for m in chat.parse(r.rendered)]


def test_log_folds_back(spark):
    rows = sample()
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("kind", F.lit("clash")).withColumn("seq", F.lit(1))
    log = chat.streamed_log(frame)
    kinds = {r.kind: r["count"] for r in log.groupBy("kind").count().collect()}
    assert kinds["message"] == kinds["edit"] == kinds["regenerate"] == len(rows) and kinds["delta"] > 2 * len(rows)
    on_disk = [r.seq for r in log.collect()]
    assert len(set(on_disk)) == len(on_disk) and on_disk != sorted(on_disk)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    assert said(chat.format_chats(log)) == [(c, r or "", t or "") for c, _, r, t in want]


@pytest.mark.parametrize("lost", ["edit", "regenerate", "delta"])
def test_every_kind_of_event_matters(spark, lost):
    rows = sample()
    log = chat.streamed_log(spark.createDataFrame(rows, SCHEMA))
    want = said(chat.format_chats(log))
    assert said(chat.format_chats(log.filter(F.col("kind") != lost))) != want
    assert said(chat.format_chats(log.withColumn("seq", -F.col("seq")))) != want


def test_empty(spark):
    assert chat.read_chats(chat.format_chats(chat.streamed_log(spark.createDataFrame([], SCHEMA)))).count() == 0
