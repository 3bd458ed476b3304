"""Tables that change together: whole or not at all, one writer after another; completing tasks through them."""

import pytest

from quillspark.operators import completion, ledger

SCHEMAS = {"a": "id long, v string", "b": "id long, n int"}


def made(spark, rows_a=(), rows_b=()):
    return {k: spark.createDataFrame(list(r), SCHEMAS[k]) for k, r in (("a", rows_a), ("b", rows_b)) if r}


def test_versions_and_keys(spark, tmp_path):
    one = ledger.Ledger(spark, SCHEMAS, {"a": "id"}, f"file://{tmp_path}/l")
    assert one.version() == 0 and one.table("a").collect() == []
    one.change(lambda v: made(spark, [(1, "x"), (2, "y")], [(1, 1)]))
    one.change(lambda v: made(spark, [(1, "z")], [(1, 2)]))
    assert sorted(map(tuple, one.table("a").collect())) == [(1, "z"), (2, "y")] and sorted(r.n for r in one.table("b").collect()) == [1, 2]
    assert sorted(map(tuple, one.view(1).table("a").collect())) == [(1, "x"), (2, "y")]
    one.compact("a")
    again = ledger.Ledger(spark, SCHEMAS, {"a": "id"}, f"file://{tmp_path}/l")
    assert again.version() == 3 and len(again.view().folders["a"]) == 1 and sorted(map(tuple, again.table("a").collect())) == [(1, "z"), (2, "y")]


def test_second_writer_judges_anew(spark, tmp_path):
    one, two = (ledger.Ledger(spark, SCHEMAS, {"a": "id"}, f"file://{tmp_path}/l") for _ in range(2))
    one.change(lambda v: made(spark, [(1, "0")]))
    seen = []

    def add(view):
        value = int(view.table("a").first().v)
        seen.append(value)
        if len(seen) == 1:  # another writer is first
            two.change(lambda v: made(spark, [(1, "10")]))
        return made(spark, [(1, str(value + 1))])

    one.change(add)
    assert seen == [0, 10] and one.table("a").first().v == "11" and one.version() == 3


def test_gives_up_after_some_tries(spark, tmp_path):
    one, two = (ledger.Ledger(spark, SCHEMAS, folder=f"file://{tmp_path}/l") for _ in range(2))

    def beaten(view):
        two.change(lambda v: made(spark, [(1, "x")]))
        return made(spark, [(2, "y")])

    with pytest.raises(ledger.Conflict):
        one.change(beaten, tries=2)
    assert {r.id for r in one.table("a").collect()} == {1}


@pytest.fixture()
def tasks(spark, tmp_path):
    book = ledger.Ledger(spark, completion.TABLES, completion.KEYS, f"file://{tmp_path}/tasks")
    rows = [(1, "IN_PROGRESS", "CONSENSUS", None), (2, "COMPLETED", "SOLO", None), (3, "FAILED", "SOLO", None), (4, "PENDING", "CONSENSUS", None)]
    book.change(lambda v: {"tasks": spark.createDataFrame(rows, completion.TABLES["tasks"]), "messages": spark.createDataFrame([(1, "user", "hello", 7, "u")], completion.TABLES["messages"])})
    proposals = spark.createDataFrame([(10, 1, 100), (11, 1, 40), (40, 4, 5)], "id long, task_id long, tokens long")
    return book, proposals


def ask(spark, *rows):
    return spark.createDataFrame(list(rows), completion.REQUEST)


FULL = (1, "ann", [10, 11], [11], 11, 0.5, "why", 3, 4, "all is done", '{"x": 1}')


def test_completing_leaves_all_rows(spark, tasks):
    book, proposals = tasks
    completion.complete(book, proposals, ask(spark, FULL, (3, None, None, None, None, None, None, None, None, None, None), (2, "bob", None, None, None, None, None, None, None, None, None), (4, "bob", None, None, None, None, None, None, None, None, None)))
    assert {r.id: (r.status, r.completed_by) for r in book.table("tasks").collect()} == {1: ("COMPLETED", "ann"), 2: ("COMPLETED", None), 3: ("COMPLETED", "unknown"), 4: ("PENDING", None)}
    got = {(r.task_id, r.name): r.value for r in book.table("metrics").collect()}
    assert got == {
        (1, "decision.token_savings.absolute"): 100.0, (1, "decision.token_savings.percent"): 100 / 140, (1, "task.tokens.input"): 3.0, (1, "task.tokens.output"): 4.0,
        (1, "task.tokens.total"): 7.0, (1, "task.conversation.tokens.total"): 9.0, (3, "task.conversation.tokens.total"): 0.0,
    }
    assert [(r.task_id, r.considered, r.selected, r.winner) for r in book.table("decisions").collect()] == [(1, [10, 11], [11], 11)]
    assert sorted((r.task_id, r.role, r.tokens) for r in book.table("messages").collect()) == [(1, "system", 2), (1, "user", 7)] and book.table("snapshots").count() == 1


def test_refusals(spark, tasks):
    book, proposals = tasks
    req = lambda i, c, **k: (i, "x", c, k.get("selected"), k.get("winner"), k.get("rate"), None, None, None, None, None)
    cases = [(req(9, [10]), "task not found"), (req(2, [10]), "already completed"), (req(4, []), "consensus needs considered proposals"), (req(4, [77]), "proposal not found"), (req(4, [10]), "proposal of another task"), (req(4, [40], winner=10), "winner not considered"), (req(4, [40], selected=[41]), "selected not considered"), (req(4, [40], rate=1.5), "agreement rate out of range"), (req(4, [40]), None)]
    for row, why in cases:
        assert completion.judged(book.table("tasks"), proposals, ask(spark, row)).first().refused == why


@pytest.mark.parametrize("failing", [*completion.TABLES, "log"])
def test_a_failure_between_two_writes_leaves_nothing(spark, tasks, monkeypatch, failing):
    book, proposals = tasks
    before = {n: sorted(map(str, book.table(n).collect())) for n in completion.TABLES}
    real = completion.rows

    def broken(outcomes, messages):
        out = real(outcomes, messages)
        if failing in out:
            from pyspark.sql import functions as F

            first = out[failing].columns[0]
            out[failing] = out[failing].withColumn(first, F.raise_error(F.lit("disk full")).cast("long"))
        return out

    with monkeypatch.context() as m:
        m.setattr(completion, "rows", broken)
        if failing == "log":
            m.setattr(ledger.Ledger, "_create", lambda *a: (_ for _ in ()).throw(OSError("disk full")))
        with pytest.raises(Exception, match="disk full"):
            completion.complete(book, proposals, ask(spark, FULL))
    assert {n: sorted(map(str, book.table(n).collect())) for n in completion.TABLES} == before
    completion.complete(book, proposals, ask(spark, FULL))
    assert book.table("decisions").count() == 1 and book.table("metrics").count() == 6


def test_two_writers_complete_a_task_once(spark, tasks):
    book, proposals = tasks
    other, real = ledger.Ledger(spark, completion.TABLES, completion.KEYS, book.folder), ledger.Ledger._create
    done = []

    def slow(self, version, text):
        if self is book and not done:
            done.append(completion.complete(other, proposals, ask(spark, FULL)))
        return real(self, version, text)

    book._create = slow.__get__(book)
    completion.complete(book, proposals, ask(spark, FULL))
    assert book.table("decisions").count() == 1 and sum(r.name == "task.tokens.total" for r in book.table("metrics").collect()) == 1
