"""What a worker keeps stays until a task lets it go."""

import threading

from quillspark.llm import workers


def test_kept_until_forgotten():
    made = []
    make = lambda: made.append(1) or len(made)
    workers.forget()
    assert workers.kept("a", make) == workers.kept("a", make) == 1
    workers.forget()
    assert not workers._state() and workers.kept("a", make) == 2
    workers.forget()


def test_nothing_runs_beside_the_task():
    before = threading.active_count()
    workers.kept("b", dict)
    assert threading.active_count() == before
    workers.forget()
