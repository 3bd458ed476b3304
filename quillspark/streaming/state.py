"""Stateful streams: waiting for proposals, and workflow states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.operators.tasks import TRANSITIONS
from quillspark.session import ship

ship(__name__)


def _milliseconds(span: str) -> int:
    amount, unit = span.split()
    return int(amount) * {"millisecond": 1, "second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]


def awaited(proposals: DataFrame, wanted: int, timeout: str = "10 minutes") -> DataFrame:
    """(task_id, n, outcome): ``complete`` once a task has ``wanted`` proposals, ``timeout`` when its event time runs out.

    ``proposals`` has task_id and ts with a watermark; the timer starts with the first.
    """
    wait = _milliseconds(timeout)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        row = lambda n, what: pd.DataFrame([(key[0], n, what)], columns=["task_id", "n", "outcome"])
        if state.hasTimedOut:
            (n, _) = state.get
            state.remove()
            if n >= 0:
                yield row(n, "timeout")
            return
        n, due = state.get if state.exists else (0, 0)
        for b in batches:
            n += len(b) if n >= 0 else 0
            due = due or int(b.ts.min().timestamp() * 1000) + wait
        if n >= wanted:
            yield row(n, "complete")
            n = -1  # told; later proposals are late
        state.update((n, due))
        if due > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(due)

    return proposals.groupBy("task_id").applyInPandasWithState(step, "task_id long, n long, outcome string", "n long, due long", "append", GroupStateTimeout.EventTimeTimeout)


def workflow_states(changes: DataFrame) -> DataFrame:
    """(task_id, seq, status, accepted) of each change request (task_id, seq, status): only allowed transitions are taken."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, out = (state.get[0] if state.exists else None), []
        for b in batches:
            for r in b.sort_values("seq").itertuples():
                ok = r.status == "PENDING" if now is None else r.status in TRANSITIONS.get(now, ())
                now = r.status if ok else now
                out.append((key[0], r.seq, r.status, ok))
        if now is not None:
            state.update((now,))
        yield pd.DataFrame(out, columns=["task_id", "seq", "status", "accepted"])

    return changes.groupBy("task_id").applyInPandasWithState(step, "task_id long, seq long, status string, accepted boolean", "status string", "append", GroupStateTimeout.NoTimeout)
