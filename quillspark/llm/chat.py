"""Chat formatting by event-sourced reconstruction.

A conversation is a log of events: ``message`` opens a message of a turn,
``delta`` appends to it, ``edit`` replaces its text, ``regenerate`` empties it for
the deltas that follow. The log is partitioned by conversation and turn, sorted by
sequence and folded in one streaming pass that holds one message at a time: events of
different turns never touch each other, so a long conversation is folded by many tasks. A
message renders as

    ### <role>:\\n<text></turn>\\n

Inside texts and roles every backslash is doubled and a backslash goes before
each ``###`` and ``</turn>`` (in roles also before each colon), so that neither can
occur there unescaped; unescaping takes the character behind each backslash.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import ship, written

ship(__name__)

OPEN, MIDDLE, CLOSE = "### ", ":\n", "</turn>\n"
_HEAD = re.compile(r"### ((?:[^\\:]++|\\.)*+):\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_END = re.compile(r"(?:[^\\<]++|\\.|<(?!/turn>))*+", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The rendered message, and where its escaped text begins and ends in code points."""
    head = OPEN + escape(role).replace(":", "\\:") + MIDDLE
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse(rendered: str) -> list[tuple[str, str]]:
    """(role, text) of every message of a rendered conversation."""
    at, out = 0, []
    while at < len(rendered):
        head = _HEAD.match(rendered, at)
        if not head:
            raise ValueError(f"no message at {at}")
        end = _END.match(rendered, head.end()).end()
        if not rendered.startswith(CLOSE, end):
            raise ValueError(f"message at {at} has no end")
        out.append((unescape(head[1]), unescape(rendered[head.end() : end])))
        at = end + len(CLOSE)
    return out


def fold(events):
    """(conv_id, role, text) of final messages from sorted events (conv_id, turn, kind, role, text).

    A delta, edit or regenerate that no message of its turn precedes opens one.
    """
    at, role, parts = None, "", []
    for conv, turn, kind, who, text in events:
        if kind == "message" or (conv, turn) != at:
            if at:
                yield at[0], role, "".join(parts)
            at, role, parts = (conv, turn), who or "", []
        if kind in ("edit", "regenerate"):
            parts = []
        if kind != "regenerate" and text:
            parts.append(text)
    if at:
        yield at[0], role, "".join(parts)


def streamed_log(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) as the log of a server that streamed them, written to the shared folder.

    Every text starts as a draft; it is then either edited and regenerated, and streamed in three deltas, or regenerated,
    edited to its first third and continued by two deltas. ``seq`` is one sequence over all conversations,
    in the order of conv_id, turn (nulls first), role and text; on disk the events lie in no order.
    """
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    plain = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ranked = plain.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    third = F.ceil(F.length("text") / 3).cast("int")
    piece = [F.substring("text", third * k + 1, third) for k in range(3)]
    draft, wrong = F.concat(F.lit("a draft: "), F.reverse(F.substring("text", 1, 16))), F.lit("not this")
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.cast("string").alias("text"))
    none, rest = F.lit(None), [event("delta", p) for p in piece[1:]]
    again = F.array(event("message", draft), event("delta", wrong), event("edit", wrong), event("regenerate", none), event("delta", piece[0]), *rest)
    edited = F.array(event("message", draft), event("regenerate", none), event("delta", wrong), event("edit", piece[0]), *rest)
    log = ranked.select("conv_id", "turn", "role", "at", F.posexplode(F.when(F.col("at") % 2 == 0, again).otherwise(edited)).alias("k", "e"))
    events = log.select("conv_id", "turn", (F.col("at") * 8 + F.col("k")).alias("seq"), "e.kind", "role", "e.text")
    return written(events.repartition(F.xxhash64("seq")).sortWithinPartitions(F.xxhash64("seq")), "chat-log")


def format_chats(events: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Rendered messages of ``events`` (conv_id, turn, seq, kind, role, text), written to the shared folder.

    Gives (conv_id, pos, rendered, loss_start, loss_end): ``pos`` orders the
    messages of a conversation, the span is in code points and null for messages
    outside the loss. Null texts and roles are empty; null ids and turns sort
    first and null ids make one conversation; equal turns keep the order of seq,
    role and text, so repeated rows are messages of their own. A text may be of any length; memory is bounded by the
    longest message. Other columns are not read, so their names cannot clash. An empty table gives an empty result.
    """

    def run(batches):
        def rows():
            for b in batches:
                yield from zip(*[c.to_pylist() for c in b.columns], strict=True)

        held, pos = [], TaskContext.get().partitionId() << 40  # the ranges of the partitions are in order
        for c, role, text in fold(rows()):
            pos += 1
            whole, a, b = render(role, text)
            lost = role in loss_roles
            held.append((c, pos, whole, a if lost else None, b if lost else None))
            if len(held) == 1000:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    turn = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn")]
    order = [*turn, F.asc_nulls_first("seq"), F.asc_nulls_first("role"), F.asc_nulls_first("text")]
    dealt = events.repartitionByRange(*turn).sortWithinPartitions(*order).select("conv_id", "turn", "kind", "role", "text")
    return written(dealt.mapInArrow(run, _SCHEMA), "chats")


_SCHEMA = "conv_id long, pos long, rendered string, loss_start long, loss_end long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["conv_id", "pos", "rendered", "loss_start", "loss_end"])


def read_chats(formatted: DataFrame) -> DataFrame:
    """Digests of every conversation, parsed from its rendered messages in one streaming pass; none for an empty table.

    A digest reads its conversation from start to end, so one task has one conversation, of which it holds one message. Null ids are
    one conversation; repeated rows count each; other columns are not read.
    """

    def run(batches):
        state, out = None, []
        for b in batches:
            for conv, rendered, a, z in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if state is None or state[0] != conv:
                    if state:
                        out.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(rendered):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                if a is not None:
                    lost = unescape(rendered[a:z])
                    state[3] += len(lost)
                    state[4].update(lost.encode())
                state[5] += len(rendered)
            if out:
                yield _digests(out)
                out = []
        if state:
            yield _digests([*out, state])

    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return dealt.select("conv_id", "rendered", "loss_start", "loss_end").mapInArrow(run, schema)


def _digests(states: list[list]) -> pa.RecordBatch:
    rows = [(c, n, t.hexdigest(), k, s.hexdigest(), f) for c, n, t, k, s, f in states]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
