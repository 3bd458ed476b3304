"""The mix against a plain version that goes word by word, with targets found by bisection."""

import collections
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import entries, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string"


def chained(*values, seed=42):
    """Spark's xxhash64 of values one after the other: each hash is the seed of the next; nulls are passed over."""
    h = seed
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v, h)
    return h - 2**64 if h >= 2**63 else h


def int4(v):
    return struct.pack("<i", v)


def int8(v):
    return None if v is None else struct.pack("<q", v)


def unsigned(h):
    return h % 2**64


def brute_targets(sizes, share=1.5, most=2.0):
    weights = [(5, 2, 1)[k % 3] for k in range(len(sizes))]
    total, low, high = share * sum(sizes), 0.0, share * sum(sizes) + 1
    given = lambda unit: [min(unit * w, most * s) for w, s in zip(weights, sizes, strict=True)]
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(given(mid)) < total else (low, mid)
    return given(high)


def brute_permuted(j, n, key, rounds=20):
    x = j
    for r in range(rounds):
        partner = (chained(int8(key), int4(r)) % n - x) % n
        if chained(int8(key), int4(r), int8(max(x, partner))) % 2 == 1:
            x = partner
    return x


def brute_mix(rows, block, seed=17):
    """taken by row, and the words of every slot of every source as (row, place) pairs."""
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    targets = brute_targets([sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in names])
    taken, slots = [0] * len(rows), {}
    for s, (name, target) in enumerate(zip(names, targets, strict=True)):
        mine = [k for k, r in enumerate(rows) if r[2] == name]
        text = lambda k: chained(None if rows[k][1] is None else rows[k][1].encode())
        order = sorted(mine, key=lambda k: (chained(int4(seed), int8(rows[k][0]), int8(text(k))), size[k], rows[k][0] is not None, rows[k][0] or 0))
        stream = [(k, w) for k in order for w in range(size[k])]
        blocks = [stream[i : i + block] for i in range(0, len(stream), block)]
        full, left, ordinal = len(stream) // block, round(target), 0
        while left > 0:
            epoch, j = divmod(ordinal, len(blocks))
            if j < full:
                key = chained(int4(seed), b"epoch", int4(s), int8(epoch))
                j = brute_permuted(j, full, key)
            words = blocks[j][:left]
            slots[s, ordinal] = words
            left, ordinal = left - len(words), ordinal + 1
            for k, _ in words:
                taken[k] += 1
    return names, targets, taken, slots


def sample(seed):
    rnd = random.Random(seed)
    rows = [(k, " ".join(["w"] * rnd.randint(0, 120)), rnd.choice(["a", "b", "é", None])) for k in range(70)]
    return [*rows, (200, None, "a"), (201, "", "z"), (None, "x y z", "a"), (7, "one two", "a"), (7, "one two", "a"), (300, "lone", "only")]


@pytest.mark.parametrize("seed", [1, 2])
def test_taken_equals_the_plain_version(spark, seed):
    rows = sample(seed)
    names, targets, taken, _ = brute_mix(rows, 16)
    got = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA), block_words=16).collect()
    by = dict(zip(names, targets, strict=True))
    assert all(abs(r.target - by[r.source]) < 1e-3 for r in got)
    want = collections.Counter((r[0], r[2], len(WORD.findall(r[1] or "")), k) for r, k in zip(rows, taken, strict=True))
    assert collections.Counter((r.doc_id, r.source, r.size, r.taken) for r in got) == want


def shards(spark, rows, **how):
    found = mixing.mix_shards(spark.createDataFrame(rows, SCHEMA), block_words=16, shard_slots=20, **how).collect()
    return collections.Counter((r.shard, r.source, r.ordinal, r.doc_id, r.lo, r.hi) for r in found)


def test_draws_decide_what_shards_hold(spark):
    rows = [r for r in sample(3) if r[0] not in (7, None)]
    names, targets, taken, slots = brute_mix(rows, 16)
    one, same, other = shards(spark, rows), shards(spark, rows), shards(spark, rows, draw_seed=5)
    assert one == same and one != other
    for found in (one, other):
        words = collections.Counter()
        for (_, source, ordinal, doc, lo, hi), n in found.items():
            for w in range(lo, hi):
                words[source, ordinal, doc, w] += n
        want = collections.Counter((names[s], ordinal, rows[k][0], w) for (s, ordinal), ws in slots.items() for k, w in ws)
        assert words == want  # every slot holds the words of the plain version, whatever shard it is in
    counts = lambda found: collections.Counter({(s, src): 0 for s, src, *_ in found}) + collections.Counter((s, src) for s, src, _ in {(f[0], f[1], f[2]) for f in found})
    drawn = mixing._draws(spark, [len([1 for s, _ in slots if s == k]) for k in range(len(names))], 20, mixing.SEED).collect()
    per = collections.Counter({(r.shard, names[r["__s"]]): r.n for r in drawn})
    total, quota = collections.Counter(), collections.Counter()
    for (_, src), n in per.items():
        total[src] += n
    for (_, src), n in counts(one).items():
        quota[src] += n
    for key, n in counts(one).items():
        if total[key[1]]:
            assert abs(n - per[key] * quota[key[1]] / total[key[1]]) <= 1
    first = {}
    for shard, _, _, doc, _, _ in one:
        first[doc] = min(shard, first.get(doc, shard))
    got = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA), block_words=16, shard_slots=20).collect()
    assert {r.doc_id: r.first_shard for r in got} == {r[0]: first.get(r[0]) for r in rows}


def test_sources_that_no_shard_draws(spark, monkeypatch):
    """With every draw gone to one source, the others' slots are spread evenly and the totals stay."""
    rows = [r for r in sample(4) if r[0] not in (7, None)]
    _, _, taken, _ = brute_mix(rows, 16)
    monkeypatch.setattr(mixing, "_alias", lambda p: ([0.0] * len(p), [0] * len(p)))
    found = shards(spark, rows)
    got = collections.Counter()
    for (_, _, _, doc, lo, hi), n in found.items():
        got[doc] += n * (hi - lo)
    assert got == +collections.Counter({r[0]: k for r, k in zip(rows, taken, strict=True)})
    assert len({s for s, src, *_ in found if src == "b"}) > 1


def test_nothing_to_mix(spark):
    none = spark.createDataFrame([(1, None, "a"), (2, " ", None)], SCHEMA)
    assert [(r.taken, r.target, r.first_shard) for r in mixing.mix_sources(none).collect()] == [(0, 0.0, None)] * 2
    assert mixing.mix_shards(none).count() == 0 and mixing.mix_shards(none.limit(0)).count() == 0


def test_query_columns(spark):
    from conftest import DATA

    out = entries.op3_source_mixing(spark, DATA)
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken", "first_shard"]
    assert out.filter((F.col("taken") > 0) == F.col("first_shard").isNull()).count() == 0
