"""Spelling variants: against brute force over all pairs, the keys themselves, and odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import entries, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(docs):
    counts = Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_groups(docs):
    words = plain_words(docs)
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def found(spark, docs):
    rows = spelling.spelling_groups(spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, n int")).collect()
    assert len({r.word for r in rows}) == len(rows)
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("seed,letters", [(0, "abé"), (1, "aab"), (2, "abcdef×ÿ"), (3, "aB")])
def test_equals_brute_force(spark, seed, letters, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 64)
    rng = random.Random(seed)
    pool = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 8))) for _ in range(60)]
    weights = [5 ** rng.randint(0, 5) for _ in pool]
    docs = [(n, " -1_Ω".join(rng.choices(pool, weights, k=rng.randint(0, 300)))) for n in range(60)]
    assert len(want := plain_groups(docs)) > 20
    assert found(spark, docs) == want


def test_chains_and_ties(spark):
    counts = {"abcdefg": 5, "abcdefgh": 25, "abcdefghi": 125, "abcdefghij": 625, "zzzzzz": 5, "zzzzzzz": 25, "zzzzzy": 25, "qqqqqq": 5, "qqqqqqq": 24}
    docs = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(counts.items())]
    assert not any(zlib.crc32(f"{k}:{w}".encode()) % 199 == 0 for k, w in enumerate(counts))
    rows = {r[0]: r for r in found(spark, docs)}
    assert rows == {r[0]: r for r in plain_groups(docs)}
    assert rows["abcdefg"][1:3] == ("abcdefgh", "abcdefghij") and rows["zzzzzz"][1] == "zzzzzy" and rows["qqqqqq"][1] is None


def test_odd_rows(spark):
    long = "a" * 30_000
    docs = [(None, None), (None, ""), (1, "Ünïcodé " * 5), (None, "nameless " * 5), (None, "nameless " * 5), (2, f"{long} " * 5 + f"{long}a " * 30), (3, "short " * 9), (4, "LOWERED lowered Lowered " * 2), (5, "word日本word " * 9)]
    rows = found(spark, docs)
    assert rows == plain_groups(docs) and (long, long + "a", long + "a", 5, 1, 30) in rows and not [r for r in rows if r[0].startswith("word")]
    assert found(spark, []) == set() and found(spark, docs[:2]) == set()


def test_deletion_rule_is_met(spark):
    """Some run of some document loses a letter, in the null document too."""
    word = next(w for n in range(9999) if zlib.crc32(f":{(w := 'word' + chr(97 + n % 26) * (2 + n // 26))}".encode()) % 199 == 0)
    docs = [(None, f"{word} " * 6)]
    assert found(spark, docs) == plain_groups(docs) and len(next(iter(plain_words(docs)))) == len(word) - 1


def test_keys():
    words = ["aabbcc", "abcabc", "zzzzzz"]
    letters = np.frombuffer("".join(words).encode(), np.uint8).reshape(3, 6)
    by_key = {}
    for row, key, first, last in zip(*spelling.deletion_keys(letters), strict=True):
        w = words[row]
        string = w if first < 0 else w[:first] + w[first + 1 :]
        assert first < 0 or string == w[:last] + w[last + 1 :]
        by_key.setdefault(int(key), set()).add(string)
    assert all(len(s) == 1 for s in by_key.values()) and len(by_key) == 3 + 3 + 6 + 1
    five = np.frombuffer(b"zzzzz", np.uint8).reshape(1, 5)
    assert spelling.deletion_keys(five)[1][-1] in {k for r, k, f, _ in zip(*spelling.deletion_keys(letters), strict=True) if r == 2 and f == 0}


def test_collisions_link_nothing():
    members = [("abcdef", 9, -1, -1), ("abcdefg", 5, 6, 6), ("uvwxyz", 7, -1, -1), ("uvwxyzz", 5, 5, 6), ("uvwxyaz", 5, 5, 5)]
    near = spelling.near_of(members)
    assert near == {"abcdef": (1, 5, "abcdefg"), "abcdefg": (1, 9, "abcdef"), "uvwxyz": (2, 5, "uvwxyaz"), "uvwxyzz": (2, 7, "uvwxyz"), "uvwxyaz": (2, 7, "uvwxyz")}


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = entries.QUERIES["op12_spelling_variants"](spark, folder).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == plain_groups(docs)
