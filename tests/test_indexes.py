"""Term table, vector cells, exact percentiles, frequent pairs, diversity: each against its plain form."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import cells, metrics, retrieval, terms

SCHEMA = "chunk_id long, file_id long, ordinal int, token_count int, kind string, content string, summary string"
FILES = "file_id long, abs_path string, language string, is_deleted boolean"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    parts = ["foo", "bar", "foo_bar", "xfoo", "foofoo", "a_a_a", "é", "naïve", "FOO", "Bar", "1", "ß", "the", "x" * 30]
    rows = []
    for n in range(400):
        body = "".join(rng.choice(parts) + rng.choice([" ", "  ", "-", "", "_", ".", "é", "\n"]) for _ in range(rng.randint(0, 25)))
        rows.append((n, n % 40, n // 40, 5, "TABLE" if n % 3 else "PARAGRAPH", body, rng.choice([None, "src/foo.txt", "bar/Foo"])))
    rows += [(900, 1, 99, 1, "TABLE", None, "foo bar"), (901, 1, 100, 1, "TABLE", "", None), (902, 1, 101, 1, "TABLE", "foo " * 40_000 + "bar", "s"), (903, 39, 1, 1, "TABLE", "foo bar", "deleted")]
    files = [(n, f"p/{n}.txt", "en", n == 39) for n in range(40)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(files, FILES)


@pytest.mark.parametrize("few", [True, False])
def test_full_text_equals_the_scan(corpus, monkeypatch, few):
    chunks, files = corpus
    if not few:  # as with more terms and chunks than are named or broadcast
        monkeypatch.setattr(terms, "NAMED", 0), monkeypatch.setattr(terms, "FEW_CHUNKS", 0), monkeypatch.setattr(terms, "ROOM", 1)
    table = terms.build_terms(chunks)
    for query, summary in [("foo", True), ("foo bar", False), ("bar foo", True), ("a_a", False), ("foo_bar foo", False), ("nothing foo", False), ("naïve", False), ("the", False), ("src txt", True)][:: 1 if few else 3]:
        want = retrieval.full_text(chunks, files, query, summary=summary).select("chunk_id", "file_path", "tokens", "score")
        got = terms.full_text(table, files, query, summary=summary).select("chunk_id", "file_path", "tokens", "score")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), (query, summary)
    some = terms.full_text(table, files, "foo", where=F.col("abs_path").startswith("p/1"), kinds=("TABLE",))
    assert sorted(r.chunk_id for r in some.collect()) == sorted(r.chunk_id for r in retrieval.full_text(chunks.filter("kind = 'TABLE'"), files, "foo", F.col("abs_path").startswith("p/1")).collect())


def test_full_text_reads_no_texts(spark, corpus):
    chunks, files = corpus
    plan = terms.full_text(terms.build_terms(chunks), files, "foo bar")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "In(term, [" in plan


def test_term_table_follows_its_files(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    put = lambda text: spark.createDataFrame([(1, 1, 0, 1, "K", text, "s")], SCHEMA).write.mode("overwrite").parquet(path)
    ask = lambda q: [r.chunk_id for r in terms.search(terms.terms_of_table(spark.read.parquet(path), path, lambda d: d), q).collect()]
    put("alpha beta")
    assert ask("alpha") == [1] and ask("gamma") == []
    one = terms.terms_of_table(spark.read.parquet(path), path, lambda d: d)
    assert terms.terms_of_table(spark.read.parquet(path), path, lambda d: d) is one
    put("gamma delta and more")
    assert ask("alpha") == [] and ask("gamma") == [1]


def test_empty_corpus(spark):
    table = terms.build_terms(spark.createDataFrame([], SCHEMA))
    assert terms.search(table, "foo bar").collect() == []


def grouped(seed, n, size=16):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(12, size))
    return [(k, [float(x) for x in middles[k % 12] + 0.05 * rng.normal(size=size)], "document" if k % 5 == 0 else "code", "m" if k % 2 else "o") for k in range(n)]


def test_cells_equal_the_scan_and_skip_files(spark):
    rows = grouped(1, 600) + [(7000, [0.0] * 16, "code", "m"), (7001, None, "code", "m"), (7002, [1.0], "code", "m"), (7003, [float("nan")] * 16, "code", "m"), (7004, [None] * 16, "code", "m"), (3, grouped(1, 4)[3][1], "code", "m")]
    vectors = spark.createDataFrame(rows, "chunk_id long, vector array<double>, language string, model string")
    table = cells.build_cells(vectors, 16)
    assert table.n.sum() == 601 and table.zeros == 2
    plain = lambda df: [(r.chunk_id, r.score) for r in df.collect()]
    for query in (rows[0][1], [-x for x in rows[5][1]], [0.0] * 16):
        for how in ({"k": 5}, {"k": 60, "least": 0.0}, {"k": 3, "least": 0.0, "model": "m"}, {"k": 700, "least": -1.0}, {"k": 4, "where": F.col("language") == "document"}):
            want = [x for x in plain(retrieval.semantic(vectors, query, **how)) if x[0] != 7003]  # a NaN is at 0 to a query of length 0 alone
            assert plain(cells.semantic(table, query, **how)) == want, how
    few = cells.visited(table, rows[0][1], 5, 0.3, 1.35, lambda v: retrieval.semantic(v, rows[0][1], 5))
    assert table.share(few) < 0.5
    found = cells.semantic(table, rows[0][1], k=5)
    assert "PartitionFilters: [cell" in found._jdf.queryExecution().executedPlan().toString()


def test_nearest_of_many_queries(spark):
    rows = grouped(2, 300)
    vectors = spark.createDataFrame(rows, "chunk_id long, vector array<double>, language string, model string")
    asked = spark.createDataFrame([(r[0], r[1]) for r in rows[::20]] + [(-1, None), (-2, [0.0] * 16), (-3, [1.0])], "query_id long, vector array<double>")
    found = {}
    for r in cells.nearest(cells.build_cells(vectors, 16), asked, 7).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = r.chunk_id
    unit = np.array([np.array(r[1]) / np.linalg.norm(r[1]) for r in rows])
    want = {n: dict(enumerate(sorted(range(300), key=lambda k: (-round(float(unit[n] @ unit[k]), 9), k))[:7], 1)) for n in range(0, 300, 20)}
    assert found == want


def test_nearest_by_units(spark, monkeypatch):
    """Units in parts, copies beyond k, vectors at cosine 0 and ungrouped ones; pairs are summed in tasks, not by an expression for each pair."""
    monkeypatch.setattr(cells, "UNIT", 8)
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.normal(size=16)]) for k in range(120)] + [(k, [1.0] * 16) for k in range(120, 200)] + [(k, [0.0] * 16) for k in range(200, 230)] + [(230, [None] + [1.0] * 15)]
    vectors = spark.createDataFrame(rows, "chunk_id long, vector array<double>")
    asked = [rows[0], rows[17], rows[125], (-1, [-1.0] * 16), (-2, [float("inf")] * 16)]
    table = cells.build_cells(vectors, 16)
    got = cells.nearest(table, spark.createDataFrame(asked, "query_id long, vector array<double>"), 60)
    found = sorted((r.query_id, r["rank"], r.chunk_id, r.cosine) for r in got.collect())
    unit = [np.zeros(16) if None in v or not any(v) else np.array(v) / np.linalg.norm(v) for _, v in rows]
    want = []
    for q, v in asked[:4]:
        cos = [round(float(np.array(v) / np.linalg.norm(v) @ u), 9) + 0.0 for u in unit]
        want += [(q, n, k, c) for n, (c, k) in enumerate(sorted(((c, k) for k, c in enumerate(cos)), key=lambda x: (-x[0], x[1]))[:60], 1)]
    assert [x[:3] for x in found] == [x[:3] for x in sorted(want)]
    assert all(abs(a[3] - b[3]) < 2e-9 for a, b in zip(found, sorted(want), strict=True))
    assert "zip_with" not in got._jdf.queryExecution().optimizedPlan().toString().lower().replace("zipwith", "zip_with")


@pytest.mark.parametrize("seed", range(4))
def test_percentiles(spark, seed, monkeypatch):
    monkeypatch.setattr(metrics, "LEFT", 5)
    monkeypatch.setattr(metrics, "PARTS", 16)
    rng = random.Random(seed)
    draw = [lambda: rng.gauss(0, 1), lambda: rng.choice([7.0, 7.0, 7.0, rng.random()]), lambda: 10 ** rng.uniform(-300, 300) * rng.choice([1, -1]), lambda: rng.choice([float("inf"), float("-inf"), float("nan"), 1.0, rng.random(), -1e308, 1e308])][seed]
    rows = [(rng.choice(["a", "b", None]), draw()) for _ in range(500)] + [("c", None), ("d", 3.0)]
    df = spark.createDataFrame(rows, "g string, value double")
    order = lambda v: (v != v, v if v == v else 0)
    disc = lambda vs, q: sorted(vs, key=order)[max(int(np.ceil(q * len(vs))), 1) - 1]
    same = lambda a, b: a == b or (a != a and b != b)
    for q in (0.0, 0.5, 0.99):
        assert same(metrics.exact_percentile(df, q).first()[0], disc([v for _, v in rows if v is not None], q))
        got = {r.g: r[1] for r in metrics.percentile_by(df, q, ["g"], parts=8).collect()}
        want = {g: disc([v for h, v in rows if h == g and v is not None], q) for g in ("a", "b", None, "d")}
        assert got.keys() == want.keys() and all(same(got[g], want[g]) for g in want)
    assert metrics.exact_percentile(df.limit(0), 0.5).collect()[0][0] is None


def plain_pairs(rows, least):
    of = {}
    for c, f in set(rows):
        if c is not None and f is not None:
            of.setdefault(c, set()).add(f)
    counts = Counter(p for fs in of.values() for p in itertools.permutations(sorted(fs), 2))
    return {(*p, n) for p, n in counts.items() if n >= least}


@pytest.mark.parametrize("least", [1, 2, 3])
def test_co_changes(spark, least, monkeypatch):
    monkeypatch.setattr(retrieval, "TILE", 4)
    rng = random.Random(least)
    rows = [(c, f) for c in range(60) for f in rng.sample(range(40), rng.randint(1, 6))] + [(99, f) for f in range(40)] + [(98, f) for f in range(40)] + [(None, 1), (1, None), (1, 1), (1, 1)]
    got = retrieval.co_changes(spark.createDataFrame(rows, "commit long, file long"), least)
    assert {(r.file, r.other, r.n) for r in got.collect()} == plain_pairs(rows, least)
    assert retrieval.co_changes(spark.createDataFrame([], "commit long, file long")).collect() == []


def test_a_commit_of_very_many_files(spark):
    """100,000 files: all but those that change together once more are left out before a pair is made."""
    small = [(c, c * 3 + k) for c in range(200) for k in range(3)]
    rows = spark.range(100_000).select(F.lit(-1).cast("long").alias("commit"), F.col("id").alias("file")).unionByName(spark.createDataFrame(small, "commit long, file long"))
    got = retrieval.co_changes(rows, 2).collect()
    assert len(got) == 200 * 6 and {r.n for r in got} == {2}


def test_mmr_equals_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(q, k, round(float(rng.random()), 3), int(rng.integers(1, 40)), rng.normal(size=6).tolist()) for q in "ab" for k in range(30)]
    rows += [("a", 90, rows[0][2], 3, rows[0][4]), ("c", 1, 0.5, 999, [0.0] * 6)]
    got = {}
    for r in retrieval.mmr(spark.createDataFrame(rows, "q string, chunk_id long, score double, tokens int, vector array<double>"), "q", 8, 0.6, 150).collect():
        got.setdefault(r.q, {})[r["rank"]] = r.chunk_id
    want = {}
    for q in "abc":
        own = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))
        unit = [np.array(r[4]) / max(np.linalg.norm(r[4]), 1e-12) for r in own]
        chosen, used = [], 0
        while len(chosen) < 8:
            free = [i for i in range(len(own)) if i not in chosen and used + own[i][3] <= 150]
            if not free:
                break
            value = lambda i, unit=unit, own=own, chosen=chosen: own[i][2] if not chosen else round(0.6 * own[i][2] - 0.4 * max(float(unit[i] @ unit[j]) for j in chosen), 9)
            best = max(free, key=lambda i: (value(i), own[i][2], -i))
            chosen.append(best)
            used += own[best][3]
        if chosen:
            want[q] = {n + 1: own[i][1] for n, i in enumerate(chosen)}
    assert got == want


def test_fusion_ranks_every_hit(spark):
    rows = [("p", n, "f", float(-n)) for n in range(3000)] + [("q", n, "f", float(n)) for n in range(0, 3000, 3)]
    hits = spark.createDataFrame(rows, "provider string, chunk_id long, file_path string, score double")
    got = {r.chunk_id: r.score for r in retrieval.fuse(hits).collect()}
    rank_q = {n: k for k, n in enumerate(sorted(range(0, 3000, 3), reverse=True), 1)}
    want = {n: 1 / (60 + n + 1) + (1 / (60 + rank_q[n]) if n in rank_q else 0) for n in range(3000)}
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-12 for n in want)
    assert {r.chunk_id for r in retrieval.fuse(hits, limit=10).collect()} == set(range(10)) | set(sorted(rank_q, reverse=True)[:10])


def test_keywords_are_terms():
    assert T.keywords("naïve a_a FOO") == ["na", "ve", "a_a", "foo"]
