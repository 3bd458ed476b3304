"""Sources outside Spark's own readers, embedding, and what has no SQL: against hand-made files and plain versions."""

import io
import json
import os
import subprocess
import zipfile
import zlib

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from quillspark.operators import catalog as K
from quillspark.operators import consensus as CS
from quillspark.operators import context as X
from quillspark.operators import embedding as E
from quillspark.sources import documents as D
from quillspark.sources import files as FS
from quillspark.sources import git as G


def docx(*paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t><w:tab/><w:t>end</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def pdf(deflated):
    stream = rb"BT /F1 12 Tf 72 700 Td (Hello \(there\)) Tj 0 -14 Td [(Wor) -20 (ld\0412)] TJ T* <4F4B> Tj ET"
    body, extra = (zlib.compress(stream), b"/Filter /FlateDecode ") if deflated else (stream, b"")
    return b"%PDF-1.4\n1 0 obj\n<< " + extra + b"/Length %d >>\nstream\n" % len(body) + body + b"\nendstream\nendobj\n%%EOF"


def test_documents(spark):
    rows = [("a.docx", docx("One &amp; two", "Three")), ("b.PDF", pdf(True)), ("c.pdf", pdf(False)), ("d.docx", b"no zip"), ("e.pdf", None), ("f.txt", b"x")]
    got = {r.path: (r.text, r.problem) for r in D.extracted(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a.docx"] == ("One & two\tend\nThree\tend", None)
    assert got["b.PDF"] == got["c.pdf"] == ("Hello (there)\nWorld!2\nOK", None)
    assert got["d.docx"] == (None, "not a readable .docx") and got["e.pdf"][1] == "not a readable .pdf" and got["f.txt"][1] == "no extractor for .txt"


@pytest.fixture
def repo(tmp_path):
    run = lambda *a, at="2024-01-01T00:00:00Z": subprocess.run(
        ["git", "-C", str(tmp_path), *a], check=True, capture_output=True,
        env={**os.environ, "GIT_COMMITTER_DATE": at, "GIT_AUTHOR_DATE": at, "GIT_AUTHOR_NAME": "A", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "A", "GIT_COMMITTER_EMAIL": "a@x"},
    )
    run("init", "-q")
    for n, (files, at) in enumerate([({"a.txt": "1\n2\n", "b.txt": "b\n"}, "2024-01-01T00:00:00Z"), ({"a.txt": "1\ntwo\n"}, "2024-01-02T00:00:00Z"), ({"c.txt": "c\n"}, "2024-01-03T00:00:00Z")]):
        for name, text in files.items():
            (tmp_path / name).write_text(text)
        run("add", "-A")
        run("commit", "-qm", f"commit {n}", at=at)
    return str(tmp_path)


def test_git(spark, repo):
    log = G.log(spark, repo).orderBy(F.desc("at")).collect()
    assert [(r.message, sorted(r.files)) for r in log] == [("commit 2", ["c.txt"]), ("commit 1", ["a.txt"]), ("commit 0", ["a.txt", "b.txt"])]
    assert [r.message for r in G.log(spark, repo, "a.txt", 1).collect()] == ["commit 1"]
    lines = G.blame(spark, repo, "a.txt").orderBy("line").collect()
    assert [(r.line, r.text, r.commit) for r in lines] == [(1, "1", log[2].commit), (2, "two", log[1].commit)] and lines[0].author == "A"
    assert [r.message for r in FS.commits(G.log(spark, repo), "a.txt").collect()] == ["commit 1", "commit 0"]
    assert FS.blame(G.blame(spark, repo, "a.txt").select("path", "line", "commit"), G.log(spark, repo)).count() == 2


def test_scan_of_roots_and_links(spark, tmp_path):
    (tmp_path / "one/in").mkdir(parents=True)
    (tmp_path / "two").mkdir()
    (tmp_path / "one/in/a.txt").write_text("a")
    (tmp_path / "two/b.txt").write_text("b")
    one, two, gone = (str(tmp_path / n) for n in ("one", "two", "gone"))
    assert sorted(r.path.rsplit("/", 1)[-1] for r in FS.scan(spark, one, f"{one}/in", gone, two, one).collect()) == ["a.txt", "b.txt"]
    with pytest.raises(FileNotFoundError):
        FS.scan(spark, gone)
    os.symlink("in/a.txt", f"{one}/good")
    os.symlink(f"{two}/b.txt", f"{one}/out")
    os.symlink("loop", f"{one}/loop")
    assert FS.resolved(f"{one}/good", [one]).endswith("one/in/a.txt") and FS.resolved(f"{one}/out", [one]) is None and FS.resolved(f"{one}/out", [one, two]) and FS.resolved(f"{one}/loop", [one]) is None


def test_word_pieces_and_models(spark):
    vocabulary = {p: k for k, p in enumerate(["[UNK]", "[CLS]", "[SEP]", "play", "##ing", "##ed", "un", "##play", "!", "cafe"])}
    assert E.word_pieces("Playing, UNPLAYED! Café", vocabulary) == [1, 3, 4, 0, 6, 7, 5, 8, 9, 2]
    assert E.word_pieces("", vocabulary) == [1, 2] and len(E.word_pieces("play " * 900, vocabulary)) == 512 and E.word_pieces("play" * 30, vocabulary) == [1, 0, 2]
    d = spark.createDataFrame([(1, "one two two"), (2, None), (3, "two one two")], "id long, text string")
    got = {r.id: r for r in E.embedded(d, "id", "text", lambda: E.hashing_model(16), "h", batch=2).collect()}
    assert got[1].vector == got[3].vector and abs(np.linalg.norm(got[1].vector) - 1) < 1e-6 and not any(got[2].vector) and got[1].model == "h"


def test_reasoning_features(spark):
    doc = {"reasoning": "- one\n2. two\nPlan:", "steps": ["a", None, "b"], "inner": {"Risks": [["x"], "y"], "n": 3}, "pros": "a pitfall"}
    f = CS.proposal_features(doc)
    # two list lines, read once as such; "steps" has two items and is counted by name (three places) too; every object adds its names
    assert f["steps"] == 2 + 3 + 2 and f["sections"] == 4 + 2 + 1
    assert f["edges"] == 2 + 2 + 1 and f["trades"] == 0 and f["has_edge"] and not f["has_trade"]
    texts = ["- one\n2. two\nPlan:"] * 2 + ["a"] * 2 + ["b"] * 2 + ["x"] * 2 + ["y"] * 2 + ["a pitfall"]
    assert f["chars"] == len("\n".join(texts))
    d = spark.createDataFrame([(json.dumps(doc), 0.5), ("plain text with cons", 1.0), (None, 0.0)], "c string, k double")
    rows = d.select(CS.json_features(F.col("c")).alias("f"), "k").select("f", CS.reasoning_score(F.col("f"), F.col("k")).alias("s")).collect()
    want = (0.5 * (0.7 * f["chars"] / 1200 + 0.2 * 7 / 10 + 0.1 * 1) + 0.25 * (0.7 * 1 + 0.15)) * 0.75
    assert rows[0].f.asDict() == f and rows[0].s == pytest.approx(want)
    assert rows[1].f.has_trade and rows[1].s == pytest.approx(0.5 * 0.7 * 20 / 1200 + 0.25 * 0.15) and rows[2].s == 0


def test_numbers_by_ranges(spark):
    d = spark.range(0, 1000).select(F.xxhash64("id").alias("k"), "id").repartition(7)
    got = K.numbered(d, [F.asc("k")], "n", 5).orderBy("k").collect()
    assert [r.n for r in got] == list(range(5, 1005)) and K.numbered(d.limit(0), [F.asc("k")]).count() == 0


def test_grid_filters_and_reflection(spark):
    with pytest.raises(ValueError):
        K.extension_allowed(F.col("p"), ["a"], ["b"])
    tables = {"files": spark.range(1).withColumnRenamed("id", "file_id"), "links": spark.createDataFrame([(1, 2)], "source_file_id int, other int")}
    assert K.referring(tables, "file_id") == [("files", "file_id"), ("links", "source_file_id")]


def corpus(spark):
    from quillspark.plans import retrieval as P
    from quillspark.plans.registry import Tables

    t = Tables(spark, DATA)
    return P._corpus(t), P._asked(t)


def test_requests(spark):
    c, asked = corpus(spark)
    with pytest.raises(KeyError):
        X.gathered(c, asked, ("nobody",))
    with pytest.raises(ValueError):
        X.query_context(c, X.Request("  "))
    assert set(X.PROVIDERS) == {"full_text", "semantic", "symbol", "git_history", "hybrid"}


def test_diverse_hits_equal_a_plain_choice(spark):
    """The optimiser's order, chosen one by one from plain vectors."""
    c, asked = corpus(spark)
    asked.window, asked.diversity, asked.k, asked.path_boosts, asked.language_boosts = 0, 0.5, 8, {}, {}
    found = {r.chunk_id for r in X.query_context(c, asked).collect()}
    hits = X.gathered(c, asked).collect()
    best = {}
    for h in hits:
        best[h.chunk_id] = max(best.get(h.chunk_id, h), h, key=lambda x: x.score)
    top = sorted((h for h in best.values() if h.score >= 0.3), key=lambda h: (-h.score, h.file_path, h.chunk_id))[:8]
    vectors = {r.chunk_id: np.array(r.vector, float) / np.linalg.norm(r.vector) for r in c.vectors.collect()}
    chosen, used = [], 0
    while True:
        free = [h for h in top if h not in chosen and used + h.tokens <= asked.max_tokens]
        if not free:
            break
        near = lambda h: max((float(vectors.get(h.chunk_id, np.zeros(64)) @ vectors.get(o.chunk_id, np.zeros(64))) for o in chosen), default=0.0)
        pick = max(free, key=lambda h: (0.5 * h.score - 0.5 * near(h) if chosen else h.score, h.score, -h.chunk_id))
        chosen.append(pick)
        used += pick.tokens
    assert found == {h.chunk_id for h in chosen}
