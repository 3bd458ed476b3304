"""All queries of the corpus operators on a folder of odd rows, and on one of empty tables."""

import hashlib

import pytest

from quillspark.llm import entries, warc

LONG = " ".join(f"word{k % 977}" for k in range(60_000))
DOCS = [
    (None, None, None, None, 1, "x"), (None, "", "en", "a", 1, "x"), (None, "no id, some words", "en", None, 1, "x"), (None, "no id, some words", "en", None, 1, "x"), (7, "one id\ntwo texts", "en", "a", 1, "x"),
    (7, "another text of the same id", "fr", "b", 1, "x"), (8, LONG, "en", "a", 1, "x"), (9, LONG, "en", "a", 1, "x"), (10, "12 34 !?", None, "", 1, "x"), (-(2**63), "smallest id é ü", "de", "b", 1, "x"), (11, " \t\n\n ", "de", "b", 1, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string"
PAGES = [(1, "u", None), (None, None, LONG), (2, "u\r\nX: y", LONG), (2, "u", LONG), (3, "", ""), (4, "é", "\0\x1f�" * 40)]
TALKS = [(1, 0, "user", LONG), (1, 0, "user", LONG), (1, None, None, None), (None, None, None, None), (None, 1, "assistant", "x"), (2, 1, "assistant", "")]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    made = []
    for n in (None, 0):
        out = str(tmp_path_factory.mktemp("tables"))
        tables = {
            "documents": (DOCS, SCHEMA), "pages": ([(*p, "clash") for p in PAGES], "page_id long, url string, html string, digest string"),
            "benchmark": ([(1, LONG[:400]), (None, "a benchmark item without an id of its own here"), (2, None)], "item_id long, text string"),
            "labels": ([(7, 1, 1, "clash"), (7, 0, 0, "y"), (8, 0, 0, "y"), (None, 1, 1, "y"), (9, None, None, "y"), (404, 0, 1, "y"), (11, 0, 5, "y")], "doc_id long, quality int, toxic int, score string"),
            "embeddings": ([(1, [0.5] * 64, 0, 9), (None, [0.25] * 64, 0, 9), (2, None, None, 9), (3, [None] * 64, 1, 9), (1, [0.5] * 64, 0, 9)], "vec_id long, embedding array<float>, label int, cluster int"),
            "conversations": ([(*c, "clash") for c in TALKS], "conv_id long, turn int, role string, text string, kind string"),
        }
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows[:n], schema).write.parquet(f"{out}/{name}.parquet")
        made.append(out)
    return made


@pytest.mark.parametrize("name", sorted(entries.QUERIES))
def test_odd_and_empty_tables(spark, folders, name):
    rows = entries.QUERIES[name](spark, folders[0]).collect()
    none = entries.QUERIES[name](spark, folders[1]).collect()
    per_row = {"op8_warc": len(PAGES), "op9_chat_formatting": 4, "op7_decontamination": 2, "op12_spelling_variants": 0, "op13_centroid_clustering": 3}.get(name, len(DOCS))
    assert len(rows) == per_row, rows
    assert [r.conv_id for r in none] == [-7] if name == "op9_chat_formatting" else none == []
    if per_row == len(DOCS):
        assert sorted((r.doc_id is not None, r.doc_id or 0) for r in rows) == sorted((d[0] is not None, d[0] or 0) for d in DOCS)


def test_what_odd_rows_give(spark, folders):
    run = lambda name: entries.QUERIES[name](spark, folders[0]).collect()
    langs = [(r.doc_id, r.lang_pred) for r in run("op1_language_id")]
    assert langs.count((None, "und")) == 2 and (10, "und") in langs and (11, "und") in langs and dict(langs)[8] != "und"
    removed = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in run("op5_repeated_substrings")}
    assert {(8, len(LONG), len(LONG), 1), (9, len(LONG), len(LONG), 1)} <= removed and all(n == 0 for i, _, n, _ in removed if i not in (8, 9))
    groups = {r.doc_id: (r.fingerprint, r.component_id) for r in run("op10_simhash_near_dup") if r.doc_id in (8, 9, 11)}
    assert groups[8] == groups[9] and groups[8][1] == 8 and groups[11] == ("0" * 16, 11)
    assert {(r.doc_id, r.item_id) for r in run("op7_decontamination")} == {(8, 1), (9, 1)}
    pages = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in run("op8_warc"))
    assert pages == [(0, len(LONG), "revisit", 2), (1, 0, "response", None), (2, len(LONG), "response", None), (2, len(LONG), "response", None), (3, 0, "response", None), (4, 200, "response", None)]
    talks = {r.conv_id: r for r in run("op9_chat_formatting")}
    assert talks[1].n_turns == 3 and talks[1].turns_sha256 == hashlib.sha256(f"\n\nuser\n{LONG}\nuser\n{LONG}\n".encode()).hexdigest()
    assert (talks[None].n_turns, talks[None].loss_chars, talks[2].loss_sha256) == (2, 1, hashlib.sha256(b"").hexdigest())


def test_warc_query_fails_on_quarantined_bytes(spark, folders, monkeypatch):
    write = warc.write_warc

    def damaged(pages, *args):
        files = write(pages, *args)
        path = files.first()["path"].removeprefix("file://")
        raw = bytearray(open(path, "rb").read())
        raw[len(raw) // 2] ^= 255
        open(path, "wb").write(raw)
        return files

    monkeypatch.setattr(warc, "write_warc", damaged)
    with pytest.raises(Exception, match="quarantined"):
        entries.QUERIES["op8_warc"](spark, folders[0]).collect()
