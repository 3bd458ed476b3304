"""Line dedup, quality rules, mixing, language ID and repeated strings against brute force."""

import collections
import random
import re

import pytest
from compare import assert_same
from conftest import DATA
from pyspark.sql import functions as F

from quillspark.llm import entries, langid, linededup, mixing, quality, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h int, kept int, s string"
BLANK, WORD = " \t\n\x0b\f\r", re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, None, "en", "a"), (2, "", "en", None), (None, "Same line\nother", None, "a"), (4, "same LINE\nother\n", "en", "b"), (4, "same LINE\nother\n", "en", "b"),
    (5, "  SAME line\t\n\n\n", "fr", "b"), (6, "É same\nKK\nİx\nSTRASSE ß", "fr", "a"), (7, "é same\nkk\nİX\nstrasse ß", "fr", None), (8, "word " * 3000, "en", "a"), (9, "x" * 5000, "en", "a"),
    (10, " \nnbsp", "en", "b"), (11, " \x0b\x0c ", "en", "b"),
]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, la, s, 0, 1, 2, "z") for i, t, la, s in rows], SCHEMA)


def low(x):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in x)


def brute_lines(rows, least):
    keys = lambda t: [low(x.strip(BLANK)) for x in (t or "").split("\n")]
    n = collections.Counter(k for r in rows for k in set(keys(r[1])) if k)
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x, k in zip(lines, keys(r[1]), strict=True) if not (k and n[k] >= least)]
        out.append((r[0], "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("least", "batches", "fanout", "broadcast"), [(2, 4, 2, 100), (3, 1, 2, 0), (2, 5, 3, 0), (99, 2, 2, 9)])
def test_line_dedup(spark, least, batches, fanout, broadcast):
    out = linededup.dedup_lines(docs(spark, ODD), least, batches, fanout, broadcast)
    assert {"lang", "h", "s"} <= set(out.columns)
    assert sorted(((r.doc_id, r.kept, r.n_lines, r.n_dropped) for r in out.collect()), key=repr) == brute_lines(ODD, least)


@pytest.mark.parametrize("name", ["op2_line_dedup", "op4_quality_rules", "op8_warc", "op9_chat_formatting"])
def test_queries_with_sql(spark, duck, name):
    df = entries.QUERIES[name](spark, DATA)
    assert_same(df.collect(), df.columns, duck.execute(entries.ORACLES[name]))


def brute_measures(t):
    t = t or ""
    w = WORD.findall(t)
    grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark):
    rnd = random.Random(3)
    rows = [*ODD, *[(100 + k, " ".join(rnd.choice(["ab", "c#", "d\n"]) for _ in range(rnd.randint(0, 60))), "en", "a") for k in range(40)]]
    out = quality.quality_rules(docs(spark, rows)).collect()
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
    want = collections.Counter((i, *(m := brute_measures(t)), m[0] < 20 or 100 * m[4] > 30 * m[0]) for i, t, _, _ in rows)
    assert got == want and not [r for r in out if r.kept and r.base_failed]


def test_quality_thresholds_are_those_of_groups(spark):
    plain = [(k, f"some plain words that make a text of ordinary kind {k} " + " ".join(f"w{k}x{j}" for j in range(30)), "en", "a") for k in range(150)]
    junk = [(900, " ".join(f"w{j}###" for j in range(40)), "en", "a")]
    kept = {r.doc_id for r in quality.quality_rules(docs(spark, plain + junk)).filter("kept").collect()}
    assert kept == set(range(150))


def test_sketch_buckets(spark):
    v = spark.range(0, 5000).withColumn("b", quality.bucket_of(F.col("id"))).withColumn("top", quality.bucket_top(F.col("b")))
    for r in v.collect():
        assert r.top <= r.id and (r.id - r.top) * 32 <= r.id


def test_water_filling():
    assert mixing.water_fill([100, 100, 100], [5, 2, 1], 300, 2) == pytest.approx([187.5, 75, 37.5])
    assert mixing.water_fill([10, 100, 100], [5, 2, 1], 300, 2) == pytest.approx([20, 186.6667, 93.3333], rel=1e-5)
    assert mixing.water_fill([0, 0], [5, 2], 0, 2) == [0, 0]


@pytest.mark.parametrize("bin_rows", [1, 5, 4000])
def test_mixing(spark, bin_rows):
    rnd = random.Random(5)
    rows = [*ODD, *[(50 + k, "w " * rnd.randint(0, 400), "en", rnd.choice(["a", "b", "c", None])) for k in range(60)]]
    columns = ["doc_id", "source", "size", "source_size", "target", "taken"]

    def run():
        mixed = mixing.mix_sources(docs(spark, rows).select("doc_id", "text", "source"), block_words=16, bin_rows=bin_rows)
        return sorted((tuple(r) for r in mixed.select(*columns).collect()), key=repr)

    got = run()
    assert got == run() and len(got) == len(rows)
    size = collections.Counter()
    for _, t, _, s in rows:
        size[s] += len(WORD.findall(t or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    targets = dict(zip(names, mixing.water_fill([size[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 1.5 * sum(size.values()), 2), strict=True))
    taken = collections.Counter()
    for _, s, n, whole, target, k in got:
        assert whole == size[s] and target == pytest.approx(targets[s]) and 0 <= k <= 2 * n
        taken[s] += k
    assert all(abs(taken[s] - targets[s]) <= 1 for s in names)


def test_mixing_permutation_is_one(spark):
    for n in (1, 2, 7, 100):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3)).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))


def test_mixed_documents_hold_what_the_mix_takes(spark):
    rnd = random.Random(6)
    rows = [(k, " ".join(f"w{k}_{j}" for j in range(rnd.randint(0, 300))), "en", rnd.choice("abc")) for k in range(50)]
    rows += [rows[0], rows[0], (None, "null id here", "en", "a"), (77, None, "en", None)]
    d = docs(spark, rows)
    want = collections.Counter()
    for r in mixing.mix_sources(d, block_words=16).collect():
        want[r.doc_id] += r.taken
    got = collections.Counter()
    texts = {i: t for i, t, _, _ in rows}
    for r in mixing.mixed_documents(d, block_words=16).collect():
        words = WORD.findall(r.text)
        got[r.doc_id] += len(words)
        assert words and r.n_chars == len(r.text) and set(words) <= set(WORD.findall(texts[r.doc_id])) and len(words) == len(set(words))
    assert +want == +got


def test_language_id(spark):
    held = spark.read.parquet(f"{DATA}/documents.parquet")
    out = entries.op1_language_id(spark, DATA).join(held.select("doc_id", "lang", "text"), "doc_id").filter(F.length("text") > 200).collect()
    assert sum(r.lang_pred == r.lang for r in out if r.held_out) >= 0.9 * sum(r.held_out for r in out) > 0
    assert all(0 <= r.score <= 1 for r in out)


def test_language_id_odd_rows(spark):
    d = docs(spark, ODD)
    table = langid.train_dictionaries(d)
    assert set(table) == {"en", "fr"}
    got = {r.doc_id: r for r in langid.identify(d.select("doc_id", "text", F.lit(1).alias("score")), table).collect()}
    assert len(got) == len({r[0] for r in ODD}) and got[1].lang_pred == got[2].lang_pred == got[11].lang_pred == "und" and got[6].lang_pred in table
    assert langid.train_dictionaries(d.limit(0)) == {} and langid.identify(d.select("doc_id", "text"), {}).first().lang_pred == "und"


def brute_repeats(texts, size):
    n = collections.Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        mask = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if n[t[i : i + size]] > 1:
                mask[i : i + size] = b"\1" * size
        out.append((bytes(b for b, m in zip(t, mask, strict=True) if not m), sum(mask), len(re.findall(b"\x01+", bytes(mask)))))
    return out


def test_columns_find_all_repeats():
    rnd = random.Random(1)
    for trial in range(80):
        alphabet = b"ab" if trial % 2 else b"abcdefgh\xff\x00"
        base = bytes(rnd.choice(alphabet) for _ in range(60))
        texts = [base[(a := rnd.randint(0, 40)) : a + rnd.randint(0, 40)] + bytes(rnd.choice(alphabet) for _ in range(rnd.randint(0, 20))) for _ in range(rnd.randint(1, 12))]
        size = rnd.choice([1, 3, 8])
        n = collections.Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
        want = [[i for i in range(len(t) - size + 1) if n[t[i : i + size]] > 1] for t in texts]
        assert [x.tolist() for x in substrings.repeated_starts(texts, size)] == want


@pytest.mark.parametrize("how", [{}, {"sieve_anchors": 0}, {"most_in_group": 1}, {"batch_bytes": 1}])
def test_repeated_strings(spark, how):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 9))) for _ in range(300)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    shared, other = text(60), text(45)
    rows = [(k, text(rnd.randint(0, 60)) + (shared[rnd.randint(0, 90) :] if k % 2 else other) + text(rnd.randint(0, 50)), "en", "a") for k in range(25)]
    rows += [*ODD, (60, "a" * 900, "en", "a"), (61, "a" * 199, "en", "a"), (62, shared + shared, "en", "a"), (63, rows[3][1], "en", "a"), (64, "ab" * 300, "en", "a")]
    got = substrings.remove_repeats(docs(spark, rows), size=200, **how).collect()
    want = [(i, *b, len((t or "").encode())) for (i, t, _, _), b in zip(rows, brute_repeats([(t or "").encode() for _, t, _, _ in rows], 200), strict=True)]
    assert sorted(((r.doc_id, bytes(r.kept), r.n_removed, r.n_spans, r.n_bytes) for r in got), key=repr) == sorted(want, key=repr)


def hash32_twins(spark, n=200_000):
    """Two numbers that Spark's 32-bit hash of the text around them does not tell apart."""
    body = F.concat(F.lit("t"), F.col("id").cast("string"), F.lit(" "), F.repeat(F.lit("lorem ipsum dolor "), 20))
    found = spark.range(n).select("id", F.hash(body).alias("h")).groupBy("h").agg(F.collect_list("id").alias("ids")).filter(F.size("ids") > 1)
    return sorted(found.first().ids)[:2]


def test_repeats_of_rows_with_equal_short_hashes(spark):
    a, b = (f"t{k} " + "lorem ipsum dolor " * 20 for k in hash32_twins(spark))
    apart = "".join(chr(33 + k * k * 7 % 90) + str(k) for k in range(150))
    rows = [(None, a, "en", "a"), (None, b, "en", "a"), (None, apart, "en", "a"), (-(2**63), apart[:150], "en", "a"), (None, None, "en", "a")]
    got = substrings.remove_repeats(docs(spark, rows), size=200).collect()
    want = [(i, *x) for (i, _, _, _), x in zip(rows, brute_repeats([(t or "").encode() for _, t, _, _ in rows], 200), strict=True)]
    assert sorted(((r.doc_id, bytes(r.kept), r.n_removed, r.n_spans) for r in got), key=repr) == sorted(want, key=repr)


def test_crowded_groups_are_parted(spark, monkeypatch):
    """Passages in very many contexts, and copies of one row, with every heavy key broadcast."""
    from quillspark.llm import skew

    rnd = random.Random(8)
    noise = lambda n: "".join(rnd.choice("abcdefghij klmnopqrst") for _ in range(n))
    passage, line = noise(230), noise(190)
    rows = [(k, noise(rnd.randint(0, 250)) + (passage, line, passage[: rnd.randint(150, 229)])[k % 3] + noise(rnd.randint(0, 250)), "en", "a") for k in range(90)]
    rows += [(7, passage + noise(40), "en", "a")] * 1 + [(None, line + passage, "en", "a")] * 30
    heavy = skew.heavy_keys
    monkeypatch.setattr(substrings, "heavy_keys", lambda c, k, n, **_: heavy(c, k, n, 10, 2))
    want = sorted(((i, *x) for (i, _, _, _), x in zip(rows, brute_repeats([t.encode() for _, t, _, _ in rows], 200), strict=True)), key=repr)
    for most in (2, 20):
        got = substrings.remove_repeats(docs(spark, rows), size=200, most_in_group=most).collect()
        assert sorted(((r.doc_id, bytes(r.kept), r.n_removed, r.n_spans) for r in got), key=repr) == want


def test_long_texts_are_cut_in_pieces():
    rnd = random.Random(4)
    raw = bytes(rnd.choice(b"abcd ") for _ in range(5000))
    for piece in (300, 777, 1 << 20):
        starts = [k for s, e, _, _ in substrings.text_segments(raw, 200, piece) for a, b in zip(s, e, strict=True) for k in range(a, b + 1)]
        assert starts == list(range(len(raw) - 199))


@pytest.mark.parametrize("run", [linededup.dedup_lines, quality.quality_rules, mixing.mix_sources, mixing.mixed_documents, substrings.remove_repeats])
def test_empty_tables(spark, run):
    assert run(docs(spark, []).select("doc_id", "text", "lang", "source")).count() == 0
