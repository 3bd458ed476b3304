"""Language ID against plain sums of compressed sizes, and dictionaries that stay within their bounds."""

import random

import zstandard
from conftest import DATA
from pyspark.sql import functions as F

from quillspark.llm import entries, langid


def brute_prediction(text, dictionaries):
    """Every 2 KB of the lower-cased text compressed once for each dictionary, smallest sum first, learned order on ties."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    raw, sums = text.lower().encode(), []
    for lang, d in dictionaries.items():
        total = 0
        for k in range(0, len(raw), 2048):
            known = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            packer = zstandard.ZstdCompressor(level=6, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)
            total += len(packer.compress(raw[k : k + 2048]))
        sums.append((total, lang))
    best = min(s for s, _ in sums)
    others = sorted(s for s, _ in sums)
    second = others[1] if len(others) > 1 else len(raw)
    return next(lang for s, lang in sums if s == best), max(0, second - best) / max(1, second)


def test_query_equals_plain_sums(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rest = F.expr("crc32(encode(cast(doc_id AS string), 'UTF-8')) % 4")
    table = langid.train_dictionaries(docs.filter(rest != 2).select("doc_id", "text", "lang"))
    texts = {r.doc_id: r for r in docs.withColumn("rest", rest).collect()}
    got = entries.op1_language_id(spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        lang, score = brute_prediction(texts[r.doc_id].text, table)
        assert (r.lang_pred, r.held_out) == (lang, texts[r.doc_id].rest == 2) and abs(r.score - min(1.0, score)) < 1e-12


def test_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    rest = F.expr("crc32(encode(cast(doc_id AS string), 'UTF-8')) % 4")
    other = docs.withColumn("text", F.when(rest == 2, F.lit("zzz qqq " * 50)).otherwise(F.col("text")))
    assert langid.train_dictionaries(docs.filter(rest != 2)) == langid.train_dictionaries(other.filter(rest != 2))


def test_very_many_languages(spark):
    rnd = random.Random(1)
    rows = [(k, " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(40)), f"l{k % 450:03d}") for k in range(900)]
    rows += [(None, "ein text", "de"), (None, "ein text", "de"), (1000, None, "de"), (1001, "12 34", "xx"), (1002, "words", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    table = langid.train_dictionaries(docs, dict_bytes=1000, all_bytes=90_000)
    assert len(table) == 451 and sum(map(len, table.values())) <= 90_000 and "xx" not in table
    few = langid.train_dictionaries(docs, max_langs=3)
    assert len(few) == 3
    found = langid.identify(docs.withColumn("decided", F.lit(1)).withColumn("h", F.lit("x")), few)
    assert found.columns == ["doc_id", "lang", "h", "lang_pred", "score", "margin", "rejected", "decided"]
    assert {r.lang_pred for r in found.collect()} <= {*few, "und"} and found.count() == len(rows)
    assert langid.identify(docs.limit(0), few).count() == 0
