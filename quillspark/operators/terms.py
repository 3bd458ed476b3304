"""Full text by a term table: which chunks hold a word, and where, without reading their texts.

A term is a longest run of letters a-z, digits and underscores of a lower-cased text. A keyword is made of these characters alone, so a text
holds it exactly where one of its terms does. The table of terms is small beside the texts; the postings (term, field, chunk, places) are sorted by term
and chunk over ranges, so that a common term lies in many files and a rare one in a part of one. A query finds the terms that hold its keywords, reads
their postings, the rarest keyword's first, and scores phrases by places.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.retrieval import once
from quillspark.session import ship, written

ship(__name__)

_TERM = re.compile("[a-z0-9_]+")
#: Terms that are named to the scan of the postings; chunks of the rarest keyword that are broadcast; terms that come to the driver (of more, only sums).
NAMED, FEW_CHUNKS, ROOM = 500, 200_000, 20_000


def spots_of(low: str) -> dict[str, list[int]]:
    """Places of the terms of a lower-cased text: 4 times the place, from 1, plus 2 for a letter or digit before the term, 1 for one behind it."""
    found: dict[str, list[int]] = {}
    alnum = lambda c: c.isalpha() or c.isdecimal()
    for m in _TERM.finditer(low):
        a, b = m.span()
        before, behind = a > 0 and alnum(low[a - 1]), b < len(low) and alnum(low[b])
        found.setdefault(m.group(), []).append((a + 1) * 4 + 2 * before + behind)
    return found


@dataclass
class TermTable:
    """``chunks`` with ``n_chars`` beside their own columns, ``postings`` (term, field, chunk_id, spots) and ``terms`` (term, n): the number of postings."""

    chunks: DataFrame
    postings: DataFrame
    terms: DataFrame


def build_terms(chunks: DataFrame, fields: tuple[str, ...] = ("content", "summary")) -> TermTable:
    """Write the chunks, the postings of their ``fields`` and the terms.

    A null text has no terms. The chunk's id may be any number; repeated rows have a posting each. A term that many chunks have is
    cut in ranges by chunk.
    """
    stored = written(chunks.withColumn("n_chars", F.length(fields[0])), "chunks")
    lowered = stored.select("chunk_id", *(F.lower(f).alias(f) for f in fields))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                term, field, chunk, spots = [], [], [], []
                part = b.slice(at, 2000)
                for k in range(len(fields)):
                    for name, low in zip(part.column(0).to_pylist(), part.column(k + 1).to_pylist(), strict=True):
                        found = spots_of(low) if low else {}
                        term += found.keys()
                        spots += found.values()
                        field += [k] * len(found)
                        chunk += [name] * len(found)
                yield pa.RecordBatch.from_pydict({"term": pa.array(term, pa.string()), "field": pa.array(field, pa.int32()), "chunk_id": pa.array(chunk, pa.int64()), "spots": pa.array(spots, pa.list_(pa.int32()))})

    raw = written(lowered.mapInArrow(run, "term string, field int, chunk_id long, spots array<int>"), "postings-raw")  # ranges are drawn from it
    postings = written(raw.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id"), "postings")
    counted = postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return TermTable(stored, postings, written(counted, "terms"))


_KNOWN: dict[tuple[str, str, int, int], TermTable] = {}


def _state(table: DataFrame) -> tuple[int, int]:
    """What tells one state of a table's files from another: a sum over their names, sizes and times."""
    m = F.col("_metadata")
    each = table.select(F.xxhash64(m["file_path"], m["file_size"], m["file_modification_time"]).alias("h")).distinct()
    row = each.agg(F.coalesce(F.sum(F.shiftright("h", 16)), F.lit(0)), F.count(F.lit(1))).first()
    return row[0], row[1]


def terms_of_table(table: DataFrame, name: str, chunked) -> TermTable:
    """The term table of ``chunked(table)``, built when first asked for and again when the files of ``table`` have changed; it lasts as long as the application."""
    key = (table.sparkSession.sparkContext.applicationId, name, *_state(table))
    if key not in _KNOWN:
        _KNOWN[key] = build_terms(chunked(table))
    return _KNOWN[key]


def _sizes(terms: DataFrame, words: list[str]) -> list[tuple[int, int, list[str]]]:
    """(postings, k, terms if they are few) of each word that a term holds, the rarest first: from the table of terms alone."""
    each = F.array(*(F.when(F.contains("term", F.lit(w)), F.lit(k)) for k, w in enumerate(words)))
    matched = terms.select("term", "n", F.explode(F.filter(each, lambda k: k.isNotNull())).alias("k"))
    few = matched.limit(ROOM + 1).collect()
    if len(few) > ROOM:
        return sorted((r.n, r.k, []) for r in matched.groupBy("k").agg(F.sum("n").alias("n")).collect())  # a row for each keyword
    by_word: dict[int, list] = {}
    for r in few:
        by_word.setdefault(r.k, []).append(r)
    return sorted((sum(r.n for r in rows), k, [r.term for r in rows] if len(rows) <= NAMED else []) for k, rows in by_word.items())


def _postings(table: TermTable, word: str, k: int, names: list[str]) -> DataFrame:
    """(k, chunk_id, field, places): where a word stands in each chunk; a place has ``at``, ``left`` and ``right`` (whether no letter or digit is beside it)."""
    size, postings = len(word), table.postings
    if names:
        postings = postings.filter(F.col("term").isin(names))  # reaches the scan, which skips the files and row groups of other terms
    edge = lambda at: F.substring("term", at, F.lit(1)) == "_"
    inside = F.filter(F.sequence(F.lit(1), F.length("term") - size + 1), lambda i: F.substring("term", i, F.lit(size)) == word)

    def place(spot: Column, i: Column) -> Column:
        left = F.when(i == 1, spot.bitwiseAND(2) == 0).otherwise(edge(i - 1))
        right = F.when(i + size > F.length("term"), spot.bitwiseAND(1) == 0).otherwise(edge(i + size))
        return F.struct((F.shiftright(spot, 2) + i - 1).alias("at"), left.alias("left"), right.alias("right"))

    met = postings.filter(F.contains("term", F.lit(word)))
    return met.select(F.lit(k).alias("k"), "chunk_id", "field", F.flatten(F.transform("spots", lambda s: F.transform(inside, lambda i: place(s, i)))).alias("places"))


def _lexical(places: list[Column], words: list[str]) -> Column:
    """The score of ``text.lexical_score`` from the sorted places of each word."""

    def count(k: int) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        alone = lambda p, acc: p["left"] & p["right"] & (p["at"] >= acc["end"])
        step = lambda acc, p: F.struct(F.when(alone(p, acc), p["at"] + len(words[k])).otherwise(acc["end"]).alias("end"), (acc["n"] + F.when(alone(p, acc), 1).otherwise(0)).alias("n"))
        return F.aggregate(places[k], start, step)["n"]

    def onward(own: Column, size: int):
        """The scan's next step: the word's first place from where the last one ended (places are sorted), 0 if there is none."""

        def step(s: Column) -> Column:
            found = F.try_element_at(F.filter(own, lambda p: p["at"] >= s["at"]), F.lit(1))
            place = lambda p: F.coalesce(p["at"], F.lit(0))
            parted = lambda p: F.coalesce(p["left"] & p["right"], F.lit(False))
            return T.let(
                found,
                lambda p: F.struct((place(p) + size).alias("at"), (s["ok"] & parted(p)).alias("ok"), F.when(s["first"] == 0, place(p)).otherwise(s["first"]).alias("first")),
            )

        return step

    def score(counts: Column) -> Column:
        total = F.aggregate(counts, F.lit(0), lambda acc, x: acc + x)
        partial = F.least(F.lit(0.5), total / (2.0 * len(words)))
        if len(words) < 2:
            return F.when(total == 0, 0.0).otherwise(partial)
        state = F.struct(F.lit(1).alias("at"), F.lit(True).alias("ok"), F.lit(0).alias("first"))
        for k, w in enumerate(words):
            state = T.let(state, onward(places[k], len(w)))
        phrase = T.let(state, lambda p: p["ok"] & (p["at"] - p["first"] <= 50))
        return F.when(total == 0, 0.0).when(phrase, 0.95).when(F.forall(counts, lambda c: c > 0), 0.7).otherwise(partial)

    return T.let(F.array(*map(count, range(len(words)))), score)


def search(table: TermTable, query: str, summary: bool = False) -> DataFrame:
    """(chunk_id, lex): chunks whose content, or summary too if ``summary``, has all keywords of the query, and the lexical score of the content."""
    spark, words = table.terms.sparkSession, T.keywords(query)
    nothing = spark.createDataFrame([], "chunk_id long, lex double")
    if not words:
        return nothing
    sizes = _sizes(table.terms, words)
    if len(sizes) < len(words):
        return nothing
    allowed = F.lit(True) if summary else F.col("field") == 0
    of = {k: _postings(table, words[k], k, names).filter(allowed) for _, k, names in sizes}
    (n, rarest, _), *rest = sizes
    found = of[rarest]
    ids = found.select("chunk_id").distinct()
    for size, k, _ in rest:
        # where the rarest word is much rarer, its chunks are all that is left of the others
        found = found.unionByName(of[k].join(F.broadcast(ids) if n <= FEW_CHUNKS else ids, "chunk_id", "left_semi") if size > 8 * n else of[k])
    mine = lambda k: F.flatten(F.collect_list(F.when((F.col("k") == k) & (F.col("field") == 0), F.col("places"))))
    have = found.groupBy("chunk_id").agg(F.countDistinct("k").alias("have"), *(mine(k).alias(f"p{k}") for k in range(len(words)))).filter(F.col("have") == len(words))
    placed = have.select("chunk_id", *(F.array_sort(f"p{k}").alias(f"p{k}") for k in range(len(words))))
    return placed.select("chunk_id", _lexical([F.col(f"p{k}") for k in range(len(words))], words).alias("lex"))


def full_text(table: TermTable, files: DataFrame, query: str, where: Column | None = None, summary: bool = False, kinds: tuple[str, ...] = ()) -> DataFrame:
    """The hits of ``retrieval.full_text`` from the term table, without their text: (provider, chunk_id, file_id, ordinal, file_path, language, tokens, score)."""
    meta = table.chunks.select("chunk_id", "file_id", "ordinal", "token_count", "kind", "n_chars")
    met = meta.join(search(table, query, summary), "chunk_id")
    score = F.least(F.lit(1.0), F.col("lex") * T.length_idf(T.keywords(query))) * F.when(F.col("n_chars") < 50, 0.3).otherwise(1.0)
    scored = once(met.filter(F.col("kind").isin(list(kinds))) if kinds else met, "score", score).filter("score > 0")
    hits = scored.join(files.filter(~F.col("is_deleted")), "file_id").withColumn("file_path", F.col("abs_path"))
    return (hits.filter(where) if where is not None else hits).select(F.lit("full_text").alias("provider"), "chunk_id", "file_id", "ordinal", "file_path", "language", F.col("token_count").alias("tokens"), "score")
