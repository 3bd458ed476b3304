"""Toxicity by weak supervision: many voters, a generative model of them, a linear classifier trained on its posterior labels.

1. Lexicons are mined from a bounded sample of labelled rows: words, beginnings and ends of words that far more toxic texts have than others.
2. Voters look at a text: two for each family of terms (some, many of its words are in the lexicon) and four fixed patterns. Their votes over
   all training texts are counted by pattern, 65,536 patterns at most.
3. A latent-class model explains these counts: a class for each text, a rate of each voter for each class, voters that go together within a class
   in blocks with a joint table, and the given labels as one more voter with errors of its own. EM estimates all of it.
4. A logistic regression on rates of terms learns the posterior labels of the sample and scores every text.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillspark.session import quoted, ship, written

ship(__name__)

PIECE, WORDS_KEPT = 1 << 20, 300_000
_WORD, _OUTSIDE = re.compile(r"[^\W\d_]+"), re.compile(r"[\W\d_]")
#: Families of terms: a whole word, its first letters, its last letters.
FAMILIES = (("word", 0), ("first", 4), ("first", 5), ("first", 6), ("first", 7), ("last", 5))
#: Insults of four languages, for the pattern voters alone (a fixed list of this library).
INSULTS = (
    "idiot", "moron", "stupid", "dumb", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "fool", "jerk",
    "dummkopf", "trottel", "abschaum", "blödmann", "idiote", "imbécile", "crétin", "ordure", "idiota", "estúpido", "imbécil", "basura",
)
_SHOUT, _MARKS = re.compile(r"\b[A-ZÀ-Þ]{4,}\b"), re.compile(r"!{3}")
_ADDRESS = re.compile(r"\b(?:you|your|du|dein|deine|tu|ton|vous|votre|tú|usted|eres)\b(?:\W+\w+){0,3}?\W+(?:" + "|".join(INSULTS) + r")\b")
VOTERS = tuple(f"{kind}{size or ''}_{much}" for kind, size in FAMILIES for much in ("some", "many")) + ("insult", "address", "shouting", "marks")
#: Voters that may share one joint table of 2**BLOCK entries; least correlation within a class that joins two blocks.
BLOCK, LEAST_CORRELATION = 4, 0.1


def words_of(text: str) -> Counter:
    """The lower-cased words of a whole text, counted piece by piece."""
    low, found, at = text.lower(), Counter(), 0
    while at < len(low):
        end = at + PIECE
        if end < len(low):
            gap = _OUTSIDE.search(low, end)
            end = gap.start() if gap else len(low)
        found.update(_WORD.findall(low, at, end))
        at = end
    return found


def terms_of(word: str) -> list[str]:
    """The terms of a word, each with the number of its family in front."""
    out = [f"0{word}"] if len(word) <= 24 else []
    for k, (kind, size) in enumerate(FAMILIES[1:], 1):
        if len(word) > size:
            out.append(f"{k}{word[:size] if kind == 'first' else word[-size:]}")
    return out


class Lexicon:
    """The mined terms: what a text has of them, and the fixed patterns."""

    def __init__(self, terms: list[str]):
        self.number = {t: k for k, t in enumerate(terms)}
        self.words: dict[str, tuple[tuple[int, ...], tuple[int, ...]]] = {}

    def _of(self, word: str):
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= WORDS_KEPT:
                self.words.clear()
            known = [t for t in terms_of(word) if t in self.number]
            found = self.words[word] = tuple(self.number[t] for t in known), tuple(int(t[0]) for t in known)
        return found

    def evidence(self, text: str | None) -> tuple[int, list[int], int, list[int], list[int]]:
        """Number of words, hits of each family, bits of the fixed patterns, numbers and counts of the terms found."""
        words = words_of(text or "")
        hits, found = [0] * len(FAMILIES), {}
        for word, n in words.items():
            terms, families = self._of(word)
            for t in terms:
                found[t] = found.get(t, 0) + n
            for f in families:
                hits[f] += n
        total, fixed = sum(words.values()), 0
        if any(w in words for w in INSULTS):
            fixed = 1 | (2 if _ADDRESS.search(text.lower()) else 0)
        if text:
            loud = sum(1 for _ in _SHOUT.finditer(text))
            fixed |= (4 if loud >= 5 and 10 * loud >= 3 * total else 0) | (8 if _MARKS.search(text) else 0)
        at = sorted(found)
        return total, hits, fixed, at, [found[t] for t in at]


def votes(n_words: np.ndarray, hits: np.ndarray, fixed: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The votes of texts as bits: for each family, two hits at least and a rate above its first, its second limit; then the patterns."""
    rates = hits / np.maximum(n_words, 1)[:, None]
    bits = (hits >= 2)[:, :, None] & (rates[:, :, None] > limits[None])
    flat = bits.reshape(len(n_words), -1)
    return flat.astype(np.int64) @ (1 << np.arange(flat.shape[1])) + (fixed.astype(np.int64) << flat.shape[1])


class LabelModel:
    """A latent class for each text; voters in blocks that are independent within a class; labels as a voter that may err."""

    def __init__(self, n_voters: int):
        self.blocks, self.n = [[k] for k in range(n_voters)], n_voters

    def _tables(self, patterns: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Smoothed log-probabilities of every block's outcomes in each class (columns of ``weight``)."""
        out = []
        for block in self.blocks:
            at = sum(((patterns >> v) & 1) << k for k, v in enumerate(block))
            counts = np.stack([np.bincount(at, weight[:, y], 1 << len(block)) for y in (0, 1)]) + 0.5 / (1 << len(block))
            out.append(np.log(counts / counts.sum(1, keepdims=True)))
        return out

    def _posterior(self, patterns: np.ndarray, labels: np.ndarray) -> np.ndarray:
        score = np.log([1 - self.prior, self.prior]) + np.zeros((len(patterns), 2))
        for block, table in zip(self.blocks, self.tables, strict=True):
            at = sum(((patterns >> v) & 1) << k for k, v in enumerate(block))
            score += table[:, at].T
        for label in (0, 1):
            score[labels == label] += np.log(self.said[:, label])
        return 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -50, 50)))

    def _em(self, patterns, labels, counts, p, rounds):
        for _ in range(rounds):
            weight = np.stack([counts * (1 - p), counts * p], 1)
            self.prior = float(np.clip(weight[:, 1].sum() / counts.sum(), 1e-4, 1 - 1e-4))
            self.tables = self._tables(patterns, weight)
            self.said = np.array([[weight[labels == z, y].sum() + 0.5 for z in (0, 1)] for y in (0, 1)])
            self.said /= self.said.sum(1, keepdims=True)
            after = self._posterior(patterns, labels)
            if np.abs(after - p).max() < 1e-6:
                return after
            p = after
        return p

    def correlations(self, patterns: np.ndarray, counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The correlation of each two voters within the classes, weighed by the classes."""
        votes = (patterns[:, None] >> np.arange(self.n)) & 1
        total, out = counts.sum(), np.zeros((self.n, self.n))
        for w in (counts * (1 - p), counts * p):
            if w.sum() > 0:
                mean = w @ votes / w.sum()
                cov = (votes * w[:, None]).T @ votes / w.sum() - np.outer(mean, mean)
                sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
                out += w.sum() / total * cov / np.outer(sd, sd) * ((sd > 1e-5)[:, None] & (sd > 1e-5))
        np.fill_diagonal(out, 0)
        return out

    def fit(self, patterns: np.ndarray, labels: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
        """``labels`` is 0, 1 or -1 (not given) for each row of pattern and count; labelled rows start the estimate."""
        known = {z: np.where(labels == z, counts, 0).sum() for z in (0, 1)}
        base = known[1] / max(1, known[0] + known[1])
        with_one = {q: 0.0 for q in np.unique(patterns)}
        seen = dict(with_one)
        for q, z, n in zip(patterns, labels, counts, strict=True):
            if z >= 0:
                seen[q] += n
                with_one[q] += n * z
        start = np.array([(with_one[q] + 2 * base) / (seen[q] + 2) for q in patterns])
        while True:
            settled = self.correlations(patterns, counts, self._em(patterns, labels, counts, start, rounds))
            # one round from what the labels say tells which voters go together: more could take them for the classes
            found = np.abs(self.correlations(patterns, counts, self._em(patterns, labels, counts, start, 1)))
            of = {v: b for b in self.blocks for v in b}
            apart = [(i, j) for i, j in itertools.combinations(range(self.n), 2) if of[i] is not of[j] and len(of[i]) + len(of[j]) <= BLOCK]
            if not apart or max(abs(settled[ij]) for ij in apart) < LEAST_CORRELATION:
                break
            i, j = max(apart, key=lambda ij: found[ij])
            if found[i, j] < LEAST_CORRELATION:
                break
            self.blocks = [b for b in self.blocks if b is not of[i] and b is not of[j]] + [of[i] + of[j]]
        self._em(patterns, labels, counts, start, rounds)
        return self

    def rates(self) -> np.ndarray:
        """How often each voter votes in each class."""
        out = np.zeros((self.n, 2))
        for block, table in zip(self.blocks, self.tables, strict=True):
            for k, v in enumerate(block):
                out[v] = np.exp(table)[:, [(o >> k) & 1 == 1 for o in range(1 << len(block))]].sum(1)
        return out

    def posterior(self, patterns: np.ndarray, labels: np.ndarray) -> np.ndarray:
        return self._posterior(patterns, labels)


def features(n_words: np.ndarray, hits: np.ndarray, rows: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of what the classifier sees: hits of families, then terms, for each 100 words, 5 at most."""
    n = n_words + 10.0
    own = np.repeat(np.arange(len(n)), hits.shape[1])
    row, column = np.concatenate([own, rows]), np.concatenate([np.tile(np.arange(hits.shape[1]), len(n)), terms + hits.shape[1]])
    value = np.minimum(5.0, 100.0 * np.concatenate([hits.reshape(-1), counts]) / n[row])
    return row, column, value


def fit_linear(x: tuple[np.ndarray, np.ndarray, np.ndarray], p: np.ndarray, weight: np.ndarray, size: int, rounds: int = 400, l2: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression on posterior labels ``p``, the last one being the constant: full batches, Adam steps."""
    row, column, value = x
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    weight = weight / weight.sum()
    base = float(np.clip((weight * p).sum(), 1e-4, 1 - 1e-4))
    w[size] = np.log(base / (1 - base))
    for t in range(1, rounds + 1):
        z = np.bincount(row, value * w[column], len(p)) + w[size]
        error = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - p)
        grad = np.append(np.bincount(column, value * error[row], size), error.sum()) + l2 * np.append(w[:size], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sampled(docs: DataFrame, labels: DataFrame, per_label: tuple[int, int]) -> tuple[DataFrame, list[int], list[int]]:
    """A written sample of labelled texts (h, toxic, text), so many of each label at most; how many texts have the label, and how many were taken."""
    n = [0, 0]
    for r in labels.groupBy("toxic").count().collect():
        n[r.toxic] = r["count"]
    h, space = F.xxhash64(F.lit(11), "doc_id"), 1 << 30
    parts = []
    for y in (0, 1):
        share = min(space, 2 * per_label[y] * space // max(1, n[y]) + 64)  # as many again as are wanted, so that sorting them is cheap
        parts.append(labels.filter(F.col("toxic") == y).select("doc_id", "toxic", h.alias("h")).filter(F.pmod("h", F.lit(space)) < share).orderBy("h", "doc_id").limit(per_label[y]))
    chosen = written(parts[0].unionByName(parts[1]), "toxic-chosen")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # as many rows as per_label at most
    made = written(rows.groupBy("h", "doc_id", "toxic").agg(F.min("text").alias("text")).select("h", "doc_id", "toxic", "text"), "toxic-sample")
    taken = [0, 0]
    for r in made.groupBy("toxic").count().collect():
        taken[r.toxic] = r["count"]
    return made, n, taken


def mined_terms(sample: DataFrame, taken: list[int], per_family: int = 500, most: int = 50_000) -> list[str]:
    """Terms that many more toxic texts of the sample have than others, the ``per_family`` clearest of each family.

    A candidate is in three toxic texts and one in 200 of them at least; there are fewer of them than ``most``, those in most toxic texts.
    """
    least = max(3, taken[1] // 200)

    def toxic_texts(batches):
        found = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                found.update(set(itertools.chain.from_iterable(map(terms_of, words_of(text or "")))))
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    counted = sample.filter("toxic = 1").select("text").mapInArrow(toxic_texts, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    toxic = {r.term: r.n for r in counted.filter(F.col("n") >= least).orderBy(F.desc("n"), "term").limit(most).collect()}

    def other_texts(batches):
        found = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                found.update(toxic.keys() & set(itertools.chain.from_iterable(map(terms_of, words_of(text or "")))))
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    counted = sample.filter("toxic = 0").select("text").mapInArrow(other_texts, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    other = {r.term: r.n for r in counted.collect()}
    scored: list[list[tuple[float, str]]] = [[] for _ in FAMILIES]
    for term, a in toxic.items():
        b = other.get(term, 0)
        ra, rb = a / max(1, taken[1]), (b + 0.5) / (taken[0] + 1)
        z = (ra - rb) / np.sqrt(ra * (1 - ra) / max(1, taken[1]) + rb / (taken[0] + 1) + 1e-12)
        if ra >= 3 * rb and z >= 2:
            scored[int(term[0])].append((-z, term))
    return [t for found in scored for _, t in sorted(found)[:per_family]]


_EVIDENCE = "n_words long, hits array<long>, fixed int, terms array<int>, counts array<long>"


def _evidence(rows: DataFrame, passed: list[str], terms: list[str]) -> DataFrame:
    """``passed`` columns and what each text has of the lexicon."""
    schema = rows.select(*passed).schema
    shared = rows.sparkSession.sparkContext.broadcast(terms)  # 3,000 terms at most

    def run(batches):
        lexicon = Lexicon(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                found = [lexicon.evidence(t.as_py()) for t in part.column(len(passed))]
                kinds = (pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()))
                own = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(len(passed))] + own, [*passed, "n_words", "hits", "fixed", "terms", "counts"])

    for field in StructType.fromDDL(_EVIDENCE).fields:
        schema = schema.add(field)
    return rows.select(*passed, "text").mapInArrow(run, schema)


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words, hits, pattern bits, and (row, term, count) of a batch of evidence."""
    plain = lambda c: c.to_numpy(zero_copy_only=False)
    hits = plain(b.column("hits").flatten()).reshape(b.num_rows, len(FAMILIES))
    lengths = plain(pc.list_value_length(b.column("terms")))
    return plain(b.column("n_words")), hits, plain(b.column("fixed")), (np.repeat(np.arange(b.num_rows), lengths), plain(b.column("terms").flatten()).astype(np.int64), plain(b.column("counts").flatten()))


def score_toxicity(docs: DataFrame, labels: DataFrame, learned: Callable[[Column], Column], per_label: tuple[int, int] = (12_000, 6_000)) -> DataFrame:
    """``docs`` without ``text``, plus ``score`` (0 to 1) and ``predicted``.

    ``docs`` has ``doc_id`` and ``text``, ``labels`` has ``doc_id`` and ``toxic`` (0 or 1); ``learned`` makes of a column of ids the condition for rows
    that may teach. The lexicons and the classifier are fitted on at most ``per_label`` labelled texts of each label, chosen by a hash of their id;
    the votes of all texts that may teach are counted. Null and empty texts have no words and are scored like any other; other labels than 0 and 1,
    and labels of unknown or null ids, are ignored, of labels that disagree the 1 counts; rows of one id are scored each by its own text, one of
    their texts may be in the sample; texts may be of any length. Without a text of either label all scores are 0. Input columns with a result's
    name are replaced, others pass through; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    passed = [c for c in docs.columns if c not in ("text", "score", "predicted")]
    ids = F.col("doc_id").cast("long")
    known = labels.select(ids.alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.filter(F.coalesce(learned(F.col("doc_id")), F.lit(False))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    row = F.struct(*map(quoted, passed)) if passed else F.struct(F.lit(0).alias("__none"))
    texts = docs.select(row.alias("__row"), ids.alias("__id"), "text")  # a struct, so that no column of theirs can clash
    sample, n, taken = _sampled(texts.select(F.col("__id").alias("doc_id"), "text"), known, per_label)
    if not all(taken):
        return docs.select(*map(quoted, passed), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    terms = mined_terms(sample, taken)

    seen = _evidence(sample, ["h", "doc_id", "toxic"], terms).toArrow().sort_by([("h", "ascending"), ("doc_id", "ascending")]).combine_chunks()
    batch = seen.to_batches()[0]  # as many rows as per_label at most
    n_words, hits, fixed, found = _arrays(batch)
    toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
    rates = hits / np.maximum(n_words, 1)[:, None]
    first = np.quantile(rates[toxic == 0], 0.98, axis=0)
    limits = np.stack([first, np.maximum(2 * first, np.quantile(rates[toxic == 1], 0.25, axis=0))], 1)

    whole = _evidence(texts, ["__row", "__id"], terms)
    stated = StructType([*whole.schema.fields, StructField("votes", LongType())])

    def voted(batches):
        for b in batches:
            if b.num_rows:
                words, own, bits, _ = _arrays(b)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(votes(words, own, bits, limits))], stated.names)

    whole = written(whole.mapInArrow(voted, stated), "toxic-evidence")
    pairs = whole.filter(F.coalesce(learned(F.col("__id")), F.lit(False))).select(F.col("__id").alias("doc_id"), "votes").groupBy("doc_id", "votes").agg(F.count(F.lit(1)).alias("n"))
    table = pairs.join(known, "doc_id", "left").groupBy("votes", F.coalesce("toxic", F.lit(-1)).alias("toxic")).agg(F.sum("n").alias("n"))
    counted = sorted(map(tuple, table.collect()))  # three rows for each pattern at most
    model = LabelModel(len(VOTERS)).fit(*(np.array(c, k) for c, k in zip(zip(*counted, strict=True), (np.int64, np.int64, float), strict=True)))
    truth = model.posterior(votes(n_words, hits, fixed, limits), toxic)
    weight = np.where(toxic == 1, n[1] / taken[1], n[0] / taken[0])
    size = len(FAMILIES) + len(terms)
    w = fit_linear(features(n_words, hits, *found), truth, weight, size)
    out = whole.select("__row").schema.add("score", "double").add("predicted", "integer")

    def scored(batches):
        for b in batches:
            if b.num_rows:
                words, own, _, has = _arrays(b)
                row, column, value = features(words, own, *has)
                z = np.bincount(row, value * w[column], b.num_rows) + w[size]
                score = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], out.names)

    return whole.select("__row", "n_words", "hits", "fixed", "terms", "counts").mapInArrow(scored, out).select(*(["__row.*"] if passed else []), "score", "predicted")
