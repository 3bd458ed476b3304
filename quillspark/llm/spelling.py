"""Spelling variants: words one inserted, deleted or replaced letter apart, found by hashes of all their deletions.

Two words are one letter apart if they are alike without one letter at the same place, or if one is the other without a letter. So every word gives
the hash of itself and of every string that one deletion makes of it: from prefix and suffix polynomials, all of a batch at once in NumPy. The
64-bit keys are dealt by their high bits and sorted; a key that only one word has is dropped, the rest get their strings and are verified on them.
A group of one string holds at most 64 + 26 words for each of its places, so no pair has to be made: a group gives each of its words the number of its
near words and the best of them, and these are added up.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import ship, written

ship(__name__)

#: Code points of a text that are counted at once, words held before counts are passed on, cells of a tile of letters.
PIECE, HELD, CELLS = 1 << 20, 200_000, 1 << 20
#: Base of the polynomials, and the constants of the finaliser that spreads them over all bits.
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
RADIX_BITS = 20


def _run_pattern(least: int) -> re.Pattern[bytes]:
    return re.compile(rb"[a-z\xc0-\xff]{%d,}" % least)


def runs_of(text: str, pattern: re.Pattern[bytes]):
    """Counts of the runs of letters in Latin-1 bytes, A-Z lower-cased, piece by piece; other code points part them."""
    raw = text.encode("latin-1", "replace").lower()
    at = 0
    while at < len(raw):
        end = at + PIECE
        if end < len(raw):
            gap = re.compile(rb"[^a-z\xc0-\xff]").search(raw, end)
            end = gap.start() if gap else len(raw)
        yield Counter(pattern.findall(raw, at, end))
        at = end


def altered(run: bytes, seed: int, every: int) -> bytes:
    """``run``, without one letter if ``every`` divides the CRC-32 of its UTF-8 bytes, which begins at ``seed``."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def count_words(docs: DataFrame, least: int = 6, occurrences: int = 5, every: int = 199) -> DataFrame:
    """``word`` and ``n``: lower-cased runs of at least ``least`` letters that occur ``occurrences`` times or more in ``doc_id``, ``text``."""

    def run(batches):
        pattern, counts = _run_pattern(least), Counter()

        def passed():
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                seed = zlib.crc32(b":" if name is None else b"%d:" % name)
                for found in runs_of(text.as_py() or "", pattern):
                    for w, n in found.items():
                        w = altered(w, seed, every)
                        if len(w) >= least:
                            counts[w] += n
                    if len(counts) > HELD:
                        yield passed()
                        counts.clear()
        if counts:
            yield passed()

    parts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX[0]
    h = (h ^ (h >> np.uint64(27))) * MIX[1]
    return h ^ (h >> np.uint64(31))


def deletion_keys(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, key, first and last place of every different deletion of words of one length (a matrix of letters); place -1 is the word itself.

    Deletions within a run of equal letters give one string, so they are one row with the run's first and last place.
    """
    n, size = letters.shape
    x = letters.astype(np.uint64) + np.uint64(1)
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, BASE)]))
    prefix, suffix = np.zeros((n, size + 1), np.uint64), np.zeros((n, size + 1), np.uint64)
    for j in range(size):
        prefix[:, j + 1] = prefix[:, j] * BASE + x[:, j]
    for j in range(size - 1, -1, -1):
        suffix[:, j] = x[:, j] * powers[size - 1 - j] + suffix[:, j + 1]
    begins = np.ones((n, size), bool)
    begins[:, 1:] = letters[:, 1:] != letters[:, :-1]
    row, first = np.nonzero(begins)
    last = np.full(len(row), size - 1)
    same = row[1:] == row[:-1]
    last[:-1][same] = first[1:][same] - 1
    key = prefix[row, first] * powers[size - 1 - first] + suffix[row, first + 1]
    own = np.arange(n)
    keys = _mixed(np.concatenate([key, prefix[:, size]]))
    return np.concatenate([row, own]), keys, np.concatenate([first, np.full(n, -1)]), np.concatenate([last, np.full(n, -1)])


def _keys(words: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            raw = [w.encode("latin-1") for w in b.column(1).to_pylist()]
            sizes, ids = np.array([len(w) for w in raw]), b.column(0).to_numpy()
            for size in np.unique(sizes):
                which = np.flatnonzero(sizes == size)
                for at in range(0, len(which), max(1, CELLS // int(size))):
                    own = which[at : at + max(1, CELLS // int(size))]
                    letters = np.frombuffer(b"".join(raw[k] for k in own), np.uint8).reshape(len(own), size)
                    row, key, first, last = deletion_keys(letters)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[own][row]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["key", "wid", "first", "last"])

    return words.select("wid", "word").mapInArrow(run, "key long, wid long, first int, last int")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows by the high bits of their key, sorted by key within each task."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, F.shiftrightunsigned("key", 64 - RADIX_BITS)).sortWithinPartitions("key")


def _shared(sorted_rows: DataFrame) -> DataFrame:
    """The rows whose key another row has too."""

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            b = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            key = b.column(0).to_numpy()
            same = key[1:] == key[:-1]
            keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            end = len(key) - 1 - int(np.argmax(np.concatenate([~same[::-1], [True]])))  # where the last key begins: it may go on in the next batch
            yield b.slice(0, end).filter(pa.array(keep[:end]))
            held = b.slice(end)
        if held is not None and held.num_rows > 1:
            yield held

    return sorted_rows.mapInArrow(run, sorted_rows.schema)


def near_of(members: list[tuple[str, int, int, int]]) -> dict[str, tuple[int, int, str]]:
    """Number of near words, and count and name of the best of them, that a group of one key shows for each of its words.

    ``members`` are (word, n, first, last). They are parted by the string that is left, so a collision of hashes links nothing.
    """
    strings = defaultdict(list)
    for word, n, first, last in members:
        strings[word if first < 0 else word[:first] + word[first + 1 :]].append((-n, word, first, last))
    found: dict[str, tuple[int, int, str]] = {}

    def tell(word, count, best):
        had = found.get(word)
        found[word] = (count, *best) if had is None else (had[0] + count, *min(had[1:], best))

    for same in strings.values():
        if len(same) < 2:
            continue
        same.sort()
        longer = [m for m in same if m[2] >= 0]
        for n, word, first, _ in same:
            if first < 0 and longer:
                tell(word, len(longer), longer[0][:2])
                for m in longer:
                    tell(m[1], 1, (n, word))
        places = defaultdict(list)
        for m in longer:
            for place in range(m[2], m[3] + 1):
                places[place].append(m)
        for group in places.values():
            for m in group if len(group) > 1 else ():
                tell(m[1], len(group) - 1, group[0][:2] if group[0] is not m else group[1][:2])
    return {word: (count, -n, best) for word, (count, n, best) in found.items()}


def _near(sorted_rows: DataFrame) -> DataFrame:
    """``word``, ``near``, ``best_n`` and ``best`` of each group of ``key``, ``word``, ``n``, ``first``, ``last``."""

    def run(batches):
        key, members, rows = None, [], []

        def passed():
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "near", "best_n", "best"])

        for b in batches:
            for k, *m in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != key:
                    rows += [(w, *f) for w, f in near_of(members).items()] if len(members) > 1 else []
                    key, members = k, []
                members.append(tuple(m))
            yield passed()
            rows.clear()
        rows += [(w, *f) for w, f in near_of(members).items()] if len(members) > 1 else []
        yield passed()

    return sorted_rows.select("key", "word", "n", "first", "last").mapInArrow(run, "word string, near long, best_n long, best string")


def _roots(forms: DataFrame, most: int, ratio: int) -> DataFrame:
    """``word``, ``root``: where following the forms ends. Each step multiplies the count by ``ratio``, which bounds the steps; each round doubles them."""
    steps, made = 1, written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while ratio**steps <= most:
        onward = made.select(F.col("word").alias("root"), F.col("root").alias("__end"))
        made = written(made.join(onward, "root", "left").select("word", F.coalesce("__end", "root").alias("root")), "spelling-roots")
        steps *= 2
    return made


def spelling_groups(docs: DataFrame, least: int = 6, occurrences: int = 5, every: int = 199, ratio: int = 5) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of every word of ``doc_id``, ``text``.

    A word's form is its near word of most occurrences (ties: the first in code-point order) if that has ``ratio`` times the word's own or more, else
    null; the root is where following forms ends, the word itself if it has none. Null and empty texts have no words; a null doc_id counts as an empty
    name in the deletion rule; repeated rows count each; words may be as long as a text, as keys carry ids and places and not strings; other columns are
    left out, whatever they are called; an empty table gives an empty result.
    """
    words = written(count_words(docs, least, occurrences, every).withColumn("wid", F.monotonically_increasing_id()), "spelling-words")
    shared = _shared(_dealt(_keys(words)))
    near = written(_near(_dealt(shared.join(words, "wid"))), "spelling-near")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("best")
    per = near.groupBy("word").agg(F.sum("near").alias("n_near"), best)
    far = -F.col("best.less") >= F.col("n") * ratio
    judged = written(
        words.join(per, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(far, F.col("best.word")).alias("form"), F.when(far, -F.col("best.less")).alias("form_n")
        ),
        "spelling-forms",
    )
    most = judged.agg(F.max(F.col("form_n"))).first()[0]
    if most is None:
        return judged.select("word", "form", F.col("word").alias("root"), "n", "n_near", "form_n")
    roots = _roots(judged.filter("form IS NOT NULL"), most // occurrences, ratio)
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
