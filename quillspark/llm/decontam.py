"""Benchmark decontamination by template canonicalisation.

A text becomes a template: numbers, names and units turn into the placeholders
``<num>``, ``<name>`` and ``<unit>``; other words are lower-cased and lose the
punctuation around them. Windows of template words of the benchmark and of the
documents meet in a hash join: of ``window`` words, and of ``SEED`` for items of fewer than ``SHORT`` words,
which a few changed words would leave without longer ones. Windows of which more than half are
placeholders are hashed by their raw words, so that these are found as they stand.
Windows on one diagonal (place in the document less place in the item) are one
occurrence; its slots are consistent if each value of the item maps to one value
of the document and the other way round, so that a re-parameterised question
counts and a mere look-alike does not. Where a value is kept in one place and
changed in another, only the windows with the change are dropped.
A document is contaminated by an item if its occurrences cover ``min_cover`` of
the item's windows or, for short items, ``SHORT_COVER`` of its words and five
at least; either of all, or of those that are not hashed by raw words.
"""

from __future__ import annotations

import array
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.workers import forget
from quillspark.session import ship, written

ship(__name__)

#: Words that are units when a number stands before them, in English, German, French and Spanish.
UNITS = frozenset((
    # symbols
    "mg", "g", "kg", "t", "mm", "cm", "dm", "m", "km", "ml", "cl", "dl", "l", "hl", "ha", "km²", "m²", "m³", "ft", "mi", "yd", "lb", "lbs", "oz",
    "s", "ms", "min", "h", "hz", "khz", "mhz", "ghz", "w", "kw", "mw", "kwh", "v", "kv", "a", "j", "kj", "kcal", "pa", "hpa", "n", "k", "°c", "°f", "c", "f",
    "b", "kb", "mb", "gb", "tb", "kbit", "mbit", "gbit", "km/h", "m/s", "mph", "kmh", "rpm", "usd", "eur", "gbp", "chf", "€", "$", "£", "%",
    # English
    "gram", "grams", "kilogram", "kilograms", "kilo", "kilos", "ton", "tons", "tonne", "tonnes", "pound", "pounds", "ounce", "ounces",
    "metre", "metres", "meter", "meters", "kilometre", "kilometres", "kilometer", "kilometers", "mile", "miles", "yard", "yards", "foot", "feet", "inch", "inches",
    "litre", "litres", "liter", "liters", "gallon", "gallons", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks",
    "month", "months", "year", "years", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "degree", "degrees",
    # German
    "gramm", "kilogramm", "tonnen", "meter", "kilometer", "liter", "sekunde", "sekunden", "minuten", "stunde", "stunden", "tag", "tage", "tagen", "woche", "wochen",
    "monat", "monate", "monaten", "jahr", "jahre", "jahren", "prozent", "grad",
    # French
    "gramme", "grammes", "mètre", "mètres", "kilomètre", "kilomètres", "litre", "litres", "seconde", "secondes", "heure", "heures", "jour", "jours", "semaine", "semaines",
    "mois", "an", "ans", "année", "années", "degré", "degrés",
    # Spanish
    "gramo", "gramos", "metro", "metros", "litro", "litros", "segundo", "segundos", "minuto", "minutos", "hora", "horas", "día", "días", "semana", "semanas",
    "mes", "meses", "año", "años", "grado", "grados",
))
NUMBER = re.compile(r"[-+$€£(]*\d[\d.,:/]*[%)\w]{0,3}[.,;:!?)]*")
MARK, NUM, NAME, UNIT = 0, 1, 2, 3
_TRIM = "\"'()[]{}<>.,;:!?«»„“”"
PRIME = np.uint64(0x9E3779B97F4A7C15)
RAW = np.uint64(0x5851F42D4C957F2D)
#: Items of fewer words are short: two changed words can spoil half of their windows of 8.
SHORT, SEED, SHORT_COVER, LEAST_WORDS = 40, 4, 0.55, 5


class Words(dict):
    """Numbers the different raw words; arrays hold what each is. Starts anew beyond ``most`` words."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.hashes, self.kinds, self.ends = array.array("Q", [0]), array.array("b", [MARK]), array.array("b", [1])
        self.raws = array.array("Q", [0])
        self["\0"] = 0

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, kind, whether a sentence ends and hash of the raw word, by number of the word."""
        return np.array(self.hashes), np.array(self.kinds), np.array(self.ends), np.array(self.raws)

    def __missing__(self, w: str) -> int:
        bare = w.strip(_TRIM)
        if NUMBER.fullmatch(w):
            kind, text = NUM, "<num>"
        elif bare.lower() in UNITS:
            kind, text = UNIT, bare.lower()
        elif bare[:1].isupper() and not bare.isupper():
            kind, text = NAME, bare.lower()
        else:
            kind, text = 4, bare.lower() or w
        self.hashes.append(xxhash.xxh64_intdigest(text.encode(), 7))
        self.raws.append(xxhash.xxh64_intdigest((bare.lower() or w).encode(), 7))
        self.kinds.append(kind)
        self.ends.append(int(w.rstrip("\"')]»”")[-1:] in tuple(".!?:") and w[-1:] != ""))
        k = self[w] = len(self.hashes) - 1
        return k


_NAME, _UNIT = (np.uint64(xxhash.xxh64_intdigest(t, 7)) for t in (b"<name>", b"<unit>"))


def template(text: str, vocabulary: Words) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Raw words, template hashes, whether each is a slot, and raw hashes."""
    words = text.replace("\n", " \0 ").split()
    if len(vocabulary) > vocabulary.most:
        vocabulary.reset()
    ix = np.fromiter(map(vocabulary.__getitem__, words), dtype=np.int64, count=len(words))
    return _slotted(words, *(t[ix] for t in vocabulary.tables()))


def _slotted(words, hashes, kinds, ends, raws):
    start = np.ones(len(kinds), dtype=bool)
    start[1:] = ends[:-1] == 1
    before = np.zeros(len(kinds), dtype=np.int8)
    before[1:] = kinds[:-1]
    name, unit = (kinds == NAME) & ~start, (kinds == UNIT) & (before == NUM)
    hashes = np.where(name, _NAME, np.where(unit, _UNIT, hashes))
    real = kinds != MARK
    slot = (name | unit | (kinds == NUM))[real]
    return ([w for w, r in zip(words, real.tolist(), strict=True) if r] if not real.all() else words), hashes[real], slot, raws[real]


def _rolled(hashes: np.ndarray, n: int, size: int) -> np.ndarray:
    out = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        out = out * PRIME + hashes[k : k + n]
    return out ^ (out >> np.uint64(29))


def windows(hashes: np.ndarray, slot: np.ndarray, raws: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of all windows, and which have more words than slots to tell them by; the others go by raw words."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out = _rolled(hashes, n, size)
    sums = np.concatenate([[0], np.cumsum(slot)])
    telling = (sums[size:] - sums[:n]) * 2 <= size
    if not telling.all():
        out = np.where(telling, out, _rolled(raws, n, size) ^ RAW)
    return out, telling


def _slots(words: list[str], slot: np.ndarray, at: int, size: int) -> list[str]:
    return [words[k].strip(_TRIM) for k in range(at, at + size) if slot[k]]


def item_windows(benchmark: DataFrame, window: int = 8, least: int = 5) -> DataFrame:
    """(item_id, n, n_told, n_words, told_words, size, at, told, h, slots) of every window.

    An item of ``least`` to ``window`` words is one window. n windows cover n_words words; n_told of them, which
    are not hashed by raw words, cover told_words. Items below ``least`` words, nulls among
    them, cannot be told from chance and give none.
    """

    def run(batches):
        vocabulary = Words()
        for b in batches:
            out = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words, hashes, slot, raws = template(text or "", vocabulary)
                if len(words) < least:
                    continue
                size = len(words) if len(words) <= window else SEED if len(words) < SHORT else window
                h, telling = windows(hashes, slot, raws, size)
                covered = np.zeros(len(words), dtype=bool)
                for k in np.nonzero(telling)[0]:
                    covered[k : k + size] = True
                of = (item, len(h), int(telling.sum()), len(words), int(covered.sum()), size)
                out += [(*of, k, bool(telling[k]), int(h[k].view(np.int64)), _slots(words, slot, k, size)) for k in range(len(h))]
            if out:
                kinds = [pa.int64(), *[pa.int64()] * 4, pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.list_(pa.string())]
                names = ["item_id", "n", "n_told", "n_words", "told_words", "size", "at", "told", "h", "slots"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    schema = "item_id long, n long, n_told long, n_words long, told_words long, size int, at int, told boolean, h long, slots array<string>"
    return benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(run, schema)


def contaminated_texts(
    docs: DataFrame, benchmark: DataFrame, window: int = 8, min_cover: float = 0.5, broadcast_rows: int = 200_000, sieve_bits: int = 22
) -> DataFrame:
    """(doc_id, key, item_id, n_found, n_windows, cover, n_slots) for each contaminated text and item; key is its XXH64.

    Whole texts are read. Before the join a bit sieve of fixed size (2 **
    ``sieve_bits`` bits of the items' hashes) drops windows that no item has.
    Null and empty texts match nothing; rows that repeat a doc_id and text count once;
    null doc_ids are kept as such; a cover equal to the limit is enough; texts may be of any length, 256 of them are held at a time; items that repeat are items each; only doc_id and
    text are read, so other columns cannot clash; an empty table on either side gives an empty
    result.
    """
    spark = docs.sparkSession
    items = written(item_windows(benchmark, window), "benchmark-windows")
    mask = (1 << sieve_bits) - 1
    marks = items.select(F.expr(f"h & {mask}L").alias("m")).distinct().collect()  # at most 2 ** sieve_bits numbers
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())
    sieve = np.zeros(1 << sieve_bits, dtype=bool)
    sieve[[r[0] for r in marks]] = True
    shared = spark.sparkContext.broadcast(np.packbits(sieve))

    def run(batches):
        forget()
        bits, vocabulary = np.unpackbits(shared.value).astype(bool), Words()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                out = []
                ids, keys, texts = (part.column(c).to_pylist() for c in range(3))
                if len(vocabulary) > vocabulary.most:
                    vocabulary.reset()
                raw = [(t or "").replace("\n", " \0 ").split() for t in texts]
                numbers = [np.fromiter(map(vocabulary.__getitem__, w), dtype=np.int64, count=len(w)) for w in raw]
                tables = vocabulary.tables()
                for doc, row, ix, words in zip(ids, range(len(ids)), numbers, raw, strict=True):
                    if not len(ix):
                        continue
                    words, hashes, slot, raws = _slotted(words, *(t[ix] for t in tables))
                    for size in sizes:
                        h, _ = windows(hashes, slot, raws, size)
                        hit = np.nonzero(bits[(h & np.uint64(mask)).astype(np.int64)])[0]
                        out += [(doc, keys[row], size, int(k), int(h[k].view(np.int64)), _slots(words, slot, k, size)) for k in hit]
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "key", "size", "pos", "h", "found"])

    schema = "doc_id long, key long, size int, pos int, h long, found array<string>"
    mine = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text").mapInArrow(run, schema)
    right = F.broadcast(items) if items.limit(broadcast_rows + 1).count() <= broadcast_rows else items
    met = mine.join(right, ["h", "size"])
    # one occurrence: the windows of a diagonal; repeated rows fall together in the sets
    item = ["doc_id", "key", "item_id", "n", "n_told", "n_words", "told_words", "size"]
    pairs = F.array_distinct(F.arrays_zip("slots", "found"))
    on_line = met.groupBy(*item, (F.col("pos") - F.col("at")).alias("line")).agg(F.collect_set(F.struct("at", "told", pairs.alias("p"))).alias("w"))
    on_line = on_line.withColumn("p", F.array_distinct(F.flatten("w.p")))
    against = lambda x, y: ((x["slots"] == y["slots"]) & (x["found"] != y["found"])) | ((x["slots"] != y["slots"]) & (x["found"] == y["found"]))
    same = lambda x: x["slots"] == x["found"]
    # values that are changed against others; where none of those is kept as it stands, the occurrence is a look-alike
    bad = F.filter("p", lambda x: ~same(x) & F.exists("p", lambda y: against(x, y)))
    unlike = F.exists("bad", lambda x: ~F.exists("p", lambda y: same(y) & against(x, y)))
    sound = on_line.withColumn("bad", bad).filter(~unlike)
    kept = sound.withColumn("w", F.filter("w", lambda v: F.size(F.array_intersect(v["p"], F.col("bad"))) == 0))
    whole = kept.groupBy(*item).agg(F.flatten(F.collect_list("w")).alias("w"), F.max(F.size(F.array_except("p", "bad"))).alias("n_slots"))
    words = lambda w: F.size(F.array_distinct(F.flatten(F.transform(w, lambda v: F.sequence(v["at"], v["at"] + F.col("size") - 1)))))
    ats = lambda w: F.size(F.array_distinct(F.transform(w, lambda v: v["at"])))
    told = F.filter("w", lambda v: v["told"])
    counted = whole.select(*item, "n_slots", ats(F.col("w")).alias("k"), ats(told).alias("k_told"), words(F.col("w")).alias("c"), words(told).alias("c_told"))
    by_words = (F.col("n_words") > window) & (F.col("n_words") < SHORT)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    cover = F.when(by_words, F.greatest(share("c", "n_words"), share("c_told", "told_words"))).otherwise(F.greatest(share("k", "n"), share("k_told", "n_told")))
    enough = F.when(by_words, (F.col("cover") >= SHORT_COVER) & (F.col("c") >= LEAST_WORDS)).otherwise(F.col("cover") >= min_cover)
    hits = counted.withColumn("cover", cover).filter(enough)
    return hits.select("doc_id", "key", "item_id", F.col("k").cast("long").alias("n_found"), F.col("n").alias("n_windows"), "cover", F.col("n_slots").cast("long").alias("n_slots"))


def contaminated(docs: DataFrame, benchmark: DataFrame, *args, **kwargs) -> DataFrame:
    """``contaminated_texts`` by doc_id: (doc_id, item_id, n_found, n_windows, cover, n_slots)."""
    hits = contaminated_texts(docs, benchmark, *args, **kwargs)
    return hits.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("n_found", "n_windows", "cover", "n_slots")))
