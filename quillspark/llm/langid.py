"""Language identification by compression with per-language dictionaries.

Each language's dictionary is raw text of a bounded sample of labelled rows. A
text is cut into blocks, every block is compressed by zstandard once for each
dictionary, and the language with the smallest total wins. A margin below
``min_margin`` bytes saved for each byte of text is too narrow: the row is marked
``rejected``, and ``decided`` is then ``und``.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.session import ship, small_table

ship(__name__)

UNKNOWN = "und"
BLOCK = 2048


def train_dictionaries(
    rows: DataFrame, docs_per_lang: int = 400, slice_chars: int = 1500, dict_bytes: int = 100_000, all_bytes: int = 32_000_000, max_langs: int = 10_000
) -> dict[str, bytes]:
    """Raw dictionaries from rows with ``doc_id``, ``text`` and ``lang``.

    The sample is bounded by the parameters: at most ``docs_per_lang``
    documents of a language, of each a slice of at most ``slice_chars``
    characters at a pseudorandom place, at most ``dict_bytes`` bytes in all. Above ``all_bytes / dict_bytes`` languages (320) each has fewer bytes, so that all
    dictionaries together have ``all_bytes``; of more than ``max_langs`` labels, those with most rows are learned.
    ``doc_id`` only picks the sample; rows without one share a place in it. Null texts and languages, and texts without a letter, teach nothing;
    repeated rows are learned once. An empty table gives no dictionary.
    """
    usable = rows.filter(F.col("lang").isNotNull() & F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()}
    if not counts:
        return {}
    share_bytes = min(dict_bytes, all_bytes // len(counts))
    per_lang = min(docs_per_lang, max(1, 4 * share_bytes // slice_chars))
    space = 1 << 30
    kept = small_table(rows.sparkSession, [(k, min(space, 2 * per_lang * space // n + 1)) for k, n in counts.items()], "lang string, share long")
    h = F.xxhash64(F.lit(5), "doc_id")
    at = F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.greatest(F.length("text") - slice_chars, F.lit(0)) + 1).cast("int") + 1
    # max_langs rows at most
    known = usable.select("doc_id", "text", "lang").join(F.broadcast(kept), "lang").filter(F.pmod(h, F.lit(space)) < F.col("share"))
    thinned = known.select("lang", h.alias("h"), F.substring("text", at, F.lit(slice_chars)).alias("t"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h", "t"))
    sample = thinned.withColumn("r", rank).filter(F.col("r") <= per_lang).orderBy("lang", "r").collect()
    parts: dict[str, list[bytes]] = {}
    for r in sample:
        parts.setdefault(r.lang, []).append(r.t.lower().encode())
    # the languages with most rows come first and so win ties of the shortest texts
    order = sorted(parts, key=lambda k: (-counts[k], k))
    return {k: b"\n".join(dict.fromkeys(parts[k]))[-share_bytes:] for k in order}


class Classifier:
    """Compressors for every language, built once for each Python worker."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = 6):
        self.langs, self.packers = list(dictionaries), []
        for raw in dictionaries.values():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.packers.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> tuple[int, list[int]]:
        """Bytes of the text, and its compressed bytes for each language."""
        raw = text.lower().encode()
        blocks = [raw[k : k + BLOCK] for k in range(0, len(raw), BLOCK)]
        return len(raw), [sum(len(c.compress(b)) for b in blocks) for c in self.packers]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin; equal sizes go to the first language in order."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0
        n, sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min((s for k, s in enumerate(sizes) if k != best), default=n)
        saved = max(0, second - sizes[best])
        return self.langs[best], min(1.0, saved / max(1, second)), saved / n


def identify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = 0.005) -> DataFrame:
    """``docs`` without ``text``, plus ``lang_pred``, ``score``, ``margin``, ``rejected`` and ``decided``.

    A null text, or one without a letter, is ``und`` with score 0. Without
    dictionaries all rows are. Whole texts are read, in blocks, so memory is
    bounded by the text. Equal sizes go to the language with most rows. Every row is judged by its text alone: null ids and repeated rows are rows like any other. Input columns
    with a result's name are replaced, others pass through; an empty table gives an empty result.
    """
    results = ("text", "lang_pred", "score", "margin", "rejected", "decided")
    passed = [c for c in docs.columns if c not in results]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(dictionaries)  # bounded by all_bytes
    schema = docs.select(*passed).schema
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("margin", "double"), ("rejected", "boolean"), ("decided", "string")):
        schema = schema.add(name, kind)

    def run(batches):
        model = Classifier(shared.value)
        for b in batches:
            found = [model.predict(t) for t in b.column(len(passed)).to_pylist()]
            low = [m < min_margin for _, _, m in found]
            own = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64())]
            own += [pa.array(low, pa.bool_()), pa.array([UNKNOWN if x else f[0] for f, x in zip(found, low, strict=True)], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in range(len(passed))] + own, [f.name for f in schema.fields])

    return docs.select(*passed, "text").mapInArrow(run, schema)
