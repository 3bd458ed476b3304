"""Embedding of texts: word pieces, and any model that turns texts into vectors, in Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import ship

ship(__name__)

BATCH = 32
_WORDS = re.compile(r"\w+|[^\w\s]")


def word_pieces(text: str, vocabulary: dict[str, int], unknown: str = "[UNK]", most: int = 512, longest: int = 100) -> list[int]:
    """Ids between [CLS] and [SEP]: words in lower case without accents, each as the longest pieces from the left, ``##`` before all but the first."""
    bare = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    ids = []
    for word in _WORDS.findall(bare):
        at, own = 0, []
        while at < len(word) <= longest:
            end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocabulary), None)
            if end is None:
                break
            own.append(vocabulary[("##" if at else "") + word[at:end]])
            at = end
        ids += own if at == len(word) else [vocabulary[unknown]]
    return [vocabulary["[CLS]"], *ids[: most - 2], vocabulary["[SEP]"]]


def word_piece_ids(text: Column, vocabulary: dict[str, int]) -> Column:
    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: word_pieces(t or "", vocabulary))

    return ids(text)


def hashing_model(dimensions: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A model without weights: signed counts of hashed words, as unit vectors; it stands in where no trained model is given."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions))
        for row, text in zip(out, texts, strict=True):
            for w in text.lower().split():
                h = xxhash.xxh64_intdigest(w.encode())
                row[h % dimensions] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def embedded(df: DataFrame, key: str, text: str, load: Callable[[], Callable[[list[str]], np.ndarray]], model: str, batch: int = BATCH) -> DataFrame:
    """(key, vector, model): every text through the model that ``load`` gives once for each task, ``batch`` texts at a time; null is empty."""

    def run(batches):
        embed = load()
        for b in batches:
            for k in range(0, b.num_rows, batch):
                part = b.slice(k, batch)
                vectors = np.asarray(embed([t or "" for t in part.column(1).to_pylist()]), dtype=np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(vectors), pa.list_(pa.float32())), pa.array([model] * part.num_rows)], [key, "vector", "model"])

    return df.select(key, text).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, vector array<float>, model string")
