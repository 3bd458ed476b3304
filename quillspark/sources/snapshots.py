"""Snapshots: JSON text as base64 of its gzip form, and back."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import ship

ship(__name__)


def packed(df: DataFrame, column: str) -> DataFrame:
    @F.pandas_udf("binary")
    def squeeze(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else gzip.compress(x.encode(), mtime=0))

    return df.withColumn(column, F.base64(squeeze(column)))


def unpacked(df: DataFrame, column: str) -> DataFrame:
    @F.pandas_udf("string")
    def expand(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else gzip.decompress(x).decode())

    return df.withColumn(column, expand(F.unbase64(column)))
