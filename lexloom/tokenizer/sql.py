"""The engine's functions by name in SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexloom.tokenizer.codec import codec
from lexloom.tokenizer.vocab import BOS, EOS, Merges, token_name


def register(spark: SparkSession, merges: Merges, prefix: str = "lex_") -> list[str]:
    """Register ``encode``, ``encode_marked``, ``decode``, ``token_count`` and ``token_name`` for ``spark.sql``; returns their names."""

    @F.pandas_udf("array<int>")
    def encode(s: pd.Series) -> pd.Series:
        c = codec(merges)
        return pd.Series([None if t is None else c.encode(t) for t in s])

    @F.pandas_udf("array<int>")
    def encode_marked(s: pd.Series) -> pd.Series:
        c = codec(merges)
        return pd.Series([None if t is None else [BOS, *c.encode(t, True), EOS] for t in s])

    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        c = codec(merges)
        return pd.Series([None if t is None else c.decode(t) for t in s])

    @F.pandas_udf("int")
    def token_count(s: pd.Series) -> pd.Series:
        c = codec(merges)
        return pd.Series([None if t is None else c.count(t) for t in s], dtype="Int32")

    @F.pandas_udf("string")
    def name(s: pd.Series) -> pd.Series:
        return s.map(lambda i: None if pd.isna(i) else token_name(int(i), merges))

    every = {"encode": encode, "encode_marked": encode_marked, "decode": decode, "token_count": token_count, "token_name": name}
    for k, f in every.items():
        spark.udf.register(prefix + k, f)
    return [prefix + k for k in every]
