"""Looking up vectors of token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def embed_tokens(df: DataFrame, table: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", token_col: str = "token", vector_col: str = "vector") -> DataFrame:
    """``id_col, position, token, vector``: each token of each row with its vector, null for tokens without one.

    A join on the token, so the table may be of any size; Spark broadcasts it if it is small. Frequent tokens are counted on by adaptive skew handling."""
    tokens = df.select(id_col, F.posexplode(ids_col).alias("position", "token"))
    return tokens.join(table.select(F.col(token_col).alias("token"), F.col(vector_col).alias("vector")), "token", "left").select(id_col, "position", "token", "vector")
