"""Token totals per slice of a corpus, and recorded totals that are wrong.

Whole texts are hashed (128 bits) and deduplicated, each distinct text is tokenized once with the existing merges, and the
counts are joined back to the multiplicities of the slices. Only hashes and numbers take part in that join. A text that makes up a
third of all rows is reduced to one row per map task before anything is shuffled, and its multiplicities to one row per slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.tokenizer.codec import token_count
from lexloom.tokenizer.vocab import Merges

_H = ("_h1", "_h2")


def _hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias(_H[0]), F.xxhash64(F.lit("\x01second"), text).alias(_H[1])]


def slice_tokens(df: DataFrame, merges: Merges, keys: dict[str, Column], id_col: str = "dialogue_id", text_col: str = "text") -> DataFrame:
    """One row per slice: ``keys..., documents, distinct_texts, tokens``.

    ``keys`` maps output names to expressions over ``df``. Each id counts once (of redelivered rows that differ, the smallest key
    struct and text hash); rows with a null id count as one document each. A null text has 0 tokens and no distinct text, a blank
    one the tokens of its blanks. An empty table gives no rows. Other columns of ``df`` are ignored, whatever their names."""
    text = F.col(text_col)
    base = df.select(F.col(id_col).alias("_id"), *_hashes(text), F.struct(*[c.alias(f"k{i}") for i, c in enumerate(keys.values())]).alias("_k"), text.isNull().alias("_null"))
    named = base.where("_id is not null").groupBy("_id").agg(F.min(F.struct("_k", "_null", *_H)).alias("_r")).select("_r.*")
    unnamed = base.where("_id is null").select("_k", "_null", *_H)
    docs = named.unionByName(unnamed)
    slices = docs.groupBy("_k", "_null", *_H).agg(F.count(F.lit(1)).alias("_n"))
    texts = df.where(text.isNotNull()).select(*_hashes(text), text.alias("_t")).groupBy(*_H).agg(F.first("_t").alias("_t"))
    counts = texts.select(*_H, token_count("_t", merges).cast("long").alias("_tokens"))
    joined = slices.join(counts, list(_H), "left")
    real = F.when(~F.col("_null"), F.col("_tokens"))
    return (
        joined.groupBy("_k")
        .agg(F.sum("_n").alias("documents"), F.count(real).alias("distinct_texts"), F.coalesce(F.sum(real * F.col("_n")), F.lit(0).cast("long")).alias("tokens"))
        .select(*[F.col(f"_k.k{i}").alias(name) for i, name in enumerate(keys)], "documents", "distinct_texts", "tokens")
    )


def recorded_lang(c: Column) -> Column:
    """A language as the recorded budget spells it: null and the empty string are ``none``."""
    return F.when(c.isNull() | (c == ""), F.lit("none")).otherwise(c)


def budget_check(shards: DataFrame, recorded: DataFrame, merges: Merges, tolerance: float = 0.02) -> DataFrame:
    """Every recorded slice beside its true total: ``shard, source, lang, topic, recorded_tokens, true_tokens, wrong``.

    ``wrong`` if the two differ by more than ``tolerance`` of the true total, or if nothing or null is recorded for a slice that has
    tokens. A recorded slice without documents has a true total of 0. Null keys match null keys."""
    keys = {"shard": F.col("shard"), "source": F.col("source"), "lang": recorded_lang(F.col("lang")), "topic": F.col("topic")}
    true = slice_tokens(shards, merges, keys).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("tokens").alias("_true"))
    r = recorded.select(*keys, F.col("tokens").alias("recorded_tokens"))
    cond = None
    for k in keys:
        c = r[k].eqNullSafe(true[f"_{k}"])
        cond = c if cond is None else cond & c
    both = r.join(true, cond, "left").withColumn("true_tokens", F.coalesce("_true", F.lit(0).cast("long")))
    off = F.abs(F.coalesce("recorded_tokens", F.lit(0)) - F.col("true_tokens")) > F.lit(tolerance) * F.col("true_tokens")
    return both.select(*keys, "recorded_tokens", "true_tokens", off.alias("wrong"))
