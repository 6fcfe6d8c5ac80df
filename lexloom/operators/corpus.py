"""Counts over a corpus and reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.patterns import WS


def word_frequency(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``word, n`` of white-space free pieces; counted per task before the shuffle."""
    return df.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"([^{WS}]+)"), 1)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def pair_frequency(words: DataFrame, ids: Column) -> DataFrame:
    """``a, b, n``: adjacent ids of every distinct word, weighted by how often the word occurs."""
    listed = words.select("n", ids.alias("ids")).where(F.size("ids") >= 2)
    pairs = listed.select("n", F.explode(F.transform(F.sequence(F.lit(0), F.size("ids") - 2), lambda i: F.struct(F.get("ids", i).alias("a"), F.get("ids", i + 1).alias("b")))).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.sum("n").alias("n"))


def best_pair(pairs: DataFrame) -> DataFrame:
    """The most frequent pair; of equally frequent ones the smallest."""
    return pairs.agg(F.max_by(F.struct("a", "b", "n"), F.struct("n", (-F.col("a")).alias("na"), (-F.col("b")).alias("nb"))).alias("p")).select("p.*")


def merge_pair(ids: Column | str, a: int, b: int, new: int) -> Column:
    """Replace each non-overlapping pair from the left, in one Arrow pass linear in the ids. Null for null."""

    @F.pandas_udf("array<int>")
    def merged(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else _merge(np.asarray(x), a, b, new) for x in s])

    return merged(F.col(ids) if isinstance(ids, str) else ids)


def _merge(x: np.ndarray, a: int, b: int, new: int) -> np.ndarray:
    hit = np.flatnonzero((x[:-1] == a) & (x[1:] == b))
    if a == b and len(hit):  # in a run of one id every second position counts
        start = np.r_[True, np.diff(hit) > 1]
        run = np.maximum.accumulate(np.where(start, np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
    out = x.copy()
    out[hit] = new
    return np.delete(out, hit + 1)


def tokenizer_stats(df: DataFrame, text_col: str, n_tokens: str) -> DataFrame:
    """Totals and ratios of an encoded corpus."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    words = F.size(F.filter(F.split(t, f"[{WS}]+"), lambda x: x != ""))
    s = df.agg(F.coalesce(F.sum(n_tokens), F.lit(0)).alias("tokens"), F.coalesce(F.sum(words), F.lit(0)).alias("words"), F.coalesce(F.sum(F.length(t)), F.lit(0)).alias("chars"))
    one = lambda c: F.greatest(F.lit(1), F.col(c))
    return s.select("tokens", "words", "chars", (F.col("tokens") / one("words")).alias("tokens_per_word"), (F.col("tokens") / one("chars")).alias("tokens_per_char"), (F.col("chars") / one("tokens")).alias("chars_per_token"))


def dialogue_report(df: DataFrame, lang: str = "lang", bucket: str = "bucket") -> DataFrame:
    """Dialogues and turns in all, by language and by bucket, in one pass (grouping sets)."""
    sets = df.groupingSets([[F.col(lang)], [F.col(bucket)], []], F.col(lang), F.col(bucket))
    part = F.when(F.grouping(lang) == 0, "lang").when(F.grouping(bucket) == 0, "bucket").otherwise("all")
    rows = sets.agg(part.alias("part"), F.count(F.lit(1)).alias("dialogues"), F.sum("turns").alias("turns"), F.avg("turns").alias("avg_turns"))
    return rows.select("part", F.coalesce(lang, bucket).alias("value"), "dialogues", "turns", "avg_turns")


def suite_scores(df: DataFrame) -> DataFrame:
    """``suite, total, scored, accuracy`` of answered items (``suite, answers, hit``); items without answers count in the total only."""
    scored = F.size("answers") > 0
    return df.groupBy("suite").agg(F.count(F.lit(1)).alias("total"), F.count_if(scored).alias("scored"), F.coalesce(F.avg(F.when(scored, F.col("hit").cast("double"))), F.lit(0.0)).alias("accuracy"))


def generation_report(df: DataFrame, broken: Column, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("samples"), F.avg(broken.cast("double")).alias("broken_rate"), F.avg("repetition_ratio").alias("avg_repetition"), F.avg("reply_length").alias("avg_length"))
