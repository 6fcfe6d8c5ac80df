"""Budgets, splits and samples in a stated order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.operators.prefix import prefix_sum


def within_budget(df: DataFrame, size: str | Column, limit: int, order_col: str = "doc_id") -> DataFrame:
    """Rows in order until the sizes before them reach ``limit``; the row that crosses it is included. Adds ``before``.

    ``order_col`` must be unique. Only order and size go through the prefix sum."""
    sizes = df.select(order_col, (F.col(size) if isinstance(size, str) else size).cast("long").alias("_size"))
    kept = prefix_sum(sizes, "_size", [order_col], name="before").where(F.col("before") < limit).select(order_col, "before")
    return df.join(kept, order_col)


def first_share(df: DataFrame, share: float, order_col: str = "doc_id") -> DataFrame:
    """Add ``split``: ``validation`` for the first ``max(1, int(share * n))`` rows in order, ``train`` for the rest."""
    total = df.agg(F.greatest(F.lit(1), F.floor(F.lit(share) * F.count(F.lit(1)))).alias("_k"))
    placed = prefix_sum(df.select(order_col), F.lit(1), [order_col], name="_row")
    marked = placed.crossJoin(F.broadcast(total)).select(order_col, F.when(F.col("_row") < F.col("_k"), "validation").otherwise("train").alias("split"))  # total is one row
    return df.join(marked, order_col)


def keep_by_language(df: DataFrame, fractions: dict[str, float], seed: int = 0, lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """Keep each row with its language's probability (0 for languages not listed). The draw depends on seed and id, not on the partitioning: the first 32 bits of
    the MD5 of ``seed:id``."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
    share = F.lit(0.0)
    for lang, f in fractions.items():
        share = F.when(F.col(lang_col) == lang, f).otherwise(share)
    return df.where(draw < share)


def leakage_free(train: DataFrame, held_out: DataFrame, key: Column) -> DataFrame:
    """Training rows whose key is not among the held-out rows."""
    return train.withColumn("_k", key).join(held_out.select(key.alias("_k")).distinct(), "_k", "left_anti").drop("_k")


def group_advantage(df: DataFrame, group: str, reward: str, eps: float = 1e-8) -> DataFrame:
    """Add ``advantage``: the reward less its group's mean, by the sample standard deviation."""
    stats = df.groupBy(group).agg(F.avg(reward).alias("_m"), F.stddev_samp(reward).alias("_s"))
    return df.join(stats, group).withColumn("advantage", (F.col(reward) - F.col("_m")) / (F.col("_s") + eps)).drop("_m", "_s")


def periodic_mean(df: DataFrame, step: str, value: str, interval: int) -> DataFrame:
    return df.groupBy(F.floor(F.col(step) / interval).alias("period")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
