"""Arithmetic of model sizes and training schedules over a table of configurations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Name, vocabulary, hidden size, layers, heads, key-value heads, feed-forward size, tied embeddings.
CONFIGS = [
    ("100m", 32768, 512, 16, 8, 4, 2048, False),
    ("300m", 32768, 1024, 24, 16, 8, 3072, False),
    ("1b", 32768, 1536, 24, 24, 8, 6144, False),
    ("3b", 32768, 2560, 32, 32, 8, 10240, False),
    ("7b", 32768, 4096, 32, 32, 8, 14336, False),
    ("13b", 32768, 5120, 40, 40, 8, 13824, False),
    ("70b", 32768, 8192, 80, 64, 8, 28672, False),
    ("405b", 128000, 16384, 126, 128, 8, 53248, False),
    ("800b", 256000, 20480, 170, 128, 16, 61440, False),
]
CONFIG_SCHEMA = "name string, vocab_size long, hidden_size long, num_layers long, num_heads long, num_kv_heads long, intermediate_size long, tie_embeddings boolean"


def configs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONFIGS, CONFIG_SCHEMA)


def parameter_breakdown(df: DataFrame) -> DataFrame:
    """Parameters by part of a decoder with grouped key-value heads, a gated feed-forward part and two norms per layer."""
    h, layers = F.col("hidden_size"), F.col("num_layers")
    head = F.expr("hidden_size div num_heads")
    q, kv = F.col("num_heads") * head, F.col("num_kv_heads") * head
    emb = F.col("vocab_size") * h
    parts = df.select(
        "name", emb.alias("embedding"), (layers * (h * q + 2 * h * kv + q * h)).alias("attention"), (layers * 3 * h * F.col("intermediate_size")).alias("ffn"),
        (layers * 2 * h + h).alias("norm"), F.when(F.col("tie_embeddings"), F.lit(0).cast("long")).otherwise(emb).alias("lm_head"),
    )
    return parts.withColumn("total", F.col("embedding") + F.col("attention") + F.col("ffn") + F.col("norm") + F.col("lm_head"))


def flops_per_token(params: Column | str) -> Column:
    return 6 * (F.col(params) if isinstance(params, str) else params)


def training_estimate(df: DataFrame, params: str, tokens: float, accelerators: int, tflops: float, utilisation: float) -> DataFrame:
    """``training_flops`` and ``training_days`` on a number of accelerators at a share of their peak."""
    flops = flops_per_token(params).cast("double") * tokens
    return df.withColumn("training_flops", flops).withColumn("training_days", flops / (accelerators * tflops * 1e12 * utilisation) / 86400)


def memory_estimate(df: DataFrame, params: str, element_bytes: int = 2, optimizer_copies: int = 3, batch: int = 0, seq_len: int = 0) -> DataFrame:
    """GB of weights and gradients, of an optimizer with 4-byte copies, and of activations (needs ``num_layers, hidden_size``; a batch of 0 has none)."""
    gb = F.col(params).cast("double") / 1e9
    kept = F.col("num_layers") * F.col("hidden_size") * F.lit(2.0 * batch * seq_len * element_bytes) / 1e9 if batch else F.lit(0.0)
    parts = {"weights_gb": gb * element_bytes, "gradients_gb": gb * element_bytes, "optimizer_gb": gb * 4 * optimizer_copies, "activations_gb": kept}
    return df.withColumns(parts).withColumn("total_gb", F.col("weights_gb") + F.col("gradients_gb") + F.col("optimizer_gb") + F.col("activations_gb"))


# Least accelerator memory (GB) by configuration.
CONFIG_VRAM = [("100m", 3.0), ("300m", 6.0), ("1b", 18.0), ("3b", 45.0), ("7b", 90.0), ("13b", 160.0), ("70b", 800.0), ("405b", 4600.0), ("800b", 9000.0)]


#: Configurations to choose from; their table is broadcast.
MAX_CONFIGS = 1000


def recommend(devices: DataFrame, needs: DataFrame) -> DataFrame:
    """For each ``device, vram_gb`` the largest configuration that fits, or null. ``needs`` is a table of a few configurations."""
    if needs.limit(MAX_CONFIGS + 1).count() > MAX_CONFIGS:
        raise ValueError(f"more than {MAX_CONFIGS} configurations")
    fits = devices.join(F.broadcast(needs), F.col("min_vram_gb") <= F.col("vram_gb"), "left")
    return fits.groupBy("device", "vram_gb").agg(F.max_by("config", "min_vram_gb").alias("config"))


def derived_max_steps(tokens: Column, batch: Column, seq_len: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(tokens / (batch * seq_len))).cast("long")


def warmup_cosine(step: Column | str, warmup: int, steps: int, base: float, low: float = 0.0) -> Column:
    """Linear rise over ``warmup`` steps, then a half cosine down to ``low``."""
    s = F.col(step) if isinstance(step, str) else step
    progress = F.least(F.lit(1.0), (s - warmup) / max(1, steps - warmup))
    return F.when(s < warmup, base * s / max(1, warmup)).otherwise(low + 0.5 * (base - low) * (1 + F.cos(F.lit(math.pi) * progress)))


def warmup_cosine_from_one(step: Column | str, warmup: int, steps: int, base: float, low: float = 0.0) -> Column:
    """The variant whose first step already has a rate of ``base / warmup``."""
    s = F.col(step) if isinstance(step, str) else step
    progress = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (s - warmup) / max(1, steps - warmup)))
    return F.when(s < warmup, base * (s + 1) / max(1, warmup)).otherwise(low + 0.5 * (base - low) * (1 + F.cos(F.lit(math.pi) * progress)))


def mean_loss(df: DataFrame, by: list[str], loss: str, order: list[str], batches: int = 50) -> DataFrame:
    """``loss, n`` per key: the mean of its first ``batches`` losses in order, each batch with the same weight; 0 where none is known."""
    from lexloom.operators.dedup import capped_per_key

    first = capped_per_key(df, by, order, batches)
    return first.groupBy(*by).agg(F.coalesce(F.avg(loss), F.lit(0.0)).alias("loss"), F.count(loss).alias("n"))


def ema(values: Column | str, decay: float) -> Column:
    """Exponential moving average of an ordered array; the first value starts it."""
    v = F.col(values) if isinstance(values, str) else values
    return F.when(F.size(v) > 0, F.aggregate(F.slice(v, 2, F.greatest(F.lit(1), F.size(v))), F.get(v, F.lit(0)).cast("double"), lambda a, x: a * decay + x * (1 - decay)))
