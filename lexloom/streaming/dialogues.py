"""Incremental ingestion of dialogues: checks, exact deduplication and a template cap as stateful operators, shards per batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexloom.functions.clean import doc_hash
from lexloom.functions.dialogue import check_dialogue

SCHEMA = "dialogue_id long, text string, turns int, lang string, signature array<string>, created_at timestamp"


def read_stream(spark: SparkSession, path: str, schema: str = SCHEMA, fmt: str = "json", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def valid_dialogues(df: DataFrame) -> DataFrame:
    return df.where(check_dialogue("text"))


def stream_exact_dedup(df: DataFrame, time_col: str = "created_at", delay: str | None = None) -> DataFrame:
    """First arrival of each text. With ``delay`` the state of a text is dropped that long after its time; without, state grows with the distinct texts."""
    hashed = df.withColumn("doc_hash", doc_hash(F.coalesce(F.col("text"), F.lit(""))))
    if delay is None:
        return hashed.dropDuplicates(["doc_hash"])
    return hashed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["doc_hash"])


def stream_template_cap(df: DataFrame, cap: int = 3, idle_minutes: int | None = None) -> DataFrame:
    """At most ``cap`` dialogues per signature over the life of the query, smallest ids first within a batch. The count of a signature is forgotten
    after ``idle_minutes`` without a new one. Null and empty signatures are not capped.

    State is one number per signature; a hot signature's rows beyond the cap are read and skipped, never kept."""
    keyed = df.select("dialogue_id", "text", F.coalesce(F.when(F.size("signature") > 0, F.sha2(F.to_json("signature"), 256)), F.concat(F.lit("id:"), F.col("dialogue_id"))).alias("key"))

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = state.get[0] if state.exists else 0
        best: pd.DataFrame | None = None
        for pdf in batches:
            best = pdf if best is None else pd.concat([best, pdf])
            best = best.nsmallest(max(0, cap - n), "dialogue_id")
        kept = 0 if best is None else len(best)
        state.update((n + kept,))
        if idle_minutes:
            state.setTimeoutDuration(idle_minutes * 60_000)
        if kept:
            yield best[["dialogue_id", "text", "key"]]

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_minutes else GroupStateTimeout.NoTimeout
    return keyed.groupBy("key").applyInPandasWithState(keep, "dialogue_id long, text string, key string", "n int", "append", timeout)


def write_batches(df: DataFrame, path: str, checkpoint: str):
    """Run what has arrived: one Parquet folder per batch, named by its number, so that a batch that runs again replaces itself."""

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("shard", F.lit(number)).write.mode("overwrite").parquet(f"{path}/shard={number}")

    return df.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Extension: events and their value per type and time window with a watermark for late data."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", delay).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select("window.start", "window.end", "event_type", "n", "value")


def session_counts(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Extension: sessions per user, closed by a gap."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("session_window.start", "session_window.end", "user_id", "n")
