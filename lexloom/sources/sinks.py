"""Writers: token shards with a manifest, dialogue shards with meta files, messages, vocabularies and reports."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.dialogue import text_to_messages, trainable
from lexloom.operators.prefix import prefix_sum
from lexloom.operators.shards import shard_manifest, token_shards
from lexloom.session import is_local, materialize, shared_dir
from lexloom.tokenizer.codec import encode
from lexloom.tokenizer.vocab import Merges, vocab_document


def _put(spark, path: str, text: str) -> None:
    """One small file through the cluster's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_token_shards(df: DataFrame, path: str, merges: Merges, vocab_size: int, tokens_per_shard: int = 1_000_000, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encode, pack and write ``shard, tokens`` as Parquet with a manifest beside it; returns the shards as written."""
    spark = df.sparkSession
    encoded = df.select(id_col, encode(F.coalesce(F.col(text_col), F.lit("")), merges).alias("ids"))
    token_shards(encoded, tokens_per_shard, id_col).write.mode("overwrite").parquet(f"{path}/shards")
    shards = spark.read.parquet(f"{path}/shards")
    row = shard_manifest(shards, vocab_size).first()
    _put(spark, f"{path}/shards_manifest.json", json.dumps(row.asDict(recursive=True)))
    return shards


def write_token_files(shards: DataFrame, path: str, vocab_size: int) -> DataFrame:
    """Raw token files, one per shard, written by the executors; returns ``file, tokens`` (sizes).

    ``path`` is a URI of a file system the executors share (hdfs, s3, gs, ...). A plain path is taken only with a local master or below the
    shared folder of the session, as it would land on the executors' own disks."""
    kind = "<u2" if vocab_size <= 65535 else "<u4"
    spark = shards.sparkSession
    bare = path.removeprefix("file://")
    if bare.startswith("/") and not is_local(spark) and not bare.startswith(shared_dir(spark).removeprefix("file://")):
        raise ValueError(f"{path} is on each executor's own disk; use a shared file system")

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        store.create_dir(root, recursive=True)
        for pdf in batches:
            rows = []
            for shard, tokens in zip(pdf["shard"], pdf["tokens"]):
                name = f"shard_{shard:05d}.bin"
                part = f"{root}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(np.asarray(tokens).astype(kind).tobytes())
                store.move(part, f"{root}/{name}")  # a task that is run again leaves the same file
                rows.append((name, len(tokens)))
            yield pd.DataFrame(rows, columns=["file", "tokens"])

    return shards.select("shard", "tokens").mapInPandas(save, "file string, tokens long")


def write_dialogue_shards(df: DataFrame, path: str, order_col: str = "dialogue_id", dialogues_per_shard: int = 2000) -> DataFrame:
    """JSON lines in shards of a fixed number of dialogues in order, and a meta table; returns ``shard, dialogues, turns, tokens, size_mb``."""
    at = prefix_sum(df.select(order_col), F.lit(1), [order_col], name="_row")
    rows = df.join(at, order_col).withColumn("shard", F.floor(F.col("_row") / dialogues_per_shard).cast("int")).drop("_row")
    rows.repartition("shard").sortWithinPartitions("shard", order_col).write.mode("overwrite").partitionBy("shard").json(f"{path}/dialogues")
    meta = dialogue_meta(rows)
    meta.write.mode("overwrite").json(f"{path}/meta")
    return df.sparkSession.read.schema(meta.schema).json(f"{path}/meta")


def dialogue_meta(df: DataFrame) -> DataFrame:
    size = F.sum(F.octet_length("text")) / F.lit(1024.0 * 1024.0)
    return df.groupBy("shard").agg(F.count(F.lit(1)).alias("dialogues"), F.sum("turns").alias("turns"), F.sum("tokens").alias("tokens"), size.alias("size_mb"))


def write_sft(df: DataFrame, path: str, text_col: str = "text") -> int:
    """``messages`` of dialogues that can be trained on, as JSON lines; returns their number without a second pass."""
    from pyspark.sql import Observation

    seen = Observation()
    rows = df.select(text_to_messages(text_col).alias("messages")).where(trainable("messages")).observe(seen, F.count(F.lit(1)).alias("n"))
    rows.write.mode("overwrite").json(path)
    return seen.get["n"]


def write_tokenizer(spark, path: str, merges: Merges, config: dict | None = None) -> None:
    """Vocabulary, merges and configuration as JSON files."""
    _put(spark, f"{path}/vocab.json", json.dumps(vocab_document(merges)))
    _put(spark, f"{path}/merges.json", json.dumps([list(m) for m in merges]))
    _put(spark, f"{path}/tokenizer_config.json", json.dumps({"type": "byte_bpe", **(config or {})}))


def read_tokenizer(spark, path: str) -> Merges:
    text = spark.read.option("wholetext", True).text(f"{path}/merges.json").first().value
    return tuple((a, b) for a, b in json.loads(text))


def ensure_tokenizer(spark, path: str) -> Merges:
    """The merges of a stored tokenizer. Tokenizers are never trained here: where none is stored, this fails and says so."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/merges.json")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(f"no tokenizer at {path}; store one with write_tokenizer")
    return read_tokenizer(spark, path)


#: Rows of a report that are written as one file.
REPORT_ROWS = 100_000


def write_report(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """A result as JSON lines: one file up to ``REPORT_ROWS`` rows, one per partition beyond."""
    rows = materialize(df.select(*columns) if columns else df, "report")
    small = rows.limit(REPORT_ROWS + 1).count() <= REPORT_ROWS
    (rows.coalesce(1) if small else rows).write.mode("overwrite").json(path)
