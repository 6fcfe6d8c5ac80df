"""Packing token streams into shards of exact size, and cutting shards into training sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from lexloom.operators.prefix import prefix_sum
from lexloom.session import materialize
from lexloom.tokenizer.vocab import EOS


def pick_dtype(vocab_size: Column | int) -> Column:
    v = F.lit(vocab_size) if isinstance(vocab_size, int) else vocab_size
    return F.when(v <= 65535, "uint16").otherwise("uint32")


def byte_tokens(text: Column | str) -> Column:
    """Ids 0-255 of the UTF-8 bytes: the tokenizer without merges. An Arrow batch of bytes becomes one of ids by its buffers, without a step per row; null for null."""

    @F.arrow_udf("array<int>")
    def ids(raw: pa.Array) -> pa.Array:
        raw = raw.cast(pa.large_binary())
        _, offsets, data = raw.buffers()
        at = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
        values = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
        known = pa.array(np.r_[raw.is_null().to_numpy(zero_copy_only=False), False])
        return pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32), mask=known.to_numpy(zero_copy_only=False)), pa.array(values.astype(np.int32)))

    return ids(F.encode(F.col(text) if isinstance(text, str) else text, "utf-8"))


#: Tokens that one task cuts into shards (one shard at least), the most such parts, and ids or bytes of a row that Python gets: a batch has a bound in bytes whatever the documents' length.
PART_TOKENS = 4 << 20
MOST_PARTS = 20_000
PIECE_LENGTH = 1 << 10
#: Tokens of the windows that a batch from Python has.
WINDOW_TOKENS = 1 << 18


def _stream(df: DataFrame, id_col: str, ids_col: str, add_eos: bool) -> tuple[DataFrame, Column, DataFrame]:
    """``_id, _ids`` of the documents that have tokens, the number of their ids, and ``_id, _n`` with the end mark, written once."""
    binary = df.schema[ids_col].dataType == BinaryType()
    docs = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(ids_col), F.lit(b"") if binary else F.array().cast("array<int>")).alias("_ids"))
    length = F.octet_length("_ids") if binary else F.size("_ids")
    docs = docs.where(length + int(add_eos) > 0)
    return docs, length, materialize(docs.select("_id", (length.cast("long") + int(add_eos)).alias("_n")), "sizes")


#: Makes record batches of the tokens of one or more shards of a size, given the number of the first.
Emit = Callable[[int, np.ndarray, int], Iterator[pa.RecordBatch]]


def _whole(shard: int, tokens: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    step = max(1, (1 << 20) // size) * size
    for i in range(0, len(tokens), step):
        some = tokens[i : i + step]
        ends = np.arange(0, len(some) + 1, size, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(shard + i // size + np.arange(len(ends) - 1), pa.int32()), pa.ListArray.from_arrays(ends, some)], ["shard", "tokens"])


def token_shards(df: DataFrame, tokens_per_shard: int, id_col: str = "doc_id", ids_col: str = "ids", add_eos: bool = True) -> DataFrame:
    """``shard, tokens``: the documents' ids in id order, with an end mark each, cut into shards of exactly ``tokens_per_shard``; the last is shorter.

    ``ids_col`` has arrays of ids, or binary values whose bytes are the ids (a quarter of the bytes to move). Null counts as empty. Ids of documents must be unique and not null.

    Only (id, size) goes through the prefix sum. It gives the documents at the borders of parts of whole shards, a small table; every document then goes to the parts
    it has tokens in, which is the only shuffle of its ids, and a task cuts the sorted stream of a part, holding one shard at a time."""
    return _cut(df, tokens_per_shard, id_col, ids_col, add_eos, _whole, "shard int, tokens array<int>")


def token_windows(df: DataFrame, tokens_per_shard: int, seq_len: int, stride: int | None = None, id_col: str = "doc_id", ids_col: str = "ids", add_eos: bool = True) -> DataFrame:
    """``shard, start, ids``: what :func:`sequence_windows` gives of :func:`token_shards`. Windows are cut where shards are, so that no row holds a shard, let alone one for each window."""
    step = stride or seq_len
    if min(seq_len, step) < 1:
        raise ValueError("seq_len and stride must be positive")

    def windows(shard: int, tokens: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
        each = max(0, (size - seq_len) // step + 1)
        most = max(1, WINDOW_TOKENS // seq_len)
        for i in range(0, len(tokens) // size * each, most):
            k, n = np.divmod(np.arange(i, min(i + most, len(tokens) // size * each)), each)
            ids = tokens[(k * size + n * step)[:, None] + np.arange(seq_len)]
            ends = np.arange(0, ids.size + 1, seq_len, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard + k, pa.int32()), pa.array(n * step, pa.int32()), pa.ListArray.from_arrays(ends, ids.ravel())], ["shard", "start", "ids"])

    return _cut(df, tokens_per_shard, id_col, ids_col, add_eos, windows, "shard int, start int, ids array<int>")


def shard_sizes(df: DataFrame, tokens_per_shard: int, id_col: str = "doc_id", ids_col: str = "ids", add_eos: bool = True) -> DataFrame:
    """``shard, n``: the tokens in each shard of :func:`token_shards`, from where each document's tokens begin and end in the stream. Only ids and sizes are moved.

    A shard has at most ``tokens_per_shard`` rows to add up; only a document that has more tokens is in several shards in full."""
    if tokens_per_shard < 1:
        raise ValueError("tokens_per_shard must be positive")
    _, _, sizes = _stream(df, id_col, ids_col, add_eos)
    at = prefix_sum(sizes, "_n", ["_id"], name="_at")
    held = at.select("_at", (F.col("_at") + F.col("_n")).alias("_end"), F.explode(F.expr(f"sequence(_at div {tokens_per_shard}, (_at + _n - 1) div {tokens_per_shard})")).alias("_s"))
    n = F.least("_end", (F.col("_s") + 1) * tokens_per_shard) - F.greatest("_at", F.col("_s") * tokens_per_shard)
    return held.select(F.col("_s").cast("int").alias("shard"), n.alias("n")).repartition("shard").groupBy("shard").agg(F.sum("n").alias("n"))


def _cut(df: DataFrame, tokens_per_shard: int, id_col: str, ids_col: str, add_eos: bool, emit: Emit, schema: str) -> DataFrame:
    if tokens_per_shard < 1:
        raise ValueError("tokens_per_shard must be positive")
    binary = df.schema[ids_col].dataType == BinaryType()
    docs, length, sizes = _stream(df, id_col, ids_col, add_eos)
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    part_tokens = max(min(PART_TOKENS, total // (2 * df.sparkSession.sparkContext.defaultParallelism)), total // MOST_PARTS, 1)
    per_part = -(-part_tokens // tokens_per_shard)
    width = per_part * tokens_per_shard
    at = prefix_sum(sizes, "_n", ["_id"], name="_at").select("_id", "_at", F.expr(f"(_at + {width - 1}) div {width}").alias("_from"), F.expr(f"(_at + _n - 1) div {width}").alias("_to"))
    # The documents that hold the first token of a part, in order of the parts: at most MOST_PARTS and one.
    borders = at.where("_from <= _to").select(F.explode(F.sequence("_from", "_to")).alias("_part"), "_id", "_at").orderBy("_part").collect()
    firsts, starts = pd.Series([r["_id"] for r in borders]).to_numpy(), np.array([r["_at"] for r in borders], np.int64)
    inside = starts < np.arange(len(starts)) * width  # the document begins in the part before

    @F.pandas_udf("first int, last int")
    def parts(ids: pd.Series) -> pd.DataFrame:
        x = ids.to_numpy()
        low, last = np.searchsorted(firsts, x, "left"), np.searchsorted(firsts, x, "right") - 1
        on_border = low <= last
        first = np.where(on_border, low - inside[np.minimum(low, len(firsts) - 1)], last)
        return pd.DataFrame({"first": first.astype(np.int32), "last": last.astype(np.int32)})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, shard, held = -1, 0, 0, []
        for batch in batches:
            keys, marks, lists = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False), batch.column(1)
            lists = lists.cast(pa.large_binary() if binary else pa.large_list(pa.int32()))
            offsets = np.frombuffer(lists.buffers()[1], np.int64)[lists.offset : lists.offset + len(lists) + 1] if len(lists) else np.zeros(1, np.int64)
            values = np.frombuffer(lists.buffers()[2] or b"", np.uint8) if binary else lists.values.to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)] if len(keys) else [0]
            for a, b in zip(edges, edges[1:]):
                if keys[a] != part:
                    if held:
                        last = np.concatenate(held)
                        yield from emit(shard, last, len(last))
                    part = int(keys[a])
                    at, shard, held = int(starts[part]), part * per_part, []
                tokens = values[offsets[a] : offsets[b]].astype(np.int32)
                if add_eos:
                    tokens = np.insert(tokens, (offsets[a + 1 : b + 1] - offsets[a])[marks[a:b]], EOS)
                own = tokens[max(0, part * width - at) : max(0, (part + 1) * width - at)]
                at += len(tokens)
                held.append(own)
                if sum(map(len, held)) >= tokens_per_shard:
                    own = np.concatenate(held)
                    whole = len(own) // tokens_per_shard * tokens_per_shard
                    yield from emit(shard, own[:whole], tokens_per_shard)
                    shard += whole // tokens_per_shard
                    held = [own[whole:]]
                held = [x for x in held if len(x)]
        if held:
            last = np.concatenate(held)
            yield from emit(shard, last, len(last))

    placed = docs.withColumn("_p", parts("_id")).select(F.explode(F.sequence("_p.first", "_p.last")).alias("_part"), "_id", "_ids").repartition("_part").sortWithinPartitions("_part", "_id")
    piece = lambda i: F.substring("_ids", i + 1, F.lit(PIECE_LENGTH)) if binary else F.slice("_ids", i + 1, F.lit(PIECE_LENGTH))
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0)), F.lit(PIECE_LENGTH)), lambda i: F.struct(piece(i).alias("ids"), (i + PIECE_LENGTH >= length).alias("last")))
    return placed.select("_part", F.explode(pieces).alias("p")).select("_part", "p.ids", "p.last").mapInArrow(cut, schema)


def shard_manifest(shards: DataFrame, vocab_size: int) -> DataFrame:
    """One row: dtype, number of shards, tokens in all, and name and size of each shard in order. ``shards`` has their tokens or, as from :func:`shard_sizes`, their sizes ``n``."""
    n = F.col("n") if "n" in shards.columns else F.size("tokens")
    rows = shards.select("shard", F.struct(F.format_string("shard_%05d.bin", "shard").alias("file"), n.cast("long").alias("tokens")).alias("s"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("shard", "s"))), lambda x: x["s"])  # by number: names of more than five digits sort otherwise
    return rows.agg(F.max(pick_dtype(vocab_size)).alias("dtype"), F.count(F.lit(1)).alias("num_shards"), F.coalesce(F.sum("s.tokens"), F.lit(0)).alias("total_tokens"), listed.alias("shards"))


def sequence_windows(shards: DataFrame, seq_len: int, stride: int | None = None) -> DataFrame:
    """``shard, start, ids``: full windows of ``seq_len`` tokens every ``stride`` (default: their length); none crosses a shard, the rest at its end is dropped."""
    step = stride or seq_len
    fits = shards.where(F.size("tokens") >= seq_len)
    starts = fits.select("shard", "tokens", F.explode(F.sequence(F.lit(0), F.size("tokens") - seq_len, F.lit(step))).alias("start"))
    return starts.select("shard", "start", F.slice("tokens", F.col("start") + 1, seq_len).alias("ids"))


def shifted_pairs(windows: DataFrame) -> DataFrame:
    """Inputs and targets of next-token prediction: all but the last and all but the first token."""
    n = F.size("ids")
    return windows.select("shard", "start", F.slice("ids", F.lit(1), n - 1).alias("x"), F.slice("ids", F.lit(2), n - 1).alias("y"))


def batches(df: DataFrame, order: list[str], size: int, drop_last: bool = True) -> DataFrame:
    """Add ``batch`` in a total order; an incomplete last batch is dropped if asked."""
    placed = prefix_sum(df, F.lit(1), order, name="_row").withColumn("batch", F.floor(F.col("_row") / size)).drop("_row")
    if not drop_last:
        return placed
    full = placed.groupBy("batch").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == size).select("batch")
    return placed.join(full, "batch", "left_semi")


def shuffled_shards(shards: DataFrame, seed: int, workers: int, worker: int) -> DataFrame:
    """The share of one of several workers of the shards in a seeded random order."""
    if not 0 <= worker < workers:
        raise ValueError("worker must be below workers")
    order = Window.orderBy(F.xxhash64(F.lit(seed), "shard"), "shard")
    few = shards.select("shard").distinct().withColumn("position", F.row_number().over(order) - 1)  # one row per shard: a small list
    return shards.join(few.where(F.pmod("position", F.lit(workers)) == worker), "shard")


def random_starts(shards: DataFrame, seq_len: int, per_shard: int, seed: int) -> DataFrame:
    """``shard, draw, ids``: windows at seeded random starts."""
    draws = shards.where(F.size("tokens") > seq_len).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(per_shard - 1))))
    start = F.pmod(F.xxhash64(F.lit(seed), "shard", "draw"), (F.size("tokens") - seq_len).cast("long")).cast("int")
    return draws.select("shard", "draw", F.slice("tokens", start + 1, seq_len).alias("ids"))
