"""Chat templates over encoded messages: ids, labels, padding, batches. JVM-side once the contents are encoded."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.tokenizer.codec import Codec, codec
from lexloom.tokenizer.vocab import BOS, EOS, IGNORE, PAD, SPECIAL_TO_ID, Merges

ROLES = {"user": "<USER>", "assistant": "<ASSISTANT>", "system": "<SYSTEM>", "tool": "<TOOL>"}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _mark(role: Column) -> Column:
    out = F.lit("<USER>")
    for r, m in ROLES.items():
        out = F.when(role == r, m).otherwise(out)
    return out


def _mark_id(role: Column) -> Column:
    out = F.lit(SPECIAL_TO_ID["<USER>"])
    for r, m in ROLES.items():
        out = F.when(role == r, SPECIAL_TO_ID[m]).otherwise(out)
    return out


def apply_template(messages: Column | str, generation_prompt: bool = True) -> Column:
    """Role mark and content of each message; a mark for the answer at the end. Unknown roles are users."""
    text = F.array_join(F.transform(_c(messages), lambda m: F.concat(_mark(m["role"]), m["content"])), "")
    return F.concat(text, F.lit("<ASSISTANT>")) if generation_prompt else text


def encode_messages(messages: Column | str, merges: Merges) -> Column:
    """``role, ids`` of each message, in one Arrow pass."""
    @F.pandas_udf("array<array<int>>")
    def ids(s: pd.Series) -> pd.Series:
        c: Codec = codec(merges)
        return pd.Series([None if m is None else [c.encode(t or "", True) for t in m] for m in s])

    m = _c(messages)
    return F.zip_with(m, ids(F.transform(m, lambda x: x["content"])), lambda x, y: F.struct(x["role"].alias("role"), y.alias("ids")))


def chat_ids(encoded: Column | str, generation_prompt: bool = True) -> Column:
    """Begin mark, then per message its role's mark and ids, an end mark after the assistant's; the answer's mark at the end."""
    end = lambda m: F.when(m["role"] == "assistant", F.array(F.lit(EOS))).otherwise(F.array().cast("array<int>"))
    body = F.flatten(F.transform(_c(encoded), lambda m: F.concat(F.array(_mark_id(m["role"])), m["ids"], end(m))))
    out = F.concat(F.array(F.lit(BOS)), body)
    return F.concat(out, F.array(F.lit(SPECIAL_TO_ID["<ASSISTANT>"]))) if generation_prompt else out


def chat_labels(encoded: Column | str) -> Column:
    """Aligned with :func:`chat_ids` without a prompt at the end: the assistant's ids and end marks, -100 elsewhere."""
    off = lambda n: F.array_repeat(F.lit(IGNORE), n)
    body = F.flatten(F.transform(_c(encoded), lambda m: F.when(m["role"] == "assistant", F.concat(off(F.lit(1)), m["ids"], F.array(F.lit(EOS)))).otherwise(off(F.size(m["ids"]) + 1))))
    return F.concat(off(F.lit(1)), body)


def with_marks(ids: Column | str, bos: bool = True, eos: bool = True) -> Column:
    parts = [F.array(F.lit(BOS))] * bos + [_c(ids)] + [F.array(F.lit(EOS))] * eos
    return F.concat(*parts)


def pad(ids: Column | str, length: int, left: bool = False, value: int = PAD) -> Column:
    """Cut on the right or fill up to ``length``."""
    x = F.slice(_c(ids), F.lit(1), F.lit(length))
    fill = F.array_repeat(F.lit(value), F.greatest(F.lit(0), F.lit(length) - F.size(x)))
    return F.concat(fill, x) if left else F.concat(x, fill)


def collate(df: DataFrame, batch: str = "batch", max_length: int = 512, pad_id: int = PAD) -> DataFrame:
    """Fill ``input_ids`` and ``labels`` up to the longest of their batch, after cutting them at ``max_length``."""
    cut = df.withColumns({"input_ids": F.slice("input_ids", F.lit(1), F.lit(max_length)), "labels": F.slice("labels", F.lit(1), F.lit(max_length))})
    longest = cut.groupBy(batch).agg(F.max(F.size("input_ids")).alias("_m"))
    both = cut.join(longest, batch)
    fill = lambda c, v: F.concat(F.col(c), F.array_repeat(F.lit(v), F.col("_m") - F.size(c)))
    return both.withColumns({"input_ids": fill("input_ids", pad_id), "labels": fill("labels", IGNORE)}).drop("_m")
