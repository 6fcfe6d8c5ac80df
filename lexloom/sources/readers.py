"""Readers of corpora: JSON lines, paragraphs of text files, Parquet rows, messages, shards, raw token files."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lexloom.functions.clean import strip, titled_document
from lexloom.functions.patterns import WS

#: Files of a folder that are read, in this order.
EXTENSIONS = ("txt", "jsonl", "md", "html")


def _files(spark: SparkSession, path: str, ext: str, whole: bool) -> DataFrame:
    """The text of files with an extension anywhere below ``path`` (or the file itself), with ``file_path``."""
    reader = spark.read.option("recursiveFileLookup", True)
    if not path.endswith(f".{ext}"):
        reader = reader.option("pathGlobFilter", f"*.{ext}")
    return reader.text(path, wholetext=whole).select("value", F.col("_metadata.file_path").alias("file_path"))


def parse_jsonl(value: Column, keep_other: bool = False) -> Column:
    """The document of a JSON line: the string itself or an object's ``text``; null for anything else, also for invalid lines."""
    parsed = F.try_parse_json(strip(value))
    kind = F.schema_of_variant(parsed)
    found = F.when(kind == "STRING", F.try_variant_get(parsed, "$", "string")).otherwise(F.try_variant_get(parsed, "$.text", "string"))
    return F.coalesce(found, F.when(F.startswith(kind, F.lit("OBJECT")), F.to_json(parsed))) if keep_other else found


def read_jsonl(spark: SparkSession, path: str, keep_other: bool = False) -> DataFrame:
    """``text, file_path``: a JSON string or an object's ``text`` per line. Blank and invalid lines are skipped.

    Objects without ``text`` are skipped, or with ``keep_other`` given as they are. ``spark.read.json`` would lose bare strings."""
    ext = "json" if path.endswith(".json") else "jsonl"
    lines = _files(spark, path, ext, False).where(strip("value") != "")
    return lines.select(parse_jsonl(F.col("value"), keep_other).alias("text"), "file_path").where("text is not null")


def paragraphs(text: Column) -> Column:
    """Non-blank lines joined by line feeds; blank lines separate."""
    lines = F.regexp_replace(F.make_valid_utf8(text), r"\r\n?", "\n")
    blocks = F.split(lines, rf"\n(?:[{WS}]*\n)+")
    return F.filter(F.transform(blocks, strip), lambda x: x != "")


def read_paragraphs(spark: SparkSession, path: str, ext: str = "txt") -> DataFrame:
    """``text, file_path`` per paragraph of text-like files. Broken UTF-8 becomes U+FFFD; tags are not parsed."""
    return _files(spark, path, ext, True).select(F.explode(paragraphs(F.col("value"))).alias("text"), "file_path")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One file by its extension, or a folder's text, JSON-lines, Markdown and HTML files, recursively."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else None
    if ext in ("jsonl", "json"):
        return read_jsonl(spark, path)
    if ext in EXTENSIONS:
        return read_paragraphs(spark, path, ext)
    parts = [read_jsonl(spark, path) if e == "jsonl" else read_paragraphs(spark, path, e) for e in EXTENSIONS]
    return reduce(DataFrame.unionByName, parts)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """For tokenizer statistics: whole text and Markdown files as one document each, every JSON line."""
    whole = [_files(spark, path, e, True).select(F.make_valid_utf8("value").alias("text"), "file_path") for e in ("txt", "md")]
    return reduce(DataFrame.unionByName, [*whole, read_jsonl(spark, path, keep_other=True)])


def persona_dialogue(utterances: Column, dialog: Column, turns: Column, history: Column) -> Column:
    """A dialogue from the last entry of the first list that is there; its history, else the row's, roles by position."""
    last = F.coalesce(*[F.try_element_at(x, F.lit(-1))["history"] for x in (utterances, dialog, turns)])
    h = F.coalesce(last, history)
    return F.array_join(F.transform(h, lambda m, i: F.concat(F.when(i % 2 == 0, "USER: ").otherwise("ASSISTANT: "), strip(m))), "\n\n")


def read_rows(spark: SparkSession, path: str, extract: Callable[[DataFrame], Column], max_rows: int | None = None, min_chars: int = 30, order: Sequence[str] = ()) -> DataFrame:
    """``text`` of Parquet rows by an extracting expression; empty and short ones are left out, at most ``max_rows`` are taken."""
    df = spark.read.parquet(path)
    out = df.withColumn("_t", strip(extract(df))).where(F.length("_t") >= min_chars)
    if order:
        out = out.orderBy(*order)
    out = out.select(F.col("_t").alias("text"))
    return out.limit(max_rows) if max_rows is not None else out


# Name, extracting expression and share of the row quota of known sources.
PRESETS: dict[str, tuple[Callable[[DataFrame], Column], float]] = {
    "encyclopedia_ru": (lambda df: titled_document(df["title"], df["text"]), 1.0),
    "encyclopedia_en": (lambda df: titled_document(df["title"], df["text"]), 1.0),
    "plain": (lambda df: df["text"], 0.15),
    "persona_dialogues": (lambda df: persona_dialogue(*[df[c] for c in ("utterances", "dialog", "turns", "history")]), 1.0),
}


def read_preset(spark: SparkSession, name: str, path: str, max_rows: int | None = None) -> DataFrame:
    if name not in PRESETS:
        raise ValueError(f"unknown source {name}; known: {', '.join(sorted(PRESETS))}")
    extract, share = PRESETS[name]
    return read_rows(spark, path, extract, None if max_rows is None else int(max_rows * share))


def read_presets(spark: SparkSession, paths: dict[str, str], max_rows: int) -> DataFrame:
    """``text, preset`` of several sources, each within its quota. A source whose path does not exist gives no rows; any other fault is raised."""
    parts = []
    for name, path in paths.items():
        try:
            parts.append(read_preset(spark, name, path, max_rows).withColumn("preset", F.lit(name)))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "text string, preset string")


MESSAGES = "messages array<struct<role:string,content:string>>"


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """``messages`` of JSON lines; invalid JSON fails, empty lists are left out."""
    return spark.read.schema(MESSAGES).option("mode", "FAILFAST").json(path).where(F.size("messages") > 0)


SHARD_META = "shard int, dialogues long, turns long, tokens long, size_mb double"


def scan_shard_meta(spark: SparkSession, path: str) -> DataFrame:
    """Largest index and sums over the meta files of a folder; unreadable ones are skipped."""
    meta = spark.read.schema(SHARD_META).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.meta.json").json(path).where("shard is not null")
    return meta.agg(F.coalesce(F.max("shard"), F.lit(-1)).alias("last_shard"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("dialogues", "turns", "tokens", "size_mb")])


def read_token_files(spark: SparkSession, path: str, dtype: str = "uint16") -> DataFrame:
    """``file, tokens`` of raw little-endian token files."""
    kind = np.dtype(dtype).newbyteorder("<")

    @F.pandas_udf("array<int>")
    def unpack(s: pd.Series) -> pd.Series:
        return s.map(lambda b: np.frombuffer(b, kind).astype(np.int32))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), unpack("content").alias("tokens"))


def read_shard_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``position, file, tokens`` of the shards a folder's manifest names, in its order; files it does not name are not read.

    The manifest is one small JSON file; sizes that differ from it fail."""
    rows = spark.read.option("multiLine", True).json(f"{path}/shards_manifest.json").select("dtype", F.posexplode("shards").alias("position", "s")).select("dtype", "position", "s.*")
    head = rows.limit(1).collect()
    listed = rows.select("position", "file", F.col("tokens").alias("_n"))
    found = read_token_files(spark, path, head[0].dtype if head else "uint16")
    both = listed.join(found, "file", "left")
    ok = F.col("_n") == F.size("tokens")
    return both.select("position", "file", F.when(ok, F.col("tokens")).otherwise(F.raise_error(F.concat(F.lit("missing or cut: "), F.col("file"))).cast("array<int>")).alias("tokens"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``file, bytes, sha256`` of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def load_config(text: str, schema: dict) -> dict:
    """``section: / key: value`` configurations. ``schema`` maps keys to types, or sections to such maps; unknown keys are dropped, numbers in quotes
    become numbers, a missing section is empty."""
    out: dict = {k: {} for k, v in schema.items() if isinstance(v, dict)}
    section: str | None = None
    for line in text.splitlines():
        bare = line.split("#", 1)[0].rstrip()
        key, colon, value = bare.partition(":")
        name, value = key.strip(), value.strip().strip("'\"")
        if not colon or not name:
            continue
        if key[:1] not in (" ", "\t"):
            section = name if not value else None
        known, at = (schema.get(section), out.get(section)) if section and name != section else (schema, out)
        kind = known.get(name) if isinstance(known, dict) else None
        if value and isinstance(kind, type):
            at[name] = value.lower() in ("true", "yes", "1") if kind is bool else int(float(value)) if kind is int else kind(value)
    return out


def config_frame(spark: SparkSession, configs: dict[str, dict]) -> DataFrame:
    """``name, section, key, value``: several configurations as one table."""
    rows = [(name, s if isinstance(v, dict) else "", k, str(x)) for name, c in configs.items() for s, v in c.items() for k, x in (v.items() if isinstance(v, dict) else [(s, v)])]
    return spark.createDataFrame(rows, "name string, section string, key string, value string")
