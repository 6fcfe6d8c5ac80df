"""Queries of the training-data operators, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import confusables, langid, mixing, near_dup, packing, pair_defects, readability, text_quality, token_budget
from lexloom.session import read_table, spread
from lexloom.tokenizer.vocab import read_merges

#: Dialogues: shingles of three words, 60 % in common.
DIALOGUES = near_dup.Params(words=3, similarity=0.6)


def _near(spark: SparkSession, d: str) -> near_dup.NearDuplicates:
    return near_dup.near_duplicates(read_table(spark, d, "shards"), "dialogue_id", "text", DIALOGUES)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).pairs()


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).groups().withColumnRenamed("id", "dialogue_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    check = token_budget.budget_check(spread(read_table(spark, d, "shards")), read_table(spark, d, "token_budget"), read_merges(read_table(spark, d, "merges")))
    return check.where("wrong").select("shard", "source", "lang", "topic").distinct()


def p2_totals(spark: SparkSession, d: str) -> DataFrame:
    keys = {"source": F.col("source"), "lang": F.coalesce(langid.recorded(F.col("lang")), F.lit("none")), "topic": F.col("topic")}
    return token_budget.slice_tokens(spread(read_table(spark, d, "shards")), read_merges(read_table(spark, d, "merges")), keys)


def _languages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    raw, shards = read_table(spark, d, "raw"), read_table(spark, d, "shards")
    net = langid.fit([(raw, "raw_id", "text", "lang"), (shards, "dialogue_id", "text", "lang")])
    written = text_quality.text_stats(spread(raw.select("raw_id", "lang", "text")))
    a = langid.label_languages(written, net, "raw_id", skip=F.col("quality.kind") == "junk", carry=F.col("lang"))
    b = langid.label_languages(spread(shards.select("dialogue_id", "lang", "text")), net, "dialogue_id", dialogues=True, carry=F.col("lang"))
    named = lambda df, t: df.withColumnsRenamed({"id": "rec_id", "carried": "recorded"}).withColumn("tab_name", F.lit(t))
    return named(a, "raw"), named(b, "shards")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    raw, shards = _languages(spark, d)
    off = F.col("lang").isNotNull() & ~langid.recorded(F.col("recorded")).eqNullSafe(F.col("lang"))
    whole = F.when(off, F.array(F.struct(F.lit(0).alias("seg_no"), F.col("lang").alias("lang")))).otherwise(F.array())
    parts = F.when(F.col("lang") == langid.MIXED, F.transform("segments", lambda s: F.struct(s["seg_no"].alias("seg_no"), s["lang"].alias("lang")))).otherwise(F.array())
    # A record and its segments come out of one pass of the network.
    rows = raw.withColumn("_x", F.concat(whole, parts)).unionByName(shards.withColumn("_x", whole))
    return rows.select("tab_name", "rec_id", F.explode("_x").alias("_x")).select("tab_name", "rec_id", "_x.seg_no", "_x.lang").distinct()


def p3_labels(spark: SparkSession, d: str) -> DataFrame:
    raw, shards = _languages(spark, d)
    return raw.unionByName(shards).select("tab_name", "rec_id", "lang", "confidence", F.to_json("segments").alias("segments"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return confusables.same_look_pairs(confusables.look_classes(spread(read_table(spark, d, "raw").select("raw_id", "text")), "raw_id", "text"))


def p4_canonical(spark: SparkSession, d: str) -> DataFrame:
    return spread(read_table(spark, d, "raw").select("raw_id", "text")).select("raw_id", confusables.canonical("text").alias("canonical"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_defects(spark, d).where("defect is not null").select("sample_id", "defect")


def p5_defects(spark: SparkSession, d: str) -> DataFrame:
    pairs = spread(read_table(spark, d, "quality_report").select("sample_id", "prompt", "reply"))
    return pair_defects.pair_defects(pairs).withColumnRenamed("id", "sample_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    # Redelivered rows are one record; the grouping also keeps the filter from being pushed into the statistics, which would compute them twice.
    return p6_stats(spark, d).groupBy("raw_id").agg(F.min("kind").alias("kind")).where("kind <> 'prose'")


def p6_stats(spark: SparkSession, d: str) -> DataFrame:
    return text_quality.text_stats(spread(read_table(spark, d, "raw").select("raw_id", "text"))).select("raw_id", "quality.*")


def p6_basic(spark: SparkSession, d: str) -> DataFrame:
    return p6_stats(spark, d).select("raw_id", "n_words", "n_lines", "distinct_share", "letter_share")


def p6_rules(spark: SparkSession, d: str) -> DataFrame:
    """The published rules each text fails, and the statistics they look at."""
    rows = p6_stats(spark, d)
    known = F.array(F.lit("empty"), *[F.lit(r) for r in text_quality.PUBLISHED])
    return rows.select("raw_id", "n_words", "common_words", *[F.round(c, 9).alias(c) for c in ("mean_word_length", "symbol_ratio", "bullet_share", "stop_line_share")], F.array_join(F.array_intersect("reasons", known), ",").alias("failed"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(read_table(spark, d, "documents"), read_table(spark, d, "pack_specs"), read_merges(read_table(spark, d, "merges")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_containers(spark, d).where("piece = 1").select("spec_id", "doc_id").distinct()


def _mix(spark: SparkSession, d: str) -> mixing.Mix:
    return mixing.mix(spread(read_table(spark, d, "documents").select("doc_id", "source", "text")), read_table(spark, d, "mix_targets"), read_merges(read_table(spark, d, "merges")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).report().where("short").select("mix_id", "source")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).chosen


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).report()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_levels(spark, d).select("doc_id", "reading_level").distinct()


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    return readability.reading_levels(spread(read_table(spark, d, "documents").select("doc_id", "text")), read_table(spark, d, "reading_labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (p1_found, p1_groups, p2_found, p2_totals, p3_found, p3_labels, p4_found, p4_canonical, p5_found, p5_defects, p6_found, p6_stats, p6_basic, p6_rules, p7_found, p7_containers, p8_found, p8_mix, p8_report, p9_found, p9_levels)
    return {f.__name__: f for f in every}
