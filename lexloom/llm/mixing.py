"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies. A prefix sum of these within the source, in order of size, plus one
random offset per plan and source crosses integer boundaries; the document is used once for each crossing. Ordering by size makes
the sample stratified by size, so the tokens chosen keep close to the target. The prefix sum is the two-level one of
:mod:`lexloom.operators.prefix`; a source with a third of all documents spreads over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators.prefix import prefix_sum
from lexloom.session import materialize
from lexloom.tokenizer.codec import token_count
from lexloom.tokenizer.vocab import Merges

#: A plan table larger than this is joined by a shuffle instead of a broadcast.
BROADCAST_PLANS = 100_000


def source_key(c: Column) -> Column:
    """Stray blanks and capitals of a source do not matter."""
    return F.lower(F.trim(c))


@dataclass
class Mix:
    """``chosen``: ``mix_id, source, doc_id, tokens, copies``; ``plan``: a row per plan row with what it asks for and what is there."""

    chosen: DataFrame
    plan: DataFrame

    def report(self) -> DataFrame:
        """``plan`` with ``actual_tokens, actual_share, short`` (``short``: the repeat cap keeps the source below its target)."""
        got = self.chosen.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("_got"), F.sum("copies").alias("_copies"))
        p = self.plan.alias("p").join(got.alias("g"), (F.col("p.mix_id") == F.col("g.mix_id")) & (F.col("p.source") == F.col("g.source")), "left")
        rows = p.select("p.*", F.coalesce("g._got", F.lit(0)).alias("actual_tokens"), F.coalesce("g._copies", F.lit(0)).alias("documents_used"))
        whole = F.sum("actual_tokens").over(Window.partitionBy("mix_id"))
        return rows.withColumn("actual_share", F.when(whole > 0, F.col("actual_tokens") / whole))


def mix(documents: DataFrame, targets: DataFrame, merges: Merges, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """Choose documents for every plan of ``targets (mix_id, source, target_share, max_repeats)``.

    A plan row gets ``target_share`` of the tokens of all documents, but each document at most ``max_repeats`` times. A source that no
    document has gets nothing; documents whose source is null or in no plan count in the total only. Null texts have 0 tokens. Plan rows with a null
    key, share or cap are ignored; of repeated plan rows (same mix and source) the shares add up and the smallest cap holds. Each document row
    counts, repeated ids too. Empty tables give empty results (a plan without documents: a report of zeros)."""
    sized = materialize(
        documents.select(F.col(id_col).cast("long").alias("doc_id"), source_key(F.col(source_col)).alias("source"), F.coalesce(token_count(text_col, merges), F.lit(0)).cast("long").alias("tokens")),
        "sized",
    )
    total = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("_total"))
    sums = sized.where("source is not null").groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count(F.lit(1)).alias("source_documents"))
    asked = (
        targets.select("mix_id", source_key(F.col("source")).alias("source"), "target_share", "max_repeats")
        .dropna()
        .groupBy("mix_id", "source")
        .agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    )
    plan = asked.join(sums, "source", "left").crossJoin(F.broadcast(total))  # total is one row
    want = F.col("target_share") * F.col("_total")
    most = F.col("max_repeats") * F.col("source_tokens")
    plan = materialize(
        plan.withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0)))
        .withColumn("source_documents", F.coalesce("source_documents", F.lit(0)))
        .select(
            "mix_id", "source", "target_share", "max_repeats", "source_tokens", "source_documents", want.alias("target_tokens"), (want > most).alias("short"),
            F.when(F.col("source_tokens") > 0, F.least(want / F.col("source_tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0).alias("expected_copies"),
        ),
        "mixplan",
    )
    used = sized.join(plan.select("source").distinct(), "source", "left_semi")
    placed = prefix_sum(used, F.lit(1), ["tokens", "doc_id"], ["source"], "_at")
    few = plan.select("mix_id", "source", "expected_copies", "max_repeats")
    if plan.limit(BROADCAST_PLANS + 1).count() <= BROADCAST_PLANS:
        few = F.broadcast(few)
    rate = F.col("expected_copies")
    offset = F.pmod(F.xxhash64(F.lit(seed), "mix_id", "source"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # Rounding could cross one boundary too many where the rate is a whole number: the cap is applied once more.
    copies = F.least(F.floor(rate * (F.col("_at") + 1) + offset) - F.floor(rate * F.col("_at") + offset), F.col("max_repeats").cast("long")).cast("int")
    chosen = placed.join(few, "source").select("mix_id", "source", "doc_id", "tokens", copies.alias("copies")).where("copies > 0")
    return Mix(chosen, plan)
