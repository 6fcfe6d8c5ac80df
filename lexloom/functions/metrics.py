"""Measures of generated texts and of answers, on arrays of tokens or on strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.binding import let
from lexloom.functions.clean import _c, strip, words
from lexloom.functions.dialogue import ngrams
from lexloom.functions.patterns import WS


def repetition_ratio(tokens: Column | str, n: int = 4) -> Column:
    """Distinct n-grams that occur more than once, per n-gram; 0 below n tokens."""
    zero = F.struct(F.lit(None).cast("string").alias("prev"), F.lit(0).alias("run"), F.lit(0).alias("again"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(a["prev"].eqNullSafe(x), a["run"] + 1).otherwise(1)
        return F.struct(x.alias("prev"), run.alias("run"), (a["again"] + F.when(run == 2, 1).otherwise(0)).alias("again"))

    share = lambda g: F.when(F.size(g) > 0, F.aggregate(F.sort_array(g), zero, step, lambda a: a["again"]) / F.size(g)).otherwise(0.0)
    return let(ngrams(F.transform(_c(tokens), lambda x: x.cast("string")), n), share)


def distinct_ratio(tokens: Column | str) -> Column:
    t = _c(tokens)
    return F.when(F.size(t) > 0, F.size(F.array_distinct(t)) / F.size(t)).otherwise(0.0)


def max_run_ratio(tokens: Column | str) -> Column:
    """Longest run of equal tokens, per token."""
    strings = F.transform(_c(tokens), lambda x: x.cast("string"))
    zero = F.struct(F.lit(None).cast("string").alias("prev"), F.lit(0).alias("cur"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        cur = F.when((a["cur"] > 0) & a["prev"].eqNullSafe(x), a["cur"] + 1).otherwise(1)
        return F.struct(x.alias("prev"), cur.alias("cur"), F.greatest(a["best"], cur).alias("best"))

    return let(strings, lambda t: F.when(F.size(t) > 0, F.aggregate(t, zero, step, lambda a: a["best"]) / F.size(t)).otherwise(0.0))


def _share(text: Column | str, pattern: str) -> Column:
    t = _c(text)
    return F.when(F.length(t) > 0, (F.length(t) - F.length(F.regexp_replace(t, pattern, ""))) / F.length(t)).otherwise(0.0)


def invalid_char_ratio(text: Column | str) -> Column:
    """Replacement and control characters other than tab and line feed, per character."""
    return _share(text, r"[\x{fffd}\x{00}-\x{08}\x{0b}-\x{1f}]")


def non_letter_symbol_ratio(text: Column | str) -> Column:
    """Characters that are neither letters, figures, blanks nor common punctuation, per character."""
    return _share(text, rf"[^\p{{L}}\p{{N}}{WS}.,!?;:()«»„“\"'\x{{2014}}\x{{2026}}-]")


def word_fragment_ratio(text: Column | str) -> Column:
    """Single letters among the words that contain a letter."""
    lettered = F.filter(words(text), lambda x: x.rlike(r"\p{L}"))
    return let(lettered, lambda w: F.when(F.size(w) > 0, F.size(F.filter(w, lambda x: F.length(x) == 1)) / F.size(w)).otherwise(0.0))


def assess_generation(text: Column | str, tokens: Column | str) -> Column:
    """All measures of a generated text as a struct, rounded as reports show them."""
    return F.struct(
        F.length(_c(text)).alias("length"), F.size(_c(tokens)).alias("tokens"), F.round(repetition_ratio(tokens), 3).alias("repetition_ratio"), F.round(max_run_ratio(tokens), 3).alias("max_run_ratio"),
        F.round(invalid_char_ratio(text), 4).alias("invalid_char_ratio"), F.round(non_letter_symbol_ratio(text), 4).alias("symbol_ratio"), F.round(word_fragment_ratio(text), 3).alias("word_fragment_ratio"),
    )


def is_broken(m: Column) -> Column:
    """Whether any measure of the struct is beyond its limit."""
    return (m["invalid_char_ratio"] > 0.02) | (m["symbol_ratio"] > 0.05) | (m["repetition_ratio"] > 0.4) | (m["max_run_ratio"] > 0.5) | (m["word_fragment_ratio"] > 0.3)


def exact_match(answer: Column | str, reference: Column | str) -> Column:
    return (strip(answer) == strip(reference)).cast("double")


def contains_any(answer: Column | str, accepted: Column | str) -> Column:
    low = F.lower(_c(answer))
    return F.exists(_c(accepted), lambda a: F.contains(low, F.lower(a)))


def perplexity(loss: Column | str, cap: float = 700.0) -> Column:
    return F.exp(F.least(_c(loss), F.lit(cap)))
