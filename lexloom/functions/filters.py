"""Document filters: each is a boolean column, true to keep."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.binding import let
from lexloom.functions.clean import _c, words
from lexloom.functions.language import detect_language
from lexloom.functions.patterns import CARD, EMAIL, PHONE


def filter_length(text: Column | str, low: int = 50, high: int = 100_000) -> Column:
    return F.length(_c(text)).between(low, high)


def filter_word_count(text: Column | str, low: int = 10, high: int = 50_000) -> Column:
    return F.size(words(text)).between(low, high)


def filter_word_char_ratio(text: Column | str, least: float = 1.0) -> Column:
    """Mean word length; a text without words fails."""
    return let(words(text), lambda w: F.when(F.size(w) > 0, F.length(F.array_join(w, "")) / F.size(w) >= least).otherwise(False))


def filter_unique_words(text: Column | str, least: float = 0.15) -> Column:
    return let(words(text), lambda w: F.when(F.size(w) > 0, F.size(F.array_distinct(w)) / F.size(w) >= least).otherwise(False))


def has_email(text: Column | str) -> Column:
    return _c(text).rlike(EMAIL)


def has_phone(text: Column | str) -> Column:
    return _c(text).rlike(PHONE)


def has_card(text: Column | str) -> Column:
    return _c(text).rlike(CARD)


def filter_pii(text: Column | str) -> Column:
    """No e-mail address, telephone or card number."""
    return ~(has_email(text) | has_phone(text) | has_card(text))


def filter_spam(text: Column | str) -> Column:
    """At most a tenth exclamation or question marks, at most 70 % capitals among the letters, no run of four equal marks; empty passes."""
    t = _c(text)
    n, letters = F.length(t), F.length(F.regexp_replace(t, r"\P{L}", ""))
    marks = lambda c: n - F.length(F.replace(t, F.lit(c), F.lit("")))
    bad = (marks("!") > 0.1 * n) | (marks("?") > 0.1 * n) | (F.length(F.regexp_replace(t, r"[^\p{Lu}]", "")) > 0.7 * letters) | t.rlike(r"!{4,}|\?{4,}|\.{4,}")
    return ~bad


def top_char_share(text: Column | str) -> Column:
    """Share of the most frequent character; null for an empty text."""
    # Characters in sorted order: the longest run is the most frequent one, in one pass however many different ones there are.
    zero = F.struct(F.lit("").alias("prev"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, c: Column) -> Column:
        run = F.when(a["prev"] == c, a["run"] + 1).otherwise(1)
        return F.struct(c.alias("prev"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    t = _c(text)
    return F.when(F.length(t) > 0, F.aggregate(F.sort_array(F.filter(F.split(t, ""), lambda c: c != "")), zero, step, lambda a: a["best"]) / F.length(t))


def filter_repetition(text: Column | str, most: float = 0.3) -> Column:
    return F.coalesce(top_char_share(text) <= most, F.lit(False))


def reject_reason(text: Column | str, langs: list[str] | None = None, min_length: int = 50) -> Column:
    """The first filter that fails, in the order language, length, word count, word length, unique words, personal data, spam, repetition; else null.

    The cheap tests come first and later ones are evaluated only for what passed them."""
    # Bound once: a filter is pushed below the projection that makes its text, which would be computed anew for each mention.
    return let(F.coalesce(_c(text), F.lit("")), lambda t: _first_failure(t, langs, min_length))


def _first_failure(t: Column, langs: list[str] | None, min_length: int) -> Column:
    tests = [("length", filter_length(t, min_length)), ("word_count", filter_word_count(t)), ("word_length", filter_word_char_ratio(t)), ("unique_words", filter_unique_words(t)), ("pii", filter_pii(t)), ("spam", filter_spam(t)), ("repetition", filter_repetition(t))]
    if langs is not None:
        tests.insert(0, ("language", detect_language(t).isin(*langs)))
    out = None
    for name, test in tests:
        out = F.when(~test, name) if out is None else out.when(~test, name)
    return out


def filter_document(text: Column | str, langs: list[str] | None = None, min_length: int = 50) -> Column:
    return reject_reason(text, langs, min_length).isNull()
