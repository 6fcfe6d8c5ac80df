"""Dialogues in ``USER: … / ASSISTANT: …`` form: turns, messages and quality checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.binding import let
from lexloom.functions.clean import _c, strip, words
from lexloom.functions.patterns import WS

_TURN = rf"(?md)^(USER|ASSISTANT):[{WS}]*(.*)$"


def split_turns(text: Column | str) -> Column:
    """What follows each role label at a line's start. Blanks after the label may cross lines, so an empty turn swallows the next label."""
    return F.transform(F.regexp_extract_all(_c(text), F.lit(_TURN), 2), strip)


def text_to_messages(text: Column | str, strict: bool = False) -> Column:
    """``role, content`` per turn. Roles follow the position, as labels are meant to alternate; ``strict`` takes the labels. Empty turns are left out."""
    if strict:
        roles = F.transform(F.regexp_extract_all(_c(text), F.lit(_TURN), 1), F.lower)
        pairs = F.zip_with(roles, split_turns(text), lambda r, t: F.struct(r.alias("role"), t.alias("content")))
    else:
        pairs = F.transform(split_turns(text), lambda t, i: F.struct(F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), t.alias("content")))
    return F.filter(pairs, lambda m: m["content"] != "")


def assemble(turns: Column | str) -> Column:
    """The inverse of :func:`split_turns`."""
    return F.array_join(F.transform(_c(turns), lambda t, i: F.concat(F.when(i % 2 == 0, "USER: ").otherwise("ASSISTANT: "), t)), "\n\n")


def trainable(messages: Column | str) -> Column:
    """At least two messages, one of them the assistant's."""
    m = _c(messages)
    return (F.size(m) >= 2) & F.exists(m, lambda x: x["role"] == "assistant")


def check_format(text: Column | str) -> Column:
    """Every non-blank line begins with a label, labels alternate, the first is the user's."""
    lines = F.filter(F.transform(F.split(_c(text), "\n"), strip), lambda x: x != "")
    roles = F.transform(lines, lambda x: F.when(F.startswith(x, F.lit("USER:")), 0).when(F.startswith(x, F.lit("ASSISTANT:")), 1).otherwise(2))
    return (F.size(roles) > 0) & F.coalesce(F.forall(F.transform(roles, lambda r, i: r == i % 2), lambda ok: ok), F.lit(False))


def _turns(text: Column | str | None, turns: Column | str | None) -> Column:
    return split_turns(text) if turns is None else _c(turns)


def check_min_turns(text: Column | str | None, least: int = 2, turns: Column | str | None = None) -> Column:
    """The checks of turns take them ready-made too, so that several checks split a text once."""
    return F.size(_turns(text, turns)) >= least


def check_no_empty(text: Column | str | None, turns: Column | str | None = None) -> Column:
    return F.forall(_turns(text, turns), lambda x: x != "")


def check_no_broken_roles(text: Column | str) -> Column:
    return F.contains(_c(text), F.lit("USER:")) & F.contains(_c(text), F.lit("ASSISTANT:"))


def _top_of_sorted(items: Column) -> Column:
    """Length of the longest run in the sorted array: the count of the most frequent element, in n log n."""
    zero = F.struct(F.lit(None).cast("string").alias("prev"), F.lit(0).alias("cur"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        cur = F.when(a["prev"].eqNullSafe(x), a["cur"] + 1).otherwise(1)
        return F.struct(x.alias("prev"), cur.alias("cur"), F.greatest(a["best"], cur).alias("best"))

    return F.aggregate(F.sort_array(items), zero, step, lambda a: a["best"])


def ngrams(items: Column, n: int) -> Column:
    """Joined runs of ``n`` elements; empty if there are fewer."""
    runs = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(x) - (n - 1))), lambda i: F.array_join(F.slice(x, i, n), "\x01"))
    return let(items, lambda x: F.when(F.size(x) >= n, runs(x)).otherwise(F.array().cast("array<string>")))


def check_repetition(text: Column | str | None, share: float = 0.5, n: int = 4, turns: Column | str | None = None) -> Column:
    """No turn is said by more than half of the turns (and more than twice), no 4-gram makes up more than a quarter of over 20 words."""

    def judge(turns: Column) -> Column:
        calm = _top_of_sorted(turns) <= F.greatest(F.lit(2.0), F.size(turns) * share)
        varied = let(words(F.lower(F.array_join(turns, " "))), lambda w: (F.size(w) <= 20) | (_top_of_sorted(ngrams(w, n)) / F.size(w) <= 0.25))
        return F.when(F.size(turns) == 0, False).otherwise(calm & varied)

    return let(_turns(text, turns), judge)


def check_unicode(text: Column | str) -> Column:
    return ~F.contains(_c(text), F.lit("�"))


def check_message_len(text: Column | str | None, most: int = 300, turns: Column | str | None = None) -> Column:
    return F.forall(_turns(text, turns), lambda x: F.length(x) <= most)


def quality_report(text: Column | str) -> Column:
    """The checks as a struct of booleans."""
    t = F.coalesce(_c(text), F.lit(""))
    checks = lambda p: F.struct(
        check_format(p["t"]).alias("format"), check_min_turns(None, turns=p["s"]).alias("min_turns"), check_no_empty(None, turns=p["s"]).alias("no_empty"),
        check_no_broken_roles(p["t"]).alias("no_broken_roles"), check_repetition(None, turns=p["s"]).alias("repetition"), check_unicode(p["t"]).alias("unicode"),
    )
    return let(F.struct(t.alias("t"), split_turns(t).alias("s")), checks)


def check_dialogue(text: Column | str, min_turns: int = 2, max_chars: int = 300) -> Column:
    t = F.coalesce(_c(text), F.lit(""))

    def all_checks(p: Column) -> Column:
        text, turns = p["t"], p["s"]
        return check_format(text) & check_min_turns(None, min_turns, turns) & check_no_empty(None, turns) & check_no_broken_roles(text) & check_repetition(None, turns=turns) & check_unicode(text) & check_message_len(None, max_chars, turns)

    return let(F.struct(t.alias("t"), split_turns(t).alias("s")), all_checks)
