"""Simple language tests by script and frequent words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.clean import _c

# Frequent words that decide between Russian and English.
RU_STOP = (
    "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему теперь "
    "когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам"
).split()
EN_STOP = "the be to of and a in that have i it for not on with he as you do at this but his by from they we say her she or an will my one all would there".split()


def _count(text: Column, inside: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{inside}]", ""))


def detect_language(text: Column | str) -> Column:
    """``ru``, ``en`` or ``other`` by letters and stop words; other Latin-script languages count as ``en``."""
    low = F.lower(_c(text))
    found = F.regexp_extract_all(low, F.lit("([а-яёa-z]+)"), 1)
    ru, en = F.size(F.filter(found, lambda w: w.isin(*RU_STOP))), F.size(F.filter(found, lambda w: w.isin(*EN_STOP)))
    cyr, lat = _count(low, "а-яё"), _count(low, "a-z")
    return (
        F.when(F.size(found) == 0, "other")
        .when(cyr > 2 * lat, "ru")
        .when((ru > en) & (cyr > 0), "ru")
        .when((en > 0) | (lat > 2 * cyr), "en")
        .otherwise("other")
    )


def language_guess(text: Column | str) -> Column:
    """The script with more letters: ``ru`` (U+0400-04FF), ``en`` (ASCII letters), ``other`` if equal."""
    t = _c(text)
    cyr, lat = _count(t, r"\x{0400}-\x{04FF}"), _count(t, "A-Za-z")
    return F.when(cyr > lat, "ru").when(lat > cyr, "en").otherwise("other")
