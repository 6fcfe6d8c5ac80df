"""Cleaning of texts as column expressions. Order in :func:`clean_text`: composed form, spaces, control characters, redaction, collapsing."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.patterns import CONTROL, EMAIL, PIECE, SPACE_VARIANTS, URL, WS, WS_CHARS


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_unicode(text: Column | str, form: str = "NFC") -> Column:
    """A Unicode normal form. Spark has no built-in, so this is an Arrow UDF; texts whose characters are all composed by nature (for NFC:
    below U+0300) pass it unchanged and cheaply."""
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"unknown normal form {form}")

    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or t.isascii() or unicodedata.is_normalized(form, t) else unicodedata.normalize(form, t))

    return normal(_c(text))


def space_variants(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), SPACE_VARIANTS, " ")


def strip_control_chars(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), CONTROL, "")


def strip(text: Column | str) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(_c(text), F.lit(WS_CHARS))


def collapse_whitespace(text: Column | str) -> Column:
    """Blanks other than line feeds become one space, three or more line feeds two, both ends are stripped."""
    return strip(F.regexp_replace(F.regexp_replace(_c(text), r"[ \t\r\f\x{0b}]+", " "), r"\n{3,}", "\n\n"))


def redact(text: Column | str, urls: bool = True, emails: bool = True) -> Column:
    out = _c(text)
    if urls:
        out = F.regexp_replace(out, URL, "<URL>")
    return F.regexp_replace(out, EMAIL, "<EMAIL>") if emails else out


def clean_text(text: Column | str, unicode_form: str | None = "NFC", redact_urls: bool = False, redact_emails: bool = False) -> Column:
    """The whole cleaning; null becomes empty. With ``unicode_form=None`` everything stays inside the JVM."""
    out = F.coalesce(_c(text), F.lit(""))
    if unicode_form:
        out = normalize_unicode(out, unicode_form)
    out = strip_control_chars(space_variants(out))
    return collapse_whitespace(redact(out, redact_urls, redact_emails))


def words(text: Column | str) -> Column:
    """White-space separated words."""
    return F.filter(F.split(_c(text), f"[{WS}]+"), lambda x: x != "")


def normalize_exact(text: Column | str) -> Column:
    """Words joined by single spaces."""
    return F.array_join(words(text), " ")


def doc_hash(text: Column | str) -> Column:
    """SHA-256 (hex) of the text with single spaces."""
    return F.sha2(normalize_exact(text), 256)


def pre_tokenize(text: Column | str) -> Column:
    """Alternating runs of white space and other characters."""
    return F.regexp_extract_all(_c(text), F.lit(PIECE), 1)


def titled_document(title: Column | str, text: Column | str) -> Column:
    """Title and text on two lines, unless one is missing or the text begins with the title. An empty text stays empty."""
    a, b = strip(F.coalesce(_c(title), F.lit(""))), strip(F.coalesce(_c(text), F.lit("")))
    return F.when((a != "") & (b != "") & ~F.startswith(b, a), F.concat_ws("\n", a, b)).otherwise(b)


def fill_template(template: Column | str, slots: Column | str, default: str = "…") -> Column:
    """Replace ``{name}`` by the map's value; names without a value by ``default``."""
    out = F.aggregate(F.map_entries(_c(slots)), _c(template), lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(default))))
    return F.regexp_replace(out, r"\{\w+\}", default)
