"""Per-document text statistics, the fixed-threshold rules a text fails, and its kind: prose, list, table or junk.

Everything is native expressions over the lines and words of a text: no shuffle, no Python. Each rule compares one or a few statistics with fixed
numbers, and each one a text fails is recorded as a reason. The rules come in two sets: the published ones for web text, with their published numbers
(``PUBLISHED``), and rules that tell lists, tables and junk (``OWN``), as the published ones are made for long English pages and fail on most short texts
of any kind. The kind is read from the recorded reasons alone (:func:`kind_of`): one of ``JUNK`` makes it junk, else one of ``TABLE`` a
table, else one of ``LIST`` a list, else it is prose.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Chosen by hand: frequent function words of the languages of the corpus, as whole lower-case words.
COMMON_WORDS = (
    "the of and to in a is that for on with as by at from this an or be are it was not "
    "в и на с по для к за у о от до из что как не при под над или но же а я он она мы это его "
    "і й та у на з до за від що як не при під або але ж я він вона ми це його під час "
    "der die das und in zu den dem ein eine einen mit von am im auf für ist nicht als auch nach bei "
    "le la les de des du un une et à en dans sur pour avec au aux ce est pas que qui par "
    "el la los las de del un una y a en con por para al que es no se su"
).split()

#: Published thresholds. Gopher (Rae et al. 2021, table A1): words, mean word length, symbols (# and ellipses) a word, bullet lines, lines ending in
#: an ellipsis, words with a letter, stop words, duplicate lines. FineWeb (Penedo et al. 2024): lines ending in punctuation, duplicate characters in lines are left out.
PUBLISHED = {
    "gopher_words": (50, 100_000),
    "gopher_word_length": (3.0, 10.0),
    "gopher_symbols": 0.1,
    "gopher_bullets": 0.9,
    "gopher_ellipses": 0.3,
    "gopher_letters": 0.8,
    "gopher_stop_words": 2,
    "gopher_duplicate_lines": 0.3,
    "fineweb_stops": 0.12,
}
#: Chosen thresholds: prose of any of the corpus' languages and spellings keeps clear of them, also in texts of a few words.
OWN = {
    "overlong_words": 25,  # characters a word, on average
    "repetition": 0.3,  # distinct words a word, below which a text of 6 words repeats itself
    "repeated_lines": 0.5,  # distinct lines a line, of 3 lines
    "unpronounceable": 0.25,  # unpronounceable letter runs a word
    "noise_without_words": 0.1,  # the same, where hardly any common word is seen:
    "hardly_common": 0.03,
    "rarely_common": 0.1,
    "few_letters": 0.4,  # letters outside markup and runs of one character, of all visible characters
    "hardly_letters": 0.2,
    "markup": 0.25,
    "broken_characters": 0.05,
    "wrong_decoding": 0.3,
    "hex_dump": 0.6,
    "tags": 0.5,
    "table_lines": 0.5,  # lines in rows of a table
    "value_words": 0.6,  # words in field-value lines
    "list_words": 0.5,  # words in lines of an enumeration
    "marked_item_words": 8,  # words an inline item with a mark, and without
    "item_words": 6,
}
#: Reasons that decide the kind, in this order.
JUNK = ("gopher_symbols", "gibberish", "repetition", "repeated_lines", "overlong_words", "broken_characters", "wrong_decoding", "hex_dump", "few_letters", "hardly_letters", "tags")
TABLE = ("table_rows", "field_values")
LIST = ("gopher_bullets", "list_lines", "inline_marks", "inline_items")

_ODD_BLANKS = r"[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
_INVISIBLE = r"[\x{00AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}]"
#: Full-width forms and their ordinary characters.
_WIDE, _NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
#: What can need the mapping below: three Latin-1 characters and three ranges, few enough to be tested on every character.
_ODD = r"[\r\x{00A0}\x{00AD}\x{1680}-\x{200F}\x{2028}-\x{202F}\x{205F}-\x{FFFF}]"
_BULLET = r"^\s*(?:[-*•·‣◦▪●+>]\s+|\(?\d{1,4}[.)]\s+|№\s*\d+\s*|#\d+\s+|\[[ xXхХ✓]?\]\s*|[a-zа-я]\)\s+|[☐☑✓✗]\s*)\S"
_VALUE_LINE = r"^\s*[\p{L}\p{N}_/%][\p{L}\p{N}_/% .]{0,24}\s*[:=]\s*\S+(?:\s+\S+){0,4}\s*$"
_PRICE_LINE = r"(?:—|–|-|\.{2,}|…|:|=)\s*[$€]?\d[\d .,]*\p{L}{0,4}\.?\s*$"
_STOP = r"[.!?…。]['\"»”’)\]]*\s*$"
_CELL = r"(?:^|[\t|,;\s])-?\d[\d.,:%-]*(?=$|[\t|,;\s])|(?:^|[\t|,;]|\s\s)\s*[-–—]\s*(?=$|[\t|,;\s])|[-:=+]{3,}"
_CONSONANT = "[b-df-hj-np-tv-xzб-джзй-нп-тф-щ]"
_NOISE = rf"{_CONSONANT}{{5,}}|[ъь][ъьыаоуэ]|[жшчщ]ы|ыы|[аеёиоуыэ-яaeiouy]{{4}}+|(?<!\p{{L}})(?:{_CONSONANT}{{3,}}(?!\p{{L}})|[ъьы])"
_DELIMITERS = ("\t", "|", ";", ",")


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _kept(text: Column, pattern: str) -> Column:
    """Characters outside the matches."""
    return F.length(F.regexp_replace(text, pattern, ""))


def _chars(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def text_stats(df: DataFrame, text_col: str = "text", name: str = "quality") -> DataFrame:
    """Add a struct ``name`` with the statistics, the failed rules (``reasons``: their names) and the ``kind`` that follows from them.

    Null and blank texts get statistics of zero, the only reason ``empty`` and a null kind. Texts are taken whole, of any length; ties
    (as many words in list as in table lines) go to the table. Columns of ``df`` named like a statistic don't matter, as all are inside
    the struct; a column named like the struct is replaced."""
    # Steps are columns of their own, not fields of a struct: Catalyst would inline a struct's fields and split the text again for each use.
    at = lambda f: f"__{name}_{f}"
    q = lambda f: F.col(at(f))
    raw = F.coalesce(F.col(text_col), F.lit(""))
    plain_text = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, _INVISIBLE, ""), _ODD_BLANKS, " "), r"\r\n?|[\x{2028}\x{2029}]", "\n"), _WIDE, _NARROW)
    out = df.withColumn(at("t"), F.when(raw.rlike(_ODD), plain_text).otherwise(raw))
    t, lines, words, low = q("t"), q("lines"), q("words"), q("low")
    marked = F.contains(t, F.lit("<")) | F.contains(t, F.lit("&")) | t.rlike(r"(\S)\1{9}")
    out = out.withColumns({
        at("lines"): F.filter(F.split(t, "\n"), lambda x: x.rlike(r"\S")),
        at("words"): F.filter(F.split(t, r"\s+"), lambda x: x != ""),
        at("low"): F.lower(t),
        at("letters"): _kept(t, r"\P{L}+"),
        at("bare_letters"): F.when(marked, _kept(t, r"<[^<>]{0,200}>|&(?:[a-z]{2,8}|#\d+);?|(\S)\1{9,}|\P{L}")),
    })

    out = out.withColumn(at("visible"), F.length(F.array_join(words, "")))

    def line(x: Column) -> Column:
        """A line with what rules ask of it. A price line has at most 9 words and a field-value line at most 12, as part of what they are."""
        n = F.regexp_count(x, F.lit(r"\S+"))
        return F.struct(
            x.alias("x"), n.alias("n"), x.rlike(_STOP).alias("stop"), x.rlike(_BULLET).alias("bullet"), x.rlike(r"^\s*[–—]\s").alias("dash"),
            F.when(n <= 9, x.rlike(_PRICE_LINE)).otherwise(False).alias("price"),
            F.when(n <= 12, x.rlike(_VALUE_LINE)).otherwise(False).alias("value"),
            F.struct(*[_chars(x, c).alias(f"d{i}") for i, c in enumerate(_DELIMITERS)], F.regexp_count(F.trim(x), F.lit(r"\s{2,}")).alias("d4")).alias("d"),
        )

    out = out.withColumn(at("ls"), F.transform(lines, line))
    ls = q("ls")
    size = lambda test: F.size(F.filter(ls, test))
    mass = lambda test: F.aggregate(F.filter(ls, test), F.lit(0), lambda a, x: a + x["n"])
    listing = lambda x: x["bullet"] & ~(x["stop"] & (x["n"] > 8)) | x["dash"] & ~x["stop"] & (x["n"] <= 8)
    ended = lambda x: x["x"].rlike(r"[;,]['\"»”)]*\s*$")
    short = lambda x: (x["n"] <= 6) & ~x["stop"] & ~x["dash"] & ~ended(x)
    value = lambda x: x["value"] & ~x["x"].rlike(r"[.!?…]\s*$|(?i)^\s*(?:user|assistant)\s*:")

    def tabular(i: int, least: int) -> Column:
        """Lines of the shape of a table: as many fields as the first or second line (at least ``least``), short, mostly with figures.
        A paragraph of more than 60 words sets no width, unless it has the fields to be a row itself."""
        fields = lambda x: F.when((x["n"] <= 60) | (x["n"] <= (x["d"][f"d{i}"] + 1) * 5), x["d"][f"d{i}"])
        width = F.greatest(fields(F.get(ls, F.lit(0))), fields(F.get(ls, F.lit(1))))
        fits = F.filter(ls, lambda x: (x["d"][f"d{i}"] == width) & (x["n"] <= (width + 1) * 5))
        figures = F.size(F.filter(fits, lambda x: x["x"].rlike(_CELL)))
        return F.when((width + 1 >= least) & (F.size(fits) >= 2), F.when(figures * 2 >= F.size(fits), F.size(fits)).otherwise(0)).otherwise(0)

    n_words, n_lines, visible = F.size(words), F.size(lines), q("visible")
    tables = F.greatest(tabular(0, 2), tabular(1, 3), tabular(2, 3), tabular(3, 3), tabular(4, 2))
    stats = {
        "n_words": n_words,
        "n_lines": n_lines,
        "n_visible": visible,
        "mean_word_length": _share(visible, n_words),
        "symbol_ratio": _share(_chars(t, "#") + _chars(t, "…") + _chars(t, "...") / 3, n_words),
        "letter_share": _share(q("letters"), visible),
        "bare_letter_share": _share(F.coalesce(q("bare_letters"), q("letters")), visible),
        "stop_line_share": _share(size(lambda x: x["stop"]), n_lines),
        "bullet_share": _share(size(listing), n_lines),
        "ellipsis_share": _share(size(lambda x: x["x"].rlike(r"(?:…|\.\.\.)\s*$")), n_lines),
        "lettered_share": _share(n_words - F.regexp_count(t, F.lit(r"(?<!\S)[!-@\[-`{-~«»—–…№]+(?!\S)")), n_words),
        "tag_share": F.when(F.contains(t, F.lit("#")), _share(F.regexp_count(t, F.lit(r"(?<!\S)#\p{L}")), n_words)).otherwise(0.0),
        "hex_share": _share(F.regexp_count(t, F.lit(r"(?<!\S)[0-9A-Fa-f]{2}(?!\S)")), n_words),
        "distinct_share": _share(F.size(F.array_distinct(words)), n_words),
        "distinct_line_share": _share(F.size(F.array_distinct(lines)), n_lines),
        "common_words": F.size(F.filter(F.split(low, r"[^\p{L}]+"), lambda x: x.isin(*sorted(set(COMMON_WORDS))))),
        "common_share": _share(q("common_words"), n_words),
        "mojibake_share": F.when(t.rlike("[ÃÐÑÂ]"), _share(2 * F.regexp_count(t, F.lit("[ÃÐÑÂ]")), visible)).otherwise(0.0),
        "broken_share": _share(_chars(t, "�"), visible),
        "list_words": mass(lambda x: listing(x) | x["price"] | short(x)),
        "value_words": mass(value),
        "value_lines": size(value),
        "table_lines": F.when(n_lines >= 2, tables).otherwise(0),
        "inline_marks": F.regexp_count(t, F.lit(r"(?<!\S)\(?\d{1,3}[).]\s+\S")),
        "inline_items": F.regexp_count(t, F.lit(r";\s+|\s[/|>»·•→]\s")) + 1,
        "sentences": F.regexp_count(t, F.lit(r"[.!?…]+(?:\s|$)")) + 1,
    }
    out = out.withColumn(at("common_words"), stats.pop("common_words")).withColumns({at(k): v for k, v in stats.items()})
    stats["common_words"] = q("common_words")
    # The kind asks for unpronounceable words only where common words are rare: where the kind alone is wanted, the other texts are spared.
    noise = _share(F.regexp_count(low, F.lit(_NOISE)), q("n_words"))
    out = out.withColumn(at("rare_noise"), F.when(q("common_share") < OWN["rarely_common"], noise))
    stats["noise_share"] = F.coalesce(q("rare_noise"), noise)
    out = out.withColumn(at("noise_share"), stats["noise_share"])
    empty = q("n_words") == 0
    two, three = q("n_lines") >= 2, q("n_lines") >= 3
    per_mark, per_item = q("n_words") / q("inline_marks"), q("n_words") / q("inline_items")
    rules = {
        "gopher_words": ~q("n_words").between(*PUBLISHED["gopher_words"]),
        "gopher_word_length": ~q("mean_word_length").between(*PUBLISHED["gopher_word_length"]),
        "gopher_symbols": q("symbol_ratio") > PUBLISHED["gopher_symbols"],
        "gopher_bullets": q("bullet_share") > PUBLISHED["gopher_bullets"],
        "gopher_ellipses": q("ellipsis_share") > PUBLISHED["gopher_ellipses"],
        "gopher_letters": q("lettered_share") < PUBLISHED["gopher_letters"],
        "gopher_stop_words": q("common_words") < PUBLISHED["gopher_stop_words"],
        "gopher_duplicate_lines": 1 - q("distinct_line_share") > PUBLISHED["gopher_duplicate_lines"],
        "fineweb_stops": q("stop_line_share") <= PUBLISHED["fineweb_stops"],
        "unpronounceable": (q("noise_share") > OWN["unpronounceable"]) & (q("n_words") >= 3),
        "markup": (q("bare_letter_share") < OWN["markup"]) & (q("letter_share") >= OWN["markup"]),
        "table_rows": (q("table_lines") >= 2) & (q("table_lines") >= OWN["table_lines"] * q("n_lines")),
        "field_values": (q("value_lines") >= 2) & (q("value_words") * 10 >= q("n_words") * int(10 * OWN["value_words"])),
        "list_lines": two & (q("list_words") > OWN["list_words"] * q("n_words")),
        "inline_marks": (q("inline_marks") >= 3) & (per_mark <= OWN["marked_item_words"]) & (q("sentences") <= q("inline_marks") + 2),
        "inline_items": (q("inline_items") >= 4) & (per_item <= OWN["item_words"]) & (q("sentences") <= 2 + q("inline_items") / 4),
    }
    table = rules["table_rows"] | rules["field_values"]
    listed = rules["list_lines"] | rules["inline_marks"] | rules["inline_items"]
    rare_noise = F.coalesce(q("rare_noise"), F.lit(0.0))
    rules |= {
        "gibberish": (rare_noise > OWN["unpronounceable"]) | (rare_noise > OWN["noise_without_words"]) & (q("common_share") < OWN["hardly_common"]),
        "repetition": (q("distinct_share") < OWN["repetition"]) & (q("n_words") >= 6) & (q("table_lines") < 3),
        "repeated_lines": (q("distinct_line_share") <= OWN["repeated_lines"]) & three & (q("bullet_share") < 0.5) & ~table,
        "overlong_words": q("mean_word_length") > OWN["overlong_words"],
        "broken_characters": q("broken_share") > OWN["broken_characters"],
        "wrong_decoding": q("mojibake_share") > OWN["wrong_decoding"],
        "hex_dump": q("hex_share") > OWN["hex_dump"],
        "few_letters": (q("bare_letter_share") < OWN["few_letters"]) & ~table & ~listed,
        "hardly_letters": (q("bare_letter_share") < OWN["hardly_letters"]) & ~table,
        "tags": q("tag_share") > OWN["tags"],
    }
    # The same conditions that are recorded decide; as columns and not as a search in the array, so that those that don't matter need not be computed.
    failed = lambda names: F.greatest(*[F.coalesce(rules[k], F.lit(False)) for k in names])
    kind = F.when(empty, F.lit(None).cast("string")).when(failed(JUNK), "junk").when(failed(TABLE), "table").when(failed(LIST), "list").otherwise("prose")
    hidden = ("value_words", "sentences")
    reasons = F.when(empty, F.array(F.lit("empty"))).otherwise(F.filter(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]), lambda x: x.isNotNull()))
    out = out.withColumn(name, F.struct(*[q(k).alias(k) for k in stats if k not in hidden], reasons.alias("reasons"), kind.alias("kind")))
    return out.drop(*[c for c in out.columns if c.startswith(f"__{name}_")])


def kind_of(reasons: Sequence[str]) -> str | None:
    """The kind that recorded reasons stand for."""
    if "empty" in reasons:
        return None
    return next((kind for kind, names in (("junk", JUNK), ("table", TABLE), ("list", LIST)) if set(names) & set(reasons)), "prose")
