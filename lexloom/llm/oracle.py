"""Equivalent SQL of the training-data queries, where SQL can express them."""

from __future__ import annotations

from lexloom.llm import text_quality

# Identical word sequences count as a pair too, also where they are too short for a shingle.
_P1 = r"""
WITH d AS (SELECT dialogue_id, any_value(text) AS text FROM shards WHERE text IS NOT NULL GROUP BY dialogue_id),
w AS (SELECT dialogue_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM d),
s AS (SELECT DISTINCT dialogue_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3),
n AS (SELECT dialogue_id, count(*) AS n FROM s GROUP BY dialogue_id),
c AS (SELECT a.dialogue_id AS id_a, b.dialogue_id AS id_b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.dialogue_id < b.dialogue_id GROUP BY 1, 2),
j AS (SELECT id_a, id_b FROM c JOIN n x ON x.dialogue_id = id_a JOIN n y ON y.dialogue_id = id_b WHERE c >= 0.6 * (x.n + y.n - c)),
e AS (SELECT a.dialogue_id AS id_a, b.dialogue_id AS id_b FROM w a JOIN w b ON a.w = b.w AND a.dialogue_id < b.dialogue_id)
SELECT id_a, id_b FROM j UNION SELECT id_a, id_b FROM e
"""

# Texts of raw as the statistics see them: t, its words w and its lines l.
_P6_TEXT = r"""
SELECT raw_id, t, list_filter(string_split_regex(t, '\s+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '\S')) AS l
FROM (SELECT raw_id, translate(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\x{00AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}]', '', 'g'), '[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]', ' ', 'g'), '\r\n?|[\x{2028}\x{2029}]', chr(10), 'g'), WIDE, NARROW) AS t FROM raw)
"""
_P6 = rf"""
SELECT raw_id, len(w)::INTEGER AS n_words, len(l)::INTEGER AS n_lines, CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 0.0 END AS distinct_share,
       CASE WHEN length(regexp_replace(t, '\s+', '', 'g')) > 0 THEN length(regexp_replace(t, '\P{{L}}+', '', 'g')) / length(regexp_replace(t, '\s+', '', 'g')) ELSE 0.0 END AS letter_share
FROM ({_P6_TEXT})
"""


def _rules_sql() -> str:
    p = text_quality.PUBLISHED
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    stop, bullet, dash = (f"regexp_matches(x, {quoted(r)})" for r in (text_quality._STOP, text_quality._BULLET, r"^\s*[–—]\s"))
    count = "len(list_filter(string_split_regex(x, '\\s+'), lambda y: y <> ''))"
    share = lambda test: f"CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda x: {test})) / len(l) ELSE 0.0 END"
    common = ", ".join(sorted({quoted(w) for w in text_quality.COMMON_WORDS}))
    stats = rf"""SELECT raw_id, len(w)::INTEGER AS n_words, len(list_filter(string_split_regex(lower(t), '[^\p{{L}}]+'), lambda x: x IN ({common})))::INTEGER AS common_words,
CASE WHEN len(w) > 0 THEN length(array_to_string(w, '')) / len(w) ELSE 0.0 END AS mean_word_length,
CASE WHEN len(w) > 0 THEN (length(t) - length(replace(t, '#', '')) + length(t) - length(replace(t, '…', '')) + (length(t) - length(replace(t, '...', ''))) / 3) / len(w) ELSE 0.0 END AS symbol_ratio,
{share(f"{bullet} AND NOT ({stop} AND {count} > 8) OR {dash} AND NOT {stop} AND {count} <= 8")} AS bullet_share, {share(stop)} AS stop_line_share,
{share("regexp_matches(x, '(?:…|[.][.][.])" + chr(92) + "s*$')")} AS ellipses, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: NOT regexp_full_match(x, '[!-@\[-`{{-~«»—–…№]+'))) / len(w) ELSE 0.0 END AS lettered,
CASE WHEN len(l) > 0 THEN len(list_distinct(l)) / len(l) ELSE 0.0 END AS lines FROM ({_P6_TEXT})"""
    failed = {
        "gopher_words": f"n_words NOT BETWEEN {p['gopher_words'][0]} AND {p['gopher_words'][1]}", "gopher_word_length": f"mean_word_length NOT BETWEEN {p['gopher_word_length'][0]} AND {p['gopher_word_length'][1]}",
        "gopher_symbols": f"symbol_ratio > {p['gopher_symbols']}::DOUBLE", "gopher_bullets": f"bullet_share > {p['gopher_bullets']}::DOUBLE", "gopher_ellipses": f"ellipses > {p['gopher_ellipses']}::DOUBLE",
        "gopher_letters": f"lettered < {p['gopher_letters']}::DOUBLE", "gopher_stop_words": f"common_words < {p['gopher_stop_words']}", "gopher_duplicate_lines": f"1 - lines > {p['gopher_duplicate_lines']}::DOUBLE",
        "fineweb_stops": f"stop_line_share <= {p['fineweb_stops']}::DOUBLE",
    }
    names = ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in failed.items())
    rounded = ", ".join(f"round({c}::DOUBLE, 9) AS {c}" for c in ("mean_word_length", "symbol_ratio", "bullet_share", "stop_line_share"))
    return f"SELECT raw_id, n_words, common_words, {rounded}, CASE WHEN n_words = 0 THEN 'empty' ELSE concat_ws(',', {names}) END AS failed FROM ({stats})"


def oracle_sql() -> dict[str, str]:
    wide = " || ".join(f"chr({c})" for c in range(0xFF01, 0xFF5F))
    narrow = " || ".join(f"chr({c})" for c in range(0x21, 0x7F))
    plain = lambda sql: sql.replace("WIDE", f"({wide})").replace("NARROW", f"({narrow})")
    return {"p1_found": _P1, "p6_basic": plain(_P6), "p6_rules": plain(_rules_sql())}
