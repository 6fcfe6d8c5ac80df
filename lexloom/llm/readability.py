"""Reading level of documents: classic readability formulas per clause, their median, and the level of the bulk of the text.

Sentence length alone misleads here (long chains of plain statements, short sentences full of terms), so a text is cut into clauses, at
stops and at the joints of a chain. Each clause gets several grade estimates from its length, its syllables per word (counted by
vowel-group rules) and its long words; their median is the clause's grade. The formulas are those of Flesch-Kincaid, ARI, Coleman-Liau, Fog, SMOG and Lix
with two changes: a clause takes the place of a sentence, and a long word has four syllables or more in all of them (three in Fog and SMOG, more than six
letters in Lix as published), as the corpus is largely Russian, where words are longer. The level is read from the word-weighted median over
the clauses, so that single deviating sentences change nothing.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("easy", "medium", "hard")
#: Grades between the levels by alphabet (True: Cyrillic), used where there are fewer than ``MIN_LABELLED`` labelled documents.
DEFAULT_CUTS = {False: (5.0, 9.5), True: (8.5, 17.0)}
#: At most so many labelled documents are used to fit the two cuts.
MAX_LABELLED = 5000
MIN_LABELLED = 12
MIN_WORDS = 40

_VOWELS = "aeiouyäöüáéíóúàèùâêîôûœæаеёиоуыэюяіїє"
_GROUP = re.compile(f"[{_VOWELS}]+")
# Two vowels that are spoken apart though they stand together.
_HIATUS = re.compile(r"(?<![cgst])i[ao](?!u)|eo|(?<!q)ua|iu(?=m)|(?<=[aeiou][b-df-hj-np-tv-xz])ea$")
_CYR = re.compile("[аеёиоуыэюяіїє]")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_CLAUSE = re.compile(r"(?:[.!?…;:]+|\n+|,|\s[—–-]\s)\s*")
_ROLE = re.compile(r"(?m)^\s*(?:USER|ASSISTANT|SYSTEM)\s*:", re.I)


def syllables(word: str) -> int:
    """Syllables of a lower-case word by rule: vowel groups, in Cyrillic single vowels, less silent endings of English."""
    if _CYR.search(word):
        return max(1, len(_CYR.findall(word)))
    groups = _GROUP.findall(word)
    n = len(groups)
    n += len(_HIATUS.findall(word))
    if word.endswith("e") and not word.endswith(("le", "ee", "ye", "ie", "oe")) and n > 1:
        n -= 1
    if re.search(r"[^aeiouytd]ed$", word) and n > 1:
        n -= 1
    return max(1, n)


_SYLLABLES: dict[str, int] = {}


def _syllables(word: str) -> int:
    n = _SYLLABLES.get(word)
    if n is None:
        if len(_SYLLABLES) > 500_000:
            _SYLLABLES.clear()
        n = syllables(word.lower())
        if len(word) <= 64:  # blobs would fill the memory
            _SYLLABLES[word] = n
    return n


def clause_grades(words: np.ndarray, syll: np.ndarray, letters: np.ndarray, hard: np.ndarray) -> np.ndarray:
    """The median of six grade estimates for clauses of the given sums (one sentence each)."""
    w = np.maximum(words, 1)
    spw, lpw, long = syll / w, letters / w, hard / w
    kincaid = 0.39 * w + 11.8 * spw - 15.59
    ari = 4.71 * lpw + 0.5 * w - 21.43
    fog = 0.4 * (w + 100 * long)
    coleman = 5.88 * lpw - 29.6 / w - 15.8
    smog = 1.043 * np.sqrt(30 * hard) + 3.1291
    lix = (w + 100 * long) / 5 - 2
    return np.median(np.stack([kincaid, ari, fog, coleman, smog, lix]), axis=0)


_CODE = re.compile(r"[{}\[\]=<>_*/^+\\|#$@&~`]")
_BLANK = re.compile(r"\s+")


def measure(text: str) -> tuple[int, bool, bool, float | None, float]:
    """(blank-separated words, prose?, mostly Cyrillic?, grade of the bulk or None, syllables per word)."""
    n = len(text.split())
    visible = len(_BLANK.sub("", text))
    figures = sum(c.isdigit() for c in text)
    prose = visible > 0 and len(_CODE.findall(text)) < 0.03 * visible and figures < 0.2 * visible
    body = _ROLE.sub("\n", text)
    rows: list[list[int]] = []
    joined = False  # a clause of fewer than four words is read with the next one
    cyrillic = letters_seen = 0
    known = _SYLLABLES
    for part in _CLAUSE.split(body):
        words = _WORD.findall(part)
        if not words:
            continue
        s = [known.get(w) or _syllables(w) for w in words]
        letters = sum(map(len, words))
        letters_seen += letters
        if words[0][0] >= "Ѐ":
            cyrillic += letters
        row = [len(words), sum(s), letters, sum([k >= 4 for k in s])]
        if joined:
            rows[-1] = [a + b for a, b in zip(rows[-1], row)]
        else:
            rows.append(row)
        joined = rows[-1][0] < 4
    if not rows:
        return n, prose, False, None, 0.0
    w, s, c, h = np.array(rows, float).T
    grade = clause_grades(w, s, c, h)
    order = np.argsort(grade, kind="stable")
    total = np.cumsum(w[order])
    return n, prose, 2 * cyrillic > letters_seen, float(grade[order][np.searchsorted(total, total[-1] / 2)]), float(s.sum() / w.sum())


def reading_grades(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, is_prose, is_cyrillic, grade, syllables_per_word`` of every row, texts taken whole.

    Null texts count as empty: no words, no grade, not prose. Texts without a letter have no grade."""

    @F.pandas_udf("n_words int, is_prose boolean, is_cyrillic boolean, grade double, syllables_per_word double")
    def grades(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t or "") for t in texts], columns=["n_words", "is_prose", "is_cyrillic", "grade", "syllables_per_word"])

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), grades(F.col(text_col)).alias("_g")).select("doc_id", "_g.*")


def best_cuts(grades: list[float], levels: list[int]) -> tuple[float, float] | None:
    """The two cuts that put the fewest labelled grades on the wrong side; of equally good ones the middle of the widest gap."""
    g, y = np.array(grades), np.array(levels)
    if len(g) < MIN_LABELLED or len(set(levels)) < 3:
        return None
    order = np.argsort(g, kind="stable")
    g, y = g[order], y[order]
    cuts = []
    for k in (1, 2):  # below cut k are the levels under k
        wrong = np.r_[0, np.cumsum(y >= k)] + np.r_[np.cumsum((y < k)[::-1])[::-1], 0]
        at = np.flatnonzero(wrong == wrong.min())
        edges = [(g[i - 1] if i else g[0] - 1, g[i] if i < len(g) else g[-1] + 1) for i in at]
        lo, hi = max(edges, key=lambda e: e[1] - e[0])
        cuts.append(float(lo + hi) / 2)
    return (cuts[0], max(cuts))


def fit_cuts(graded: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> dict[bool, tuple[float, float]]:
    """The cuts between the levels, by alphabet (True: Cyrillic), from at most ``limit`` labelled documents.

    A document's label is the one most of its readers gave; documents on which readers are evenly divided are not used. The sample takes
    the smallest hashes of doc_id, so it doesn't depend on the order of rows."""
    votes = labels.where(F.col("doc_id").isNotNull() & F.lower("reading_level").isin(*LEVELS)).select("doc_id", "rater", F.lower("reading_level").alias("level")).distinct()
    counts = votes.groupBy("doc_id", "level").agg(F.count(F.lit(1)).alias("n"))
    one = counts.groupBy("doc_id").agg(F.max("n").alias("m"), F.max_by("level", "n").alias("level"), F.sort_array(F.collect_list("n"), False).alias("all"))
    clear = one.where("size(all) = 1 or all[0] > all[1]").orderBy(F.xxhash64("doc_id")).limit(limit).select(F.col("doc_id").cast("long").alias("doc_id"), "level")
    rows = graded.join(F.broadcast(clear), "doc_id").where("is_prose and grade is not null").select("is_cyrillic", "grade", "level").limit(4 * limit).collect()
    out = {}
    for cyr in (False, True):
        own = [(r.grade, LEVELS.index(r.level)) for r in rows if r.is_cyrillic == cyr]
        cuts = best_cuts([g for g, _ in own], [y for _, y in own])
        out[cyr] = cuts or DEFAULT_CUTS[cyr]
    return out


def reading_levels(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, reading_level, grade, n_words`` of every document of prose or dialogue with at least 40 blank-separated words.

    Code and formulas, shorter and null texts get no row. A grade on a cut counts as the higher level. Repeated rows give repeated
    rows. Without labels the default cuts hold."""
    from lexloom.session import materialize

    graded = materialize(reading_grades(documents, id_col, text_col), "grades")
    cuts = fit_cuts(graded, labels)
    low = F.when(F.col("is_cyrillic"), cuts[True][0]).otherwise(cuts[False][0])
    high = F.when(F.col("is_cyrillic"), cuts[True][1]).otherwise(cuts[False][1])
    level = F.when(F.col("grade") >= high, LEVELS[2]).when(F.col("grade") >= low, LEVELS[1]).otherwise(LEVELS[0])
    return graded.where(F.col("is_prose") & (F.col("n_words") >= MIN_WORDS) & F.col("grade").isNotNull()).select("doc_id", level.alias("reading_level"), "grade", "n_words")
