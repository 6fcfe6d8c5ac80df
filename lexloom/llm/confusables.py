"""One consistent form for texts that look the same.

Blanks, widths, invisible characters, stored accents and joined letters have a normal form of their own. Look-alike letters are
resolved per word: every letter stands for the set of scripts that have a letter of this look, the sets are intersected across the
word, and the word is spelled in the script that is left. If several are left (a whole-script confusable) the scripts of the
surrounding words decide; if none is left (scripts really mixed) the most frequent script of the word does. All of these choices
depend on the look of the text only, so two texts of the same look get the same form.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.session import materialize

# Letters of the same look, in the order Latin, Cyrillic, Greek; a dot where the script has none.
LOOKALIKES = """
A А Α
B В Β
C С .
E Е Ε
H Н Η
I І Ι
J Ј .
K К Κ
M М Μ
N . Ν
O О Ο
P Р Ρ
S Ѕ .
T Т Τ
X Х Χ
Y Ү Υ
Z . Ζ
Q Ԛ .
W Ԝ .
V Ѵ .
G Ԍ .
a а .
c с .
d ԁ .
e е .
h һ .
i і .
j ј .
o о ο
p р ρ
q ԛ .
s ѕ .
v ѵ ν
w ԝ .
x х .
y у .
æ ӕ .
Æ Ӕ .
ə ә .
Ə Ә .
. Г Γ
. П Π
. Ф Φ
"""
#: Ties between scripts are broken in this order.
SCRIPTS = ("Latn", "Cyrl", "Grek")

_LOOK: dict[str, tuple[str | None, ...]] = {}
for _row in LOOKALIKES.split("\n"):
    if _row:
        _letters = tuple(None if x == "." else x for x in _row.split())
        for _x in _letters:
            if _x:
                _LOOK[_x] = _letters

_INVISIBLE = {0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, 0xFEFF, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), *range(0xE0000, 0xE0080), *range(0xE0100, 0xE01F0)}
_BLANKS = {0x09, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000, 0x2800}


@lru_cache(1)
def _character_map() -> dict[int, str | None]:
    """What single characters become, whatever is around them; built from the character database by rule."""
    table: dict[int, str | None] = {c: None for c in _INVISIBLE}
    table |= {c: " " for c in _BLANKS}
    table |= {0x2028: "\n", 0x2029: "\n", 0x85: "\n", 0x0B: "\n", 0x0C: "\n"}
    for c in [*range(0x132, 0x1F4), *range(0xFB00, 0xFB50), *range(0xFB50, 0xFE00), *range(0xFE70, 0xFF00), *range(0xFF01, 0xFFF0)]:
        kind, _, parts = unicodedata.decomposition(chr(c)).partition(" ")
        width = kind in ("<wide>", "<narrow>")
        joined = kind in ("<compat>", "<isolated>", "<initial>", "<medial>", "<final>")
        if width or joined and all(unicodedata.category(chr(int(x, 16)))[0] in "LM" for x in parts.split()):
            table[c] = unicodedata.normalize("NFKC", chr(c))
    table |= {0x2010: "-", 0x2011: "-"}
    return {k: v for k, v in table.items() if v is None or chr(k) != v}


@lru_cache(100_000)
def _script(letter: str) -> str:
    name = unicodedata.name(letter, "").split(" ")[0]
    return {"LATIN": "Latn", "CYRILLIC": "Cyrl", "GREEK": "Grek"}.get(name, name)


_RUN = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*")


def _base(letter: str) -> tuple[str, str]:
    """A letter's base and its marks."""
    d = unicodedata.normalize("NFD", letter)
    return d[0], d[1:]


@lru_cache(1)
def _accented_look() -> dict[str, dict[int, str]]:
    """Per script: character to character for every letter with a look-alike in that script, precomposed accents included.

    Covers single characters; marks that stay combining are left as they are."""
    out: dict[str, dict[int, str]] = {s: {} for s in SCRIPTS}
    for c in [*range(0x41, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        base, marks = _base(chr(c))
        row = _LOOK.get(base)
        if not row:
            continue
        for script, letter in zip(SCRIPTS, row):
            if letter and letter != base:
                new = unicodedata.normalize("NFC", letter + marks)
                out[script][c] = new
    return out


def _letter_scripts(letter: str) -> frozenset[str]:
    row = _LOOK.get(_base(letter)[0])
    if row:
        return frozenset(s for s, x in zip(SCRIPTS, row) if x)
    return frozenset((_script(letter),))


def _resolve(run: str) -> tuple[str | None, frozenset[str]]:
    """The script a run of letters is spelled in, or None and the scripts that are possible."""
    sets = [_letter_scripts(x) for x in run if not unicodedata.combining(x)]
    left = frozenset.intersection(*sets)
    if len(left) == 1:
        return next(iter(left)), left
    if left:
        return None, left
    votes = Counter(next(iter(s)) for s in sets if len(s) == 1)
    # Scripts really mixed: the most frequent script of the word, of equally frequent ones the first known.
    order = {s: i for i, s in enumerate(SCRIPTS)}
    return min(votes, key=lambda s: (-votes[s], order.get(s, 9), s)), left


def _spell(run: str, script: str) -> str:
    """The run with look-alikes written in ``script``, in composed form."""
    table = _accented_look().get(script)
    s = unicodedata.normalize("NFC", run.translate(table)) if table else run
    return s


class Normalizer:
    """Keeps what it found for each blank-separated token; the cache is emptied when full."""

    LIMIT = 300_000

    def __init__(self) -> None:
        self.tokens: dict[str, tuple[str, str | None, dict[str, str] | None]] = {}

    def _token(self, token: str) -> tuple[str, str | None, dict[str, str] | None]:
        """(form, script it votes for, its forms if the script is open)."""
        runs = _RUN.findall(token)
        if not runs:
            found = (token, None, None)
        else:
            scripts = [_resolve(r) for r in runs]
            sure = Counter(s for s, _ in scripts if s)
            vote = sure.most_common(1)[0][0] if sure else None
            it = iter(scripts)
            if all(s for s, _ in scripts):
                found = (_RUN.sub(lambda m: _spell(m[0], next(it)[0]), token), vote, None)
            else:
                forms = {}
                for script in SCRIPTS:
                    it = iter(scripts)
                    forms[script] = _RUN.sub(lambda m, it=it, script=script: self._open(m[0], *next(it), script), token)
                found = (forms[SCRIPTS[0]], vote, forms)
        if len(self.tokens) >= self.LIMIT:
            self.tokens.clear()
        if len(token) <= 256:  # blobs would fill the memory
            self.tokens[token] = found
        return found

    @staticmethod
    def _open(run: str, script: str | None, left: frozenset[str], wanted: str) -> str:
        if script is None:
            script = wanted if wanted in left else next(s for s in SCRIPTS if s in left)
        return _spell(run, script)

    def __call__(self, text: str) -> str:
        if not text.isascii():
            text = text.translate(_character_map())
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
        elif "\t" in text or "\x0b" in text or "\x0c" in text:
            text = text.translate(_character_map())
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        lines = []
        known = self.tokens
        for line in text.split("\n"):
            parts = []
            for t in line.rstrip(" ").split(" "):
                parts.append(known.get(t) or self._token(t))
            lines.append(parts)
        votes: Counter = Counter()
        is_open = False
        for parts in lines:
            for _, vote, forms in parts:
                if vote:
                    votes[vote] += 1
                if forms:
                    is_open = True
        if is_open:
            first = max(SCRIPTS, key=lambda s: votes[s])
            out = "\n".join(" ".join([forms[first] if forms else form for form, _, forms in parts]) for parts in lines)
        else:
            out = "\n".join(" ".join([p[0] for p in parts]) for parts in lines)
        return out.rstrip("\n")


_NORMALIZER: list[Normalizer] = []


def normalizer() -> Normalizer:
    if not _NORMALIZER:
        _NORMALIZER.append(Normalizer())
    return _NORMALIZER[0]


def canonical(text: Column | str) -> Column:
    """The consistent form of a text; null for null. Blank texts stay blank: their form is empty or blanks only.

    Kinds of blanks become U+0020 but keep their number, blanks and line ends at the end of a line or text go, leading ones stay."""

    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        n = normalizer()
        return pd.Series([None if t is None else n(t) for t in s], dtype=object)

    return form(text)


def _hash(c: Column, name: str) -> list[Column]:
    return [F.xxhash64(c).alias(f"{name}1"), F.xxhash64(F.lit("\x01second"), c).alias(f"{name}2")]


def look_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, look1, look2, text1, text2``: per non-blank text 128-bit hashes of its consistent form and of the text itself.

    Texts with the same look hash cannot be told apart. Rows with a null id, null or blank texts are left out; redelivered rows count once. Only
    hashes leave the Python workers' stage, so a text of any length costs 40 bytes in what follows."""
    text = F.col(text_col)
    kept = df.where(F.col(id_col).isNotNull() & text.rlike(r"(?U)\S")).select(F.col(id_col).cast("long").alias("id"), text.alias("t"), canonical(text).alias("c"))
    return kept.where(F.length("c") > 0).select("id", *_hash(F.col("c"), "look"), *_hash(F.col("t"), "text")).distinct()


def same_look_pairs(classes: DataFrame) -> DataFrame:
    """``id_a, id_b`` with id_a < id_b: different texts of the same look.

    The hashes are written once, as both the count of texts per look and the join read them. Looks with one text only are dropped before
    the join; AQE splits a look that very many rows share."""
    classes = materialize(classes, "looks")
    texts = classes.groupBy("look1", "look2").agg(F.min("text1").alias("lo"), F.max("text1").alias("hi"), F.min("text2").alias("lo2"), F.max("text2").alias("hi2"))
    several = texts.where("lo <> hi or lo2 <> hi2").select("look1", "look2")
    rows = classes.join(several, ["look1", "look2"], "left_semi")
    a, b = rows.alias("a"), rows.alias("b")
    same = (F.col("a.look1") == F.col("b.look1")) & (F.col("a.look2") == F.col("b.look2")) & (F.col("a.id") < F.col("b.id"))
    differ = (F.col("a.text1") != F.col("b.text1")) | (F.col("a.text2") != F.col("b.text2"))
    return a.join(b, same & differ).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()
