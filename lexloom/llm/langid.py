"""Languages of documents and of one-language segments.

A bidirectional recurrent network reads each sentence as one sequence of bytes, across its words, and labels every position; the positions are pooled to
the sentence (each word with the same weight), the sentences to the document, whose segments are the runs of sentences in one language. Sentences longer than a
window are read in overlapping windows. Look-alike letters and invisible characters are resolved before, so the script a language is written in and
disguised spellings don't matter.

The network is trained where it is used, once per application and sample, on a bounded sample of labelled records. Their labels are noisy: sentences whose
words contradict the record's label are left out first.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.confusables import _character_map, normalizer
from lexloom.llm.gru import ByteGRU, one_thread, train
from lexloom.llm.pair_defects import FUNCTION_WORDS

LANGS = ("ru", "en", "uk", "de", "fr", "es")
MIXED = "mixed"
#: Labelled records per language the network is trained on.
TRAIN_PER_LANG = 700
TRAIN_STEPS = 800
#: Sequences of a training batch and their bytes at most.
TRAIN_BATCH, TRAIN_BYTES = 128, 72
#: How much more likely (in nats) a sentence must be in another language than the rest, to make its record mixed; one of a single word by the second.
FOREIGN_MARGIN, WORD_MARGIN = 6.0, 4.0
#: Bytes of a sentence that are read as one sequence. Longer ones are read in windows that overlap by twice ``CONTEXT`` bytes; every position counts once.
WINDOW, CONTEXT = 256, 32
#: Positions evaluated at once.
CELLS = 1 << 18

# Spellings of a language in records.
SPELLINGS = {
    "ru": ("ru", "rus", "russian", "русский", "рус"),
    "en": ("en", "eng", "english", "английский", "англ"),
    "uk": ("uk", "ukr", "ua", "ukrainian", "українська", "украинский"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
    MIXED: ("mixed", "mul", "multi", "multiple", "mix"),
}

# Romanizations of Cyrillic letters, the usual one first.
ROMAN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p",
    "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
ROMAN_OTHER = {"й": "j", "х": "h", "ц": "c", "ю": "ju", "я": "ja", "щ": "sch", "ё": "e", "ь": "'", "ы": "i", "ж": "j"}
ROMAN_UK = {"г": "h", "ґ": "g", "и": "y", "і": "i", "ї": "yi", "є": "ye", "'": "", "’": ""}
_TABLES = [("ru", str.maketrans(ROMAN)), ("ru", str.maketrans(ROMAN | ROMAN_OTHER)), ("uk", str.maketrans(ROMAN | ROMAN_UK)), ("uk", str.maketrans(ROMAN | ROMAN_OTHER | ROMAN_UK | {"ї": "i", "є": "ie"}))]

# Abbreviations that end in a stop within a sentence.
ABBREVIATIONS = frozenset("см ср г гг в вв т тт п пп д др пр ул рис стр табл гл им св руб коп тыс млн млрд mr mrs ms dr st vs no nr p pp fig ca bzw z d h b u a etc e g i cf m mme mlle sr sra ud uds pág págs núm ej art vol".split())

_WORD = re.compile(r"[^\W\d_]+(?:['’ʼ][^\W\d_]+)*")
_CAPITALS = re.compile("[A-Z]['’ʼ]?[A-Z]")
_SPECIAL = re.compile(r"[^\x00-\x7fÀ-ɏЀ-ӿ‐-‟…«»№–—]")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'»”’)\]]*\s+|\n+")
_TURN = re.compile(r"(?:^|\n)\s*(?:USER|ASSISTANT|SYSTEM)\s*:\s*", re.I)


def recorded(lang: Column) -> Column:
    """The code a recorded language stands for; null if it is null, blank or unknown."""
    bare = F.regexp_extract(F.lower(F.trim(lang)), r"^(\p{L}+)(?:[-_][\p{L}\d]+)?$", 1)
    out = F.lit(None).cast("string")
    for code, names in SPELLINGS.items():
        out = F.when(bare.isin(*names), code).otherwise(out)
    return out


def sentences(text: str) -> list[str]:
    """Sentences and lines. An abbreviation or initial alone with its stop belongs to what follows it."""
    out: list[str] = []
    joined = False
    for s in _SENTENCE.split(_clean(text)):
        if not s or s.isspace():
            continue
        if joined:
            out[-1] += " " + s
        else:
            out.append(s)
        bare = out[-1].strip("([«\"' ").removesuffix(".").lower() if len(out[-1]) <= 8 and out[-1].endswith(".") else ""
        joined = len(bare) == 1 or bare in ABBREVIATIONS
    return out


def words_of(sentence: str) -> list[str]:
    """The words that tell something about the language: codes and acronyms (capitals among small letters) don't, unless there is nothing else."""
    words = _WORD.findall(sentence)
    if not _CAPITALS.search(sentence):
        return words
    plain = [w for w in words if not (len(w) > 1 and w.isascii() and w.isupper())]
    return plain if len(plain) * 3 >= len(words) else words


def turns(text: str) -> list[str]:
    """Turns of a dialogue without their role labels."""
    return [s for s in _TURN.split(_clean(text)) if s and not s.isspace()]


def _clean(text: str) -> str:
    text = text.replace("\r", "\n")
    return text.translate(_character_map()) if _SPECIAL.search(text) else text


def _surface(word: str) -> str:
    """Lower case, with look-alikes spelled in the script the rest of the word shows."""
    if not word.isascii():
        form, _, forms = normalizer()._token(word)
        if not forms:
            word = form
    return word.lower()


def windows(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """``unit, first, length, low, high`` of the windows of units at ``starts`` in a long byte string; positions from low to high count."""
    long = np.flatnonzero(sizes > WINDOW)
    if not len(long):
        return np.arange(len(sizes)), starts, sizes, starts, starts + sizes
    step = WINDOW - 2 * CONTEXT
    n = np.where(sizes > WINDOW, -(-sizes // step), 1)
    unit = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(len(unit)) - np.repeat(np.cumsum(n) - n, n)
    many = n[unit] > 1
    end = starts[unit] + sizes[unit]
    low = np.where(many, starts[unit] + k * step, starts[unit])
    high = np.where(many, np.minimum(low + step, end), end)
    first, last = np.maximum(low - CONTEXT * many, starts[unit]), np.minimum(high + CONTEXT * many, end)
    return unit, first, last - first, low, high


class Scorer:
    """Log-probabilities of the languages for sentences given as words."""

    #: Surfaces of words kept; emptied when full. Longer words are not kept.
    LIMIT, LENGTH = 400_000, 64

    def __init__(self, net: ByteGRU) -> None:
        self.net = net
        self.known: dict[str, bytes] = {}

    def _bytes(self, word: str) -> bytes:
        raw = _surface(word).encode("utf-8", "replace")
        if len(self.known) >= self.LIMIT:
            self.known.clear()
        if len(word) <= self.LENGTH:
            self.known[word] = raw
        return raw

    def score(self, units: list[list[str]]) -> np.ndarray:
        """Per unit the sum over its words of the mean log-probabilities of their bytes; no unit may be empty."""
        known = self.known
        parts = [known.get(w) or self._bytes(w) for u in units for w in u]
        out = np.zeros((len(units), len(LANGS)))
        with one_thread():
            for unit, x, live, weight in batches(parts, [len(u) for u in units], CELLS):
                logp = self.net.log_probs(x, live)
                logp *= weight[:, None, :]
                np.add.at(out, unit, logp.sum(0).T)
        return out


def batches(parts: list[bytes], counts: list[int], cells: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``unit, bytes (T, B), live, weight`` of sentences given as the bytes of their words and their numbers of words, those of like length together.

    A word's bytes share a weight of 1, the blanks between words have none."""
    size = np.array([len(p) for p in parts], np.int64)
    flat = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    weight = np.repeat((1 / np.maximum(size, 1)).astype(np.float32), size + 1)
    ends = np.cumsum(size + 1)
    weight[ends - 1] = 0
    last = np.cumsum(counts) - 1
    first = np.r_[0, last[:-1] + 1]
    starts = ends[first] - size[first] - 1
    unit, at, length, low, high = windows(starts, ends[last] - 1 - starts)
    order = np.argsort(length, kind="stable")
    k = 0
    while k < len(order):
        # Ascending lengths: the last of a batch is its longest.
        n = max(1, min(len(order) - k, 4096, cells // max(1, int(length[order[k]]))))
        while n > 1 and n * int(length[order[k + n - 1]]) > cells:
            n = max(1, n * 3 // 4)
        w = order[k : k + n]
        k += n
        steps = np.arange(int(length[w[-1]]))[:, None]
        live = steps < length[w]
        idx = np.minimum(at[w] + steps, len(flat) - 1)
        share = weight[idx]
        share *= live
        if len(unit) > len(counts):  # some sentences have several windows, whose borders are context
            share *= (idx >= low[w]) & (idx < high[w])
        yield unit[w], flat[idx] * live, live, share


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def decide(scores: np.ndarray, sizes: np.ndarray) -> tuple[str, float, list[tuple[str, float, int, int]]]:
    """Language and confidence of a document from its sentences' scores, and its segments (language, confidence, first, last sentence).

    A sentence stands out if it is more likely in its own language than in the document's by the margin; others take the language around
    them."""
    total = scores.sum(0)
    main = int(total.argmax())
    own = scores.argmax(1)
    lead = scores[np.arange(len(own)), own] - scores[:, main]
    stands = (own != main) & (lead > np.where(sizes == 1, WORD_MARGIN, FOREIGN_MARGIN))
    if not stands.any():
        conf = float(_softmax(total / max(1.0, sizes.sum() ** 0.5))[main])
        return LANGS[main], conf, [(LANGS[main], conf, 0, len(own) - 1)]
    # The document's language is the one of the sentences that do not stand out; each sentence is now judged by itself.
    label = np.where(stands, own, main)
    segments = []
    first = 0
    for i in range(1, len(label) + 1):
        if i == len(label) or label[i] != label[first]:
            part = scores[first:i].sum(0)
            conf = float(_softmax(part / max(1.0, sizes[first:i].sum() ** 0.5))[label[first]])
            segments.append((LANGS[label[first]], conf, first, i - 1))
            first = i
    if len({s[0] for s in segments}) == 1:
        lang, conf = segments[0][0], float(np.mean([s[1] for s in segments]))
        return lang, conf, [(lang, conf, 0, len(own) - 1)]
    return MIXED, float(min(s[1] for s in segments)), segments


def training_sentences(rows: list[tuple[str, str]]) -> list[tuple[int, list[str]]]:
    """Sentences (label, words) from records (label, text) whose labels may be wrong.

    Word counts of all records give a first estimate; sentences whose words contradict their record's label are left out, repeatedly. Runs of function
    words of each language are always there, so that few or no records still give a network."""
    data = []
    surface = lru_cache(None)(_surface)  # the sample is bounded, and so are its words
    for lang, text in rows:
        for s in turns(text) if _TURN.match(text) else sentences(text):
            words = [surface(w) for w in words_of(s)]
            if len(words) >= 2:
                data.append((LANGS.index(lang), words))
    base = [(k, FUNCTION_WORDS[lang].split()) for k, lang in enumerate(LANGS)]
    kept = data
    for _ in range(4):
        c: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(LANGS)))
        for k, words in base:
            for w in words:
                c[w][k] += 2.0
        for k, words in kept:
            for w in words:
                c[w][k] += 1
        mass = np.maximum(sum(c.values()), 1.0)
        scored = {w: np.log((x + 0.05) / mass) for w, x in c.items()}
        zero = np.log(0.05 / mass)
        kept = [(k, words) for k, words in data if sum(scored.get(w, zero) for w in words).argmax() == k]
    return kept + [(k, words[i : i + 6]) for k, words in base for i in range(0, len(words), 6)]


#: Share of training sequences of Cyrillic languages that are spelled in Latin letters, of sequences cut to one or a few words, and of those in which words of
#: another language are put: they don't change the label.
ROMANIZED, CUT, FOREIGN = 0.2, 0.3, 0.3


def training_batches(sentences_: list[tuple[int, list[str]]]) -> Callable[[np.random.Generator], tuple]:
    """A drawing function for :func:`lexloom.llm.gru.train`: each language as often as any other, words in a row from a random one on."""
    by_lang = [[words for k, words in sentences_ if k == lang] for lang in range(len(LANGS))]
    tables = [[t for name, t in _TABLES if name == lang] for lang in LANGS]

    def draw(rng: np.random.Generator) -> tuple:
        parts: list[bytes] = []
        counts, labels = [], []
        for lang in rng.integers(0, len(LANGS), TRAIN_BATCH):
            words = by_lang[lang][rng.integers(len(by_lang[lang]))]
            most = int(rng.integers(1, 4)) if rng.random() < CUT else len(words)
            first = int(rng.integers(max(1, len(words) - most + 1))) if most < len(words) else int(rng.integers(max(1, len(words) // 2 + 1)))
            table = tables[lang][rng.integers(len(tables[lang]))] if tables[lang] and rng.random() < ROMANIZED else None
            taken, size = [], 0
            run = [(w.translate(table) or w) if table else w for w in words[first : first + most]]
            if len(run) > 1 and rng.random() < FOREIGN:
                other = by_lang[rng.integers(0, len(LANGS))]
                other = other[rng.integers(len(other))]
                most = len(run) if tables[lang] and not table else max(1, len(run) // 3)  # names in Latin letters may be as many as the words around them
                for _ in range(int(rng.integers(1, min(5, most + 1)))):
                    run.insert(int(rng.integers(len(run) + 1)), other[rng.integers(len(other))])
            for w in run:
                raw = w.encode("utf-8", "replace")[:TRAIN_BYTES]
                if taken and size + len(raw) + 1 > TRAIN_BYTES:
                    break
                taken.append(raw)
                size += len(raw) + 1
            if taken:
                parts += taken
                counts.append(len(taken))
                labels.append(lang)
        unit, x, live, weight = next(batches(parts, counts, 1 << 30))
        return x, live, weight, np.eye(len(LANGS), dtype=np.float32)[np.array(labels)[unit]].T

    return draw


def training_sample(tables: list[tuple[DataFrame, str, str, str]], per_lang: int = TRAIN_PER_LANG) -> list[tuple[str, str]]:
    """At most ``per_lang`` records per recorded language and table (frame, id, text, lang), those of the smallest id hashes.

    Only ids are ranked; their number is bounded, so they are broadcast to fetch the texts."""
    out: list[tuple[str, str]] = []
    for df, id_col, text_col, lang_col in tables:
        named = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), recorded(F.col(lang_col)).alias("lang")).where(F.col("lang").isin(*LANGS))
        order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
        ids = named.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_lang).select("id", "lang").distinct()
        texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(ids), "id")
        # One text a sampled id and label: of redelivered rows that differ, the smallest.
        seen = {(r.id, r.lang): r.text for r in texts.groupBy("id", "lang").agg(F.min("text").alias("text")).collect()}
        out += [(lang, text) for (_, lang), text in sorted(seen.items(), key=lambda x: (str(x[0][0]), x[0][1]))]
    return out


_NETS: dict[int, ByteGRU] = {}


def fit(tables: list[tuple[DataFrame, str, str, str]], per_lang: int = TRAIN_PER_LANG, steps: int = TRAIN_STEPS) -> ByteGRU:
    """The network for tables (frame, id, text, lang); the same sample is not trained on twice in one process."""
    rows = training_sample(tables, per_lang)
    key = hash((steps, tuple(rows)))
    if key not in _NETS:
        _NETS.clear()
        _NETS[key] = fit_rows(rows, steps)
    return _NETS[key]


def fit_rows(rows: list[tuple[str, str]], steps: int = TRAIN_STEPS) -> ByteGRU:
    return train(training_batches(training_sentences(rows)), len(LANGS), steps)


_SCORERS: dict[int, Scorer] = {}


def _scorer(net: ByteGRU) -> Scorer:
    key = hash(net.p["V"].tobytes())
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(net)
    return _SCORERS[key]


def label_texts(texts: list[str | None], net: ByteGRU, dialogues: bool) -> list[tuple[str | None, float | None, list[dict]]]:
    scorer = _scorer(net)
    cut = turns if dialogues else sentences
    units: list[list[str]] = []
    plan: list[tuple[int, list[str]] | None] = []
    for t in texts:
        parts, n = [], 0
        for s in cut(t) if t else ():
            words = words_of(s)
            if words:
                units.append(words)
                parts.append(s)
        plan.append((len(parts), parts))
    scores = scorer.score(units) if units else np.empty((0, len(LANGS)))
    sizes = np.array([len(u) for u in units])
    out, at = [], 0
    for n, parts in plan:
        if not n:
            out.append((None, None, []))
            continue
        lang, conf, segments = decide(scores[at : at + n], sizes[at : at + n])
        at += n
        out.append((lang, conf, [{"seg_no": i + 1, "lang": x, "confidence": c, "first": a, "last": b} for i, (x, c, a, b) in enumerate(segments)]))
    return out


SEGMENTS = "array<struct<seg_no:int,lang:string,confidence:double,first:int,last:int>>"


def label_languages(df: DataFrame, net: ByteGRU, id_col: str, text_col: str = "text", dialogues: bool = False, skip: Column | None = None, carry: Column | None = None) -> DataFrame:
    """``id, carried, lang, confidence, segments`` of every row: ``lang`` is a code or ``mixed``, ``segments`` are the maximal runs of
    sentences in one language.

    A text is mixed if at least one whole sentence (of a dialogue: turn) is in another language than the rest. Null texts, texts without
    letters and rows where ``skip`` holds have a null language and no segments. ``carry`` is a string that is passed on. Texts of any length
    are taken whole, repeated rows give repeated rows, other columns don't matter."""

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = label_texts(list(pdf["text"]), net, dialogues)
            out = pd.DataFrame(found, columns=["lang", "confidence", "segments"])
            out.insert(0, "id", pdf["id"].to_numpy())
            out.insert(1, "carried", pdf["carried"].to_numpy())
            yield out

    # An operator of its own and not a column: filters above it must not be pushed into what computes its input.
    text = F.col(text_col) if skip is None else F.when(~F.coalesce(skip, F.lit(False)), F.col(text_col))
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), (carry if carry is not None else F.lit(None)).cast("string").alias("carried"), text.alias("text"))
    return rows.mapInPandas(label, f"id long, carried string, lang string, confidence double, segments {SEGMENTS}")
