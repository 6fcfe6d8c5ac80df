"""Defects of prompt and response pairs: empty, copy, refusal, other_language, truncated.

* ``copy``: the response is compressed with its prompt as a zstandard dictionary; a copy adds next to nothing to the prompt.
* ``refusal`` and ``other_language``: dictionaries of refusal phrases and of function words and letters of languages.
* ``truncated``: a terminal-context model. Over all responses and prompts it is counted how often a word, and a word after its
  predecessor, ends a sentence; a response without a final stop is truncated if its last words hardly ever do. Open
  brackets and quotes, a final comma, colon or dash and words seen nowhere else count as breaking off too.

The counts cover all rows and are joined by word, never collected or broadcast by hand.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.session import materialize

DEFECTS = ("empty", "copy", "refusal", "other_language", "truncated")
#: Compressed size with the prompt as dictionary against without, up to which a response is a copy.
COPY_RATIO = 0.4
#: The same for a response that also breaks off: up to this it is a copy, above it a truncated answer that repeats the question.
SURE_COPY_RATIO = 0.15
#: Share of occurrences of the last words at a sentence's end below which the response breaks off there.
END_RATE = 0.04
#: Weight, in occurrences, of the single word's rate in the rate of a pair of words.
BACKOFF = 2.0

# Chosen by hand: fillers that say nothing.
NOTHING = ("n/a", "na", "null", "none", "nil", "nan", "undefined", "empty", "-", "нет ответа", "no answer", "no response", "todo", "tbd")

# Chosen by hand: function words by language.
FUNCTION_WORDS = {
    "ru": "и в во не на я что он с со как а то все она так его но да ты к у же вы за бы по только её мне было вот от меня ещё нет о из ему теперь когда даже ну ли если уже или ни быть был него до вас опять вам ведь там потом себя ничего ей может они тут где есть надо для мы тебя их чем была сам чтоб без будто чего раз тоже себе под будет тогда кто этот потому этого какой совсем этом этой перед сразу после через хотя пока",
    "en": "the of and to in is you that it he was for on are as with his they at be this have from or one had by but not what all were we when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into time has look two more go see no way could my than first been who its now find down did get come may part this because",
    "uk": "і й та в у не на я що він з зі із як а то все вона так його але ти до же ви за б по тільки її мені було ось від мене ще ні про йому тепер коли навіть чи якщо вже або бути був нього вас знову вам адже там потім себе нічого може вони тут де є треба для ми тебе їх чим була без ніби чого тоді хто цей тому цього який під перед біля після через хоча поки дуже щодня вранці вдень увечері сьогодні щотижня іноді завжди",
    "de": "der die das und in zu den dem ein eine einen einem einer mit von am im auf für ist nicht als auch nach bei aus an er sie es ich du wir ihr wie so aber oder wenn weil dass war sind hat haben wird sich um noch nur über vor zum zur denn doch manchmal jeden heute",
    "fr": "le la les de des du un une et à en dans sur pour avec au aux ce cette est pas que qui par il elle nous vous je tu ils elles ne se sa son ses mais ou où donc car si comme plus tout près chaque après avant mon ma mes notre quand l d",
    "es": "el la los las de del un una unos y a en con por para al que es no se su sus lo le mi tu nuestro nuestra pero o si como más muy cada después antes cuando porque aunque hoy ayer esta este junto mientras veces",
}
_WORDS = {lang: frozenset(words.split()) for lang, words in FUNCTION_WORDS.items()}
# Chosen by hand: letters that point to a language among those of its script.
_LETTERS = {"ru": "ыэъё", "uk": "іїєґ", "de": "äöüß", "fr": "àâçèêëîïôœùûÿ", "es": "ñ¿¡áíóú"}

# Chosen by hand: a translation or an answer in a language that is named is asked for.
_ASKED = re.compile(
    r"\b(?:перев[её]д|переклад|перекласт|translat|übersetz|tradui|traduc)|"
    r"\b(?:на|по)[ -](?:английск|немецк|французск|испанск|украинск|русск|китайск|итальянск)|"
    r"\b(?:in|into|to) (?:english|german|french|spanish|ukrainian|russian|chinese|italian)\b|\bauf (?:englisch|deutsch|russisch)|\ben (?:anglais|allemand|inglés|alemán|ruso|russe)",
    re.I,
)

# Chosen by hand: refusing phrases, and phrases with the same words that do not refuse.
_NOT_REFUSING = re.compile(
    r"не (?:могу|можу) не |(?:can['’]?t|cannot|couldn['’]?t) help (?:but|\w+ing)|(?:can['’]?t|cannot) (?:recommend|thank|praise|stress|wait|say)\b[^.!?]*\benough|"
    r"not able to (?:sit|stand|wait|stop|help but)|(?:отказать(?:ся)?|отказываться) (?:тут |здесь |от этого )?(?:сложно|трудно|нельзя|невозможно)|nobody can refuse|hard to refuse",
    re.I,
)
_REFUSING = re.compile(
    r"\bне (?:могу|смогу|буду|стану|хочу|готов\w*|имею права|вправе|получится|да(?:ю|м)|положено|умею|разрешено|позволено|в силах|в состоянии)\b[^.!?…]*|"
    r"\b(?:помочь|ответить|отвечать|обсуждать|рассказать|рассказывать)\b[^.!?…]* не (?:могу|смогу|буду|стану|получится|готов\w*|хочу)\b|"
    r"\b(?:мне|нам) (?:нельзя|запрещено|не разрешено)\b[^.!?…]*|\bвоздерж(?:усь|иваюсь|аться)\b|\bотказываюсь\b|\bоткажусь\b|\bвынужден\w* отказать|\bвыходит за рамки\b[^.!?…]*|"
    r"\bтема\b[^.!?…]* закрыта\b|\b(?:ответа|советов|советы) не да(?:м|ю)\b|\bобратитесь к специалист\w*|"
    r"\b(?:I|we)(?: am|['’]m| are|['’]re)? (?:just |only |simply |afraid |afraid I |sorry |sorry,? but I |really )*(?:can['’]?t|cannot|can not|won['’]?t|will not|am not able to|not able to|unable to|am unable to|not allowed to|not permitted to|not going to|must decline|have to decline|decline|refuse|must refuse|have to pass|must pass|would rather not|['’]d rather not|do not|don['’]t|prefer not to)\b[^.!?…]*|"
    r"\boff[- ]limits\b|\bbeyond what I\b[^.!?…]*|\boutside (?:of )?what I\b[^.!?…]*|\bagainst my (?:rules|guidelines|policy)\b|"
    r"\bich (?:kann|darf|werde|möchte)\b[^.!?…]* nicht\b[^.!?…]*|\bje ne (?:peux|veux|dois|vais) pas\b[^.!?…]*|\bno (?:puedo|voy a|debo)\b[^.!?…]*|\bне (?:можу|буду)\b[^.!?…]*",
    re.I,
)
_ABOUT = re.compile(
    r"ответ|отвеч|обсужд|помоч|помог|рассказ|говорить|совет|подсказ|запрос|тем[аеуы]\b|вопрос|комментир|воздерж|отказыва|откажусь|отказать|рамки|закрыта|специалист|"
    r"help|answer|discuss|assist|talk|advi[cs]e|question|request|comment|provide|topic|specialist|decline|refuse|pass\b|rather not|off[- ]limits|beyond|outside|tell|share|respond|rules|guidelines|policy|"
    r"antwort|helfen|sprechen|beantwort|répond|aider|parler|discuter|contestar|responder|ayudar|hablar|відпові|допомог|обговор",
    re.I,
)
_MARKS = re.compile(r"<[A-Z_]{2,16}>|^\s*(?:USER|ASSISTANT|SYSTEM)\s*:\s*", re.M)
_ALNUM = re.compile(r"[^\W_]")
_TOKENS = re.compile(r"[^\W\d_]+")
_PLAIN = re.compile(r"[^\w]+|_+")


def is_empty(reply: str | None) -> bool:
    """Nothing is said: no letters or figures, or a filler or special tokens only."""
    if reply is None:
        return True
    bare = _MARKS.sub(" ", reply).strip()
    return not _ALNUM.search(bare) or bare.strip(" .!?…[](){}<>\"'").lower() in NOTHING


def refuses(reply: str) -> bool:
    """A sentence of the reply declines and names what it declines."""
    text = _NOT_REFUSING.sub(" ", reply)
    return any(_ABOUT.search(m[0]) or _ABOUT.search(text[max(0, m.start() - 40) : m.end() + 40].split(". ")[0]) and len(m[0].split()) <= 4 for m in _REFUSING.finditer(text))


def dictionary_language(text: str) -> tuple[str | None, float]:
    """Language by function words and letters, and its lead over the next one (in words); None without evidence."""
    low = text.lower()
    words = _TOKENS.findall(low)
    if not words:
        return None, 0.0
    cyr = sum(1 for w in words if "а" <= w[0] <= "ӿ")
    langs = ("ru", "uk") if cyr * 2 > len(words) else ("en", "de", "fr", "es")
    score = {lang: float(sum(w in _WORDS[lang] for w in words)) for lang in langs}
    for lang in langs:
        score[lang] += 1.5 * sum(any(c in _LETTERS.get(lang, "") for c in w) for w in words)
    ranked = sorted(langs, key=lambda x: -score[x])
    return ranked[0], score[ranked[0]] - score[ranked[1]]


def _script(text: str) -> str | None:
    words = _TOKENS.findall(text)
    cyr = sum(len(w) for w in words if "а" <= w[0].lower() <= "ӿ")
    lat = sum(len(w) for w in words if w[0].isascii() or "À" <= w[0] <= "ɏ")
    return None if not cyr and not lat else "Cyrl" if cyr > lat else "Latn"


def in_other_language(prompt: str, reply: str) -> bool:
    """The reply is not in the prompt's language and none was asked for."""
    if _ASKED.search(prompt):
        return False
    a, b = _script(prompt), _script(reply)
    if a is None or b is None:
        return False
    n = len(_TOKENS.findall(reply))
    if a != b:
        return n >= 2
    (la, ma), (lb, mb) = dictionary_language(prompt), dictionary_language(reply)
    return la is not None and lb is not None and la != lb and ma >= 1 and mb >= 1.5 and n >= 3


def _plain(text: str) -> bytes:
    return _PLAIN.sub(" ", text.lower()).strip().encode()


def copy_ratio(prompt: str, reply: str) -> float:
    """Compressed size of the reply with the prompt as dictionary, against its size compressed alone. Case and marks don't matter."""
    import zstandard as z

    p, r = _plain(prompt), _plain(reply)
    if not p or not r:
        return 1.0
    params = z.ZstdCompressionParameters.from_level(3, write_content_size=0, write_checksum=0, write_dict_id=0, format=z.FORMAT_ZSTD1_MAGICLESS)
    alone = len(z.ZstdCompressor(compression_params=params).compress(r))
    known = len(z.ZstdCompressor(dict_data=z.ZstdCompressionDict(p, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=params).compress(r))
    return max(known - 4, 0) / max(alone - 4, 1)


def is_copy(prompt: str, reply: str, ratio: float) -> bool:
    """Only the question comes back: it adds little to the prompt, is about as long and holds most of it."""
    p, r = _plain(prompt).split(), _plain(reply).split()
    if len(r) < 3 or len(r) < 0.5 * len(p) or len(r) > 1.5 * len(p) + 4:
        return False
    inside = len(set(p) & set(r)) / max(1, len(set(p)))
    return ratio <= COPY_RATIO and inside >= 0.6


def _pair_signals(prompt: Column, reply: Column) -> Column:
    @F.pandas_udf("empty boolean, copy_ratio double, copy boolean, refusal boolean, other_language boolean")
    def signals(prompts: pd.Series, replies: pd.Series) -> pd.DataFrame:
        rows = []
        for p, r in zip(prompts, replies):
            if is_empty(r):
                rows.append((True, 1.0, False, False, False))
                continue
            p = p or ""
            ratio = copy_ratio(p, r)
            rows.append((False, ratio, is_copy(p, r, ratio), refuses(r), in_other_language(p, r)))
        return pd.DataFrame(rows, columns=["empty", "copy_ratio", "copy", "refusal", "other_language"])

    return signals(prompt, reply)


_TOKEN = r"[\p{L}\p{N}]+(?:['’\-][\p{L}\p{N}]+)*|[.!?…]+"


def terminal_counts(texts: Sequence[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """How often words and word pairs of the one-column frames (``t``) end a sentence: ``w1, n, n_end`` and ``w0, w1, n, n_end``."""
    both = texts[0]
    for t in texts[1:]:
        both = both.unionByName(t)
    tokens = both.where("t is not null").select(F.regexp_extract_all(F.lower("t"), F.lit(f"({_TOKEN})"), 1).alias("w"))
    stop = lambda x: F.left(x, F.lit(1)).isin(".", "!", "?", "…")
    # The last token of a text without a stop has no successor: whether it ends a sentence is what is asked, so it isn't counted.
    triples = tokens.where(F.size("w") >= 2).select(
        F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(F.when(i > 1, F.get("w", i - 2)).alias("w0"), F.get("w", i - 1).alias("w1"), stop(F.get("w", i)).alias("end")))).alias("x")
    )
    pairs = triples.select("x.*").where(~stop(F.col("w1"))).groupBy("w0", "w1").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end").cast("long")).alias("n_end"))
    pairs = materialize(pairs, "word_pairs")
    return pairs.groupBy("w1").agg(F.sum("n").alias("n"), F.sum("n_end").alias("n_end")), pairs


def pair_defects(df: DataFrame, id_col: str = "sample_id", prompt_col: str = "prompt", reply_col: str = "reply") -> DataFrame:
    """One row per id: ``id, defect, copy_ratio, end_rate`` with the first defect that holds, in the order of ``DEFECTS``, or null.

    Redelivered rows count once (of different rows under one id the smallest pair); null ids are left out. A null or blank reply is empty.
    Pairs without a prompt (null or blank) get no defect. An empty table gives no rows."""
    rows = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.struct(F.col(prompt_col).alias("p"), F.col(reply_col).alias("r"))).alias("_x")).select("id", "_x.p", "_x.r")
    rows = materialize(rows, "pairs")
    words, pairs = terminal_counts([rows.select(F.col("r").alias("t")), rows.select(F.col("p").alias("t"))])
    body = F.regexp_replace(F.coalesce("r", F.lit("")), r"(?U)\s+$", "")
    tail = F.regexp_extract_all(F.lower(body), F.lit(f"({_TOKEN})"), 1)
    asked = rows.where(F.col("p").rlike(r"(?U)\S")).withColumn("tail", tail).select(
        "id", "p", "r",
        body.alias("body"),
        F.when(F.size("tail") >= 1, F.try_element_at("tail", F.lit(-1))).alias("last"),
        F.when(F.size("tail") >= 2, F.try_element_at("tail", F.lit(-2))).alias("before"),
        F.size("tail").alias("n_tokens"),
    )
    sig = asked.withColumn("s", _pair_signals(F.col("p"), F.col("r")))
    w = words.select(F.col("w1").alias("_w"), F.col("n").alias("wn"), F.col("n_end").alias("we"))
    q = pairs.select(F.col("w0").alias("_q0"), F.col("w1").alias("_q1"), F.col("n").alias("qn"), F.col("n_end").alias("qe"))
    known = sig.join(w, sig["last"] == w["_w"], "left").join(q, (F.col("before") == F.col("_q0")) & (F.col("last") == F.col("_q1")), "left")
    uni = F.coalesce(F.col("we") / F.col("wn"), F.lit(0.0))
    rate = (F.coalesce("qe", F.lit(0)) + F.lit(BACKOFF) * uni) / (F.coalesce("qn", F.lit(0)) + F.lit(BACKOFF))
    stopped = F.col("body").rlike(r"(?:[.!?…]['\"»”’)\]*]*|[)\]»”]|[\x{2600}-\x{27BF}\x{1F300}-\x{1FAFF}\x{FE0F}]|[:;]-?[)D(P])$")
    count = lambda c: F.length("body") - F.length(F.replace("body", F.lit(c), F.lit("")))
    brackets = (count("(") > count(")")) & ~F.col("body").rlike(r"[:;]-?\($")
    unclosed = brackets | (count("«") > count("»")) | (count("[") > count("]")) | (count("{") > count("}")) | (count("„") > count("“") + count("”")) | (count('"') % 2 == 1)
    dangling = F.col("body").rlike(r"[,:;(\[{«„—–-]['\"]*$") & ~stopped
    truncated = unclosed | dangling | ~stopped & (F.col("n_tokens") > 3) & (rate < END_RATE)
    known = known.withColumn("_broken_off", truncated)
    truncated = F.col("_broken_off")
    copy = F.col("s.copy") & (~truncated | (F.col("s.copy_ratio") <= SURE_COPY_RATIO))
    defect = F.when(F.col("s.empty"), "empty").when(copy, "copy").when(F.col("s.refusal"), "refusal").when(F.col("s.other_language"), "other_language").when(truncated, "truncated")
    return known.select("id", defect.alias("defect"), F.col("s.copy_ratio").alias("copy_ratio"), F.when(~stopped, rate).alias("end_rate"))
