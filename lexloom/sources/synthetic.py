"""Synthetic corpora, repeatable row by row: a row depends on the seed and its number, not on the partitioning."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bucket, share, least and most turns.
BUCKETS = (("very_short", 0.10, 2, 4), ("short", 0.20, 5, 9), ("medium", 0.30, 10, 29), ("long", 0.25, 30, 60), ("very_long", 0.15, 61, 120))
# Share of dialogues in English, and of mixed ones among the others.
ENGLISH, MIXED = 0.03, 0.06
PERSONAS = ("student", "parent", "gamer", "traveler", "cook", "night_owl", "joker", "skeptic", "dreamer", "calm", "curious", "tired", "worker")
STYLES = ("short", "detailed", "playful", "neutral", "supportive", "with_question", "dry", "warm", "formal", "lively")
TOPICS = {
    "study": (("экзамен", "лекция", "задача"), ("exam", "lecture", "problem")),
    "work": (("проект", "отчёт", "встреча"), ("project", "report", "meeting")),
    "home": (("ужин", "уборка", "сад"), ("dinner", "cleaning", "garden")),
    "games": (("партия", "турнир", "уровень"), ("match", "tournament", "level")),
    "travel": (("поездка", "билет", "маршрут"), ("trip", "ticket", "route")),
}
_USER = (("Сегодня у меня {x}.", "Что ты думаешь про {x}?", "Опять {x}, и я не знаю, с чего начать."), ("Today I have a {x}.", "What do you think about the {x}?", "Again a {x}, and I do not know where to begin."))
_BOT = (("Расскажи подробнее про {x}.", "Понимаю, {x} отнимает силы.", "Начни с малого, и {x} пойдёт легче."), ("Tell me more about the {x}.", "I see, a {x} takes effort.", "Begin with a small step, the {x} gets easier."))
DIALOGUE = "id long, text string, turns int, lang string, persona string, style string, bucket string, signature array<string>"


def colloquial(text: str, rng: random.Random, formal: bool = False) -> str:
    """As written in a chat: a small first letter or two letters swapped, now and then. Formal texts and texts in capitals stay."""
    if formal or not text or text.isupper():
        return text
    if rng.random() < 0.4:
        text = text[0].lower() + text[1:]
    at = rng.randrange(len(text))
    if rng.random() < 0.05 and at + 1 < len(text) and text[at].isalpha() and text[at + 1].isalpha():
        text = text[:at] + text[at + 1] + text[at] + text[at + 2 :]
    return text


def make_dialogue(seed: int, number: int) -> tuple:
    rng = random.Random(f"{seed}:{number}")
    bucket, _, low, high = rng.choices(BUCKETS, [b[1] for b in BUCKETS])[0]
    turns = rng.randint(low, high)
    turns += turns % 2
    lang = "en" if rng.random() < ENGLISH else "mixed" if rng.random() < MIXED else "ru"
    topic = rng.choice(sorted(TOPICS))
    lines, signature, recent = [], [], []
    for i in range(turns):
        k = {"ru": 0, "en": 1}.get(lang, rng.random() < 0.5)
        bank = (_USER, _BOT)[i % 2][k]
        at = rng.choice([n for n in range(len(bank)) if (i % 2, k, n) not in recent[-2:]] or range(len(bank)))
        recent.append((i % 2, k, at))
        said = bank[at].format(x=rng.choice(TOPICS[topic][k])) + ("" if rng.random() < 0.7 else f" ({i + 1})")
        lines.append(said if i % 2 else colloquial(said, rng))
        signature.append(f"{'ru' if not k else 'en'}.{'ua'[i % 2]}.{topic}.{at}")
    text = "\n\n".join(("USER: ", "ASSISTANT: ")[i % 2] + x for i, x in enumerate(lines))
    return number, text, turns, lang, rng.choice(PERSONAS), rng.choice(STYLES), bucket, signature


def dialogues(spark: SparkSession, n: int, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """``n`` dialogues with the fields a generator records."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in DIALOGUE.split(", ")]
        for pdf in batches:
            yield pd.DataFrame([make_dialogue(seed, int(i)) for i in pdf["id"]], columns=names)

    return spark.range(0, n, 1, partitions or spark.sparkContext.defaultParallelism).mapInPandas(make, DIALOGUE)


def sft_messages(spark: SparkSession, n: int, seed: int = 0, extra: DataFrame | None = None) -> DataFrame:
    """``messages`` of ``n`` synthetic dialogues and of the dialogues (column ``text``) of another source, if they have two messages or more."""
    from lexloom.functions.dialogue import text_to_messages

    texts = dialogues(spark, n, seed).select("text")
    if extra is not None:
        texts = texts.unionByName(extra.select("text"))
    return texts.select(text_to_messages("text").alias("messages")).where(F.size("messages") >= 2)


# Kinds of seed documents and their shares.
SEED_KINDS = (("prose", 0.40), ("dialogue", 0.35), ("instruction", 0.10), ("code", 0.05), ("math", 0.10))


def seed_corpus(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """``doc_id, kind, text``: short documents of several kinds; every second one comes with an extra one, so there are more rows than ``n``."""
    draw = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(1 << 30)) / float(1 << 30)
    base = spark.range(n).withColumn("copy", F.explode(F.when(draw(1) < 0.5, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    r = F.pmod(F.xxhash64(F.lit(seed), F.lit(2), "id", "copy"), F.lit(1 << 30)) / float(1 << 30)
    kind, at = F.lit(SEED_KINDS[-1][0]), 1.0
    for name, share in reversed(SEED_KINDS[:-1]):
        at -= dict(SEED_KINDS)[SEED_KINDS[[k for k, _ in SEED_KINDS].index(name) + 1][0]]
        kind = F.when(r < at, name).otherwise(kind)
    x = F.pmod(F.xxhash64(F.lit(seed), F.lit(3), "id", "copy"), F.lit(997))
    text = (
        F.when(F.col("kind") == "prose", F.format_string("Text %d is about the number %d. It has two sentences.", "id", x))
        .when(F.col("kind") == "dialogue", F.format_string("USER: What is %d?\n\nASSISTANT: A number.", x))
        .when(F.col("kind") == "instruction", F.format_string("Write down the number %d.", x))
        .when(F.col("kind") == "code", F.format_string("def f(x):\n    return x + %d", x))
        .otherwise(F.format_string("%d + 1 = %d", x, x + 1))
    )
    return base.withColumn("kind", kind).select((F.col("id") * 2 + F.col("copy")).alias("doc_id"), "kind", text.alias("text"))
