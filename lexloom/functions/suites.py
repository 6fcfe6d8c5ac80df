"""Small built-in suites of prompts with accepted answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Suite, prompt, accepted answers, type.
ITEMS = [
    ("arithmetic", "2 + 2 =", ["4"], "math"),
    ("arithmetic", "10 - 3 =", ["7"], "math"),
    ("arithmetic", "6 * 7 =", ["42"], "math"),
    ("arithmetic", "Сколько будет 5 + 5?", ["10"], "math"),
    ("arithmetic", "What is 12 / 3?", ["4"], "math"),
    ("instruction", "Напиши ответ одним словом: столица России?", ["Москва", "москва"], "instruction"),
    ("instruction", "Ответь только словом: 2+2 равно", ["4"], "instruction"),
    ("instruction", "Say the single word: color of the sky", ["blue", "Blue"], "instruction"),
    ("reasoning", "У Маши было 3 яблока, ей дали ещё 2. Сколько яблок стало?", ["5"], "reasoning"),
    ("reasoning", "If a train travels 60 km in 1 hour, how far in 2 hours?", ["120"], "reasoning"),
    ("multilingual", "Переведи на английский: привет", ["hello", "hi"], "multilingual"),
    ("multilingual", "Translate to Russian: goodbye", ["пока", "до свидания", "прощай"], "multilingual"),
    ("conversation", "Привет! Как дела?", [], "conversation"),
    ("conversation", "Hello! How are you?", [], "conversation"),
    ("programming", "Напиши функцию на Python, которая возвращает сумму двух чисел.", ["def", "return"], "code"),
    ("programming", "Write a Python function that returns the square of x.", ["def", "return"], "code"),
]
SCHEMA = "suite string, prompt string, answers array<string>, type string"


def suite(spark: SparkSession, name: str = "all") -> DataFrame:
    """The items of a suite, of all for ``all``, none for an unknown name."""
    items = spark.createDataFrame(ITEMS, SCHEMA)
    return items if name == "all" else items.where(F.col("suite") == name)


def suite_names() -> list[str]:
    return [*dict.fromkeys(i[0] for i in ITEMS), "all"]
