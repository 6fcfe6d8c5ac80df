import unicodedata

import pytest
from pyspark.sql import functions as F

from lexloom.functions import clean, dialogue, filters, language, logits, metrics, sizing, suites
from lexloom.operators import shards


def one(spark, expr, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) and (not v or isinstance(v[0], str)) else 'array<int>' if isinstance(v, list) and isinstance(v[0], int) else 'array<double>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "cleaned"),
    [
        ("  Hello   world\n\n\n\nagain ", "Hello world\n\nagain"),
        ("a\x00b\x0cc", "abc"),
        ("x​y﻿", "xy"),
        ("été", "été"),
        (None, ""),
        ("\n \n", ""),
        ("a\r\nb", "a \nb"),
    ],
)
def test_clean(spark, text, cleaned):
    assert one(spark, clean.clean_text("t"), t=text) == cleaned


def test_redact_and_normal_forms(spark):
    assert one(spark, clean.redact("t"), t="see HTTPS://a.b/c?d and Jo.Do+x@mail.example.org now") == "see <URL> and <EMAIL> now"
    assert one(spark, clean.normalize_unicode("t", "NFKC"), t="ﬁ ²") == unicodedata.normalize("NFKC", "ﬁ ²")
    with pytest.raises(ValueError):
        clean.normalize_unicode("t", "NFX")


def test_hash_ignores_blanks(spark):
    assert one(spark, clean.doc_hash("t"), t="a  b c") == one(spark, clean.doc_hash("t"), t=" a b c ")
    assert one(spark, clean.pre_tokenize("t"), t="a \n b") == ["a", " \n ", "b"]
    assert one(spark, clean.titled_document(F.lit("T"), F.col("t")), t="T is") == "T is"
    assert one(spark, clean.titled_document(F.lit("T"), F.col("t")), t="x") == "T\nx"
    assert one(spark, clean.fill_template("t", F.create_map(F.lit("a"), F.lit("1"))), t="{a} {b}") == "1 …"


@pytest.mark.parametrize(("text", "lang"), [("Это предложение на русском языке и оно простое", "ru"), ("This is the text of an English sentence", "en"), ("12345", "other"), ("le chat noir", "en"), ("", "other")])
def test_language(spark, text, lang):
    assert one(spark, language.detect_language("t"), t=text) == lang


def test_filters(spark):
    long = "Here is a plain sentence with quite enough different words to pass every single test of length. "
    assert one(spark, filters.reject_reason("t"), t="short") == "length"
    assert one(spark, filters.reject_reason("t"), t=long) is None
    assert one(spark, filters.reject_reason("t"), t=long + "john.doe@example.com") == "pii"
    assert one(spark, filters.reject_reason("t"), t=long + "+7 (912) 345-67-89") == "pii"
    assert one(spark, filters.reject_reason("t"), t=long + "wow!!!!") == "spam"
    assert one(spark, filters.reject_reason("t"), t=long.upper()) == "spam"
    assert one(spark, filters.reject_reason("t"), t="go " * 40) == "unique_words"
    assert one(spark, filters.reject_reason("t", ["ru"]), t=long) == "language"
    assert one(spark, filters.reject_reason("t"), t=None) == "length"
    assert one(spark, filters.top_char_share("t"), t="aab") == pytest.approx(2 / 3)
    assert one(spark, filters.filter_repetition("t"), t="") is False


GOOD = "USER: привет\n\nASSISTANT: Привет! Как дела?"


def test_dialogue(spark):
    assert one(spark, dialogue.split_turns("t"), t=GOOD) == ["привет", "Привет! Как дела?"]
    assert one(spark, dialogue.split_turns("t"), t="USER: \n\nASSISTANT: ") == ["ASSISTANT:"]
    assert one(spark, dialogue.assemble(dialogue.split_turns("t")), t=GOOD) == GOOD
    assert [tuple(m) for m in one(spark, dialogue.text_to_messages("t"), t=GOOD)] == [("user", "привет"), ("assistant", "Привет! Как дела?")]
    assert one(spark, dialogue.check_dialogue("t"), t=GOOD) is True
    for bad in ("hello", "USER: \n\nASSISTANT: ", "USER: a\n\nUSER: b", "USER: a\n\nASSISTANT: �", "USER: a\n\nASSISTANT: " + "x" * 301, "", None):
        assert one(spark, dialogue.check_dialogue("t"), t=bad) is False
    loop = "USER: x\n\nASSISTANT: same\n\nUSER: same\n\nASSISTANT: same"
    assert one(spark, dialogue.check_repetition("t"), t=loop) is False
    grams = "USER: " + "a b c d " * 10 + "\n\nASSISTANT: ok"
    assert one(spark, dialogue.check_repetition("t"), t=grams) is True  # each 4-gram makes up less than a quarter
    assert one(spark, dialogue.check_repetition("t"), t="USER: " + "a " * 30 + "\n\nASSISTANT: ok") is False


def test_metrics(spark):
    assert one(spark, metrics.repetition_ratio("t"), t=list("abcdabcd")) == pytest.approx(1 / 5)
    assert one(spark, metrics.repetition_ratio("t"), t=list("abc")) == 0
    assert one(spark, metrics.max_run_ratio("t"), t=list("abbbc")) == pytest.approx(3 / 5)
    assert one(spark, metrics.max_run_ratio("t"), t=[]) == 0
    assert one(spark, metrics.distinct_ratio("t"), t=list("aab")) == pytest.approx(2 / 3)
    assert one(spark, metrics.invalid_char_ratio("t"), t="a�\r\n") == pytest.approx(2 / 4)
    assert one(spark, metrics.non_letter_symbol_ratio("t"), t="a#b ") == pytest.approx(1 / 4)
    assert one(spark, metrics.word_fragment_ratio("t"), t="a bb 7 c") == pytest.approx(2 / 3)
    assert one(spark, metrics.contains_any("t", F.array(F.lit("BLUE"))), t="It is blue") is True
    assert one(spark, metrics.perplexity(F.lit(10000.0)), t="") == pytest.approx(1.0142320547350045e304)


def test_logits(spark):
    x = [1.0, 3.0, 2.0, 3.0]
    assert one(spark, logits.top_k("t", 1), t=x) == [1, 3]
    assert one(spark, logits.argmax("t"), t=x) == 1
    assert one(spark, logits.top_p("t", 0.5), t=x) == [1, 3]
    assert one(spark, logits.min_p("t", 0.3), t=x) == [1, 2, 3]
    assert sum(one(spark, logits.softmax("t"), t=x)) == pytest.approx(1)
    assert one(spark, logits.repetition_penalty("t", F.array(F.lit(1)), 2.0), t=x) == [1.0, 1.5, 2.0, 3.0]
    assert one(spark, logits.count_penalties("t", F.array(F.lit(0), F.lit(0)), 0.5, 0.25), t=x)[0] == pytest.approx(-0.25)
    assert one(spark, logits.dpo_loss(F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(0.0)), t="") == pytest.approx(0.6931471805599453)
    assert one(spark, logits.clipped_ratio_loss(F.lit(1.0), F.lit(0.0), F.lit(1.0)), t="") == pytest.approx(-1.2)
    normed = one(spark, logits.layer_norm("t"), t=x)
    assert sum(normed) == pytest.approx(0, abs=1e-9)
    assert one(spark, logits.rms_norm("t"), t=[3.0, 4.0])[0] == pytest.approx(3 / 12.5**0.5, rel=1e-5)


def test_sizes(spark):
    parts = {r.name: r for r in sizing.parameter_breakdown(sizing.configs(spark)).collect()}
    assert all(90e6 < parts["100m"].total < 1.1e8 for _ in (0,)) and parts["300m"].total > parts["100m"].total
    lr = [r.x for r in spark.range(3).select(sizing.warmup_cosine(F.element_at(F.array(F.lit(0), F.lit(10), F.lit(100)), (F.col("id") + 1).cast("int")), 10, 100, 1.0).alias("x")).collect()]
    assert lr == [pytest.approx(0), pytest.approx(1), pytest.approx(0, abs=1e-6)]
    assert one(spark, sizing.ema("t", 0.5), t=[1.0, 3.0]) == pytest.approx(2.0)
    assert one(spark, sizing.derived_max_steps(F.lit(1000), F.lit(4), F.lit(10)), t="") == 25
    assert suites.suite(spark, "nothing").count() == 0 and suites.suite(spark).count() == 16 and suites.suite_names()[-1] == "all"


def test_bytes(spark):
    assert one(spark, shards.byte_tokens("t"), t="aé") == list("aé".encode())
    assert one(spark, shards.byte_tokens("t"), t="") == []
    assert one(spark, shards.pick_dtype(F.lit(65536)), t="") == "uint32"
