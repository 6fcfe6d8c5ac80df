"""Each operator against brute force, an exact round trip or plain cases on small fixtures."""

import itertools
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import confusables, gru, langid, mixing, near_dup, packing, pair_defects, readability, text_quality, token_budget
from lexloom.tokenizer.codec import Codec

MERGES = ((97, 98), (268, 99))
CODEC = Codec(MERGES)


# --- 1 near duplicates ---------------------------------------------------------------------------------------------


def shingles(text, n):
    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def dialogues():
    rng = random.Random(7)
    vocab = [f"слово{i}" for i in range(400)]
    rows = []
    for g in range(60):
        base = [rng.choice(vocab) for _ in range(rng.choice([12, 60, 200]))]
        rows += [edited(rng, base, k) for k in (0, 1, 3, len(base) // 8, len(base) // 2)]
    rows += [rows[0], rows[0].upper() + "!", "a b", "a b", "", " ... ", None]
    return list(enumerate(rows, 1))


@pytest.mark.parametrize(("words", "similarity"), [(3, 0.6), (5, 0.8)])
def test_near_duplicates(spark, dialogues, words, similarity):
    df = spark.createDataFrame([*dialogues, dialogues[3], (None, "x y z")], "id long, text string").withColumn("class_id", F.lit("clash"))
    found = near_dup.near_duplicates(df, "id", "text", near_dup.Params(words=words, similarity=similarity))
    got = Counter((r.id_a, r.id_b) for r in found.pairs().collect())
    sets = {i: shingles(t, words) for i, t in dialogues if t is not None}
    same = {i: re.findall(r"[^\W_]+", t.lower()) for i, t in dialogues if t is not None}
    want = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        union = sets[a] | sets[b]
        if same[a] == same[b] or union and len(sets[a] & sets[b]) >= similarity * len(union):
            want.add((a, b))
    assert set(got.values()) <= {1}
    assert set(got) <= want  # nothing wrong
    assert len(want - set(got)) <= 0.02 * len(want)  # banding may miss a pair near the threshold
    groups = {r.id: r for r in found.groups().collect()}
    assert len(groups) == len(dialogues) and groups[len(dialogues)].class_id is None
    for a, b in got:
        assert groups[a].group_id == groups[b].group_id


def test_near_duplicates_star_blocks_and_empty(spark):
    rows = [(i, "one two three four five six") for i in range(1, 30)] + [(i, f"ONE two three four, five six{'!' * i}") for i in range(30, 45)] + [(100 + i, f"one two three four five six {i}") for i in range(20)]
    df = spark.createDataFrame(rows, "id long, text string")
    p = near_dup.Params(words=2, similarity=0.6, star=20, block=3, broadcast_keys=1)
    found = near_dup.near_duplicates(df, "id", "text", p)
    got = {(r.id_a, r.id_b) for r in found.pairs().collect()}
    assert {(1, i) for i in range(2, 30)} <= got and (2, 3) not in got  # byte-identical texts are a star
    assert {(r.id, r.stands_for) for r in found.copies().collect()} == {(i, 1) for i in range(2, 30)}
    assert {(a, b) for a, b in itertools.combinations([1, *range(30, 45)], 2)} <= got  # different texts of one class are all paired
    assert {(a, b) for a, b in itertools.combinations(range(100, 120), 2)} <= got  # small blocks lose nothing
    assert {(i, j) for i in (1, *range(30, 45)) for j in range(100, 120)} <= got
    empty = near_dup.near_duplicates(df.limit(0), "id", "text", p)
    assert empty.pairs().count() == 0 and empty.groups().count() == 0


def test_near_duplicates_of_ids_with_several_texts(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue white black brown")
    rows = [(1, a), (1, b), (2, b + " eight"), (3, a + " eta"), (4, c), (4, c + " grey")]
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "id long, text string"), "id", "text", near_dup.Params(words=2, similarity=0.6))
    assert sorted((r.id_a, r.id_b) for r in found.pairs().collect()) == [(1, 2), (1, 3)]  # no link lost, doubled or with itself
    assert {r.id: r.group_id for r in found.groups().collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    p = near_dup.Params()
    pool = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    a, b = np.sort(pool[:800]), np.sort(pool[200:])
    s = near_dup.signatures([a, b, a[:3]], p)
    size = np.array([800.0])
    assert abs(near_dup.estimate(s[:1], s[1:2], size, size, p)[0] - 0.6) < 0.12
    assert near_dup.estimate_floor(size, size, p)[0] < 0.8 and s.shape == (3, p.layers * p.buckets)
    assert list(near_dup._leading_zeros(np.array([1, 1 << 63, 1 << 32, 255], np.uint64))) == [63, 0, 31, 56]


def test_collisions_of_unrelated_registers():
    """Unrelated registers of few mantissa bits often agree; the correction takes that out."""
    rng = np.random.default_rng(3)
    p = near_dup.Params(mantissa=2)
    for n, m in ((400, 400), (2000, 300)):
        sets = [rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (n, m) * 60]
        s = near_dup.signatures(sets, p)
        na, nb = np.full(60, float(n)), np.full(60, float(m))
        agree = (s[::2] == s[1::2]).mean()
        assert agree > 0.01 and near_dup.collision_rate(na, nb, p)[0] == pytest.approx(agree, rel=0.15)
        assert abs(((s[::2] == s[1::2]).mean(1) - near_dup.collision_rate(na, nb, p)).mean()) < 0.02


# --- 2 token budget ------------------------------------------------------------------------------------------------


def test_token_budget(spark):
    rows = [(1, 0, "s", "ru", "t", "abc ab"), (1, 0, "s", "ru", "t", "abc ab"), (2, 0, "s", None, "t", "abc ab"), (3, 0, "s", "", "t", None), (4, 0, None, "en", None, "x\t\ty"), (None, 0, "s", "ru", "t", "q"), (5, 0, "s", "ru", "t", "abc ab")]
    df = spark.createDataFrame(rows, "dialogue_id long, shard int, source string, lang string, topic string, text string").withColumn("tokens", F.lit("clash")).withColumn("_t", F.lit(0))
    n = len(CODEC.encode("abc ab"))
    budget = [(0, "s", "ru", "t", 2 * n + 1), (0, "s", "none", "t", n + 1), (0, None, "en", None, 4), (0, "gone", "ru", "t", 7), (0, "gone", "ru", None, None), (0, "s", "ru", "t", 2 * n + 1)]
    recorded = spark.createDataFrame(budget, "shard int, source string, lang string, topic string, tokens long")
    out = {(r.source, r.lang, r.topic): (r.true_tokens, r.wrong) for r in token_budget.budget_check(df, recorded, MERGES).collect()}
    assert out == {("s", "ru", "t"): (2 * n + 1, False), ("s", "none", "t"): (n, True), (None, "en", None): (4, False), ("gone", "ru", "t"): (0, True), ("gone", "ru", None): (0, False)}
    total = {r.lang: (r.documents, r.distinct_texts, r.tokens) for r in token_budget.slice_tokens(df, MERGES, {"lang": token_budget.recorded_lang(F.col("lang"))}).collect()}
    assert total == {"ru": (3, 2, 2 * n + 1), "none": (2, 1, n), "en": (1, 1, 4)}
    assert token_budget.slice_tokens(df.limit(0), MERGES, {"lang": F.col("lang")}).count() == 0


# --- 3 languages ---------------------------------------------------------------------------------------------------


def test_labels_without_states():
    """Labels as those of the states that training keeps, in any order of the sequences, read without keeping the states."""
    rng = np.random.default_rng(5)
    net = gru.ByteGRU(6, seed=4)
    for sizes in ([3, 5, 5, 40], [40, 3, 5, 5], [7], [1, 1]):
        x = rng.integers(0, 256, (max(sizes), len(sizes)))
        live = np.arange(max(sizes))[:, None] < np.array(sizes)
        states = net._states(x, live)
        want = np.einsum("hl,thb->tlb", net.p["V"], states) + net.p["c"][:, None]
        want -= np.log(np.exp(want).sum(1, keepdims=True))
        got = net.log_probs(x, live)
        assert np.abs((got - want).transpose(0, 2, 1)).max() < 1e-5 and got.dtype == np.float32
    x = rng.integers(0, 256, (256, 500))
    tracemalloc.start()
    net.log_probs(x, np.ones(x.shape, bool))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < x.size * 2 * net.hidden * 4


def test_gradients():
    net = gru.ByteGRU(3, hidden=4, seed=1)
    rng = np.random.default_rng(2)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    x = rng.integers(0, 256, (6, 3))
    live = np.arange(6)[:, None] < np.array([3, 5, 6])
    weight = live * rng.random((6, 3))
    y = rng.dirichlet(np.ones(3), 3).T
    _, g = net.gradients(x, live, weight, y)
    for k in net.p:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        keep = net.p[k][at]
        ends = []
        for e in (1e-6, -1e-6):
            net.p[k][at] = keep + e
            ends.append(net.gradients(x, live, weight, y)[0])
        net.p[k][at] = keep
        assert (ends[0] - ends[1]) / 2e-6 == pytest.approx(g[k][at], rel=1e-3, abs=1e-8)


def test_padding_changes_nothing():
    net = gru.ByteGRU(3, hidden=4, seed=1)
    x = np.random.default_rng(4).integers(0, 256, (9, 2))
    live = np.arange(9)[:, None] < np.array([4, 9])
    alone = net.log_probs(x[:4, :1], live[:4, :1])
    assert np.allclose(net.log_probs(np.where(live, x, 0), live)[:4, :, :1], alone, atol=1e-5)


def test_windows_cover_every_position_once():
    sizes = np.array([1, langid.WINDOW, langid.WINDOW + 1, 5000])
    starts = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    seen = np.zeros(starts[-1] + sizes[-1], int)
    for unit, first, length, low, high in zip(*langid.windows(starts, sizes)):
        assert length <= langid.WINDOW and starts[unit] <= first <= low < high <= first + length <= starts[unit] + sizes[unit]
        seen[low:high] += 1
    assert seen.sum() == sizes.sum() and seen.max() == 1
    parts = [b"ab", b"c", b"d" * 700]
    total = np.zeros(2)
    for unit, x, live, weight in langid.batches(parts, [2, 1], 500):
        np.add.at(total, unit, weight.sum(0))
        assert x.shape == live.shape == weight.shape
    assert total == pytest.approx([2, 1])  # every word counts 1


SENTENCES = {
    "ru": ["Мой брат читает новую книгу дома.", "Сегодня мы идём в городской парк.", "Соседка покупает свежий хлеб утром."],
    "en": ["My brother reads a new book at home.", "Today we walk to the city park.", "The neighbor buys fresh bread in the morning."],
    "uk": ["Мій брат читає нову книгу вдома.", "Сьогодні ми йдемо до міського парку.", "Сусідка купує свіжий хліб уранці."],
    "de": ["Mein Bruder liest zu Hause ein neues Buch.", "Heute gehen wir in den Park der Stadt.", "Die Nachbarin kauft am Morgen frisches Brot."],
    "fr": ["Mon frère lit un nouveau livre à la maison.", "Aujourd'hui nous allons au parc de la ville.", "La voisine achète du pain frais le matin."],
    "es": ["Mi hermano lee un libro nuevo en casa.", "Hoy vamos al parque de la ciudad.", "La vecina compra pan fresco por la mañana."],
}


@pytest.fixture(scope="module")
def net():
    rows = [(lang, " ".join(s)) for lang, s in SENTENCES.items()] * 3 + [("en", SENTENCES["ru"][0])]  # one wrong label
    return langid.fit_rows(rows, 500)


def test_labels(net):
    for lang, s in SENTENCES.items():
        assert langid.label_texts([" ".join(s)], net, False)[0][0] == lang
    roman = SENTENCES["ru"][0].lower().translate(str.maketrans(langid.ROMAN))
    assert langid.label_texts([roman], net, False)[0][0] == "ru"
    mixed = f"{SENTENCES['ru'][0]} {SENTENCES['ru'][1]} {SENTENCES['de'][0]}\n{SENTENCES['de'][1]} {SENTENCES['ru'][2]}"
    lang, _, segments = langid.label_texts([mixed], net, False)[0]
    assert lang == "mixed" and [s["lang"] for s in segments] == ["ru", "de", "ru"] and [s["seg_no"] for s in segments] == [1, 2, 3]
    word = "Мой брат читает README и новую книгу дома. См. FAQ и новую книгу дома."
    assert langid.label_texts([word], net, False)[0][0] == "ru"
    assert langid.sentences("Да. Нет. См. ниже. Gracias.") == ["Да.", "Нет.", "См. ниже.", "Gracias."]
    talk = f"USER: {SENTENCES['ru'][0]}\n\nAssistant: {SENTENCES['en'][1]}"
    assert langid.label_texts([talk], net, True)[0][0] == "mixed"
    assert langid.label_texts([None, "", " ", "123 ..."], net, False) == [(None, None, [])] * 4
    assert langid.label_texts([" ".join(SENTENCES["fr"]) * 2000], net, False)[0][0] == "fr"


def test_a_sentence_of_one_word_can_stand_out():
    scores = np.full((3, len(langid.LANGS)), -9.0)
    scores[:, 0] = -0.1
    for lead, lang in ((3.0, "ru"), (6.0, "mixed")):
        scores[1, 0], scores[1, 5] = -0.1 - lead, -0.1
        found = langid.decide(scores, np.array([5, 1, 4]))
        assert found[0] == lang and [s[0] for s in found[2]] == (["ru"] if lang == "ru" else ["ru", "es", "ru"])


def test_label_frame(spark, net):
    df = spark.createDataFrame([(1, "en", SENTENCES["ru"][0]), (1, "en", SENTENCES["ru"][0]), (2, None, None), (3, "ru", "junk junk"), (None, "ru", "x")], "rec long, lang string, text string").withColumn("confidence", F.lit("clash"))
    out = langid.label_languages(df, net, "rec", skip=F.col("rec") == 3, carry=F.col("lang")).collect()
    assert sorted((r.id, r.carried, r.lang) for r in out if r.lang) == [(1, "en", "ru")] * 2 and len(out) == 4
    assert langid.label_languages(df.limit(0), net, "rec").count() == 0
    codes = spark.createDataFrame([("ru-RU",), (" RUS ",), ("english",), ("mul",), ("und",), ("",), (None,), ("??",), ("es-419",)], "l string")
    assert [r.x for r in codes.select(langid.recorded(F.col("l")).alias("x")).collect()] == ["ru", "ru", "en", "mixed", None, None, None, None, "es"]
    assert langid.training_sample([(df, "rec", "text", "lang")], 1) == [("en", SENTENCES["ru"][0]), ("ru", "junk junk")]


# --- 4 look-alikes -------------------------------------------------------------------------------------------------

SAME = [
    ("Model BPE7", "Мodel ВРЕ7"),
    ("ａｂ １２．", "ab 12."),
    ("a b c", "a b c"),
    ("soft­hy​phen", "softhyphen"),
    ("café", "café"),
    ("ﬁne ﬂow", "fine flow"),
    ("Снοва гοсть", "Снова гость"),
    ("end.  \n", "end."),
    ("line\r\nline", "line\nline"),
    ("naïve", "nаїve"),
]
OTHER = [("ё", "е"), ("A", "a"), ("2", "²"), ("a.", "a!"), ("й", "и"), ("1", "2"), ("a, b", "a b"), ("résumé", "resume"), ("a\nb", "a b"), ("…", "...")]


def test_canonical():
    n = confusables.Normalizer()
    for a, b in SAME:
        assert n(a) == n(b), (a, b)
    for a, b in OTHER:
        assert n(a) != n(b), (a, b)
    assert n("Мοдель из Τуры") == "Модель из Туры"
    assert n("mаrkеt prісe") == "market price"
    for t in [a for pair in SAME + OTHER for a in pair]:
        assert n(n(t)) == n(t)


def test_same_look_pairs(spark):
    rows = [(1, "Model A"), (2, "Мodel А"), (3, "Model A"), (4, "Model a"), (5, None), (6, " "), (7, "​"), (8, "x" * 200_000), (9, "х" * 200_000), (2, "Мodel А"), (None, "Model А")]
    df = spark.createDataFrame(rows, "raw_id long, text string").withColumn("look1", F.lit("clash"))
    got = sorted((r.id_a, r.id_b) for r in confusables.same_look_pairs(confusables.look_classes(df, "raw_id", "text")).collect())
    assert got == [(1, 2), (2, 3), (8, 9)]
    assert confusables.same_look_pairs(confusables.look_classes(df.limit(0), "raw_id", "text")).count() == 0


# --- 5 pairs -------------------------------------------------------------------------------------------------------


def test_pair_defects(spark):
    good = [(100 + i, f"Почему сосед чинит крышу номер {i}?", f"Потому что сосед любит порядок в доме {w}.") for i, w in enumerate("летом зимой осенью весной утром вечером днём ночью".split() * 3)]
    prompt = "Расскажи, зачем дедушка чинит старую лодку у реки весной."
    rows = [
        (1, prompt, None), (2, prompt, " "), (3, prompt, "<EOS>"), (4, prompt, "N/A"), (5, prompt, "ASSISTANT:"),
        (6, prompt, prompt), (7, prompt, "РАССКАЖИ ЗАЧЕМ ДЕДУШКА ЧИНИТ СТАРУЮ ЛОДКУ У РЕКИ ВЕСНОЙ"), (8, prompt, f"Вы спросили: {prompt}"),
        (9, prompt, "Извините, я не могу ответить на этот вопрос."), (10, "Why is it so?", "Sorry, I can't help with that."), (11, prompt, "Не могу не отметить, что сосед любит порядок в доме летом."),
        (12, prompt, "The neighbor likes the order in the house in the summer."), (13, "Переведи на английский: «Сосед спит.»", "The neighbor sleeps in the house."),
        (14, prompt, "Потому что сосед любит порядок в доме, а который"), (15, prompt, "Потому что сосед любит порядок в доме и,"), (16, prompt, "Потому что сосед любит порядок в («доме"),
        (17, prompt, "Да"), (18, prompt, "Потому что сосед любит порядок в доме летом"), (19, None, ""), (20, " ", "<EOS>"), (21, prompt, "Дедушка чинит старую лодку у реки весной, потому что сосед любит порядок в доме летом."),
        (22, prompt, "Да. " * 200), (23, "Why does my friend sing in the garden?", "Weil der Nachbar am Morgen in dem Haus singt und die Arbeit nicht mag."), (6, prompt, prompt), (None, prompt, ""),
    ]
    df = spark.createDataFrame(rows + good, "sample_id long, prompt string, reply string").withColumn("defect", F.lit("clash"))
    out = [(r.id, r.defect) for r in pair_defects.pair_defects(df).collect()]
    got = dict(out)
    assert len(out) == len(got)
    want = {**dict.fromkeys(range(1, 6), "empty"), **dict.fromkeys((6, 7, 8), "copy"), 9: "refusal", 10: "refusal", 12: "other_language", 23: "other_language", **dict.fromkeys((14, 15, 16), "truncated")}
    assert {i: d for i, d in got.items() if d} == want
    assert pair_defects.pair_defects(df.limit(0)).count() == 0


# --- 6 quality -----------------------------------------------------------------------------------------------------

KINDS = [
    ("prose", "The house stands by the river, and in the morning the light falls on the old bridge. People cross it on their way to work."),
    ("prose", "В доме у реки живёт старый мастер. Утром он выходит во двор и чинит лодку, пока соседи спят."),
    ("prose", "V dome u reki zhivyot staryy master. Utrom on vykhodit vo dvor i chinit lodku, poka sosedi spyat."),
    ("prose", "— Ты придёшь сегодня к нам на ужин?\n— Да, я приду после работы, если не будет дождя.\n— Хорошо, мы будем тебя ждать."),
    ("prose", "THE HOUSE STANDS BY THE RIVER, AND IN THE MORNING THE LIGHT FALLS ON THE OLD BRIDGE."),
    ("prose", "We talked about the plan for the summer and agreed on most of it. We need:\n- bread\n- milk\nAfter that we went to the market and bought what was on the list."),
    ("list", "- bread\n- milk\n- two eggs\n* salt"),
    ("list", "1. первый пункт\n2. второй пункт\n3. третий пункт"),
    ("list", "– хлеб\n– молоко\n– соль"),
    ("list", "Главная / Корзина / Вход / Оплата / Помощь"),
    ("list", "Soup — 120\nBread — 15\nTea — 30"),
    ("list", "1) хлеб 2) молоко 3) соль 4) два яйца"),
    ("table", "Item\tPrice\nbread\t1.20\nmilk\t0.99"),
    ("table", "| a | b |\n|---|---|\n| x | 1 |\n| y | 2 |"),
    ("table", "Цена: 12.50\nВес: 300\nГород: Тула"),
    ("table", "bread  1.20  30\nmilk  0.99  12\nsalt  0.10  -"),
    ("junk", "$%^&*()_+{}[]<>?/|$%^&*()_+"),
    ("junk", "<br><br id='1'/><td><td id='2'/><div>"),
    ("junk", "go go go go go go go go"),
    ("junk", "Ð¡Ð»ÑƒÐ¶Ð±Ð° Ð¿Ð¾Ð´Ð´ÐµÑ€Ð¶ÐºÐ¸ Ð¿ÐµÑ€ÐµÐ½Ð¾"),
    ("junk", "CF B1 E9 D1 03 90 B8 03 6D 64 D6"),
    ("junk", "фхэйнззднд гыежгэщрнй вцыщюшй кзвиххимьб пфитмсжабмсязк"),
    ("junk", "#dog #leaf #pass #tea #cup"),
    ("junk", "x" * 300),
    (None, ""), (None, None), (None, " \n\t"),
]


def test_kinds(spark):
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(KINDS)], "raw_id long, text string").withColumn("n_words", F.lit("clash"))
    got = {r.raw_id: r for r in text_quality.text_stats(df).select("raw_id", "n_words", "quality").collect()}
    for i, (kind, text) in enumerate(KINDS):
        assert got[i].quality.kind == kind == text_quality.kind_of(got[i].quality.reasons), (text, got[i].quality)
        assert got[i].quality.n_words == len((text or "").split()) and got[i].n_words == "clash"
    assert got[len(KINDS) - 1].quality.reasons == ["empty"] and "markup" in got[17].quality.reasons
    long = spark.createDataFrame([(1, KINDS[0][1] * 3000)], "raw_id long, text string")
    assert text_quality.text_stats(long).first().quality.kind in ("prose", "junk")
    assert text_quality.text_stats(df.limit(0)).count() == 0


def test_wide_tables(spark):
    rows = [[100 + 90 * i + j for j in range(70)] for i in range(5)]
    wide = ["\n".join("| " + " | ".join(map(str, r[:31])) + " |" for r in rows), *["\n".join(by.join(map(str, r)) for r in rows) for by in ("\t", "  ", "; ", ", ")]]
    wide.append("Plain words of a long paragraph, " * 12 + "\n" + "\n".join(",".join(map(str, r[:3])) for r in rows))  # a paragraph before a table
    df = spark.createDataFrame(list(enumerate(wide)), "raw_id long, text string")
    got = {r.raw_id: r.quality for r in text_quality.text_stats(df).collect()}
    assert [(got[i].table_lines, got[i].kind) for i in range(len(wide))] == [(5, "table")] * len(wide)


def test_noise_and_hex_shares_of_every_text(spark):
    half = "the cat sat on the mat and it was good" + " bcdfgh бвгджз" * 5
    dump = "0000000000001a40 CF B1 E9 D1 03 90 B8 03 |abcdefgh|"
    rows = spark.createDataFrame([(1, half), (2, dump)], "raw_id long, text string")
    got = {r.raw_id: r.quality for r in text_quality.text_stats(rows).collect()}
    assert got[1].common_share >= 0.1 and got[1].noise_share > 0.25 and "unpronounceable" in got[1].reasons
    assert got[2].mean_word_length > 4 and got[2].hex_share == pytest.approx(0.8) and "hex_dump" in got[2].reasons and got[2].kind == "junk"


# --- 7 packing -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("open_bins", [1, 4, 1000])
def test_best_fit(open_bins):
    rng = random.Random(5)
    b = packing.BestFit(100, open_bins)
    sizes = [rng.choice([0, 1, 5, 30, 60, 99, 100]) for _ in range(800)]
    bins = {}
    for i, s in enumerate(sizes):
        for number, items in b.add(s, i):
            assert number not in bins
            bins[number] = items
        assert b.n_open <= open_bins
    for number, items in b.finish():
        assert number not in bins
        bins[number] = items
    placed = [item for items in bins.values() for _, item in items]
    assert sorted(placed) == list(range(800)) and all(sum(s for s, _ in items) <= 100 for items in bins.values())
    assert len(bins) <= sum(sizes) / 100 * {1: 1.6, 4: 1.2, 1000: 1.12}[open_bins] + 1


def test_fullest_closes_first():
    b = packing.BestFit(100, 2)
    closed = [(item, number) for item, size in enumerate([60, 70, 55, 35, 30, 45]) for number, _ in b.add(size, item)]
    # 55 opens a third bin: the one with 30 free closes, not that with 40. 35 then leaves 5 in the first, 30 joins 55, and 45 opens the fourth.
    assert closed == [(2, 1), (5, 0)]
    assert [(n, [i for _, i in items]) for n, items in b.finish()] == [(2, [2, 4]), (3, [5])]


def test_bound_binds_on_documents(data):
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{data}/documents.parquet", columns=["text"]).column(0).to_pylist()
    b = packing.BestFit(2048, 8)
    sizes = [min(len((x or "").split()) * 2, 2048) for x in texts]
    early = sum(1 for i, s in enumerate(sizes) for _ in b.add(s, i))
    assert early > b.n_open and 1 - sum(sizes) / ((early + len(list(b.finish()))) * 2048) < 0.12


def test_containers(spark):
    rng = random.Random(6)
    docs = [(i, "x" * rng.choice([0, 3, 40, 150, 1000])) for i in range(200)] + [(500, None), (501, "x" * 5), (501, "x" * 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("tokens", F.lit("clash")).repartition(3)
    specs = spark.createDataFrame([(1, 128), (2, 300), (2, 400), (3, None), (None, 5), (4, 0)], "spec_id int, capacity int")
    rows = packing.containers(df, specs, MERGES, open_bins=8).collect()
    pieces = defaultdict(list)
    room = Counter()
    for r in rows:
        pieces[r.spec_id, r.doc_id].append((r.piece, r.tokens))
        room[r.spec_id, r.container] += r.tokens
    caps = {1: 128, 2: 300}
    assert {s for s, _ in pieces} == {1, 2} and all(n <= caps[s] for (s, _), n in room.items())
    for spec, cap in caps.items():
        for i, t in docs[:201]:
            n = len(t or "")
            got = sorted(pieces[spec, i])
            assert [p for p, _ in got] == list(range(max(1, -(-n // cap)))) and sum(x for _, x in got) == n
            assert all(x == cap for _, x in got[:-1])
        assert len(pieces[spec, 501]) == 2
    report = {r.spec_id: r.unused_share for r in packing.fill_report(packing.containers(df, specs, MERGES), specs).collect()}
    assert max(report.values()) < 0.1
    assert packing.containers(df.limit(0), specs, MERGES).count() == 0 and packing.containers(df, specs.limit(0), MERGES).count() == 0


# --- 8 mixing ------------------------------------------------------------------------------------------------------


def test_mixing(spark):
    rng = random.Random(8)
    docs = [(i, rng.choice([" A", "a", "B "]), "x" * rng.randrange(1, 60)) for i in range(2000)] + [(5000 + i, "c", "x" * 10) for i in range(10)] + [(9000, None, "x" * 100), (9001, "a", None)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("copies", F.lit("clash"))
    targets = spark.createDataFrame([(1, "A", 0.2, 2), (1, "b", 0.3, 3), (1, "C", 0.5, 4), (1, "gone", 0.1, 9), (2, "a", 0.9, 1), (None, "a", 0.5, 1)], "mix_id int, source string, target_share double, max_repeats int")
    m = mixing.mix(df, targets, MERGES)
    rows = {(r.mix_id, r.source): r for r in m.report().collect()}
    total = sum(len(t or "") for _, _, t in docs)
    own = Counter()
    for _, s, t in docs:
        own[(s or "").strip().lower()] += len(t or "")
    assert {k for k, r in rows.items() if r.short} == {(1, "c"), (1, "gone"), (2, "a")} == {(k, s) for k, s, share, cap in [(1, "a", 0.2, 2), (1, "b", 0.3, 3), (1, "c", 0.5, 4), (1, "gone", 0.1, 9), (2, "a", 0.9, 1)] if share * total > cap * own[s]}
    for key in ((1, "a"), (1, "b")):
        assert rows[key].actual_tokens == pytest.approx(rows[key].target_tokens, rel=0.02)
    assert rows[1, "c"].actual_tokens == 400 and rows[2, "a"].actual_tokens == own["a"]
    assert sum(r.actual_share for k, r in rows.items() if k[0] == 1) == pytest.approx(1)
    caps = {(1, "a"): 2, (1, "b"): 3, (1, "c"): 4, (2, "a"): 1}
    assert all(1 <= r.copies <= caps[r.mix_id, r.source] for r in m.chosen.collect())
    again = {tuple(r) for r in mixing.mix(df.repartition(5), targets, MERGES).chosen.collect()}
    assert again == {tuple(r) for r in m.chosen.collect()}
    none = mixing.mix(df.limit(0), targets, MERGES)
    assert none.chosen.count() == 0 and none.report().agg(F.sum("actual_tokens")).first()[0] == 0
    assert mixing.mix(df, targets.limit(0), MERGES).report().count() == 0


# --- 9 reading levels ----------------------------------------------------------------------------------------------


def test_syllables():
    for word, n in {"кот": 1, "молоко": 3, "house": 1, "table": 2, "reading": 2, "walked": 1, "wanted": 2, "idea": 3, "nation": 2, "maison": 2, "zum": 1, "ш": 1}.items():
        assert readability.syllables(word) == n, word


EASY = "The cat sat on the mat and the dog ran to the red barn. " * 5
MEDIUM = "The city library checks the plan for the spring season with the members of the reading club. A careful editor corrects the weekly report. " * 4
HARD = "Epistemological considerations necessitate methodological reconsideration of institutionalised interdisciplinary conceptualisation. " * 6


def test_levels(spark):
    docs = [(1, EASY), (2, MEDIUM), (3, HARD), (4, "too short"), (5, None), (6, "x = [i ** 2 for i in y]; " * 20), (7, "f(7) = 12/5 + 3 * 8\n" * 30), (8, EASY + HARD[:120]), (9, EASY.replace(". ", ", and ") + "."), (2, MEDIUM), (10, "USER: " + EASY), (11, HARD * 300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("grade", F.lit("clash"))
    labels = spark.createDataFrame([(1, "a", "easy"), (None, "a", "hard"), (2, "a", None)], "doc_id long, rater string, reading_level string")
    got = sorted((r.doc_id, r.reading_level) for r in readability.reading_levels(df, labels).collect())
    assert got == [(1, "easy"), (2, "medium"), (2, "medium"), (3, "hard"), (8, "easy"), (9, "easy"), (10, "easy"), (11, "hard")]
    assert readability.reading_levels(df.limit(0), labels.limit(0)).count() == 0


def test_cuts(spark):
    rng = random.Random(9)
    grades, levels = [], []
    for level, middle in enumerate((2, 10, 20)):
        for _ in range(20):
            grades.append(rng.gauss(middle, 1))
            levels.append(level)
    levels[0], levels[59] = 2, 0  # two mistakes
    low, high = readability.best_cuts(grades, levels)
    assert 4 < low < 8 and 12 < high < 18
    assert readability.best_cuts([1.0] * 20, [0] * 20) is None
    graded = spark.createDataFrame([(i, 50, True, True, float(i), 2.0) for i in range(60)], "doc_id long, n_words int, is_prose boolean, is_cyrillic boolean, grade double, syllables_per_word double")
    votes = [(i, r, ("easy", "medium", "hard")[i // 20]) for i in range(60) for r in "ab"] + [(0, "c", "hard"), (1, "c", "hard"), (1, "d", "hard"), (59, "a", "HARD")]
    cuts = readability.fit_cuts(graded, spark.createDataFrame(votes, "doc_id long, rater string, reading_level string"))
    assert cuts[True] == (19.5, 39.5) and cuts[False] == readability.DEFAULT_CUTS[False]
