import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.session import read_table
from lexloom.sources import sinks
from lexloom.tokenizer import chat
from lexloom.tokenizer.sql import register
from lexloom.tokenizer.codec import Codec, decode, encode, token_count
from lexloom.tokenizer.vocab import BOS, EOS, PAD, SPECIAL_TO_ID, read_merges, token_name, vocab_document

MERGES = ((104, 101), (108, 108), (268, 269), (270, 111), (208, 191))


def plain(merges, ids):
    """The definition: the pair of lowest rank, leftmost first."""
    rank = {p: i for i, p in enumerate(merges)}
    ids = list(ids)
    while True:
        found = [(rank[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]
        if not found:
            return ids
        r, i = min(found)
        ids[i : i + 2] = [268 + r]


def test_specials():
    assert (PAD, BOS, EOS) == (256, 257, 258) and SPECIAL_TO_ID["<END_CODE>"] == 267
    assert token_name(65, MERGES) == "<0x41>" and token_name(268, MERGES) == "he" and token_name(9999, MERGES) == "<UNK>" and token_name(258, MERGES) == "<EOS>"


@given(st.text(max_size=80))
@settings(max_examples=150, deadline=None)
def test_round_trip_and_count(text):
    c = Codec(MERGES)
    ids = c.encode(text)
    assert c.decode(ids) == text.encode("utf-8", "replace").decode()
    assert c.count(text) == len(ids)


def test_long_runs_are_not_kept():
    c = Codec(MERGES)
    blob = "hello" * 5000
    assert c.count(f"hello {blob} he") == len(c.encode(f"hello {blob} he")) == 5003 + 1
    assert max(map(len, c.words)) <= 256 and max(map(len, c.saved)) <= 256


@given(st.lists(st.sampled_from([104, 101, 108, 111]), max_size=400))
@settings(max_examples=60, deadline=None)
def test_merging_follows_the_definition(ids):
    c = Codec(MERGES)
    assert c._merge(list(ids)) == plain(MERGES, ids) == c._merge_long(list(ids))


def test_columns(spark, data):
    merges = read_merges(read_table(spark, data, "merges"))
    rows = read_table(spark, data, "documents").select("text").limit(50).unionByName(spark.createDataFrame([(None,), ("",), ("  \n",)], "text string"))
    out = rows.select("text", encode("text", merges).alias("ids"), token_count("text", merges).alias("n")).withColumn("back", decode("ids", merges)).collect()
    for r in out:
        assert (r.text is None) == (r.ids is None) == (r.n is None)
        if r.text is not None:
            assert r.back == r.text and r.n == len(r.ids)
    assert vocab_document(merges)["vocab_size"] == 968


def test_chat(spark):
    rows = spark.createDataFrame([([("user", "hello"), ("assistant", "he"), ("nobody", "")],)], "m array<struct<role:string,content:string>>")
    e = rows.withColumn("e", chat.encode_messages("m", MERGES))
    r = e.select(chat.apply_template("m").alias("t"), chat.chat_ids("e").alias("p"), chat.chat_ids("e", False).alias("ids"), chat.chat_labels("e").alias("labels")).first()
    assert r.t == "<USER>hello<ASSISTANT>he<USER><ASSISTANT>"
    assert r.ids == [257, 260, 271, 261, 268, 258, 260] and r.p == [*r.ids, 261]
    assert r.labels == [-100, -100, -100, -100, 268, 258, -100] and len(r.labels) == len(r.ids)
    x = spark.createDataFrame([([1, 2, 3],)], "a array<int>")
    assert x.select(chat.pad("a", 5).alias("x")).first().x == [1, 2, 3, 256, 256]
    assert x.select(chat.pad("a", 5, left=True).alias("x")).first().x == [256, 256, 1, 2, 3]
    assert x.select(chat.pad("a", 2).alias("x")).first().x == [1, 2]
    assert x.select(chat.with_marks("a").alias("x")).first().x == [257, 1, 2, 3, 258]
    two = spark.createDataFrame([(0, [1], [1]), (0, [1, 2], [1, 2]), (1, [3], [3])], "batch int, input_ids array<int>, labels array<int>")
    got = sorted((r.batch, r.input_ids, r.labels) for r in chat.collate(two).collect())
    assert got == [(0, [1, 2], [1, 2]), (0, [1, 256], [1, -100]), (1, [3], [3])]


def test_sql(spark):
    assert len(register(spark, MERGES)) == 5
    r = spark.sql("SELECT lex_encode('hello') a, lex_decode(array(271, 999)) b, lex_token_count('hello he') c, lex_encode_marked('he<EOS>') d, lex_token_name(268) e, lex_encode(NULL) f").first()
    assert tuple(r) == ([271], "hello<UNK>", 3, [257, 268, 258, 258], "he", None)


def test_files(spark, tmp_path):
    sinks.write_tokenizer(spark, str(tmp_path), MERGES)
    assert sinks.read_tokenizer(spark, str(tmp_path)) == MERGES
    assert json.loads((tmp_path / "vocab.json").read_text())["num_merges"] == 5


def test_merge_limit(spark):
    rows = spark.createDataFrame([(1, 3, 4), (0, 1, 2)], "merge_rank int, left_id int, right_id int")
    assert read_merges(rows) == ((1, 2), (3, 4))
    with pytest.raises(Exception, match="merge_rank"):
        read_merges(rows.select(F.lit(1).alias("x")))
