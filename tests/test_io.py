import json
import time

import pytest
from pyspark.sql import functions as F

from lexloom.sources import readers, sinks, synthetic
from lexloom.streaming import dialogues as stream

MERGES = ((97, 98),)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("one\ntwo\n\n \nthree\n", encoding="utf-8")
    (tmp_path / "sub" / "b.md").write_bytes("x\r\ny\xff\r\n\r\nz".encode("latin-1"))
    (tmp_path / "c.jsonl").write_text('{"text": "t1", "n": 1}\n\n"bare"\nnot json\n{"other": 1}\n{"text": null}\n[1]\n', encoding="utf-8")
    (tmp_path / "d.html").write_text("<p>tag</p>\n", encoding="utf-8")
    (tmp_path / "e.csv").write_text("ignored", encoding="utf-8")
    return str(tmp_path)


def test_readers(spark, folder):
    got = sorted(r.text for r in readers.read_texts(spark, folder).collect())
    assert got == sorted(["one\ntwo", "three", "x\ny�", "z", "t1", "bare", "<p>tag</p>"])
    assert sorted(r.text for r in readers.read_texts(spark, f"{folder}/c.jsonl").collect()) == ["bare", "t1"]
    whole = [r.text for r in readers.read_corpus(spark, folder).collect()]
    assert "one\ntwo\n\n \nthree\n" in whole and '{"other":1}' in whole


def test_rows_and_presets(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.createDataFrame([("T", "T is the title of a rather long text here"), ("U", "short"), ("V", "another text which is long enough to be kept")], "title string, text string").coalesce(1).write.parquet(path)
    assert readers.read_preset(spark, "encyclopedia_ru", path).count() == 2
    assert readers.read_preset(spark, "plain", path, 10).count() == 1
    assert readers.read_presets(spark, {"plain": path, "encyclopedia_en": path + "-missing"}, 100).count() == 2
    with pytest.raises(ValueError):
        readers.read_preset(spark, "nothing", path)
    h = "array<struct<history:array<string>>>"
    rows = spark.createDataFrame([([(["a"],), (["hi ", "yo"],)], None, None, ["z"]), (None, None, None, ["z"])], f"u {h}, d {h}, t {h}, h array<string>")
    out = [r.x for r in rows.select(readers.persona_dialogue(F.col("u"), F.col("d"), F.col("t"), F.col("h")).alias("x")).collect()]
    assert out == ["USER: hi\n\nASSISTANT: yo", "USER: z"]


def test_messages_and_meta(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"messages": [{"role": "user", "content": "a"}]}\n{"messages": []}\n')
    assert readers.read_messages(spark, str(tmp_path / "m.jsonl")).count() == 1
    for i in range(2):
        (tmp_path / f"s{i}.meta.json").write_text(json.dumps({"shard": i, "dialogues": 5, "turns": 10, "tokens": 100, "size_mb": 0.5}))
    (tmp_path / "bad.meta.json").write_text("{")
    r = readers.scan_shard_meta(spark, str(tmp_path)).first()
    assert (r.last_shard, r.dialogues, r.tokens) == (1, 10, 200)
    assert readers.load_config("a: 1  # c\nb: '2.5'\nzzz: 1\nf: true", {"a": int, "b": float, "f": bool}) == {"a": 1, "b": 2.5, "f": True}
    nested = readers.load_config("model:\n  size: '3e2'\n  other: 1\ntraining:\n  lr: 0.1\nseed: 7\n", {"model": {"size": int}, "training": {"lr": float}, "data": {"x": int}, "seed": int})
    assert nested == {"model": {"size": 300}, "training": {"lr": 0.1}, "data": {}, "seed": 7}
    assert readers.config_frame(spark, {"a": nested}).count() == 3


def test_shard_files(spark, tmp_path):
    df = spark.createDataFrame([(i, "ab " * i) for i in range(10)], "doc_id long, text string")
    shards = sinks.write_token_shards(df, str(tmp_path / "out"), MERGES, 269, tokens_per_shard=20)
    total = sum(2 * i + 1 for i in range(10))
    assert sum(len(r.tokens) for r in shards.collect()) == total
    assert json.loads((tmp_path / "out" / "shards_manifest.json").read_text())["total_tokens"] == total
    files = sinks.write_token_files(shards, str(tmp_path / "bin"), 269).collect()
    back = {r.file: r.tokens for r in readers.read_token_files(spark, str(tmp_path / "bin")).collect()}
    assert {f.file: f.tokens for f in files} == {k: len(v) for k, v in back.items()}
    assert [t for k in sorted(back) for t in back[k]] == [t for r in sorted(shards.collect(), key=lambda r: r.shard) for t in r.tokens]
    assert readers.file_hashes(spark, str(tmp_path / "bin")).count() == len(back)


def test_dialogue_shards_and_sft(spark, tmp_path):
    d = synthetic.dialogues(spark, 30, seed=3, partitions=3).withColumnRenamed("id", "dialogue_id").withColumn("tokens", F.lit(1))
    meta = sinks.write_dialogue_shards(d, str(tmp_path / "d"), dialogues_per_shard=12)
    assert sorted((r.shard, r.dialogues) for r in meta.collect()) == [(0, 12), (1, 12), (2, 6)]
    assert sinks.write_sft(d, str(tmp_path / "sft")) == 30 == readers.read_messages(spark, str(tmp_path / "sft")).count()


def test_synthetic(spark):
    a = [tuple(r) for r in synthetic.dialogues(spark, 300, seed=5, partitions=2).collect()]
    b = [tuple(r) for r in synthetic.dialogues(spark, 300, seed=5, partitions=7).collect()]
    assert sorted(a) == sorted(b)
    langs = [r[3] for r in a]
    assert langs.count("ru") > 200 and all(r[2] % 2 == 0 and len(r[7]) == r[2] for r in a)
    buckets = [r[6] for r in a]
    assert buckets.count("medium") > buckets.count("very_short")
    kinds = synthetic.seed_corpus(spark, 2000, seed=1)
    n = kinds.count()
    assert 2800 < n < 3200 and 0.3 < kinds.where("kind = 'prose'").count() / n < 0.5 and kinds.select("doc_id").distinct().count() == n


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    good = "USER: hello there\n\nASSISTANT: good day {}"
    rows = [(i, good.format(i % 4), 2, "en", ["s"] if i < 8 else None) for i in range(12)] + [(50, "broken", 1, "en", ["t"])]
    df = spark.createDataFrame(rows, "dialogue_id long, text string, turns int, lang string, signature array<string>").withColumn("created_at", F.timestamp_seconds(F.col("dialogue_id") * 60))
    df.where("dialogue_id < 6").write.json(src)
    once = stream.stream_exact_dedup(stream.valid_dialogues(stream.read_stream(spark, src)))
    run = lambda s, k: stream.write_batches(s, str(tmp_path / f"out{k}"), str(tmp_path / f"cp{k}")).awaitTermination(120)
    run(once, 1)
    assert spark.read.parquet(str(tmp_path / "out1")).count() == 4
    time.sleep(0.2)
    df.where("dialogue_id >= 6").write.mode("append").json(src)
    run(stream.stream_exact_dedup(stream.valid_dialogues(stream.read_stream(spark, src))), 1)  # resumes with its state
    assert spark.read.parquet(str(tmp_path / "out1")).count() == 4
    run(stream.stream_template_cap(stream.read_stream(spark, src), cap=3), 2)
    kept = sorted(r.dialogue_id for r in spark.read.parquet(str(tmp_path / "out2")).collect())
    assert kept == [0, 1, 2, 8, 9, 10, 11, 50]
    within = stream.stream_exact_dedup(stream.read_stream(spark, src), delay="1 hour")
    run(within, 3)
    assert spark.read.parquet(str(tmp_path / "out3")).select("doc_hash").distinct().count() == 5


def test_event_windows(spark, data, tmp_path):
    src = str(tmp_path / "events")
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(src)
    live = spark.readStream.schema(events.schema).parquet(src)
    for k, q in enumerate((stream.windowed_counts(live), stream.session_counts(live))):
        stream.write_batches(q, str(tmp_path / f"w{k}"), str(tmp_path / f"wcp{k}")).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / f"w{k}")).agg(F.sum("n")).first()[0] <= events.count()
