import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.operators import budget, corpus, dedup, shards
from lexloom.operators.components import connected_components
from lexloom.operators.prefix import prefix_sum


def test_prefix_sum(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", None]), i, rng.choice([0, 3, 10, None])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = {r.i: r.p for r in prefix_sum(df, "v", ["i"], ["k"], "p", partitions=7).collect()}
    sums = {}
    for k, i, v in rows:
        assert got[i] == sums.get(k, 0)
        sums[k] = sums.get(k, 0) + (v or 0)
    assert prefix_sum(df.limit(0), "v", ["i"]).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


TEXTS = [(1, "hello world"), (2, "hello world"), (3, "hello  world"), (4, "unique"), (5, None), (6, "")]


def test_exact_dedup(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    assert sorted(r.doc_id for r in dedup.exact_dedup(df).collect()) == [1, 4, 5]
    assert dedup.duplicate_groups(df).count() == 2


def test_greedy_keeps_what_a_pass_keeps(spark):
    rng = random.Random(3)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)})
    kept = []
    dropped = set()
    for i in range(40):
        if any((j, i) in pairs for j in kept):
            dropped.add(i)
        else:
            kept.append(i)
    got = {r.id for r in dedup.greedy_keep(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == dropped
    assert dedup.greedy_keep(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_dedup_chain(spark):
    base = " ".join(f"word{i}" for i in range(200))
    near = base.replace("word7 ", "other ")
    far = near
    for i in range(20, 60):
        far = far.replace(f"word{i} ", f"x{i} ")
    df = spark.createDataFrame([(1, base), (2, near), (3, far), (4, base + " "), (5, ""), (6, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in dedup.near_dedup(df).collect()) == [1, 3, 5]
    pairs = dedup.minhash_pairs(df.where("doc_id < 4")).collect()
    assert [(p.a, p.b) for p in pairs] == [(1, 2)]
    with pytest.raises(ValueError):
        dedup.minhash_pairs(df, threshold=0.5)


def test_signatures_estimate_jaccard():
    a, b = "abcdefghij" * 30 + "x" * 200, "abcdefghij" * 30 + "y" * 200
    x, y = set(dedup.char_shingles(a).tolist()), set(dedup.char_shingles(b).tolist())
    assert len(dedup.char_shingles("")) == 0 and len(dedup.char_shingles("ab")) == 1
    assert 0 < len(x & y) / len(x | y) < 1


def test_keys_lose_nothing_and_find_little_else(spark):
    rng = random.Random(8)
    for threshold in (0.76, 0.8, 0.92, 1.0):
        differ = int((1 - threshold) * 128 + 1e-9)
        keys = dedup.band_keys(threshold)
        assert len(keys) <= dedup.MOST_KEYS
        for _ in range(500):
            changed = set(rng.sample(range(128), differ))
            assert any(not changed & set(k) for k in keys)
    # Texts of which half agrees: with keys of 4 values most pairs were candidates.
    assert sum(0.5 ** len(k) for k in dedup.band_keys(0.8)) < 0.6 and sum(0.5 ** len(k) for k in dedup.band_keys(0.92)) < 0.001
    words = [f"word{i}" for i in range(400)]
    base = [" ".join(rng.sample(words, 60)) for _ in range(25)]
    texts = [" ".join(w if rng.random() > share else "x" + w for w in rng.choice(base).split()) for share in (0.0, 0.02, 0.05, 0.1) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    once = dedup.exact_dedup(df)
    signs = {r.doc_id: np.array(r.s) for r in once.select("doc_id", dedup.minhash_signature("text").alias("s")).collect()}
    for threshold in (0.8, 0.92):
        want = {(a, b, float((x == y).mean())) for a, x in signs.items() for b, y in signs.items() if a < b and (x == y).mean() >= threshold}
        assert want and {tuple(r) for r in dedup.minhash_pairs(once, threshold=threshold).collect()} == want
    a, b = dedup._coefficients(dedup.PERMUTATIONS)
    brute = ((dedup.char_shingles(texts[0])[:, None] * a + b) & np.uint64(0xFFFFFFFF)).min(0)
    assert signs[0].tolist() == brute.tolist()


def test_template_cap_and_stages(spark):
    rows = [(i, f"USER: text number {i} {'abc' * i}\n\nASSISTANT: answer {i * i}", ["s"]) for i in range(1, 6)] + [(6, "same", None), (7, "same", []), (8, "other words here", [])]
    df = spark.createDataFrame(rows, "dialogue_id long, text string, signature array<string>")
    assert sorted(r.dialogue_id for r in dedup.template_cap(df, cap=3).collect()) == [1, 2, 3, 6, 7, 8]
    reasons = {r.id: r.reason for r in dedup.conversation_dedup(df, cap=3).collect()}
    assert reasons[7] == "exact" and reasons[5] == "template" and reasons[1] is None and reasons[8] is None


def test_bloom(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 30_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    bloom = dedup.BloomFilter(10_000, 0.01)
    bloom.add(x[:10_000])
    assert bloom.contains(x[:10_000]).all() and bloom.contains(x[10_000:]).mean() < 0.02
    df = spark.createDataFrame([(str(i),) for i in range(20)] + [(None,)], "v string")
    for error in (0.001, 0.9):  # the result is exact whatever the filter lets through
        left = sorted(str(r.v) for r in dedup.bloom_anti_join(df, df.where("v < '15'"), "v", error).collect())
        assert left == sorted([str(i) for i in range(20) if not str(i) < "15"] + ["None"])
    built = dedup.bloom_filter(spark.range(200_000).select(F.col("id").alias("v")))
    assert len(built.words) > dedup.BLOOM_PART or built.words.any()
    hashes = np.array([r.h for r in spark.range(500).select(F.xxhash64(F.col("id").cast("string")).alias("h")).collect()], np.int64).view(np.uint64)
    assert built.contains(hashes).all()


def test_conversation_fold(spark):
    """The rounds against a pass over the dialogues one by one."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(12)]
    rows = []
    for i in range(1, 90):
        t = rng.choice(texts).split()
        if rng.random() < 0.5:
            t[rng.randrange(80)] = rng.choice(words)
        rows.append((i, " ".join(t), rng.choice([["hot"], ["hot"], ["a"], ["b"], [], None])))
    df = spark.createDataFrame(rows, "dialogue_id long, text string, signature array<string>")
    once = dedup.exact_dedup(df, order_col="dialogue_id")
    linked = {(r.a, r.b) for r in dedup.minhash_pairs(once, id_col="dialogue_id", threshold=0.8).collect()}
    first = {}
    for i, t, _ in rows:
        first.setdefault(t, i)
    kept, want, counts = {}, {}, {}
    for i, t, s in rows:
        key = tuple(s) if s else None
        if t in kept:
            want[i] = "exact"
        elif key and counts.get(key, 0) >= 2:
            want[i] = "template"
        elif any(tuple(sorted((first[t], first[u]))) in linked for u in kept):
            want[i] = "near"
        else:
            kept[t] = i
            if key:
                counts[key] = counts.get(key, 0) + 1
            want[i] = None
    got = {r.id: r.reason for r in dedup.conversation_dedup(df, cap=2, threshold=0.8).collect()}
    assert got == want and {"exact", "near", "template"} <= set(want.values())


def test_long_chain_of_links(spark):
    pairs = [(i, i + 1) for i in range(1, 12)]
    assert {r.id for r in dedup.greedy_keep(spark.createDataFrame(pairs, "a long, b long")).collect()} == {2, 4, 6, 8, 10, 12}


def test_byte_tokens(spark):
    texts = [None, "", "aé", "привет", None, "x" * 3000, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(1)
    got = {r.i: r.ids for r in df.select("i", shards.byte_tokens("text").alias("ids")).collect()}
    assert got == {i: None if t is None else list(t.encode()) for i, t in enumerate(texts)}
    assert df.limit(0).select(shards.byte_tokens("text")).count() == 0 and df.where("text is null").select(shards.byte_tokens("text").alias("x")).first().x is None


def test_shards_and_windows(spark):
    rng = random.Random(4)
    docs = [(i, [rng.randrange(256) for _ in range(rng.choice([0, 1, 7, 130]))]) for i in range(40)] + [(99, None)]
    stream = [t for _, ids in docs for t in [*(ids or []), 258]]
    out = shards.token_shards(spark.createDataFrame(docs, "doc_id long, ids array<int>"), 50)
    got = {r.shard: r.tokens for r in out.collect()}
    assert [t for s in sorted(got) for t in got[s]] == stream
    assert all(len(got[s]) == 50 for s in sorted(got)[:-1])
    m = shards.shard_manifest(out, 968).first()
    assert m.total_tokens == len(stream) and m.dtype == "uint16" and m.num_shards == len(got) and m.shards[0].file == "shard_00000.bin"
    w = shards.sequence_windows(out, 16, 8)
    assert {(r.shard, r.start) for r in w.collect()} == {(s, k) for s, t in got.items() for k in range(0, len(t) - 15, 8)}
    p = shards.shifted_pairs(w).first()
    assert len(p.x) == len(p.y) == 15 and p.x[1:] == p.y[:-1]
    parts = [{r.shard for r in shards.shuffled_shards(out, 1, 3, k).collect()} for k in range(3)]
    assert sorted(s for x in parts for s in x) == sorted(got)
    assert all(len(r.ids) == 8 for r in shards.random_starts(out, 8, 3, 1).collect())
    with pytest.raises(ValueError):
        shards.token_shards(out, 0)
    b = shards.batches(spark.range(10).withColumnRenamed("id", "doc_id"), ["doc_id"], 4)
    assert b.count() == 8 and shards.batches(spark.range(10), ["id"], 4, drop_last=False).count() == 10


def test_shards_of_bytes(spark, monkeypatch):
    """Bytes as ids, documents longer than a piece, a shard and a part, several parts, no end marks, nothing at all."""
    rng = random.Random(6)
    docs = [(i * 7 % 61, rng.randbytes(rng.choice([0, 1, 40, 3000, 20_000]))) for i in range(60)] + [(99, None)]
    df = spark.createDataFrame(docs, "doc_id long, ids binary")
    assert shards.token_shards(df.limit(0), 50).count() == 0
    monkeypatch.setattr(shards, "PART_TOKENS", 5000)
    for eos, size in ((True, 1700), (False, 1700), (True, 1), (False, 10**7)):
        part = df if size > 1 else df.where("doc_id < 20 and octet_length(ids) < 50")
        stream = [t for _, ids in sorted(map(tuple, part.collect())) for t in [*(ids or b""), *[258] * eos]]
        got = {r.shard: r.tokens for r in shards.token_shards(part, size, add_eos=eos).collect()}
        assert got == {k: stream[k * size : (k + 1) * size] for k in range(-(-len(stream) // size))}
    plan = shards.token_shards(df, 1700)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "collect_list" not in plan


def _bytes(spark):
    rng = random.Random(8)
    return spark.createDataFrame([(i * 7 % 61, rng.randbytes(rng.choice([0, 1, 40, 3000, 20_000]))) for i in range(60)] + [(99, None)], "doc_id long, ids binary")


def test_shard_sizes(spark):
    """The sizes of the shards without their tokens, and a manifest in order of the numbers, which is not that of the names."""
    df = _bytes(spark)
    for eos, size in ((True, 1700), (False, 1700), (True, 10**7)):
        want = {r.shard: len(r.tokens) for r in shards.token_shards(df, size, add_eos=eos).collect()}
        assert {r.shard: r.n for r in shards.shard_sizes(df, size, add_eos=eos).collect()} == want
    assert shards.shard_sizes(df.limit(0), 50).count() == 0 and shards.shard_manifest(shards.shard_sizes(df.limit(0), 50), 968).first().num_shards == 0
    m = shards.shard_manifest(spark.range(99_998, 100_002).select(F.col("id").cast("int").alias("shard"), F.lit(5).alias("n")), 968).first()
    assert [x.file for x in m.shards] == [f"shard_{k:05d}.bin" for k in range(99_998, 100_002)] and m.total_tokens == 20


def test_token_windows(spark, monkeypatch):
    """Windows as those of the finished shards, with and without overlap, over several batches, and none where a shard is too short."""
    df = _bytes(spark)
    monkeypatch.setattr(shards, "PART_TOKENS", 5000)
    monkeypatch.setattr(shards, "WINDOW_TOKENS", 700)
    for size, seq_len, stride in ((1700, 128, None), (1700, 128, 50), (300, 7, 11), (100, 101, None), (10**7, 1000, None)):
        want = {(r.shard, r.start): r.ids for r in shards.sequence_windows(shards.token_shards(df, size), seq_len, stride).collect()}
        assert {(r.shard, r.start): r.ids for r in shards.token_windows(df, size, seq_len, stride).collect()} == want


def test_budgets(spark):
    df = spark.createDataFrame([(i, 10) for i in range(20)], "doc_id long, n long")
    assert sorted(r.doc_id for r in budget.within_budget(df, "n", 35).collect()) == [0, 1, 2, 3]
    assert budget.first_share(df, 0.01).where("split = 'validation'").count() == 1
    langs = df.withColumn("lang", F.when(F.col("doc_id") < 10, "ru").otherwise("en"))
    assert budget.keep_by_language(langs, {"ru": 1.0}).count() == 10
    assert budget.leakage_free(df, df.where("doc_id < 5"), F.col("doc_id")).count() == 15
    means = {r.period: r["mean"] for r in budget.periodic_mean(df, "doc_id", "n", 5).collect()}
    assert means == {0: 10, 1: 10, 2: 10, 3: 10}


def test_pairs(spark):
    words = corpus.word_frequency(spark.createDataFrame([("ab ab\tabc",), (None,)], "text string"))
    assert {(r.word, r.n) for r in words.collect()} == {("ab", 2), ("abc", 1)}
    pairs = corpus.pair_frequency(words, shards.byte_tokens("word"))
    assert {(r.a, r.b): r.n for r in pairs.collect()} == {(97, 98): 3, (98, 99): 1}
    assert tuple(corpus.best_pair(pairs).first()) == (97, 98, 3)
    x = spark.createDataFrame([([1, 1, 1, 2],)], "ids array<int>")
    assert x.select(corpus.merge_pair("ids", 1, 1, 9).alias("x")).first().x == [9, 1, 2]
    rng = random.Random(5)
    for _ in range(200):
        ids, (a, b) = [rng.randrange(3) for _ in range(rng.randrange(12))], (rng.randrange(3), rng.randrange(3))
        want, i = [], 0
        while i < len(ids):
            pair = ids[i : i + 2] == [a, b]
            want.append(9 if pair else ids[i])
            i += 2 if pair else 1
        assert corpus._merge(np.array(ids, int), a, b, 9).tolist() == want
    stats = corpus.tokenizer_stats(spark.createDataFrame([("a b", 3), (None, 0)], "text string, n int"), "text", "n").first()
    assert (stats.tokens, stats.words, stats.chars, stats.tokens_per_word) == (3, 2, 3, 1.5)


def test_seeded_functions_are_stable():
    a, b = dedup._coefficients(4)
    assert np.array_equal(a, dedup._coefficients(4)[0]) and len(b) == 4
