"""Near-duplicate documents by HyperMinHash signatures, banding, corrected estimates and an exact check.

1. A document's word shingles are hashed to 64 bits and fall into buckets by their upper bits, in several independent layers. A bucket's
   register is the HyperMinHash one: the leading-zero count of the smallest hash in it and a few mantissa bits after it. Empty
   buckets borrow from filled ones of their layer (densification), so that short documents work too. The registers are written once,
   beside hashes of the document: no later step reads all texts again.
2. Bands of registers are hashed to keys, which are shuffled once. Keys so frequent that they would be a hot spot are known from a bounded sample
   before and counted with partial aggregation instead; the sample decides where rows go, never whether they do.
3. A candidate's Jaccard similarity is estimated from the share of registers that agree, less what registers of unrelated sets of these sizes
   agree by chance (the HyperMinHash collision term). Candidates below the threshold by more than the estimate's error are dropped.
4. The texts of the candidates left are fetched by id and verified exactly on the sets of shingles.

Documents with the same sequence of words form a class, known by 128 bits of hash; one representative per class takes part, so copies cost nothing
and no pairs of copies arise before the result. 64 bits of the hash serve as an address on the way; at the end the whole hash is compared.
A key of very many classes is cut into a grid of block pairs spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import materialize, spread

_U = np.uint64


@dataclass(frozen=True)
class Params:
    """``words`` per shingle; ``similarity`` at which two documents are linked; ``layers`` x ``buckets`` registers in bands of ``rows``."""

    words: int = 5
    similarity: float = 0.8
    layers: int = 8
    buckets: int = 32
    rows: int = 5
    #: Bits of a register's mantissa; the other bits of its two bytes count leading zeros.
    mantissa: int = 11
    #: Standard errors by which the estimate from the registers may fall short of ``similarity``.
    margin: float = 5.0
    #: Rows of one key that are compared within one task; larger keys are cut into blocks of this size.
    block: int = 2000
    #: Documents sampled to find band keys that at least ``hot_share`` of all documents have (at most ``bands / hot_share`` keys).
    hot_sample: int = 10_000
    hot_share: float = 0.002
    #: Keys of candidates up to this number are broadcast to fetch their rows; more are joined by a shuffle.
    broadcast_keys: int = 1_000_000
    #: Byte-identical texts under more ids than this are given as a star around the smallest id instead of all pairs of ids.
    star: int = 1000

    @property
    def bands(self) -> int:
        return self.layers * self.buckets // self.rows

    @property
    def octaves(self) -> int:
        """Counts of leading zeros a register tells apart."""
        return min(1 << (16 - self.mantissa), 48)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_WORDS: dict[str, int] = {}


def _word_hash(word: str) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
    if len(_WORDS) >= 1_000_000:
        _WORDS.clear()
    if len(word) <= 64:  # blobs would fill the memory
        _WORDS[word] = h
    return h


def shingle_hashes(norm: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` consecutive words of a normal form; empty if it has fewer words."""
    tokens = norm.split(" ")
    n = len(tokens) - words + 1
    if n < 1:
        return np.empty(0, _U)
    get = _WORDS.get
    h = np.array([get(w) or _word_hash(w) for w in tokens], dtype=_U)
    s = h[:n]
    for k in range(1, words):
        s = _mix(s) + h[k : k + n]
    s = np.sort(_mix(s))
    return s[np.r_[True, s[1:] != s[:-1]]]


def _leading_zeros(x: np.ndarray) -> np.ndarray:
    """Of positive 64-bit numbers."""
    upper = np.frexp((x >> _U(32)).astype(np.float64))[1]
    lower = np.frexp((x & _U(0xFFFFFFFF)).astype(np.float64))[1]
    return np.where(upper > 0, 32 - upper, 64 - lower)


def signatures(sets: list[np.ndarray], p: Params) -> np.ndarray:
    """HyperMinHash registers, a row of uint16 per set: the leading zeros before ``mantissa`` bits. No set may be empty.

    Registers of different layers alternate, so that a band mixes layers."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)) * p.buckets, [len(s) for s in sets])
    bits, none = p.buckets.bit_length() - 1, _U(0xFFFFFFFFFFFFFFFF)
    out = np.empty((len(sets), p.buckets, p.layers), np.uint16)
    for layer in range(p.layers):
        h = _mix(flat + _U((0x9E3779B97F4A7C15 * (layer + 1)) & 0xFFFFFFFFFFFFFFFF))
        low = np.full(len(sets) * p.buckets, none, _U)
        np.minimum.at(low, row + (h >> _U(64 - bits)).astype(np.int64), (h << _U(bits)) | _U(1))
        low = low.reshape(len(sets), p.buckets)
        filled = low != none
        todo = ~filled
        for attempt in range(1, 64 * p.buckets):
            r, b = np.nonzero(todo)
            if not len(r):
                break
            donor = (_mix((b + p.buckets * attempt).astype(_U)) >> _U(33)).astype(np.int64) % p.buckets
            ok = filled[r, donor]
            low[r[ok], b[ok]] = low[r[ok], donor[ok]]
            todo[r[ok], b[ok]] = False
        lead = np.minimum(_leading_zeros(low), p.octaves - 1).astype(_U)
        out[:, :, layer] = (lead << _U(p.mantissa)) | ((low << (lead + _U(1))) >> _U(64 - p.mantissa))
    return out.reshape(len(sets), -1)


def band_keys(registers: Column, p: Params) -> Column:
    """An array of one 64-bit key per band from the bytes of the registers."""
    return F.array(*[F.xxhash64(F.lit(k), F.substring(registers, 2 * k * p.rows + 1, 2 * p.rows)) for k in range(p.bands)])


def collision_rate(n_a: np.ndarray, n_b: np.ndarray, p: Params) -> np.ndarray:
    """Probability that a register of one set equals that of an unrelated set, for sets of ``n_a`` and ``n_b`` shingles.

    A bucket's smallest hash is exponential with the rate of shingles per bucket; two such meet in a cell of ``2^-mantissa`` of an octave. Summed
    over octaves, with the product of densities integrated in each."""
    a, b = np.maximum(n_a / p.buckets, 1.0), np.maximum(n_b / p.buckets, 1.0)
    both = a + b
    out = np.zeros(len(both))
    for lead in range(p.octaves):
        high = 2.0**-lead
        out += high / 2 * 2.0**-p.mantissa * a * b / both * (np.exp(-both * high / 2) - np.exp(-both * high))
    return out


def estimate(sig_a: np.ndarray, sig_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, p: Params) -> np.ndarray:
    """Jaccard similarity of pairs of sets from their registers, corrected for chance collisions."""
    chance = collision_rate(n_a, n_b, p)
    return np.maximum(((sig_a == sig_b).mean(1) - chance) / (1 - chance), 0.0)


def estimate_floor(n_a: np.ndarray, n_b: np.ndarray, p: Params) -> np.ndarray:
    """What the estimate of a pair at the threshold hardly falls short of. Sets of fewer shingles than buckets give that many independent registers a layer."""
    independent = p.layers * np.minimum(p.buckets, np.maximum(np.maximum(n_a, n_b), 1))
    return p.similarity - p.margin * np.sqrt(p.similarity * (1 - p.similarity) / independent)


_SECOND = "\x01second"


def _hash128(c: str, name: str) -> list[Column]:
    """Two independent 64-bit hashes, null for null."""
    return [F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias(f"{name}1"), F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(_SECOND), F.col(c))).alias(f"{name}2")]


def normal_words(text: Column) -> Column:
    """Words of the lower-cased text (maximal runs of letters or digits) with single blanks between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


@dataclass
class NearDuplicates:
    """``members``: ``id, class_no, class_id, t1, t2`` of every document (``class_id``: the smallest id with the same words, ``t1, t2``: the hash of
    the very text; null texts have no class; an id with several texts has a row for each). ``links``: ``class_a, class_b, similarity`` of class numbers,
    class_a < class_b."""

    members: DataFrame
    links: DataFrame
    params: Params

    def copies(self) -> DataFrame:
        """``id, stands_for``: ids whose text more than ``star`` ids have byte for byte, beside the smallest of these, which stands for them in :meth:`pairs`."""
        key = ["class_no", "t1", "t2"]
        many = self.members.where("class_no is not null").groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("stands_for")).where(F.col("_n") > self.params.star)
        return self.members.join(many, key).where("id <> stands_for").select("id", "class_no", "t1", "t2", "stands_for")

    def pairs(self) -> DataFrame:
        """``id_a, id_b``, each once, id_a < id_b: all linked documents and all with the same words.

        One form is shortened: of byte-identical texts under more than ``star`` ids only the smallest id is linked with other texts and with each of
        its copies; :meth:`copies` names those. Different texts lose no link."""
        alone = self.members.where("class_no is not null").select("id", "class_no", "t1", "t2")
        star = materialize(self.copies(), "copies")
        if star.limit(1).count():
            alone = alone.join(star.select("id", "class_no", "t1", "t2"), ["id", "class_no", "t1", "t2"], "left_anti")
        a, b = alone.select(F.col("id").alias("_a"), F.col("class_no").alias("class_a")), alone.select(F.col("id").alias("_b"), F.col("class_no").alias("class_b"))
        across = self.links.join(a, "class_a").join(b, "class_b").select("_a", "_b")
        inner = a.join(b.withColumnRenamed("class_b", "class_a"), "class_a").where("_a < _b").select("_a", "_b")
        every = across.unionByName(inner).unionByName(star.select(F.col("stands_for").alias("_a"), F.col("id").alias("_b")))
        return every.where("_a <> _b").select(F.least("_a", "_b").alias("id_a"), F.greatest("_a", "_b").alias("id_b")).distinct()

    def groups(self) -> DataFrame:
        """One row per document: ``id, class_id, group_id, links`` (``links``: other classes it is linked with). The group is the connected
        component, named by its smallest id; documents without text are their own group. An id with several texts joins their groups, has the smallest of
        their class ids and the sum of their links."""
        from lexloom.operators.components import connected_components

        edges = self.links.select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
        known = self.members.where("class_no is not null")
        several = known.groupBy("id").agg(F.min("class_no").alias("a"), F.max("class_no").alias("_hi")).where("a <> _hi").select("id", "a")
        shared = known.join(several, "id").where("class_no <> a").select("a", F.col("class_no").alias("b"))
        comp = connected_components(edges.unionByName(shared)).select(F.col("node").alias("class_no"), "component")
        degree = edges.select(F.col("a").alias("class_no")).unionByName(edges.select(F.col("b").alias("class_no"))).groupBy("class_no").agg(F.count(F.lit(1)).alias("links"))
        in_group = materialize(self.members.join(comp, "class_no", "left").join(degree, "class_no", "left").select("id", "class_id", "component", "links"), "grouped")
        named = in_group.where("component is not null").groupBy("component").agg(F.min("id").alias("group_id"))
        rows = in_group.join(named, "component", "left").select("id", "class_id", F.coalesce("group_id", "class_id", "id").alias("group_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
        return rows.groupBy("id").agg(F.min("class_id").alias("class_id"), F.min("group_id").alias("group_id"), F.sum("links").alias("links"))


_SIGNED = "id long, h1 long, h2 long, t1 long, t2 long, n int, registers binary"


def _sign(rows: DataFrame, p: Params) -> DataFrame:
    """``id, h1, h2, t1, t2`` with the registers of the first row of each class in a task, so that copies don't pile up under their keys."""

    def sign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set[int] = set()
        for batch in batches:
            if len(seen) > SEEN:
                seen.clear()  # a class may then be signed again, which changes nothing but work
            sets, at = [], []
            for i, (h, norm) in enumerate(zip(batch.column(1).to_pylist(), batch.column(5).to_pylist())):
                if norm is None or h in seen:
                    continue
                seen.add(h)
                s = shingle_hashes(norm, p.words)
                if len(s):
                    sets.append(s)
                    at.append(i)
            sizes: list[int | None] = [None] * batch.num_rows
            registers: list[bytes | None] = [None] * batch.num_rows
            for first in range(0, len(sets), 2000):
                part = sets[first : first + 2000]
                for i, s, row in zip(at[first : first + 2000], part, signatures(part, p)):
                    sizes[i], registers[i] = len(s), row.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sizes, pa.int32()), pa.array(registers, pa.binary())], names=[c.split(" ")[0] for c in _SIGNED.split(", ")])

    return rows.mapInArrow(sign, _SIGNED)


#: Classes a task remembers while it signs.
SEEN = 1_000_000


def _few(keys: DataFrame, p: Params) -> DataFrame:
    """Written keys, marked for a broadcast if there are few of them."""
    return F.broadcast(keys) if keys.limit(p.broadcast_keys + 1).count() <= p.broadcast_keys else keys


def _hot_keys(signed: DataFrame, keys_of: Callable[[DataFrame], DataFrame], p: Params) -> DataFrame:
    """``key`` of the bands that very many documents share, from a bounded sample."""
    n = signed.count()
    sample = signed.sample(min(1.0, p.hot_sample / max(n, 1)), seed=1) if n > p.hot_sample else signed
    least = max(8, int(p.hot_share * min(n, p.hot_sample)))
    return materialize(keys_of(sample).groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("key"), "hot_keys")


def _candidates(signed: DataFrame, p: Params) -> DataFrame:
    """``a, b`` (addresses, a < b): classes that share a band key."""
    keys_of = lambda df: df.select("h1", F.explode(band_keys(F.col("registers"), p)).alias("key"))
    signed = signed.where("registers is not null").select("h1", "registers")
    keys, hot = keys_of(signed), _hot_keys(signed, keys_of, p)
    some = hot.limit(1).count() > 0
    w = Window.partitionBy("key")
    cold = keys.join(F.broadcast(hot), "key", "left_anti") if some else keys  # at most bands / hot_share keys
    cold = cold.select("key", "h1", F.count(F.lit(1)).over(w).alias("_c"), F.min("h1").over(w).alias("_lo"), F.max("h1").over(w).alias("_hi")).where("_c > 1 and _lo <> _hi")
    blocks = F.ceil(F.col("_c") / p.block).cast("int").alias("blocks")
    shared = cold.select("key", "h1", blocks)
    if some:
        rows = keys.join(F.broadcast(hot), "key", "left_semi").distinct()
        counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
        shared = shared.unionByName(rows.join(F.broadcast(counts), "key").select("key", "h1", blocks))  # no more keys than hot ones
    shared = materialize(shared, "shared_keys")
    # A key with more rows than a block is a grid of block pairs: two rows of different blocks meet in one cell, of one block on its diagonal.
    own = F.pmod(F.xxhash64("h1"), F.col("blocks")).cast("int")
    cells = (
        shared.withColumn("_x", own)
        .withColumn("_y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "h1", "_x", F.least("_x", "_y").alias("_i"), F.greatest("_x", "_y").alias("_j"))
    )
    x, y = cells.alias("x"), cells.alias("y")
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x._i") == F.col("y._i")) & (F.col("x._j") == F.col("y._j")) & (F.col("x.h1") < F.col("y.h1"))
    once = (F.col("x._x") != F.col("y._x")) | (F.col("x._i") == F.col("x._j"))
    return x.join(y, meet & once).select(F.col("x.h1").alias("a"), F.col("y.h1").alias("b")).distinct()


def _likely(candidates: DataFrame, signed: DataFrame, p: Params) -> DataFrame:
    """The candidates whose estimated similarity does not rule them out."""
    wanted = materialize(candidates.select(F.col("a").alias("h1")).unionByName(candidates.select(F.col("b").alias("h1"))).distinct(), "candidate_keys")
    known = signed.where("registers is not null").select("h1", "n", "registers").join(_few(wanted, p), "h1", "left_semi").dropDuplicates(["h1"])
    known = materialize(known, "candidate_registers")
    side = lambda c: known.select(F.col("h1").alias(c), F.col("n").alias(f"n_{c}"), F.col("registers").alias(f"r_{c}"))

    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (2, 4))
            sa, sb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for k in (3, 5))
            ok = estimate(sa, sb, na, nb, p) >= estimate_floor(na, nb, p)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in batch.columns[:2]], names=["a", "b"])

    both = candidates.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "r_a", "n_b", "r_b")
    return both.mapInArrow(keep, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str, text_col: str, params: Params = Params()) -> NearDuplicates:
    """Link all documents whose sets of word shingles have a Jaccard similarity of at least ``params.similarity``.

    Ids must be whole numbers; rows with a null id are ignored, redelivered rows (same id and text) count once, an id with several
    texts is linked by each, never with itself. A null text belongs to no class and has no link; texts without a word form one class of copies.
    Texts with fewer words than a shingle have no shingles and are linked to their copies only. An empty table gives empty results.

    Banding finds a pair with probability 1 - (1 - J^rows)^bands (51 bands of 5: 0.984 at J = 0.6, 0.998 at 0.65, 0.9999 at 0.7; at J >= 0.8 all but one
    pair in 10^8). Bands of 4 find more at 0.6, but unrelated texts of one domain then share keys in numbers that grow as the square of the table.
    Everything found is verified on whole texts: no reported pair has less than the similarity, but for collisions of 64-bit shingle hashes."""
    p = params
    text = F.col(text_col)
    source = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    hashed = source.select("id", "text", normal_words(F.col("text")).alias("norm")).select("id", *_hash128("norm", "h"), *_hash128("text", "t"), "norm")
    signed = materialize(_sign(spread(hashed), p), "signed")
    ids = signed.select("id", "h1", "h2", "t1", "t2").distinct()
    classes = ids.where("h1 is not null").groupBy("h1", "h2").agg(F.min("id").alias("class_id"))
    classes = materialize(classes.withColumn("class_no", F.monotonically_increasing_id()), "classes")
    members = materialize(ids.join(classes, ["h1", "h2"], "left").select("id", "class_no", "class_id", "t1", "t2"), "members")

    likely = _likely(materialize(_candidates(signed, p), "candidates"), signed, p)
    side = lambda c: classes.select(F.col("h1").alias(c), F.col("class_no").alias(f"no_{c}"), F.col("class_id").alias(f"id_{c}"), F.col("h2").alias(f"h2_{c}"))
    named = materialize(likely.join(side("a"), "a").join(side("b"), "b"), "likely")
    wanted = named.select(F.col("no_a").alias("no"), F.col("id_a").alias("id"), F.col("a").alias("h1"), F.col("h2_a").alias("h2")).unionByName(
        named.select(F.col("no_b").alias("no"), F.col("id_b").alias("id"), F.col("b").alias("h1"), F.col("h2_b").alias("h2"))
    )
    # The ids meet the rows before these are normalized: only the candidates' texts are, and an id with several texts gives the one that is meant.
    texts = source.join(_few(materialize(wanted.distinct(), "candidate_ids"), p), "id").select("no", "h1", "h2", normal_words(F.col("text")).alias("norm"))
    texts = texts.where((F.xxhash64("norm") == F.col("h1")) & (F.xxhash64(F.lit(_SECOND), F.col("norm")) == F.col("h2"))).select("no", "norm").dropDuplicates(["no"])
    texts = materialize(texts, "candidate_texts")
    order = F.col("no_a") < F.col("no_b")
    pairs = named.select(F.when(order, F.col("no_a")).otherwise(F.col("no_b")).alias("class_a"), F.when(order, F.col("no_b")).otherwise(F.col("no_a")).alias("class_b"))
    sides = pairs.join(texts.select(F.col("no").alias("class_a"), F.col("norm").alias("text_a")), "class_a").join(texts.select(F.col("no").alias("class_b"), F.col("norm").alias("text_b")), "class_b")

    def verify(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out: list[tuple[int, int, float]] = []
            sets: dict[int, np.ndarray] = {}
            for ia, ib, ta, tb in zip(*(batch.column(k).to_pylist() for k in range(4))):
                for i, t in ((ia, ta), (ib, tb)):
                    if i not in sets:
                        sets[i] = shingle_hashes(t, p.words)
                x, y = sets[ia], sets[ib]
                both = len(np.intersect1d(x, y, assume_unique=True))
                either = len(x) + len(y) - both
                if either and both / either >= p.similarity - 1e-12:
                    out.append((ia, ib, both / either))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["class_a", "class_b", "similarity"])

    links = materialize(sides.select("class_a", "class_b", "text_a", "text_b").mapInArrow(verify, "class_a long, class_b long, similarity double"), "links")
    return NearDuplicates(members, links, p)
