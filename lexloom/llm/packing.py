"""Filling containers of fixed capacity by bounded-space online best-fit.

Each input partition packs its own documents as they arrive: no shuffle, and memory for a fixed number of open containers only.
Open containers are found through a bitset keyed by free space, so best-fit is one shift and one lowest-set-bit. When too many are open
the fullest closes. Nothing is packed twice: the containers still open at a partition's end close as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.tokenizer.codec import token_count
from lexloom.tokenizer.vocab import Merges

#: Open containers per partition and capacity. On the sizes of documents 64 leave no more room unused than thousands do (README).
OPEN = 64
#: More capacities than this are refused (the table is collected).
MAX_SPECS = 10_000


class BestFit:
    """Bounded-space best-fit into bins of one capacity; closed bins are handed out as ``(bin number, items)``."""

    def __init__(self, capacity: int, open_bins: int = OPEN) -> None:
        if capacity < 1:
            raise ValueError("a capacity must be at least 1")
        self.capacity, self.limit = capacity, open_bins
        self.bits, self.opened, self.n_open = 0, 0, 0
        self.by_free: dict[int, list[tuple[int, list]]] = {}

    def _put(self, free: int, b: tuple[int, list]) -> None:
        at = self.by_free.setdefault(free, [])
        at.append(b)
        self.bits |= 1 << free
        self.n_open += 1

    def _take(self, free: int) -> tuple[int, list]:
        at = self.by_free[free]
        b = at.pop()
        if not at:
            del self.by_free[free]
            self.bits ^= 1 << free
        self.n_open -= 1
        return b

    def add(self, size: int, item) -> Iterator[tuple[int, list]]:
        """Place one item of ``0 <= size <= capacity``; yields a bin if one closes."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            free, b = self.capacity, (self.opened, [])
            self.opened += 1
        b[1].append((size, item))
        free -= size
        if free == 0:
            yield b
            return
        self._put(free, b)
        if self.n_open > self.limit:
            yield self._take((self.bits & -self.bits).bit_length() - 1)

    def finish(self) -> Iterator[tuple[int, list]]:
        """Close what is still open, the fullest first."""
        while self.bits:
            yield self._take((self.bits & -self.bits).bit_length() - 1)


def pack_partition(rows: Iterator[pd.DataFrame], specs: list[tuple[int, int]], open_bins: int, partition: int) -> Iterator[pd.DataFrame]:
    bins = [(spec, cap, BestFit(cap, open_bins)) for spec, cap in specs]
    out: list[tuple] = []

    def closed(spec: int, b: tuple[int, list]) -> None:
        name = f"{partition}-{b[0]}"
        out.extend((spec, doc, piece, size, name) for size, (doc, piece) in b[1])

    def flush() -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["spec_id", "doc_id", "piece", "tokens", "container"])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        out.clear()
        return frame

    for batch in rows:
        docs = [None if pd.isna(d) else int(d) for d in batch["doc_id"]]
        for doc, size in zip(docs, batch["tokens"].tolist()):
            for spec, cap, packer in bins:
                piece, rest = 0, int(size)
                while True:
                    for b in packer.add(min(rest, cap), (doc, piece)):
                        closed(spec, b)
                    rest -= cap
                    piece += 1
                    if rest <= 0:
                        break
        if len(out) >= 50_000:
            yield flush()
    for spec, _, packer in bins:
        for b in packer.finish():
            closed(spec, b)
    yield flush()


def containers(documents: DataFrame, specs: DataFrame, merges: Merges, id_col: str = "doc_id", text_col: str = "text", open_bins: int = OPEN) -> DataFrame:
    """One row per document or piece and capacity: ``spec_id, doc_id, piece, tokens, container``.

    A document is split only if it exceeds the capacity, then into full pieces and one rest, numbered from 0. ``container`` is unique
    within a spec. Null and empty texts have 0 tokens and take no room; a repeated row is packed again; specs with a null or
    non-positive capacity are ignored, a repeated spec_id counts once (its smallest capacity). No documents or no specs: no rows."""
    plan = specs.where("spec_id is not null and capacity > 0").groupBy("spec_id").agg(F.min("capacity").alias("capacity")).limit(MAX_SPECS + 1).collect()
    if len(plan) > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} capacities")
    chosen = sorted((int(r.spec_id), int(r.capacity)) for r in plan)
    sized = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(token_count(text_col, merges), F.lit(0)).alias("tokens"))

    def pack(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        yield from pack_partition(rows, chosen, open_bins, context.partitionId() if context else 0)

    return sized.mapInPandas(pack, "spec_id int, doc_id long, piece int, tokens int, container string")


def fill_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per capacity: ``spec_id, capacity, containers, tokens, unused_share``."""
    used = packed.groupBy("spec_id").agg(F.count_distinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    cap = specs.groupBy("spec_id").agg(F.min("capacity").alias("capacity"))
    return used.join(F.broadcast(cap), "spec_id").select("spec_id", "capacity", "containers", "tokens", (1 - F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("unused_share"))
