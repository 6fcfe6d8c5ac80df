"""Encoding and decoding with a byte-level merge table, as Arrow UDFs with a cache of words per worker."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.tokenizer.vocab import FIRST_MERGE_ID, SPECIAL_TO_ID, SPECIALS, UNK, Merges, id_to_bytes

_PIECES = re.compile(r"\s+|\S+")
_SPECIAL = re.compile("|".join(re.escape(s) for s in sorted(SPECIALS, key=len, reverse=True)))
#: Words remembered per Python worker. The cache is emptied when full, so memory is bounded and results don't change.
CACHE_WORDS = 400_000
#: Longer runs of characters (blobs) are encoded each time, so that the cache stays small in bytes too.
CACHE_LENGTH = 256


class Codec:
    """Merges inside runs of non-blanks; blanks are single bytes."""

    def __init__(self, merges: Merges) -> None:
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.table = id_to_bytes(merges)
        self.words: dict[str, list[int]] = {}
        self.saved: dict[str, int] = {}

    def word(self, word: str) -> list[int]:
        """Lowest rank first, leftmost first, until no known pair is left."""
        if len(word) > CACHE_LENGTH:
            return self._merge(list(word.encode("utf-8", "replace")))
        ids = self.words.get(word)
        if ids is None:
            ids = self._merge(list(word.encode("utf-8", "replace")))
            if len(self.words) >= CACHE_WORDS:
                self.words.clear()
            self.words[word] = ids
        return ids

    def _merge(self, ids: list[int]) -> list[int]:
        rank = self.rank
        none = len(rank)
        if len(ids) > 256:
            return self._merge_long(ids)
        while len(ids) > 1:
            best = min(map(lambda p: rank.get(p, none), zip(ids, ids[1:])))
            if best == none:
                break
            ids = self._replace(ids, best)
        return ids

    def _replace(self, ids: list[int], best: int) -> list[int]:
        out, i, n, new = [], 0, len(ids), FIRST_MERGE_ID + best
        rank = self.rank
        while i < n:
            if i + 1 < n and rank.get((ids[i], ids[i + 1])) == best:
                out.append(new)
                i += 2
            else:
                out.append(ids[i])
                i += 1
        return out

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same result with a heap over a linked list, n log n for very long runs."""
        import heapq

        n, rank = len(ids), self.rank
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or rank.get((ids[i], ids[j])) != r:
                continue
            ids[i], alive[j], nxt[i] = FIRST_MERGE_ID + r, False, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (q := rank.get((ids[i], ids[nxt[i]]))) is not None:
                    heapq.heappush(heap, (q, i))
            if prv[i] >= 0 and (q := rank.get((ids[prv[i]], ids[i]))) is not None:
                heapq.heappush(heap, (q, prv[i]))
        return [t for t, a in zip(ids, alive) if a]

    def encode(self, text: str, specials: bool = False) -> list[int]:
        if specials:
            out, at = [], 0
            for m in _SPECIAL.finditer(text):
                out += self.encode(text[at : m.start()])
                out.append(SPECIAL_TO_ID[m[0]])
                at = m.end()
            return out + self.encode(text[at:])
        out: list[int] = []
        for piece in _PIECES.findall(text):
            if piece[0].isspace():
                out += piece.encode()
            else:
                out += self.word(piece)
        return out

    def count(self, text: str) -> int:
        """``len(encode(text))`` without the ids: the bytes less what merging saves in each word."""
        saved, total = self.saved, len(text.encode("utf-8", "replace"))
        words = text.split()
        try:
            return total - sum([saved[w] for w in words])
        except KeyError:
            for w in words:
                less = saved.get(w)
                if less is None:
                    less = len(w.encode("utf-8", "replace")) - len(self.word(w))
                    if len(saved) >= CACHE_WORDS:
                        saved.clear()
                    if len(w) <= CACHE_LENGTH:
                        saved[w] = less
                total -= less
            return total

    def decode(self, ids, skip_special: bool = False) -> str:
        first, parts = 256, []
        for i in ids:
            if i is None:
                continue
            if first <= i < FIRST_MERGE_ID and skip_special:
                continue
            parts.append(self.table.get(int(i), SPECIALS[UNK - first].encode()))
        return b"".join(parts).decode(errors="replace")


_CODECS: dict[int, tuple[Merges, Codec]] = {}


def codec(merges: Merges) -> Codec:
    """One codec per merge table and worker, kept between tasks."""
    key = hash(merges)
    found = _CODECS.get(key)
    if found is None or found[0] != merges:
        _CODECS.clear()
        _CODECS[key] = found = (merges, Codec(merges))
    return found[1]


def token_count(text: Column | str, merges: Merges) -> Column:
    """Size in tokens; null for null."""

    @F.pandas_udf("int")
    def size(s: pd.Series) -> pd.Series:
        c = codec(merges)
        return pd.Series([None if t is None else c.count(t) for t in s], dtype="Int32")

    return size(text)


def encode(text: Column | str, merges: Merges, specials: bool = False) -> Column:
    """Token ids; null for null."""

    @F.pandas_udf("array<int>")
    def ids(s: pd.Series) -> pd.Series:
        c = codec(merges)
        return pd.Series([None if t is None else c.encode(t, specials) for t in s])

    return ids(text)


def decode(ids: Column | str, merges: Merges, skip_special: bool = False) -> Column:
    """Text of token ids; unknown ids give ``<UNK>``, broken UTF-8 gives U+FFFD."""

    @F.pandas_udf("string")
    def text(s: pd.Series) -> pd.Series:
        c = codec(merges)
        return pd.Series([None if t is None else c.decode(t, skip_special) for t in s])

    return text(ids)
