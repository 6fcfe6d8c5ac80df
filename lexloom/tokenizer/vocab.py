"""Byte-level vocabulary: ids 0-255 are bytes, then the specials, then one id per merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

# Ids of the special tokens, in order from 256.
SPECIALS = ("<PAD>", "<BOS>", "<EOS>", "<UNK>", "<USER>", "<ASSISTANT>", "<SYSTEM>", "<TOOL>", "<THINK>", "<END_THINK>", "<CODE>", "<END_CODE>")
BYTE_IDS = 256
SPECIAL_TO_ID = {s: BYTE_IDS + i for i, s in enumerate(SPECIALS)}
FIRST_MERGE_ID = BYTE_IDS + len(SPECIALS)
PAD, BOS, EOS, UNK = (SPECIAL_TO_ID[s] for s in SPECIALS[:4])
IGNORE = -100
#: A merge table larger than this is refused by readers that bring it to the driver.
MAX_MERGES = 1_000_000

Merges = tuple[tuple[int, int], ...]


def read_merges(df: DataFrame) -> Merges:
    """The merges of a ``merge_rank, left_id, right_id`` table in rank order; its size is checked before it is collected."""
    rows = df.select("merge_rank", "left_id", "right_id").limit(MAX_MERGES + 1).collect()
    if len(rows) > MAX_MERGES:
        raise ValueError(f"more than {MAX_MERGES} merges")
    return tuple((r.left_id, r.right_id) for r in sorted(rows, key=lambda r: r.merge_rank))


def id_to_bytes(merges: Sequence[tuple[int, int]]) -> dict[int, bytes]:
    """What each id stands for; specials stand for their own spelling."""
    table = {i: bytes([i]) for i in range(BYTE_IDS)}
    table |= {i: s.encode() for s, i in SPECIAL_TO_ID.items()}
    for rank, (a, b) in enumerate(merges):
        table[FIRST_MERGE_ID + rank] = table[a] + table[b]
    return table


def vocab_document(merges: Sequence[tuple[int, int]]) -> dict:
    """The description that is stored beside the merges."""
    return {"version": 1, "num_byte_tokens": BYTE_IDS, "special_tokens": dict(SPECIAL_TO_ID), "vocab_size": FIRST_MERGE_ID + len(merges), "num_merges": len(merges)}


def token_name(i: int, merges: Sequence[tuple[int, int]]) -> str:
    """Printable form of an id: ``<0xNN>`` for bytes, the special's name, the text of a merge, ``<UNK>`` beyond."""
    if 0 <= i < BYTE_IDS:
        return f"<0x{i:02X}>"
    table = id_to_bytes(merges)
    return table[i].decode(errors="replace") if i in table else "<UNK>"
