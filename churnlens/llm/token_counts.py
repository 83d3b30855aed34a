"""Token counts by rank-synchronous array merging.

All pre-tokens of a batch lie in one ragged NumPy array.  In each round every sequence finds
its lowest-rank pair, all sequences apply theirs at the same time, and the array is closed up;
sequences without a mergeable pair leave it with their number of surviving symbols.
"""

from __future__ import annotations

import json
import re

import numpy as np
import regex
from pyspark.sql import DataFrame

from .frames import map_batches, texts_of
from .pretokens import Remembered, blocks, checked, looked_up, match_pieces

NONE = np.int32(2**31 - 1)


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself
    if printable in Latin-1, else the next free code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class MergeTable:
    """Pair of ids -> (rank, merged id), from sorted keys."""

    def __init__(self, lefts, rights, ranks, merged, n_ids: int, byte_ids: np.ndarray):
        key = np.asarray(lefts, np.int64) * n_ids + np.asarray(rights, np.int64)
        order = np.argsort(key)
        self.key = np.append(key[order], np.iinfo(np.int64).max)
        self.rank = np.append(np.asarray(ranks, np.int32)[order], NONE)
        self.n_ids, self.byte_ids = n_ids, byte_ids
        self.merged = np.zeros(int(max(ranks, default=0)) + 1, np.int32)
        self.merged[np.asarray(ranks, np.int64)] = merged
        pair = np.arange(65536)
        self._bytes = self._find(byte_ids[pair >> 8], byte_ids[pair & 255])

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.n_ids + right
        at = np.searchsorted(self.key, key)
        return np.where(self.key[at] == key, self.rank[at], NONE)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self._find(left, right)

    def byte_ranks(self, raw: np.ndarray) -> np.ndarray:
        """Ranks of the neighbouring pairs of raw bytes (one less than bytes)."""
        return self._bytes[(raw[:-1].astype(np.int64) << 8) | raw[1:]]


def alternate(hit: np.ndarray) -> np.ndarray:
    """In each run of neighbouring hits keep the first, third, ...: overlapping pairs of one
    rank merge from the left."""
    if not (hit[1:] & hit[:-1]).any():
        return hit
    at = np.flatnonzero(hit)
    start = np.r_[True, np.diff(at) > 1]
    run_first = np.maximum.accumulate(np.where(start, np.arange(at.size), 0))
    out = np.zeros_like(hit)
    out[at[(np.arange(at.size) - run_first) % 2 == 0]] = True
    return out


def surviving(tokens: list[bytes], table: MergeTable) -> np.ndarray:
    """Number of symbols left of each byte string once no pair can merge."""
    left = np.fromiter(map(len, tokens), np.int64, len(tokens))
    raw = np.frombuffer(b"".join(tokens), np.uint8)
    if raw.size < 2:
        return left
    sym = table.byte_ids[raw]
    seq = np.repeat(np.arange(len(tokens)), left)
    rank = np.append(table.byte_ranks(raw), NONE)
    rank[np.append(seq[1:] != seq[:-1], True)] = NONE  # the last symbol of a sequence pairs with nothing
    while sym.size:
        first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        lowest = np.minimum.reduceat(rank, first)
        size = np.diff(np.append(first, sym.size))
        left[seq[first]] = size
        alive = lowest < NONE
        if not alive.all():  # finished sequences leave the arrays
            keep = np.repeat(alive, size)
            sym, seq, rank = sym[keep], seq[keep], rank[keep]
            lowest, size = lowest[alive], size[alive]
            if not sym.size:
                break
        hit = alternate(rank == np.repeat(lowest, size))
        at = np.flatnonzero(hit)
        sym[at] = table.merged[rank[at]]
        keep = np.ones(sym.size, bool)
        keep[at + 1] = False
        sym, seq, rank = sym[keep], seq[keep], rank[keep]
        at -= np.arange(at.size)  # where the merged symbols are now
        changed = np.zeros(sym.size, bool)
        changed[at] = True
        changed[at[at > 0] - 1] = True
        changed[-1] = False
        rank[-1] = NONE
        touched = np.flatnonzero(changed)
        found = table.ranks_of(sym[touched], sym[touched + 1])
        rank[touched] = np.where(seq[touched] == seq[touched + 1], found, NONE)
    return left


class _Counter:
    """Counts tokens of texts by a byte-level BPE description (the bytes of a tokenizer JSON)."""

    def __init__(self, description: bytes, pattern: str):
        told = json.loads(description)
        vocab, merges = told["model"]["vocab"], told["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        letters = byte_letters()
        byte_ids = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        n = max(vocab.values()) + 1
        self.table = MergeTable([vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs],
                                range(len(pairs)), [vocab[a + b] for a, b in pairs], n, byte_ids)
        added = sorted((t["content"] for t in told.get("added_tokens", [])), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.pattern = regex.compile(checked(pattern))
        self.known = Remembered(self.solve)

    def solve(self, new: set[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        ordered, tokens, first = match_pieces(new, self.pattern)
        distinct = {t: k for k, t in enumerate(dict.fromkeys(tokens))}
        counts = surviving([t.encode() for t in distinct], self.table)
        per = counts[np.fromiter(map(distinct.__getitem__, tokens), np.int64, len(tokens))]
        sums = np.diff(np.append(0, np.cumsum(per))[first])
        return ordered, sums.astype(np.int32), np.ones(len(ordered), np.int32)

    def segments(self, texts: list[str]) -> tuple[list[int], list[int], list[str]]:
        """Special strings in each text; what lies between them, with the index of its text."""
        special, owner, parts = [0] * len(texts), [], []
        for k, text in enumerate(texts):
            cut = self.added.split(text) if self.added else [text]
            special[k] = len(cut) - 1
            owner += [k] * len(cut)
            parts += cut
        return special, owner, parts

    def counts(self, texts: list[str]) -> list[int]:
        out, owner, parts = self.segments(texts)
        for a, b in blocks(parts):
            for k, rows in looked_up(parts[a:b], self.known):
                out[owner[a + k]] += int(self.known.values[rows].sum())
        return out


_COUNTERS: dict[tuple[int, str], _Counter] = {}


def counter(description: bytes, pattern: str) -> _Counter:
    key = (hash(description), pattern)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = _Counter(description, pattern)
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, description_path: str, pattern: str, id_col: str = "doc_id",
                 text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_tokens``, ``over_limit`` (n_tokens > limit).

    ``description_path`` is a byte-level BPE tokenizer in JSON; it is read on the driver and
    sent to the tasks once (its size is that of the vocabulary, whatever the corpus).  A null
    text counts as empty: 0 bytes, 0 tokens.  Special strings in a text count as one token
    each, as the description's library does by default.  Null ids and repeated rows are kept
    as they are; other columns are ignored, whatever their names.  No shuffle.
    """
    checked(pattern)
    with open(description_path, "rb") as f:
        told = docs.sparkSession.sparkContext.broadcast(f.read())

    def work(batch):
        texts = texts_of(batch, "_text")
        n = counter(told.value, pattern).counts(texts)
        yield {"_id": batch.column("_id"), "n_bytes": [len(t.encode()) for t in texts],
               "n_tokens": n, "over_limit": [k > limit for k in n]}

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    out = map_batches(slim, f"_id {kind}, n_bytes long, n_tokens long, over_limit boolean", work)
    return out.withColumnRenamed("_id", id_col)
