"""Byte-level BPE encoding by merge replay over a corpus block, and decoding.

A block is the distinct pre-tokens of a run of texts that the worker has not met before.
All their bytes are symbols of one linked list.  An inverted index maps the rank of a pair to
the positions where that pair stands; the ranks are replayed in ascending order, each applied
at all its positions at once, and only the pairs at both sides of a merge are looked up anew
and entered in the index.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import map_batches, texts_of
from .pretokens import Remembered, blocks, checked, looked_up, match_pieces, ragged
from .token_counts import NONE, MergeTable, alternate


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """Lines of a base64 token and its rank."""
    return {base64.b64decode(t): int(r) for t, r in map(bytes.split, raw.splitlines()) if t}


def merge_table(ranks: dict[bytes, int]) -> MergeTable:
    """Every way to cut a token into two tokens is a pair that may merge at its rank."""
    found = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t))
             if t[:k] in ranks and t[k:] in ranks]
    left, right, rank = (np.array(x, np.int64) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 3
    byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    return MergeTable(left, right, rank, rank.astype(np.int32), max(ranks.values()) + 1, byte_ids)


def one_by_one(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The definition: merge the leftmost pair of lowest rank until none is left."""
    parts = [token[k:k + 1] for k in range(len(token))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, NONE), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == NONE:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def replay(tokens: list[bytes], table: MergeTable, ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all tokens one after another, and the number of ids of each token."""
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    raw = np.frombuffer(b"".join(tokens), np.uint8)
    n = raw.size
    if not n:
        return np.zeros(0, np.int32), size
    word = np.repeat(np.arange(len(tokens), dtype=np.int32), size)
    sym = table.byte_ids[raw]
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    last = np.append(word[1:] != word[:-1], True)
    after[last], before[np.roll(last, 1)] = -1, -1
    rank = np.append(table.byte_ranks(raw), NONE)
    rank[last] = NONE

    index: dict[int, list[np.ndarray]] = {}

    def enter(at: np.ndarray, found: np.ndarray) -> None:
        order = np.argsort(found, kind="stable")
        at, found = at[order], found[order]
        cut = np.flatnonzero(found[1:] != found[:-1]) + 1
        starts = [0, *cut.tolist(), found.size]
        for k, r in enumerate(found[starts[:-1]].tolist()):
            part = at[starts[k]:starts[k + 1]]
            if r in index:
                index[r].append(part)
            else:
                index[r] = [part]
                heapq.heappush(queue, r)

    queue: list[int] = []
    open_pairs = np.flatnonzero(rank < NONE).astype(np.int32)
    if open_pairs.size:
        enter(open_pairs, rank[open_pairs])
    odd: set[int] = set()
    while queue:
        r = heapq.heappop(queue)
        held = index.pop(r)
        at = held[0] if len(held) == 1 else np.concatenate(held)
        at = at[rank[at] == r]
        if at.size > 1:
            at = np.sort(at)
            at = at[np.append(True, at[1:] != at[:-1])]
            touching = after[at[:-1]] == at[1:]
            if touching.any():  # overlapping pairs merge from the left
                slot = np.arange(at.size) + np.append(0, np.cumsum(~touching))
                hit = np.zeros(int(slot[-1]) + 1, bool)
                hit[slot] = True
                at = at[alternate(hit)[slot]]
        elif not at.size:
            continue
        gone = after[at]
        nxt = after[gone]
        sym[at], after[at] = table.merged[r], nxt
        rank[gone] = rank[at] = NONE
        has_next = nxt >= 0
        before[nxt[has_next]] = at[has_next]
        prev = before[at]
        near = np.concatenate([at[has_next], prev[prev >= 0]])
        if not near.size:
            continue
        found = table.ranks_of(sym[near], sym[after[near]])
        rank[near] = found
        can = found < NONE
        if can.any():
            near, found = near[can], found[can]
            if (found <= r).any():  # a merge opened an earlier one: such words are done one by one
                odd.update(word[near[found <= r]].tolist())
            enter(near, found)
    alive = reached(after, before, last)
    ids, counts = sym[alive], np.bincount(word[alive], minlength=len(tokens))
    if odd:
        cut = np.append(0, np.cumsum(counts))
        parts = [one_by_one(tokens[k], ranks) if k in odd else ids[cut[k]:cut[k + 1]]
                 for k in range(len(tokens))]
        ids, counts = np.concatenate(parts).astype(np.int32), np.array([len(p) for p in parts])
    return ids, counts


def reached(after: np.ndarray, before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Positions still in the linked list: first of a word, or named by their predecessor."""
    first = np.roll(last, 1)
    back = np.where(before >= 0, before, 0)
    return first | ((before >= 0) & (after[back] == np.arange(after.size)))


class _Coder:
    def __init__(self, raw: bytes, pattern: str):
        self.ranks = parse_ranks(raw)
        self.table = merge_table(self.ranks)
        self.pattern = regex.compile(checked(pattern))
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.known = Remembered(self.solve)

    def solve(self, new: set[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        ordered, tokens, first = match_pieces(new, self.pattern)
        distinct = {t: k for k, t in enumerate(dict.fromkeys(tokens))}
        ids, counts = replay([t.encode() for t in distinct], self.table, self.ranks)
        rows = np.fromiter(map(distinct.__getitem__, tokens), np.int64, len(tokens))
        sizes = np.diff(np.append(0, np.cumsum(counts[rows]))[first])
        return ordered, ragged(ids, np.cumsum(counts) - counts, counts, rows), sizes.astype(np.int32)

    def ids(self, texts: list[str]) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        """Ids of each of the texts a..b, block by block."""
        for a, b in blocks(texts):
            out: list[list[np.ndarray]] = [[] for _ in range(a, b)]
            for k, rows in looked_up(texts[a:b], self.known):
                out[k].append(self.known.gather(rows))
            yield a, b, [np.concatenate(x) if x else np.zeros(0, np.int32) for x in out]


_CODERS: dict[tuple[int, str], _Coder] = {}


def coder(raw: bytes, pattern: str) -> _Coder:
    key = (hash(raw), pattern)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = _Coder(raw, pattern)
    return _CODERS[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One row per document: its id and ``ids array<int>``, the tokens of its whole text.

    ``ranks_path`` holds one base64 token and rank a line; it is read on the driver and sent to
    the tasks once (its size is that of the vocabulary).  A null or empty text has no ids.
    Null ids and repeated rows are kept; other columns are ignored, whatever their names.  No
    shuffle; each run of texts is replayed as one block and words met before are remembered.
    """
    checked(pattern)
    with open(ranks_path, "rb") as f:
        told = docs.sparkSession.sparkContext.broadcast(f.read())

    def work(batch):
        for a, b, ids in coder(told.value, pattern).ids(texts_of(batch, "_text")):
            cut = np.append(0, np.cumsum([x.size for x in ids])).astype(np.int32)
            yield {"_id": batch.column("_id").slice(a, b - a),
                   "ids": pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(ids)))}

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    return map_batches(slim, f"_id {kind}, ids array<int>", work).withColumnRenamed("_id", id_col)


def _decoded(ids: np.ndarray, cut: np.ndarray, raw: bytes) -> pa.Array:
    """The bytes of each run of ids; ``cut`` are the ends of the runs, from 0."""
    flat, starts, sizes = token_bytes(raw)
    ends = np.append(0, np.cumsum(sizes[ids]))  # bytes up to each id
    return pa.Array.from_buffers(pa.binary(), cut.size - 1, [
        None, pa.py_buffer(ends[cut].astype(np.int32)), pa.py_buffer(ragged(flat, starts, sizes, ids))])


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``encoded`` (id, ids) with ``decoded binary``, the bytes of their ids.  Null
    ids decode to no bytes; an id outside the vocabulary fails."""
    with open(ranks_path, "rb") as f:
        told = encoded.sparkSession.sparkContext.broadcast(f.read())

    def work(batch):
        column = batch.column("ids")
        for a in range(0, len(column), 256):
            part = column.slice(a, 256)
            cut = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(part), 0).to_numpy()))
            yield {"_id": batch.column("_id").slice(a, 256), "ids": part,
                   "decoded": _decoded(part.flatten().to_numpy(), cut, told.value)}

    kind = encoded.schema[id_col].dataType.simpleString()
    slim = encoded.select(encoded[id_col].alias("_id"), encoded["ids"])
    out = map_batches(slim, f"_id {kind}, ids array<int>, decoded binary", work)
    return out.withColumnRenamed("_id", id_col)


_BYTES: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def token_bytes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens by rank in one array, with the start and the size of each."""
    if hash(raw) not in _BYTES:
        ranks = parse_ranks(raw)
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        sizes[list(ranks.values())] = [len(t) for t in ranks]
        flat = np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), np.uint8)
        _BYTES.clear()
        _BYTES[hash(raw)] = flat, np.cumsum(sizes) - sizes, sizes
    return _BYTES[hash(raw)]


def digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """Per document: id, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by a space)
    and ``decoded_sha256`` (of the bytes that the ids decode to).  Texts are encoded and their ids
    decoded in one pass, by one worker a task."""
    checked(pattern)
    with open(ranks_path, "rb") as f:
        told = docs.sparkSession.sparkContext.broadcast(f.read())

    def work(batch):
        for a, b, ids in coder(told.value, pattern).ids(texts_of(batch, "_text")):
            cut, flat = np.append(0, np.cumsum([x.size for x in ids])).astype(np.int32), np.concatenate(ids)
            yield {"_id": batch.column("_id").slice(a, b - a), "ids": pa.ListArray.from_arrays(pa.array(cut), pa.array(flat)),
                   "decoded": _decoded(flat, cut, told.value)}

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    done = map_batches(slim, f"_id {kind}, ids array<int>, decoded binary", work).withColumnRenamed("_id", id_col)
    return done.select(
        done[id_col], F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
