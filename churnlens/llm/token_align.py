"""Alignment of the tokens of two tokenizers, by anchors at white space.

Every text is tokenised whole by both.  An end that a token of each side shares, and after which
both sides go on with a token that carries a space mark, is an anchor; anchors cut the text into
windows of token ids, mostly one word long.  A window is aligned once: its groups and links are
remembered by its two id tuples, so a word that returns costs one look-up.

A group is what lies between two neighbouring byte offsets at which tokens of both sides end; a
link joins the two tokens that end together there.  (No token is empty, so a group has one link.)

The number of texts that link two ids is summed over all texts.  Of two linked tokens one's bytes
are the end of the other's, so the vocabularies alone bound that table: :func:`most_pairs`.

Null and empty texts, and texts that one of the tokenizers does not give back byte for byte, have
no tokens.  Rows with repeated or null ids count singly; further columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import map_batches, slices, stored, texts_of
from .token_counts import byte_letters

#: Windows that a worker remembers; beyond it, it forgets them all and goes on.
REMEMBERED = 200_000
#: Characters that are tokenised at once, or one longer text.
AT_ONCE = 1 << 20
#: What a piece of the second vocabulary has in place of a space.
SPACE = "▁"


def entry_bytes(description: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; an added token stands for its own text."""
    letters = {c: b for b, c in byte_letters().items()}
    found = json.loads(description)
    entries = {i: bytes(letters[c] for c in entry) for entry, i in found["model"]["vocab"].items()}
    entries |= {t["id"]: t["content"].encode() for t in found["added_tokens"]}
    return [entries.get(i, b"") for i in range(max(entries) + 1)]


def merged_ranks(description: str) -> dict[bytes, int]:
    """Bytes -> id of the single bytes and of what the merges of a byte-level vocabulary make."""
    found = json.loads(description)["model"]
    letters = byte_letters()
    alphabet = {c: b for b, c in letters.items()}
    made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in found["merges"]]
    return {bytes(map(alphabet.__getitem__, entry)): found["vocab"][entry] for entry in [*letters.values(), *made]}


def rank_order(description: str) -> bool:
    """Whether merging the lowest id of :func:`merged_ranks` first gives the tokens that the merges of
    a byte-level vocabulary give.

    It does if the merges are in the order of the ids they make and turn the spelling of each
    merged entry into that entry alone.  For then no two neighbours that the merges leave apart
    spell an entry: nothing else has crossed their outer ends so far, so the entry's own spelling
    would be left in these two as well.  By induction over the ids, both ways make the same merges."""
    from tokenizers import Tokenizer

    found = json.loads(description)
    vocabulary, split = found["model"]["vocab"], found["pre_tokenizer"] or {}
    made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in found["model"]["merges"]]
    ids = [vocabulary[entry] for entry in made]
    if (found["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space")
            or not split.get("use_regex", True) or any(a >= b for a, b in zip(ids, ids[1:]))):
        return False
    whole = Tokenizer.from_str(json.dumps(found | {"pre_tokenizer": None, "post_processor": None, "added_tokens": []}))
    if any(e.ids != [i] for e, i in zip(whole.encode_batch_fast(made, add_special_tokens=False), ids)):
        return False
    return all(vocabulary[c] < ids[0] for c in byte_letters().values())


def piece_bytes(model) -> list[bytes]:
    """The bytes of each id of a piece vocabulary."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode()
            for i, p in enumerate(pieces)]


def most_pairs(a: list[bytes], b: list[bytes]) -> int:
    """How many pairs of ids can be linked at all: one's bytes end with the other's."""
    def ends(one, other):
        ids = {}
        for x in other:
            ids[x] = ids.get(x, 0) + 1
        return sum(ids.get(x[k:], 0) for x in one for k in range(len(x)))
    return ends(a, b) + ends(b, a)


class _Side:
    """One tokenizer: ``encode`` gives the ids of texts as arrays, the rest is by id.  ``faithful``: its
    tokens are stretches of the text in turn, so that only their length can be wanting."""

    def __init__(self, entries: list[bytes], encode, faithful: bool = False):
        self.entries, self.encode, self.faithful = entries, encode, faithful
        self.size = np.fromiter(map(len, entries), np.int64, len(entries))
        self.sizes, self.decimal = self.size.tolist(), list(map(str, range(len(entries))))
        self.marked = np.fromiter((e[:1] == b" " for e in entries), bool, len(entries))

    def gives(self, ids: np.ndarray, whole: bytes) -> bool:
        """Whether the tokens spell ``whole``."""
        return self.size[ids].sum() == len(whole) and (
            self.faithful or b"".join(map(self.entries.__getitem__, ids.tolist())) == whole)


def _ids(found: list[int]) -> np.ndarray:
    return np.frombuffer(array("i", found), np.int32)


def _sides(description: str, model: bytes, pattern: str | None) -> tuple[_Side, _Side]:
    import sentencepiece
    second = sentencepiece.SentencePieceProcessor(model_proto=model)
    if pattern is None:
        from tokenizers import Tokenizer
        library = Tokenizer.from_str(description)
        library.encode_special_tokens = True  # their strings in a text are ordinary text

        def first(text):
            return _ids(library.encode(text, add_special_tokens=False).ids)
    else:
        import tiktoken
        ranked = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merged_ranks(description), special_tokens={})

        def first(text):
            return ranked.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
    return (_Side(entry_bytes(description), lambda texts: [first(" " + t) for t in texts], pattern is not None),
            _Side(piece_bytes(second), lambda texts: [_ids(x) for x in second.encode(texts, num_threads=1)]))


class Aligner:
    """Aligns texts in blocks and remembers windows.  ``pattern`` is None where the first
    tokenizer's own library has to encode."""

    def __init__(self, description: str, model: bytes, pattern: str | None = None):
        self.a, self.b = _sides(description, model, pattern)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.written: list[str] = []
        self.codes: list[bytes] = []

    def window(self, key: bytes) -> int:
        """The number of a window, given the ids of the first side and then of the second (which
        follow on those of the first): its groups as text and the codes of its linked pairs are
        remembered under it."""
        found = self.known.get(key)
        if found is None:
            text_a, text_b, size_a, size_b = self.a.decimal, self.b.decimal, self.a.sizes, self.b.sizes
            shift, wide = len(size_a), len(size_b)
            ids = array("i", key)
            rest = iter([x - shift for x in ids if x >= shift])
            written, codes, ids_a, ids_b, at_a, at_b, b = [], [], [], [], 0, 0, 0
            for a in ids:
                if a >= shift:
                    break
                at_a += size_a[a]
                ids_a.append(text_a[a])
                while at_b < at_a:
                    b = next(rest)
                    at_b += size_b[b]
                    ids_b.append(text_b[b])
                if at_a == at_b:
                    written.append(f"{','.join(ids_a)}|{','.join(ids_b)}")
                    codes.append(a * wide + b)
                    ids_a, ids_b = [], []
            found = self.known[key] = len(self.written)
            self.written.append(";".join(written))
            self.codes.append(array("q", codes).tobytes())
        return found

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of both sides of each text; none where a side does not give the text back."""
        out, none = [], np.zeros(0, np.int32)
        for text, a, b in zip(texts, self.a.encode(texts), self.b.encode(texts)):
            whole = (" " + text).encode()
            kept = text and self.a.gives(a, whole) and self.b.gives(b, whole)
            out.append((a, b) if kept else (none, none))
        return out

    def windows(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """The windows of one text in turn."""
        if not a.size:
            return []
        ends_a, ends_b = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        both = np.zeros(ends_a[-1] + 1, bool)
        # a token ends here and the next one carries a space mark, on the one side and on the other
        both[ends_b[:-1][self.b.marked[b[1:]]]] = True
        at_a = np.flatnonzero(self.a.marked[a[1:]])
        at_a = at_a[both[ends_a[at_a]]]
        cut_a = np.concatenate([[0], at_a + 1, [a.size]])
        cut_b = np.concatenate([[0], np.searchsorted(ends_b, ends_a[at_a]) + 1, [b.size]])
        # the ids of a window side by side
        ids = np.empty(a.size + b.size, np.int32)
        ids[np.arange(a.size) + np.repeat(cut_b[:-1], np.diff(cut_a))] = a
        ids[np.arange(b.size) + np.repeat(cut_a[1:], np.diff(cut_b))] = b + len(self.a.sizes)
        raw, cut = ids.tobytes(), (4 * (cut_a + cut_b)).tolist()
        if len(self.known) > REMEMBERED:
            self.forget()
        keys = [raw[i:j] for i, j in zip(cut, cut[1:])]
        found = list(map(self.known.get, keys))
        return [self.window(key) if at is None else at for key, at in zip(keys, found)]


_ALIGNERS: dict[tuple, Aligner] = {}


def _aligner(description: str, model: bytes, pattern: str | None) -> Aligner:
    """One for all tasks of a worker, so that it is made once and what it remembers serves them all."""
    key = (hash(description), hash(model), pattern)
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(description, model, pattern)
    return _ALIGNERS[key]


def _packed(codes: bytes) -> bytes:
    """Codes in order, compressed."""
    return pa.compress(np.sort(np.frombuffer(codes, "<i8")).tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    return np.frombuffer(pa.decompress(raw, decompressed_size=8 * n, codec="zstd"), "<i8")


def aligned(docs: DataFrame, description_path: str, model_path: str, id_col: str = "doc_id",
            text_col: str = "text", digest: bool = False, pattern: str | None = None) -> DataFrame:
    """Per document: id, n_a, n_b (tokens), n_groups, n_links, ``groups`` (written as
    ``a1,a2|b1;a3|b2,b3``; with ``digest`` the SHA-256 of that, empty without tokens), and its
    linked id pairs packed, for :func:`pair_counts` and :func:`with_counts`.

    ``pattern`` is the one by which the first tokenizer splits texts; where it is given and
    :func:`rank_order` holds, texts are encoded by ranks, with the same ids in a fifth of the time."""
    with open(description_path, encoding="utf-8") as f:
        description = f.read()
    with open(model_path, "rb") as f:
        model = f.read()
    if pattern is not None and not rank_order(description):
        pattern = None
    told = docs.sparkSession.sparkContext.broadcast((description, model, pattern))

    def work(batch: pa.RecordBatch):
        own, texts = _aligner(*told.value), texts_of(batch, "_text")
        out = {name: [] for name in ("n_a", "n_b", "n_groups", "groups", "pairs")}
        start = 0
        while start < len(texts):
            stop, size = start + 1, len(texts[start])
            while stop < len(texts) and size + len(texts[stop]) <= AT_ONCE:
                size += len(texts[stop])
                stop += 1
            for a, b in own.tokens(texts[start:stop]):
                found = own.windows(a, b)
                codes = b"".join(map(own.codes.__getitem__, found))
                groups = ";".join(map(own.written.__getitem__, found))
                out["n_a"].append(a.size)
                out["n_b"].append(b.size)
                out["n_groups"].append(len(codes) // 8)
                out["groups"].append(hashlib.sha256(groups.encode()).hexdigest() if digest and found else groups)
                out["pairs"].append(_packed(codes) if found else b"")
            start = stop
        yield {"id": batch.column("id"), "n_a": pa.array(out["n_a"], pa.int64()), "n_b": pa.array(out["n_b"], pa.int64()),
               "n_groups": pa.array(out["n_groups"], pa.int64()), "n_links": pa.array(out["n_groups"], pa.int64()),
               "groups": pa.array(out["groups"], pa.string()), "pairs": pa.array(out["pairs"], pa.binary())}

    id_type = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    return map_batches(narrow, f"id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups string, "
                               "pairs binary", work)


def pair_counts(found: DataFrame, n_b_ids: int) -> DataFrame:
    """(a_id, b_id, n): how many links of all documents of :func:`aligned` join the two ids."""
    def run(batches):
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:  # what a task holds is bounded by most_pairs, whatever its rows
            for part in slices(batch):
                rows = zip(part.column("pairs").to_pylist(), part.column("n_links").to_pylist())
                found, times = np.unique(np.concatenate([_unpacked(*row) for row in rows]), return_counts=True)
                codes, place = np.unique(np.concatenate([codes, found]), return_inverse=True)
                counts = np.bincount(place, weights=np.concatenate([counts, times]), minlength=codes.size).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"code": pa.array(codes, pa.int64()), "n": pa.array(counts, pa.int64())})
    return (found.select("pairs", "n_links").mapInArrow(run, "code long, n long")
            .groupBy("code").agg(F.sum("n").alias("n"))
            .selectExpr(f"code div {n_b_ids} AS a_id", f"code % {n_b_ids} AS b_id", "n"))


def with_counts(found: DataFrame, counts: DataFrame, n_b_ids: int, most: int) -> DataFrame:
    """``found`` of :func:`aligned` with n_best (links whose count is the highest of their second
    id, ties included) and count_sum (of the counts of all links) in place of the packed pairs.

    ``counts`` goes to every task: it has at most ``most`` rows (:func:`most_pairs`), whatever the
    number of documents."""
    table = counts.selectExpr(f"a_id * {n_b_ids} + b_id AS code", "n", "b_id").limit(most + 1).toArrow()
    if table.num_rows > most:
        raise ValueError(f"more than {most} linked pairs")
    code, n, b = (table.column(name).to_numpy() for name in ("code", "n", "b_id"))
    order = np.argsort(code)
    code, n, b = code[order], n[order], b[order]
    top = np.zeros(n_b_ids, np.int64)
    np.maximum.at(top, b, n)
    shared = found.sparkSession.sparkContext.broadcast((code, n, n == top[b]))

    def work(batch: pa.RecordBatch):
        code, n, best = shared.value
        n_best, total = [], []
        for row in zip(batch.column("pairs").to_pylist(), batch.column("n_links").to_pylist()):
            at = np.searchsorted(code, _unpacked(*row))
            n_best.append(int(best[at].sum()) if at.size else 0)
            total.append(int(n[at].sum()) if at.size else 0)
        kept = {c: batch.column(c) for c in batch.schema.names if c != "pairs"}
        yield kept | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64())}

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name != "pairs")
    return map_batches(found, schema + ", n_best long, count_sum long", work)


def align_report(docs: DataFrame, description_path: str, model_path: str, id_col: str = "doc_id",
                 text_col: str = "text", pattern: str | None = None) -> DataFrame:
    """Per document the figures and the digest of its alignment, and how its links stand among
    all links of the corpus.  The alignment is stored once; texts are tokenised once."""
    import sentencepiece
    with open(description_path, encoding="utf-8") as f:
        a = entry_bytes(f.read())
    b = piece_bytes(sentencepiece.SentencePieceProcessor(model_file=model_path))
    found = stored(aligned(docs, description_path, model_path, id_col, text_col, True, pattern))
    out = with_counts(found, pair_counts(found, len(b)), len(b), most_pairs(a, b))
    return out.selectExpr(f"id AS `{id_col}`", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                          "groups AS groups_sha256")
