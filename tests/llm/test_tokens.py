"""Byte-level BPE against the public libraries, on texts that are hard to split."""

from __future__ import annotations

import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from churnlens.llm import bpe_replay, pretokens, token_counts

RANKS, DESCRIPTION = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "  ", "\n", " a", "a ", "a  b \n\n c", "don't I'll we've  'sx 'S", "x\x1cy \x1c z \x85 w 　v",
    "日本語テキスト １２３ ٣٤ ½", "a\tb \t c\r\n  d", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 9, "ababab ababa" * 20,
    "x" * 3000 + " " * 3000 + "!" * 500 + " \n" * 700, "😀😀 👩‍👩‍👧 é é naïve", "<|endoftext|> a<|endoftext|>b <|endoftext|>",
    "key=val;{json: [1,2,3]}\\n<html></html>", "Ünïcödé ñandú ça où", "the the the The THE", "   lead and trail   ",
]


def reference():
    with open(RANKS, "rb") as f:
        ranks = bpe_replay.parse_ranks(f.read())
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_digests_equal_the_library(spark, docs_of):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(900, None), (None, "null id"), (5, TEXTS[5])]
    enc = reference()
    got = sorted(bpe_replay.digests(docs_of(rows), RANKS, P.PATTERN).collect(), key=repr)
    want = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)


def test_round_trip(spark, docs_of):
    done = bpe_replay.decode(bpe_replay.encode(docs_of(list(enumerate(TEXTS))), RANKS, P.PATTERN), RANKS)
    assert {r.doc_id: bytes(r.decoded).decode() for r in done.collect()} == dict(enumerate(TEXTS))


def test_long_text_in_parts(monkeypatch):
    monkeypatch.setattr(pretokens, "PIECES_AT_ONCE", 50)
    monkeypatch.setattr(pretokens, "BLOCK_CHARS", 400)
    monkeypatch.setattr(pretokens, "REMEMBERED", 30)
    texts = [" ".join(TEXTS) * 3, "short", *TEXTS]
    with open(RANKS, "rb") as f:
        own = bpe_replay._Coder(f.read(), P.PATTERN)
    got = [x.tolist() for _, _, ids in own.ids(texts) for x in ids]
    assert got == [reference().encode_ordinary(t) for t in texts]


def test_a_merge_that_opens_an_earlier_one():
    """Ranks where replaying in order alone is wrong: such words are merged one by one."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"bc": 400, b"ab": 300, b"abab": 260, b"cab": 500}
    table = bpe_replay.merge_table(ranks)
    enc = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    tokens = [b"abc", b"abab", b"ababc", b"cabab", b"abcabcab", b"xaby", b"ababababcc", b"c"]
    ids, counts = bpe_replay.replay(tokens, table, ranks)
    cut = [0, *counts.cumsum().tolist()]
    assert [ids[a:b].tolist() for a, b in zip(cut, cut[1:])] == [enc.encode_ordinary(t.decode()) for t in tokens]
    assert [bpe_replay.one_by_one(t, ranks) for t in tokens] == [enc.encode_ordinary(t.decode()) for t in tokens]


def test_counts_equal_the_library(spark, docs_of):
    lib = Tokenizer.from_file(DESCRIPTION)
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(900, None), (3, TEXTS[3])]
    got = sorted(tuple(r) for r in token_counts.count_tokens(docs_of(rows), DESCRIPTION, P.PATTERN).collect())
    want = []
    for i, t in rows:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    assert got == sorted(want)


def test_whole_table_counts(spark, medium):
    lib = Tokenizer.from_file(DESCRIPTION)
    docs = medium[0]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, DESCRIPTION, P.PATTERN).collect()}
    rows = docs.select("doc_id", "text").collect()
    want = [len(e.ids) for e in lib.encode_batch([r.text for r in rows], add_special_tokens=False)]
    assert got == {r.doc_id: n for r, n in zip(rows, want)}


def test_other_patterns_are_refused(docs_of):
    """Cutting texts before white space holds for the given pattern; another would get wrong ids."""
    for run in (bpe_replay.encode, token_counts.count_tokens):
        with pytest.raises(ValueError, match="cannot be cut"):
            run(docs_of([(1, "a  b")]), RANKS if run is bpe_replay.encode else DESCRIPTION, r"\S+\s+|\s+\S+|\S+|\s+")
    assert pretokens.checked(P.PATTERN) == P.PATTERN


@pytest.mark.parametrize("run", [lambda d: bpe_replay.digests(d, RANKS, P.PATTERN),
                                 lambda d: token_counts.count_tokens(d, DESCRIPTION, P.PATTERN)])
def test_empty_table(docs_of, run):
    assert run(docs_of([])).collect() == []
