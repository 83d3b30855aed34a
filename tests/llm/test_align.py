"""Alignment of two tokenizers against a plain one over byte offsets."""

from __future__ import annotations

import hashlib
import json
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from conftest_llm import MEDIUM, by_id
from tokenizers import Tokenizer

from churnlens.llm import queries, token_align

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXTS = ["", " ", "a", " a", "a  b \n\n c ", "don't  I'll we've", "日本語 テキスト 😀😀 é é", "x▁y ▁ z", "▁",
         "<|endoftext|> a<s>b</s> <unk> <0x0A>", "the the the The THE internationalisation antidisestablishment",
         "a\tb\r\n  d\x00\x01", "x" * 3000 + " " * 300 + "!" * 500 + "\n" * 700, "Ünïcödé ñandú ça où ½ ①",
         " ".join(f"word{k % 50} of{k % 7}" for k in range(3000))]


def plain(rows):
    """{id: figures} from byte offsets of every token, one text after another."""
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    with open(A, encoding="utf-8") as f:
        bytes_a = token_align.entry_bytes(f.read())
    out, links, counts = {}, {}, Counter()
    for i, text in rows:
        ids_a = first.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = second.encode(text or "")
        raw_b = [bytes([int(p[3:5], 16)]) if second.is_byte(k) else p.replace("▁", " ").encode()
                 for k, p in zip(ids_b, map(second.id_to_piece, ids_b))]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a[k] for k in ids_a) != whole or b"".join(raw_b) != whole:
            out[i], links[i] = (0, 0, 0, 0, ""), []
            continue
        ends_a, ends_b, at = {}, {}, 0
        for k, x in enumerate(ids_a):
            at += len(bytes_a[x])
            ends_a[at] = k
        at = 0
        for k, x in enumerate(raw_b):
            at += len(x)
            ends_b[at] = k
        cut = sorted(set(ends_a) & set(ends_b))
        links[i] = [(ids_a[ends_a[e]], ids_b[ends_b[e]]) for e in cut]
        groups, j, k = [], 0, 0
        for e in cut:
            groups.append("|".join((",".join(map(str, ids_a[j:ends_a[e] + 1])), ",".join(map(str, ids_b[k:ends_b[e] + 1])))))
            j, k = ends_a[e] + 1, ends_b[e] + 1
        counts.update(links[i])
        out[i] = (len(ids_a), len(ids_b), len(cut), len(cut), hashlib.sha256(";".join(groups).encode()).hexdigest())
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return {i: (*out[i][:4], sum(counts[x] == top[x[1]] for x in links[i]), sum(counts[x] for x in links[i]), out[i][4])
            for i in out}


def figures(row):
    return row.n_a, row.n_b, row.n_groups, row.n_links, row.n_best, row.count_sum, row.groups_sha256


@pytest.mark.parametrize("pattern", [None, P.PATTERN])
def test_equals_the_plain_alignment(docs_of, pattern):
    rows = [*enumerate(TEXTS), (900, None)]
    got = by_id(token_align.align_report(docs_of(rows), A, B, pattern=pattern))
    want = plain(rows)
    assert {i: figures(r) for i, r in got.items()} == want
    assert want[TEXTS.index("x▁y ▁ z")][0] == 0 < want[TEXTS.index("a  b \n\n c ")][0]


def test_repeated_and_null_ids(docs_of):
    rows = [(1, "the cat"), (1, "the cat"), (None, "a dog"), (1, "the dog")]
    got = sorted(figures(r) for r in token_align.align_report(docs_of(rows), A, B).collect())
    assert got == sorted(plain([(k, t) for k, (_, t) in enumerate(rows)]).values())


def test_whole_table(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    got = by_id(queries.op12_token_alignment(spark, MEDIUM))
    assert {i: figures(r) for i, r in got.items()} == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_groups_and_pairs(docs_of):
    found = token_align.aligned(docs_of([(1, "internationalisation"), (2, "")]), A, B)
    row = by_id(found, "id")
    assert row[2].groups == "" and row[1].groups.count("|") == row[1].n_groups
    n_b = sentencepiece.SentencePieceProcessor(model_file=B).get_piece_size()
    assert sum(r.n for r in token_align.pair_counts(found, n_b).collect()) == row[1].n_links


def test_windows_forgotten_in_between(monkeypatch):
    monkeypatch.setattr(token_align, "REMEMBERED", 3)
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        own = token_align.Aligner(f.read(), g.read())
    written = []
    for a, b in own.tokens(TEXTS):
        found = own.windows(a, b)
        written.append(hashlib.sha256(";".join(own.written[w] for w in found).encode()).hexdigest() if found else "")
    assert written == [v[-1] for v in plain(list(enumerate(TEXTS))).values()]


def test_ranks_in_place_of_merges():
    """The ids of the library, over characters of all kinds; a vocabulary out of order is refused."""
    with open(A, encoding="utf-8") as f:
        description = f.read()
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=token_align.merged_ranks(description), special_tokens={})
    assert token_align.rank_order(description)
    for c in range(3, 0x110000, 41):
        if not 0xD800 <= c < 0xE000:
            text = f" a{chr(c)}1{chr(c)}!{chr(c) * 2} {chr(c)} the"
            assert own.encode_ordinary(text) == first.encode(text, add_special_tokens=False).ids
    found = json.loads(description)
    found["model"]["merges"][:2] = found["model"]["merges"][1::-1]
    assert not token_align.rank_order(json.dumps(found))


def test_empty_table(docs_of):
    assert token_align.align_report(docs_of([]), A, B).collect() == []
