"""Fingerprints against plain Python: the edited texts, the ring of documents, likeness."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from conftest_llm import MEDIUM, by_id

from churnlens.llm import fingerprints, queries


def edited(text, following):
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def exact(a, b):
    """Generalised Jaccard similarity of word counts."""
    a, b = (Counter(t.encode().lower().split()) for t in (a, b))
    both = a.keys() | b.keys()
    return sum(min(a[w], b[w]) for w in both) / sum(max(a[w], b[w]) for w in both) if both else 1.0


def tie(spark, text):
    return spark.sql("SELECT xxhash64(:t) AS h", args={"t": text}).first().h


@pytest.mark.parametrize("rows_a_range", [4000, 2, 1])
def test_the_ring(spark, docs_of, monkeypatch, rows_a_range):
    monkeypatch.setattr(fingerprints, "ROWS_A_RANGE", rows_a_range)
    rows = [(5, "five one two three four"), (-3, "minus"), (9, "nine é😀 words and more words"), (0, ""), (2**62, "a large id"),
            (2**62 + 1, "a larger id"), (7, None), (8, "w " * 20_000), (5, "a second text of five"), (5, "third"), (5, "fourth of them"),
            (None, "null id one"), (None, "null id two"), (None, "null id three"), (6, "six"), (4, "four")]
    got = [(r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprints.compare_with_next(docs_of(rows)).collect()]
    texts = [(i, t or "") for i, t in rows]
    ring = sorted(texts, key=lambda x: (x[0] is None, -(x[0] or 0), tie(spark, x[1])))
    want = [(i, len(t), hashlib.sha256(edited(t, ring[(k + 1) % len(ring)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(ring)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_one_id_and_no_ids(docs_of, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_A_RANGE", 5)
    for i in (7, None):
        rows = [(i, f"text number {k} of the id") for k in range(40)] + [(i, "the same text")] * 30
        got = fingerprints.compare_with_next(docs_of(rows)).collect()
        assert len(got) == 70 and len({r.fingerprint for r in got}) == 41
        # a repeated row is followed by itself, but for the last of them
        assert sum(r.near_next == 1.0 for r in got) >= 29


def test_whole_table(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    got = by_id(queries.op7_weighted_sampling(spark, MEDIUM))
    ring = sorted(texts, reverse=True)
    assert got.keys() == texts.keys()
    off = []
    for k, i in enumerate(ring):
        following = texts[ring[(k + 1) % len(ring)]]
        changed, r = edited(texts[i], following), got[i]
        assert r.n_chars == len(texts[i]) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        off += [r.near_edited - exact(texts[i], changed), r.near_next - exact(texts[i], following)]
    mean = sum(off) / len(off)
    assert abs(mean) < 0.005 and sum(abs(x) for x in off) / len(off) < 0.05 and max(map(abs, off)) < 0.25
    by_text = {}
    for i, r in got.items():
        assert by_text.setdefault(texts[i], r.fingerprint) == r.fingerprint


def test_places_agree_as_often_as_the_weights():
    """The rate of agreement is the generalised Jaccard similarity, also where only counts differ."""
    rng = random.Random(11)
    for words, weight in ((40, 1), (40, 9), (5, 30), (300, 2)):
        off = []
        for k in range(60):
            a = [f"w{k}-{w}" for w in range(words) for _ in range(rng.randint(1, weight))]
            b = [w for w in a if rng.random() < 0.8] + [f"v{k}-{w}" for w in range(words // 5)]
            x, y = " ".join(a), " ".join(b)
            p, q = fingerprints.fingerprints([x, y])
            off.append(fingerprints.likeness(p, q) - exact(x, y))
        assert abs(sum(off) / len(off)) < 0.025, (words, weight)


def test_texts_without_words_and_empty_tables(docs_of):
    got = by_id(fingerprints.compare_with_next(docs_of([(2, ""), (1, " \n"), (0, "a")])))
    assert got[2].fingerprint == got[1].fingerprint == "" != got[0].fingerprint
    assert got[2].near_next == 1.0 and got[1].near_next == 0.0
    assert fingerprints.compare_with_next(docs_of([])).collect() == []
    one = fingerprints.compare_with_next(docs_of([(3, "abcdef")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1.0
