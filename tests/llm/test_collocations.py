"""Phrase collocations against plain counting, and the index against plain search."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest_llm import MEDIUM

from churnlens.llm import collocations, queries

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, most_words=5, top=2000):
    count, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(A_TO_Z)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for d in range(1, most_words + 1):
                count.update((lang, tuple(w[i:i + d])) for i in range(len(w) - d + 1))
    held = {k: a for k, a in count.items() if a >= least and len(k[1]) > 1}
    inside = set()
    for (lang, p), a in held.items():
        for d in range(2, len(p)):
            for i in range(len(p) - d + 1):
                if a >= count[lang, p[i:i + d]]:
                    inside.add((lang, p[i:i + d]))
    out = []
    for (lang, p), a in held.items():
        if (lang, p) in inside:
            continue
        cuts = []
        for k in range(1, len(p)):
            left, right = count[lang, p[:k]], count[lang, p[k:]]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, -score, -a, " ".join(p).encode(), left, right))
    out.sort()
    rank, rows = Counter(), []
    for lang, score, a, p, left, right in out:
        rank[lang] += 1
        if rank[lang] <= top:
            rows.append((lang, rank[lang], p.decode(), -a, left, right, n[lang], -score))
    return rows


TEXTS = [("en", "New York, new york! In New York City. new york city hall"), ("en", "a a a a a a a\ta  a"), ("en", None), (None, "x y z"),
         (None, "X Y z x y\nz"), ("und", "x y z"), ("de", "Äpfel äpfel ÄPFEL \x0b y z"), ("en", ""), ("en", " .,; "),
         ("en", "\x00 \x1c \x00 \x1c new york city hall new york city hall today"), ("fr", "seul")] * 2


def made(docs_of, rows):
    return docs_of([(k, text, lang) for k, (lang, text) in enumerate(rows)])


@pytest.mark.parametrize("least,shard", [(2, 10**6), (3, 7), (1, 1), (4, 15)])
def test_equals_plain_counting(docs_of, monkeypatch, least, shard):
    monkeypatch.setattr(collocations, "SHARD", shard)
    monkeypatch.setattr(collocations, "WORDS_A_RANGE", 20)
    got = [tuple(r) for r in collocations.collocations(made(docs_of, TEXTS), least).collect()]
    assert sorted(got) == sorted(plain(TEXTS, least)) and got


def test_top_and_shorter_phrases(docs_of):
    got = collocations.collocations(made(docs_of, TEXTS), 2, most_words=3, top=2).collect()
    assert sorted(map(tuple, got)) == sorted(plain(TEXTS, 2, 3, 2))
    pairs = collocations.collocations(made(docs_of, TEXTS), 2, most_words=2).collect()
    assert sorted(map(tuple, pairs)) == sorted(plain(TEXTS, 2, 2))


def test_whole_table_and_sql(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()]
    query = queries.op13_phrase_index(spark, MEDIUM)
    got = sorted(map(tuple, query.collect()))
    assert got == sorted(plain(rows, 100)) and len(got) > 50
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{MEDIUM}/documents.parquet'")
    sql = con.execute(queries.ORACLE["op13_phrase_index"])
    assert [c[0] for c in sql.description] == query.columns and sorted(sql.fetchall()) == got


def test_products_beyond_64_bits(spark):
    from decimal import Decimal
    a, n, left, right = 10**13, 3 * 10**16, 2 * 10**13, 10**13 + 7
    row = spark.sql(f"SELECT CAST(1000 * {a}L AS DECIMAL(19, 0)) * CAST({n}L AS DECIMAL(18, 0)) div "
                    f"(CAST({left}L AS DECIMAL(18, 0)) * CAST({right}L AS DECIMAL(18, 0))) AS score").first()
    assert row.score == 1000 * a * n // (left * right) and Decimal(1000 * a * n) > 2**63


def test_intervals_of_both_transforms():
    rng = np.random.default_rng(5)
    ids = np.append(0, rng.integers(0, 5, 400)).astype(np.int32)
    index = collocations.Index(collocations.transform(ids, 6), collocations.transform(ids[::-1], 6), 5)
    hashes = rng.integers(1, 2**63, 5).astype(np.uint64)
    found, text = index.single(hashes), ids.tolist()
    for d in range(1, 6):
        if d > 1:
            left, right = index.left(found), index.right(found)
            by_left = {(s, *found.words[o].tolist()): (a, b, n) for o, s, a, b, n in zip(*left)}
            by_right = {(*found.words[o].tolist(), s): (a, b, n) for o, s, b, a, n in zip(*right)}
            assert by_left == by_right
            found = index.longer(found, hashes)
        want = Counter(tuple(text[i:i + d]) for i in range(len(text) - d + 1))
        want = {p: n for p, n in want.items() if 0 not in p}
        assert {tuple(w): n for w, n in zip(found.words.tolist(), found.size.tolist())} == want


def test_long_text_is_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "SHARD", 4)
    found = collocations.tokens("a b c d e f. g h. i j k")
    parts = list(collocations.runs(found))
    assert [w for p in parts for w in p] == found and all(p[-1] == b"\n" for p in parts[:-1]) and len(parts) > 1


def test_empty_table(docs_of):
    assert collocations.collocations(docs_of([])).collect() == []
    assert collocations.collocations(docs_of([(1, None), (2, " ")])).collect() == []
