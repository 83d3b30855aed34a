"""Secret scans against Python's own regular expressions, and what the ledger spares."""

from __future__ import annotations

import dataclasses
import hashlib
import re

import duckdb
from conftest_llm import MEDIUM

from churnlens.llm import frames, queries, secret_ledger
from churnlens.llm.secret_ledger import BASE, MORE, RULES, Ledger

KEY, HEX = "AKIA" + "Z" * 12, "0123456789abcdef" * 2
TEXTS = ["", " ", "nothing here", f"password={HEX}", f"a {KEY} b {KEY}9 AKIA AKIAAAAA", f"é😀 PassWord : '{HEX}' 😀 {HEX}x{HEX}0",
         "password = token:abcdefghij", "secret=token=abcdefgh1", "api_key\" = \"abcd+/_.=-efgh\" apikey:short token:'12345678",
         "paſſword=abcdefgh toKen=abcdefgh", f"{KEY}{HEX}token={KEY}", "-----BEGIN RSA PRIVATE KEY-----\npasswd:xxxxxxxx",
         f"{HEX}\n{HEX}\r\n{KEY} {KEY}", "token" + " " * 5000 + "=abcdefgh", " ".join([f"token={HEX}"] * 3000),
         "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK"]


def plain(text, rules=RULES):
    found = []
    for k, r in enumerate(rules):
        for m in re.finditer(r.pattern, text or ""):
            if len(m.group(r.group)) >= r.least:
                found.append((m.start(), k, m.end(), r.name))
    return [f"{name}:{a}:{b}" for a, _, b, name in sorted(found)]


def row_of(i, text):
    base = plain(text, BASE)
    counts = tuple(sum(s.startswith(r.name + ":") for s in base) for r in BASE)
    return (i, *counts, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(plain(text)))


def test_equals_plain_matching(docs_of):
    rows = [*enumerate(TEXTS), (900, None), (None, TEXTS[4]), (5, TEXTS[4]), (5, TEXTS[4])]
    got = [tuple(r) for r in secret_ledger.fresh_report(docs_of(rows)).collect()]
    assert sorted(got, key=repr) == sorted([row_of(i, t) for i, t in rows], key=repr)
    assert row_of(0, TEXTS[6])[1] == 0 and row_of(0, TEXTS[7])[1] == 1


def test_whole_table_and_sql(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()]
    want = sorted(row_of(i, t) for i, t in docs)
    query = queries.op11_secret_ledger(spark, MEDIUM)
    assert sorted(tuple(r) for r in query.collect()) == want and any(r[1] for r in want)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{MEDIUM}/documents.parquet'")
    sql = con.execute(queries.ORACLE["op11_secret_ledger"])
    assert [c[0] for c in sql.description] == query.columns and sorted(sql.fetchall()) == want


def test_only_unseen_pairs_are_scanned(spark, docs_of):
    ledger = Ledger(spark, frames.shared_folder(spark))
    history = docs_of([(1, "old"), (2, TEXTS[3]), (3, TEXTS[3]), (4, TEXTS[4])])
    assert ledger.scan(history, BASE).count() == 3  # a copy is the same blob
    later = docs_of([(2, TEXTS[3]), (9, TEXTS[4]), (10, "new")])
    added = ledger.scan(later, BASE).collect()
    assert [r.blob for r in added] == [hashlib.sha256(b"new").hexdigest()]
    assert ledger.scan(later, BASE).count() == 0
    newer = (dataclasses.replace(BASE[0], least=4, version=2), *BASE[1:])
    added = ledger.scan(later, newer).collect()  # the one changed rule goes over the old blobs
    assert len(added) == 3 and {(x.rule, x.version) for r in added for x in r.rules} == {("assign", 2)}
    found = secret_ledger.findings(history.union(later), ledger, newer)
    want = sorted((i, *s.split(":")) for i, t in [(1, "old"), (2, TEXTS[3]), (3, TEXTS[3]), (4, TEXTS[4]), (2, TEXTS[3]),
                                                  (9, TEXTS[4]), (10, "new")] for s in plain(t, newer))
    assert sorted((r.doc_id, r.rule, str(r.start), str(r.end)) for r in found.collect()) == want


def test_a_batch_written_twice_does_no_harm(spark, docs_of):
    ledger = Ledger(spark, frames.shared_folder(spark))
    docs = docs_of([(1, TEXTS[3]), (2, TEXTS[4])])
    first = ledger.scan(docs)
    first.write.mode("append").parquet(ledger.path)
    assert sorted(tuple(r) for r in secret_ledger.report(docs, ledger).collect()) == [row_of(1, TEXTS[3]), row_of(2, TEXTS[4])]


def test_no_python_in_the_plan(spark, docs_of):
    plan = secret_ledger.fresh_report(docs_of([(1, "x")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(docs_of):
    assert secret_ledger.fresh_report(docs_of([])).collect() == []
    assert len(MORE) == 2
