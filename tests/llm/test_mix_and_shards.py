"""Mixing, sharding and the corpus pipeline against plain Python."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

from conftest_llm import MEDIUM, SMALL, by_id

from churnlens.llm import mixing, sharding


def _words(text: str | None) -> int:
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets():
    assert mixing.targets({"a": 100, "b": 100, "c": 100}, (5, 2, 1), 3) == {"a": 187.5, "b": 75.0, "c": 37.5}
    capped = mixing.targets({"a": 10, "b": 100, None: 100}, (5, 2, 1), 3)
    assert capped["a"] == 30.0 and isinstance(capped["a"], float)
    assert abs(capped["b"] - 120) < 1e-9 and abs(capped[None] - 60) < 1e-9
    assert mixing.targets({}, (5, 2, 1), 3) == {}


def replayed(units, goal, most=3):
    """Copies taken of each unit, by a queue per source in plain Python.  ``units``: (source, h, id,
    text hash, words)."""
    taken, by_source = Counter(), defaultdict(list)
    for u in units:
        by_source[u[0]].append(u)
    for source, queue in by_source.items():
        queue.sort(key=lambda u: (u[1], u[2] is None, u[2] or 0, u[3]))
        whole, given, first = sum(u[4] for u in queue), 0, {}
        lack = goal[source]
        for epoch in range(most):
            for u in queue:
                given += u[4]
                if not u[4]:
                    continue
                if given / goal[source] <= 1:
                    taken[u] += 1
                    lack -= u[4]
                else:
                    first.setdefault((u[4].bit_length(), u[4] >> max(0, u[4].bit_length() - 3)), u)
        assert given == most * whole
        rest = sorted(first.values(), key=lambda u: (u[4], u[2], u[3]), reverse=True)
        for u in list(rest):
            if u[4] <= lack:
                taken[u] += 1
                lack -= u[4]
                rest.remove(u)
        near = min(rest, key=lambda u: (abs(u[4] - lack), u[4], u[2], u[3]), default=None)
        if near and abs(near[4] - lack) < lack:
            taken[near] += 1
    return taken


def check_replay(docs):
    """The decisions equal the replay, and each source is within one document of its target."""
    got = mixing.decisions(docs).selectExpr("*", "shiftrightunsigned(xxhash64(7, _id, _text), 1) AS h").collect()
    units = {(r["_source"], r["h"], r["_id"], r["_text"], r["size"] * r["rows"]): r["copies"] for r in got}
    sizes, taken, longest = Counter(), Counter(), Counter()
    for u, copies in units.items():
        sizes[u[0]] += u[4]
        taken[u[0]] += u[4] * copies
        longest[u[0]] = max(longest[u[0]], u[4])
    goal = mixing.targets(sizes, (5, 2, 1), 3)
    want = replayed(list(units), goal)
    assert {u: c for u, c in units.items() if c} == {u: c for u, c in want.items() if c}
    assert all(abs(taken[s] - goal[s]) <= longest[s] for s in sizes)
    return {s: abs(taken[s] - goal[s]) / goal[s] for s in sizes if goal[s]}


def test_mix_equals_a_replay(spark, docs_of, medium):
    off = check_replay(spark.read.parquet(f"{SMALL}/documents.parquet"))
    assert max(off.values()) < 0.15, off
    assert max(check_replay(medium[0]).values()) < 0.02
    # one document as long as its source's share: it is taken rather than nothing
    rows = [(k, "w " * 300, "en", "a") for k in range(2000)] + [(9001, "w " * 300_000, "en", "b"), (9002, "w", "en", "b")]
    assert check_replay(docs_of(rows))["b"] < 0.17  # its target is 257,143


def test_names_that_the_mix_uses(docs_of):
    rows = docs_of([(k, "a b c", "en", "s") for k in range(20)])
    for name in ("copy", "_copy", "_id", "_source", "_text", "words", "finish", "class", "lack", "found"):
        rows = rows.selectExpr("*", f"'own' AS {name}") if name not in rows.columns else rows
    out = mixing.mix(rows)
    assert out.columns == rows.columns and {r["copy"] for r in out.collect()} == {"own"}


def test_mix_of_a_whole_table(medium):
    docs, _ = medium
    rows = {r["doc_id"]: r for r in docs.collect()}
    got = by_id(mixing.mix_report(docs))
    again = by_id(mixing.mix_report(docs))
    assert got == again and got.keys() == rows.keys()
    sizes = Counter()
    for r in rows.values():
        sizes[r["source"]] += _words(r["text"])
    goal = mixing.targets(sizes, (5, 2, 1), 3)
    taken = Counter()
    for i, r in got.items():
        source = rows[i]["source"]
        assert r["size"] == _words(rows[i]["text"]) and r["source_size"] == sizes[source]
        assert abs(r["target"] - goal[source]) < 1e-6 and r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 0.02 * goal[s] for s in sizes)


def test_mix_small_cases(docs_of):
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "one two three", "en", None), (3, "one two three", "en", None),
            (4, "x " * 5000, "en", "a"), (5, "a b c d", None, "b"), (None, "a b", "en", "b")]
    got = mixing.mix_report(docs_of(rows)).collect()
    assert len(got) == len(rows)
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert all(r["taken"] == 0 for r in got if r["doc_id"] in (1, 2))
    assert len({r["taken"] for r in got if r["doc_id"] == 3}) == 1
    mixed = mixing.mix(docs_of(rows))
    assert mixed.columns == docs_of(rows).columns
    assert sum(_words(r["text"]) for r in mixed.collect()) == sum(r["taken"] for r in got)
    assert mixing.mix_report(docs_of([])).collect() == [] and mixing.mix(docs_of([])).collect() == []


def test_only_copies_up_to_the_budget_are_sorted(spark):
    """Ranges behind the one where the words pass the budget go, the last one of all late copies too."""
    rows = [(0, 4), (0, 5), (3, 2), (3, 6), (9, 1)] + [(4000, 7)] * 50
    copies = spark.createDataFrame(rows, "range int, words long")
    left = lambda budget: sorted(r["range"] for r in mixing._up_to_budget(copies, budget).collect())
    assert left(10) == [0, 0, 3, 3] and left(17) == [0, 0, 3, 3, 9]
    assert left(16) == [0, 0, 3, 3] and left(18) == left(10**6) == sorted(r for r, _ in rows)


def one_by_one(sizes, shards):
    """Loads and shards of groups that go singly, largest first, to the least loaded shard."""
    load, given = [0] * shards, []
    for size, number in sizes:
        got = Counter()
        for _ in range(number):
            k = min(range(shards), key=lambda x: (load[x], x))
            load[k] += size
            got[k] += 1
        given.append(sorted(got.items()))
    return load, given


def test_schedule_equals_one_group_at_a_time():
    rng = random.Random(6)
    for case in range(60):
        shards = rng.choice([1, 2, 3, 7, 40])
        sizes = sorted({rng.randrange(1, rng.choice([30, 5000])) for _ in range(40)}, reverse=True)
        sizes = [(s, rng.choice([1, 1, 2, 5, 90])) for s in sizes]
        if case % 3 == 0:
            sizes.insert(0, (10**6, 1))  # one group larger than all others together
        load, given = one_by_one(sizes, shards)
        assert [sorted(x) for x in sharding.longest_first(sizes, shards)] == given
    sizes = [(7, 2), (6, 2), (5, 2), (4, 3)]
    load = Counter()
    for (s, _), given in zip(sizes, sharding.longest_first(sizes, 3)):
        for k, n in given:
            load[k] += s * n
    assert sum(load.values()) == 48 and max(load.values()) <= (4 / 3 - 1 / 9) * 16
    assert sum(sharding.dealt([0, 5, 10**15], 10, 10**12)) == 10**12


def test_shards_equal_a_plain_placement(medium, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_A_TASK", 100)
    docs, _ = medium
    load = Counter()
    for r in sharding.shard(docs).collect():
        load[r["shard"]] += r["size"]
    groups = Counter()
    for r in docs.collect():
        groups[r["text"] or ""] += len((r["text"] or "").encode()) + 16
    sizes = sorted(Counter(groups.values()).items(), reverse=True)
    assert [load[k] for k in range(40)] == one_by_one(sizes, 40)[0]


def test_shards_of_a_whole_table(medium):
    docs, _ = medium
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = sharding.shard(docs).collect()
    assert {r["doc_id"] for r in got} == rows.keys() and len(got) == len(rows)
    load, slots, groups = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        raw = (rows[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "bytes"
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        groups[raw].add(r["shard"])
    assert set(load) == set(range(40)) and all(len(s) == 1 for s in groups.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) < 0.01 * max(load.values())


def test_shards_small_cases(docs_of):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "a"), (4, "y" * 300_000)]
    got = sharding.shard(docs_of(rows), shards=4).collect()
    assert len(got) == len(rows)
    assert len({r["shard"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert len({r["shard"] for r in got if r["text_crc32"] == zlib.crc32(b"a")}) == 1
    for k in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    assert sharding.shard(docs_of([]), shards=4).collect() == []


def test_every_pipeline_stage(spark):
    """Each stage against its operator's own decisions and plain Python, on what the one before kept."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.stored(stage(spark, docs, SMALL))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names
            assert not out.exceptAll(docs).dropDuplicates().join(docs.select("doc_id"), "doc_id", "left_anti").count()
            docs = out
    last = out.collect()
    assert len(last) == docs.count() and {r["doc_id"] for r in last} <= {r["doc_id"] for r in docs.collect()}


def test_pipeline_stages_on_an_empty_table(spark, docs_of):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs_of([], clash=False), MEDIUM).collect() == []


def test_stages_on_odd_rows(spark, docs_of):
    """Null ids, texts and sources, empty and long texts, repeated rows, clashing names: each stage gives rows."""
    import corpus_pipeline

    rows = [(None, "a null id and some words"), (1, None), (2, ""), (3, "word " * 30_000), (3, "word " * 30_000), (4, "a b", None, None),
            (5, "\x00 odd \u2028 text é", "en", None)]
    docs = docs_of(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, MEDIUM)
        assert out.columns == docs.columns and out.count() >= 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, MEDIUM).count() == len(rows)
