"""Jaccard join, components, embedding duplicates: against brute force."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest
from conftest_llm import MEDIUM, by_id

from churnlens.llm import hnsw_dedup, jaccard_join
from churnlens.llm.components import components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def united(nodes, pairs):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute(rows):
    """{id: (n_shingles, n_links, component)} by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    pairs = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    links = dict.fromkeys(sets, 0)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    root = united(sets, pairs)
    return {i: (len(s), links[i], root[i]) for i, s in sets.items()}


def joined(docs):
    return {r.doc_id: (r.n_shingles, r.n_links, r.component_id) for r in jaccard_join.jaccard_join(docs).collect()}


def edits(rng, words, share):
    return [w if rng.random() > share else f"e{rng.randrange(10**6)}" for w in words]


def corpus(seed=3, copies=60):
    """Documents with common passages, near copies on both sides of the threshold, exact copies and oddities."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    passage = [word() for _ in range(30)]
    base = [word() for _ in range(150)]
    out = [" ".join(edits(rng, base, share)) for share in (0.005, 0.01, 0.015, 0.02, 0.04) for _ in range(copies // 5)]
    out += [" ".join([word() for _ in range(rng.randrange(5, 60))] + passage) for _ in range(40)]
    out += [" ".join(base), " ".join(base), " ".join(base).upper(), "one two three", "One  two\tthree", "one two", "", "   ",
            "é É five six seven eight", "a b c d e", "a b c d e f"]
    return list(enumerate(out))


def test_join_equals_brute_force(docs_of):
    rows = corpus()
    assert joined(docs_of(rows)) == brute(rows)


def test_large_regions_split_and_block(docs_of, monkeypatch):
    """Regions far above the bound go through further pivots and blocks and lose no link."""
    monkeypatch.setattr(jaccard_join, "REGION", 8)
    rows = corpus(seed=4, copies=100)
    assert joined(docs_of(rows)) == brute(rows)


def dense_sets(rng, groups=6, size=40):
    """Sets in groups that share a core, so that pivots find regions, and others far from all."""
    out = []
    for _ in range(groups):
        core = rng.integers(1, 2**63, 200, dtype=np.uint64)
        for _ in range(size):
            own = rng.integers(1, 2**63, int(rng.choice([3, 40, 250])), dtype=np.uint64)
            out.append(np.unique(np.append(core[rng.random(200) < rng.uniform(0.75, 1)], own)))
    return out + [np.unique(rng.integers(1, 2**63, 300, dtype=np.uint64)) for _ in range(60)]


@pytest.mark.parametrize("percent", [80, 60, 90])
def test_linked_sets_meet_in_a_region(percent):
    sets = dense_sets(np.random.default_rng(percent))
    pivots = jaccard_join.spread_pivots(sets[::2], percent)
    regions = jaccard_join.Regions(pivots, percent)
    assert 3 <= len(pivots) <= jaccard_join.PIVOTS
    apart = [jaccard_join._distances(a, [b])[0] for a, b in combinations(pivots, 2)]
    assert min(apart) > jaccard_join._reach(percent)  # no pivot lies in the region of one before it
    where = [regions.of(s) for s in sets]
    met = linked = 0
    for (a, u), (b, v) in combinations(list(zip(sets, where)), 2):
        both = np.intersect1d(a, b).size
        if 100 * both >= percent * (a.size + b.size - both):
            linked += 1
            assert u[0] in v or v[0] in u
        met += bool(set(u) & set(v))
    # and the regions keep most other pairs apart
    assert linked > 30 and met < 0.5 * len(sets) * (len(sets) - 1) / 2
    for s in sets[:50]:
        d = regions.distances(s)
        want = jaccard_join._distances(s, pivots)
        assert np.allclose(d if d is not None else 1.0, want)


def test_join_with_pivot_regions(docs_of, monkeypatch):
    rows = corpus(seed=8, copies=90)
    used, plain = [], jaccard_join.spread_pivots
    monkeypatch.setattr(jaccard_join, "spread_pivots", lambda *a: used.append(plain(*a)) or used[-1])
    assert joined(docs_of(rows)) == brute(rows)
    assert used[0]  # the near copies gather around pivots


def test_join_edge_cases(docs_of):
    rows = [(1, None), (2, ""), (None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, "x " * 20000)]
    got = sorted(jaccard_join.jaccard_join(docs_of(rows)).collect(), key=repr)
    assert sorted((r.doc_id or -1, r.n_shingles, r.n_links, r.component_id) for r in got) == sorted(
        [(1, 0, 0, 1), (2, 0, 0, 2), (-1, 2, 2, 7), (7, 2, 2, 7), (7, 2, 2, 7), (9, 1, 0, 9)])
    assert jaccard_join.jaccard_join(docs_of([])).collect() == []
    kept = jaccard_join.one_of_each(docs_of([*rows, (8, "A b c d e F")]))
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 2, 7, 9]
    assert kept.columns == docs_of(rows).columns


def test_one_of_each_decides_by_id_and_text(docs_of):
    """Repeated ids with different texts, and repeated rows without id or shingle."""
    a, b = "a b c d e f g h", "k l m n o p q r"
    rows = [(3, a), (5, a), (5, b), (5, b), (6, "s t u v w x"), (6, "S T U V W X"), (None, "y z"), (None, "y z"), (8, ""), (8, "")]
    kept = jaccard_join.one_of_each(docs_of(rows)).collect()
    assert sorted((r.doc_id or -1, r.text.lower()) for r in kept) == [
        (-1, "y z"), (-1, "y z"), (3, a), (5, b), (6, "s t u v w x"), (8, ""), (8, "")]
    near = "i0 i1 i2 i3 i4 i5 i6 i7 i8 i9 i10 i11 i12 i13 i14 i15 i16 i17 i18 i19 i20 i21 i22 i23 i24 i25"
    kept = jaccard_join.one_of_each(docs_of([(7, near), (7, near + " end")])).collect()
    assert len(kept) == 1  # two near copies under one id


def test_names_that_the_join_uses(docs_of):
    rows = docs_of([(1, "a b c d e f"), (2, "a b c d e f"), (3, "other words than those before")])
    for name in ("_gone", "_set", "g", "d", "region", "high", "s", "kind", "links"):
        rows = rows.selectExpr("*", f"'own' AS {name}")
    for docs in (rows, rows.union(rows)):
        out = jaccard_join.one_of_each(docs)
        assert out.columns == rows.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_components(spark):
    rng = random.Random(5)
    pairs = [(k, k + 1) for k in range(200, 260)] + [(rng.randrange(150), rng.randrange(150)) for _ in range(120)]
    pairs += [(500, k) for k in range(400, 480)] + [(3, 3)]
    df = spark.createDataFrame(pairs + [(None, 4), (4, None)], "u long, v long")
    real = [(a, b) for a, b in pairs if a != b]
    nodes = {x for p in real for x in p}
    assert {r.node: r.component for r in components(df).collect()} == united(nodes, real)
    assert components(df.limit(0)).collect() == []


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' AS c", "1 AS id")


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16))
    rows = []
    for k in range(400):
        v = centres[k % 40] + rng.normal(size=16) * (0.05 if k % 3 else 0.35)
        rows.append((k, [float(np.float32(x)) for x in v], k % 2))
    rows += [(1000 + k, rows[5][1], 1) for k in range(30)]  # exact copies
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] + [1.0] * 15, 1), (2003, [None] + [1.0] * 15, 1),
             (2004, rows[5][1], None), (2005, rows[5][1][:8], 1), (2006, [x * 1e-30 for x in rows[5][1]], 1), (2007, [], 1)]
    got = by_id(hnsw_dedup.near_duplicates(vectors(spark, rows)), "vec_id")
    good = [(i, np.array(v, np.float32).astype(float), lab) for i, v, lab in rows
            if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)]
    pairs = [(a, b) for (a, x, la), (b, y, lb) in combinations(good, 2) if la == lb and len(x) == len(y)
             and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93]
    root = united([r[0] for r in rows], pairs)
    links = dict.fromkeys(root, 0)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {
        i: (links[i], root[i], root[i] == i) for i in root}
    assert hnsw_dedup.near_duplicates(vectors(spark, rows).limit(0)).collect() == []


def test_several_shards(spark, monkeypatch):
    monkeypatch.setattr(hnsw_dedup, "SHARD", 60)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(80, 12))
    rows = [(k, [float(x) for x in base[k % 80] + rng.normal(size=12) * 0.05], 1) for k in range(300)]
    got = by_id(hnsw_dedup.near_duplicates(vectors(spark, rows)), "vec_id")
    unit = np.array([r[1] for r in rows], np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.93).sum(1) - 1
    assert [got[k].n_links for k in range(300)] == want.tolist()


def test_a_meeting_tells_counts_and_a_forest():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 10))
    v = base[rng.integers(0, 30, 500)] + rng.normal(size=(500, 10)) * rng.choice([0.03, 0.2], (500, 1))
    c, m = rng.permutation(10**6)[:500].astype(np.int64), rng.integers(1, 5, 500)
    for split in (500, 200):
        shards = [hnsw_dedup.Shard(c[a:b], m[a:b], v[a:b].tolist()) for a, b in ((0, split), (split, 500)) if b > a]
        shards = [hnsw_dedup.Shard.unpacked(s.packed()) for s in shards]
        one, other = shards[0], shards[-1]
        hit = hnsw_dedup.meeting(one, other, 0.93)
        unit = [s.exact for s in (one, other)]
        want = unit[0] @ unit[1].T >= 0.93
        if one is other:
            np.fill_diagonal(want, False)
        assert (hit == want).all() and hit.any()
        pairs = [(int(one.c[i]), int(other.c[j])) for i, j in zip(*np.nonzero(want))]
        links, rows = {}, dict(zip(c.tolist(), m.tolist()))
        for a, b in set(map(tuple, map(sorted, pairs))):
            links[a] = links.get(a, 0) + rows[b]
            links[b] = links.get(b, 0) + rows[a]
        root = united(links, pairs)
        assert {a: (n, r) for a, n, r in zip(*(x.tolist() for x in hnsw_dedup.told(one, other, hit)))} == {
            a: (links[a], root[a]) for a in links}


class Blind:
    """A graph whose search finds ``seen`` links only, until its beam has ``least_beam`` places."""

    def __init__(self, vectors, seen, least_beam):
        self.vectors, self.seen, self.least_beam = vectors, seen, least_beam

    def search(self, queries, beam):
        sims = queries @ self.vectors.T
        if beam < self.least_beam:
            sims = np.where(self.seen(sims), sims, np.float32(-1))
        nodes = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
        return nodes, np.take_along_axis(sims, nodes, 1)


def unit_vectors(n, seed):
    v = np.random.default_rng(seed).normal(size=(n, 128)).astype(np.float32)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_audit_does_not_count_the_query_itself():
    """One real link, missed by narrow beams, among 128 queries that all find themselves."""
    v = unit_vectors(300, 1)
    v[200] = v[5]
    itself = lambda sims: np.arange(300) == sims.argmax(1)[:, None]
    q, found, recall = hnsw_dedup.linked_pairs(Blind(v, itself, 64), v[:128], 0.93, np.arange(128))
    assert (5, 200) in zip(q.tolist(), found.tolist()) and recall == 1.0


def test_audit_of_sparse_queries_beside_a_dense_group():
    """A third of the vectors link with each other and are found; the pairs of the rest are not."""
    v = unit_vectors(2400, 2)
    v[0::3] = v[0]
    v[1::3] = v[2::3]
    dense = lambda sims: np.broadcast_to(((sims >= 0.93).sum(1) > 2)[:, None], sims.shape)
    q, found, recall = hnsw_dedup.linked_pairs(Blind(v, dense, 64), v, 0.93, np.arange(2400))
    assert np.bincount(q, minlength=2400).tolist() == [800, 2, 2] * 800 and recall == 1.0


@pytest.mark.parametrize("beam", [64])
def test_recall_of_the_graph(beam):
    """Nearest neighbours of a graph search against all vectors, without audits or widening."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(1500, 24)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = hnsw_dedup.Graph(v)
    nodes, _ = graph.search(v[:200], beam)
    true = np.argsort(-(v[:200] @ v.T), axis=1)[:, :10]
    recall = np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(nodes.tolist(), true.tolist())])
    assert recall >= 0.9


def test_join_on_the_small_table(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert joined(docs) == brute(rows)
