"""Embedding near-duplicates by hierarchical navigable small-world graphs.

Vectors that are equal form one class.  The classes of a label are dealt over shards of bounded
size; each shard builds a graph of several levels, where a node knows a few diverse neighbours.
Every class queries every shard of its label by a beam search that starts at the top level.  A
beam that ends full of links is widened; then some queries of every block are held against all
other vectors of the shard, and while those with few links or those with many found too few of them
on average, all beams are widened.  Found pairs are
verified by cosine in double precision, counted, and linked classes are united.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .frames import stored

#: Classes in a shard, and queries that meet it in one task.
SHARD = 8000
#: Neighbours of a node (twice as many at the lowest level), beam while building, first beam.
DEGREE, BUILD_BEAM, FIRST_BEAM = 16, 64, 32
#: Queries searched side by side, and nodes of a beam expanded at once.
SIDE_BY_SIDE, AT_ONCE = 256, 4
#: Audited queries of a block, and the share of its links that such a query must have found on average.
AUDITED, LEAST_RECALL = 128, 0.99


def beam_search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray,
                beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Per query the best nodes found and their similarities, best first (node -1: none).
    ``links[v]`` are the neighbours of v (-1: none), ``entry[q]`` the nodes to start from."""
    q, n = len(queries), len(vectors)
    every = np.arange(q)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True  # the place that -1 points to
    seen[every[:, None], entry] = True
    nodes = np.full((q, beam), -1)
    sims = np.full((q, beam), -np.inf, np.float32)
    width = min(beam, entry.shape[1])
    first = np.einsum("qd,qmd->qm", queries, vectors[entry])
    first[entry < 0] = -np.inf
    best = np.argsort(-first, axis=1, kind="stable")[:, :width]
    nodes[:, :width] = np.take_along_axis(entry, best, 1)
    sims[:, :width] = np.take_along_axis(first, best, 1)
    done = ~np.isfinite(sims)
    active = every
    while active.size:
        rank = np.where(done[active], -np.inf, sims[active])
        top = np.argsort(-rank, axis=1, kind="stable")[:, :AT_ONCE]
        live = np.isfinite(np.take_along_axis(rank, top, 1))
        going = live.any(1)
        active, top, live = active[going], top[going], live[going]
        if not active.size:
            break
        rows = active[:, None]
        done[rows, top] |= live
        found = links[np.where(live, nodes[rows, top], n)].reshape(active.size, -1)  # links[n] is all -1
        found = np.sort(found, axis=1)
        fresh = (found >= 0) & ~seen[rows, found]
        fresh[:, 1:] &= found[:, 1:] != found[:, :-1]
        seen[rows, np.where(fresh, found, n)] = True
        sim = np.einsum("qd,qmd->qm", queries[active], vectors[found])
        sim[~fresh] = -np.inf
        all_sims = np.concatenate([sims[active], sim], 1)
        all_nodes = np.concatenate([nodes[active], found], 1)
        all_done = np.concatenate([done[active], ~fresh], 1)
        keep = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        sims[active] = np.take_along_axis(all_sims, keep, 1)
        nodes[active] = np.take_along_axis(all_nodes, keep, 1)
        done[active] = np.take_along_axis(all_done, keep, 1)
    return np.where(np.isfinite(sims), nodes, -1), sims


def _diverse(vectors: np.ndarray, near: np.ndarray, sims: np.ndarray, degree: int) -> list[int]:
    """Neighbours from the nearest on, without those nearer to one already taken than to the
    node; filled up with the nearest of the rest."""
    order = np.argsort(-sims, kind="stable")
    near, sims = near[order], sims[order]
    if near.size <= degree:
        return near.tolist()
    among = vectors[near] @ vectors[near].T
    taken: list[int] = []
    barred = np.zeros(near.size, bool)
    for k in range(near.size):
        if not barred[k]:
            taken.append(k)
            if len(taken) == degree:
                break
            barred |= among[k] > sims
    for k in range(near.size):
        if len(taken) == degree:
            break
        if k not in taken:
            taken.append(k)
    return near[taken].tolist()


class Graph:
    """The graph of a shard; ``vectors`` are of unit length, in the order of insertion."""

    def __init__(self, vectors: np.ndarray, seed: int = 5):
        self.vectors, n = vectors, len(vectors)
        draws = np.random.default_rng(seed).random(n)
        self.level = np.minimum((-np.log(np.maximum(draws, 1e-12)) / np.log(DEGREE)).astype(int), 8)
        self.level[0] = self.level.max(initial=0)  # the first node is on every level: the way in
        self.links = [np.full((n + 1, DEGREE * (2 if k == 0 else 1)), -1) for k in range(int(self.level.max(initial=0)) + 1)]
        done = 1
        while done < n:
            step = min(max(1, done), SIDE_BY_SIDE, n - done)
            self._insert(np.arange(done, done + step), done)
            done += step

    def _insert(self, new: np.ndarray, there: int) -> None:
        entry = np.zeros((new.size, 1), int)
        among = self.vectors[new] @ self.vectors[new].T
        for k in range(len(self.links) - 1, -1, -1):
            beam = BUILD_BEAM if k <= self.level[new].max() else 1
            nodes, sims = beam_search(self.vectors, self.links[k], self.vectors[new], entry, beam)
            entry = nodes[:, :8]
            for i in np.flatnonzero(self.level[new] >= k).tolist():
                # candidates: the beam, and earlier nodes of this batch on the same level
                mates = np.flatnonzero(self.level[new[:i]] >= k)
                real = nodes[i] >= 0
                near = np.concatenate([nodes[i][real], new[mates]])
                sim = np.concatenate([sims[i][real], among[i, mates]])
                if mates.size > BUILD_BEAM:
                    best = np.argsort(-sim, kind="stable")[:2 * BUILD_BEAM]
                    near, sim = near[best], sim[best]
                self._connect(k, int(new[i]), _diverse(self.vectors, near, sim, DEGREE))

    def _connect(self, k: int, node: int, chosen: list[int]) -> None:
        links = self.links[k]
        links[node, :len(chosen)] = chosen
        for other in chosen:
            row = links[other]
            free = np.flatnonzero(row < 0)
            if free.size:
                row[free[0]] = node
            else:
                near = np.append(row, node)
                kept = _diverse(self.vectors, near, self.vectors[near] @ self.vectors[other], row.size)
                links[other, :len(kept)] = kept

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.zeros((len(queries), 1), int)
        for k in range(len(self.links) - 1, 0, -1):
            entry = beam_search(self.vectors, self.links[k], queries, entry, 8)[0]
        return beam_search(self.vectors, self.links[0], queries, entry, beam)


def linked(graph: Graph, queries: np.ndarray, least: float, own_node: np.ndarray) -> tuple[np.ndarray, float]:
    """Which nodes each query has a similarity of at least ``least`` with (a table of booleans), and the
    recall of the audit that passed: the mean over audited queries that have links, of those with
    fewer than ``FIRST_BEAM`` links or of the others, whichever is less.  ``own_node[q]`` is the node of
    the query itself (-1: not in this shard); the audit does not count it."""
    n, found_from = len(graph.vectors), np.float32(least - 1e-5)
    audited = np.unique(np.linspace(0, len(queries) - 1, min(AUDITED, len(queries))).astype(int))
    # nearer than what counts as found by more than single precision errs
    truth = queries[audited] @ graph.vectors.T >= np.float32(least - 1e-6)
    inside = np.flatnonzero(own_node[audited] >= 0)
    truth[inside, own_node[audited[inside]]] = False
    links = truth.sum(1)
    strata = [x for x in (np.flatnonzero((links > 0) & (links < FIRST_BEAM)), np.flatnonzero(links >= FIRST_BEAM)) if x.size]
    beam = FIRST_BEAM
    while True:
        hit = np.zeros((len(queries), n), bool)
        for a in range(0, len(queries), SIDE_BY_SIDE):
            rows, own = np.arange(a, min(a + SIDE_BY_SIDE, len(queries))), min(beam, n)
            while own < n and rows.size:
                nodes, sims = graph.search(queries[rows], own)
                i, j = np.nonzero(sims >= found_from)
                hit[rows[i], nodes[i, j]] = True
                # every place of the beam is a link: widen, beyond a few steps to the whole shard
                rows, own = rows[sims[:, -1] >= found_from], 4 * own if 4 * own <= n // 4 else n
            if rows.size:  # the beam holds the whole shard
                hit[rows] = queries[rows] @ graph.vectors.T >= found_from
        recall = min((((hit[audited] & truth).sum(1) / np.maximum(links, 1))[x].mean() for x in strata), default=1.0)
        if recall >= LEAST_RECALL or beam >= n:
            return hit, float(recall)
        beam *= 2


def linked_pairs(graph: Graph, queries: np.ndarray, least: float, own_node: np.ndarray,
                 ) -> tuple[np.ndarray, np.ndarray, float]:
    """:func:`linked` as pairs (query, node)."""
    hit, recall = linked(graph, queries, least, own_node)
    return *np.nonzero(hit), recall


class Shard:
    """The classes of a shard in order, how many rows each has, its vectors and their graph."""

    def __init__(self, c: np.ndarray, m: np.ndarray, vectors: list):
        order = np.argsort(c, kind="stable")
        self.c, self.m = c[order], m[order].astype(float)
        exact = np.array([vectors[k] for k in order.tolist()], np.float64)
        # the largest component first, so that neither tiny nor huge vectors lose their length
        exact = exact / np.abs(exact).max(axis=1, keepdims=True)
        self.exact = exact / np.linalg.norm(exact, axis=1, keepdims=True)
        self.graph = Graph(self.exact.astype(np.float32))

    def packed(self) -> bytes:
        vectors, self.graph.vectors = self.graph.vectors, None  # made again from the exact ones
        raw = pickle.dumps(self, protocol=5)
        self.graph.vectors = vectors
        return raw

    @staticmethod
    def unpacked(raw: bytes) -> Shard:
        shard = pickle.loads(raw)
        shard.graph.vectors = shard.exact.astype(np.float32)
        return shard


def meeting(one: Shard, other: Shard, least: float) -> np.ndarray:
    """Which classes of two shards (or of one with itself) link: those that one finds in the other's graph
    or the other way, with a cosine of at least ``least`` in double precision."""
    if one is other:
        hit = linked(one.graph, one.graph.vectors, least, np.arange(one.c.size))[0]
        hit |= hit.T.copy()
        np.fill_diagonal(hit, False)
    else:
        none = [np.full(s.c.size, -1) for s in (one, other)]
        hit = linked(other.graph, one.graph.vectors, least, none[0])[0]
        hit |= linked(one.graph, other.graph.vectors, least, none[1])[0].T
    for a in range(0, one.c.size, SIDE_BY_SIDE):
        part = hit[a:a + SIDE_BY_SIDE]
        at = np.flatnonzero(part.any(0))
        part[:, at] &= one.exact[a:a + SIDE_BY_SIDE] @ other.exact[at].T >= least
    return hit


def told(one: Shard, other: Shard, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per class with a link in ``hit``: class, rows linked with, and the least class that the links of
    this meeting lead to.  The links themselves, which may be as many as the pairs, stay in the task."""
    back = np.ascontiguousarray(hit.T)
    sides = [(one, hit, other), (other, back, one)]
    links = [np.concatenate([table[a:a + SIDE_BY_SIDE].astype(float) @ far.m for a in range(0, len(table), SIDE_BY_SIDE)])
             for _, table, far in sides]
    root = [np.zeros(s.c.size, np.int64) for s, _, _ in sides]
    left = [x > 0 for x in links]
    while left[0].any():
        seen = [np.zeros(x.size, bool) for x in left]
        front = np.flatnonzero(left[0])[:1]
        side = 0
        while front.size:
            seen[side][front] = True
            left[side][front] = False
            near = sides[side][1][front].any(0)
            side = 1 - side
            front = np.flatnonzero(near & left[side])
        least = min(s.c[x].min() for (s, _, _), x in zip(sides, seen) if x.any())
        for r, x in zip(root, seen):
            r[x] = least
    if one is other:  # both sides are the same classes
        both = np.minimum(np.where(links[0] > 0, root[0], one.c), np.where(links[1] > 0, root[1], one.c))
        at = np.flatnonzero(links[0] > 0)
        return one.c[at], links[0][at].astype(np.int64), both[at]
    c, n, r = (np.concatenate(x) for x in ((one.c, other.c), links, root))
    at = np.flatnonzero(n > 0)
    return c[at], n[at].astype(np.int64), r[at]


def near_duplicates(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """One row per vector: id, ``n_links`` (other vectors linked directly), ``component_id`` (least id
    reachable by links), ``kept`` (id = component_id).

    Vectors link when their labels are equal and not null and their cosine, in double precision,
    is at least ``least``.  A vector that is null, empty, zero or holds a null or non-finite component
    links with nothing, nor do vectors of different lengths.  A null id has a null component and
    is not kept.  Repeated rows count as vectors of their own.  Other columns are ignored.

    A label of s shards costs s * (s + 1) / 2 meetings, each of bounded size: the method queries
    every shard.  A meeting gives counts and a forest, not its links."""
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].alias("label"),
                          vectors[vector_col].cast("array<double>").alias("v"))
    usable = ("label IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) "
              "AND exists(v, x -> x <> 0)")
    rows = rows.withColumn("label", F.expr(f"CASE WHEN {usable} THEN named_struct('label', label, 'size', size(v)) END"))
    rows = rows.withColumn("c", F.when(F.col("label").isNotNull(), F.xxhash64("label", "v")))
    named = rows.where("c IS NOT NULL")
    classes = stored(named.groupBy("c").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("id"),
                                            F.first("label").alias("label"), F.first("v").alias("v")))
    shards = classes.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards"))
    dealt = classes.select("c", "m", "label", "v").join(shards, "label").withColumn(
        "shard", F.expr("CAST(pmod(xxhash64(c, 'shard'), shards) AS INT)"))
    dealt = dealt.withColumn("g", F.xxhash64("label", "shard"))

    def build(key, table):
        own = Shard(table.column("c").to_numpy(), table.column("m").to_numpy(), table.column("v").to_pylist())
        return pa.table({"label": table.column("label").slice(0, 1), "g": table.column("g").slice(0, 1),
                         "shard": pa.array([own.packed()], pa.binary())}, schema=None)

    label_type = dealt.schema["label"].dataType.simpleString()
    graphs = stored(dealt.groupBy("g").applyInArrow(build, f"label {label_type}, g long, shard binary"))
    # each shard meets itself and each other one of its label, once
    named_ = graphs.select("label", "g")
    pairs = named_.join(named_.withColumnRenamed("g", "h"), "label").where("g <= h").withColumn("meet", F.xxhash64("g", "h"))
    seats = pairs.select("meet", "g").union(pairs.where("g < h").selectExpr("meet", "h AS g"))

    def meet(key, table):
        met = [Shard.unpacked(x.as_py()) for x in table.column("shard")]
        one, other = met[0], met[-1]
        c, links, root = told(one, other, meeting(one, other, least))
        return pa.table({"c": c, "links": links, "root": root})

    found = seats.join(graphs.select("g", "shard"), "g").select("meet", "shard")
    found = stored(found.groupBy("meet").applyInArrow(meet, "c long, links long, root long"))
    return _labelled(rows, classes.drop("v", "label"), found, id_col)


def _labelled(rows: DataFrame, classes: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """``found``: per class and meeting the rows it links with, and the least class its links lead to."""
    linked_ = found.groupBy("c").agg(F.sum("links").alias("links"))
    forest = components(found.selectExpr("c AS u", "root AS v"))
    named = (classes.join(linked_, "c", "left").join(forest.withColumnRenamed("node", "c"), "c", "left")
             .withColumn("component", F.coalesce("component", "c")))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = named.join(least, "component").select("c", "component_id", F.expr("m - 1 + coalesce(links, 0)").alias("n_links"))
    out = rows.select("id", "c").join(named, "c", "left")
    component = F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
