"""N-gram Jaccard join: pivots, Voronoi regions with replicated boundaries, exact recursion.

Documents with one shingle set are one class.  Jaccard distance is a metric, so pivots part it.  Of
a bounded sample of classes those are pivots that have most others of the sample near them and
near no pivot before (so they are spread, and lie where classes are dense).  A class belongs to
the region of its nearest pivot, if that is near enough, else to the region outside; it is
replicated to every region that the triangle inequality leaves possible: with w the largest
distance of a link, to pivots no more than 2w further than its own, or, from outside, within w
of a region's rim.  So two classes that link meet in the region of one of them.

Regions join recursively.  Within a region two classes that link share one of their first
shingles in any common order (shingles found frequent last): the classes at such a shingle are a
cell, a region of its own with the least class as its name.  Cells are cut into rings by set size
with replicated boundaries, and bits of filled hash buckets bound the overlap of two sets and
drop members that cannot link.  A cell that is still large takes further pivots among its members,
with their Voronoi regions and triangle windows (d(x, p) <= d(x, home) + 2w); one in which they
separate nothing is joined block against block.  Every pair is verified on whole sets, and exactly
one region counts it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .components import Forest, components
from .frames import fresh, map_batches, slices, stored
from .shingles import mixed, shingle_set, words

#: Classes that one task compares with each other at once.
REGION = 400
#: Pivots of the first level, and the classes of the sample that they are chosen from.
PIVOTS, SAMPLE = 64, 1024
#: Bits of the fixed-size sketch of shared cells (16 MB): it only spares work, a join decides.
CELL_BITS = 1 << 27
#: Rounds of further pivots before a region that does not shrink is joined block by block.
ROUNDS = 3
#: Bits of the fixed-size sketch of wanted ids (2 MB): it only spares work, a join decides.
SKETCH_BITS = 1 << 24
#: Shingles that the frequency order may name (8 MB at most); any order is exact.
FREQUENT = 1 << 20


def _set_id(s: np.ndarray) -> int:
    """64-bit name of a set: equal sets agree; of n different sets two agree with odds n^2 / 2^65."""
    total = np.bitwise_xor.reduce(mixed(s + np.uint64(0x9E3779B97F4A7C15)))
    return int(mixed(np.array([total + np.uint64(s.size)]))[0].view(np.int64)) if s.size else 0


def _prefix(s: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of ``s`` in the common order: as many as a linked set cannot all miss."""
    need = s.size - -(-s.size * percent // 100) + 1
    if frequent.size:
        hot = frequent[np.minimum(np.searchsorted(frequent, s), frequent.size - 1)] == s
        s = np.concatenate([s[~hot], s[hot]])
    return s[:need]


def described(docs: DataFrame, id_col: str, text_col: str, width: int, frequent_from: int) -> DataFrame:
    """Per document (kind 0): id, set id, set size; per batch (kind 1): shingles that at least
    ``frequent_from`` documents of the batch hold, with their number."""
    def work(batch):
        ids, sets = batch.column("_id").to_pylist(), []
        for text in batch.column("_text").to_pylist():
            sets.append(shingle_set(words(text), width))
        yield {"kind": pa.array([0] * len(sets), pa.int32()), "id": pa.array(ids, pa.int64()),
               "c": pa.array([_set_id(s) for s in sets], pa.int64()),
               "n": pa.array([s.size for s in sets], pa.int64())}
        all_of = np.sort(np.concatenate(sets))
        first = np.flatnonzero(np.append(True, all_of[1:] != all_of[:-1])) if all_of.size else np.zeros(0, np.int64)
        count = np.diff(np.append(first, all_of.size))
        keep = count >= frequent_from
        yield {"kind": pa.array([1] * int(keep.sum()), pa.int32()),
               "id": pa.array([None] * int(keep.sum()), pa.int64()),
               "c": pa.array(all_of[first[keep]].view(np.int64)), "n": pa.array(count[keep].astype(np.int64))}
    slim = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].alias("_text"))
    return map_batches(slim, "kind int, id long, c long, n long", work)


def spread_pivots(sets: list[np.ndarray], percent: int) -> list[np.ndarray]:
    """Of ``sets`` those that have the most others within reach that no pivot before them has."""
    if not sets:
        return []
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    size = np.array([s.size for s in sets])
    start = np.cumsum(size) - size
    mark, near = np.zeros(int(ids.max()) + 1, np.int32), np.zeros((size.size, size.size), bool)
    for k in range(size.size):
        own = ids[start[k]:start[k] + size[k]]
        mark[own] = 1
        both = np.add.reduceat(mark[ids], start)
        mark[own] = 0
        near[k] = 1 - both / (size[k] + size - both) <= _reach(percent)
    pivots, left = [], np.ones(size.size, bool)
    while len(pivots) < PIVOTS:
        gain = (near & left).sum(1)
        best = int(gain.argmax())
        if gain[best] < 2:
            break  # a pivot that is near to itself alone parts nothing
        pivots.append(sets[best])
        left &= ~near[best]
    return pivots


def _reach(percent: int) -> float:
    """How near to a pivot the classes of its region lie: three times the distance of a link, less
    where that would bring every class within a link of a region's rim."""
    link = 1 - percent / 100
    return max(0.0, min(3 * link, 0.95 - link))


class Regions:
    """The regions of the first level: which ones a class belongs to, by its distances to all pivots."""

    def __init__(self, pivots: list[np.ndarray], percent: int):
        self.size = np.array([p.size for p in pivots], np.int64)
        self.link, self.reach = 1 - percent / 100, _reach(percent)
        flat = np.concatenate([np.zeros(0, np.uint64), *pivots])
        self.shingles, place = np.unique(flat, return_inverse=True)
        bits = np.repeat(np.uint64(1) << np.arange(len(pivots), dtype=np.uint64), self.size)
        self.holders = np.zeros(self.shingles.size, np.uint64)
        np.bitwise_or.at(self.holders, place, bits)

    def distances(self, s: np.ndarray) -> np.ndarray | None:
        """To each pivot; None if all are 1."""
        if not self.shingles.size:
            return None
        at = np.minimum(np.searchsorted(self.shingles, s), self.shingles.size - 1)
        held = self.holders[at[self.shingles[at] == s]]
        if not held.size:
            return None
        both = np.unpackbits(held.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)[:self.size.size]
        return 1 - both / (s.size + self.size - both)

    def of(self, s: np.ndarray) -> list[int]:
        """0 for the region outside, k + 1 for that of pivot k; the class's own region first."""
        d = self.distances(s)
        if d is None:
            return [0]
        home, slack = int(d.argmin()), 1e-9
        if d[home] <= self.reach:
            most = min(d[home] + 2 * self.link, self.reach + self.link) + slack
            return [home + 1, *(k + 1 for k in np.flatnonzero(d <= most).tolist() if k != home)]
        return [0, *(np.flatnonzero(d <= self.reach + self.link + slack) + 1).tolist()]


def _cell_rows(docs, text_col, width, percent, frequent, regions, shared=None):
    """(h, c): the cells of each class, a cell being a region and a shingle hashed together; with
    ``shared`` (bits) only those that may hold another class."""
    def work(batch):
        h, c = [], []
        seen = set()  # of copies in one batch the first stands for all
        for text in batch.column("_text").to_pylist():
            s = shingle_set(words(text), width)
            if s.size and (name := _set_id(s)) not in seen:
                seen.add(name)
                first = _prefix(s, frequent.value, percent)
                for region in regions.value.of(s):
                    p = mixed(first ^ np.uint64(region * 0x9E3779B97F4A7C15 % 2**64)) if region else first
                    if shared is not None:
                        place = (p & np.uint64(CELL_BITS - 1)).astype(np.int64)
                        p = p[(shared.value[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)]
                    h.append(p)
                    c.append(np.full(p.size, name, np.int64))
        if h:
            yield {"h": pa.array(np.concatenate(h).view(np.int64)), "c": pa.array(np.concatenate(c))}
    return map_batches(docs.select(docs[text_col].alias("_text")), "h long, c long", work)


def _cell_sketch(cells: DataFrame) -> np.ndarray:
    """A bit for each cell; fixed size, whatever the number of cells."""
    place = F.expr(f"h & {CELL_BITS - 1}L")
    found = (cells.select(place.alias("p")).selectExpr("p DIV 32 AS w", "CAST(1 AS BIGINT) << CAST(p % 32 AS INT) AS b")
             .groupBy("w").agg(F.bit_or("b").alias("b"))).toArrow()
    out = np.zeros(CELL_BITS // 32, "<u4")
    out[found.column("w").to_numpy()] = found.column("b").to_numpy().astype("<u4")
    return out.view(np.uint8)


def _members(docs, text_col, width, percent, frequent, regions) -> DataFrame:
    """(region, c): the classes of each cell that holds two or more, the cell being called after its
    least class.

    The least and the largest class of a cell are found by an aggregate, which combines in each task
    before the shuffle, so a shingle that very many classes share costs a row a task; then the texts
    are read again for the classes at the cells that two classes share."""
    cells = _cell_rows(docs, text_col, width, percent, frequent, regions)
    shared = cells.groupBy("h").agg(F.min("c").alias("region"), F.max("c").alias("high")).where("region <> high")
    shared = stored(shared.select("h", "region"))
    bits = docs.sparkSession.sparkContext.broadcast(_cell_sketch(shared))
    again = _cell_rows(docs, text_col, width, percent, frequent, regions, bits)
    return again.join(shared, "h").select("region", "c").distinct()


def _buckets(s: np.ndarray) -> bytes:
    """One bit for each bucket that holds a shingle, of at least two buckets a shingle."""
    bits = np.zeros(max(64, 1 << int(2 * s.size - 1).bit_length()), np.uint8)
    bits[(s & np.uint64(bits.size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _of_wanted(docs, id_col, text_col, width, wanted, form, name):
    """(c, name): ``form`` of the shingle set of each wanted class, from the text of its least id."""
    sketch = docs.sparkSession.sparkContext.broadcast(_sketch(wanted))

    def work(batch):
        i, c, out = [], [], []
        bits, places = sketch.value, batch.column("_place").to_numpy()
        for k in np.flatnonzero(bits[places >> 3] >> (places & 7) & 1).tolist():
            found = shingle_set(words(batch.column("_text")[k].as_py()), width)
            if found.size:
                i.append(batch.column("_id")[k].as_py())
                c.append(_set_id(found))
                out.append(form(found))
        yield {"id": pa.array(i, pa.int64()), "c": pa.array(c, pa.int64()), name: pa.array(out, pa.binary())}

    slim = docs.select(docs[text_col].alias("_text"), docs[id_col].cast("long").alias("_id"))
    slim = slim.withColumn("_place", F.expr(f"pmod(xxhash64(_id), {SKETCH_BITS})"))
    found = map_batches(slim, f"id long, c long, {name} binary", work)
    # the sketch lets a few others through, and an id may have several rows
    found = found.join(wanted.selectExpr("c", "id AS least"), "c").where("id = least")
    return stored(found.select("c", name).dropDuplicates(["c"]))


def _sketch(ids: DataFrame) -> np.ndarray:
    """A bit for the hash of each id; fixed size, whatever the number of ids."""
    place = F.expr(f"pmod(xxhash64(id), {SKETCH_BITS})")
    found = (ids.select(place.alias("p")).selectExpr("p DIV 32 AS w", "CAST(1 AS BIGINT) << CAST(p % 32 AS INT) AS b")
             .groupBy("w").agg(F.bit_or("b").alias("b"))).toPandas()
    out = np.zeros(SKETCH_BITS // 32, "<u4")
    out[found["w"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64).astype("<u4")
    return out.view(np.uint8)


def _distances(x: np.ndarray, others: list[np.ndarray]) -> list[float]:
    both = [np.count_nonzero(p[np.minimum(np.searchsorted(p, x), p.size - 1)] == x) for p in others]
    return [1 - b / (x.size + p.size - b) for b, p in zip(both, others)]


def _grouped(batches, keys: list[str]):
    """Rows of each group, as lists of columns; the partition is sorted by ``keys``."""
    now, held = None, []
    for batch in (part for whole in batches for part in slices(whole)):
        for row in batch.to_pylist():
            key = [row[k] for k in keys]
            if key != now:
                if held:
                    yield held
                now, held = key, []
            held.append(row)
    if held:
        yield held


FOUND = "c long, links long, root long"


def _links_within(part: list[dict], percent: int) -> dict | None:
    """Links among the classes of one group: per class the documents it links with, and a
    spanning forest.  Of all groups where a pair meets only one counts it."""
    part.sort(key=lambda r: (r["n"], r["c"]))
    sizes = [r["n"] for r in part]
    ends = np.searchsorted(sizes, [n * 100 // percent for n in sizes], side="right").tolist()
    if all(e <= k + 1 for k, e in enumerate(ends)):
        return None  # no two sizes are near enough
    sides, ring, region, path = {part[0]["lo"], part[0]["hi"]}, part[0]["ring"], part[0]["region"], part[0]["path"]
    n = np.array(sizes, np.int64)
    flat = np.frombuffer(b"".join(r["s"] for r in part), "<u8")
    start = np.append(0, np.cumsum(n))
    ids = np.unique(flat, return_inverse=True, sorted=True)[1]
    mark = np.zeros(int(ids.max()) + 1, np.int32)
    links, forest = [0] * len(part), Forest()

    def counted_here(x: dict, y: dict) -> bool:
        return (max(x["own_ring"], y["own_ring"]) == ring and {x["block"], y["block"]} == sides
                and all(min(a, b) == g for a, b, g in zip(x["homes"], y["homes"], path))
                and min(set(x["regions"]).intersection(y["regions"])) == region)

    for i, end in enumerate(ends):
        if end <= i + 1:
            continue
        own = ids[start[i]:start[i + 1]]
        mark[own] = 1
        both = np.add.reduceat(mark[ids[start[i + 1]:start[end]]], start[i + 1:end] - start[i + 1]).astype(np.int64)
        mark[own] = 0
        for j in (i + 1 + np.flatnonzero(100 * both >= percent * (n[i] + n[i + 1:end] - both))).tolist():
            if counted_here(part[i], part[j]):
                links[i] += part[j]["m"]
                links[j] += part[i]["m"]
                forest.join(part[i]["c"], part[j]["c"])
    hit = [k for k, v in enumerate(links) if v]
    c = [part[k]["c"] for k in hit]
    return {"c": c, "links": [links[k] for k in hit], "root": [forest.root(x) for x in c]} if hit else None


def _may_link(part: list[dict], percent: int) -> list[int]:
    """Classes that may link with another of the group.  A bucket that only one of two sets fills
    holds a shingle that the other lacks, which bounds their common shingles from above."""
    part.sort(key=lambda r: (r["n"], r["c"]))
    n = np.array([r["n"] for r in part], np.int64)
    ends = np.searchsorted(n, n * 100 // percent, side="right")
    least = min(len(r["bits"]) for r in part)
    rows = np.stack([np.bitwise_or.reduce(np.frombuffer(r["bits"], "<u8").reshape(-1, least // 8), axis=0) for r in part])
    full = np.bitwise_count(rows).sum(1, dtype=np.int64)
    sides, block = {part[0]["lo"], part[0]["hi"]}, np.array([r["block"] for r in part])
    live = np.zeros(n.size, bool)
    for i, end in enumerate(ends.tolist()):
        if end > i + 1:
            j = np.arange(i + 1, end)
            both = np.bitwise_count(rows[i] & rows[j]).sum(1, dtype=np.int64)
            most = np.minimum(n[i] - (full[i] - both), n[j] - (full[j] - both))
            near = 100 * most >= percent * (n[i] + n[j] - most)
            if len(sides) == 2:
                near &= block[j] != block[i]
            live[i] |= near.any()
            live[j[near]] = True
    return np.flatnonzero(live).tolist()


def _survivors(member: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """(g0, c): the members of each group that may link within it, found on bucket bits alone."""
    def run(batches):
        for part in _grouped(batches, ["g"]):
            if len(part) > 1 and (live := _may_link(part, percent)):
                yield pa.RecordBatch.from_pydict({k: pa.array([part[x][k] for x in live], pa.int64()) for k in ("g0", "c")})
    slim = _counted(member.withColumn("g0", F.col("g"))).select("g", "g0", "c", "n", "cnt", "block", "lo", "hi")
    groups = slim.where(f"cnt <= {REGION}").unionByName(_in_blocks(slim.where(f"cnt > {REGION}")))
    rows = groups.join(bits, "c").repartition("g").sortWithinPartitions("g")
    return rows.mapInArrow(run, "g0 long, c long").distinct()


def _joined(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of all groups (each of bounded size), tasks working group by group."""
    def run(batches):
        for part in _grouped(batches, ["g"]):
            if len(part) > 1 and (found := _links_within(part, percent)):
                yield pa.RecordBatch.from_pydict(found, schema=pa.schema([(k, pa.int64()) for k in found]))
    rows = groups.join(sets, "c").repartition("g").sortWithinPartitions("g")
    return rows.mapInArrow(run, FOUND)


def _split(large: DataFrame, sets: DataFrame, percent: int, level: int) -> DataFrame:
    """Members of large groups with further pivots: a row (g, c, g2, home2) for each region that a
    member belongs to, its own and those within the triangle window of it."""
    window = 2 * (1 - percent / 100) + 1e-9
    salted = (large.join(sets.select("c", "s"), "c")
              .withColumn("salts", F.expr(f"CAST(ceil(cnt / {REGION}) AS INT)"))
              .withColumn("pivot", F.expr(f"pmod(xxhash64(c, {level}), cnt) < least(16, 2 * salts)")))
    pivots = salted.where("pivot").select("g", "c", "s", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"),
                                          F.lit(0).alias("kind"))
    members = salted.select("g", "c", "s", F.expr("CAST(pmod(xxhash64(c, 's'), salts) AS INT)").alias("salt"),
                            F.lit(1).alias("kind"))

    def run(batches):
        for part in _grouped(batches, ["g", "salt"]):
            tops = [r for r in part if r["kind"] == 0]
            if not tops:
                continue
            points = [np.frombuffer(r["s"], "<u8") for r in tops]
            g, c, to, home = [], [], [], []
            for r in part[len(tops):]:
                d = _distances(np.frombuffer(r["s"], "<u8"), points)
                near = int(np.argmin(d))
                for k in np.flatnonzero(np.array(d) <= d[near] + window).tolist():
                    g.append(r["g"])
                    c.append(r["c"])
                    to.append(tops[k]["c"])
                    home.append(tops[near]["c"])
            yield pa.RecordBatch.from_pydict({"g": g, "c": c, "to": to, "home": home},
                                             schema=pa.schema([(k, pa.int64()) for k in ("g", "c", "to", "home")]))

    rows = pivots.union(members).repartition("g", "salt").sortWithinPartitions("g", "salt", "kind", "c")
    found = rows.mapInArrow(run, "g long, c long, to long, home long")
    return found.selectExpr("g", "c", "xxhash64(g, to) AS g2", "xxhash64(g, home) AS home2")


def _in_blocks(groups: DataFrame) -> DataFrame:
    """Groups that pivots do not separate: every block of members meets every other, and itself."""
    cut = groups.withColumn("nb", F.expr(f"CAST(ceil(2 * cnt / {REGION}) AS INT)"))
    cut = cut.withColumn("block", F.expr("CAST(pmod(xxhash64(c, 'b'), nb) AS INT)"))
    out = cut.withColumn("other", F.explode(F.expr("sequence(0, nb - 1)")))
    return (out.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
            .withColumn("g", F.expr("xxhash64(g, lo, hi)")).drop("nb", "other"))


def _counted(groups: DataFrame) -> DataFrame:
    """With ``cnt``, the members of each group; groups of one go."""
    size = groups.groupBy("g").agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1")
    return groups.join(size, "g")


def _groups(members: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Bounded groups that hold every pair of classes at least once."""
    todo = stored(_counted(members.join(classes.select("c", "m"), "c")))
    done, blocks, order = todo.where(f"cnt <= {REGION}"), [], todo.columns
    for level in range(ROUNDS):
        large = todo.where(f"cnt > {REGION}")
        if large.isEmpty():
            break
        found = stored(_split(large, sets, percent, level))
        inner = found.groupBy("g", "g2").agg(F.count(F.lit(1)).alias("cnt2"))
        cost = inner.groupBy("g").agg(F.sum(F.expr("CAST(cnt2 AS DOUBLE) * cnt2")).alias("cost"))
        judged = stored(large.join(cost, "g", "left").withColumn(
            "apart", F.expr("coalesce(cost < 0.6D * cnt * cnt, false)")).drop("cost"))
        blocks.append(judged.where("NOT apart").select(order))
        todo = stored(_counted(
            judged.where("apart").drop("cnt").join(found, ["g", "c"])
            .withColumn("path", F.expr("array_append(path, g2)"))
            .withColumn("homes", F.expr("array_append(homes, home2)"))
            .withColumn("g", F.col("g2")).drop("g2", "home2", "apart")).select(order))
        done = done.union(todo.where(f"cnt <= {REGION}"))
    for rest in [*blocks, todo.where(f"cnt > {REGION}")]:
        done = done.union(_in_blocks(rest).select(order))
    return done


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                 percent: int = 80) -> DataFrame:
    """One row per document: id (long), ``n_shingles``, ``n_links`` (documents linked directly),
    ``class_id`` (least id with the same set) and ``component_id`` (least id reachable by links).

    Two documents link when 100 * |A and B| >= percent * |A or B| of their word shingles.  A text
    of fewer than ``width`` words is one shingle; a null, empty or blank text has none and links
    with nothing.  A null id stays null and names no class; a set that only rows with null ids have is
    not compared with others.  Repeated rows are documents of their
    own.  Other columns are ignored, whatever their names.
    """
    return _linked(docs, id_col, text_col, width, percent).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "n_links", "class_id", "component_id")


def _linked(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """What ``jaccard_join`` gives, with the set id ``c`` of the row and of the least (id, set id) of its
    component, ``first_c``."""
    spark = docs.sparkSession
    raw = stored(described(docs, id_col, text_col, width, frequent_from=2))
    base = raw.where("kind = 0").select("id", "c", "n")
    shared = raw.where("kind = 1").groupBy("c").agg(F.sum("n").alias("k"))
    levels = {r["l"]: r["cnt"] for r in shared.groupBy(F.expr("CAST(floor(log2(k)) AS INT)").alias("l"))
              .agg(F.count(F.lit(1)).alias("cnt")).collect()}
    least = next(x for x in range(1, 65) if sum(v for k, v in levels.items() if k >= x) <= FREQUENT)
    hot = shared.where(f"k >= {2 ** least}").select("c").toPandas()["c"].to_numpy(np.int64)
    frequent = spark.sparkContext.broadcast(np.sort(hot.view(np.uint64)))

    classes = stored(base.where("n > 0").groupBy("c").agg(
        F.count(F.lit(1)).alias("m"), F.min("id").alias("id"), F.first("n").cast("int").alias("n")))
    chosen = stored(classes.where("id IS NOT NULL").orderBy(F.xxhash64("c", F.lit("pivot")), "c").limit(SAMPLE))
    sample = _of_wanted(docs, id_col, text_col, width, chosen, np.ndarray.tobytes, "s").orderBy("c").toArrow()
    pivots = spread_pivots([np.frombuffer(x.as_py(), "<u8") for x in sample.column("s")], percent)
    regions = spark.sparkContext.broadcast(Regions(pivots, percent))
    member = stored(_members(docs, text_col, width, percent, frequent, regions))
    ratio = (100 / percent) ** 2
    placed = (member.join(classes.select("c", "n"), "c")
              .withColumn("own_ring", F.expr(f"CAST(floor(ln(n) / ln({ratio}D)) AS INT)"))
              .withColumn("ring", F.explode(F.expr(
                  f"CASE WHEN n * {100 / percent}D * 1.000001D >= power({ratio}D, own_ring + 1) "
                  "THEN array(own_ring, own_ring + 1) ELSE array(own_ring) END")))
              .withColumn("g", F.expr("xxhash64(region, ring)"))
              .withColumns({"block": F.lit(0), "lo": F.lit(0), "hi": F.lit(0)}))
    placed = stored(_counted(placed).drop("cnt"))

    def wanted(rows):
        return stored(classes.join(rows.select("c").distinct(), "c", "left_semi").where("id IS NOT NULL"))

    bits = _of_wanted(docs, id_col, text_col, width, wanted(placed), _buckets, "bits")
    live = stored(_survivors(placed, bits, percent))
    placed = stored(placed.join(live.withColumnRenamed("g0", "g"), ["g", "c"], "left_semi"))
    # a linked pair survives wherever both are, so the cells left to each hold all that they share
    own = placed.groupBy("c").agg(F.collect_set("region").alias("regions"))
    none = F.expr("CAST(array() AS array<bigint>)")
    placed = placed.join(own, "c").withColumns({"path": none, "homes": none})
    sets = _of_wanted(docs, id_col, text_col, width, wanted(placed), np.ndarray.tobytes, "s")
    found = stored(_joined(_groups(placed, classes, sets, percent), sets, percent))
    return _labelled(base, classes, found)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                percent: int = 80) -> DataFrame:
    """The documents without all but the least (id, shingle set) of each component, all columns as they are.

    Rows without a shingle or an id stay.  Of rows that repeat id and shingle set one stays."""
    found = _linked(docs, id_col, text_col, width, percent).where("n > 0 AND id IS NOT NULL")
    gone = found.where("NOT (id = component_id AND c = first_c)").select("id", "c").distinct().alias("g")
    d = docs.alias("d")
    same_id = F.col(f"d.{id_col}").cast("long") == F.col("g.id")
    repeated = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("k")).where(F.col(id_col).isNotNull() & (F.col("k") > 1))
    if repeated.isEmpty():  # the id tells the set
        return d.join(gone, same_id, "left_anti")
    named, name = _with_set(docs, text_col, width)
    out = named.alias("d").join(gone, same_id & (F.col(f"d.{name}") == F.col("g.c")), "left_anti")
    whole = F.col(id_col).isNotNull() & F.col(name).isNotNull()
    return out.where(~whole).unionByName(out.where(whole).dropDuplicates([id_col, name])).drop(name)


def _with_set(docs: DataFrame, text_col: str, width: int) -> tuple[DataFrame, str]:
    """``docs`` with the set id of each row (null: no shingle) in a further column, and its name."""
    name, place = fresh("_set", docs), docs.columns.index(text_col)

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            sets = [shingle_set(words(t), width) for t in batch.column(place).to_pylist()]
            own = pa.array([_set_id(s) if s.size else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, own], names=[*batch.schema.names, name])
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())])), name


def _labelled(base: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    root = components(found.selectExpr("c AS u", "root AS v"))
    named = (classes.join(root.withColumnRenamed("node", "c"), "c", "left")
             .join(found.groupBy("c").agg(F.sum("links").alias("links")), "c", "left")
             .withColumn("component", F.coalesce("component", "c")))
    least = named.groupBy("component").agg(F.expr("min(struct(id, c)) FILTER (WHERE id IS NOT NULL)").alias("first"))
    named = named.join(least, "component").select(
        "c", F.col("first.id").alias("component_id"), F.col("first.c").alias("first_c"), F.col("id").alias("class_id"),
        F.expr("m - 1 + coalesce(links, 0)").alias("n_links"))
    out = base.join(named, "c", "left")
    return out.select(
        "id", "c", "n", F.coalesce("n_links", F.lit(0)).alias("n_links"), "first_c",
        F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
