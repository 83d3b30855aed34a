"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import stored


class Forest:
    """Union-find over the values of one batch of links; the root of a tree is its least value."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (above := up.get(top, top)) != top:
            top = above
        while (above := up.get(x, x)) != top:
            up[x], x = top, above
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def stars(self) -> tuple[list[int], list[int]]:
        return list(self.up), [self.root(x) for x in self.up]


def contracted(links: DataFrame) -> DataFrame:
    """Links (u, v) with the same components but at most one per value and batch."""
    def run(batches):
        for batch in batches:
            forest = Forest()
            for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
                forest.join(a, b)
            u, v = forest.stars()
            yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})
    return links.mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (u long, v long): the least node that its
    links lead to.  Null ends and loops are dropped; an empty table gives an empty table.

    Each round writes its stars to the shared folder, so a lost executor costs no more than the
    round; the rounds end when a checksum of the stars stands still (O(log n) of them)."""
    links = links.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").selectExpr("u", "v")
    stars, sign = stored(contracted(links).distinct()), None
    while True:
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == sign:
            return stars.selectExpr("u AS node", "v AS component").union(
                stars.selectExpr("v AS node", "v AS component")).distinct()
        sign = now
        both = stars.union(stars.selectExpr("v AS u", "u AS v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").selectExpr("v AS u", "m AS v").where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").selectExpr("v AS u", "m AS v")
        stars = stored(small.union(least.selectExpr("u", "m AS v")).distinct())
