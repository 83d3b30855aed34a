"""Sharding by longest processing time: groups that stay together go, largest first, to the
shard with the least load so far.

Groups are rows of equal text.  Groups of one size are alike to the schedule, so it is made over the
distinct sizes with their numbers of groups: a heap step for a single group, and for many at once
the same outcome in closed form (:func:`dealt`).  What reaches the driver is one row per distinct
size of a group.  Different sizes add up, so there are at most sqrt(2 * bytes) of them, whatever
the number of documents.  The groups of a size are then numbered, in parts, and take their shards
by number.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import row_count, stored

#: Rows that one task ranks within a shard or a size.
ROWS_A_TASK = 20_000


def dealt(loads: list[int], size: int, number: int) -> list[int]:
    """How many of ``number`` groups of one size each shard gets, if each goes to the shard with the least
    load (the first of them): the steps load, load + size, ... of all shards are taken in order."""
    order = np.array(loads, np.int64)
    low, high = int(order.min()), int(order.min()) + size * number
    while low < high:  # the largest level below which there are no more than ``number`` steps
        level = (low + high + 1) // 2
        if int(np.maximum(0, -((order - level) // size)).sum()) <= number:
            low = level
        else:
            high = level - 1
    out = np.maximum(0, -((order - low) // size))
    rest = number - int(out.sum())
    out[np.flatnonzero((order + out * size) == low)[:rest]] += 1
    return out.tolist()


def longest_first(sizes: list[tuple[int, int]], shards: int) -> list[list[tuple[int, int]]]:
    """For each (size, number of groups), by falling size: (shard, how many of them it gets)."""
    heap, out = [(0, k) for k in range(shards)], []
    for size, number in sizes:
        if number == 1:
            load, k = heap[0]
            heapq.heapreplace(heap, (load + size, k))
            out.append([(k, 1)])
            continue
        heap.sort(key=lambda x: x[1])
        given = dealt([load for load, _ in heap], size, number)
        out.append([(k, n) for k, n in enumerate(given) if n])
        heap = [(load + n * size, k) for (load, k), n in zip(heap, given)]
        heapq.heapify(heap)
    return out


def numbered(df: DataFrame, key: str, spread: str, order: list, out: str, rows: int) -> DataFrame:
    """``out``: the place of each row among those of its ``key``, gapless from 0.  The hash of
    ``spread`` deals the rows over parts, which are counted first, so that no task holds more
    than one part of a key."""
    parts = -(-rows // ROWS_A_TASK) or 1
    df = df.withColumn("_part", F.expr(f"CAST(pmod(xxhash64({spread}, 'slot'), {parts}) AS INT)"))
    before = df.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = before.withColumn("_base", F.coalesce(F.sum("_n").over(
        Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order))
    got = df.withColumn("_rank", rank).join(before, [key, "_part"])
    return got.withColumn(out, F.col("_base") + F.col("_rank") - 1).drop("_base", "_rank", "_part")


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``size`` (UTF-8 bytes of the text plus 16), ``text_crc32``
    (unsigned), ``law`` ('bytes': sizes of shards are near equal), ``shard``, ``slot`` (its place in the
    shard, gapless from 0) and ``grown_shard`` (null: this law has no rule for one more shard).

    Equal texts share a shard.  A null text has no bytes and the checksum 0, as an empty one, and
    shares its group; rows with a null id are kept.  Repeated rows have slots of their own.  An
    empty table gives no rows.  Other columns are ignored, whatever their names.  A single group
    larger than a shard's share stays whole; the other shards are then equal to each other.
    """
    spark, text = docs.sparkSession, F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = stored(docs.select(
        docs[id_col].alias("_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"))
        .withColumn("item", F.xxhash64("key", "text_crc32")).drop("key"))
    groups = stored(rows.groupBy("item").agg(F.sum("size").alias("bytes")))
    sizes = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by([("bytes", "descending")])
    sizes = list(zip(sizes.column("bytes").to_pylist(), sizes.column("n").to_pylist()))
    plan = longest_first(sizes, shards)
    told = spark.createDataFrame(pa.table({
        "bytes": pa.array([b for b, _ in sizes], pa.int64()),
        "upto": pa.array([np.cumsum([n for _, n in given]).tolist() for given in plan], pa.list_(pa.int64())),
        "to": pa.array([[k for k, _ in given] for given in plan], pa.list_(pa.int32()))}))
    placed = numbered(groups, "bytes", "item", ["item"], "number", row_count(groups)).join(told, "bytes").select(
        "item", F.expr("element_at(to, size(filter(upto, x -> x <= number)) + 1)").alias("shard"))
    placed = stored(rows.join(placed, "item").drop("item"))
    out = numbered(placed, "shard", "_id", ["_id", "text_crc32"], "slot", row_count(placed))
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
