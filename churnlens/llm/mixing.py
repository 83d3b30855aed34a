"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its shuffled documents, repeated as often as allowed.  The virtual
finish time of a copy is the words its source has given with it, divided by the source's target.
The copies of all sources are sorted by that time over ranges, and the mix ends where its running
total of words would exceed the budget, for a source at the latest at time 1, when it has given its
target.  Whole documents are taken, so a source then lacks part of the copy across its end; what it
lacks is made up from its later copies, one of each size class at most (:func:`_made_up`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import fresh, row_count, stored

#: Rows that one task sums up in order.
ROWS_A_TASK = 20_000
#: Sources that the driver computes targets for; more are refused, not dropped.
MOST_SOURCES = 100_000
#: SQL: the three leading bits of a number of words, and how many bits follow.
SIZE_CLASS = ("CASE WHEN words < 8 THEN words ELSE length(bin(words)) * 4 - 4 + shiftright(words, length(bin(words)) - 3) END")
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict[str | None, int], weights: tuple[float, ...], most: float) -> dict[str | None, float]:
    """Words for each source: the total by weight (sources by code point, null last, weights
    repeating), none above ``most`` times its size; the excess is shared again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[k % len(weights)]) for k, s in enumerate(order)}
    left, fixed = float(sum(sizes.values())), {}
    while rest := [s for s in order if s not in fixed]:
        whole = sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / whole > most * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / whole for s in rest}
        for s in over:
            fixed[s] = float(most * sizes[s])
        left = max(0.0, left - sum(fixed[s] for s in over))
    return fixed


def _running(df: DataFrame, keys: list[str], part: str, order: list, value: str, out: str) -> DataFrame:
    """``out``: sum of ``value`` up to and with the row, per ``keys``, in the order (part, order).
    Parts are summed first, so no task holds more than one part."""
    base = df.groupBy(*keys, part).agg(F.sum(value).alias("_sum"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    base = base.withColumn("_base", F.coalesce(F.sum("_sum").over(
        whole.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    own = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    got = df.withColumn("_own", F.sum(value).over(own)).alias("d")
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col(f"d.{part}") == F.col(f"b.{part}")]
    on = same[0]
    for x in same[1:]:
        on = on & x
    return got.join(base.alias("b"), on).select("d.*", (F.col("_own") + F.col("_base")).alias(out)).drop("_own")


def _units(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Documents as the mix takes them: equal rows (id, source, text) are one unit of ``rows`` rows."""
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].alias("_id"), docs[source_col].cast("string").alias("_source"),
                       F.xxhash64(text).alias("_text"),
                       F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    return rows.groupBy("_id", "_source", "_text", "size").agg(F.count(F.lit(1)).alias("rows"))


def _up_to_budget(copies: DataFrame, budget: int) -> DataFrame:
    """The copies up to the range in which the running total of words passes ``budget``: no later one
    can be taken, so they need no sorting."""
    sums = copies.groupBy("range").agg(F.sum("words").alias("s"))
    upto = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    last = sums.withColumn("total", F.sum("s").over(upto)).where(F.col("total") > budget).agg(F.min("range")).first()[0]
    return copies if last is None else copies.where(F.col("range") <= last)


def _made_up(late: DataFrame, told: DataFrame, taken: DataFrame) -> DataFrame:
    """Of the ``late`` copies those that bring each source nearer its target.

    Of each class of sizes (four to each power of two) the first late copy in the queue is a
    candidate, so a source has less than 256.  From the largest on, a candidate that still fits is taken;
    at last the one, if any, whose excess is less than what would be lacking without it."""
    given = taken.groupBy("_source").agg(F.sum("words").alias("given"))
    first = late.groupBy("_source", F.expr(SIZE_CLASS).alias("class")).agg(
        F.min_by(F.struct("words", "_id", "_text"), F.struct("finish", "h", "_id", "_text", "epoch")).alias("c"))
    found = first.groupBy("_source").agg(F.sort_array(F.collect_list("c"), False).alias("found"))
    same = F.col("f._source").eqNullSafe(F.col("t._source"))
    lacking = (found.alias("f").join(told.alias("t"), same).join(given.alias("g"), F.col("f._source").eqNullSafe(F.col("g._source")), "left")
               .select("f._source", "found", (F.col("target") - F.coalesce("given", F.lit(0))).alias("lack")))
    fitted = lacking.withColumn("s", F.expr(
        "aggregate(found, named_struct('lack', lack, 'got', slice(found, 1, 0)), (s, c) -> "
        "IF(c.words <= s.lack, named_struct('lack', s.lack - c.words, 'got', array_append(s.got, c)), s))"))
    nearest = fitted.withColumn("last", F.expr(
        "array_min(transform(array_except(found, s.got), c -> named_struct('off', abs(c.words - s.lack), 'c', c)))"))
    return nearest.select("_source", F.inline(F.expr(
        "IF(last.off < s.lack, array_append(s.got, last.c), s.got)"))).select("_id", "_source", "_text")


def decisions(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, seed: int = 7,
              id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per unit (see ``_units``): ``size``, ``rows``, ``source_size``, ``target`` and ``copies``, how often the
    mix takes it.  The shuffle is a hash of seed, id and text: reruns agree."""
    spark, units = docs.sparkSession, stored(_units(docs, id_col, text_col, source_col))
    per_source = units.groupBy("_source").agg(F.sum(F.expr("size * rows")).alias("s")).limit(MOST_SOURCES + 1).collect()
    if len(per_source) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sizes = {r["_source"]: r["s"] for r in per_source}
    goal, budget = targets(sizes, weights, most), sum(sizes.values())
    told = spark.createDataFrame([(s, n, goal[s]) for s, n in sizes.items()],
                                 "_source string, source_size long, target double")
    parts = -(-row_count(units) // ROWS_A_TASK) or 1
    same = F.col("u._source").eqNullSafe(F.col("t._source"))
    queued = (units.alias("u").join(F.broadcast(told).alias("t"), same).select("u.*", "t.source_size", "t.target")
              .withColumn("words", F.expr("size * rows"))
              .withColumn("h", F.expr(f"xxhash64({seed}, _id, _text)"))
              # the part is the upper end of the hash, so parts follow each other in the order
              .withColumn("h", F.expr("shiftrightunsigned(h, 1)"))
              .withColumn("part", F.expr(f"CAST((h >> 32) * {parts} >> 31 AS INT)")))
    order = ["h", F.col("_id").asc_nulls_last(), "_text"]
    queued = _running(queued, ["_source"], "part", order, "words", "given")
    copies = (queued.where("words > 0 AND target > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
              .withColumn("finish", F.expr("(epoch * CAST(source_size AS DOUBLE) + given) / target")))
    # virtual time advances with words, so equal ranges of it hold about as many copies each
    copies = stored(copies.select("_id", "_source", "_text", "size", "words", "h", "epoch", "finish")
                    .withColumn("range", F.expr(f"CAST(floor(least(finish, 1000D) * {4 * parts}) AS INT)")))
    order = ["finish", F.col("_source").asc_nulls_last(), "h", F.col("_id").asc_nulls_last(), "_text", "epoch"]
    early = _running(_up_to_budget(copies, budget), [], "range", order, "words", "total")
    early = stored(early.where((F.col("total") <= budget) & (F.col("finish") <= 1)).select("_id", "_source", "_text", "words"))
    key = ["_id", "_source", "_text"]
    taken = early.select(*key).union(_made_up(copies.where("finish > 1"), told, early))
    taken = taken.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"))
    on = [F.col(f"q.{k}").eqNullSafe(F.col(f"k.{k}")) for k in key]
    out = queued.alias("q").join(taken.alias("k"), on[0] & on[1] & on[2], "left")
    return out.select(*[f"q.{k}" for k in key], "q.size", "q.rows", "q.source_size", "q.target",
                      F.coalesce("k.copies", F.lit(0)).alias("copies"))


def mix_report(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: id, ``size`` (words), ``source_size``, ``target`` and ``taken``, the words the mix
    takes of it, repeats counted.

    A null or blank text has size 0 and is never taken; a null source is a source.  Equal rows are
    decided together and each keeps its row.  An empty table gives no rows.  Other columns are
    ignored, whatever their names."""
    out = decisions(docs, id_col=id_col, **options)
    out = out.withColumn("_row", F.explode(F.expr("sequence(1L, rows)")))
    return out.select(F.col("_id").alias(id_col), "size", "source_size", "target",
                      (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        **options) -> DataFrame:
    """The mixed documents with all their columns: each row as often as the mix takes it.

    Nulls, blank texts, repeated rows and empty tables as in :func:`mix_report`: a document that
    is never taken has no row, and each of some equal rows comes as often as the others."""
    chosen = decisions(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    chosen = chosen.where("copies > 0").select("_id", "_source", "_text", "copies").alias("k")
    d = docs.alias("d")
    on = (F.col(f"d.{id_col}").eqNullSafe(F.col("k._id")) & F.col(f"d.{source_col}").cast("string").eqNullSafe(F.col("k._source"))
          & (F.xxhash64(F.col(f"d.{text_col}").cast("string")) == F.col("k._text")))
    copy = fresh("copy", docs)
    return (d.join(chosen, on).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("k.copies").cast("int"))))
            .select(*[f"d.`{c}`" for c in docs.columns]))
