"""Document fingerprints by consistent weighted sampling.

For each of K places and each term of a document two gamma variates and a uniform one, drawn from
the term's hash, quantise the logarithm of the term's weight and give it a value; the term of
least value and its quantum are the sample of that place.  Two documents agree in a place
with the probability of their generalised Jaccard similarity, sum of minima over sum of maxima
of the weights (here: how often a word occurs).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import row_count
from .pretokens import blocks
from .shingles import mixed, words

#: Places of a fingerprint; the standard error of a likeness is at most 0.5 / sqrt(PLACES).
PLACES = 128
#: Documents that one range of neighbours holds.
ROWS_A_RANGE = 4000
#: Quantiles that part the ids.
MOST_RANGES = 20_000
#: Terms whose variates are drawn at once.
TERMS_AT_ONCE = 256

_PLACE = mixed(np.arange(1, 3 * PLACES + 1, dtype=np.uint64)).reshape(3, PLACES)


def _uniforms(term: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two uniform variates of 24 bits, between 0 and 1, for each term and place."""
    drawn = term ^ _PLACE[k]
    high = drawn >> np.uint64(33)
    for odd in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):  # shingles.mixed, in place
        drawn ^= high
        drawn *= np.uint64(odd)
        np.right_shift(drawn, np.uint64(33), out=high)
    drawn ^= high
    # two halves of 24 bits each
    parts = drawn.view(np.uint32).reshape(*drawn.shape, 2) >> np.uint32(8)
    out = parts.astype(np.float32)
    out += np.float32(0.5)
    out *= np.float32(2**-24)
    return out[..., 0], out[..., 1]


def _samples(term: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value and quantum of each (term, weight) in each place."""
    value = np.empty((term.size, PLACES), np.float32)
    quantum = np.empty((term.size, PLACES), np.int16)
    for a in range(0, term.size, TERMS_AT_ONCE):
        t = term[a:a + TERMS_AT_ONCE, None]
        (u, v), (x, y), (shift, _) = (_uniforms(t, k) for k in range(3))
        r = np.log(u * v)
        np.negative(r, out=r)
        q = np.log(weight[a:a + TERMS_AT_ONCE, None].astype(np.float32)) / r
        q += shift
        np.floor(q, out=q)
        quantum[a:a + TERMS_AT_ONCE] = np.clip(q, 0, 32767)
        q -= shift
        q += 1
        q *= r
        np.subtract(np.log(-np.log(x * y)), q, out=value[a:a + TERMS_AT_ONCE])
    return value, quantum


def weighted_terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words (A-Z lower-cased) and how often each occurs."""
    found = np.sort(np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words(text))), "<u8"))
    first = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if found.size else np.zeros(0, np.int64)
    return found[first], np.diff(np.append(first, found.size))


def fingerprints(texts: list[str]) -> list[np.ndarray | None]:
    """PLACES 16-bit samples of each text; none for a text without words."""
    out: list[np.ndarray | None] = []
    for a, b in blocks(texts):
        sets = [weighted_terms(t) for t in texts[a:b]]
        term, weight = (np.concatenate([s[k] for s in sets]) for k in (0, 1))
        both = np.stack([term.view(np.int64), weight.astype(np.int64)], 1)
        order = np.lexsort((both[:, 1], both[:, 0]))
        new = np.append(True, (both[order][1:] != both[order][:-1]).any(1)) if term.size else np.zeros(0, bool)
        row = np.empty(term.size, np.int64)
        row[order] = np.cumsum(new) - 1
        first = order[new]
        value, quantum = _samples(term[first], weight[first])
        name = mixed(term[first])
        place, start = np.arange(PLACES), 0
        for found, _ in sets:
            own = row[start:start + found.size]
            start += found.size
            if not found.size:
                out.append(None)
                continue
            best = own[value[own].argmin(axis=0)]
            tag = mixed(name[best] + quantum[best, place].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            out.append((tag >> np.uint64(48)).astype("<u2"))
    return out


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Share of places that agree; texts without words are alike among themselves only."""
    if a is None or b is None:
        return float(a is b)
    return float((a == b).mean())


def _text(f: np.ndarray | None) -> str:
    return "" if f is None else f.tobytes().hex()


def _ranges(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows in ranges of falling id, each range followed by a ghost, the first row after it (after
    the last row: the first of all), so that a task sees every row beside its next.

    Quantiles of the ids part the ranges; an id (or null) that more rows have than a range should
    hold is parted further by the hash of the text, which orders the rows of one id.  There are
    :data:`MOST_RANGES` quantiles at most, whatever the rows: a task takes its range as a stream, so
    ranges may be long, and the driver sees the ends of ranges and the frequent ids alone."""
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    count = row_count(rows)
    number = max(1, min(MOST_RANGES, -(-count // ROWS_A_RANGE)))
    ids = rows.select("id").where("id IS NOT NULL").withColumn("x", F.col("id").cast("double"))
    cuts = ids.approxQuantile("x", [k / number for k in range(1, number)], 0.2 / number) if number > 1 else []
    # at most ``number`` ids can have more rows than the mean range
    frequent = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > count / number).collect()
    # beyond 2^53 neighbouring ids are one double; then the id does not get a range of its own
    parted = {r["id"]: -(-r["n"] * number // count) for r in frequent if r["id"] is None or abs(r["id"]) < 2**53}
    own = [x for i in parted if i is not None for x in (float(i), float(i) + 1)]
    splits = [-np.inf, *sorted({*cuts, *own} or {0.0}), np.inf]
    cut = Bucketizer(splits=splits, inputCol="x", outputCol="b", handleInvalid="keep")
    told = spark.createDataFrame([(i, n) for i, n in parted.items()], "fid long, parts long")

    def ranged(df):
        got = cut.transform(df.withColumn("x", F.col("id").cast("double"))).join(
            F.broadcast(told), F.col("id").eqNullSafe(F.col("fid")), "left")
        above = F.when(F.col("id").isNull(), len(splits)).otherwise(len(splits) - F.col("b")).cast("long")
        # the hash as a fraction of its range, so that parts follow each other in its order
        part = F.coalesce(F.expr("least(CAST((CAST(tie AS DOUBLE) / 18446744073709551616D + 0.5D) * parts AS BIGINT), parts - 1)"), F.lit(0))
        return got.withColumn("range", above * F.lit(1 << 32) + part).drop("x", "b", "fid", "parts")

    order = F.struct(F.col("id").isNull(), -F.col("id").cast("decimal(20,0)"), "tie")
    heads = sorted(ranged(rows.select("id", "tie")).groupBy("range").agg(F.min_by(F.struct("id", "tie"), order).alias("h")).collect())
    ghosts = spark.createDataFrame([(heads[k].h.id, heads[k].h.tie, heads[k - 1].range) for k in range(len(heads))],
                                   "hid long, htie long, before long")
    rows = rows.join(F.broadcast(ghosts), F.col("id").eqNullSafe(F.col("hid")) & (F.col("tie") == F.col("htie")), "left")
    rows = ranged(rows.select("id", "text", "tie", "before"))
    places = F.when(F.col("before").isNull(), F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("ghost"))))
    places = places.otherwise(F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("ghost")),
                                      F.struct(F.col("before").alias("range"), F.lit(1).alias("ghost"))))
    rows = rows.select("id", "text", "tie", F.inline(places))
    return rows.repartitionByRange(max(1, len(heads)), "range").sortWithinPartitions(
        "range", "ghost", F.col("id").desc_nulls_last(), "tie").select("id", "text", "ghost")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_chars`` (code points), ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``.

    The edited text is the text with its last floor(n_chars / 3) code points replaced by as many of
    the beginning of the next document, or all it has; documents follow each other by falling id,
    null ids last, and the first follows the last.  Equal texts have equal fingerprints.  A null
    text counts as empty; a text without words has the empty fingerprint, which is like itself only.
    Repeated rows follow each other, equal ids in the order of a hash of their texts.  Other columns
    are ignored, whatever their names.  One shuffle of the texts into ranges of ids."""
    def work(held: list[tuple]) -> dict:
        own = [t for _, t, _ in held]
        cut = [len(t) - len(t) // 3 for t in own]
        edited = [t[:c] + nxt[:len(t) - c] for t, c, nxt in zip(own, cut, own[1:])]
        # a text and its edited form beside each other, so that what they share is drawn once
        both = fingerprints([t for pair in zip(own, [*edited, ""]) for t in pair])
        prints, after = both[::2], both[1::2]
        keep = [k for k in range(len(edited)) if not held[k][2]]
        return {"_id": pa.array([held[k][0] for k in keep], pa.int64()),
                "n_chars": pa.array([len(own[k]) for k in keep], pa.int64()),
                "edited_sha256": [hashlib.sha256(edited[k].encode()).hexdigest() for k in keep],
                "fingerprint": [_text(prints[k]) for k in keep],
                "edited_fingerprint": [_text(after[k]) for k in keep],
                "near_edited": [likeness(prints[k], after[k]) for k in keep],
                "near_next": [likeness(prints[k], prints[k + 1]) for k in keep]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("id", "text", "ghost"))):
                held.append(row)
                size += len(row[1])
                if size > 1 << 21 and len(held) > 1:
                    yield pa.RecordBatch.from_pydict(work(held))
                    held, size = held[-1:], len(row[1])
        if len(held) > 1:
            yield pa.RecordBatch.from_pydict(work(held))

    out = _ranges(docs, id_col, text_col).mapInArrow(
        run, "_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")
    return out.withColumnRenamed("_id", id_col)
