"""Bounded samples of labelled rows, chosen by hash: reruns agree, no sort, no window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes that a sample may have; more are refused.
MOST_CLASSES = 512


def remainder(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(column.cast("string").cast("binary")) % modulus


def rates(rows: DataFrame, label: str, bound: int) -> dict:
    """For each value of ``label`` the part of its rows that makes about ``bound`` of them."""
    found = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(MOST_CLASSES + 1).collect()
    if len(found) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} values of {label}")
    return {r[label]: min(1.0, bound / r["n"]) for r in found}


def chosen(label: str, key: str, part: dict) -> Column:
    """Whether a row is in the sample: about ``bound`` rows of each value, whatever the table's size."""
    if not part:
        return F.lit(False)
    rate = F.create_map(*[F.lit(x) for pair in part.items() for x in pair])[F.col(label)]
    return F.expr(f"shiftrightunsigned(xxhash64({key}, 'sample'), 11)") / F.lit(float(2**53)) < rate
