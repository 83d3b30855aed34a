"""Right-closed binning (``(a, b]``, lowest edge excluded), as Column expressions.

Spark's Bucketizer is ``[a, b)``, so bins are written as one CASE expression:
values outside ``(edges[0], edges[-1]]`` and NULLs get a NULL band and are left
out of band aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

# Tenure bands (months) and their labels.
TENURE_EDGES = [0, 6, 12, 24, 36, 48, 60, 72]
TENURE_LABELS = ["0-6", "7-12", "13-24", "25-36", "37-48", "49-60", "61-72"]

# Monthly-charge bands and their labels.
CHARGE_EDGES = [0, 30, 50, 70, 90, 120]
CHARGE_LABELS = ["Basic", "Standard", "Plus", "Premium", "Enterprise"]


def band_ordinal_sql(col: str, edges: Sequence[float]) -> str:
    """SQL: 1-based index of the ``(edges[i-1], edges[i]]`` bin holding ``col``; NULL outside."""
    arms = " ".join(f"WHEN `{col}` <= {upper} THEN {i}" for i, upper in enumerate(edges[1:], start=1))
    return f"CASE WHEN `{col}` > {edges[0]} THEN CASE {arms} END END"


def band_label_sql(ordinal: str, labels: Sequence[str]) -> str:
    items = ", ".join("'" + x.replace("'", "\\'") + "'" for x in labels)
    return f"element_at(array({items}), {ordinal})"
