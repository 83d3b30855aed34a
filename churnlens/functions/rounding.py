"""Exact decimal rounding and money helpers.

Spark rounds doubles HALF_UP on their binary value, other engines differ on ties,
and double sums depend on task order.  Rounded figures are therefore computed in
DECIMAL: money is summed unrounded to ten decimals, and each figure is rounded once,
half away from zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unrounded money: 18 digits before the point, 10 after.
MONEY = "DECIMAL(28,10)"
# Numbers from here on are no money: aggregates skip them, whatever they are handed.
MONEY_LIMIT = 1e18


def round_ratio_sql(num: str, den: str, digits: int) -> str:
    """SQL: ``num / den`` rounded half away from zero to ``digits`` decimals, as DOUBLE; NULL where
    ``den`` is NULL or not positive (which also keeps ANSI mode from raising on an empty group).

    ``num`` may have up to ten decimals and 20 digits before the point (NULL beyond), ``den`` is integral.
    The remainder is taken off before dividing, so the division is exact."""
    scale = 10 ** digits
    n, d = f"TRY_CAST(({num}) AS DECIMAL(30,10))", f"CAST(({den}) AS DECIMAL(20,0))"
    doubled = f"(abs({n}) * {2 * scale} + {d})"
    q = f"(({doubled} - {doubled} % ({d} * 2)) / ({d} * 2))"
    return (f"CASE WHEN {d} > 0 THEN CAST(CASE WHEN {n} < 0 THEN -{q} ELSE {q} END AS DOUBLE)"
            f" / {scale} END")


def money_sql(col: str) -> str:
    """SQL: a DOUBLE money column, exact to ten decimals; NULL beyond the money range."""
    return f"TRY_CAST(({col}) AS {MONEY})"


def mean_money_sql(col: str, digits: int = 2) -> str:
    """Aggregate SQL: mean of a money column (NULLs skipped), summed unrounded, rounded once."""
    return round_ratio_sql(f"sum({money_sql(col)})", f"count({money_sql(col)})", digits)


def sum_money_sql(col: str) -> str:
    """Aggregate SQL: sum of a money column, rounded once to the cent; 0.0 for no rows."""
    return f"coalesce({round_ratio_sql(f'sum({money_sql(col)})', '1', 2)}, 0.0D)"


def round_ratio(num: Column | str, den: Column | str, digits: int) -> Column:
    """Column form of :func:`round_ratio_sql`; SQL-text operands give one parsed expression."""
    if isinstance(num, str) and isinstance(den, str):
        return F.expr(round_ratio_sql(num, den, digits))
    scale = 10 ** digits
    n, d = num.try_cast("decimal(30,10)"), den.cast("decimal(20,0)")
    doubled = F.abs(n) * (2 * scale) + d
    q = (doubled - doubled % (d * 2)) / (d * 2)
    return F.when(d > 0, F.when(n < 0, -q).otherwise(q).cast("double") / scale)


def mean_money(col: str, digits: int = 2) -> Column:
    """Aggregate expression: :func:`mean_money_sql`."""
    return F.expr(mean_money_sql(col, digits))


def sum_money(col: str) -> Column:
    """Aggregate expression: :func:`sum_money_sql`."""
    return F.expr(sum_money_sql(col))


def round_double(col: Column, digits: int) -> Column:
    """Round a non-money double (e.g. a density) to ``digits`` decimals."""
    return F.round(col.cast("decimal(38,18)"), digits).cast("double")
