"""Equal-width histogram and Gaussian kernel density of a numeric column.

Both count the distinct values first (one scan and one shuffle; for a money column the counts
are bounded by the value range, at any row count).  The column's statistics are scalar
subqueries over those counts, which reuse the shuffle, and are bound as a struct column.
The histogram is one partial aggregate over ``bins`` groups (empty bins come from a union with a
zero-count grid, not a join).  The KDE expands each distinct value against the fixed grid inside
the task and sums per grid point, so the shuffle carries at most ``grid`` rows per task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import MONEY, round_double


def _counted(df: DataFrame, col: str, kind: str) -> DataFrame:
    """Distinct non-null values ``x`` of ``col`` and how many rows have them (``w``)."""
    vals = df.select(F.col(col).try_cast(kind).alias("x")).where(F.col("x").isNotNull())
    return vals.groupBy("x").agg(F.count(F.lit(1)).alias("w"))


def histogram(df: DataFrame, col: str, bins: int = 30, decimals: int | None = 2) -> DataFrame:
    """bin (0-based), bin_start, bin_end, count; every bin present; bins ``[a, b)``, last closed.

    With ``decimals`` (money: 2) values are binned as exact decimals, unrounded, so a value
    lying on an edge always opens the upper bin, as it does mathematically, and edges are
    computed in units of 10^-decimals; ``decimals=None`` bins the doubles directly.  A constant
    column gets the unit range around its value, as numpy does.
    """
    grid = (df.sparkSession.range(bins)
            .selectExpr("CAST(id AS INT) AS bin", "CAST(0 AS BIGINT) AS n"))
    kind = "double" if decimals is None else MONEY
    counted = _counted(df, col, kind)
    lo0, hi0, half = F.min("x"), F.max("x"), F.lit(0.5).cast("double" if decimals is None else "decimal(2,1)")
    stats = counted.select(F.struct(
        F.when(lo0 == hi0, lo0 - half).otherwise(lo0).cast(kind).alias("lo"),
        F.when(lo0 == hi0, hi0 + half).otherwise(hi0).cast(kind).alias("hi")).alias("s")).scalar()
    if decimals is None:
        index = "CAST(least(floor((x - _s.lo) * {0} / (_s.hi - _s.lo)), {0} - 1) AS INT)"
        edge = "_s.lo + ({1}) * (_s.hi - _s.lo) / {0}"
    else:
        offset = "CAST((x - _s.lo) * {0} AS DECIMAL(30,10))"
        width = "CAST(_s.hi - _s.lo AS DECIMAL(28,10))"
        # the remainder is taken off first, so the division is exact
        index = f"CAST(least(({offset} - {offset} % {width}) / {width}, {{0}} - 1) AS INT)"
        edge = (f"CAST((_s.lo * {{0}} + ({{1}}) * (_s.hi - _s.lo)) * {10 ** decimals} AS DOUBLE)"
                f" / ({{0}} * {10 ** decimals})")
    hits = counted.withColumn("_s", stats).select(F.expr(index.format(bins)).alias("bin"), F.col("w").alias("n"))
    counts = hits.unionByName(grid).groupBy("bin").agg(F.sum("n").alias("count"))
    return counts.withColumn("_s", stats).select(
        "bin", F.expr(edge.format(bins, "bin")).alias("bin_start"),
        F.expr(edge.format(bins, "bin + 1")).alias("bin_end"), "count")


def _curve_stats(counted: DataFrame):
    """One struct over the distinct values: n, lo, hi and the sample deviation (NULL if there is none)."""
    n = F.sum("w")
    rough = counted.select(F.struct(n.alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"),
                                    (F.sum(F.col("x") * F.col("w")) / n).alias("mean")).alias("s")).scalar()
    spread = F.sum(F.pow(F.col("x") - F.col("_r.mean"), F.lit(2)) * F.col("w"))
    return counted.withColumn("_r", rough).groupBy("_r").agg(spread.alias("ss")).select(
        F.struct("_r.n", "_r.lo", "_r.hi", F.expr("CASE WHEN _r.n > 1 AND ss > 0 THEN sqrt(ss / (_r.n - 1)) END")
                 .alias("sd")).alias("s")).scalar()


def _curve(sums: DataFrame, stats, grid: int, hist_bins: int, density_digits: int, count_digits: int) -> DataFrame:
    """The curve from the kernel sums ``s`` of the grid points."""
    n, lo, hi = F.col("_s.n"), F.col("_s.lo"), F.col("_s.hi")
    h = F.col("_s.sd") * F.pow(n.cast("double"), F.lit(-0.2))
    step = (hi - lo) / (grid - 1)
    density = F.col("s") / (n * h * math.sqrt(2 * math.pi))
    return sums.withColumn("_s", stats).select(
        F.col("point").cast("int").alias("point"),
        (lo + F.col("point") * step).alias("x"),
        round_double(density, density_digits).alias("density"),
        round_double(density * n * (hi - lo) / hist_bins, count_digits).alias("count_density"),
    )


def kde(df: DataFrame, col: str, grid: int = 200, hist_bins: int = 30,
        density_digits: int = 10, count_digits: int = 6) -> DataFrame:
    """Gaussian KDE on ``grid`` evenly spaced points over [min, max].

    Bandwidth is Scott's rule: sample std * n^(-1/5).  Columns: point, x,
    density (probability density) and count_density (density * n * histogram
    bin width, i.e. on the scale of the ``hist_bins`` histogram).  A constant column (or one
    value) has no bandwidth: its points have NULL densities.

    Every distinct value meets every grid point: for money and other columns of few values.  For
    continuous ones see :func:`kde_binned`.
    """
    counted = _counted(df, col, "double")
    stats = _curve_stats(counted)
    n, lo, hi = F.col("_s.n"), F.col("_s.lo"), F.col("_s.hi")
    h = F.col("_s.sd") * F.pow(n.cast("double"), F.lit(-0.2))
    step = (hi - lo) / (grid - 1)
    expanded = counted.withColumn("_s", stats).select(
        "x", "w", "_s", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point"))
    z = (lo + F.col("point") * step - F.col("x")) / h
    sums = expanded.groupBy("point").agg(F.sum(F.col("w") * F.exp(z * z * -0.5)).alias("s"))
    return _curve(sums, stats, grid, hist_bins, density_digits, count_digits)


def kde_binned(df: DataFrame, col: str, grid: int = 200, hist_bins: int = 30, error: float = 1e-6,
               density_digits: int = 10, count_digits: int = 6) -> DataFrame:
    """:func:`kde` of a continuous column, each density within ``error`` times the kernel's peak,
    1 / (bandwidth * sqrt(2 pi)), of the exact one before rounding.

    Every value is dealt linearly to the two nodes around it on a fine grid of width d, which puts
    the chord of the kernel between the nodes in the kernel's place.  With the bandwidth as unit the
    kernel exp(-z^2/2) has a second derivative of at most 1, so the chord is off by d^2/8 at most;
    d = 2 sqrt(error) makes that half the error.  Nodes further than sqrt(2 ln(2/error)) bandwidths
    from a point are left out, each less than the other half.  So the kernel is evaluated per node
    in use and near grid point, and not per distinct value; nodes are counted in each task before
    the shuffle.  The statistics are exact, from one more pass over the rows.
    """
    if not 0 < error < 1:
        raise ValueError("error must lie between 0 and 1")
    rows = df.select(F.col(col).try_cast("double").alias("x")).where("x IS NOT NULL AND abs(x) < double('inf')")
    stats = _curve_stats(rows.select("x", F.lit(1).alias("w")))
    n, lo, hi = F.col("_s.n"), F.col("_s.lo"), F.col("_s.hi")
    h = F.col("_s.sd") * F.pow(n.cast("double"), F.lit(-0.2))
    place = (F.col("x") - lo) / (h * (2 * math.sqrt(error)))
    placed = rows.withColumn("_s", stats).select(F.when(h > 0, place).alias("p"))
    left = F.floor("p")
    # a sum of whole units of 2^-30: the result does not depend on the order of the rows
    share = F.round((F.col("p") - left) * 2**30).cast("decimal(20,0)")
    ends = F.array(F.struct(left.alias("node"), (F.lit(2**30) - share).alias("w")),
                   F.struct((left + 1).alias("node"), share.alias("w")))
    nodes = placed.where("p IS NOT NULL").select(F.inline(ends)).groupBy("node").agg(F.sum("w").alias("w"))
    nodes = nodes.withColumn("_s", stats).select(
        (lo + F.col("node") * h * (2 * math.sqrt(error))).alias("x"), (F.col("w").cast("double") / 2**30).alias("w"), "_s")
    step, reach = (hi - lo) / (grid - 1), h * math.sqrt(2 * math.log(2 / error))
    first = F.greatest(F.ceil((F.col("x") - reach - lo) / step), F.lit(0))
    last = F.least(F.floor((F.col("x") + reach - lo) / step), F.lit(grid - 1))
    near = nodes.withColumn("first", first).withColumn("last", last).where("first <= last").select(
        "x", "w", "_s", F.explode(F.sequence("first", "last")).alias("point"))
    z = (lo + F.col("point") * step - F.col("x")) / h
    kernel = near.select("point", (F.col("w") * F.exp(z * z * -0.5)).alias("s"))
    # every point of the grid appears, also of a constant column, whose densities are NULL
    points = df.sparkSession.range(grid).select(F.col("id").alias("point"), F.lit(0.0).alias("s"))
    seen = rows.limit(1).select(F.lit(1).alias("one")).scalar()
    points = points.withColumn("one", seen).where("one IS NOT NULL").drop("one")
    sums = kernel.unionByName(points).groupBy("point").agg(F.sum("s").alias("s"))
    return _curve(sums, stats, grid, hist_bins, density_digits, count_digits)
