"""Exact order statistics and running sums over many values, without a task that holds them all.

Values are counted first (a partial aggregate), dealt into ranges between approximate quantiles, and ranges' sums give what
lies before each range. Only windows within a range are sorted, so a hot group is as many tasks as it has ranges. Ranges
decide only who works on what; results are exact whatever the approximation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGES = 256


def ranged(counts: DataFrame, by: list[str], x: str) -> DataFrame:
    """Adds `range`: the number of approximate quantiles (RANGES of each group, a row a group) below x."""
    points = counts.groupBy(*by).agg(F.percentile_approx(x, F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)]), 1000).alias("_points"))
    joined = counts.join(points, by) if by else counts.crossJoin(F.broadcast(points))
    return joined.withColumn("range", F.size(F.filter("_points", lambda p: p < F.col(x)))).drop("_points")


def running(counts: DataFrame, by: list[str], x: str, sums: list[str]) -> DataFrame:
    """counts(*by, x, *sums), a row a value -> those and before_<sum>: the sums over all lesser values of the group."""
    dealt = ranged(counts, by, x)
    totals = dealt.groupBy(*by, "range").agg(*[F.sum(c).alias(c) for c in sums])
    earlier = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in sums])
    within = Window.partitionBy(*by, "range").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums})
    out = inside.join(offsets, [*by, "range"])
    return out.withColumns({f"before_{c}": F.col(f"before_{c}") + F.col(f"_{c}") for c in sums}).drop("range", *[f"_{c}" for c in sums])


def quantiles(rows: DataFrame, by: list[str], x: str, at: list[float]) -> DataFrame:
    """(*by, q): exact quantiles of the x that are there, linear between neighbours, in the order of `at`."""
    counts = rows.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("c"))
    placed = running(counts, by, x, ["c"])
    size = counts.groupBy(*by).agg(F.sum("c").alias("n"))
    sized = placed.join(F.broadcast(size), by) if by else placed.crossJoin(F.broadcast(size))
    position = [F.lit(p) * (F.col("n") - 1) for p in at]

    def value(place: Column) -> Column:
        """The x of a rank: one row holds it."""
        return F.max(F.when((F.col("before_c") <= place) & (place < F.col("before_c") + F.col("c")), F.col(x)))

    grouped = sized.groupBy(*by).agg(*[value(F.floor(p)).alias(f"lo_{i}") for i, p in enumerate(position)], *[value(F.ceil(p)).alias(f"hi_{i}") for i, p in enumerate(position)], F.first("n").alias("n"))
    between = [F.col(f"lo_{i}") + (F.col(f"hi_{i}") - F.col(f"lo_{i}")) * (p - F.floor(p)) for i, p in enumerate(position)]
    return grouped.select(*by, F.array(*between).alias("q"))
