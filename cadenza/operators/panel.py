"""Entities on a shared calendar: the grid, states, returns, neighbours and date sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PRE_LISTING, SUSPENDED, TRADED = -1, 0, 1


def calendar_of(dates: DataFrame, column: str = "d") -> DataFrame:
    """(cal_idx, d): the distinct dates in order, numbered from 0. As long as the calendar, not the data."""
    days = dates.select(F.col(column).alias("d")).where("d IS NOT NULL").distinct()
    return days.select((F.row_number().over(Window.orderBy("d")) - 1).alias("cal_idx"), "d")


def grid(entities: DataFrame, calendar: DataFrame, bars: DataFrame) -> DataFrame:
    """Every entity on every calendar date, bars joined, with `state` and the return `r` of traded rows.

    Nothing is filled: a listed row without a bar is suspended, a row before listing is marked so. The calendar has a
    row a date and is broadcast.
    """
    dense = entities.select("stock_id", "list_date").crossJoin(F.broadcast(calendar))
    joined = dense.join(bars, ["stock_id", "d"], "left")
    state = F.when(F.col("d") < F.col("list_date"), PRE_LISTING).when(F.col("close").isNotNull(), TRADED).otherwise(SUSPENDED)
    order = Window.partitionBy("stock_id").orderBy("cal_idx")
    last = F.last(F.when(F.col("state") == TRADED, F.col("close")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    with_state = joined.withColumn("state", state)
    cleared = with_state.withColumns({c: F.when(F.col("state") == TRADED, F.col(c)) for c in bars.columns if c not in ("stock_id", "d")})
    change = F.when(F.col("state") == TRADED, F.coalesce(F.col("close") / last - 1, F.lit(0.0)))
    return cleared.withColumn("r", change)


def date_set_difference(left: DataFrame, right: DataFrame, examples: int = 3) -> DataFrame:
    """Per stock the dates on one side only: counts and the first examples of each. Stocks that agree are absent."""
    one = left.join(right, ["stock_id", "d"], "left_anti").withColumn("side", F.lit("missing_right"))
    two = right.join(left, ["stock_id", "d"], "left_anti").withColumn("side", F.lit("missing_left"))
    ranked = one.unionByName(two).withColumn("nth", F.row_number().over(Window.partitionBy("stock_id", "side").orderBy("d")))
    sample = F.array_sort(F.collect_list(F.when(F.col("nth") <= examples, F.col("d").cast("string"))))
    return ranked.groupBy("stock_id", "side").agg(F.count(F.lit(1)).alias("n"), F.array_join(sample, ",").alias("examples"))


def neighbours(calendar: DataFrame) -> DataFrame:
    """Each date with the dates before and after it."""
    order = Window.orderBy("cal_idx")
    return calendar.select("cal_idx", "d", F.lag("d").over(order).alias("previous_day"), F.lead("d").over(order).alias("next_day"))


def history_prefix(panel: DataFrame, rows: int) -> DataFrame:
    """What was known before calendar row `rows`: legal before windows, which look back only."""
    return panel.where(F.col("cal_idx") < rows)
