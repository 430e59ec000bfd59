"""The next calendar date's return, its availability and status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import lead

OBSERVED, TARGET_SUSPENDED, OUTSIDE_CALENDAR, TARGET_PRE_LISTING = 1, 2, 3, 4

EXPRESSIONS = {
    "target_idx": f"CASE WHEN {lead('state')} IS NOT NULL THEN cal_idx + 1 END",
    "target_status": f"CASE {lead('state')} WHEN 1 THEN {OBSERVED} WHEN 0 THEN {TARGET_SUSPENDED} WHEN -1 THEN {TARGET_PRE_LISTING} ELSE {OUTSIDE_CALENDAR} END",
    "label_available_idx": f"CASE WHEN {lead('state')} = 1 THEN cal_idx + 1 END",
    "y": f"CASE WHEN {lead('state')} = 1 THEN {lead('r')} END",
}


def with_targets(panel: DataFrame) -> DataFrame:
    return panel.withColumns({n: F.expr(e) for n, e in EXPRESSIONS.items()})


def samples(panel: DataFrame, entities: DataFrame) -> DataFrame:
    """Listed rows with targets, `prediction_eligible`, the entity's number by name and a dense row_id by (entity, date).

    Numbering is by counts, not by one sorted partition: rows before an entity are a sum over entities.
    """
    from pyspark.sql.window import Window

    by_name = Window.orderBy("stock_id")
    order = Window.partitionBy("stock_id").orderBy("cal_idx")
    rows = with_targets(panel).where("state >= 0").withColumn("nth", F.row_number().over(order))
    sizes = rows.groupBy("stock_id").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("stock_id", (F.row_number().over(by_name) - 1).alias("stock_idx"), (F.sum("n").over(by_name) - F.col("n")).alias("before"))
    return rows.join(starts, "stock_id").withColumn("row_id", F.col("before") + F.col("nth") - 1).withColumn("prediction_eligible", F.col("state") == 1).drop("before", "nth")


def sample_coverage(rows: DataFrame, features: tuple[str, ...] = ()) -> DataFrame:
    """Counters per entity over its listed rows; with features, the rows that lack any of them."""
    n = F.count_if
    some = F.lit(False)
    for x in features:
        some = some | F.col(x).isNull()
    lacking = [n(some).alias("rows_with_nan_features")] if features else []
    ok, status = F.col("prediction_eligible"), F.col("target_status")
    return rows.groupBy("stock_id").agg(
        F.count(F.lit(1)).alias("grid_rows"), n(ok).alias("prediction_eligible"), n(~ok).alias("information_day_paused"),
        n(status == 1).alias("target_observed"), n(status == 2).alias("target_suspended"), n(status == 3).alias("target_calendar_unknown"),
        n(ok & (status == 1)).alias("supervised_candidates"), n(ok & (status == 2)).alias("eligible_target_suspended"),
        n(ok & (status == 3)).alias("eligible_target_calendar_unknown"), n((status == 1) & (F.col("y") == 0)).alias("observed_zero_labels"), *lacking,
    )
