"""Scores of regression and binary predictions: overall, by day, by group, day-equal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import quantiles, running


def regression_aggregates(p: str = "p", y: str = "y") -> list[Column]:
    """n, error sums, RMSE, MAE, mean error and three-way direction accuracy; NULL rates without rows."""
    e = F.col(p) - F.col(y)
    return [
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(e * e), F.lit(0.0)).alias("squared_error_sum"), F.coalesce(F.sum(F.abs(e)), F.lit(0.0)).alias("absolute_error_sum"), F.coalesce(F.sum(e), F.lit(0.0)).alias("error_sum"),
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("mean_error"), F.avg((F.signum(p) == F.signum(y)).cast("double")).alias("direction_accuracy"),
        F.sqrt(F.avg(F.col(y) * F.col(y))).alias("zero_rmse"), F.avg(F.abs(y)).alias("zero_mae"),
    ]


def compared_with_zero(scores: DataFrame) -> DataFrame:
    return scores.withColumns({"delta_rmse": F.col("rmse") - F.col("zero_rmse"), "delta_mae": F.col("mae") - F.col("zero_mae"), "relative_rmse_improvement": F.when(F.col("zero_rmse") > 0, 1 - F.col("rmse") / F.col("zero_rmse"))})


def regression_scores(rows: DataFrame, *by: str) -> DataFrame:
    return compared_with_zero(rows.groupBy(*by).agg(*regression_aggregates()) if by else rows.agg(*regression_aggregates()))


def day_equal(rows: DataFrame, *by: str) -> DataFrame:
    """Root of the mean of the days' mean squares; mean of the days' mean absolute errors."""
    e = F.col("p") - F.col("y")
    days = rows.groupBy(*by, "day").agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"))
    return days.groupBy(*by).agg(F.sqrt(F.avg("mse")).alias("rmse"), F.avg("mae").alias("mae"), F.count(F.lit(1)).alias("score_days"))


def volatility_boundaries(train: DataFrame, column: str, *by: str) -> DataFrame:
    """The distinct quartiles of what is there, of training rows alone: a row a group."""
    return quantiles(train.select(*by, F.col(column).cast("double").alias("_x")), list(by), "_x", [0.25, 0.5, 0.75]).select(*by, F.array_distinct("q").alias("boundaries"))


def volatility_group(value: Column, boundaries: Column) -> Column:
    """Q1, Q2, ...; a value on a boundary is above it; missing is a group of its own."""
    return F.when(value.isNull(), "missing").otherwise(F.concat(F.lit("Q"), (F.size(F.filter(boundaries, lambda b: b <= value)) + 1).cast("string")))


def binary_aggregates(label: str = "label", p: str = "p", threshold: float = 0.5) -> list[Column]:
    actual, predicted = F.col(label) == 1, F.col(p) > threshold
    return [F.count(F.lit(1)).alias("n"), F.count_if(actual & predicted).alias("tp"), F.count_if(~actual & ~predicted).alias("tn"), F.count_if(~actual & predicted).alias("fp"), F.count_if(actual & ~predicted).alias("fn"),
            F.avg(-F.when(actual, F.ln(clipped(p))).otherwise(F.log1p(-clipped(p)))).alias("logloss"), F.avg((F.col(p) - F.col(label)) * (F.col(p) - F.col(label))).alias("brier")]


def clipped(p: str) -> Column:
    """Away from 0 and 1 for logarithms. What is no probability is an error."""
    x = F.col(p)
    return F.when((x >= 0) & (x <= 1), F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), x))).when(x.isNotNull(), F.raise_error(F.lit("not a probability")))


def binary_rates(counts: DataFrame) -> DataFrame:
    """NULL where a rate has no rows; balanced accuracy needs both classes."""
    up, down = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    return counts.withColumns({
        "accuracy": F.try_divide(F.col("tp") + F.col("tn"), F.col("n")), "up_recall": F.try_divide(F.col("tp"), up), "not_up_recall": F.try_divide(F.col("tn"), down), "up_precision": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")),
        "predicted_up_rate": F.try_divide(F.col("tp") + F.col("fp"), F.col("n")), "actual_up_rate": F.try_divide(up, F.col("n")), "balanced_accuracy": (F.try_divide(F.col("tp"), up) + F.try_divide(F.col("tn"), down)) / 2,
    })


def binary_scores(rows: DataFrame, *by: str) -> DataFrame:
    return binary_rates(rows.groupBy(*by).agg(*binary_aggregates()) if by else rows.agg(*binary_aggregates()))


def roc_auc(rows: DataFrame, by: str) -> DataFrame:
    """Area under the curve by average ranks of ties; NULL for one class. Ranks are running counts over distinct scores, range by range."""
    each = rows.groupBy(by, "p").agg(F.count(F.lit(1)).alias("c"), F.sum("label").alias("pos"))
    ranked = running(each, [by], "p", ["c"])
    sums = ranked.groupBy(by).agg(F.sum(F.col("pos") * (2 * F.col("before_c") + F.col("c") + 1)).alias("twice"), F.sum("pos").alias("positives"), F.sum("c").alias("n"))
    other = F.col("n") - F.col("positives")
    return sums.select(by, "n", "positives", F.when((F.col("positives") > 0) & (other > 0), (F.col("twice") / 2 - F.col("positives") * (F.col("positives") + 1) / 2) / (F.col("positives") * other)).alias("auc"))


def calibration(rows: DataFrame) -> DataFrame:
    """Ten equal bins of the probability, the last with its upper end; empty bins stay."""
    counted = rows.groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_probability"), F.avg("label").alias("observed_up_rate"))
    every = rows.sparkSession.range(10).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counted), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_probability", "observed_up_rate")


def training_prior(train: DataFrame, *by: str) -> DataFrame:
    """The share of up labels and the class of the majority; a missing label is an error."""
    label = F.when(F.col("y").isNull(), F.raise_error(F.lit("missing label"))).when(F.col("y") > 0, 1).otherwise(0)
    return train.groupBy(*by).agg(F.avg(label).alias("prior"), F.when(F.avg(label) > 0.5, 1).otherwise(0).alias("majority"), F.count(F.lit(1)).alias("n"))
