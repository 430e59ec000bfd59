"""The 49 causal features of an entity's calendar rows, from one window stage and one that reads its results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import BY, complete, deviation, frame, gated, lag, mean, position, ratio, share

WINDOWS = (5, 10, 20, 60)
LAGS = (0, 1, 2, 5, 10, 20, 60)
MARKETS = ("sh000001", "sz399001")
MARKET_BY = "PARTITION BY symbol ORDER BY cal_idx"


def catalogue() -> dict[str, tuple[str, str]]:
    """Name -> (family, expression over the columns of `prepared`)."""
    out: dict[str, tuple[str, str]] = {}
    for k in LAGS:
        out[f"return_lag_{k}"] = ("return_lag", lag("r", k))
    for kind, of in (("mean", mean), ("std", deviation), ("valid_fraction", share)):
        for k in WINDOWS:
            out[f"return_{kind}_{k}"] = (f"return_{kind}", of("r", k))
    out["candle_body"] = ("candle", f"{ratio('close', 'open')} - 1")
    out["high_low_range"] = ("candle", f"{ratio('high', 'low')} - 1")
    out["close_position"] = ("candle", ratio("close - low", "high - low"))
    out["upper_shadow"] = ("candle", ratio("high - greatest(open, close)", "close"))
    out["lower_shadow"] = ("candle", ratio("least(open, close) - low", "close"))
    for x in ("volume_shares", "amount_yuan"):
        for k in (5, 20):
            out[f"{x}_relative_{k}"] = ("liquidity", f"{ratio(x, mean(x, k, 1))} - 1")
    out["turnover"] = ("turnover", "turnover")
    out["turnover_change_1"] = ("turnover", f"turnover - {lag('turnover', 1)}")
    out["turnover_relative_20"] = ("turnover", f"{ratio('turnover', mean('turnover', 20, 1))} - 1")
    for s in MARKETS:
        for name in (f"{s}_return_0", *(f"{s}_return_{kind}_{k}" for kind in ("mean", "std") for k in (5, 20))):
            out[name] = ("market", name)
    out["listing_age_days"] = ("history_state", "CASE WHEN state >= 0 THEN age_days END")
    out["suspended_days_20"] = ("history_state", gated(frame("sum(CASE WHEN state = 0 THEN 1e0 ELSE 0e0 END)", 19), 20))
    out["days_since_previous_trade"] = ("history_state", f"cal_idx - max(CASE WHEN state = 1 THEN cal_idx END) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    for k in (20, 60):
        out[f"quote_index_ma_deviation_{k}"] = ("quote_index_trend", f"{ratio('q', f'ma{k}')} - 1")
    out["quote_index_ma_change_20_5"] = ("quote_index_trend", f"{ratio('ma20', lag('ma20', 5))} - 1")
    out["quote_index_prior_high_distance_20"] = ("quote_index_trend", f"{ratio('q', complete('max', 'q', 20, 1))} - 1")
    out["quote_index_prior_low_distance_20"] = ("quote_index_trend", f"{ratio('q', complete('min', 'q', 20, 1))} - 1")
    return out


FEATURES = tuple(catalogue())
#: Of the first window stage: complete moving averages of the quote index.
AVERAGES = {"ma20": complete("avg", "q", 20), "ma60": complete("avg", "q", 60)}


def market_expressions() -> dict[str, str]:
    """Per index: return_0, and its means and deviations. `ret` is the return column."""
    return {"return_0": "ret"} | {f"return_{kind}_{k}": of("ret", k, by=MARKET_BY) for kind, of in (("mean", mean), ("std", deviation)) for k in (5, 20)}


MARKET_RETURN = f"{ratio('close', lag('close', 1, MARKET_BY))} - 1"


def market_features(markets: DataFrame) -> DataFrame:
    """markets(symbol, cal_idx, close) -> cal_idx and five columns for each index: as many rows as the calendar."""
    each = markets.withColumn("ret", F.expr(MARKET_RETURN)).selectExpr("symbol", "cal_idx", *(f"{e} AS {n}" for n, e in market_expressions().items()))
    columns = [F.max(F.when(F.col("symbol") == s, F.col(n))).alias(f"{s}_{n}") for s in MARKETS for n in market_expressions()]
    return each.groupBy("cal_idx").agg(*columns)


def quote_index(panel: DataFrame) -> DataFrame:
    """Adds q: 100 on the first traded row, then compounded returns of traded rows; NULL where not traded.

    A level that is not positive and finite is an error, not a gap.
    """
    run = Window.partitionBy("stock_id").orderBy("cal_idx").rowsBetween(Window.unboundedPreceding, 0)
    nth = F.sum(F.when(F.col("state") == 1, 1).otherwise(0)).over(run)
    stepped = panel.withColumn("_factor", F.when((F.col("state") != 1) | (nth <= 1), F.lit(1.0)).otherwise(1 + F.col("r")))
    level = 100 * F.product("_factor").over(run)
    bad = (level <= 0) | F.isnan(level) | (level == float("inf"))
    return stepped.withColumn("q", F.when(F.col("state") == 1, F.when(bad, F.raise_error(F.lit("quote index is not positive and finite"))).otherwise(level))).drop("_factor")


def prepared(panel: DataFrame, markets: DataFrame) -> DataFrame:
    """panel(stock_id, cal_idx, d, list_date, state, bars, r) with q, its moving averages, age and the market columns."""
    wide = quote_index(panel).withColumn("age_days", F.datediff("d", "list_date").cast("double")).withColumns({n: F.expr(e) for n, e in AVERAGES.items()})
    return wide.join(market_features(markets), "cal_idx", "left")


def features(ready: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """Keys and the features as float, of every calendar row: filter listed rows afterwards, not before."""
    table = catalogue()
    return ready.select("stock_id", "cal_idx", "d", "state", *[F.expr(f"CAST({table[n][1]} AS FLOAT)").alias(n) for n in names])


def feature_quality(rows: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """Per feature: finite and missing rows, finite eligible rows, least and greatest. One wide aggregate; its one row is unpivoted."""
    figures = {"finite_rows": F.count, "eligible_finite_rows": lambda n: F.count(F.when(F.col("state") == 1, F.col(n))), "minimum": lambda n: F.min(n).cast("double"), "maximum": lambda n: F.max(n).cast("double")}
    one = rows.agg(F.count(F.lit(1)).alias("rows"), *[F.struct(*[of(n).alias(k) for k, of in figures.items()]).alias(n) for n in names])
    each = one.select("rows", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("f")) for n in names])).alias("e"))
    return each.select("e.name", "e.f.finite_rows", (F.col("rows") - F.col("e.f.finite_rows")).alias("nan_rows"), "e.f.eligible_finite_rows", "e.f.minimum", "e.f.maximum")


__all__ = ["AVERAGES", "FEATURES", "catalogue", "feature_quality", "features", "market_features", "position", "prepared", "quote_index"]
