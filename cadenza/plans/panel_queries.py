"""Queries over the brand by week panel: bars, calendar, features, targets, indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import rounded
from ..operators import features as ft
from ..operators import indicators as ind
from ..operators import panel as pn
from ..operators import targets as tg
from ..sources import prepared as prep
from ..sources import trade_panel as src
from .reference_sql import BARS, FEATURE_SQL, columns, with_ctes

BAR_COLUMNS = ("open", "high", "low", "close", "volume_shares", "amount_yuan", "turnover")
FAMILIES = {
    "feat_return_lags": ("return_lag",), "feat_return_mean": ("return_mean",), "feat_return_std": ("return_std",), "feat_valid_fraction": ("return_valid_fraction",), "feat_candle": ("candle",),
    "feat_liquidity": ("liquidity",), "feat_turnover": ("turnover",), "feat_market": ("market",), "feat_history_state": ("history_state",), "feat_trend": ("quote_index_trend",), "feat_all_49": (),
}


def names_of(key: str) -> tuple[str, ...]:
    return tuple(n for n, (family, _) in ft.catalogue().items() if not FAMILIES[key] or family in FAMILIES[key])


def round_all(df: DataFrame, names: tuple[str, ...], keys: tuple[str, ...] = ("stock_id", "cal_idx")) -> DataFrame:
    return df.select(*keys, *[F.expr(f"{rounded(f'CAST({n} AS DOUBLE)')} AS {n}") for n in names])


def feature_query(key: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = names_of(key)
        return round_all(ft.features(prep.ready(spark, sf_dir), names).where("state >= 0"), names)

    return run


def indicator_query(names: tuple[str, ...]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_all(ind.indicators(ft.quote_index(prep.panel(spark, sf_dir))), names)

    return run


def bars_brand_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(src.bars_of(src.trades(spark, sf_dir), "stock_id"), BAR_COLUMNS, ("stock_id", "d"))


def bars_supplier_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = src.read(spark, sf_dir, "lineitem").where("l_shipdate IS NOT NULL").withColumn("d", F.date_trunc("month", "l_shipdate").cast("date"))
    return round_all(src.bars_of(lines, "l_suppkey"), BAR_COLUMNS, ("l_suppkey", "d"))


def grid_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(prep.panel(spark, sf_dir), ("close", "r"), ("stock_id", "cal_idx", "d", "state"))


def date_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates that a listed entity should trade on against those that it does."""
    rows = prep.panel(spark, sf_dir).where("state >= 0")
    return pn.date_set_difference(rows.select("stock_id", "d"), rows.where("state = 1").select("stock_id", "d"))


def feat_quote_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(ft.quote_index(prep.panel(spark, sf_dir)), ("q",))


def feat_causality_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features from the first 200 weeks alone: equal to those from all weeks."""
    short = pn.history_prefix(prep.panel(spark, sf_dir), 200)
    markets = prep.market_closes(spark, sf_dir).where("cal_idx < 200")
    names = ("return_mean_20", "volume_shares_relative_20", "quote_index_ma_change_20_5", "sh000001_return_std_20")
    return round_all(ft.features(ft.prepared(short, markets), names).where("state >= 0"), names)


def feature_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ft.feature_quality(ft.features(prep.ready(spark, sf_dir)).where("state >= 0"))
    return out.select("name", "finite_rows", "nan_rows", "eligible_finite_rows", *[F.expr(f"{rounded(c)} AS {c}") for c in ("minimum", "maximum")])


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.samples(spark, sf_dir)


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampled(spark, sf_dir)
    return rows.select("row_id", "stock_idx", F.col("cal_idx").alias("as_of_idx"), F.coalesce("target_idx", F.lit(-1)).alias("target_idx"), F.coalesce("label_available_idx", F.lit(-1)).alias("label_available_idx"), "target_status", "prediction_eligible", F.expr(f"{rounded('y')} AS y"))


def target_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled(spark, sf_dir).groupBy("target_status").agg(F.count(F.lit(1)).alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average next return by the sign of the mean of the last 20 returns."""
    rows = tg.with_targets(prep.ready(spark, sf_dir)).withColumn("m", F.expr(ft.catalogue()["return_mean_20"][1])).where("state = 1 AND y IS NOT NULL AND m IS NOT NULL")
    return rows.groupBy(F.signum("m").cast("int").alias("sign")).agg(F.count(F.lit(1)).alias("n"), F.expr(f"{rounded('avg(y)')} AS mean_next_return"))


QUERIES = {
    "bars_brand_week": bars_brand_week, "bars_supplier_month": bars_supplier_month, "calendar": src.calendar, "grid_state": grid_state, "date_set_diff": date_set_diff,
    "prev_next_day": lambda spark, sf_dir: pn.neighbours(prep.calendar(spark, sf_dir)), **{k: feature_query(k) for k in FAMILIES}, "feat_quote_index": feat_quote_index, "feat_causality_prefix": feat_causality_prefix,
    "feature_quality": feature_quality, "sample_coverage": lambda spark, sf_dir: tg.sample_coverage(prep.samples(spark, sf_dir), ft.FEATURES), "targets": targets, "target_status_counts": target_status_counts, "momentum_next_return": flagship,
}
INDICATORS = {
    "ind_platform": tuple(ind.platform_expressions()), "ind_bottom": tuple(ind.bottom_expressions()), "ind_channel": tuple(f"channel_{n}_{k}" for k in ind.CHANNELS for n in ("gain", "r2", "width", "sigma", "offset")),
    "ind_channel_higher": tuple(ind.channel_higher_expressions()), "ind_volume_complete": ("volume_history_complete",),
}
QUERIES |= {k: indicator_query(n) for k, n in INDICATORS.items()}

_PREFIX = ("return_mean_20", "volume_shares_relative_20", "quote_index_ma_change_20_5", "sh000001_return_std_20")
ORACLES = {
    "bars_brand_week": with_ctes(f"SELECT stock_id, d, {columns(BAR_COLUMNS)} FROM bars", "bars"),
    "bars_supplier_month": f"SELECT l_suppkey, d, {columns(BAR_COLUMNS)} FROM (SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS d, {BARS} FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1, 2)",
    "calendar": with_ctes("SELECT cal_idx, d FROM cal", "cal"),
    "grid_state": with_ctes(f"SELECT stock_id, cal_idx, d, state, {columns(['close', 'r'])} FROM panel", "panel"),
    "date_set_diff": with_ctes("SELECT stock_id, 'missing_right' AS side, count(*) AS n, array_to_string(list(CAST(d AS VARCHAR) ORDER BY d) FILTER (nth <= 3), ',') AS examples FROM (SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY d) AS nth FROM panel WHERE state = 0) GROUP BY stock_id", "panel"),
    "prev_next_day": with_ctes("SELECT cal_idx, d, lag(d) OVER (ORDER BY cal_idx) AS previous_day, lead(d) OVER (ORDER BY cal_idx) AS next_day FROM cal", "cal"),
    **{k: with_ctes(f"SELECT stock_id, cal_idx, {columns(names_of(k))} FROM feats WHERE state >= 0", "feats") for k in FAMILIES},
    "feat_quote_index": with_ctes(f"SELECT stock_id, cal_idx, {columns(['q'])} FROM quoted", "quoted"),
    "feat_causality_prefix": with_ctes(f"SELECT stock_id, cal_idx, {columns(_PREFIX)} FROM feats WHERE state >= 0 AND cal_idx < 200", "feats"),
    "feature_quality": with_ctes(" UNION ALL ".join(f"SELECT '{n}' AS name, count({n}) AS finite_rows, count(*) - count({n}) AS nan_rows, count(CASE WHEN state = 1 THEN {n} END) AS eligible_finite_rows, {rounded(f'CAST(min({n}) AS DOUBLE)')} AS minimum, {rounded(f'CAST(max({n}) AS DOUBLE)')} AS maximum FROM feats WHERE state >= 0" for n in FEATURE_SQL), "feats"),
    "sample_coverage": with_ctes("SELECT stock_id, count(*) AS grid_rows, count_if(prediction_eligible) AS prediction_eligible, count_if(NOT prediction_eligible) AS information_day_paused, count_if(target_status = 1) AS target_observed, count_if(target_status = 2) AS target_suspended, count_if(target_status = 3) AS target_calendar_unknown, count_if(prediction_eligible AND target_status = 1) AS supervised_candidates, count_if(prediction_eligible AND target_status = 2) AS eligible_target_suspended, count_if(prediction_eligible AND target_status = 3) AS eligible_target_calendar_unknown, count_if(target_status = 1 AND y = 0) AS observed_zero_labels, CAST(sum(nan_rows) AS BIGINT) AS rows_with_nan_features FROM (SELECT s.*, CASE WHEN " + " OR ".join(f"f.{n} IS NULL" for n in FEATURE_SQL) + " THEN 1 ELSE 0 END AS nan_rows FROM samples s JOIN feats f ON f.stock_id = s.stock_id AND f.cal_idx = s.cal_idx) GROUP BY stock_id", "samples", "feats"),
    "targets": with_ctes(f"SELECT row_id, stock_idx, cal_idx AS as_of_idx, coalesce(target_idx, -1) AS target_idx, coalesce(label_available_idx, -1) AS label_available_idx, target_status, prediction_eligible, {columns(['y'])} FROM samples", "samples"),
    "target_status_counts": with_ctes("SELECT target_status, count(*) AS n FROM samples GROUP BY 1", "samples"),
    "momentum_next_return": with_ctes(f"SELECT CAST(sign(return_mean_20) AS INTEGER) AS sign, count(*) AS n, {rounded('avg(y)')} AS mean_next_return FROM targets t JOIN feats f ON f.stock_id = t.stock_id AND f.cal_idx = t.cal_idx WHERE t.state = 1 AND y IS NOT NULL AND return_mean_20 IS NOT NULL GROUP BY 1", "targets", "feats"),
    **{k: with_ctes(f"SELECT stock_id, cal_idx, {columns(n)} FROM inds", "inds") for k, n in INDICATORS.items()},
}
