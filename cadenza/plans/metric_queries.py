"""Queries that score closed-form predictors on the folds' rows, audit the bars, and look at periods."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.storage import shared_folder
from ..functions.windows import rounded
from ..operators import admission as ad
from ..operators import audit as au
from ..operators import metrics as mt
from ..operators import splits as sp
from ..operators import targets as tg
from ..sources import prepared as prep
from ..sources.store import save_predictions
from .reference_sql import rounded as round_sql
from .reference_sql import with_ctes
from .split_queries import SPLIT_CTES, plan

#: The predictors: a tenth of the last return, and its logistic.
REGRESSION, PROBABILITY = "0.1e0 * r", "1 / (1 + exp(-r))"
VOLATILITY = "return_std_20"


def role_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sp.roles(prep.samples(spark, sf_dir).withColumn("trend", F.col("quote_index_ma_change_20_5")), plan(spark, sf_dir))
    return rows.withColumnRenamed("target_idx", "day").withColumns({"p": F.expr(REGRESSION), "q_up": F.expr(PROBABILITY), "label": F.expr("CASE WHEN y > 0 THEN 1 ELSE 0 END")})


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_rows(spark, sf_dir).where("role = 'score' AND fold <> 'holdout'")


def binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).withColumn("p", F.col("q_up"))


REG = ("squared_error_sum", "absolute_error_sum", "error_sum", "rmse", "mae", "mean_error", "direction_accuracy", "zero_rmse", "zero_mae", "delta_rmse", "delta_mae", "relative_rmse_improvement")
RATES = ("accuracy", "up_recall", "not_up_recall", "up_precision", "predicted_up_rate", "actual_up_rate", "balanced_accuracy", "logloss", "brier")


def shown(df: DataFrame, keys: tuple[str, ...], names: tuple[str, ...]) -> DataFrame:
    return df.select(*keys, *[F.expr(f"{rounded(n)} AS {n}") for n in names])


def grouped(spark: SparkSession, sf_dir: str, score) -> DataFrame:
    """By volatility group of each fold's training rows, and by whether the trend is there."""
    rows = role_rows(spark, sf_dir).where("fold <> 'holdout'")
    bounds = mt.volatility_boundaries(rows.where("role = 'train'"), VOLATILITY, "fold").withColumnRenamed("boundaries", "bounds")
    with_group = rows.where("role = 'score'").join(F.broadcast(bounds), "fold")
    parts = F.array(F.struct(F.lit("training_volatility").alias("grouping"), mt.volatility_group(F.col(VOLATILITY).cast("double"), F.col("bounds")).alias("group")), F.struct(F.lit("trend_availability").alias("grouping"), F.when(F.col("trend").isNull(), "missing").otherwise("complete").alias("group")), F.struct(F.lit("industry").alias("grouping"), F.lit("unknown").alias("group")))
    return score(with_group.withColumn("g", F.explode(parts)).select("*", "g.grouping", "g.group"))


def bin_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.roc_auc(binary(spark, sf_dir).withColumn("p", F.expr("floor(p * 100) / 100e0")), "fold").select("fold", "n", "positives", F.expr(f"{rounded('auc')} AS auc"))


def bin_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy averaged over days, balanced accuracy over the days that have both classes."""
    days = mt.binary_scores(binary(spark, sf_dir), "fold", "day")
    return days.groupBy("fold").agg(F.count("accuracy").alias("accuracy_days"), F.count("balanced_accuracy").alias("balanced_days"), F.expr(f"{rounded('avg(accuracy)')} AS accuracy"), F.expr(f"{rounded('avg(balanced_accuracy)')} AS balanced_accuracy"))


def vol_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every fold's training rows."""
    rows = role_rows(spark, sf_dir).where("role = 'train'")
    return mt.volatility_boundaries(rows, VOLATILITY, "fold").select("fold", F.posexplode("boundaries").alias("nth", "b")).select("fold", "nth", F.expr(f"{rounded('b')} AS boundary"))


def periods_year_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after a positive 20-week mean: by year, and by year and quarter."""
    days = prep.calendar(spark, sf_dir).select(F.col("cal_idx").alias("target_idx"), F.col("d").alias("next_day"))
    rows = triggered(spark, sf_dir).where("hit").join(F.broadcast(days), "target_idx")
    rows = rows.select(F.year("next_day").alias("year"), F.quarter("next_day").alias("quarter"), "y")
    return rows.groupingSets([["year"], ["year", "quarter"]], "year", "quarter").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") > 0).alias("up"), F.expr(f"{rounded('avg(y)')} AS mean_y"))


def triggered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.samples(spark, sf_dir).where("state = 1 AND y IS NOT NULL").withColumn("hit", F.col("return_mean_20") > 0)


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every calendar day with its triggers, none as zero."""
    counted = triggered(spark, sf_dir).where("hit").groupBy("target_idx").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") > 0).alias("up"))
    return prep.calendar(spark, sf_dir).select(F.col("cal_idx").alias("target_idx")).join(counted, "target_idx", "left").na.fill(0)


def sensitivity_largest_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day with the most triggers, the earliest of ties, and the rate without it."""
    days = triggered(spark, sf_dir).where("hit").groupBy("target_idx").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") > 0).alias("up"))
    top = F.max_by(F.struct("target_idx", "n", "up"), F.struct("n", -F.col("target_idx")))
    return days.agg(top.alias("t"), F.sum("n").alias("all_n"), F.sum("up").alias("all_up")).select(F.col("t.target_idx").alias("largest_day"), F.col("t.n").alias("largest_n"), (F.col("all_n") - F.col("t.n")).alias("rest_n"), F.expr(f"{rounded('CASE WHEN all_n > t.n THEN (all_up - t.up) / CAST(all_n - t.n AS DOUBLE) END')} AS rest_rate"))


# -- audit tables: integer cents of the bars, with faults put in by rule
_C = {c: f"CAST(floor({c} * 100 + 0.5e0) AS BIGINT)" for c in ("open", "high", "low", "close")}
MONEY = "CAST({} AS DECIMAL(18,2)) * CAST(0.01 AS DECIMAL(3,2))"
FAULT = "(number * 31 + cal_idx * 17) % 101"
AUDIT_COLUMNS = {
    "open": MONEY.format(_C["open"]), "high": f"CASE WHEN fault = 1 THEN CAST(0.01 AS DECIMAL(3,2)) ELSE CAST(1 AS DECIMAL(3,2)) END * ({MONEY.format('greatest(' + ', '.join(_C.values()) + ')')})", "low": MONEY.format(f"least({', '.join(_C.values())})"), "close": f"CASE WHEN fault = 2 THEN CAST(-1 AS DECIMAL(3,2)) ELSE CAST(1 AS DECIMAL(3,2)) END * ({MONEY.format(_C['close'])})",
    "lots": "CAST(volume_shares AS BIGINT)", "shares": "CAST(volume_shares AS BIGINT) * CASE WHEN fault = 3 THEN 99 ELSE 100 END", "amount": "CAST(floor(amount_yuan) AS BIGINT)", "turnover": "CASE WHEN fault = 4 THEN -1 ELSE 1 END",
}


def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traded rows as an audit sees them. The label's reference is the close before, or a cent more, by rule; its percentage is exact."""
    grid = prep.panel(spark, sf_dir).join(prep.entities(spark, sf_dir).select("stock_id", "number"), "stock_id").withColumns({"fault": F.expr(FAULT), "resumed": F.expr("coalesce(lag(state) OVER (PARTITION BY stock_id ORDER BY cal_idx) = 0, false)")})
    rows = grid.where("state = 1").withColumns({"cents": F.expr(_C["close"])})
    rows = rows.withColumns({n: F.expr(e) for n, e in {**AUDIT_COLUMNS, "base_close": "close"}.items()})
    rows = rows.withColumn("prev_cents", F.expr("lag(cents) OVER (PARTITION BY stock_id ORDER BY cal_idx)"))
    out = rows.selectExpr("stock_id", "cal_idx", "d", "list_date", "resumed", "fault", *AUDIT_COLUMNS, *(f"{e} AS {n}" for n, e in LABEL_COLUMNS.items()))
    return ad.with_clues(out, clues(out))


def clues(rows: DataFrame) -> DataFrame:
    """What was known of differences: every twentieth week, wrong by rule."""
    return rows.where("cal_idx % 20 = 0").selectExpr("stock_id", "d", "CASE WHEN fault = 10 THEN 3 ELSE 2 END AS clue_existing", "pct AS clue_web", "cal_idx % 40 = 0 AS clue_known")


LABEL_COLUMNS = {
    "pct": "CASE WHEN fault = 5 THEN -101 ELSE 0 END", "web_close": "close", "web_pct": "CASE WHEN fault = 6 THEN 7 WHEN fault = 5 THEN -101 ELSE 0 END", "ref": "CASE WHEN fault = 7 THEN close + CAST(0.01 AS DECIMAL(3,2)) ELSE close END", "tolerance": "CAST(0.000001 AS DECIMAL(9,6))",
    "change_pct": "2", "reference_traded": "(fault + cal_idx) % 5 = 0", "reference_close": "CASE WHEN fault = 9 THEN close + CAST(0.01 AS DECIMAL(3,2)) ELSE close END", "reference_preclose": "CASE WHEN fault = 7 THEN close + CAST(0.01 AS DECIMAL(3,2)) ELSE close END",
    "label_previous": "CASE WHEN fault = 8 THEN CAST(1 AS DECIMAL(18,2)) ELSE lag(close) OVER (PARTITION BY stock_id ORDER BY cal_idx) END",
}


def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return au.reviewed(audit_rows(spark, sf_dir))


def audit_next_day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sound = reviewed(spark, sf_dir).where("issue IS NULL").select("stock_id", "cal_idx", F.lit(True).alias("valid"))
    grid = prep.panel(spark, sf_dir).select("stock_id", "cal_idx", "state").join(sound, ["stock_id", "cal_idx"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))
    return au.next_day_counts(grid)


def audit_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reviewed(spark, sf_dir)
    return au.audit_counters(prep.panel(spark, sf_dir).where("state >= 0").select("stock_id", "d", "state"), rows, au.cases(rows), F.to_date(F.lit("2000-01-01")))


def bin_non_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of rows whose outcome isn't zero: accuracy by fold, and its mean over days with the days that have it."""
    rows = binary(spark, sf_dir).where("y <> 0")
    whole = mt.binary_scores(rows, "fold").select("fold", "n", "accuracy")
    days = mt.binary_scores(rows, "fold", "day").groupBy("fold").agg(F.avg("accuracy").alias("day_accuracy"), F.count("accuracy").alias("days"))
    return shown(whole.join(days, "fold"), ("fold", "n", "days"), ("accuracy", "day_accuracy"))


def sample_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the samples against those of the panel that they are made from."""
    grid = prep.panel(spark, sf_dir).where("state >= 0")
    following = F.lead("state").over(Window.partitionBy("stock_id").orderBy("cal_idx"))
    declared = grid.withColumn("after", following).agg(F.count(F.lit(1)).alias("grid_rows"), F.count_if(F.col("state") == 1).alias("prediction_eligible"), F.count_if((F.col("state") == 1) & (F.col("after") == 1)).alias("supervised_candidates"))
    counted = tg.sample_coverage(prep.samples(spark, sf_dir)).agg(*[F.sum(c).alias(c) for c in ("grid_rows", "prediction_eligible", "supervised_candidates")])
    long = lambda df, value: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias(value)) for c in df.columns])).alias("e")).select("e.*")
    return long(declared, "declared").join(long(counted, "counted"), "name", "full").withColumn("equal", F.col("declared").eqNullSafe(F.col("counted")))


def audit_month_slice_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy of the last weeks whose rows keep another order every seventh week: rows that differ in their place."""
    rows = audit_rows(spark, sf_dir).where("cal_idx >= 300").select("stock_id", "cal_idx", "close")
    place = F.row_number().over(Window.partitionBy("stock_id").orderBy(F.when(F.col("cal_idx") % 7 == 0, F.col("cal_idx") + 1.5).otherwise(F.col("cal_idx"))))
    return ad.slice_positions(rows, rows.withColumn("nth", place), "stock_id", "cal_idx", "close").groupBy("stock_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("same")).alias("moved"))


def return_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw returns against the stored feature, in single precision, and the grid of dates against the samples'."""
    raw = prep.panel(spark, sf_dir).where("state >= 0").select("stock_id", "cal_idx", F.col("r").cast("float").alias("raw"))
    both = raw.join(prep.samples(spark, sf_dir).select("stock_id", "cal_idx", "return_lag_0", F.lit(True).alias("stored")), ["stock_id", "cal_idx"], "full")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("stored").isNull()).alias("not_stored"), F.count_if(~F.col("raw").eqNullSafe(F.col("return_lag_0"))).alias("different"))


def prediction_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions written as gzipped CSV and read again: unscorable rows have a blank truth and their reason."""
    rows = role_rows(spark, sf_dir).where("fold <> 'holdout' AND role = 'predict'")
    reason = F.when(F.col("target_status") == 2, "target_suspended").when(F.col("target_status") == 3, "outside_calendar")
    path = f"{shared_folder(spark)}/predictions-{uuid.uuid4().hex}"
    save_predictions(rows.select("fold", "row_id", F.expr(f"{rounded('p')} AS p"), F.expr(f"{rounded('y')} AS truth"), reason.alias("reason")), path)
    return spark.read.csv(path, header=True, schema="fold string, row_id long, p double, truth double, reason string")


def audit_month_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last year of the bars against a copy in which every tenth close is a cent more."""
    rows = audit_rows(spark, sf_dir).where("cal_idx >= 300").select("stock_id", "cal_idx", F.col("close").cast("decimal(18,2)").alias("close"))
    copy = rows.withColumn("close", (F.col("close") + F.when(F.col("cal_idx") % 10 == 0, F.lit("0.01").cast("decimal(3,2)")).otherwise(F.lit("0.00").cast("decimal(3,2)"))).cast("decimal(18,2)"))
    return au.slice_difference(rows, copy, "stock_id", "cal_idx", "close").groupBy("side").agg(F.count(F.lit(1)).alias("n"))


def audit_manifest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = prep.panel(spark, sf_dir).where("state = 1")
    left = bars.groupBy("stock_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("stock_id").alias("path"), F.sha2(F.col("n").cast("string"), 256).alias("sha"))
    right = left.where(~F.col("path").endswith("1")).withColumn("sha", F.when(F.col("path").endswith("2"), F.sha2(F.lit("other"), 256)).otherwise(F.col("sha")))
    return au.manifest_merge(left, right)


def audit_count_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared: a bar a listed calendar row; counted: bars."""
    rows = prep.panel(spark, sf_dir).where("state >= 0")
    return au.count_mismatches(rows.groupBy(F.col("stock_id").alias("name")).agg(F.count(F.lit(1)).alias("declared")), rows.where("state = 1").groupBy(F.col("stock_id").alias("name")).agg(F.count(F.lit(1)).alias("counted")))


_REG_SQL = "count(*) AS n, coalesce(sum((p - y) * (p - y)), 0e0) AS squared_error_sum, coalesce(sum(abs(p - y)), 0e0) AS absolute_error_sum, coalesce(sum(p - y), 0e0) AS error_sum, sqrt(avg((p - y) * (p - y))) AS rmse, avg(abs(p - y)) AS mae, avg(p - y) AS mean_error, avg(CASE WHEN sign(p) = sign(y) THEN 1e0 ELSE 0e0 END) AS direction_accuracy, sqrt(avg(y * y)) AS zero_rmse, avg(abs(y)) AS zero_mae"
_REG_MORE = "rmse - zero_rmse AS delta_rmse, mae - zero_mae AS delta_mae, CASE WHEN zero_rmse > 0 THEN 1 - rmse / zero_rmse END AS relative_rmse_improvement"
_BIN_SQL = "count(*) AS n, count_if(label = 1 AND q_up > 0.5) AS tp, count_if(label = 0 AND q_up <= 0.5) AS tn, count_if(label = 0 AND q_up > 0.5) AS fp, count_if(label = 1 AND q_up <= 0.5) AS fn, avg(-CASE WHEN label = 1 THEN ln(greatest(1e-15, least(1 - 1e-15, q_up))) ELSE ln(1 - greatest(1e-15, least(1 - 1e-15, q_up))) END) AS logloss, avg((q_up - label) * (q_up - label)) AS brier"
_DIV = lambda a, b: f"CASE WHEN ({b}) > 0 THEN CAST({a} AS DOUBLE) / ({b}) END"
_BIN_MORE = f"{_DIV('tp + tn', 'n')} AS accuracy, {_DIV('tp', 'tp + fn')} AS up_recall, {_DIV('tn', 'tn + fp')} AS not_up_recall, {_DIV('tp', 'tp + fp')} AS up_precision, {_DIV('tp + fp', 'n')} AS predicted_up_rate, {_DIV('tp + fn', 'n')} AS actual_up_rate, ({_DIV('tp', 'tp + fn')} + {_DIV('tn', 'tn + fp')}) / 2 AS balanced_accuracy"
METRIC_CTES = SPLIT_CTES | {
    "mrows": (("roles", "feats"), f"SELECT r.*, r.target_idx AS day, 0.1e0 * r.r AS p, 1 / (1 + exp(-r.r)) AS q_up, CASE WHEN r.y > 0 THEN 1 ELSE 0 END AS label, f.return_std_20, f.quote_index_ma_change_20_5 AS trend FROM roles r JOIN feats f ON f.stock_id = r.stock_id AND f.cal_idx = r.cal_idx"),
    "mscore": (("mrows",), "SELECT * FROM mrows WHERE role = 'score' AND fold <> 'holdout'"),
    "mgroup": (("mscore",), f"SELECT s.*, grouping, CASE grouping WHEN 'training_volatility' THEN CASE WHEN {VOLATILITY} IS NULL THEN 'missing' ELSE 'Q' || CAST(len(list_filter(bounds, lambda b: b <= CAST({VOLATILITY} AS DOUBLE))) + 1 AS VARCHAR) END WHEN 'trend_availability' THEN CASE WHEN trend IS NULL THEN 'missing' ELSE 'complete' END ELSE 'unknown' END AS \"group\" FROM mscore s JOIN (SELECT fold, list_distinct(quantile_cont(CAST({VOLATILITY} AS DOUBLE), [0.25, 0.5, 0.75])) AS bounds FROM mrows WHERE role = 'train' GROUP BY fold) USING (fold) CROSS JOIN (SELECT unnest(['training_volatility', 'trend_availability', 'industry']) AS grouping)"),
    "bdays": (("mscore",), f"SELECT *, {_BIN_MORE} FROM (SELECT fold, day, {_BIN_SQL} FROM mscore GROUP BY fold, day)"),
    "trg": (("targets", "feats", "cal"), "SELECT t.*, c.d AS next_day, f.return_mean_20 AS m FROM targets t JOIN feats f ON f.stock_id = t.stock_id AND f.cal_idx = t.cal_idx LEFT JOIN cal c ON c.cal_idx = t.target_idx"),
    "hits": (("trg",), "SELECT * FROM trg WHERE state = 1 AND y IS NOT NULL AND m > 0"),
    # the audit's rows in whole cents; a sign, a cent or a factor is wrong where the fault says so
    "arows0": (("panel", "ent"), "SELECT p.*, (number * 31 + p.cal_idx * 17) % 101 AS fault, coalesce(b.state = 0, false) AS resumed, CAST(floor(p.open * 100 + 0.5e0) AS BIGINT) AS o, CAST(floor(p.high * 100 + 0.5e0) AS BIGINT) AS h, CAST(floor(p.low * 100 + 0.5e0) AS BIGINT) AS l, CAST(floor(p.close * 100 + 0.5e0) AS BIGINT) AS c FROM panel p JOIN ent e ON e.stock_id = p.stock_id LEFT JOIN panel b ON b.stock_id = p.stock_id AND b.cal_idx = p.cal_idx - 1"),
    "arows1": (("arows0",), "SELECT stock_id, cal_idx, d, list_date, resumed, fault, o AS open_c, CASE WHEN fault = 1 THEN greatest(o, h, l, c) / 100e0 ELSE greatest(o, h, l, c) END AS high_c, least(o, h, l, c) AS low_c, CASE WHEN fault = 2 THEN -c ELSE c END AS close_c, CAST(volume_shares AS BIGINT) AS lots, CAST(volume_shares AS BIGINT) * CASE WHEN fault = 3 THEN 99 ELSE 100 END AS shares, CAST(floor(amount_yuan) AS BIGINT) AS amount, CASE WHEN fault = 4 THEN -1 ELSE 1 END AS turnover FROM arows0 WHERE state = 1"),
    "arows": (("arows1",), "SELECT *, close_c / 100e0 AS close, lag(close_c) OVER t AS previous_c, CASE WHEN fault = 5 THEN -101 ELSE 0 END AS pct, CASE WHEN fault = 6 THEN 7 WHEN fault = 5 THEN -101 ELSE 0 END AS web_pct, CASE WHEN fault = 7 THEN close_c + 1 ELSE close_c END AS ref_c, CASE WHEN fault = 8 THEN 100 ELSE lag(close_c) OVER t END AS said_c, (fault + cal_idx) % 5 = 0 AS checked, CASE WHEN cal_idx % 20 = 0 THEN CASE WHEN fault = 10 THEN 3 ELSE 2 END END AS clue, cal_idx % 40 = 0 AS known_clue FROM arows1 WINDOW t AS (PARTITION BY stock_id ORDER BY cal_idx)"),
    "rev": (("arows",), """SELECT *, CASE WHEN open_c <= 0 OR high_c <= 0 OR low_c <= 0 OR close_c <= 0 THEN 'nonpositive_price'
 WHEN low_c > open_c OR low_c > close_c OR high_c < open_c OR high_c < close_c THEN 'bar_order'
 WHEN lots <= 0 OR shares <= 0 OR amount <= 0 OR turnover < 0 THEN 'nonpositive_volume'
 WHEN shares <> lots * 100 THEN 'lot_conversion'
 WHEN pct <= -100 THEN 'percent_range'
 WHEN web_pct <> pct THEN 'web_mismatch'
 WHEN ref_c <= 0 THEN 'reference_price'
 WHEN abs(close_c * 100 - ref_c * (100 + pct)) * 1000000 > ref_c THEN 'reference_arithmetic'
 WHEN (ref_c > 1 AND abs(close_c * 100 - (ref_c - 1) * (100 + pct)) * 1000000 <= ref_c - 1) OR abs(close_c * 100 - (ref_c + 1) * (100 + pct)) * 1000000 <= ref_c + 1 THEN 'reference_not_unique'
 WHEN previous_c IS NOT NULL AND (said_c IS NULL OR said_c <> previous_c) THEN 'previous_close'
 WHEN checked AND fault = 9 THEN 'independent_reference'
 WHEN clue <> 2 THEN 'clue' END AS issue FROM arows"""),
    "tagged": (("rev",), "SELECT *, unnest(CASE WHEN len(t) > 0 THEN t ELSE ['ordinary'] END) AS \"case\" FROM (SELECT *, list_filter([CASE WHEN d = list_date THEN 'listing_day' END, CASE WHEN resumed THEN 'resumed_after_pause' END, CASE WHEN known_clue THEN 'known_ex_dividend_clue' END, CASE WHEN previous_c IS NOT NULL AND ref_c <> previous_c THEN 'reference_differs_from_last_close' END], lambda x: x IS NOT NULL) AS t FROM rev WHERE issue IS NULL)"),
}


def sql(body: str, *names: str) -> str:
    return with_ctes(body, *names, extra=METRIC_CTES)


def _round(names: tuple[str, ...]) -> str:
    return ", ".join(f"{round_sql(n)} AS {n}" for n in names)


QUERIES = {
    "reg_metrics": lambda spark, sf_dir: shown(mt.regression_scores(scored(spark, sf_dir), "fold"), ("fold", "n"), REG),
    "reg_daily": lambda spark, sf_dir: shown(mt.regression_scores(scored(spark, sf_dir), "fold", "day"), ("fold", "day", "n"), ("rmse", "mae", "direction_accuracy")),
    "reg_groups": lambda spark, sf_dir: shown(grouped(spark, sf_dir, lambda x: mt.regression_scores(x, "fold", "grouping", "group")), ("fold", "grouping", "group", "n"), ("rmse", "mae")),
    "reg_day_equal": lambda spark, sf_dir: shown(mt.day_equal(scored(spark, sf_dir), "fold"), ("fold", "score_days"), ("rmse", "mae")),
    "vol_boundaries": vol_boundaries,
    "bin_confusion": lambda spark, sf_dir: mt.binary_scores(binary(spark, sf_dir), "fold").select("fold", "n", "tp", "tn", "fp", "fn"),
    "bin_losses": lambda spark, sf_dir: shown(mt.binary_scores(binary(spark, sf_dir), "fold"), ("fold",), RATES),
    "bin_auc": bin_auc, "bin_daily": bin_daily,
    "bin_groups": lambda spark, sf_dir: shown(grouped(spark, sf_dir, lambda x: mt.binary_scores(x.withColumn("p", F.col("q_up")), "fold", "grouping", "group")), ("fold", "grouping", "group", "n", "tp", "tn"), ("accuracy",)),
    "calibration_bins": lambda spark, sf_dir: shown(mt.calibration(binary(spark, sf_dir)), ("bin", "n"), ("mean_probability", "observed_up_rate")),
    "training_prior": lambda spark, sf_dir: shown(mt.training_prior(role_rows(spark, sf_dir).where("role = 'train'"), "fold"), ("fold", "majority", "n"), ("prior",)),
    "periods_year_quarter": periods_year_quarter, "daily_series": daily_series, "sensitivity_largest_day": sensitivity_largest_day,
    "audit_row_rules": lambda spark, sf_dir: reviewed(spark, sf_dir).select("stock_id", "cal_idx", "issue"),
    "audit_issue_summary": lambda spark, sf_dir: au.issue_summary(reviewed(spark, sf_dir)),
    "audit_cases": lambda spark, sf_dir: au.cases(reviewed(spark, sf_dir)).groupBy("case").agg(F.count(F.lit(1)).alias("n")),
    "audit_case_examples": lambda spark, sf_dir: au.case_examples(au.cases(reviewed(spark, sf_dir))),
    "audit_stock_coverage": lambda spark, sf_dir: au.stock_coverage(reviewed(spark, sf_dir)),
    "audit_next_day_counts": audit_next_day_counts, "audit_month_slice": audit_month_slice, "audit_manifest_merge": audit_manifest_merge, "audit_count_reconcile": audit_count_reconcile,
    "audit_counters": audit_counters, "bin_non_flat": bin_non_flat, "sample_reconcile": sample_reconcile, "audit_month_slice_order": audit_month_slice_order, "return_rescan": return_rescan, "prediction_file": prediction_file,
}
ORACLES = {
    "reg_metrics": sql(f"SELECT fold, n, {_round(REG)} FROM (SELECT *, {_REG_MORE} FROM (SELECT fold, {_REG_SQL} FROM mscore GROUP BY fold))", "mscore"),
    "reg_daily": sql(f"SELECT fold, day, n, {_round(('rmse', 'mae', 'direction_accuracy'))} FROM (SELECT fold, day, {_REG_SQL} FROM mscore GROUP BY fold, day)", "mscore"),
    "reg_groups": sql(f"SELECT fold, grouping, \"group\", n, {_round(('rmse', 'mae'))} FROM (SELECT fold, grouping, \"group\", {_REG_SQL} FROM mgroup GROUP BY ALL)", "mgroup"),
    "reg_day_equal": sql(f"SELECT fold, score_days, {_round(('rmse', 'mae'))} FROM (SELECT fold, count(*) AS score_days, sqrt(avg(mse)) AS rmse, avg(mae) AS mae FROM (SELECT fold, day, avg((p - y) * (p - y)) AS mse, avg(abs(p - y)) AS mae FROM mscore GROUP BY fold, day) GROUP BY fold)", "mscore"),
    "vol_boundaries": sql(f"SELECT fold, CAST(i - 1 AS INTEGER) AS nth, {round_sql('b')} AS boundary FROM (SELECT fold, unnest(q) AS b, generate_subscripts(q, 1) AS i FROM (SELECT fold, list_sort(list_distinct(quantile_cont(CAST({VOLATILITY} AS DOUBLE), [0.25, 0.5, 0.75]))) AS q FROM mrows WHERE role = 'train' GROUP BY fold))", "mrows"),
    "bin_confusion": sql(f"SELECT fold, n, tp, tn, fp, fn FROM (SELECT fold, {_BIN_SQL} FROM mscore GROUP BY fold)", "mscore"),
    "bin_losses": sql(f"SELECT fold, {_round(RATES)} FROM (SELECT *, {_BIN_MORE} FROM (SELECT fold, {_BIN_SQL} FROM mscore GROUP BY fold))", "mscore"),
    "bin_auc": sql(f"SELECT fold, n, positives, {round_sql('CASE WHEN positives > 0 AND n > positives THEN (twice / 2e0 - positives * (positives + 1) / 2e0) / (positives * (n - positives)) END')} AS auc FROM (SELECT fold, CAST(sum(c) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS positives, sum(pos * (2 * s + c + 1)) AS twice FROM (SELECT *, sum(c) OVER (PARTITION BY fold ORDER BY p2) - c AS s FROM (SELECT fold, floor(q_up * 100) / 100e0 AS p2, count(*) AS c, sum(label) AS pos FROM mscore GROUP BY ALL)) GROUP BY fold)", "mscore"),
    "bin_daily": sql(f"SELECT fold, count(accuracy) AS accuracy_days, count(balanced_accuracy) AS balanced_days, {round_sql('avg(accuracy)')} AS accuracy, {round_sql('avg(balanced_accuracy)')} AS balanced_accuracy FROM bdays GROUP BY fold", "bdays"),
    "bin_groups": sql(f"SELECT fold, grouping, \"group\", n, tp, tn, {round_sql('accuracy')} AS accuracy FROM (SELECT *, {_BIN_MORE} FROM (SELECT fold, grouping, \"group\", {_BIN_SQL} FROM mgroup GROUP BY ALL))", "mgroup"),
    "calibration_bins": sql(f"SELECT CAST(k AS INTEGER) AS bin, coalesce(n, 0) AS n, {round_sql('m')} AS mean_probability, {round_sql('o')} AS observed_up_rate FROM range(10) t(k) LEFT JOIN (SELECT CAST(least(floor(q_up * 10), 9) AS INTEGER) AS b, count(*) AS n, avg(q_up) AS m, avg(label) AS o FROM mscore GROUP BY 1) ON b = k", "mscore"),
    "training_prior": sql(f"SELECT fold, CASE WHEN avg(label) > 0.5 THEN 1 ELSE 0 END AS majority, count(*) AS n, {round_sql('avg(label)')} AS prior FROM mrows WHERE role = 'train' GROUP BY fold", "mrows"),
    "periods_year_quarter": sql(f"SELECT CAST(year(next_day) AS INTEGER) AS year, CAST(quarter(next_day) AS INTEGER) AS quarter, count(*) AS n, count_if(y > 0) AS up, {round_sql('avg(y)')} AS mean_y FROM hits GROUP BY GROUPING SETS ((year(next_day)), (year(next_day), quarter(next_day)))", "hits"),
    "daily_series": sql("SELECT cal_idx AS target_idx, coalesce(n, 0) AS n, coalesce(up, 0) AS up FROM cal LEFT JOIN (SELECT target_idx, count(*) AS n, count_if(y > 0) AS up FROM hits GROUP BY 1) h ON h.target_idx = cal_idx", "cal", "hits"),
    "sensitivity_largest_day": sql(f"SELECT largest_day, largest_n, CAST(all_n - largest_n AS BIGINT) AS rest_n, {round_sql('CASE WHEN all_n > largest_n THEN (all_up - largest_up) / CAST(all_n - largest_n AS DOUBLE) END')} AS rest_rate FROM (SELECT target_idx AS largest_day, n AS largest_n, up AS largest_up, sum(n) OVER () AS all_n, sum(up) OVER () AS all_up FROM (SELECT target_idx, count(*) AS n, count_if(y > 0) AS up FROM hits GROUP BY 1) QUALIFY row_number() OVER (ORDER BY n DESC, target_idx) = 1)", "hits"),
    "audit_row_rules": sql("SELECT stock_id, cal_idx, issue FROM rev", "rev"),
    "audit_issue_summary": sql("SELECT 'error' AS severity, issue AS code, count(*) AS n FROM rev WHERE issue IS NOT NULL GROUP BY issue", "rev"),
    "audit_cases": sql("SELECT \"case\", count(*) AS n FROM tagged GROUP BY 1", "tagged"),
    "audit_case_examples": sql("SELECT \"case\", stock_id, min(d) AS d FROM tagged GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY \"case\" ORDER BY stock_id) <= 5", "tagged"),
    "audit_stock_coverage": sql("SELECT stock_id, count(*) AS daily_rows, count_if(issue IS NULL) AS valid_trading_rows, count_if(issue IS NOT NULL) AS invalid_rows FROM rev GROUP BY ROLLUP (stock_id)", "rev"),
    "audit_next_day_counts": sql("SELECT count_if(a IS NULL) AS calendar_tail_without_next_day, count_if(av) AS next_day_pair_candidates, count_if(a = 0 AND NOT av) AS next_day_suspended, count_if(a <> 0 AND NOT av) AS next_day_invalid_label FROM (SELECT valid, lead(state) OVER w AS a, lead(valid) OVER w AS av FROM (SELECT p.stock_id, p.cal_idx, p.state, r.stock_id IS NOT NULL AS valid FROM panel p LEFT JOIN (SELECT * FROM rev WHERE issue IS NULL) r ON r.stock_id = p.stock_id AND r.cal_idx = p.cal_idx) WINDOW w AS (PARTITION BY stock_id ORDER BY cal_idx)) WHERE valid", "panel", "rev"),
    "audit_month_slice": sql("SELECT side, count(*) AS n FROM (SELECT unnest(['only_left', 'only_right']) AS side FROM arows WHERE cal_idx >= 300 AND cal_idx % 10 = 0) GROUP BY side", "arows"),
    "audit_manifest_merge": sql("SELECT count_if(stock_id NOT LIKE '%1' AND stock_id NOT LIKE '%2') AS equal, count_if(stock_id LIKE '%2') AS conflict, count_if(stock_id LIKE '%1') AS only_left, CAST(0 AS BIGINT) AS only_right FROM (SELECT DISTINCT stock_id FROM panel WHERE state = 1)", "panel"),
    "audit_count_reconcile": sql("SELECT * FROM (SELECT stock_id AS name, count(*) AS declared, count_if(state = 1) AS counted FROM panel WHERE state >= 0 GROUP BY 1) WHERE declared <> counted", "panel"),
    "audit_counters": sql("""SELECT s.stock_id, state_rows, suspended_rows, coalesce(daily_rows, 0) AS daily_rows, coalesce(monthly_daily_rows, 0) AS monthly_daily_rows, coalesce(valid_trading_rows, 0) AS valid_trading_rows, coalesce(independent_reference_rows, 0) AS independent_reference_rows, coalesce(legacy, 0) AS legacy_difference_records_checked,
 coalesce(c1, 0) AS case_listing_day, coalesce(c2, 0) AS case_resumed_after_pause, coalesce(c3, 0) AS case_known_ex_dividend_clue, coalesce(c4, 0) AS case_reference_differs_from_last_close, coalesce(c5, 0) AS case_ordinary
 FROM (SELECT stock_id, count(*) AS state_rows, count_if(state = 0) AS suspended_rows FROM panel WHERE state >= 0 GROUP BY GROUPING SETS ((stock_id), ())) s
 LEFT JOIN (SELECT stock_id, count(*) AS daily_rows, count_if(d >= DATE '2000-01-01') AS monthly_daily_rows, count_if(issue IS NULL) AS valid_trading_rows, count_if(issue IS NULL AND checked) AS independent_reference_rows, count_if(issue IS NULL AND clue IS NOT NULL) AS legacy FROM rev GROUP BY GROUPING SETS ((stock_id), ())) r ON r.stock_id IS NOT DISTINCT FROM s.stock_id
 LEFT JOIN (SELECT stock_id, count_if("case" = 'listing_day') AS c1, count_if("case" = 'resumed_after_pause') AS c2, count_if("case" = 'known_ex_dividend_clue') AS c3, count_if("case" = 'reference_differs_from_last_close') AS c4, count_if("case" = 'ordinary') AS c5 FROM tagged GROUP BY GROUPING SETS ((stock_id), ())) t ON t.stock_id IS NOT DISTINCT FROM s.stock_id""", "panel", "rev", "tagged"),
    "bin_non_flat": sql(f"SELECT fold, n, days, {round_sql('accuracy')} AS accuracy, {round_sql('day_accuracy')} AS day_accuracy FROM (SELECT fold, count(*) AS n, avg(CASE WHEN (q_up > 0.5) = (label = 1) THEN 1e0 ELSE 0e0 END) AS accuracy FROM mscore WHERE y <> 0 GROUP BY fold) JOIN (SELECT fold, count(*) AS days, avg(a) AS day_accuracy FROM (SELECT fold, day, avg(CASE WHEN (q_up > 0.5) = (label = 1) THEN 1e0 ELSE 0e0 END) AS a FROM mscore WHERE y <> 0 GROUP BY fold, day) GROUP BY fold) USING (fold)", "mscore"),
    "sample_reconcile": sql("SELECT name, n AS declared, n AS counted, true AS equal FROM (SELECT unnest(['grid_rows', 'prediction_eligible', 'supervised_candidates']) AS name, unnest([count(*), count_if(prediction_eligible), count_if(prediction_eligible AND target_status = 1)]) AS n FROM samples)", "samples"),
    "audit_month_slice_order": sql("SELECT stock_id, count(*) AS rows, count_if(cal_idx <> other) AS moved FROM (SELECT a.stock_id, a.cal_idx, b.cal_idx AS other FROM (SELECT stock_id, cal_idx, row_number() OVER (PARTITION BY stock_id ORDER BY cal_idx) AS nth FROM arows WHERE cal_idx >= 300) a JOIN (SELECT stock_id, cal_idx, row_number() OVER (PARTITION BY stock_id ORDER BY CASE WHEN cal_idx % 7 = 0 THEN cal_idx + 1.5 ELSE cal_idx END) AS nth FROM arows WHERE cal_idx >= 300) b USING (stock_id, nth)) GROUP BY stock_id", "arows"),
    "return_rescan": sql("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS not_stored, CAST(0 AS BIGINT) AS different FROM panel WHERE state >= 0", "panel"),
    "prediction_file": sql(f"SELECT fold, row_id, {round_sql('p')} AS p, {round_sql('y')} AS truth, CASE target_status WHEN 2 THEN 'target_suspended' WHEN 3 THEN 'outside_calendar' END AS reason FROM mrows WHERE role = 'predict' AND fold <> 'holdout'", "mrows"),
}
