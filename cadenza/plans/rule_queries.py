"""Queries of conditional hit rates, over discovery rows (the first fold's training) and confirmation rows (all folds' scores).

Every feature is mined, for every event. The DuckDB text is written by hand in the second half.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import rounded
from ..operators import features as ft
from ..operators import rules as ru
from ..operators import splits as sp
from ..sources import prepared as prep
from .reference_sql import EVENT_COLUMNS, EVENTS, FEATURE_SQL, with_ctes
from .reference_sql import rounded as round_sql
from .split_queries import FIRST, FOLDS, LENGTH, SPLIT_CTES, plan

QUANTILES, DISCRETE_MAX = [0.1, 0.25, 0.5, 0.75, 0.9], 64
FAMILIES = {n: family for n, (family, _) in ft.catalogue().items()}
BOOT_WIDTH, BOOT_REPS = 5, 200


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of both phases: phase, fold, row_id, entity, day, y, the features and the events. Kept, as every statistic reads them."""
    return prep.kept(spark, sf_dir, "scored", lambda: scored_rows(spark, sf_dir), {"plan": [FIRST, LENGTH, FOLDS], "events": ru.event_expressions()})


def cuts_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature, cuts): a row a feature. Kept."""
    settings = {"plan": [FIRST, LENGTH, FOLDS], "quantiles": QUANTILES, "discrete_max": DISCRETE_MAX, "natural": {n: ru.natural_cuts(n, f) for n, f in FAMILIES.items()}}
    return prep.kept(spark, sf_dir, "cuts", lambda: cuts_of(scored(spark, sf_dir)), settings)


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = sp.roles(prep.samples(spark, sf_dir), plan(spark, sf_dir)).where("(fold = 'F01' AND role = 'train') OR (fold <> 'holdout' AND role = 'score')")
    rows = roles.select(F.when(F.col("role") == "train", "discovery").otherwise("confirmation").alias("phase"), "fold", "row_id", F.col("stock_id").alias("entity"), F.col("target_idx").alias("day"), "y", *FAMILIES)
    return ru.with_events(rows)


def long_rows(rows: DataFrame) -> DataFrame:
    return ru.long_features(rows, list(FAMILIES), "phase", "fold", "row_id", "entity", "day", "y", *ru.EVENTS)


def cuts_of(rows: DataFrame) -> DataFrame:
    """From discovery features alone, before any outcome is read."""
    return ru.make_cuts(long_rows(rows).where("phase = 'discovery'").select("feature", "x", "day", "row_id"), FAMILIES, QUANTILES, DISCRETE_MAX)


class Mined:
    """The frames that several statistics read: scored rows, cuts, and the binned rows."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.rows = scored(spark, sf_dir)
        self.long = long_rows(self.rows)
        self.cuts = cuts_for(spark, sf_dir)
        self.binned = ru.assign_bins(self.long, self.cuts)

    def stats(self, phase: str) -> DataFrame:
        return ru.interval_stats(self.binned.where(F.col("phase") == phase), self.cuts, ru.daily_base(self.rows.where(F.col("phase") == phase)))

    def folds(self, spark: SparkSession) -> DataFrame:
        names = spark.range(1).select(F.explode(F.array(*[F.lit(f"F{i:02}") for i in range(1, 8)])).alias("fold"))
        return ru.interval_folds(self.binned.where("phase = 'confirmation'"), self.cuts, names)

    def classes(self, spark: SparkSession) -> DataFrame:
        return ru.classify(self.stats("discovery"), self.stats("confirmation"), self.folds(spark))


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuts_for(spark, sf_dir).select("feature", F.posexplode("cuts").alias("nth", "cut")).select("feature", "nth", F.expr(f"{rounded('cut')} AS cut"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ru.intervals(cuts_for(spark, sf_dir))


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mined(spark, sf_dir).binned.groupBy("phase", "feature", "bin").agg(F.count(F.lit(1)).alias("n"), F.count_if("up").alias("up"))


SHOWN = ("mean_y", "max_day_share", "max_stock_share", *(f"{p}_{e}" for p in ("daily", "matched") for e in EVENTS))


def interval_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Mined(spark, sf_dir).stats("discovery")
    return out.select("feature", "lo", "hi", "n", "dates", "stocks", *ru.EVENTS, *[F.expr(f"{rounded(n)} AS {n}") for n in SHOWN])


def fold_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mined(spark, sf_dir).folds(spark).select("feature", "lo", "hi", "fold", "n", "dates", *ru.EVENTS)


def classify_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mined(spark, sf_dir).classes(spark).select("feature", "lo", "hi", "event", "discovery_n", "discovery_hits", "confirmation_n", "confirmation_hits", "supported_folds", "passing_folds", "state")


def pooled_over65(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules above 65 % over both phases together."""
    both = Mined(spark, sf_dir).classes(spark).withColumns({"n": F.col("discovery_n") + F.col("confirmation_n"), "hits": F.col("discovery_hits") + F.col("confirmation_hits")})
    return both.where(ru.over_65(F.col("hits"), F.col("n"))).select("feature", "lo", "hi", "event", "n", "hits")


def pooled_over65_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooled_over65(spark, sf_dir).groupBy("feature").agg(F.count(F.lit(1)).alias("rules"), F.count_distinct("event").alias("events"))


def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ru.representatives(Mined(spark, sf_dir).stats("discovery")).select("feature", "event", "lo", "hi", "n", "hits")


def feature_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per feature: intervals above 65 % in both phases, in each, and the correlation in discovery."""
    m = Mined(spark, sf_dir)
    both = m.classes(spark).groupBy("feature").agg(
        F.count(F.lit(1)).alias("rules"), F.count_if(ru.over_65(F.col("discovery_hits"), F.col("discovery_n"))).alias("discovery_over"), F.count_if(ru.over_65(F.col("confirmation_hits"), F.col("confirmation_n"))).alias("confirmation_over"))
    return both.join(ru.correlation(m.long.where("phase = 'discovery'")), "feature", "left").select("feature", "rules", "discovery_over", "confirmation_over", F.expr(f"{rounded('correlation')} AS correlation"))


def feature_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per feature: its conditions, what is there in each phase, correlations, how many rules and events are above 65 % or supported, and the best representative of a direction."""
    m, some = Mined(spark, sf_dir), chosen(spark, sf_dir)
    classes = m.classes(spark)
    d, c = (ru.over_65(F.col(f"{p}_hits"), F.col(f"{p}_n")) for p in ("discovery", "confirmation"))
    counted = classes.groupBy("feature").agg(F.count_if(d | c).alias("empirical_over"), F.count_if(d).alias("discovery_over"), F.count_if(d & c).alias("both_over"), F.count_if(F.col("state") == "supported_cross_period").alias("supported"))
    best = classes.where("event IN ('up', 'down')").join(F.broadcast(some.select(*ru.RULE)), list(ru.RULE)).withColumn("nth", F.expr("row_number() OVER (PARTITION BY feature ORDER BY discovery_n DESC, lo, hi, event DESC)")).where("nth = 1")
    best = best.select("feature", F.col("event").alias("best_event"), F.col("lo").alias("best_lo"), F.col("hi").alias("best_hi"), (F.col("discovery_hits") / F.col("discovery_n")).alias("best_discovery_rate"), (F.col("confirmation_hits") / F.nullif("confirmation_n", F.lit(0))).alias("best_confirmation_rate"), F.col("state").alias("best_state"))
    there = m.long.groupBy("feature").agg(*[F.count(F.when(F.col("phase") == p, F.col("x"))).alias(f"{p}_finite") for p in ("discovery", "confirmation")])
    pearson = [ru.correlation(m.long.where(F.col("phase") == p)).select("feature", F.col("correlation").alias(f"{p}_pearson")) for p in ("discovery", "confirmation")]
    out = m.cuts.select("feature", ((F.size("cuts") + 1) * (F.size("cuts") + 2) / 2 + 1).cast("long").alias("conditions"))
    for part in (there, counted, *pearson, best):  # a row a feature each
        out = out.join(part, "feature", "left")
    return shown(out.na.fill(0, ["empirical_over", "discovery_over", "both_over", "supported"]), ("discovery_pearson", "confirmation_pearson", "best_discovery_rate", "best_confirmation_rate"))


def correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ru.correlation(long_rows(scored(spark, sf_dir)).where("phase = 'discovery'")).select("feature", "n", F.expr(f"{rounded('correlation')} AS correlation"))


def events_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("phase").agg(F.count(F.lit(1)).alias("n"), *ru.hit_sums())


def phase_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    middle = ru.exact_quantiles(rows, ["phase"], "y", [0.5]).select("phase", F.col("q")[0].alias("m"))
    out = rows.groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("day").alias("dates"), F.count_distinct("entity").alias("stocks"), F.expr(f"{rounded('avg(y)')} AS mean_y"), F.expr(f"{rounded('avg(CASE WHEN up THEN 1e0 ELSE 0e0 END)')} AS up_rate"))
    return out.join(middle, "phase").withColumn("median_y", F.expr(rounded("m"))).drop("m")


def over65(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which over 65 % of the rows went up."""
    by = scored(spark, sf_dir).groupBy("phase", "day").agg(F.count(F.lit(1)).alias("n"), F.count_if("up").alias("hits"))
    return by.where(ru.over_65(F.col("hits"), F.col("n")))


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The representatives. Kept, as several tables look at them."""
    settings = {"plan": [FIRST, LENGTH, FOLDS], "quantiles": QUANTILES, "discrete_max": DISCRETE_MAX, "support": {k: str(v) for k, v in ru.SUPPORT.items()}}
    return prep.kept(spark, sf_dir, "representatives", lambda: ru.representatives(Mined(spark, sf_dir).stats("discovery")), settings)


def profile(spark: SparkSession, sf_dir: str) -> ru.Profile:
    m, some = Mined(spark, sf_dir), chosen(spark, sf_dir)
    dates = prep.calendar(spark, sf_dir).select(F.col("cal_idx").alias("day"), F.col("d").alias("date"))
    return ru.Profile(ru.rule_rows(m.binned, some, m.cuts), m.rows, some, dates)


def representative_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every representative by phase, year and quarter."""
    return shown(profile(spark, sf_dir).periods(), ("hit_rate", "mean_return", "median_return", "unconditional_rate"))


def representative_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every representative by phase and day, with the rate of all rows of the day."""
    return shown(profile(spark, sf_dir).days(), ("hit_rate", "mean_return", "same_date_base"))


def representative_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every representative by phase without its largest day."""
    return shown(profile(spark, sf_dir).without_largest_day(), ("rest_rate", "observed_min", "observed_max"))


def shown(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return df.select(*[F.expr(f"{rounded(c)} AS {c}") if c in names else c for c in df.columns])


def selected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of a phase and fold every representative selects."""
    m, some = Mined(spark, sf_dir), chosen(spark, sf_dir)
    rows = m.binned.drop("cuts").join(F.broadcast(ru.rule_index(some, m.cuts)), ["feature", "bin"]).withColumn("r", F.explode("rules"))
    return rows.groupBy("feature", "r.event", "r.lo", "r.hi", "phase", "fold").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every representative and phase: resamples of all scored days in blocks."""
    p = profile(spark, sf_dir)
    out = ru.bootstrap_intervals(p.daily, p.scored.select("phase", "day"), list(ru.RULE), BOOT_REPS, BOOT_WIDTH)
    return shown(out, ("low", "high"))


QUERIES = {f.__name__: f for f in (cuts, intervals, bins, interval_stats, fold_stats, classify_rules, pooled_over65, pooled_over65_counts, representatives, feature_overview, correlation, events_ten, phase_baselines, over65, bootstrap_ci, representative_periods, representative_days, representative_sensitivity, selected_rows, feature_summary)}

# -- the SQL, by hand
_HITS = ", ".join(f"count_if({e}) AS {e}" for e in EVENTS)
_SUMS = ", ".join(f"CAST(sum({e}) AS BIGINT) AS {e}" for e in EVENTS)
_MARKET = "starts_with(feature, 'sh000001_') OR starts_with(feature, 'sz399001_')"
_SUPPORT = {"discovery": (1000, 60, 20), "confirmation": (300, 30, 10)}
_ABLE = {p: f"{p}_n >= {n} AND {p}_dates >= {d} AND {p}_stocks >= {s}" for p, (n, d, s) in _SUPPORT.items()}
_OVER = {p: f"{p}_n > 0 AND 20 * {p}_hits > 13 * {p}_n" for p in _SUPPORT}

# The natural cuts, as single-precision numbers, by what the feature's name says.
_NATURAL = """SELECT feature, list_concat(list_transform(c, lambda x: CAST(CAST(x AS FLOAT) AS DOUBLE)), CASE WHEN fraction THEN [CAST(nextafter(CAST(0 AS FLOAT), CAST(1 AS FLOAT)) AS DOUBLE), CAST(nextafter(CAST(1 AS FLOAT), CAST(2 AS FLOAT)) AS DOUBLE)] ELSE [CAST(nextafter(CAST(0 AS FLOAT), CAST(1 AS FLOAT)) AS DOUBLE)] END) AS fixed_cuts
 FROM (SELECT feature, feature = 'close_position' OR feature LIKE '%valid_fraction%' AS fraction, CASE
 WHEN feature LIKE '%std%' THEN [0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.10]
 WHEN feature LIKE '%relative%' THEN [-0.9, -0.75, -0.5, 0, 0.5, 1, 2, 4, 9]
 WHEN feature = 'listing_age_days' THEN [5, 10, 20, 30, 60, 90, 180, 365, 730, 1095, 1825, 3650, 7300]
 WHEN feature = 'close_position' OR feature LIKE '%valid_fraction%' THEN [0, 0.25, 0.5, 0.75, 0.9, 0.95, 1]
 WHEN feature = 'turnover' THEN [0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.10, 0.20, 0.30, 0.50]
 WHEN feature = 'turnover_change_1' THEN [-0.10, -0.05, -0.02, -0.01, 0, 0.01, 0.02, 0.05, 0.10]
 WHEN feature IN ('candle_body', 'high_low_range', 'upper_shadow', 'lower_shadow') THEN [-0.10, -0.05, -0.03, -0.02, -0.01, 0, 0.01, 0.02, 0.03, 0.05, 0.10, 0.20]
 WHEN feature IN ('suspended_days_20', 'days_since_previous_trade') THEN [0, 1, 2, 5, 10, 20, 60]
 ELSE [-0.20, -0.10, -0.099, -0.098, -0.095, -0.05, -0.03, -0.02, -0.01, 0, 0.01, 0.02, 0.03, 0.05, 0.095, 0.098, 0.099, 0.10, 0.20] END AS c FROM (SELECT DISTINCT feature FROM long))"""


def _stats(phase: str) -> dict[str, tuple[tuple[str, ...], str]]:
    p = phase[0]
    return {
        f"{p}cell": (("binned",), f"SELECT feature, bin, day, count(*) AS n, sum(y) AS sum_y, {_HITS} FROM binned WHERE phase = '{phase}' GROUP BY ALL"),
        f"{p}day": ((f"{p}cell", "ints"), f"SELECT i.feature, lo, hi, day, sum(n) AS n, sum(sum_y) AS sum_y, {', '.join(f'sum({e}) AS {e}' for e in EVENTS)} FROM {p}cell b JOIN ints i ON b.feature = i.feature AND bin >= lo AND bin < hi GROUP BY ALL"),
        f"{p}base": (("scored",), f"SELECT day, {', '.join(f'avg(CAST({e} AS DOUBLE)) AS base_{e}' for e in EVENTS)} FROM scored WHERE phase = '{phase}' GROUP BY day"),
        f"{p}ecell": (("binned",), f"SELECT feature, bin, entity, count(*) AS n FROM binned WHERE phase = '{phase}' GROUP BY ALL"),
        f"{p}ent": ((f"{p}ecell", "ints"), f"SELECT feature, lo, hi, count(*) AS stocks, max(n) / CAST(sum(n) AS DOUBLE) AS max_stock_share FROM (SELECT i.feature, lo, hi, entity, sum(n) AS n FROM {p}ecell b JOIN ints i ON b.feature = i.feature AND bin >= lo AND bin < hi GROUP BY ALL) GROUP BY ALL"),
        f"{p}stats": ((f"{p}day", f"{p}base", f"{p}ent"), f"SELECT t.*, stocks, max_stock_share FROM (SELECT feature, lo, hi, CAST(sum(n) AS BIGINT) AS n, count(*) AS dates, sum(sum_y) / sum(n) AS mean_y, max(n) / CAST(sum(n) AS DOUBLE) AS max_day_share, {_SUMS}, {', '.join(f'avg({e} / CAST(n AS DOUBLE)) AS daily_{e}' for e in EVENTS)}, {', '.join(f'sum(n * base_{e}) / sum(n) AS matched_{e}' for e in EVENTS)} FROM {p}day JOIN {p}base USING (day) GROUP BY feature, lo, hi) t JOIN {p}ent USING (feature, lo, hi)"),
        f"{p}long": ((f"{p}stats",), " UNION ALL ".join(f"SELECT feature, lo, hi, n AS {phase}_n, dates AS {phase}_dates, stocks AS {phase}_stocks, '{e}' AS event, {e} AS {phase}_hits FROM {p}stats" for e in EVENTS)),
    }


_COUNTED = ("discovery_n", "discovery_dates", "discovery_stocks", "discovery_hits", "confirmation_n", "confirmation_dates", "confirmation_stocks", "confirmation_hits", "supported_folds", "passing_folds")
RULE_CTES = SPLIT_CTES | {
    "scored": (("roles", "feats"), f"SELECT *, {EVENT_COLUMNS} FROM (SELECT CASE role WHEN 'train' THEN 'discovery' ELSE 'confirmation' END AS phase, fold, row_id, r.stock_id AS entity, target_idx AS day, y, {', '.join(f'f.{n}' for n in FEATURE_SQL)} FROM roles r JOIN feats f ON f.stock_id = r.stock_id AND f.cal_idx = r.cal_idx WHERE (fold = 'F01' AND role = 'train') OR (fold <> 'holdout' AND role = 'score'))"),
    "long": (("scored",), " UNION ALL ".join(f"SELECT phase, fold, row_id, entity, day, y, {', '.join(EVENTS)}, '{n}' AS feature, CAST({n} AS DOUBLE) AS x FROM scored" for n in FEATURE_SQL)),
    "vals": (("long",), f"SELECT feature, x FROM long WHERE phase = 'discovery' AND x IS NOT NULL AND NOT ({_MARKET}) UNION ALL SELECT feature, x FROM (SELECT feature, arg_min(x, row_id) AS x FROM long WHERE phase = 'discovery' AND ({_MARKET}) AND x IS NOT NULL GROUP BY feature, day)"),
    "nat": (("long",), _NATURAL),
    "cuts": (("vals", "nat"), f"SELECT feature, CASE WHEN low = high THEN [] WHEN len(states) <= {DISCRETE_MAX} THEN list_transform(range(1, len(states)), lambda i: (states[i] + states[i + 1]) / 2) ELSE list_sort(list_distinct(list_filter(list_concat(q, fixed_cuts), lambda c: c > low AND c <= high))) END AS cuts FROM (SELECT feature, min(x) AS low, max(x) AS high, quantile_cont(x, {QUANTILES}) AS q, list_sort(list(DISTINCT x)) AS states FROM vals GROUP BY feature) JOIN nat USING (feature)"),
    "binned": (("long", "cuts"), "SELECT l.*, CASE WHEN x IS NULL THEN len(cuts) + 1 ELSE len(list_filter(cuts, lambda c: c <= x)) END AS bin FROM long l JOIN cuts USING (feature)"),
    "ints": (("cuts",), "SELECT feature, lo, hi FROM (SELECT feature, len(cuts) + 1 AS k FROM cuts), range(0, 200) a(lo), range(1, 201) b(hi) WHERE lo < hi AND hi <= k UNION ALL SELECT feature, len(cuts) + 1, len(cuts) + 2 FROM cuts"),
    **_stats("discovery"), **_stats("confirmation"),
    "fcell": (("binned",), f"SELECT feature, bin, fold, day, count(*) AS n, {_HITS} FROM binned WHERE phase = 'confirmation' GROUP BY ALL"),
    "fstats": (("fcell", "ints"), f"SELECT i.feature, lo, hi, fold, coalesce(n, 0) AS n, coalesce(dates, 0) AS dates, {', '.join(f'coalesce({e}, 0) AS {e}' for e in EVENTS)} FROM ints i CROSS JOIN (SELECT printf('F%02d', k) AS fold FROM range(1, 8) t(k)) f LEFT JOIN (SELECT j.feature, lo, hi, fold, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT day) AS dates, {_SUMS} FROM fcell b JOIN ints j ON b.feature = j.feature AND bin >= lo AND bin < hi GROUP BY ALL) c USING (feature, lo, hi, fold)"),
    "stable": (("fstats",), "SELECT feature, lo, hi, event, count(*) AS supported_folds, count_if(20 * hits > 13 * n) AS passing_folds FROM (" + " UNION ALL ".join(f"SELECT feature, lo, hi, n, '{e}' AS event, {e} AS hits FROM fstats WHERE n >= 20 AND dates >= 10" for e in EVENTS) + ") GROUP BY ALL"),
    "classes": (("dlong", "clong", "stable"), f"""SELECT *, CASE WHEN {_OVER['discovery']} AND {_OVER['confirmation']} AND {_ABLE['discovery']} AND {_ABLE['confirmation']} AND supported_folds >= 3 AND 2 * passing_folds > supported_folds THEN 'supported_cross_period'
 WHEN {_OVER['discovery']} AND {_OVER['confirmation']} THEN 'both_over_weak_support' WHEN {_OVER['discovery']} AND confirmation_n > 0 THEN 'discovery_only_not_reproduced' WHEN {_OVER['discovery']} THEN 'discovery_only_no_later_sample' WHEN {_OVER['confirmation']} THEN 'later_only' ELSE 'not_over' END AS state
 FROM (SELECT feature, lo, hi, event, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _COUNTED)} FROM dlong FULL JOIN clong USING (feature, lo, hi, event) LEFT JOIN stable USING (feature, lo, hi, event))"""),
    "pooled": (("classes",), "SELECT feature, lo, hi, event, n, hits FROM (SELECT *, discovery_n + confirmation_n AS n, discovery_hits + confirmation_hits AS hits FROM classes) WHERE n > 0 AND 20 * hits > 13 * n"),
    "corr_": (("long",), "SELECT feature, count(*) AS n, CASE WHEN count(*) >= 2 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END AS c FROM long WHERE phase = 'discovery' AND x IS NOT NULL AND y IS NOT NULL GROUP BY feature"),
    "reps": (("dlong",), f"SELECT feature, event, lo, hi FROM dlong WHERE {_OVER['discovery']} AND {_ABLE['discovery']} QUALIFY row_number() OVER (PARTITION BY feature, event ORDER BY discovery_n DESC, lo, hi) = 1"),
    "rep_rows": (("reps", "binned", "cal"), f"SELECT r.*, phase, fold, row_id, entity, day, x, y, c.d AS date, CASE event {' '.join(f'WHEN {chr(39)}{e}{chr(39)} THEN {e}' for e in EVENTS)} END AS hit FROM reps r JOIN binned b ON b.feature = r.feature AND b.bin >= r.lo AND b.bin < r.hi JOIN cal c ON c.cal_idx = b.day"),
    "flags": (("scored", "cal"), " UNION ALL ".join(f"SELECT phase, day, d AS date, '{e}' AS event, {e} AS flag FROM scored JOIN cal ON cal_idx = day" for e in EVENTS)),
    "rep_daily": (("rep_rows",), "SELECT feature, event, lo, hi, phase, day, count(*) AS n, count_if(hit) AS hits, avg(y) AS mean_y FROM rep_rows GROUP BY ALL"),
    "num": (("scored",), "SELECT phase, day, row_number() OVER (PARTITION BY phase ORDER BY day) - 1 AS nth, count(*) OVER (PARTITION BY phase) AS days FROM (SELECT DISTINCT phase, day FROM scored)"),
    # every drawn day of every resample, one by one
    "drawn": (("num",), f"SELECT phase, rep, day FROM (SELECT p.phase, rep, (((rep * 7919 + block * 104729 + 17) % days) + j) % days AS nth FROM (SELECT DISTINCT phase, days FROM num) p, range({BOOT_REPS}) a(rep), range(0, 400) b(block), range(0, {BOOT_WIDTH}) c(j) WHERE block < ceil(days / {BOOT_WIDTH}e0) AND block * {BOOT_WIDTH} + j < days) JOIN num USING (phase, nth)"),
}


def sql(body: str, *names: str) -> str:
    """A body with CTEs of its own goes on with the list."""
    text = with_ctes("\0" + body, *names, extra=RULE_CTES)
    return text.replace("\n\0WITH ", ",\n").replace("\0", "")


_EDGES = "CAST(lo AS INTEGER) AS lo, CAST(hi AS INTEGER) AS hi"
ORACLES = {
    "cuts": sql(f"SELECT feature, CAST(i - 1 AS INTEGER) AS nth, {round_sql('c')} AS cut FROM (SELECT feature, unnest(cuts) AS c, generate_subscripts(cuts, 1) AS i FROM cuts)", "cuts"),
    "bins": sql("SELECT phase, feature, CAST(bin AS INTEGER) AS bin, count(*) AS n, count_if(up) AS up FROM binned GROUP BY ALL", "binned"),
    "intervals": sql(f"SELECT feature, {_EDGES} FROM ints", "ints"),
    "interval_stats": sql(f"SELECT feature, {_EDGES}, n, dates, stocks, {', '.join(EVENTS)}, {', '.join(f'{round_sql(n)} AS {n}' for n in SHOWN)} FROM dstats", "dstats"),
    "fold_stats": sql(f"SELECT feature, {_EDGES}, fold, n, dates, {', '.join(EVENTS)} FROM fstats", "fstats"),
    "classify_rules": sql(f"SELECT feature, {_EDGES}, event, discovery_n, discovery_hits, confirmation_n, confirmation_hits, supported_folds, passing_folds, state FROM classes", "classes"),
    "pooled_over65": sql(f"SELECT feature, {_EDGES}, event, n, hits FROM pooled", "pooled"),
    "pooled_over65_counts": sql("SELECT feature, count(*) AS rules, count(DISTINCT event) AS events FROM pooled GROUP BY feature", "pooled"),
    "representatives": sql(f"SELECT feature, event, {_EDGES}, discovery_n AS n, discovery_hits AS hits FROM dlong WHERE {_OVER['discovery']} AND {_ABLE['discovery']} QUALIFY row_number() OVER (PARTITION BY feature, event ORDER BY discovery_n DESC, lo, hi) = 1", "dlong"),
    "feature_overview": sql(f"SELECT feature, rules, discovery_over, confirmation_over, {round_sql('c')} AS correlation FROM (SELECT feature, count(*) AS rules, count_if({_OVER['discovery']}) AS discovery_over, count_if({_OVER['confirmation']}) AS confirmation_over FROM classes GROUP BY feature) LEFT JOIN corr_ USING (feature)", "classes", "corr_"),
    "feature_summary": sql(f"""WITH pear AS (SELECT feature, phase, CASE WHEN count(*) >= 2 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END AS c FROM long WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY feature, phase),
best AS (SELECT c.* FROM classes c JOIN reps r ON r.feature = c.feature AND r.event = c.event AND r.lo = c.lo AND r.hi = c.hi WHERE c.event IN ('up', 'down') QUALIFY row_number() OVER (PARTITION BY c.feature ORDER BY discovery_n DESC, c.lo, c.hi, c.event DESC) = 1),
tot AS (SELECT feature, count_if(({_OVER['discovery']}) OR ({_OVER['confirmation']})) AS eo, count_if({_OVER['discovery']}) AS d_o, count_if({_OVER['discovery']} AND {_OVER['confirmation']}) AS bo, count_if(state = 'supported_cross_period') AS su FROM classes GROUP BY feature)
SELECT i.feature, conditions, discovery_finite, confirmation_finite, coalesce(eo, 0) AS empirical_over, coalesce(d_o, 0) AS discovery_over, coalesce(bo, 0) AS both_over, coalesce(su, 0) AS supported, {round_sql('pd.c')} AS discovery_pearson, {round_sql('pc.c')} AS confirmation_pearson, b.event AS best_event, CAST(b.lo AS INTEGER) AS best_lo, CAST(b.hi AS INTEGER) AS best_hi, {round_sql('b.discovery_hits / CAST(b.discovery_n AS DOUBLE)')} AS best_discovery_rate, {round_sql('b.confirmation_hits / CAST(nullif(b.confirmation_n, 0) AS DOUBLE)')} AS best_confirmation_rate, b.state AS best_state
FROM (SELECT feature, count(*) AS conditions FROM ints GROUP BY feature) i JOIN (SELECT feature, count_if(phase = 'discovery' AND x IS NOT NULL) AS discovery_finite, count_if(phase = 'confirmation' AND x IS NOT NULL) AS confirmation_finite FROM long GROUP BY feature) USING (feature)
LEFT JOIN tot ON tot.feature = i.feature LEFT JOIN (SELECT * FROM pear WHERE phase = 'discovery') pd ON pd.feature = i.feature LEFT JOIN (SELECT * FROM pear WHERE phase = 'confirmation') pc ON pc.feature = i.feature LEFT JOIN best b ON b.feature = i.feature""", "classes", "reps", "long", "ints"),
    "correlation": sql(f"SELECT feature, n, {round_sql('c')} AS correlation FROM corr_", "corr_"),
    "events_ten": sql(f"SELECT phase, count(*) AS n, {_HITS} FROM scored GROUP BY phase", "scored"),
    "phase_baselines": sql(f"SELECT phase, count(*) AS n, count(DISTINCT day) AS dates, count(DISTINCT entity) AS stocks, {round_sql('avg(y)')} AS mean_y, {round_sql('avg(CASE WHEN up THEN 1e0 ELSE 0e0 END)')} AS up_rate, {round_sql('median(y)')} AS median_y FROM scored GROUP BY phase", "scored"),
    "over65": sql("SELECT * FROM (SELECT phase, day, count(*) AS n, count_if(up) AS hits FROM scored GROUP BY phase, day) WHERE 20 * hits > 13 * n", "scored"),
    "bootstrap_ci": sql(f"SELECT feature, event, {_EDGES}, phase, count(*) AS resamples, {round_sql('quantile_cont(h / CAST(n AS DOUBLE), 0.025)')} AS low, {round_sql('quantile_cont(h / CAST(n AS DOUBLE), 0.975)')} AS high FROM (SELECT feature, event, lo, hi, phase, rep, sum(n) AS n, sum(hits) AS h FROM drawn JOIN rep_daily USING (phase, day) GROUP BY ALL) GROUP BY ALL", "drawn", "rep_daily"),
    "selected_rows": sql(f"SELECT feature, event, {_EDGES}, phase, fold, count(*) AS n, min(row_id) AS first_row, max(row_id) AS last_row FROM rep_rows GROUP BY ALL", "rep_rows"),
    "representative_periods": sql(f"""WITH kinds AS (SELECT unnest(['year', 'quarter']) AS period_kind), named AS (SELECT *, CASE period_kind WHEN 'year' THEN strftime(date, '%Y') ELSE strftime(date, '%Y') || 'Q' || quarter(date) END AS period FROM rep_rows CROSS JOIN kinds),
base AS (SELECT phase, event, period_kind, CASE period_kind WHEN 'year' THEN strftime(date, '%Y') ELSE strftime(date, '%Y') || 'Q' || quarter(date) END AS period, avg(CASE WHEN flag THEN 1e0 ELSE 0e0 END) AS base FROM flags CROSS JOIN kinds GROUP BY ALL),
got AS (SELECT feature, event, lo, hi, phase, period_kind, period, count(*) AS n, count_if(hit) AS hits, count(DISTINCT day) AS dates, count(DISTINCT entity) AS stocks, avg(y) AS m, median(y) AS mid FROM named GROUP BY ALL)
SELECT feature, event, {_EDGES}, phase, period_kind, period, coalesce(n, 0) AS n, coalesce(hits, 0) AS hits, {round_sql('hits / CAST(n AS DOUBLE)')} AS hit_rate, coalesce(dates, 0) AS dates, coalesce(stocks, 0) AS stocks, {round_sql('m')} AS mean_return, {round_sql('mid')} AS median_return, {round_sql('base')} AS unconditional_rate
FROM reps JOIN base USING (event) LEFT JOIN got USING (feature, event, lo, hi, phase, period_kind, period)""", "reps", "rep_rows", "flags"),
    "representative_days": sql(f"SELECT feature, event, {_EDGES}, phase, CAST(day AS INTEGER) AS day, coalesce(n, 0) AS n, coalesce(hits, 0) AS hits, {round_sql('hits / CAST(n AS DOUBLE)')} AS hit_rate, {round_sql('mean_y')} AS mean_return, {round_sql('base')} AS same_date_base FROM reps JOIN (SELECT phase, day, event, avg(CASE WHEN flag THEN 1e0 ELSE 0e0 END) AS base FROM flags GROUP BY ALL) USING (event) LEFT JOIN rep_daily USING (feature, event, lo, hi, phase, day)", "reps", "rep_daily", "flags"),
    "representative_sensitivity": sql(f"""WITH top AS (SELECT feature, event, lo, hi, phase, day, n, hits, sum(n) OVER w AS all_n, sum(hits) OVER w AS all_hits FROM rep_daily WINDOW w AS (PARTITION BY feature, event, lo, hi, phase) QUALIFY row_number() OVER (PARTITION BY feature, event, lo, hi, phase ORDER BY n DESC, day) = 1),
spread AS (SELECT feature, event, lo, hi, phase, min(x) AS low, max(x) AS high, count(DISTINCT x) AS k FROM rep_rows GROUP BY ALL)
SELECT feature, event, {_EDGES}, phase, CAST(coalesce(all_n, 0) AS BIGINT) AS n, CAST(coalesce(day, 0) AS INTEGER) AS largest_day, coalesce(n, 0) AS largest_day_n, coalesce(hits, 0) AS largest_day_hits, CAST(coalesce(all_n - n, 0) AS BIGINT) AS rest_n, CAST(coalesce(all_hits - hits, 0) AS BIGINT) AS rest_hits, coalesce(k, 0) AS observed_values, {round_sql('CASE WHEN all_n > n THEN (all_hits - hits) / CAST(all_n - n AS DOUBLE) END')} AS rest_rate, {round_sql('low')} AS observed_min, {round_sql('high')} AS observed_max
FROM reps CROSS JOIN (SELECT DISTINCT phase FROM scored) LEFT JOIN top USING (feature, event, lo, hi, phase) LEFT JOIN spread USING (feature, event, lo, hi, phase)""", "reps", "rep_daily", "rep_rows", "scored"),
}
