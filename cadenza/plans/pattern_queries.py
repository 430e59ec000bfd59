"""Queries of chart rules over the brand by week panel; thresholds are scaled to its dispersion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import rounded
from ..operators import features as ft
from ..operators import indicators as ind
from ..operators import patterns as pt
from ..operators import rules as ru
from ..operators import targets as tg
from ..sources import prepared as prep
from .reference_sql import EVENTS, with_ctes
from .reference_sql import rounded as round_sql
from .rule_queries import RULE_CTES, scored
from .split_queries import FIRST, FOLDS, LENGTH

#: 81 platforms, 48 bottoms, 36 channels, among them the three canonical ones.
CONFIG = {
    "platform": {"windows": (20, 40, 60), "maximum_widths": (0.1, 1.5, 4.0), "breakout_minimums": (0.0, 0.05, 0.2), "volume_minimums": (None, 0.8, 1.5)},
    "bottom_volume": {"windows": (60, 120), "minimum_drawdowns": (0.05, 0.2), "maximum_low_distances": (0.08, 0.6, 2.0), "volume_minimums": (0.5, 2.0), "rising_today": (True, False)},
    "ascending_channel": {"windows": (20, 40, 60), "minimum_gains": (-0.5, 0.1), "maximum_widths": (0.2, 20.0), "positions": ("all", "lower", "upper"), "minimum_r_squared": 0.01, "sigma_zero_tolerance": 1e-12},
}
RULES = pt.rule_grid(CONFIG)
#: Channels on the scale of the panel, of which few are as narrow as the canonical one; `pattern_channel` judges these too.
WIDE_CHANNELS = CONFIG["ascending_channel"] | {"minimum_gains": (-0.5, 0.0), "maximum_widths": (2.0, 20.0)}
#: What the queries of one family judge.
FAMILY_RULES = {family: [r for r in RULES if r["family"] == family] for family in pt.FAMILIES}
FAMILY_RULES["ascending_channel"] = pt.joined_grid(FAMILY_RULES["ascending_channel"], [r for r in pt.rule_grid(CONFIG | {"ascending_channel": WIDE_CHANNELS}) if r["family"] == "ascending_channel"])
#: Least rows, dates and entities of a phase, rows and dates of a fold, and how many folds: a tenth of what intervals need, as signals are rarer.
SUPPORT = {"discovery": (100, 30, 10), "confirmation": (30, 15, 5), "fold": (5, 3), "folds": 3}
FOLD_NAMES = tuple(f"F{i:02}" for i in range(1, FOLDS + 1))
METRICS = {"volume_shares_relative_20_plus_one": "volume_shares_relative_20 + CAST(1 AS DOUBLE)", "amount_yuan_relative_20_plus_one": "amount_yuan_relative_20 + CAST(1 AS DOUBLE)", "turnover": "turnover"}
BOOT_WIDTH, BOOT_REPS = 5, 200
VOLUME = f"{ft.catalogue()['volume_shares_relative_20'][1]} + 1"


def indicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with indicators, the volume ratio and outcomes."""
    return tg.with_targets(ind.indicators(ft.quote_index(prep.panel(spark, sf_dir))).withColumn("volume_ratio_20", F.expr(VOLUME))).where("state >= 0")


def triggers(spark: SparkSession, sf_dir: str, family: str | None = None, only: str = "known") -> DataFrame:
    """Rows of rules that are known (or hit)."""
    rules = FAMILY_RULES[family] if family else RULES
    return pt.unpacked(pt.packed(indicated(spark, sf_dir), rules, "state", "y", "target_idx"), rules, only)


def pattern_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules, and the first and last date of the panel on which each is known and hit."""
    dates = triggers(spark, sf_dir).groupBy("rule_id").agg(F.min("cal_idx").alias("first_known"), F.max("cal_idx").alias("last_known"), F.min(F.when(F.col("hit"), F.col("cal_idx"))).alias("first_signal"))
    return pt.rule_frame(spark, RULES).select("rule_id", "family", "canonical", "window", F.coalesce("volume", F.lit(0.0)).alias("volume")).join(dates, "rule_id", "left")


def family_query(family: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rules = FAMILY_RULES[family]
        counted = triggers(spark, sf_dir, family).groupBy("rule_id").agg(F.count_if("known").alias("known"), F.count_if("hit").alias("hit"))
        return pt.rule_frame(spark, rules).select("rule_id").join(counted, "rule_id", "left").na.fill(0)

    return run


def first_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers(spark, sf_dir, only="first_hit").select("rule_id", "stock_id", "cal_idx")


def judge(spark: SparkSession, sf_dir: str) -> pt.Judged:
    return pt.Judged(pt.packed(indicated(spark, sf_dir), RULES, "state", "y", "target_idx"), scored(spark, sf_dir), RULES, SUPPORT)


def kept(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Kept, as several tables read them: what the rules did by day, and the statistics of both phases."""
    settings = {"rules": [str(r) for r in RULES], "events": ru.event_expressions(), "plan": [FIRST, LENGTH, FOLDS], "conditions": [str(pt.conditions(r)) for r in RULES]}
    return prep.kept(spark, sf_dir, name, build, settings)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "pattern_daily", lambda: judge(spark, sf_dir).daily())


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "pattern_statistics", lambda: judge(spark, sf_dir).statistics(daily(spark, sf_dir)))


def judgement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, sf_dir).judged(daily(spark, sf_dir), statistics(spark, sf_dir), FOLD_NAMES)


def tidy(df: DataFrame) -> DataFrame:
    return df.select(*[F.expr(f"{rounded(c)} AS {c}") if kind == "double" else c for c, kind in df.dtypes])


def pattern_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per rule, view and phase: scored signals and the ten events."""
    return tidy(statistics(spark, sf_dir))


def pattern_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per rule, view and event: both phases, the pooled rate and the state."""
    return tidy(judgement(spark, sf_dir))


def pattern_pooled_over65(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules, views and events above 65 % over both phases together."""
    return judgement(spark, sf_dir).where(ru.over_65(F.col("pooled_hits"), F.col("pooled_n"))).select("rule_id", "view", "event", "pooled_n", "pooled_hits", "state")


def pattern_fold_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmation signals by fold: every rule, view and fold, and the ten events."""
    return judge(spark, sf_dir).folds(daily(spark, sf_dir), FOLD_NAMES)


def discovery_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per family, view and event the supported rule with the most discovery signals of those above 65 %."""
    return judge(spark, sf_dir).choices(judgement(spark, sf_dir)).select("family", "view", "event", "rule_id", F.col("discovery_n").alias("n"), F.col("discovery_hits").alias("hits"), "state")


def pattern_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical rules and the choices, with block bootstrap intervals in confirmation."""
    out = judge(spark, sf_dir).representatives(judgement(spark, sf_dir), daily(spark, sf_dir), BOOT_REPS, BOOT_WIDTH)
    return tidy(out.select("rule_id", "view", "event", "family", "canonical", "discovery_selected", "state", "discovery_n", "discovery_hits", "confirmation_n", "confirmation_hits", "confirmation_ci_low", "confirmation_ci_high"))


def pattern_family_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, sf_dir).family_states(judgement(spark, sf_dir))


def pattern_view_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, sf_dir).coverage()


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.coverage(pt.packed(indicated(spark, sf_dir), RULES, "state", "y"), RULES)


def family_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage(spark, sf_dir).groupBy("family").agg(F.count("rule_id").alias("rules"), F.sum("known").alias("known"), F.sum("signals").alias("signals"), F.sum("first_signals").alias("first_signals"), F.count_if(F.col("signals") > 0).alias("rules_with_signals"))


def liquidity_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per rule, view and phase: volume, amount and turnover on its scored signals."""
    return tidy(judge(spark, sf_dir).liquidity(METRICS))


QUERIES = {
    "pattern_grid": pattern_grid, "pattern_platform": family_query("platform"), "pattern_bottom": family_query("bottom_volume"), "pattern_channel": family_query("ascending_channel"), "first_trigger": first_trigger,
    "pattern_stats": pattern_stats, "pattern_fold_stats": pattern_fold_stats, "pattern_coverage": coverage, "discovery_choice": discovery_choice, "family_summary": family_summary, "liquidity_diag": liquidity_diag,
    "pattern_judged": pattern_judged, "pattern_pooled_over65": pattern_pooled_over65, "pattern_representatives": pattern_representatives, "pattern_family_states": pattern_family_states, "pattern_view_coverage": pattern_view_coverage,
}

# -- the SQL, by hand: rules are rows, and so are the indicators of a window
_P = "SELECT *, printf('P%03d', row_number() OVER (ORDER BY a, b, c, e)) AS rule_id FROM (SELECT * FROM (VALUES (1, 20), (2, 40), (3, 60)) w(a, k), (VALUES (1, 0.1e0), (2, 1.5e0), (3, 4e0)) x(b, width), (VALUES (1, 0e0), (2, 0.05e0), (3, 0.2e0)) y(c, breakout), (VALUES (1, NULL), (2, 0.8e0), (3, 1.5e0)) z(e, volume))"
_B = "SELECT *, printf('B%03d', row_number() OVER (ORDER BY a, b, c, e, f)) AS rule_id FROM (SELECT * FROM (VALUES (1, 60), (2, 120)) w(a, k), (VALUES (1, 0.05e0), (2, 0.2e0)) x(b, drawdown), (VALUES (1, 0.08e0), (2, 0.6e0), (3, 2e0)) y(c, low), (VALUES (1, 0.5e0), (2, 2e0)) z(e, volume), (VALUES (1, TRUE), (2, FALSE)) v(f, rising))"
_C = "SELECT *, printf('C%03d', row_number() OVER (ORDER BY a, b, c, e)) AS rule_id FROM (SELECT * FROM (VALUES (1, 20), (2, 40), (3, 60)) w(a, k), (VALUES (1, -0.5e0), (2, 0.1e0)) x(b, gain), (VALUES (1, 0.2e0), (2, 20e0)) y(c, width), (VALUES (1, 'all'), (2, 'lower'), (3, 'upper')) z(e, position))"
#: The wide channels, without the nine that are in the grid above.
_CW = "SELECT *, printf('C%03d', 36 + row_number() OVER (ORDER BY a, b, c, e)) AS rule_id FROM (SELECT * FROM (VALUES (1, 20), (2, 40), (3, 60)) w(a, k), (VALUES (1, -0.5e0), (2, 0e0)) x(b, gain), (VALUES (1, 2e0), (2, 20e0)) y(c, width), (VALUES (1, 'all'), (2, 'lower'), (3, 'upper')) z(e, position) WHERE gain = 0 OR width = 2)"
_ROW = "stock_id, cal_idx, state, y, target_idx, volume_ratio_20, r, volume_history_complete"
_OUT = "stock_id, cal_idx, state, y, target_idx"
_CHANNELS = f"SELECT {_OUT}, rule_id, 'ascending_channel' AS family, state = 1 AND gain_ IS NOT NULL AND r2 IS NOT NULL AND shift IS NOT NULL AND sigma > 1e-12 AS known, gain_ >= gain AND r2 >= 0.01e0 AND 4 * sigma <= ln(1 + width) AND abs(shift) <= 2 * sigma AND (position = 'all' OR (position = 'lower') = (shift < 0)) AS holds FROM crows JOIN {{rules}} USING (k)"


def _by_window(names: dict[str, str], windows: tuple[int, ...]) -> str:
    return " UNION ALL ".join(f"SELECT {_ROW}, {k} AS k, {', '.join(f'{c}_{k} AS {n}' for n, c in names.items())} FROM indicated" for k in windows)


#: What a phase shows, and which of it is zero without signals.
_STAGE = {"n": "n", "hits": "hits", "dates": "dates", "stocks": "stocks", "mean_return": "mean_return", "median_return": "median_return", "daily": "daily_equal_rate", "matched": "matched_date_base", "max_day_share": "max_day_share", "max_stock_share": "max_stock_share"}
_ZERO = ("n", "hits", "dates", "stocks")
_CANON = "coalesce((family = 'platform' AND k = 20 AND width = 0.1e0 AND breakout = 0 AND volume = 1.5e0) OR (family = 'bottom_volume' AND k = 120 AND drawdown = 0.2e0 AND low = 0.08e0 AND volume = 2 AND rising) OR (family = 'ascending_channel' AND k = 60 AND gain = 0.1e0 AND width = 0.2e0 AND position = 'all'), false)"
PATTERN_CTES = RULE_CTES | {
    "indicated": (("inds", "targets"), "SELECT i.*, t.target_idx, t.y FROM inds i JOIN targets t ON t.stock_id = i.stock_id AND t.cal_idx = i.cal_idx WHERE i.state >= 0"),
    "prules": ((), _P), "brules": ((), _B), "crules": ((), _C),
    "every_rule": (("prules", "brules", "crules"), "SELECT rule_id, 'platform' AS family, k, volume, width, breakout, NULL AS drawdown, NULL AS low, NULL AS rising, NULL AS gain, NULL AS position FROM prules UNION ALL SELECT rule_id, 'bottom_volume', k, volume, NULL, NULL, drawdown, low, rising, NULL, NULL FROM brules UNION ALL SELECT rule_id, 'ascending_channel', k, NULL, width, NULL, NULL, NULL, NULL, gain, position FROM crules"),
    "prows": (("indicated",), _by_window({"width_": "prior_width", "drift": "prior_drift", "out_": "breakout"}, (20, 40, 60))),
    "brows": (("indicated",), _by_window({"down": "prior_drawdown", "above": "bottom_low_distance"}, (60, 120))),
    "crows": (("indicated",), _by_window({"gain_": "channel_gain", "r2": "channel_r2", "sigma": "channel_sigma", "shift": "channel_offset"}, (20, 40, 60))),
    "pknown": (("prows", "prules"), f"SELECT {_OUT}, rule_id, 'platform' AS family, state = 1 AND width_ IS NOT NULL AND drift IS NOT NULL AND out_ IS NOT NULL AND (volume IS NULL OR (volume_ratio_20 IS NOT NULL AND volume_history_complete = 1)) AS known, width_ <= width AND abs(drift) <= width / 2 AND out_ > breakout AND (volume IS NULL OR volume_ratio_20 >= volume) AS holds FROM prows JOIN prules USING (k)"),
    "bknown": (("brows", "brules"), f"SELECT {_OUT}, rule_id, 'bottom_volume' AS family, state = 1 AND down IS NOT NULL AND above IS NOT NULL AND volume_ratio_20 IS NOT NULL AND volume_history_complete = 1 AND (NOT rising OR r IS NOT NULL) AS known, -down >= drawdown AND above <= low AND volume_ratio_20 >= volume AND (NOT rising OR r > 0) AS holds FROM brows JOIN brules USING (k)"),
    "cknown": (("crows", "crules"), _CHANNELS.format(rules="crules")),
    "cwide": ((), _CW),
    "cwknown": (("crows", "cwide"), _CHANNELS.format(rules="cwide")),
    "evaluated": (("pknown", "bknown", "cknown"), f"SELECT {_OUT}, rule_id, family, coalesce(known, false) AS known, coalesce(known AND holds, false) AS hit FROM (SELECT * FROM pknown UNION ALL SELECT * FROM bknown UNION ALL SELECT * FROM cknown)"),
    # five known days before, without a hit on any
    "clear": (("evaluated",), "SELECT a.rule_id, a.stock_id, a.cal_idx FROM evaluated a JOIN evaluated b ON b.rule_id = a.rule_id AND b.stock_id = a.stock_id AND b.cal_idx BETWEEN a.cal_idx - 5 AND a.cal_idx - 1 WHERE a.hit AND b.known AND NOT b.hit GROUP BY ALL HAVING count(*) = 5"),
    "trig": (("evaluated", "clear"), "SELECT e.*, c.rule_id IS NOT NULL AS first_hit FROM evaluated e LEFT JOIN clear c ON c.rule_id = e.rule_id AND c.stock_id = e.stock_id AND c.cal_idx = e.cal_idx"),
    "viewed": (("trig", "scored"), "SELECT rule_id, family, view, s.* FROM (SELECT *, 'all_qualifying_days' AS view FROM trig WHERE hit UNION ALL SELECT *, 'first_after_5_clear_days' FROM trig WHERE first_hit) t JOIN scored s ON s.entity = t.stock_id AND s.day = t.target_idx"),
    "keys": (("every_rule",), f"SELECT rule_id, family, view, event, {_CANON} AS canonical FROM every_rule, (VALUES ('all_qualifying_days'), ('first_after_5_clear_days')) v(view), (VALUES {', '.join(f'({chr(39)}{e}{chr(39)})' for e in EVENTS)}) e(event)"),
    # a row a signal and event
    "vlong": (("viewed",), " UNION ALL ".join(f"SELECT rule_id, view, phase, fold, day, entity, y, '{e}' AS event, {e} AS hit FROM viewed" for e in EVENTS)),
    "base_day": (("scored",), " UNION ALL ".join(f"SELECT phase, day, '{e}' AS event, avg(CASE WHEN {e} THEN 1e0 ELSE 0e0 END) AS base FROM scored GROUP BY ALL" for e in EVENTS)),
    "base_all": (("scored",), " UNION ALL ".join(f"SELECT phase, '{e}' AS event, avg(CASE WHEN {e} THEN 1e0 ELSE 0e0 END) AS base FROM scored GROUP BY ALL" for e in EVENTS)),
    "vday": (("vlong", "base_day"), "SELECT l.*, base FROM (SELECT rule_id, view, phase, event, day, count(*) AS n, count_if(hit) AS hits FROM vlong GROUP BY ALL) l JOIN base_day USING (phase, event, day)"),
    "vstat": (("vlong", "vday"), "SELECT * FROM (SELECT rule_id, view, phase, event, count(*) AS n, count_if(hit) AS hits, count(DISTINCT day) AS dates, count(DISTINCT entity) AS stocks, avg(y) AS mean_return, median(y) AS median_return FROM vlong GROUP BY ALL) JOIN (SELECT rule_id, view, phase, event, avg(hits / CAST(n AS DOUBLE)) AS daily, sum(n * base) / sum(n) AS matched, max(n) / CAST(sum(n) AS DOUBLE) AS max_day_share FROM vday GROUP BY ALL) USING (rule_id, view, phase, event) JOIN (SELECT rule_id, view, phase, event, max(n) / CAST(sum(n) AS DOUBLE) AS max_stock_share FROM (SELECT rule_id, view, phase, event, entity, count(*) AS n FROM vlong GROUP BY ALL) GROUP BY ALL) USING (rule_id, view, phase, event)"),
    "vfold": (("keys", "vlong"), f"SELECT k.rule_id, k.view, k.event, fold, coalesce(n, 0) AS n, coalesce(dates, 0) AS dates, coalesce(hits, 0) AS hits FROM keys k CROSS JOIN (SELECT printf('F%02d', f) AS fold FROM range(1, {FOLDS + 1}) t(f)) LEFT JOIN (SELECT rule_id, view, event, fold, count(*) AS n, count(DISTINCT day) AS dates, count_if(hit) AS hits FROM vlong WHERE phase = 'confirmation' GROUP BY ALL) c USING (rule_id, view, event, fold)"),
    "states": (("keys", "vstat", "base_all", "vfold"), f"""SELECT *, CASE WHEN discovery_n + confirmation_n = 0 THEN 'no_scored_rows' WHEN d AND c AND sound AND folds_ >= {SUPPORT['folds']} AND 2 * passing > folds_ THEN 'supported_cross_period' WHEN d AND c THEN 'both_over_weak_support' WHEN d AND confirmation_n > 0 THEN 'discovery_only_not_reproduced' WHEN d THEN 'discovery_only_no_later_sample' WHEN c THEN 'later_only' ELSE 'not_over' END AS state
 FROM (SELECT k.*, {', '.join(f"{a}.{x} AS {p}_{y}" if y not in _ZERO else f"coalesce({a}.{x}, 0) AS {p}_{y}" for p, a in (("discovery", "d"), ("confirmation", "c")) for x, y in _STAGE.items())}, bd.base AS discovery_unconditional_rate, bc.base AS confirmation_unconditional_rate,
 20 * coalesce(d.hits, 0) > 13 * coalesce(d.n, 0) AND coalesce(d.n, 0) > 0 AS d, 20 * coalesce(c.hits, 0) > 13 * coalesce(c.n, 0) AND coalesce(c.n, 0) > 0 AS c, {' AND '.join(f"{a}.{x} >= {least}" for p, a in (("discovery", "d"), ("confirmation", "c")) for x, least in zip(("n", "dates", "stocks"), SUPPORT[p], strict=True))} AS sound, coalesce(folds_, 0) AS folds_, coalesce(passing, 0) AS passing
 FROM keys k LEFT JOIN (SELECT * FROM vstat WHERE phase = 'discovery') d USING (rule_id, view, event) LEFT JOIN (SELECT * FROM vstat WHERE phase = 'confirmation') c USING (rule_id, view, event) JOIN (SELECT * FROM base_all WHERE phase = 'discovery') bd USING (event) JOIN (SELECT * FROM base_all WHERE phase = 'confirmation') bc USING (event)
 LEFT JOIN (SELECT rule_id, view, event, count(*) AS folds_, count_if(20 * hits > 13 * n) AS passing FROM vfold WHERE n >= {SUPPORT['fold'][0]} AND dates >= {SUPPORT['fold'][1]} GROUP BY ALL) f USING (rule_id, view, event))"""),
    "chosen": (("states",), f"SELECT * FROM states WHERE d AND discovery_n >= {SUPPORT['discovery'][0]} AND discovery_dates >= {SUPPORT['discovery'][1]} AND discovery_stocks >= {SUPPORT['discovery'][2]} QUALIFY row_number() OVER (PARTITION BY family, view, event ORDER BY discovery_n DESC, rule_id) = 1"),
    "last_": (("scored",), "SELECT max(day) - 1 AS last_as_of FROM scored"),
    "pcov": (("trig", "every_rule"), "SELECT rule_id, r.family, count_if(state = 1) AS eligible, count_if(known) AS known, count_if(hit) AS signals, count_if(first_hit) AS first_signals, count_if(hit AND y IS NULL) AS unscorable_signals FROM every_rule r LEFT JOIN trig t USING (rule_id) GROUP BY ALL"),
}


def sql(body: str, *names: str) -> str:
    """A body with CTEs of its own goes on with the list."""
    text = with_ctes("\0" + body, *names, extra=PATTERN_CTES)
    return text.replace("\n\0WITH ", ",\n").replace("\0", "")


_RATE = {"hit_rate": "{p}_hits / CAST(nullif({p}_n, 0) AS DOUBLE)", "lift": "{p}_hits / CAST(nullif({p}_n, 0) AS DOUBLE) - {p}_unconditional_rate"}
_COUNTS = [f"{p}_{c}" for p in ("discovery", "confirmation") for c in _ZERO]
_MEANS = [f"{p}_{c}" for p in ("discovery", "confirmation") for c in (*(y for y in _STAGE.values() if y not in _ZERO), "unconditional_rate")]
_METRIC = "(VALUES ('volume_shares_relative_20_plus_one'), ('amount_yuan_relative_20_plus_one'), ('turnover')) m(metric)"
ORACLES = {
    "pattern_grid": sql(f"SELECT rule_id, family, {_CANON} AS canonical, CAST(k AS INTEGER) AS \"window\", coalesce(volume, 0e0) AS volume, first_known, last_known, first_signal FROM every_rule LEFT JOIN (SELECT rule_id, min(cal_idx) AS first_known, max(cal_idx) AS last_known, min(CASE WHEN hit THEN cal_idx END) AS first_signal FROM evaluated WHERE known GROUP BY 1) USING (rule_id)", "every_rule", "evaluated"),
    **{k: sql(f"SELECT rule_id, count_if(known) AS known, count_if(hit) AS hit FROM evaluated WHERE family = '{f}' GROUP BY rule_id", "evaluated") for k, f in (("pattern_platform", "platform"), ("pattern_bottom", "bottom_volume"))},
    "pattern_channel": sql("SELECT rule_id, count_if(known) AS known, count_if(hit) AS hit FROM (SELECT rule_id, family, known, hit FROM evaluated UNION ALL SELECT rule_id, family, coalesce(known, false), coalesce(known AND holds, false) FROM cwknown) WHERE family = 'ascending_channel' GROUP BY rule_id", "evaluated", "cwknown"),
    "first_trigger": sql("SELECT rule_id, stock_id, cal_idx FROM trig WHERE first_hit", "trig"),
    "pattern_coverage": sql("SELECT * FROM pcov", "pcov"),
    "family_summary": sql("SELECT family, count(*) AS rules, CAST(sum(known) AS BIGINT) AS known, CAST(sum(signals) AS BIGINT) AS signals, CAST(sum(first_signals) AS BIGINT) AS first_signals, count_if(signals > 0) AS rules_with_signals FROM pcov GROUP BY family", "pcov"),
    "pattern_stats": sql("SELECT rule_id, view, phase, any_value(n) AS n, any_value(dates) AS dates, any_value(stocks) AS stocks, " + ", ".join(f"any_value({round_sql(c)}) AS {n}" for c, n in (("mean_return", "mean_y"), ("median_return", "median_y"), ("max_day_share", "max_day_share"), ("max_stock_share", "max_stock_share"))) + ", " + ", ".join(f"max(CASE event WHEN '{e}' THEN hits END) AS {e}, max(CASE event WHEN '{e}' THEN {round_sql('daily')} END) AS daily_{e}, max(CASE event WHEN '{e}' THEN {round_sql('matched')} END) AS matched_{e}" for e in EVENTS) + " FROM vstat GROUP BY ALL", "vstat"),
    "pattern_fold_stats": sql(f"SELECT rule_id, view, fold, any_value(n) AS n, any_value(dates) AS dates, {', '.join(f'max(CASE event WHEN {chr(39)}{e}{chr(39)} THEN hits END) AS {e}' for e in EVENTS)} FROM vfold GROUP BY ALL", "vfold"),
    "pattern_judged": sql(f"SELECT rule_id, view, event, family, canonical, state, {', '.join(_COUNTS)}, {', '.join(f'{round_sql(c)} AS {c}' for c in _MEANS)}, {', '.join(f'{round_sql(x.format(p=p))} AS {p}_{c}' for p in ('discovery', 'confirmation') for c, x in _RATE.items())}, discovery_n + confirmation_n AS pooled_n, discovery_hits + confirmation_hits AS pooled_hits, {round_sql('(discovery_hits + confirmation_hits) / CAST(nullif(discovery_n + confirmation_n, 0) AS DOUBLE)')} AS pooled_rate FROM states", "states"),
    "pattern_pooled_over65": sql("SELECT rule_id, view, event, n AS pooled_n, hits AS pooled_hits, state FROM (SELECT *, discovery_n + confirmation_n AS n, discovery_hits + confirmation_hits AS hits FROM states) WHERE n > 0 AND 20 * hits > 13 * n", "states"),
    "discovery_choice": sql("SELECT family, view, event, rule_id, discovery_n AS n, discovery_hits AS hits, state FROM chosen", "chosen"),
    "pattern_representatives": sql(f"SELECT b.rule_id, b.view, b.event, b.family, b.canonical, c.rule_id IS NOT NULL AS discovery_selected, b.state, b.discovery_n, b.discovery_hits, b.confirmation_n, b.confirmation_hits, {round_sql('low')} AS confirmation_ci_low, {round_sql('high')} AS confirmation_ci_high FROM states b LEFT JOIN chosen c ON c.rule_id = b.rule_id AND c.view = b.view AND c.event = b.event LEFT JOIN (SELECT rule_id, view, event, quantile_cont(h / CAST(n AS DOUBLE), 0.025) AS low, quantile_cont(h / CAST(n AS DOUBLE), 0.975) AS high FROM (SELECT rule_id, view, event, rep, sum(n) AS n, sum(hits) AS h FROM drawn JOIN vday USING (phase, day) WHERE phase = 'confirmation' GROUP BY ALL) GROUP BY ALL) q ON q.rule_id = b.rule_id AND q.view = b.view AND q.event = b.event WHERE b.canonical OR c.rule_id IS NOT NULL", "states", "chosen", "drawn", "vday"),
    "pattern_family_states": sql("SELECT family, count(DISTINCT rule_id) AS rules, count(*) AS rule_events, count_if(n > 0 AND 20 * hits > 13 * n) AS pooled_over_65, count_if(d AND c) AS both_over_65, count_if(state = 'supported_cross_period') AS supported FROM (SELECT *, discovery_n + confirmation_n AS n, discovery_hits + confirmation_hits AS hits FROM states) GROUP BY family", "states"),
    "pattern_view_coverage": sql("""WITH kn AS (SELECT a.rule_id, a.stock_id, a.cal_idx FROM evaluated a JOIN evaluated b ON b.rule_id = a.rule_id AND b.stock_id = a.stock_id AND b.cal_idx BETWEEN a.cal_idx - 5 AND a.cal_idx - 1 WHERE a.known AND b.known GROUP BY ALL HAVING count(*) = 5),
v AS (SELECT *, 'all_qualifying_days' AS view, known AS kn_, hit AS h FROM trig, last_ WHERE cal_idx <= last_as_of UNION ALL SELECT t.*, last_as_of, 'first_after_5_clear_days', kn.rule_id IS NOT NULL, first_hit FROM last_, trig t LEFT JOIN kn ON kn.rule_id = t.rule_id AND kn.stock_id = t.stock_id AND kn.cal_idx = t.cal_idx WHERE t.cal_idx <= last_as_of),
w AS (SELECT v.*, phase FROM v LEFT JOIN scored s ON s.entity = v.stock_id AND s.day = v.target_idx)
SELECT r.rule_id, e.view, r.family, (SELECT count_if(state = 1) FROM indicated, last_ WHERE cal_idx <= last_as_of) AS eligible, count_if(kn_) AS known, count_if(h) AS signals, count_if(h AND y IS NULL) AS unscorable_signals, count_if(kn_ AND phase = 'discovery') AS discovery_known, count_if(kn_ AND phase = 'confirmation') AS confirmation_known, count_if(h AND phase = 'discovery') AS discovery_signals, count_if(h AND phase = 'confirmation') AS confirmation_signals
FROM every_rule r CROSS JOIN (SELECT unnest(['all_qualifying_days', 'first_after_5_clear_days']) AS view) e LEFT JOIN w ON w.rule_id = r.rule_id AND w.view = e.view GROUP BY ALL""", "evaluated", "trig", "last_", "scored", "every_rule", "indicated"),
    "liquidity_diag": sql(f"SELECT k.rule_id, k.view, k.family, k.phase, k.metric, coalesce(n, 0) AS n, coalesce(finite_n, 0) AS finite_n, {round_sql('mean')} AS mean, {round_sql('mid')} AS median FROM (SELECT DISTINCT rule_id, view, family, phase, metric FROM keys, (VALUES ('discovery'), ('confirmation')) p(phase), {_METRIC}) k LEFT JOIN (SELECT rule_id, view, phase, metric, count(*) AS n, count(x) AS finite_n, avg(x) AS mean, median(x) AS mid FROM (SELECT rule_id, view, phase, metric, CASE metric WHEN 'turnover' THEN CAST(turnover AS DOUBLE) WHEN 'volume_shares_relative_20_plus_one' THEN CAST(volume_shares_relative_20 AS DOUBLE) + 1 ELSE CAST(amount_yuan_relative_20 AS DOUBLE) + 1 END AS x FROM viewed, {_METRIC}) GROUP BY ALL) USING (rule_id, view, phase, metric)", "keys", "viewed"),
}
