"""Chart rules, three-valued: unknown, known and not hit, hit. All rules are evaluated in one pass over the panel, as bits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranks import quantiles
from ..functions.shipping import ship
from . import rules as ru

ship(__name__)

FAMILIES = {"platform": "P", "bottom_volume": "B", "ascending_channel": "C"}
VIEWS = ("all_qualifying_days", "first_after_5_clear_days")
CLEAR_DAYS = 5


#: Of each family the parameters that span its grid, in the order of their numbering, with the name that a rule has for each.
GRID = {
    "platform": (("windows", "window"), ("maximum_widths", "width"), ("breakout_minimums", "breakout"), ("volume_minimums", "volume")),
    "bottom_volume": (("windows", "window"), ("minimum_drawdowns", "drawdown"), ("maximum_low_distances", "low_distance"), ("volume_minimums", "volume"), ("rising_today", "rising")),
    "ascending_channel": (("windows", "window"), ("minimum_gains", "gain"), ("maximum_widths", "width"), ("positions", "position")),
}
#: What all rules of a family share.
SHARED = {"ascending_channel": (("minimum_r_squared", "r_squared"), ("sigma_zero_tolerance", "sigma_zero"))}
#: The rule of each family that stands for it in reports.
CANONICAL = {"platform": (20, 0.10, 0.0, 1.5), "bottom_volume": (120, 0.20, 0.08, 2.0, True), "ascending_channel": (60, 0.10, 0.20, "all")}


def rule_grid(config: dict, canonical: dict[str, tuple] = CANONICAL) -> list[dict]:
    """Every combination of each family's parameters, numbered within the family; one of them may be canonical."""
    out: list[dict] = []
    for family, spans in GRID.items():
        given = config[family]
        fixed = {name: given[key] for key, name in SHARED.get(family, ())}
        for number, values in enumerate(product(*[given[key] for key, _ in spans]), 1):
            out.append({"rule_id": f"{FAMILIES[family]}{number:03}", "family": family, "canonical": values == canonical.get(family), **{name: v for (_, name), v in zip(spans, values, strict=True)}, **fixed})
    return out


def joined_grid(rules: list[dict], more: list[dict]) -> list[dict]:
    """The rules, and those of another grid of their family that aren't among them, numbered on."""
    bare = lambda r: {k: v for k, v in r.items() if k != "rule_id"}
    there = [bare(r) for r in rules]
    new = [r for r in more if bare(r) not in there]
    return rules + [r | {"rule_id": f"{FAMILIES[r['family']]}{number:03}"} for number, r in enumerate(new, len(rules) + 1)]


def rule_text(rule: dict) -> str:
    """What a rule says, with shares in percent."""
    w, share = rule["window"], lambda x: f"{100 * x:g} %"
    volume = "any volume" if rule.get("volume") is None else f"volume at least {rule['volume']:g} times its mean"
    if rule["family"] == "platform":
        return f"the last {w} days are at most {share(rule['width'])} wide and drift at most {share(rule['width'] / 2)}; today breaks out by more than {share(rule['breakout'])}; {volume}"
    if rule["family"] == "bottom_volume":
        return f"yesterday at least {share(rule['drawdown'])} below the high and at most {share(rule['low_distance'])} above the low of {w} days; {volume}{'; today rises' if rule['rising'] else ''}"
    part = {"all": "inside", "lower": "in the lower half of", "upper": "in the upper half of"}[rule["position"]]
    return f"a fit of {w} days gains at least {share(rule['gain'])} with R2 of at least {rule['r_squared']:g} and is at most {share(rule['width'])} wide; today is {part} the channel"


RULE_SCHEMA = "rule_id string, family string, canonical boolean, window int, width double, breakout double, volume double, drawdown double, low_distance double, rising boolean, gain double, position string, r_squared double, sigma_zero double"


def rule_frame(spark: SparkSession, rules: list[dict]) -> DataFrame:
    names = [c.split()[0] for c in RULE_SCHEMA.split(", ")]
    number = lambda r, n: float(r[n]) if n not in ("rule_id", "family", "canonical", "window", "position", "rising") and r.get(n) is not None else r.get(n)
    return spark.createDataFrame([tuple(number(r, n) for n in names) for r in rules], RULE_SCHEMA)


def conditions(rule: dict) -> tuple[list[str], list[str]]:
    """What must be there for the rule to be known, and what must hold for a hit: expressions over indicators, `volume_ratio_20`, `r` and `state`."""
    w, have = rule["window"], ["state = 1"]
    if rule["family"] == "platform":
        have += [f"prior_width_{w} IS NOT NULL", f"prior_drift_{w} IS NOT NULL", f"breakout_{w} IS NOT NULL"]
        hit = [f"prior_width_{w} <= {rule['width']}e0", f"abs(prior_drift_{w}) <= {rule['width']}e0 / 2", f"breakout_{w} > {rule['breakout']}e0"]
    elif rule["family"] == "bottom_volume":
        have += [f"prior_drawdown_{w} IS NOT NULL", f"bottom_low_distance_{w} IS NOT NULL"]
        hit = [f"prior_drawdown_{w} <= -{rule['drawdown']}e0", f"bottom_low_distance_{w} <= {rule['low_distance']}e0"]
        if rule["rising"]:
            have, hit = [*have, "r IS NOT NULL"], [*hit, "r > 0"]
    else:
        have += [f"channel_{n}_{w} IS NOT NULL" for n in ("gain", "r2", "sigma", "offset")] + [f"channel_sigma_{w} > {rule["sigma_zero"]:.20f}"]
        u = f"(channel_offset_{w} / (2 * CASE WHEN channel_sigma_{w} > 0 THEN channel_sigma_{w} END))"
        hit = [f"channel_gain_{w} >= {rule['gain']}e0", f"channel_r2_{w} >= {rule['r_squared']}e0", f"4 * channel_sigma_{w} <= ln(1 + {rule['width']}e0)", f"{u} >= -1", f"{u} <= 1"]
        hit += {"lower": [f"{u} < 0"], "upper": [f"{u} >= 0"]}.get(rule["position"], [])
    if rule.get("volume") is not None:
        have, hit = [*have, "volume_ratio_20 IS NOT NULL", "volume_history_complete = 1"], [*hit, f"volume_ratio_20 >= {rule['volume']}e0"]
    return have, hit


#: Rules in a 64-bit word.
WORD = 62


def packed(panel: DataFrame, rules: list[dict], *keep: str) -> DataFrame:
    """A row a panel row: for all rules at once, bit by bit, `known` and `hit`, and `first_known` and `first_hit` after clear days.

    Conditions that rules share are evaluated once; one that fails takes away the rules that need it. The only exchange is
    that of the panel by entity, whatever the number of rules.
    """
    words = -(-len(rules) // WORD)
    needs: tuple[dict[str, list[int]], dict[str, list[int]]] = ({}, {})
    for i, rule in enumerate(rules):
        for side, some in zip(needs, conditions(rule), strict=True):
            for c in some:
                side.setdefault(c, [0] * words)[i // WORD] |= 1 << (i % WORD)
    names = {c: f"_c{i}" for i, c in enumerate(dict.fromkeys([*needs[0], *needs[1]]))}
    rows = panel.withColumns({n: F.coalesce(F.expr(c), F.lit(False)) for c, n in names.items()})

    def lost(side: dict[str, list[int]], word: int) -> Column:
        out = F.lit(0).cast("long")
        for c, masks in side.items():
            if masks[word]:
                out = out.bitwiseOR(F.when(F.col(names[c]), F.lit(0).cast("long")).otherwise(F.lit(masks[word]).cast("long")))
        return out

    full = [sum(1 << (i % WORD) for i in range(len(rules)) if i // WORD == w) for w in range(words)]
    rows = rows.withColumns({f"_k{w}": F.lit(full[w]).cast("long").bitwiseAND(F.bitwise_not(lost(needs[0], w))) for w in range(words)})
    rows = rows.withColumns({f"_h{w}": F.col(f"_k{w}").bitwiseAND(F.bitwise_not(lost(needs[1], w))) for w in range(words)})
    order = Window.partitionBy("stock_id").orderBy("cal_idx")
    before = order.rowsBetween(-CLEAR_DAYS, -1)
    # without a gap in the calendar
    clear = (F.count(F.lit(1)).over(before) == CLEAR_DAYS) & (F.col("cal_idx") - F.lag("cal_idx", CLEAR_DAYS).over(order) == CLEAR_DAYS)
    rows = rows.withColumn("_clear", F.coalesce(clear, F.lit(False)))
    rows = rows.withColumns({f"_fk{w}": F.when(F.col("_clear"), F.col(f"_k{w}").bitwiseAND(F.bit_and(f"_k{w}").over(before))).otherwise(F.lit(0).cast("long")) for w in range(words)} | {f"_no{w}": F.bitwise_not(F.coalesce(F.bit_or(f"_h{w}").over(before), F.lit(0).cast("long"))) for w in range(words)})
    some = lambda prefix: F.array(*[F.col(f"{prefix}{w}") for w in range(words)])
    first = F.array(*[F.col(f"_fk{w}").bitwiseAND(F.col(f"_h{w}")).bitwiseAND(F.col(f"_no{w}")) for w in range(words)])
    return rows.select("stock_id", "cal_idx", *keep, some("_k").alias("known"), some("_h").alias("hit"), some("_fk").alias("first_known"), first.alias("first_hit"))


def unpacked(bits: DataFrame, rules: list[dict], only: str = "known") -> DataFrame:
    """A row for each panel row and rule whose bit of `only` is set: rule_id, family, known, hit, first_known, first_hit."""
    each = F.array(*[F.struct(F.lit(r["rule_id"]).alias("rule_id"), F.lit(r["family"]).alias("family"), F.lit(i // WORD).alias("word"), F.lit(1 << (i % WORD)).cast("long").alias("mask")) for i, r in enumerate(rules)])
    names = ("known", "hit", "first_known", "first_hit")
    keep = [c for c in bits.columns if c not in names]
    some = bits.where(F.exists(only, lambda w: w != 0)).withColumn("_r", F.explode(F.filter(each, lambda r: F.get(only, r["word"]).bitwiseAND(r["mask"]) != 0)))
    return some.select(*keep, "_r.rule_id", "_r.family", *[(F.get(F.col(n), F.col("_r.word")).bitwiseAND(F.col("_r.mask")) != 0).alias(n) for n in names])


def coverage(bits: DataFrame, rules: list[dict]) -> DataFrame:
    """Per rule: eligible, known and hit rows of the grid, signals without an outcome. Rules that are never known are there."""
    n = F.count_if
    counted = unpacked(bits, rules).groupBy("rule_id").agg(n("known").alias("known"), n("hit").alias("signals"), n("first_hit").alias("first_signals"), n(F.col("hit") & F.col("y").isNull()).alias("unscorable_signals"))
    eligible = bits.agg(n(F.col("state") == 1).alias("eligible"))
    every = rule_frame(bits.sparkSession, rules).select("rule_id", "family").join(F.broadcast(eligible))  # one row
    return every.join(counted, "rule_id", "left").na.fill(0)


#: Of a rule and a view.
RULE = ("rule_id", "view")


def with_masks(bits: DataFrame, *names: str) -> DataFrame:
    """Adds `masks`: the words of these columns, a view each."""
    return bits.withColumn("masks", F.concat(*names))


def bit_sums(rows: DataFrame, by: list[str], words: int, flags: tuple[str, ...], values: tuple[str, ...] = ()) -> DataFrame:
    """(*by, bit, n, flags, values): for each bit of `masks` the rows that have it, those with each flag, and sums of values, by group.

    Within a task bits are a matrix and a group's sums its product with the flags, so that rows are never multiplied by the
    rules; what leaves a task is a row a group and bit that it met. Flags, values and masks hold no nulls.
    """
    sums = [*flags, *values]
    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by), "bit int", "n long", *(f"{c} double" for c in sums)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.arange(WORD, dtype=np.int64)
        for batch in batches:
            if not len(batch):
                continue
            masks = batch.column("masks").flatten().to_numpy().reshape(len(batch), 2 * words)
            bits = ((masks[:, :, None] >> at) & 1).reshape(len(batch), -1).astype(np.float64)
            each = np.stack([np.ones(len(batch)), *(batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in sums)])
            keys = pa.table([batch.column(c) for c in by], names=by).append_column("_row", pa.array(np.arange(len(batch))))
            groups = keys.group_by(by).aggregate([("_row", "list")])
            first, bit, found = [], [], []
            for members in groups.column("_row_list").to_pylist():
                total = each[:, members] @ bits[members]
                some = np.flatnonzero(total[0])
                first.append(np.full(len(some), members[0]))
                bit.append(some)
                found.append(total[:, some])
            first, found = np.concatenate(first), np.concatenate(found, axis=1)
            out = [*(batch.column(c).take(pa.array(first)) for c in by), pa.array(np.concatenate(bit), pa.int32()), pa.array(found[0].astype(np.int64)), *map(pa.array, found[1:])]
            yield pa.RecordBatch.from_arrays(out, [*by, "bit", "n", *sums])

    part = rows.select(*by, "masks", *(F.col(c).cast("double").alias(c) for c in sums)).mapInArrow(run, schema)
    whole = part.groupBy(*by, "bit").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums])
    return whole.select(*by, "bit", "n", *[F.round(c).cast("long").alias(c) for c in flags], *values)


def bit_names(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """(bit, rule_id, family, view) of the bits of `masks`. A row a rule and view."""
    words = -(-len(rules) // WORD)
    rows = [((v * words + i // WORD) * WORD + i % WORD, r["rule_id"], r["family"], view) for v, view in enumerate(VIEWS) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "bit int, rule_id string, family string, view string")


class Judged:
    """The chart rules over both phases: statistics, folds, states and choices, for every rule, view and event.

    bits are those of `packed` with state, y and target_idx; scored(phase, fold, entity, day, y, events, ...) has all scored
    rows, and a signal counts where its row is scored. Days and entities are summed bit by bit, whatever the number of rules.
    """

    def __init__(self, bits: DataFrame, scored: DataFrame, rules: list[dict], support: dict):
        spark = bits.sparkSession
        self.spark, self.rules, self.scored, self.support, self.words = spark, rules, scored, support, -(-len(rules) // WORD)
        self.names = F.broadcast(bit_names(spark, rules))
        last = scored.agg(F.max("day").alias("last_day"))  # one row
        # the last row of information before any scored outcome
        self.bits = bits.join(F.broadcast(last)).where("cal_idx < last_day").drop("last_day")
        self.views = spark.createDataFrame([(v,) for v in VIEWS], "view string")
        self.every = rule_frame(spark, rules).select("rule_id", "family", "canonical").join(F.broadcast(self.views))

    def rows(self, *names: str) -> DataFrame:
        """Scored rows with the bits of these columns."""
        keyed = with_masks(self.bits, *names).select(F.col("stock_id").alias("entity"), F.col("target_idx").alias("day"), "masks")
        return self.scored.join(keyed, ["entity", "day"])

    def named(self, sums: DataFrame) -> DataFrame:
        return sums.join(self.names, "bit").drop("bit", "family")

    def daily(self) -> DataFrame:
        """(phase, fold, day, rule_id, view, n, events, sum_y)."""
        return self.named(bit_sums(self.rows("hit", "first_hit").withColumn("sum_y", F.col("y")), ["phase", "fold", "day"], self.words, ru.EVENTS, ("sum_y",)))

    def signals(self, *keep: str) -> DataFrame:
        """A row a scored signal, for what sums don't tell: (rule_id, view, phase, *keep)."""
        at = F.filter(F.sequence(F.lit(0), F.lit(2 * self.words * WORD - 1)), lambda i: F.getbit(F.get("masks", F.floor(i / WORD).cast("int")), i % WORD) == 1)
        return self.named(self.rows("hit", "first_hit").select("phase", "masks", *keep).withColumn("bit", F.explode(at))).drop("masks")

    def statistics(self, daily: DataFrame) -> DataFrame:
        """(rule_id, view, phase, n, dates, stocks, events, mean_y, median_y, largest shares, daily_ and matched_ rates), for those with signals."""
        by = [*RULE, "phase"]
        base = self.scored.groupBy("phase", "day").agg(*[F.avg(F.col(e).cast("double")).alias(f"base_{e}") for e in ru.EVENTS])
        days = daily.join(F.broadcast(base), ["phase", "day"])  # a row a phase and day
        total = days.groupBy(*by).agg(
            F.sum("n").alias("n"), F.count(F.lit(1)).alias("dates"), (F.sum("sum_y") / F.sum("n")).alias("mean_y"), (F.max("n") / F.sum("n")).alias("max_day_share"), *[F.sum(e).alias(e) for e in ru.EVENTS],
            *[F.avg(F.col(e) / F.col("n")).alias(f"daily_{e}") for e in ru.EVENTS], *[(F.sum(F.col("n") * F.col(f"base_{e}")) / F.sum("n")).alias(f"matched_{e}") for e in ru.EVENTS],
        )
        entities = self.named(bit_sums(self.rows("hit", "first_hit"), ["phase", "entity"], self.words, ())).groupBy(*by).agg(F.count(F.lit(1)).alias("stocks"), (F.max("n") / F.sum("n")).alias("max_stock_share"))
        middle = quantiles(self.signals("y"), by, "y", [0.5]).select(*by, F.col("q")[0].alias("median_y"))
        return total.join(entities, by).join(middle, by)

    def folds(self, daily: DataFrame, names: tuple[str, ...]) -> DataFrame:
        """(rule_id, view, fold, n, dates, events) of confirmation: a row for every fold, those without signals as zeros."""
        every = self.every.select(*RULE).join(F.broadcast(self.spark.createDataFrame([(f,) for f in names], "fold string")))
        counted = daily.where("phase = 'confirmation'").groupBy(*RULE, "fold").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("dates"), *[F.sum(e).alias(e) for e in ru.EVENTS])
        return every.join(counted, [*RULE, "fold"], "left").na.fill(0)

    def _stage(self, stats: DataFrame, phase: str) -> DataFrame:
        """Of every rule, view and event what a phase has, under the phase's name."""
        p = f"{phase}_"
        rates = self.scored.where(F.col("phase") == phase).agg(*[F.avg(F.col(e).cast("double")).alias(f"rate_{e}") for e in ru.EVENTS])
        some = self.every.select(*RULE).join(stats.where(F.col("phase") == phase), [*RULE], "left").join(F.broadcast(rates))  # one row
        each = F.array(*[F.struct(F.lit(e).alias("event"), F.coalesce(F.col(e), F.lit(0)).alias("hits"), F.col(f"daily_{e}").alias("daily"), F.col(f"matched_{e}").alias("matched"), F.col(f"rate_{e}").alias("rate")) for e in ru.EVENTS])
        long = some.withColumn("e", F.explode(each))
        hit_rate = F.col("e.hits") / F.nullif("n", F.lit(0))
        shown = {
            "n": F.coalesce("n", F.lit(0)), "hits": F.col("e.hits"), "hit_rate": hit_rate, "dates": F.coalesce("dates", F.lit(0)), "stocks": F.coalesce("stocks", F.lit(0)), "mean_return": F.col("mean_y"), "median_return": F.col("median_y"), "daily_equal_rate": F.col("e.daily"),
            "unconditional_rate": F.col("e.rate"), "matched_date_base": F.col("e.matched"), "max_day_share": F.col("max_day_share"), "max_stock_share": F.col("max_stock_share"), "lift": hit_rate - F.col("e.rate"),
        }
        return long.select(*RULE, "e.event", *[x.alias(p + c) for c, x in shown.items()])

    def judged(self, daily: DataFrame, stats: DataFrame, folds: tuple[str, ...]) -> DataFrame:
        """A row a rule, view and event: both phases, their pooled rate, and the state."""
        key = [*RULE, "event"]
        classes = ru.classify(stats.where("phase = 'discovery'"), stats.where("phase = 'confirmation'"), self.folds(daily, folds), support=self.support, by=RULE).select(*key, "state")
        both = self.every.join(self._stage(stats, "discovery"), [*RULE]).join(self._stage(stats, "confirmation"), key).join(classes, key, "left")
        pooled = {c: F.col(f"discovery_{c}") + F.col(f"confirmation_{c}") for c in ("n", "hits")}
        out = both.withColumns({f"pooled_{c}": x for c, x in pooled.items()} | {"state": F.coalesce("state", F.lit("no_scored_rows"))})
        return out.withColumn("pooled_rate", F.col("pooled_hits") / F.nullif("pooled_n", F.lit(0)))

    def choices(self, judged: DataFrame) -> DataFrame:
        """Of each family, view and event the supported rule above 65 % in discovery with the most signals, the first of equal ones."""
        able = judged.where(ru.has_support("discovery", self.support["discovery"]) & ru.over_65(F.col("discovery_hits"), F.col("discovery_n")))
        order = Window.partitionBy("family", "view", "event").orderBy(F.desc("discovery_n"), "rule_id")  # a row a rule
        return able.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")

    def representatives(self, judged: DataFrame, daily: DataFrame, reps: int, width: int) -> DataFrame:
        """The canonical rules and the choices, with the bootstrap of their rate in confirmation."""
        key = [*RULE, "event"]
        chosen = self.choices(judged).select(*key, F.lit(True).alias("discovery_selected"))
        some = judged.join(chosen, key, "left").withColumn("discovery_selected", F.coalesce("discovery_selected", F.lit(False))).where("canonical OR discovery_selected")
        each = F.explode(F.array(*[F.struct(F.lit(e).alias("event"), F.col(e).alias("hits")) for e in ru.EVENTS]))
        counts = daily.where("phase = 'confirmation'").select(*RULE, "phase", "day", "n", each.alias("e")).select(*key[:2], "e.event", "phase", "day", "n", "e.hits").join(some.select(*key), key, "left_semi")
        ends = ru.bootstrap_intervals(counts, self.scored.where("phase = 'confirmation'").select("phase", "day"), key, reps, width).drop("phase", "resamples")
        return some.join(ends.withColumnsRenamed({"low": "confirmation_ci_low", "high": "confirmation_ci_high"}), key, "left")

    def family_states(self, judged: DataFrame) -> DataFrame:
        over = lambda p: ru.over_65(F.col(f"{p}_hits"), F.col(f"{p}_n"))
        return judged.groupBy("family").agg(F.count_distinct("rule_id").alias("rules"), F.count(F.lit(1)).alias("rule_events"), F.count_if(over("pooled")).alias("pooled_over_65"), F.count_if(over("discovery") & over("confirmation")).alias("both_over_65"), F.count_if(F.col("state") == "supported_cross_period").alias("supported"))

    def coverage(self) -> DataFrame:
        """Per rule and view: known rows and signals of the full grid and of the scored rows of each phase, and signals without an outcome."""
        whole = self.bits.withColumn("unscorable", F.col("y").isNull())

        def counted(rows: DataFrame, by: list[str], names: tuple[str, str], **as_: str) -> DataFrame:
            flags = ("unscorable",) if "unscorable" in as_ else ()
            sums = self.named(bit_sums(with_masks(rows, *names) if "masks" not in rows.columns else rows, by, self.words, flags))
            return sums.select(*RULE, *by, *[F.col(c).alias(n) for c, n in as_.items()])

        one = whole.withColumn("all", F.lit(0))
        full = counted(one, ["all"], ("known", "first_known"), n="known").join(counted(one, ["all"], ("hit", "first_hit"), n="signals", unscorable="unscorable_signals"), [*RULE, "all"], "left").drop("all")
        out = self.every.select(*RULE, "family").join(F.broadcast(self.bits.agg(F.count_if(F.col("state") == 1).alias("eligible")))).join(full, [*RULE], "left")
        for names, what in ((("known", "first_known"), "known"), (("hit", "first_hit"), "signals")):
            by_phase = counted(self.rows(*names).select("phase", "masks"), ["phase"], names, n="n")
            for phase in ("discovery", "confirmation"):
                out = out.join(by_phase.where(F.col("phase") == phase).select(*RULE, F.col("n").alias(f"{phase}_{what}")), [*RULE], "left")
        return out.na.fill(0)

    def liquidity(self, metrics: dict[str, str]) -> DataFrame:
        """Per rule, view, phase and metric (an expression over scored rows): signals, those that have it, mean and median; with rows for those without signals."""
        rows = self.signals(*[F.expr(f"CAST({x} AS DOUBLE)").alias(n) for n, x in metrics.items()]).unpivot([*RULE, "phase"], list(metrics), "metric", "x")
        by = [*RULE, "phase", "metric"]
        middle = quantiles(rows, by, "x", [0.5]).select(*by, F.col("q")[0].alias("median"))
        out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("finite_n"), F.avg("x").alias("mean"))
        kinds = self.spark.createDataFrame([(p, m) for p in ("discovery", "confirmation") for m in metrics], "phase string, metric string")
        return self.every.select(*RULE, "family").join(F.broadcast(kinds)).join(out, by, "left").join(middle, by, "left").na.fill(0, ["n", "finite_n"])
