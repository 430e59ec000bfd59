"""Profiles, bootstraps, judged chart rules and the artefacts that analyses start from, against plain Python."""

import random
import statistics
from collections import defaultdict
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import patterns, rules
from cadenza.sources import artefacts, store

SPANS = {"up": lambda y: y > 0, "down": lambda y: y < 0, **{f"{s}_ge_{k}": (lambda y, k=k: y >= k / 100) if s == "up" else (lambda y, k=k: y <= -k / 100) for s in ("up", "down") for k in (1, 2, 3, 5)}}


@pytest.fixture(scope="module")
def scored_rows():
    rng = random.Random(4)
    out = []
    for phase, days in (("discovery", range(0, 40)), ("confirmation", range(40, 75))):
        for d in days:
            for e in rng.sample("ABCDE", rng.randrange(1, 6)):
                out.append((phase, f"F{1 + (d - 40) // 5:02}" if phase == "confirmation" else "F01", e, d, rng.choice([-0.06, -0.02, 0.0, 0.004, 0.015, 0.05]), rng.choice([None, 0.1, 0.2, 0.3, 0.4])))
    return out


def frames(spark, scored_rows):
    rows = rules.with_events(spark.createDataFrame(scored_rows, "phase string, fold string, entity string, day int, y double, a double"))
    long = rules.long_features(rows, ["a"], "phase", "fold", "entity", "day", "y", *rules.EVENTS)
    cuts = spark.createDataFrame([("a", [0.15, 0.25, 0.35])], "feature string, cuts array<double>")
    return rows, rules.assign_bins(long, cuts), cuts


RULES = [("a", "up", 0, 2), ("a", "down_ge_2", 1, 3), ("a", "up_ge_5", 4, 5), ("a", "down", 3, 4)]


def binned(x):
    return 4 if x is None else sum(c <= x for c in (0.15, 0.25, 0.35))


def test_profile(spark, scored_rows):
    rows, bins, cuts = frames(spark, scored_rows)
    chosen = spark.createDataFrame(RULES, "feature string, event string, lo int, hi int")
    start = date(2023, 11, 6)
    dates = spark.createDataFrame([(i, start + timedelta(weeks=i)) for i in range(80)], "day int, date date")
    p = rules.Profile(rules.rule_rows(bins, chosen, cuts), rows, chosen, dates)
    held = defaultdict(list)
    for phase, _, e, d, y, x in scored_rows:
        for r in RULES:
            if r[2] <= binned(x) < r[3]:
                held[r, phase].append((d, e, y, SPANS[r[1]](y), x))
    period = lambda d, kind: (w := start + timedelta(weeks=d)) and (str(w.year) if kind == "year" else f"{w.year}Q{(w.month + 2) // 3}")
    got = {(r.feature, r.event, r.lo, r.hi, r.phase, r.period_kind, r.period): r for r in p.periods().collect()}
    want = {(*r, ph, k, period(d, k)) for r in RULES for ph, _, _, d, _, _ in scored_rows for k in ("year", "quarter")}
    assert set(got) == want
    for key, row in got.items():
        some = [x for x in held[key[:4], key[4]] if period(x[0], key[5]) == key[6]]
        base = [SPANS[key[1]](y) for ph, _, _, d, y, _ in scored_rows if ph == key[4] and period(d, key[5]) == key[6]]
        assert (row.n, row.hits, row.dates, row.stocks) == (len(some), sum(x[3] for x in some), len({x[0] for x in some}), len({x[1] for x in some}))
        assert row.unconditional_rate == pytest.approx(sum(base) / len(base))
        if some:
            assert row.median_return == pytest.approx(statistics.median(x[2] for x in some)) and row.mean_return == pytest.approx(sum(x[2] for x in some) / len(some)) and row.hit_rate == pytest.approx(row.hits / row.n)
        else:
            assert row.median_return is None and row.mean_return is None and row.hit_rate is None
    for r in p.days().collect():
        some = [x for x in held[(r.feature, r.event, r.lo, r.hi), r.phase] if x[0] == r.day]
        assert (r.n, r.hits) == (len(some), sum(x[3] for x in some))
    assert p.days().count() == len(RULES) * len({(ph, d) for ph, _, _, d, _, _ in scored_rows})
    for r in p.without_largest_day().collect():
        some = held[(r.feature, r.event, r.lo, r.hi), r.phase]
        by = defaultdict(list)
        for x in some:
            by[x[0]].append(x)
        top = max(by, key=lambda d: (len(by[d]), -d)) if by else 0
        rest = [x for x in some if x[0] != top]
        seen = {x[4] for x in some if x[4] is not None}
        assert (r.n, r.largest_day, r.largest_day_n, r.rest_n, r.rest_hits, r.observed_values) == (len(some), top, len(by[top]), len(rest), sum(x[3] for x in rest), len(seen))
        assert r.rest_rate == (pytest.approx(sum(x[3] for x in rest) / len(rest)) if rest else None)


def test_bootstrap_of_many_rules(spark, scored_rows):
    rows, bins, cuts = frames(spark, scored_rows)
    chosen = spark.createDataFrame(RULES, "feature string, event string, lo int, hi int")
    daily = rules.rule_rows(bins, chosen, cuts).groupBy(*rules.RULE, "phase", "day").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"))
    got = {(r.event, r.phase): r for r in rules.bootstrap_intervals(daily, rows.select("phase", "day"), list(rules.RULE), 50, 4, seed=3).collect()}
    assert len(got) == 8
    counts = defaultdict(lambda: [0, 0])
    for phase, _, _, d, y, x in scored_rows:
        for r in RULES:
            if r[2] <= binned(x) < r[3]:
                counts[r[1], phase, d][0] += 1
                counts[r[1], phase, d][1] += SPANS[r[1]](y)
    for (event, phase), r in got.items():
        days = sorted({d for ph, _, _, d, _, _ in scored_rows if ph == phase})
        rates = []
        for rep in range(50):
            drawn = [days[((rep * 7919 + b * 104729 + 3) % len(days) + j) % len(days)] for b in range(-(-len(days) // 4)) for j in range(4)][: len(days)]
            n, h = (sum(counts[event, phase, d][i] for d in drawn) for i in (0, 1))
            rates += [h / n] if n else []
        assert r.resamples == len(rates) and (r.low, r.high) == pytest.approx(tuple(np.quantile(rates, [0.025, 0.975])))


def test_bit_sums_and_judgement(spark, scored_rows):
    grid = patterns.rule_grid({"platform": {"windows": (20,), "maximum_widths": tuple(range(1, 36)), "breakout_minimums": (0.0, 1.0), "volume_minimums": (None,)}, "bottom_volume": {"windows": (120,), "minimum_drawdowns": (0.2,), "maximum_low_distances": (0.08,), "volume_minimums": (2.0,), "rising_today": (True,)},
                               "ascending_channel": {"windows": (60,), "minimum_gains": (0.1,), "maximum_widths": (0.2,), "positions": ("all",), "minimum_r_squared": 0.5, "sigma_zero_tolerance": 1e-12}})
    rng, words = random.Random(9), 2
    assert len(grid) == 72
    panel, signal = [], {}
    for d in range(-1, 80):
        for e in "ABCDE":
            hit, first = ([i for i in range(72) if rng.random() < 0.1 + 0.5 * (i % 7 == 0)] for _ in (0, 1))
            signal[e, d] = (hit, first)
            pack = lambda bits: [sum(1 << (i % 62) for i in bits if i // 62 == w) for w in range(words)]
            panel.append((e, d - 1, 1, None, d, pack(range(72)), pack(hit), pack(range(72)), pack(first)))
    bits = spark.createDataFrame(panel, "stock_id string, cal_idx int, state int, y double, target_idx int, known array<long>, hit array<long>, first_known array<long>, first_hit array<long>")
    rows, _, _ = frames(spark, scored_rows)
    support = {"discovery": (10, 5, 2), "confirmation": (5, 3, 2), "fold": (2, 1), "folds": 2}
    j = patterns.Judged(bits, rows, grid, support)
    daily = j.daily()
    want = defaultdict(list)
    for phase, fold, e, d, y, _ in scored_rows:
        for v in (0, 1):
            for i in signal[e, d][v]:
                want[grid[i]["rule_id"], patterns.VIEWS[v], phase].append((fold, e, d, y))
    stats = j.statistics(daily)
    got = {(r.rule_id, r.view, r.phase): r for r in stats.collect()}
    assert set(got) == set(want)
    for key, some in want.items():
        r = got[key]
        assert (r.n, r.dates, r.stocks, r.up, r.down_ge_2) == (len(some), len({x[2] for x in some}), len({x[1] for x in some}), sum(x[3] > 0 for x in some), sum(x[3] <= -0.02 for x in some))
        assert r.median_y == pytest.approx(statistics.median(x[3] for x in some)) and r.mean_y == pytest.approx(statistics.mean(x[3] for x in some))
    judged = j.judged(daily, stats, tuple(f"F{i:02}" for i in range(1, 8))).persist()
    assert judged.count() == 72 * 2 * 10
    every = judged.collect()
    # the choice: supported, above 65 %, most signals, the first of equal ones
    best = {}
    for r in sorted(every, key=lambda r: r.rule_id):
        able = r.discovery_n >= 10 and r.discovery_dates >= 5 and r.discovery_stocks >= 2 and 20 * r.discovery_hits > 13 * r.discovery_n
        if able and (r.family, r.view, r.event) not in best or able and r.discovery_n > best[r.family, r.view, r.event].discovery_n:
            best[r.family, r.view, r.event] = r
    assert {(r.family, r.view, r.event): r.rule_id for r in j.choices(judged).collect()} == {k: r.rule_id for k, r in best.items()}
    cover = {(r.rule_id, r.view): r for r in j.coverage().collect()}
    inside = [(e, d) for (e, d) in signal if d - 1 < 74]
    for i in (0, 7, 50):
        for v in (0, 1):
            r = cover[grid[i]["rule_id"], patterns.VIEWS[v]]
            assert r.eligible == r.known == len(inside) and r.signals == r.unscorable_signals == sum(i in signal[k][v] for k in inside) and r.discovery_signals == len(want[r.rule_id, r.view, "discovery"])
    families = {r.family: r for r in j.family_states(judged).collect()}
    assert families["platform"].rules == 70 and families["platform"].rule_events == 1400


@pytest.fixture
def chain(spark, tmp_path):
    """Inputs, samples of 12 days and one fold, with their records."""
    s = store.Store(spark, f"file://{tmp_path}/store")
    spark.range(5).write.parquet(f"file://{tmp_path}/lines.parquet")
    rows = [(i, i // 2, i // 2 + 1, i // 2 + 1, True, 1) for i in range(20)]
    s.publish("samples", spark.createDataFrame(rows, "row_id long, cal_idx int, target_idx int, label_available_idx int, prediction_eligible boolean, target_status int"))
    roles = [("F01", "train", i) for i in range(8)] + [("F01", "score", i) for i in range(8, 14)] + [("F02", "score", i) for i in range(14, 18)] + [("holdout", "train", i) for i in range(18)] + [("holdout", "score", i) for i in (18, 19)]
    s.publish("roles", spark.createDataFrame(roles, "fold string, role string, row_id long"))
    at = lambda n: f"file://{tmp_path}/{n}.json"
    artefacts.record_inputs(spark, at("inputs"), {"lines": f"file://{tmp_path}/lines.parquet"})
    artefacts.record_frame(spark, at("samples"), "prepared", "samples", at("inputs"))
    artefacts.record_frame(spark, at("split"), "split-ready", "roles", at("samples"), holdout_first_day=10)
    return s, at, lambda **k: artefacts.load_inputs(spark, s, at("split"), ("F01", "train"), k.get("confirmation", [("F01", "score"), ("F02", "score")]))


def test_inputs_of_an_analysis(spark, tmp_path, chain):
    s, at, load = chain
    got = load()
    assert got.samples.count() == 20 and {(r.phase, r.n) for r in got.phases.groupBy("phase").agg(F.count(F.lit(1)).alias("n")).collect()} == {("discovery", 8), ("confirmation", 10)}
    with pytest.raises(artefacts.ArtefactError, match="^split-ready: the phases don't cover"):
        load(confirmation=[("F01", "score")])
    with pytest.raises(artefacts.ArtefactError, match="^split-ready: discovery ends on day 9"):
        artefacts.load_inputs(spark, s, at("split"), ("F02", "score"), [("F01", "score"), ("F01", "train")])
    # each link by its name
    artefacts.record_frame(spark, at("split"), "split-ready", "roles", at("samples"), holdout_first_day=8)
    with pytest.raises(artefacts.ArtefactError, match="^prepared: 4 rows can't be scored"):
        load()
    artefacts.record_frame(spark, at("split"), "draft", "roles", at("samples"), holdout_first_day=10)
    with pytest.raises(artefacts.ArtefactError, match="^split-ready: the record says draft"):
        load()
    artefacts.record_frame(spark, at("split"), "split-ready", "none", at("samples"), holdout_first_day=10)
    with pytest.raises(artefacts.ArtefactError, match="^split-ready: "):
        load()
    artefacts.record_frame(spark, at("split"), "split-ready", "roles", at("samples"), holdout_first_day=10)
    assert load().split["identity"] == "roles"
    # the samples' record is written again after the split was made
    artefacts.record_frame(spark, at("samples"), "prepared", "samples", at("inputs"), note="later")
    with pytest.raises(artefacts.ArtefactError, match="^prepared: the record is not the one"):
        load()
    artefacts.record_frame(spark, at("split"), "split-ready", "roles", at("samples"), holdout_first_day=10)
    spark.range(1, 6).write.mode("overwrite").parquet(f"file://{tmp_path}/lines.parquet")
    with pytest.raises(artefacts.ArtefactError, match="^inputs: lines has other rows"):
        load()
    with pytest.raises(artefacts.ArtefactError, match="no such record"):
        artefacts.load_inputs(spark, s, at("nothing"), ("F01", "train"), [])


def test_rules_read_back(spark, tmp_path, scored_rows):
    cuts = {"a": [0.15, 0.25, 0.35]}
    saved = spark.createDataFrame([(*r, 9) for r in RULES], "feature string, event string, lo int, hi int, n int")
    store.save_csv(saved, f"file://{tmp_path}/rules")
    got = artefacts.read_rules(spark, f"file://{tmp_path}/rules", cuts)
    assert {(r.feature, r.event, r.lo, r.hi) for r in got} == set(RULES)
    # what was read back profiles as what was mined
    rows, bins, table = frames(spark, scored_rows)
    chosen = artefacts.rule_frame(spark, got)
    dates = spark.createDataFrame([(i, date(2023, 11, 6) + timedelta(weeks=i)) for i in range(80)], "day int, date date")
    assert rules.Profile(rules.rule_rows(bins, chosen, table), rows, chosen, dates).days().count() == len(RULES) * 75
    for bad in ("a,up,0\n", "b,up,0,1\n", "a,sideways,0,1\n", "a,up,2,2\n", "a,up,0,9\n", "a,up,x,1\n", "a,up,0,1\na,up,0,1\n"):
        (tmp_path / "bad.csv").write_text("feature,event,lo,hi\n" + bad)
        with pytest.raises(artefacts.ArtefactError):
            artefacts.read_rules(spark, f"file://{tmp_path}/bad.csv", cuts)
    (tmp_path / "bad.csv").write_text("feature,event\na,up\n")
    with pytest.raises(artefacts.ArtefactError, match="missing"):
        artefacts.read_rules(spark, f"file://{tmp_path}/bad.csv", cuts)
