"""Hand-made panels, an independent calculation of features, causality, and DuckDB on the registered queries."""

import math
import random
from datetime import date, timedelta

import duckdb
import numpy as np
import pytest

from cadenza.functions import ranks
from cadenza.operators import audit, features, indicators, metrics, panel, patterns, rules, splits, targets
from cadenza.plans import catalog, pattern_queries, reference_sql, rule_queries

BAR = "stock_id string, d date, open double, high double, low double, close double, volume_shares double, amount_yuan double, turnover double"


def make(spark, closes, listed=0, days=None):
    """One stock, closes by calendar day (None: no trade), on a calendar of as many days."""
    days = days or [date(2026, 1, 1) + timedelta(days=i) for i in range(len(closes))]
    bars = spark.createDataFrame([("S", d, c, c + 1, c - 1, c, 100.0, c * 100, 0.01) for d, c in zip(days, closes, strict=True) if c is not None and d >= days[listed]], BAR)
    cal = spark.createDataFrame(list(enumerate(days)), "cal_idx int, d date")
    return panel.grid(spark.createDataFrame([("S", days[listed])], "stock_id string, list_date date"), cal, bars), cal


def test_states_returns_and_targets(spark):
    p, _ = make(spark, [None, 10.0, 11.0, None, 12.1, 12.1], listed=1)
    rows = targets.with_targets(p).orderBy("cal_idx").collect()
    assert [r.state for r in rows] == [-1, 1, 1, 0, 1, 1]
    assert [None if r.r is None else round(r.r, 9) for r in rows] == [None, 0, 0.1, None, 0.1, 0]
    assert [r.target_status for r in rows] == [1, 1, 2, 1, 1, 3]
    assert [r.label_available_idx for r in rows] == [1, 2, None, 4, 5, None]


def test_features_by_hand(spark):
    closes = [None if i in (9, 13, 30) else 20 + i / 10 + (i % 5) for i in range(70)]
    p, cal = make(spark, closes, listed=3)
    markets = cal.selectExpr("'sh000001' AS symbol", "cal_idx", "CAST(100 + cal_idx AS DOUBLE) AS close").unionByName(cal.selectExpr("'sz399001' AS symbol", "cal_idx", "CAST(200 + 3 * cal_idx AS DOUBLE) AS close"))
    got = features.features(features.prepared(p, markets)).orderBy("cal_idx").collect()
    r = [x.r for x in p.orderBy("cal_idx").collect()]
    for t in (3, 8, 10, 19, 20, 31, 50, 60, 69):
        window = [x for x in r[max(0, t - 19) : t + 1] if x is not None]
        if t >= 19:
            mean = sum(window) / len(window)
            assert got[t].return_mean_20 == pytest.approx(mean, rel=2e-6, abs=1e-7)
            assert got[t].return_std_20 == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in window) / len(window)), rel=2e-6, abs=1e-7)
            assert got[t].return_valid_fraction_20 == pytest.approx(len(window) / 20)
        else:
            assert got[t].return_mean_20 is None and got[t].return_valid_fraction_20 is None
        before = [i for i in range(t) if closes[i] is not None and i >= 3]
        assert got[t].days_since_previous_trade == (t - before[-1] if before else None)
        assert got[t].sh000001_return_0 == pytest.approx(1 / (99 + t), rel=1e-5)
    assert len(features.FEATURES) == 49
    assert [t for t in range(70) if got[t].quote_index_ma_deviation_20 is not None][0] == 50


def test_future_changes_nothing(spark):
    closes = [20 + (i * 7 % 11) / 10 for i in range(40)]
    names = ("return_std_10", "quote_index_prior_high_distance_20", "volume_shares_relative_5")
    one, two = (features.features(features.prepared(make(spark, c)[0], spark.createDataFrame([], "symbol string, cal_idx int, close double")), names).where("cal_idx < 30").orderBy("cal_idx").collect() for c in (closes, closes[:30] + [99.0] * 10))
    assert one == two


def test_perfect_channel(spark):
    p, _ = make(spark, [math.exp(0.01 * i) * 50 for i in range(25)])
    last = indicators.indicators(features.quote_index(p)).orderBy("cal_idx").collect()[-1]
    assert last.channel_r2_20 == pytest.approx(1) and last.channel_sigma_20 < 1e-12 and last.channel_gain_20 == pytest.approx(math.expm1(0.19)) and last.channel_higher_20 == 1


def test_plan_rules():
    days = [f"2026-03-{d:02}" for d in range(2, 14)]
    fold = {"id": "F01", "train_through": "2026-03-04", "validation_start": "2026-03-05", "validation_end": "2026-03-08"}
    plan = splits.build_plan([fold], {"start": "2026-03-09", "end": "2026-03-13"}, days)
    assert [(w.name, w.fit, w.first, w.last) for w in plan] == [("F01", 2, 3, 6), ("holdout", 6, 7, 11)]
    for bad in ({"id": "F02"}, {"train_through": "2026-03-03"}, {"validation_end": "2026-03-07"}, {"validation_start": "2026-3-5"}, {"validation_start": "2026-02-30"}, {"extra": 1}, {"train_through": "2026-02-27"}, {"validation_end": "2026-03-04"}):
        with pytest.raises(splits.SplitError):
            splits.build_plan([fold | bad], {"start": "2026-03-09", "end": "2026-03-13"}, days)
    for holdout, calendar in (({"start": "2026-03-10", "end": "2026-03-13"}, days), ({"start": "2026-03-09", "end": "2026-03-12"}, days), ({"start": "2026-03-14", "end": "2026-03-15"}, days), ({"start": "2026-03-09", "end": "2026-03-13"}, days[::-1]), ({"start": "2026-03-09", "end": "2026-03-13"}, [])):
        with pytest.raises(splits.SplitError):
            splits.build_plan([fold], holdout, calendar)
    with pytest.raises(splits.SplitError):
        splits.build_plan([], {"start": "2026-03-09", "end": "2026-03-13"}, days)
    # closed days project to the market days inside
    gaps = [d for d in days if d not in ("2026-03-05", "2026-03-08")]
    closed = splits.build_plan([fold], {"start": "2026-03-09", "end": "2026-03-15"}, gaps)
    assert [(w.fit, w.first, w.last) for w in closed] == [(2, 3, 4), (4, 5, 9)]


def test_regression_and_binary_metrics(spark):
    rows = spark.createDataFrame([(0.02, 0.01), (-0.01, 0.01), (0.0, 0.0)], "y double, p double")
    m = metrics.regression_scores(rows).head()
    assert m.rmse == pytest.approx(math.sqrt(0.0005 / 3)) and m.mae == pytest.approx(0.01) and m.direction_accuracy == pytest.approx(2 / 3)
    b = spark.createDataFrame([("a", 1, 0.8), ("a", 0, 0.7), ("a", 1, 0.5), ("a", 0, 0.1), ("b", 1, 0.2)], "g string, label int, p double")
    auc = {r.g: r.auc for r in metrics.roc_auc(b, "g").collect()}
    assert auc == {"a": 0.75, "b": None}
    with pytest.raises(Exception, match="not a probability"):
        metrics.binary_scores(b.withColumn("p", b.p * 2)).collect()
    s = {r.g: r for r in metrics.binary_scores(b, "g").collect()}
    assert (s["a"].tp, s["a"].tn, s["a"].fp, s["a"].fn) == (1, 1, 1, 1) and s["b"].not_up_recall is None and s["b"].up_precision is None


def test_bins_and_intervals(spark):
    long = spark.createDataFrame([("f", x) for x in (-2.0, -1.0, 0.0, 0.5, 2.0, None)], "feature string, x double")
    cuts = spark.createDataFrame([("f", [-1.0, 0.5])], "feature string, cuts array<double>")
    assert [r.bin for r in rules.assign_bins(long, cuts).collect()] == [0, 1, 1, 2, 2, 3]
    assert sorted((r.lo, r.hi) for r in rules.intervals(cuts).collect()) == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (3, 4)]


def test_strict_parsing(spark):
    rows = spark.createDataFrame([("2026-01-02", "1.5"), ("2026-01-02 00:00:00", "NaN"), ("2026-1-2", ""), ("2026-02-30", "Infinity")], "t string, n string")
    got = rows.select(audit.strict_date(rows.t).alias("d"), audit.finite_number(rows.n).alias("n")).collect()
    assert [r.d for r in got] == [date(2026, 1, 2)] * 2 + [None] * 2 and [r.n is None for r in got] == [False, True, True, True]


@pytest.mark.parametrize("name", ["momentum_next_return", "feat_trend", "targets", "split_role_counts", "audit_issue_summary", "reg_metrics"])
def test_against_duckdb(spark, data, name):
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.execute(catalog.oracle_sql()[name]).fetchdf()
    got = catalog.queries()[name](spark, data).toPandas()
    tidy = lambda df: sorted(repr([None if v is None or v != v else float(v) if not isinstance(v, (str, bool)) else v for v in row]) for row in df[sorted(df.columns)].itertuples(index=False))
    assert tidy(got) == tidy(want)


def test_every_feature_is_mined():
    for q in ("cuts", "bins", "intervals", "interval_stats", "fold_stats", "classify_rules", "pooled_over65", "representatives", "feature_overview", "correlation"):
        assert all(f"'{n}' AS feature" in catalog.oracle_sql()[q] for n in features.FEATURES), q
    assert set(rule_queries.FAMILIES) == set(features.FEATURES) == set(reference_sql.FEATURE_SQL)


def test_reference_sql_reads_no_operator():
    """The text that checks the operators is written on its own: its module imports none of them."""
    with open(reference_sql.__file__, encoding="utf-8") as f:
        assert "import" not in f.read().split('"""', 2)[2].replace("from __future__ import annotations", "")


@pytest.mark.parametrize("name", ["cuts", "interval_stats", "classify_rules", "first_trigger", "pattern_stats", "header_audit", "audit_counters"])
def test_mining_and_patterns_against_duckdb(spark, data, name):
    test_against_duckdb(spark, data, name)


def test_interval_sums_by_brute_force(spark):
    rng = random.Random(4)
    cells = [("f" if i % 3 else "g", rng.randrange(5), rng.choice("xyz"), rng.randrange(1, 9)) for i in range(60)]
    cuts = spark.createDataFrame([("f", [0.0, 1.0, 2.0]), ("g", [5.0, 6.0, 7.0]), ("h", [1.0])], "feature string, cuts array<double>")
    got = {(r.feature, r.lo, r.hi, r.day): r.n for r in rules.over_intervals(spark.createDataFrame(cells, "feature string, bin int, day string, n long"), cuts, ["day"], ["n"]).collect()}
    want = {}
    for f in "fg":
        for lo, hi in [(a, b) for a in range(4) for b in range(a + 1, 5)] + [(4, 5)]:
            for day in "xyz":
                n = sum(c for g, b, d, c in cells if g == f and d == day and lo <= b < hi)
                if n:
                    want[f, lo, hi, day] = n
    assert got == want


def test_exact_quantiles_and_running_sums(spark, monkeypatch):
    monkeypatch.setattr(ranks, "RANGES", 7)
    rng = np.random.default_rng(6)
    rows = [("a", float(x)) for x in rng.normal(size=501).round(2)] + [("b", 1.0)] * 300 + [("b", float(x)) for x in range(10)] + [("c", 3.5), ("d", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    at = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: r.q for r in ranks.quantiles(df, ["g"], "x", at).collect()}
    for g in "abc":
        assert got[g] == pytest.approx(np.quantile([x for k, x in rows if k == g], at).tolist(), abs=1e-12)
    assert "d" not in got
    assert ranks.quantiles(df, [], "x", [0.5]).head().q == pytest.approx([np.quantile([x for _, x in rows if x is not None], 0.5)])
    counts = df.where("x IS NOT NULL").groupBy("g", "x").count().withColumnRenamed("count", "c")
    for r in ranks.running(counts, ["g"], "x", ["c"]).collect():
        assert r.before_c == sum(k == r.g and x is not None and x < r.x for k, x in rows)


def test_rules_as_bits_by_brute_force(spark):
    """Two rules over a small panel, with gaps in the calendar and unknown days."""
    rng = random.Random(11)
    rows = [(s, d, rng.choice([0, 1, 1, 1]), rng.choice([None, 0.1, 0.2, 0.9]), rng.choice([-0.1, 0.0, 0.1]), rng.choice([None, -0.2, 0.01, 0.3]), rng.choice([None, 0.5, 2.0]), rng.choice([0, 1, 1]), None if rng.random() < 0.1 else 0.01) for s in "AB" for d in range(60) if not (s == "B" and d % 17 == 0)]
    panel_ = spark.createDataFrame(rows, "stock_id string, cal_idx int, state int, prior_width_20 double, prior_drift_20 double, breakout_20 double, volume_ratio_20 double, volume_history_complete int, y double")
    grid = [{"rule_id": f"P{i:03}", "family": "platform", "canonical": False, "window": 20, "width": w, "breakout": b, "volume": v} for i, (w, b, v) in enumerate([(w, b, v) for w in (0.1, 0.2, 0.5, 1.0) for b in (-1.0, 0.0, 0.1, 0.2) for v in (None, 0.4, 1.0, 3.0, 0.5)])]
    bits = patterns.packed(panel_, grid, "state", "y")
    want = {}
    for rule in grid:
        per = {}
        for s, d, state, width, drift, out, volume, complete, _ in rows:
            known = state == 1 and width is not None and out is not None and (rule["volume"] is None or (volume is not None and complete == 1))
            per[s, d] = known, known and width <= rule["width"] and abs(drift) <= rule["width"] / 2 and out > rule["breakout"] and (rule["volume"] is None or volume >= rule["volume"])
        for (s, d), (known, hit) in per.items():
            before = [per.get((s, d - k)) for k in range(1, 6)]
            clear = all(b is not None and b[0] for b in before)
            if known:
                want[rule["rule_id"], s, d] = hit, clear, hit and clear and not any(b[1] for b in before)
    got = {(r.rule_id, r.stock_id, r.cal_idx): (r.hit, r.first_known, r.first_hit) for r in patterns.unpacked(bits, grid).collect()}
    assert got == want
    cover = {r.rule_id: r for r in patterns.coverage(bits, grid).collect()}
    assert set(cover) == {r["rule_id"] for r in grid} and all(cover[i].signals == sum(h for (k, _, _), (h, _, _) in want.items() if k == i) for i in cover)


def test_channels_of_both_scales(spark, data):
    """pattern_channel judges the grid that all chart queries share under its numbers, and every channel on the panel's scale; none twice."""
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    assert sorted(r[0] for r in con.execute(catalog.oracle_sql()["pattern_channel"]).fetchall()) == [f"C{i:03}" for i in range(1, 64)]
    judged = pattern_queries.FAMILY_RULES["ascending_channel"]
    assert judged[:36] == [r for r in pattern_queries.RULES if r["family"] == "ascending_channel"] and [r["rule_id"] for r in judged] == [f"C{i:03}" for i in range(1, 64)]
    spans = lambda gains, widths: {(w, g, x, p) for w in (20, 40, 60) for g in gains for x in widths for p in ("all", "lower", "upper")}
    keys = [(r["window"], r["gain"], r["width"], r["position"]) for r in judged]
    assert len(keys) == len(set(keys)) and set(keys) == spans((-0.5, 0.1), (0.2, 20.0)) | spans((-0.5, 0.0), (2.0, 20.0))
    rng = random.Random(5)
    rows = [(d, [(rng.choice([-0.6, -0.2, 0.0, 0.05, 0.3]), rng.choice([None, 0.001, 0.5, 0.5]), rng.choice([0.0, 0.04, 0.2, 0.6, 1.0]), rng.choice([-1.0, -0.05, 0.0, 0.05, 1.0])) for _ in range(3)]) for d in range(1500)]
    names = [f"channel_{n}_{k}" for k in (20, 40, 60) for n in ("gain", "r2", "sigma", "offset")]
    panel_ = spark.createDataFrame([("S", d, 1, *[x for f in fits for x in f]) for d, fits in rows], "stock_id string, cal_idx int, state int, " + ", ".join(f"{n} double" for n in names))
    want = {}
    for r in judged:
        for d, fits in rows:
            gain, r2, sigma, offset = fits[(20, 40, 60).index(r["window"])]
            if r2 is not None and sigma > 1e-12:
                side = {"all": True, "lower": offset < 0, "upper": offset >= 0}[r["position"]]
                want[r["rule_id"], d] = gain >= r["gain"] and r2 >= 0.01 and 4 * sigma <= math.log1p(r["width"]) and abs(offset) <= 2 * sigma and side
    assert {(x.rule_id, x.cal_idx): x.hit for x in patterns.unpacked(patterns.packed(panel_, judged), judged).collect()} == want
    assert {i for (i, _), hit in want.items() if hit} == {r["rule_id"] for r in judged}


@pytest.mark.parametrize("name", ["pattern_channel", "pattern_platform", "pattern_bottom"])
def test_families_against_duckdb(spark, data, name):
    test_against_duckdb(spark, data, name)


def test_texts_of_rules_and_conditions():
    assert [rules.condition_text("f", [0.1, 2.0], lo, hi) for lo, hi in ((0, 1), (1, 2), (2, 3), (0, 3), (3, 4))] == ["f < 0.10000000000000001", "f >= 0.10000000000000001 and f < 2", "f >= 2", "f present", "f missing"]
    grid = patterns.rule_grid({"platform": {"windows": (20,), "maximum_widths": (0.1, 0.2), "breakout_minimums": (0.0,), "volume_minimums": (None, 1.5)}, "bottom_volume": {"windows": (120,), "minimum_drawdowns": (0.2,), "maximum_low_distances": (0.08,), "volume_minimums": (2.0,), "rising_today": (True, False)}, "ascending_channel": {"windows": (60,), "minimum_gains": (0.1,), "maximum_widths": (0.2,), "positions": ("all", "lower"), "minimum_r_squared": 0.5, "sigma_zero_tolerance": 1e-12}})
    assert [r["rule_id"] for r in grid if r["canonical"]] == ["P002", "B001", "C001"] and len(grid) == 8
    assert all(str(r["window"]) in patterns.rule_text(r) for r in grid) and "10 %" in patterns.rule_text(grid[0]) and "5 %" in patterns.rule_text(grid[0]) and len({patterns.rule_text(r) for r in grid}) == 8
