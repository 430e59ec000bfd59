"""Tables, store, holdout registry, boosted trees and bars from ticks."""

import math
import os
import random
import struct
import time
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from cadenza.operators import experiments, holdout, models, splits
from cadenza.sources import prepared, store, tables
from cadenza.streaming import bars


def test_csv_contract(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_bytes("﻿date,close,extra\n2026-01-02,1.50,\n".encode())
    assert tables.read_csv(spark, str(good), ("date", "close")).head().asDict() == {"date": "2026-01-02", "close": "1.50", "extra": None}
    for text, required in (("a,a\n1,2\n", ("a",)), ("a,b\n1,2\n", ("c",)), ("", ("a",))):
        bad = tmp_path / "bad.csv"
        bad.write_text(text)
        with pytest.raises(tables.TableError):
            tables.read_csv(spark, str(bad), required)


def test_receipts_show_changes(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a").write_text("one")
    (folder / "b").write_text("two")
    before = spark.createDataFrame(tables.receipts(spark, str(folder)).collect())
    tables.require_approved(before, before)
    (folder / "b").write_text("three")
    after = tables.receipts(spark, str(folder))
    assert tables.changed(before, after).count() == 1
    assert tables.fingerprint(before).head() != tables.fingerprint(after).head()
    with pytest.raises(tables.TableError):
        tables.require_approved(after, before)


def test_store_publishes_once(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    identity = store.identity_of({"b": 1, "a": [1, 2]})
    assert identity == store.identity_of({"a": [1, 2], "b": 1}) and s.find(identity) is None
    s.publish(identity, spark.range(5))
    assert s.publish(identity, spark.range(9)).count() == 5
    (tmp_path / "store" / "broken").mkdir()
    with pytest.raises(store.StoreError):
        s.find("broken")


def test_holdout_is_exposed_once(spark, tmp_path):
    rows = lambda *days: spark.createDataFrame([(e, d) for e in "AB" for d in days], "entity string, day string")
    r = holdout.Registry(spark, f"file://{tmp_path}/r")
    with pytest.raises(holdout.HoldoutError):
        r.expose("000000-none", {})
    one = r.reserve(rows("2026-08-25", "2026-08-26"), {"plan": "p"})
    # reserved rows are in the way, also of a run that crashed; other rows are not
    with pytest.raises(holdout.HoldoutError, match="reserves"):
        r.reserve(rows("2026-08-26", "2026-08-27"), {"plan": "q"})
    with pytest.raises(holdout.HoldoutError):
        r.finish(one, {})
    other = r.reserve(rows("2026-09-01"), {"plan": "p"})
    r.abandon(other, "the machine was lost")
    again = r.reserve(rows("2026-09-01"), {"plan": "p"})
    assert r.state(other) == "finished" and r.state(again) == "reserved"
    r.expose(one, {"predictions": "d"})
    for step in (lambda: r.expose(one, {}), lambda: r.abandon(one, "no"), lambda: r.finish(again, {})):
        with pytest.raises(holdout.HoldoutError):
            step()
    # a crash between exposure and end: a new process sees the rows as exposed, under any plan, window or part of the entities
    later = holdout.Registry(spark, f"file://{tmp_path}/r")
    for wanted in (rows("2026-08-25", "2026-08-26"), rows("2026-08-26", "2026-08-27"), rows("2026-08-25").where("entity = 'B'")):
        with pytest.raises(holdout.HoldoutError, match="has exposed"):
            later.reserve(wanted, {"plan": "another", "label": "another"})
    later.finish(one, {"n": 4})
    with pytest.raises(holdout.HoldoutError, match="has exposed"):
        later.reserve(rows("2026-08-25"), {"plan": "third"})
    assert [(a["attempt"], a["state"]) for a in later.attempts()] == [(one, "finished"), (other, "finished"), (again, "reserved")]
    assert later.attempts()[0]["exposed"] == {"predictions": "d"} and later._names("claims") == []


def test_of_two_writers_one_reserves_at_most(spark, tmp_path):
    rows = spark.createDataFrame([("A", "2026-08-25")], "entity string, day string")
    registries = [holdout.Registry(spark, f"file://{tmp_path}/r") for _ in range(4)]

    def attempt(r):
        try:
            return r.reserve(rows, {"plan": "p"})
        except holdout.HoldoutError:
            return None

    with ThreadPoolExecutor(4) as pool:
        got = [x for x in pool.map(attempt, registries) if x]
    assert len(got) <= 1 and registries[0]._names("claims") == []
    # a writer that died with its claim is in the way until the claim is released by name
    held = registries[0].claim()
    assert attempt(registries[1]) is None
    registries[2].release(held)
    assert len(got) + bool(attempt(registries[1])) == 1


def test_gate_and_frozen_rounds(spark):
    gate = holdout.Gate(spark.range(1))
    with pytest.raises(holdout.HoldoutError):
        _ = gate.targets
    gate.open()
    assert gate.targets.count() == 1 and holdout.frozen_rounds([6, 26, 1, 1, 67, 4, 120]) == 6


def test_boosted_trees(spark):
    rows = spark.range(400).select(((F.col("id") % 20) / 20).cast("float").alias("a"), F.when(F.col("id") % 7 > 0, (F.col("id") % 3).cast("float")).alias("b"), F.col("id")).withColumn("label", F.col("a") * 2 + F.coalesce("b", F.lit(5.0)))
    s = models.Settings(rounds=4, patience=2, least_rows=5)
    model, rounds = models.fit(rows, rows, ["a", "b"], "regression", s)
    got = models.predict(model, rows, ["a", "b"])
    assert 1 <= rounds <= 4 and got.where("p IS NULL OR isnan(p)").count() == 0
    assert got.agg(F.avg((F.col("p") - F.col("label")) ** 2)).head()[0] < rows.agg(F.var_pop("label")).head()[0] / 4
    usage = models.feature_usage(model, ["a", "b"])
    assert sum(g for _, g, _ in usage) == pytest.approx(1) and sum(n for *_, n in usage) == sum(t.splits for t in model.trees)
    assert models.replay_patience([3, 2, 2.5, 2.6, 1], 2) == 2 and models.replay_patience([3, 2, 1], 2) == 3
    with pytest.raises(ValueError):
        models.Settings(rounds=0)
    whole = {f: getattr(s, f) for f in s.__dataclass_fields__}
    assert models.Settings.from_mapping(whole) == s
    for bad in ({**whole, "extra": 1}, {k: v for k, v in whole.items() if k != "bins"}, {**whole, "depth": 2.5}, {**whole, "depth": True}, {**whole, "subsample": 0.0}):
        with pytest.raises(ValueError):
            models.Settings.from_mapping(bad)


def test_matrix_is_checked(spark):
    rows = spark.createDataFrame([(1.0, None, 0.5), (2.0, 3.0, 0.1)], "a double, b double, label double")
    models.check_matrix(rows, ["a", "b"])
    for bad, names in ((rows, ["a", "c"]), (rows.withColumn("a", F.lit(float("inf"))), ["a"]), (rows.withColumn("a", F.lit(float("nan"))), ["a"]), (rows.withColumn("label", F.lit(None).cast("double")), ["a"]), (rows.where("a > 9"), ["a"])):
        with pytest.raises(models.ModelError):
            models.check_matrix(bad, names)


def library_curve(train, valid, names, kind, s, rounds):
    """Losses by round of Spark ML's boosted trees, on rows without missing values."""
    make = GBTClassifier if kind == "binary" else GBTRegressor
    ready = VectorAssembler(inputCols=names, outputCol="features")
    model = make(featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=s.depth, maxBins=s.bins, stepSize=s.learning_rate, minInstancesPerNode=s.least_rows, seed=s.seed).fit(ready.transform(train))
    return model.evaluateEachIteration(ready.transform(valid), *(() if kind == "binary" else ("squared",)))


@pytest.mark.parametrize("kind", ["regression", "binary"])
def test_rounds_are_those_of_the_library(spark, monkeypatch, kind):
    """The same curve as a fit of fixed rounds, and the round that patience picks from it; margins are written on the way."""
    monkeypatch.setattr(models, "EVERY", 4)
    rng = random.Random(3)
    made = [(rng.randrange(20) / 20, rng.randrange(9) / 7, rng.random()) for _ in range(500)]
    rows = [(a, b, (float(a + c > 0.9) if kind == "binary" else a * b + 0.3 * c)) for a, b, c in made]
    train, valid = (spark.createDataFrame(x, "a double, b double, label double") for x in (rows[:300], rows[300:]))
    s = models.Settings(rounds=16, patience=3, least_rows=5)
    curve = library_curve(train, valid, ["a", "b"], kind, s, 16)
    model, best = models.fit(train, valid, ["a", "b"], kind, s)
    assert best == models.replay_patience(curve, 3) == len(model.trees) and model.held_losses == pytest.approx(curve[:best], rel=1e-9)


def test_edges_of_many_features_keep_few_columns(spark):
    """Distinct values of 49 features: an aggregate of some columns a feature, where the registers of approx_count_distinct made hundreds a feature."""
    names = [f"x{i}" for i in range(49)]
    rows = spark.range(300).select(*[(F.col("id") * (i + 3) % (4 + 6 * i)).cast("float").alias(n) for i, n in enumerate(names)], F.lit(None).cast("float").alias("none"))
    plan = models.distinct_values(rows, names)._jdf.queryExecution().sparkPlan()
    while plan.children().size():
        assert plan.output().size() <= 2 * len(names)
        plan = plan.children().head()
    counted = models.distinct_values(rows, [*names, "none"]).head()
    exact = rows.agg(*[F.count_distinct(n).alias(n) for n in [*names, "none"]]).head()
    assert all(counted[n] == exact[n] for n in [*names, "none"])
    edges = models.feature_edges(rows, [*names, "none"], 8)
    assert edges[0] == [0.5, 1.5, 2.5] and edges[-1] == [] and all(0 < len(e) < 8 for e in edges[:-1])


def test_models_that_grow_together_are_those_fitted_alone(spark, monkeypatch):
    """Parts that stop at rounds of their own, margins written on the way; a pass serves all that still grow."""
    monkeypatch.setattr(models, "EVERY", 3)
    rng = random.Random(5)
    parts = []
    for n, noise in ((300, 0.1), (200, 3.0), (260, 0.5)):
        made = [(rng.randrange(30) / 20, None if rng.random() < 0.2 else rng.randrange(9) / 7) for _ in range(n)]
        rows = [(a, b, a * (b or 0.3) + noise * (rng.random() - 0.5)) for a, b in made]
        parts.append(tuple(spark.createDataFrame(x, "a double, b double, label double") for x in (rows[:n // 2], rows[n // 2:])))
    s, passes, real = models.Settings(rounds=12, patience=2, least_rows=5), [], models.histograms
    monkeypatch.setattr(models, "histograms", lambda *a: passes.append(1) or real(*a))
    alone = [models.fit(t, v, ["a", "b"], "regression", s) for t, v in parts]
    each, passes[:] = len(passes), []
    together = models.fit_parts(parts, ["a", "b"], "regression", s)
    assert len({best for _, best in alone}) > 1 and [b for _, b in together] == [b for _, b in alone] and len(passes) < each
    for (x, _), (y, _) in zip(alone, together, strict=True):
        assert x.edges == y.edges and [(t.feature, t.cut, t.missing_left) for t in x.trees] == [(t.feature, t.cut, t.missing_left) for t in y.trees]
        assert x.losses == pytest.approx(y.losses) and x.held_losses == pytest.approx(y.held_losses)
    fixed = models.fit_parts([(t, None) for t, _ in parts], ["a", "b"], "regression", models.Settings(rounds=4, patience=2, least_rows=5))
    assert [(b, len(m.trees)) for m, b in fixed] == [(4, 4)] * 3
    with pytest.raises(models.ModelError):
        models.fit_parts([parts[0], (parts[1][0].where("a > 9"), None)], ["a", "b"])


def test_missing_values_go_where_they_do_better(spark):
    rows = [(None if i % 4 == 0 else float(i % 10), 9.0 if i % 4 == 0 else float(i % 10 > 5)) for i in range(400)]
    train = spark.createDataFrame(rows, "a double, label double")
    model, _ = models.fit(train, None, ["a"], "regression", models.Settings(rounds=1, patience=1, least_rows=5, depth=2))
    got = {(r.a, round(r.p, 9)) for r in models.predict(model, train, ["a"]).collect()}
    # odd values up to 5, above it, and none are told apart by two splits
    assert got == {(x, 9.0 if x is None else float(x > 5)) for x, _ in rows}
    assert any(model.trees[0].missing_left) or model.trees[0].feature[0] == 0
    with pytest.raises(models.ModelError):
        models.predict(model, train, ["a"], "binary")


def test_saved_models_and_native_losses(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").alias("row_id"), ((F.col("id") * 7 % 20) / 20).cast("float").alias("a"), (F.col("id") % 2).cast("double").alias("label"))
    for kind in ("regression", "binary"):
        model, _ = models.fit(rows, None, ["a"], kind, models.Settings(rounds=3, patience=1, least_rows=5))
        models.check_reload(model, f"file://{tmp_path}/{kind}", rows, ["a"], kind)
        assert models.check_native_metric(model, rows, ["a"], kind) > 0


def folds_source(spark, fold="F01"):
    rows = spark.range(300).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("stock_idx"), F.floor(F.col("id") / 3).alias("cal_idx"), F.floor(F.col("id") / 3 + 1).alias("target_idx"), (F.rand(4) - 0.4).alias("y"), F.rand(5).cast("float").alias("a"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    roles = rows.select(F.lit(fold).alias("fold"), F.when(F.col("row_id") < 200, "train").otherwise("predict").alias("role"), "row_id", "stock_idx", "cal_idx")
    score = roles.where("role = 'predict' AND row_id % 5 <> 0").withColumn("role", F.lit("score"))
    return experiments.FoldSource(roles.unionByName(score), rows, fold, ["a"]), rows


def test_fold_source_keeps_features_from_targets(spark, tmp_path):
    source, rows = folds_source(spark)
    with pytest.raises(holdout.HoldoutError):
        source.targets()
    declared = source.describe()
    assert {k: v["rows"] for k, v in declared.items()} == {"train": 200, "predict": 100, "score": 80}
    source.verify(declared)
    with pytest.raises(splits.SplitError):
        source.verify({**declared, "train": {**declared["train"], "rows": 199}})
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("feed"))
    spark.sparkContext.setJobGroup("feed", "")
    before = jobs()
    batches = list(source.prediction_batches(32, f"file://{tmp_path}/32"))
    few = jobs() - before
    assert len(list(source.prediction_batches(7, f"file://{tmp_path}/7"))) == 15 and jobs() - before == 2 * few
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert all(len(b.inputFiles()) == 1 for b in batches)
    assert sorted(r.row_id for b in batches for r in b.collect()) == list(range(200, 300)) and all(b.columns == ["row_id", "a"] for b in batches)
    assert "y" not in source.features().columns and source.training().count() == 200
    source.enable_scoring()
    assert source.targets().count() == 80


def test_holdout_is_scored_after_its_predictions_are_sealed(spark, tmp_path):
    source, rows = folds_source(spark, "holdout")
    settings = models.Settings(rounds=4, patience=2, least_rows=5)
    results = [experiments.FoldResult(f"F{i:02}", n, {}) for i, n in enumerate((3, 9, 2, 2, 5, 1, 4), 1)]
    plan = experiments.freeze(results, "binary", ["a"], settings)
    assert plan.rounds == 3 and experiments.load_plan(experiments.plan_text(plan), plan.identity) == plan
    for bad in (results[:6], [*results[:6], results[0]]):
        with pytest.raises(holdout.HoldoutError):
            experiments.freeze(bad, "binary", ["a"], settings)
    with pytest.raises(holdout.HoldoutError):
        experiments.load_plan(experiments.plan_text(plan).replace('"rounds": 3', '"rounds": 4', 1), plan.identity)
    seen = []
    real = source.enable_scoring
    source.key = ("stock_idx", "cal_idx")
    source.enable_scoring = lambda: (seen.append([a['state'] for a in registry.attempts()]), real())
    registry = holdout.Registry(spark, f"file://{tmp_path}/reg")
    result = experiments.run_holdout(source, plan, registry, f"file://{tmp_path}")
    # when targets open, the exposure with the predictions' digest is on record
    assert seen == [["exposed"]] and result["n"] == 80 and result["rounds"] == 3
    again, _ = folds_source(spark, "holdout")
    again.key = ("stock_idx", "cal_idx")
    other = experiments.freeze([experiments.FoldResult(f"F{i:02}", 2, {}) for i in range(1, 8)], "regression", ["a"], settings)
    for p in (plan, other):
        with pytest.raises(holdout.HoldoutError):
            experiments.run_holdout(again, p, registry, f"file://{tmp_path}")
    recorded = experiments.holdout_once(again, plan, registry, f"file://{tmp_path}")
    assert {k: recorded[k] for k in result} == result
    with pytest.raises(holdout.HoldoutError):
        experiments.holdout_once(again, other, registry, f"file://{tmp_path}")
    with pytest.raises(holdout.HoldoutError):
        again.targets()
    # a run of this plan that crashed before its exposure goes on; one that crashed after it is finished from its sealed predictions
    crashed = holdout.Registry(spark, f"file://{tmp_path}/crashed")
    attempt = crashed.reserve(again.predicted_rows(), {"plan": plan.identity})
    real_finish, crashed.finish = crashed.finish, lambda *_: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        experiments.holdout_once(again, plan, crashed, f"file://{tmp_path}/c")
    crashed.finish = real_finish
    assert crashed.state(attempt) == "exposed"
    last, _ = folds_source(spark, "holdout")
    last.key = ("stock_idx", "cal_idx")
    assert {k: v for k, v in experiments.holdout_once(last, plan, crashed, f"file://{tmp_path}/c").items() if k != "state"} == result
    assert [(a["attempt"], a["state"]) for a in crashed.attempts()] == [(attempt, "finished")]
    assert experiments.description_for("binary", {"target": "next_return", "rows": 5}) == {"target": "next_return>0", "rows": 5}


def test_fold_runs(spark):
    source, rows = folds_source(spark)
    settings = models.Settings(rounds=6, patience=2, least_rows=5)
    result, model = experiments.run_fold(source, "regression", settings)
    got = models.predict(model, rows, ["a"]).join(rows.where("row_id >= 200 AND row_id % 5 <> 0").select("row_id"), "row_id").collect()
    assert result.scores["n"] == 80 and result.scores["rmse"] == pytest.approx(math.sqrt(sum((r.p - r.y) ** 2 for r in got) / 80))
    fixed, _ = experiments.run_fold(folds_source(spark)[0], "binary", settings, 3)
    assert fixed.rounds == 3 and 0 < fixed.scores["logloss"] < 1


def test_prepared_samples_by_row_number(spark, data, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    samples = prepared.samples(spark, data)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    s.publish("one", samples, order="row_id")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    reader = prepared.PreparedReader(s, "one")
    some = spark.createDataFrame([(3,), (5,), (10**9,)], "row_id long")
    assert reader.index().count() == samples.count() and reader.features_at(some).count() == 2 and reader.targets_at(some).columns == ["row_id", "y"]
    # only the file that holds the rows is read, and in it only row groups that can
    assert len(s.find("one").inputFiles()) == 6 and len(reader.features_at(some).inputFiles()) == 1
    assert "GreaterThanOrEqual(row_id,3)" in reader.features_at(some)._jdf.queryExecution().executedPlan().toString()
    last = samples.count() - 1
    ends = spark.createDataFrame([(0,), (last,), (0,)], "row_id long")
    assert sorted(r.row_id for r in reader.targets_at(ends).collect()) == [0, last] and len(reader.targets_at(ends).inputFiles()) == 2
    assert reader.targets_at(some.where("row_id > 5")).count() == 0
    # targets aren't read with features
    assert "y:" not in reader.features_at(some)._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1].split(">")[0]
    s.publish("gap", samples.where("row_id <> 4"))
    s.publish("few", samples.drop("turnover"))
    with pytest.raises(store.StoreError):
        prepared.PreparedReader(s, "gap").index()
    for name in ("few", "none"):
        with pytest.raises(store.StoreError):
            prepared.PreparedReader(s, name)
    # the same inputs give the same identity, and the frame is found, not built
    assert prepared.preparation_identity(spark, data, "samples") == prepared.preparation_identity(spark, data, "samples") != prepared.preparation_identity(spark, data, "panel")
    assert prepared.kept(spark, data, "samples", lambda: 1 / 0).count() == samples.count()


def test_changed_bytes_or_code_build_anew(spark, tmp_path, monkeypatch):
    """The same name, length and time, and one other value; then another operator; then frames that were touched."""
    folder = tmp_path / "in"
    folder.mkdir()
    for name in prepared.INPUTS:
        pq.write_table(pa.table({"k": pa.array([1, 2, 3]), "x": pa.array([0.5, 1234.5678, 2.5]), "run": pa.array([time.time_ns()] * 3)}), folder / f"{name}.parquet", compression="none", use_dictionary=False, write_statistics=False)
    sf_dir, built = f"file://{folder}", []
    build = lambda: built.append(1) or spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("k", "2 * x AS x")
    look = lambda: sorted(r.x for r in prepared.kept(spark, sf_dir, "twice", build).collect())
    assert look() == look() == [1.0, 5.0, 2469.1356] and len(built) == 1
    path = folder / "part.parquet"
    before, times = path.read_bytes(), path.stat()
    path.write_bytes(before.replace(struct.pack("<d", 1234.5678), struct.pack("<d", 8765.4321)))
    os.utime(path, ns=(times.st_atime_ns, times.st_mtime_ns))
    (folder / ".part.parquet.crc").unlink(missing_ok=True)
    assert path.stat().st_size == times.st_size and path.stat().st_mtime_ns == times.st_mtime_ns
    prepared.recheck()
    assert look() == [1.0, 5.0, 17530.8642] and len(built) == 2
    monkeypatch.setattr(prepared, "code_digest", lambda: "another operator")
    assert look() == [1.0, 5.0, 17530.8642] and len(built) == 3
    # nulls don't slide from one column to the next unseen
    two = [spark.createDataFrame([r], "a int, b int") for r in ((None, 1), (1, None))]
    assert store.rows_digest(two[0]) != store.rows_digest(two[1]) and store.rows_digest(two[0].union(two[1])) == store.rows_digest(two[1].union(two[0]))


def test_a_stored_frame_with_other_files_is_refused(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    s.publish("one", spark.range(10).repartition(3))
    assert s.verify("one").count() == 10
    part = next((tmp_path / "s" / "one" / "data").glob("*.parquet"))
    other = tmp_path / "other.parquet"
    pq.write_table(pa.table({"id": pa.array([77], pa.int64())}), other)
    with pytest.raises(store.StoreError, match="without an order"):
        s.gather("one", spark.range(1).withColumnRenamed("id", "row_id"))
    part.with_name("part-extra.parquet").write_bytes(other.read_bytes())
    with pytest.raises(store.StoreError, match="files on record"):
        s.find("one")
    part.with_name("part-extra.parquet").unlink()
    part.unlink()
    with pytest.raises(store.StoreError, match="files on record"):
        s.find("one")


def test_splits_are_published_reused_or_refused(spark, tmp_path):
    s = prepared.SplitStore(store.Store(spark, f"file://{tmp_path}/splits"))
    roles = spark.createDataFrame([("F01", "train", 1, 0, 0), ("F01", "score", 2, 0, 1)], "fold string, role string, row_id long, stock_idx int, cal_idx int")
    plan = [splits.Window("F01", "validation", "2026-01-01", "2026-01-02", "2026-01-03", 0, 1, 2)]

    def refuse():
        raise splits.SplitError("F01.score is empty")

    assert prepared.prepare_splits(s, "samples", plan, lambda: roles, refuse)[1]["state"] == "failed"
    found, record = prepared.prepare_splits(s, "samples", plan, lambda: roles, lambda: None)
    assert record["state"] == "published" and found.count() == 2
    again, record = prepared.prepare_splits(s, "samples", plan, lambda: 1 / 0, refuse)
    assert record["state"] == "reused" and again.count() == 2 and s.identity("other", plan) != record["identity"]


def test_bars_from_a_stream(spark, tmp_path):
    t = datetime(2026, 1, 5, 9)
    ticks = [(t + timedelta(hours=h), "S", p, 10.0) for h, p in ((0, 5.0), (1, 7.0), (2, 4.0), (24, 6.0))]
    schema = "ts timestamp, stock_id string, price double, size double"
    spark.createDataFrame(ticks, schema).write.parquet(str(tmp_path / "ticks"))
    live = spark.readStream.schema(schema).parquet(str(tmp_path / "ticks"))
    query = bars.tick_bars(live).writeStream.format("memory").queryName("bars").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    one = spark.table("bars").orderBy("d").head()
    assert (one.open, one.high, one.low, one.close, one.volume_shares) == (5.0, 7.0, 4.0, 4.0, 30.0) and spark.table("bars").count() == 2
