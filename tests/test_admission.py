"""Market folders read from disk, what they are checked for, and evidence."""

import hashlib
import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from cadenza.operators import admission, reports
from cadenza.sources import market_folder as mf
from cadenza.sources import store, tables

DAYS = ["2026-08-20", "2026-08-21", "2026-08-24", "2026-08-25", "2026-08-26", "2026-08-27"]
STOCKS = (("000001", "SZ", "2000-01-01"), ("600001", "SH", "2026-08-21"))


def write(path, columns, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(("\ufeff" + "\n".join([",".join(columns), *(",".join(map(str, r)) for r in rows)]) + "\n").encode())


def folder(root, days=DAYS):
    (root).mkdir(parents=True, exist_ok=True)
    (root / mf.FROZEN).write_text(json.dumps({"start": DAYS[0], "end": DAYS[-1], "month_start": "2026-08-25", "count": 2}), encoding="utf-8")
    (root / mf.CALENDAR).write_text(json.dumps(days), encoding="utf-8-sig")
    write(root / mf.MASTER, mf.MASTER_COLUMNS, STOCKS)
    for code, exchange, listed in STOCKS:
        name = f"{exchange}{code}.csv"
        own = [d for d in days if d >= listed]
        write(root / mf.GROUPS["daily"][0] / name, mf.GROUPS["daily"][1], [(d, code, exchange, 10, 11, 9, 10, 1, 100, 1000, 0) for d in own])
        write(root / mf.GROUPS["label"][0] / name, mf.GROUPS["label"][1], [(d, code, exchange, 0, 10, 10) for d in own])
        write(root / mf.GROUPS["state"][0] / name, mf.GROUPS["state"][1], [(d, code, exchange, 1, "bar", "x") for d in own])
        write(root / mf.GROUPS["web"][0] / name, mf.GROUPS["web"][1], [(code, f"{code}.{exchange}", f"{d} 00:00:00", 10, 0) for d in own])
    for symbol in admission.MARKETS:
        write(root / mf.MARKET_FOLDER / f"{symbol}.csv", mf.MARKET_COLUMNS, [(d, symbol, 100, 101, 99, 100) for d in days])
    digest = lambda g, n: hashlib.sha256((root / mf.GROUPS[g][0] / n).read_bytes()).hexdigest()
    write(root / mf.PROVENANCE, mf.PROVENANCE_COLUMNS, [(c, e, digest("daily", f"{e}{c}.csv"), digest("web", f"{e}{c}.csv")) for c, e, _ in STOCKS])
    write(root / mf.CLUES, mf.CLUE_COLUMNS, [("000001", "SZ", DAYS[1], "0", "0", "True")])
    write(root / mf.REFERENCE_FOLDER / "SZ000001.csv", mf.REFERENCE_COLUMNS, [(d, "sz.000001", 10, 10, 1) for d in days])
    return root


@pytest.fixture
def source(spark, tmp_path):
    history, month = folder(tmp_path / "history"), folder(tmp_path / "month", [d for d in DAYS if d >= "2026-08-25"])
    return mf.MarketFolder(spark, f"file://{history}", f"file://{month}"), tmp_path


def issues_of(inputs, **changes):
    x = {**inputs, **changes}
    return {r.code: r.n for r in admission.header_issues(x["frozen"], x["calendar"], x["month_calendar"], x["master"], x["month_master"], x["provenance"], x["clues"], x.get("tolerance", 1e-6), 0.01).collect()}


def test_a_sound_folder(source, spark):
    reader, _ = source
    frozen, calendar, stocks = reader.core()
    assert frozen.count == 2 and calendar.count() == 6 and [r.stock_id for r in stocks.collect()] == ["SH600001", "SZ000001"]
    daily = reader.group("daily")
    assert daily.count() == 11 and {r.stock_id for r in daily.select("stock_id").distinct().collect()} == {"SH600001", "SZ000001"} and daily.agg(F.max("d")).head()[0] == date(2026, 8, 27)
    assert reader.group("web").count() == 11 and reader.group("label").count() == 11 and reader.reference().count() == 6
    inputs = reader.inspection_inputs()
    assert issues_of(inputs) == {}
    assert admission.inventory_difference(inputs["master"], inputs["inventories"]).count() == 0
    states = reader.group("state")
    assert admission.state_faults(states).where("fault IS NOT NULL").count() == 0
    market = reader.market()
    review = {r.symbol: r for r in admission.market_review(market, reader.market(reader.holdout), calendar, F.to_date(F.lit(frozen.month_start))).collect()}
    assert all((r.rows, r.unsound, r.missing_days, r.monthly_rows, r.monthly_copy) == (6, 0, 0, 3, "verified") for r in review.values()) and len(review) == 2
    said = inputs["provenance"].selectExpr("stock_id", "stack(2, 'daily', daily_input_sha256, 'web', web_input_sha256) AS (source, sha256)")
    assert admission.provenance_mismatch(reader.digests("daily").unionByName(reader.digests("web")), said).count() == 0
    month = reader.group("daily", reader.holdout)
    assert admission.slice_positions(reader.group("daily").where("d >= DATE '2026-08-25'"), month, "stock_id", "d", "close", "open").where("NOT same").count() == 0


def test_faults_of_headers(source, spark):
    reader, root = source
    inputs = reader.inspection_inputs()
    other = lambda name, f: {name: f(inputs[name])}
    assert issues_of(inputs, frozen=admission.Frozen("2026-08-20", "2026-08-26", "2026-08-25", 2)) == {"calendar_range": 1}
    assert issues_of(inputs, frozen=admission.Frozen("2026-08-20", "2026-08-27", "2026-08-19", 3))["range"] == 1
    assert issues_of(inputs, **other("calendar", lambda c: c.withColumn("nth", -F.col("nth")))) == {"calendar_order": 5}
    assert issues_of(inputs, **other("month_calendar", lambda c: c.where("nth > 0"))) == {"month_calendar": 1}
    assert issues_of(inputs, **other("month_master", lambda m: m.limit(1))) == {"month_master": 1}
    assert issues_of(inputs, **other("provenance", lambda p: p.unionByName(p))) == {"provenance_repeated": 2}
    assert issues_of(inputs, **other("provenance", lambda p: p.limit(1))) == {"provenance_stocks": 1}
    assert issues_of(inputs, **other("clues", lambda c: c.unionByName(c))) == {"clues_repeated": 1}
    assert issues_of(inputs, tolerance=float("nan")) == {"tolerance": 1}
    (root / "history" / mf.GROUPS["daily"][0] / "SZ000001.csv").rename(root / "history" / mf.GROUPS["daily"][0] / "SZ000009.csv")
    again = reader.inspection_inputs()
    assert [(r.missing, r.extra) for r in admission.inventory_difference(again["master"], again["inventories"]).collect()] == [(1, 1)]
    with pytest.raises(Exception, match="another stock"):
        reader.group("daily").collect()


def test_faults_of_files(source, spark):
    reader, root = source
    path = root / "history" / mf.GROUPS["state"][0] / "SH600001.csv"
    lines = path.read_text(encoding="utf-8-sig").splitlines()
    path.write_text("\n".join([lines[0].replace("evidence_ref", "evidence_ref,more"), *lines[1:]]), encoding="utf-8")
    with pytest.raises(tables.TableError):
        reader.group("state")
    path.write_text("\n".join(lines[1:]), encoding="utf-8")
    with pytest.raises(tables.TableError):
        reader.group("state")
    market = root / "month" / mf.MARKET_FOLDER / "sh000001.csv"
    market.write_text(market.read_text(encoding="utf-8-sig").replace("99,100", "99,100.5", 1), encoding="utf-8")
    frozen, calendar, _ = reader.core()
    copies = {r.symbol: r.monthly_copy for r in admission.market_review(reader.market(), reader.market(reader.holdout), calendar, F.to_date(F.lit(frozen.month_start))).collect()}
    assert copies == {"sh000001": "mismatch", "sz399001": "verified"}
    (root / "history" / mf.FROZEN).write_text('{"start": NaN}')
    with pytest.raises(tables.TableError):
        reader.core()


def test_masters(spark):
    schema = "exchange string, code string, list_date string"
    sound = [("SH", "600001", "2000-01-01"), ("SZ", "000001", "2000-01-01 00:00:00")]
    assert [r.stock_id for r in admission.require_master(spark.createDataFrame(sound, schema)).collect()] == ["SH600001", "SZ000001"]
    for bad in ([], [*sound, sound[0]], [("XX", "600001", "2000-01-01")], [("SH", "60001", "2000-01-01")], [("SH", "60000a", "2000-01-01")], [("SH", "600001", "2000-1-1")], [(None, "600001", "2000-01-01")]):
        with pytest.raises(admission.AdmissionError):
            admission.require_master(spark.createDataFrame(bad, schema))


def test_evidence(spark):
    schema = "path string, sha256 string, end_sha256 string, unchanged string"
    rows = [("a", "1", "1", "True"), ("b", "2", "2", "True")]
    frame = lambda r: spark.createDataFrame(r, schema)
    primary = {"schema_version": 1, "stage": "P0", "admission_status": "passed_with_limitations", "inputs_unchanged": True, "issues": [{"severity": "warning"}], "range": {"start": "2026-08-20", "end": "2026-08-27", "month_start": "2026-08-25"}, "stock_count": 2, "counts": {"daily_rows": 11}, "source_fingerprint": "f"}
    execution = {"execution_status": "completed", "run_id": "r"}
    more = {"previous_p0_run": "r", "errors": 0, "checked_inputs_unchanged": True, "prior_p0_market_source_hashes_match": True, "markets": {m: {"monthly_copy": "verified"} for m in admission.MARKETS}}
    reads = spark.createDataFrame([("a", "1")], "path string, sha256 string")
    approve = lambda p=primary, e=execution, m=rows, s=((more, [("a", "1", "1", "True"), ("c", "3", "3", "True")], ("c",)),), r=reads, match=True: admission.approve_evidence(p, e, "r", frame(m), [(x, frame(y), z) for x, y, z in s], r, match)
    approved = approve()
    assert sorted(tuple(r) for r in approved.collect()) == [("a", "1"), ("b", "2"), ("c", "3")]
    for bad in (
        {"p": {**primary, "stage": "P1"}}, {"p": {**primary, "inputs_unchanged": 1}}, {"p": {**primary, "issues": [{"severity": "error"}]}}, {"e": {**execution, "run_id": "x"}}, {"match": False},
        {"m": [*rows, rows[0]]}, {"m": [("a", "1", "2", "True")]}, {"m": [("a", "1", "1", "False")]},
        {"s": ((more, [("d", "3", "3", "True")], ("c",)),)}, {"s": ((more, [("a", "9", "9", "True")], ("c",)),)}, {"s": (({**more, "errors": 1}, [], ()),)}, {"s": (({**more, "markets": {}}, [], ()),)},
        {"r": spark.createDataFrame([("b", "9")], "path string, sha256 string")},
    ):
        with pytest.raises(admission.AdmissionError):
            approve(**bad)
    frozen = admission.Frozen("2026-08-20", "2026-08-27", "2026-08-25", 2)
    calendar = spark.createDataFrame([(i, date.fromisoformat(d)) for i, d in enumerate(DAYS)], "nth int, d date")
    stocks, inputs = spark.range(2), spark.createDataFrame([("a",), ("c",)], "path string")
    assert admission.admitted_snapshot(frozen, primary, calendar, stocks, approved, inputs)["market_days"] == 6
    for bad in (
        (frozen, primary, calendar.where("nth < 0"), stocks, approved, inputs), (frozen, primary, calendar.withColumn("nth", -F.col("nth")), stocks, approved, inputs), (frozen, primary, calendar, spark.range(3), approved, inputs),
        (frozen, primary, calendar, stocks, approved, spark.createDataFrame([("z",)], "path string")), (frozen, {**primary, "range": {}}, calendar, stocks, approved, inputs),
    ):
        with pytest.raises(admission.AdmissionError):
            admission.admitted_snapshot(*bad)


def test_sinks_and_reports(spark, tmp_path):
    store.save_json({"b": 1, "a": "\u65e5"}, spark, f"file://{tmp_path}/x.json")
    assert (tmp_path / "x.json").read_bytes().decode() == '{\n  "a": "\u65e5",\n  "b": 1\n}\n'
    with pytest.raises(ValueError):
        store.save_json({"a": float("nan")}, spark, f"file://{tmp_path}/y.json")
    for n in (2, 1):
        store.save_issues(spark.createDataFrame([("error", "bar_order", "S")] * n, "severity string, code string, stock_id string"), f"file://{tmp_path}/issues")
    assert spark.read.csv(f"file://{tmp_path}/issues", header=True).count() == 3
    text = reports.report("Inspection", "passed", {"rows": 3}, [{"severity": "error", "code": "a", "n": 2}], ["no sectors"])
    assert text.startswith("# Inspection\n\n**passed**\n\n| Checked | Result |\n| --- | --- |\n| rows | 3 |") and "- `error/a`: 2" in text and text.endswith("- no sectors\n")
    rep = spark.createDataFrame([("f", "up", 0, 2, 10, 7)], "feature string, event string, lo int, hi int, n long, hits long")
    store.save_csv(rep, f"file://{tmp_path}/rep")
    back = spark.read.csv(f"file://{tmp_path}/rep", header=True, schema=rep.schema)
    assert back.collect() == rep.collect()


def test_reread(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("one")
    before = spark.createDataFrame(tables.receipts(spark, f"file://{tmp_path}/in").collect())
    assert tables.reread(spark, f"file://{tmp_path}/in", before).count() == 1
    (tmp_path / "in" / "a").write_text("two")
    with pytest.raises(tables.TableError):
        tables.reread(spark, f"file://{tmp_path}/in", before)
