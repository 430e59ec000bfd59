"""Whether a source may be used: masters, states, markets, headers, slices, inventories, fingerprints, evidence.

Audits return rows of issues (severity, code, stock_id, source, detail) or counts; what stops a run at once is an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .audit import strict_date

EXCHANGES = ("SH", "SZ")
#: The markets whose monthly copies supplements must have verified.
MARKETS = ("sh000001", "sz399001")


class AdmissionError(ValueError):
    """A source, or evidence about it, that may not be used."""


def issue(code: str, stock: Column, source: Column, detail: Column, severity: str = "error") -> list[Column]:
    return [F.lit(severity).alias("severity"), F.lit(code).alias("code"), stock.cast("string").alias("stock_id"), source.cast("string").alias("source"), detail.cast("string").alias("detail")]


# -- masters, states, markets
def master_faults(master: DataFrame) -> DataFrame:
    """master(exchange, code, list_date as text) -> symbol and the fault of each row; NULL for sound ones."""
    symbol = F.concat_ws("", "exchange", "code")
    bad_code = ~F.coalesce(F.col("exchange").isin(*EXCHANGES) & F.col("code").rlike("^[0-9]{6}$"), F.lit(False))
    repeats = F.count(F.lit(1)).over(Window.partitionBy("symbol")) > 1
    named = master.withColumn("symbol", symbol)
    fault = F.when(bad_code, "code").when(repeats, "repeated").when(strict_date(F.col("list_date")).isNull(), "list_date")
    return named.withColumn("fault", fault)


def require_master(master: DataFrame) -> DataFrame:
    """(stock_id, list_date) of a sound master, in the order of symbols."""
    found = master_faults(master).groupBy(F.coalesce("fault", F.lit("")).alias("fault")).agg(F.count(F.lit(1)).alias("n"), F.min("symbol").alias("first")).collect()  # a row a fault
    if not found:
        raise AdmissionError("the master is empty")
    for r in found:
        if r.fault:
            raise AdmissionError(f"{r.n} rows of the master are wrong in {r.fault}, {r.first} first")
    return master.select(F.concat("exchange", "code").alias("stock_id"), strict_date(F.col("list_date")).alias("list_date")).orderBy("stock_id")


def state_faults(states: DataFrame) -> DataFrame:
    """states(stock_id, d, trade_status, evidence_type, evidence_ref), all text -> those and the fault; NULL for sound rows."""
    there = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    fault = F.when(~F.coalesce(F.col("trade_status").isin("0", "1"), F.lit(False)), "status").when(~(there("evidence_type") & there("evidence_ref")), "evidence")
    return states.withColumn("fault", fault)


def market_faults(rows: DataFrame) -> DataFrame:
    """rows(symbol, d, open, high, low, close): whether each bar is `sound`."""
    inside = (F.col("low") <= F.least("open", "close")) & (F.greatest("open", "close") <= F.col("high"))
    return rows.withColumn("sound", F.coalesce(inside & (F.least("open", "high", "low", "close") > 0), F.lit(False)))


def market_review(history: DataFrame, copy: DataFrame | None, calendar: DataFrame, month_start: Column) -> DataFrame:
    """Per symbol: rows, unsound bars, days that lack or exceed the calendar, rows of the month, and what its copy is."""
    days = calendar.select("d")
    per = market_faults(history).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("sound")).alias("unsound"), F.count_if(F.col("d") >= month_start).alias("monthly_rows"))
    strange = history.join(F.broadcast(days), "d", "left_anti").groupBy("symbol").agg(F.count(F.lit(1)).alias("extra_days"))
    every = history.select("symbol").distinct().join(F.broadcast(days))  # a row a symbol and day
    absent = every.join(history.select("symbol", "d"), ["symbol", "d"], "left_anti").groupBy("symbol").agg(F.count(F.lit(1)).alias("missing_days"))
    out = per.join(strange, "symbol", "left").join(absent, "symbol", "left").na.fill(0)
    if copy is None:
        return out.withColumn("monthly_copy", F.lit("not_present"))
    other = slice_positions(history.where(F.col("d") >= month_start), copy, "symbol", "d", *[c for c in ("open", "high", "low", "close") if c in copy.columns])
    bad = other.groupBy("symbol").agg(F.count_if(~F.col("same")).alias("bad"), F.count(F.lit(1)).alias("n"))
    state = F.when(F.col("n").isNull(), "not_present").when(F.col("bad") > 0, "mismatch").otherwise("verified")
    return out.join(bad, "symbol", "left").withColumn("monthly_copy", state).drop("bad", "n")


# -- slices, clues, inventories, fingerprints
def slice_positions(history: DataFrame, copy: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """Rows by their place within each key, on both sides: whether all columns agree there. `copy` keeps its order in `nth` if it has one."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    left = history.select(key, place.alias("nth"), F.struct(order, *columns).alias("a"))
    right = copy.select(key, (F.col("nth") if "nth" in copy.columns else place).alias("nth"), F.struct(order, *columns).alias("b"))
    return left.join(right, [key, "nth"], "full").withColumn("same", F.coalesce(F.col("a").eqNullSafe(F.col("b")) & F.col("a").isNotNull(), F.lit(False)))


def with_clues(rows: DataFrame, clues: DataFrame) -> DataFrame:
    """Adds what is known of a (stock_id, d): clues are a small list."""
    return rows.join(F.broadcast(clues), ["stock_id", "d"], "left")


def repeated_clues(clues: DataFrame) -> DataFrame:
    return clues.groupBy("stock_id", "d").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def inventory_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """expected(stock_id), actual(source, stock_id) -> per source the names it lacks and those it has beyond."""
    every = actual.select("source").distinct().join(F.broadcast(expected.select("stock_id").distinct()))  # a row a source and stock
    absent = every.join(actual.select("source", "stock_id"), ["source", "stock_id"], "left_anti").select("source", F.lit("missing").alias("side"))
    beyond = actual.join(expected.select("stock_id"), "stock_id", "left_anti").select("source", F.lit("extra").alias("side"))
    return absent.unionByName(beyond).groupBy("source").agg(F.count_if(F.col("side") == "missing").alias("missing"), F.count_if(F.col("side") == "extra").alias("extra"))


def content_digests(rows: DataFrame, by: str, order: str, *columns: str) -> DataFrame:
    """(by, sha256): of each entity's rows in order, every column as text; a row an entity and date is gathered by entity, as many as the calendar has days."""
    line = F.concat_ws("|", order, *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])
    each = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order), line.alias("l")))).alias("r"))
    return each.select(by, F.sha2(F.array_join(F.transform("r", lambda x: x["l"]), "\n"), 256).alias("sha256"))


def provenance_mismatch(actual: DataFrame, provenance: DataFrame) -> DataFrame:
    """Both (stock_id, source, sha256): the files whose digest isn't the one that labels were derived from."""
    said = provenance.select("stock_id", "source", F.col("sha256").alias("said"))
    return actual.join(said, ["stock_id", "source"], "left").where(~F.col("sha256").eqNullSafe(F.col("said")))


# -- headers
@dataclass(frozen=True)
class Frozen:
    """A source's declared range and size; dates are ISO text."""

    start: str
    end: str
    month_start: str
    count: int


def header_issues(frozen: Frozen, calendar: DataFrame, month_calendar: DataFrame, master: DataFrame, month_master: DataFrame, provenance: DataFrame, clues: DataFrame, tolerance: float, unit: float) -> DataFrame:
    """(code, n) of what is wrong with a source's small tables; no rows for a sound one. Calendars are (nth, d)."""
    lit = lambda x: F.to_date(F.lit(x))
    order = Window.orderBy("nth")
    days = calendar.withColumn("before", F.lag("d").over(order))
    out = days.agg(
        F.count_if(F.col("d") <= F.col("before")).alias("calendar_order"), F.count_if(~F.col("d").between(lit(frozen.start), lit(frozen.end))).alias("calendar_range"), F.count_if(F.lit(False)).alias("none"),
        (F.count(F.lit(1)) == 0).cast("long").alias("calendar_empty"),
    ).drop("none")
    sliced = calendar.where(F.col("d") >= lit(frozen.month_start)).select("d")
    month = sliced.exceptAll(month_calendar.select("d")).unionByName(month_calendar.select("d").exceptAll(sliced)).agg(F.count(F.lit(1)).alias("month_calendar"))
    names = ["stock_id", "list_date"]
    masters = master.select(*names).exceptAll(month_master.select(*names)).unionByName(month_master.select(*names).exceptAll(master.select(*names))).agg(F.count(F.lit(1)).alias("month_master"))
    size = master.agg(F.abs(F.count(F.lit(1)) - frozen.count).alias("stock_count"))
    twice = provenance.groupBy("stock_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("provenance_repeated"))
    sides = master.select("stock_id").exceptAll(provenance.select("stock_id").distinct()).unionByName(provenance.select("stock_id").distinct().exceptAll(master.select("stock_id"))).agg(F.count(F.lit(1)).alias("provenance_stocks"))
    again = repeated_clues(clues).agg(F.count(F.lit(1)).alias("clues_repeated"))
    fixed = master.sparkSession.range(1).select(F.lit(int(not frozen.start <= frozen.month_start <= frozen.end)).cast("long").alias("range"), F.lit(int(not 0 < tolerance < float("inf") or unit != 0.01)).cast("long").alias("tolerance"))
    one = fixed
    for part in (out, month, masters, size, twice, sides, again):  # a row each
        one = one.join(F.broadcast(part))
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).cast("long").alias("n")) for c in one.columns])).alias("e")).select("e.*").where("n > 0")


# -- prepared chunks
def chunk_faults(samples: DataFrame, names: tuple[str, ...], calendar_rows: int) -> DataFrame:
    """Per entity, rows that no chunk of samples may have: all counts are zero for sound ones."""
    n = F.count_if
    infinite = F.lit(False)
    for x in names:
        infinite = infinite | F.coalesce(F.abs(F.col(x).cast("double")) == float("inf"), F.lit(False)) | F.coalesce(F.isnan(F.col(x).cast("double")), F.lit(False))
    observed = F.col("target_status") == 1
    following = F.when(F.col("cal_idx") + 1 < calendar_rows, F.col("cal_idx") + 1)
    return samples.groupBy("stock_idx").agg(
        n(infinite).alias("infinite_features"), n(observed != F.col("y").isNotNull()).alias("label_and_status"), n(~F.col("target_idx").eqNullSafe(following)).alias("target_not_next"),
        n(observed & ~F.col("label_available_idx").eqNullSafe(F.col("target_idx"))).alias("availability"), n(F.col("state") < 0).alias("unlisted_rows"),
    )


# -- evidence: small records on the driver, manifests as frames
def merged_manifest(manifest: DataFrame, supplements: list[tuple[DataFrame, tuple[str, ...]]] = (), prior_reads: DataFrame | None = None) -> DataFrame:
    """(path, sha256) that primary and supplements approve: (path, sha256, end_sha256, unchanged) each, unique, unchanged, without conflicts.

    A supplement adds only the paths that it may. What was read before must be what is approved.
    """
    approved = None
    for number, (part, allowed) in enumerate([(manifest, None), *supplements]):
        bad = part.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("unchanged") != "True") | (F.col("sha256") != F.col("end_sha256")) | F.col("sha256").isNull()).alias("changed")).where("n > 1 OR changed > 0").head(1)
        if bad:
            raise AdmissionError(f"{bad[0].path} is repeated or changed in manifest {number}")
        rows = part.select("path", "sha256")
        if approved is None:
            approved = rows
            continue
        both = approved.select("path", F.col("sha256").alias("known")).join(rows, "path", "full")
        conflict = both.where("known <> sha256").head(1)
        if conflict:
            raise AdmissionError(f"{conflict[0].path} has two digests")
        strange = both.where(F.col("known").isNull() & ~F.col("path").isin(*allowed)).head(1)
        if strange:
            raise AdmissionError(f"{strange[0].path} is beyond what supplement {number} may add")
        approved = both.select("path", F.coalesce("known", "sha256").alias("sha256"))
    if prior_reads is not None:
        other = prior_reads.select("path", F.col("sha256").alias("read")).join(approved, "path").where("read <> sha256").head(1)
        if other:
            raise AdmissionError(f"{other[0].path} was read with another digest")
    return approved


def require(record: dict, **values) -> None:
    for name, value in values.items():
        if record.get(name) != value or type(record.get(name)) is not type(value):
            raise AdmissionError(f"{name} is {record.get(name)!r}, not {value!r}")


def approve_evidence(primary: dict, execution: dict, run_id: str, manifest: DataFrame, supplements: list[tuple[dict, DataFrame, tuple[str, ...]]] = (), prior_reads: DataFrame | None = None, directories_match: bool = True) -> DataFrame:
    """The approved digests of a passed inspection and its supplements."""
    require(primary, schema_version=1, stage="P0", admission_status="passed_with_limitations", inputs_unchanged=True)
    require(execution, execution_status="completed", run_id=run_id)
    if any(i["severity"] == "error" for i in primary.get("issues", ())):
        raise AdmissionError("the inspection has errors")
    if not directories_match:
        raise AdmissionError("the source is not the one inspected")
    for record, _, _ in supplements:
        require(record, previous_p0_run=run_id, errors=0, checked_inputs_unchanged=True, prior_p0_market_source_hashes_match=True)
        for market in MARKETS:
            require(record.get("markets", {}).get(market, {}), monthly_copy="verified")
    return merged_manifest(manifest, [(m, allowed) for _, m, allowed in supplements], prior_reads)


def admitted_snapshot(frozen: Frozen, primary: dict, calendar: DataFrame, stocks: DataFrame, approved: DataFrame, inputs: DataFrame) -> dict:
    """What a preparation may rely on; inputs(path) are the files that it will read."""
    require(primary["range"], start=frozen.start, end=frozen.end, month_start=frozen.month_start)
    days = calendar.withColumn("before", F.lag("d").over(Window.orderBy("nth"))).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") <= F.col("before")).alias("unordered"), F.count_if(~F.col("d").between(F.to_date(F.lit(frozen.start)), F.to_date(F.lit(frozen.end)))).alias("outside")).head()
    if not days.n or days.unordered or days.outside:
        raise AdmissionError(f"the calendar is empty, unordered or out of range: {days}")
    count = stocks.count()
    if not count == primary["stock_count"] == frozen.count:
        raise AdmissionError(f"{count} stocks, {frozen.count} declared, {primary['stock_count']} inspected")
    absent = inputs.join(approved, "path", "left_anti").head(1)
    if absent:
        raise AdmissionError(f"{absent[0].path} has no evidence")
    return {"range": [frozen.start, frozen.end], "market_days": days.n, "stocks": count, "inputs": inputs.count(), "counts": dict(primary["counts"]), "source_fingerprint": primary["source_fingerprint"]}
