"""Queries of admission audits over tables derived from the driver's, with faults put in by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import admission as ad
from ..operators import audit as au
from ..operators import features as ft
from ..sources import prepared as prep
from ..sources import trade_panel as src
from .reference_sql import with_ctes


def master_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as securities: some exchanges, codes and dates are wrong, and some codes come twice."""
    return src.read(spark, sf_dir, "customer").selectExpr(
        "CASE WHEN c_custkey % 11 = 0 THEN 'XX' WHEN c_custkey % 2 = 0 THEN 'SH' ELSE 'SZ' END AS exchange", "CASE WHEN c_custkey % 13 = 0 THEN concat('A', c_custkey) ELSE lpad(cast(c_custkey % 1400 AS string), 6, '0') END AS code",
        "CASE WHEN c_custkey % 7 = 0 THEN '2001-2-3' WHEN c_custkey % 5 = 0 THEN '2001-02-30' WHEN c_custkey % 3 = 0 THEN '2001-02-03 00:00:00' ELSE '2001-02-03' END AS list_date")


def admission_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.master_faults(master_of(spark, sf_dir)).groupBy("exchange", "fault").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("symbol").alias("symbols"))


def parsed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates and numbers from text, NULL where it isn't strict."""
    rows = master_of(spark, sf_dir).withColumn("number", F.expr("CASE WHEN code LIKE 'A%' THEN code WHEN code LIKE '%7' THEN 'NaN' WHEN code LIKE '%3' THEN 'Infinity' WHEN code LIKE '%1' THEN '' ELSE concat(code, '.25') END"))
    return rows.groupBy("list_date").agg(F.min(au.strict_date(F.col("list_date"))).alias("d"), F.count(au.finite_number(F.col("number"))).alias("numbers"), F.sum(au.finite_number(F.col("number"))).cast("double").alias("total"), F.count(F.lit(1)).alias("n"))


def state_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prep.panel(spark, sf_dir).where("state >= 0").join(F.broadcast(prep.entities(spark, sf_dir).select("stock_id", "number")), "stock_id").selectExpr(
        "stock_id", "d", "CASE WHEN (number * 7 + cal_idx) % 53 = 0 THEN '2' WHEN (number * 7 + cal_idx) % 97 = 0 THEN NULL ELSE cast(state AS string) END AS trade_status", "CASE WHEN cal_idx % 59 = 0 THEN NULL ELSE 'daily' END AS evidence_type", "CASE WHEN cal_idx % 61 = 0 THEN '' ELSE 'ref' END AS evidence_ref")
    return ad.state_faults(rows).groupBy("stock_id", "fault").agg(F.count(F.lit(1)).alias("n"))


def market_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prep.market_closes(spark, sf_dir).where("close IS NOT NULL").join(F.broadcast(prep.calendar(spark, sf_dir)), "cal_idx")
    return rows.selectExpr("symbol", "d", "cal_idx", "close AS open", "CASE WHEN cal_idx % 37 = 0 THEN close * 0.5e0 ELSE close * 2 END AS high", "CASE WHEN cal_idx % 41 = 0 THEN -1e0 ELSE close / 2 END AS low", "close")


def market_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The indices against the calendar, and against a copy of the last weeks in which one index has another close."""
    rows = market_rows(spark, sf_dir)
    start = F.to_date(F.lit("2000-01-01"))
    copy = rows.where(F.col("d") >= start).withColumn("close", F.when((F.col("symbol") == "sz399001") & (F.col("cal_idx") % 50 == 0), F.col("close") + 1).otherwise(F.col("close")))
    return ad.market_review(rows.where("cal_idx % 100 <> 99"), copy.where("cal_idx % 100 <> 99"), prep.calendar(spark, sf_dir), start)


def inventory_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = prep.entities(spark, sf_dir).select("stock_id")
    daily = names.where("stock_id NOT LIKE '%3'").select(F.lit("daily").alias("source"), "stock_id")
    state = names.select(F.lit("state").alias("source"), F.when(F.col("stock_id").like("%4"), F.concat("stock_id", F.lit("x"))).otherwise(F.col("stock_id")).alias("stock_id"))
    return ad.inventory_difference(names, daily.unionByName(state).unionByName(names.select(F.lit("web").alias("source"), "stock_id")))


def provenance_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the stocks' bars against those of the bars that were recorded: of some one volume differs by a share, of some nothing was recorded."""
    columns = ("open", "high", "low", "close", "volume_shares", "amount_yuan")
    bars = prep.panel(spark, sf_dir).where("state = 1")
    recorded = bars.withColumn("first", F.min("cal_idx").over(Window.partitionBy("stock_id"))).withColumn("volume_shares", F.col("volume_shares") + F.when(F.col("stock_id").like("%2") & (F.col("cal_idx") == F.col("first")), 1).otherwise(0))
    both = lambda df: df.withColumn("source", F.explode(F.array(F.lit("daily"), F.lit("web"))))
    actual, said = (both(ad.content_digests(df, "stock_id", "cal_idx", *columns)) for df in (bars, recorded))
    said = said.where("NOT (stock_id LIKE '%5' AND source = 'web')")
    return ad.provenance_mismatch(actual, said).select("stock_id", "source", F.col("said").isNotNull().alias("recorded"))


def header_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small tables with a fault of each kind."""
    days = prep.calendar(spark, sf_dir).select(F.col("cal_idx").alias("nth"), "d")
    names = prep.entities(spark, sf_dir).select("stock_id", "list_date")
    frozen = ad.Frozen("1995-06-01", "2001-06-30", "2000-01-01", 24)
    month = days.where(F.col("d") >= F.to_date(F.lit("2000-01-01"))).where("nth % 10 <> 0")
    provenance = names.where("stock_id NOT LIKE '%1'").unionByName(names.where("stock_id LIKE '%2'")).select("stock_id")
    clues = names.crossJoin(F.broadcast(days.where("nth < 2"))).unionByName(names.where("stock_id LIKE '%3'").crossJoin(F.broadcast(days.where("nth = 1")))).select("stock_id", "d")
    return ad.header_issues(frozen, days, month, names, names.where("stock_id NOT LIKE '%4'"), provenance, clues, 0.000001, 0.01)


def chunk_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.chunk_faults(prep.samples(spark, sf_dir), ft.FEATURES, prep.calendar(spark, sf_dir).count())


QUERIES = {f.__name__: f for f in (admission_master, parsed_text, state_validity, market_validity, inventory_difference, provenance_mismatch, header_audit, chunk_invariants)}

_MASTER = """SELECT CASE WHEN c_custkey % 11 = 0 THEN 'XX' WHEN c_custkey % 2 = 0 THEN 'SH' ELSE 'SZ' END AS exchange, CASE WHEN c_custkey % 13 = 0 THEN 'A' || c_custkey ELSE lpad(CAST(c_custkey % 1400 AS VARCHAR), 6, '0') END AS code,
 CASE WHEN c_custkey % 7 = 0 THEN '2001-2-3' WHEN c_custkey % 5 = 0 THEN '2001-02-30' WHEN c_custkey % 3 = 0 THEN '2001-02-03 00:00:00' ELSE '2001-02-03' END AS list_date FROM customer"""
CTES = {
    "master": ((), _MASTER),
    "mbars": (("markets", "cal"), "SELECT symbol, d, cal_idx, close, cal_idx % 37 = 0 OR cal_idx % 41 = 0 AS bad FROM markets JOIN cal USING (cal_idx) WHERE close IS NOT NULL AND cal_idx % 100 <> 99"),
}


def sql(body: str, *names: str) -> str:
    return with_ctes(body, *names, extra=CTES)


ORACLES = {
    "admission_master": sql("SELECT exchange, fault, count(*) AS n, count(DISTINCT exchange || code) AS symbols FROM (SELECT *, CASE WHEN exchange = 'XX' OR code LIKE 'A%' THEN 'code' WHEN count(*) OVER (PARTITION BY exchange, code) > 1 THEN 'repeated' WHEN list_date IN ('2001-2-3', '2001-02-30') THEN 'list_date' END AS fault FROM master) GROUP BY ALL", "master"),
    "parsed_text": sql("SELECT list_date, CASE WHEN list_date LIKE '2001-02-03%' THEN DATE '2001-02-03' END AS d, count(v) AS numbers, CAST(sum(v) AS DOUBLE) AS total, count(*) AS n FROM (SELECT *, CASE WHEN code LIKE 'A%' OR right(code, 1) IN ('7', '3', '1') THEN NULL ELSE CAST(code AS INTEGER) + 0.25 END AS v FROM master) GROUP BY list_date", "master"),
    "state_validity": sql("SELECT stock_id, fault, count(*) AS n FROM (SELECT p.stock_id, CASE WHEN (number * 7 + cal_idx) % 53 = 0 OR (number * 7 + cal_idx) % 97 = 0 THEN 'status' WHEN cal_idx % 59 = 0 OR cal_idx % 61 = 0 THEN 'evidence' END AS fault FROM panel p JOIN ent e ON e.stock_id = p.stock_id WHERE state >= 0) GROUP BY ALL", "panel", "ent"),
    "market_validity": sql("SELECT symbol, count(*) AS rows, count_if(bad) AS unsound, count_if(d >= DATE '2000-01-01') AS monthly_rows, CAST(0 AS BIGINT) AS extra_days, (SELECT count(*) FROM cal) - count(*) AS missing_days, CASE WHEN symbol = 'sz399001' AND count_if(d >= DATE '2000-01-01' AND cal_idx % 50 = 0) > 0 THEN 'mismatch' WHEN count_if(d >= DATE '2000-01-01') = 0 THEN 'not_present' ELSE 'verified' END AS monthly_copy FROM mbars GROUP BY symbol", "mbars", "cal"),
    "inventory_difference": sql("SELECT * FROM (SELECT 'daily' AS source, count_if(stock_id LIKE '%3') AS missing, CAST(0 AS BIGINT) AS extra FROM ent UNION ALL SELECT 'state', count_if(stock_id LIKE '%4'), count_if(stock_id LIKE '%4') FROM ent) WHERE missing + extra > 0", "ent"),
    "provenance_mismatch": sql("SELECT stock_id, source, NOT (stock_id LIKE '%5') AS recorded FROM (SELECT DISTINCT stock_id FROM panel WHERE state = 1), (VALUES ('daily'), ('web')) s(source) WHERE stock_id LIKE '%2' OR (stock_id LIKE '%5' AND source = 'web')", "panel"),
    "header_audit": sql("""SELECT * FROM (SELECT 'calendar_range' AS code, count_if(d NOT BETWEEN DATE '1995-06-01' AND DATE '2001-06-30') AS n FROM cal UNION ALL SELECT 'month_calendar', count_if(d >= DATE '2000-01-01' AND cal_idx % 10 = 0) FROM cal UNION ALL SELECT 'month_master', count_if(stock_id LIKE '%4') FROM ent UNION ALL SELECT 'stock_count', abs(count(*) - 24) FROM ent
 UNION ALL SELECT 'provenance_repeated', count_if(stock_id LIKE '%2') FROM ent UNION ALL SELECT 'provenance_stocks', count_if(stock_id LIKE '%1') FROM ent UNION ALL SELECT 'clues_repeated', count_if(stock_id LIKE '%3') FROM ent) WHERE n > 0""", "cal", "ent"),
    "chunk_invariants": sql("SELECT stock_idx, CAST(0 AS BIGINT) AS infinite_features, CAST(0 AS BIGINT) AS label_and_status, CAST(0 AS BIGINT) AS target_not_next, CAST(0 AS BIGINT) AS availability, CAST(0 AS BIGINT) AS unlisted_rows FROM samples GROUP BY stock_idx", "samples"),
}
