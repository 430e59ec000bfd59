"""Bars of a panel and digests of its inputs: sums by integers against decimals, lines that are hashed and not sorted."""

import hashlib
import json
from datetime import datetime

from pyspark.sql import functions as F

from cadenza.sources import store
from cadenza.sources import trade_panel as src

LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_linestatus string, l_shipdate timestamp_ntz"


def odd_lines(spark, folder):
    """Ties of the first time, values that no two decimals hold, beyond a long's hundredths, negative and missing ones; parts without a brand."""
    mon, tue, later = datetime(2026, 1, 5), datetime(2026, 1, 6, 9), datetime(2026, 1, 11, 23, 59, 59)
    values = [(3.0, 1.005, 0.07), (7.0, 2.675, 0.1), (1e7, 123456789012345.5, 0.05), (0.125, -4.5, 0.0), (None, 11.0, 0.01), (5.0, None, 0.02), (9999999.99, 9999999.99, 0.03), (2.0, 1e-9, None), (-0.0, 8.35, 0.04)]
    lines = [(o, o % 5, o % 3, n, *values[(o * 7 + n) % 9], "FO"[o % 2], when) for o in range(60) for n, when in enumerate((tue, later, mon, tue) if o % 4 else (tue, later, None))]
    lines += [(None, 1, 1, 1, 4.0, 77.0, 0.0, "F", tue), (1, 4, 1, 1, None, None, None, "O", datetime(2026, 2, 3))]
    spark.createDataFrame(lines, LINE).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(0, "Brand#11"), (1, "Brand#12"), (2, "Brand#11"), (3, None), (4, "Brand#13")], "p_partkey long, p_brand string").write.parquet(f"{folder}/part.parquet")


def test_few_bars_are_those_of_all_lines_in_order(spark, tmp_path, monkeypatch):
    odd_lines(spark, tmp_path)
    want = src.bars_of(src.trades(spark, tmp_path), "stock_id").where("stock_id IS NOT NULL")
    for many in (src.MANY_PARTS, 1):  # parts by broadcast, and hashed in shares
        monkeypatch.setattr(src, "MANY_PARTS", many)
        got = src.few_bars(spark, tmp_path).select(*want.columns)
        assert got.count() == want.count() == 4 and not got.exceptAll(want).count()


def test_a_panel_sorts_no_lines(spark, tmp_path, monkeypatch):
    odd_lines(spark, tmp_path)
    kept, stored = [], src.stored
    monkeypatch.setattr(src, "stored", lambda df: kept.append(df) or stored(df))
    days = src.calendar(spark, tmp_path)
    src.panel(spark, tmp_path, days, src.entities(spark, tmp_path, days)).collect()
    (sums,) = kept
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "Sort [" not in plan


def test_market_closes_are_exact(spark, tmp_path):
    odd_lines(spark, tmp_path)
    days = src.calendar(spark, tmp_path)
    price, size = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_quantity").cast("decimal(18,2)")
    lines = src.read(spark, tmp_path, "lineitem").withColumn("d", F.date_trunc("week", "l_shipdate").cast("date")).join(days, "d")
    want = {(src.MARKET_OF[r.l_linestatus], r.cal_idx): r.close for r in lines.groupBy("l_linestatus", "cal_idx").agg((F.sum(price * size).cast("double") / F.sum(size).cast("double")).alias("close")).collect()}
    got = {(r.symbol, r.cal_idx): r.close for r in src.market_closes(spark, tmp_path, days).collect()}
    assert got == {key: want.get(key) for key in got} and len(got) == 4 and len(want) == 3


def test_digest_of_rows_adds_whole_hashes(spark):
    rows = spark.range(1000).withColumn("x", F.when(F.col("id") % 3 > 0, F.col("id") * -1.5))
    each = rows.select(F.xxhash64(F.when(F.col("id").isNotNull(), 0), "id", F.when(F.col("x").isNotNull(), 1), "x").alias("a"), F.xxhash64(F.lit(7), "x", F.when(F.col("x").isNotNull(), 1), "id", F.when(F.col("id").isNotNull(), 0)).alias("b")).collect()
    xor = [0, 0]
    for r in each:
        xor = [xor[0] ^ r.a, xor[1] ^ r.b]
    want = [["id", "x"], 1000, str(sum(r.a for r in each)), str(sum(r.b for r in each)), *xor]
    assert store.rows_digest(rows) == hashlib.sha256(json.dumps(want).encode()).hexdigest()
    assert store.rows_digest(rows.limit(0)) == hashlib.sha256(json.dumps([["id", "x"], 0, "0", "0", 0, 0]).encode()).hexdigest()
