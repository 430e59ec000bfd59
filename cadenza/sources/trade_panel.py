"""Bars and panels from trade lines: which entity, which period, prices and sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import stored
from ..operators.panel import calendar_of, grid

MARKET_OF = {"F": "sh000001", "O": "sz399001"}
#: Above so many parts they aren't left to a broadcast or to sorts of all lines: each task hashes its share.
MANY_PARTS = 2_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def period(unit: str) -> Column:
    """The first date of the line's period. Weeks and longer ones by dates alone, which is a third of the work of timestamps."""
    return F.trunc(F.col("l_shipdate").cast("date"), unit) if unit in ("week", "month", "quarter", "year") else F.date_trunc(unit, "l_shipdate").cast("date")


def trades(spark: SparkSession, sf_dir: str, unit: str = "week", times: DataFrame | None = None) -> DataFrame:
    """A row a line item: stock_id (the part's brand), period, price, size and a total order. times: only lines shipped at one of these few l_shipdate."""
    lines = read(spark, sf_dir, "lineitem").where("l_shipdate IS NOT NULL")
    if times is not None:
        lines = lines.join(F.broadcast(times), "l_shipdate", "left_semi")
    parts = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("stock_id"))
    if parts.count() > MANY_PARTS:
        parts = parts.hint("shuffle_hash")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.withColumn("d", period(unit))


def exact_sum(*factors: str) -> Column:
    """The sum of products of one or two columns as decimal(18,2), exact, then as double.

    Usual values, whose hundredths a double holds and whose product a long holds, are added as integers in two halves, which
    hold some billion rows of a group; the rest as decimals. Decimals of more than 18 digits cost an object a row.
    """
    usual = " AND ".join(f"rint({x} * 100) / 100 = {x} AND abs({x}) < 1e7" for x in factors)
    product = f"CASE WHEN {usual} THEN {' * '.join(f'CAST(rint({x} * 100) AS BIGINT)' for x in factors)} END"
    high, low = f"sum(shiftright({product}, 30))", f"sum(({product}) & 1073741823)"
    unit = "0.01" if len(factors) == 1 else "0.0001"
    integers = f"(CAST({high} AS DECIMAL(20,0)) * 1073741824 + CAST({low} AS DECIMAL(20,0))) * {unit}"
    unusual = f"NOT coalesce({usual}, false)"
    rest = f"sum(CASE WHEN {unusual} THEN {' * '.join(f'CAST({x} AS DECIMAL(18,2))' for x in factors)} END) FILTER (WHERE {unusual})"
    return F.expr(f"CAST(CASE WHEN {high} IS NULL THEN {rest} WHEN {rest} IS NULL THEN {integers} ELSE {integers} + {rest} END AS DOUBLE)")


def bars_of(lines: DataFrame, *keys: str) -> DataFrame:
    """Open, high, low, close (size-weighted mean), volume, amount and turnover. Sums are decimal, so order is nothing."""
    price, size = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_quantity").cast("decimal(18,2)")
    volume = F.sum(size).cast("double")
    first = F.min_by("l_extendedprice", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return lines.groupBy(*keys, "d").agg(
        first.alias("open"), F.max("l_extendedprice").alias("high"), F.min("l_extendedprice").alias("low"),
        (F.sum(price * size).cast("double") / volume).alias("close"), volume.alias("volume_shares"), F.sum(price * size).cast("double").alias("amount_yuan"),
        (F.sum(F.col("l_discount").cast("decimal(18,2)") * size).cast("double") / volume).alias("turnover"),
    )


def few_bars(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    """The bars of `bars_of` by stock_id, where they are few: a broadcast holds them. Lines are summed by hashing; only those of each bar's first time, at which the open is, are ordered."""
    volume, amount = exact_sum("l_quantity"), exact_sum("l_extendedprice", "l_quantity")
    totals = stored(trades(spark, sf_dir, unit).groupBy("stock_id", "d").agg(
        F.min("l_shipdate").alias("l_shipdate"), F.max("l_extendedprice").alias("high"), F.min("l_extendedprice").alias("low"),
        (amount / volume).alias("close"), volume.alias("volume_shares"), amount.alias("amount_yuan"), (exact_sum("l_discount", "l_quantity") / volume).alias("turnover"),
    ))
    bar = ["stock_id", "d", "l_shipdate"]
    early = trades(spark, sf_dir, unit, totals.select("l_shipdate").distinct()).join(F.broadcast(totals.where("stock_id IS NOT NULL").select(*bar)), bar)
    first = early.groupBy("stock_id", "d").agg(F.min_by("l_extendedprice", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("open"))
    return first.join(totals.drop("l_shipdate"), ["stock_id", "d"])


def market_closes(spark: SparkSession, sf_dir: str, weeks: DataFrame, unit: str = "week") -> DataFrame:
    """(symbol, cal_idx, close): the size-weighted mean price by line status, on the calendar `weeks`."""
    lines = read(spark, sf_dir, "lineitem").where("l_shipdate IS NOT NULL").withColumn("d", period(unit))
    closes = lines.where(F.col("l_linestatus").isin(*MARKET_OF)).groupBy("l_linestatus", "d").agg((exact_sum("l_extendedprice", "l_quantity") / exact_sum("l_quantity")).alias("close"))
    symbol = F.when(F.col("l_linestatus") == "F", MARKET_OF["F"]).otherwise(MARKET_OF["O"])
    return weeks.crossJoin(spark.range(1).select(F.explode(F.array(*map(F.lit, MARKET_OF.values()))).alias("symbol"))).join(closes.select(symbol.alias("symbol"), "d", "close"), ["symbol", "d"], "left").select("symbol", "cal_idx", "close")


def calendar(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    return calendar_of(read(spark, sf_dir, "lineitem").select(period(unit).alias("d")))


def entities(spark: SparkSession, sf_dir: str, weeks: DataFrame) -> DataFrame:
    """(stock_id, number, list_date): listing comes (number mod 5) * 4 weeks after the first week of the calendar."""
    first = weeks.where("cal_idx = 0").select(F.col("d").alias("start"))
    brands = read(spark, sf_dir, "part").select(F.col("p_brand").alias("stock_id")).distinct()
    number = F.regexp_replace("stock_id", "[^0-9]", "").cast("int")
    return brands.withColumn("number", number).crossJoin(F.broadcast(first)).select("stock_id", "number", F.date_add("start", (F.col("number") % 5) * 28).alias("list_date"))


def panel(spark: SparkSession, sf_dir: str, weeks: DataFrame, names: DataFrame) -> DataFrame:
    """The brand by week panel, with bars dropped where (7 number + 3 cal_idx) mod 97 = 0, which makes suspensions."""
    bars = few_bars(spark, sf_dir)
    kept = bars.join(F.broadcast(weeks), "d").join(names.select("stock_id", "number"), "stock_id").where("(number * 7 + cal_idx * 3) % 97 <> 0").drop("cal_idx", "number")
    return grid(names, weeks, kept)
