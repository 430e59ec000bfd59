"""Reader of a market data folder: a history, and a holdout month with copies of its last days.

Every group of per-stock files is one read, whatever the number of stocks; the file's name gives the stock. All columns are
text. Small documents come to the driver, as they steer it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.admission import Frozen, require_master
from ..operators.audit import strict_date
from .tables import TableError, read_csv, receipts

# Names of files and folders, and the columns that each kind of file must have.
FROZEN, CALENDAR, MASTER, MARKET_FOLDER, REFERENCE_FOLDER = "冻结配置.json", "交易日期.json", "股票名单.csv", "市场行情", "状态估值"
PROVENANCE, CLUES = "日线派生字段覆盖.csv", "网页与既有涨跌幅差异.csv"
GROUPS = {
    "daily": ("日线", ("date", "code", "exchange", "open", "high", "low", "close", "volume_lots", "volume_shares", "amount_yuan", "turnover_pct")),
    "label": ("日线派生涨跌", ("date", "code", "exchange", "provider_change_pct", "inferred_reference_close_yuan", "previous_actual_close_yuan")),
    "state": ("交易状态/逐日交易状态", ("date", "code", "exchange", "trade_status", "evidence_type", "evidence_ref")),
    "web": ("网页股本估值", ("SECURITY_CODE", "SECUCODE", "TRADE_DATE", "CLOSE_PRICE", "CHANGE_RATE")),
}
REFERENCE_COLUMNS = ("date", "code", "close", "preclose", "tradestatus")
MARKET_COLUMNS = ("date", "symbol", "open", "high", "low", "close")
PROVENANCE_COLUMNS = ("code", "exchange", "daily_input_sha256", "web_input_sha256")
CLUE_COLUMNS = ("code", "exchange", "date", "existing_pct", "web_pct", "known_ex_dividend_date")
MASTER_COLUMNS = ("code", "exchange", "list_date")


def read_json(spark: SparkSession, path: str) -> dict | list:
    """A small document; a byte order mark is dropped, NaN and infinities are errors."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise TableError(f"{path}: not one document")

    def refuse(name: str):
        raise TableError(f"{path}: {name} is no number")

    return json.loads(rows[0][0].lstrip("\ufeff"), parse_constant=refuse)


def read_many(spark: SparkSession, folder: str, required: tuple[str, ...]) -> DataFrame:
    """All CSV files of a folder: `symbol` from the file's name and the columns as text. One header for all files."""
    lines = spark.read.text(f"{folder}/*.csv").select(F.regexp_replace("value", "^\ufeff", "").alias("value"), F.col("_metadata.file_path").alias("file"))
    heads = lines.where(F.col("value").startswith(required[0]) & F.col("value").contains(required[-1])).groupBy("value").agg(F.count_distinct("file").alias("files"), F.count(F.lit(1)).alias("n")).limit(2).collect()
    if len(heads) != 1 or heads[0].files != heads[0].n:
        raise TableError(f"{folder}: files have {'no header' if not heads else 'different or repeated headers'}")
    if heads[0].files != lines.agg(F.count_distinct("file")).head()[0]:
        raise TableError(f"{folder}: some files have no header")
    names = heads[0].value.split(",")
    if len(set(names)) != len(names) or not set(required) <= set(names):
        raise TableError(f"{folder}: columns {names}, required {required}")
    rows = spark.read.csv(f"{folder}/*.csv", schema=", ".join(f"`{n}` string" for n in names), header=True, mode="FAILFAST", encoding="UTF-8", enforceSchema=True)
    return rows.withColumn("symbol", F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), "([^/]+)\\.csv$", 1))


class MarketFolder:
    def __init__(self, spark: SparkSession, history: str, holdout: str | None = None):
        self.spark, self.history, self.holdout = spark, history.rstrip("/"), holdout.rstrip("/") if holdout else None

    def calendar(self, root: str | None = None) -> DataFrame:
        """(nth, d) in the order of the document."""
        days = read_json(self.spark, f"{root or self.history}/{CALENDAR}")
        rows = self.spark.createDataFrame(list(enumerate(days)), "nth int, text string")
        return rows.select("nth", strict_date(F.col("text")).alias("d"))

    def master(self, root: str | None = None) -> DataFrame:
        return read_csv(self.spark, f"{root or self.history}/{MASTER}", MASTER_COLUMNS)

    def core(self) -> tuple[Frozen, DataFrame, DataFrame]:
        """What preparation needs: the declared range, the calendar and the stocks in the order of symbols."""
        given = read_json(self.spark, f"{self.history}/{FROZEN}")
        return Frozen(given["start"], given["end"], given["month_start"], given["count"]), self.calendar(), require_master(self.master())

    def inspection_inputs(self) -> dict:
        """What inspection needs besides: both masters and calendars, fingerprints, clues, and the names of all files."""
        frozen, calendar, stocks = self.core()
        named = lambda df: df.withColumn("stock_id", F.concat("exchange", "code"))
        inventories = None
        for root in (self.history, self.holdout):
            for group in GROUPS:
                part = self.names(group, root).withColumn("source", F.lit(f"{root}/{GROUPS[group][0]}"))
                inventories = part if inventories is None else inventories.unionByName(part)
        return {
            "frozen": frozen, "calendar": calendar, "stocks": stocks, "master": named(self.master()), "month_calendar": self.calendar(self.holdout), "month_master": named(self.master(self.holdout)), "inventories": inventories,
            "provenance": named(read_csv(self.spark, f"{self.history}/{PROVENANCE}", PROVENANCE_COLUMNS)), "clues": named(read_csv(self.spark, f"{self.history}/{CLUES}", CLUE_COLUMNS)).withColumn("d", strict_date(F.col("date"))),
        }

    def names(self, group: str, root: str | None = None) -> DataFrame:
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(f"{root or self.history}/{GROUPS[group][0]}")
        return files.select(F.regexp_extract(F.url_decode("path"), "([^/]+)\\.csv$", 1).alias("stock_id"))

    def group(self, name: str, root: str | None = None) -> DataFrame:
        """All rows of a group with `stock_id` and the date `d`; a row of another stock than its file's is an error."""
        folder, columns = GROUPS[name]
        rows = read_many(self.spark, f"{root or self.history}/{folder}", columns)
        code, exchange = F.substring("symbol", 3, 6), F.substring("symbol", 1, 2)
        right = (F.col("SECURITY_CODE") == code) & (F.col("SECUCODE") == F.concat_ws(".", code, exchange)) if name == "web" else (F.col("code") == code) & (F.col("exchange") == exchange)
        date = F.col("TRADE_DATE" if name == "web" else "date")
        checked = F.when(F.coalesce(right, F.lit(False)), F.col("symbol")).otherwise(F.raise_error(F.concat(F.lit("a row of another stock in "), F.col("symbol"))))
        return rows.withColumn("stock_id", checked).withColumn("d", strict_date(date)).drop("symbol")

    def reference(self) -> DataFrame:
        return read_many(self.spark, f"{self.history}/{REFERENCE_FOLDER}", REFERENCE_COLUMNS).withColumnRenamed("symbol", "stock_id").withColumn("d", strict_date(F.col("date")))

    def market(self, root: str | None = None) -> DataFrame:
        """All indices: symbol, d and prices as decimals."""
        rows = read_many(self.spark, f"{root or self.history}/{MARKET_FOLDER}", MARKET_COLUMNS)
        return rows.select("symbol", strict_date(F.col("date")).alias("d"), *[F.col(c).try_cast("decimal(18,6)").alias(c) for c in MARKET_COLUMNS[2:]])

    def digests(self, group: str) -> DataFrame:
        """(stock_id, source, sha256) of the files of a group."""
        found = receipts(self.spark, f"{self.history}/{GROUPS[group][0]}")
        return found.select(F.regexp_extract(F.url_decode("path"), "([^/]+)\\.csv$", 1).alias("stock_id"), F.lit(group).alias("source"), "sha256")
