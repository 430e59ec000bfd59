"""Content-addressed Parquet: written under a temporary name, published by a rename, reused when the identity fits.

The record of a frame lists its files with their lengths and, where it was published in an order, the range of that column in
each; it also keeps a digest of the rows. Finding a frame compares the list, which costs a listing; `verify` reads the rows.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType


class StoreError(ValueError):
    """A stored frame that isn't complete or isn't what its identity says."""


def identity_of(parts: dict) -> str:
    """SHA-256 of canonical JSON."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()).hexdigest()


def rows_digest(frame: DataFrame) -> str:
    """A digest of a frame's rows whatever their order, by one scan: their number and sums of two hashes of each, as SHA-256."""
    columns = sorted(c for c in frame.columns if not isinstance(frame.schema[c].dataType, MapType | VariantType))
    # places are hashed with values, as a hash alone passes over nulls
    values = [x for i, c in enumerate(columns) for x in (F.when(F.col(f"`{c}`").isNotNull(), i), F.col(f"`{c}`"))]
    each = frame.select(F.xxhash64(*values).alias("a"), F.xxhash64(F.lit(7), *reversed(values)).alias("b"))
    # a sum of longs in pieces of 21 bits, each a long for 2**42 rows; a sum of decimals makes objects for every row
    pieces = [F.coalesce(F.sum(p), F.lit(0)) for c in "ab" for p in (F.shiftright(c, 42), F.shiftright(c, 21).bitwiseAND(2**21 - 1), F.col(c).bitwiseAND(2**21 - 1))]
    n, *sums, xor_a, xor_b = each.agg(F.count(F.lit(1)), *pieces, *[F.coalesce(F.bit_xor(c), F.lit(0)) for c in "ab"]).head()
    found = [n, *[str((high << 42) + (middle << 21) + low) for high, middle, low in (sums[:3], sums[3:])], xor_a, xor_b]
    return hashlib.sha256(json.dumps([columns, *found], default=str).encode()).hexdigest()


class Store:
    """A folder that Spark's file systems reach, local or not."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self.path_of = jvm.org.apache.hadoop.fs.Path
        self.files = self.path_of(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def place(self, identity: str) -> str:
        return f"{self.root}/{identity}"

    def _listed(self, folder: str) -> list[list]:
        """Paths below a folder and lengths of its data files."""
        top, out = self.files.makeQualified(self.path_of(folder)).toString(), []
        found = self.files.listFiles(self.path_of(folder), True)
        while found.hasNext():
            f = found.next()
            if not f.getPath().getName().startswith(("_", ".")):
                out.append([f.getPath().toString().removeprefix(f"{top}/"), f.getLen()])
        return sorted(out)

    def record(self, identity: str) -> dict:
        place = self.place(identity)
        if not self.files.exists(self.path_of(f"{place}/_meta")):
            raise StoreError(f"{place} is not complete")
        return json.loads(self.spark.read.text(f"{place}/_meta").head()[0])

    def find(self, identity: str) -> DataFrame | None:
        """The complete frame of this identity; a folder without its record, with another one, or with other files is an error."""
        place = self.place(identity)
        if not self.files.exists(self.path_of(place)):
            return None
        meta = self.record(identity)
        if (listed := self._listed(f"{place}/data")) != meta["files"]:
            raise StoreError(f"{place} has not the files on record: {[x for x in listed + meta['files'] if (x in listed) != (x in meta['files'])][:4]}")
        frame = self.spark.read.parquet(f"{place}/data")
        if meta["identity"] != identity or meta["schema"] != frame.schema.simpleString():
            raise StoreError(f"{place} does not match its record")
        return frame

    def verify(self, identity: str) -> DataFrame:
        """The frame, once its rows are those that were published: a scan."""
        found = self.find(identity)
        if found is None or rows_digest(found) != self.record(identity)["rows"]:
            raise StoreError(f"{self.place(identity)} has not the rows that were published")
        return found

    def publish(self, identity: str, frame: DataFrame, *partitions: str, order: str | None = None) -> DataFrame:
        """Write, record, rename: readers see all of it or nothing. With an order, files hold ranges of that column, sorted."""
        if (known := self.find(identity)) is not None:
            return known
        partial = f"{self.root}/.partial-{uuid.uuid4().hex}"
        if order:
            frame = frame.repartitionByRange(order).sortWithinPartitions(order)
        frame.write.partitionBy(*partitions).parquet(f"{partial}/data")
        written = self.spark.read.parquet(f"{partial}/data")
        meta = {"identity": identity, "schema": written.schema.simpleString(), "files": self._listed(f"{partial}/data"), "rows": rows_digest(written)}
        if order:
            ranges = written.groupBy(F.col("_metadata.file_name").alias("name")).agg(F.min(order).alias("low"), F.max(order).alias("high"))
            meta |= {"order": order, "ranges": sorted([r.low, r.high, r.name] for r in ranges.collect())}  # a row a file
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{partial}/_meta")
        if not self.files.rename(self.path_of(partial), self.path_of(self.place(identity))):
            raise StoreError(f"{self.place(identity)} could not be published")
        return self.find(identity)

    def gather(self, identity: str, rows: DataFrame, *columns: str) -> DataFrame:
        """The frame's rows whose value of its order is in rows(order), of these columns: only files and row groups that can hold one are read.

        Which files, comes from the ranges on record: a row a file reaches the driver. Row groups are skipped by the least and
        greatest value asked for.
        """
        meta = self.record(identity)
        if "order" not in meta:
            raise StoreError(f"{identity} was published without an order")
        key = meta["order"]
        whole, wanted = self.find(identity), rows.select(key)
        ranges = self.spark.createDataFrame([tuple(r) for r in meta["ranges"]] or [(0, -1, "")], "low long, high long, name string")
        needed = wanted.join(F.broadcast(ranges), F.col(key).between(F.col("low"), F.col("high"))).groupBy("name").agg(F.min(key).alias("low"), F.max(key).alias("high")).collect()
        if not needed:
            return whole.select(key, *columns).limit(0)
        some = self.spark.read.schema(whole.schema).parquet(*sorted(f"{self.place(identity)}/data/{r.name}" for r in needed))
        return some.where(F.col(key).between(min(r.low for r in needed), max(r.high for r in needed))).select(key, *columns).join(wanted, key, "left_semi")


def save_csv(frame: DataFrame, path: str) -> None:
    """One file with LF and a header; missing counters of small reports as 0."""
    frame.na.fill(0).coalesce(1).write.csv(path, header=True, lineSep="\n")


def save_json(value: dict | list, spark: SparkSession, path: str) -> None:
    """One document: UTF-8, LF, sorted keys; NaN and infinities are errors."""
    text = json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True, allow_nan=False) + "\n"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


ISSUE_COLUMNS = ("severity", "code", "stock_id", "date", "source", "detail")


def save_issues(issues: DataFrame, path: str) -> None:
    """Issues are appended as they are found: one write an audit, LF and a header in each part."""
    shown = [F.col(c).cast("string") if c in issues.columns else F.lit("").alias(c) for c in ISSUE_COLUMNS]
    issues.select(*shown).write.mode("append").csv(path, header=True, lineSep="\n", emptyValue="")


def save_predictions(frame: DataFrame, path: str) -> None:
    """Gzipped parts; unscorable rows keep a blank truth and their reason."""
    frame.write.option("compression", "gzip").csv(path, header=True)
