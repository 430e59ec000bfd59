"""Strict CSV tables, hashed receipts and set fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class TableError(ValueError):
    """A table that breaks its contract."""


def read_csv(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    """All columns as text. A duplicate or missing column and a ragged row are errors; a byte order mark is dropped.

    Spark renames duplicate columns in silence, so the header is read first, as text.
    """
    head = spark.read.text(path).limit(1).head()
    if head is None:
        raise TableError(f"{path}: no header")
    names = [c.strip().strip('"') for c in head[0].lstrip("﻿").split(",")]
    if len(set(names)) != len(names):
        raise TableError(f"{path}: duplicate columns")
    if missing := set(required) - set(names):
        raise TableError(f"{path}: missing columns {sorted(missing)}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", enforceSchema=False, encoding="UTF-8")


def receipts(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose digests differ, or that only one side has."""
    both = before.select("path", F.col("sha256").alias("was")).join(after.select("path", F.col("sha256").alias("is")), "path", "full")
    return both.where(~F.col("was").eqNullSafe(F.col("is")))


def reread(spark: SparkSession, path: str, before: DataFrame) -> DataFrame:
    """The receipts of a path, which must be those of the read before."""
    now = receipts(spark, path)
    first = changed(before, now).head(1)
    if first:
        raise TableError(f"changed since it was read: {first[0].path}")
    return now


def require_approved(found: DataFrame, approved: DataFrame) -> None:
    """Fails if a file isn't in the approved manifest (path, sha256)."""
    first = found.join(approved, ["path", "sha256"], "left_anti").head(1)
    if first:
        raise TableError(f"not approved: {first[0].path}")


def fingerprint(found: DataFrame) -> DataFrame:
    """One digest of the sorted (path, sha256) pairs: a row a file, of which there are few."""
    pairs = F.array_sort(F.collect_list(F.concat_ws(":", "path", "sha256")))
    return found.agg(F.sha2(F.array_join(pairs, "\n"), 256).alias("fingerprint"))
