"""Joins of a large frame with a small row a key, where one key may hold a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, quoted

#: Keys that hold more than 1 / MOST of all rows are hot; so there are fewer than MOST of them, whatever the table.
MOST = 4096


def looked_up(rows: DataFrame, looks: DataFrame, keys: list[str], count: str) -> DataFrame:
    """rows LEFT JOIN looks on `keys`, nulls equal; looks has a row a key and in `count` how many rows have that key, and loses that column.

    Rows of hot keys meet a broadcast of fewer than MOST rows where they are; the rest is dealt by key, hot rows by a hash of
    their other columns, so that no task gets a large key. Columns of `rows` but for the keys mustn't be in `looks`.
    """
    values = [c for c in looks.columns if c not in keys and c != count]
    total, hot, own, spread = (free_name(rows, c) for c in ("_total", "_hot", "_own", "_spread"))
    named = [free_name(rows, f"_key{i}") for i in range(len(keys))]
    sized = looks.join(F.broadcast(looks.agg(F.sum(count).alias(total))))  # one row
    is_hot = F.col(count) * MOST > F.col(total)
    looked = sized.select(*[quoted(k).alias(n) for k, n in zip(keys, named, strict=True)], F.struct(*map(quoted, values)).alias(own), is_hot.alias(hot))
    equal = lambda a, b: [a[k].eqNullSafe(b[n]) for k, n in zip(keys, named, strict=True)]
    few = looked.where(hot)
    first = rows.join(F.broadcast(few), equal(rows, few), "left").drop(*named)
    first = first.withColumn(spread, F.when(F.col(hot), F.xxhash64(*map(quoted, rows.columns))).otherwise(F.lit(0))).withColumnRenamed(own, f"{own}_few").drop(hot)
    many = looked.where(~F.col(hot)).withColumn(f"{spread}_many", F.lit(0).cast("long")).drop(hot)
    both = first.join(many, [*equal(first, many), first[spread] == many[f"{spread}_many"]], "left")
    return both.withColumn(own, F.coalesce(f"{own}_few", own)).select(*map(quoted, rows.columns), *[F.col(f"{own}.`{c}`").alias(c) for c in values])
