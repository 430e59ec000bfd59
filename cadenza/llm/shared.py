"""What several operators need: shared storage, shipping of functions, free column names, components of links."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.storage import shared_folder

#: Words are runs of anything but blank and the ASCII controls 9 to 13.
WORD_BREAK = "[\\x20\\x09-\\x0D]+"
#: The columns of `documents`, which stages return.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Links that a task joins at a time.
PART = 1 << 18


def ship(module: str) -> None:
    """Let executors that cannot import this package receive the module's functions by value."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


#: Paths of the scratch that is open, if any.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def stored(df: DataFrame, keep: bool = False) -> DataFrame:
    """Cut the lineage: write the frame to the shared folder and read it again. A lost executor loses none of it.

    Inside a `scratch` the files go at its end, but for frames to `keep`, which a result reads.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cadenza-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if not keep and (held := _SCRATCH.get()) is not None:
        held.append(path)
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stored inside is deleted at the end, whether or not it ended well."""
    held: list[str] = []
    token = _SCRATCH.set(held)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in held:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a frame from `stored` that no later plan reads."""
    for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        delete(df.sparkSession, path)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, for mapInArrow; what it has freed at its end goes back to the system, as a worker idles beside the executor's other work and malloc would keep whole batches."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return whole


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the frame doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable, which no projection rule copies."""
    return F.transform(F.array(value), body)[0]


def joined(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links (src, dst) every id that isn't the least it reaches by them, once, and that least id."""
    ids, at = np.unique(np.concatenate((src, dst)), return_inverse=True)
    a, b = at[: len(src)], at[len(src) :]
    low, own = np.arange(len(ids)), np.arange(len(ids))
    while (apart := low[a] != low[b]).any():
        x, y = low[a[apart]], low[b[apart]]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]
    return ids[low != own], ids[low[low != own]]


def _joined_parts(edges: DataFrame) -> DataFrame:
    """The same components with fewer links: of PART at a time, as a task reads them, each id keeps one at most, without an exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def part() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in joined(*(np.concatenate(c) for c in zip(*held, strict=True)))], ["src", "dst"])

        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy() for c in ("src", "dst")))
            size += len(batch)
            if size >= PART:
                yield part()
                held, size = [], 0
        if size:
            yield part()

    return edges.mapInArrow(trimmed(run), "src long, dst long")


def stars(edges: DataFrame) -> DataFrame:
    """Every id of edges(src long, dst long) that isn't the least it reaches, as src, once, and that least id as dst. Stored.

    Links are joined where a task has them; then alternating small-star and large-star rounds over distributed edges,
    until no id has two smaller neighbours, or a smaller and a larger one. Each round is stored, so lineage stays short,
    and only a count reaches the driver. Self links and nulls are ignored; without links the result is empty. The
    joining leaves an id no more smaller neighbours than there are parts, so the first small-star, a window by id, has
    no large group; large-star, where the ids of a star meet at its centre, is a join, whose skew can be split.
    """
    now = stored(_joined_parts(edges.where("src <> dst").select("src", "dst")))
    while _unsettled(now):
        met = now.where("src > dst").withColumn("low", F.min("dst").over(Window.partitionBy("src")))
        small = met.select(F.when(F.col("dst") > F.col("low"), F.col("dst")).otherwise(F.col("src")).alias("src"), F.col("low").alias("dst"))
        least = small.groupBy(F.col("src").alias("dst")).agg(F.min("dst").alias("low"))
        large = small.join(least, "dst", "left").select("src", F.coalesce("low", "dst").alias("dst")).distinct()
        after = stored(large)
        discard(now)
        now = after
    return now


def components(edges: DataFrame) -> DataFrame:
    """Least reachable id of every id in edges(src long, dst long); returns (id, component). See `stars`."""
    found = stars(edges)
    return found.select(F.col("src").alias("id"), F.col("dst").alias("component")).unionByName(found.select(F.col("dst").alias("id"), F.col("dst").alias("component")).distinct())


def _unsettled(edges: DataFrame) -> int:
    """How many ids have two smaller neighbours, or a smaller and a larger one."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("up")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 OR (ups = 1 AND least = 0)").count()
