"""The panel's prepared frames: built once for an input, kept by content, read by every query.

The identity of a frame is that of the inputs' rows, of the frame's name and settings, and of the text of the modules that
calculate, so that other inputs or another calculation never meet an old frame. A session reads the inputs' rows once for
that, and again when a file's name, length or time changes or `recheck` asks for it. Frames are published by a rename, so
readers see all or nothing.
"""

from __future__ import annotations

import functools
import hashlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as own_functions
from .. import operators
from ..functions.storage import shared_folder
from ..operators import features as ft
from ..operators import targets as tg
from . import trade_panel as src
from .store import Store, StoreError, identity_of, rows_digest

INPUTS = ("lineitem", "part")
#: Digests of inputs that this process has read, by what their files looked like.
_READ: dict[str, str] = {}


def input_files(spark: SparkSession, sf_dir: str) -> list[list]:
    """Name, length and time of every input file, by Spark's own file system."""
    out = []
    for name in INPUTS:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
        while files.hasNext():
            f = files.next()
            out.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    return sorted(out)


def input_digest(spark: SparkSession, sf_dir: str) -> str:
    """Of the rows of all inputs."""
    key = identity_of({"application": spark.sparkContext.applicationId, "files": input_files(spark, sf_dir)})
    if key not in _READ:
        _READ[key] = identity_of({n: rows_digest(spark.read.parquet(f"{sf_dir}/{n}.parquet")) for n in INPUTS})
    return _READ[key]


def recheck() -> None:
    """The next look at a frame reads its inputs' rows again."""
    _READ.clear()


@functools.cache
def code_digest() -> str:
    """Of the text of every module of the operators and functions, and of the panel's own."""
    texts = {}
    for package in (operators, own_functions):
        for m in pkgutil.iter_modules(package.__path__):
            texts[f"{package.__name__}.{m.name}"] = m.module_finder.find_spec(m.name).loader.get_source(m.name)
    texts[src.__name__] = src.__spec__.loader.get_source(src.__name__)
    return hashlib.sha256("\0".join(f"{k}\0{v}" for k, v in sorted(texts.items())).encode()).hexdigest()


def preparation_identity(spark: SparkSession, sf_dir: str, name: str, settings: dict | None = None) -> str:
    return identity_of({"name": name, "inputs": input_digest(spark, sf_dir), "code": code_digest(), "state": "complete", "settings": settings or {}})


def kept(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], settings: dict | None = None, order: str | None = None) -> DataFrame:
    """settings: what else the frame depends on. order: a column by whose ranges its rows are kept."""
    store = Store(spark, f"{shared_folder(spark)}/prepared")
    identity = preparation_identity(spark, sf_dir, name, settings)
    found = store.find(identity)
    return found if found is not None else store.publish(identity, build(), order=order)


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "calendar", lambda: src.calendar(spark, sf_dir))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "entities", lambda: src.entities(spark, sf_dir, calendar(spark, sf_dir)))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "panel", lambda: src.panel(spark, sf_dir, calendar(spark, sf_dir), entities(spark, sf_dir)))


def market_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "markets", lambda: src.market_closes(spark, sf_dir, calendar(spark, sf_dir)))


def ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with the quote index, its averages and the market's columns."""
    return ft.prepared(panel(spark, sf_dir), market_closes(spark, sf_dir))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed rows with targets, numbers and all features as float."""

    def build() -> DataFrame:
        wide, table = ready(spark, sf_dir), ft.catalogue()
        named = wide.withColumns({f"_{n}": F.expr(f"CAST({table[n][1]} AS FLOAT)") for n in ft.FEATURES})
        plain = named.select(*[c for c in wide.columns if c not in ft.FEATURES], *[F.col(f"_{n}").alias(n) for n in ft.FEATURES])
        return tg.samples(plain, entities(spark, sf_dir))

    return kept(spark, sf_dir, "samples", build, order="row_id")


def gathered(spark: SparkSession, sf_dir: str, rows: DataFrame, *columns: str) -> DataFrame:
    """Samples by row number: row_id and the columns of those in rows(row_id)."""
    samples(spark, sf_dir)
    return Store(spark, f"{shared_folder(spark)}/prepared").gather(preparation_identity(spark, sf_dir, "samples"), rows, *columns)


def stock_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stock_idx, stock_id): numbers by name, a row an entity."""
    return samples(spark, sf_dir).select("stock_idx", "stock_id").distinct()


class PreparedReader:
    """A published frame of samples by row number: the index, features and targets are opened apart, and only what is asked is read."""

    INDEX = ("row_id", "stock_idx", "cal_idx", "target_idx", "label_available_idx", "state", "prediction_eligible", "target_status")

    def __init__(self, store: Store, identity: str):
        found = store.find(identity)
        if found is None:
            raise StoreError(f"{identity} is not published")
        if missing := [n for n in (*self.INDEX, "y", *ft.FEATURES) if n not in found.columns]:
            raise StoreError(f"the samples lack {missing}")
        self.store, self.identity, self._frame = store, identity, found

    def index(self) -> DataFrame:
        """Keys and states, checked: rows are numbered from 0 without gaps."""
        rows = self._frame.select(*self.INDEX)
        seen = rows.agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("low"), F.max("row_id").alias("high"), F.count_distinct("row_id").alias("distinct")).head()
        if seen.n and (seen.low, seen.high, seen.distinct) != (0, seen.n - 1, seen.n):
            raise StoreError(f"row numbers are not 0 to {seen.n - 1}")
        return rows

    def at(self, rows: DataFrame, *columns: str) -> DataFrame:
        return self.store.gather(self.identity, rows, *columns)

    def features_at(self, rows: DataFrame) -> DataFrame:
        return self.at(rows, *ft.FEATURES)

    def targets_at(self, rows: DataFrame) -> DataFrame:
        return self.at(rows, "y")


class SplitStore:
    """Roles of samples by fold and role, published with the plan that made them."""

    def __init__(self, store: Store):
        self.store = store

    def identity(self, samples_identity: str, plan: list) -> str:
        return identity_of({"samples": samples_identity, "plan": [[str(v) for v in vars(w).values()] for w in plan]})

    def find(self, identity: str) -> DataFrame | None:
        return self.store.find(identity)

    def publish(self, identity: str, assigned: DataFrame) -> DataFrame:
        return self.store.publish(identity, assigned.select("row_id", "stock_idx", "cal_idx", "fold", "role"), "fold", "role")


def prepare_splits(splits: SplitStore, samples_identity: str, plan: list, build: Callable[[], DataFrame], check: Callable[[], None]) -> tuple[DataFrame | None, dict]:
    """Reuse what is published, or check, build and publish; the record says which, or why not."""
    identity = splits.identity(samples_identity, plan)
    try:
        if (found := splits.find(identity)) is not None:
            return found, {"state": "reused", "identity": identity}
        check()
        return splits.publish(identity, build()), {"state": "published", "identity": identity}
    except ValueError as e:
        return None, {"state": "failed", "identity": identity, "error": f"{type(e).__name__}: {e}"}
