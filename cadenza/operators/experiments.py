"""Runs over folds and over the holdout: what may be read when, what is frozen, what is sealed.

A fold is fitted on its training rows, stopped on its scores and scored by metrics of our own. The final plan freezes the
folds' rounds. The holdout's predictions are written and digested before its targets can be read, once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics as mt
from . import models as md
from . import splits as sp
from .holdout import Gate, HoldoutError, Registry, frozen_rounds

TREND = "quote_index_trend"


class FoldSource:
    """The rows of one fold: roles checked against their declared counts and key digests, features apart from targets."""

    def __init__(self, assigned: DataFrame, samples: DataFrame, fold: str, names: list[str], key: tuple[str, str] = ("stock_id", "d"), gather: Callable[..., DataFrame] | None = None):
        """gather(rows, *columns): samples by row number, where they are kept so that it reads less than a scan."""
        self.fold, self.names, self.key, self.gather = fold, names, key, gather
        self.roles = assigned.where(F.col("fold") == fold).select("fold", "role", "row_id", "stock_idx", "cal_idx")
        self.samples = samples
        self._gate = Gate(self._targets())

    def describe(self) -> dict[str, dict]:
        """Per role: rows and the digest of the sample keys. Three rows."""
        counts = {r.role: r.n for r in self.roles.groupBy("role").agg(F.count(F.lit(1)).alias("n")).collect()}
        digests = {r.role: r.digest for r in sp.sample_key_digest(self.roles).collect()}
        return {role: {"rows": n, "digest": digests[role]} for role, n in sorted(counts.items())}

    def verify(self, declared: dict[str, dict]) -> None:
        if (found := self.describe()) != declared:
            raise sp.SplitError(f"{self.fold}: roles are not those declared: {found}")

    def _at(self, role: str, *columns: str) -> DataFrame:
        """Samples by row number; only the columns asked for are read."""
        rows = self.roles.where(F.col("role") == role).select("row_id")
        return self.gather(rows, *columns) if self.gather else self.samples.select("row_id", *columns).join(rows, "row_id", "left_semi")

    def _targets(self) -> DataFrame:
        return self._at("score", "y", "target_idx")

    def training(self) -> DataFrame:
        return self._at("train", "y", *self.names)

    def features(self, role: str = "predict") -> DataFrame:
        return self._at(role, *self.names)

    def prediction_batches(self, size: int, folder: str) -> Iterator[DataFrame]:
        """The rows to predict, `size` row numbers at a time. One job writes all batches, each to a folder of its own; each frame reads its own alone."""
        rows = self.features().withColumn("batch", F.floor(F.col("row_id") / size))
        rows.repartition("batch").sortWithinPartitions("batch", "row_id").write.partitionBy("batch").parquet(folder)
        spark, schema = rows.sparkSession, rows.drop("batch").schema
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        listed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        for number in sorted(int(n.removeprefix("batch=")) for f in listed if (n := f.getPath().getName()).startswith("batch=")):
            yield spark.read.schema(schema).parquet(f"{folder}/batch={number}")

    def predicted_rows(self) -> DataFrame:
        """(entity, day) of the rows to predict, by names that don't depend on the preparation."""
        return self._at("predict", *self.key).select(F.col(self.key[0]).alias("entity"), F.col(self.key[1]).alias("day"))

    def enable_scoring(self) -> None:
        self._gate.open()

    def targets(self) -> DataFrame:
        """Outcomes of the scored rows, for whoever has the predictions already."""
        return self._gate.targets


def labelled(rows: DataFrame, kind: str) -> DataFrame:
    return rows.withColumn("label", F.when(F.col("y") > 0, 1.0).otherwise(0.0) if kind == "binary" else F.col("y"))


def scored(predictions: DataFrame, targets: DataFrame, kind: str) -> DataFrame:
    """One row of scores of predictions (row_id, p) against targets (row_id, y)."""
    rows = labelled(predictions.join(targets, "row_id"), kind)
    if kind == "binary":
        return mt.binary_scores(rows.withColumn("label", F.col("label").cast("int"))).select("n", "accuracy", "logloss", "brier")
    return mt.regression_scores(rows).select("n", "rmse", "mae", "zero_rmse")


@dataclass(frozen=True)
class FoldResult:
    fold: str
    rounds: int
    scores: dict


def run_fold(source: FoldSource, kind: str, settings: md.Settings, rounds: int | None = None) -> tuple[FoldResult, object]:
    """Fit with patience on the fold's scores (or for fixed rounds), predict, score; returns the result and the model."""
    return run_folds([source], kind, settings, rounds)[0]


def run_folds(sources: list[FoldSource], kind: str, settings: md.Settings, rounds: int | None = None) -> list[tuple[FoldResult, object]]:
    """`run_fold` of each. The models grow together; what is small and independent runs side by side."""

    def rows(source: FoldSource) -> tuple[DataFrame, DataFrame | None]:
        train = labelled(source.training(), kind)
        source.enable_scoring()  # a development fold's scores stop its training
        return train, labelled(source.features("score").join(source.targets(), "row_id"), kind) if rounds is None else None

    def result(source: FoldSource, model: md.Boosted, best: int) -> FoldResult:
        predictions = md.predict(model, source.features("score"), source.names, kind).select("row_id", "p")
        return FoldResult(source.fold, best, scored(predictions, source.targets(), kind).head().asDict())

    names = sources[0].names
    with ThreadPoolExecutor(len(sources)) as pool:
        parts = list(pool.map(rows, sources))
        fitted = md.fit_parts(parts, names, kind, settings if rounds is None else md.Settings(**{**asdict(settings), "rounds": rounds}))
        results = list(pool.map(lambda x: result(x[0], *x[1]), zip(sources, fitted, strict=True)))
    return [(r, model) for r, (model, _) in zip(results, fitted, strict=True)]


@dataclass(frozen=True)
class FinalPlan:
    """What the holdout run may use: it can't be changed after it is frozen without changing its identity."""

    kind: str
    rounds: int
    features: tuple[str, ...]
    settings: dict
    folds: dict

    @property
    def identity(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, allow_nan=False).encode()).hexdigest()


def freeze(results: list[FoldResult], kind: str, names: list[str], settings: md.Settings, folds: int = 7) -> FinalPlan:
    """The final plan of exactly the expected folds: the median of their rounds."""
    if [r.fold for r in results] != [f"F{i:02}" for i in range(1, folds + 1)]:
        raise HoldoutError("the plan is frozen from all folds, in order")
    return FinalPlan(kind, frozen_rounds([max(1, r.rounds) for r in results]), tuple(names), asdict(settings), {r.fold: r.rounds for r in results})


def load_plan(text: str, identity: str) -> FinalPlan:
    given = json.loads(text)
    plan = FinalPlan(given["kind"], given["rounds"], tuple(given["features"]), given["settings"], given["folds"])
    if plan.identity != identity:
        raise HoldoutError("the plan is not the one that was frozen")
    return plan


def plan_text(plan: FinalPlan) -> str:
    return json.dumps(asdict(plan), sort_keys=True, allow_nan=False)


def description_for(kind: str, description: dict) -> dict:
    """The provenance of samples as a classifier sees it: the same rows and features, the sign of the target."""
    return {**description, "target": f"{description['target']}>0"} if kind == "binary" else dict(description)


def predictions_digest(predictions: DataFrame) -> str:
    """A digest of predictions in row order; blocks of rows are digested apart, and their digests together."""
    line = F.concat_ws(":", "row_id", F.format_string("%.17g", "p"))
    blocks = predictions.groupBy(F.floor(F.col("row_id") / 65536).alias("block")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_id", line.alias("l")))), lambda x: x["l"]), ","), 256).alias("h"))
    return blocks.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "h"))), lambda x: x["h"]), ","), 256)).head()[0]


def run_holdout(source: FoldSource, plan: FinalPlan, registry: Registry, folder: str, attempt: str | None = None) -> dict:
    """Reserve the rows, fit the frozen rounds, write and digest the predictions, expose, and only then read the targets and score.

    attempt: one of the same plan that was reserved and never exposed, to go on with; only one run can expose it.
    """
    attempt = attempt or registry.reserve(source.predicted_rows(), {"plan": plan.identity, "text": plan_text(plan)})
    settings = md.Settings(**{**plan.settings, "rounds": plan.rounds})
    model, _ = md.fit(labelled(source.training(), plan.kind), None, list(plan.features), plan.kind, settings)
    path = f"{folder}/predictions-{attempt}"
    md.predict(model, source.features(), list(plan.features), plan.kind).select("row_id", "p").write.mode("overwrite").parquet(path)
    digest = predictions_digest(source.samples.sparkSession.read.parquet(path))
    md.check_reload(model, f"{folder}/model-{attempt}", source.features(), list(plan.features), plan.kind)
    registry.expose(attempt, {"plan": plan.identity, "predictions": digest})
    return finish_exposed(source, plan, registry, folder, attempt, digest)


def finish_exposed(source: FoldSource, plan: FinalPlan, registry: Registry, folder: str, attempt: str, digest: str) -> dict:
    """Scores the sealed predictions of an exposed attempt, whose digest is on record; none are made anew."""
    sealed = source.samples.sparkSession.read.parquet(f"{folder}/predictions-{attempt}")
    source.enable_scoring()
    result = {**scored(sealed, source.targets(), plan.kind).head().asDict(), "rounds": plan.rounds, "predictions": digest}
    if predictions_digest(sealed) != digest:
        raise HoldoutError("the predictions changed after they were sealed")
    registry.finish(attempt, result)
    return result


def holdout_once(source: FoldSource, plan: FinalPlan, registry: Registry, folder: str) -> dict:
    """The result on record of this very plan on these rows; or the rest of an attempt of this plan that crashed; or else a run, which the registry refuses if any other attempt has seen the rows."""
    for known in registry.attempts():
        if known["reserved"]["configuration"].get("plan") == plan.identity and (known["state"] != "finished" or "exposed" in known):
            if known["state"] == "finished":
                return known["finished"]
            if known["state"] == "exposed":
                return finish_exposed(source, plan, registry, folder, known["attempt"], known["exposed"]["predictions"])
            return run_holdout(source, plan, registry, folder, known["attempt"])
    return run_holdout(source, plan, registry, folder)
