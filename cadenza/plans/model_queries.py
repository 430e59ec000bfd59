"""Queries that fit boosted trees on all folds and all features. SQL has no counterpart, so they are checked by contract in tests."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import shared_folder, stored
from ..operators import experiments as ex
from ..operators import features as ft
from ..operators import holdout as ho
from ..operators import metrics as mt
from ..operators import models as md
from ..operators import splits as sp
from ..sources import prepared as prep
from .reference_sql import with_ctes
from .split_queries import FIRST, FOLDS, LENGTH, SPLIT_CTES, plan

NAMES = list(ft.FEATURES)
#: A smaller patience than the operators' 200 of 10,000 rounds, as a tree here is several jobs; both still act.
SETTINGS = md.Settings(rounds=200, patience=4)


def sources(spark: SparkSession, sf_dir: str) -> list[ex.FoldSource]:
    samples = prep.samples(spark, sf_dir)
    assigned = stored(sp.roles(samples, plan(spark, sf_dir)).select("fold", "role", "row_id", "stock_idx", "cal_idx"))
    gather = lambda rows, *columns: prep.gathered(spark, sf_dir, rows, *columns)
    return [ex.FoldSource(assigned, samples, f, NAMES, gather=gather) for f in (*[f"F{i:02}" for i in range(1, FOLDS + 1)], "holdout")]


def each_fold(spark: SparkSession, sf_dir: str, kind: str, rounds: int | None = None) -> list[tuple[ex.FoldResult, md.Boosted]]:
    return ex.run_folds(sources(spark, sf_dir)[:FOLDS], kind, SETTINGS, rounds)


def fitted(spark: SparkSession, sf_dir: str, kind: str) -> list[tuple[ex.FoldResult, md.Boosted]]:
    """The folds' results and models, fitted once for an input: kept as a row a fold, with the model's text."""

    def build() -> DataFrame:
        rows = [(r.fold, r.rounds, json.dumps(r.scores), m.text()) for r, m in each_fold(spark, sf_dir, kind)]
        return spark.createDataFrame(rows, "fold string, rounds int, scores string, model string")

    found = prep.kept(spark, sf_dir, f"models_{kind}", build, {"settings": asdict(SETTINGS), "plan": [FIRST, LENGTH, FOLDS]}).orderBy("fold").collect()  # a row a fold
    return [(ex.FoldResult(r.fold, r.rounds, json.loads(r.scores)), md.Boosted.from_text(r.model)) for r in found]


def folds_of(spark: SparkSession, sf_dir: str, kind: str) -> list[ex.FoldResult]:
    return [r for r, _ in fitted(spark, sf_dir, kind)]


def table(spark: SparkSession, results: list[ex.FoldResult]) -> DataFrame:
    """A row a fold."""
    names = list(results[0].scores)
    kinds = ", ".join(f"{n} {'long' if n == 'n' else 'double'}" for n in names)
    return spark.createDataFrame([(r.fold, r.rounds, *(r.scores[n] for n in names)) for r in results], f"fold string, rounds int, {kinds}")


def fold_query(kind: str):
    return lambda spark, sf_dir: table(spark, folds_of(spark, sf_dir, kind))


def gbt_fixed_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fold fitted again without validation rows, for the rounds that are frozen from all folds: the median of their best."""
    frozen = ho.frozen_rounds([max(1, r.rounds) for r in folds_of(spark, sf_dir, "regression")])
    return table(spark, [r for r, _ in each_fold(spark, sf_dir, "regression", frozen)])


def feature_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every fold's model at its best rounds: gain and splits by feature. A row a fold and feature."""
    used = [(r.fold, *row) for r, m in fitted(spark, sf_dir, "regression") for row in md.feature_usage(m, NAMES)]
    return spark.createDataFrame(used, "fold string, feature string, gain_share double, splits int")


def predictions(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(fold, row_id, p) of every fold's scored rows by its model."""
    out = None
    for source, (result, model) in zip(sources(spark, sf_dir), fitted(spark, sf_dir, kind), strict=False):
        one = md.predict(model, source.features("score"), NAMES, kind).select(F.lit(result.fold).alias("fold"), "row_id", "p")
        out = one if out is None else out.unionByName(one)
    return stored(out)


def predicted_rows(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    p = predictions(spark, sf_dir, kind)
    named = prep.gathered(spark, sf_dir, p.select("row_id"), "target_idx", "y").withColumnRenamed("target_idx", "day")
    return p.join(named, "row_id")


def gbt_regression_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models' own predictions by fold: all regression scores, and those that weigh days alike."""
    rows = predicted_rows(spark, sf_dir, "regression")
    days = mt.day_equal(rows, "fold").select("fold", "score_days", F.col("rmse").alias("day_rmse"), F.col("mae").alias("day_mae"))
    return mt.regression_scores(rows, "fold").join(days, "fold")


def gbt_classification_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classifiers' own predictions by fold: confusion, rates, losses and the area under the curve."""
    rows = predicted_rows(spark, sf_dir, "binary").withColumn("label", F.expr("CASE WHEN y > 0 THEN 1 ELSE 0 END"))
    return mt.binary_scores(rows, "fold").join(mt.roc_auc(rows, "fold").select("fold", "auc"), "fold")


def holdout_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Freeze the classifier's plan from the folds, predict the holdout, seal, then score: one row.

    The registry is that of the input, and lasts as long as the shared folder: a holdout is evaluated once, and what was
    recorded then is what later calls return; another plan on the same rows is refused.
    """
    frozen = ex.freeze(folds_of(spark, sf_dir, "binary"), "binary", NAMES, SETTINGS)
    folder = f"{shared_folder(spark)}/holdout-{prep.preparation_identity(spark, sf_dir, 'samples')}"
    result = ex.holdout_once(sources(spark, sf_dir)[-1], frozen, ho.Registry(spark, f"{folder}/registry"), folder)
    return spark.createDataFrame([(result["n"], result["rounds"], result["accuracy"], result["logloss"], result["brier"])], "n long, rounds int, accuracy double, logloss double, brier double")


def training_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `check_matrix` counts, for every fold's training rows."""
    rows = sp.roles(prep.samples(spark, sf_dir), plan(spark, sf_dir)).where("role = 'train'")
    infinite = sum((F.coalesce(F.abs(F.col(n).cast("double")) == float("inf"), F.lit(False)).cast("long") for n in NAMES), F.lit(0).cast("long"))
    lacking = sum((F.col(n).isNull().cast("long") for n in NAMES), F.lit(0).cast("long"))
    return rows.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.sum(infinite).alias("infinite_features"), F.sum(lacking).alias("missing_features"), F.count_if(F.col("y").isNull()).alias("bad_labels"))


def gathered_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each role by row number, with names for indices."""
    rows = sp.roles(prep.samples(spark, sf_dir), plan(spark, sf_dir)).select("fold", "role", "row_id")
    named = prep.gathered(spark, sf_dir, rows, "stock_idx", "cal_idx", "return_lag_0").join(F.broadcast(prep.stock_names(spark, sf_dir)), "stock_idx").join(F.broadcast(prep.calendar(spark, sf_dir)), "cal_idx")
    return rows.join(named, "row_id").groupBy("fold", "role", "stock_id").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count("return_lag_0").alias("with_return"))


QUERIES = {
    "gbt_regression_folds": fold_query("regression"), "gbt_classification_folds": fold_query("binary"), "gbt_fixed_rounds": gbt_fixed_rounds, "feature_usage": feature_usage, "gbt_regression_scores": gbt_regression_scores, "gbt_classification_scores": gbt_classification_scores, "holdout_evaluation": holdout_evaluation,
    "training_matrix": training_matrix, "gathered_samples": gathered_samples,
}


def _lacking() -> str:
    from .reference_sql import FEATURE_SQL

    return " + ".join(f"CASE WHEN f.{n} IS NULL THEN 1 ELSE 0 END" for n in FEATURE_SQL)


_MODEL_CTES = SPLIT_CTES | {"trained": (("roles", "feats"), f"SELECT r.fold, r.y, {_lacking()} AS lacking FROM roles r JOIN feats f ON f.stock_id = r.stock_id AND f.cal_idx = r.cal_idx WHERE role = 'train'")}
ORACLES = {
    "training_matrix": with_ctes("SELECT fold, count(*) AS rows, CAST(0 AS BIGINT) AS infinite_features, CAST(sum(lacking) AS BIGINT) AS missing_features, count_if(y IS NULL) AS bad_labels FROM trained GROUP BY fold", "trained", extra=_MODEL_CTES),
    "gathered_samples": with_ctes("SELECT fold, role, stock_id, count(*) AS n, min(d) AS first_day, max(d) AS last_day, count(r) AS with_return FROM roles GROUP BY ALL", "roles", extra=_MODEL_CTES),
}
