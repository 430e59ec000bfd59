"""Queries over the roles of samples."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import splits as sp
from ..sources import prepared as prep
from .reference_sql import with_ctes

#: Of the weekly calendar: folds of 20 weeks from week 160, then the holdout from week 300.
FOLDS, FIRST, LENGTH = 7, 160, 20


def plan_of(spark: SparkSession, sf_dir: str) -> list[sp.Window]:
    """The plan, from the calendar's dates: a row a week comes to the driver."""
    days = [r.d.isoformat() for r in prep.calendar(spark, sf_dir).orderBy("cal_idx").collect()]
    folds = [{"id": f"F{i + 1:02}", "train_through": days[FIRST + LENGTH * i - 1], "validation_start": days[FIRST + LENGTH * i], "validation_end": days[FIRST + LENGTH * (i + 1) - 1]} for i in range(FOLDS)]
    last = FIRST + LENGTH * FOLDS
    closed = (date.fromisoformat(days[last]) - timedelta(days=2)).isoformat()  # projects to the market day after it
    return sp.build_plan(folds, {"start": closed, "end": days[-1]}, days)


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.plan_frame(spark, plan_of(spark, sf_dir))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.samples(spark, sf_dir)


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.roles(samples(spark, sf_dir), plan(spark, sf_dir))


def split_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).select("fold", "kind", "fit_idx", "first_idx", "last_idx", "market_days")


def exact_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The holdout's training rows against those of the first fold and all folds' scores."""
    rows = assigned(spark, sf_dir)
    parts = rows.where("(fold = 'F01' AND role = 'train') OR (fold <> 'holdout' AND role = 'score')").select("row_id")
    return sp.exact_cover(parts, rows.where("fold = 'holdout' AND role = 'train'").select("row_id"))


def split_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, p = samples(spark, sf_dir), plan(spark, sf_dir)
    return sp.role_violations(sp.roles(rows, p), p)


def index_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.index_invariants(samples(spark, sf_dir), prep.calendar(spark, sf_dir).count())


QUERIES = {
    "split_plan": split_plan, "split_roles": lambda spark, sf_dir: assigned(spark, sf_dir).select("fold", "role", "row_id"), "split_role_counts": lambda spark, sf_dir: sp.role_counts(samples(spark, sf_dir), plan(spark, sf_dir)),
    "split_daily_coverage": lambda spark, sf_dir: sp.daily_coverage(samples(spark, sf_dir), plan(spark, sf_dir), prep.calendar(spark, sf_dir)), "split_invariants": split_invariants, "index_invariants": index_invariants,
    "score_subset_predict": lambda spark, sf_dir: sp.score_mask(assigned(spark, sf_dir)), "sample_key_digest": lambda spark, sf_dir: sp.sample_key_digest(assigned(spark, sf_dir)), "population_coverage": lambda spark, sf_dir: sp.population_coverage(samples(spark, sf_dir)), "exact_cover": exact_cover,
}
SPLIT_CTES = {
    "plan": ((), f"SELECT printf('F%02d', i + 1) AS fold, 'validation' AS kind, {FIRST} + {LENGTH} * i - 1 AS fit_idx, {FIRST} + {LENGTH} * i AS first_idx, {FIRST} + {LENGTH} * (i + 1) - 1 AS last_idx FROM range({FOLDS}) t(i) UNION ALL SELECT 'holdout', 'holdout', {FIRST + LENGTH * FOLDS - 1}, {FIRST + LENGTH * FOLDS}, (SELECT max(cal_idx) FROM cal)"),
    "rw": (("plan",), "SELECT fold, fit_idx, 'train' AS role, 0 AS from_idx, fit_idx AS to_idx, fit_idx AS cutoff FROM plan UNION ALL SELECT fold, fit_idx, role, first_idx, last_idx, last_idx FROM plan CROSS JOIN (SELECT unnest(['predict', 'score']) AS role)"),
    "cand": (("rw", "samples"), "SELECT *, prediction_eligible AND (mature OR role = 'predict') AS selected, prediction_eligible AND target_status <> 1 AS unavailable, prediction_eligible AND target_status = 1 AND NOT mature AS immature FROM (SELECT *, target_status = 1 AND coalesce(label_available_idx, -1) BETWEEN 0 AND cutoff AS mature FROM samples JOIN rw ON target_idx BETWEEN from_idx AND to_idx)"),
    "roles": (("cand",), "SELECT * FROM cand WHERE selected"),
}
SPLIT_CTES["plan"] = (("cal",), SPLIT_CTES["plan"][1])
COUNTED = "count(*) AS period_rows, count_if(NOT prediction_eligible) AS information_ineligible, count_if(prediction_eligible) AS prediction_eligible, count_if(unavailable) AS target_unavailable, count_if(immature) AS label_not_mature, count_if(selected) AS selected"


def sql(body: str, *names: str) -> str:
    return with_ctes(body, *names, extra=SPLIT_CTES)


_KEYS = ("period_rows", "information_ineligible", "prediction_eligible", "target_unavailable", "label_not_mature", "selected")
ORACLES = {
    "split_plan": sql("SELECT fold, kind, fit_idx, first_idx, last_idx, last_idx - first_idx + 1 AS market_days FROM plan", "plan"),
    "split_roles": sql("SELECT fold, role, row_id FROM roles", "roles"),
    "split_role_counts": sql(f"SELECT fold, role, {COUNTED} FROM cand GROUP BY fold, role", "cand"),
    "split_daily_coverage": sql(f"SELECT w.fold, w.role, w.target_idx, {', '.join(f'coalesce(c.{k}, 0) AS {k}' for k in _KEYS)} FROM (SELECT fold, role, cal_idx AS target_idx FROM cal JOIN rw ON cal_idx BETWEEN from_idx AND to_idx) w LEFT JOIN (SELECT fold, role, target_idx, {COUNTED} FROM cand GROUP BY ALL) c ON c.fold = w.fold AND c.role = w.role AND c.target_idx = w.target_idx", "cand"),
    "split_invariants": sql("SELECT fold, role, count(*) AS n, count_if(NOT (target_idx BETWEEN from_idx AND to_idx AND prediction_eligible AND (role = 'predict' OR mature) AND (role = 'train' OR cal_idx >= fit_idx))) AS bad, count(*) - count(DISTINCT row_id) AS repeated FROM roles GROUP BY fold, role", "roles"),
    "index_invariants": sql("SELECT count_if(cal_idx NOT BETWEEN 0 AND n - 1) AS as_of_out_of_range, count_if(b >= cal_idx) AS unordered, count_if(coalesce(target_idx, -1) <> CASE WHEN cal_idx + 1 < n THEN cal_idx + 1 ELSE -1 END) AS target_not_next, count_if(prediction_eligible <> (state = 1)) AS eligibility, count_if((target_status = 3) <> (target_idx IS NULL)) AS status_and_date, count_if((target_status = 1) <> (label_available_idx IS NOT NULL)) AS availability, count_if((target_status = 1) <> (y IS NOT NULL)) AS label FROM (SELECT *, lag(cal_idx) OVER (PARTITION BY stock_idx ORDER BY row_id) AS b, (SELECT count(*) FROM cal) AS n FROM samples)", "samples"),
    "score_subset_predict": sql("SELECT fold, count_if(p) AS predicted, count_if(p AND s) AS scored, count_if(NOT p) AS score_outside_predict FROM (SELECT fold, row_id, bool_or(role = 'predict') AS p, bool_or(role = 'score') AS s FROM roles WHERE role <> 'train' GROUP BY fold, row_id) GROUP BY fold", "roles"),
    "sample_key_digest": sql("SELECT fold, role, sha256(string_agg(h, ',' ORDER BY block)) AS digest FROM (SELECT fold, role, row_id // 65536 AS block, sha256(string_agg(printf('%d:%d:%d', row_id, stock_idx, cal_idx), ',' ORDER BY row_id)) AS h FROM roles GROUP BY ALL) GROUP BY ALL", "roles"),
    "population_coverage": sql("SELECT count(*) AS grid_rows, count_if(prediction_eligible) AS prediction_eligible, count_if(NOT prediction_eligible) AS information_ineligible, count_if(target_idx IS NULL) AS unknown_target_date, count_if(target_idx IS NULL AND prediction_eligible) AS eligible_without_target_date FROM samples", "samples"),
    "exact_cover": sql("SELECT count_if(n > 1) AS repeated, count_if(w IS NULL) AS extra, count_if(n IS NULL) AS missing, count(*) AS rows FROM (SELECT row_id, count(*) AS n FROM roles WHERE (fold = 'F01' AND role = 'train') OR (fold <> 'holdout' AND role = 'score') GROUP BY 1) a FULL JOIN (SELECT row_id, 1 AS w FROM roles WHERE fold = 'holdout' AND role = 'train') b USING (row_id)", "roles"),
}
