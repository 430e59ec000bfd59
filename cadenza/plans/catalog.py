"""All registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import admission_queries, metric_queries, model_queries, panel_queries, pattern_queries, rule_queries, split_queries

MODULES = (panel_queries, split_queries, rule_queries, pattern_queries, metric_queries, admission_queries, model_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def long_counts(text: str) -> str:
    """DuckDB's count_if is a HUGEINT; Spark's a long."""
    out, at = [], 0
    while (i := text.find("count_if(", at)) >= 0:
        depth, j = 1, i + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(text[j], 0)
            j += 1
        out += [text[at:i], "CAST(", text[i:j], " AS BIGINT)"]
        at = j
    return "".join(out) + text[at:]


def oracle_sql() -> dict[str, str]:
    return {k: long_counts(s) for m in MODULES for k, s in m.ORACLES.items()}
