"""Expressions over an entity's dense calendar, as SQL text that Spark evaluates in one window stage.

Missing is NULL, never NaN. A window of k periods counts calendar rows, those before listing included, so a window is
NULL until k rows exist; observations missing inside it are skipped unless it must be complete.
"""

from __future__ import annotations

BY = "PARTITION BY stock_id ORDER BY cal_idx"


def frame(aggregate: str, first: int, last: int = 0, by: str = BY) -> str:
    """An aggregate over the rows from `first` to `last` before this one."""
    end = "CURRENT ROW" if last == 0 else f"{last} PRECEDING"
    return f"{aggregate} OVER ({by} ROWS BETWEEN {first} PRECEDING AND {end})"


def lag(x: str, k: int, by: str = BY) -> str:
    return x if k == 0 else f"lag({x}, {k}) OVER ({by})"


def lead(x: str, k: int = 1, by: str = BY) -> str:
    return f"lead({x}, {k}) OVER ({by})"


def position(by: str = BY) -> str:
    return f"row_number() OVER ({by})"


def gated(body: str, rows: int, by: str = BY) -> str:
    return f"CASE WHEN {position(by)} >= {rows} THEN {body} END"


def mean(x: str, k: int, before: int = 0, by: str = BY) -> str:
    return gated(frame(f"avg({x})", k - 1 + before, before, by), k + before, by)


def deviation(x: str, k: int, by: str = BY) -> str:
    """Population standard deviation of at least two observations."""
    return gated(f"CASE WHEN {frame(f'count({x})', k - 1, 0, by)} >= 2 THEN {frame(f'stddev_pop({x})', k - 1, 0, by)} END", k, by)


def share(x: str, k: int, by: str = BY) -> str:
    return gated(f"{frame(f'count({x})', k - 1, 0, by)} / {k}e0", k, by)


def complete(aggregate: str, x: str, k: int, before: int = 0, by: str = BY) -> str:
    """NULL unless all k observations are there."""
    return f"CASE WHEN {frame(f'count({x})', k - 1 + before, before, by)} = {k} THEN {frame(f'{aggregate}({x})', k - 1 + before, before, by)} END"


def ratio(top: str, bottom: str) -> str:
    """NULL unless both are there and the divisor is above zero."""
    return f"(CASE WHEN ({bottom}) > 0 THEN ({top}) / ({bottom}) END)"


def rounded(x: str, digits: int = 6) -> str:
    """Rounding that engines agree on: half up, but for a hair, so that noise at a tie rounds alike; no negative zero."""
    return f"(floor(({x}) * 1e{digits} + 0.5001e0) / 1e{digits} + 0e0)"
