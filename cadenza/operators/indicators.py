"""Chart indicators: platforms, bottoms and log-linear channels of the quote index before today.

Windows are the `k` calendar rows before today and must be complete. Structure stays defined on a day without trade;
what needs today's level does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import complete, frame, gated, lag, ratio

PLATFORMS, BOTTOMS, CHANNELS = (20, 40, 60), (60, 120, 250), (20, 40, 60)


def platform_expressions() -> dict[str, str]:
    out = {}
    for k in PLATFORMS:
        high, low = complete("max", "q", k, 1), complete("min", "q", k, 1)
        out[f"prior_width_{k}"] = f"({high}) / ({low}) - 1"
        out[f"prior_drift_{k}"] = f"CASE WHEN {frame('count(q)', k, 1)} = {k} THEN {lag('q', 1)} / {lag('q', k)} - 1 END"
        out[f"breakout_{k}"] = f"q / ({high}) - 1"
    return out


def bottom_expressions() -> dict[str, str]:
    out = {}
    for k in BOTTOMS:
        high, low, last = complete("max", "q", k, 1), complete("min", "q", k, 1), lag("q", 1)
        out[f"bottom_position_{k}"] = ratio(f"{last} - ({low})", f"({high}) - ({low})")
        out[f"prior_drawdown_{k}"] = f"{last} / ({high}) - 1"
        out[f"bottom_low_distance_{k}"] = f"{last} / ({low}) - 1"
    return out


def channel_higher_expressions() -> dict[str, str]:
    """1 if the second half's extremes lie strictly above the first half's."""
    out = {}
    for k in CHANNELS:
        h = k // 2
        above = " AND ".join(f"{frame(f'{f}(q)', h, 1)} > {frame(f'{f}(q)', k, h + 1)}" for f in ("max", "min"))
        out[f"channel_higher_{k}"] = f"CASE WHEN {frame('count(q)', k, 1)} = {k} THEN CASE WHEN {above} THEN 1e0 ELSE 0e0 END END"
    return out


VOLUME_COMPLETE = f"CASE WHEN coalesce({gated(frame('min(CASE WHEN state = 1 THEN 1 ELSE 0 END)', 20, 1), 21)}, 0) = 1 THEN 1 ELSE 0 END"


def channel(values: Column, k: int) -> Column:
    """Least squares of k logarithms on 0..k-1, from residuals: gain, r2, width, sigma, and the fit at k."""
    middle, spread = (k - 1) / 2, k * (k * k - 1) / 12
    x = lambda i: i.cast("double") - F.lit(middle)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)

    def fitted(a: Column) -> Column:
        average = total(a) / k

        def line(m: Column) -> Column:
            centred = F.transform(a, lambda v: v - m)

            def residuals(c: Column) -> Column:
                slope = total(F.transform(c, lambda v, i: v * x(i))) / spread

                def figures(s: Column) -> Column:
                    def of(e: Column) -> Column:
                        sse, sst = total(F.transform(e, lambda v: v * v)), total(F.transform(c, lambda v: v * v))
                        r2 = F.when(F.array_max(a) > F.array_min(a), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - sse / sst)))
                        return F.struct(F.expm1(s * (k - 1)).alias("gain"), r2.alias("r2"), F.expm1(F.array_max(e) - F.array_min(e)).alias("width"), F.sqrt(sse / k).alias("sigma"), (m + s * (k - middle)).alias("fit"))

                    return F.transform(F.array(F.transform(c, lambda v, i: v - s * x(i))), of)[0]

                return F.transform(F.array(slope), figures)[0]

            return F.transform(F.array(centred), residuals)[0]

        return F.transform(F.array(average), line)[0]

    return F.when(F.size(values) == k, F.transform(F.array(values), fitted)[0])


def with_channels(panel: DataFrame, windows: tuple[int, ...] = CHANNELS) -> DataFrame:
    order = Window.partitionBy("stock_id").orderBy("cal_idx")
    out = panel
    for k in windows:
        logs = F.collect_list(F.ln("q")).over(order.rowsBetween(-k, -1))
        out = out.withColumn(f"_logs_{k}", F.when(F.count("q").over(order.rowsBetween(-k, -1)) == k, logs))
    for k in windows:
        out = out.withColumn(f"_fit_{k}", channel(F.col(f"_logs_{k}"), k))
    fits = {f"channel_{n}_{k}": F.col(f"_fit_{k}")[n] for k in windows for n in ("gain", "r2", "width", "sigma")}
    fits |= {f"channel_offset_{k}": F.ln("q") - F.col(f"_fit_{k}")["fit"] for k in windows}
    return out.withColumns(fits).drop(*[f"_{n}_{k}" for n in ("logs", "fit") for k in windows])


def indicators(panel: DataFrame) -> DataFrame:
    """All indicators, added to a panel that has q."""
    plain = platform_expressions() | bottom_expressions() | channel_higher_expressions() | {"volume_history_complete": VOLUME_COMPLETE}
    return with_channels(panel.withColumns({n: F.expr(e) for n, e in plain.items()}))
