"""Audits of bar tables against their sources: rules a row, sets of dates a stock, reconciliations.

A row's first failing rule names its issue. Arithmetic is decimal and multiplied out, so no division rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

AMOUNT = "decimal(18,4)"


def strict_date(text: Column) -> Column:
    """A date from ISO text, or ISO text and ` 00:00:00`; NULL for any other form."""
    plain = F.regexp_replace(text, " 00:00:00$", "")
    parsed = F.try_to_date(plain, "yyyy-MM-dd")
    return F.when(F.date_format(parsed, "yyyy-MM-dd") == plain, parsed)


def finite_number(text: Column, kind: str = "decimal(18,6)") -> Column:
    return text.try_cast(kind)


#: Rules of one row, in order: name and what must hold. Names of columns are those of `joined_rows`.
ROW_RULES: tuple[tuple[str, str], ...] = (
    ("nonpositive_price", "open > 0 AND high > 0 AND low > 0 AND close > 0"),
    ("bar_order", "low <= least(open, close) AND greatest(open, close) <= high"),
    ("nonpositive_volume", "lots > 0 AND shares > 0 AND amount > 0 AND turnover >= 0"),
    ("lot_conversion", "shares = lots * 100"),
    ("percent_range", "pct > -100"),
    ("web_mismatch", "web_close = close AND web_pct = pct"),
    ("reference_price", "ref > 0 AND ref = round(ref, 2)"),
    ("reference_arithmetic", "abs(close * 100 - ref * (100 + pct)) <= tolerance * ref"),
    ("reference_not_unique", "NOT (ref > 0.01 AND abs(close * 100 - (ref - 0.01) * (100 + pct)) <= tolerance * (ref - 0.01)) AND NOT abs(close * 100 - (ref + 0.01) * (100 + pct)) <= tolerance * (ref + 0.01)"),
    ("previous_close", "previous IS NULL OR label_previous = previous"),
    ("independent_reference", "NOT coalesce(reference_traded, false) OR (reference_close = close AND reference_preclose = ref)"),
    ("clue", "clue_existing IS NULL OR (clue_existing = change_pct AND clue_web = pct)"),
)


def first_issue(rules: tuple[tuple[str, str], ...] = ROW_RULES) -> str:
    """A CASE of the first rule that a row breaks or cannot answer; NULL for a sound row."""
    return "CASE " + " ".join(f"WHEN NOT coalesce({holds}, false) THEN '{name}'" for name, holds in rules) + " END"


def with_previous(rows: DataFrame) -> DataFrame:
    """The close of the bar before, over bars, not calendar days."""
    return rows.withColumn("previous", F.lag("close").over(Window.partitionBy("stock_id").orderBy("d")))


def reviewed(rows: DataFrame) -> DataFrame:
    return with_previous(rows).withColumn("issue", F.expr(first_issue()))


CASES = ("listing_day", "resumed_after_pause", "known_ex_dividend_clue", "reference_differs_from_last_close", "ordinary")


def case_tags() -> str:
    """What a sound row is an example of."""
    return "filter(array(CASE WHEN d = list_date THEN 'listing_day' END, CASE WHEN resumed THEN 'resumed_after_pause' END, CASE WHEN clue_known THEN 'known_ex_dividend_clue' END, CASE WHEN previous IS NOT NULL AND ref <> previous THEN 'reference_differs_from_last_close' END), x -> x IS NOT NULL)"


def cases(rows: DataFrame) -> DataFrame:
    """A row a sound row and case; rows without any are ordinary."""
    tags = F.expr(case_tags())
    return rows.where("issue IS NULL").withColumn("case", F.explode(F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("ordinary")))))


def case_examples(tagged: DataFrame, most: int = 5) -> DataFrame:
    """The first date of each case and stock, for the first stocks of a case."""
    firsts = tagged.groupBy("case", "stock_id").agg(F.min("d").alias("d"))
    return firsts.withColumn("nth", F.row_number().over(Window.partitionBy("case").orderBy("stock_id"))).where(F.col("nth") <= most).drop("nth")


def issue_summary(rows: DataFrame) -> DataFrame:
    return rows.where("issue IS NOT NULL").groupBy(F.lit("error").alias("severity"), F.col("issue").alias("code")).agg(F.count(F.lit(1)).alias("n"))


def stock_coverage(rows: DataFrame) -> DataFrame:
    """Counters by stock, and over all stocks where stock_id is NULL."""
    return rows.rollup("stock_id").agg(F.count(F.lit(1)).alias("daily_rows"), F.count_if(F.col("issue").isNull()).alias("valid_trading_rows"), F.count_if(F.col("issue").isNotNull()).alias("invalid_rows"))


def audit_counters(states: DataFrame, rows: DataFrame, tagged: DataFrame, month_start: Column) -> DataFrame:
    """By stock, and over all where stock_id is NULL: states(stock_id, d, state), reviewed rows, and sound rows by case."""
    n, sound = F.count_if, F.col("issue").isNull()
    listed = states.rollup("stock_id").agg(F.count(F.lit(1)).alias("state_rows"), n(F.col("state") == 0).alias("suspended_rows"))
    checked = rows.rollup("stock_id").agg(
        F.count(F.lit(1)).alias("daily_rows"), n(F.col("d") >= month_start).alias("monthly_daily_rows"), n(sound).alias("valid_trading_rows"),
        n(sound & F.coalesce("reference_traded", F.lit(False))).alias("independent_reference_rows"), n(sound & F.col("clue_existing").isNotNull()).alias("legacy_difference_records_checked"),
    )
    cases_ = tagged.rollup("stock_id").agg(*[n(F.col("case") == c).alias(f"case_{c}") for c in CASES])
    same = lambda df, name: df.withColumnRenamed("stock_id", name)
    out = listed.join(same(checked, "s1"), F.col("stock_id").eqNullSafe(F.col("s1")), "left").join(same(cases_, "s2"), F.col("stock_id").eqNullSafe(F.col("s2")), "left")
    return out.drop("s1", "s2").na.fill(0)


def next_day_counts(grid: DataFrame) -> DataFrame:
    """grid(stock_id, cal_idx, state, valid): what follows each valid row on the calendar."""
    order = Window.partitionBy("stock_id").orderBy("cal_idx")
    rows = grid.withColumns({"after": F.lead("state").over(order), "after_valid": F.lead("valid").over(order)}).where("valid")
    n = F.count_if
    return rows.agg(n(F.col("after").isNull()).alias("calendar_tail_without_next_day"), n("after_valid").alias("next_day_pair_candidates"), n((F.col("after") == 0) & ~F.col("after_valid")).alias("next_day_suspended"), n((F.col("after") != 0) & ~F.col("after_valid")).alias("next_day_invalid_label"))


def slice_difference(left: DataFrame, right: DataFrame, *columns: str) -> DataFrame:
    """Rows, with their number in order, that one side has and the other hasn't."""
    one, two = (x.select(*columns) for x in (left, right))
    return one.exceptAll(two).withColumn("side", F.lit("only_left")).unionByName(two.exceptAll(one).withColumn("side", F.lit("only_right")))


def manifest_merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two tables (path, sha): agreements, conflicts, and what only one has."""
    both = left.select("path", F.col("sha").alias("a")).join(right.select("path", F.col("sha").alias("b")), "path", "full")
    return both.agg(F.count_if(F.col("a") == F.col("b")).alias("equal"), F.count_if(F.col("a") != F.col("b")).alias("conflict"), F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a").isNull()).alias("only_right"))


def count_mismatches(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Names whose declared and counted numbers differ."""
    return expected.join(actual, "name", "full").where(~F.col("declared").eqNullSafe(F.col("counted")))
