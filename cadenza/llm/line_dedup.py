"""Line removal by site-relative frequency.

Per host, the number of pages that contain a line is divided by the host's page total; lines above a ratio are
boilerplate and go. The ratio is MAX_RATIO, and on hosts of few pages, where shares say less, SMALL_HOST over the root of
the pages: 3 of 3 pages, 5 of 9, 8 of 25, and from 225 pages on a tenth. Lines are compared after trimming, with runs of blanks as one and without regard to case. Pages of
equal text count as one page, so that copies of a page don't make its own lines boilerplate.

Skew: counts are partial aggregates by (host, line), so a hot host or line meets its counter as one row a task. The
lines that go are found by a join on (host, line), whose hot keys adaptive execution can split, and return to their
document by a hash of the document.

Defined results: a null or blank line is never boilerplate; a null host is a host of its own; a null text stays null;
repeated rows are treated alike; n_chars is the length of the new text (null for null); other columns stay as they
are, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD_BREAK, free_name, quoted

MAX_RATIO, SMALL_HOST = 0.1, 1.5


def too_often(n: Column, of: Column, max_ratio: float = MAX_RATIO, small_host: float = SMALL_HOST) -> Column:
    """Whether n of a host's `of` pages are above the ratio for a host of that size."""
    return n > F.greatest(F.lit(max_ratio), F.lit(small_host) / F.sqrt(of)) * of


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, WORD_BREAK, " ")))


def line_hash(line: Column) -> Column:
    """Null for a blank line."""
    return F.when(line.rlike("[^\\x20\\x09-\\x0D]"), F.xxhash64(normal_line(line)))


def frequent_lines(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, small_host: float = SMALL_HOST) -> DataFrame:
    """(host, line, n_pages, n_host): the lines on more of a host's distinct pages than the ratio allows."""
    rows = page_rows(docs, host, text)
    pages = rows.select("host", "page").distinct()
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n_host"))
    # copies go first: one row a page and line
    lines = rows.select("host", "page", F.explode("hashes").alias("line")).distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_pages")).where("n_pages > 1")
    return lines.join(totals, "host").where(too_often(F.col("n_pages"), F.col("n_host"), max_ratio, small_host))


def page_rows(docs: DataFrame, host: str, text: str) -> DataFrame:
    """(host, page, hashes): page is a hash of the text; a null host has a name that no host has."""
    hashes = F.array_distinct(F.array_compact(F.transform(F.split(quoted(text), "\n"), line_hash)))
    return docs.where(quoted(text).isNotNull()).select(F.coalesce(F.concat(F.lit("="), quoted(host).cast("string")), F.lit("null")).alias("host"), F.xxhash64(quoted(text)).alias("page"), hashes.alias("hashes"))


def without_frequent_lines(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, small_host: float = SMALL_HOST, bad: DataFrame | None = None) -> DataFrame:
    """The documents with their boilerplate lines removed, and `n_lines_removed`. bad(host, line): lines found elsewhere."""
    if bad is None:
        bad = frequent_lines(docs, host, text, max_ratio, small_host).select("host", "line")
    rows = page_rows(docs, host, text)
    found = rows.select("host", "page", F.explode("hashes").alias("line")).distinct().join(bad, ["host", "line"], "left_semi")
    key_h, key_p, drop, count = (free_name(docs, n) for n in ("_host", "_page", "_drop", "n_lines_removed"))
    gone = found.groupBy("host", "page").agg(F.collect_set("line").alias(drop)).withColumnsRenamed({"host": key_h, "page": key_p})
    keyed = docs.withColumn(key_h, F.coalesce(F.concat(F.lit("="), quoted(host).cast("string")), F.lit("null"))).withColumn(key_p, F.xxhash64(quoted(text)))
    joined = keyed.join(gone, [key_h, key_p], "left")
    lines = F.split(quoted(text), "\n")
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(quoted(drop), line_hash(x)), F.lit(False)))
    cleaned = F.when(quoted(drop).isNull(), quoted(text)).otherwise(F.array_join(kept, "\n"))
    new = joined.withColumn(count, F.when(quoted(drop).isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("long")).withColumn(text, cleaned)
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.length(quoted(text)).cast("long"))
    return new.select(*[quoted(c) for c in docs.columns], quoted(count))
