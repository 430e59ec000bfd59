"""Quality of documents: repetition within the text, and lines that many documents of a host share.

All of it is DataFrame functions. Per document: words, their characters, symbols, repeated lines, and words in windows
of eight words that occur twice or more. Across documents: lines are normalised (trimmed, blanks as one, case ignored)
and hashed, distinct documents that hold a line are counted per host, lines above the limits are removed (`cleaned` returns
the texts without them), and a document that keeps too few of its characters is rejected as depleted. Documents of equal
text count once, so that copies of a document are not rejected for one another's lines.

Skew: counters are partial aggregates by (host, line); the join that finds a document's frequent lines is one that
adaptive execution can split; texts are never shuffled to judge them, only counts and hashes are.

Defined results: a null text has no words, fails (under 20 words) and counts in no host; a null host is a host of its own; repeated rows
get equal results; a null doc_id is kept; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .line_dedup import line_hash, too_often
from .shared import WORD_BREAK, bound, free_name, quoted, scratch, stored

LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
#: A line is frequent on more of a host's distinct documents than MAX_RATIO (or SMALL_HOST / root) of them; a document is depleted that keeps under LEAST_KEPT of the characters of its lines.
LEAST_KEPT = 0.3
SYMBOLS = "[#*$%&|<>]"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def repeated_words(words: Column) -> Column:
    """Words in windows found twice or more, from an array of words."""

    def over(hashes: Column) -> Column:
        # (hash, place) of every window, sorted: equal neighbours are repeats
        places = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def neighbours(p: Column) -> Column:
            pairs = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
            return F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda q: q.isNotNull()))))

        def cover(at: Column) -> Column:
            gaps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda x, y: F.least(y - x, F.lit(WINDOW)))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + F.coalesce(g, F.lit(WINDOW)))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(bound(bound(places, neighbours), cover))

    # hashes of 2, 4 and 8 words, each of two halves; the last seven have fewer words and so equal none
    def twice(step: int):
        return lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step)))

    windows = words
    for step in (1, 2, 4):
        windows = bound(windows, twice(step))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("long")).otherwise(bound(windows, over))


def text_figures(text: Column) -> Column:
    """A struct of the figures of one text, which is split into words once."""
    given = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(given, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    repeated_lines = bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return bound(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(given, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            repeated_lines.cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )


def host_of(docs: DataFrame) -> Column:
    return F.coalesce(F.concat(F.lit("="), quoted("source").cast("string")), F.lit("null"))


def page_of(docs: DataFrame) -> Column:
    """Equal for equal texts; null for null."""
    return F.when(quoted("text").isNotNull(), F.xxhash64(quoted("text")))


def scanned(docs: DataFrame) -> DataFrame:
    """One pass over the texts, stored: doc_id, host, page (a hash of the text), the figures, and of each line that isn't blank its hash and length."""
    lines = F.filter(F.transform(F.split(quoted("text"), "\n"), lambda x: F.struct(line_hash(x).alias("line"), F.length(x).alias("n"))), lambda e: e["line"].isNotNull())
    rows = docs.select(quoted("doc_id").alias("doc_id"), host_of(docs).alias("host"), page_of(docs).alias("page"), text_figures(quoted("text")).alias("f"), F.coalesce(lines, F.array()).alias("lines"))
    return stored(rows.select("doc_id", "host", "page", "f.*", "lines"))


def frequent_of(scan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, page, line, n): the characters of each line in each distinct text; and of those the lines above the limits, (host, line, bad)."""
    texts = scan.where("page IS NOT NULL")
    totals = texts.groupBy("host").agg(F.count_distinct("page").alias("n_host"))
    pages = texts.groupBy("host", "page").agg(F.first("lines").alias("lines"))
    each = stored(pages.select("host", "page", F.explode("lines").alias("e")).groupBy("host", "page", F.col("e.line").alias("line")).agg(F.sum("e.n").alias("n")))
    often = each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).where("n_docs > 1")
    return each, often.join(totals, "host").where(too_often(F.col("n_docs"), F.col("n_host"))).select("host", "line", F.lit(1).alias("bad"))


def depletion(scan: DataFrame) -> DataFrame:
    """(host, page, lost): the share of its characters that frequent lines take from each distinct text, where any do."""
    each, frequent = frequent_of(scan)
    marked = each.join(frequent, ["host", "line"], "left")
    sums = marked.groupBy("host", "page").agg(F.sum(F.when(F.col("bad") == 1, F.col("n"))).alias("bad"), F.sum("n").alias("n"))
    return sums.where("bad > 0").select("host", "page", (F.col("bad") / F.col("n")).alias("lost"))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the figures, base_failed, kept and lost_share of each document, and its host and page."""
    with scratch(docs.sparkSession):
        scan = scanned(docs)
        failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
        out = scan.drop("lines").join(depletion(scan), ["host", "page"], "left").withColumn("lost_share", F.coalesce("lost", F.lit(0.0))).withColumn("base_failed", failed)
        kept = ~F.col("base_failed") & (1 - F.col("lost_share") >= LEAST_KEPT)
        return stored(out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "lost_share", "host", "page"), keep=True)


def accepted(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with the columns of the input alone."""
    h, p = (free_name(docs, x) for x in ("_host", "_page"))
    kept = judged(docs).where("kept").select(F.col("host").alias(h), F.col("page").alias(p)).distinct()
    keyed = docs.withColumn(h, host_of(docs)).withColumn(p, page_of(docs))
    return keyed.join(kept, [h, p], "left_semi").select(*[quoted(c) for c in docs.columns])


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents that are kept, without the lines above the limits; the columns of the input, n_chars renewed."""
    from .line_dedup import without_frequent_lines

    with scratch(docs.sparkSession):
        bad = stored(frequent_of(scanned(docs))[1].select("host", "line"), keep=True)
    return without_frequent_lines(accepted(docs), bad=bad).select(*[quoted(c) for c in docs.columns])
