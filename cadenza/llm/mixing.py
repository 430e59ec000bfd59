"""Mixing sources to target weights by temperature.

The weight of a source is its share of the tokens to the power alpha, normalised. alpha is bisected: for a target
entropy, to the alpha at which the weights have it; for a repetition limit, to the smallest alpha at which no source is
repeated more often. The budget is what lets the largest need be met once: the source with the least weight for its
tokens is seen exactly once, others up to the limit, so no document is lost. Weights are realised as block
permutations: each pass over a source is a fresh hashed permutation of its documents, the passes follow one another
up to the source's budget, and the running token count, divided by the source's share of a block, is the block number.
Every block so holds each source in its weight.

The sources stay distributed: repetition depends on the least and the greatest source alone, entropy is an aggregate over
the sources at each step, and only such sums reach the driver.

Skew: running counts of a hot source are sums within hashed ranges of the permutation and offsets of those ranges;
a range is a task's window, and the number of ranges of a source grows with its documents.

Defined results: a null source is a source of its own; null or empty texts have no tokens and come once, in pass 0;
a null doc_id is kept; equal rows share a place in the permutation; extra columns are ignored or, in
`mixed_documents`, kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import WORD_BREAK, free_name, quoted, stored

REPETITION_LIMIT, BLOCK_TOKENS, RANGE_ROWS, SEED = 2.0, 1 << 20, 4096, "mix-1"
#: Rows of the plan, about 100 bytes each, that may be broadcast.
BROADCAST_SOURCES = 100_000


def token_count(text: Column) -> Column:
    """Words: runs of anything but blanks."""
    return F.coalesce(F.size(F.array_remove(F.split(text, WORD_BREAK), "")), F.lit(0)).cast("long")


def weights_for(tokens: dict[str, int], alpha: float) -> dict[str, float]:
    total = sum(tokens.values())
    raw = {s: (n / total) ** alpha for s, n in tokens.items()}
    norm = math.fsum(raw.values())
    return {s: w / norm for s, w in raw.items()}


def repetitions(tokens: dict[str, int], weights: dict[str, float]) -> dict[str, float]:
    """Passes over each source when the one that is seen least is seen once."""
    per = {s: weights[s] / tokens[s] for s in tokens}
    least = min(per.values())
    return {s: p / least for s, p in per.items()}


def bisected(too_flat: Callable[[float], bool], steps: int = 50) -> float:
    """The least alpha in [0, 1] that isn't too flat. Entropy falls and repetition falls as alpha grows."""
    low, high = 0.0, 1.0
    if not too_flat(low):
        return low
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if too_flat(middle) else (low, middle)
    return high


def bisect_alpha(tokens: dict[str, int], entropy: float | None = None, limit: float | None = None) -> float:
    """alpha for a few sources on the driver."""
    if len(tokens) < 2:
        return 1.0

    def too_flat(alpha: float) -> bool:
        w = weights_for(tokens, alpha)
        if entropy is not None:
            return -math.fsum(x * math.log(x) for x in w.values() if x > 0) > entropy
        return max(repetitions(tokens, w).values()) > limit

    return bisected(too_flat)


def alpha_for(counts: DataFrame, total: int, least: int, most: int, entropy: float | None, limit: float) -> float:
    """alpha for the sources with tokens. At alpha a source of t tokens is repeated (most / t) ** (1 - alpha) times."""
    if least == most:
        return 1.0
    if entropy is None:
        return bisected(lambda alpha: (most / least) ** (1 - alpha) > limit)

    def too_flat(alpha: float) -> bool:
        raw = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(alpha))
        norm, logs = counts.where("tokens > 0").agg(F.sum(raw), F.sum(raw * F.ln(raw))).head()
        return math.log(norm) - logs / norm > entropy

    return bisected(too_flat, 30)


def source_plan(counts: DataFrame, entropy: float | None = None, limit: float = REPETITION_LIMIT) -> DataFrame:
    """counts(mix_source, tokens, docs) -> those and weight, passes, per_block. Up to BROADCAST_SOURCES rows are broadcast; beyond, it is joined like any table."""
    counts = stored(counts)
    tokens = F.col("tokens").cast("double")
    some = counts.where("tokens > 0").agg(F.sum("tokens").alias("total"), F.min("tokens").alias("least"), F.max("tokens").alias("most")).head()
    if some.total is None:
        weight, passes = F.lit(0.0), F.lit(1.0)
    else:
        alpha = alpha_for(counts, some.total, some.least, some.most, entropy, limit)
        raw = F.pow(tokens / F.lit(float(some.total)), F.lit(alpha))
        norm = counts.where("tokens > 0").agg(F.sum(raw)).head()[0]
        weight = F.when(tokens > 0, raw / F.lit(norm)).otherwise(0.0)
        passes = F.when(tokens > 0, F.pow(F.lit(float(some.most)) / tokens, F.lit(1 - alpha))).otherwise(1.0)
    plan = counts.withColumns({"weight": weight, "passes": passes}).withColumn("per_block", F.col("weight") * BLOCK_TOKENS)
    return F.broadcast(plan) if counts.count() <= BROADCAST_SOURCES else plan


def order_key(doc: Column, epoch: Column, *more: Column) -> Column:
    """The place of a document in a pass: 60 bits, evenly spread. What tells documents of one id, or of none, apart may follow."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), doc, epoch, *more), 4)


def placed(lengths: DataFrame, entropy: float | None = None, limit: float = REPETITION_LIMIT) -> DataFrame:
    """lengths(mix_key, mix_text, mix_source, mix_tokens), a row a document -> a row for each time it is used: those and epoch, weight, block, position (tokens of its source before it)."""
    counts = lengths.groupBy("mix_source").agg(F.sum("mix_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    plan = source_plan(counts, entropy, limit)
    ranges = F.greatest(F.lit(1), F.ceil(F.col("docs") / RANGE_ROWS)).cast("long")
    each = lengths.join(plan.withColumnRenamed("mix_source", "plan_source"), F.col("mix_source") == F.col("plan_source")).drop("plan_source").withColumn("ranges", ranges)
    each = each.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.when(F.col("mix_tokens") > 0, F.ceil("passes").cast("int") - 1).otherwise(0))))
    each = each.withColumn("key", order_key(F.col("mix_key"), F.col("epoch"), F.col("mix_text")))
    each = each.withColumn("range", F.floor(F.col("key") / (F.lit(float(1 << 60))) * F.col("ranges")).cast("long"))
    sums = each.groupBy("mix_source", "epoch", "range").agg(F.sum("mix_tokens").alias("t"))
    before = sums.select("mix_source", "epoch", "range", (F.sum("t").over(Window.partitionBy("mix_source", "epoch").orderBy("range")) - F.col("t")).alias("before"))
    run = Window.partitionBy("mix_source", "epoch", "range").orderBy("key", "mix_key", "mix_text").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("within", F.coalesce(F.sum("mix_tokens").over(run), F.lit(0)))
    each = each.join(before, ["mix_source", "epoch", "range"]).withColumn("position", F.col("epoch") * F.col("tokens") + F.col("before") + F.col("within"))
    used = each.where((F.col("epoch") == 0) | (F.col("position") < F.round(F.col("passes") * F.col("tokens")).cast("long")))
    block = F.when(F.col("per_block") > 0, F.floor(F.col("position") / F.col("per_block"))).otherwise(0).cast("long")
    return used.select("mix_key", "mix_source", "mix_tokens", F.col("epoch").cast("long").alias("epoch"), "weight", block.alias("block"), "position")


def lengths_of(docs: DataFrame, key: Column) -> DataFrame:
    source = F.coalesce(F.concat(F.lit("="), quoted("source").cast("string")), F.lit("null"))
    return docs.select(key.alias("mix_key"), F.xxhash64(quoted("text")).alias("mix_text"), source.alias("mix_source"), token_count(quoted("text")).alias("mix_tokens"))


def mixture(docs: DataFrame, entropy: float | None = None, limit: float = REPETITION_LIMIT) -> DataFrame:
    """A row for each use of a document: doc_id, source, n_tokens, epoch, weight, block, position."""
    uses = placed(stored(lengths_of(docs, quoted("doc_id").cast("long"))), entropy, limit)
    source = F.when(F.col("mix_source") != "null", F.substring("mix_source", 2, 1 << 30))
    return uses.select(F.col("mix_key").alias("doc_id"), source.alias("source"), F.col("mix_tokens").alias("n_tokens"), "epoch", "weight", "block", "position")


def mixed_documents(docs: DataFrame, entropy: float | None = None, limit: float = REPETITION_LIMIT) -> DataFrame:
    """The documents, each as often as its source's weight asks, with the columns of the input alone."""
    key, uses = free_name(docs, "_mix"), free_name(docs, "_uses")
    named = F.xxhash64(quoted("doc_id"), quoted("source").cast("string"), quoted("text"))
    placed_ = placed(stored(lengths_of(docs, named).distinct()), entropy, limit)
    often = placed_.groupBy("mix_key").agg(F.count(F.lit(1)).alias(uses)).withColumnRenamed("mix_key", key)
    out = docs.withColumn(key, named).join(often, key)
    return out.withColumn(uses, F.explode(F.sequence(F.lit(1), quoted(uses)))).select(*[quoted(c) for c in docs.columns])
