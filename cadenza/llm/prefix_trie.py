"""The trie of conversation prefixes: which conversations begin alike, and what sharing their prefixes saves.

A turn becomes a SHA-256 digest of its role and text (`numbered`), and a conversation the chain of its turns' digests, so
that equal prefixes of equal depth have equal digests (`chained`). Every prefix is a row; grouped by (depth, digest) they are
the nodes. For sums over subtrees each node would be exploded to all its ancestors: here the nodes that a conversation
stands for (those of which it is the least member) are added up from its end first, so that it sends each of its prefixes one
sum, not one for each pair (`trie`). The text itself is never shuffled.

No conversation, node or group has to fit a task. Turns are numbered after a range sort, whose tasks count on from those
before them. The chain is cut into blocks of `BLOCK` turns: within one it starts anew, and a prefix's digest is that of
the blocks before and of the chain in its own; only a row a block meets by conversation. A node's members are hashed in
ascending order as runs of `RUN` ids in one text each. Keys that hold many rows are joined by `hot_keys`.

Defined results: turns are ordered by turn, null first, and equal ones by their digest, so rows that repeat are turns of
their own; a null role or text is empty; rows without a conv_id belong to no conversation and are left out; an empty table
has no node at all; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .hot_keys import looked_up
from .shared import scratch, ship, stored

ship(__name__)

#: Turns in a block of the chain, and conversations in a run of a node's members.
BLOCK, RUN = 1024, 4096
#: The digest of no turns.
ROOT = hashlib.sha256(b"").digest()


def turn_digest() -> Column:
    """SHA-256 of role and text; the role's length keeps them apart."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, nth from 1, link, chars) of conversations(conv_id, turn, role, text). Stored."""
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), turn_digest().alias("link"), F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("chars"))
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("link")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, first, part = None, 0, True, TaskContext.get().partitionId()
        for batch in batches:
            at: list[int] = []
            for conv in batch.column("conv_id").to_pylist():
                if conv != last:
                    first, last, n = last is None, conv, 0
                n += 1
                at.append(n if not first else -n)  # of a partition's first conversation the count may have begun before it
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(at, pa.int64()), pa.array([part] * len(at), pa.int32()), batch.column("link"), batch.column("chars")], ["conv_id", "nth", "part", "link", "chars"])

    counted = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "conv_id long, nth long, part int, link binary, chars long"))
    # a row a partition: its first conversation, if that is in others too
    starts = F.broadcast(counted.where("nth = -1").select("conv_id").distinct())
    sizes = counted.join(starts, "conv_id", "left_semi").groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("conv_id", "part", (F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")).alias("before"))
    return counted.join(F.broadcast(before.where("before > 0")), ["conv_id", "part"], "left").select("conv_id", (F.abs("nth") + F.coalesce("before", F.lit(0))).alias("nth"), "link", "chars")


def lengths(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) of numbered turns."""
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))


def rebuilt(turns: DataFrame, of: Column, head: Column, longest: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first `head` turns are those of conversation `of`, and then their own after as many: numbered turns with `turns`, and (conv_id, turns).

    Both columns are of conv_id; a head has at most `longest` turns, and fewer where the other conversation does.
    """
    turns = stored(turns)
    heads = turns.where(F.col("nth") <= longest).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("nth", "link", "chars"))).alias("firsts"))
    convs = lengths(turns).withColumnRenamed("turns", "own").withColumns({"base": of, "head": head}).join(heads, "base", "left")
    convs = convs.withColumn("firsts", F.coalesce(F.slice("firsts", F.lit(1), F.col("head")), F.array().cast(heads.schema["firsts"].dataType)))
    convs = stored(convs.select("conv_id", "own", "head", "firsts", (F.size("firsts") + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("turns")))
    taken = convs.select("conv_id", "turns", F.explode("firsts").alias("f")).select("conv_id", "f.nth", "f.link", "f.chars", "turns")
    rest = looked_up(turns, convs.select("conv_id", "head", F.size("firsts").alias("got"), "turns", "own"), ["conv_id"], "own").where("nth > head")
    rest = rest.select("conv_id", (F.col("nth") - F.col("head") + F.col("got")).alias("nth"), "link", "chars", "turns")
    return taken.unionByName(rest), convs.select("conv_id", "turns")


PREFIX = "conv_id long, block long, depth long, own binary, before binary, chars long, turns long"


def chained(turns: DataFrame) -> DataFrame:
    """A row a prefix, without the empty ones: (conv_id, depth, digest, parent, chars, turns) of numbered turns with `turns`, their conversation's."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chain = None, b""
        for batch in batches:
            own, before = [], []
            for conv, block, link in zip(batch.column("conv_id").to_pylist(), batch.column("block").to_pylist(), batch.column("link").to_pylist(), strict=True):
                if (conv, block) != key:
                    key, chain = (conv, block), ROOT if block == 0 else b""
                before.append(chain)
                chain = hashlib.sha256(chain + link).digest()
                own.append(chain)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), batch.column("depth"), pa.array(own, pa.binary()), pa.array(before, pa.binary()), batch.column("chars"), batch.column("turns")], ["conv_id", "block", "depth", "own", "before", "chars", "turns"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, chain = None, b""
        for batch in batches:
            out = []
            for conv, own in zip(batch.column("conv_id").to_pylist(), batch.column("own").to_pylist(), strict=True):
                chain = hashlib.sha256(chain + own).digest() if conv == last else own
                last = conv
                out.append(chain)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), pa.array(out, pa.binary())], ["conv_id", "block", "until"])

    cut = turns.select("conv_id", F.expr(f"(nth - 1) div {BLOCK}").alias("block"), F.col("nth").alias("depth"), "link", "chars", "turns")
    inner = stored(cut.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "depth").mapInArrow(links, PREFIX))
    ends = inner.where(f"depth % {BLOCK} = 0 AND depth < turns").select("conv_id", (F.col("block") + 1).alias("block"), "own")
    until = ends.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(blocks, "conv_id long, block long, until binary")
    later = inner.where("block > 0").join(until, ["conv_id", "block"])
    whole = lambda own: F.when(F.octet_length(own) == 0, F.col("until")).otherwise(F.unhex(F.sha2(F.concat("until", own), 256)))
    names = ("conv_id", "depth", "digest", "parent", "chars", "turns")
    return inner.where("block = 0").select("conv_id", "depth", F.col("own").alias("digest"), F.col("before").alias("parent"), "chars", "turns").unionByName(later.select("conv_id", "depth", whole("own").alias("digest"), whole("before").alias("parent"), "chars", "turns").select(*names))


def ends_hashed(ends: DataFrame) -> DataFrame:
    """(depth, digest, ends_sha256) of ends(depth, digest, conv_id): of the ids in ascending order, comma-joined."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.int64(), pa.string()))], ["depth", "digest", "first", "ids"])

        for batch in batches:
            out = []
            for depth, digest, conv in zip(*(batch.column(c).to_pylist() for c in ("depth", "digest", "conv_id")), strict=True):
                if (depth, digest) != key or len(held) == RUN:
                    if held:
                        out.append((*key, held[0], ",".join(map(str, held))))
                    key, held = (depth, digest), []
                held.append(conv)
            yield rows(out)
        if held:
            yield rows([(*key, held[0], ",".join(map(str, held)))])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.string()))], ["depth", "digest", "ends_sha256"])

        for batch in batches:
            out = []
            for depth, digest, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "digest", "ids")), strict=True):
                if (depth, digest) == key:
                    state.update(b",")
                else:
                    if key:
                        out.append((*key, state.hexdigest()))
                    key, state = (depth, digest), hashlib.sha256()
                state.update(ids.encode())
            yield rows(out)
        if key:
            yield rows([(*key, state.hexdigest())])

    order = ["depth", "digest", "conv_id"]
    cut = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(runs, "depth long, digest binary, first long, ids string")
    return cut.repartition("depth", "digest").sortWithinPartitions("depth", "digest", "first").mapInArrow(whole, "depth long, digest binary, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row a node of numbered turns with `turns`, and of convs(conv_id, turns): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, digest.

    Conversations without turns are members of the root.
    """
    spark, key = turns.sparkSession, ["depth", "digest"]
    none = hashlib.sha256(b"").hexdigest()
    with scratch(spark):
        prefixes = stored(chained(turns))
        root = convs.agg(F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("digest"), F.lit(None).cast("binary").alias("parent"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("turns").alias("deepest"), F.lit(0).cast("long").alias("chars"))
        found = prefixes.groupBy(*key).agg(F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("turns").alias("deepest"), F.max("chars").alias("chars"))
        nodes = stored(root.unionByName(found).where("n_convs > 0").select("*", F.when(F.col("deepest") == F.col("depth"), 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saves")))

        # what a conversation stands for, from its end: within blocks, and the blocks after
        own = nodes.where("depth > 0").select("conv_id", "depth", F.lit(None).cast("binary").alias("digest"), "leaf", "saves")
        sent = prefixes.select("conv_id", "depth", "digest", F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saves")).unionByName(own).withColumn("block", F.expr(f"(depth - 1) div {BLOCK}"))
        below = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        inner = sent.select("conv_id", "block", *key, F.sum("leaf").over(below).alias("leaf"), F.sum("saves").over(below).alias("saves")).where("digest IS NOT NULL")
        totals = own.groupBy("conv_id", F.expr(f"(depth - 1) div {BLOCK}").alias("block")).agg(F.sum("leaf").alias("leaf"), F.sum("saves").alias("saves"))
        # of conversations of several blocks only
        long = prefixes.where(f"depth = {BLOCK + 1}").select("conv_id")
        spans = prefixes.where(f"turns > {BLOCK} AND (depth - 1) % {BLOCK} = 0").select("conv_id", F.expr(f"(depth - 1) div {BLOCK}").alias("block")).join(totals.join(long, "conv_id", "left_semi"), ["conv_id", "block"], "left")
        after = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
        later = spans.select("conv_id", "block", F.sum("leaf").over(after).alias("leaf_after"), F.sum("saves").over(after).alias("saves_after"))
        more = F.coalesce("leaf_after", F.lit(0)), F.coalesce("saves_after", F.lit(0))
        summed = inner.join(later, ["conv_id", "block"], "left").groupBy(*key).agg(F.sum(F.col("leaf") + more[0]).alias("n_leaves"), F.sum(F.col("saves") + more[1]).alias("saved_tokens"))
        everything = nodes.agg(F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("digest"), F.sum("leaf").alias("n_leaves"), F.sum("saves").alias("saved_tokens")).where("n_leaves IS NOT NULL")

        children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("n_children"))
        last = prefixes.where("depth = turns").select(*key, "conv_id").unionByName(convs.where("turns = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("digest"), "conv_id"))
        whole = nodes.join(summed.unionByName(everything), key, "left").join(children, key, "left").join(ends_hashed(last), key, "left")
        whole = stored(whole.select("conv_id", "depth", "digest", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")))
        parents = whole.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children").withColumnRenamed("n_children", "held")
        return stored(looked_up(whole, parents, ["depth", "parent"], "held").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "digest"), keep=True)


def shared_prefixes(conversations: DataFrame) -> DataFrame:
    """The trie of conversations(conv_id, turn, role, text) as they are; see `trie`."""
    with scratch(conversations.sparkSession):
        turns = numbered(conversations)
        convs = lengths(turns)
        return trie(looked_up(turns, convs.withColumn("held", F.col("turns")), ["conv_id"], "held"), convs)


def hundred_heads(conversations: DataFrame, longest: int = 6) -> DataFrame:
    """The trie of conversations rebuilt: conversation c begins with the first h turns of c - c % 100, h being crc32(c) % longest, and goes on with its own after as many."""
    with scratch(conversations.sparkSession):
        turns, convs = rebuilt(numbered(conversations), F.col("conv_id") - F.col("conv_id") % 100, (F.crc32(F.col("conv_id").cast("string").cast("binary")) % longest).cast("int"), longest - 1)
        return trie(turns, convs)
