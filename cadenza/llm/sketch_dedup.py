"""Near copies by word shingles: fast similarity sketches, banding, exact verification.

A sketch has `BINS` coordinates. In round r every element of the set is placed by a fresh hash into one bin, and
each bin that is still empty keeps its least hash; after BINS rounds, round BINS + j puts every element into bin j,
so that every coordinate is full whatever the set's size. Equal coordinates estimate the Jaccard similarity with the
concentration of minwise hashing. Bands of five coordinates deal out candidates; links are confirmed on full sets.

Skew: sets that are equal form one class before anything is paired (a partial aggregate). Shingles that a class shares
with no other candidate bound its similarity to all of them; classes that this rules out of a band leave it. In a band
each class is compared with a pivot first, the class that has the least of its own; members that this leaves in
different components are compared with each other only if bounds from those comparisons allow the similarity
(`still_apart`). So neither copies nor near copies make all pairs, and no link between components is lost.

Defined results: a null text is an empty one; a text without words has an empty set and links with nothing; a null
doc_id gets a null component_id and stays; rows that repeat a doc_id are judged each by its own text, as a class is
known by its set and not by a doc_id; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, quoted, scratch, ship, stars, stored, trimmed

ship(__name__)

BINS, BIN_BITS = 128, 7
BANDS, BAND_ROWS = 25, 5
CHUNK = 1 << 18

SEEDS = np.random.default_rng(20260101).integers(1, 2**64, 2 * BINS, dtype=np.uint64, endpoint=False)
LETTERS = np.random.default_rng(20260102).integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
STEPS = np.random.default_rng(20260103).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BREAK = np.zeros(256, dtype=bool)
BREAK[[32, 9, 10, 11, 12, 13]] = True
LETTERS[BREAK] = 0
LETTERS = LETTERS[LOWER]
POWER, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Sets of hashed word shingles, for many texts at a time."""

    def __init__(self, words: int):
        self.words, self.up, self.down = words, powers(POWER, 1 << 14), powers(INVERSE, 1 << 14)

    def hashes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A hash of each word of all texts; where the words of each text begin among them (one entry more)."""
        raw = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
        if len(raw) > len(self.up):
            self.up, self.down = powers(POWER, 2 * len(raw)), powers(INVERSE, 2 * len(raw))
        gap = BREAK[raw]
        starts = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
        begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        if not len(starts):
            return np.zeros(0, np.uint64), np.zeros(len(begins), np.int64)
        sums = np.add.reduceat(LETTERS[raw] * self.up[: len(raw)], starts)
        return mix(sums * self.down[starts]), np.searchsorted(starts, begins)

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """Of each text the sorted distinct shingles; with fewer words, all of them as one."""
        k = self.words
        words, at = self.hashes(texts)
        n = max(0, len(words) - k + 1)
        rolled = np.zeros(n, np.uint64)
        for j in range(k):
            rolled += words[j : n + j] * STEPS[j]
        rolled = mix(rolled)
        out = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= k:
                out.append(np.unique(rolled[a : b - k + 1]))
            else:
                out.append(mix(np.array([(words[a:b] * STEPS[: b - a]).sum(dtype=np.uint64)], np.uint64) + STEPS[63 - (b - a)]) if b > a else np.zeros(0, np.uint64))
        return out

    def by_chunk(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        part, size = [], 0
        for t in texts:
            part.append(t or b"")
            size += len(t or b"")
            if size >= CHUNK:
                yield from self.sets(part)
                part, size = [], 0
        if part:
            yield from self.sets(part)


def sketch(elements: np.ndarray) -> np.ndarray:
    """The BINS coordinates of a set that isn't empty."""
    out, empty = np.zeros(BINS, np.uint64), np.ones(BINS, bool)
    shift, left = np.uint64(64 - BIN_BITS), BINS
    for r in range(2 * BINS):
        h = mix(elements ^ SEEDS[r])
        if r < BINS:
            bins = (h >> shift).astype(np.int64)
            if r:
                h = h[empty[bins]]
            if not len(h):
                continue
            h.sort()
            bins = (h >> shift).astype(np.int64)
            first = np.concatenate(([True], bins[1:] != bins[:-1]))
            at = bins[first]
            out[at] = mix(h[first] + SEEDS[r])
            empty[at] = False
            left -= len(at)
        elif empty[r - BINS]:
            out[r - BINS] = mix(h.min(keepdims=True) + SEEDS[r])[0]
            empty[r - BINS] = False
            left -= 1
        if not left:
            break
    return out


def bands(coordinates: np.ndarray) -> np.ndarray:
    rows = coordinates[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
    return mix((rows * STEPS[:BAND_ROWS]).sum(axis=1, dtype=np.uint64) + SEEDS[:BANDS]).view(np.int64)


SIGNATURE = "doc_id long, page long, n_shingles long, set_key binary, bands array<bigint>"


def page_of(docs: DataFrame) -> Column:
    """Equal for equal texts; with the doc_id it tells a row's text among rows that repeat the doc_id."""
    return F.xxhash64(quoted("text").cast("string"))


def paged(docs: DataFrame) -> DataFrame:
    return docs.select(quoted("doc_id").cast("long").alias("doc_id"), page_of(docs).alias("page"), quoted("text").cast("string").alias("text"))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """One row per document: a hash of its text, size and digest of its set, and its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            for a in range(0, len(batch), 512):
                ids, pages, sizes, keys, parts = batch.column("doc_id").slice(a, 512), batch.column("page").slice(a, 512), [], [], []
                for s in shingler.by_chunk(texts.slice(a, 512).to_pylist()):
                    sizes.append(len(s))
                    if len(s):
                        keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                        parts.append(bands(sketch(s)))
                    else:
                        keys.append(None), parts.append(None)
                yield pa.RecordBatch.from_arrays([ids, pages, pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(parts, pa.list_(pa.int64()))], ["doc_id", "page", "n_shingles", "set_key", "bands"])

    return paged(docs).mapInArrow(trimmed(run), SIGNATURE)


def lone_shingles(texts: DataFrame, words: int) -> DataFrame:
    """(node, lone): how many shingles of each of texts(node, text) no other of them has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                sets = list(shingler.by_chunk(part.column("text").cast(pa.large_binary()).to_pylist()))
                ids = np.repeat(part.column("node").to_numpy(), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(sets).view(np.int64))], ["node", "shingle"])

    rows = texts.select("node", "text").mapInArrow(trimmed(run), "node long, shingle long")
    return rows.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("other")).where("node = other").groupBy("node").agg(F.count(F.lit(1)).alias("lone"))


COMPARED = "a long, b long, linked boolean, size_a long, size_b long, common long, delta array<bigint>"


def compared(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Of pairs(a, b), on full sets: whether 100 * intersection >= percent * union, the sizes, and what b has beyond a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last, own = Shingler(words), None, None
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                a_text, b_text = (batch.column(c).cast(pa.large_binary()).to_pylist() for c in ("text_a", "text_b"))
                rows = []
                for ta, tb in zip(a_text, b_text, strict=True):
                    if last != ta:
                        last, own = ta, shingler.sets([ta])[0]
                    other = shingler.sets([tb])[0]
                    delta = np.setdiff1d(other, own, assume_unique=True)
                    both = len(other) - len(delta)
                    rows.append((both > 0 and 100 * both >= percent * (len(own) + len(other) - both), len(own), len(other), both, delta.view(np.int64)))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(cols[0], pa.bool_()), *[pa.array(c, pa.int64()) for c in cols[1:4]], pa.array(cols[4], pa.list_(pa.int64()))], ["a", "b", "linked", "size_a", "size_b", "common", "delta"])

    full = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return full.select("a", "b", "text_a", "text_b").mapInArrow(trimmed(run), COMPARED)


def still_apart(tested: DataFrame, found: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one pivot, in different components, that can have the similarity.

    What two members share beyond the pivot is in both their deltas. If the deltas are disjoint, what each has in
    common with the pivot bounds their intersection; so a pair either shares a shingle of its deltas, which a join on
    it finds, or its sizes must fit. Both kinds must also obey the triangle inequality of the Jaccard distance, and the
    bound from shingles that no other candidate has.
    """
    of = lambda df, c, name: df.join(found.select(F.col("src").alias(c), F.col("dst").alias(name)), c, "left").withColumn(name, F.coalesce(name, c))
    rows = of(of(tested, "b", "label"), "a", "label_a").join(known.select(F.col("node").alias("b"), F.col("common").alias("not_lone")), "b")
    distance = 1 - F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common"))
    room = lambda c: (100 + percent) * F.col(c) - percent * F.col("size_b")
    rows = rows.withColumns({"distance": distance, "room": room("common"), "lone_room": room("not_lone"), "stray": F.col("label") != F.col("label_a")})
    rows = stored(rows.join(rows.where("stray").select("a").distinct(), "a", "left_semi").select("a", F.col("b").alias("x"), "label", "stray", F.col("size_b").alias("size"), "distance", "room", "lone_room", "delta"))
    plain = rows.drop("delta")
    least = rows.groupBy("a").agg(F.min("size").alias("least"))

    def met(left: DataFrame, right: DataFrame, on: list[str], sizes: bool) -> DataFrame:
        r = right.select(*on, *[F.col(c).alias(f"{c}_r") for c in ("x", "label", "size", "distance", "room", "lone_room")])
        fits = (F.col("label") != F.col("label_r")) & (F.abs(F.col("distance") - F.col("distance_r")) <= 1 - percent / 100 + 1e-9)
        for name in ("lone_room", *(["room"] if sizes else [])):
            fits = fits & (percent * F.col("size_r") <= F.col(name)) & (percent * F.col("size") <= F.col(f"{name}_r"))
        return left.join(r, on).where(fits).select(F.least("x", "x_r").alias("a"), F.greatest("x", "x_r").alias("b"))

    parts = rows.select("a", "x", "label", "stray", "size", "distance", "room", "lone_room", F.explode("delta").alias("s"))
    shared = met(parts.where("stray"), parts, ["a", "s"], False)
    able = plain.join(least, "a").where(percent * F.col("least") <= F.col("room")).drop("least")
    sized = met(able.where("stray"), able, ["a"], True)
    return shared.unionByName(sized).distinct()


def texts_of(docs: DataFrame, met: DataFrame) -> DataFrame:
    """(node, text) of the classes met(node, rep, page): one text each, the class's least doc_id's."""
    found = stored(paged(docs).join(met.select(F.col("rep").alias("doc_id"), "page", "node").distinct(), ["doc_id", "page"]).select("node", "text"))
    if found.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").head(1):
        # rows that are the same in both come once
        return stored(found.groupBy("node").agg(F.first("text").alias("text")))
    return found


def near_rows(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, page, n_shingles, component_id, and the number of its group (null without a set or a doc_id). Stored."""
    with scratch(docs.sparkSession):
        signed = stored(signatures(docs, words))
        grouped = signed.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min(F.struct("doc_id", "page")).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
        # a class is a node; its number is fixed as it is written
        classes = stored(grouped.select(F.monotonically_increasing_id().alias("node"), "set_key", F.col("first.doc_id").alias("rep"), F.col("first.page").alias("page"), "n_shingles", "bands"))
        dealt = classes.select("node", "set_key", F.explode("bands").alias("h"))
        buckets = dealt.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
        met = stored(dealt.join(buckets, "h"))
        texts = texts_of(docs, classes.select("node", "rep", "page").join(met.select("node").distinct(), "node"))
        # shingles that no other candidate has are in no intersection: what is left bounds the similarity from above
        known = stored(classes.select("node", F.col("n_shingles").alias("size")).join(lone_shingles(texts, words), "node", "left").select("node", "size", (F.col("size") - F.coalesce("lone", F.lit(0))).alias("common")))
        sized = met.join(known, "node")
        least = sized.groupBy("h").agg(F.min("size").alias("least"))
        able = sized.join(least, "h").where((100 + percent) * F.col("common") >= percent * (F.col("size") + F.col("least")))
        # the pivot of a bucket is the member with the least of its own: the text that the others were made from
        pivots = able.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((1 - F.col("common") / F.col("size")).alias("own"), "set_key", "node")).alias("p")).where("n > 1").select("h", F.col("p.node").alias("a"))
        tried = stored(able.select("h", "node").join(pivots, "h").where("node <> a").select("a", F.col("node").alias("b")).distinct())
        tested = stored(compared(tried, texts, words, percent))
        links = tested.where("linked").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        found = stars(links)
        apart = still_apart(tested, found, known, percent).join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
        more = stored(compared(stored(apart), texts, words, percent).where("linked").select(F.col("a").alias("src"), F.col("b").alias("dst")))
        if more.head(1):
            found = stars(found.unionByName(more))
        # the least doc_id of the component's classes
        labelled = classes.select("node", "set_key", "rep").join(found.select(F.col("src").alias("node"), "dst"), "node", "left").select("set_key", "rep", F.coalesce("dst", "node").alias("group"))
        whole = labelled.join(labelled.groupBy("group").agg(F.min("rep").alias("component_id")), "group").select("set_key", "group", "component_id")
        out = signed.select("doc_id", "page", "n_shingles", "set_key").join(whole, "set_key", "left")
        return stored(out.select("doc_id", "page", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), F.when(F.col("doc_id").isNotNull(), F.col("group")).alias("group")), keep=True)


def near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable by links), kept."""
    rows = near_rows(docs, words, percent)
    return rows.select("doc_id", "n_shingles", "component_id", (F.coalesce("component_id", F.lit(0)) == F.coalesce("doc_id", F.lit(0))).alias("kept"))


def without_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group stays, the first of least doc_id, with the columns of the input; rows that repeat one go.

    Documents without words, and those without a doc_id, are copies of nothing; of rows that are equal in doc_id and text one stays.
    """
    rows = near_rows(docs, words, percent)
    d, p = (free_name(docs, x) for x in ("_doc", "_page"))
    keyed = docs.withColumn(d, quoted("doc_id").cast("long")).withColumn(p, page_of(docs))
    if rows.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n")).where("n > 1").head(1):
        keyed = keyed.dropDuplicates([d, p])
    able = rows.where("group IS NOT NULL").select("group", "doc_id", "page").distinct()
    firsts = able.groupBy("group").agg(F.min(F.struct("doc_id", "page")).alias("first"))
    gone = able.join(firsts, "group").where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("page") != F.col("first.page"))).select(F.col("doc_id").alias(d), F.col("page").alias(p))
    return keyed.join(gone, [d, p], "left_anti").select(*[quoted(c) for c in docs.columns])
