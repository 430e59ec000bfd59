"""Passages that repeat across or within documents: content-defined chunks.

A gear hash rolls over the UTF-8 bytes: h = 2 h + gear[byte], of which the low bits depend on the last `GEAR` bytes.
A chunk ends where the hash's `MASK_BITS` bits are zero, so the cuts inside a passage depend on the passage alone and
return after an insertion. Chunks are known by a 64-bit digest. A chunk that occurs more than once is a copy at every
occurrence but the first (in the document of least doc_id, there the first). Copies that touch or overlap make a span, and spans of `LEAST_BYTES`
or more count, chance repeats of a few words don't.

`without_copies` returns the texts without the copied chunks of such spans; `repeated_passages` reports the spans.

Cuts alone give no bound: a passage can hold few whole chunks, or none. So runs of `SEED` words are known by digests too.
Of any `SEED` such runs side by side the least digest is taken, in whatever text they stand, so a passage of
2 * SEED - 1 = 51 words always holds one that all its occurrences take. A span with a repeated seed counts whatever its bytes.
Blanks between a seed's words may differ. A span's ends are those of its chunks and seeds, not exact to the word.

Skew: counts and first places of digests are partial aggregates; occurrences meet them in a join that adaptive
execution can split; texts are never shuffled.

Every text is judged by itself: its chunks are gathered by doc_id and a checksum of the text, and texts without a doc_id by a
digest of their own, so that no group is larger than a text.

Defined results: a null or empty text has no chunks; texts that repeat a doc_id have spans of their own, but equal chunks in
them aren't copies of each other; texts without a doc_id are documents of their own and sort first, by their digest, and equal
ones count once; a doc_id under -2^62 counts as none; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, quoted, ship

ship(__name__)

GEAR, MASK_BITS, LEAST_BYTES, SEED, LEAST_CUT = 16, 5, 256, 26, 64
TABLE = np.random.default_rng(20260401).integers(0, 2**32, 256, dtype=np.uint32)
LETTERS = np.random.default_rng(20260402).integers(1, 2**64, 256, dtype=np.uint64)
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Under this are the keys of texts without a doc_id.
LEAST_ID = -(1 << 62)
POWER = 0x9E3779B97F4A7C15
INVERSE = pow(POWER, -1, 2**64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sliding(of: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """of (minimum or maximum) over every `width` values side by side."""
    span = 1
    while 2 * span <= width:
        x, span = of(x[:-span], x[span:]), 2 * span
    return of(x[: len(x) - width + span], x[width - span :]) if span < width else x


def spaced(at: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Which seeds stay. Of equal ones close by, as in a text that repeats a word, one in each window does."""
    order = np.lexsort((at, digests))
    p, d = at[order], digests[order]
    close = np.flatnonzero((d[1:] == d[:-1]) & (p[1:] - p[:-1] < SEED))
    keep = np.ones(len(at), bool)
    last, upto = 0, -2
    for i in close.tolist():  # the pair i, i + 1
        if i != upto:
            last = p[i]
        elif p[i + 1] - last <= SEED:
            keep[order[i]] = False
        else:
            last = p[i]
        upto = i + 1
    return keep


class Chunker:
    def __init__(self):
        self.up, self.down = powers(POWER, 1 << 16), powers(INVERSE, 1 << 16)

    def chunks(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the chunks, in bytes, and their digests."""
        raw = np.frombuffer(text, np.uint8)
        if len(raw) > len(self.up):
            self.up, self.down = powers(POWER, 2 * len(raw)), powers(INVERSE, 2 * len(raw))
        h, span = TABLE[raw], 1
        while span < GEAR:  # the hash of 2 * span bytes from two of span
            h[span:] = h[span:] + (h[:-span] << np.uint32(span))
            span *= 2
        cut = ((h >> np.uint32(GEAR - MASK_BITS)) & np.uint32((1 << MASK_BITS) - 1)) == 0
        cut[-1] = True
        ends = np.flatnonzero(cut) + 1
        starts = np.concatenate(([0], ends[:-1]))
        sums = np.add.reduceat(LETTERS[raw] * self.up[: len(raw)], starts)
        return ends, mix(sums * self.down[starts] + (ends - starts).astype(np.uint64)).view(np.int64)

    def seeds(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the seeds, in bytes, and their digests. After `chunks` of the text, which sizes the powers."""
        raw = np.frombuffer(text, np.uint8)
        blank = BLANK[raw]
        edges = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True]))))
        starts, ends = edges[::2], edges[1::2]
        n = len(starts)
        if n < 2 * SEED - 1:
            return starts[:0], starts[:0], starts[:0]
        sums = np.add.reduceat(np.where(blank, np.uint64(0), LETTERS[raw]) * self.up[: len(raw)], starts)
        words = mix(sums * self.down[starts] + (ends - starts).astype(np.uint64))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * self.up[:n])))
        runs = mix((total[SEED:] - total[:-SEED]) * self.down[: n - SEED + 1])
        least = sliding(np.minimum, runs, SEED)
        none = np.zeros(SEED - 1, np.uint64)
        # a run is taken if it is the least of a window that holds it
        at = np.flatnonzero(runs == sliding(np.maximum, np.concatenate((none, least, none)), SEED))
        at = at[spaced(at, runs[at])]
        return starts[at], ends[at + SEED - 1], (~runs[at]).view(np.int64)


def text_key(doc: int | None, text: bytes) -> tuple[int, int]:
    """What stands for a text: its doc_id, or without one a digest under LEAST_ID; and a checksum that tells texts of one doc_id apart."""
    if doc is None or doc < LEAST_ID:
        return -(1 << 63) + (int.from_bytes(hashlib.blake2b(text, digest_size=8).digest()) >> 2), 0
    return doc, zlib.crc32(text) & 0xFFFFFF


def chunk_rows(docs: DataFrame) -> DataFrame:
    """doc_id and page (see `text_key`), and of each chunk and seed its digest and `at`: start and length in bytes, whether the document had it before, whether it is a seed.

    `at` packs them in 31, 31, 1 and 1 bits, as these are the most rows there are, and sorts by start.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunker = Chunker()
        for batch in batches:
            for a in range(0, len(batch), 512):
                ids = batch.column("doc_id").slice(a, 512).to_pylist()
                parts = []
                for doc, text in zip(ids, batch.column("text").slice(a, 512).cast(pa.large_binary()).to_pylist(), strict=True):
                    if text:
                        ends, digests = chunker.chunks(text)
                        doc, page = text_key(doc, text)
                        for seed, start, end, own in ((0, np.concatenate(([0], ends[:-1])), ends, digests), (1, *chunker.seeds(text))):
                            again = np.ones(len(end), np.int64)
                            again[np.unique(own, return_index=True)[1]] = 0
                            parts.append((np.full(len(end), doc), np.full(len(end), page, np.int32), start.astype(np.int64) << 33 | (end - start).astype(np.int64) << 2 | again << 1 | seed, own))
                if parts:
                    doc, page, at, digest = (np.concatenate(c) for c in zip(*parts, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(page), pa.array(at), pa.array(digest)], ["doc_id", "page", "at", "digest"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, page int, at long, digest long")


SPANS = "doc_id long, page long, start long, end long, copied long, copies_of array<bigint>, known array<bigint>, again array<bigint>"


def merged(docs: np.ndarray, pages: np.ndarray, sizes: np.ndarray, at: np.ndarray, first: np.ndarray, digest: np.ndarray, least_bytes: int) -> list[list]:
    """The columns of SPANS from the repeated chunks and seeds of documents, side by side, each document's in the order of their starts."""
    out: list[list] = [[] for _ in range(8)]
    if not len(at):
        return out
    doc = np.repeat(np.arange(len(docs)), sizes)
    start, length, again, seed = at >> 33, (at >> 2) & (2**31 - 1), (at >> 1) & 1, (at & 1).astype(bool)
    own = docs[doc]
    copy = (again == 1) | (first < own)
    base = doc.astype(np.int64) << 32  # places of one document lie beyond those of the one before
    low, high = base + start, base + start + length
    reach = np.maximum.accumulate(high)
    cuts = np.flatnonzero(np.concatenate(([True], (low[1:] > reach[:-1]) | (doc[1:] != doc[:-1]))))
    # bytes that several copies hold count once
    held = np.maximum.accumulate(np.where(copy, high, base))
    fresh = np.where(copy, np.maximum(0, high - np.maximum(low, np.concatenate(([0], held[:-1])))), 0)
    ends = np.concatenate((cuts[1:], [len(at)]))
    left, right = low[cuts], np.maximum.reduceat(high, cuts)
    copied, seeded = np.add.reduceat(fresh, cuts), np.logical_or.reduceat(seed, cuts)
    for k in np.flatnonzero((right - left >= least_bytes) | seeded):
        a, b = cuts[k], ends[k]
        me = int(own[a])
        mine = copy[a:b]
        of = np.unique(first[a:b][mine])
        chunk = mine & ~seed[a:b]
        other = first[a:b] != me
        known = me >= LEAST_ID
        row = (me if known else None, int(pages[doc[a]]) if known else me, int(left[k] - base[a]), int(right[k] - base[a]), int(copied[k]), of[of >= LEAST_ID].tolist(), *(np.unique(digest[a:b][chunk & side]).tolist() for side in (other, ~other)))
        for o, v in zip(out, row, strict=True):
            o.append(v)
    return out


def copied_spans(docs: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """doc_id, page (tells the texts of one doc_id, or of none, apart), start, end (bytes of the text), copied, copies_of, known, again: every run of repeated chunks and seeds.

    copied: the bytes that are copies; 0 for a passage that is nowhere earlier. copies_of: the documents that hold
    the copied chunks and seeds first. known: the copied chunks that an earlier document holds; again: those that this
    one holds first and repeats.
    """
    rows = chunk_rows(docs)
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc <> last_doc").select("digest", "first_doc")
    hit = rows.join(firsts, "digest", "left").where("first_doc IS NOT NULL OR at & 2 <> 0")
    # all of a text's repeated chunks and seeds: at most its own
    per = hit.groupBy("doc_id", "page").agg(F.array_sort(F.collect_set(F.struct("at", F.coalesce("first_doc", "doc_id").alias("first_doc"), "digest"))).alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("c")
            flat = lists.flatten()
            sizes = np.diff(lists.offsets.to_numpy())
            columns = [flat.field(k).to_numpy() for k in range(3)]
            out = merged(batch.column("doc_id").to_numpy(), batch.column("page").to_numpy(), sizes, *columns, least_bytes)
            kinds = (*[pa.int64()] * 5, *[pa.list_(pa.int64())] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds, strict=True)], ["doc_id", "page", "start", "end", "copied", "copies_of", "known", "again"])

    return per.mapInArrow(run, SPANS)


def without_copies(docs: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """The documents without the copied chunks of their repeated spans, with the columns of the input, n_chars renewed.

    A chunk that an earlier document holds goes; one that this document holds first stays once.
    Chunks are cut from the text anew, so rows that repeat a doc_id lose only what they hold. Cuts move to the next
    character. Documents without such spans, null texts and null ids stay as they are.
    """
    spans = copied_spans(docs, least_bytes).where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("known", "again")])
    d, known, again = (free_name(docs, x) for x in ("_doc", "_known", "_again"))
    joined = docs.withColumn(d, quoted("doc_id").cast("long")).join(spans.withColumnsRenamed({"doc_id": d, "known": known, "again": again}), d, "left").drop(d)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunker = Chunker()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).cast(pa.large_binary()).to_pylist()
            for i, (k, a) in enumerate(zip(batch.column(known).to_pylist(), batch.column(again).to_pylist(), strict=True)):
                if texts[i] and (k or a):
                    texts[i] = cut_text(chunker, texts[i], set(k or ()), set(a or ()))
            cut = pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(pa.string())
            columns_ = [cut if n == at else batch.column(n) for n in range(len(columns))]
            yield pa.RecordBatch.from_arrays(columns_, schema=pa.schema([batch.schema.field(n).with_type(columns_[n].type) for n in range(len(columns))]))

    out = joined.withColumn("text", quoted("text").cast("string")).mapInArrow(run, docs.withColumn("text", quoted("text").cast("string")).schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else out


def cut_text(chunker: Chunker, text: bytes, known: set[int], again: set[int]) -> bytes:
    """The text without runs of copied chunks; runs of under LEAST_CUT bytes, which chance makes, stay."""
    ends, digests = chunker.chunks(text)
    seen: set[int] = set()
    gone: list[list[int]] = []
    start = 0
    for end, digest in zip(ends.tolist(), digests.tolist(), strict=True):
        if digest in known or digest in again and digest in seen:
            if gone and gone[-1][1] == start:
                gone[-1][1] = end
            else:
                gone.append([start, end])
        seen.add(digest)
        start = end
    parts, start = [], 0
    for a, b in gone:
        if b - a >= LEAST_CUT:
            # ends inside a character move to its end
            while a < len(text) and text[a] & 0xC0 == 0x80:
                a += 1
            while b < len(text) and text[b] & 0xC0 == 0x80:
                b += 1
            parts.append(text[start:a])
            start = b
    return b"".join([*parts, text[start:]])


def repeated_passages(docs: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """A row per text that shares or repeats passages: doc_id, n_spans, n_bytes, n_copied_bytes, spans (start:end, comma-joined), copies_of (ids)."""
    text = F.format_string("%d:%d", "start", "end")
    return copied_spans(docs, least_bytes).groupBy("doc_id", "page").agg(
        F.count(F.lit(1)).alias("n_spans"),
        F.sum(F.col("end") - F.col("start")).alias("n_bytes"),
        F.sum("copied").alias("n_copied_bytes"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", text.alias("t")))), lambda x: x["t"]), ",").alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("copies_of")))).alias("copies_of"),
    ).drop("page")
