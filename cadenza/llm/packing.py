"""Packing documents into sequences: shortest pack first over the histogram of lengths.

Documents become token ids (the tokenizer library's own ids, with an end id), are cut into full sequences and a rest,
and the histogram of piece lengths, at most one count a length, goes to the driver. There lengths are placed longest
first, each into the packs that are shortest so far; packs that have had the same placements are a range of sequence
numbers with one count, so a placement is a line "ranks r to r + k of length l go to sequences s to s + k at offset o".
Pieces then find their place by their rank among the pieces of their length. The lines number a few for each length,
whatever the number of documents.

A length may belong to a third of all pieces: ranks are counted within hashed parts of a length, whose offsets are
sums of the parts' counts. A length has as many parts as its pieces need, `PART_ROWS` in each.

Defined results: a null text is an empty one and gives just the end id; a null doc_id is kept; repeated rows are
packed each; ties in rank are broken arbitrarily between equal rows; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import heapq
import re
import sys
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import ship, stored, trimmed

ship(__name__)

SEQUENCE, END_ID, PART_ROWS = 4096, 2, 8192
TOKENIZER = "word_bpe_49k.json"
#: Entries in a worker's memory of encoded pieces and runs, and the characters of the longest; others are encoded anew each time.
MEMORY, LONGEST = 200_000, 32
#: What may be split at changes between letters, digits and the rest without changing its ids: ASCII without the apostrophe, and precomposed letters of Latin-1, none of which combines with another.
PLAIN = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+")
RUNS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^A-Za-zÀ-ÖØ-öø-ÿ0-9]+")


def tokenizer_path(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Encoder(dict):
    """From a piece between blanks, or a run within one, to the bytes of its ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shifted = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in printable)}
        self.bytes_as = {c: "".join(chr(shifted.get(b, b)) for b in chr(c).encode()) for c in [*range(33, 127), *range(192, 256)]}

    def __missing__(self, piece: str) -> bytes:
        if "<|" not in piece and PLAIN.fullmatch(piece):
            runs = RUNS.findall(piece.lower())
            out = self.run(piece) if runs == [piece] else b"".join(map(self.__getitem__, runs))
        else:
            out = b"".join([i.to_bytes(4, "little") for i in self.whole.encode(piece, add_special_tokens=False).ids])
        if len(self) < MEMORY and len(piece) <= LONGEST:
            self[piece] = out
        return out

    def run(self, w: str) -> bytes:
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(w.translate(self.bytes_as))])

    def ids(self, text: str) -> bytes:
        """Blanks and line feeds never lie in a token nor combine with letters, so texts may be cut there."""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def encoder(name: str) -> Encoder:
    """One for a worker process, kept between tasks."""
    held = sys.__dict__.setdefault("_cadenza_encoders", {})
    if name not in held:
        held[name] = Encoder(tokenizer_path(name))
    return held[name]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, size: int = SEQUENCE) -> DataFrame:
    """Full pieces and a rest of each document: doc_id, start, length, ids_crc32, doc_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), END_ID.to_bytes(4, "little")
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = memoryview(enc.ids(text.as_py() or "") + end)
                n = len(ids) // 4
                for a in range(0, n, size):
                    b = min(n, a + size)
                    for o, v in zip(out, (doc, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), n), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(run), PIECES)


def placements(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Lines (length, first rank, count, first sequence, offset)."""
    packs: list[tuple[int, int, int]] = []  # (tokens so far, first sequence, count)
    lines, opened = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left and packs and packs[0][0] + length <= size:
            filled, first, count = heapq.heappop(packs)
            k = min(count, left)
            lines.append((length, rank, k, first, filled))
            heapq.heappush(packs, (filled + length, first, k))
            if k < count:
                heapq.heappush(packs, (filled, first + k, count - k))
            rank, left = rank + k, left - k
        fit = size // length
        for each, count in ((fit, left // fit), (left % fit, 1)) if left else ():
            if each and count:
                for j in range(each):
                    lines.append((length, rank, count, opened, j * length))
                    rank += count
                heapq.heappush(packs, (each * length, opened, count))
                opened += count
    return lines


LINES = pa.list_(pa.struct([(name, pa.int64()) for name in ("rank", "count", "first", "at")]))


def packed(docs: DataFrame, tokenizer: str = TOKENIZER, size: int = SEQUENCE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer, size))
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `size` rows
    lines: dict[int, list] = {}
    for length, rank, count, first, offset in placements(histogram, size):
        lines.setdefault(length, []).append((rank, count, first, offset))
    # Arrow tables are local relations; lists of rows would start Python workers beside those that encode
    plan = spark.createDataFrame(pa.table({"length": pa.array(lines, pa.int64()), "lines": pa.array(lines.values(), LINES)}))
    parts = spark.createDataFrame(pa.table({"length": pa.array(histogram, pa.int64()), "parts": pa.array([-(-n // PART_ROWS) for n in histogram.values()], pa.int64())}))
    cut = cut.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), F.col("parts"))).drop("parts")
    counts = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = cut.withColumn("nth", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")))
    ranked = ranked.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth") - 1)
    placed = ranked.join(F.broadcast(plan), "length").withColumn("line", F.element_at(F.filter("lines", lambda x: (x["rank"] <= F.col("rank")) & (F.col("rank") < x["rank"] + x["count"])), 1))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("line.first") + F.col("rank") - F.col("line.rank")).alias("sequence_id"), F.col("line.at").alias("offset"))
