"""Product codes of vectors: Lloyd's rounds whose sums are kept up to date by what moved.

A vector becomes integers, floor(scale * x), and is cut into equal parts; each part's position has a codebook of its own.
The assignments of the round before are stored beside the vectors, and the sums and counts of every entry are kept from
round to round: a round reads the vectors once, assigns their parts, and sends a plus for the entry that a part came to and
a minus for the one that it left, added up where it runs. Parts that stay send nothing. All arithmetic is in integers, so the
sums are exact and the codebooks don't depend on the order of the rows. What reaches the driver is a row an entry.

Defined results: rows whose vector is null, empty, holds a null or a non-finite component, or isn't as long as that of the
least vec_id whose length is a multiple of the parts are left out; integers beyond +-2^27 count as +-2^27, so that no distance overflows; fewer vectors than entries give as many entries; entries that no part
chose stay; equal distances go to the lower entry; null vec_ids come last; rows that repeat are coded each; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hot_keys import looked_up
from .shared import discard, scratch, ship, stored, trimmed

ship(__name__)

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Beyond this an integer counts as this.
LIMIT = 1 << 27
#: Vectors whose distances a task holds at a time.
ROWS = 2048
#: No entry yet.
NONE = 255

#: By part and entry; a column a component.
Books = np.ndarray

STATE = "vec_id long, label string, ints array<int>, codes binary"
SENT = "part int, entry int, rows long, sums array<long>"


def integers(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """(vec_id, label, ints) of vectors(vec_id, embedding, label) that can be coded."""
    x = F.col("embedding").cast("array<double>")
    sound = F.coalesce(F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))), F.lit(False))
    ints = F.transform(x, lambda v: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), v * float(scale)))).cast("int"))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.when(sound, ints).alias("ints")).where("ints IS NOT NULL")
    able = rows.where((F.size("ints") > 0) & (F.size("ints") % parts == 0))
    size = able.agg(F.min(F.struct(F.col("vec_id").isNull(), "vec_id", F.size("ints"))).alias("s")).select(F.col("s.col3").alias("size"))
    return able.join(F.broadcast(size), F.size("ints") == F.col("size")).drop("size")  # one row


def first_books(rows: DataFrame, parts: int, entries: int) -> Books | None:
    """The parts of the vectors of least vec_id."""
    least = rows.orderBy(F.asc_nulls_last("vec_id"), "ints").limit(entries).select("ints").collect()
    if not least:
        return None
    return np.array([r.ints for r in least], np.int64).reshape(len(least), parts, -1).transpose(1, 0, 2)


def nearest(ints: np.ndarray, books: Books) -> tuple[np.ndarray, np.ndarray]:
    """Of each row and part the nearest entry, the lower of equal ones, and the squared distance. ints: (rows, parts, components)."""
    codes, least = np.empty(ints.shape[:2], np.uint8), np.empty(ints.shape[:2], np.int64)
    for p in range(ints.shape[1]):
        part = ints[:, p]
        far = np.stack([((part - e) ** 2).sum(axis=1) for e in books[p]], axis=1)
        codes[:, p] = far.argmin(axis=1)
        least[:, p] = np.take_along_axis(far, codes[:, p, None].astype(np.int64), 1)[:, 0]
    return codes, least


def cut(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    return batch.column("ints").flatten().to_numpy().astype(np.int64).reshape(len(batch), parts, -1)


def moved(ints: np.ndarray, before: np.ndarray, codes: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """By part and entry how many parts came, less those that left, and the sum of their components alike."""
    parts, width = ints.shape[1:]
    rows, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
    for p in range(parts):
        changed = codes[:, p] != before[:, p]
        left = changed & (before[:, p] != NONE)
        for sign, which, at in ((1, changed, codes), (-1, left, before)):
            to = at[which, p].astype(np.int64)
            np.add.at(rows[p], to, sign)
            np.add.at(sums[p], to, sign * ints[which, p])
    return rows, sums


def reassigned(state: DataFrame, books: Books) -> DataFrame:
    """A round: rows of the state with new codes, and besides them what a task has to send, a row an entry that changed."""
    parts, entries, _ = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rows, sums = [*(c.split()[0] for c in f"{STATE}, {SENT}".split(", "))], None, None
        blank = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                ints = cut(batch, parts)
                before = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, parts)
                codes, _ = nearest(ints, books)
                more = moved(ints, before, codes, entries)
                rows, sums = more if rows is None else (rows + more[0], sums + more[1])
                coded = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "ints")), coded, *(pa.nulls(len(batch), t) for t in blank[4:])], names)
        if rows is not None:
            p, e = np.nonzero((rows != 0) | (sums != 0).any(axis=2))
            sent = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(rows[p, e], pa.int64()), pa.array(list(sums[p, e]), blank[7])]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(p), t) for t in blank[:4]), *sent], names)

    return state.select("vec_id", "label", "ints", "codes").mapInArrow(trimmed(run), f"{STATE}, {SENT}")


def trained(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Books | None]:
    """The rows with the codes of the last round, and the codebooks after it. Stored; the state of a round goes once the next is."""
    state = stored(rows.withColumn("codes", F.lit(bytes([NONE] * parts))))
    books = first_books(state, parts, entries)
    if books is None:
        return state, None
    width = books.shape[2]
    counts, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
    for _ in range(rounds):
        after = stored(reassigned(state, books))
        discard(state)
        state = after.where("part IS NULL").select("vec_id", "label", "ints", "codes")
        sent = after.where("part IS NOT NULL").groupBy("part", "entry").agg(F.sum("rows").alias("rows"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
        for r in sent.collect():  # a row an entry at most
            counts[r.part, r.entry] += r.rows
            sums[r.part, r.entry] += np.array(r[3:], np.int64)
        used = counts > 0
        books = np.where(used[:, :, None], sums // np.maximum(counts, 1)[:, :, None], books)
    return state, books


def coded(rows: DataFrame, books: Books) -> DataFrame:
    """(vec_id, label, code, error) under codebooks: a hex digit pair a part, and the squared distances."""
    parts = books.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                codes, far = nearest(cut(batch, parts), books)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(far.sum(axis=1), pa.int64())], ["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "ints").mapInArrow(trimmed(run), "vec_id long, label string, code string, error long")


def digest(books: Books | None) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, [] if books is None else books.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of vectors(vec_id, embedding, label)."""
    with scratch(vectors.sparkSession):
        state, books = trained(integers(vectors, scale, parts), parts, entries, rounds)
        if books is None:
            out = state.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        else:
            out = stored(coded(state, books))
        sums = out.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("held"))
        whole = looked_up(out, sums, ["label"], "held")
        return stored(whole.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")), keep=True)


def restored(codes: DataFrame, books: Books, scale: int = SCALE) -> DataFrame:
    """(vec_id, embedding) that the codes stand for: the middle of each entry's integers, back in the vector's scale."""
    entry = F.array(*[F.array(*[F.array(*[F.lit((int(c) + 0.5) / scale) for c in e]) for e in part]) for part in books])
    at = F.sequence(F.lit(0), F.lit(books.shape[0] - 1))
    return codes.select("vec_id", F.flatten(F.transform(at, lambda p: entry[p][F.conv(F.substring("code", p * 2 + 1, F.lit(2)), 16, 10).cast("int")])).alias("embedding"))
