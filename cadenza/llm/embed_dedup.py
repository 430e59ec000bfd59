"""Near copies of embeddings: cross-polytope hashing with multiprobe buckets and verified pairs.

A hash applies three rounds of random signs and a fast Hadamard transform and takes the largest coordinate with its
sign: the nearest corner of the cross-polytope. Several such corners together are a bucket of a table. Every vector also
goes to the buckets in which one corner is replaced by its runner-up (multiprobe on both sides).

How many corners a bucket has follows from the number of vectors (`plan`): so many that vectors at random share few
buckets, whatever the table's size. How many tables there are follows from that: random pairs of exactly the least cosine
are hashed, and tables are added until a pair misses all of them with probability below MISS.

Skew: vectors with equal components form one class first (a partial aggregate). Buckets of one class go before any vector
is shipped. A bucket of over `BLOCK` members is split into blocks by a hash of the id, and every pair of blocks is a task
of its own, so no task holds a whole bucket. A task verifies its pairs by matrix products and returns at most a row for
each member: how many vectors it links here, and the least class linked with it here. A pair that meets in several
buckets counts in the first one only, which both vectors' hashes tell.

Defined results: a vector that is null, empty, zero, or has null or non-finite components links with nothing; vectors
link with those of their own length only; a null vec_id gets null component_id and stays; rows that repeat a vec_id are
one vector where their components are equal, and else each judged by its own; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, scratch, ship, stored

ship(__name__)

ROUNDS, BLOCK, SEED = 3, 1024, 20260201
#: Vectors at random that may share a bucket with one; the probability that a pair of the least cosine meets in none.
STRANGERS, MISS = 64, 1e-4
#: Up to this size a rotation is one matrix (that of the fast transform), above the transform itself.
MATRIX_SIZE = 128
#: Buckets of up to so many members are compared many at a time.
SMALL = 64
#: The bits of a bucket that hold the length of its vectors.
LENGTHS = 2**20 - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast transform of rows whose length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(-1, n // (2 * h), 2, h)
        x = np.concatenate((x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]), axis=2)
        h *= 2
    return x.reshape(-1, n)


class Rotations:
    """The random rotations of vectors of `dim` components, padded to a power of two."""

    def __init__(self, dim: int, count: int):
        self.dim, self.size = dim, 1 << max(1, (dim - 1).bit_length())
        self.signs = np.stack([np.random.default_rng([SEED, dim, k]).choice(np.array([-1.0, 1.0], np.float32), (ROUNDS, self.size)) for k in range(count)])
        self.matrices = [self.transform(np.eye(self.size, dtype=np.float32)[:dim], k) for k in range(count)] if self.size <= MATRIX_SIZE else []

    def transform(self, x: np.ndarray, k: int) -> np.ndarray:
        for r in range(ROUNDS):
            x = hadamard(x * self.signs[k, r]) / np.float32(np.sqrt(self.size))
        return x

    def corners(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest and the second nearest corner of each row."""
        if self.matrices:
            x = x @ self.matrices[k]
        else:
            padded = np.zeros((len(x), self.size), np.float32)
            padded[:, : self.dim] = x
            x = self.transform(padded, k)
        size = np.abs(x)
        rows, first = np.arange(len(x)), size.argmax(axis=1)
        corner = lambda at: (at * 2 + (x[rows, at] < 0)).astype(np.uint64)
        one = corner(first)
        size[rows, first] = -1
        return one, corner(size.argmax(axis=1))


def probes(near: list[tuple[np.ndarray, np.ndarray]], table: int, dim: int) -> np.ndarray:
    """Buckets of rows x probes from the corners of one table: the vectors' length in the low bits, a hash in the others."""
    out = np.zeros((len(near[0][0]), len(near) + 1), np.uint64)
    for p in range(len(near) + 1):
        code = np.full(len(out), table + 1, np.uint64)
        for j, (one, two) in enumerate(near):
            code = mix(code ^ (two if p == j + 1 else one) + np.uint64(0x9E3779B97F4A7C15))
        out[:, p] = code
    return ((out & np.uint64(~LENGTHS & (2**64 - 1))) | np.uint64(dim & LENGTHS)).view(np.int64)


def plan(dim: int, n: int, least: float) -> tuple[int, int]:
    """(tables, corners a bucket) for n vectors of `dim` components."""
    size = 1 << max(1, (dim - 1).bit_length())
    if dim < 2 or least >= 1:
        return 1, 1
    rng = np.random.default_rng([SEED, dim])
    x = rng.normal(size=(1000, dim))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    r = rng.normal(size=(1000, dim))
    r -= (r * x).sum(axis=1, keepdims=True) * x
    y = least * x + np.sqrt(1 - least * least) * r / np.sqrt((r * r).sum(axis=1, keepdims=True))
    rotations = Rotations(dim, 24)
    at = [[rotations.corners(v.astype(np.float32), k) for k in range(24)] for v in (x, y)]
    hashes = 1
    while True:
        met = [(probes(at[0][t : t + hashes], 0, dim)[:, :, None] == probes(at[1][t : t + hashes], 0, dim)[:, None, :]).any(axis=(1, 2)).mean() for t in range(0, 25 - hashes, max(1, hashes // 2))]
        tables = max(1, int(np.ceil(np.log(MISS) / np.log(1 - min(0.9999, max(0.01, float(np.mean(met))))))))
        if hashes == 8 or n * tables * (hashes + 1) ** 2 / (2.0 * size) ** hashes <= STRANGERS:
            return tables, hashes
        hashes += 1


class Hasher:
    """The buckets of vectors of `dim` components."""

    def __init__(self, dim: int, n: int, least: float):
        self.dim = dim
        self.tables, self.hashes = plan(dim, n, least)
        self.rotations = Rotations(dim, self.tables * self.hashes)

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """Buckets of unit vectors: rows x tables x probes."""
        x = unit.astype(np.float32)
        return np.stack([probes([self.rotations.corners(x, t * self.hashes + j) for j in range(self.hashes)], t, self.dim) for t in range(self.tables)], axis=1)


def hasher(dim: int, n: int, least: float) -> Hasher:
    """One for a worker process, kept between tasks."""
    held = sys.__dict__.setdefault("_cadenza_hashers", {})
    key = (dim, n, least)
    if key not in held:
        if len(held) >= 8:
            held.clear()
        held[key] = Hasher(dim, n, least)
    return held[key]


def unit_rows(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): v are the components in doubles as bytes, null if the vector can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column("embedding").to_pylist():
                x = np.array([np.nan if c is None else c for c in v or ()], dtype=float)
                ok = len(x) and np.isfinite(x).all()
                if ok:
                    with np.errstate(all="ignore"):
                        x = x / np.abs(x).max() + 0.0 if x.any() else x
                    ok = x.any() and np.isfinite(x).all()
                out.append(x.astype("<f8").tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "v"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, v binary")


def bucket_rows(classes: DataFrame, n: int, least: float) -> DataFrame:
    """(g, node) for each bucket g of each of n classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 1024):
                raw, ids = batch.column("v").slice(a, 1024).to_pylist(), batch.column("node").slice(a, 1024).to_numpy()
                for width in {len(v) for v in raw}:
                    at = np.array([i for i, v in enumerate(raw) if len(v) == width])
                    codes = hasher(width // 8, n, least).codes(unit_rows([raw[i] for i in at])).reshape(len(at), -1)
                    yield pa.RecordBatch.from_arrays([pa.array(codes.ravel()), pa.array(np.repeat(ids[at], codes.shape[1]))], ["g", "node"])

    return classes.select("node", "v").mapInArrow(run, "g long, node long")


def close_pairs(x: np.ndarray, edges: list[int], whole: np.ndarray, side: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the linked pairs of each group x[edges[k] : edges[k + 1]]; between the sides if it isn't whole."""
    sizes = np.diff(edges)
    group = np.repeat(np.arange(len(sizes)), sizes)
    small = whole & (sizes <= SMALL)
    out_i, out_j = [], []
    here = np.flatnonzero(small[group])
    step = 1
    while len(here):
        here = here[here + step < len(group)]
        here = here[group[here + step] == group[here]]
        for a in range(0, len(here), 8192):
            i = here[a : a + 8192]
            ok = np.einsum("ij,ij->i", x[i], x[i + step]) >= least
            out_i.append(i[ok]), out_j.append(i[ok] + step)
        step += 1
    for k in np.flatnonzero(~small):
        a, b = edges[k], edges[k + 1]
        left = np.arange(a, b) if whole[k] else a + np.flatnonzero(side[a:b] == 0)
        right = left if whole[k] else a + np.flatnonzero(side[a:b] == 1)
        if len(left) and len(right):
            near = x[left] @ x[right].T >= least
            i, j = np.nonzero(np.triu(near, 1) if whole[k] else near)
            out_i.append(left[i]), out_j.append(right[j])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_i]), np.concatenate([none, *out_j])


def linked_members(rows: DataFrame, total: int, least: float) -> DataFrame:
    """rows(g, a, b, side, node, n, v), sorted by (g, a, b) within partitions -> (node, linked, root)."""

    def counted(g: np.ndarray, i: np.ndarray, j: np.ndarray, ids: np.ndarray, n: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        """Of linked positions: members, the vectors that each links, the least node linked with it."""
        used, spot = np.unique(np.concatenate((i, j)), return_inverse=True)
        i, j = spot[: len(i)], spot[len(i) :]
        h = hasher(x.shape[1], total, least)
        codes = np.concatenate([h.codes(x[used[a : a + 1024]]) for a in range(0, len(used), 1024)])
        linked, root = np.zeros(len(used), np.int64), ids[used].copy()
        for a in range(0, len(i), 8192):
            one, two = i[a : a + 8192], j[a : a + 8192]
            p, q = codes[one], codes[two]
            met = np.where((p[:, :, :, None] == q[:, :, None, :]).any(axis=3), p, np.iinfo(np.int64).max).reshape(len(p), -1)
            first = met.min(axis=1) == g[used[one]]
            np.add.at(linked, one[first], n[used[two[first]]])
            np.add.at(linked, two[first], n[used[one[first]]])
        while True:
            before = root.copy()
            np.minimum.at(root, i, root[j])
            np.minimum.at(root, j, root[i])
            if (before == root).all():
                return [ids[used], linked, root]

    def work(t: pa.Table, upto: bool) -> tuple[pa.RecordBatch, pa.Table]:
        g, first, second = (t.column(c).to_numpy() for c in ("g", "a", "b"))
        cut = np.flatnonzero((g[1:] != g[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1])) + 1
        edges = [0, *cut.tolist(), len(t)]
        if not upto:
            edges.pop()
        got: list[list[np.ndarray]] = []
        if len(edges) > 1:
            side, ids, n, raw = t.column("side").to_numpy(), t.column("node").to_numpy(), t.column("n").to_numpy(), t.column("v").to_pylist()
            width = np.array([len(v) for v in raw])
            # groups of a length side by side, so that the vectors of each are one matrix
            k = 0
            while k < len(edges) - 1:
                m = k + 1
                while m < len(edges) - 1 and width[edges[m]] == width[edges[k]]:
                    m += 1
                a, b = edges[k], edges[m]
                if (width[a:b] == width[a]).all():
                    x = unit_rows(raw[a:b])
                    here = np.array(edges[k : m + 1]) - a
                    i, j = close_pairs(x, here.tolist(), (first == second)[a:b][here[:-1]], side[a:b], least)
                    if len(i):
                        got.append(counted(g[a:b], i, j, ids[a:b], n[a:b], x))
                k = m
        none = np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *(x[k] for x in got)]), pa.int64()) for k in range(3)], ["node", "linked", "root"]), t.slice(edges[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            for a in range(0, len(batch), 4096):
                part = pa.Table.from_batches([batch.slice(a, 4096)])
                held = part if held is None or not len(held) else pa.concat_tables([held, part])
                out, held = work(held, False)
                yield out
        if held is not None and len(held):
            yield work(held, True)[0]

    return rows.mapInArrow(run, "node long, linked long, root long")


def near_vectors(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (least vec_id reachable by links), kept."""
    spark = vectors.sparkSession
    with scratch(spark):
        given = stored(valid_vectors(vectors))
        able = given.where("v IS NOT NULL AND vec_id IS NOT NULL")
        # n: the vec_ids of these components; a class is a node, whose number is fixed as it is written
        grouped = able.distinct().groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
        classes = stored(grouped.select(F.monotonically_increasing_id().alias("node"), "rep", "n", "v"))
        total = 1 << max(0, (classes.count() - 1)).bit_length()
        dealt = stored(bucket_rows(classes, total, least).distinct())
        # members of the bucket, as counts alone
        full = dealt.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("g", F.ceil(F.col("m") / BLOCK).cast("int").alias("k"))
        placed = dealt.join(full, "g").select("g", "node", "k", F.pmod(F.xxhash64("node"), F.col("k")).cast("int").alias("s"))
        each = placed.select("g", "node", "s", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o"))
        each = each.select("g", F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b"), F.when(F.col("s") <= F.col("o"), 0).otherwise(1).alias("side"), "node")
        rows = each.join(classes.select("node", "n", "v"), "node")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(parts, "g", "a", "b").sortWithinPartitions("g", "a", "b").select("g", "a", "b", "side", "node", "n", "v")
        links = stored(linked_members(rows, total, least))
        found = components(links.where("node <> root").select(F.col("node").alias("src"), F.col("root").alias("dst")))
        counts = links.groupBy("node").agg(F.sum("linked").alias("linked"))
        # the least vec_id of the component's classes
        joined = found.select(F.col("id").alias("node"), "component").join(classes.select("node", "rep"), "node")
        heads = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
        whole = classes.join(counts, "node", "left").join(joined.join(heads, "component").select("node", "component_id"), "node", "left")
        whole = whole.select("v", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
        out = given.join(whole, "v", "left")
        own = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
        return stored(out.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), (F.coalesce(own, F.lit(0)) == F.coalesce("vec_id", F.lit(0))).alias("kept")), keep=True)
