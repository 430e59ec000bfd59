"""WARC archives, vector codes and prefix tries against brute force, with nulls, repeats, empties and clashing columns."""

import gzip
import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadenza.llm import hot_keys, lloyd_codes, prefix_trie, queries, warc_archive

PAGES = "page_id long, url string, html string, key string, first long, digest string, bytes long"


@pytest.fixture(params=[4096, 2])
def most(request, monkeypatch):
    """Every key counts as hot, or only those of more than half of the rows."""
    monkeypatch.setattr(hot_keys, "MOST", request.param)


def test_looked_up(spark, most):
    rows = [(1 if i % 3 else None if i % 5 == 0 else i, i) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, v int")
    looks = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")).where("k IS NULL OR k % 2 = 1")
    sums = defaultdict(int)
    for k, v in rows:
        sums[k] += v
    got = hot_keys.looked_up(df, looks, ["k"], "n").collect()
    assert sorted((r.v, r.k, r.s) for r in got) == sorted(((v, k, sums[k] if k is None or k % 2 else None) for k, v in rows), key=lambda x: x[0])
    assert hot_keys.looked_up(df.limit(0), looks, ["k"], "n").count() == 0 and hot_keys.looked_up(df, looks.limit(0), ["k"], "n").where("s IS NULL").count() == 300


def page_rows():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh <p>é語\n") for _ in range(n))
    long, edge, under = text(5000), "x" * 1000, "x" * 999
    rows = [(i, f"http://a.example/{i}", long) for i in range(40)] + [(100 + i, None, edge) for i in range(3)] + [(200 + i, "u", under) for i in range(3)]
    rows += [(300, "http://b.example/a b\r\nX: y", ""), (301, "é", None), (None, "n", long), (None, "m", text(1500)), (302, "w", text(200_000)), (303, "r", text(1200)), (39, "again", long)]
    rows += [(400 + i, "z", text(rng.randrange(2000))) for i in range(60)]
    return rows


def test_archive(spark, most, tmp_path):
    rows = page_rows()
    df = spark.createDataFrame([(*r, "k", 9, "d", 1) for r in rows], PAGES).repartition(3)
    sizes = defaultdict(list)
    for i, _, h in rows:
        sizes[h or ""].append(i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        last = max((x for x in sizes[h or ""] if x is not None), default=None) if len(data) >= 1000 else i
        again = last is not None and last != i
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last if again else None))
    for k, split in enumerate((1 << 25, 1999)):
        got = warc_archive.archived(df, f"file://{tmp_path}/{k}", file_bytes=30_000, split=split).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    found = warc_archive.records(warc_archive.archives(spark, f"file://{tmp_path}/0"), 5000).collect()
    assert len(found) == len(rows) and sorted(r.payload.decode() for r in found if r.type == "response") == sorted((h or "") for (_, _, h), w in zip(rows, want, strict=True) if w[3] == "response")
    assert {r.uri for r in found} >= {"http://b.example/a%20b%0D%0AX:%20y", "é", None}
    # gzip itself reads what was written, and a record's header says what its block is
    with gzip.open(found[0].path.removeprefix("file://").removeprefix("file:")) as f:
        whole = f.read()
    assert whole.count(b"WARC/1.1\r\n") == sum(r.path == found[0].path for r in found)
    assert warc_archive.archived(df.limit(0)).count() == 0


def test_archives_of_others(spark, tmp_path):
    """Without marks, with names in the members' headers; a broken member; an archive inside a payload that isn't compressed."""
    make = lambda i, body, kind="response": f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{i}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    plain = [gzip.compress(make(i, random.Random(i).randbytes(3000), "resource")) for i in range(20)]
    named = b"\x1f\x8b\x08\x08\0\0\0\0\0\xffname.warc\0" + gzip.compress(make(77, b"q", "resource"))[10:]
    broken = plain[5][:-9] + b"\0" + plain[5][-8:]
    (tmp_path / "a.warc.gz").write_bytes(b"".join([*plain[:5], broken, named, *plain[6:]]))
    for split in (1 << 20, 1111):
        found = warc_archive.records(warc_archive.archives(spark, f"file://{tmp_path}"), split).collect()
        assert sorted(r.record_id for r in found) == sorted([f"urn:x:{i}" for i in range(20) if i != 5] + ["urn:x:77"])
        assert all(r.payload == random.Random(int(r.record_id[6:])).randbytes(3000) for r in found if r.record_id != "urn:x:77")
    inside, mark = b"".join(warc_archive.member(make(f"in{i}", b"i" * 50, "resource"), b"o" * 16, 6) for i in range(30)), b"m" * 16
    outer = [warc_archive.member(make(i, inside if i == 1 else b"y" * 200, "resource"), mark, 0) for i in range(3)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(outer))
    for split in (1 << 20, 150):
        found = warc_archive.records(warc_archive.archives(spark, f"file://{tmp_path}"), split).collect()
        assert sorted(r.record_id for r in found) == ["urn:x:0", "urn:x:1", "urn:x:2"]


VECTORS = "vec_id long, embedding array<float>, label int, codes string, part string, error int"


def coded(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Every round from nothing, in Python's integers."""
    kept = sorted(((i, [int(np.floor(float(np.float32(x)) * scale)) for x in v], lab) for i, v, lab in rows if v and all(x is not None and np.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    w = width // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        groups = [defaultdict(list) for _ in range(parts)]
        for c in cut:
            for p in range(parts):
                groups[p][near(c[p], books[p])[1]].append(c[p])
        books = [[[sum(x) // len(g) for x in zip(*g, strict=True)] if (g := groups[p].get(k)) else e for k, e in enumerate(books[p])] for p in range(parts)]
    out, sums = [], defaultdict(int)
    for (i, _, lab), c in zip(kept, cut, strict=True):
        best = [near(c[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), lab))
        sums[lab] += out[-1][2]
    text = ",".join(str(x) for b in books for e in b for x in e)
    return [(i, c, e, sums[lab], hashlib.sha256(text.encode()).hexdigest()) for i, c, e, lab in out]


@pytest.mark.parametrize("n", [400, 9, 1])
def test_vector_codes(spark, most, n):
    rng = np.random.default_rng(n)
    vectors = rng.normal(0, 0.2, (n, 16)).astype(np.float32)
    vectors[n // 2 :] = vectors[0]  # a third or more are copies
    rows = [(int(i), v.tolist(), int(i % 4) if i % 3 == 0 else None if i % 3 == 1 else 7) for i, v in zip(rng.permutation(n) - 3, vectors, strict=True)]
    rows += [(5000, None, 1), (-90, [float("nan")] * 16, 1), (-91, [float("inf"), *[0.0] * 15], 1), (-92, [None, *[0.0] * 15], 2), (-93, [], 1), (6000, [1.0] * 8, 1), (None, [0.5] * 16, 3), rows[0]]
    df = spark.createDataFrame([(*r, "c", "p", 1) for r in rows], VECTORS).repartition(5)
    got = lloyd_codes.compressed(df).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, coded(rows)))


def test_vector_codes_of_nothing(spark):
    df = spark.createDataFrame([(1, None, 1, "c", "p", 1)], VECTORS)
    assert lloyd_codes.compressed(df).count() == 0 and lloyd_codes.compressed(df.limit(0)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    odd = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1, "c", "p", 1)], VECTORS)
    assert lloyd_codes.compressed(odd).count() == 0
    big = spark.createDataFrame([(i, [3e38 * (-1) ** i] * 8, 1, "c", "p", 1) for i in range(4)], VECTORS)
    assert lloyd_codes.compressed(big).where("error = 0").count() == 4


def test_only_what_moved_is_sent(spark):
    rng = np.random.default_rng(1)
    ints = rng.integers(-900, 900, (500, 8, 2))
    codes, _ = lloyd_codes.nearest(ints, ints[:16].transpose(1, 0, 2))
    first = lloyd_codes.moved(ints, np.full_like(codes, lloyd_codes.NONE), codes, 16)
    assert first[0].sum() == 4000 and (first[1].sum(axis=1) == ints.sum(axis=0)).all()
    after = codes.copy()
    after[3, 1] = (codes[3, 1] + 1) % 16
    rows, sums = lloyd_codes.moved(ints, codes, after, 16)
    assert np.abs(rows).sum() == 2 and rows[1, after[3, 1]] == 1 and (sums[1, after[3, 1]] == ints[3, 1]).all() and (sums.sum(axis=1) == 0).all()


def test_restored(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.2, 16).astype(np.float32).tolist(), 1, "c", "p", 1) for i in range(200)]
    state, books = lloyd_codes.trained(lloyd_codes.integers(spark.createDataFrame(rows, VECTORS)))
    out = {r.vec_id: r.embedding for r in lloyd_codes.restored(lloyd_codes.coded(state, books), books).collect()}
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    spread = np.var([r[1] for r in rows], axis=0).sum()
    assert np.mean([apart(out[r[0]], r[1]) for r in rows]) < 0.5 * spread


TALKS = "conv_id long, turn long, role string, text string, depth int, digest string, link string, base long, own int, head int"


def tries(convs):
    """Nodes of conversations {id: [(role, text)]} by their whole prefixes."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, out = defaultdict(list), []
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        sums[p] = (sum(sums[k][0] for k in kids[p]) or 1, saved + sum(sums[k][1] for k in kids[p]))
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), *sums[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def talk_rows():
    rng = random.Random(8)
    rows = []
    for c in [*range(-3, 12), *range(95, 130), *range(200, 230), 777, 778]:
        same = rng.random() < 0.4  # much the same beginning
        for t in range(rng.randrange(1, 12)):
            rows.append((c, t if rng.random() < 0.95 else None, "user" if t % 2 == 0 else "assistant", f"turn {t}" if same or rng.random() < 0.3 else f"{rng.randrange(9)} é語" * rng.randrange(4)))
    rows += [(900, t, "user", f"long {t // 3}") for t in range(400)] + [(901, t, "user", f"long {t // 3}") for t in range(395)]
    rows += [(None, 1, "user", "nobody's"), (950, 1, None, None), (951, 1, "", ""), (952, None, "user", "x"), (952, None, "user", "x"), (953, 2, "us", "erx"), (954, 2, "use", "rx")]
    return rows


def original(rows):
    digest = lambda role, text: hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
    out = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            out[c].append(((t is not None, t or 0, digest(role or "", text or "")), (role or "", text or "")))
    return {c: [x for _, x in sorted(v)] for c, v in out.items()}


@pytest.mark.parametrize(("block", "run"), [(1024, 4096), (3, 2)])
def test_prefix_trie(spark, most, monkeypatch, block, run):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "RUN", run)
    rows = talk_rows()
    df = spark.createDataFrame([(*r, 1, "d", "l", 2, 3, 4) for r in rows], TALKS).repartition(7)
    whole = original(rows)
    got = prefix_trie.shared_prefixes(df).drop("digest").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, tries(whole)))
    rebuilt = {}
    for c, own in whole.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = whole.get(c - int(np.fmod(c, 100)), [])[:h] + own[h:]
    got = prefix_trie.hundred_heads(df).drop("digest").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, tries(rebuilt)))


def test_prefix_trie_of_nothing(spark):
    df = spark.createDataFrame([(None, 1, "user", "x", 1, "d", "l", 2, 3, 4)], TALKS)
    assert prefix_trie.hundred_heads(df).count() == 0 and prefix_trie.shared_prefixes(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op11_web_archive", "op12_vector_codes", "op13_prefix_trie"])
def test_contract(spark, data, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).fetchdf()
    got = queries.queries()[name](spark, data).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    tidy = lambda df: sorted(repr(tuple(None if pd.isna(x) else x if isinstance(x, str) else int(x) for x in r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert tidy(got) == tidy(want)
