"""Each operator against brute force on small rows, with nulls, empties, long texts, repeats and clashing columns."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cadenza.llm import chunk_dedup, embed_dedup, html_extract, license_scan, line_dedup, mixing, packing, pii_crf, quality_lines, shared, sketch_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, rep string, line string, host string, page string, length int"


def frame(spark, rows):
    """Documents, with columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t) if t else None, "h", "rep", "line", "host", "page", 7) for i, t, s in rows], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice("tal mer sol vin kort lang huset ved havet og en den blå røde går står ser hører stille natt dag sommer vinter".split()) + str(rng.randrange(60)) for _ in range(n))


def variant(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for g in range(4):
        base = prose(rng, 150)
        out += [base, base.upper(), *(variant(rng, base, e) for e in (1, 2, 3, 4, 6, 8, 12, 20))]
    out += [prose(rng, 60) for _ in range(10)] + ["", None, "  \n\t ", "one", "one two", "One  TWO", prose(rng, 4000)]
    return [(i, t, "a" if i % 3 else "b") for i, t in enumerate(out)] + [(0, out[0], "a")]


def reachable(ids, links):
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {i: find(i) for i in ids}


def shingle_sets(rows, k):
    out = {}
    for i, t, _ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_copies(spark, rows, k, percent):
    sets = shingle_sets(rows, k)
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = reachable(sets, links)
    got = sketch_dedup.near_copies(frame(spark, rows), k, percent).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_copies_that_repeat_an_id(spark, k, percent):
    rng = random.Random(21)
    base, other = prose(rng, 120), prose(rng, 90)
    given = [(1, base, "s"), (2, base + " one", "s"), (2, other, "s"), (3, base + " two", "s"), (7, other + " more", "s"), (7, other + " more", "s"), (7, None, "s"), (7, "", "s"), (8, base, "s"), (5, prose(rng, 80), "s"), (5, prose(rng, 80), "s")]
    given += [(int(rng.randrange(20, 26)), variant(rng, base, rng.randrange(0, 4)), "s") for _ in range(15)]
    sets = {n: next(iter(shingle_sets([row], k).values())) for n, row in enumerate(given)}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    label = {n: given[n][0] for n in sets}
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = sketch_dedup.near_copies(frame(spark, given), k, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == Counter((given[n][0], len(sets[n]), label[n], label[n] == given[n][0]) for n in sets)
    # one row of each group stays, whatever ids its rows have
    group = reachable(sets, links)
    left = sketch_dedup.without_near_copies(frame(spark, given), k, percent)
    assert left.columns == frame(spark, given).columns
    kept = Counter((r.doc_id, r.text) for r in left.collect())
    assert max(kept.values()) == 1 and len(kept) == len({group[n] for n in sets if sets[n]}) + len({given[n][:2] for n in sets if not sets[n]})
    for key in {g for n, g in group.items() if sets[n]}:
        members = [given[n][:2] for n in sets if group[n] == key]
        stays = [m for m in set(members) if kept[m]]
        assert len(stays) == 1 and stays[0][0] == min(i for i, _ in members)


def test_near_copies_edges(spark):
    assert sketch_dedup.near_copies(frame(spark, [])).count() == 0
    got = sketch_dedup.near_copies(frame(spark, [(None, "a b c", "s"), (1, None, None)])).collect()
    assert sorted((r.doc_id is None, r.component_id, r.kept) for r in got) == [(False, 1, True), (True, None, True)]


def links_of(spark, links, parts):
    """Rows (src, dst) in so many partitions."""
    return spark.createDataFrame(spark.sparkContext.parallelize(links, parts), "src long, dst long")


@pytest.mark.parametrize("part", [3, 1 << 18])
def test_components_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(shared, "PART", part)
    rng = random.Random(8)
    chain = rng.sample(range(100, 140), 40)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + list(zip(chain[:-1], chain[1:], strict=True))
    # hubs that are the greatest and the least of theirs, linked both ways, and links of no one
    links += [(299, i) for i in range(200, 230)] + [(i, 300) for i in range(301, 330)] + [(329, 299), (299, 329), (-5, 70), (-(2**62), -5)] + [(400, 400)]
    rng.shuffle(links)
    want = reachable({x for a, b in links if a != b for x in (a, b)}, [x for x in links if x[0] != x[1]])
    got = shared.components(links_of(spark, [*links, (None, 1), (2, None)], 5)).collect()
    assert len(got) == len(want) and {r.id: r.component for r in got} == want
    own = shared.stars(links_of(spark, links, 3)).collect()
    assert len(own) == len({r.src for r in own}) and {r.src: r.dst for r in own} == {i: c for i, c in want.items() if i != c}
    assert not shared.components(links_of(spark, [(7, 7)], 1)).collect()


def test_components_that_a_task_holds_take_no_round(spark, monkeypatch):
    written, real = [], shared.stored
    monkeypatch.setattr(shared, "stored", lambda df, keep=False: written.append(1) or real(df, keep))
    links = [(50 * g + 40, 50 * g + i) for g in range(4) for i in range(20)]
    assert {r.id: r.component for r in shared.components(links_of(spark, links, 1)).collect()} == reachable({x for e in links for x in e}, links)
    assert len(written) == 1
    # what several tasks have of a star meets in one round
    written.clear()
    assert {r.id: r.component for r in shared.components(links_of(spark, links[::3] + links[1::3] + links[2::3], 4)).collect()} == reachable({x for e in links for x in e}, links)
    assert len(written) == 2


def test_near_copies_write_few_frames(spark, rows, monkeypatch):
    written, real = [], shared.stored
    for module in (shared, sketch_dedup):
        monkeypatch.setattr(module, "stored", lambda df, keep=False: written.append(1) or real(df, keep))
    assert sketch_dedup.near_copies(frame(spark, rows), 3, 85).count() == len(rows) and len(written) <= 14


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 3, 200, 5000):
        assert len(np.unique(sketch_dedup.sketch(np.unique(rng.integers(0, 2**63, n).astype(np.uint64))))) == sketch_dedup.BINS
    pool = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    same = np.mean(sketch_dedup.sketch(pool[:2000]) == sketch_dedup.sketch(pool[500:2500]))
    assert abs(same - 0.6) < 0.15


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 20))
    v = [base[i % 6] + rng.normal(size=20) * (0.02 + 0.05 * (i % 5)) for i in range(80)] + [base[0]] * 4 + [base[0] * 3, np.zeros(20)]
    rows = [(i, x.tolist(), "z") for i, x in enumerate(v)] + [(200, None, "z"), (201, [1.0, None] + [0.0] * 18, "z"), (202, [float("nan")] * 20, "z"), (203, [], "z"), (None, base[1].tolist(), "z")]
    got = {r.vec_id: r for r in embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, g string")).collect()}
    x = np.array(v[:-1])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.95
    np.fill_diagonal(close, False)
    want = reachable(range(len(x)), list(zip(*np.nonzero(close), strict=True)))
    assert [got[i].n_links for i in range(len(x))] == close.sum(1).tolist()
    assert {i: got[i].component_id for i in range(len(x))} == want
    assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i in (85, 200, 201, 202, 203))
    assert got[None].component_id is None
    assert embed_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_near_vectors_that_repeat_an_id(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(4, 24))
    given = [(int(rng.integers(0, 25)), (base[k % 4] * rng.choice([1.0, 2.0]) + rng.normal(size=24) * rng.choice([0.0, 0.06])).tolist()) for k in range(60)]
    given += given[:7] + [(1, base[0].tolist()), (1, base[0].tolist()), (4, (base[0] + 0.01).tolist()), (90, base[0][:12].tolist()), (91, base[0][:12].tolist())]
    unit = lambda v: np.array(v) / np.abs(v).max()
    nodes = sorted({(i, tuple(unit(v))) for i, v in given})
    cos = lambda v, w: len(v) == len(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.95
    # vectors of equal direction and length of components are one class; an id counts once in it
    links = [(a, b) for a in range(len(nodes)) for b in range(len(nodes)) if a != b and cos(nodes[a][1], nodes[b][1])]
    root = list(range(len(nodes)))
    label = [i for i, _ in nodes]
    for _ in nodes:
        for a, b in links:
            label[a] = min(label[a], label[b])
    degree = Counter(a for a, _ in links)
    want = Counter((nodes[k][0], degree[k], label[k]) for i, v in given for k in root if nodes[k] == (i, tuple(unit(v))))
    got = embed_dedup.near_vectors(spark.createDataFrame(given, "vec_id long, embedding array<double>")).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want


def test_hash_plan_grows_with_the_table():
    for dim in (16, 64):
        sizes = [embed_dedup.plan(dim, n, 0.95) for n in (1 << 8, 1 << 16, 1 << 24, 1 << 32)]
        assert [h for _, h in sizes] == sorted(h for _, h in sizes) and sizes[0][1] < sizes[-1][1]
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = rng.normal(size=x.shape)
    r -= (r * x).sum(axis=1, keepdims=True) * x
    y = 0.951 * x + np.sqrt(1 - 0.951**2) * r / np.linalg.norm(r, axis=1, keepdims=True)
    for n in (1 << 10, 1 << 20, 1 << 30):
        h = embed_dedup.Hasher(64, n, 0.95)
        p, q, z = h.codes(x), h.codes(y), h.codes(np.roll(x, 1, axis=0))
        met = lambda u, v: (u[:, :, :, None] == v[:, :, None, :]).any(axis=(1, 2, 3)).mean()
        assert met(p, q) > 0.998 and met(p, z) < 0.2


def test_rotation_by_matrix_and_by_transform_agree():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(50, 40)).astype(np.float32)
    r = embed_dedup.Rotations(40, 2)
    padded = np.zeros((50, 64), np.float32)
    padded[:, :40] = x
    assert np.allclose(x @ r.matrices[1], r.transform(padded, 1), atol=1e-4)
    assert np.allclose(np.linalg.norm(r.transform(padded, 0), axis=1), np.linalg.norm(x, axis=1), rtol=1e-4)


def test_a_bucket_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 8)
    rng = np.random.default_rng(3)
    v = rng.normal(size=30) + rng.normal(size=(50, 30)) * 0.01
    got = embed_dedup.near_vectors(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).collect()
    assert all(r.n_links == 49 and r.component_id == 0 for r in got)


def test_main_text(spark, data):
    weights = html_extract.trained()
    for page in html_extract.LABELLED:
        kept = re.findall(r"<keep>(.*?)</keep>", page, re.DOTALL)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for k in kept for b in re.split(r"</?(?:p|h1|h2|li|ul|ol|blockquote|div|br|pre|table|tr|td|dl|dt|dd|section|article)>", k)]
        got, want = html_extract.main_text(re.sub("</?keep>", "", page), weights), "\n".join(b for b in blocks if b)
        # cells of a layout table without a telling container are too short to count
        assert got == want or ("<table>" in page and want.startswith(got) and len(got) > 0.8 * len(want))
    pages = spark.read.parquet(f"{data}/pages.parquet")
    for r, p in zip(html_extract.main_texts(pages).orderBy("page_id").collect(), pages.orderBy("page_id").collect(), strict=True):
        body = re.search(r"<article>(.*)</article>", p.html, re.DOTALL)[1]
        want = "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", body)) if x)
        assert (r.text, r.n_chars) == (want, len(want))


def test_main_text_inline_blanks_and_wrappers():
    weights = html_extract.trained()
    article = "<h1>Title of it</h1><p>We walked on <b>day</b> <i>long</i>, see <a>first</a> <a>second</a>,\n by the old river and then home.</p>"
    want = "Title of it\nWe walked on day long, see first second, by the old river and then home."
    menu, foot = "<nav><a>Home</a> <a>News</a></nav>", "<footer>Imprint and privacy</footer>"
    for page in (
        f"<body>{menu}<article>{article}</article>{foot}</body>", f"<body class='home nav-open'>{menu}{article}{foot}</body>", f"<html class='footer'><body class='has-sidebar'>{menu}{article}{foot}</body>",
        f"<body><form action='x'>{menu}{article}{foot}</form></body>", f"<form><div class='content'>{article}</div></form>", f"<div class='page sidebar'><main>{article}</main>{foot}</div>", article,
        f"<div class='main-nav'><a>One</a> <a>Two</a></div><div class='post'>{article}<div class='post-comments'><p>I like this piece a lot, thanks for it</p></div></div>",
        f"<div class='is-open no-sidebar'>{article}</div>", f"<form><p>Search all of our issues by a word or a date of your choice</p><input></form><div>{article}</div>",
        f"<body>{'<div>' * 1000}{menu}<article>{article}</article>", f"<body><nav>{'<div>x' * 1000}</nav><article>{article}</article></body>",
    ):
        assert html_extract.main_text(page, weights) == want, page[:200]
    assert html_extract.main_text("<article><div>Text in a div.<br>Second line.</div><table><tr><td>One</td><td>Two</td></tr></table></article>", weights) == "Text in a div.\nSecond line.\nOne\nTwo"


def test_main_text_weights_come_from_labels():
    weights = html_extract.trained()
    seen = {True: 0, False: 0}
    inside = {True: 0, False: 0}
    for page in html_extract.LABELLED:
        t = html_extract.page_tokens(page, marks=True)
        for (kind, context, _), n, kept in zip(t.kinds, t.counts, t.kept, strict=True):
            seen[kept] += n
            inside[kept] += n * (context == "article")
    names = len([k for k in weights if k[0] == "context"]) - 1  # hidden is no label's
    assert abs(weights["context", "article"] - (math.log((inside[True] + 1) / (seen[True] + names)) - math.log((inside[False] + 1) / (seen[False] + names)))) < 1e-9
    assert weights["tag", ""] < 0 < weights["context", "article"] and weights["kind", "link"] < 0
    # labels turned round turn the weights round
    turned = html_extract.trained(tuple(p.replace("<keep>", "\0").replace("</keep>", "<keep>").replace("\0", "</keep>").replace("<body", "<keep><body", 1) for p in html_extract.LABELLED))
    assert turned["context", "article"] < 0


def test_best_region_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        scores = rng.integers(-3, 4, rng.integers(0, 12)).tolist()
        best = max([(0, 0, 0), *((sum(scores[a:b]), -a, -b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1))])
        a, b = html_extract.best_region(scores)
        assert sum(scores[a:b]) == best[0]


def test_main_text_edges(spark):
    weights = html_extract.trained()
    for page in (None, "", "   ", "<", "<p", "<script>x", "<!-- x", "<a href='", "<p class=\"x>y", "a < b", "<b>" * 50_000):
        assert isinstance(html_extract.main_text(page, weights), str)
    page = "<body><nav><a href='/'>Home of all</a></nav><article><p>It rained &amp; rained all day long.</p><aside>Read this too</aside><p>Then  it\nstopped.</p></article><form>Search <input></form></body>"
    assert html_extract.main_text(page, weights) == "It rained & rained all day long.\nThen it stopped."
    empty = spark.createDataFrame([], "page_id long, url string, html string, text string")
    assert html_extract.main_texts(empty).columns == ["page_id", "url", "text", "n_chars"] and html_extract.main_texts(empty).count() == 0


def test_main_text_after_many_unclosed_items():
    weights = html_extract.trained()
    article = "<article><p>It rained all day long, and then the sun came out.</p></article>"
    want = "It rained all day long, and then the sun came out."
    for items in ("<ul>" + "<li><a href='/'>Home</a>" * 1000 + "</ul>", "<ul>" + "<li><div>Home" * 1000 + "</ul>", "<dl>" + "<dt>One<dd>Two" * 500 + "</dl>", "<table>" + "<tr><td>One<td>Two" * 500 + "</table>", "<div>" * 1000, "<section>" * 1000):
        assert html_extract.main_text(f"<body><nav>{items}</nav>{article}</body>", weights) == want
    # what an omitted end tag leaves open ends with its predecessor, and not beyond its list or table
    for page, contexts in (("<ul><li class='ad'>x<li>y</ul>z", ["ad", "body", "body"]), ("<ul><li class='ad'>x<ul><li>y</ul>z</ul>", ["ad"] * 3), ("<table><tr class='ad'><td>x<tr><td>y</table>", ["ad", "body"]), ("<table><tr><td class='ad'>x<table><tr><td>y</table>z<td>v</table>", ["ad", "ad", "ad", "body"]), ("<dl><dt class='ad'>x<dd>y</dl>", ["ad", "body"])):
        t = html_extract.Tokens(page)
        assert [t.kinds[at][1] for at, _, _ in t.words] == contexts, page


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and pii_crf.luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans_by_pattern():
    rng = random.Random(7)
    for _ in range(20_000):
        text = "".join(rng.choice("1299.+- ()@ab.55%é") for _ in range(rng.randrange(40)))
        assert pii_crf.base_spans(text) == plain_spans(text)
    assert pii_crf.base_spans("9" * 50_000) == [] and pii_crf.base_spans("a" * 100_000) == [] and pii_crf.base_spans("1.2.3.4") == [(0, 1, 7)]


def test_field_on_held_out_runs():
    rows = pii_crf.labelled_runs()
    half = len(rows) // 2
    field = pii_crf.trained(rows[:half])
    held = rows[half:]
    tags = pii_crf.decoded(field, [pii_crf.signs([x[slice(*pii_crf.core(x, 0, len(x)))] for x in w]) for w, _ in held])
    right = [pii_crf.LABELS[i] == t for got, (_, want) in zip(tags, held, strict=True) for i, t in zip(got, want, strict=True)]
    assert np.mean(right) > 0.97


def test_viterbi_is_the_best_path():
    field = pii_crf.trained(pii_crf.labelled_runs()[:60], steps=20)
    from itertools import product

    run = [("a", ""), ("93", "10"), ("+91", "10")]
    emit = field.scores(run)
    score = lambda path: sum(emit[t][y] for t, y in enumerate(path)) + sum(field.pairs[a, b] for a, b in zip(path, path[1:], strict=False)) + (-1e9 if pii_crf.LABELS[path[0]][0] == "I" else 0)
    best = max(product(range(len(pii_crf.LABELS)), repeat=3), key=score)
    assert abs(score(tuple(pii_crf.decoded(field, [run])[0])) - score(best)) < 1e-9


#: Sentences written by hand, not drawn from the templates; [kind text] is personal, all other figures are not.
#: About a dozen strings of DEVELOPED are those that the features were developed on, so its figures flatter. FRESH was
#: written afterwards without them, scored once, and nothing was changed for it; its author knew the templates.
DEVELOPED = """Please ring me at [phone 020 7946 0958] after six.
My mobile is [phone 07700 900123], and the office has [phone (0161) 496 0123].
Call [phone 555 123 4567] or [phone 212.555.0188] for the tickets!
Fax: [phone 030/9018200], desk [phone 030-901820].
She wrote [email anna.berg+list@post.example.org] on the card.
He uses bob@localhost on that machine and user@host in the manual.
Charge it to [card 4111 1111 1111 1111], please.
The number [card 5500-0000-0000-0004] was declined in 2021.
They typed [card 4012.8888.8888.1881] with dots between.
Order 1234 5678 9012 3456 was shipped in 2 boxes of 12 each.
The router at [ip 10.0.0.138] answers, 10.0.0.338 does not.
Its other address is [ip 2001:db8:0:1:1:1:1:1] and the link one is [ip fe80::1ff:fe23:4567:890a].
We met at 12:30:45 on 2023-11-05, or was it 05.11.2023?
Section 4.3.2 of version 10.15.7 lists 3 of the 25 cases.
In 1914 1915 1916 1917 1918 the mill made 12 400 tons a year.
The account DE89 3704 0044 0532 0130 00 has 1,250.75 left.
ISBN 978-3-16-148410-0, shelf 820.9, page 112-118.
You reach us on [phone +44 20 7946 0991] and on [phone 0044 20 7946 0992].
Numéro : [phone 01 42 68 53 00], fermé le 14/07/2022.
Rufen Sie [phone 089 1234567] an, Zimmer 214.
Tel. [phone 1-800-555-0199], ext 42.
The winning numbers were 4 8 15 16 23 42 again.
Room 101, floor 7, 90210-1234 Beverly Hills.
Speed 300 000 km per second, that is 299 792 458 metres.
The score was 3-2 (1-1), with 45 000 people there.
Write to [email j_smith99@mail.co.uk] or [email info@shop-24.de] by 9.
MAC 00:1a:2b:3c:4d:5e belongs to port 8080.
His SSN 078-05-1120 isn't a phone, nor is 12-345-6789.
The serial is 4410-2231-0097, made in week 32.
Text [phone (415) 555-2671] or [phone 415-555-2672].
GPS 52.5200 13.4050, altitude 34 m.
Mix 1 2 3 4 5 6 7 8 9 10 drops with 250 ml.
Server [ip 192.0.2.44] sent 1500 bytes to [ip 198.51.100.7].
Her card [card 3782 822463 10005] expires 11/27.
Tracking 1Z 999 AA1 01 2345 6784 left on 3/14.
Ring [phone 0171-2345678] or [phone 0043 1 5880 1234]."""
FRESH = """The clinic can be reached on [phone 0131 225 4567] until noon.
Ask for Mara, [phone (020) 3868 7712], extension 9.
Mobile [phone 07911 654321]; landline [phone 01632 960983].
Toll free [phone 1-866-303-4410] or locally [phone 503-226-7780].
Reach the desk at [phone 617.868.1200], not at window 17.
Büro: [phone 040/3344556], Lager: [phone 0221 9876543].
Appelez le [phone 04 78 42 11 90] avant le 3 mai 2019.
From abroad dial [phone +33 4 78 42 11 90] or [phone 0033 478 421190].
Sydney office [phone (02) 9264 7781], Perth [phone 08 6552 1100].
WhatsApp [phone +55 11 91234 5678] works best.
Send drafts to [email k.ono-7@univ.example.ac.jp] by the 12th.
Also [email sales@north-pier.shop], never sales at north-pier.
The card [card 5105 1051 0510 5100] and the spare [card 6011-1111-1111-1117] were cut up.
Typed as [card 3530.1113.3330.0000] it was refused.
Amex [card 3714 496353 98431] is kept in the safe.
Voucher 7781 2210 4456 9035 gives 15 % off.
The gateway [ip 172.16.31.9] replied; 172.16.310.9 is a typo.
Over six it is [ip 2a02:26f0:1:3::45] or [ip fd12:3456:789a:1::1].
The build is 21.4.0.3877 and the patch is 7.12.
In 1848 and 1871 there were 2 and 5 such laws.
The years 1988 1992 1996 2000 were leap years.
IBAN FR14 2004 1010 0505 0001 3M02 606 was closed.
ISBN 0-306-40615-2 costs 24.95, the set 89.90.
Order no. 2024-118834, lot 66-0192, shelf B7.
Train 4711 leaves at 07:42 from track 12.
It covers 12 742 km and weighs 5 972 units.
Chapter 3.1.4, figure 12, pages 204-219.
Scores were 21-19, 18-21 and 21-17.
Population rose from 48 210 to 51 874 by 2011.
The plate was HH-AB 1234 and the fine 35 euros.
ZIP 30301-4402, box 118.
Cells 4 9 13 22 31 40 were empty.
MAC a4:5e:60:c1:7b:02, serial 55-20193-7.
Coordinates 48.8566 2.3522 at 35 m.
Her tax number is 21/815/08150.
Meeting id 845 2291 0037, passcode 118204."""


@pytest.mark.parametrize(("sentences", "least"), [(DEVELOPED, (24, 26, 28, 14, 16, 18)), (FRESH, (24, 26, 24, 16, 18, 16))])
def test_field_on_sentences_written_by_hand(sentences, least):
    field = pii_crf.trained()
    kinds = pii_crf.KINDS
    hit = found = true = added_hit = added = beyond = 0
    for line in sentences.split("\n"):
        want, text = set(), ""
        for part in re.split(r"(\[(?:email|ip|card|phone) [^\]]*\])", line):
            if part.startswith("["):
                kind, own = part[1:-1].split(" ", 1)
                want.add((len(text), kinds.index(kind), len(text) + len(own)))
                text += own
            else:
                text += part
        base, spans = pii_crf.all_spans(field, [text])[0]
        assert set(base) <= set(spans)
        hit, found, true = hit + len(want & set(spans)), found + len(spans), true + len(want)
        new = set(spans) - set(base)
        added_hit, added, beyond = added_hit + len(want & new), added + len(new), beyond + len(want - set(base))
    print(f"all spans: precision {hit}/{found}, recall {hit}/{true}; the field's: precision {added_hit}/{added}, recall {added_hit}/{beyond}")
    # measured: right spans, all found, all true; the same of the field's own
    right, most, every, own, own_most, own_every = least
    assert (true, beyond) == (every, own_every) and hit >= right and found <= most and added_hit >= own and added <= own_most


def test_long_words_and_many_spans_are_whole():
    field = pii_crf.trained()
    long = "x" * 200_000
    # what differs after the first signs of a word, or beyond its first characters, is seen
    assert pii_crf.shape("a1" * 100 + "-7") != pii_crf.shape("a1" * 100 + "+7") and len(pii_crf.shape("a1" * 100_000)) < 20
    text = " ".join(f"write u{i}@mail.example or 020 7946 {1000 + i} now" for i in range(50)) + f" {long} 07700 900123 {long}"
    base, spans = pii_crf.all_spans(field, [text])[0]
    assert len(base) == 50 and len(spans) == 101
    a, _, b = spans[-1]
    assert text[a:b] == "07700 900123"
    # one text or many, with or without base spans before: the same spans
    alone = pii_crf.all_spans(field, ["or 020 7946 1000 now"])[0][1]
    assert [text[a:b] for a, k, b in spans if k == 3][0] == "020 7946 1000" and len(alone) == 1


def test_personal_data(spark):
    texts = ["Mail jo.b@x9.example.com, now.", "call (212) 555-0188 now", None, "", "card 4111 1111 1111 1111."]
    got = {r.doc_id: r for r in pii_crf.personal_data(frame(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    assert got[0].n_email == 1 and got[0].spans == "email:5:24" and got[4].n_card == 1 and got[2].spans == "" == got[3].spans
    assert got[1].n_phone == 0 and got[1].spans.startswith("phone:5:")
    for i, t in enumerate(texts):
        base = ",".join(f"{pii_crf.KINDS[k]}:{a}:{b}" for a, k, b in plain_spans(t or ""))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and got[i].n_spans == got[i].n_email + got[i].n_ip + got[i].n_card + got[i].n_phone + got[i].n_added
    assert pii_crf.personal_data(frame(spark, [])).count() == 0


def test_quality_figures(spark, rows):
    extra = [(900, "tick tock " * 60, "a"), (901, "a b\n a b\na b\n\n\n x # $ <|>", "a"), (902, None, None)]
    for r in quality_lines.judged(frame(spark, rows + extra)).collect():
        text = next(t for i, t, _ in rows + extra if i == r.doc_id) or ""
        w = WORD.findall(text)
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {i + j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w))
    assert quality_lines.judged(frame(spark, [])).count() == 0


def test_depleted_documents_go_and_copies_stay(spark):
    rng = random.Random(3)
    foot = "All about cookies and consent in one long line of words that every page has at its end"
    docs = [(i, prose(rng, 40) + "\n" + foot, "s") for i in range(30)] + [(100, (foot + "\n") * 1 + "few words here", "s")] + [(200 + i, "the same text " + " ".join(map(str, range(40))), "s") for i in range(30)]
    kept = {r.doc_id for r in quality_lines.accepted(frame(spark, docs)).collect()}
    assert kept == {i for i, _, _ in docs} - {100}
    assert quality_lines.accepted(frame(spark, docs)).columns == frame(spark, docs).columns


def kept_by_rule(docs):
    """op3 by plain Python: (kept, lines that go) of each row."""
    host = {}
    for _, t, s in docs:
        if t is not None:
            host.setdefault(s, set()).add(t)
    lines_of = lambda t: [x for x in t.split("\n") if WORD.search(x)]
    norm = lambda x: " ".join(WORD.findall(x)).lower()
    bad = {s: {x for x, n in Counter(x for t in ts for x in {norm(y) for y in lines_of(t)}).items() if n > max(0.1, 1.5 / math.sqrt(len(ts))) * len(ts)} for s, ts in host.items()}
    out = []
    for _, t, s in docs:
        w = WORD.findall(t or "")
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {i + j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(8)}
        size = sum(len(x) for x in lines_of(t or ""))
        lost = sum(len(x) for x in lines_of(t or "") if norm(x) in bad.get(s, ())) / size if size else 0
        out.append((len(w) >= 20 and 100 * len(again) <= 30 * len(w) and 1 - lost >= 0.3, {x for x in (t or "").split("\n") if WORD.search(x) and norm(x) in bad.get(s, ())}))
    return out


def test_quality_on_hosts_at_the_limit_with_nulls(spark):
    rng = random.Random(31)
    foot = "All about cookies and consent in one long line of words that pages have at their end, again and again and again, and on"
    docs = []
    for host, n, with_foot, nulls in (("a", 99, 15, 1), ("b", 99, 14, 0), ("c", 225, 23, 3), (None, 9, 5, 2), ("d", 4, 4, 1), ("e", 3, 2, 5), ("f", 1, 1, 0)):
        docs += [(None, (prose(rng, 6) + "\n" if i % 3 else "") + prose(rng, 5) + "\n  " + foot.replace(" ", "  " if i % 2 else " "), host) if i < with_foot else (None, prose(rng, 30), host) for i in range(n)]
        docs += [(None, None, host)] * nulls
    docs = [(i, t, s) for i, (_, t, s) in enumerate(docs)]
    want = kept_by_rule(docs)
    got = {r.doc_id: r.kept for r in quality_lines.judged(frame(spark, docs)).collect()}
    assert [got[i] for i in range(len(docs))] == [k for k, _ in want]
    assert {k for k, _ in want} == {True, False}
    clean = {r.doc_id: r.text for r in quality_lines.cleaned(frame(spark, docs)).collect()}
    assert clean == {i: "\n".join(x for x in t.split("\n") if x not in gone) for (i, t, _), (kept, gone) in zip(docs, want, strict=True) if kept}


def test_frequent_lines(spark):
    rng = random.Random(4)
    docs = [(i, "  Read   MORE here\n" + prose(rng, 10) + "\n\nread more here", "s") for i in range(12)] + [(50, "read more here", None), (51, None, "s"), (52, "", "s")]
    got = {r.doc_id: r for r in line_dedup.without_frequent_lines(frame(spark, docs)).collect()}
    for i, t, _ in docs:
        want = "\n".join(x for x in t.split("\n") if x.lower().split() != ["read", "more", "here"]) if i < 12 else t
        assert (got[i].text, got[i].n_chars) == (want, len(want) if want is not None else None), i
    assert line_dedup.without_frequent_lines(frame(spark, [])).count() == 0


@pytest.fixture(scope="module")
def classifier(spark):
    return license_scan.Classifier(spark)


WRAPPED = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software.""",
    "apache-2.0": """#   Licensed under the Apache License, Version 2.0 (the "License");
#   you may not use this file except in compliance with the License.
#   You may obtain a copy of the License at
#
#       http://www.apache.org/licenses/LICENSE-2.0""",
    "bsd": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
} | {
    family: f""" * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU {name}General Public License as published by
 * the Free Software Foundation, either version {version} of the License, or
 * (at your option) any later version."""
    for family, name, version in (("gpl-3.0", "", "3"), ("gpl-2.0", "", "2"), ("agpl-3.0", "Affero ", "3"), ("lgpl-2.1", "Lesser ", "2.1"), ("lgpl-3.0", "Lesser ", "3"))
}


def test_licences(spark, classifier):
    c = classifier
    texts = {
        "Licensed under the Apache License, Version 2.0.\nSome prose about a lake.": ("apache-2.0", 1), "It was released in May\nReleased under the MIT License.": ("mit", 1), "Of the public and the general licence fee": ("", 0), None: ("", 0), "": ("", 0), "word " * 30_000: ("", 0),
        "Licensed under the GNU GPL, version 2.": ("gpl-2.0", 1), "Released under the GNU Affero General Public License v3": ("agpl-3.0", 1), "// SPDX-License-Identifier: MIT": ("mit", 1), "# SPDX-License-Identifier: GPL-2.0-only": ("gpl-2.0", 1), "This work is licensed under CC BY-ND 4.0": ("cc-by-nd", 1),
        "prose " * 70 + "Licensed under the MIT License. " + "more prose " * 70: ("mit", 1), "Released under the MIT License.\n\nAll rights reserved.": ("mit,reserved", 2), "license " * 5000: ("", 0),
    }
    texts |= {t: (f, 1) for f, t in WRAPPED.items()} | {f"Some prose here\nand there.\n{t}\nmore prose\nwithout end": (f, 1) for f, t in WRAPPED.items()}
    got = {r.doc_id: (r.licences, r.n_notices) for r in license_scan.licences(frame(spark, [(i, t, "a") for i, t in enumerate(texts)]), c).collect()}
    for i, (t, want) in enumerate(texts.items()):
        assert got[i] == want, t
    assert license_scan.licences(frame(spark, []), c).count() == 0


def test_licence_notices_that_training_does_not_see(spark, classifier):
    held = license_scan.held_rows()
    assert not {p for _, p in held} & {p for _, p in license_scan.training_rows()}
    rows = license_scan.values(spark, held).withColumnRenamed("family", "own")
    wanted = {(p, f) for f, p in held if f != license_scan.UNKNOWN}
    found = {(r.paragraph, r.family) for r in classifier.confirmed(rows).collect()}
    assert len(found & wanted) >= 0.97 * len(wanted) and len(found - wanted) <= 0.03 * len(held)
    # the temperature is inside the grid, as some of the held rows are hard
    assert 0.05 < classifier.temperature < 0.05 * 1.15**39


def test_licence_scores_by_brute_force(spark, classifier):
    """Each step on plain Python: terms, hashing, regression, temperature, templates."""
    words = lambda t: [w for w in re.split(r"[^\w]+|_", t.lower()) if w]
    telling = lambda w: w in license_scan.TELLING or w == "version" or re.search("[0-9]", w)
    sets = lambda t: {tuple(words(t)[i : i + 3]) for i in range(max(1, len(words(t)) - 2)) if any(telling(w) for w in words(t)[i : i + 3])}
    matrix, bias = classifier.model.coefficientMatrix.toArray(), classifier.model.interceptVector.toArray()
    paragraphs = [p for _, p in license_scan.held_rows()][::7] + [t for t in WRAPPED.values()]
    want = {}
    for p in paragraphs:
        w = words(p)
        x = np.zeros(license_scan.FEATURES)
        x[[classifier.hashing.indexOf(t) for t in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]]] = 1
        raw = matrix @ x + bias
        odds = np.exp((raw - raw.max()) / classifier.temperature)
        odds = dict(zip(classifier.names, odds / odds.sum(), strict=True))
        if odds[license_scan.UNKNOWN] > 1 - license_scan.LEAST_PROBABILITY:
            continue
        scores = sorted(((len(sets(t) & sets(p)) / len(sets(t)), len(sets(t) & sets(p)), f, frozenset(sets(t) & sets(p))) for f, t in license_scan.templates()), key=lambda x: x[:3], reverse=True)
        scores = [x for x in scores if x[0] >= license_scan.LEAST_SHARE]
        base = lambda f: f.split("-")[0] if f.split("-")[0] in license_scan.BASES else f
        seen, taken = set(), []
        for share, hit, f, own in scores:
            if 2 * len(own - seen) > hit and not any(u[0] == share and u[3] == own and u[2] != f for u in scores):
                seen |= own
                taken.append((f, share))
        total = sum(x for n, x in odds.items() if base(n) in {base(f) for f, _ in taken})
        if total >= license_scan.LEAST_PROBABILITY:
            want |= {(p, f): (round(total, 6), round(share, 6)) for f, share in taken}
    got = {(r.paragraph, r.family): (round(r.probability, 6), round(r.share, 6)) for r in classifier.confirmed(spark.createDataFrame([(p,) for p in paragraphs], "paragraph string")).collect()}
    assert got == want and len(want) > 50


HEADERS = {"c": ("/*", " * ", " */"), "hash": ("#", "# ", "#"), "plain": ("", "", "")}


@pytest.mark.parametrize("style", HEADERS)
def test_versions_of_notices_in_wrapped_headers(spark, classifier, style):
    """Every template with a version, behind every number of words that a window's step has, wrapped and commented."""
    before, each, after = HEADERS[style]
    rng = random.Random(2)
    rows, want = [], []
    for family, notice in license_scan.notices():
        if family.partition("-")[0] in license_scan.GNU_VERSIONS and "-" in family:
            for k in range(license_scan.STRIDE):
                words, lines = [*prose(rng, k).split(), *notice.split(), *"This program is distributed in the hope that it will be useful".split()], [[]]
                for w in words:
                    if len(" ".join([*lines[-1], w])) > 70:
                        lines.append([])
                    lines[-1].append(w)
                rows.append((len(rows), "\n".join([before, *(each + " ".join(x) for x in lines), after]), "a"))
                want.append(family)
    got = {r.doc_id: r.licences for r in license_scan.licences(frame(spark, rows), classifier).collect()}
    right = sum(got[i] == f for i, f in enumerate(want))
    assert right == len(want), (right, len(want), [(rows[i][1], got[i], f) for i, f in enumerate(want) if got[i] != f][:2])


#: Written after the classifier, in words that it wasn't fitted on, and scored as they are.
UNSEEN = (
    ("Dual licensed under the MIT License and the Apache License, Version 2.0.", "apache-2.0,mit"), ("SPDX-License-Identifier: MIT OR Apache-2.0", "apache-2.0,mit"), ("// SPDX-License-Identifier: (GPL-2.0-only OR BSD-2-Clause)", "bsd-2-clause,gpl-2.0"),
    ("License: MIT", "mit"), ("License: GPLv3", "gpl-3.0"), ("GPLv3 licensed", "gpl-3.0"), ("Licence: Creative Commons Attribution 4.0", "cc-by"), ("License: Apache-2.0", "apache-2.0"), ("licence: CC BY-SA 4.0", "cc-by-sa"), ("License: BSD-3-Clause", "bsd-3-clause"),
    ("Our library comes under the terms of the MIT License, so do what you like with it.", "mit"), ("The whole site is published under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"), ("You are free to share these pictures under the Creative Commons Attribution-ShareAlike 4.0 License.", "cc-by-sa"),
    ("Code in this folder falls under the Mozilla Public License, v. 2.0.", "mpl-2.0"), ("the solver is free software, licensed under the GNU Lesser General Public License v3", "lgpl-3.0"), ("These fonts and scripts are distributed under the Boost Software License, Version 1.0.", "bsl-1.0"),
    ("Everything here may be used under the Eclipse Public License 2.0 unless a file says otherwise.", "epl-2.0"), ("The data set is dedicated to the public under CC0 1.0 Universal", "cc0"), ("Distributed with the tool under the zlib/libpng license", "zlib"), ("we ship it under the ISC License since last year", "isc"),
    ("Copyright 2019 by the authors of this page. All rights reserved.", "reserved"), ("This project is released under the 3-Clause BSD License.", "bsd-3-clause"), ("Made available to you under the Apache 2.0 license", "apache-2.0"), ("all sources are covered by the GNU General Public License, version 2", "gpl-2.0"), ("Use is subject to the GNU Affero General Public License v3", "agpl-3.0"),
    ("He compared the MIT License and the Apache License in a long essay for the journal.", ""), ("My fishing licence was reserved at the public library.", ""), ("The general public held a license to walk there under the old law.", ""), ("An apache pilot with a license told the story of a mozilla fan.", ""),
    ("Permission to sing in the hall was granted to the choir by the owner of the copyright.", ""), ("The software was not sold with a warranty, said the judge on Monday.", ""), ("Version 2 of the licence fee was rejected in parliament.", ""), ("Which rights does a tenant have, and which are reserved to the landlord?", ""),
)


def test_licences_of_unseen_notices(spark, classifier):
    got = {r.doc_id: r.licences for r in license_scan.licences(frame(spark, [(i, t, "a") for i, (t, _) in enumerate(UNSEEN)]), classifier).collect()}
    pairs = [({x for x in got[i].split(",") if x}, {x for x in want.split(",") if x}) for i, (_, want) in enumerate(UNSEEN)]
    hit, found, true = (sum(len(f(g, w)) for g, w in pairs) for f in (lambda g, w: g & w, lambda g, w: g, lambda g, w: w))
    wrong = [(t, got[i]) for i, (t, w) in enumerate(UNSEEN) if got[i] != w]
    assert  hit >= 0.9 * true and hit >= 0.9 * found, (hit, found, true, wrong)


def test_licence_units_without_a_telling_word_hold_no_template():
    assert max(len(re.findall(r"[^\W_]+", t)) for _, t in license_scan.templates()) <= license_scan.LONGEST
    for _, t in license_scan.templates():
        w = [x for x in re.split(r"[^a-z0-9]+", t.lower()) if x]
        sets = {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2)) if any(x in license_scan.TELLING or x == "version" or re.search("[0-9]", x) for x in w[i : i + 3])}
        assert sets and sum(not any(x in license_scan.TELLING for x in s) for s in sets) < license_scan.LEAST_SHARE * len(sets), t


def test_repeated_passages(spark):
    rng = random.Random(9)
    passage = prose(rng, 60)
    docs = [(i, prose(rng, 50) + " " + passage + " " + prose(rng, 50), "a") for i in range(3)] + [(10 + i, prose(rng, 100), "a") for i in range(20)] + [(40, passage, "a"), (50, None, "a"), (51, "", "a"), (None, passage, "a")]
    got = {r.doc_id: r for r in chunk_dedup.repeated_passages(frame(spark, docs)).collect()}
    assert set(got) == {0, 1, 2, 40, None} and got[None].n_copied_bytes == 0 and got[1].n_copied_bytes >= 128
    text = docs[1][1].encode()
    for span in got[1].spans.split(","):
        a, b = map(int, span.split(":"))
        assert text[a:b] in docs[0][1].encode() or passage.encode() in text[max(0, a - 200) : b + 200]
    assert chunk_dedup.repeated_passages(frame(spark, [])).count() == 0


def test_every_passage_of_51_words_is_found(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(1, 9 if short else 12)))
    docs = []
    for i in range(600):
        short = i % 2
        passage = " ".join(word() for _ in range(51))
        docs += [(2 * i + k, " ".join(word() for _ in range(rng.randrange(60))) + " " + passage + "\n" + " ".join(word() for _ in range(rng.randrange(60))), "a") for k in (0, 1)]
    docs += [(5000 + i, " ".join(word() for _ in range(120)), "a") for i in range(100)]
    got = {r.doc_id: r for r in chunk_dedup.repeated_passages(frame(spark, docs)).collect()}
    assert set(got) == set(range(1200))
    assert all(got[i].n_copied_bytes > 50 and i - 1 in got[i].copies_of for i in got if i % 2)
    assert all(got[i].n_copied_bytes <= got[i].n_bytes for i in got)


def test_copied_spans_by_brute_force(spark):
    """The same chunks and seeds, joined on plain Python: spans, copied bytes, and the texts without copies."""
    rng = random.Random(17)
    passages = [prose(rng, 70), prose(rng, 55), prose(rng, 30) + " é ü ñ " * 30]
    docs = [(i, " ".join([prose(rng, rng.randrange(5, 80)), *(rng.choice(passages) for _ in range(rng.randrange(0, 3))), prose(rng, rng.randrange(5, 60))]), "a") for i in range(40)]
    docs += [(50, None, "a"), (51, "", "a"), (52, "tick tock " * 400, "a"), (53, docs[3][1], "a"), (54, docs[3][1] + " and more", "a"), (3, docs[3][1], "a"), (5, passages[0], "a"), (60, "x" * 50_000, "a")]
    docs += [(None, passages[0] + " " + prose(rng, 30), "a"), (None, prose(rng, 90) + " " + passages[1], "a"), (None, docs[3][1], "a"), (None, prose(rng, 40), "a"), (None, passages[0] + " twice " + passages[0], "a"), (None, docs[3][1], "a"), (-(2**63) + 5, passages[2] + " of no id", "a")]
    c = chunk_dedup.Chunker()
    pieces, texts = [], {}
    for n, (doc, t, _) in enumerate(docs):
        key = None if not t else ("", hashlib.blake2b(t.encode(), digest_size=8).digest()) if doc is None or doc < -(2**62) else (doc, t)
        if t and key not in texts:
            texts[key] = n
            raw = t.encode()
            ends, digests = c.chunks(raw)
            seen = set()
            for seed, rows in ((False, zip([0, *ends.tolist()], ends.tolist(), digests.tolist(), strict=False)), (True, zip(*[x.tolist() for x in c.seeds(raw)], strict=True))):
                for a, b, d in rows:
                    pieces.append((n, a, b, d, (d, seed) in seen, seed))
                    seen.add((d, seed))
    # documents in order: those without an id first, by digest; texts of one id are one
    who = {n: (0, key[1]) if key[0] == "" else (1, key[0]) for key, n in texts.items()}
    holders = {}
    for n, _, _, d, _, _ in pieces:
        holders.setdefault(d, set()).add(who[n])
    spans = {}
    for n in sorted({p[0] for p in pieces}):
        mine = sorted({(a, b, min(holders[d]) if len(holders[d]) > 1 else who[n], again or min(holders[d]) < who[n], seed) for j, a, b, d, again, seed in pieces if j == n and (len(holders[d]) > 1 or again)})
        groups = []
        for p in mine:
            if groups and p[0] <= max(q[1] for q in groups[-1]):
                groups[-1].append(p)
            else:
                groups.append([p])
        for g in groups:
            a, b = g[0][0], max(q[1] for q in g)
            if b - a >= chunk_dedup.LEAST_BYTES or any(q[4] for q in g):
                spans.setdefault(n, []).append((a, b, len({k for q in g if q[3] for k in range(q[0], q[1])})))
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.spans, r.n_copied_bytes) for r in chunk_dedup.repeated_passages(frame(spark, docs)).collect()))
    has = lambda n: docs[n][0] is not None and docs[n][0] >= -(2**62)
    assert got == sorted((has(n), docs[n][0] if has(n) else 0, ",".join(f"{a}:{b}" for a, b, _ in s), sum(x for *_, x in s)) for n, s in spans.items())
    assert sum(not x[0] for x in got) == 5 and sum(x[1] in (3, 5) for x in got) >= 3
    # as the checks below know documents by their id
    want = {docs[n][0]: s for n, s in spans.items() if has(n)}
    pieces = [(docs[n][0], *rest) for n, *rest in pieces if has(n)]
    holders = {d: {w[1] if w[0] else -(2**63) for w in ws} for d, ws in holders.items()}
    clean = chunk_dedup.without_copies(frame(spark, docs))
    assert clean.columns == frame(spark, docs).columns
    left = {}
    for r in clean.collect():
        left.setdefault(r.doc_id, []).append(r.text)
        assert r.n_chars == (len(r.text) if r.text is not None else None)
    assert left[50] == [None] and left[51] == [""] and len(left[3]) == 2 and len("".join(x for i in range(40) for x in left[i])) < 0.8 * sum(len(t) for i, t, _ in docs if i is not None and 0 <= i < 40)
    # of the chunks of counted spans go, in runs of 64 bytes, those that an earlier document holds, and repeats of those that none does
    for i, t, _ in docs:
        if i in want and i not in (3, 5):  # those of one text
            mine = [(a, b, d) for j, a, b, d, _, seed in pieces if j == i and not seed]
            counted = {d for a, b, d in mine if any(x <= a and b <= y for x, y, _ in want[i])}
            flag = [d in counted and (min(holders[d]) < i or d in {e for *_, e in mine[:k]}) for k, (_, _, d) in enumerate(mine)]
            raw, kept, k = t.encode(), b"", 0
            while k < len(mine):
                m = k
                while m < len(mine) and flag[m] == flag[k]:
                    m += 1
                if not flag[k] or mine[m - 1][1] - mine[k][0] < 64:
                    kept += raw[mine[k][0] : mine[m - 1][1]]
                k = m
            assert left[i][0].encode().replace("é".encode(), b"") == kept.decode(errors="ignore").encode().replace("é".encode(), b""), i
    assert all(len(t) < 60 for t in left[53]) and passages[0] in "".join(x or "" for ts in left.values() for x in ts)


def test_seeds_of_a_repeated_word_are_spaced():
    c = chunk_dedup.Chunker()
    for text in (b"tick tock " * 2000, b"word " * 4000):
        c.chunks(text)
        start, end, digest = c.seeds(text)
        assert len(start) <= 4000 // 20 and (start[1:] <= end[:-1] + 1).all() and len(set(digest.tolist())) == 1


def test_chunks_resist_shifts():
    rng = random.Random(2)
    c = chunk_dedup.Chunker()
    text = prose(rng, 500).encode()
    _, one = c.chunks(text)
    _, two = c.chunks(b"inserted " + text)
    assert len(set(one.tolist()) & set(two.tolist())) >= len(set(one.tolist())) - 2
    ends, _ = c.chunks(text)
    assert ends[-1] == len(text) and (np.diff(ends) > 0).all()


def test_packing(spark, rows):
    from tokenizers import Tokenizer

    odd = ["it's we'll <|endoftext|> é   x y", "ÀÉ ß№ ½ 12 3a", "a" * 9000]
    docs = rows + [(300 + i, t, "a") for i, t in enumerate(odd)]
    got = packing.packed(frame(spark, docs)).collect()
    whole = Tokenizer.from_file(packing.tokenizer_path(packing.TOKENIZER))
    want = Counter()
    for i, t, _ in docs:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        for a in range(0, len(ids), 4096):
            want[i, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    filled = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 4096 and set(filled) == set(range(len(filled)))
    assert packing.packed(frame(spark, [])).count() == 0


def test_packing_in_parts(spark, rows, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 2)
    docs = [*rows, *((1000 + i, "same words here", "a") for i in range(30))]
    got = packing.packed(frame(spark, docs), size=64).collect()
    filled = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 64 and set(filled) == set(range(len(filled)))
    assert {(r.doc_id, r.start, r.length) for r in got} == {(r.doc_id, r.start, r.length) for r in packing.pieces(frame(spark, docs), size=64).collect()}


def test_packing_memory(spark, rows, monkeypatch):
    monkeypatch.setattr(packing, "MEMORY", 40)
    enc = packing.Encoder(packing.tokenizer_path(packing.TOKENIZER))
    texts = ["x" * 5000 + " \u6f22" * 3 + "\u6f22" * 900, *(t or "" for _, t, _ in rows), "Upper, UPPER. upper! it's"]
    for t in texts:
        assert enc.ids(t) == np.array(enc.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    # pieces and runs share one bounded memory, and long ones aren't in it
    held = [enc, *(v for k, v in vars(enc).items() if isinstance(v, dict) and k != "bytes_as")]
    assert sum(map(len, held)) <= 40 and max(len(k) for d in held for k in d) <= 32
    # no rows come from the driver's Python, whose workers would stay beside those that encode
    assert "ExistingRDD" not in packing.packed(frame(spark, rows))._jdf.queryExecution().toString()


def test_trimmed(monkeypatch):
    calls, freed = [], []

    class Batch:
        def __del__(self):
            freed.append(len(calls))

    def run(batches):
        for batch in batches:
            yield id(batch)

    monkeypatch.setattr(shared.ctypes, "CDLL", lambda name: type("C", (), {"malloc_trim": staticmethod(calls.append)}))
    assert len(list(shared.trimmed(run)(Batch() for _ in range(3)))) == 3 and calls == [0] and freed == [0, 0, 0]
    monkeypatch.setattr(shared.ctypes, "CDLL", lambda name: object())
    assert list(shared.trimmed(iter)([1, 2])) == [1, 2]


def test_placements_fill_well():
    rng = random.Random(1)
    lengths = Counter(min(4096, int(rng.expovariate(1 / 900)) + 1) for _ in range(20_000))
    lines = packing.placements(lengths)
    assert Counter({k: sum(c for l, _, c, _, _ in lines if l == k) for k in lengths}) == lengths
    packs = max(f + c for _, _, c, f, _ in lines)
    assert sum(k * n for k, n in lengths.items()) / (packs * 4096) > 0.98


def test_mixture(spark):
    rng = random.Random(6)
    docs = [(i, prose(rng, 30), "big") for i in range(200)] + [(1000 + i, prose(rng, 30), "mid") for i in range(60)] + [(2000 + i, prose(rng, 30), None) for i in range(20)] + [(3000, None, "empty"), (3001, "", "empty")]
    got = mixing.mixture(frame(spark, docs)).collect()
    uses = Counter(r.doc_id for r in got)
    assert set(uses) == {i for i, _, _ in docs} and max(uses.values()) <= 2
    tokens = {"big": 6000, "mid": 1800, "null": 600}
    alpha = mixing.bisect_alpha(tokens, limit=2.0)
    passes = mixing.repetitions(tokens, mixing.weights_for(tokens, alpha))
    assert max(passes.values()) <= 2 + 1e-9 and abs(max(passes.values()) - 2) < 1e-6
    for source, name in (("big", "big"), ("mid", "mid"), (None, "null")):
        mine = sorted((r.position, r.n_tokens) for r in got if r.source == source)
        assert mine == [(30 * k, 30) for k in range(len(mine))] and len(mine) * 30 - 30 < passes[name] * tokens[name] <= len(mine) * 30 + 1
    flat = mixing.weights_for(tokens, mixing.bisect_alpha(tokens, entropy=1.0))
    assert abs(-sum(w * np.log(w) for w in flat.values()) - 1.0) < 1e-6
    # the plan over the table of sources is that over a few on the driver, for both targets
    counts = spark.createDataFrame([(s, n, 1) for s, n in tokens.items()] + [("none", 0, 2)], "mix_source string, tokens long, docs long")
    for entropy in (None, 1.0):
        want = mixing.weights_for(tokens, mixing.bisect_alpha(tokens, entropy=entropy, limit=2.0))
        often = mixing.repetitions(tokens, want)
        for r in mixing.source_plan(counts, entropy, 2.0).collect():
            assert abs(r.weight - want.get(r.mix_source, 0)) < 1e-6 and abs(r.passes - often.get(r.mix_source, 1)) < 1e-5
    # by hand: the least source, a tenth of the most, may repeat twice, so 10 ** (1 - alpha) = 2
    by_hand = 1 - math.log(2) / math.log(10)
    assert abs(alpha - by_hand) < 1e-6
    raw = {s: (n / 8400) ** by_hand for s, n in tokens.items()}
    assert {(r.source or "null", round(r.weight, 5)) for r in got if r.n_tokens} == {(s, round(x / sum(raw.values()), 5)) for s, x in raw.items()}
    # rows without a doc_id take places of their own
    none = mixing.mixture(frame(spark, [(None, prose(rng, 20 + i), "a") for i in range(50)])).collect()
    assert len({r.position for r in none}) == 50 and sum(r.n_tokens for r in none) == sum(20 + i for i in range(50))
    again = mixing.mixed_documents(frame(spark, docs))
    assert again.columns == frame(spark, docs).columns and {r.doc_id for r in again.collect()} == set(uses)
    assert mixing.mixture(frame(spark, [])).count() == 0


def test_scratch_leaves_only_what_results_read(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_folder", lambda spark: f"file://{tmp_path}")
    tables = lambda: {p for p in tmp_path.iterdir() if not p.name.startswith(".")}
    for run in (lambda: sketch_dedup.near_copies(frame(spark, rows)), lambda: quality_lines.judged(frame(spark, rows)), lambda: embed_dedup.near_vectors(spark.createDataFrame([(i, [1.0, i % 3 + 0.0]) for i in range(9)], "vec_id long, embedding array<double>"))):
        known = tables()
        out = run()
        assert len(tables() - known) == 1 and out.count() > 0
    known = tables()
    with pytest.raises(ValueError), shared.scratch(spark):
        shared.stored(spark.range(3))
        raise ValueError
    assert tables() == known
