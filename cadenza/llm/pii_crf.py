"""Personal data in texts: exact patterns, and a linear-chain conditional random field over word shapes.

The patterns give the base spans. The field reads runs of words that hold a digit, an @ or a +, with the word on either
side, and labels every word as outside or as the beginning or inside of one of the four kinds. Its features are the
shapes of the word, fine and coarse, those of both neighbours, and what is known of the figures that the word stands among
(`facts`): how many digits, whether they pass Luhn, whether an address's parts are in range. It is trained on the driver, by
gradient ascent of the conditional log-likelihood, from a small labelled table (`labelled_runs`), and decoded by Viterbi for
many runs at a time. Spans of the field that touch no base span are added; base spans always stay.

Defined results: a null text is an empty one, without spans; offsets are code points, ends exclusive; words are read whole,
however long; repeated rows give repeated results; a null doc_id is kept; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship

ship(__name__)

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Starting only where a run of digits does keeps the scan linear and finds the same: a run that fails at its first digit fails at all.
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ACTIVE = re.compile(r"[0-9@+]")
SPACE = re.compile(r"\s")
AREA = re.compile(r"\([0-9]+\)")
AGAIN = re.compile(r"(.{2,8}?)\1{2,}")
NUMBER = re.compile(r"\+?[0-9()][0-9()./-]*")
YEAR = re.compile(r"(?:19|20)[0-9]{2}")
QUAD = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
SIX = re.compile(r"[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:[0-9A-Fa-f:]*")
FEATURES = 5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted: what the patterns find, leftmost and not overlapping within a kind."""
    out = []
    last = 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            a = m.start()
            while a > last and text[a - 1] in LOCAL:
                a -= 1
            if a < m.start():
                out.append((a, 0, m.end()))
                last = m.end()
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in (m[0].split(".", 1)[0], m[1], m[2], m[3])):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if 14 <= m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def core(text: str, a: int, b: int) -> tuple[int, int]:
    """The word without the marks around it; an area code keeps its brackets."""
    if AREA.match(text, a, b):
        return a, b
    while a < b and text[a] in "([{<\"'":
        a += 1
    while b > a and text[b - 1] in ".,;:!?)]}>\"'" and not (text[b - 1] == ")" and "(" in text[a:b]):
        b -= 1
    return a, b


def shape(word: str) -> str:
    """Runs of letters as a, of digits as 9 with their number up to 20, all else as it is; what repeats is written once, with a star."""
    out = re.sub(r"[0-9]+", lambda m: f"9{min(20, len(m[0]))}", re.sub(r"[^\W\d_]+", "a", word))
    return AGAIN.sub(r"\1*", out)


def coarse(s: str) -> str:
    """The shape without the lengths of its runs of digits."""
    return re.sub(r"9\d+", "9", s)


def facts(words: list[str]) -> list[str]:
    """Of each word what is known of its figures: of the stretch of number words that it stands in, the digits and whether they pass Luhn."""
    out = [""] * len(words)
    i = 0
    while i < len(words):
        j = i
        while j < len(words) and NUMBER.fullmatch(words[j]):
            j += 1
        if j > i:
            digits = "".join(c for w in words[i:j] for c in w if "0" <= c <= "9")
            years = all(YEAR.fullmatch(w) for w in words[i:j])
            known = f"{min(20, len(digits))}{'L' if 13 <= len(digits) <= 19 and luhn(digits) else ''}{'y' if years else ''}{'0' if digits[:1] == '0' else ''}"
            for k in range(i, j):
                out[k] = known
        i = max(j, i + 1)
    for k, w in enumerate(words):
        if QUAD.fullmatch(w) and max(map(len, w.split("."))) <= 3:
            out[k] = "quad" if max(map(int, w.split("."))) <= 255 else "no quad"
        elif SIX.fullmatch(w) and (w.count(":") == 7 or w.count("::") == 1 and w.count(":") < 8):
            out[k] = "six"
    return out


Sign = tuple[str, str]


def signs(words: list[str]) -> list[Sign]:
    """Shape and facts of the words of a run."""
    return list(zip(map(shape, words), facts(words), strict=True))


def features(run: list[Sign]) -> list[tuple[str, str, str, str, str]]:
    """Of each word of a run: its shape, its coarse shape, those of its neighbours, and its facts."""
    c = ["$", *(coarse(x) for x, _ in run), "$"]
    return [(x, c[i + 1], c[i], c[i + 2], known) for i, (x, known) in enumerate(run)]


def words_of(text: str) -> list[list[tuple[int, int]]]:
    """Runs of active words as (start, end), each with the word before and after, if any."""
    runs: list[list[tuple[int, int]]] = []
    pos, n = 0, len(text)
    while m := ACTIVE.search(text, pos):
        a = m.start()
        while a > pos and not text[a - 1].isspace():
            a -= 1
        end = SPACE.search(text, m.end())
        b = end.start() if end else n
        gap = a
        while gap > 0 and text[gap - 1].isspace():
            gap -= 1
        if runs and runs[-1][-1][1] == gap and gap:
            runs[-1].append((a, b))
        else:
            runs.append([(a, b)])
        pos = b
    for run in runs:
        b = run[0][0]
        while b > 0 and text[b - 1].isspace():
            b -= 1
        a = b
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        e = run[-1][1]
        while e < n and text[e].isspace():
            e += 1
        f = e
        while f < n and not text[f].isspace():
            f += 1
        if b > a:
            run.insert(0, (a, b))
        if f > e:
            run.append((e, f))
    return runs


#: The labelled table's templates: personal data by kind, and what looks like it and isn't.
PATTERNS = {
    "email": ("w.99@w9.w.com", "w@w.org", "w_w+9@w-w.w"),
    "card": ("C9999999999999999", "C9999 9999 9999 9999", "C9999-9999-9999-9999", "C9999.9999.9999.9999", "C9999/9999/9999/9999", "C9999 999999 99999"),
    "phone": (
        "+1 (999) 555-9999", "+99 999 9999 9999", "+99999999999", "+99 9 99 99 99 99", "+99 (0) 999 999999", "(999) 999-9999", "(999) 999 9999", "999-999-9999", "999.999.9999", "999 999 9999", "1-999-999-9999", "1 999 999 9999",
        "09999 999999", "099 9999 9999", "0999 999 9999", "09 99 99 99 99", "09.99.99.99.99", "0999/9999999", "0999-9999999", "099-999 99 99", "(099) 9999 9999", "(09999) 999999", "0099 999 9999999", "09999 999 999", "099 99999999",
    ),
}
OTHERS = (
    "9.9", "9", "99", "9999", "99999", "9.9.9", "1999-99-99", "99.99.1999", "99/99/2099", "password=w99w999", "\"999w9999w999999\"", "AKIAw9w", "99%", "w@w", "999,999", "99:99", "99:99:99", "+", "+9", "99 99 9 999 9", "9999999",
    "99999999999999999999", "X9999 9999 9999 9999", "X9999999999999999", "X9999-9999-9999-9999", "X9999.9999.9999.9999", "w99 9999 9999 9999 9999 99", "w99 w 9999 9999 9999 99", "999-9-99-999999-9", "9 999 999", "99 999 999", "9,999,999.99", "99999-9999", "99.9999 99.9999",
    "9999-9999", "999-99-9999", "w999999999", "99:9w:9w:99:9w:99", "$9,999", "9-9", "999-999", "99-99999-99", "9w9w9w9w99w9w", "no.9999/99", "9x99", "999 w 999", "99 000 000", "9.99 9.99 9.99", "9999 999", "99 w 99 w", "9/99", "1w 999 w9 99 9999 9999", "9 9 9 9 9 9 9 9 9", "9 9 9 9", "9 9 99 9 99 99 9", "99 99 99 99 99 99 99 99 99", "999 99 9999 9 999 99", "9.9 9.9 9.9 9.9 9.9", "999 999 999 999 999", "9999 9999",
)


def labelled_runs() -> list[tuple[list[str], list[str]]]:
    """The labelled table: words and labels. What stands in the slots is drawn by a fixed rule.

    In a template 9 stands for a digit, w for a word; C marks figures that pass Luhn, X figures that don't.
    """
    g = np.random.default_rng(20260301)
    w = lambda: "".join(g.choice(list("abdefghilmnoprstu"), g.integers(2, 9)))
    rows: list[tuple[list[str], list[str]]] = []

    def filled(template: str) -> str:
        passes = {"C": True, "X": False}.get(template[0])
        body = template[1:] if passes is not None else template
        while True:
            out = "".join(str(g.integers(0, 10)) if c == "9" else w() if c == "w" else c for c in body)
            if passes is None or luhn("".join(c for c in out if c.isdigit())) == passes:
                return out

    def add(middle: str, kind: str | None) -> None:
        parts = middle.split()
        tag = [f"{'I' if i else 'B'}-{kind}" if kind else "O" for i in range(len(parts))]
        end = g.choice(["", "", ",", "."])
        before, after = [w()] if g.random() < 0.9 else [], [w()] if g.random() < 0.9 else []
        parts[-1] += end
        rows.append((before + parts + after, ["O"] * len(before) + tag + ["O"] * len(after)))

    for _ in range(10):
        add(".".join(str(x) for x in g.integers(1, 256, 4)), "ip")
        add(".".join(str(x) for x in [*g.integers(1, 256, 3), g.integers(256, 1000)]), None)
        add(":".join(f"{x:x}" for x in g.integers(4096, 65536, 8)), "ip")
        add("::".join(f"{x:x}" for x in g.integers(16, 65536, 2)), "ip")
        add("%x:%x::%x" % tuple(g.integers(16, 65536, 3)), "ip")
        add(" ".join(str(x) for x in g.integers(1900, 2100, g.integers(2, 6))), None)
        for kind, templates in PATTERNS.items():
            for t in templates:
                add(filled(t), kind)
        for t in OTHERS:
            add(filled(t), None)
    return rows


class Field:
    """Weights by label of each of a word's features, and of label pairs."""

    def __init__(self, tables: list[dict[str, np.ndarray]], pairs: np.ndarray, prior: np.ndarray):
        self.tables, self.pairs, self.prior = tables, pairs, prior

    def scores(self, run: list[Sign]) -> np.ndarray:
        out = np.tile(self.prior, (len(run), 1))
        for row, found in zip(out, features(run), strict=True):
            for table, f in zip(self.tables, found, strict=True):
                if (w := table.get(f)) is not None:
                    row += w
        return out


def allowed() -> np.ndarray:
    """-inf for label pairs that no spans have: inside a kind follows its beginning or inside only."""
    out = np.zeros((len(LABELS), len(LABELS)))
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            out[[i for i, a in enumerate(LABELS) if a[2:] != b[2:]], j] = -1e9
    return out


def trained(rows: list[tuple[list[str], list[str]]] | None = None, steps: int = 100, penalty: float = 0.02) -> Field:
    rows = rows or labelled_runs()
    shapes = [signs([x[slice(*core(x, 0, len(x)))] for x in words]) for words, _ in rows]
    index: dict[tuple[int, str], int] = {}
    size, most, k = len(rows), max(map(len, shapes)), len(LABELS)
    at = np.zeros((size, most, FEATURES), int)
    gold, mask = np.zeros((size, most), int), np.zeros((size, most), bool)
    for i, (s, (_, tags)) in enumerate(zip(shapes, rows, strict=True)):
        for t, found in enumerate(features(s)):
            at[i, t] = [index.setdefault((f, v), len(index) + 1) for f, v in enumerate(found)]
            gold[i, t], mask[i, t] = LABELS.index(tags[t]), True
    n, hard = len(index) + 1, allowed()
    first = np.array([-1e9 if x[0] == "I" else 0.0 for x in LABELS])
    # fixed: nothing seen means outside
    params = [np.zeros((n, k)), np.zeros((k, k))]
    prior = np.zeros(k)
    prior[0] = 3.0
    seen_pairs = np.zeros((k, k))
    np.add.at(seen_pairs, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1)
    target = np.zeros((n, k))
    for f in range(FEATURES):
        np.add.at(target, (at[..., f][mask], gold[mask]), 1)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    lse = lambda x, axis: np.log(np.exp(x - x.max(axis=axis, keepdims=True)).sum(axis=axis)) + x.max(axis=axis)
    for step in range(1, steps + 1):
        emit = params[0][at].sum(axis=2) + prior
        trans = params[1] + hard
        alpha, beta = np.zeros((size, most, k)), np.zeros((size, most, k))
        alpha[:, 0] = emit[:, 0] + first
        for t in range(1, most):
            new = lse(alpha[:, t - 1, :, None] + trans, 1) + emit[:, t]
            alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
        for t in range(most - 2, -1, -1):
            new = lse(trans + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], new, 0)
        z = lse(alpha[:, -1], 1)
        node = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        expect = np.zeros((n, k))
        for f in range(FEATURES):
            np.add.at(expect, at[..., f], node)
        edge = np.zeros((k, k))
        for t in range(1, most):
            e = np.exp(alpha[:, t - 1, :, None] + trans + (emit[:, t] + beta[:, t])[:, None, :] - z[:, None, None])
            edge += (e * mask[:, t, None, None]).sum(axis=0)
        for p, g, m in zip(params, (target - expect - penalty * params[0], seen_pairs - edge - penalty * params[1]), moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            p += 0.15 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    tables: list[dict[str, np.ndarray]] = [{} for _ in range(FEATURES)]
    for (f, v), i in index.items():
        tables[f][v] = params[0][i]
    return Field(tables, params[1] + hard, prior)


def decoded(field: Field, runs: list[list[Sign]]) -> list[np.ndarray]:
    """The best labels of each run, by Viterbi over many runs of like length at a time."""
    out: list[np.ndarray] = [np.zeros(0, int)] * len(runs)
    order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
    k = len(LABELS)
    first = np.array([-1e9 if x[0] == "I" else 0.0 for x in LABELS])
    at = 0
    while at < len(order):
        part = [order[at]]
        while at + len(part) < len(order) and len(part) < 1024 and (len(part) + 1) * len(runs[order[at + len(part)]]) <= 1 << 16:
            part.append(order[at + len(part)])
        at += len(part)
        sizes = np.array([len(runs[i]) for i in part])
        most = int(sizes.max())
        emit = np.zeros((len(part), most, k))
        for r, i in enumerate(part):
            emit[r, : len(runs[i])] = field.scores(runs[i])
        score = emit[:, 0] + first
        back = np.zeros((len(part), most, k), np.int8)
        for t in range(1, most):
            options = score[:, :, None] + field.pairs
            back[:, t] = options.argmax(axis=1)
            score = np.where((t < sizes)[:, None], options.max(axis=1) + emit[:, t], score)
        best = score.argmax(axis=1)
        tags = np.zeros((len(part), most), int)
        rows = np.arange(len(part))
        now = best
        for t in range(most - 1, -1, -1):
            tags[:, t] = np.where(t < sizes, now, 0)
            if t:
                now = np.where(t < sizes, back[rows, t, now], now)
        for r, i in enumerate(part):
            out[i] = tags[r, : sizes[r]]
    return out


def all_spans(field: Field, texts: list[str]) -> list[tuple[list, list]]:
    """Of each text the base spans, and all spans, as (start, kind, end)."""
    bases, where, runs = [], [], []
    for i, text in enumerate(texts):
        found = base_spans(text)
        bases.append(found)
        starts = [a for a, _, _ in found]
        ends = list(accumulate((b for _, _, b in found), max))
        for run in words_of(text):
            words = [core(text, a, b) for a, b in run]
            # a run whose active words all lie in base spans has nothing to add
            if found and all((j := bisect_left(starts, y)) and ends[j - 1] > x for x, y in words if ACTIVE.search(text, x, y)):
                continue
            where.append((i, words))
            runs.append(signs([text[x:y] for x, y in words]))
    added: list[list] = [[] for _ in texts]
    for (i, words), tags in zip(where, decoded(field, runs), strict=True):
        t = 0
        while t < len(tags):
            if tags[t]:
                kind, e = (tags[t] - 1) // 2, t + 1
                while e < len(tags) and tags[e] == 2 * kind + 2:
                    e += 1
                added[i].append((words[t][0], int(kind), words[e - 1][1]))
                t = e
            else:
                t += 1
    out = []
    for found, more in zip(bases, added, strict=True):
        starts = np.array([a for a, _, _ in found])
        ends = np.maximum.accumulate(np.array([b for _, _, b in found])) if found else starts
        new = []
        for a, kind, b in more:
            j = int(np.searchsorted(starts, b)) if found else 0  # base spans that start before b
            if b > a and not (j and ends[j - 1] > a):
                new.append((a, kind, b))
        out.append((found, sorted(found + new)))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


PERSONAL = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"


def personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, counts of base spans by kind, the digest of the base spans, all spans, how many the field added, and how many there are."""
    field = field or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 1024):
                found = all_spans(field, [t.as_py() or "" for t in batch.column("text").slice(a, 1024)])
                counts = [pa.array([sum(s[1] == k for s in b) for b, _ in found], pa.int64()) for k in range(4)]
                digests = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, 1024), *counts, digests, pa.array([joined(s) for _, s in found]), pa.array([len(s) - len(b) for b, s in found], pa.int64()), pa.array([len(s) for _, s in found], pa.int64())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PERSONAL)
