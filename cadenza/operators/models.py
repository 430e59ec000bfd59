"""Boosted trees per fold, grown round by round: nothing is fitted twice, whatever the cap and the patience.

Features are binned once and kept with the label and a margin. A round reads them once a level of its tree: tasks add the trees
since the margin was written, take the gradient, route rows through the part of the tree that is grown, and add up gradients by
node, feature and bin; what they found is summed by Spark, and a row a node, feature and bin reaches the driver, which picks the
splits. The pass that begins a round also gives the losses of all trees before it, on rows to fit and on rows held
back, so that patience costs no pass. Margins are written anew every `EVERY` rounds, so no task adds more trees than that.
Several models on rows of their own grow side by side as parts of one frame: a pass serves them all.

A missing value has no bin; each split sends it to the side where it does better. Trees split by variance of the negative
gradient, and a leaf is its mean; the first tree has weight 1 and is fitted to the labels, the others have the learning rate.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..functions.storage import shared_folder

ship(__name__)

#: The bin of a missing value, and rounds after which margins are written anew.
NO_BIN, EVERY = 255, 20


class ModelError(ValueError):
    """Rows that no model may see, or a model that isn't what was saved."""


@dataclass(frozen=True)
class Settings:
    """The cap and the patience are the reference configuration's; queries state smaller ones."""

    rounds: int = 10_000
    patience: int = 200
    depth: int = 3
    bins: int = 32
    learning_rate: float = 0.1
    least_rows: int = 20
    subsample: float = 1.0
    seed: int = 7

    def __post_init__(self):
        if min(self.rounds, self.patience, self.depth, self.bins, self.least_rows) < 1 or not 0 < self.learning_rate <= 1 or not 0 < self.subsample <= 1:
            raise ValueError("counts are at least 1, the learning rate and the sample in (0, 1]")

    @classmethod
    def from_mapping(cls, given: dict) -> Settings:
        """Exactly the known fields, with values of their types."""
        kinds = {f.name: f.type for f in fields(cls)}
        if set(given) != set(kinds):
            raise ValueError(f"settings differ in {sorted(set(given) ^ set(kinds))}")
        for name, kind in kinds.items():
            ok = isinstance(given[name], int) if kind == "int" else isinstance(given[name], int | float)
            if not ok or isinstance(given[name], bool):
                raise ValueError(f"{name} is no {kind}")
        return cls(**given)


def matrix_faults(rows: DataFrame, names: list[str], label: str | None = "label", *by: str) -> DataFrame:
    """One row (or one a group): infinite features, and labels that are missing or not finite. All zero for rows that may be fitted."""
    bad = F.lit(0)
    for n in names:
        bad = bad + F.coalesce(F.abs(F.col(n).cast("double")) == float("inf"), F.lit(False)).cast("int") + F.coalesce(F.isnan(F.col(n).cast("double")), F.lit(False)).cast("int")
    out = [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(bad), F.lit(0)).cast("long").alias("infinite_features")]
    if label:
        y = F.col(label).cast("double")
        out.append(F.count_if(y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))).alias("bad_labels"))
    return rows.groupBy(*by).agg(*out)


def check_matrix(rows: DataFrame, names: list[str], label: str | None = "label") -> None:
    missing = [n for n in names if n not in rows.columns]
    if missing:
        raise ModelError(f"features are missing: {missing}")
    found = matrix_faults(rows, names, label).head().asDict()
    if not found["rows"] or found["infinite_features"] or found.get("bad_labels"):
        raise ModelError(f"rows can't be used: {found}")


def replay_patience(curve: list[float], patience: int) -> int:
    """Rounds at the best point before `patience` rounds pass without a better one."""
    best, at = float("inf"), 0
    for i, loss in enumerate(curve, 1):
        if loss < best:
            best, at = loss, i
        elif i - at >= patience:
            break
    return at


@dataclass
class Tree:
    """Nodes as a heap: the feature a node splits by (-1 for a leaf), the last bin that goes left, whether missing values do, the mean and the gain."""

    feature: list[int]
    cut: list[int]
    missing_left: list[bool]
    value: list[float]
    gain: list[float]

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls([-1] * n, [0] * n, [False] * n, [0.0] * n, [0.0] * n)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row of bins ends in."""
        at = np.zeros(len(bins), np.int64)
        feature, cut, left = (np.array(x) for x in (self.feature, self.cut, self.missing_left))
        rows = np.arange(len(bins))
        for _ in range((len(feature) + 1).bit_length() - 2):
            f = feature[at]
            b = bins[rows, np.maximum(f, 0)]
            goes_left = np.where(b == NO_BIN, left[at], b <= cut[at])
            at = np.where(f < 0, at, 2 * at + np.where(goes_left, 1, 2))
        return at

    def margins(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]

    @property
    def splits(self) -> int:
        return sum(f >= 0 for f in self.feature)


@dataclass
class Boosted:
    """A model: its features' edges, its trees with their weights, and the losses after each round."""

    kind: str
    names: list[str]
    edges: list[list[float]]
    trees: list[Tree] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    held_losses: list[float] = field(default_factory=list)

    def cut_to(self, rounds: int) -> Boosted:
        return Boosted(self.kind, self.names, self.edges, self.trees[:rounds], self.weights[:rounds], self.losses[:rounds], self.held_losses[:rounds])

    def text(self) -> str:
        return json.dumps(asdict(self), allow_nan=False)

    @classmethod
    def from_text(cls, text: str) -> Boosted:
        given = json.loads(text)
        return cls(**{**given, "trees": [Tree(**t) for t in given["trees"]]})


def binned(batch: pa.RecordBatch, names: list[str], edges: list[list[float]]) -> np.ndarray:
    """A row a row, a column a feature: how many edges lie below the value, or NO_BIN."""
    out = np.empty((len(batch), len(names)), np.uint8)
    for k, (n, e) in enumerate(zip(names, edges, strict=True)):
        x = batch.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False)
        out[:, k] = np.where(np.isnan(x), NO_BIN, np.searchsorted(np.array(e), x, side="left"))
    return out


def distinct_values(rows: DataFrame, names: list[str], *by: str) -> DataFrame:
    """About how many distinct values each feature has, exactly if they are some hundred: one row (or one a group).

    A sketch is one binary value, where the registers of approx_count_distinct are hundreds of columns a feature.
    """
    return rows.groupBy(*by).agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(F.when(F.col(n).isNotNull(), F.xxhash64(F.col(n).cast("double"))))).alias(n) for n in names])


def feature_edges(train: DataFrame, names: list[str], bins: int) -> list[list[float]]:
    """Of each feature the mid-points of its values if they are at most `bins`, else quantiles."""
    return part_edges(train.withColumn("part", F.lit(0)), names, bins).get(0, [[] for _ in names])


def part_edges(rows: DataFrame, names: list[str], bins: int) -> dict[int, list[list[float]]]:
    """The edges of each part. A row a part, of `bins` values a feature."""
    if not 2 <= bins < NO_BIN:
        raise ValueError(f"bins are 2 to {NO_BIN - 1}")
    about = {r.part: r for r in distinct_values(rows, names, "part").collect()}
    few = {n: [p for p, r in about.items() if r[n] <= 2 * bins] for n in names}  # may be few enough; the estimate is within some percent
    points = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    wanted = []
    for k, n in enumerate(names):
        x, among = F.col(n).cast("double"), F.col("part").isin(few[n])
        if few[n]:
            wanted.append(F.array_sort(F.collect_set(F.when(among, x))).alias(f"values_{k}"))
        if len(few[n]) < len(about):
            wanted.append(F.percentile_approx(F.when(~among, x), points, 10_000).alias(f"quantiles_{k}"))
    out = {}
    for row in rows.groupBy("part").agg(*wanted).collect() if about else []:
        out[row.part] = []
        for k, n in enumerate(names):
            if row.part not in few[n]:
                out[row.part].append(sorted(set(row[f"quantiles_{k}"] or [])))
            elif len(values := sorted(set(row[f"values_{k}"]))) <= bins:
                out[row.part].append([(a + b) / 2 for a, b in zip(values, values[1:], strict=False)])
            else:
                out[row.part].append(sorted({values[(i * len(values)) // bins] for i in range(1, bins)}))
    return out


def residual(label: np.ndarray, margin: np.ndarray, kind: str, first: bool) -> np.ndarray:
    """The negative gradient of the squared loss, or of 2 log(1 + exp(-2 y m)) with y in {-1, 1}; of the first round the label."""
    if first:
        return label
    return 4 * label / (1 + np.exp(2 * label * margin)) if kind == "binary" else 2 * (label - margin)


def losses(label: np.ndarray, margin: np.ndarray, kind: str) -> np.ndarray:
    return 2 * np.logaddexp(0, -2 * label * margin) if kind == "binary" else (label - margin) ** 2


STATE = "part int, bins binary, label double, held boolean, margin double, row long"


def kept_rows(parts: list[tuple[DataFrame, DataFrame | None]], names: list[str]) -> DataFrame:
    """Rows to fit and rows held back of every part. Written to the shared folder, as checks, edges and bins read them."""
    out = None
    for i, (train, held) in enumerate(parts):
        if missing := [n for n in names if n not in train.columns]:
            raise ModelError(f"features are missing: {missing}")
        for rows, back in ((train, False), (held, True)):
            if rows is not None:
                one = rows.select(F.lit(i).alias("part"), *names, "label", F.lit(back).alias("held"))
                out = one if out is None else out.unionByName(one)
    return _written(out)


def kept_state(rows: DataFrame, names: list[str], edges: dict[int, list[list[float]]], kind: str) -> DataFrame:
    """The rows binned, each by its part's edges. Written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.empty((len(batch), len(names)), np.uint8)
            for p, at in _by_part(batch, edges):
                bins[at] = binned(batch.take(pa.array(at)), names, edges[p])
            label = batch.column("label").to_numpy()
            label = np.where(label > 0.5, 1.0, -1.0) if kind == "binary" else label
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array([b.tobytes() for b in bins], pa.binary()), pa.array(label), batch.column("held"), pa.array(np.zeros(len(batch))), batch.column("row")], [c.split()[0] for c in STATE.split(", ")])

    cast = rows.select("part", *[F.col(n).cast("double").alias(n) for n in names], F.col("label").cast("double"), "held", F.xxhash64(*[F.col(n).cast("double") for n in names], F.col("label").cast("double"), F.monotonically_increasing_id()).alias("row"))
    return _written(cast.mapInArrow(run, STATE))


def _written(df: DataFrame) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/boosting-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _gone(df: DataFrame) -> None:
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        path(folder).getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path(folder), True)


def _by_part(batch: pa.RecordBatch, parts: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Of these parts those that a batch has rows of, and where."""
    part = batch.column("part").to_numpy()
    for p in parts:
        if len(at := np.flatnonzero(part == p)):
            yield p, at


def _arrays(batch: pa.RecordBatch, width: int, trees: list[Tree], weights: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins, labels and margins of a part's rows, the trees added that the margins don't have yet."""
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(len(batch), width)
    margin = batch.column("margin").to_numpy().copy()
    for t, w in zip(trees, weights, strict=True):
        margin += w * t.margins(bins)
    return bins, batch.column("label").to_numpy(), margin


@dataclass
class Histogram:
    """Of a part: rows to fit and sums of their residuals by node of the level, feature and slot (the last one for missing values); rows and mean losses of those to fit, and held back."""

    n: np.ndarray
    s: np.ndarray
    rows: list[int]
    losses: list[float]


def histograms(state: DataFrame, kind: str, width: int, slots: int, added: dict[int, tuple[list[Tree], list[float]]], first: bool, growing: dict[int, Tree], level: int, sample: tuple[float, int]) -> dict[int, Histogram]:
    """Of each part that grows. added: the trees that its margins lack, and their weights."""
    start, nodes = 2**level - 1, 2**level
    cells = nodes * width * slots  # of a part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, told = ({p: np.zeros(m, kind_) for p in growing} for m, kind_ in ((cells, np.int64), (cells, float), ((2, 2), float)))
        for whole in batches:
            for p, at in _by_part(whole, growing):
                batch = whole.take(pa.array(at))
                bins, label, margin = _arrays(batch, width, *added[p])
                held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
                if level == 0:
                    each = losses(label, margin, kind)
                    told[p] += [[(~held).sum(), each[~held].sum()], [held.sum(), each[held].sum()]]
                fit = ~held
                if sample[0] < 1:
                    x = (batch.column("row").to_numpy().view(np.uint64) + np.uint64(sample[1])) * np.uint64(0x9E3779B97F4A7C15)
                    fit &= ((x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(11)) / 2.0**53 < sample[0]
                node = growing[p].nodes(bins) - start
                at = np.flatnonzero(fit & (node >= 0) & (node < nodes))
                r = residual(label[at], margin[at], kind, first)
                slot = np.minimum(bins[at], slots - 1).astype(np.int64)
                cell = (node[at, None] * width + np.arange(width)) * slots + slot
                counts[p] += np.bincount(cell.ravel(), minlength=cells)
                sums[p] += np.bincount(cell.ravel(), weights=np.repeat(r, width), minlength=cells)
        for p in growing:
            some = np.flatnonzero(counts[p])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some) + 2, p, np.int32)), pa.array(np.concatenate((some, [-1, -2]))), pa.array(np.concatenate((counts[p][some], told[p][:, 0].astype(np.int64)))), pa.array(np.concatenate((sums[p][some], told[p][:, 1])))], ["part", "cell", "n", "s"])

    rows = state.where(F.col("part").isin(list(growing)))
    summed = rows.mapInArrow(run, "part int, cell long, n long, s double").groupBy("part", "cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    part, cell, n, s = (c.to_numpy() for c in summed.toArrow().columns)  # a row a part, node, feature and bin
    out = {}
    for p in growing:
        own, told = (part == p) & (cell >= 0), [(part == p) & (cell == c) for c in (-1, -2)]
        filled = Histogram(np.zeros(cells, np.int64), np.zeros(cells), [int(n[t].sum()) for t in told], [float(s[t].sum()) / max(1, int(n[t].sum())) for t in told])
        filled.n[cell[own]], filled.s[cell[own]] = n[own], s[own]
        filled.n, filled.s = (x.reshape(nodes, width, slots) for x in (filled.n, filled.s))
        out[p] = filled
    return out


def best_split(n: np.ndarray, s: np.ndarray, cuts: list[int], least: int) -> tuple | None:
    """Of a node's rows and residuals by feature and slot: gain, feature, cut, whether missing values go left, and both sides' rows and sums."""
    best = None
    for f, k in enumerate(cuts):
        left_n, left_s = np.cumsum(n[f, :-1])[:k], np.cumsum(s[f, :-1])[:k]
        total_n, total_s = n[f].sum(), s[f].sum()
        for missing_left in (False, True) if n[f, -1] else (False,):
            ln, ls = (left_n + n[f, -1], left_s + s[f, -1]) if missing_left else (left_n, left_s)
            rn, rs = total_n - ln, total_s - ls
            able = (ln >= least) & (rn >= least)
            if able.any():
                gain = np.where(able, ls**2 / np.maximum(ln, 1) + rs**2 / np.maximum(rn, 1) - total_s**2 / total_n, -np.inf)
                at = int(gain.argmax())
                if gain[at] > 1e-12 * max(1.0, abs(total_s)) and (best is None or gain[at] > best[0] * (1 + 1e-12)):
                    best = (float(gain[at]), f, at, missing_left, (int(ln[at]), float(ls[at])), (int(rn[at]), float(rs[at])))
    return best


def fit(train: DataFrame, valid: DataFrame | None, names: list[str], kind: str = "regression", settings: Settings | None = None) -> tuple[Boosted, int]:
    """A model and its rounds: the best before `patience` rounds pass without a better one; without validation rows, all of the settings'."""
    return fit_parts([(train, valid)], names, kind, settings)[0]


def fit_parts(parts: list[tuple[DataFrame, DataFrame | None]], names: list[str], kind: str = "regression", settings: Settings | None = None) -> list[tuple[Boosted, int]]:
    """Models of several (train, valid), each as `fit` gives it. They grow together, a level of all their trees a job; one that is done is left out of later jobs."""
    settings = settings or Settings()
    rows = kept_rows(parts, names)
    try:
        fitted = rows.where("NOT held")
        faults = {r.part: r.asDict() for r in matrix_faults(fitted, names, "label", "part").collect()}
        for i in range(len(parts)):
            if i not in faults or faults[i]["infinite_features"] or faults[i]["bad_labels"]:
                raise ModelError(f"rows can't be used: {faults.get(i, 'there are none')}")
        edges = part_edges(fitted, names, settings.bins)
        state = kept_state(rows, names, edges, kind)
    finally:
        _gone(rows)
    width, slots = len(names), max((len(e) for each in edges.values() for e in each), default=0) + 2
    growing = {i: Boosted(kind, list(names), edges[i]) for i in range(len(parts))}
    best, at, out = dict.fromkeys(growing, math.inf), dict.fromkeys(growing, 0), {}
    done = written = 0  # trees of all that grow, and of these in the margins on disk
    try:
        while growing:
            made = {i: Tree.empty(settings.depth) for i in growing}
            trees = made  # those that may be split further
            for level in range(settings.depth):
                added = {i: (growing[i].trees[written:], growing[i].weights[written:]) for i in trees}
                found = histograms(state, kind, width, slots, added, done == 0, trees, level, (settings.subsample, settings.seed + 7919 * done))
                if level == 0 and done:
                    for i in list(growing):
                        model, h = growing[i], found[i]
                        model.losses.append(h.losses[0])
                        if parts[i][1] is not None:
                            model.held_losses.append(h.losses[1] if h.rows[1] else math.inf)
                            if model.held_losses[-1] < best[i]:
                                best[i], at[i] = model.held_losses[-1], done
                            elif done - at[i] >= settings.patience:
                                out[i] = (model.cut_to(at[i]), at[i])
                                del growing[i]
                if done == settings.rounds:
                    break
                trees = {i: t for i, t in trees.items() if i in growing and _grow(t, level, found[i], [len(e) for e in edges[i]], settings.least_rows)}
                if not trees:
                    break
            if done == settings.rounds:
                out |= {i: (m.cut_to(at[i]), at[i]) if parts[i][1] is not None else (m, settings.rounds) for i, m in growing.items()}
                break
            for i, model in growing.items():
                model.trees.append(made[i])
                model.weights.append(settings.learning_rate if done else 1.0)
            done += 1
            if growing and done - written >= EVERY:
                state, written = with_margins(state, width, {i: (m.trees[written:], m.weights[written:]) for i, m in growing.items()}), done
    finally:
        _gone(state)
    return [out[i] for i in range(len(parts))]


def _grow(tree: Tree, level: int, found: Histogram, cuts: list[int], least: int) -> bool:
    """Splits the nodes of a level that can be; whether any was."""
    grown = False
    for k in range(2**level):
        node = 2**level - 1 + k
        if not (rows := found.n[k, 0].sum()):
            continue
        if level == 0:
            tree.value[0] = float(found.s[k, 0].sum() / rows)
        if (split := best_split(found.n[k], found.s[k], cuts, least)) is not None:
            tree.gain[node], tree.feature[node], tree.cut[node], tree.missing_left[node] = split[:4]
            for child, (n, total) in zip((2 * node + 1, 2 * node + 2), split[4:], strict=True):
                tree.value[child] = total / n
            grown = True
    return grown


def with_margins(state: DataFrame, width: int, added: dict[int, tuple[list[Tree], list[float]]]) -> DataFrame:
    """The parts that still grow with these trees in their margins, written anew; the old state goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = batch.column("margin").to_numpy().copy()
            for p, at in _by_part(batch, added):
                margin[at] = _arrays(batch.take(pa.array(at)), width, *added[p])[2]
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(margin))

    out = _written(state.where(F.col("part").isin(list(added))).mapInArrow(run, STATE))
    _gone(state)
    return out


def predict(model: Boosted, rows: DataFrame, names: list[str], kind: str = "regression") -> DataFrame:
    """The rows with `p`: the prediction, or the probability of an up label."""
    if list(names) != model.names or kind != model.kind:
        raise ModelError(f"the model is of {model.kind} over {model.names}")
    schema = rows.drop("p").withColumn("p", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, margin = binned(batch, model.names, model.edges), np.zeros(len(batch))
            for t, w in zip(model.trees, model.weights, strict=True):
                margin += w * t.margins(bins)
            p = 1 / (1 + np.exp(-2 * margin)) if kind == "binary" else margin
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, "p"])

    return rows.drop("p").mapInArrow(run, schema)


def feature_usage(model: Boosted, names: list[str]) -> list[tuple[str, float, int]]:
    """Share of the gain and number of splits by feature."""
    gains, splits = [0.0] * len(names), [0] * len(names)
    for t in model.trees:
        for f, g in zip(t.feature, t.gain, strict=True):
            if f >= 0:
                gains[f], splits[f] = gains[f] + g, splits[f] + 1
    total = sum(gains)
    return [(n, gains[i] / total if total else 0.0, splits[i]) for i, n in enumerate(names)]


def save(model: Boosted, spark, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(model.text().encode()))
    finally:
        out.close()


def load(spark, path: str) -> Boosted:
    return Boosted.from_text(spark.read.text(path, wholetext=True).head()[0])


def check_reload(model: Boosted, path: str, rows: DataFrame, names: list[str], kind: str = "regression", tolerance: float = 1e-12) -> Boosted:
    """Save, read again, and compare the predictions of the rows; returns the model that was read."""
    spark = rows.sparkSession
    save(model, spark, path)
    again = load(spark, path)
    one = predict(model, rows, names, kind).select("row_id", F.col("p").alias("a"))
    two = predict(again, rows, names, kind).select("row_id", F.col("p").alias("b"))
    worst = one.join(two, "row_id").agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("d"), F.count(F.lit(1)).alias("n")).head()
    if not worst.n or worst.d > tolerance:
        raise ModelError(f"the saved model predicts otherwise, by {worst.d} over {worst.n} rows")
    return again


def check_native_metric(model: Boosted, fitted: DataFrame, names: list[str], kind: str = "regression", tolerance: float = 1e-9) -> float:
    """The loss of the last round, as fitting found it on these rows, against one computed from the predictions."""
    native, rows = model.losses[-1], predict(model, fitted, names, kind)
    if kind == "binary":
        # 2 log(1 + exp(-2 y m)) with y in {-1, 1}, and p = 1 / (1 + exp(-2 m))
        own = 2 * rows.agg(F.avg(-F.when(F.col("label") == 1, F.ln("p")).otherwise(F.log1p(-F.col("p"))))).head()[0]
    else:
        own = rows.agg(F.avg((F.col("p") - F.col("label")) ** 2)).head()[0]
    if not math.isclose(native, own, rel_tol=tolerance, abs_tol=tolerance):
        raise ModelError(f"fitting says {native}, the predictions {own}")
    return own
