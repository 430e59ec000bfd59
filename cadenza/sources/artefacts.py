"""Artefacts of a run that an analysis starts from: a chain of records, split -> samples -> inputs, checked link by link.

A record names its state, the published frame that it stands for, and its parent by path and by the SHA-256 of the parent's
text. Loading follows the chain down, compares every digest, reads the rows of every frame against its store's record and the
inputs' rows against theirs, and only then hands out roles and samples. The first broken link is the error, by its name.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules as ru
from .store import Store, StoreError, rows_digest, save_json

#: What a record stands for, in the order of the chain.
STATES = ("split-ready", "prepared", "inputs")


class ArtefactError(ValueError):
    """A link of the chain that doesn't hold; it begins with the link's name."""


def text_of(spark: SparkSession, path: str) -> str:
    try:
        return spark.read.text(path, wholetext=True).head()[0]
    except Exception as e:
        raise ArtefactError(f"{path}: there is no such record") from e


def record_inputs(spark: SparkSession, path: str, tables: dict[str, str]) -> None:
    """The end of the chain: tables by name and path, with the digest of their rows."""
    save_json({"state": "inputs", "tables": {n: {"path": p, "rows": rows_digest(spark.read.parquet(p))} for n, p in tables.items()}}, spark, path)


def record_frame(spark: SparkSession, path: str, state: str, identity: str, parent: str, **facts: object) -> None:
    """A published frame, with its parent's record as it is now."""
    save_json({"state": state, "identity": identity, "parent": parent, "parent_sha256": hashlib.sha256(text_of(spark, parent).encode()).hexdigest(), **facts}, spark, path)


@dataclass(frozen=True)
class Inputs:
    """What an analysis may read: the samples, and the rows of both phases with their folds."""

    samples: DataFrame
    phases: DataFrame
    split: dict


def load_inputs(spark: SparkSession, store: Store, split_path: str, discovery: tuple[str, str], confirmation: list[tuple[str, str]], whole: tuple[str, str] = ("holdout", "train")) -> Inputs:
    """Follows the chain and checks what it holds: roles (fold, role) of both phases cover `whole` exactly, don't meet in time, and end before the holdout begins."""
    chain, path = [], split_path
    for state in STATES:
        text = text_of(spark, path)
        if chain and hashlib.sha256(text.encode()).hexdigest() != chain[-1]["parent_sha256"]:
            raise ArtefactError(f"{state}: the record is not the one that {chain[-1]['state']} was made from")
        record = json.loads(text)
        if record.get("state") != state:
            raise ArtefactError(f"{state}: the record says {record.get('state')}")
        chain.append(record)
        path = record.get("parent")
    split, prepared, inputs = chain
    for name, given in inputs["tables"].items():
        if rows_digest(spark.read.parquet(given["path"])) != given["rows"]:
            raise ArtefactError(f"inputs: {name} has other rows than on record")
    frames = {}
    for state, record in (("prepared", prepared), ("split-ready", split)):
        try:
            frames[state] = store.verify(record["identity"])
        except StoreError as e:
            raise ArtefactError(f"{state}: {e}") from e
    samples, roles = frames["prepared"], frames["split-ready"]
    named = F.when((F.col("fold") == discovery[0]) & (F.col("role") == discovery[1]), "discovery")
    for fold, role in confirmation:
        named = named.when((F.col("fold") == fold) & (F.col("role") == role), "confirmation")
    phases = roles.withColumn("phase", named).where("phase IS NOT NULL").select("phase", "fold", "row_id")
    wanted = roles.where((F.col("fold") == whole[0]) & (F.col("role") == whole[1])).select("row_id")
    both = phases.groupBy("row_id").agg(F.count(F.lit(1)).alias("n")).join(wanted.withColumn("w", F.lit(1)), "row_id", "full")
    cover = both.agg(F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("w").isNull()).alias("extra"), F.count_if(F.col("n").isNull()).alias("missing")).head().asDict()
    if any(cover.values()):
        raise ArtefactError(f"split-ready: the phases don't cover {'.'.join(whole)} once: {cover}")
    keyed = phases.join(samples.select("row_id", "cal_idx", "target_idx", "label_available_idx", "prediction_eligible", "target_status"), "row_id", "left")
    boundary = split["holdout_first_day"]
    sound = F.col("prediction_eligible") & (F.col("target_status") == 1) & (F.col("target_idx") == F.col("cal_idx") + 1) & (F.col("target_idx") < boundary) & F.col("label_available_idx").between(F.col("target_idx"), F.lit(boundary - 1))
    seen = keyed.agg(F.count_if(~F.coalesce(sound, F.lit(False))).alias("unsound"), F.max(F.when(F.col("phase") == "discovery", F.col("target_idx"))).alias("last"), F.min(F.when(F.col("phase") == "confirmation", F.col("target_idx"))).alias("first")).head()
    if seen.unsound:
        raise ArtefactError(f"prepared: {seen.unsound} rows can't be scored, or reach into the holdout")
    if seen.last is not None and seen.first is not None and seen.last >= seen.first:
        raise ArtefactError(f"split-ready: discovery ends on day {seen.last}, confirmation begins on {seen.first}")
    return Inputs(samples, phases, split)


@dataclass(frozen=True)
class Rule:
    """An interval of a feature's bins and the event that it is about."""

    feature: str
    event: str
    lo: int
    hi: int


RULE_COLUMNS = ("feature", "event", "lo", "hi")


def read_rules(spark: SparkSession, path: str, cuts: dict[str, list[float]]) -> list[Rule]:
    """Rules that were saved as CSV, read back strictly: known features and events, intervals that the cuts have, none twice. A row a representative."""
    parts = [r[0] for r in spark.read.text(path, wholetext=True).collect()]
    out: list[Rule] = []
    for text in parts:
        rows = csv.DictReader(io.StringIO(text))
        if missing := [c for c in RULE_COLUMNS if c not in (rows.fieldnames or ())]:
            raise ArtefactError(f"{path}: the columns {missing} are missing")
        for line, row in enumerate(rows, 2):
            where = f"{path}, line {line}"
            try:
                rule = Rule(row["feature"], row["event"], int(row["lo"]), int(row["hi"]))
            except (TypeError, ValueError) as e:
                raise ArtefactError(f"{where}: {e}") from e
            if rule.feature not in cuts or rule.event not in ru.EVENTS:
                raise ArtefactError(f"{where}: {rule.feature} or {rule.event} is not known")
            finite = len(cuts[rule.feature]) + 1
            if not (0 <= rule.lo < rule.hi <= finite or (rule.lo, rule.hi) == (finite, finite + 1)):
                raise ArtefactError(f"{where}: the bins [{rule.lo}, {rule.hi}) are none of {rule.feature}")
            if rule in out:
                raise ArtefactError(f"{where}: {rule} is there twice")
            out.append(rule)
    return out


def rule_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rules as `rules.Profile` takes them."""
    return spark.createDataFrame([(r.feature, r.event, r.lo, r.hi) for r in rules], "feature string, event string, lo int, hi int")
