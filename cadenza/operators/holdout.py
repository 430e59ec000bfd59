"""The registry of holdouts: what was evaluated on which rows, so that no row is held out twice.

A holdout is known by its rows, (entity, day), not by the plan, model or label that is evaluated on it. An attempt reserves
rows, is exposed before its targets may be read, and is finished. Every step is a file of its own that is only ever created,
so what happened stays on record whatever crashes: an attempt that was exposed counts as exposed, finished or not, and one
that was reserved stays in the way until it is abandoned by name. Rows are compared by a join, however many they are.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = "entity string, day string"


class HoldoutError(RuntimeError):
    """A second exposure, or a look at targets before it."""


class Registry:
    """A folder that Spark's file systems reach: attempts, and the claims of who is reserving."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.files = self.path_of(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for part in ("attempts", "claims"):
            self.files.mkdirs(self.path_of(f"{self.folder}/{part}"))

    def _there(self, name: str) -> bool:
        return self.files.exists(self.path_of(f"{self.folder}/{name}"))

    def _names(self, part: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self.files.listStatus(self.path_of(f"{self.folder}/{part}")))

    def _once(self, name: str, value: dict) -> None:
        text = json.dumps(value, sort_keys=True, allow_nan=False)
        try:
            out = self.files.create(self.path_of(f"{self.folder}/{name}"), False)
        except Exception as e:
            raise HoldoutError(f"{name} is there already") from e
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _read(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.folder}/{name}", wholetext=True).head()[0])

    def state(self, attempt: str) -> str | None:
        """The last step on record; None for what crashed before it was reserved."""
        for step in ("finished", "exposed", "reserved"):
            if self._there(f"attempts/{attempt}/{step}.json"):
                return step
        return None

    def attempts(self) -> list[dict]:
        """All attempts with what each step recorded, in order of their names."""
        out = []
        for attempt in self._names("attempts"):
            if (state := self.state(attempt)) is not None:
                steps = [s for s in ("reserved", "exposed", "finished") if self._there(f"attempts/{attempt}/{s}.json")]
                out.append({"attempt": attempt, "state": state, **{s: self._read(f"attempts/{attempt}/{s}.json") for s in steps}})
        return out

    def claim(self) -> str:
        """An exclusive claim: of two writers that meet neither may go on, so that both can't; each sees at least the other's claim."""
        own = uuid.uuid4().hex
        self._once(f"claims/{own}", {})
        if others := [c for c in self._names("claims") if c != own]:
            self.release(own)
            raise HoldoutError(f"another run reserves: {others}")
        return own

    def release(self, claim: str) -> None:
        """Gives a claim back; one that a crash left is released by its name."""
        self.files.delete(self.path_of(f"{self.folder}/claims/{claim}"), False)

    def _rows(self, attempt: str) -> DataFrame:
        return self.spark.read.schema(KEYS).parquet(f"{self.folder}/attempts/{attempt}/rows")

    def reserve(self, rows: DataFrame, configuration: dict) -> str:
        """An attempt on rows(entity, day). Refused where one of them was exposed, or is reserved and not finished."""
        claim = self.claim()
        try:
            wanted = rows.select(F.col("entity").cast("string"), F.col("day").cast("string")).distinct()
            attempt = f"{len(self._names('attempts')):06}-{uuid.uuid4().hex}"
            wanted.write.parquet(f"{self.folder}/attempts/{attempt}/rows")
            wanted = self._rows(attempt)
            for known in self.attempts():
                exposed = "exposed" in known
                if (exposed or known["state"] == "reserved") and self._rows(known["attempt"]).join(wanted, ["entity", "day"], "left_semi").limit(1).count():
                    raise HoldoutError(f"{known['attempt']} {'has exposed' if exposed else 'reserves'} some of these rows")
            self._once(f"attempts/{attempt}/reserved.json", {"configuration": configuration})
            return attempt
        finally:
            self.release(claim)

    def expose(self, attempt: str, evidence: dict) -> None:
        """From now on the rows count as seen; evidence says what was sealed before."""
        if self.state(attempt) != "reserved":
            raise HoldoutError(f"{attempt} is {self.state(attempt)}, not reserved")
        self._once(f"attempts/{attempt}/exposed.json", evidence)

    def finish(self, attempt: str, result: dict) -> None:
        if self.state(attempt) != "exposed":
            raise HoldoutError(f"{attempt} is {self.state(attempt)}, not exposed")
        self._once(f"attempts/{attempt}/finished.json", {"state": "finished", **result})

    def abandon(self, attempt: str, reason: str) -> None:
        """Ends an attempt that was reserved and never exposed, so that its rows are free again. What was exposed stays so."""
        if self.state(attempt) != "reserved":
            raise HoldoutError(f"{attempt} is {self.state(attempt)}: only what was never exposed can be abandoned")
        self._once(f"attempts/{attempt}/finished.json", {"state": "abandoned", "reason": reason})


class Gate:
    """Owns the targets of an evaluation and gives them out after predictions are sealed."""

    def __init__(self, targets: DataFrame):
        self._targets, self._open = targets, False

    def open(self) -> None:
        self._open = True

    @property
    def targets(self) -> DataFrame:
        if not self._open:
            raise HoldoutError("predictions come before targets")
        return self._targets


def frozen_rounds(best: list[int]) -> int:
    """The median of an odd number of folds' best rounds."""
    if not best or len(best) % 2 == 0:
        raise HoldoutError("an odd number of folds is needed")
    return sorted(best)[len(best) // 2]
