"""Versions of tables, lifecycles of datasets, experiments and models, loader checkpoints, budgets."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .analysis import row_diff
from .dedup import dataset_digest


class Versions:
    """Snapshots of a table below a folder that all executors share: Parquet, named by the rows' digest.

    A commit of rows that are stored already writes nothing but its entry in the log. Branches and tags are entries beside
    it, so that another session over the folder finds them. One writer at a time.
    """

    SCHEMA = "version long, digest string, parent long, message string, rows long, at double"
    NAMES = "kind string, name string, version long, place long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _names(self, kind: str) -> dict[str, int]:
        """Branches or tags and their versions: each name's last entry, unless that deletes it."""
        if not self._exists(f"{self.path}/names"):
            return {}
        entries = self.spark.read.schema(self.NAMES).parquet(f"{self.path}/names").filter(F.col("kind") == kind)
        last = entries.groupBy("name").agg(F.max_by("version", "place").alias("version")).filter("version is not null")
        return {r["name"]: r["version"] for r in last.collect()}

    def _name(self, kind: str, name: str, at: int | None) -> None:
        place = self.spark.read.schema(self.NAMES).parquet(f"{self.path}/names").count() if self._exists(f"{self.path}/names") else 0
        self.spark.createDataFrame([(kind, name, at, place)], self.NAMES).coalesce(1).write.mode("append").parquet(f"{self.path}/names")

    @property
    def branches(self) -> dict[str, int]:
        return self._names("branch")

    @property
    def tags(self) -> dict[str, int]:
        return self._names("tag")

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def log(self) -> DataFrame:
        if not self._exists(f"{self.path}/log"):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/log")

    def commit(self, df: DataFrame, message: str = "", branch: str = "main") -> int:
        digest = dataset_digest(df).first()[0]
        if not self._exists(f"{self.path}/data/{digest}/_SUCCESS"):
            df.write.mode("overwrite").parquet(f"{self.path}/data/{digest}")
        last = self.log().agg(F.max("version")).first()[0]
        version = (last or 0) + 1
        row = (version, digest, self.branches.get(branch), message, df.count(), time.time())
        self.spark.createDataFrame([row], self.SCHEMA).write.mode("append").parquet(f"{self.path}/log")
        self._name("branch", branch, version)
        return version

    def checkout(self, version: int | str) -> DataFrame:
        """The rows of a version, branch or tag."""
        number = version if isinstance(version, int) else self.branches.get(version, self.tags.get(version))
        row = self.log().filter(F.col("version") == number).first()
        if row is None:
            raise KeyError(version)
        return self.spark.read.parquet(f"{self.path}/data/{row['digest']}")

    def branch(self, name: str, at: int) -> None:
        """A new branch at a version."""
        if name in self.branches:
            raise ValueError(f"branch exists: {name}")
        self._name("branch", name, at)

    def drop_branch(self, name: str) -> None:
        """Forget a branch, but not main; its versions stay."""
        if name == "main" or name not in self.branches:
            raise ValueError(f"no branch to drop: {name}")
        self._name("branch", name, None)

    def tag(self, name: str, at: int) -> None:
        self._name("tag", name, at)

    def diff(self, old: int | str, new: int | str, key: Sequence[str]) -> DataFrame:
        """How many rows are added, removed, modified and unchanged between two versions, branches or tags, by key."""
        return row_diff(self.checkout(old), self.checkout(new), key)

    def ancestry(self, version: int) -> list[int]:
        parents = {r["version"]: r["parent"] for r in self.log().select("version", "parent").collect()}
        out = [version]
        while parents.get(out[-1]):
            out.append(parents[out[-1]])
        return out


#: States and the ones that follow them.
DATASET = {"registered": ("active", "archived"), "active": ("archived",), "archived": ("active",)}
EXPERIMENT = {"created": ("running",), "running": ("paused", "completed", "failed", "cancelled"), "paused": ("running", "cancelled"), "completed": (), "failed": ("running",), "cancelled": ()}
MODEL = {"none": ("staging", "archived"), "staging": ("production", "archived"), "production": ("archived", "staging"), "archived": ("staging",)}


@dataclass
class Lifecycle:
    """A thing with a state; moves that its graph does not allow raise."""

    graph: dict[str, Sequence[str]]
    state: str
    history: list[str] = field(default_factory=list)

    def move(self, to: str) -> None:
        if to not in self.graph[self.state]:
            raise ValueError(f"{self.state} does not become {to}")
        self.history.append(self.state)
        self.state = to


def bumped(version: str, part: str = "patch") -> str:
    """The next semantic version."""
    major, minor, patch = map(int, version.split("."))
    return {"major": f"{major + 1}.0.0", "minor": f"{major}.{minor + 1}.0", "patch": f"{major}.{minor}.{patch + 1}"}[part]


@dataclass
class LoaderState:
    """Where a loader stands: epoch, step, rows seen and the seed of the epoch's order."""

    epoch: int = 0
    step: int = 0
    seen: int = 0
    seed: int = 42

    def after(self, batch: int, rows: int) -> LoaderState:
        seen = self.seen + batch
        return LoaderState(self.epoch + 1, self.step + 1, 0, self.seed) if seen >= rows else LoaderState(self.epoch, self.step + 1, seen, self.seed)

    def dump(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def load(text: str) -> LoaderState:
        return LoaderState(**json.loads(text))

    def rest(self, df: DataFrame, key: str) -> DataFrame:
        """The rows of this epoch that have not been seen, with their place."""
        from .splits import hash_rank

        return hash_rank(df, key, str(self.seed + self.epoch), "place").filter(F.col("place") >= self.seen)


def budget(tokens: float, tokens_a_second: float, devices: int = 1, price_an_hour: float = 0.0) -> dict[str, float]:
    """Hours, device hours and cost of a run over that many tokens."""
    hours = tokens / (tokens_a_second * devices) / 3600
    return {"hours": hours, "device_hours": hours * devices, "cost": hours * devices * price_an_hour}


def validate_phases(phases: Sequence[dict]) -> list[str]:
    """What is wrong with a plan's phases (name, steps, weights): empty ones, repeated names, weights that add up to 0."""
    out = [] if phases else ["no phases"]
    names = [p["name"] for p in phases]
    out += [f"repeated: {n}" for n in sorted({n for n in names if names.count(n) > 1})]
    out += [f"no steps: {p['name']}" for p in phases if p["steps"] <= 0]
    return out + [f"no weight: {p['name']}" for p in phases if sum(p["weights"].values()) <= 0]


def batches_of(rows: int, size: int, drop_last: bool = False) -> int:
    return rows // size if drop_last else math.ceil(rows / size)
