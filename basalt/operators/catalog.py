"""A catalogue of datasets: search, facets, recommendation, versions, lineage and parameter grids."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence
from functools import reduce
from itertools import count, product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..storage import written


def _has(text: Column, query: str) -> Column:
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(query.lower()))


def relevance(query: str) -> Column:
    """0.4 for the name, 0.3 more if it is the name, 0.2 for the description, 0.1 for a tag, 0.1 for a task.

    Sums are rounded, so that equal points from other places are equal and the order goes by id.
    """
    any_of = lambda c: F.exists(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: _has(x, query))
    points = [(_has(F.col("name"), query), 0.4), (F.lower("name") == query.lower(), 0.3), (_has(F.col("description"), query), 0.2), (any_of("tags"), 0.1), (any_of("tasks"), 0.1)]
    return F.round(reduce(lambda a, b: a + b, (F.when(c, p).otherwise(0.0) for c, p in points)), 6)


def search(catalogue: DataFrame, query: str = "", formats: Sequence[str] = (), tags: Sequence[str] = (), least_rows: int | None = None, most_rows: int | None = None, offset: int = 0, limit: int = 20) -> DataFrame:
    """catalogue: (id, name, description, tags, tasks, format, rows, created_at). Adds relevance; the best first."""
    got = catalogue.withColumn("relevance", relevance(query) if query else F.lit(0.0))
    got = got.filter("relevance > 0") if query else got
    got = got.filter(F.col("format").isin(list(formats))) if formats else got
    got = got.filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))) if tags else got
    got = got.filter(F.col("rows") >= least_rows) if least_rows is not None else got
    got = got.filter(F.col("rows") <= most_rows) if most_rows is not None else got
    return got.orderBy(F.desc("relevance"), "id").offset(offset).limit(limit)


def facets(catalogue: DataFrame) -> DataFrame:
    """(facet, value, n) for format, tag, task, rows and month."""
    rows = F.when(F.col("rows") < 1000, "tiny").when(F.col("rows") < 10_000, "small").when(F.col("rows") < 100_000, "medium").otherwise("large")
    one = lambda name, c: F.struct(F.lit(name).alias("facet"), c.alias("value"))
    many = lambda name, c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: one(name, x))
    values = F.concat(F.array(one("format", F.col("format")), one("rows", rows), one("month", F.substring("created_at", 1, 7))), many("tag", "tags"), many("task", "tasks"))
    return catalogue.select(F.explode(values).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def recommend(catalogue: DataFrame, kind: str, rows: int, limit: int = 5) -> DataFrame:
    """catalogue with quality from 0 to 100. Score: 0.35 kind in the tags, 0.3 size, 0.2 quality, 0.15 description."""
    size = F.least(F.col("rows") / float(max(rows, 1)), F.lit(1.0))
    score = F.when(F.array_contains("tags", kind), 0.35).otherwise(0.0) + 0.3 * size + 0.2 * F.col("quality") / 100 + F.when(_has(F.col("description"), kind), 0.15).otherwise(0.0)
    return catalogue.withColumn("score", score).orderBy(F.desc("score"), "id").limit(limit)


def popularity(downloads: Column, likes: Column) -> Column:
    return F.least(0.6 * downloads + 0.4 * likes, F.lit(100.0)) / 100


def version_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, new: (file, hash). (file, change)."""
    both = old.select("file", F.col("hash").alias("_o")).join(new.select("file", F.col("hash").alias("_n")), "file", "full")
    return both.select("file", F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") != F.col("_n"), "modified").otherwise("unchanged").alias("change"))


def reachable(edges: DataFrame, starts: DataFrame, upstream: bool = False, most: int | None = None) -> DataFrame:
    """(node, depth) from starts (node) along edges (src, dst), by rounds of joins against the frontier, to the end or `most`
    steps far. Each round is written to the shared folder."""
    step = edges.select(F.col("dst" if upstream else "src").alias("node"), F.col("src" if upstream else "dst").alias("next")).distinct()
    front = seen = written(starts.select("node", F.lit(0).alias("depth")).distinct())
    for depth in count(1) if most is None else range(1, most + 1):
        front = written(front.join(step, "node").select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def levels(edges: Sequence[tuple[str, str]]) -> list[list[str]]:
    """Nodes of a small graph by longest path from a root: each level can run at once. A cycle raises."""
    above, nodes = defaultdict(set), {n for e in edges for n in e}
    for a, b in edges:
        above[b].add(a)
    out: list[list[str]] = []
    done: set[str] = set()
    while len(done) < len(nodes):
        ready = sorted(n for n in nodes - done if above[n] <= done)
        if not ready:
            raise ValueError("cycle")
        out.append(ready)
        done |= set(ready)
    return out


def impact(n: int) -> str:
    """The severity of a change with n nodes below."""
    return "none" if n == 0 else "low" if n <= 3 else "medium" if n <= 10 else "high"


def stale_steps(edges: Sequence[tuple[str, str]], old: dict[str, str], new: dict[str, str]) -> dict[str, str]:
    """Steps of a small pipeline graph to run again, in running order: "changed" if the new digest is another one or the
    first, "upstream" if a step above is run again. Steps without a new digest count as unchanged. A cycle raises."""
    out: dict[str, str] = {}
    for n in (n for level in levels(edges) for n in level):
        if n in new and old.get(n) != new[n]:
            out[n] = "changed"
        elif any(a in out for a, b in edges if b == n):
            out[n] = "upstream"
    return out


def graph_problems(nodes: Sequence[str], edges: Sequence[tuple[str, str]]) -> list[str]:
    """What is wrong with a graph: repeated nodes, edges from or to unknown nodes, nodes without edges, a cycle."""
    out = [f"repeated: {n}" for n in sorted({n for n in nodes if list(nodes).count(n) > 1})]
    ends = {n for e in edges for n in e}
    out += [f"unknown: {n}" for n in sorted(ends - set(nodes))]
    out += [f"isolated: {n}" for n in sorted(set(nodes) - ends)] if len(set(nodes)) > 1 else []
    try:
        levels(edges)
    except ValueError as e:
        out.append(str(e))
    return out


def mermaid(edges: Sequence[tuple[str, str]]) -> str:
    return "\n".join(["graph TD", *(f"    {a} --> {b}" for a, b in edges)])


def grid(spark: SparkSession, choices: dict[str, Sequence]) -> DataFrame:
    """All combinations of the choices, one column each; at most 1000."""
    if math.prod(map(len, choices.values())) > 1000:
        raise ValueError("more than 1000 combinations")
    return spark.createDataFrame(list(product(*choices.values())), list(choices))


def listed(catalogue: DataFrame, status: str | None = None, form: str | None = None, name: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """Datasets by status, format and a part of the name, the last updated first."""
    got = catalogue.filter(F.col("status") == status) if status else catalogue
    got = got.filter(F.col("format") == form) if form else got
    got = got.filter(F.col("name").like(f"%{name}%")) if name else got
    return got.orderBy(F.desc("updated_at"), "id").offset(offset).limit(limit)


def size_bucket(megabytes: Column) -> Column:
    return F.when(megabytes < 10, "small").when(megabytes < 100, "medium").when(megabytes < 1000, "large").otherwise("huge")


def experiments(rows: DataFrame, status: str | None = None, name: str | None = None, task: str | None = None, group: str | None = None) -> DataFrame:
    """Experiments by status, a part of the name, task type (stored with or without quotes) and group."""
    got = rows.filter(F.col("status") == status) if status else rows
    got = got.filter(F.col("name").like(f"%{name}%")) if name else got
    got = got.filter(F.trim(F.col("task_type"), F.lit('"')) == task) if task else got
    return got.filter(F.col("group_name") == group) if group else got


def random_trials(spark: SparkSession, ranges: dict[str, tuple[float, float]], n: int, seed: str = "42") -> DataFrame:
    """n trials, each parameter uniform in its range by a hash."""
    return spark.range(n).select(F.col("id").alias("trial"), *((lo + (hi - lo) * uniform(f"{seed}|{k}", F.col("id"))).alias(k) for k, (lo, hi) in ranges.items()))


def best_trial(trials: DataFrame, metric: str, minimize: bool = True) -> DataFrame:
    """The trial with the best metric, the first of equals."""
    return trials.filter(F.col(metric).isNotNull()).orderBy(F.col(metric) if minimize else F.desc(metric), "trial").limit(1)


def reproducibility(with_code: bool, with_environment: bool, with_seed: bool) -> int:
    """0 to 100: 40 for the code's version, 30 for the environment, 30 for the seed."""
    return 40 * with_code + 30 * with_environment + 30 * with_seed
