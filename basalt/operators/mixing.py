"""Interleaving datasets and step-wise recipes, in closed form over row numbers and steps."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import uniform


def normalized(weights: dict[str, float]) -> dict[str, float]:
    """Weights that add up to 1; negative ones, or a sum of 0, raise."""
    if not weights or min(weights.values()) < 0 or sum(weights.values()) <= 0:
        raise ValueError("weights: at least one, none negative, a positive sum")
    return {k: w / sum(weights.values()) for k, w in weights.items()}


def target_total(sizes: dict[str, int], weights: dict[str, float], stop: str = "all", total: int | None = None) -> int:
    """Rows of the mix: "first" ends with the smallest dataset, else total or all rows."""
    if stop == "first":
        return math.ceil(min(sizes.values()) / min(normalized(weights).values()))
    return total if total is not None else sum(sizes.values())


def _dataset(names: Sequence[str], values: dict[str, float], column: str = "dataset") -> Column:
    return reduce(lambda rest, k: F.when(F.col(column) == k, F.lit(values[k])).otherwise(rest), names, F.lit(None))


def round_robin(rows: DataFrame, weights: dict[str, float], total: int) -> DataFrame:
    """rows: (dataset, row_index from 0). One row of each live dataset a pass, up to ceil(total * weight) of each, total in all.

    Adds position.
    """
    w, names = normalized(weights), list(weights)
    quota = _dataset(names, {k: math.ceil(total * x) for k, x in w.items()})
    live = rows.filter(F.col("row_index") < quota).withColumn("_d", _dataset(names, {k: i for i, k in enumerate(names)}))
    from .splits import indexed

    return indexed(live, ["row_index", "_d"], "position").filter(F.col("position") < total).drop("_d")


def proportional(rows: DataFrame, weights: dict[str, float], total: int, equal: bool = False) -> DataFrame:
    """Blocks of ceil(10 * weight) rows of each dataset a pass (10 if equal), total in all. Adds position."""
    w, names = normalized(weights), list(weights)
    block = F.lit(10) if equal else _dataset(names, {k: math.ceil(10 * x) for k, x in w.items()})
    placed = rows.withColumn("_block", F.floor(F.col("row_index") / block)).withColumn("_d", _dataset(names, {k: i for i, k in enumerate(names)}))
    from .splits import indexed

    return indexed(placed, ["_block", "_d", "row_index"], "position").filter(F.col("position") < total).drop("_block", "_d")


def curriculum_quota(sizes: dict[str, int], weights: dict[str, float], phases: Sequence[float] = (0.3, 0.5, 0.2)) -> list[dict[str, int]]:
    """Rows of each dataset by phase: int(phase * weight * all rows), as far as they reach."""
    w, total, left = normalized(weights), sum(sizes.values()), dict(sizes)
    out = []
    for p in phases:
        quota = {k: min(left[k], int(p * x * total)) for k, x in w.items()}
        left = {k: left[k] - quota[k] for k in left}
        out.append(quota)
    return out


def curriculum(rows: DataFrame, sizes: dict[str, int], weights: dict[str, float], phases: Sequence[float] = (0.3, 0.5, 0.2)) -> DataFrame:
    """Adds phase: each dataset's rows in their order, as many a phase as `curriculum_quota` says; the rest is left out."""
    quota, names = curriculum_quota(sizes, weights, phases), list(weights)
    out, upto = F.lit(None).cast("int"), {k: sum(q[k] for q in quota) for k in names}
    for i, q in reversed(list(enumerate(quota))):
        out = F.when(F.col("row_index") < _dataset(names, upto), F.lit(i)).otherwise(out)
        upto = {k: upto[k] - q[k] for k in names}
    return rows.withColumn("phase", out).filter("phase is not null")


Choice = Callable[[Column, Sequence[str]], Column]


@dataclass(frozen=True)
class Phase:
    """Steps from start to end with the same live datasets; lost: a step that yields nothing."""

    start: int
    end: int
    live: tuple[str, ...]
    lost: int | None = None


def phases(spark: SparkSession, total: int, sizes: dict[str, int | None], choose: Choice, noticed: bool = False, parts: int = 1000) -> list[Phase]:
    """The phases of a mix of datasets that run out; choose(step, live) names a step's dataset. sizes: None never runs out.

    A dataset is out after its last row, or if `noticed`, at the pick after that, a step that is lost. There is at most one
    phase more than datasets. In each, picks are counted by `parts` blocks of steps, and the step at which a dataset runs
    out is found in its block; steps themselves never come to the driver.
    """
    left, live, start, out = dict(sizes), [k for k, n in sizes.items() if n is None or n > 0 or noticed], 0, []
    while start < total and live:
        picks = spark.range(start, total).select(F.col("id").alias("step"), choose(F.col("id"), live).alias("dataset"))
        width = max(1, math.ceil((total - start) / parts))
        counts: dict[str, dict[int, int]] = {k: {} for k in live}
        for r in picks.filter("dataset is not null").groupBy("dataset", F.floor((F.col("step") - start) / width).alias("block")).count().collect():
            counts.setdefault(r["dataset"], {})[r["block"]] = r["count"]
        ends: list[tuple[int, str]] = []
        for k in live:
            need = None if left[k] is None else left[k] + noticed
            for block, n in sorted(counts[k].items()):
                if need is not None and n >= need:
                    own = picks.filter((F.col("dataset") == k) & F.col("step").between(start + block * width, start + (block + 1) * width - 1))
                    ends.append((own.orderBy("step").offset(need - 1).limit(1).first()["step"], k))
                    break
                need = None if need is None else need - n
        if not ends:
            out.append(Phase(start, total, tuple(live)))
            break
        last, gone = min(ends)
        used = {r["dataset"]: r["count"] for r in picks.filter(F.col("step") <= last).groupBy("dataset").count().collect()}
        left = {k: None if n is None else n - used.get(k, 0) for k, n in left.items()}
        out.append(Phase(start, last + 1, tuple(live), last if noticed else None))
        live.remove(gone)
        start = last + 1
    return out


def mixed_steps(spark: SparkSession, plan: Sequence[Phase], choose: Choice, sizes: dict[str, int | None]) -> DataFrame:
    """(step, position, dataset, row_index, epoch) of a plan's steps: the n-th pick of a dataset is its row n modulo its size."""
    total = plan[-1].end if plan else 0
    dataset = F.lit(None).cast("string")
    for p in reversed(plan):
        pick = choose(F.col("step"), p.live)
        pick = pick if p.lost is None else F.when(F.col("step") != p.lost, pick)
        dataset = F.when((F.col("step") >= p.start) & (F.col("step") < p.end), pick).otherwise(dataset)
    rows = spark.range(total).withColumnRenamed("id", "step").withColumn("dataset", dataset).filter("dataset is not null")
    from .splits import indexed, ranked

    placed = ranked(indexed(rows, ["step"], "position"), ["dataset"], ["step"], "n")
    size = F.greatest(F.coalesce(_dataset([k for k, n in sizes.items() if n], {k: n for k, n in sizes.items() if n}), F.lit((1 << 62))), F.lit(1))
    return placed.select("step", "position", "dataset", (F.col("n") % size).alias("row_index"), F.floor(F.col("n") / size).alias("epoch"))


def executed(spark: SparkSession, recipe: Recipe, sizes: dict[str, int | None], total: int, epochs: dict[str, int | None] | None = None) -> DataFrame:
    """A recipe run over datasets that end: (step, position, dataset, row_index, epoch). epochs: how often a dataset may be
    read, 1 by default, None without end. Random strategies draw among the live datasets by their weights, interleaving
    takes turns among them; it stops at `total` or when none is left."""
    epochs = {k: 1 for k in sizes} | (epochs or {})
    room = {k: None if n is None or epochs[k] is None else n * epochs[k] for k, n in sizes.items()}

    def choose(step: Column, live: Sequence[str]) -> Column:
        return chosen(step, replace(recipe, weights={k: recipe.weights[k] for k in recipe.weights if k in live}))

    return mixed_steps(spark, phases(spark, total, room, choose), choose, sizes)


def weighted_random(rows: DataFrame, weights: dict[str, float], total: int, seed: str = "42", sizes: dict[str, int] | None = None) -> DataFrame:
    """Steps pick a dataset by weight and take its next row; a dataset that is out gives its steps to the first live one, and
    the step that finds it out is lost. Adds position."""
    spark, names = rows.sparkSession, list(weights)
    sizes = sizes or {k: 0 for k in names} | {r["dataset"]: r["count"] for r in rows.groupBy("dataset").count().collect()}

    def choose(step: Column, live: Sequence[str]) -> Column:
        first = next(k for k in names if k in live)
        pick = _pick(uniform(seed, step), normalized(weights))
        return F.when(pick.isin(list(live)), pick).otherwise(first)

    picked = mixed_steps(spark, phases(spark, total, sizes, choose, noticed=True), choose, {})
    return rows.join(picked.select("dataset", "row_index", "position"), ["dataset", "row_index"])


def oversample(rows: DataFrame, sizes: dict[str, int], targets: dict[str, int]) -> DataFrame:
    """rows repeated in cycles until each dataset has its target. Adds copy, the number of the cycle."""
    names = list(targets)
    size, target = _dataset(names, sizes), _dataset(names, targets)
    times = F.ceil((target - F.col("row_index")) / size).cast("int")
    return rows.filter(F.col("row_index") < target).withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(times - 1, F.lit(0)))))


def contribution(mixed: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(dataset, n, actual, target, match): the share of each dataset, and 1 - |actual - target|."""
    w = normalized(weights)
    n = mixed.groupBy("dataset").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("_t"))
    actual = F.col("n") / F.col("_t")
    target = _dataset(list(w), w)
    return n.crossJoin(F.broadcast(total)).select("dataset", "n", actual.alias("actual"), target.alias("target"), (1 - F.abs(actual - target)).alias("match"))


def optimal_weights(sizes: dict[str, int], target: dict[str, float]) -> dict[str, float]:
    """Target share over current share, by the largest."""
    t, total = normalized(target), sum(sizes.values())
    raw = {k: t[k] / (sizes[k] / total) if sizes[k] else 0.0 for k in t}
    top = max(raw.values())
    return {k: x / top for k, x in raw.items()}


def validate(recipe: Recipe) -> list[str]:
    """What is wrong with a recipe."""
    out = ["no datasets"] * (not recipe.weights)
    out += [f"negative weight: {k}" for k, w in recipe.weights.items() if w < 0]
    out += ["weights add up to 0"] * (bool(recipe.weights) and sum(recipe.weights.values()) <= 0)
    out += ["run: at least 1"] * (recipe.run < 1) + ["temperature: above 0"] * (recipe.temperature <= 0)
    out += [f"stage {n}: ends before it starts" for n, a, b, _ in recipe.stages if b <= a]
    return out + [f"stage {n}: unknown dataset {k}" for n, _, _, w in recipe.stages for k in w if k not in recipe.weights]


@dataclass(frozen=True)
class Recipe:
    """strategy: proportional, interleaved (every `run` steps the next), weighted (softmax of w / temperature),
    sequential, or staged (`stages`: name, start, end, weights)."""

    weights: dict[str, float]
    strategy: str = "proportional"
    run: int = 1
    temperature: float = 1.0
    stages: Sequence[tuple[str, int, int, dict[str, float]]] = field(default_factory=tuple)
    seed: str = "42"


def _pick(u: Column, weights: dict[str, float]) -> Column:
    """The dataset whose range of cumulative weights holds u."""
    upto, bounds = 0.0, []
    for k, w in weights.items():
        upto += w
        bounds.append((k, upto))
    out = F.lit(bounds[-1][0])
    for k, bound in reversed(bounds[:-1]):
        out = F.when(u < bound, F.lit(k)).otherwise(out)
    return out


def chosen(step: Column, recipe: Recipe) -> Column:
    """The dataset of a step, NULL outside all stages."""
    w, names, u = normalized(recipe.weights), list(recipe.weights), uniform(recipe.seed, step)
    if recipe.strategy == "proportional":
        return _pick(u, w)
    if recipe.strategy in ("interleaved", "sequential"):
        run = recipe.run if recipe.strategy == "interleaved" else 1
        return F.element_at(F.array(*map(F.lit, names)), (F.floor(step / run) % len(names) + 1).cast("int"))
    if recipe.strategy == "weighted":
        soft = {k: math.exp(x / recipe.temperature) for k, x in recipe.weights.items()}
        return _pick(u, normalized(soft))
    if recipe.strategy == "staged":
        out = F.lit(None).cast("string")
        for _, start, end, weights in reversed(list(recipe.stages)):
            out = F.when((step >= start) & (step < end), _pick(u, normalized(weights))).otherwise(out)
        return out
    raise ValueError(f"unknown strategy: {recipe.strategy}")


def steps(spark: SparkSession, recipe: Recipe, n: int) -> DataFrame:
    """(step, dataset) of the first n steps."""
    return spark.range(n).select(F.col("id").alias("step"), chosen(F.col("id"), recipe).alias("dataset"))


def difficulty(step: Column, total: int, warmup: int = 0, low: float = 0.0, high: float = 1.0, pacing: str = "linear", base: float = 10.0, size: int = 100, gamma: float = 0.9) -> Column:
    """Pacing of a curriculum: low during the warm-up, then linear, exponential, cosine or step."""
    after = step - warmup
    p = F.least(after / F.lit(float(max(total - warmup, 1))), F.lit(1.0))
    factor = {"linear": p, "exponential": (F.pow(F.lit(base), p) - 1) / (base - 1), "cosine": 0.5 * (1 - F.cos(p * math.pi)), "step": 1 - F.pow(F.lit(gamma), F.floor(after / size))}[pacing]
    return F.when(step < warmup, F.lit(low)).otherwise(low + (high - low) * factor)


def ratio(step: Column, initial: float, target: float, over: int, schedule: str = "linear", rate: float = 5.0) -> Column:
    """A mixing ratio annealed from initial to target."""
    p = step / F.lit(float(max(over, 1)))
    factor = {"linear": p, "cosine": 0.5 * (1 - F.cos(p * math.pi)), "exponential": 1 - F.exp(-rate * p)}[schedule]
    return F.when(step >= over, F.lit(target)).otherwise(initial + (target - initial) * factor)


def learning_rate(epoch: Column, initial: float, kind: str, total: int, step: int = 30, gamma: float = 0.1) -> Column:
    """constant, step, exponential, cosine or linear decay over epochs."""
    p = epoch / F.lit(float(max(total, 1)))
    return {"constant": F.lit(initial), "step": initial * F.pow(F.lit(gamma), F.floor(epoch / step)), "exponential": initial * F.pow(F.lit(gamma), epoch), "cosine": initial * 0.5 * (1 + F.cos(p * math.pi)), "linear": initial * (1 - p)}[kind]


#: Ready recipes: weights and strategy.
PRESETS = {
    "pretraining": Recipe({"web": 0.6, "books": 0.2, "code": 0.15, "papers": 0.05}, "proportional"),
    "sft": Recipe({"instructions": 0.6, "conversations": 0.3, "reasoning": 0.1}, "weighted"),
    "rlhf": Recipe({"preferences": 0.7, "prompts": 0.3}, "interleaved", run=8),
}
