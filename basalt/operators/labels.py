"""Annotator agreement, confident learning, influence, evaluation and metric series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import free
from .splits import indexed

#: Points of a series that are smoothed in one row.
SEGMENT = 1000
#: Places whose values a rolling mean adds up together.
RUN = 16


def _counts(a: DataFrame) -> DataFrame:
    return a.groupBy("sample_id", "label").agg(F.count("*").alias("c"))


def pairwise_agreement(annotations: DataFrame) -> DataFrame:
    """annotations: (sample_id, annotator, label, confidence). Agreeing over all pairs of labels of a sample; 1 without pairs."""
    per = _counts(annotations).groupBy("sample_id").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("agree"), (F.sum("c") * (F.sum("c") - 1) / 2).alias("pairs"))
    return per.agg(F.when(F.sum("pairs") > 0, F.sum("agree") / F.sum("pairs")).otherwise(1.0).alias("agreement"))


def fleiss_kappa(annotations: DataFrame, raters: int) -> DataFrame:
    """Fleiss' kappa of complete panels."""
    c = _counts(annotations)
    per = c.groupBy("sample_id").agg(((F.sum(F.col("c") * F.col("c")) - raters) / (raters * (raters - 1.0))).alias("p"))
    n = per.agg(F.avg("p").alias("po"), F.count("*").alias("n"))
    share = c.groupBy("label").agg(F.sum("c").alias("t")).crossJoin(F.broadcast(n)).agg(F.sum(F.pow(F.col("t") / (F.col("n") * raters), 2)).alias("pe"), F.first("po").alias("po"))
    return share.select(F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))).otherwise(1.0).alias("kappa"))


def cohen_kappa(annotations: DataFrame, first: str, second: str) -> DataFrame:
    """Cohen's kappa of two annotators over the samples both labelled."""
    a = annotations.filter(F.col("annotator") == first).select("sample_id", F.col("label").alias("x"))
    j = a.join(annotations.filter(F.col("annotator") == second).select("sample_id", F.col("label").alias("y")), "sample_id")
    n = j.agg(F.count("*").alias("n"), F.avg((F.col("x") == F.col("y")).cast("double")).alias("po"))
    px, py = j.groupBy(F.col("x").alias("l")).agg(F.count("*").alias("a")), j.groupBy(F.col("y").alias("l")).agg(F.count("*").alias("b"))
    pe = px.join(py, "l").crossJoin(F.broadcast(n)).agg(F.sum(F.col("a") * F.col("b") / (F.col("n") * F.col("n"))).alias("pe"))
    return n.crossJoin(pe).select(F.when(F.col("pe") < 1, (F.col("po") - F.coalesce("pe", F.lit(0.0))) / (1 - F.coalesce("pe", F.lit(0.0)))).otherwise(1.0).alias("kappa"))


def krippendorff_alpha(annotations: DataFrame) -> DataFrame:
    """Nominal alpha over the samples with two labels or more."""
    c = _counts(annotations)
    sized = c.withColumn("m", F.sum("c").over(Window.partitionBy("sample_id"))).filter("m > 1")
    do = sized.agg(F.sum(F.col("c") * (F.col("m") - F.col("c")) / (F.col("m") - 1)).alias("d"), F.sum("c").alias("n"))
    de = sized.groupBy("label").agg(F.sum("c").alias("t")).agg(F.sum(F.col("t") * F.col("t")).alias("q"))
    return do.crossJoin(de).select(F.when(F.col("n") * F.col("n") > F.col("q"), 1 - F.col("d") * (F.col("n") - 1) / (F.col("n") * F.col("n") - F.col("q"))).otherwise(1.0).alias("alpha"))


def consensus(annotations: DataFrame) -> DataFrame:
    """(sample_id, label): the majority label, ties to the smallest."""
    w = Window.partitionBy("sample_id").orderBy(F.desc("c"), "label")
    return _counts(annotations).withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("sample_id", "label")


def annotator_stats(annotations: DataFrame) -> DataFrame:
    """(annotator, n, agreement with the consensus, mean confidence, low_confidence under 0.5)."""
    j = annotations.join(consensus(annotations).withColumnRenamed("label", "_l"), "sample_id")
    return j.groupBy("annotator").agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("_l")).cast("double")).alias("agreement"), F.avg("confidence").alias("confidence"), F.count_if(F.col("confidence") < 0.5).alias("low_confidence"))


def agreement_grade(x: Column) -> Column:
    return F.when(x >= 0.8, "excellent").when(x >= 0.6, "good").when(x >= 0.4, "fair").when(x >= 0.2, "poor").otherwise("critical")


def predicted(probabilities: Column) -> Column:
    """The first class with the largest probability, from 0."""
    return F.array_position(probabilities, F.array_max(probabilities)) - 1


def confident_joint(df: DataFrame, label: str = "label", probabilities: str = "probs", threshold: float | None = None) -> DataFrame:
    """(given, predicted, n): predictions of at least the threshold (1 / classes by default)."""
    p = F.col(probabilities)
    own = df.select(F.col(label).cast("long").alias("given"), predicted(p).alias("predicted"), F.array_max(p).alias("_p"), (F.lit(threshold) if threshold is not None else 1.0 / F.size(p)).alias("_t"))
    return own.filter("_p >= _t").groupBy("given", "predicted").agg(F.count("*").alias("n"))


def noise(joint: DataFrame) -> DataFrame:
    """The off-diagonal share."""
    return joint.agg((F.sum(F.when(F.col("given") != F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("noise_rate"))


def class_errors(df: DataFrame, label: str = "label", probabilities: str = "probs", threshold: float | None = None, top: int = 3) -> DataFrame:
    """(class, total, errors, error_rate, confused): confident predictions of another class over all rows of the class, and
    the classes most often predicted instead, as class:n, the smaller first of equals."""
    totals = df.groupBy(F.col(label).cast("long").alias("class")).agg(F.count("*").alias("total"))
    wrong = confident_joint(df, label, probabilities, threshold).filter("given <> predicted")
    by = wrong.groupBy(F.col("given").alias("class")).agg(F.sum("n").alias("errors"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "predicted"))).alias("l"))
    confused = F.array_join(F.transform(F.slice("l", 1, top), lambda x: F.concat_ws(":", x["predicted"], -x["n"])), ",")
    got = totals.join(by, "class", "left").select("class", "total", F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce(confused, F.lit("")).alias("confused"))
    return got.select("class", "total", "errors", (F.col("errors") / F.col("total")).alias("error_rate"), "confused")


def label_score(errors: DataFrame, noise_ratio: Column, noise_rate: Column) -> DataFrame:
    """One row, score from 0 to 1 from class errors, the share of label issues and the estimated noise rate: 1, less 0.6 times
    the mean of both, 0.2 times the worst class's distance from the mean class, and 0.2 times the worst class."""
    worst, mean = F.coalesce(F.max("error_rate"), F.lit(0.0)), F.coalesce(F.avg("error_rate"), F.lit(0.0))
    off = F.when((worst > 0) & (mean > 0), F.abs(worst - mean)).otherwise(0.0)
    penalty = F.least(0.5 * noise_ratio + 0.5 * noise_rate, F.lit(1.0))
    return errors.agg(F.least(F.greatest(1 - (0.6 * penalty + 0.2 * off + 0.2 * worst), F.lit(0.0)), F.lit(1.0)).alias("score"))


def label_summary(df: DataFrame, label: str = "label") -> DataFrame:
    """(class, n, ratio, balance_ratio, balanced): the smallest over the largest class, balanced over 0.5."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"), (F.min("n") / F.max("n")).alias("balance_ratio"))
    return counts.crossJoin(F.broadcast(total)).select("class", "n", (F.col("n") / F.col("t")).alias("ratio"), "balance_ratio", (F.col("balance_ratio") > 0.5).alias("balanced"))


def loss_influence(df: DataFrame, key: str, loss: str, full_loss: float | None = None) -> DataFrame:
    """(key, score): leaving a row out, the full model's loss less the one without it; else the mean loss less the row's."""
    if full_loss is not None:
        return df.select(key, (F.lit(full_loss) - F.col(loss)).alias("score"))
    mean = df.agg(F.avg(loss).alias("mean"))
    return df.select(key, F.col(loss).alias("loss")).crossJoin(F.broadcast(mean)).select(key, (F.col("mean") - F.col("loss")).alias("score"))


def class_influence(scores: DataFrame, label: str) -> DataFrame:
    """(class, mean, helpful, harmful): the mean score and the shares of positive and negative ones. scores: with a label."""
    s, n = F.col("score"), F.count(F.lit(1))
    return scores.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("class")).agg(F.avg(s).alias("mean"), (F.count_if(s > 0) / n).alias("helpful"), (F.count_if(s < 0) / n).alias("harmful"))


def attribution(report: DataFrame) -> DataFrame:
    """One row of an influence report: positive, negative and net influence, 1 less the share of harmful rows, and the benefit
    expected from pruning the most harmful ones."""
    s, n = F.col("score"), F.count(F.lit(1))
    part = lambda c: F.coalesce(F.sum(F.when(c, s)), F.lit(0.0))
    bad = F.count_if(F.col("class").isin("harmful", "highly_harmful")) / F.greatest(n, F.lit(1))
    return report.agg(part(s > 0).alias("positive"), part(s < 0).alias("negative"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("net"), (1 - bad).alias("efficiency"), (F.count_if(F.col("class") == "highly_harmful") / F.greatest(n, F.lit(1)) * 0.05).alias("pruning_benefit"))


def label_issues(df: DataFrame, key: str, label: str = "label", probabilities: str = "probs", method: str = "by_class", least: float = 0.0) -> DataFrame:
    """(key, given, predicted, margin, issue, prune) of rows whose prediction differs from their label.

    margin: the largest probability less the label's own; over 0.3 likely wrong, over 0.15 ambiguous, else borderline.
    prune: a margin over 0.1 (method by_class) or 0.05 (by_noise_rate, both). Predictions under `least` are left out.
    """
    p = F.col(probabilities)
    margin = F.array_max(p) - F.coalesce(F.get(p, F.col(label).cast("int")), F.lit(0.0))
    own = df.select(key, F.col(label).cast("long").alias("given"), predicted(p).alias("predicted"), margin.alias("margin"), F.array_max(p).alias("sure")).filter((F.col("given") != F.col("predicted")) & (F.col("sure") >= least)).drop("sure")
    return own.withColumn("issue", F.when(F.col("margin") > 0.3, "likely_wrong").when(F.col("margin") > 0.15, "ambiguous").otherwise("borderline")).withColumn("prune", F.col("margin") > (0.1 if method == "by_class" else 0.05))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def influence(samples: DataFrame, gradients: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, score): the mean inner product with the checkpoint gradients (vector of the same name).

    The mean of inner products is the inner product with the mean, so the gradients are averaged first.
    """
    mean = gradients.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x")).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("_l")).select(F.transform("_l", lambda v: v["x"]).alias("_g"))
    return samples.crossJoin(F.broadcast(mean)).select(key, dot(F.col(vector), F.col("_g")).alias("score"))


def influence_report(scores: DataFrame, key: str) -> DataFrame:
    """Adds class by distance from the mean in population deviations: beyond 2 highly, beyond 1 plainly helpful or harmful."""
    s = scores.agg(F.avg("score").alias("_m"), F.stddev_pop("score").alias("_s"))
    z = (F.col("score") - F.col("_m")) / F.col("_s")
    named = F.when(z > 2, "highly_helpful").when(z > 1, "helpful").when(z < -2, "highly_harmful").when(z < -1, "harmful").otherwise("neutral")
    return scores.crossJoin(F.broadcast(s)).select(key, "score", named.alias("class"))


def extremes(scores: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The k most helpful and the k most harmful rows."""
    top = scores.orderBy(F.desc("score"), key).limit(k).withColumn("side", F.lit("helpful"))
    return top.unionByName(scores.orderBy("score", key).limit(k).withColumn("side", F.lit("harmful")))


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("predicted")).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, support, precision, recall, f1), rounded to 4 places; 0 without a divisor."""
    c = confusion(df, label, prediction)
    true = c.groupBy("label").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    said = c.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said"))
    j = true.join(said, "label", "left")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("hit"), F.coalesce("said", F.lit(0))), ratio(F.col("hit"), F.col("support"))
    return j.select("label", "support", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 4).alias("f1"))


def regression(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """mse, rmse, mae and r2 (0 for a constant label), rounded to 4 places."""
    e, y = F.col(prediction) - F.col(label), F.col(label)
    mse, var = F.avg(e * e), F.var_pop(y)
    return df.agg(F.round(mse, 4).alias("mse"), F.round(F.sqrt(mse), 4).alias("rmse"), F.round(F.avg(F.abs(e)), 4).alias("mae"), F.round(F.when(var > 0, 1 - mse / var).otherwise(0.0), 4).alias("r2"))


def ema(series: DataFrame, name: str, step: str, value: str, alpha: float) -> DataFrame:
    """(series, step, value, ema): s0 = v0, then alpha * v + (1 - alpha) * s; alpha outside (0, 1) leaves values as they are.

    Points are placed by range and smoothed in segments of SEGMENT from 0; what the series carries into a segment is then
    added with its decay. One row holds a segment's points, or one number a segment of a series.
    """
    if not 0 < alpha < 1:
        return series.select(F.col(name).alias("series"), F.col(step).alias("step"), F.col(value).alias("value"), F.col(value).cast("double").alias("ema"))
    rows = indexed(series.select(F.col(name).alias("series"), F.col(step).alias("step"), F.col(value).cast("double").alias("value")), ["series", "step", "value"], "_i")
    points = rows.groupBy("series", F.floor(F.col("_i") / SEGMENT).alias("seg")).agg(F.array_sort(F.collect_list(F.struct("_i", "step", "value"))).alias("p"))
    none = F.array().cast("array<double>")
    own = F.aggregate("p", none, lambda a, x: F.concat(a, F.array(alpha * x["value"] + F.when(F.size(a) == 0, 0.0).otherwise((1 - alpha) * F.element_at(a, -1)))))
    points = points.withColumn("e", own)
    ends = points.select("series", F.struct("seg", F.size("p").alias("n"), F.element_at("e", -1).alias("b"), F.col("p")[0]["value"].alias("v")).alias("x"))
    ends = ends.groupBy("series").agg(F.array_sort(F.collect_list("x")).alias("x"))
    carry = F.aggregate("x", F.array(F.col("x")[0]["v"]), lambda a, x: F.concat(a, F.array(x["b"] + F.pow(F.lit(1 - alpha), x["n"]) * F.element_at(a, -1))))
    carried = ends.withColumn("c", carry).select(F.col("series").alias("_s"), F.explode(F.arrays_zip(F.col("x")["seg"].alias("seg"), F.slice("c", 1, F.size("x")).alias("c"))).alias("z")).select("_s", F.col("z.seg").alias("_g"), F.col("z.c").alias("c"))
    joined = points.join(carried, F.col("series").eqNullSafe(F.col("_s")) & (F.col("seg") == F.col("_g")))
    return joined.select("series", "c", F.posexplode(F.arrays_zip(F.col("p")["step"].alias("step"), F.col("p")["value"].alias("value"), F.col("e").alias("e"))).alias("k", "r")).select("series", "r.step", "r.value", (F.col("r.e") + F.pow(F.lit(1 - alpha), F.col("k") + 1) * F.col("c")).alias("ema"))


def aligned(a: DataFrame, b: DataFrame, step: str, value: str) -> DataFrame:
    """(place, a, b): two series point by point, by their places in step order, as far as both reach."""
    one = lambda df, n: indexed(df.select(F.col(step).alias("step"), F.col(value).alias(n)), ["step"], "place").select("place", n)
    return one(a, "a").join(one(b, "b"), "place")


def rolling(df: DataFrame, order: Sequence[str], value: str, n: int = 1000) -> DataFrame:
    """Adds rolling_mean and rolling_max of the last n rows of an order, this one included.

    Rows are cut into blocks of n; a block sees the one before it too, so that no task holds more than two of them. Means
    of floating-point values add up whole runs of RUN places, then what is left at both ends, as an engine with a tree of
    sums does: the same doubles, on whichever side of a tie they fall.
    """
    i, block, home, run, upto, rest = free(df, "index", "block", "home", "run", "upto", "rest")
    rows = indexed(df, order, i).withColumn(home, F.floor(F.col(i) / n)).withColumn(run, F.floor(F.col(i) / RUN))
    seen = rows.withColumn(block, F.explode(F.array(F.col(home), F.col(home) + 1)))
    w = Window.partitionBy(block).orderBy(i)
    last = w.rowsBetween(-(n - 1), 0)
    mean = F.avg(value).over(last)
    if n >= RUN and dict(df.dtypes)[value] in ("float", "double"):
        own = Window.partitionBy(block, run).orderBy(i)
        seen = seen.withColumn(upto, F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, 0))).withColumn(rest, F.sum(value).over(own.rowsBetween(0, Window.unboundedFollowing)))
        ends, first = F.col(i) % RUN == RUN - 1, F.col(i) - (n - 1)
        whole = F.sum(F.when(ends, F.col(upto))).over(w.rowsBetween(RUN - n, 0))  # runs that start and end in the frame
        head = F.when((first > 0) & (first % RUN != 0), F.lag(rest, n - 1).over(w))
        parts = [F.coalesce(c, F.lit(0.0)) for c in (whole, head, F.when(~ends, F.col(upto)))]
        mean = F.try_divide(parts[0] + parts[1] + parts[2], F.count(value).over(last))
    got = seen.withColumns({"rolling_mean": mean, "rolling_max": F.max(value).over(last)})
    return got.filter(F.col(block) == F.col(home)).select(*df.columns, "rolling_mean", "rolling_max")


def last_points(series: DataFrame, name: str, step: str, n: int) -> DataFrame:
    """The n last points of each series."""
    return series.withColumn("_n", F.row_number().over(Window.partitionBy(name).orderBy(F.desc(step)))).filter(F.col("_n") <= n).drop("_n")


def trimmed(series: DataFrame, name: str, step: str, most: int = 2000, keep: int = 1000) -> DataFrame:
    """Series with more than `most` points keep the newest `keep`."""
    n = F.count(F.lit(1)).over(Window.partitionBy(name))
    ranked = series.withColumn("_c", n).withColumn("_n", F.row_number().over(Window.partitionBy(name).orderBy(F.desc(step))))
    return ranked.filter((F.col("_c") <= most) | (F.col("_n") <= keep)).drop("_c", "_n")


def best_metric(series: DataFrame, name: str, value: str) -> DataFrame:
    """(name, best): the smallest value of losses and errors, the largest of other metrics."""
    low = F.lower(F.col(name)).rlike("loss|error|mse|rmse|mae")
    return series.groupBy(name).agg(F.min(value).alias("_a"), F.max(value).alias("_b")).select(name, F.when(low, F.col("_a")).otherwise(F.col("_b")).alias("best"))
