"""Grouped statistics, calibration of thresholds against labels, and report pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def described(c: str) -> list[Column]:
    """max, min, mean, sample variance and deviation of a column; 0.0 where there are no values, or too few to vary."""
    zero = F.lit(0.0)
    return [F.coalesce(f(c).cast("double"), zero).alias(n) for n, f in (("max", F.max), ("min", F.min), ("mean", F.avg), ("variance", F.var_samp), ("stdev", F.stddev_samp))]


def group_means(df: DataFrame, group: Column, measures: list[str], improved: dict[str, Column]) -> DataFrame:
    """Means by group (`true` / `false`) and over all, with how often a condition holds and its rate (denominator at least 1)."""
    g = df.withColumn("__group", F.when(F.coalesce(group, F.lit(False)), "true").otherwise("false"))
    aggs = [F.count(F.lit(1)).alias("n")] + [F.coalesce(F.avg(m), F.lit(0.0)).alias(f"mean_{m}") for m in measures]
    for name, cond in improved.items():
        aggs += [F.count_if(cond).alias(f"n_{name}"), (F.count_if(cond) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias(f"rate_{name}")]
    return g.rollup("__group").agg(*aggs).withColumn("group", F.coalesce("__group", F.lit("all"))).drop("__group")


def tag_stats(df: DataFrame, tag: str, score: str) -> DataFrame:
    """Count and mean score by tag and overall (`ALL`)."""
    return df.rollup(tag).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(score), F.lit(0.0)).alias("mean_score")).withColumn(tag, F.coalesce(tag, F.lit("ALL")))


def roc_auc(df: DataFrame, groups: list[str], label: str, score: str) -> DataFrame:
    """P(positive above negative) + half P(tie) for each group, from average ranks; null where a class is empty.

    Scores are counted by value first, so that the ranking handles distinct scores, not rows.
    """
    v = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*groups, score).agg(F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("n"))
    w = W.partitionBy(*groups).orderBy(score).rowsBetween(W.unboundedPreceding, -1)
    below = v.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return below.groupBy(*groups).agg(
        F.sum("p").alias("n_positive"), F.sum("n").alias("n_negative"), (F.sum(F.col("p") * (F.col("below") + F.col("n") * 0.5)) / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auc")
    )


def threshold_scan(df: DataFrame, groups: list[str], label: str, score: str, steps: int = 100) -> DataFrame:
    """n_selected, n_correct and precision at each of steps + 1 thresholds from 0 to 1, from cumulative counts by step.

    A score counts for every threshold up to itself; each row is counted once, at the last threshold it reaches.
    """
    reach = F.floor(F.col(score) * steps + 1e-9).cast("int")
    last = F.when(reach * F.lit(1.0 / steps) > F.col(score), reach - 1).when((reach + 1) * F.lit(1.0 / steps) <= F.col(score), reach + 1).otherwise(reach)
    at = df.filter(F.col(label).isNotNull() & (F.col(score) >= 0)).withColumn("__i", F.least(last, F.lit(steps)))
    counts = at.groupBy(*groups, "__i").agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.col(label)).alias("__c"))
    keys = df.select(*groups).distinct() if groups else df.sparkSession.range(1).select()
    grid = keys.select(*groups, F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("__i"))
    full = grid.join(counts, [*groups, "__i"], "left").fillna(0, ["__n", "__c"])
    w = W.partitionBy(*groups).orderBy(F.desc("__i")).rowsBetween(W.unboundedPreceding, 0)
    out = full.withColumn("n_selected", F.sum("__n").over(w)).withColumn("n_correct", F.sum("__c").over(w)).withColumn("threshold", F.col("__i") * F.lit(1.0 / steps))
    return out.select(*groups, "threshold", "n_selected", "n_correct", F.when(F.col("n_selected") > 0, F.col("n_correct") / F.col("n_selected")).alias("precision"))


def precision_threshold(df: DataFrame, groups: list[str], label: str, score: str, target: float = 0.8, least: int = 1) -> DataFrame:
    """The smallest threshold with at least that precision over at least `least` selected rows; no row where there is none."""
    s = threshold_scan(df, groups, label, score).filter((F.col("precision") >= target) & (F.col("n_selected") >= least))
    return s.groupBy(*groups).agg(F.min("threshold").alias("threshold"), F.min_by("n_selected", "threshold").alias("n_selected"), F.min_by("precision", "threshold").alias("precision"))


def cross_validated_threshold(df: DataFrame, fold: str, label: str, score: str, folds: int = 5, target: float = 0.8, least: int = 1, combine: str = "mean") -> DataFrame:
    """One row: the mean (or with `combine="max"` the largest) of the folds' thresholds, each found on the other folds, and the mean
    precision on the fold itself.

    Null where a fold finds no threshold or there are fewer rows than folds; a fold that selects nothing counts 0.0.
    """
    if combine not in ("mean", "max"):
        raise ValueError(f"unknown way to combine: {combine!r}")
    rest = df.withColumn("held", F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda i: i != F.col(fold))))
    per = precision_threshold(rest, ["held"], label, score, target, least).select("held", "threshold")
    check = df.join(F.broadcast(per), F.col("held") == F.col(fold)).groupBy("held", "threshold").agg(
        F.count_if(F.col(score) >= F.col("threshold")).alias("n"), F.count_if((F.col(score) >= F.col("threshold")) & F.col(label)).alias("c")
    )
    out = check.agg(F.count(F.lit(1)).alias("found"), (F.avg if combine == "mean" else F.max)("threshold").alias("t"), F.avg(F.coalesce(F.col("c") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0))).alias("p"))
    out = out.withColumn("rows", df.agg(F.count(F.lit(1))).scalar())
    ok = (F.col("found") == folds) & (F.col("rows") >= folds)
    return out.select(F.col("found").alias("n_folds"), F.when(ok, F.col("t")).alias("threshold"), F.when(ok, F.col("p")).alias("precision"))


def class_gap(df: DataFrame, groups: list[str], label: str, score: str) -> DataFrame:
    """Mean score of positives less that of negatives."""
    return df.groupBy(*groups).agg((F.avg(F.when(F.col(label), F.col(score))) - F.avg(F.when(~F.col(label), F.col(score)))).alias("gap"))


def paired_wins(df: DataFrame, label: str, base: str, current: str) -> DataFrame:
    """How often the current score moved the right way: over all pairs, and over those that moved."""
    win = (F.col(label) & (F.col(current) > F.col(base))) | (~F.col(label) & (F.col(current) < F.col(base)))
    moved = F.col(current) != F.col(base)
    return df.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(win).alias("n_wins"), F.count_if(moved).alias("n_moved"),
        (F.count_if(win) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("rate_all"), (F.count_if(win) / F.nullif(F.count_if(moved), F.lit(0))).alias("rate_moved"),
    )


def ranked(df: DataFrame, metric: str, order: str, name: str = "place") -> DataFrame:
    """Configurations by a metric, best first, ties by their order. Meant for the few rows of a report."""
    return df.withColumn(name, F.row_number().over(W.orderBy(F.desc(metric), order)))


def histogram(df: DataFrame, value: str, bins: int = 200) -> DataFrame:
    """Counts in equal bins over the data's range; the last bin is closed at its right. Empty bins have no row."""
    v = df.select(F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    x = v.withColumn("lo", v.agg(F.min("v")).scalar()).withColumn("hi", v.agg(F.max("v")).scalar()).withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    b = F.when(F.col("width") > 0, F.least(F.floor((F.col("v") - F.col("lo")) / F.col("width")), F.lit(bins - 1))).otherwise(0)
    return x.groupBy(b.cast("int").alias("bin"), F.col("lo"), F.col("width")).agg(F.count(F.lit(1)).alias("n")).select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("left_edge"), "n")


def limited_histogram(df: DataFrame, value: str, limit: float, of: str | None = None, edges: int = 100) -> DataFrame:
    """Counts between equally spaced edges from 0 to 1.5 times a limit, or to the 99th percentile of `of` if that is more.

    `of` is the value itself by default. The last bin is closed at its right; values outside the edges aren't counted, and empty
    bins have no row.
    """
    top = df.agg(F.greatest(F.lit(1.5 * limit), F.percentile(F.col(of or value).cast("double"), 0.99)).alias("top")).scalar()
    v = df.select(F.col(value).cast("double").alias("v")).withColumn("top", top).filter("v >= 0 AND v <= top").withColumn("step", F.col("top") / (edges - 1))
    k = F.floor(F.col("v") / F.col("step"))
    b = F.least(k + F.when(F.col("v") < k * F.col("step"), -1).when(F.col("v") >= (k + 1) * F.col("step"), 1).otherwise(0), F.lit(edges - 2))
    return v.groupBy(b.cast("int").alias("bin"), "step").agg(F.count(F.lit(1)).alias("n")).select("bin", (F.col("bin") * F.col("step")).alias("left_edge"), "n")


def config_grid(spark: SparkSession, normal: tuple[str, ...] = ("none", "noise", "semantic", "full"), build: tuple[str, ...] = ("legacy", "block")) -> DataFrame:
    """Every way of normalizing with every way of building: normal, build and the configuration's name."""
    one = lambda xs, name: spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in xs])).alias(name))
    return one(normal, "normal").crossJoin(one(build, "build")).withColumn("config", F.concat_ws("_", "normal", "build"))


def percentiles(df: DataFrame, groups: list[str], value: str, at: tuple[float, ...] = (0.8, 0.99)) -> DataFrame:
    """Exact percentiles with linear interpolation, with count, mean and maximum."""
    return df.groupBy(*groups).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).cast("double").alias("max"), *[F.percentile(value, p).alias(f"p{round(p * 100)}") for p in at])


def status_pivot(df: DataFrame, groups: list[str], status: str, metrics: list[str], yes: str, no: str) -> DataFrame:
    """For each metric: mean by the two statuses and their difference, one row for each group and metric."""
    long = df.select(*groups, status, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")).select(*groups, status, "x.metric", "x.v")
    mean = lambda s: F.avg(F.when(F.col(status) == s, F.col("v")))
    return long.groupBy(*groups, "metric").agg(mean(yes).alias(f"mean_{yes}"), mean(no).alias(f"mean_{no}"), (mean(yes) - mean(no)).alias("difference"))


def best_by_metric(df: DataFrame, model: str, metrics: list[str]) -> DataFrame:
    """metric, model, mean and whether the model is best in it: every tie at the maximum is, if that is above 0."""
    long = df.select(model, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")).select(model, "x.metric", "x.v")
    m = long.groupBy("metric", model).agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias("mean"))
    top = F.max("mean").over(W.partitionBy("metric"))
    return m.withColumn("best", (F.col("mean") == top) & (top > 0))


def scored_pass(df: DataFrame, score: str, threshold: float) -> DataFrame:
    return df.agg(F.count_if(F.col(score) >= threshold).alias("n_pass"), F.count(F.lit(1)).alias("n"))


def paired_configs(df: DataFrame, keys: list[str], config: str, base: str, value: str) -> DataFrame:
    """Each row of another configuration beside the base's row of the same key: keys, config, base_value, value."""
    b = df.filter(F.col(config) == base).select(*keys, F.col(value).alias("base_value"))
    return df.filter(F.col(config) != base).select(*keys, config, F.col(value).alias("value")).join(b, keys)


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    """A Markdown table of the few rows of an aggregate."""
    line = lambda cells: "| " + " | ".join(str(c) for c in cells) + " |"
    fmt = lambda v: f"{v:.4f}" if isinstance(v, float) else "" if v is None else v
    return "\n".join([line(columns), line(["---"] * len(columns)), *[line([fmt(r.get(c)) for c in columns]) for r in rows]])
