"""Reports over model runs (model, rf, fold and scores): distributions, curves, weights and comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.operators import statistics as T

BOX = (("low", 0.0), ("q25", 0.25), ("median", 0.5), ("q75", 0.75), ("high", 1.0))


def medians(runs: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """keys and the exact median of each value; groups are the folds of a run."""
    return runs.groupBy(*keys).agg(*[F.percentile(v, F.lit(0.5)).alias(v) for v in values])


def box_stats(runs: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, low, q25, median, q75, high, in the order of the medians."""
    q = runs.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(s) for _, s in BOX])).alias("__q"))
    return q.select(*keys, *[F.col("__q")[i].alias(n) for i, (n, _) in enumerate(BOX)]).orderBy("median")


def score_histogram(runs: DataFrame, keys: Sequence[str], value: str, bins: int) -> DataFrame:
    """keys, bin, n over equal bins between the smallest and the largest value of all; the largest falls into the last, a single value into the first, null has no bin."""
    ends = runs.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    place = F.try_divide(F.col(value) - F.col("__lo"), (F.col("__hi") - F.col("__lo")) / bins)
    bin_ = F.when(F.col(value).isNotNull(), F.least(F.floor(F.coalesce(place, F.lit(0.0))), F.lit(bins - 1))).cast("int")
    return runs.join(F.broadcast(ends)).groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("n"))


def mean_by_rf(runs: DataFrame, kind: Column, value: str, voxel_mm: float) -> DataFrame:
    """rf, class, mean and the neighbourhood's reach in mm."""
    g = runs.groupBy("rf", kind.alias("class")).agg(F.avg(value).alias("mean"))
    return g.withColumn("width_mm", F.col("rf") * voxel_mm)


def training_curve(runs: DataFrame, step: str, validation: Column, value: str) -> DataFrame:
    """round, part (train or validation), mean and sample deviation; std is null for a single run."""
    part = F.when(validation, "validation").otherwise("train").alias("part")
    return runs.groupBy(F.col(step).alias("round"), part).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def channel_weights(coefficients: DataFrame, places: int) -> DataFrame:
    """channel, median, std, share from coefficients (fold, pos, weight), channel-major with `places` to a channel: medians over places, then over folds; shares are of the absolute medians, null if all are 0."""
    per_fold = coefficients.groupBy("fold", F.floor(F.col("pos") / places).alias("channel")).agg(F.percentile("weight", F.lit(0.5)).alias("__m"))
    c = per_fold.groupBy("channel").agg(F.percentile("__m", F.lit(0.5)).alias("median"), F.stddev_pop("__m").alias("std"))
    return c.join(F.broadcast(c.agg(F.sum(F.abs("median")).alias("__total")))).select("channel", "median", "std", F.try_divide(F.abs("median"), "__total").alias("share"))


def spatial_weights(coefficients: DataFrame, places: int) -> DataFrame:
    """place, median of the coefficients of that place over channels and folds."""
    return coefficients.groupBy((F.col("pos") % places).alias("place")).agg(F.percentile("weight", F.lit(0.5)).alias("median"))


def trained_thresholds(runs: DataFrame, threshold: Column) -> DataFrame:
    """model, the median of its folds' thresholds, and the number of folds."""
    return runs.groupBy("model").agg(F.percentile(threshold, F.lit(0.5)).alias("threshold"), F.count("*").alias("folds"))


def union_runs(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All runs under the union of their columns; what a table lacks is null."""
    for o in others:
        first = first.unionByName(o, allowMissingColumns=True)
    return first


def rf_comparison(runs: DataFrame, near: int, far: int, pooled: str = "mean model") -> DataFrame:
    """model, mean_rf<near>, mean_rf<far> and p of the signed-rank test between them by fold; also for the mean over all models."""
    pool = runs.groupBy("rf", "fold").agg(F.avg("roc_auc").alias("roc_auc")).withColumn("model", F.lit(pooled))
    both = runs.select("model", "rf", "fold", "roc_auc").unionByName(pool)
    test = T.wilcoxon(T.pair_runs(both, far - near).filter(F.col("rf") == near), ["model"]).select("model", "p")
    means = both.groupBy("model").agg(*[F.avg(F.when(F.col("rf") == r, F.col("roc_auc"))).alias(f"mean_rf{r}") for r in (near, far)])
    return means.join(test, "model")


def best_rates(best: DataFrame) -> DataFrame:
    """rate, mean, runs: the means of tpr and fpr at each run's best cut-off."""
    return best.select(F.expr("stack(2, 'tpr', tpr, 'fpr', fpr) AS (rate, v)")).groupBy("rate").agg(F.avg("v").alias("mean"), F.count("*").alias("runs"))
