"""Scores of classifiers: confusion metrics, ROC curves and what follows from them, per group or pooled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 64


def share(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b; `empty` where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(empty).cast("double"))


def confusion(score: Column, y: Column, threshold: float = 0.5) -> list[Column]:
    hit = score >= (0.5 if threshold != threshold else threshold)
    count = lambda c, name: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias(name)
    return [count(hit & (y == 1), "tp"), count(hit & (y != 1), "fp"), count(~hit & (y == 1), "fn"), count(~hit & (y != 1), "tn")]


def confusion_metrics(df: DataFrame, keys: Sequence[str] = (), score: str = "score", y: str = "y", threshold: float = 0.5) -> DataFrame:
    """Accuracy, F1, Jaccard, Dice, precision of both classes and the error ratio at score >= threshold (0.5 for NaN); ratios of nothing are 0, Dice and Jaccard of two empty masks 1."""
    return with_ratios(df.groupBy(*keys).agg(*confusion(F.col(score), F.col(y), threshold)))


def with_ratios(c: DataFrame) -> DataFrame:
    """c (tp, fp, fn, tn) with the ratios of confusion_metrics."""
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    both_empty = (tp + fp + fn) == 0
    return c.withColumns({
        "accuracy": share(tp + tn, tp + fp + fn + tn), "f1": share(2 * tp, 2 * tp + fp + fn), "jaccard": F.when(both_empty, 1.0).otherwise(share(tp, tp + fp + fn)), "dice": F.when(both_empty, 1.0).otherwise(share(2 * tp, 2 * tp + fp + fn)),
        "ppv": share(tp, tp + fp), "npv": share(tn, tn + fn), "error_ratio": share(fp + fn, tp + fp + fn + tn),
    })


def roc_points(df: DataFrame, keys: Sequence[str] = (), score: str = "score", y: str = "y") -> DataFrame:
    """keys, threshold, tp, fp, p, n, tpr, fpr, the point before (tpr0, fpr0), and the rows at the score: one row per distinct score, highest first.

    Rows are first counted per score. The counts are cut into score ranges, each range sums up on its own and takes over the
    sum of the ranges above, so that one large group, or the pooled one, isn't ordered in a single task. Rates of a missing
    class are null.
    """
    counts = df.groupBy(*keys, F.col(score).alias("threshold")).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("__tp"), F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).alias("__fp"))
    # At most PARTS bounds, whatever the number of scores.
    bounds = df.agg(F.percentile_approx(score, [i / PARTS for i in range(1, PARTS)], 10_000).alias("b")).first()["b"] or []
    part = F.size(F.filter(F.array(*[F.lit(float(b)) for b in sorted(set(bounds))]).cast("array<double>"), lambda b: b <= F.col("threshold")))
    cut = counts.withColumn("__part", part)
    sums = cut.groupBy(*keys, "__part").agg(F.sum("__tp").alias("tp"), F.sum("__fp").alias("fp"))
    above = Window.partitionBy(*keys).orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carried = sums.select(*keys, "__part", F.coalesce(F.sum("tp").over(above), F.lit(0)).alias("__ctp"), F.coalesce(F.sum("fp").over(above), F.lit(0)).alias("__cfp"), F.sum("tp").over(whole).alias("p"), F.sum("fp").over(whole).alias("n"))
    inside = Window.partitionBy(*keys, "__part").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*keys, "__part")]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    joined = cut.withColumns({"__itp": F.sum("__tp").over(inside), "__ifp": F.sum("__fp").over(inside)}).alias("l").join(carried.alias("r"), condition)
    tp, fp = F.col("__itp") + F.col("__ctp"), F.col("__ifp") + F.col("__cfp")
    rate = lambda a, b: F.when(F.col(b) > 0, a / F.col(b))
    return joined.select(
        *[F.col(f"l.{k}").alias(k) for k in keys], "threshold", tp.alias("tp"), fp.alias("fp"), "p", "n",
        rate(tp, "p").alias("tpr"), rate(fp, "n").alias("fpr"), rate(tp - F.col("__tp"), "p").alias("tpr0"), rate(fp - F.col("__fp"), "n").alias("fpr0"), (F.col("__tp") + F.col("__fp")).alias("rows"),
    )


def roc_auc(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Area by trapezoids; null if a class is missing."""
    return points.groupBy(*keys).agg(F.sum((F.col("fpr") - F.col("fpr0")) * (F.col("tpr") + F.col("tpr0")) / 2).alias("roc_auc"))


def metrics_of_points(points: DataFrame, keys: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """confusion_metrics, roc_auc and raw (the sum of all scores) out of roc_points: the rows are read and counted once for all of them. Null scores are never hits, null labels count as negative."""
    hit = F.col("threshold") >= threshold
    at = lambda c: F.coalesce(F.max(F.when(hit, F.col(c))), F.lit(0)).alias(c)
    area = F.sum((F.col("fpr") - F.col("fpr0")) * (F.col("tpr") + F.col("tpr0")) / 2)
    sums = points.groupBy(*keys).agg(at("tp"), at("fp"), F.max("p").alias("__p"), F.max("n").alias("__n"), area.alias("roc_auc"), F.sum(F.col("threshold") * F.col("rows")).alias("raw"))
    return with_ratios(sums.withColumns({"fn": F.col("__p") - F.col("tp"), "tn": F.col("__n") - F.col("fp")}).drop("__p", "__n"))


def youden_cutoff(points: DataFrame, keys: Sequence[str] = (), ties: str = "highest") -> DataFrame:
    """The threshold with the largest TPR - FPR, its rates and index; of equals the highest, or the lowest."""
    sign = 1 if ties == "highest" else -1
    # Differences of counts compare exactly where differences of rates would not.
    exact = F.col("tp") * F.col("n") - F.col("fp") * F.col("p")
    best = points.groupBy(*keys).agg(F.max(F.struct(exact.alias("j"), (sign * F.col("threshold")).alias("t"), "tpr", "fpr")).alias("b"))
    return best.select(*keys, (sign * F.col("b.t")).alias("cutoff"), F.col("b.tpr").alias("tpr"), F.col("b.fpr").alias("fpr"), (F.col("b.tpr") - F.col("b.fpr")).alias("youden"))


def balanced_cutoff(points: DataFrame, keys: Sequence[str] = (), largest: bool = False) -> DataFrame:
    """The threshold where TPR and 1 - FPR are nearest (or farthest apart); of equals the highest."""
    gap = F.abs(F.col("tp") * F.col("n") - (F.col("n") - F.col("fp")) * F.col("p"))
    best = points.groupBy(*keys).agg(F.max(F.struct((gap if largest else -gap).alias("g"), "threshold", "tpr", "fpr")).alias("b"))
    return best.select(*keys, F.col("b.threshold").alias("cutoff"), F.col("b.tpr").alias("tpr"), F.col("b.fpr").alias("fpr"))


def mean_roc(points: DataFrame, fold: str, keys: Sequence[str] = (), steps: int = 100) -> DataFrame:
    """Per grid point of FPR the mean and population deviation of the folds' interpolated TPR, the band of one deviation clipped to [0, 1]; the last point's mean is 1.

    Each curve segment (from the point before to the point) serves the grid points inside it, so curve and grid meet without
    a range join.
    """
    last = steps - 1
    begin, end = F.ceil(F.col("fpr0") * last - 1e-9), F.floor(F.col("fpr") * last + 1e-9)
    grid = points.filter("fpr IS NOT NULL AND tpr IS NOT NULL AND fpr > fpr0").withColumn("g", F.explode(F.when(begin <= end, F.sequence(begin, end))))
    at = F.col("g") / last
    slope = (F.col("tpr") - F.col("tpr0")) / (F.col("fpr") - F.col("fpr0"))
    value = F.col("tpr0") + (at - F.col("fpr0")) * slope
    per_fold = grid.groupBy(*keys, fold, "g").agg(F.max(F.when(F.col("g") == 0, 0.0).otherwise(value)).alias("tpr"))
    stats = per_fold.groupBy(*keys, "g").agg(F.avg("tpr").alias("m"), F.stddev_pop("tpr").alias("s"))
    mean = F.when(F.col("g") == last, 1.0).otherwise(F.col("m"))
    return stats.select(*keys, "g", (F.col("g") / last).alias("fpr"), mean.alias("tpr"), F.col("s").alias("std"), F.greatest(mean - F.col("s"), F.lit(0.0)).alias("low"), F.least(mean + F.col("s"), F.lit(1.0)).alias("high"))
