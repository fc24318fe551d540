"""Summaries and rank tests of model runs; deterministic samples and folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Differences, and values of both sides together, up to which p_exact is given.
EXACT_PAIRS, EXACT_VALUES = 25, 30


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the standard normal distribution by a rational approximation of erfc (error under 1.2e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.5 * x)
    # Coefficients of the approximation, highest power first.
    series = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        series = F.lit(c) + t * series
    return t * F.exp(-x * x + series)


def doubled_ranks() -> Column:
    """Twice the ranks (whole numbers, even with ties) of groups that are small enough for exact counts."""
    return F.collect_list(F.when(F.col("__few"), (2 * F.col("__r")).cast("int")))


def mean_rank(by: Sequence[str], value: Column) -> Column:
    """Rank with the mean of tied places."""
    w = Window.partitionBy(*by).orderBy(value)
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0


def subset_counts(shifts: Column, size: Column) -> Column:
    """At index s (from 0, under `size`) the number of subsets of the array `shifts` of whole numbers whose sum is s, by adding one number at a time."""
    none = F.array_repeat(F.lit(0).cast("long"), (size - 1).cast("int"))
    moved = lambda acc, by: F.slice(F.concat(F.array_repeat(F.lit(0).cast("long"), by), acc), F.lit(1), size.cast("int"))
    return F.aggregate(shifts, F.concat(F.array(F.lit(1).cast("long")), none), lambda acc, by: F.zip_with(acc, moved(acc, by), lambda x, y: x + y))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x)


def wilcoxon(pairs: DataFrame, keys: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """Signed-rank test: keys, n, w_plus, w_minus, z, p, p_exact.

    Zero differences are dropped, ties get mean ranks, p is the normal approximation with tie correction. p_exact counts
    which share of all choices of signs is as far out, two-sided, given the ties; null for more than 25 differences. Groups
    are the folds of a run, so windows by key stay small.
    """
    d = pairs.withColumn("__d", F.round(F.col(a) - F.col(b), 12)).filter("__d <> 0").withColumn("__abs", F.abs("__d"))
    ranked = d.withColumns({"__r": mean_rank(keys, F.col("__abs")), "__t": F.count("*").over(Window.partitionBy(*keys, "__abs")), "__few": F.count("*").over(Window.partitionBy(*keys)) <= EXACT_PAIRS})
    signed = lambda c: F.coalesce(F.sum(F.when(c, F.col("__r"))), F.lit(0.0))
    s = ranked.groupBy(*keys).agg(F.count("*").alias("n"), signed(F.col("__d") > 0).alias("w_plus"), signed(F.col("__d") < 0).alias("w_minus"), F.sum(F.col("__t") * F.col("__t") - 1).alias("__ties"), doubled_ranks().alias("__ranks"))
    n = F.col("n")
    var = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("__ties") / 48.0
    z = F.when(var > 0, (F.least("w_plus", "w_minus") - n * (n + 1) / 4.0) / F.sqrt(var))
    few = F.least(n, F.lit(EXACT_PAIRS))  # no long array for groups without exact counts, whatever is evaluated
    counts = subset_counts(F.col("__ranks"), few * (few + 1) + 1)
    below = total(F.slice(counts, F.lit(1), (2 * F.least("w_plus", "w_minus") + 1).cast("int")))
    exact = F.when(n <= EXACT_PAIRS, F.least(F.lit(1.0), 2 * below / F.pow(F.lit(2.0), n)))
    return s.withColumn("z", z).withColumns({"p": normal_tail(F.col("z")), "p_exact": exact}).drop("__ties", "__ranks")


def mann_whitney(df: DataFrame, keys: Sequence[str], value: str, first: Column) -> DataFrame:
    """U test of the rows where `first` holds against the others: keys, n1, n2, u, z, p, p_exact; mean ranks, tie and continuity correction.

    z and p are null for a single row, an empty side or equal values only. p_exact counts which share of all ways to choose
    n1 of the ranks is as far out, two-sided, given the ties; null for an empty side or more than 30 rows.
    """
    r = df.withColumns({"__g": first.cast("int"), "__r": mean_rank(keys, F.col(value)), "__t": F.count("*").over(Window.partitionBy(*keys, value)), "__few": F.count("*").over(Window.partitionBy(*keys)) <= EXACT_VALUES})
    s = r.groupBy(*keys).agg(F.sum("__g").alias("n1"), F.sum(1 - F.col("__g")).alias("n2"), F.sum(F.col("__g") * F.col("__r")).alias("__r1"), F.sum(F.col("__t") * F.col("__t") - 1).alias("__ties"), doubled_ranks().alias("__ranks"))
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    u = F.col("__r1") - n1 * (n1 + 1) / 2.0
    var = n1 * n2 / 12.0 * ((n + 1) - F.try_divide(F.col("__ties"), n * (n - 1)))
    z = F.when(var > 0, F.greatest(F.abs(u - n1 * n2 / 2.0) - 0.5, F.lit(0.0)) / F.sqrt(var))
    # Subsets of k ranks with doubled sum s are counted at index k * width + s: each rank taken moves by its sum and one width.
    few = F.least(n, F.lit(EXACT_VALUES))
    width = few * (few + 1) + 1
    counts = subset_counts(F.transform("__ranks", lambda x: (x + width).cast("int")), (F.least(n1, few) + 1) * width)
    chosen = F.slice(F.when((n <= EXACT_VALUES) & (n1 > 0) & (n2 > 0), counts), (n1 * width + 1).cast("int"), width.cast("int"))
    at = (2 * F.col("__r1")).cast("int") + 1
    s = s.withColumns({"u": u, "z": z, "__chosen": chosen})
    low, high = total(F.slice("__chosen", F.lit(1), at)), total(F.slice("__chosen", at, width.cast("int")))
    exact = F.least(F.lit(1.0), 2 * F.least(low, high) / total(F.col("__chosen")))
    exact = F.when(F.col("__chosen").isNotNull(), exact)
    return s.withColumns({"p": normal_tail(F.col("z")), "p_exact": exact}).drop("__r1", "__ties", "__ranks", "__chosen")


def hash_order(seed: str, *keys: str) -> Column:
    """32 hexadecimal digits that order rows at random, the same on every engine."""
    return F.md5(F.concat_ws("-", F.lit(seed), *[F.col(k).cast("string") for k in keys]))


def exact_sample(df: DataFrame, order: Column, want: DataFrame) -> DataFrame:
    """The rows with the smallest hash order, as many as the one row of `want` (column __want) says, without a global sort.

    Rows are counted by the first 16 bits of the order (at most 65,536 counts); lower buckets are taken whole and only the
    bucket that the number falls into is ranked.
    """
    keyed = df.withColumns({"__h": order, "__b": F.conv(F.substring(order, 1, 4), 16, 10).cast("int")})
    below = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = keyed.groupBy("__b").agg(F.count("*").alias("__n")).withColumn("__below", F.coalesce(F.sum("__n").over(below), F.lit(0)))
    left = F.col("__want") - F.col("__below")
    # At most 65,536 rows of three numbers.
    limits = F.broadcast(buckets.join(F.broadcast(want)).select("__b", left.alias("__left"), (left >= F.col("__n")).alias("__whole")).filter("__left > 0"))
    found = keyed.join(limits, "__b")
    cut = found.filter("NOT __whole").withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy("__h"))).filter("__r <= __left").drop("__r")
    return found.filter("__whole").unionByName(cut).drop("__h", "__b", "__left", "__whole")


def undersample_negatives(df: DataFrame, keys: Sequence[str], seed: str = "1", label: str = "label", mask: str = "mask") -> DataFrame:
    """All positives, wherever they are, and as many masked negatives, drawn by hash order."""
    positives = df.filter(F.col(label) == 1)
    want = positives.agg(F.count("*").alias("__want"))
    return positives.unionByName(exact_sample(df.filter((F.col(label) == 0) & (F.col(mask) == 1)), hash_order(seed, *keys), want))


def balance_both(df: DataFrame, keys: Sequence[str], seed: str = "1", label: str = "label", mask: str = "mask") -> DataFrame:
    """Of masked rows as many positives as negatives: the larger class shrinks."""
    masked = df.filter(F.col(mask) == 1)
    want = masked.agg(F.least(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).alias("__want"))
    parts = [exact_sample(masked.filter(F.col(label) == v), hash_order(seed, *keys), want) for v in (1, 0)]
    return parts[0].unionByName(parts[1])


def subject_kfold(subjects: DataFrame, k: int, repeats: int = 1, seed: str = "1") -> DataFrame:
    """subject, repeat, fold: subjects in hash order cut into k runs whose sizes differ by one at most, the longer ones first.

    Subjects are few against voxels; each repeat is ordered on its own.
    """
    reps = subjects.select("subject").distinct().withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    w = Window.partitionBy("repeat")
    order = F.md5(F.concat_ws("-", F.lit(seed), F.col("repeat").cast("string"), F.col("subject").cast("string")))
    placed = reps.withColumns({"__i": F.row_number().over(w.orderBy(order)) - 1, "__n": F.count("*").over(w)})
    base, extra = F.floor(F.col("__n") / k), F.col("__n") % k
    early = extra * (base + 1)
    fold = F.when(F.col("__i") < early, F.floor(F.col("__i") / (base + 1))).otherwise(extra + F.floor((F.col("__i") - early) / base))
    return placed.select("subject", "repeat", fold.cast("int").alias("fold"))


def leave_one_out(df: DataFrame, most: int, seed: str = "1") -> DataFrame:
    """subject, other: for each subject at most `most` other subjects to train on, the next ones on a ring in hash order.

    Subjects are ranked within the first 16 bits of their hash, after those of lower ones (at most 65,536 counts); places on
    the ring meet by equality, so no subject is compared with all others.
    """
    order = hash_order(seed, "subject")
    keyed = df.select("subject").distinct().withColumns({"__h": order, "__b": F.conv(F.substring(order, 1, 4), 16, 10).cast("int")})
    below = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("__b").agg(F.count("*").alias("__c"))
    offsets = counts.select("__b", F.coalesce(F.sum("__c").over(below), F.lit(0)).alias("__below"))
    ring = keyed.join(F.broadcast(offsets), "__b").select("subject", (F.col("__below") + F.row_number().over(Window.partitionBy("__b").orderBy("__h")) - 1).alias("__i"))
    sized = ring.join(F.broadcast(counts.agg(F.sum("__c").alias("__n"))))
    ahead = sized.withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(most)))).filter("__k < __n").withColumn("__j", (F.col("__i") + F.col("__k")) % F.col("__n"))
    return ahead.join(ring.select(F.col("__i").alias("__j"), F.col("subject").alias("other")), "__j").select("subject", "other")


def summary(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean, population deviation and median of each value."""
    return df.groupBy(*keys).agg(*[x for v in values for x in (F.avg(v).alias(f"{v}_mean"), F.stddev_pop(v).alias(f"{v}_std"), F.percentile(v, F.lit(0.5)).alias(f"{v}_median"))])


def confidence_band(df: DataFrame, keys: Sequence[str], value: str, least: float = 0.0) -> DataFrame:
    """Mean, and mean -/+ 1.96 deviations over the root of n, not under `least`; null without values."""
    s = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("__s"), F.count(value).alias("n"))
    half = 1.96 * F.try_divide("__s", F.sqrt("n"))
    return s.withColumns({"low": F.when(half.isNotNull(), F.greatest(F.col("mean") - half, F.lit(least))), "high": F.col("mean") + half}).drop("__s")


def pair_runs(runs: DataFrame, step: int, order: str = "rf", fold: str = "fold", model: str = "model", value: str = "roc_auc") -> DataFrame:
    """model, rf, fold, a, b: each run's value with that of the run `step` further, by fold."""
    other = runs.select(F.col(model), (F.col(order) - step).alias(order), F.col(fold), F.col(value).alias("b"))
    return runs.select(model, order, fold, F.col(value).alias("a")).join(other, [model, order, fold])
