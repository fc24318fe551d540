"""Per-subject and pooled normalisation of channels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.functions.voxel import side
from voxframe.operators.quantiles import exact_quantiles, exact_quantiles_of

KEY = "subject"
CLIP = (0.01, 0.99)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.when(b != 0, a / b)


def clipped_mean(c: str, low: Column, high: Column) -> Column:
    return F.avg(F.greatest(F.least(F.col(c), high), low))


def rescale_outliers(df: DataFrame, channels: Sequence[str], factor: float = 5.0, divisor: float = 10.0) -> DataFrame:
    """A channel is divided by 10 in the subjects whose masked median is over 5 times the pooled masked median, all medians taken from the input."""
    masked = df.filter("mask = 1")
    own = masked.groupBy(KEY).agg(*[F.percentile(c, F.lit(0.5)).alias(f"__own_{c}") for c in channels])
    pooled = {c: q[0] for c, q in exact_quantiles_of(masked, {c: [0.5] for c in channels}).items()}
    flags = own.select(KEY, *[(F.col(f"__own_{c}") > factor * F.lit(pooled[c]).cast("double")).alias(f"__out_{c}") for c in channels])
    fixed = {c: F.when(F.coalesce(F.col(f"__out_{c}"), F.lit(False)), F.col(c) / divisor).otherwise(F.col(c)) for c in channels}
    return df.join(flags, KEY, "left").withColumns(fixed).drop(*[f"__out_{c}" for c in channels])


def standardise(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Zero mean and unit population deviation over all rows; constant channels become 0."""
    stats = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in channels], *[F.stddev_pop(c).alias(f"__s_{c}") for c in channels])
    scaled = {c: F.when(F.col(f"__s_{c}") > 0, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).otherwise(0.0) for c in channels}
    return df.join(F.broadcast(stats)).withColumns(scaled).drop(*[f"__{k}_{c}" for c in channels for k in "ms"])


def contralateral_means(df: DataFrame, c: str, nx: int) -> DataFrame:
    """subject, side, mean: the masked values' mean in each half after clipping to the half's 1st to 99th percentile."""
    halves = df.filter("mask = 1").withColumn("side", side(nx))
    bounds = halves.groupBy(KEY, "side").agg(F.percentile(c, F.array(*map(F.lit, CLIP))).alias("b"))
    return halves.join(bounds, [KEY, "side"]).groupBy(KEY, "side").agg(clipped_mean(c, F.col("b")[0], F.col("b")[1]).alias("mean"))


def contralateral_norm(df: DataFrame, c: str, nx: int, out: str = "normalised") -> DataFrame:
    """Each half divided by the opposite half's clipped mean; 0 outside the mask, null without a usable mean."""
    other = contralateral_means(df, c, nx).select(KEY, (1 - F.col("side")).alias("side"), "mean")
    joined = df.withColumn("side", side(nx)).join(other, [KEY, "side"], "left")
    return joined.withColumn(out, F.when(F.col("mask") == 1, ratio(F.col(c), F.col("mean"))).otherwise(0.0)).drop("side", "mean")


def healthy_norm(df: DataFrame, c: str, out: str = "normalised", by: str = "tmax", limit: float = 4.0) -> DataFrame:
    """Divided by the median of the masked voxels with Tmax under the limit, clipped to their 1st to 99th percentile first."""
    healthy = df.filter((F.col("mask") == 1) & (F.col(by) < limit))
    bounds = healthy.groupBy(KEY).agg(F.percentile(c, F.array(*map(F.lit, CLIP))).alias("b"))
    clipped = healthy.join(bounds, KEY).withColumn("__v", F.greatest(F.least(F.col(c), F.col("b")[1]), F.col("b")[0]))
    medians = clipped.groupBy(KEY).agg(F.percentile("__v", F.lit(0.5)).alias("__median"))
    return df.join(medians, KEY, "left").withColumn(out, F.when(F.col("mask") == 1, ratio(F.col(c), F.col("__median"))).otherwise(0.0)).drop("__median")


def minmax_norm(df: DataFrame, c: str, out: str = "normalised", clip: tuple[float, float] | None = (0.001, 0.999), flip: bool = False) -> DataFrame:
    """Per subject to [0, 1] over the dense grid, where zeros outside the mask count; constant volumes become 0."""
    value = F.when(F.col("mask") == 1, F.col(c)).otherwise(0.0) * (-1 if flip else 1)
    v = df.withColumn("__v", value)
    if clip:
        bounds = v.groupBy(KEY).agg(F.percentile("__v", F.array(*map(F.lit, clip))).alias("__b"))
    else:
        bounds = v.groupBy(KEY).agg(F.array(F.min("__v"), F.max("__v")).alias("__b"))
    low, high = F.col("__b")[0], F.col("__b")[1]
    scaled = (F.greatest(F.least(F.col("__v"), high), low) - low) / (high - low)
    return v.join(bounds, KEY).withColumn(out, F.when(high > low, scaled).otherwise(0.0)).drop("__v", "__b")


def penumbra(df: DataFrame, c: str = "tmax", low: float = 6.0, quantile: float = 0.99) -> DataFrame:
    """`penumbra`: 1 above `low` and below the 99th percentile of all rows pooled."""
    top = exact_quantiles(df, c, [quantile])[0]
    return df.withColumn("penumbra", F.when((F.col(c) > low) & (F.col(c) < F.lit(top).cast("double")), 1).otherwise(0))


def csf_threshold(df: DataFrame, c: str, low: float = 0.0, high: float = 40.0, width: float = 1.96) -> DataFrame:
    """`csf`: 1 for values in (low, high) under the subject's mean minus 1.96 population deviations of such values; and `csf_limit`."""
    inside = df.filter((F.col(c) > low) & (F.col(c) < high))
    limits = inside.groupBy(KEY).agg((F.avg(c) - width * F.stddev_pop(c)).alias("csf_limit"))
    return df.join(limits, KEY, "left").withColumn("csf", F.when((F.col(c) > low) & (F.col(c) < F.col("csf_limit")), 1).otherwise(0))


def intensity_filter(df: DataFrame, a: str, b: str, out: str, least: float = 0.05) -> DataFrame:
    """Product of two images: at most 0 becomes 0, clipped at the 99th percentile of the positive values, scaled to [0, 1], at most 0.05 becomes 0."""
    product = df.withColumn("__p", F.greatest(F.col(a) * F.col(b), F.lit(0.0)))
    top = product.filter("__p > 0").groupBy(KEY).agg(F.percentile("__p", F.lit(0.99)).alias("__top"))
    clipped = product.join(top, KEY, "left").withColumn("__c", F.least(F.col("__p"), F.coalesce("__top", F.lit(0.0))))
    bounds = clipped.groupBy(KEY).agg(F.min("__c").alias("__lo"), F.max("__c").alias("__hi"))
    scaled = clipped.join(bounds, KEY).withColumn("__s", F.when(F.col("__hi") > F.col("__lo"), (F.col("__c") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(0.0))
    return scaled.withColumn(out, F.when(F.col("__s") > least, F.col("__s")).otherwise(0.0)).drop("__p", "__top", "__c", "__lo", "__hi", "__s")


def mirror_ratio(df: DataFrame, channels: Sequence[str], nx: int) -> DataFrame:
    """Each voxel divided by the voxel at nx-1-x; of odd widths the middle plane is divided by the mean of its two neighbours."""
    place = [KEY, "y", "z"]
    other = df.select(*place, (nx - 1 - F.col("x")).alias("x"), *[F.col(c).alias(f"__o_{c}") for c in channels])
    joined = df.join(other, [*place, "x"], "left")
    if nx % 2:
        middle = nx // 2
        beside = df.filter(F.col("x").isin(middle - 1, middle + 1)).groupBy(*place).agg(*[F.avg(c).alias(f"__b_{c}") for c in channels]).withColumn("x", F.lit(middle))
        joined = joined.join(beside, [*place, "x"], "left").withColumns({f"__o_{c}": F.when(F.col("x") == middle, F.col(f"__b_{c}")).otherwise(F.col(f"__o_{c}")) for c in channels})
    return joined.withColumns({c: ratio(F.col(c), F.col(f"__o_{c}")) for c in channels}).drop(*[f"__{k}_{c}" for c in channels for k in "ob"])


def correlation(a: str, b: str) -> Column:
    """Pearson's r as an aggregate; null for fewer than two values or a constant side."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def channel_correlation(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """a, b, r of every pair of columns, pooled over all rows in one pass."""
    pairs = [(a, b) for a in names for b in names]
    wide = df.agg(*[correlation(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("r")) for a, b in pairs])).alias("p")).select("p.a", "p.b", "p.r")


def voxelwise_correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the mean over grid positions of the correlation across subjects, and the positions that have one."""
    r = df.groupBy("x", "y", "z").agg(correlation(a, b).alias("r"))
    return r.agg(F.avg("r").alias("mean_r"), F.count("r").alias("positions"))
