"""Row-wise rules for voxel values."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LARGEST = sys.float_info.max


def nan_to_zero(c: Column) -> Column:
    """Null and NaN become 0, infinities the largest finite value of their sign."""
    finite = F.when(c == float("inf"), LARGEST).when(c == float("-inf"), -LARGEST).otherwise(c)
    return F.when(c.isNull() | F.isnan(c), 0.0).otherwise(finite)


def clamp_label(c: Column) -> Column:
    """Labels above 1 become 1, missing ones 0."""
    return F.least(nan_to_zero(c.cast("double")), F.lit(1.0)).cast("int")


def threshold_mask(c: Column, threshold: float, inverse: bool = False) -> Column:
    """1 where the value is above the threshold; with inverse, where the negated value is above the negated threshold."""
    return F.when(-c > -threshold if inverse else c > threshold, 1).otherwise(0)


def apply_mask(c: Column, mask: Column) -> Column:
    return F.when(mask.cast("boolean"), c).otherwise(F.lit(0.0))


def window_intensity(c: Column, low: float, high: float) -> Column:
    """Values outside [low, high] become 0."""
    return F.when(c.between(low, high), c).otherwise(F.lit(0.0))


def volume_mm3(voxels: Column, voxel_mm3: float = 8.0) -> Column:
    return voxels * F.lit(voxel_mm3)


def volume_ml(voxels: Column, voxel_mm3: float = 8.0) -> Column:
    return voxels * F.lit(voxel_mm3) * F.lit(0.001)


def binarize(df: DataFrame, c: str, threshold: float, fraction_of_max: bool = True, key: str = "subject") -> DataFrame:
    """`binary`: 1 above the threshold, absolute or a fraction of the volume's maximum; volumes of 0 and 1 stay as they are."""
    stats = df.groupBy(key).agg(F.max(c).alias("__max"), F.bool_and(F.col(c).isin(0.0, 1.0)).alias("__is_binary"))
    cut = F.col("__max") * threshold if fraction_of_max else F.lit(threshold)
    return df.join(stats, key).withColumn("binary", F.when(F.col("__is_binary"), F.col(c).cast("int")).otherwise(F.when(F.col(c) > cut, 1).otherwise(0))).drop("__max", "__is_binary")


def stretch_intensity(df: DataFrame, c: str, key: str = "subject", low: float = -100.0, high: float = 100.0, factor: float = 10.0, floor: float = -1024.0, least_range: float = 1999.0, most_min: float = -500.0) -> DataFrame:
    """`stretched`: raw scanner units with the band [low, high] widened.

    Values are floored, the part of the band below a value counts factor times, and the volume is moved to a minimum of 0.
    Volumes with a range under least_range or a minimum above most_min have other units: they are only moved to 0.
    """
    stats = df.groupBy(key).agg(F.min(c).alias("__min"), F.max(c).alias("__max"))
    value = F.greatest(F.col(c), F.lit(floor))
    inside = lambda v: F.greatest(F.lit(0.0), F.least(v, F.lit(high)) - low)
    moved = lambda v: v - F.lit(floor) + (factor - 1) * inside(v)
    skip = (F.col("__max") - F.col("__min") < least_range) | (F.col("__min") > most_min)
    return df.join(stats, key).withColumn("stretched", F.when(skip, F.col(c) - F.col("__min")).otherwise(moved(value) - moved(F.greatest(F.col("__min"), F.lit(floor))))).drop("__min", "__max")


def border(nx: int, ny: int, nz: int, k: int) -> Column:
    """Whether a voxel lies in the outer k layers of the grid."""
    edge = F.lit(False)
    for axis, n in (("x", nx), ("y", ny), ("z", nz)):
        edge = edge | (F.col(axis) < k) | (F.col(axis) >= n - k)
    return edge


def side(nx: int) -> Column:
    """0 for the low half of x, 1 for the high half; the middle plane of odd widths belongs to the high half."""
    return F.when(F.col("x") < nx // 2, 0).otherwise(1)


def opposite_side(x_of_point: Column, nx: int) -> Column:
    """Whether a voxel lies in the half opposite a point: the low half if the point's x is above nx // 2, otherwise the high half."""
    return F.when(x_of_point > nx // 2, F.col("x") < nx // 2).otherwise(F.col("x") >= nx // 2)


def pad_grid(df: DataFrame, values: Sequence[str], key: str = "subject") -> DataFrame:
    """Volumes moved up in z to the deepest volume's depth, with zero planes below: every volume ends at the same z.

    The filled planes are made from each volume's own extents, so work follows the output.
    """
    extents = df.groupBy(key).agg(F.max("x").alias("mx"), F.max("y").alias("my"), F.max("z").alias("mz"))
    deepest = extents.agg(F.max("mz").alias("deepest"))
    shifts = extents.join(F.broadcast(deepest)).withColumn("shift", F.col("deepest") - F.col("mz"))
    moved = df.join(shifts.select(key, "shift"), key).withColumn("z", F.col("z") + F.col("shift"))
    planes = shifts.filter("shift > 0").withColumn("z", F.explode(F.sequence(F.lit(0), (F.col("shift") - 1).cast("int"))))
    rows = planes.withColumn("x", F.explode(F.sequence(F.lit(0), "mx"))).withColumn("y", F.explode(F.sequence(F.lit(0), "my")))
    empty = rows.select(key, "x", "y", "z", *[F.lit(0.0).alias(v) for v in values])
    return moved.select(key, "x", "y", "z", *values).unionByName(empty)
