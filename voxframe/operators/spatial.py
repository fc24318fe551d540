"""Neighbourhoods on the grid: stencils, smoothing, morphology, receptive fields, distances.

Volumes are dense grids, one row per voxel. A pass along one axis works in lines of the grid (subject and the two other
axes), so its groups have the length of a grid side whatever the number of subjects.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.operators.tiles import KEY, receptive_field, squared_distances  # noqa: F401


def line(axis: str) -> Window:
    return Window.partitionBy("subject", *[a for a in "xyz" if a != axis]).orderBy(axis)


def axis_weights(n: int, weights: Sequence[float], border: str) -> list[dict[int, float]]:
    """For each place of an axis of length n the weights of its neighbours by offset: `reflect` mirrors at the edge (edge repeated), `zero` and `drop` leave outside places out."""
    r = len(weights) // 2
    out: list[dict[int, float]] = []
    for at in range(n):
        row: dict[int, float] = {}
        for k, w in enumerate(weights):
            src = at + k - r
            if border == "reflect":
                period = src % (2 * n)
                src = period if period < n else 2 * n - 1 - period
            elif not 0 <= src < n:
                continue
            row[src - at] = row.get(src - at, 0.0) + w
        out.append(row)
    return out


def stencil(df: DataFrame, values: Sequence[str], axis: str, n: int, weights: Sequence[float], border: str = "reflect") -> DataFrame:
    """Weighted sums along an axis of a dense grid: a window over each line, so every voxel is shuffled once. Only places near an end have weights of their own."""
    rows = axis_weights(n, weights, border)
    inner = dict(zip(range(-(len(weights) // 2), len(weights) // 2 + 1), weights, strict=True))
    offsets = sorted({o for row in rows for o in row})
    w = line(axis)
    lags = {(v, o): F.col(v) if o == 0 else F.lag(v, -o).over(w) for v in values for o in offsets}
    wide = df.select(*KEY, *[c.alias(f"__{v}_{o}") for (v, o), c in lags.items()])

    def total(v: str, row: dict[int, float]) -> Column:
        return reduce(lambda a, b: a + b, [F.col(f"__{v}_{o}") * F.lit(x) for o, x in sorted(row.items())])

    def value(v: str) -> Column:
        ends = [k for k, row in enumerate(rows) if row != inner]
        out = None
        for k in ends:
            out = (F if out is None else out).when(F.col(axis) == k, total(v, rows[k]))
        if len(ends) == n:
            return out
        return total(v, inner) if out is None else out.otherwise(total(v, inner))

    return wide.select(*KEY, *[value(v).alias(v) for v in values])


def gaussian_weights(width: int) -> list[float]:
    """Normalised weights of a kernel of odd width k: deviation k/3, radius (k-1)/2."""
    sigma, r = width / 3, (width - 1) // 2
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return [w / sum(raw) for w in raw]


def gaussian_smooth(df: DataFrame, values: Sequence[str], shape: tuple[int, int, int], width: int, axes: str = "xy") -> DataFrame:
    """Separable Gaussian smoothing, in each z plane (xy) or the volume (xyz), mirrored at the edges."""
    for axis in axes:
        df = stencil(df, values, axis, shape["xyz".index(axis)], gaussian_weights(width))
    return df


def box_extreme(df: DataFrame, c: str, size: int, largest: bool, axes: str = "xyz") -> DataFrame:
    """Dilation (largest) or erosion of a 0/1 column with a box of the given size; outside counts as 0.

    Erosion looks from -size//2 to size-1-size//2, dilation the mirrored way, which differ for even sizes.
    """
    low, high = -(size // 2), size - 1 - size // 2
    if largest:
        low, high = -high, -low
    for axis in axes:
        w = line(axis).rangeBetween(low, high)
        value = F.max(c).over(w) if largest else F.when(F.count(c).over(w) < size, 0).otherwise(F.min(c).over(w))
        df = df.withColumn(c, value)
    return df


def ball_extreme(df: DataFrame, c: str, largest: bool) -> DataFrame:
    """Dilation or erosion with a voxel and its six neighbours; outside counts as 0."""
    frames = [line(a).rangeBetween(-1, 1) for a in "xyz"]
    if largest:
        return df.withColumn(c, F.greatest(*[F.max(c).over(w) for w in frames]))
    return df.withColumn(c, F.least(*[F.when(F.count(c).over(w) < 3, 0).otherwise(F.min(c).over(w)) for w in frames]))


def dilate(df: DataFrame, c: str, size: int = 0) -> DataFrame:
    return box_extreme(df, c, size, True) if size else ball_extreme(df, c, True)


def erode(df: DataFrame, c: str, size: int = 0) -> DataFrame:
    return box_extreme(df, c, size, False) if size else ball_extreme(df, c, False)


def closing(df: DataFrame, c: str, size: int = 0) -> DataFrame:
    """Dilation, then erosion, with a box of the size or (0) the six-neighbour ball."""
    return erode(dilate(df, c, size), c, size)


def opening(df: DataFrame, c: str, size: int = 0) -> DataFrame:
    return dilate(erode(df, c, size), c, size)


def undefined_count(df: DataFrame, mask: str, r: tuple[int, int, int], out: str = "undefined") -> DataFrame:
    """Masked-out or outside voxels in each neighbourhood of radii r: its volume less a box sum in three passes."""
    df = df.withColumn(out, F.col(mask).cast("long"))
    for axis, k in zip("xyz", r, strict=True):
        df = df.withColumn(out, F.sum(out).over(line(axis).rangeBetween(-k, k)))
    return df.withColumn(out, F.lit(math.prod(2 * k + 1 for k in r)) - F.col(out))


def rolling_window(df: DataFrame, value: str, shape: tuple[int, int, int], size: tuple[int, int, int], stride: tuple[int, int, int] = (1, 1, 1), dilation: tuple[int, int, int] = (1, 1, 1)) -> DataFrame:
    """subject, x, y, z of a window's first voxel and `window`, its values in C order; only whole windows, every stride-th one.

    A size of 0 leaves an axis alone. size x dilation must fit into the shape.
    """
    sizes = tuple(s or 1 for s in size)
    if any((s - 1) * d >= n for s, d, n in zip(sizes, dilation, shape, strict=True)):
        raise ValueError("size x dilation does not fit")
    out = df.select(*KEY, F.array(F.col(value)).alias("window"))
    for axis, s, d in reversed(list(zip("xyz", sizes, dilation, strict=True))):
        w = line(axis)
        out = out.withColumn("window", F.concat(*[F.lead("window", k * d).over(w) for k in range(s)]))
    kept = F.col("window").isNotNull()
    for axis, st in zip("xyz", stride, strict=True):
        kept = kept & (F.col(axis) % st == 0)
    return out.filter(kept)


def region_mirror_ratio(df: DataFrame, c: str, shape: tuple[int, int, int], width: int = 5) -> DataFrame:
    """Each voxel divided by the smoothed opposite half's voxel at nx-1-x; halves are smoothed on their own. The middle plane of odd widths is divided by the mean of the planes beside it."""
    nx, ny, _ = shape
    half = nx // 2
    folded = df.filter((F.col("x") < half) | (F.col("x") >= nx - half)).withColumn("side", F.when(F.col("x") < half, 0).otherwise(1)).withColumn("hx", F.when(F.col("x") < half, F.col("x")).otherwise(F.col("x") - (nx - half)))
    tagged = folded.select(F.struct("subject", "side").alias("subject"), F.col("hx").alias("x"), "y", "z", F.col(c).alias("v"))
    smooth = gaussian_smooth(tagged, ("v",), (half, ny, shape[2]), width)
    back = smooth.select(F.col("subject.subject").alias("subject"), F.when(F.col("subject.side") == 0, F.col("x")).otherwise(F.col("x") + (nx - half)).alias("sx"), "y", "z", "v").withColumn("x", nx - 1 - F.col("sx")).drop("sx")
    if nx % 2:
        beside = df.filter(F.col("x").isin(half - 1, half + 1)).groupBy("subject", "y", "z").agg(F.avg(c).alias("v")).select("subject", "y", "z", "v", F.lit(half).alias("x"))
        back = back.unionByName(beside)
    return df.join(back, list(KEY), "left").withColumn("ratio", F.when(F.col("v") != 0, F.col(c) / F.col("v"))).drop("v")


def reconstruct_grid(df: DataFrame, values: Sequence[str], shape: tuple[int, int, int], subjects: DataFrame) -> DataFrame:
    """The dense grid of every subject, made from the shape: df's values where it has a row, 0 elsewhere."""
    places = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(a) for a, n in zip("xyz", shape, strict=True)]
    grid = subjects.select("subject").distinct()
    for place in places:
        grid = grid.select("*", place)
    return grid.join(df.select(*KEY, *values), list(KEY), "left").fillna(0.0, list(values))


def center_slices(df: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """The three middle planes, with the plane's axis."""
    planes = [df.filter(F.col(a) == (n - 1) // 2).withColumn("plane", F.lit(a)) for a, n in zip("xyz", shape, strict=True)]
    return planes[0].unionByName(planes[1]).unionByName(planes[2])


def squared_distance(df: DataFrame, c: str, out: str = "d2") -> DataFrame:
    """Squared distance to the subject's nearest voxel with c = 1, null if it has none."""
    return squared_distances(df, {out: c})


def hausdorff(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per subject the directed distance (largest from truth to prediction), the two mean nearest distances and their larger one; null if a side is empty. Both directions are measured in the same two shuffles."""
    both = squared_distances(df.select(*KEY, truth, predicted), {"to_p": predicted, "to_t": truth})
    at = lambda side, d: F.when((F.col(side) == 1) & F.col(d).isNotNull(), F.sqrt(F.col(d).cast("double")))
    sums = both.groupBy("subject").agg(F.max(at(truth, "to_p")).alias("hausdorff"), F.avg(at(truth, "to_p")).alias("mean_truth_to_predicted"), F.avg(at(predicted, "to_t")).alias("mean_predicted_to_truth"))
    return sums.withColumn("modified_hausdorff", F.when(F.col("mean_truth_to_predicted").isNotNull() & F.col("mean_predicted_to_truth").isNotNull(), F.greatest("mean_truth_to_predicted", "mean_predicted_to_truth")))


def align_channels(images: DataFrame, channels: Sequence[str]) -> DataFrame:
    """One row per key and a column per channel out of one row per key and channel (channel, value). A place that lacks a channel raises, as shapes then differ."""
    wide = images.groupBy(*KEY).pivot("channel", list(channels)).agg(F.first("value"))
    lacking = F.lit(False)
    for c in channels:
        lacking = lacking | F.col(c).isNull()
    first = channels[0]
    return wide.withColumn(first, F.when(lacking, F.raise_error(F.lit("shapes differ")).cast("double")).otherwise(F.col(first)))


def image_difference(a: DataFrame, b: DataFrame, c: str) -> DataFrame:
    """key, difference: a's channel less b's at the same place, 0 outside a's mask."""
    other = b.select(*KEY, F.col(c).alias("__other"))
    return a.join(other, list(KEY)).select(*KEY, F.when(F.col("mask") == 1, F.col(c) - F.col("__other")).otherwise(0.0).alias("difference"))


def mask_union(*masks: DataFrame) -> DataFrame:
    """Keys that are in any of the masks, each once."""
    out = masks[0].select(*KEY)
    for m in masks[1:]:
        out = out.unionByName(m.select(*KEY))
    return out.distinct()


def mask_intersection(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Keys that are in all of the masks, each once."""
    out = first.select(*KEY).distinct()
    for m in others:
        out = out.join(m.select(*KEY), list(KEY), "left_semi")
    return out
