"""Connected regions of voxels: found within tiles first, then joined across the tiles' faces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.operators.tiles import KEY, Offset, joined_regions, local_regions, smoothed_parts
from voxframe.sources.shared import cut

SIX = [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
TWENTY_SIX = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0)]
#: Side of a tile: a task holds at most so many voxels to the third power at once.
SIDE = 32


def _wide(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never broadcast: Spark goes by the size of files, and rows of voxels are many times larger in memory than there."""
    return df.hint("merge")


def _parts(df: DataFrame, value: str, linked: str | None, offsets: Sequence[Offset], side: int) -> tuple[DataFrame, DataFrame]:
    """Voxels with the root and size of their region's part in their tile, and subject, root, region of the parts that go on in other tiles; both written once."""
    parts = cut(local_regions(df, value, linked, offsets, side))
    return parts, _joined(parts, offsets, side)


def _joined(parts: DataFrame, offsets: Sequence[Offset], side: int) -> DataFrame:
    """subject, root, region of the parts that go on in other tiles, written once."""
    moves = F.array(*[F.struct(*[F.lit(k).alias(n) for k, n in zip(o, ("dx", "dy", "dz"), strict=True)]) for o in offsets])
    inside = parts.filter("root IS NOT NULL")
    edge = F.lit(False)
    for a, k in zip("xyz", range(3), strict=True):
        if any(o[k] for o in offsets):
            edge = edge | ((F.col(a) % side == 0) & (F.col(a) > 0)) | (F.col(a) % side == side - 1)
    faces = inside.filter(edge)
    moved = faces.withColumn("m", F.explode(moves)).select("subject", *[(F.col(a) + F.col(f"m.d{a}")).alias(a) for a in "xyz"], *[F.floor(F.col(a) / side).alias(f"t{a}") for a in "xyz"], F.col("v").alias("u"), F.col("root").alias("a"))
    out = F.lit(False)
    for a in "xyz":
        out = out | (F.floor(F.col(a) / side) != F.col(f"t{a}"))
    links = moved.filter(out).join(_wide(faces.select(*KEY, "v", F.col("root").alias("b"))), list(KEY)).filter(F.col("u").eqNullSafe(F.col("v"))).select("subject", "a", "b").distinct()
    return cut(joined_regions(links))


def _with_size(parts: DataFrame, joined: DataFrame, least: int) -> DataFrame:
    """parts with `large`: whether the region has so many voxels. Parts come with their sizes; only those that go on in other tiles are summed for regions and looked up by their voxels."""
    large = F.coalesce(F.col("n") >= least, F.lit(False))
    if joined.isEmpty():
        return parts.withColumn("large", large)
    first = (F.col("x") == F.col("root.x")) & (F.col("y") == F.col("root.y")) & (F.col("z") == F.col("root.z"))  # one voxel of each part
    sizes = parts.filter(first).select("subject", "root", "n").join(_wide(joined), ["subject", "root"])
    big = sizes.groupBy("subject", "region").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("subject", "region")
    kept = joined.join(_wide(big), ["subject", "region"], "left_semi").select("subject", "root", F.lit(True).alias("__kept"))
    return parts.join(_wide(kept), ["subject", "root"], "left").withColumn("large", large | F.coalesce("__kept", F.lit(False)))


def label_regions(df: DataFrame, value: str | None = None, offsets: Sequence[Offset] = SIX, side: int = SIDE) -> DataFrame:
    """df's subject, x, y, z and `region`: rows of a subject are linked if neighbours (and, with `value`, equal in it); a region is named after its smallest voxel (x, y, z in turn). Places count from 0.

    Each tile is labelled by itself; only links across tile faces, one for each pair of parts, go on to be joined, those of
    a volume together. The result maps parts to regions, so no region is a key of a shuffle, however large it is.
    """
    parts, joined = _parts(df.withColumn("__v", F.lit(0)) if value is None else df, value or "__v", None, offsets, side)
    if joined.isEmpty():
        return parts.select(*KEY, F.col("root").alias("region"))
    return parts.join(_wide(joined), ["subject", "root"], "left").select(*KEY, F.coalesce("region", "root").alias("region"))


def remove_small_objects(df: DataFrame, c: str, least: int, side: int = SIDE) -> DataFrame:
    """The 0/1 column c without its six-connected regions of fewer than `least` voxels; other columns than the key are left out."""
    on = df.select(*KEY, F.col(c).alias("__c")).withColumn("__on", F.col("__c") == 1)
    return _with_size(*_parts(on, "__c", "__on", SIX, side), least).select(*KEY, F.when(F.col("large"), 1).otherwise(0).alias(c))


def smoothed_regions(df: DataFrame, names: Sequence[str], least: int, carry: Sequence[str] = (), side: int = SIDE) -> DataFrame:
    """subject, name, x, y, z and the carried columns of the voxels where a 0/1 column is on, after closing and opening by the six-neighbour ball and without regions of fewer than `least` voxels."""
    parts = cut(smoothed_parts(df, names, carry, SIX, side))
    return _with_size(parts, _joined(parts, SIX, side), least).filter("large").select("subject.subject", "subject.name", "x", "y", "z", *carry)


def background_component(df: DataFrame, c: str, side: int = SIDE) -> DataFrame:
    """subject, x, y, z of the voxels of equal value that are 26-connected with voxel (0, 0, 0)."""
    parts, joined = _parts(df, c, None, TWENTY_SIX, side)
    corner = lambda n: (F.col(f"{n}.x") == 0) & (F.col(f"{n}.y") == 0) & (F.col(f"{n}.z") == 0)
    if joined.isEmpty():
        return parts.filter(corner("root")).select(*KEY)
    other = joined.filter(corner("region")).select("subject", "root", F.lit(True).alias("__joined"))
    return parts.join(_wide(other), ["subject", "root"], "left").filter(corner("root") | F.col("__joined")).select(*KEY)


def brain_mask(df: DataFrame, channels: tuple[str, ...], csf: str | None = None) -> DataFrame:
    """df with `brain` and `background`: background is where every channel's background component is; voxels of CSF over 0.5 (or without value) are no brain either."""
    images = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in channels])).alias("i")
    long = df.select("subject", "x", "y", "z", images).select(F.struct("subject", "i.channel").alias("subject"), "x", "y", "z", "i.v")
    flags = background_component(long, "v").select("subject.subject", "x", "y", "z")
    counted = flags.groupBy("subject", "x", "y", "z").agg(F.count("*").alias("__n"))
    out = df.join(counted, ["subject", "x", "y", "z"], "left").withColumn("background", F.when(F.coalesce("__n", F.lit(0)) == len(channels), 1).otherwise(0)).drop("__n")
    fluid = F.lit(False) if csf is None else F.coalesce(F.nanvl(csf, F.lit(1.0)), F.lit(1.0)) > 0.5
    return out.withColumn("brain", F.when((F.col("background") == 0) & ~fluid, 1).otherwise(0))
