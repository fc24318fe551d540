"""Tiles, regions across tiles and distances, against plain versions on arrays."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.operators import components as G
from voxframe.operators import spatial as P
from voxframe.operators import tiles as T


def frame(spark, **volumes):
    """Rows of volumes of the same shape, for subjects 0 and 1; the second one's are mirrored along x."""
    names = list(volumes)
    shape = next(iter(volumes.values())).shape
    rows = []
    for subject in (0, 1):
        own = [v if subject == 0 else v[::-1] for v in volumes.values()]
        rows += [(subject, *map(int, at), *[None if np.isnan(v[at]) else float(v[at]) for v in own]) for at in np.ndindex(*shape)]
    return spark.createDataFrame(rows, "subject long, x int, y int, z int, " + ", ".join(f"{n} double" for n in names))


@pytest.mark.parametrize(("r", "side"), [((3, 3, 3), 4), ((1, 2, 0), 3), ((0, 0, 0), 16), ((3, 3, 3), None)])
def test_fields_of_any_radius_are_those_of_the_whole_grid(spark, r, side):
    rng = np.random.default_rng(1)
    shape = (9, 7, 5)
    v, w, mask, want = rng.random(shape), rng.random(shape) * 9, (rng.random(shape) > 0.3).astype(float), (rng.random(shape) > 0.6).astype(float)
    v[2, 3, 1] = np.nan
    df = frame(spark, v=v, w=w, mask=mask, chosen=want)
    got = P.receptive_field(df, ("v", "w"), r, "chosen", "mask", side).collect()
    assert len(got) == 2 * want.sum()
    pads = [(k, k) for k in r]
    for row in got:
        at = (row["x"], row["y"], row["z"])
        box = tuple(slice(a, a + 2 * k + 1) for a, k in zip(at, r, strict=True))
        flip = (lambda a: a[::-1]) if row["subject"] else (lambda a: a)
        field = np.concatenate([np.pad(np.nan_to_num(flip(c)), pads)[box].ravel() for c in (v, w)])
        assert flip(want)[at] == 1 and np.array_equal(row["features"], field) and row["undefined"] == (np.pad(flip(mask), pads)[box] == 0).sum()


def test_a_field_is_shuffled_no_more_often_than_its_halo(spark):
    df = frame(spark, v=np.zeros((16, 8, 8)))
    assert T.with_halo(df, (1, 1, 0), 8).count() <= 2 * 16 * 8 * 8 * (10 / 8) ** 2
    assert P.receptive_field(df.filter("false"), ("v",), (1, 1, 1)).count() == 0


def plain_regions(values: np.ndarray, on: np.ndarray, offsets) -> dict:
    """The smallest voxel of each voxel's region, by flood fill."""
    out: dict = {}
    moves = [tuple(s * k for k in o) for o in offsets for s in (1, -1)]
    for start in map(tuple, np.argwhere(on)):
        if start in out:
            continue
        out[start], todo = start, [start]
        while todo:
            at = todo.pop()
            for m in moves:
                to = tuple(a + k for a, k in zip(at, m, strict=True))
                if all(0 <= a < n for a, n in zip(to, on.shape, strict=True)) and on[to] and to not in out and values[to] == values[at]:
                    out[to] = start
                    todo.append(to)
    return out


@pytest.mark.parametrize("side", [2, 3, 5, 32])
@pytest.mark.parametrize("offsets", [G.SIX, G.TWENTY_SIX])
def test_regions_across_tiles(spark, side, offsets):
    rng = np.random.default_rng(side)
    values = np.floor(rng.random((9, 6, 5)) * 2.3)
    df = frame(spark, v=values).filter("subject = 0 AND v < 2")
    got = {(r["x"], r["y"], r["z"]): tuple(r["region"]) for r in G.label_regions(df, "v", offsets, side).collect()}
    assert got == plain_regions(values, values < 2, offsets)
    ones = {(r["x"], r["y"], r["z"]): tuple(r["region"]) for r in G.label_regions(df.filter("v = 1"), None, offsets, side).collect()}
    assert ones == plain_regions(values, values == 1, offsets)


def test_small_objects_and_background_across_tiles(spark):
    rng = np.random.default_rng(9)
    values = (rng.random((8, 7, 6)) > 0.6).astype(float)
    values[0, 0, 0] = 0
    df = frame(spark, m=values)
    for side in (3, 32):
        got = G.remove_small_objects(df, "m", 4, side)
        regions = plain_regions(values, values == 1, G.SIX)
        sizes = {k: list(regions.values()).count(k) for k in regions.values()}
        want = {at for at, k in regions.items() if sizes[k] >= 4}
        assert {(r["x"], r["y"], r["z"]) for r in got.filter("subject = 0 AND m = 1").collect()} == want and got.count() == 2 * values.size
        back = G.background_component(df, "m", side).filter("subject = 0").collect()
        assert {(r["x"], r["y"], r["z"]) for r in back} == {at for at, k in plain_regions(values, values == 0, G.TWENTY_SIX).items() if k == (0, 0, 0)}


def test_null_values_are_alike_and_null_masks_are_off(spark):
    values = np.array([[[np.nan, np.nan, 1.0, 1.0, np.nan]]])
    df = frame(spark, v=values).filter("subject = 0")
    assert [tuple(r["region"])[2] for r in G.label_regions(df, "v", side=2).orderBy("z").collect()] == [0, 0, 2, 2, 4]
    assert [r["v"] for r in G.remove_small_objects(df, "v", 2, 2).orderBy("z").collect()] == [0, 0, 1, 1, 0]
    assert G.label_regions(df.filter("false")).count() == 0


def test_one_region_of_many_tiles(spark):
    """A volume of 48^3 voxels in one region: each part is a tile, all links meet in one small group."""
    n = 48
    df = spark.range(n**3).selectExpr("0L AS subject", f"cast(id div {n * n} AS int) AS x", f"cast(id div {n} % {n} AS int) AS y", f"cast(id % {n} AS int) AS z", "1 AS m")
    parts, joined = G._parts(df, "m", None, G.SIX, 16)
    assert joined.count() == 27 and parts.groupBy("root").count().agg(F.max("count")).first()[0] == 16**3
    assert G.remove_small_objects(df, "m", n**3, 16).filter("m = 1").count() == n**3
    assert G.remove_small_objects(df, "m", n**3 + 1, 16).filter("m = 1").count() == 0


def test_envelopes_of_many_lines():
    rng = np.random.default_rng(3)
    f = np.where(rng.random((300, 17)) > 0.6, rng.integers(0, 90, (300, 17)).astype(float), np.inf)
    f[0] = np.inf
    p = np.arange(17)
    assert np.array_equal(T.lower_envelope(f), (f[:, None, :] + (p[:, None] - p[None, :]) ** 2).min(axis=2))


@pytest.mark.parametrize("side", [1, 3, 8])
def test_distances_in_slabs(spark, side):
    rng = np.random.default_rng(4)
    a, b = (rng.random((7, 6, 5)) > 0.9).astype(float), (rng.random((7, 6, 5)) > 0.95).astype(float)
    got = T.squared_distances(frame(spark, a=a, b=b), {"da": "a", "db": "b"}, side).filter("subject = 0").collect()
    assert len(got) == a.size
    for r in got:
        for v, d in ((a, r["da"]), (b, r["db"])):
            assert d == ((np.argwhere(v == 1) - (r["x"], r["y"], r["z"])) ** 2).sum(axis=1).min()
