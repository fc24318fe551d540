"""Plans of voxel work that must stay as they are when volumes and subjects grow."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_tiles import frame
from voxframe.operators import components as G
from voxframe.operators import reports as E
from voxframe.operators import spatial as P
from voxframe.sources import shared


@pytest.mark.parametrize("side", [2, 32])
@pytest.mark.parametrize("work", [lambda df, side: G.background_component(df, "m", side), lambda df, side: G.remove_small_objects(df, "m", 3, side), lambda df, side: G.label_regions(df, "m", side=side)])
def test_no_table_of_voxels_or_parts_is_broadcast(spark, monkeypatch, work, side):
    """Files of voxels are far smaller than their rows, so a broadcast that Spark chooses by size fills the driver."""
    plans = []

    def kept(df):
        out = shared.cut(df)
        plans.append(df)
        return out

    monkeypatch.setattr(G, "cut", kept)
    out = work(frame(spark, m=(np.random.default_rng(2).random((5, 4, 4)) > 0.4).astype(float)), side)
    assert out.count() > 0
    for df in [*plans, out]:
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("side", [3, 5, 32])
def test_smoothing_in_tiles_is_that_by_windows(spark, side):
    """Closing and opening with a halo, and regions across tiles, of several columns; rows that are missing and nulls are off."""
    rng = np.random.default_rng(side)
    a, b = (rng.random((11, 8, 7)) > 0.25).astype(float), (rng.random((11, 8, 7)) > 0.5).astype(float)
    b[3:8, 2:6, 1:5], b[5, 5, 5], b[0, 0, 0] = 1, np.nan, np.nan
    df = frame(spark, a=a, b=b).filter("(x * 5 + y * 3 + z + subject) % 23 <> 0").withColumns({c: F.col(c).cast("int") for c in "ab"})
    for least in (1, 12):
        got = {(r["name"], r["subject"], r["x"], r["y"], r["z"], r["b"]) for r in G.smoothed_regions(df, ("a", "b"), least, ("b",), side).collect()}
        want, given = set(), {(r["subject"], r["x"], r["y"], r["z"]): r["b"] for r in df.collect()}
        for c in "ab":
            old = G.remove_small_objects(P.opening(P.closing(df.select("subject", "x", "y", "z", c), c), c), c, least)
            keys = [(r["subject"], r["x"], r["y"], r["z"]) for r in old.filter(f"{c} = 1").collect()]
            want |= {(c, *k, given[k]) for k in keys}
        assert got == want and {x[0] for x in got} == {"a", "b"}
        masks = E.smooth_masks(df, ("a", "b"), least).collect()
        assert len(masks) == len(given) and {(c, r["subject"], r["x"], r["y"], r["z"]) for r in masks for c in "ab" if r[c] == 1} == {x[:5] for x in want}
        assert {r[c] for r in masks for c in "ab"} == {0, 1}


def test_masks_are_shuffled_once_to_be_smoothed(spark, monkeypatch):
    """All columns of a voxel go together, once; they went by name and through a shuffle for each axis of each step."""
    plans = []
    monkeypatch.setattr(G, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or shared.cut(df))
    df = frame(spark, a=np.ones((7, 7, 7)), b=np.zeros((7, 7, 7)))
    assert E.smooth_masks(df, ("a", "b"), 2).filter("a = 1").count() > 0
    assert plans[0].count("Exchange") == 1 and "Window" not in plans[0]
    assert G.smoothed_regions(df.filter("false"), ("a", "b"), 2).count() == G.smoothed_regions(df, ("b",), 2).count() == 0
