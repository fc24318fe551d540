"""Runs are published whole or not at all."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from voxframe import carriers as C
from voxframe.operators import models as M
from voxframe.sources.runstore import RunStore
from voxframe.sources.shared import new_folder

SCHEMA = "model string, repeat int, fold int, v int"


def rows(df):
    return sorted(tuple(r) for r in df.select("model", "repeat", "fold", "v").collect())


def test_unpublished_and_repeated_folds(spark):
    store = RunStore(spark, new_folder(spark))
    table = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    assert store.parts() == set() and store.read("scores", SCHEMA).count() == 0
    with pytest.raises(ValueError):
        store.read()
    store.write(scores=table(("m", 0, 0, 1)), points=table(("m", 0, 0, 1)))  # killed between data and publication
    assert store.parts() == set() and store.read("scores", SCHEMA).count() == 0
    store.append([("m", 0, 0), ("m", 0, 1)], scores=table(("m", 0, 0, 2), ("m", 0, 1, 3), ("m", 0, 2, 9)), points=table(("m", 0, 0, 20), ("m", 0, 0, 21)))
    assert rows(store.read()) == [("m", 0, 0, 2), ("m", 0, 1, 3)]  # fold 2 was not named
    store.append([("n", 0, 0)], scores=table(("n", 0, 0, 4)))
    store.append([("m", 0, 0)], scores=table(("m", 0, 0, 5), ("m", 0, 0, 6)), points=table(("m", 0, 0, 22)))
    assert rows(store.read()) == [("m", 0, 0, 5), ("m", 0, 0, 6), ("m", 0, 1, 3), ("n", 0, 0, 4)]
    assert rows(store.read("points")) == [("m", 0, 0, 22)]
    assert RunStore(spark, store.folder + "/").parts() == {("m", 0, 0), ("m", 0, 1), ("n", 0, 0)}
    store.append([("m", 0, 1)], scores=table())  # a fold without rows replaces its rows too
    assert rows(store.read()) == [("m", 0, 0, 5), ("m", 0, 0, 6), ("n", 0, 0, 4)]


def test_cross_validation_keeps_params_and_weights(spark):
    folder, vox = new_folder(spark), C.vox(spark, "/root/testdata/sf0.001")
    scores, failed = M.cross_validate(vox, ("tmax",), M.Spec("m", M.logistic), 3, store=folder)
    store = RunStore(spark, folder)
    assert failed == 0 and scores.count() == vox.select("subject").distinct().count()
    assert {(r["fold"], tuple(r["radius"]), tuple(r["channels"])) for r in store.read("params").collect()} == {(f, (0, 0, 0), ("tmax",)) for f in range(3)}
    assert {len(r["weights"]) for r in store.read("models").collect()} == {2} and store.read("models").count() == 3
    again, _ = M.cross_validate(vox, ("tmax",), M.Spec("m", M.logistic), 3, store=folder)
    assert again.count() == scores.count() and store.read("models").select(F.count_distinct("fold")).first()[0] == 3
