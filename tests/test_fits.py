"""Many fits at once against single ones."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe import carriers as C
from voxframe.operators import fits as B
from voxframe.operators import models as M

DIR = "/root/testdata/sf0.001"
CHANNELS = ("tmax", "cbf", "mtt")


@pytest.fixture(scope="module")
def vox(spark):
    return C.vox(spark, DIR).cache()


@pytest.fixture(scope="module")
def sets(spark, vox):
    folds = M.T.subject_kfold(vox, 3, 2)
    models = spark.createDataFrame([(3 * r + f, r, f) for r in range(2) for f in range(3)], "model int, repeat int, fold int")
    return folds.withColumnRenamed("fold", "own").join(models, "repeat").filter("own <> fold").select("model", "subject").cache()


def test_members_are_the_rows_of_single_samples(vox, sets):
    few = vox.withColumn("mask", F.when(F.col("subject") > 1, F.col("mask")).otherwise(F.when(F.col("x") == 0, 1).otherwise(0)))  # model sets with fewer negatives than positives, too
    for df in (vox, few):
        rows = B.members(df, sets, B.balanced_limits(df, sets, M.KEY), M.KEY).select(*M.KEY, F.explode("models").alias("m")).collect()
        for m in range(6):
            want = M.T.undersample_negatives(df.join(sets.filter(F.col("model") == m), "subject", "left_semi"), M.KEY)
            assert {tuple(r[:4]) for r in rows if r["m"] == m} == {tuple(r) for r in want.select(*M.KEY).collect()}


def test_weights_are_those_of_single_fits(vox, sets, monkeypatch):
    rows = B.members(vox, sets, B.balanced_limits(vox, sets, M.KEY), M.KEY)
    f = M.features(rows.withColumn("w", F.when(F.size("models") > 0, 1)), CHANNELS, (1, 0, 0), wanted="w", keep=("models",)).cache()
    weights, fitted = B.fit_logistics(f, 7, 10)
    assert fitted.tolist() == [True] * 6 + [False]
    exact = M.Spec("m", lambda n: M.logistic(n).setParams(tol=1e-14, maxIter=2000))
    for m in (0, 4):
        model = M.fit(f.filter(F.array_contains("models", m)), exact).stages[-1]
        assert np.allclose(weights[m], [*model.coefficients.toArray(), model.intercept], atol=1e-6)
    monkeypatch.setattr(B, "MATRIX_BYTES", 8 * 11 * 11 * 2)  # one model after the other
    assert np.allclose(B.fit_logistics(f, 7, 10)[0], weights, atol=1e-9)


def test_folds_at_once_score_like_folds_in_turn(vox):
    at_once, failed = M.cross_validate(vox, CHANNELS, M.Spec("m", M.logistic, (1, 1, 0)), 3)
    in_turn, _ = M.cross_validate(vox, CHANNELS, M.Spec("m", lambda n: M.logistic(n).setParams(tol=1e-13, maxIter=1000), (1, 1, 0)), 3)
    a, b = (df.orderBy("subject").toPandas()[sorted(df.columns)] for df in (at_once, in_turn))
    assert failed == 0 and list(a.columns) == list(b.columns) and len(a) == 5
    assert (a.model == b.model).all() and np.allclose(a.drop(columns="model").fillna(-1).astype(float), b.drop(columns="model").fillna(-1).astype(float))


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_folds_fail_alone_and_restarts_add_what_is_missing(spark, vox):
    from voxframe.sources.shared import new_folder

    lone = vox.withColumn("label", F.when(F.col("subject") == 0, F.col("label")).otherwise(0))  # without subject 0 no positives
    store = new_folder(spark)
    scores, failed = M.cross_validate(lone, ("tmax",), M.Spec("m", M.logistic), 5, store=store)
    assert failed == 1 and sorted(r["subject"] for r in scores.select("subject").collect()) == [1, 2, 3, 4]
    again, failed = M.cross_validate(vox, ("tmax",), M.Spec("m", M.logistic), 5, store=store)
    assert failed == 0 and sorted(r["subject"] for r in again.select("subject").collect()) == [0, 1, 2, 3, 4]
    none, failed = M.cross_validate(vox.withColumn("label", F.lit(0)), ("tmax",), M.Spec("m", M.logistic), 2)
    assert failed == 2 and none.count() == 0


def test_left_out_subjects_without_a_model_have_no_score(vox):
    lone = vox.withColumn("label", F.when(F.col("subject") == 0, F.col("label")).otherwise(0))
    got = {r["subject"]: r["n"] for r in M.leave_one_out(lone, ("tmax",), M.Spec("m", M.logistic)).groupBy("subject").agg(F.count("score").alias("n")).collect()}
    assert got[0] == 0 and all(got[k] == 300 for k in range(1, 5))
    with pytest.raises(ValueError, match="logistic"):
        M.leave_one_out(vox, ("tmax",), M.Spec("b", M.boosted()))


def test_jobs_do_not_grow_with_folds(spark, vox):
    few, many = (jobs(spark, f"folds{k}", lambda k=k: M.cross_validate(vox, ("tmax", "cbf"), M.Spec("m", M.logistic), k)) for k in (2, 5))
    assert many <= few * 1.35
