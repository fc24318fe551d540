"""Model runs: fits against plain ones, failing folds, restarts, subgroups and searches."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe import carriers as C
from voxframe.operators import models as M
from voxframe.operators import reports as E
from voxframe.sources.shared import new_folder

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vox(spark):
    return C.vox(spark, DIR).cache()


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_logistic_against_a_plain_fit(spark, vox):
    f = M.features(vox, ("tmax", "cbf"), (0, 0, 0))
    train = M.T.undersample_negatives(f.filter("subject % 2 = 0"), M.KEY)
    model = M.fit(train, M.Spec("logistic", M.logistic)).stages[-1]
    part = train.toPandas()
    x, y = np.column_stack((np.array(part.features.tolist()), np.ones(len(part)))), part.label.to_numpy()
    w, penalty = np.zeros(3), np.diag([1.0, 1.0, 0.0])  # unit weight on the summed loss, the intercept is free
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
    assert np.allclose([*model.coefficients.toArray(), model.intercept], w, atol=2e-3)


def test_scores_are_zero_outside_the_mask_and_saved_models_score_alike(spark, vox):
    f = M.features(vox, ("tmax",), (1, 1, 0))
    model = M.fit(f.filter("subject = 0"), M.Spec("rf", M.logistic, (1, 1, 0)))
    once, again = M.predict(model, f), M.save_and_predict(model, f, new_folder(spark))
    assert rows(once, *M.KEY, "score") == rows(again, *M.KEY, "score")
    assert once.filter("mask = 0 AND score <> 0").count() == 0 and once.filter("score > 0").count() > 0


def test_boosting_stops_early(spark, vox):
    f = M.features(vox, ("tmax", "cbf"), (0, 0, 0))
    assert M.fit(f.filter("mask = 1"), M.Spec("boosted", M.boosted(200))).stages[-1].getNumTrees < 200


def failing_after(n: int, calls: list):
    def make(rows: int):
        calls.append(rows)
        if len(calls) > n:
            raise RuntimeError("no more")
        return M.logistic(rows)

    return make


def test_failing_folds_are_counted_and_a_restart_runs_only_them(spark, vox):
    store, calls = new_folder(spark), []
    scores, failed = M.cross_validate(vox, ("tmax",), M.Spec("m", failing_after(2, calls)), 3, store=store)
    assert failed == 1 and {r["fold"] for r in scores.collect()} == {0, 1}
    calls = []
    scores, failed = M.cross_validate(vox, ("tmax",), M.Spec("m", failing_after(9, calls)), 3, store=store)
    assert failed == 0 and len(calls) == 1
    assert rows(scores, "subject") == [(i,) for i in range(5)]
    none, failed = M.cross_validate(vox, ("tmax",), M.Spec("m", failing_after(0, [])), 3)
    assert failed == 3 and none.count() == 0 and set(none.columns) == set(scores.columns)


def test_spark_errors_fail_a_fold_only(spark, vox):
    broken = vox.withColumn("tmax", F.when((F.col("subject") == 3) & (F.col("x") == 1), F.raise_error(F.lit("bad"))).otherwise(F.col("tmax")))
    spec = M.Spec("m", lambda n: M.logistic(n).setParams(labelCol="missing"))
    assert M.cross_validate(vox, ("tmax",), spec, 2)[1] == 2
    with pytest.raises(Exception, match="bad"):  # features are made before the folds
        M.cross_validate(broken, ("tmax",), M.Spec("m", M.logistic), 2)


def test_sweeps_and_subgroups_score_every_image(spark, vox):
    specs = [*M.radius_specs("a", M.logistic, (0, 1)), *M.kernel_specs("a", M.logistic, (3,), ("tmax",), (C.NX, C.NY, C.NZ))]
    assert rows(M.sweep(vox, ("tmax",), specs, 2).groupBy("model").count(), "model", "count") == [("a_k3", 5), ("a_rf0", 5), ("a_rf1", 5)]
    groups = vox.select("subject", F.when(F.col("subject") < 2, "small").otherwise("large").alias("grp")).distinct()
    for hold_out in (False, True):
        got = M.subgroup_runs(vox, groups, ("tmax",), M.Spec("m", M.logistic), 2, hold_out)
        assert rows(got, "grp", "subject") == [("large", 2), ("large", 3), ("large", 4), ("small", 0), ("small", 1)]


def test_leave_one_out_against_its_own_fits(spark, vox):
    spec = M.Spec("m", M.logistic)
    got = M.leave_one_out(vox, ("tmax", "cbf"), spec, most=3)
    assert got.count() == vox.count()
    f = M.features(vox, ("tmax", "cbf"), (0, 0, 0))
    others = M.T.leave_one_out(vox, 3).filter("subject = 2").select(F.col("other").alias("subject"))
    assert others.count() == 3
    exact = M.Spec("m", lambda n: M.logistic(n).setParams(tol=1e-13, maxIter=1000))
    want = M.predict(M.fit(M.T.undersample_negatives(f.join(others, "subject", "left_semi"), M.KEY), exact), f.filter("subject = 2"))
    a, b = rows(got.filter("subject = 2"), *M.KEY, "score"), rows(want, *M.KEY, "score")
    assert [r[:4] for r in a] == [r[:4] for r in b] and np.allclose([r[4] for r in a], [r[4] for r in b], atol=1e-6)


def test_a_search_goes_on_where_it_stopped(spark, vox):
    assert M.random_settings(M.TREE_RANGES, 3, 1)[:2] == M.random_settings(M.TREE_RANGES, 2, 1)
    store = new_folder(spark)
    quick = (M.Range("depth", (1, 2), True), M.Range("rate", (0.1, 0.5)), M.Range("subsample", (0.6, 1.0)), M.Range("rounds", (2, 4), True))
    M.param_search(vox, ("tmax",), 1, 2, store, ranges=quick)
    before = spark.read.parquet(store).count()
    got = M.param_search(vox, ("tmax",), 2, 2, store, ranges=quick).collect()
    assert {r["model"] for r in got} == {"draw0", "draw1"} and got[0]["median_auc"] >= got[1]["median_auc"] and spark.read.parquet(store).count() == 2 * before


def test_channel_importance_shares(spark, vox):
    f = M.features(vox.withColumn("noise", F.lit(1.0)), ("tmax", "noise"), (0, 0, 0))
    got = dict(rows(M.channel_importance(M.fit(f, M.Spec("b", M.boosted(5, early_stop=False))), spark, ("tmax", "noise"), 1), "channel", "share"))
    assert got == {"tmax": 1.0, "noise": 0.0}


def test_report_with_a_model_column(spark, vox):
    model = vox.select(*M.KEY, F.lit(1).alias("predicted"))
    got = E.perfusion_volumes(vox, (C.NX, C.NY, C.NZ), 10, model)
    assert {"model_mm3", "model_smooth_ml"} <= set(got.columns) and got.filter("model_mm3 <> 2400").count() == 0
