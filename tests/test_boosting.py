"""Boosted stumps against a plain version, row by row and round by round."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from voxframe.operators import boosting as B
from voxframe.operators import models as M
from voxframe.sources.shared import new_folder

RULES = B.Rules(rounds=12, patience=4, least_weight=2.0)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(900, 3)), 2)
    y = (x[:, 0] + 0.5 * np.abs(x[:, 1]) + rng.normal(size=900) * 0.7 > 0.4).astype(int)
    x[::50, 2] = np.nan
    rows = [(int(k), [float(v) for v in x[k]], int(y[k]), k % 10 == 3) for k in range(900)]
    return spark.createDataFrame(rows, "id int, x array<double>, label int, held boolean").withColumn("h", F.xxhash64("id")).repartition(5).cache()


def plain(x, y, h, held, edges, rules):
    """All thresholds of all features tried one after the other, with the formulas written out; stumps and held-out areas of all rounds."""
    shrunk = lambda v: math.copysign(max(abs(v) - rules.alpha, 0), v)
    margin, stumps, areas = np.zeros(len(y)), [], []
    for t in range(rules.rounds):
        p = 1 / (1 + np.exp(-margin))
        own = ~held & B.in_sample(h, t, rules.subsample)
        g, w = (p - y)[own], (p * (1 - p))[own]
        whole = shrunk(g.sum()) ** 2 / (w.sum() + rules.lambda_)
        best = None
        for f in range(x.shape[1]):
            for e in edges[f]:
                left = x[own, f] <= e
                gl, wl, gr, wr = g[left].sum(), w[left].sum(), g[~left].sum(), w[~left].sum()
                if min(wl, wr) < rules.least_weight:
                    continue
                gain = shrunk(gl) ** 2 / (wl + rules.lambda_) + shrunk(gr) ** 2 / (wr + rules.lambda_) - whole
                if gain >= rules.gamma and (best is None or gain > best[0] + 1e-9):
                    best = gain, f, e, -rules.rate * shrunk(gl) / (wl + rules.lambda_), -rules.rate * shrunk(gr) / (wr + rules.lambda_)
        if best is None:
            leaf = -rules.rate * shrunk(g.sum()) / (w.sum() + rules.lambda_)
            best = 0.0, -1, 0.0, leaf, leaf
        margin = margin + (np.where(x[:, best[1]] <= best[2], best[3], best[4]) if best[1] >= 0 else best[3])
        stumps.append((best[1], best[2], best[3], best[4], best[0]))
        score = np.minimum((B.CELLS / (1 + np.exp(-margin[held]))).astype(int), B.CELLS - 1)
        up, down = score[y[held] == 1], score[y[held] == 0]
        areas.append(np.mean([(u > d) + 0.5 * (u == d) for u in up for d in down]))
    return stumps, areas


def arrays(df):
    d = df.orderBy("id").toPandas()
    return np.array(d.x.tolist()), d.label.to_numpy(), d.h.to_numpy(), d.held.to_numpy()


def test_every_round_is_that_of_the_plain_version(table):
    edges = B.bin_edges(table.filter("NOT held"), 3)
    assert all(2 < len(e) < B.BINS and np.isfinite(e).all() for e in edges)
    rules = RULES._replace(patience=99)
    want, areas = plain(*arrays(table), edges, rules)
    stumps, got = B.boost(B.binned(table, edges).cache(), edges, rules)
    assert np.allclose(got, areas, atol=1e-3) and len(got) == rules.rounds
    best = int(np.argmax(got)) + 1
    assert len(stumps) == best and len({s.feature for s in stumps}) > 1
    assert [s[0] for s in stumps] == [s[0] for s in want[:best]]
    assert np.allclose([s[1:] for s in stumps], [s[1:] for s in want[:best]], atol=1e-4)


def test_gain_and_weight_that_are_too_small_leave_a_leaf(table):
    edges = B.bin_edges(table, 3)
    rows = B.binned(table, edges).cache()
    for rules in (RULES._replace(gamma=1e6, rounds=2), RULES._replace(least_weight=1e6, rounds=2)):
        stumps, _ = B.boost(rows, edges, rules)
        want, _ = plain(*arrays(table), edges, rules)
        assert [s.feature for s in stumps] == [-1] * len(stumps) and stumps[0].right == pytest.approx(want[0][2], abs=1e-5)


def test_ends_after_the_rounds_of_patience(table):
    edges = B.bin_edges(table, 3)
    noise = table.withColumn("label", F.pmod(F.xxhash64(F.col("id") + 7), F.lit(2)).cast("int"))
    stumps, areas = B.boost(B.binned(noise, edges).cache(), edges, RULES._replace(rounds=60, gamma=0.0))
    assert len(areas) < 60 and len(areas) == len(stumps) + RULES.patience and areas[len(stumps) - 1] == max(areas)


def test_sums_do_not_depend_on_partitions(table):
    edges = B.bin_edges(table, 3)
    rows = B.binned(table, edges)
    assert B.boost(rows.repartition(9).cache(), edges, RULES._replace(rounds=5)) == B.boost(rows.coalesce(1).cache(), edges, RULES._replace(rounds=5))


def test_model_scores_like_its_stumps_and_survives_a_round_trip(spark, table):
    df = table.select("id", "label", array_to_vector("x").alias("vector"), F.col("held").alias("validation"))
    model = B.BoostedStumps(rules=[float(v) for v in RULES]).fit(df)
    x = arrays(table)[0]
    margin = sum(np.where(x[:, s.feature] <= s.threshold, s.left, s.right) if s.feature >= 0 else s.right for s in model.all_stumps())
    folder = f"{new_folder(spark)}/model"
    PipelineModel([model]).write().save(folder)
    again = PipelineModel.load(folder)
    for m in (model, again):
        out = m.transform(df).withColumn("p", vector_to_array("probability")[1]).orderBy("id").toPandas()
        assert list(out.columns) == ["id", "label", "vector", "validation", "probability", "p"]
        assert np.allclose(out.p, 1 / (1 + np.exp(-margin)))
    assert model.featureImportances.toArray().sum() == pytest.approx(1) and model.featureImportances.toArray()[0] > 0.4


def test_odd_tables(spark):
    schema = "id int, label int, x array<double>"
    fit = lambda rows: B.BoostedStumps(rules=[float(v) for v in RULES]).fit(spark.createDataFrame(rows, schema).select("id", "label", array_to_vector("x").alias("vector")))
    one = spark.createDataFrame([(1, 0, [1.0])], schema).select(array_to_vector("x").alias("vector"))
    score = lambda m: m.transform(one).first()["probability"][1]
    assert score(fit([])) == 0.5
    same = fit([(k, int(k % 4 == 0), [1.0]) for k in range(80)])
    assert same.getNumTrees == RULES.rounds and score(same) < 0.5
    assert score(fit([(k, 1, [float(k)]) for k in range(80)])) > 0.9
    nothing = fit([(k, k % 2, [math.nan]) for k in range(20)])
    assert all(s.feature == -1 for s in nothing.all_stumps())


def test_a_specification_like_any_other(spark):
    from voxframe import carriers as C

    vox = C.vox(spark, "/root/testdata/sf0.001")
    scores, failed = M.cross_validate(vox, ("tmax", "cbf"), M.Spec("stumps", M.boosted_stumps(rounds=3)), 2)
    assert failed == 0 and scores.count() == vox.select("subject").distinct().count()
