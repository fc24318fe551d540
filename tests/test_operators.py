"""Properties and hand-made cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.functions import voxel as V
from voxframe.operators import cohort as CO
from voxframe.operators import components as G
from voxframe.operators import normalise as N
from voxframe.operators import reports as E
from voxframe.operators import runs as U
from voxframe.operators import scoring as S
from voxframe.operators import spatial as P
from voxframe.operators import statistics as T


def grid(spark, values: np.ndarray, name: str = "v", subject: int = 0):
    rows = [(subject, *map(int, i), float(x)) for i, x in np.ndenumerate(values)]
    return spark.createDataFrame(rows, f"subject long, x int, y int, z int, {name} double")


def dense(df, name: str, shape: tuple[int, ...]) -> np.ndarray:
    out = np.full(shape, np.nan)
    for r in df.collect():
        if r[name] is not None:
            out[r["x"], r["y"], r["z"]] = r[name]
    return out


def test_rolling_window_worked_cases(spark):
    square = grid(spark, np.arange(9.0).reshape(3, 3, 1))
    two = {(r["x"], r["y"]): r["window"] for r in P.rolling_window(square, "v", (3, 3, 1), (2, 2, 0)).collect()}
    assert two == {(0, 0): [0, 1, 3, 4], (0, 1): [1, 2, 4, 5], (1, 0): [3, 4, 6, 7], (1, 1): [4, 5, 7, 8]}
    strided = P.rolling_window(square, "v", (3, 3, 1), (2, 2, 0), (2, 2, 1)).collect()
    assert [r["window"] for r in strided] == [[0, 1, 3, 4]]
    row = grid(spark, np.arange(10.0).reshape(10, 1, 1))
    dilated = sorted((r["x"], r["window"]) for r in P.rolling_window(row, "v", (10, 1, 1), (3, 0, 0), dilation=(2, 1, 1)).collect())
    assert dilated[0] == (0, [0, 2, 4]) and dilated[-1] == (5, [5, 7, 9])
    with pytest.raises(ValueError):
        P.rolling_window(row, "v", (10, 1, 1), (6, 0, 0), dilation=(2, 1, 1))


def test_cut_off_worked_case(spark):
    df = spark.createDataFrame([(0, -float(v), int(v < 5)) for v in range(1, 10)], "g int, score double, y int")
    assert S.youden_cutoff(S.roc_points(df, ["g"]), ["g"]).first()["cutoff"] == -4.0


def test_auc_of_negated_score_and_of_one_class(spark):
    rng = np.random.default_rng(1)
    rows = [(0, float(s), int(y)) for s, y in zip(rng.integers(0, 20, 200), rng.integers(0, 2, 200), strict=True)]
    df = spark.createDataFrame(rows, "g int, score double, y int")
    a = S.roc_auc(S.roc_points(df, ["g"]), ["g"]).first()["roc_auc"]
    b = S.roc_auc(S.roc_points(df.withColumn("score", -F.col("score")), ["g"]), ["g"]).first()["roc_auc"]
    assert a + b == pytest.approx(1)
    assert S.roc_auc(S.roc_points(df.filter("y = 1"), ["g"]), ["g"]).first()["roc_auc"] is None


def test_smoothing_keeps_constants_and_width_one_is_identity(spark):
    constant = grid(spark, np.full((5, 4, 3), 2.5))
    assert np.allclose(dense(P.gaussian_smooth(constant, ("v",), (5, 4, 3), 5, "xyz"), "v", (5, 4, 3)), 2.5)
    values = np.random.default_rng(2).random((5, 4, 3))
    assert np.allclose(dense(P.gaussian_smooth(grid(spark, values), ("v",), (5, 4, 3), 1), "v", (5, 4, 3)), values)


def test_dilation_and_erosion_enclose(spark):
    values = (np.random.default_rng(3).random((6, 5, 4)) > 0.5).astype(float)
    df = grid(spark, values)
    for size in (0, 2, 3):
        up, down = dense(P.dilate(df, "v", size), "v", values.shape), dense(P.erode(df, "v", size), "v", values.shape)
        assert (up >= values).all() and (down <= values).all()


def test_receptive_field_is_channel_major_and_zero_padded(spark):
    values = np.random.default_rng(4).random((4, 3, 2))
    df = grid(spark, values).withColumn("w", F.col("v") + 10)
    padded = [np.pad(c, ((1, 1), (1, 1), (1, 1))) for c in (values, values + 10)]
    for r in P.receptive_field(df, ("v", "w"), (1, 1, 1)).collect():
        x, y, z = r["x"], r["y"], r["z"]
        want = np.concatenate([p[x : x + 3, y : y + 3, z : z + 3].ravel() for p in padded])
        assert np.allclose(r["features"], want)


def test_diagonal_voxels(spark):
    values = np.zeros((3, 3, 3))
    values[0, 0, 0] = values[1, 1, 1] = 1
    on = grid(spark, values).filter("v = 1")
    assert G.label_regions(on).select("region").distinct().count() == 2
    assert G.label_regions(on, offsets=G.TWENTY_SIX).select("region").distinct().count() == 1


def test_leave_one_out_trains_on_75_others(spark):
    import __spark_entry__ as entry

    got = entry.queries()["loo_training_sets_75"](spark, "/root/testdata/sf0.1").toPandas()
    assert len(got) == len(got.drop_duplicates()) and got.subject.nunique() > 76 and (got.groupby("subject").size() == 75).all() and (got.subject != got.other).all()


def test_fuzzy_match_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    some = lambda n: ["".join(rng.choice(list("abcd"), rng.integers(1, 17))) for _ in range(n)]
    left, right = (spark.createDataFrame([(x,) for x in names], "name string") for names in (["Katherine", "abab", "", None, *some(150)], ["Catherine", "Kate", "xbab", *some(150)]))
    ratio = 1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b"))
    pairs = left.distinct().select(F.col("name").alias("a")).crossJoin(right.distinct().select(F.col("name").alias("b"))).withColumn("ratio", ratio).toPandas()
    for least in (0.6, 0.45, 0.85):
        want = pairs[pairs.ratio > least].sort_values(["ratio", "b"], ascending=[False, True]).groupby("a").first()
        got = CO.fuzzy_match(left, right, least=least).toPandas().set_index("a").sort_index()
        assert got.b.to_dict() == want.b.to_dict() and got.index.is_unique
        assert got.b["Katherine"] == "Catherine"


def test_name_match_against_all_pairs(spark, monkeypatch):
    """Same choices as the standard library over all pairs, also with every group split; few pairs are candidates of the strict pass."""
    from difflib import SequenceMatcher, get_close_matches

    rng = np.random.default_rng(14)
    some = lambda n: ["".join(rng.choice(list("abcdefgh"), rng.integers(1, 15))) for _ in range(n)]
    left, right = ["KATHERINE^MEYER^19500101", "MEIER^ANNA", "ab", "", None, "ab", "Zoë", *some(120)], ["CATHERINE^MEYER^19500101", "ANNA^MEIER", "ba", "", None, "Zoe", *some(120)]
    l, r = (spark.createDataFrame([(x,) for x in names], "name string") for names in (left, right))
    real = sorted({x for x in right if x})
    for least, group in ((0.6, 1000), (0.6, 3), (0.3, 1000), (0.8, 1000), (1.0, 1000)):
        monkeypatch.setattr(CO, "GROUP", group)
        want = {}
        for x in {x for x in left if x}:
            if found := get_close_matches(x, real, 1, least):
                want[x] = (found[0], SequenceMatcher(None, x, found[0]).ratio())
        got = CO.block_match(l, r, least=least).collect()
        assert len(got) == len(want) and {g["a"]: (g["b"], g["ratio"]) for g in got} == want
    numbers = spark.range(200).select(F.format_string("Person%05d", F.col("id") * 7919 % 100_000).alias("a"))
    assert CO.sharing_names(numbers, numbers.withColumnRenamed("a", "b"), 0.9).count() < 40_000 / 4
    assert CO.block_match(l.filter("false"), r).count() == CO.block_match(l, r.filter("false")).count() == 0


def test_regions_against_flood_fill(spark):
    values = (np.random.default_rng(5).random((7, 6, 5)) > 0.55).astype(float)
    seen, sizes = np.zeros(values.shape, bool), {}
    for start in zip(*np.nonzero(values), strict=True):
        if seen[start]:
            continue
        todo, n, seen[start] = [start], 0, True
        while todo:
            at = todo.pop()
            n += 1
            for k in range(3):
                for s in (-1, 1):
                    to = tuple(at[i] + s * (i == k) for i in range(3))
                    if all(0 <= a < m for a, m in zip(to, values.shape, strict=True)) and values[to] and not seen[to]:
                        seen[to] = True
                        todo.append(to)
        sizes[tuple(map(int, start))] = n
    got = {tuple(r["region"]): r["count"] for r in G.label_regions(grid(spark, values).filter("v = 1")).groupBy("region").count().collect()}
    assert got == sizes


def test_distance_against_brute_force(spark):
    values = (np.random.default_rng(6).random((5, 4, 3)) > 0.8).astype(float)
    points = np.argwhere(values == 1)
    for r in P.squared_distance(grid(spark, values), "v").collect():
        assert r["d2"] == ((points - (r["x"], r["y"], r["z"])) ** 2).sum(axis=1).min()
    assert P.squared_distance(grid(spark, np.zeros((2, 2, 1))), "v").filter("d2 IS NOT NULL").count() == 0


def test_dice_of_empty_masks(spark):
    df = spark.createDataFrame([(0, 0.1, 0)], "g int, score double, y int")
    r = S.confusion_metrics(df, ["g"]).first()
    assert (r["dice"], r["jaccard"], r["ppv"]) == (1.0, 1.0, 0.0)


def test_folds_and_samples(spark):
    subjects = spark.range(13).withColumnRenamed("id", "subject")
    folds = T.subject_kfold(subjects, 5, 2).toPandas()
    assert folds.groupby(["repeat", "fold"]).size().sort_values().tolist() == [2, 2, 2, 2, 3, 3, 3, 3, 3, 3]
    assert (folds.groupby(["repeat", "subject"]).size() == 1).all()
    df = spark.range(5000).select(F.col("id").alias("subject"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("z"), (F.col("id") % 5 == 0).cast("int").alias("label"), F.lit(1).alias("mask"))
    assert T.undersample_negatives(df, ("subject",)).groupBy("label").count().toPandas()["count"].tolist() == [1000, 1000]


def test_nulls_and_infinities(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (float("inf"),), (1.5,)], "v double")
    assert [r[0] for r in df.select(V.nan_to_zero(F.col("v"))).collect()] == [0.0, 0.0, V.LARGEST, 1.5]


def test_mirror_ratio_times_its_mirror_is_one(spark):
    values = np.random.default_rng(7).random((6, 3, 2)) + 0.5
    got = dense(N.mirror_ratio(grid(spark, values), ("v",), 6), "v", values.shape)
    assert np.allclose(got * got[::-1], 1)


def test_pooled_roc_has_no_single_partition(spark):
    df = spark.range(1000).select((F.col("id") % 1).alias("g"), (F.col("id") % 97).cast("double").alias("score"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    plan = S.roc_points(df, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_a_stencil_shuffles_each_voxel_once(spark):
    plan = P.gaussian_smooth(grid(spark, np.ones((3, 3, 1))), ("v",), (3, 3, 1), 3, "x")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_stencil_against_plain_sums(spark):
    values = np.random.default_rng(8).random((4, 3, 9))
    for width, border, mode in ((3, "reflect", "symmetric"), (9, "reflect", "symmetric"), (5, "zero", "constant")):
        w = P.gaussian_weights(width)
        for k, axis in enumerate("xyz"):
            pad = [(width // 2, width // 2) if i == k else (0, 0) for i in range(3)]
            padded = np.pad(values, pad, mode=mode)
            want = sum(x * np.take(padded, range(o, o + values.shape[k]), axis=k) for o, x in enumerate(w))
            assert np.allclose(dense(P.stencil(grid(spark, values), ("v",), axis, values.shape[k], w, border), "v", values.shape), want)


def test_constant_single_and_empty_groups(spark):
    """Correlations, U tests, bands, histograms and matches of nothing to tell apart."""
    df = spark.createDataFrame([(0, 0, 0, 0, 1.0, 2.0), (1, 0, 0, 0, 1.0, 3.0), (0, 1, 0, 0, 5.0, 1.0)], "subject long, x int, y int, z int, a double, b double")
    assert {r["r"] for r in N.channel_correlation(df.filter("x = 0"), ("a", "b")).filter("a <> b").collect()} == {None}
    assert N.channel_correlation(df.filter("false"), ("a",)).first()["r"] is None
    r = N.voxelwise_correlation(df, "a", "b").first()
    assert (r["mean_r"], r["positions"]) == (None, 0)
    one = T.mann_whitney(df.filter("b = 3").withColumn("k", F.lit(1)), ["k"], "a", F.lit(True)).first()
    assert (one["n1"], one["n2"], one["z"], one["p"]) == (1, 0, None, None)
    same = T.mann_whitney(df.filter("x = 0").withColumn("k", F.lit(1)), ["k"], "a", F.col("b") == 3).first()
    assert same["z"] is None
    band = T.confidence_band(spark.createDataFrame([("g", None)], "g string, v double"), ["g"], "v").first()
    assert (band["mean"], band["n"], band["low"], band["high"]) == (None, 0, None, None)
    assert T.confidence_band(df, ["x"], "a").filter("x = 1").first()["low"] == 5.0
    names = spark.createDataFrame([("",), (None,)], "name string")
    assert CO.fuzzy_match(names, names).count() == 0


def test_exact_rank_tests_against_enumeration(spark):
    """All choices of signs and of ranks for up to 12 values, with ties; the published tail of five equal signs; none beyond the limits."""
    from itertools import combinations, product

    rng = np.random.default_rng(15)

    def ranks(values: list[float]) -> list[float]:
        return [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values]

    signed, groups = [], []
    for g in range(14):
        n = g % 12 + 1
        signed += [(g, float(rng.integers(-4, 5)), 0.0) for _ in range(n)]
        groups += [(g, float(rng.integers(0, 6)), bool(k < max(1, n // 3))) for k in range(n)]
    signed += [(50, float(k + 1), 0.0) for k in range(5)] + [(51, float(k + 1), 0.0) for k in range(26)]
    groups += [(51, float(k), k < 10) for k in range(31)]
    got = {r["g"]: r for r in T.wilcoxon(spark.createDataFrame(signed, "g int, a double, b double"), ["g"]).collect()}
    for g in [*range(14), 50]:
        d = [a for h, a, _ in signed if h == g and a]
        if not d:
            assert g not in got
            continue
        r = ranks([abs(v) for v in d])
        plus = [sum(x for x, s in zip(r, signs, strict=True) if s) for signs in product((0, 1), repeat=len(d))]
        w = min(got[g]["w_plus"], got[g]["w_minus"])
        assert got[g]["p_exact"] == pytest.approx(min(1, 2 * sum(x <= w for x in plus) / len(plus)))
    assert got[50]["p_exact"] == 0.0625 and got[51]["p_exact"] is None and got[51]["p"] is not None
    got = {r["g"]: r for r in T.mann_whitney(spark.createDataFrame(groups, "g int, v double, f boolean"), ["g"], "v", F.col("f")).collect()}
    for g in range(14):
        own = [f for h, _, f in groups if h == g]
        r = ranks([v for h, v, _ in groups if h == g])
        sums = [sum(c) for c in combinations(r, sum(own))]
        w = sum(x for x, f in zip(r, own, strict=True) if f)
        want = min(1, 2 * min(sum(x <= w for x in sums), sum(x >= w for x in sums)) / len(sums)) if 0 < sum(own) < len(own) else None
        assert got[g]["p_exact"] == (want if want is None else pytest.approx(want))
    assert got[51]["p_exact"] is None and got[51]["p"] is not None


def test_exact_quantiles(spark):
    from voxframe.operators.quantiles import exact_quantiles, order_statistics

    rng = np.random.default_rng(9)
    for values in (np.concatenate((rng.normal(size=20_000) ** 3, np.full(9000, 0.25))), np.array([3.0]), np.array([1.0, 1.0, 2.0]), np.array([-np.inf, 0.0, 5.0, 5.0, np.inf]), rng.integers(0, 3, 5000) * 1e-320, np.array([1e308, -1e308, 0.0])):
        df = spark.createDataFrame([(float(v),) for v in [*values, np.nan]], "v double").union(spark.createDataFrame([(None,)], "v double"))
        ranks = sorted({0, len(values) // 3, len(values) // 2, len(values) - 1})
        assert order_statistics(df, "v", ranks) == {k: np.sort(values)[k] for k in ranks}
        if np.isfinite(values).all() and np.abs(values).max() < 1e300:
            want = df.filter("v IS NOT NULL AND NOT isnan(v)").agg(F.percentile("v", F.array(*map(F.lit, (0.01, 0.5, 0.99))))).first()[0]
            assert exact_quantiles(df, "v", (0.01, 0.5, 0.99)) == pytest.approx(want, rel=1e-12, abs=0)
    assert exact_quantiles(df.filter("false"), "v", (0.5,)) == [None]


def test_quantiles_of_many_columns_in_few_scans(spark):
    """Four columns at two ranks each, one of them without values: equal to single searches, in a few jobs whatever the columns."""
    from voxframe.operators.quantiles import exact_quantiles, exact_quantiles_of

    x = spark.range(30_000).select(F.randn(3).alias("a"), F.pow(F.randn(4), 3).alias("b"), (F.col("id") % 7).cast("int").alias("c"), F.lit(None).cast("double").alias("d"), F.when(F.col("id") % 3 == 0, F.randn(5) * 1e6).alias("e")).cache()
    x.count()
    shares = (0.25, 0.9)
    tracker = spark.sparkContext.statusTracker()

    def jobs(work) -> tuple[object, int]:
        before = len(tracker.getJobIdsForGroup())
        return work(), len(tracker.getJobIdsForGroup()) - before

    got, many = jobs(lambda: exact_quantiles_of(x, {c: shares for c in "abcde"}))
    one, single = jobs(lambda: exact_quantiles(x, "b", shares))
    assert got["b"] == one and got["d"] == [None, None] and many <= single + 4
    want = x.agg(*[F.percentile(c, F.array(*map(F.lit, shares))).alias(c) for c in "abce"]).first()
    assert all(got[c] == pytest.approx(want[c], rel=1e-12) for c in "abce")


def test_pooled_quantiles_leave_no_percentile_in_the_plan(spark):
    df = spark.createDataFrame([(0, 0, 0, 0, 7.0, 1), (1, 0, 0, 0, 1.0, 1)], "subject long, x int, y int, z int, tmax double, mask int")
    for out in (N.penumbra(df), N.rescale_outliers(df, ("tmax",))):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert not any("Aggregate [percentile" in x or "Aggregate [" not in x and "percentile" in x for x in plan.split("\n"))


def test_sequences_of_a_mode(spark):
    assert CO.sequences_of("perfusion") == (("wcoreg_Tmax", "wcoreg_CBF", "wcoreg_MTT", "wcoreg_CBV"), "masked_wcoreg_VOI")
    assert CO.sequences_of("angio", True) == (("betted_Angio",), "coreg_VOI") and CO.sequences_of("perfusion", True)[1] == "masked_coreg_VOI"
    with pytest.raises(ValueError):
        CO.sequences_of("ct")


def test_intermediate_tables_are_deleted(spark, tmp_path, monkeypatch):
    from voxframe.sources import shared

    monkeypatch.setattr(shared, "shared_dir", lambda spark: str(tmp_path))
    with shared.Scratch(spark) as s:
        assert s.cut(spark.range(3)).count() == 3 and len(list(tmp_path.iterdir())) == 1
    assert not list(tmp_path.iterdir())


def test_metrics_from_the_counts_per_score(spark):
    """Equal to those counted from rows, with ties, one class only and scores that are all below the cut."""
    rng = np.random.default_rng(8)
    rows = [(g, float(rng.integers(0, 9)) / 10, int(rng.integers(0, 2)) if g < 3 else 1) for g in range(4) for _ in range(60)] + [(4, 0.25, 0), (4, 0.25, 0)]
    df = spark.createDataFrame(rows, "subject long, score double, y int").cache()
    names = ["subject", "tp", "fp", "fn", "tn", "accuracy", "f1", "jaccard", "dice", "ppv", "npv", "error_ratio"]
    got = S.metrics_of_points(S.roc_points(df, ["subject"]), ["subject"])
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, S.confusion_metrics(df, ["subject"]).select(names).collect()))
    auc = {r["subject"]: r["roc_auc"] for r in S.roc_auc(S.roc_points(df, ["subject"]), ["subject"]).collect()}
    for r in got.collect():
        assert r["roc_auc"] == pytest.approx(auc[r["subject"]], rel=1e-12) if auc[r["subject"]] is not None else r["roc_auc"] is None
        assert r["raw"] == pytest.approx(sum(x[1] for x in rows if x[0] == r["subject"]))
    assert auc[3] is None and auc[4] is None


def test_run_reports_of_little(spark):
    """No bin for null, one bin for a single value, no share of nothing, no deviation of one run, columns that a table lacks."""
    runs = spark.createDataFrame([("A", 0, 0, 0.5), ("A", 0, 1, None)], "model string, rf int, fold int, roc_auc double")
    assert {(r["bin"], r["n"]) for r in U.score_histogram(runs, ["rf"], "roc_auc", 20).collect()} == {(0, 1), (None, 1)}
    assert U.score_histogram(runs.filter("false"), ["rf"], "roc_auc", 20).count() == 0
    zero = spark.createDataFrame([(0, 0, 0.0), (0, 7, 0.0)], "fold int, pos int, weight double")
    assert {(r["channel"], r["share"]) for r in U.channel_weights(zero, 7).collect()} == {(0, None), (1, None)}
    assert {(r["part"], r["std"]) for r in U.training_curve(runs.filter("fold = 0"), "rf", F.col("fold") >= 5, "roc_auc").collect()} == {("train", None)}
    both = U.union_runs(runs, runs.drop("roc_auc").withColumn("kernel", F.lit(5)))
    assert both.columns == [*runs.columns, "kernel"] and both.filter("kernel = 5 AND roc_auc IS NULL").count() == 2
    assert U.rf_comparison(runs, 0, 3).count() == 0


def test_inventory_rules_of_little(spark):
    inv = spark.createDataFrame([(1, "a", "x", 9), (1, "a", "y", 9), (1, "b", "x", 9), (1, "b", "y", 9), (2, "a", "x", 1), (3, "a", None, None)], "subject long, modality string, study string, n_files int")
    got = {r["subject"]: tuple(r)[1:] for r in CO.scan_selection(inv, ("x", "y"), "angio", 3, "no angio").collect()}
    assert got == {1: ("a", True, "no angio"), 2: (None, False, "no series"), 3: (None, False, "no series")}
    state = {r["subject"]: (r["has_x"], r["has_y"], r["has_unknown"], r["has_all"]) for r in CO.imaging_state(inv, ("x", "y"), ("x",)).collect()}
    assert state == {1: (1, 1, 1, 1), 2: (1, 0, 0, 0), 3: (0, 0, 0, 0)}
    assert {(r["subject"], r["modality"]) for r in CO.map_count_rule(inv, 2, 9).collect()} == set()
    assert {(r["subject"], r["modality"]) for r in CO.map_count_rule(inv, 3, 9).collect()} == {(1, "a"), (1, "b")}
    parts = CO.split_by_subjects(inv, inv.filter("subject = 1"))
    assert {(r["subject"], r["part"]) for r in parts.collect()} == {(1, "test"), (2, "train"), (3, "train")}
    assert CO.linear_fit(inv.filter("subject = 2"), "n_files", "subject").first()["slope"] is None


def test_masks_channels_and_thresholds(spark):
    a = grid(spark, np.array([[[1.0, 0.0], [1.0, 0.0]]]), "m").filter("m = 1")
    b = grid(spark, np.array([[[1.0, 1.0], [0.0, 0.0]]]), "m").filter("m = 1")
    assert P.mask_union(a, a, b).count() == 3 and P.mask_intersection(a, b, a).count() == 1 and P.mask_intersection(a, b.filter("false")).count() == 0
    images = spark.createDataFrame([(0, 0, 0, 0, "p", 1.0), (0, 0, 0, 0, "q", 2.0), (0, 0, 0, 1, "p", 3.0)], "subject long, x int, y int, z int, channel string, value double")
    assert tuple(P.align_channels(images.filter("z = 0"), ("p", "q")).first())[-2:] == (1.0, 2.0)
    with pytest.raises(Exception, match="shapes differ"):
        P.align_channels(images, ("p", "q")).collect()
    v = grid(spark, np.array([[[1.0, 2.0], [8.0, 9.0]]]), "tmax").withColumns({"mask": F.lit(1), "label": F.when(F.col("tmax") > 5, 1).otherwise(0)})
    assert [r["predicted"] for r in E.trained_threshold(v, v, "tmax").orderBy("tmax").collect()] == [0, 0, 0, 1]
    assert E.trained_threshold(v.filter("label = 1"), v, "tmax").agg(F.sum("predicted")).first()[0] in (0, None)
    assert E.fixed_threshold(v).agg(F.sum("predicted")).first()[0] == 2
