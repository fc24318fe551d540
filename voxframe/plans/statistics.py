"""Queries of run summaries, rank tests, samples and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe import carriers as C
from voxframe.carriers import with_views as W
from voxframe.functions import cohort as K
from voxframe.functions import voxel as V
from voxframe.operators import models as M
from voxframe.operators import runs as U
from voxframe.operators import statistics as T
from voxframe.plans.registry import query, rounded

KEY = ("subject", "x", "y", "z")
_TAIL = "(1 / (1 + 0.5 * x)) * exp(-x * x - 1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277)))))))))"


def tail_sql(source: str, columns: str) -> str:
    """`columns`, z and p from a query with z."""
    return f"SELECT {columns}, round(z, 6) AS z, round({_TAIL.replace('(1 / (1 + 0.5 * x))', 't')}, 6) AS p FROM (SELECT *, 1 / (1 + 0.5 * x) AS t FROM (SELECT *, abs(z) / sqrt(2.0) AS x FROM ({source})))"


_PAIRS = "SELECT a.model, a.rf, a.fold, a.roc_auc AS a, b.roc_auc AS b FROM runs a JOIN runs b ON b.model = a.model AND b.rf = a.rf + 1 AND b.fold = a.fold"
_WILCOXON = f"""SELECT model, rf, n, w_plus, w_minus, (least(w_plus, w_minus) - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0) AS z FROM (
SELECT model, rf, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS w_plus, coalesce(sum(r) FILTER (d < 0), 0) AS w_minus, sum(t * t - 1) AS ties FROM (
SELECT *, rank() OVER (PARTITION BY model, rf ORDER BY abs(d)) + (count(*) OVER (PARTITION BY model, rf, abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY model, rf, abs(d)) AS t FROM (
SELECT model, rf, round(a - b, 12) AS d FROM ({_PAIRS})) WHERE d <> 0) GROUP BY 1, 2)"""


@query("pair_runs", W(f"SELECT model, rf, fold, round(a, 6) AS a, round(b, 6) AS b FROM ({_PAIRS})", "runs"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(T.pair_runs(C.runs(spark, d), 1))


_SIGNED = f"""SELECT model, rf, (2 * (rank() OVER (PARTITION BY model, rf ORDER BY abs(d)) + (count(*) OVER (PARTITION BY model, rf, abs(d)) - 1) / 2.0))::BIGINT AS r, d > 0 AS up, row_number() OVER (PARTITION BY model, rf ORDER BY abs(d)) AS nth FROM (
SELECT model, rf, round(a - b, 12) AS d FROM ({_PAIRS})) WHERE d <> 0"""
# Choices of signs are counted by their sum of doubled ranks, one difference after another.
_EXACT_SIGNED = f"""SELECT model, rf, least(1.0, 2 * sum(ways) FILTER (s <= least(w, v)) / sum(ways)) AS p_exact FROM (WITH RECURSIVE d AS MATERIALIZED ({_SIGNED}), c AS (
SELECT DISTINCT model, rf, 0::BIGINT AS i, 0::BIGINT AS s, 1.0::DOUBLE AS ways FROM d UNION ALL
SELECT c.model, c.rf, c.i + 1, c.s + t * r, sum(ways) FROM c JOIN d ON d.model = c.model AND d.rf = c.rf AND nth = i + 1 CROSS JOIN (VALUES (0), (1)) t(t) GROUP BY 1, 2, 3, 4)
SELECT c.model, c.rf, s, ways, w, v FROM c JOIN (SELECT model, rf, count(*) AS n, coalesce(sum(r) FILTER (up), 0) AS w, coalesce(sum(r) FILTER (NOT up), 0) AS v FROM d GROUP BY 1, 2) e ON e.model = c.model AND e.rf = c.rf AND i = n AND n <= {T.EXACT_PAIRS}) GROUP BY 1, 2"""


@query("wilcoxon", W(f"SELECT t.*, round(p_exact, 6) AS p_exact FROM ({tail_sql(_WILCOXON, 'model, rf, n, w_plus, w_minus')}) t LEFT JOIN ({_EXACT_SIGNED}) e ON e.model = t.model AND e.rf = t.rf", "runs"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(T.wilcoxon(T.pair_runs(C.runs(spark, d), 1), ["model", "rf"]))


_RANKED = """SELECT rf, model = 'A' AS own, (2 * (rank() OVER (PARTITION BY rf ORDER BY roc_auc) + (count(*) OVER (PARTITION BY rf, roc_auc) - 1) / 2.0))::BIGINT AS r, row_number() OVER (PARTITION BY rf ORDER BY roc_auc) AS nth FROM runs WHERE model IN ('A', 'N')"""
_EXACT_RANKED = f"""SELECT rf, least(1.0, 2 * least(sum(ways) FILTER (s <= w), sum(ways) FILTER (s >= w)) / sum(ways)) AS p_exact FROM (WITH RECURSIVE d AS MATERIALIZED ({_RANKED}), c AS (
SELECT DISTINCT rf, 0::BIGINT AS i, 0::BIGINT AS k, 0::BIGINT AS s, 1.0::DOUBLE AS ways FROM d UNION ALL
SELECT c.rf, c.i + 1, c.k + t, c.s + t * r, sum(ways) FROM c JOIN d ON d.rf = c.rf AND nth = i + 1 CROSS JOIN (VALUES (0), (1)) t(t) GROUP BY 1, 2, 3, 4)
SELECT c.rf, s, ways, w FROM c JOIN (SELECT rf, count(*) AS n, count(*) FILTER (own) AS n1, sum(r) FILTER (own) AS w FROM d GROUP BY 1) e ON e.rf = c.rf AND i = n AND k = n1 AND n1 > 0 AND n1 < n AND n <= {T.EXACT_VALUES}) GROUP BY 1"""
_MANN = """SELECT rf, n1, n2, r1 - n1 * (n1 + 1) / 2.0 AS u, greatest(abs(r1 - n1 * (n1 + 1) / 2.0 - n1 * n2 / 2.0) - 0.5, 0) / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM (
SELECT rf, count(*) FILTER (model = 'A') AS n1, count(*) FILTER (model = 'N') AS n2, sum(r) FILTER (model = 'A') AS r1, sum(t * t - 1) AS ties FROM (
SELECT *, rank() OVER (PARTITION BY rf ORDER BY roc_auc) + (count(*) OVER (PARTITION BY rf, roc_auc) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY rf, roc_auc) AS t FROM runs WHERE model IN ('A', 'N')) GROUP BY 1)"""


@query("mann_whitney", W(f"SELECT t.*, round(p_exact, 6) AS p_exact FROM ({tail_sql(_MANN, 'rf, n1, n2, round(u, 6) AS u')}) t LEFT JOIN ({_EXACT_RANKED}) e ON e.rf = t.rf", "runs"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(T.mann_whitney(C.runs(spark, d).filter("model IN ('A', 'N')"), ["rf"], "roc_auc", F.col("model") == "A"))


_THREE = _WILCOXON.replace("SELECT model, rf, n,", "SELECT model, n,").replace("SELECT model, rf, count", "SELECT model, count").replace("PARTITION BY model, rf", "PARTITION BY model").replace("GROUP BY 1, 2", "GROUP BY 1").replace("b.rf = a.rf + 1", "b.rf = a.rf + 3 AND a.rf = 0")
_POOL = "runs AS (SELECT * FROM base UNION ALL SELECT 'mean model', rf, fold, avg(roc_auc), avg(dice) FROM base GROUP BY rf, fold)"


@query("rf_comparison", f"WITH base AS ({C.RUNS}), {_POOL}, t AS ({tail_sql(_THREE, 'model, n')}) SELECT t.model, round(avg(roc_auc) FILTER (rf = 0), 6) AS mean_rf0, round(avg(roc_auc) FILTER (rf = 3), 6) AS mean_rf3, any_value(t.p) AS p FROM t JOIN runs USING (model) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Means at radii 0 and 3 and the paired test between them, per model and for the mean over models."""
    return rounded(U.rf_comparison(C.runs(spark, d), 0, 3))


@query("run_summary", W("SELECT model, rf, " + ", ".join(f"round(avg({v}), 6) AS {v}_mean, round(stddev_pop({v}), 6) AS {v}_std, round(quantile_cont({v}, 0.5), 6) AS {v}_median" for v in ("roc_auc", "dice")) + " FROM runs GROUP BY 1, 2", "runs"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(T.summary(C.runs(spark, d), ["model", "rf"], ("roc_auc", "dice")))


@query("run_medians", W("SELECT model, round(quantile_cont(roc_auc, 0.5), 6) AS roc_auc, round(quantile_cont(dice, 0.5), 6) AS dice FROM runs WHERE rf = 0 GROUP BY 1", "runs"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(U.medians(C.runs(spark, d).filter("rf = 0"), ["model"], ("roc_auc", "dice")))


@query("confidence_band", W("SELECT rf, round(avg(roc_auc), 6) AS mean, count(*) AS n, round(greatest(avg(roc_auc) - 1.96 * stddev_pop(roc_auc) / sqrt(count(*)), 0), 6) AS low, round(avg(roc_auc) + 1.96 * stddev_pop(roc_auc) / sqrt(count(*)), 6) AS high FROM runs GROUP BY 1", "runs"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(T.confidence_band(C.runs(spark, d), ["rf"], "roc_auc"))


@query("box_stats", W("SELECT model, " + ", ".join(f"round(quantile_cont(dice, {q}), 6) AS {n}" for q, n in ((0, "low"), (0.25, "q25"), (0.5, "median"), (0.75, "q75"), (1, "high"))) + " FROM runs GROUP BY 1 ORDER BY median", "runs"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(U.box_stats(C.runs(spark, d), ["model"], "dice"))


@query("score_histogram", W("WITH b AS (SELECT min(roc_auc) AS lo, max(roc_auc) AS hi FROM runs) SELECT rf, CAST(least(floor((roc_auc - lo) / ((hi - lo) / 20)), 19) AS INT) AS bin, count(*) AS n FROM runs, b GROUP BY 1, 2", "runs"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return U.score_histogram(C.runs(spark, d), ["rf"], "roc_auc", 20)


@query("mean_by_rf", W("SELECT rf, CASE WHEN model = 'A' THEN 'Threshold' ELSE 'Regression' END AS class, round(avg(roc_auc), 6) AS mean, rf * 2 AS width_mm FROM runs GROUP BY 1, 2", "runs"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(U.mean_by_rf(C.runs(spark, d), F.when(F.col("model") == "A", "Threshold").otherwise("Regression"), "roc_auc", 2))


@query("training_curve", W("SELECT rf AS round, CASE WHEN fold < 5 THEN 'train' ELSE 'validation' END AS part, round(avg(dice), 6) AS mean, round(stddev_samp(dice), 6) AS std FROM runs GROUP BY 1, 2", "runs"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(U.training_curve(C.runs(spark, d), "rf", F.col("fold") >= 5, "dice"))


def coefficients(spark: SparkSession, d: str) -> DataFrame:
    """model coefficients of each fold, channels first: fold, pos (0 to 27), weight."""
    return C.read(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("fold"), (F.col("l_partkey") % 28).alias("pos")).agg((F.avg("l_discount") - 0.05).alias("weight"))


_COEF = "k AS (SELECT l_suppkey % 10 AS fold, l_partkey % 28 AS pos, avg(l_discount) - 0.05 AS weight FROM lineitem GROUP BY 1, 2)"


@query("channel_weights", f"WITH {_COEF}, f AS (SELECT fold, pos // 7 AS channel, quantile_cont(weight, 0.5) AS m FROM k GROUP BY 1, 2), c AS (SELECT channel, quantile_cont(m, 0.5) AS median, stddev_pop(m) AS std FROM f GROUP BY 1) SELECT channel, round(median, 6) AS median, round(std, 6) AS std, round(abs(median) / sum(abs(median)) OVER (), 6) AS share FROM c")
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(U.channel_weights(coefficients(spark, d), 7))


@query("spatial_weights", f"WITH {_COEF} SELECT pos % 7 AS place, round(quantile_cont(weight, 0.5), 6) AS median FROM k GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(U.spatial_weights(coefficients(spark, d), 7))


@query("trained_thresholds", W("SELECT model, round(quantile_cont(dice * 12, 0.5), 6) AS threshold, count(*) AS folds FROM runs GROUP BY 1", "runs"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(U.trained_thresholds(C.runs(spark, d), F.col("dice") * 12))


@query("union_runs", W("SELECT model, rf, fold, round(roc_auc, 6) AS roc_auc, round(dice, 6) AS dice, NULL AS kernel FROM runs WHERE rf < 3 UNION ALL SELECT model, rf, fold, round(roc_auc, 6), NULL, 5 FROM runs WHERE rf >= 3", "runs"))
def _(spark: SparkSession, d: str) -> DataFrame:
    r = C.runs(spark, d)
    return rounded(U.union_runs(r.filter("rf < 3"), r.filter("rf >= 3").drop("dice").withColumn("kernel", F.lit(5))))


@query("load_runs", "SELECT DISTINCT 'runs/' || l_returnflag || '_rf' || (l_linenumber - 1) || CASE WHEN l_linenumber % 2 = 0 THEN '_k5' ELSE '' END AS path, l_returnflag AS model, CAST(l_linenumber - 1 AS INT) AS rf, CASE WHEN l_linenumber % 2 = 0 THEN 5 END AS kernel FROM lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    from voxframe.sources.tables import load_runs

    n = F.col("l_linenumber")
    path = F.concat(F.lit("runs/"), "l_returnflag", F.lit("_rf"), (n - 1).cast("string"), F.when(n % 2 == 0, "_k5").otherwise(""))
    return load_runs(C.read(spark, d, "lineitem").select(path.alias("path")).distinct())


_ORDER = "md5('1-' || subject || '-' || x || '-' || y || '-' || z)"
_UNDER = f"SELECT subject, x, y, z, label FROM vox WHERE label = 1 UNION ALL SELECT subject, x, y, z, label FROM (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS r FROM vox WHERE label = 0 AND mask = 1) WHERE r <= (SELECT count(*) FROM vox WHERE label = 1)"


@query("undersample", W(_UNDER, "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return T.undersample_negatives(C.vox(spark, d).select(*KEY, "label", "mask"), KEY).select(*KEY, "label")


@query("balance_both", W(f"SELECT subject, x, y, z, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_ORDER}) AS r FROM vox WHERE mask = 1) WHERE r <= (SELECT least(sum(label), sum(1 - label)) FROM vox WHERE mask = 1)", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return T.balance_both(C.vox(spark, d).select(*KEY, "label", "mask"), KEY).select(*KEY, "label")


_FOLDS = """p AS (SELECT subject, repeat, row_number() OVER (PARTITION BY repeat ORDER BY md5('1-' || repeat || '-' || subject)) - 1 AS i, count(*) OVER (PARTITION BY repeat) AS n FROM (SELECT DISTINCT subject FROM vox), range(3) r(repeat)),
folds AS (SELECT subject, CAST(repeat AS INT) AS repeat, CAST(CASE WHEN i < n % 5 * (n // 5 + 1) THEN i // (n // 5 + 1) ELSE n % 5 + (i - n % 5 * (n // 5 + 1)) // (n // 5) END AS INT) AS fold FROM p)"""


@query("subject_kfold", W(f"WITH {_FOLDS} SELECT * FROM folds", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return T.subject_kfold(C.vox(spark, d), 5, 3)


@query("fraction_sample", W(f"SELECT subject, x, y, z FROM (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS r FROM vox) WHERE r <= (SELECT count(*) FROM vox) * 3 // 10", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    v = C.vox(spark, d).select(*KEY)
    return T.exact_sample(v, T.hash_order("1", *KEY), v.agg(F.floor(F.count("*") * 3 / 10).alias("__want"))).select(*KEY)


_BUILD = f"""WITH {_FOLDS}, t AS (SELECT v.* FROM vox v JOIN folds f ON f.subject = v.subject AND f.repeat = 0 AND f.fold <> 0),
n AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS r FROM t WHERE label = 0 AND mask = 1)
SELECT 'train' AS part, subject, x, y, z, label, round(tmax, 9) AS tmax FROM t WHERE label = 1 UNION ALL SELECT 'train', subject, x, y, z, label, round(tmax, 9) FROM n WHERE r <= (SELECT count(*) FROM t WHERE label = 1)
UNION ALL SELECT 'test', v.subject, v.x, v.y, v.z, v.label, round(v.tmax, 9) FROM vox v JOIN folds f ON f.subject = v.subject AND f.repeat = 0 AND f.fold = 0 WHERE v.mask = 1"""


@query("build_fold", W(_BUILD, "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    v = C.vox(spark, d)
    return rounded(M.build_fold(v, T.subject_kfold(v, 5, 3), 0, 0).select("part", *KEY, "label", "tmax"), 9)


_FIELD = f"""WITH {_FOLDS}, t AS (SELECT v.* FROM vox v JOIN folds f ON f.subject = v.subject AND f.repeat = 0 AND f.fold <> 0 WHERE v.subject IN (SELECT subject FROM clin)),
n AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS r FROM t WHERE label = 0 AND mask = 1),
rows_ AS (SELECT 'train' AS part, subject, x, y, z FROM t WHERE label = 1 UNION ALL SELECT 'train', subject, x, y, z FROM n WHERE r <= (SELECT count(*) FROM t WHERE label = 1)
 UNION ALL SELECT 'test', v.subject, v.x, v.y, v.z FROM vox v JOIN folds f ON f.subject = v.subject AND f.repeat = 0 AND f.fold = 0 WHERE v.mask = 1 AND v.subject IN (SELECT subject FROM clin)),
near AS (SELECT r.*, k.a * 3 + k.b + 4 AS i, coalesce(v.tmax, 0) AS value, coalesce(v.mask, 0) AS inside FROM rows_ r CROSS JOIN (SELECT a, b FROM range(-1, 2) p(a), range(-1, 2) q(b)) k LEFT JOIN vox v ON v.subject = r.subject AND v.x = r.x + k.a AND v.y = r.y + k.b AND v.z = r.z)
SELECT part, subject, x, y, z, CAST(i AS INT) AS i, round(value, 9) AS value FROM near UNION ALL SELECT part, subject, x, y, z, 9, age FROM rows_ JOIN clin USING (subject) UNION ALL SELECT part, subject, x, y, z, 10, CASE WHEN sex = 'm' THEN 1 ELSE 0 END FROM rows_ JOIN clin USING (subject)
UNION ALL SELECT part, subject, x, y, z, 11, 9 - sum(inside) FROM near GROUP BY ALL"""


@query("build_fold_features", W(_FIELD, "vox", "clin"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """A fold with neighbourhoods of radius 1 flat in z, two clinical columns and the count of undefined neighbours; one row per feature for comparison."""
    v = C.vox(spark, d)
    clinical = C.clinical(spark, d).select("subject", "age", K.flag(F.col("sex"), "m").alias("male"))
    rows = M.build_fold(M.features(v, ("tmax",), (1, 1, 0), clinical), T.subject_kfold(v, 5, 3), 0, 0)
    return rounded(rows.select("part", *KEY, F.posexplode("features").alias("i", "value")), 9)


@query("loo_training_sets", W("WITH s AS (SELECT subject, row_number() OVER (ORDER BY md5('1-' || subject)) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT subject FROM vox)) SELECT a.subject, b.subject AS other FROM s a, range(1, 11) k(k), s b WHERE b.i = (a.i + k) % a.n AND k < a.n", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """A short list of ten; loo_training_sets_75 has as many others as the reference trains on."""
    return T.leave_one_out(C.vox(spark, d), 10)


@query("loo_training_sets_75", W("WITH s AS (SELECT subject, row_number() OVER (ORDER BY md5('1-' || subject)) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT subject FROM vox)) SELECT a.subject, b.subject AS other FROM s a, range(1, 76) k(k), s b WHERE b.i = (a.i + k) % a.n AND k < a.n", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return T.leave_one_out(C.vox(spark, d), 75)


@query("hypoperfused_volume", W("""WITH o AS (SELECT subject, quantile_cont(tmax, 0.5) AS t FROM vox_out WHERE mask = 1 GROUP BY 1), a AS (SELECT quantile_cont(tmax, 0.5) AS t FROM vox_out WHERE mask = 1)
SELECT v.subject, count(*) FILTER (mask = 1 AND CASE WHEN o.t > 5 * a.t THEN tmax / 10 ELSE tmax END > 6) AS voxels, round(count(*) FILTER (mask = 1 AND CASE WHEN o.t > 5 * a.t THEN tmax / 10 ELSE tmax END > 6) * 0.008::DOUBLE, 6) AS ml FROM vox_out v LEFT JOIN o USING (subject) CROSS JOIN a GROUP BY 1""", "vox_out"))
def hypoperfused_volume(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: outliers rescaled, masked voxels with Tmax over 6 s, counted and in ml per subject."""
    from voxframe.operators.normalise import rescale_outliers

    v = rescale_outliers(C.vox_out(spark, d), ("tmax",))
    n = v.groupBy("subject").agg(F.count_if((F.col("mask") == 1) & (F.col("tmax") > 6)).alias("voxels"))
    return rounded(n.withColumn("ml", V.volume_ml(F.col("voxels"))))
