"""Queries that fit models, and round trips through files in the shared folder."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe import carriers as C
from voxframe.carriers import with_views as W
from voxframe.operators import models as M
from voxframe.operators import scoring as S
from voxframe.plans.registry import query, rounded
from voxframe.plans.scoring import _COUNTS, _METRICS
from voxframe.sources import tables as R
from voxframe.sources.runstore import RunStore
from voxframe.sources.shared import new_folder as folder

KEY = ("subject", "x", "y", "z")
TWO = ("tmax", "cbf")


def halves(spark: SparkSession, d: str, radius: tuple[int, int, int] = (0, 0, 0)) -> tuple[DataFrame, DataFrame]:
    """Balanced training rows of the even subjects; masked rows of the odd ones."""
    f = M.features(C.vox(spark, d), TWO, radius)
    return M.T.undersample_negatives(f.filter("subject % 2 = 0"), KEY), f.filter("subject % 2 = 1 AND mask = 1")


@query("voxel_logistic")
def _(spark: SparkSession, d: str) -> DataFrame:
    train, test = halves(spark, d)
    return M.predict(M.fit(train, M.Spec("logistic", M.logistic)), test)


@query("boosted_trees")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Up to 999 rounds of regularised stumps, ended after 30 without gain."""
    train, test = halves(spark, d)
    return M.predict(M.fit(train, M.Spec("boosted", M.boosted_stumps())), test)


@query("fixed_threshold_field")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The fixed threshold with a radius: logistic combination of the thresholded neighbours."""
    late = C.vox(spark, d).withColumn("late", F.when(F.col("tmax") > 6, 1.0).otherwise(0.0))
    f = M.features(late, ("late",), (1, 1, 0))
    train = M.T.undersample_negatives(f.filter("subject % 2 = 0"), KEY)
    return M.predict(M.fit(train, M.Spec("late_rf1", M.logistic, (1, 1, 0))), f.filter("subject % 2 = 1 AND mask = 1"))


@query("receptive_field_model")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Neighbourhood features and logistic regression; predicted where the score is over 0.5."""
    train, test = halves(spark, d, (1, 1, 0))
    return M.predict(M.fit(train, M.Spec("rf1", M.logistic, (1, 1, 0))), test).withColumn("predicted", F.when(F.col("score") > 0.5, 1).otherwise(0))


@query("batch_predict")
def _(spark: SparkSession, d: str) -> DataFrame:
    train, test = halves(spark, d)
    return M.save_and_predict(M.fit(train, M.Spec("logistic", M.logistic)), test, folder(spark))


@query("volume_prediction")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Whole volumes of the odd subjects scored by a saved model of neighbourhoods; 0 outside the mask."""
    f = M.features(C.vox(spark, d), TWO, (1, 1, 0))
    model = M.fit(M.T.undersample_negatives(f.filter("subject % 2 = 0"), KEY), M.Spec("rf1", M.logistic, (1, 1, 0)))
    return M.save_and_predict(model, f.filter("subject % 2 = 1"), folder(spark))


@query("fit_full")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Trained on every subject, saved, and applied to all."""
    f = M.features(C.vox(spark, d), TWO, (0, 0, 0))
    model = M.fit(M.T.undersample_negatives(f, KEY), M.Spec("logistic", M.logistic))
    return M.save_and_predict(model, f, folder(spark)).groupBy("subject").agg(F.sum("score").alias("expected"), F.sum("label").alias("truth"))


@query("cross_validate")
def _(spark: SparkSession, d: str) -> DataFrame:
    return M.cross_validate(C.vox(spark, d), TWO, M.Spec("logistic", M.logistic), 5)[0]


def cross_validate_radius(spark: SparkSession, d: str, r: int) -> DataFrame:
    """Five folds of a model with neighbourhoods of a radius in all directions: the work whose published times the bench is set against."""
    return M.cross_validate(C.vox(spark, d), C.CHANNELS, M.Spec(f"rf{r}", M.logistic, (r, r, r)), 5)[0]


@query("cross_validate_rf1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return cross_validate_radius(spark, d, 1)


def means(scores: DataFrame, *by: str) -> DataFrame:
    return scores.groupBy("model", *by).agg(F.avg("roc_auc").alias("roc_auc"), F.avg("dice").alias("dice"), F.count("*").alias("images"))


@query("sweep")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Radii 0 and 1, flat in z, and a smoothing kernel of width 3, over two folds."""
    shape = (C.NX, C.NY, C.NZ)
    return means(M.sweep(C.vox(spark, d), TWO, [*M.radius_specs("logistic", M.logistic, (0, 1)), *M.kernel_specs("logistic", M.logistic, (3,), TWO, shape)], 2))


@query("subgroup_runs")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Runs within each treatment group, and the same images with everyone else in training."""
    v, groups = C.vox(spark, d), C.clinical(spark, d).select("subject", F.col("treat").alias("grp")).join(C.vox(spark, d).select("subject").distinct(), "subject", "left_semi")
    runs = [M.subgroup_runs(v, groups, TWO, M.Spec("logistic", M.logistic), 2, hold_out) for hold_out in (False, True)]
    return means(runs[0].unionByName(runs[1]), "grp")


@query("leave_one_out")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Every subject scored by a model of up to 75 others; sums per subject."""
    scored = M.leave_one_out(C.vox(spark, d), TWO, M.Spec("logistic", M.logistic))
    return scored.groupBy("subject").agg(F.sum("score").alias("expected"), F.sum("label").alias("truth"), F.count("*").alias("voxels"))


@query("param_search")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Three random settings of boosted trees over two folds."""
    return M.param_search(C.vox(spark, d), TWO, 3, 2, folder(spark))


@query("channel_importance")
def _(spark: SparkSession, d: str) -> DataFrame:
    train, _ = halves(spark, d)
    return M.channel_importance(M.fit(train, M.Spec("boosted", M.boosted())), spark, TWO, 1)


_SCORED = "SELECT subject, {c}, CAST(subject % 2 AS INT) AS fold FROM (SELECT subject, tmax / 12.5 >= 0.5 AS h, label AS y FROM vox) GROUP BY subject"


@query("run_store", W("WITH c AS (" + _SCORED.format(c=_COUNTS) + f") SELECT subject, {_METRICS}, fold FROM c", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """Image scores of two folds, published one after the other; an attempt that was never published is not seen and a fold published again is there once."""
    store = RunStore(spark, folder(spark))
    scores = C.vox(spark, d).select("subject", "label", (F.col("tmax") / 12.5).alias("score"))
    of = lambda fold: S.confusion_metrics(scores.filter(F.col("subject") % 2 == fold), ["subject"], y="label").withColumns({"model": F.lit("m"), "repeat": F.lit(0), "fold": F.lit(fold)})
    store.write(scores=of(1))
    for fold in (0, 1, 0):
        store.append([("m", 0, fold)], scores=of(fold))
    return rounded(store.read().drop("model", "repeat"))


@query("report_sink", W("SELECT model, round(avg(roc_auc), 6) AS roc_auc FROM runs GROUP BY 1", "runs"))
def _(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark)
    runs = C.runs(spark, d)
    R.write_report({"scores": runs, "means": runs.groupBy("model").agg(F.avg("roc_auc").alias("roc_auc"))}, path)
    return rounded(spark.read.parquet(f"{path}/means"))


@query("dataset_roundtrip", W("SELECT subject, x, y, z, round(tmax, 9) AS tmax, label FROM vox", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """Saved with the older label name and loaded again; the second modality is missing."""
    path = folder(spark)
    v = C.vox(spark, d).select(*KEY, "tmax", "label")
    R.save_dataset({"voxels": v.withColumnRenamed("label", "lesion")}, path)
    loaded = R.load_dataset(spark, path, "voxels")
    second = R.load_dataset(spark, path, "second", optional=v.filter("false"))
    return rounded(loaded.unionByName(second).select(*KEY, "tmax", "label"), 9)


@query("libsvm_roundtrip", W("SELECT CAST(label AS DOUBLE) AS label, round(tmax, 9) AS tmax, round(cbf, 9) AS cbf, count(*) AS n FROM vox GROUP BY 1, 2, 3", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark)
    v = C.vox(spark, d).select("label", array_to_vector(F.array("tmax", "cbf")).alias("features"))
    R.write_libsvm(v, "label", "features", path)
    back = R.read_libsvm(spark, path, 2).select("label", vector_to_array("features").alias("f"))
    return back.groupBy("label", F.round(F.col("f")[0], 9).alias("tmax"), F.round(F.col("f")[1], 9).alias("cbf")).agg(F.count("*").alias("n"))


@query("volume_ingest", W("SELECT subject, x, y, z, round(tmax, 9) AS tmax FROM vox", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """Volumes packed as files' bytes and decoded to voxel rows again."""
    files = R.pack_volumes(C.vox(spark, d), "tmax", (C.NX, C.NY, C.NZ))
    return rounded(R.volume_rows(files).select(F.col("path").cast("long").alias("subject"), "x", "y", "z", F.col("value").alias("tmax")), 9)


@query("inventory_scan", W("SELECT DISTINCT CAST(subject AS VARCHAR) AS subject, 'year' || CAST(year(modality) AS VARCHAR) AS modality, study FROM inv", "inv"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """A tree of subject/modality/study folders that Spark writes from the inventory, listed by path without reading a file."""
    path = folder(spark)
    # Partition folders are named column=value; a dash parts values, also empty ones, from null.
    name = lambda c, v: F.coalesce(F.concat(F.lit("-"), v.cast("string")), F.lit("none")).alias(c)
    value = lambda c: F.when(F.col(c).rlike("^[a-z]=-"), R.unescaped(F.substring(c, 4, 1 << 30))).alias(c)
    inv = C.inventory(spark, d).select(name("s", F.col("subject")), name("m", F.concat(F.lit("year"), F.year("modality").cast("string"))), name("t", F.col("study")), "n_files")
    R.write_tree(inv, ("s", "m", "t"), path)
    return R.inventory_scan(spark, path, "*.parquet").select(value("subject"), value("modality"), value("study")).distinct()
