"""Voxel classifiers on Spark ML, with one contract: fit(df) gives a model whose transform adds `score`; cross-validation, sweeps and searches over them."""

from __future__ import annotations

import random
import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxframe.operators import boosting as G
from voxframe.operators import fits as B
from voxframe.operators import scoring as S
from voxframe.operators import spatial as P
from voxframe.operators import statistics as T
from voxframe.sources.runstore import RunStore
from voxframe.sources.shared import Scratch, cut, new_folder

KEY = ("subject", "x", "y", "z")
FAILURES = (ValueError, RuntimeError, PySparkException, Py4JJavaError)
#: Part of the training rows that early stopping watches, and the least gain that goes on.
VALIDATION, LEAST_GAIN = 0.1, 1e-4
SCORES = "subject long, tp long, fp long, fn long, tn long, accuracy double, f1 double, jaccard double, dice double, ppv double, npv double, error_ratio double, roc_auc double, model string, repeat int, fold int"


class Spec(NamedTuple):
    """A model to try: its name, its estimator given the number of training rows, neighbourhood radii, and what is done to the voxels before."""

    name: str
    estimator: Callable[[int], object]
    radius: tuple[int, int, int] = (0, 0, 0)
    prepare: Callable[[DataFrame], DataFrame] | None = None


def logistic(n: int) -> LogisticRegression:
    """L2 logistic regression with unit weight on the summed loss."""
    return LogisticRegression(featuresCol="vector", labelCol="label", regParam=1.0 / max(1, n), standardization=False, maxIter=50)


def boosted(rounds: int = 999, depth: int = 1, rate: float = 0.4, subsample: float = 0.79, early_stop: bool = True) -> Callable[[int], GBTClassifier]:
    """Boosted stumps; with early stopping a tenth of the training rows (by hash, column `validation`) is held out, and rounds end once they gain nothing on it."""

    def make(n: int) -> GBTClassifier:
        tree = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=subsample, seed=1)
        return tree.setParams(validationIndicatorCol="validation", validationTol=LEAST_GAIN) if early_stop else tree

    return make


def boosted_stumps(**rules: float) -> Callable[[int], G.BoostedStumps]:
    """Boosted stumps with regularised gain (`boosting.Rules`, of which any value can be given); ended after `patience` rounds that gain nothing on the held-out tenth."""
    chosen = [float(v) for v in G.Rules(**rules)]
    return lambda n: G.BoostedStumps(rules=chosen)


def features(df: DataFrame, channels: Sequence[str], radius: tuple[int, int, int], clinical: DataFrame | None = None, wanted: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """df's key, label, mask, the columns of `keep` and `features`: channels' values, with a radius those of the neighbourhood and at last the number of undefined neighbours; before it a subject's clinical columns.

    clinical: subject and number columns; subjects it lacks are left out. wanted: a 0/1 column; only its voxels get features,
    the others are neighbours only.
    """
    names = ["label", "mask", *keep]
    if any(radius):
        field = P.receptive_field(df, channels, radius, wanted, "mask")
        own = df if wanted is None else df.filter(F.col(wanted).cast("int") == 1)
        out, last = own.select(*KEY, *names).join(field, list(KEY)), F.array(F.col("undefined").cast("double"))
    else:
        own = df if wanted is None else df.filter(F.col(wanted).cast("int") == 1)
        out, last = own.select(*KEY, *names, F.array(*[F.col(c).cast("double") for c in channels]).alias("features")), F.array().cast("array<double>")
    parts = [F.col("features")]
    if clinical is not None:
        columns = [c for c in clinical.columns if c != "subject"]
        out = out.join(clinical.select("subject", F.array(*[F.col(c).cast("double") for c in columns]).alias("__clinical")), "subject")
        parts.append(F.col("__clinical"))
    return out.select(*KEY, *names, F.concat(*parts, last).alias("features"))


def vectors(df: DataFrame) -> DataFrame:
    """`features` as `vector`, and `validation`, true for a tenth of the rows by hash."""
    held = F.conv(F.substring(T.hash_order("validation", *KEY), 1, 6), 16, 10).cast("long") < int(VALIDATION * 16**6)
    return df.select(*[c for c in df.columns if c != "features"], array_to_vector("features").alias("vector"), held.alias("validation"))


def build_fold(df: DataFrame, folds: DataFrame, repeat: int, fold: int) -> DataFrame:
    """df's rows with `part`: balanced voxels of the other folds' subjects to train on, masked voxels of the fold's subjects to test."""
    mine = df.join(folds.filter(F.col("repeat") == repeat).select("subject", "fold"), "subject")
    train = T.undersample_negatives(mine.filter(F.col("fold") != fold), KEY)
    return train.withColumn("part", F.lit("train")).unionByName(mine.filter((F.col("fold") == fold) & (F.col("mask") == 1)).withColumn("part", F.lit("test"))).drop("fold")


def fit(train: DataFrame, spec: Spec) -> PipelineModel:
    """The spec's estimator on rows with `features` and label. ValueError without rows of both labels."""
    counts = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    if len(counts) < 2:
        raise ValueError("training rows of one class only")
    return Pipeline(stages=[spec.estimator(sum(counts.values()))]).fit(vectors(train))


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df's key, label, mask and `score`, 0 outside the mask."""
    p = vector_to_array("probability")[1]
    return model.transform(vectors(df)).select(*KEY, "label", "mask", F.when(F.col("mask") == 1, p).otherwise(0.0).alias("score"))


def save_and_predict(model: PipelineModel, df: DataFrame, folder: str) -> DataFrame:
    """The model written, read again and applied."""
    path = f"{folder}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    return predict(PipelineModel.load(path), df)


def fold_scores(scored: DataFrame, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """Metrics of each test image."""
    points = S.roc_points(scored, list(keys), y="label")
    return S.confusion_metrics(scored, list(keys), y="label").join(S.roc_auc(points, list(keys)), list(keys), "left")


def cross_validate(df: DataFrame, channels: Sequence[str], spec: Spec, k: int, repeats: int = 1, store: str | None = None, clinical: DataFrame | None = None, train_on: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Scores of every test image over k folds and repeats, and the number of folds that failed.

    Logistic regressions are fitted for all folds at once: the jobs don't grow with their number. Other estimators go fold
    by fold. Scores and parameters, for logistic regressions also weights, are published to `store` (a RunStore's folder, one of
    its own by default) as they come, each fold whole or not at all; a restart leaves out the folds that are in the store; a
    fold that fails is counted and skipped. `train_on`: subjects that only ever train, besides each
    fold's own.
    """
    spark = df.sparkSession
    runs = RunStore(spark, store or new_folder(spark))
    voxels = spec.prepare(df) if spec.prepare else df
    if clinical is not None:
        voxels = voxels.join(clinical.select("subject"), "subject", "left_semi")
    tested = voxels if train_on is None else voxels.join(train_on, "subject", "left_anti")
    folds, done = cut(T.subject_kfold(tested, k, repeats)), runs.parts()
    if train_on is not None:
        others = train_on.select("subject").distinct().withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("fold", F.lit(-1))
        folds = folds.unionByName(others)
    todo = [(repeat, fold) for repeat in range(repeats) for fold in range(k) if (spec.name, repeat, fold) not in done]
    run = _all_folds if spec.estimator is logistic else _fold_by_fold
    failed = run(voxels, channels, spec, folds, todo, runs, clinical) if todo else 0
    return runs.read("scores", SCORES).filter(F.col("model") == spec.name), failed


def run_params(spark: SparkSession, channels: Sequence[str], spec: Spec, parts: Sequence[tuple[int, int]]) -> DataFrame:
    """model, repeat, fold, radius and channels of the runs."""
    return spark.createDataFrame([(spec.name, r, f, list(spec.radius), list(channels)) for r, f in parts], "model string, repeat int, fold int, radius array<int>, channels array<string>")


def _fold_by_fold(voxels: DataFrame, channels: Sequence[str], spec: Spec, folds: DataFrame, todo: Sequence[tuple[int, int]], runs: RunStore, clinical: DataFrame | None) -> int:
    """The prepared features are written once; each fold is a Spark job over all its voxels."""
    prepared, failed = cut(features(voxels, channels, spec.radius, clinical)), 0
    for repeat, fold in todo:
        try:
            rows = build_fold(prepared, folds, repeat, fold)
            scores = fold_scores(predict(fit(rows.filter("part = 'train'").drop("part"), spec), rows.filter("part = 'test'").drop("part")))
            scores = scores.withColumns({"model": F.lit(spec.name), "repeat": F.lit(repeat), "fold": F.lit(fold)})
            runs.append([(spec.name, repeat, fold)], scores=scores, params=run_params(voxels.sparkSession, channels, spec, [(repeat, fold)]))
        except FAILURES:
            failed += 1
    return failed


def _all_folds(voxels: DataFrame, channels: Sequence[str], spec: Spec, folds: DataFrame, todo: Sequence[tuple[int, int]], runs: RunStore, clinical: DataFrame | None) -> int:
    """Training rows of all folds are chosen before their features are made; each Newton step is one scan for all folds; test voxels get features and scores on the fly."""
    spark = voxels.sparkSession
    models = F.broadcast(spark.createDataFrame([(m, r, f) for m, (r, f) in enumerate(todo)], "model int, repeat int, fold int"))
    placed = folds.withColumnRenamed("fold", "own").join(models, "repeat")
    sets = placed.filter("own <> fold").select("model", "subject")
    tests = placed.filter("own = fold").groupBy("subject").agg(F.collect_list("model").alias("tests"))
    weights, fitted = _fit_sets(voxels, channels, spec.radius, sets, len(todo), clinical)
    if not fitted.any():
        return len(todo)
    scored = _score_sets(voxels, channels, spec.radius, tests, weights, clinical, "mask").filter(F.col("model").isin([int(m) for m in np.flatnonzero(fitted)]))
    scores = fold_scores(scored.withColumnRenamed("model", "__model"), ("__model", "subject")).join(models.withColumnRenamed("model", "__model"), "__model").drop("__model")
    good = [part for part, ok in zip(todo, fitted, strict=True) if ok]
    kept = spark.createDataFrame([(spec.name, *todo[m], weights[m].tolist()) for m in np.flatnonzero(fitted)], "model string, repeat int, fold int, weights array<double>")
    runs.append([(spec.name, *part) for part in good], scores=scores.withColumn("model", F.lit(spec.name)), params=run_params(spark, channels, spec, good), models=kept)
    return int((~fitted).sum())


def _fit_sets(voxels: DataFrame, channels: Sequence[str], radius: tuple[int, int, int], sets: DataFrame, count: int, clinical: DataFrame | None) -> tuple[np.ndarray, np.ndarray]:
    """Weights of `count` models, each of the balanced voxels of its subjects (sets: model, subject), and which could be fitted. The chosen rows' features are written once and deleted after the fits."""
    with Scratch(voxels.sparkSession) as scratch:
        own = scratch.cut(sets)
        limits = scratch.cut(B.balanced_limits(voxels, own, KEY))
        chosen = B.members(voxels, own, limits, KEY).withColumn("__train", F.when(F.size("models") > 0, 1).otherwise(0))
        rows = scratch.cut(features(chosen, channels, radius, clinical, "__train", ("models",)))
        one = rows.select(F.size("features").alias("n")).first()
        return B.fit_logistics(rows, count, one["n"]) if one else (np.zeros((count, 1)), np.zeros(count, bool))


def _score_sets(voxels: DataFrame, channels: Sequence[str], radius: tuple[int, int, int], tests: DataFrame, weights: np.ndarray, clinical: DataFrame | None, wanted: str | None) -> DataFrame:
    """key, label, mask, model, score of each voxel by the models that test its subject (tests: subject, tests)."""
    return B.score_all(features(voxels, channels, radius, clinical, wanted).join(tests, "subject"), weights)


def sweep(df: DataFrame, channels: Sequence[str], specs: Sequence[Spec], k: int, store: str | None = None, clinical: DataFrame | None = None) -> DataFrame:
    """Cross-validated scores of several specifications, whatever can be run of them; resumable with a store."""
    store = store or new_folder(df.sparkSession)
    out = None
    for s in specs:
        scores = cross_validate(df, channels, s, k, store=store, clinical=clinical)[0]
        out = scores if out is None else out.unionByName(scores)
    return out


def radius_specs(name: str, estimator: Callable[[int], object], radii: Sequence[int], flat: bool = True) -> list[Spec]:
    """One specification for each neighbourhood radius, flat in z or cubic."""
    return [Spec(f"{name}_rf{r}", estimator, (r, r, 0 if flat else r)) for r in radii]


def kernel_specs(name: str, estimator: Callable[[int], object], widths: Sequence[int], channels: Sequence[str], shape: tuple[int, int, int], axes: str = "xy") -> list[Spec]:
    """One specification for each width of the smoothing kernel."""

    def smoothing(width: int) -> Callable[[DataFrame], DataFrame]:
        return lambda df: df.drop(*channels).join(P.gaussian_smooth(df, channels, shape, width, axes), list(KEY))

    return [Spec(f"{name}_k{w}", estimator, prepare=smoothing(w)) for w in widths]


def subgroup_runs(df: DataFrame, groups: DataFrame, channels: Sequence[str], spec: Spec, k: int, hold_out: bool = False, store: str | None = None) -> DataFrame:
    """Cross-validated scores of each subgroup's images with `grp`. groups: subject, grp (few distinct values).

    A subgroup is run on its own; with hold_out all subjects outside it train besides.
    """
    store, out = store or new_folder(df.sparkSession), None
    for r in groups.select("grp").distinct().orderBy("grp").collect():
        own = groups.filter(F.col("grp").eqNullSafe(F.lit(r["grp"]))).select("subject")
        named = spec._replace(name=f"{spec.name}/{r['grp']}{'/held out' if hold_out else ''}")
        if hold_out:
            scores, _ = cross_validate(df, channels, named, k, store=store, train_on=df.select("subject").distinct().join(own, "subject", "left_anti"))
        else:
            scores, _ = cross_validate(df.join(own, "subject", "left_semi"), channels, named, k, store=store)
        scores = scores.withColumn("grp", F.lit(r["grp"]))
        out = scores if out is None else out.unionByName(scores)
    return out


def leave_one_out(df: DataFrame, channels: Sequence[str], spec: Spec, most: int = 75) -> DataFrame:
    """key, label, mask, score of every subject's voxels, each scored by a logistic model of at most `most` other subjects (`statistics.leave_one_out`).

    All subjects' models are fitted together: a voxel trains the models of up to `most` subjects and is read once a step.
    Scores are 0 outside the mask, and null for a subject whose others have one class only.
    """
    if spec.estimator is not logistic:
        raise ValueError("models of all subjects at once are logistic")
    voxels = spec.prepare(df) if spec.prepare else df
    with Scratch(df.sparkSession) as scratch:
        numbered = scratch.cut(df.select("subject").distinct().withColumn("model", F.row_number().over(Window.orderBy("subject")) - 1))
        sets = numbered.join(T.leave_one_out(df, most), "subject").select("model", F.col("other").alias("subject"))
        count = numbered.count()
        if not count:
            return df.select(*KEY, "label", "mask", F.lit(0.0).alias("score"))
        weights, fitted = _fit_sets(voxels, channels, spec.radius, sets, count, None)
        tests = cut(numbered.select("subject", F.array("model").alias("tests")))
    ok = df.sparkSession.createDataFrame([(int(m),) for m in np.flatnonzero(~fitted)], "model int").withColumn("__bad", F.lit(True))
    if not fitted.any():
        return features(voxels, channels, spec.radius).select(*KEY, "label", "mask", F.lit(None).cast("double").alias("score"))
    scored = _score_sets(voxels, channels, spec.radius, tests, weights, None, None).join(ok, "model", "left")
    return scored.select(*KEY, "label", "mask", F.when(F.col("__bad").isNull(), F.col("score")).alias("score"))


class Range(NamedTuple):
    """Values of a parameter to draw from: a list, or two ends of a range."""

    name: str
    values: Sequence[float]
    whole: bool = False


#: Where searches over boosted trees draw from.
TREE_RANGES = (Range("depth", (1, 4), True), Range("rate", (0.05, 0.6)), Range("subsample", (0.5, 1.0)), Range("rounds", (20, 60), True))


def random_settings(ranges: Sequence[Range], n: int, seed: int) -> list[dict[str, float]]:
    """n random settings, the same for a seed; the first of a longer draw are those of a shorter one."""
    rng = random.Random(seed)
    return [{r.name: rng.randint(int(r.values[0]), int(r.values[1])) if r.whole else round(rng.uniform(*r.values), 4) for r in ranges} for _ in range(n)]


def param_search(df: DataFrame, channels: Sequence[str], n: int, k: int, store: str, seed: int = 1, ranges: Sequence[Range] = TREE_RANGES) -> DataFrame:
    """model, median_auc, settings, best first, of n random settings of boosted trees; a restart with the same store runs only what is missing."""
    drawn = random_settings(ranges, n, seed)
    specs = [Spec(f"draw{i}", boosted(int(s["rounds"]), int(s["depth"]), s["rate"], s["subsample"])) for i, s in enumerate(drawn)]
    scores = best_of(sweep(df, channels, specs, k, store=store))
    told = df.sparkSession.createDataFrame([(s.name, ",".join(f"{a}={b}" for a, b in sorted(d.items()))) for s, d in zip(specs, drawn, strict=True)], "model string, settings string")
    return scores.join(F.broadcast(told), "model").orderBy(F.desc("median_auc"), "model")


def best_of(scores: DataFrame) -> DataFrame:
    """model, median AUC, best first."""
    m = scores.groupBy("model").agg(F.percentile("roc_auc", F.lit(0.5)).alias("median_auc"))
    return m.orderBy(F.desc("median_auc"), "model")


def channel_importance(model: PipelineModel, spark: SparkSession, channels: Sequence[str], window: int) -> DataFrame:
    """channel, share: tree gain per channel, features that no tree uses counting 0."""
    gains = model.stages[-1].featureImportances.toArray()
    sums = [float(sum(gains[i * window : (i + 1) * window])) for i in range(len(channels))]
    total = sum(sums) or 1.0
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(c).alias("channel"), F.lit(s / total).alias("share")) for c, s in zip(channels, sums, strict=True)])))
