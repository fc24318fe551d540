"""Boosted stumps on binned features: regularised gain, row samples by hash, and an end after rounds that gain nothing on held-out rows. One scan a round."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.sources.shared import Scratch

#: Bins of a feature, at most, and how far their edges may lie from the quantiles, as a share of the rows.
BINS, EDGE_ERROR = 256, 1 / 1024
#: Held-out scores closer than 1 / CELLS count as equal.
CELLS = 1 << 14
#: Gradients are summed as whole numbers of 1 / UNIT, so that sums don't depend on the order of rows or on tasks run twice.
UNIT = 1 << 24


class Rules(NamedTuple):
    """How stumps are chosen and weighted. Those of the published hyperparameter search."""

    rounds: int = 999
    patience: int = 30
    rate: float = 0.4
    gamma: float = 0.84
    alpha: float = 0.8671463346569078
    lambda_: float = 0.5916603334004378
    least_weight: float = 10.0
    subsample: float = 0.7925462136041614


class Stump(NamedTuple):
    """Adds `left` where the feature is at most the threshold, else (also where it is not a number) `right`; feature -1 adds `right` everywhere."""

    feature: int
    threshold: float
    left: float
    right: float
    gain: float


def in_sample(h: np.ndarray, round_: int, share: float) -> np.ndarray:
    """Which rows, given their 64-bit hashes, a round samples."""
    x = h.astype(np.uint64) + np.uint64((round_ + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) < np.uint64(share * 2**53)


def best_stump(g: np.ndarray, h: np.ndarray, edges: list[np.ndarray], rules: Rules) -> Stump:
    """The stump of the greatest regularised gain, given the sums of gradients and Hessians by feature and bin; of equal ones the first feature and threshold. Without one that gains `gamma` a single leaf."""

    def shrunk(x: np.ndarray) -> np.ndarray:
        return np.sign(x) * np.maximum(np.abs(x) - rules.alpha, 0)

    total_g, total_h = g[0].sum(), h[0].sum()
    left_g, left_h = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    right_g, right_h = total_g - left_g, total_h - left_h
    worth = lambda x, w: shrunk(x) ** 2 / np.maximum(w + rules.lambda_, 1e-300)
    weight = lambda x, w: float(-rules.rate * shrunk(x) / max(w + rules.lambda_, 1e-300))
    gain = worth(left_g, left_h) + worth(right_g, right_h) - worth(total_g, total_h)
    usable = (left_h >= rules.least_weight) & (right_h >= rules.least_weight)
    usable &= np.arange(gain.shape[1]) < np.array([len(e) for e in edges])[:, None]
    gain = np.where(usable, gain, -np.inf)
    f, b = np.unravel_index(np.argmax(gain), gain.shape)
    if not gain[f, b] >= max(rules.gamma, 1e-12):
        leaf = weight(total_g, total_h)
        return Stump(-1, 0.0, leaf, leaf, 0.0)
    return Stump(int(f), float(edges[f][b]), weight(left_g[f, b], left_h[f, b]), weight(right_g[f, b], right_h[f, b]), float(gain[f, b]))


def auc(negatives: np.ndarray, positives: np.ndarray) -> float:
    """Area under the ROC curve from the numbers of rows by ascending score; 0 if a class is missing."""
    pairs = float(negatives.sum()) * float(positives.sum())
    return float((positives * (np.cumsum(negatives) - negatives / 2)).sum()) / pairs if pairs else 0.0


def bin_edges(rows: DataFrame, width: int) -> list[np.ndarray]:
    """Upper edges of each feature's bins but the last: its quantiles, ascending and distinct. One job for all features; what is not a number has no part in it."""
    shares = [(k + 1) / BINS for k in range(BINS - 1)]
    columns = rows.select(*[F.col("x")[k].alias(f"x{k}") for k in range(width)])
    return [np.unique(np.array(q, float)) for q in columns.approxQuantile(columns.columns, shares, EDGE_ERROR)]


def binned(rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """bins (a byte a feature), label, h, held of rows with x (numbers), label, h, held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            b = np.column_stack([np.searchsorted(e, x[:, k]) for k, e in enumerate(edges)]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in b], pa.binary()), *batch.columns[1:]], names=["bins", "label", "h", "held"])

    return rows.select("x", F.col("label").cast("int"), "h", "held").mapInArrow(run, "bins binary, label int, h long, held boolean")


def _scan(rows: DataFrame, table: np.ndarray, base: float, round_: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of gradients and of Hessians by feature and bin over the round's sample, and numbers of held-out rows by score and label.

    Stumps add up to one value for each feature and bin, so a row costs the same after any number of rounds. Tasks hand on
    at most a row for each bin and each of the CELLS scores.
    """
    width = len(table)
    at = np.arange(width) * BINS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(width * BINS + CELLS), np.zeros(width * BINS + CELLS)
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, width) + at
            y, held = batch.column(1).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            p = 1 / (1 + np.exp(-np.clip(base + table.ravel()[cell].sum(axis=1), -500, 500)))
            own = ~held & in_sample(batch.column(2).to_numpy(), round_, share)
            flat = cell[own].ravel()
            for sums, value in ((a, p - y), (b, p * (1 - p))):
                sums[: width * BINS] += np.bincount(flat, np.repeat(np.rint(value[own] * UNIT), width), width * BINS)
            score = width * BINS + np.minimum((p[held] * CELLS).astype(int), CELLS - 1)
            for sums, label in ((a, 0), (b, 1)):
                sums += np.bincount(score[y[held] == label], minlength=len(sums))
        some = np.flatnonzero((a != 0) | (b != 0))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(a[some].astype(np.int64)), pa.array(b[some].astype(np.int64))], names=["cell", "a", "b"])

    got = rows.mapInArrow(run, "cell int, a long, b long").groupBy("cell").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()
    sums = np.zeros((2, width * BINS + CELLS))
    sums[:, got["cell"].to_numpy()] = got["a"].to_numpy(), got["b"].to_numpy()
    g, h = sums[:, : width * BINS].reshape(2, width, BINS) / UNIT
    return g, h, sums[:, width * BINS :]


def boost(rows: DataFrame, edges: list[np.ndarray], rules: Rules) -> tuple[list[Stump], list[float]]:
    """The stumps up to the first best round on the held-out rows, and the held-out area after each round made. Without held-out rows of both labels all rounds are made and kept."""
    table, base = np.zeros((len(edges), BINS)), 0.0
    stumps: list[Stump] = []
    areas: list[float] = []
    best, judged = 0, True
    for round_ in range(rules.rounds + 1):
        g, h, held = _scan(rows, table, base, round_, rules.subsample)
        judged = bool(held[0].any() and held[1].any())
        if round_:
            areas.append(auc(*held))
            best = round_ if round_ == 1 or areas[-1] > areas[best - 1] else best
            if judged and round_ - best >= rules.patience:
                break
        if round_ == rules.rounds:
            break
        s = best_stump(g, h, edges, rules)
        stumps.append(s)
        if s.feature < 0:
            base += s.right
        else:
            k = int(np.searchsorted(edges[s.feature], s.threshold)) + 1
            table[s.feature, :k] += s.left
            table[s.feature, k:] += s.right
    return (stumps[:best] if judged else stumps), areas


class BoostedStumps(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted stumps for a 0/1 `label` on `vector`; rows with `validation` true, where the column is there, are held out to tell when to end.

    A round samples rows by a hash of all columns but the vector: the same rows whatever the partitions; rows equal in those
    columns go together. What is not a number in a feature goes to a stump's right side. An empty table gives no stumps, score
    0.5; constant features and labels of one class only leaves.
    """

    rules = Param(Params._dummy(), "rules", "values of Rules, in order", typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, rules: list[float] | None = None) -> None:
        super().__init__()
        self._setDefault(rules=[float(v) for v in Rules()])
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> BoostedStumpsModel:
        values = self.getOrDefault(self.rules)
        rules = Rules(int(values[0]), int(values[1]), *values[2:])
        names = [c for c in dataset.columns if c != "vector"]
        held = F.coalesce(F.col("validation"), F.lit(False)) if "validation" in names else F.lit(False)
        with Scratch(dataset.sparkSession) as scratch:
            rows = scratch.cut(dataset.select(vector_to_array("vector").alias("x"), "label", F.xxhash64(*names).alias("h"), held.alias("held")))
            first = rows.select(F.size("x").alias("n")).first()
            width = first["n"] if first else 0
            stumps, areas = [], []
            if width:
                edges = bin_edges(rows.filter("NOT held"), width)
                stumps, areas = boost(scratch.cut(binned(rows, edges)), edges, rules)
        return BoostedStumpsModel(stumps=[float(v) for s in stumps for v in s], width=width, areas=areas)


class BoostedStumpsModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds `probability`, the two labels' probabilities, to rows with `vector`."""

    stumps = Param(Params._dummy(), "stumps", "the values of all stumps, one stump after the other", typeConverter=TypeConverters.toListFloat)
    width = Param(Params._dummy(), "width", "number of features", typeConverter=TypeConverters.toInt)
    areas = Param(Params._dummy(), "areas", "held-out area under the ROC curve after each round made", typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, stumps: list[float] | None = None, width: int = 0, areas: list[float] | None = None) -> None:
        super().__init__()
        self._setDefault(stumps=[], width=0, areas=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def all_stumps(self) -> list[Stump]:
        v = self.getOrDefault(self.stumps)
        return [Stump(int(v[k]), *v[k + 1 : k + 5]) for k in range(0, len(v), 5)]

    @property
    def getNumTrees(self) -> int:  # noqa: N802, the name that Spark's boosted trees have
        return len(self.all_stumps())

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        """Each feature's share of all stumps' gain."""
        gains = np.zeros(self.getOrDefault(self.width))
        for s in self.all_stumps():
            if s.feature >= 0:
                gains[s.feature] += s.gain
        return Vectors.dense(gains / (gains.sum() or 1.0))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        told = json.dumps([{"f": s.feature, "t": s.threshold, "l": s.left, "r": s.right} for s in self.all_stumps()])
        all_ = F.from_json(F.lit(told), "array<struct<f:int,t:double,l:double,r:double>>")
        x = vector_to_array("vector")
        with_ = dataset.withColumn("__x", x)
        margin = F.aggregate(all_, F.lit(0.0), lambda sum_, s: sum_ + F.when((s["f"] >= 0) & (F.get("__x", s["f"]) <= s["t"]), s["l"]).otherwise(s["r"]))
        p = 1 / (1 + F.exp(-margin))
        return with_.withColumn("__p", p).withColumn("probability", array_to_vector(F.array(1 - F.col("__p"), F.col("__p")))).drop("__x", "__p")
