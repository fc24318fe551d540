"""Many logistic fits at once: balanced training sets of all models by one narrowing of hash ranges, Newton steps of all models in one scan, scores of all models in one pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.operators.statistics import hash_order
from voxframe.operators.tiles import KEY

#: Bytes of normal equations that a task holds, and that come to the driver, at once: models beyond are fitted after the others.
MATRIX_BYTES = 1 << 26
STEPS, CLOSE = 50, 1e-10
#: Rows that a task's partial sums are added up by, before all of a model's are.
PARTS = 16


def _digit(h: Column, k: int) -> Column:
    """The k-th two hexadecimal digits of a hash, as a number."""
    return F.conv(F.substring(h, 2 * k + 1, 2), 16, 10).cast("int")


def balanced_limits(df: DataFrame, sets: DataFrame, keys: Sequence[str], seed: str = "1") -> DataFrame:
    """model, most: of each model's training subjects (sets: model, subject) as many masked negatives as positives are those whose hash is at most `most`; without a limit (fewer negatives than that) it is `g`, after all hashes. Models without positives are left out.

    The same rows as undersample_negatives takes for one model. Hashes are counted by their first two digits for each
    subject and summed for the models, then by the next two within the range that the number falls into, and only the
    last range, one row in 65,536, is ranked.
    """
    rows = df.filter((F.col("label") == 1) | ((F.col("label") == 0) & (F.col("mask") == 1))).select("subject", (F.col("label") == 1).alias("up"), hash_order(seed, *keys).alias("h"))
    want = rows.filter("up").groupBy("subject").agg(F.count("*").alias("n")).join(sets, "subject").groupBy("model").agg(F.sum("n").alias("left"))
    negatives, range_, every = rows.filter("NOT up").select("subject", "h"), [], want.select("model")
    for k in (0, 1):
        digit = f"d{k}"
        if not k:
            counts = negatives.groupBy("subject", _digit(F.col("h"), 0).alias(digit)).agg(F.count("*").alias("n")).join(sets, "subject").groupBy("model", digit).agg(F.sum("n").alias("n"))
        else:
            near = negatives.withColumn("d0", _digit(F.col("h"), 0)).join(sets.join(want, "model").select("model", "subject", "d0"), ["subject", "d0"])
            counts = near.groupBy("model", "d0", _digit(F.col("h"), 1).alias(digit)).agg(F.count("*").alias("n"))
        below = F.coalesce(F.sum("n").over(Window.partitionBy("model").orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        hit = counts.withColumn("below", below).join(want, ["model", *range_]).filter((F.col("below") < F.col("left")) & (F.col("below") + F.col("n") >= F.col("left")))
        found = hit.select("model", *range_, digit, (F.col("left") - F.col("below")).alias("left"))
        want, range_ = found, [*range_, digit]
    last = negatives.withColumns({"d0": _digit(F.col("h"), 0), "d1": _digit(F.col("h"), 1)}).join(sets.join(want, "model").select("model", "subject", "d0", "d1", "left"), ["subject", "d0", "d1"])
    ranked = last.withColumn("r", F.row_number().over(Window.partitionBy("model").orderBy("h"))).filter(F.col("r") == F.col("left"))
    return every.join(ranked.select("model", F.col("h").alias("most")), "model", "left").select("model", F.coalesce("most", F.lit("g")).alias("most"))


def members(df: DataFrame, sets: DataFrame, limits: DataFrame, keys: Sequence[str], seed: str = "1") -> DataFrame:
    """df with `models`, the models that each row trains (positives everywhere, masked negatives up to the model's limit). A subject trains a bounded number of models: all but those that test it, or those whose stretch holds it."""
    own = sets.join(limits, "model").groupBy("subject").agg(F.collect_list(F.struct("model", "most")).alias("__sets"))
    up, down = F.col("label") == 1, (F.col("label") == 0) & (F.col("mask") == 1)
    keyed = df.join(own, "subject", "left").withColumn("__h", F.when(down, hash_order(seed, *keys)))
    chosen = F.filter(F.coalesce("__sets", F.array().cast("array<struct<model:int,most:string>>")), lambda s: up | F.coalesce(F.col("__h") <= s["most"], F.lit(False)))
    return keyed.withColumn("models", F.transform(chosen, lambda s: s["model"])).drop("__sets", "__h")


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix, with a last column of ones."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.column_stack((flat.reshape(n, -1), np.ones(n)))


def _sigmoid(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -500, 500)))


def _sums(rows: DataFrame, weights: np.ndarray, first: int) -> dict[int, np.ndarray]:
    """For each model from `first` on (a row of weights each) its loss, numbers of rows of both labels, gradient and Hessian over its rows, as one array: partial sums by task, then added up."""
    count, d = weights.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _matrix(batch.column(0)), batch.column(1).to_numpy().astype(float)
            lists = batch.column(2)
            model, row = lists.flatten().to_numpy(), lists.value_parent_indices().to_numpy()
            order = np.argsort(model, kind="stable")
            edges = np.flatnonzero(np.diff(model[order], prepend=-1))
            for s, e in zip(edges, np.append(edges[1:], len(order)), strict=True):
                m = int(model[order[s]]) - first
                if not 0 <= m < count:
                    continue
                a, b = x[row[order[s:e]]], y[row[order[s:e]]]
                t = a @ weights[m]
                p = _sigmoid(t)
                loss = np.logaddexp(0, t).sum() - b @ t
                one = np.concatenate(([loss, len(b) - b.sum(), b.sum()], a.T @ (p - b), ((a * (p * (1 - p))[:, None]).T @ a).ravel()))
                sums[m] = sums[m] + one if m in sums else one
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([int(abs(v[0]) * 1e6) % PARTS for v in sums.values()], pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["m", "part", "sums"])

    def added(t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(b, np.float64) for b in sorted(t["sums"].to_pylist())], axis=0)
        return pa.table({"m": t["m"].slice(0, 1), "part": t["part"].slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "m int, part int, sums binary"
    parts = rows.select("features", "label", "models").mapInArrow(partial, schema).groupBy("m", "part").applyInArrow(added, schema).groupBy("m").applyInArrow(added, schema)
    return {r["m"]: np.frombuffer(r["sums"], np.float64) for r in parts.collect()}


def fit_logistics(rows: DataFrame, models: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (the intercept last) of `models` logistic regressions with unit L2 weight on the summed loss and a free intercept, and which of them could be fitted.

    rows: features (`width` numbers), label, models (numbers from 0). Each step is one scan of the rows for all models that
    are not done; a step that makes a model's loss larger is halved. A model without rows of both labels is not fitted.
    """
    d = width + 1
    weights, fitted = np.zeros((models, d)), np.zeros(models, bool)
    at_once = max(1, MATRIX_BYTES // (8 * (d * d + d + 3)))
    penalty = np.append(np.ones(width), 0.0)
    for first in range(0, models, at_once):
        last = min(models, first + at_once)
        now, best, step = np.zeros((last - first, d)), np.full(last - first, np.inf), np.zeros((last - first, d))
        going = np.ones(last - first, bool)
        for _ in range(STEPS):
            sums = _sums(rows, now, first)
            for m in np.flatnonzero(going):
                s = sums.get(int(m))
                if s is None or min(s[1], s[2]) == 0:
                    going[m] = False
                    continue
                fitted[first + m] = True
                loss = s[0] + 0.5 * (penalty * now[m] ** 2).sum()
                if loss > best[m] + 1e-9 * abs(best[m]):
                    step[m] /= 2
                    now[m] -= step[m]
                    going[m] = np.abs(step[m]).max() > CLOSE
                    continue
                best[m] = loss
                gradient, hessian = s[3 : 3 + d] + penalty * now[m], s[3 + d :].reshape(d, d) + np.diag(penalty)
                step[m] = -np.linalg.lstsq(hessian, gradient, rcond=None)[0]
                now[m] += step[m]
                going[m] = np.abs(step[m]).max() > CLOSE * (1 + np.abs(now[m]).max())
            if not going.any():
                break
        weights[first:last] = now
    return weights, fitted


def score_all(rows: DataFrame, weights: np.ndarray, keep: Sequence[str] = ("label", "mask")) -> DataFrame:
    """key, the columns of `keep`, model, score: each row scored by every model in its list `tests`, 0 outside the mask."""
    names = [*KEY, *keep]
    own = rows.select(*names, "features", "tests")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(len(names) + 1)
            model, row = lists.flatten().to_numpy(), lists.value_parent_indices().to_numpy()
            x = _matrix(batch.column(len(names)))
            score = _sigmoid((x[row] * weights[model]).sum(axis=1))
            mask = batch.column(names.index("mask")).to_numpy(zero_copy_only=False)[row] == 1
            taken = pa.Table.from_batches([batch.select(names)]).take(pa.array(row)).combine_chunks()
            yield from pa.table([*taken.columns, pa.array(model, pa.int32()), pa.array(np.where(mask, score, 0.0))], names=[*names, "model", "score"]).to_batches()

    kinds = dict(own.dtypes)
    return own.mapInArrow(run, ", ".join([*[f"{n} {kinds[n]}" for n in names], "model int, score double"]))
