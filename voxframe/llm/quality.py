"""Quality classification by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import cut, unit_hash
from voxframe.llm.text import grams, slices, tokens
from voxframe.operators.quantiles import order_statistics

BUCKETS = 1 << 16
SMOOTHING = 32.0
MAX_LABELLED = 20_000
SEED = "quality-1"


class Model(NamedTuple):
    log_ratio: np.ndarray  #: per hash bucket, log of target over raw probability
    threshold: float  #: log weight that parts held-out labelled target documents from the others best


def buckets_of(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the single tokens and pairs of the texts, marks included, and their texts; a token that follows itself is one kind of pair, whatever the token."""
    t = tokens(texts)
    pairs, owner = grams(t.hash, t.doc, 2)
    again = (t.hash[1:] == t.hash[:-1])[t.doc[1:] == t.doc[:-1]]
    pairs = np.where(again, np.uint64(1), pairs)
    return (np.concatenate((t.hash, pairs)) % np.uint64(buckets)).astype(np.int64), np.concatenate((t.doc, owner))


def labelled_sample(labels: DataFrame, most: int) -> DataFrame:
    """At most `most` labelled doc_ids, chosen by hash, half of them held out of the target model; of contradicting labels the lower counts."""
    one = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("__y"))
    few = one.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(most).withColumnRenamed("doc_id", "__id")
    return few.withColumn("__out", F.xxhash64(F.lit(f"{SEED}/half"), "__id") % 2 == 0)


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, most: int = MAX_LABELLED) -> Model:
    """The raw model counts every document; the target model counts the sampled ones of quality 1 that aren't held out. Both are smoothed towards the raw one.

    The threshold parts the held-out ones. The bound `most` on labelled rows makes the broadcast of their ids safe. With no
    held-out document of one of the two labels the threshold is minus infinity, so that nothing is rejected without evidence.
    """
    sample = F.broadcast(labelled_sample(labels, most))
    marked = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(sample, F.col("doc_id") == F.col("__id"), "left")

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, buckets), np.int64)
        for batch in it:
            texts, good = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), bool)
            for s in slices([len(t) for t in texts]):
                bucket, doc = buckets_of(texts[s], buckets)
                sums[0] += np.bincount(bucket, minlength=buckets)
                sums[1] += np.bincount(bucket[good[s][doc]], minlength=buckets)
        there = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_pydict({"bucket": there.astype(np.int32), "raw": sums[0, there], "target": sums[1, there]})

    counted = marked.select("text", F.coalesce((F.col("__y") == 1) & ~F.col("__out"), F.lit(False))).mapInArrow(count, "bucket int, raw long, target long")
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    expected = raw * (target.sum() / max(1.0, raw.sum()))
    model = Model(np.log((target + SMOOTHING) / (expected + SMOOTHING)), -np.inf)
    # One score for each held-out id, however often it is repeated: at most `most` come to the driver.
    scored = weigh(docs.join(sample, F.col("doc_id") == F.col("__id")).filter("__out").select("text", F.lit(0).alias("doc_id"), "__id", "__y"), model)
    known = np.array([(r["log_weight"], r["__y"] == 1) for r in scored.groupBy("__id", "__y").agg(F.max("log_weight").alias("log_weight")).collect()], float).reshape(-1, 2)
    return model._replace(threshold=best_threshold(known[:, 0], known[:, 1] > 0))


def best_threshold(score: np.ndarray, good: np.ndarray) -> float:
    """The cut with the highest true minus false positive rate, amid the widest gap where several are as good."""
    if good.all() or not good.any():
        return -np.inf
    order = np.argsort(score)
    score, good = score[order], good[order]
    gain = np.cumsum(~good) / (~good).sum() - np.cumsum(good) / good.sum()
    gap = np.append(score[1:] - score[:-1], 0)
    k = max(np.flatnonzero(gap > 0), key=lambda i: (round(gain[i], 12), gap[i]), default=None)
    return -np.inf if k is None else float(score[k] + score[k + 1]) / 2


def weigh(docs: DataFrame, model: Model) -> DataFrame:
    """docs with `log_weight`, the log of target over raw probability of all the text's n-grams; null and empty texts get 0."""
    ratio, buckets = model.log_ratio, len(model.log_ratio)

    @F.pandas_udf("double")
    def log_weight(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts))
        values = texts.tolist()
        for s in slices([len(t) for t in values]):
            bucket, doc = buckets_of(values[s], buckets)
            out[s] = np.bincount(doc, ratio[bucket], minlength=s.stop - s.start)
        return pd.Series(out)

    return docs.withColumn("log_weight", log_weight(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def resample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", seed: str = SEED, k: int | None = None) -> DataFrame:
    """The k documents that importance resampling keeps, with `log_weight` and `gumbel_key`; columns of these names are replaced.

    Standard Gumbel noise hashed from the key makes the k largest sums a sample without replacement in proportion to the
    weights. Without `k` it is the number of documents whose log weight reaches the threshold that parts held-out labels.
    Documents that share the last sum all stay. Null, empty and wordless texts carry no evidence and are rejected. Rows that
    repeat a key and text share their fate. An empty table gives an empty one.
    """
    model = fit(docs, labels)
    noise = -F.log(-F.log(F.greatest(unit_hash(seed, F.col(key)), F.lit(2.0**-53))))
    usable = docs.drop("log_weight", "gumbel_key").filter(F.col("text").rlike(r"[\p{L}\p{N}]"))
    weighed = weigh(usable, model).withColumn("gumbel_key", F.col("log_weight") + noise)
    keys = cut(weighed.select("log_weight", "gumbel_key"))
    n = keys.agg(F.count("*").alias("n"), F.count_if(F.col("log_weight") >= model.threshold).alias("k")).first()
    k = min(n["n"], n["k"] if k is None else k)
    if k <= 0:
        return weighed.filter("false")
    return weighed.filter(F.col("gumbel_key") >= order_statistics(keys, "gumbel_key", [n["n"] - k])[n["n"] - k])
