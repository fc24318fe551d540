"""Exact quantiles of columns over all rows, without a map of all values in one task."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 4096


def order_statistics_of(df: DataFrame, wanted: Mapping[str, Sequence[int]]) -> dict[str, dict[int, float]]:
    """For each column the values at the given ranks (from 0, ascending) of its values that are neither null nor NaN; none where it has no values. Ranks beyond the values are an error.

    Each round is one scan for all columns and ranks: it counts the values of the bins that a wanted rank can lie in, with
    partial sums per task; the driver sees at most 4096 counts for each open rank. A bin is narrowed to the values that occur
    in it, so ties of any number end the search at once.
    """
    columns = list(wanted)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)]))
    values = df.select(each.alias("x")).select("x.c", "x.v").filter("v IS NOT NULL AND NOT isnan(v)")
    spans = {r["c"]: (r["low"], r["high"]) for r in values.groupBy("c").agg(F.min("v").alias("low"), F.max("v").alias("high")).collect()}
    todo = {(i, r): (*spans[i], r) for i, c in enumerate(columns) if i in spans for r in set(wanted[c])}  # column, rank: range of values it lies in, rank within the range
    found: dict[str, dict[int, float]] = {c: {} for c in columns}
    while todo:
        for (i, r), (low, high, _) in list(todo.items()):
            if low == high:
                found[columns[i]][r] = low
                del todo[i, r]
        ranges = sorted({(i, low, high) for (i, _), (low, high, _) in todo.items()})
        if not ranges:
            break
        # Where infinities or neighbouring numbers leave no room for bins, the two ends are counted apart from the rest.
        bin_ = F.lit(None).cast("struct<k:int,b:bigint>")
        for k, (i, low, high) in enumerate(ranges):
            width = (high - low) / BINS
            plain = math.isfinite(width) and low + width > low
            place = F.least(F.floor((F.col("v") - low) / F.lit(width)), F.lit(BINS - 1)) if plain else F.when(F.col("v") == low, 0).when(F.col("v") == high, 2).otherwise(1)
            bin_ = F.when((F.col("c") == i) & F.col("v").between(low, high), F.struct(F.lit(k).alias("k"), place.cast("long").alias("b"))).otherwise(bin_)
        rows = values.withColumn("bin", bin_).filter("bin IS NOT NULL").groupBy("bin.k", "bin.b").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        bins: dict[tuple, list] = {r: [] for r in ranges}
        for x in rows.collect():
            bins[ranges[x["k"]]].append((x["b"], x["n"], x["low"], x["high"]))
        for (i, r), (low, high, within) in list(todo.items()):
            for _, n, a, b in sorted(bins[i, low, high]):
                if within < n:
                    todo[i, r] = (a, b, within)
                    break
                within -= n
            else:
                raise ValueError(f"{columns[i]} has no value of rank {r}")
    return found


def order_statistics(df: DataFrame, column: str, ranks: Sequence[int]) -> dict[int, float]:
    """The values of one column at the given ranks, as order_statistics_of finds them."""
    return order_statistics_of(df, {column: ranks})[column]


def exact_quantiles_of(df: DataFrame, wanted: Mapping[str, Sequence[float]]) -> dict[str, list[float | None]]:
    """For each column quantiles over all rows, between two values by their distance; null without values. Equal to `percentile`, which keeps every distinct value in one task."""
    usable = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    counts = df.agg(*[F.count(F.when(usable(c), 1)).alias(c) for c in wanted]).first()
    at = {c: [q * (counts[c] - 1) for q in shares] for c, shares in wanted.items() if counts[c]}
    known = order_statistics_of(df, {c: [k for p in places for k in (math.floor(p), math.ceil(p))] for c, places in at.items()}) if at else {}

    def value(c: str, p: float) -> float:
        low, high = math.floor(p), math.ceil(p)
        return known[c][low] if p == low else (high - p) * known[c][low] + (p - low) * known[c][high]

    return {c: [value(c, p) for p in at[c]] if c in at else [None] * len(shares) for c, shares in wanted.items()}


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """Quantiles of one column, as exact_quantiles_of finds them."""
    return exact_quantiles_of(df, {column: shares})[column]
