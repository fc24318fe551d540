"""Sharding by a hypergeometric communication matrix, in DataFrame functions only.

A uniform shuffle of N rows from B source buckets into S shards of fixed sizes sends, between bucket b and shard s, a
multivariate hypergeometric number of rows. Those counts are drawn first and exactly; then each bucket orders its rows at
random and cuts them at the drawn counts, the rows are exchanged, and each shard orders its rows at random again.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.llm.common import cut

#: Enough for 6.9e10 rows; the driver then draws 65,536 x shards counts.
MOST_BUCKETS = 65_536
ROWS_PER_BUCKET = 1 << 20


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """An exact draw by inversion outwards from the mode; about a standard deviation of steps."""
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    lg = math.lgamma
    choose = lambda n, k: lg(n + 1) - lg(k + 1) - lg(n - k + 1)
    p = math.exp(choose(good, mode) + choose(bad, drawn - mode) - choose(good + bad, drawn))
    u, up, down, p_up, p_down = rng.random() - p, mode, mode, p, p
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(sizes: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows of bucket b for shard s; bucket sums are `sizes`, shard sums differ by one at most."""
    rng = random.Random(seed)
    n = sum(sizes)
    room = [n // shards + (s < n % shards) for s in range(shards)]
    matrix = []
    for size in sizes:
        row, left, total = [], size, sum(room)
        for cap in room:
            total -= cap
            row.append(hypergeometric(rng, cap, total, left))
            left -= row[-1]
        room = [cap - x for cap, x in zip(room, row, strict=True)]
        matrix.append(row)
    return matrix


def hypergeometric_shards(df: DataFrame, key: list[str], shards: int = 40, seed: int = 17) -> DataFrame:
    """df with `shard` (0 to shards-1) and `slot` (gapless from 0 in a shard): a uniform shuffle with shard sizes at most one apart.

    `key` names the columns that tell rows apart; the result is a function of them, the seed and the row set, so a lost
    executor redraws nothing. Rows that repeat a whole key are told apart by an arbitrary order, which only swaps equal
    rows. Null keys count as empty strings. Columns named shard or slot are replaced. An empty table gives an empty result.
    The driver holds one count for each of up to 65,536 buckets of a million rows, and as many
    drawn counts for each shard.
    """
    random_by = lambda salt: F.xxhash64(F.lit(f"{seed}/{salt}"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key])
    rows, buckets = df.count(), 64
    while buckets < MOST_BUCKETS and rows > buckets * ROWS_PER_BUCKET:
        buckets *= 2
    bucket = F.pmod(random_by("bucket"), F.lit(buckets)).cast("int")
    sizes = [0] * buckets
    for r in df.select(bucket.alias("b")).groupBy("b").count().collect():
        sizes[r["b"]] = r["count"]
    ends = []
    for row in communication_matrix(sizes, shards, seed):
        sums, total = [], 0
        for x in row:
            total += x
            sums.append(total)
        ends.append(sums)
    drawn = df.sparkSession.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(ends)), "array<array<long>>")).alias("__bucket", "__ends"))

    order: list[Column] = [F.col("__first"), *[F.col(c) for c in key]]
    keyed = df.drop("shard", "slot").withColumns({"__bucket": bucket, "__first": random_by("first"), "__again": random_by("again")})
    placed = (
        keyed.withColumn("__place", F.row_number().over(Window.partitionBy("__bucket").orderBy(*order)) - 1)
        .join(F.broadcast(drawn), "__bucket")
        .withColumn("shard", F.size(F.filter("__ends", lambda e: e <= F.col("__place"))))
        .withColumn("__block", F.pmod("__again", F.lit(max(8, buckets // 8))).cast("int"))
        .drop("__bucket", "__first", "__ends", "__place")
    )
    placed = cut(placed)
    # A shard's second order: blocks in turn, each in random order; a row's block is random, so this is a uniform permutation.
    blocks = placed.groupBy("shard", "__block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("shard", "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    within = Window.partitionBy("shard", "__block").orderBy("__again", *key)
    return (
        placed.withColumn("__rank", F.row_number().over(within) - 1)
        .join(offsets, ["shard", "__block"])
        .withColumn("slot", F.col("__offset") + F.col("__rank"))
        .drop("__block", "__offset", "__again", "__rank")
    )


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 17) -> DataFrame:
    """Where each document goes, under the law `rows`: shard counts at most one apart. Texts stay behind; only sizes and checks move.

    Rows are told apart by doc_id, the text's check sum and its size, so that where a row goes doesn't hang on how the input was
    dealt; rows alike in all three change places only with each other.
    """
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = hypergeometric_shards(slim, ["doc_id", "text_crc32", "size"], shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
