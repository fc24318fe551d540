"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import unit_hash

SEED = "mix-1"
TEMPERATURE = 0.7
#: Sources up to which their table of rates is broadcast (under 10 MB); more are joined by shuffling, each in SALTS parts.
BROADCAST_SOURCES = 10_000
SALTS = 32


def rates(docs: DataFrame, source: str, weights: dict[str, float] | None, temperature: float, total: float | None) -> tuple[DataFrame, int]:
    """Per source with a positive one its mean repetition rate and the Poisson distribution for it. Weights are the given ones (unnamed sources get 0) or rows ** temperature; the expected number of rows out is `total`, as many as come in by default. Also the number of parts (`__part`) that the table is copied into."""
    counts = docs.groupBy(F.col(source).alias("__source")).agg(F.count("*").alias("__rows"))
    if weights is None:
        weight = F.pow(F.col("__rows").cast("double"), F.lit(temperature))
    else:
        named = F.from_json(F.lit(json.dumps({str(k): float(w) for k, w in weights.items() if k is not None})), "map<string,double>")
        weight = F.coalesce(F.when(F.col("__source").isNull(), F.lit(float(weights.get(None, 0.0)))).otherwise(F.element_at(named, F.col("__source").cast("string"))), F.lit(0.0))
    weighted = counts.withColumn("__weight", weight)
    sums = weighted.agg(F.sum("__weight").alias("w"), F.sum("__rows").alias("n"), F.count("*").alias("sources")).first()
    share = (sums["n"] or 0) if total is None else total
    table = weighted.select("__source", (F.lit(float(share)) * F.col("__weight") / F.lit(float(sums["w"] or 1.0)) / F.col("__rows")).alias("__rate"))
    table = table.filter("__rate > 0").withColumn("__cdf", poisson_cdf(F.col("__rate")))
    if sums["sources"] <= BROADCAST_SOURCES:
        return F.broadcast(table.withColumn("__part", F.lit(0))), 1
    return table.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), SALTS


def poisson_cdf(rate: F.Column) -> F.Column:
    """P(X <= k) for k = 0, 1, ... far into the tail, summed from logarithms so that large rates don't underflow."""
    top = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc: F.Column, k: F.Column) -> F.Column:
        log_p = acc["log_p"] + F.ln(rate) - F.ln(k.cast("double"))
        return F.struct(log_p.alias("log_p"), (acc["sum"] + F.exp(log_p)).alias("sum"), F.concat(acc["cdf"], F.array(acc["sum"] + F.exp(log_p))).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), top), start, step, lambda acc: acc["cdf"])


def poisson_mix(docs: DataFrame, source: str = "source", key: str = "doc_id", weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, total: float | None = None, seed: str = SEED) -> DataFrame:
    """Each row repeated a Poisson number of times with its source's mean rate, in globally random order, with `copy` (from 1) and `shuffle_key`.

    The count inverts the Poisson distribution at a number hashed from seed and key: a rerun gives the same rows, and rows
    that repeat a key share a count. A null source is a source of its own, a null key hashes as empty. A source of rate 0 or
    an empty table gives no rows. Columns named copy or shuffle_key are replaced. A hot source costs nothing special: its
    rows meet one broadcast row, or beyond 10,000 sources one of 32 copies of it, and copies go to random places.
    """
    table, parts = rates(docs, source, weights, temperature, total)
    drawn = docs.drop("copy", "shuffle_key").withColumns({"__u": unit_hash(seed, F.col(key)), "__row": F.pmod(F.xxhash64(F.col(key), F.monotonically_increasing_id()), F.lit(parts)).cast("int")})
    joined = drawn.join(table, F.col(source).eqNullSafe(F.col("__source")) & (F.col("__row") == F.col("__part")))
    counted = joined.withColumn("__n", F.size(F.filter("__cdf", lambda c: c <= F.col("__u"))))
    copies = counted.filter("__n > 0").drop("__source", "__rate", "__cdf", "__u", "__row", "__part").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n")
    place = F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit("place"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("copy").cast("string"))), 1, 16)
    return copies.withColumn("shuffle_key", place).repartition("shuffle_key").sortWithinPartitions("shuffle_key")


ORACLE_SQL = f"""
WITH c AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {TEMPERATURE}) AS w FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM c)::DOUBLE * w / (SELECT sum(w) FROM c) / n AS rate FROM c),
k AS (SELECT source, rate, unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT)) AS k FROM r),
p AS (SELECT source, k, exp(-rate + sum(CASE WHEN k = 0 THEN 0 ELSE ln(rate) - ln(k) END) OVER (PARTITION BY source ORDER BY k)) AS p FROM k),
cdf AS (SELECT source, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
f AS (SELECT source, list(cdf ORDER BY cdf) AS cdfs FROM cdf GROUP BY source),
u AS (SELECT *, (('0x' || substr(md5('{SEED}|' || doc_id::VARCHAR), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0 AS u FROM documents),
m AS (SELECT u.*, len(list_filter(f.cdfs, lambda x: x <= u.u)) AS m FROM u JOIN f ON u.source IS NOT DISTINCT FROM f.source),
e AS (SELECT *, unnest(generate_series(1, m)) AS copy FROM m WHERE m > 0)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy, substr(md5('{SEED}|place|' || doc_id::VARCHAR || '|' || copy::VARCHAR), 1, 16) AS shuffle_key FROM e
"""
