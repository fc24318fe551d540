"""Queries of normalisation, masks and volumes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe import carriers as C
from voxframe.carriers import with_views as W
from voxframe.functions import voxel as V
from voxframe.operators import normalise as N
from voxframe.operators import reports as E
from voxframe.plans.registry import query, rounded

KEY = ("subject", "x", "y", "z")

_RESCALE = """
WITH o AS (SELECT subject, quantile_cont(tmax, 0.5) AS t, quantile_cont(cbf, 0.5) AS c FROM vox_out WHERE mask = 1 GROUP BY 1),
a AS (SELECT quantile_cont(tmax, 0.5) AS t, quantile_cont(cbf, 0.5) AS c FROM vox_out WHERE mask = 1)
SELECT v.subject, x, y, z, round(CASE WHEN o.t > 5 * a.t THEN tmax / 10 ELSE tmax END, 9) AS tmax, round(CASE WHEN o.c > 5 * a.c THEN cbf / 10 ELSE cbf END, 9) AS cbf
FROM vox_out v LEFT JOIN o USING (subject) CROSS JOIN a
"""


@query("rescale_outliers", W(_RESCALE, "vox_out"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.rescale_outliers(C.vox_out(spark, d), ("tmax", "cbf")).select(*KEY, "tmax", "cbf"), 9)


@query("standardise", W("SELECT subject, x, y, z, round((tmax - avg(tmax) OVER ()) / stddev_pop(tmax) OVER (), 6) AS tmax, round((mtt - avg(mtt) OVER ()) / stddev_pop(mtt) OVER (), 6) AS mtt FROM vox", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.standardise(C.vox(spark, d), ("tmax", "mtt")).select(*KEY, "tmax", "mtt"))


_CONTRA = """
WITH h AS (SELECT *, CASE WHEN x < 5 THEN 0 ELSE 1 END AS side FROM vox),
b AS (SELECT subject, side, quantile_cont(cbf, 0.01) AS lo, quantile_cont(cbf, 0.99) AS hi FROM h WHERE mask = 1 GROUP BY 1, 2),
m AS (SELECT subject, 1 - side AS side, avg(greatest(least(cbf, hi), lo)) AS mean FROM h JOIN b USING (subject, side) WHERE mask = 1 GROUP BY 1, 2)
SELECT subject, x, y, z, round(CASE WHEN mask = 1 THEN CASE WHEN mean <> 0 THEN cbf / mean END ELSE 0 END, 6) AS normalised FROM h LEFT JOIN m USING (subject, side)
"""


@query("contralateral_norm", W(_CONTRA, "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.contralateral_norm(C.vox(spark, d), "cbf", C.NX).select(*KEY, "normalised"))


_HEALTHY = """
WITH h AS (SELECT * FROM vox WHERE mask = 1 AND tmax < 4),
b AS (SELECT subject, quantile_cont(cbf, 0.01) AS lo, quantile_cont(cbf, 0.99) AS hi FROM h GROUP BY 1),
m AS (SELECT subject, quantile_cont(greatest(least(cbf, hi), lo), 0.5) AS median FROM h JOIN b USING (subject) GROUP BY 1)
SELECT subject, x, y, z, round(CASE WHEN mask = 1 THEN CASE WHEN median <> 0 THEN cbf / median END ELSE 0 END, 6) AS normalised FROM vox LEFT JOIN m USING (subject)
"""


@query("healthy_norm", W(_HEALTHY, "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.healthy_norm(C.vox(spark, d), "cbf").select(*KEY, "normalised"))


def _minmax(value: str, quantiles: str) -> str:
    return f"""
WITH v AS (SELECT *, {value} AS v FROM vox), b AS (SELECT subject, {quantiles} FROM v GROUP BY 1)
SELECT subject, x, y, z, round(CASE WHEN hi > lo THEN (greatest(least(v, hi), lo) - lo) / (hi - lo) ELSE 0 END, 6) AS normalised FROM v JOIN b USING (subject)
"""


@query("minmax_norm", W(_minmax("CASE WHEN mask = 1 THEN cbf ELSE 0 END", "quantile_cont(v, 0.001) AS lo, quantile_cont(v, 0.999) AS hi"), "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.minmax_norm(C.vox(spark, d), "cbf").select(*KEY, "normalised"))


@query("normalised_marker", W(_minmax("CASE WHEN mask = 1 THEN -cbf ELSE -0.0 END", "min(v) AS lo, max(v) AS hi"), "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.minmax_norm(C.vox(spark, d), "cbf", clip=None, flip=True).select(*KEY, "normalised"))


@query("penumbra", W("SELECT subject, x, y, z, CASE WHEN tmax > 6 AND tmax < (SELECT quantile_cont(tmax, 0.99) FROM vox) THEN 1 ELSE 0 END AS penumbra FROM vox", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return N.penumbra(C.vox(spark, d)).select(*KEY, "penumbra")


_MATCH = """
WITH p AS (SELECT *, CASE WHEN tmax > 6 AND tmax < (SELECT quantile_cont(tmax, 0.99) FROM vox) THEN 1 ELSE 0 END AS penumbra, CASE WHEN cbv / 10 >= 0.5 THEN 1 ELSE 0 END AS predicted FROM vox)
SELECT subject, sum(predicted) AS predicted, round(sum(predicted * penumbra) / nullif(sum(predicted), 0), 6) AS matched FROM p GROUP BY 1
"""


@query("penumbra_match", W(_MATCH, "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    p = N.penumbra(C.vox(spark, d)).withColumn("predicted", F.when(F.col("cbv") / 10 >= 0.5, 1).otherwise(0))
    sums = p.groupBy("subject").agg(F.sum("predicted").alias("predicted"), F.sum(F.col("predicted") * F.col("penumbra")).alias("both"))
    return rounded(sums.select("subject", "predicted", N.ratio(F.col("both").cast("double"), F.col("predicted")).alias("matched")))


_CSF = """
WITH l AS (SELECT subject, avg(cbf) - 1.96 * stddev_pop(cbf) AS csf_limit FROM vox WHERE cbf > 0 AND cbf < 40 GROUP BY 1)
SELECT subject, x, y, z, round(csf_limit, 6) AS csf_limit, CASE WHEN cbf > 0 AND cbf < csf_limit THEN 1 ELSE 0 END AS csf FROM vox LEFT JOIN l USING (subject)
"""


@query("csf_threshold", W(_CSF, "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.csf_threshold(C.vox(spark, d), "cbf").select(*KEY, "csf_limit", "csf"))


def _filter_sql(name: str, a: str, b: str) -> str:
    return f"""{name}p AS (SELECT subject, x, y, z, greatest({a} * {b}, 0) AS p FROM vox),
{name}t AS (SELECT subject, quantile_cont(p, 0.99) AS t FROM {name}p WHERE p > 0 GROUP BY 1),
{name}c AS (SELECT subject, x, y, z, least(p, coalesce(t, 0)) AS c FROM {name}p LEFT JOIN {name}t USING (subject)),
{name} AS (SELECT subject, x, y, z, CASE WHEN hi > lo AND (c - lo) / (hi - lo) > 0.05 THEN (c - lo) / (hi - lo) ELSE 0 END AS v FROM {name}c JOIN (SELECT subject, min(c) AS lo, max(c) AS hi FROM {name}c GROUP BY 1) USING (subject))"""


@query("dual_filter", W(f"WITH {_filter_sql('f', 'tmax', 'cbf')}, {_filter_sql('g', 'mtt', 'cbv')} SELECT subject, x, y, z, round(f.v, 6) AS first, CASE WHEN f.v > 0 AND g.v > 0 THEN 1 ELSE 0 END AS both FROM f JOIN g USING (subject, x, y, z)", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    v = N.intensity_filter(N.intensity_filter(C.vox(spark, d), "tmax", "cbf", "first"), "mtt", "cbv", "second")
    return rounded(v.select(*KEY, "first", F.when((F.col("first") > 0) & (F.col("second") > 0), 1).otherwise(0).alias("both")))


def status(spark: SparkSession, d: str) -> DataFrame:
    """subject, treat (yes, no or ?)."""
    return C.clinical(spark, d).select("subject", "treat")


_VOLUME = """
WITH v AS (SELECT subject, sum(label) * 8 * 0.001 AS ml FROM vox GROUP BY 1), s AS (SELECT v.*, treat FROM v LEFT JOIN clin USING (subject)), g AS (SELECT 'all' AS grp, ml FROM s UNION ALL SELECT treat, ml FROM s WHERE treat IS NOT NULL)
SELECT grp, count(*) AS n, round(quantile_cont(ml, 0.5), 6) AS median, round(quantile_cont(ml, 0.25), 6) AS q25, round(quantile_cont(ml, 0.75), 6) AS q75 FROM g GROUP BY 1
"""


@query("lesion_volume", W(_VOLUME.replace("* 0.001", "* 0.001::DOUBLE"), "vox", "clin"))
def _(spark: SparkSession, d: str) -> DataFrame:
    ml = C.vox(spark, d).groupBy("subject").agg(V.volume_ml(F.sum("label")).alias("ml"))
    s = ml.join(status(spark, d), "subject", "left").withColumn("grp", F.explode(F.array_compact(F.array(F.lit("all"), "treat"))))
    q = F.percentile("ml", F.array(F.lit(0.5), F.lit(0.25), F.lit(0.75)))
    return rounded(s.groupBy("grp").agg(F.count("*").alias("n"), q.alias("q")).select("grp", "n", F.col("q")[0].alias("median"), F.col("q")[1].alias("q25"), F.col("q")[2].alias("q75")))


@query("class_balance", W("SELECT sum(label) AS positives, count(*) AS total, round(sum(label) / count(*), 6) AS ratio, sum(label * mask) AS masked_positives, sum(mask) AS masked_total, round(sum(label * mask) / sum(mask), 6) AS masked_ratio FROM vox", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    s = C.vox(spark, d).agg(F.sum("label").alias("positives"), F.count("*").alias("total"), F.sum(F.col("label") * F.col("mask")).alias("masked_positives"), F.sum("mask").alias("masked_total"))
    return rounded(s.withColumns({"ratio": N.ratio(F.col("positives"), F.col("total")), "masked_ratio": N.ratio(F.col("masked_positives"), F.col("masked_total"))}))


_MIRROR = "SELECT v.subject, v.x, v.y, v.z, round(CASE WHEN o.tmax <> 0 THEN v.tmax / o.tmax END, 6) AS tmax FROM vox v LEFT JOIN vox o ON o.subject = v.subject AND o.y = v.y AND o.z = v.z AND o.x = 9 - v.x"
_MIRROR15 = """
SELECT v.subject, v.x, v.y, v.z, round(v.tmax / nullif(CASE WHEN v.x = 7 THEN b.t ELSE o.tmax END, 0), 6) AS tmax
FROM vox15 v LEFT JOIN vox15 o ON o.subject = v.subject AND o.y = v.y AND o.z = v.z AND o.x = 14 - v.x
LEFT JOIN (SELECT subject, y, z, avg(tmax) AS t FROM vox15 WHERE x IN (6, 8) GROUP BY 1, 2, 3) b ON b.subject = v.subject AND b.y = v.y AND b.z = v.z
"""


@query("mirror_ratio", W(_MIRROR, "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.mirror_ratio(C.vox(spark, d), ("tmax",), C.NX).select(*KEY, "tmax"))


@query("mirror_ratio_odd", W(_MIRROR15, "vox15"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.mirror_ratio(C.vox15(spark, d), ("tmax",), 15).select(*KEY, "tmax"))


@query("max_extent", W("SELECT max(x) + 1 AS nx, max(y) + 1 AS ny, max(z) + 1 AS nz FROM vox", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return C.vox(spark, d).agg(*[(F.max(a) + 1).alias(f"n{a}") for a in "xyz"])


@query("channel_correlation", W("SELECT a, b, round(corr(u, v), 6) AS r FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, CAST({a} AS DOUBLE) AS u, CAST({b} AS DOUBLE) AS v FROM vox" for a in (*C.CHANNELS, "label") for b in (*C.CHANNELS, "label")) + ") GROUP BY 1, 2", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.channel_correlation(C.vox(spark, d), (*C.CHANNELS, "label")))


@query("voxelwise_correlation", W("SELECT round(avg(r), 6) AS mean_r, count(r) AS positions FROM (SELECT CASE WHEN isnan(corr(tmax, label)) THEN NULL ELSE corr(tmax, label) END AS r FROM vox GROUP BY x, y, z HAVING stddev_pop(label) > 0 AND stddev_pop(tmax) > 0)", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.voxelwise_correlation(C.vox(spark, d), "tmax", "label"))


def _prepare_sql(standard: bool) -> str:
    from voxframe.operators.spatial import gaussian_weights
    from voxframe.plans.spatial import kernel_sql

    w = gaussian_weights(5)
    value = lambda c: f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()" if standard else c
    passes = ", ".join(f"{c}0 AS (SELECT subject, x, y, z, {c} AS v FROM s), {kernel_sql(f'{c}1', f'{c}0', 'x', C.NX, w)}, {kernel_sql(f'{c}2', f'{c}1', 'y', C.NY, w)}" for c in ("tmax", "cbf"))
    return f"""WITH o AS (SELECT subject, quantile_cont(tmax, 0.5) AS t, quantile_cont(cbf, 0.5) AS c FROM vox_out WHERE mask = 1 GROUP BY 1), a AS (SELECT quantile_cont(tmax, 0.5) AS t, quantile_cont(cbf, 0.5) AS c FROM vox_out WHERE mask = 1),
r AS (SELECT v.* REPLACE (CASE WHEN o.t > 5 * a.t THEN tmax / 10 ELSE tmax END AS tmax, CASE WHEN o.c > 5 * a.c THEN cbf / 10 ELSE cbf END AS cbf) FROM vox_out v LEFT JOIN o USING (subject) CROSS JOIN a),
s AS (SELECT subject, x, y, z, mask, {value('tmax')} AS tmax, {value('cbf')} AS cbf FROM r), {passes},
h AS (SELECT s.subject, s.x, s.y, s.z, s.mask, t.v AS tmax, c.v AS cbf, CASE WHEN s.x < 5 THEN 0 ELSE 1 END AS side FROM s JOIN tmax2 t USING (subject, x, y, z) JOIN cbf2 c USING (subject, x, y, z)),
b AS (SELECT subject, side, quantile_cont(cbf, 0.01) AS lo, quantile_cont(cbf, 0.99) AS hi FROM h WHERE mask = 1 GROUP BY 1, 2),
m AS (SELECT subject, 1 - side AS side, avg(greatest(least(cbf, hi), lo)) AS mean FROM h JOIN b USING (subject, side) WHERE mask = 1 GROUP BY 1, 2)
SELECT subject, x, y, z, round(tmax, 6) AS tmax, round(CASE WHEN mask = 1 THEN CASE WHEN mean <> 0 THEN cbf / mean END ELSE 0 END, {3 if standard else 6}) AS cbf FROM h LEFT JOIN m USING (subject, side)"""


@query("prepare", W(_prepare_sql(False), "vox_out"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """Outliers rescaled, smoothed in each plane, flow against the opposite half."""
    return rounded(E.prepare(C.vox_out(spark, d), ("tmax", "cbf"), (C.NX, C.NY, C.NZ), by_side=("cbf",)).select(*KEY, "tmax", "cbf"))


@query("prepare_standardised", W(re.sub(r"round\(CASE WHEN mask = 1.*?END ELSE 0 END, 3\) AS cbf", "round(cbf, 6) AS cbf", _prepare_sql(True)), "vox_out"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """As prepare, standardised before smoothing and without sides, whose means are near 0 then."""
    return rounded(E.prepare(C.vox_out(spark, d), ("tmax", "cbf"), (C.NX, C.NY, C.NZ), standard=True).select(*KEY, "tmax", "cbf"))
