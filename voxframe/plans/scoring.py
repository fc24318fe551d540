"""Queries of classifier scores and threshold models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe import carriers as C
from voxframe.carriers import with_views as W
from voxframe.operators import normalise as N
from voxframe.operators import reports as E
from voxframe.operators import runs as U
from voxframe.operators import scoring as S
from voxframe.operators.spatial import gaussian_weights
from voxframe.plans.registry import query, rounded
from voxframe.plans.spatial import _ball, _box, kernel_sql

_COUNTS = "count(*) FILTER (h AND y = 1) AS tp, count(*) FILTER (h AND y <> 1) AS fp, count(*) FILTER (NOT h AND y = 1) AS fn, count(*) FILTER (NOT h AND y <> 1) AS tn"
_METRICS = """tp, fp, fn, tn, round(CASE WHEN tp + fp + fn + tn = 0 THEN 0 ELSE (tp + tn) / (tp + fp + fn + tn) END, 6) AS accuracy, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1,
 round(CASE WHEN tp + fp + fn = 0 THEN 1 ELSE tp / (tp + fp + fn) END, 6) AS jaccard, round(CASE WHEN tp + fp + fn = 0 THEN 1 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS dice,
 round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS ppv, round(CASE WHEN tn + fn = 0 THEN 0 ELSE tn / (tn + fn) END, 6) AS npv, round(CASE WHEN tp + fp + fn + tn = 0 THEN 0 ELSE (fp + fn) / (tp + fp + fn + tn) END, 6) AS error_ratio"""


def image_scores(spark: SparkSession, d: str) -> DataFrame:
    return C.vox(spark, d).select("subject", "x", "y", "z", (F.col("tmax") / 12.5).alias("score"), F.col("label"), "mask", "cbf", "tmax")


@query("confusion_metrics", W(f"SELECT {_METRICS} FROM (SELECT {_COUNTS} FROM (SELECT score >= 0.1 AS h, y FROM scored))", "scored"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.confusion_metrics(C.scored(spark, d), threshold=0.1))


_ROC = """c AS (SELECT {k} score AS threshold, count(*) FILTER (y = 1) AS tp1, count(*) FILTER (y <> 1) AS fp1 FROM s GROUP BY ALL),
r AS (SELECT *, sum(tp1) OVER w AS tp, sum(fp1) OVER w AS fp, sum(tp1) OVER (PARTITION BY {p}) AS p, sum(fp1) OVER (PARTITION BY {p}) AS n FROM c WINDOW w AS (PARTITION BY {p} ORDER BY threshold DESC)),
roc AS (SELECT *, tp / nullif(p, 0) AS tpr, fp / nullif(n, 0) AS fpr, (tp - tp1) / nullif(p, 0) AS tpr0, (fp - fp1) / nullif(n, 0) AS fpr0 FROM r)"""
POOLED = "WITH s AS (SELECT score, y FROM scored), " + _ROC.format(k="", p="1")
BY_IMAGE = "WITH s AS (SELECT subject, tmax / 12.5 AS score, label AS y FROM vox), " + _ROC.format(k="subject,", p="subject")


def pooled(spark: SparkSession, d: str) -> DataFrame:
    return S.roc_points(C.scored(spark, d).withColumn("all", F.lit(1)), ["all"]).drop("all")


def by_image(spark: SparkSession, d: str) -> DataFrame:
    return S.roc_points(image_scores(spark, d), ["subject"], y="label")


@query("roc_curve", W(POOLED + " SELECT round(threshold, 9) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM roc UNION ALL SELECT NULL, 0, 0, 0.0, 0.0", "scored"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """With the origin as a row of its own, without threshold."""
    curve = pooled(spark, d).select(F.round("threshold", 9).alias("threshold"), "tp", "fp", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))
    return curve.union(spark.sql("SELECT CAST(NULL AS DOUBLE), 0L, 0L, 0.0D, 0.0D"))


@query("roc_auc", W(BY_IMAGE + " SELECT subject, round(sum((fpr - fpr0) * (tpr + tpr0) / 2), 6) AS roc_auc FROM roc GROUP BY 1", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.roc_auc(by_image(spark, d), ["subject"]))


_YOUDEN = " SELECT subject, round(arg_max(threshold, (tp * n - fp * p, {s} threshold)), 9) AS cutoff, round(arg_max(tpr, (tp * n - fp * p, {s} threshold)), 6) AS tpr, round(arg_max(fpr, (tp * n - fp * p, {s} threshold)), 6) AS fpr, round(max(tpr - fpr), 6) AS youden FROM roc GROUP BY 1"


@query("youden_cutoff", W(BY_IMAGE + _YOUDEN.format(s=""), "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    c = S.youden_cutoff(by_image(spark, d), ["subject"])
    return c.select("subject", F.round("cutoff", 9).alias("cutoff"), *[F.round(x, 6).alias(x) for x in ("tpr", "fpr", "youden")])


@query("youden_cutoff_lowest", W(BY_IMAGE + _YOUDEN.format(s="-"), "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    c = S.youden_cutoff(by_image(spark, d), ["subject"], ties="lowest")
    return c.select("subject", F.round("cutoff", 9).alias("cutoff"), *[F.round(x, 6).alias(x) for x in ("tpr", "fpr", "youden")])


_BALANCED = " SELECT subject, round(arg_max(threshold, ({s} abs(tp * n - (n - fp) * p), threshold)), 9) AS cutoff, round(arg_max(tpr, ({s} abs(tp * n - (n - fp) * p), threshold)), 6) AS tpr, round(arg_max(fpr, ({s} abs(tp * n - (n - fp) * p), threshold)), 6) AS fpr FROM roc GROUP BY 1"


@query("balanced_cutoff", W(BY_IMAGE + _BALANCED.format(s="-"), "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    c = S.balanced_cutoff(by_image(spark, d), ["subject"])
    return c.select("subject", F.round("cutoff", 9).alias("cutoff"), F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@query("balanced_cutoff_largest", W(BY_IMAGE + _BALANCED.format(s=""), "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    c = S.balanced_cutoff(by_image(spark, d), ["subject"], largest=True)
    return c.select("subject", F.round("cutoff", 9).alias("cutoff"), F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


_IMAGE = BY_IMAGE + f""", a AS (SELECT subject, sum((fpr - fpr0) * (tpr + tpr0) / 2) AS roc_auc FROM roc GROUP BY 1),
h AS (SELECT subject, {_COUNTS}, sum(score) AS raw FROM (SELECT subject, score, score >= 0.5 AS h, y FROM s) GROUP BY 1)
SELECT subject, round(roc_auc, 6) AS roc_auc, round((tp + fp) * 0.008::DOUBLE, 6) AS predicted_ml, round((fn - fp) * 0.008::DOUBLE, 6) AS delta_ml, round((tp + fn - raw) * 0.008, 6) AS raw_delta_ml, {_METRICS} FROM h JOIN a USING (subject)"""


@query("image_metrics", W(_IMAGE, "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.image_metrics(image_scores(spark, d)))


_MEAN_ROC = """WITH s AS (SELECT subject, tmax / 12.5 AS score, label AS y FROM vox), """ + _ROC.format(k="subject,", p="subject") + """,
seg AS (SELECT * FROM roc WHERE fpr > fpr0 AND tpr IS NOT NULL),
g AS (SELECT subject, i AS g, max(CASE WHEN i = 0 THEN 0 ELSE tpr0 + (i / 99 - fpr0) * (tpr - tpr0) / (fpr - fpr0) END) AS tpr FROM seg, generate_series(0, 99) t(i) WHERE i BETWEEN ceil(fpr0 * 99 - 1e-9) AND floor(fpr * 99 + 1e-9) GROUP BY 1, 2),
m AS (SELECT g, CASE WHEN g = 99 THEN 1 ELSE avg(tpr) END AS tpr, stddev_pop(tpr) AS s FROM g GROUP BY 1)
SELECT g, round(g / 99, 6) AS fpr, round(tpr, 6) AS tpr, round(s, 6) AS std, round(greatest(tpr - s, 0), 6) AS low, round(least(tpr + s, 1), 6) AS high FROM m"""


@query("mean_roc", W(_MEAN_ROC, "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.mean_roc(by_image(spark, d), "subject"))


@query("best_rates", W(BY_IMAGE + ", b AS (SELECT subject, arg_max(tpr, (tp * n - fp * p, threshold)) AS tpr, arg_max(fpr, (tp * n - fp * p, threshold)) AS fpr FROM roc GROUP BY 1) SELECT rate, round(avg(v), 6) AS mean, count(*) AS runs FROM (SELECT 'tpr' AS rate, tpr AS v FROM b UNION ALL SELECT 'fpr', fpr FROM b) GROUP BY 1", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(U.best_rates(S.youden_cutoff(by_image(spark, d), ["subject"])))


@query("fixed_threshold", W("SELECT subject, x, y, z, CASE WHEN mask = 1 AND tmax > 6 THEN 1 ELSE 0 END AS predicted FROM vox", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return E.fixed_threshold(C.vox(spark, d)).select("subject", "x", "y", "z", "predicted")


_TRAINED = "WITH s AS (SELECT {v} AS score, label AS y FROM vox WHERE mask = 1 AND subject % 2 = 0), " + _ROC.format(k="", p="1") + ", t AS (SELECT arg_max(threshold, (tp * n - fp * p, threshold)) AS t FROM roc)"


SHAPE = (C.NX, C.NY, C.NZ)
KEY = ("subject", "x", "y", "z")


@query("trained_threshold", W(_TRAINED.format(v="tmax") + " SELECT subject, x, y, z, CASE WHEN tmax > t THEN 1 ELSE 0 END AS predicted FROM vox, t WHERE mask = 1 AND subject % 2 = 1", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    v = C.vox(spark, d).filter("mask = 1")
    return E.trained_threshold(v.filter("subject % 2 = 0"), v.filter("subject % 2 = 1"), "tmax").select(*KEY, "predicted")


def _flow_sql(source: str, digits: int) -> str:
    """Cut trained on the even subjects' relative flow, applied to the odd ones'."""
    return f"""h AS (SELECT *, CASE WHEN x < 5 THEN 0 ELSE 1 END AS side FROM {source}),
b AS (SELECT subject, side, quantile_cont(cbf, 0.01) AS lo, quantile_cont(cbf, 0.99) AS hi FROM h WHERE mask = 1 GROUP BY 1, 2),
m AS (SELECT subject, 1 - side AS side, avg(greatest(least(cbf, hi), lo)) AS mean FROM h JOIN b USING (subject, side) WHERE mask = 1 GROUP BY 1, 2),
f AS (SELECT subject, x, y, z, label, round(-cbf / mean, {digits}) AS score FROM h JOIN m USING (subject, side) WHERE mask = 1),
s AS (SELECT score, label AS y FROM f WHERE subject % 2 = 0), {_ROC.format(k="", p="1")}, t AS (SELECT arg_max(threshold, (tp * n - fp * p, threshold)) AS t FROM roc)
SELECT subject, x, y, z, CASE WHEN score > t THEN 1 ELSE 0 END AS predicted FROM f, t WHERE subject % 2 = 1"""


def flow_threshold(spark: SparkSession, d: str, width: int, digits: int) -> DataFrame:
    f = E.relative_flow(C.vox(spark, d), SHAPE, width).withColumn("negated", F.round("negated", digits))
    return E.relative_flow_threshold(f.filter("subject % 2 = 0"), f.filter("subject % 2 = 1")).select(*KEY, "predicted")


@query("relative_flow_threshold", W("WITH " + _flow_sql("vox", 9), "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return flow_threshold(spark, d, 0, 9)


_W5 = gaussian_weights(5)
_SMOOTH = f"g AS (SELECT subject, x, y, z, cbf AS v FROM vox), {kernel_sql('ga', 'g', 'x', C.NX, _W5)}, {kernel_sql('gb', 'ga', 'y', C.NY, _W5)}, smooth AS (SELECT vox.* REPLACE (gb.v AS cbf) FROM vox JOIN gb USING (subject, x, y, z))"


@query("relative_flow_threshold_smoothed", W(f"WITH {_SMOOTH}, " + _flow_sql("smooth", 6), "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """After smoothing; ratios are taken at six digits, where sums in another order still agree."""
    return flow_threshold(spark, d, 5, 6)


_RATIOS = """WITH h AS (SELECT *, CASE WHEN x < 5 THEN 0 ELSE 1 END AS side FROM vox),
b AS (SELECT subject, side, quantile_cont(cbf, 0.01) AS lo, quantile_cont(cbf, 0.99) AS hi FROM h WHERE mask = 1 GROUP BY 1, 2),
m AS (SELECT subject, 1 - side AS side, avg(greatest(least(cbf, hi), lo)) AS mean FROM h JOIN b USING (subject, side) WHERE mask = 1 GROUP BY 1, 2),
e AS (SELECT subject, quantile_cont(cbf, 0.01) AS lo, quantile_cont(cbf, 0.99) AS hi FROM vox WHERE mask = 1 AND tmax < 4 GROUP BY 1),
k AS (SELECT subject, quantile_cont(greatest(least(cbf, hi), lo), 0.5) AS median FROM vox JOIN e USING (subject) WHERE mask = 1 AND tmax < 4 GROUP BY 1),
top AS (SELECT quantile_cont(tmax, 0.99) AS top FROM vox),
r AS (SELECT subject, x, y, z, label, mask, tmax > 6 AND tmax < top AS penumbra, round(CASE WHEN mask = 1 THEN cbf / nullif(mean, 0) ELSE 0 END, 9) AS by_side, round(CASE WHEN mask = 1 THEN cbf / nullif(median, 0) ELSE 0 END, 9) AS by_healthy
 FROM h LEFT JOIN m USING (subject, side) LEFT JOIN k USING (subject) CROSS JOIN top)"""
_INSIDE = "CASE WHEN mask = 1 AND penumbra AND (coalesce(by_side < {t}, false) OR coalesce(by_healthy < {t}, false)) THEN 1 ELSE 0 END"


@query("core_in_penumbra", W(f"{_RATIOS} SELECT subject, x, y, z, {_INSIDE.format(t='0.38')} AS predicted FROM r", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """With a fixed cut."""
    return E.core_in_penumbra(E.core_ratios(C.vox(spark, d), C.NX), 0.38).select(*KEY, "predicted")


_TRAINED_CUT = ", s AS (SELECT -by_healthy AS score, label AS y FROM r WHERE mask = 1 AND penumbra AND by_healthy IS NOT NULL AND subject % 2 = 0), " + _ROC.format(k="", p="1").replace("r AS (SELECT *, sum", "rr AS (SELECT *, sum").replace("FROM r)", "FROM rr)") + ", t AS (SELECT -arg_max(threshold, (tp * n - fp * p, threshold)) AS t FROM roc)"


@query("core_in_penumbra_trained", W(_RATIOS + _TRAINED_CUT + f", g AS (SELECT subject, x, y, z, mask, {_INSIDE.format(t='t')} AS m FROM r, t WHERE subject % 2 = 1), u AS ({_box('g', 'max', -1, 2)}), v AS ({_box('u', 'min', -2, 1)}) SELECT g.subject, g.x, g.y, g.z, CASE WHEN g.mask = 1 THEN v.m ELSE 0 END AS predicted FROM v JOIN g USING (subject, x, y, z)", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """With a cut trained inside the penumbra of the even subjects, closed with a box of 4."""
    r = E.core_ratios(C.vox(spark, d), C.NX)
    train = r.filter("subject % 2 = 0 AND mask = 1 AND penumbra = 1 AND by_healthy IS NOT NULL").withColumn("negated", F.round(-F.round("by_healthy", 9), 9))
    return E.core_in_penumbra(r.filter("subject % 2 = 1"), E.trained_cutoff(train, "negated"), 4).select(*KEY, "predicted")


def _core_sql(source: str) -> str:
    """CTEs up to `cores`: three definitions of the core."""
    fold = f"fg AS (SELECT subject * 2 + x // 5 AS subject, x % 5 AS x, y, z, cbf AS v FROM {source}), {kernel_sql('fa', 'fg', 'x', 5, _W5)}, {kernel_sql('fb', 'fa', 'y', C.NY, _W5)}, fm AS (SELECT subject // 2 AS subject, 9 - (x + 5 * (subject % 2)) AS x, y, z, v AS region FROM fb)"
    return f"""h AS (SELECT *, CASE WHEN x < 5 THEN 0 ELSE 1 END AS side FROM {source}),
b AS (SELECT subject, side, quantile_cont(cbf, 0.01) AS lo, quantile_cont(cbf, 0.99) AS hi FROM h WHERE mask = 1 GROUP BY 1, 2),
m AS (SELECT subject, 1 - side AS side, avg(greatest(least(cbf, hi), lo)) AS mean FROM h JOIN b USING (subject, side) WHERE mask = 1 GROUP BY 1, 2),
e AS (SELECT subject, quantile_cont(cbf, 0.01) AS lo, quantile_cont(cbf, 0.99) AS hi FROM {source} WHERE mask = 1 AND tmax < 4 GROUP BY 1),
k AS (SELECT subject, quantile_cont(greatest(least(cbf, hi), lo), 0.5) AS median FROM {source} JOIN e USING (subject) WHERE mask = 1 AND tmax < 4 GROUP BY 1), {fold},
n AS (SELECT *, mask = 1 AND tmax > 6 AS late, coalesce(cbf / nullif(mean, 0) < 0.3, false) AS l1, coalesce(cbf / nullif(median, 0) < 0.3, false) AS l2, coalesce(cbf / nullif(region, 0) < 0.3, false) AS l3 FROM h LEFT JOIN m USING (subject, side) LEFT JOIN k USING (subject) LEFT JOIN fm USING (subject, x, y, z)),
cores AS (SELECT subject, x, y, z, label, mask, tmax, CASE WHEN late AND l1 THEN 1 ELSE 0 END AS core, CASE WHEN late AND (l1 OR l2) THEN 1 ELSE 0 END AS core_healthy, CASE WHEN late AND (l1 OR l2 OR l3) THEN 1 ELSE 0 END AS core_region FROM n)"""


@query("core_mask", W(f"WITH {_core_sql('vox')} SELECT subject, x, y, z, core, core_healthy, core_region FROM cores", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return E.core_masks(C.vox(spark, d), SHAPE).select(*KEY, "core", "core_healthy", "core_region")


_RESCALED = """o AS (SELECT subject, quantile_cont(tmax, 0.5) AS t, quantile_cont(cbf, 0.5) AS c FROM vox_out WHERE mask = 1 GROUP BY 1), a AS (SELECT quantile_cont(tmax, 0.5) AS t, quantile_cont(cbf, 0.5) AS c FROM vox_out WHERE mask = 1),
scaled AS (SELECT v.* REPLACE (CASE WHEN o.t > 5 * a.t THEN tmax / 10 ELSE tmax END AS tmax, CASE WHEN o.c > 5 * a.c THEN cbf / 10 ELSE cbf END AS cbf) FROM vox_out v LEFT JOIN o USING (subject) CROSS JOIN a)"""
_MASKS = ("tmax6", "tmax10", "core", "core_healthy", "core_region")


def smooth_sql(source: str, least: int) -> str:
    """CTEs up to `kept` (subject, x, y, z, m) of a 0/1 column m: closing and opening by the six-neighbour ball, then regions under `least` voxels dropped."""
    return f"""c1 AS MATERIALIZED ({_ball(source, 'max')}), c2 AS MATERIALIZED ({_ball('c1', 'min')}), c3 AS MATERIALIZED ({_ball('c2', 'min')}), c4 AS MATERIALIZED ({_ball('c3', 'max')}),
on1 AS MATERIALIZED (SELECT subject, x, y, z, x * 30 + y * 5 + z AS id FROM c4 WHERE m = 1),
edge AS MATERIALIZED (SELECT p.subject, p.id AS a, q.id AS b FROM on1 p JOIN on1 q ON p.subject = q.subject AND abs(p.x - q.x) + abs(p.y - q.y) + abs(p.z - q.z) = 1),
reach AS (SELECT subject, id, id AS root FROM on1 UNION SELECT reach.subject, edge.b, reach.root FROM reach JOIN edge ON edge.subject = reach.subject AND edge.a = reach.id),
part AS (SELECT subject, id, min(root) AS region FROM reach GROUP BY 1, 2), large AS (SELECT subject, region FROM part GROUP BY 1, 2 HAVING count(*) >= {least}),
kept AS (SELECT c4.subject, c4.x, c4.y, c4.z, CASE WHEN large.region IS NULL THEN 0 ELSE 1 END AS m FROM c4 LEFT JOIN part ON part.subject = c4.subject AND part.id = c4.x * 30 + c4.y * 5 + c4.z LEFT JOIN large ON large.subject = part.subject AND large.region = part.region)"""


_SUMS = ", ".join(f"round(sum({n}) * 8.0::DOUBLE, 6) AS {n}_mm3, round(sum({n}) * 0.008::DOUBLE, 6) AS {n}_ml" for m in _MASKS for n in (m, f"{m}_smooth"))
_PERFUSION = f"""WITH RECURSIVE vox_out AS ({C.VOX_OUT}), {_RESCALED}, {_core_sql('scaled')},
flags AS (SELECT *, CASE WHEN mask = 1 AND tmax > 6 THEN 1 ELSE 0 END AS tmax6, CASE WHEN mask = 1 AND tmax > 10 THEN 1 ELSE 0 END AS tmax10 FROM cores),
long AS MATERIALIZED ({' UNION ALL '.join(f"SELECT subject * 8 + {i} AS subject, x, y, z, {n} AS m FROM flags" for i, n in enumerate(_MASKS))}), {smooth_sql('long', 10)},
wide AS (SELECT subject // 8 AS subject, x, y, z, {', '.join(f"max(m) FILTER (subject % 8 = {i}) AS {n}_smooth" for i, n in enumerate(_MASKS))} FROM kept GROUP BY ALL)
SELECT subject, {_SUMS}, round(sum(label) * 8.0::DOUBLE, 6) AS truth_mm3, round(sum(label) * 0.008::DOUBLE, 6) AS truth_ml FROM flags JOIN wide USING (subject, x, y, z) GROUP BY 1"""


@query("perfusion_volumes", _PERFUSION)
def _(spark: SparkSession, d: str) -> DataFrame:
    """The volume report: late and very late perfusion, core by three definitions, each raw and smoothed, and the true lesion, in mm3 and ml; regions under 10 voxels go, since volumes here have 300."""
    return rounded(E.perfusion_volumes(C.vox_out(spark, d), SHAPE, 10))


_FOLD = f"""WITH t AS (SELECT quantile_cont(tmax, 0.99) AS top FROM vox), test AS MATERIALIZED (SELECT vox.*, tmax / 12.5 AS score, tmax > 6 AND tmax < top AS penumbra FROM vox, t WHERE subject % 5 = 0),
s AS (SELECT subject, score, label AS y FROM test WHERE mask = 1), {_ROC.format(k="subject,", p="subject")}, a AS (SELECT subject, sum((fpr - fpr0) * (tpr + tpr0) / 2) AS roc_auc FROM roc GROUP BY 1),
counts AS (SELECT subject, {_COUNTS}, sum(score) AS raw FROM (SELECT subject, score, score >= 0.5 AS h, y FROM s) GROUP BY 1),
i AS (SELECT subject, sum(CASE WHEN penumbra THEN 1 ELSE 0 END) / nullif(count(*), 0) AS inside FROM test WHERE mask = 1 AND score >= 0.5 GROUP BY 1),
tt AS (SELECT subject, x, y, z FROM test WHERE mask = 1 AND label = 1), pp AS (SELECT subject, x, y, z FROM test WHERE mask = 1 AND score >= 0.5),
d1 AS (SELECT subject, max(d) AS hausdorff, avg(d) AS mt FROM (SELECT tt.subject, tt.x, tt.y, tt.z, min(sqrt((tt.x - pp.x) ** 2 + (tt.y - pp.y) ** 2 + (tt.z - pp.z) ** 2)) AS d FROM tt JOIN pp USING (subject) GROUP BY ALL) GROUP BY 1),
d2 AS (SELECT subject, avg(d) AS mp FROM (SELECT pp.subject, pp.x, pp.y, pp.z, min(sqrt((tt.x - pp.x) ** 2 + (tt.y - pp.y) ** 2 + (tt.z - pp.z) ** 2)) AS d FROM pp JOIN tt USING (subject) GROUP BY ALL) GROUP BY 1)
SELECT subject, round(roc_auc, 6) AS roc_auc, round((tp + fp) * 0.008::DOUBLE, 6) AS predicted_ml, round((fn - fp) * 0.008::DOUBLE, 6) AS delta_ml, round((tp + fn - raw) * 0.008, 6) AS raw_delta_ml, {_METRICS}, round(inside, 6) AS penumbra_share, round(hausdorff, 6) AS hausdorff,
 round(mt, 6) AS mean_truth_to_predicted, round(mp, 6) AS mean_predicted_to_truth, round(CASE WHEN mt IS NOT NULL AND mp IS NOT NULL THEN greatest(mt, mp) END, 6) AS modified_hausdorff FROM counts JOIN a USING (subject) LEFT JOIN i USING (subject) LEFT JOIN d1 USING (subject) LEFT JOIN d2 USING (subject)"""


@query("evaluate_fold", W(_FOLD, "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """All scores of one fold's test images: overlap, AUC, volumes, distances and the share in the penumbra."""
    test = N.penumbra(C.vox(spark, d)).filter("subject % 5 = 0").withColumn("score", F.col("tmax") / 12.5)
    return rounded(E.evaluate_images(test, SHAPE))
