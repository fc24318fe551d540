"""Queries of the row-wise rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe import carriers as C
from voxframe.carriers import with_views as W
from voxframe.functions import cohort as K
from voxframe.functions import voxel as V
from voxframe.plans.registry import query, rounded

KEY = ("subject", "x", "y", "z")


@query("nan_to_zero", W("SELECT subject, x, y, z, CASE WHEN cbv = 0 THEN 0 ELSE tmax / cbv END AS ratio FROM vox", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """Not rounded: a quotient is the same number in every engine, half of a last digit isn't."""
    v = C.vox(spark, d)
    return v.select(*KEY, V.nan_to_zero(F.when(F.col("cbv") == 0, float("nan")).otherwise(F.try_divide("tmax", "cbv"))).alias("ratio"))


@query("clamp_label", W("SELECT subject, x, y, z, CAST(least(label + mask, 1) AS INT) AS label FROM vox", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return C.vox(spark, d).select(*KEY, V.clamp_label(F.col("label") + F.col("mask")).alias("label"))


@query("threshold_mask", W("SELECT subject, x, y, z, CASE WHEN tmax > 6 THEN 1 ELSE 0 END AS above, CASE WHEN cbf < 30 THEN 1 ELSE 0 END AS below FROM vox", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return C.vox(spark, d).select(*KEY, V.threshold_mask(F.col("tmax"), 6).alias("above"), V.threshold_mask(F.col("cbf"), 30, inverse=True).alias("below"))


@query("binarize", W("SELECT v.subject, x, y, z, CASE WHEN tmax > 0.7 * m THEN 1 ELSE 0 END AS lesion, label AS label_binary FROM vox v JOIN (SELECT subject, max(tmax) AS m FROM vox GROUP BY 1) USING (subject)", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    v = V.binarize(C.vox(spark, d), "tmax", 0.7).withColumnRenamed("binary", "lesion")
    return V.binarize(v.withColumn("value", F.col("label").cast("double")), "value", 0.2, fraction_of_max=False).select(*KEY, "lesion", F.col("binary").alias("label_binary"))


@query("apply_mask", W("SELECT subject, x, y, z, round(CASE WHEN mask = 1 THEN tmax ELSE 0 END, 9) AS tmax, round(CASE WHEN mask = 1 THEN cbf ELSE 0 END, 9) AS cbf FROM vox", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.vox(spark, d).select(*KEY, *[V.apply_mask(F.col(c), F.col("mask")).alias(c) for c in ("tmax", "cbf")]), 9)


@query("select_channel", W("SELECT subject, x, y, z, round(tmax, 9) AS tmax, round(cbv, 9) AS cbv FROM vox", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.vox(spark, d).select(*KEY, "tmax", "cbv"), 9)


@query("window_intensity", W("SELECT subject, x, y, z, round(CASE WHEN cbf BETWEEN 20 AND 70 THEN cbf ELSE 0 END, 6) AS cbf FROM vox", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.vox(spark, d).select(*KEY, V.window_intensity(F.col("cbf"), 20, 70).alias("cbf")))


_STRETCH = """
WITH v AS (SELECT subject, x, y, z, mtt * 160 - 1100 + subject % 3 * 300 AS raw FROM vox),
s AS (SELECT subject, min(raw) AS lo, max(raw) AS hi FROM v GROUP BY 1),
m AS (SELECT v.*, lo, hi, greatest(raw, -1024) AS r, greatest(lo, -1024) AS l FROM v JOIN s USING (subject))
SELECT subject, x, y, z, round(CASE WHEN hi - lo < 1999 OR lo > -500 THEN raw - lo
 ELSE (r + 9 * greatest(0, least(r, 100) + 100)) - (l + 9 * greatest(0, least(l, 100) + 100)) END, 6) AS stretched FROM m
"""


@query("stretch_intensity", W(_STRETCH, "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    raw = C.vox(spark, d).select(*KEY, (F.col("mtt") * 160 - 1100 + F.col("subject") % 3 * 300).alias("raw"))
    return rounded(V.stretch_intensity(raw, "raw").select(*KEY, "stretched"))


@query("volume_units", W("SELECT subject, count(*) AS voxels, count(*) * 8.0::DOUBLE AS mm3, round(count(*) * 8 * 0.001, 6)::DOUBLE AS ml FROM vox WHERE tmax > 6 GROUP BY 1", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    n = C.vox(spark, d).filter("tmax > 6").groupBy("subject").agg(F.count("*").alias("voxels"))
    return rounded(n.withColumns({"mm3": V.volume_mm3(F.col("voxels")), "ml": V.volume_ml(F.col("voxels"))}))


_NAMES = ("red", "small", "blue widget")


@query("name_match", "SELECT p_partkey, p_name, regexp_full_match(p_name, '(red|small|blue widget)( ?(0|[1-9][0-9]{0,2}))?') AS tight, contains(p_name, 'red') OR contains(p_name, 'small') OR contains(p_name, 'blue widget') AS loose, starts_with(p_name, 'red') OR starts_with(p_name, 'small') OR starts_with(p_name, 'blue widget') AS start FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    return C.read(spark, d, "part").select("p_partkey", "p_name", *[K.name_match(F.col("p_name"), _NAMES, how).alias(how) for how in ("tight", "loose", "start")])


@query("canonical_name", "SELECT p_partkey, CASE WHEN p_name LIKE '%ring%' THEN 'RING' WHEN p_name LIKE '%red%' THEN 'RED' WHEN p_name LIKE '%small%' THEN 'SMALL' ELSE p_name END AS name FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    rules = (("small", "SMALL"), ("red", "RED"), ("ring", "RING"))
    return C.read(spark, d, "part").select("p_partkey", K.last_rule(F.col("p_name"), rules, F.col("p_name")).alias("name"))


@query("subject_pid", "SELECT c_custkey, 'subj-' || substr(sha256(upper(trim(c_name)) || '^' || upper(trim(c_mktsegment)) || '^' || strftime(DATE '1950-01-01' + CAST(c_custkey % 10000 AS INT), '%Y%m%d')), 1, 8) AS pid FROM customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    birth = F.date_add(F.lit("1950-01-01").cast("date"), (F.col("c_custkey") % 10000).cast("int"))
    return C.read(spark, d, "customer").select("c_custkey", K.subject_pid(F.col("c_name"), F.col("c_mktsegment"), birth).alias("pid"))


@query("clean_text", W("SELECT subject, replace(lower(trim(onset_known)), ' ', '_') AS onset_known, replace(lower(trim(name)), ' ', '_') AS name FROM clin", "clin"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return C.clinical(spark, d).select("subject", K.clean_text(F.col("onset_known")).alias("onset_known"), K.clean_text(F.col("name")).alias("name"))


@query("binary_flags", W("SELECT subject, CASE WHEN smoking = 'yes' THEN 1 ELSE 0 END AS smoking, CASE WHEN sex = 'm' THEN 1 ELSE 0 END AS male FROM clin", "clin"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return C.clinical(spark, d).select("subject", K.flag(F.col("smoking")).alias("smoking"), K.flag(F.col("sex"), "m").alias("male"))


@query("one_hot", W("SELECT subject, CASE WHEN treat = 'yes' THEN 1 ELSE 0 END AS treat_yes, CASE WHEN treat = '?' THEN 1 ELSE 0 END AS treat_unknown FROM clin", "clin"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return K.one_hot(C.clinical(spark, d), "treat", {"yes": "treat_yes", "?": "treat_unknown", "no": "treat_no"}, reference="no").select("subject", "treat_yes", "treat_unknown")


@query("before_event", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_shipdate < o_orderdate OR l_returnflag = 'R' THEN 1 ELSE 0 END AS before FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    j = C.read(spark, d, "lineitem").join(C.read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", K.before_event(F.col("l_shipdate"), F.col("o_orderdate"), F.col("l_returnflag"), "R").alias("before"))


@query("elapsed_minutes", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, date_diff('second', o_orderdate, l_shipdate) // 60 AS minutes FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    j = C.read(spark, d, "lineitem").join(C.read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", K.elapsed_minutes(F.col("o_orderdate"), F.col("l_shipdate")).alias("minutes"))


@query("nan_sentinel", W("SELECT subject, CASE WHEN subject % 7 = 0 THEN -1 ELSE age END AS age, CASE WHEN subject % 5 = 0 THEN NULL ELSE glucose END AS glucose FROM clin", "clin"))
def _(spark: SparkSession, d: str) -> DataFrame:
    c = C.clinical(spark, d).select("subject", F.when(F.col("subject") % 7 != 0, F.col("age")).alias("age"), F.when(F.col("subject") % 5 != 0, F.col("glucose")).alias("glucose"))
    return K.nan_sentinel(c, ("age", "glucose"))


@query("select_parameters", W("SELECT subject, age, smoking FROM clin", "clin"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return K.select_parameters(C.clinical(spark, d), ("subject", "age", "weight", "smoking", "bp_syst"))


_RULES = """
SELECT subject, 'age' AS "column", '1..120' AS rule, CAST(age AS VARCHAR) AS value FROM clin WHERE NOT age BETWEEN 1 AND 120
UNION ALL SELECT subject, 'sex', 'm|f', sex FROM clin WHERE sex NOT IN ('m', 'f')
UNION ALL SELECT subject, 'glucose', '0.1..30', CAST(glucose AS VARCHAR) FROM clin WHERE NOT glucose BETWEEN 0.1 AND 30
UNION ALL SELECT subject, 'smoking', 'yes', smoking FROM clin WHERE smoking NOT IN ('yes')
UNION ALL SELECT subject, 'name', 'yyyy-MM-dd HH:mm:ss', name FROM clin
"""


@query("validate_rules", W(_RULES, "clin"))
def _(spark: SparkSession, d: str) -> DataFrame:
    rules = (K.in_range("age", 1, 120), K.one_of("sex", ("m", "f")), K.in_range("glucose", 0.1, 30), K.one_of("smoking", ("yes",)), K.timestamp_text("name"))
    return K.validate_rules(C.clinical(spark, d), "subject", rules)


@query("time_slice", W("SELECT subject, voxel_id, round(v, 9) AS v, (SELECT count(DISTINCT t) FROM vox4d) AS points FROM vox4d WHERE t = 1", "vox4d"))
def _(spark: SparkSession, d: str) -> DataFrame:
    v = C.vox4d(spark, d)
    points = v.groupBy("subject").agg(F.countDistinct("t").alias("points"))
    return rounded(v.filter("t = 1").select("subject", "voxel_id", "v").join(points, "subject"), 9)


@query("extra_dimensions", "SELECT user_id AS subject, count(DISTINCT event_type) AS dims FROM events GROUP BY 1 HAVING count(DISTINCT event_type) <> 5")
def _(spark: SparkSession, d: str) -> DataFrame:
    return C.read(spark, d, "events").groupBy(F.col("user_id").alias("subject")).agg(F.countDistinct("event_type").alias("dims")).filter("dims <> 5")


@query("border_override", W("SELECT subject, x, y, z, round(CASE WHEN x < 1 OR x >= 9 OR y < 1 OR y >= 5 OR z < 1 OR z >= 4 THEN 0 ELSE tmax END, 9) AS tmax FROM vox", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.vox(spark, d).select(*KEY, F.when(V.border(C.NX, C.NY, C.NZ, 1), 0.0).otherwise(F.col("tmax")).alias("tmax")), 9)


_PAD = """
WITH v AS (SELECT subject, x, y, z, tmax FROM vox WHERE z < 3 + subject % 3)
SELECT subject, x, y, z + 2 - subject % 3 AS z, round(tmax, 9) AS tmax FROM v
UNION ALL SELECT DISTINCT subject, x, y, p AS z, 0.0 AS tmax FROM v, (VALUES (0), (1)) t(p) WHERE p < 2 - subject % 3
"""


@query("pad_grid", W(_PAD, "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(V.pad_grid(C.vox(spark, d).filter(F.col("z") < 3 + F.col("subject") % 3).select(*KEY, "tmax"), ("tmax",)), 9)


@query("side_mask", W("SELECT subject, x, y, z, CASE WHEN subject % 10 > 5 THEN x < 5 ELSE x >= 5 END AS opposite FROM vox", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return C.vox(spark, d).select(*KEY, V.opposite_side(F.col("subject") % 10, C.NX).alias("opposite"))


@query("model_class", W("SELECT model, rf, fold, round(roc_auc, 6) AS roc_auc, CASE WHEN model = 'A' THEN 'Threshold' WHEN model = 'N' THEN 'Regression' ELSE 'Other' END || '-rf' || rf AS tag FROM runs WHERE rf <> 4", "runs"))
def _(spark: SparkSession, d: str) -> DataFrame:
    tag = F.concat(K.last_rule(F.col("model"), (("N", "Regression"), ("A", "Threshold")), F.lit("Other")), F.lit("-rf"), F.col("rf").cast("string"))
    return rounded(C.runs(spark, d).filter("rf <> 4").select("model", "rf", "fold", "roc_auc", tag.alias("tag")))
