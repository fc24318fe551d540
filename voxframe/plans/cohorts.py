"""Queries of cohorts and scan inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe import carriers as C
from voxframe.carriers import with_views as W
from voxframe.functions import cohort as K
from voxframe.operators import cohort as O
from voxframe.plans.registry import query, rounded


@query("select_channels", W("""WITH w AS (SELECT * FROM (VALUES (0, 'cl'), (1, 'p'), (2, 'e')) t(position, prefix)),
h AS (SELECT subject, modality, position, prefix, study, row_number() OVER (PARTITION BY subject, modality, position ORDER BY lower(study), study) AS nth, count(*) OVER (PARTITION BY subject, modality, position) AS n FROM inv JOIN w ON starts_with(study, prefix))
SELECT subject, modality, position, prefix, nth, study, n > 1 AS problem FROM h WHERE nth <= 1""", "inv"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return O.select_channels(C.inventory(spark, d), ("cl", "p", "e"))


_STUDIES = ("click", "view", "purchase")
_FLAGS = ", ".join(f"max(CASE WHEN contains(study, '{s}') THEN 1 ELSE 0 END) AS has_{s}" for s in _STUDIES)
_COMPLETE = f"""WITH f AS (SELECT {{k}}, {_FLAGS} FROM inv WHERE n_files >= 3 GROUP BY ALL),
m AS (SELECT *, concat_ws(',', {', '.join(f"CASE WHEN has_{s} = 0 THEN '{s}' END" for s in _STUDIES)}) AS missing FROM f) SELECT *, CASE WHEN missing = '' THEN 1 ELSE 0 END AS complete FROM m"""


@query("completeness_flags", W(_COMPLETE.format(k="subject, modality"), "inv"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return O.completeness(C.inventory(spark, d).filter("n_files >= 3"), ("subject", "modality"), _STUDIES)


@query("complete_subjects", W(f"WITH c AS ({_COMPLETE.format(k='subject')}) SELECT subject FROM c WHERE complete = 1".replace("WITH c AS (WITH f", "WITH c AS (WITH f"), "inv"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return O.completeness(C.inventory(spark, d).filter("n_files >= 3"), ("subject",), _STUDIES).filter("complete = 1").select("subject")


@query("imaging_state", W("SELECT subject, max(CASE WHEN study = 'click' THEN 1 ELSE 0 END) AS has_click, max(CASE WHEN study = 'view' THEN 1 ELSE 0 END) AS has_view, CASE WHEN max(CASE WHEN study = 'click' THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN study = 'view' THEN 1 ELSE 0 END) = 1 THEN 1 ELSE 0 END AS has_all, max(CASE WHEN study NOT IN ('click', 'view', 'purchase') THEN 1 ELSE 0 END) AS has_unknown FROM inv GROUP BY 1", "inv"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return O.imaging_state(C.inventory(spark, d), ("click", "view"), _STUDIES)


@query("map_count_rule", W("SELECT subject, modality, count(*) AS maps, count(*) FILTER (n_files = 3) AS exact FROM inv WHERE study <> 'error' GROUP BY ALL HAVING count(*) FILTER (n_files >= 3) > 0 AND NOT (count(*) = 4 AND count(*) FILTER (n_files = 3) = 4)", "inv"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """Groups with a large series that do not hold all four maps with exactly the wanted number of files."""
    return O.map_count_rule(C.inventory(spark, d).filter("study <> 'error'"), 4, 3)


@query("empty_groups", W("SELECT c.subject FROM clin c WHERE NOT EXISTS (SELECT 1 FROM inv i WHERE i.subject = c.subject AND i.study <> 'error')", "clin", "inv"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """Declared groups without a visible member."""
    return O.empty_groups(C.clinical(spark, d), C.inventory(spark, d).filter("study <> 'error'"))


_SELECTION = """WITH g AS (SELECT subject, modality, max(CASE WHEN study = 'click' THEN 1 ELSE 0 END) AS a, max(CASE WHEN study = 'view' THEN 1 ELSE 0 END) AS b, max(CASE WHEN study = 'purchase' THEN 1 ELSE 0 END) AS angio FROM inv WHERE n_files >= 3 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY modality) AS nth, count(*) OVER (PARTITION BY subject) AS hits FROM g WHERE a = 1 AND b = 1)
SELECT subject, modality, hits > 1 AS several, CASE WHEN angio = 1 THEN 'selected' ELSE 'no angio' END AS result FROM r WHERE nth = 1 UNION ALL SELECT DISTINCT subject, NULL, false, 'no series' FROM inv WHERE subject NOT IN (SELECT subject FROM r)"""


@query("scan_selection", W(_SELECTION, "inv"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """Per subject the first group with both series; missing angio and subjects without such a group are logged as results."""
    return O.scan_selection(C.inventory(spark, d), ("click", "view"), "purchase", 3, "no angio")


@query("label_presence", W("SELECT subject, bool_or(study = 'error') AS has_label FROM inv WHERE n_files >= 3 GROUP BY 1", "inv"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return O.label_presence(C.inventory(spark, d), "error", 3)


@query("input_presence_log", W("SELECT c.subject, p.prefix, count(i.study) FILTER (starts_with(i.study, p.prefix)) AS n, CASE WHEN count(i.study) FILTER (starts_with(i.study, p.prefix)) = 0 THEN 'exclude' ELSE 'warning' END AS level FROM clin c CROSS JOIN (VALUES ('view'), ('pur')) p(prefix) LEFT JOIN inv i ON i.subject = c.subject WHERE c.subject % 4 <> 0 GROUP BY ALL HAVING count(i.study) FILTER (starts_with(i.study, p.prefix)) <> 1", "clin", "inv"))
def _(spark: SparkSession, d: str) -> DataFrame:
    s = C.clinical(spark, d).select("subject")
    return O.presence_log(s, C.inventory(spark, d), ("view", "pur"), s.filter("subject % 4 = 0"))


@query("device_inventory", "SELECT p_type AS modality, p_brand AS maker, count(*) AS n, count(DISTINCT p_size) AS models, min(p_partkey) AS first_part FROM part GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    scans = C.read(spark, d, "part").select(F.col("p_type").alias("modality"), F.col("p_brand").alias("maker"), "p_size", F.col("p_partkey").alias("part"))
    return O.device_inventory(scans, ("modality", "maker"), "p_size", "part")


_TIMELINE = "a AS (SELECT user_id AS subject, min(ts) AS ts FROM events WHERE event_type = 'signup' GROUP BY 1)"


@query("first_after", f"WITH {_TIMELINE}, c AS (SELECT a.subject, a.ts, e.ts AS c_ts, e.event_type AS kind, CASE WHEN e.event_type = 'error' THEN 0 ELSE 1 END AS o FROM a JOIN events e ON e.user_id = a.subject AND e.ts >= a.ts AND e.event_type IN ('error', 'purchase')), r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY o, c_ts, kind) AS nth, count(*) OVER (PARTITION BY subject) AS n FROM c) SELECT subject, ts, c_ts AS chosen_ts, kind, n > 1 AS several FROM r WHERE nth = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = C.read(spark, d, "events").withColumn("subject", F.col("user_id"))
    anchors = e.filter("event_type = 'signup'").groupBy("subject").agg(F.min("ts").alias("ts"))
    c = e.filter("event_type IN ('purchase', 'view', 'error')").select("subject", "ts", F.col("event_type").alias("kind"), (F.col("event_type") == "error").alias("has_label"), (F.col("event_type") == "purchase").alias("complete"))
    return O.first_after(anchors, c)


@query("fuzzy_match", "WITH l AS (SELECT DISTINCT p_name AS a FROM part), r AS (SELECT DISTINCT left(p_name, length(p_name) - 1) || 'x' AS b FROM part), m AS (SELECT a, b, 1 - levenshtein(a, b) / greatest(length(a), length(b)) AS ratio FROM l CROSS JOIN r), k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY ratio DESC, b) AS n FROM m WHERE ratio > 0.6) SELECT a, b, round(ratio, 6) AS ratio FROM k WHERE n = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = C.read(spark, d, "part").select(F.col("p_name").alias("name"))
    other = p.select(F.expr("concat(left(name, length(name) - 1), 'x')").alias("name"))
    return rounded(O.fuzzy_match(p, other))


@query("block_match")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Names against others with a changed end, a lost stretch or swapped words, by matching blocks."""
    p = C.read(spark, d, "part").select("p_partkey", F.concat_ws("^", "p_name", "p_brand").alias("name"))
    other = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat(left(name, length(name) - 1), 'x') WHEN 1 THEN concat(left(name, 3), substring(name, 8)) ELSE concat_ws(' ', reverse(split(name, ' '))) END")
    return rounded(O.block_match(p, p.select(other.alias("name"))))


@query("merge_cohort", W("SELECT o_orderkey, c.subject, age, sex FROM orders LEFT JOIN clin c ON c.subject = o_custkey AND c.subject % 2 = 0", "clin"))
def _(spark: SparkSession, d: str) -> DataFrame:
    o = C.read(spark, d, "orders").select("o_orderkey", "o_custkey")
    return O.merge_cohort(o, C.clinical(spark, d).filter("subject % 2 = 0"), "o_custkey", ("age", "sex")).drop("o_custkey")


@query("cohort_filter", W("SELECT v.subject, NOT (c.subject IS NULL OR smoking = 'yes') AS included, CASE WHEN c.subject IS NULL THEN 'not found' WHEN smoking = 'yes' THEN 'treated before' END AS reason FROM (SELECT DISTINCT subject FROM vox) v LEFT JOIN (SELECT * FROM clin WHERE subject % 7 <> 0) c USING (subject)".replace("smoking = 'yes')", "coalesce(smoking, '') = 'yes')"), "vox", "clin"))
def _(spark: SparkSession, d: str) -> DataFrame:
    s = C.vox(spark, d).select("subject").distinct()
    return O.cohort_filter(s, C.clinical(spark, d).filter("subject % 7 <> 0"), F.coalesce(F.col("smoking") == "yes", F.lit(False)))


@query("status_split", W("SELECT v.subject, CASE treat WHEN 'yes' THEN 'treated' WHEN 'no' THEN 'untreated' ELSE 'unknown' END AS grp FROM (SELECT DISTINCT subject FROM vox) v JOIN clin USING (subject)", "vox", "clin"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return O.status_split(C.vox(spark, d).select("subject").distinct(), C.clinical(spark, d), "treat", {"yes": "treated", "no": "untreated"}, "unknown")


@query("attach_clinical", W("SELECT subject, x, y, z, round(tmax, 9) AS tmax, age, CASE WHEN sex = 'm' THEN 1 ELSE 0 END AS male FROM vox JOIN clin USING (subject) WHERE mask = 1", "vox", "clin"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """Subject features on every voxel; the join is small against voxels and Spark broadcasts it while it is."""
    c = C.clinical(spark, d).select("subject", "age", K.flag(F.col("sex"), "m").alias("male"))
    return rounded(C.vox(spark, d).filter("mask = 1").select("subject", "x", "y", "z", "tmax").join(c, "subject"), 9)


@query("subset_semi_anti", W("SELECT subject, CASE WHEN treat = 'yes' THEN 'test' ELSE 'train' END AS part, n FROM (SELECT subject, count(*) AS n FROM vox GROUP BY 1) JOIN clin USING (subject)", "vox", "clin"))
def _(spark: SparkSession, d: str) -> DataFrame:
    n = C.vox(spark, d).groupBy("subject").agg(F.count("*").alias("n"))
    return O.split_by_subjects(n, C.clinical(spark, d).filter("treat = 'yes'"))


def lesion_and_reference(spark: SparkSession, d: str) -> DataFrame:
    """Lesion volumes beside an external reference's, under its own name for the subject."""
    v = C.vox(spark, d).groupBy("subject").agg((F.sum("label") * 0.008).alias("ml"))
    return O.volume_reference_join(v, C.read(spark, d, "customer").select(F.col("c_custkey").alias("anonymised_id"), ((F.col("c_acctbal") + 1000) / 1000).alias("external_ml")))


@query("volume_reference_join", W("SELECT v.subject, round(ml, 6) AS ml, round(external_ml, 6) AS external_ml FROM (SELECT subject, sum(label) * 0.008::DOUBLE AS ml FROM vox GROUP BY 1) v JOIN (SELECT c_custkey AS anonymised_id, (c_acctbal + 1000) / 1000 AS external_ml FROM customer) e ON e.anonymised_id = v.subject", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lesion_and_reference(spark, d))


@query("linear_fit", W("SELECT round(regr_slope(external_ml, ml), 6) AS slope, round(regr_intercept(external_ml, ml), 6) AS intercept, round(regr_r2(external_ml, ml), 6) AS r2 FROM (SELECT subject, sum(label) * 0.008::DOUBLE AS ml FROM vox GROUP BY 1) v JOIN (SELECT c_custkey AS subject, (c_acctbal + 1000) / 1000 AS external_ml FROM customer) e USING (subject)", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(O.linear_fit(lesion_and_reference(spark, d), "external_ml", "ml"))


@query("route_series", W("WITH g AS (SELECT study, modality, n_files, min('g' || subject) AS grp FROM inv WHERE subject % 2 = 0 GROUP BY ALL) SELECT i.subject, i.study, i.modality, i.n_files, coalesce(g.grp, i.study || '_' || CAST(i.modality AS VARCHAR)) AS target FROM inv i LEFT JOIN g USING (study, modality, n_files) WHERE i.subject % 2 = 1", "inv"))
def _(spark: SparkSession, d: str) -> DataFrame:
    inv = C.inventory(spark, d)
    groups = inv.filter("subject % 2 = 0").withColumn("grp", F.concat(F.lit("g"), F.col("subject").cast("string")))
    return O.route_series(inv.filter("subject % 2 = 1"), groups, ("study", "modality", "n_files")).select("subject", "study", "modality", "n_files", "target")


@query("cohort_profile", W("SELECT sex, count(*) AS n, round(quantile_cont(age, 0.5), 6) AS median, round(stddev_pop(age), 6) AS std, min(age) AS youngest, max(age) AS oldest, count(*) FILTER (smoking = 'yes') AS smokers FROM clin GROUP BY 1", "clin"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(O.cohort_profile(C.clinical(spark, d), "sex", "age", F.col("smoking") == "yes", "smokers"))


@query("dedupe", "SELECT c_mktsegment, c_nationkey, min(c_custkey) AS kept, count(*) AS n FROM customer GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    keys = ("c_mktsegment", "c_nationkey")
    first, repeated = O.dedupe(C.read(spark, d, "customer"), keys, ("c_custkey",))
    return repeated.groupBy(*keys).agg(F.count("*").alias("n")).join(first.select(*keys, F.col("c_custkey").alias("kept")), list(keys))


@query("unique_path", "SELECT p_partkey, CASE WHEN row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1 THEN p_name ELSE p_brand || '_' || p_name END AS target FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    return O.unique_path(C.read(spark, d, "part"), "p_brand", "p_name", ("p_partkey",)).select("p_partkey", "target")


@query("row_difference", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)")
def _(spark: SparkSession, d: str) -> DataFrame:
    taken = C.read(spark, d, "lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    return O.row_difference(C.read(spark, d, "orders").select("o_orderkey"), taken, ("o_orderkey",))


@query("drop_rows", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 13 <> 5")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = C.read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return O.row_difference(o, o.filter("o_orderkey % 13 = 5"), ("o_orderkey",))


@query("subset_subjects", W("SELECT subject, x, y, z, round(tmax, 9) AS tmax FROM vox WHERE subject IN (SELECT DISTINCT subject FROM vox ORDER BY 1 LIMIT 5)", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """The first five subjects of each table."""
    return rounded(O.first_subjects(C.vox(spark, d), 5).select("subject", "x", "y", "z", "tmax"), 9)


@query("read_cohort", W("SELECT subject, name, age, nullif(sex, '?') AS sex, nullif(treat, '?') AS treat FROM clin", "clin"))
def _(spark: SparkSession, d: str) -> DataFrame:
    from voxframe.sources.tables import read_cohort

    return read_cohort(C.clinical(spark, d), {"subject": "bigint", "name": "string", "age": "double", "sex": "string", "treat": "string", "weight": "double"})


_CHOSEN = """h AS (SELECT subject, modality, position, prefix, study, row_number() OVER (PARTITION BY subject, position ORDER BY modality, lower(study), study) AS nth FROM inv JOIN (VALUES (0, 'cl'), (1, 'view'), (2, 'pur'), (3, 'err')) t(position, prefix) ON starts_with(study, prefix)),
c AS (SELECT subject, modality, position, prefix, study FROM h WHERE nth = 1 AND subject IN (SELECT subject FROM h WHERE nth = 1 GROUP BY 1 HAVING count(*) = 4))"""


@query("choose_sequences", W(f"WITH {_CHOSEN} SELECT * FROM c", "inv"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """The series of a dataset with its label's; event names stand in for series names."""
    return O.choose_sequences(C.inventory(spark, d), ("cl", "view", "pur"), "err")


@query("build_dataset", W(f"WITH {_CHOSEN} SELECT subject, x, y, z, round(tmax, 9) AS tmax, label, age FROM vox JOIN clin USING (subject) WHERE coalesce(smoking, '') <> 'yes' AND subject IN (SELECT subject FROM c)", "vox", "clin", "inv"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """Series chosen, excluded subjects dropped from every table, clinical columns attached to voxels."""
    wanted = O.choose_sequences(C.inventory(spark, d), ("cl", "view", "pur"), "err")
    tables = O.build_dataset({"voxels": C.vox(spark, d).select("subject", "x", "y", "z", "tmax", "label")}, C.clinical(spark, d), F.coalesce(F.col("smoking") == "yes", F.lit(False)), wanted)
    return rounded(tables["voxels"].join(tables["clinical"].select("subject", "age"), "subject"), 9)
