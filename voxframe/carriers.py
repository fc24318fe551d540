"""Views that let the driver's star-schema tables stand in for voxel volumes, cohorts, inventories and model runs.

The same views exist as SQL text, so that each operator's oracle reads exactly what the operator reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NX, NY, NZ = 10, 6, 5
GRID = NX * NY * NZ
CHANNELS = ("tmax", "cbf", "mtt", "cbv")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _volumes(spark: SparkSession, sf_dir: str, nx: int, ny: int, nz: int) -> DataFrame:
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    k = F.col("o_orderkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.floor(k / (nx * ny * nz)).alias("subject"),
        (k % nx).cast("int").alias("x"),
        (F.floor(k / nx) % ny).cast("int").alias("y"),
        (F.floor(k / (nx * ny)) % nz).cast("int").alias("z"),
        (F.col("o_totalprice") / 40000.0).alias("tmax"),
        ((F.col("c_acctbal") + 1000.0) / 100.0).alias("cbf"),
        ((k * 7919 % 1000).cast("double") / 50).alias("mtt"),
        ((F.col("o_custkey") % 97).cast("double") / 10).alias("cbv"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"),
        F.when(F.col("o_orderpriority") != "5-LOW", 1).otherwise(0).alias("mask"),
    )


def vox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes of 10 x 6 x 5 voxels: subject, x, y, z, the four channels, label and mask."""
    return _volumes(spark, sf_dir, NX, NY, NZ)


def vox15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As vox with an odd width of 15 (15 x 5 x 4)."""
    return _volumes(spark, sf_dir, 15, 5, 4)


def vox_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As vox with tmax ten times too large in one subject of 17."""
    return vox(spark, sf_dir).withColumn("tmax", F.when(F.col("subject") % 17 == 3, F.col("tmax") * 10).otherwise(F.col("tmax")))


def vox4d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time-resolved volumes: subject, t (three points), voxel_id, v."""
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(F.floor(k / GRID).alias("subject"), (k % GRID % 3).cast("int").alias("t"), F.floor(k % GRID / 3).cast("int").alias("voxel_id"), (F.col("o_totalprice") / 40000.0).alias("v"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifier scores with ties: id, score, y."""
    return read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id").select(F.col("doc_id").alias("id"), (F.col("n_chars").cast("double") / 20000).alias("score"), F.col("quality").alias("y"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of repeated model runs: model, rf, fold, roc_auc, dice."""
    keys = (F.col("l_returnflag").alias("model"), (F.col("l_linenumber") - 1).alias("rf"), (F.col("l_suppkey") % 10).cast("int").alias("fold"))
    return read(spark, sf_dir, "lineitem").groupBy(*keys).agg((F.avg("l_extendedprice") / 100000.0).alias("roc_auc"), (F.avg("l_quantity") / 50.0).alias("dice"))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan inventory: subject, modality, study, n_files, ts."""
    keys = (F.col("user_id").alias("subject"), F.date_trunc("week", "ts").cast("date").alias("modality"), F.col("event_type").alias("study"))
    return read(spark, sf_dir, "events").groupBy(*keys).agg(F.count("*").alias("n_files"), F.min("ts").alias("ts"))


def clinical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohort sheet with out-of-range ages, unknown tokens, nulls and padding."""
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        k.alias("subject"), F.col("c_name").alias("name"), (20 + k % 110).cast("double").alias("age"), F.when(k % 3 == 0, "m").when(k % 3 == 1, "f").otherwise("?").alias("sex"), F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" ")).alias("onset_known"),
        F.col("c_acctbal").alias("glucose"), F.when(k % 4 == 0, "yes").when(k % 4 == 1, "no").alias("smoking"), F.when(F.col("c_mktsegment") == "BUILDING", "yes").when(F.col("c_mktsegment") == "MACHINERY", "no").otherwise("?").alias("treat"),
    )


def _vox_sql(nx: int, ny: int, nz: int) -> str:
    return f"""SELECT o_orderkey // {nx * ny * nz} AS subject, CAST(o_orderkey % {nx} AS INT) AS x, CAST((o_orderkey // {nx}) % {ny} AS INT) AS y,
 CAST((o_orderkey // {nx * ny}) % {nz} AS INT) AS z, o_totalprice / 40000.0 AS tmax, (c_acctbal + 1000.0) / 100.0 AS cbf,
 CAST(o_orderkey * 7919 % 1000 AS DOUBLE) / 50 AS mtt, CAST(o_custkey % 97 AS DOUBLE) / 10 AS cbv,
 CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, CASE WHEN o_orderpriority <> '5-LOW' THEN 1 ELSE 0 END AS mask
 FROM orders JOIN customer ON o_custkey = c_custkey"""


VOX = _vox_sql(NX, NY, NZ)
VOX15 = _vox_sql(15, 5, 4)
VOX_OUT = f"SELECT * REPLACE (tmax * CASE WHEN subject % 17 = 3 THEN 10 ELSE 1 END AS tmax) FROM ({VOX})"
VOX4D = f"SELECT o_orderkey // {GRID} AS subject, CAST((o_orderkey % {GRID}) % 3 AS INT) AS t, CAST((o_orderkey % {GRID}) // 3 AS INT) AS voxel_id, o_totalprice / 40000.0 AS v FROM orders"
SCORED = "SELECT l.doc_id AS id, CAST(d.n_chars AS DOUBLE) / 20000 AS score, l.quality AS y FROM labels l JOIN documents d ON l.doc_id = d.doc_id"
RUNS = "SELECT l_returnflag AS model, l_linenumber - 1 AS rf, CAST(l_suppkey % 10 AS INT) AS fold, AVG(l_extendedprice) / 100000.0 AS roc_auc, AVG(l_quantity) / 50.0 AS dice FROM lineitem GROUP BY ALL"
INV = "SELECT user_id AS subject, CAST(date_trunc('week', ts) AS DATE) AS modality, event_type AS study, COUNT(*) AS n_files, MIN(ts) AS ts FROM events GROUP BY ALL"
CLIN = """SELECT c_custkey AS subject, c_name AS name, CAST(20 + c_custkey % 110 AS DOUBLE) AS age, CASE c_custkey % 3 WHEN 0 THEN 'm' WHEN 1 THEN 'f' ELSE '?' END AS sex,
 concat(' ', c_mktsegment, ' ') AS onset_known, c_acctbal AS glucose, CASE c_custkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS smoking,
 CASE c_mktsegment WHEN 'BUILDING' THEN 'yes' WHEN 'MACHINERY' THEN 'no' ELSE '?' END AS treat FROM customer"""
VIEWS = {"vox": VOX, "vox15": VOX15, "vox_out": VOX_OUT, "vox4d": VOX4D, "scored": SCORED, "runs": RUNS, "inv": INV, "clin": CLIN}


def with_views(sql: str, *names: str) -> str:
    """The query with the named views in front of it."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + (", " if sql.lstrip().upper().startswith("WITH ") else " ") + (sql.lstrip()[5:] if sql.lstrip().upper().startswith("WITH ") else sql)
