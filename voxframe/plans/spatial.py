"""Queries of stencils, windows, morphology, regions and distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe import carriers as C
from voxframe.carriers import with_views as W
from voxframe.operators import components as G
from voxframe.operators import normalise as N
from voxframe.operators import reports as E
from voxframe.operators import spatial as P
from voxframe.plans.registry import query, rounded

KEY = ("subject", "x", "y", "z")
SHAPE = (C.NX, C.NY, C.NZ)


def kernel_sql(name: str, source: str, axis: str, n: int, weights: list[float], value: str = "v") -> str:
    """One smoothing pass as a CTE: edges mirrored with the edge repeated."""
    r = len(weights) // 2
    rows = ", ".join(f"({k - r}, {w!r}::DOUBLE)" for k, w in enumerate(weights))
    rest = [a for a in KEY if a != axis]
    at = f"(t.{axis} + k.o)"
    mirrored = f"CASE WHEN {at} < 0 THEN -1 - {at} WHEN {at} >= {n} THEN {2 * n - 1} - {at} ELSE {at} END"
    on = " AND ".join(f"s.{a} = t.{a}" for a in rest)
    return f"{name} AS (SELECT {', '.join(f't.{a}' for a in KEY)}, sum(s.{value} * k.w) AS {value} FROM {source} t, (VALUES {rows}) k(o, w), {source} s WHERE {on} AND s.{axis} = {mirrored} GROUP BY ALL)"


_W5 = P.gaussian_weights(5)
_W3 = P.gaussian_weights(3)


@query("stencil_join", W(f"WITH g AS (SELECT subject, x, y, z, tmax AS v FROM vox), {kernel_sql('a', 'g', 'x', C.NX, _W3)} SELECT subject, x, y, z, round(v, 6) AS tmax FROM a", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.stencil(C.vox(spark, d), ("tmax",), "x", C.NX, _W3))


@query("gaussian_smooth_2d", W(f"WITH g AS (SELECT subject, x, y, z, tmax AS v FROM vox), {kernel_sql('a', 'g', 'x', C.NX, _W5)}, {kernel_sql('b', 'a', 'y', C.NY, _W5)} SELECT subject, x, y, z, round(v, 6) AS tmax FROM b", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.gaussian_smooth(C.vox(spark, d), ("tmax",), SHAPE, 5))


@query("gaussian_smooth_3d", W(f"WITH g AS (SELECT subject, x, y, z, tmax AS v FROM vox), {kernel_sql('a', 'g', 'x', C.NX, _W3)}, {kernel_sql('b', 'a', 'y', C.NY, _W3)}, {kernel_sql('c', 'b', 'z', C.NZ, _W3)} SELECT subject, x, y, z, round(v, 6) AS tmax FROM c", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.gaussian_smooth(C.vox(spark, d), ("tmax",), SHAPE, 3, "xyz"))


def _ball(source: str, function: str) -> str:
    """CTE body: maximum or minimum of a voxel and its six neighbours; a missing neighbour counts as 0."""
    return f"SELECT v.subject, v.x, v.y, v.z, CAST({function}(coalesce(o.m, 0)) AS INT) AS m FROM {source} v CROSS JOIN (VALUES (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) k(a, b, c) LEFT JOIN {source} o ON o.subject = v.subject AND o.x = v.x + a AND o.y = v.y + b AND o.z = v.z + c GROUP BY ALL"


def _box(source: str, function: str, low: int, high: int) -> str:
    n = ", ".join(f"({k})" for k in range(low, high + 1))
    return f"SELECT v.subject, v.x, v.y, v.z, CAST({function}(coalesce(o.m, 0)) AS INT) AS m FROM {source} v CROSS JOIN (VALUES {n}) i(a) CROSS JOIN (VALUES {n}) j(b) CROSS JOIN (VALUES {n}) k(c) LEFT JOIN {source} o ON o.subject = v.subject AND o.x = v.x + a AND o.y = v.y + b AND o.z = v.z + c GROUP BY ALL"


_M = "WITH g AS (SELECT subject, x, y, z, CASE WHEN tmax > 4 THEN 1 ELSE 0 END AS m FROM vox)"


def late(spark: SparkSession, d: str, limit: float = 4) -> DataFrame:
    return C.vox(spark, d).select(*KEY, F.when(F.col("tmax") > limit, 1).otherwise(0).alias("m"))


@query("dilate", W(f"{_M}, a AS ({_ball('g', 'max')}) SELECT * FROM a", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return P.dilate(late(spark, d), "m")


@query("erode", W(f"{_M}, a AS ({_box('g', 'min', -1, 0)}) SELECT * FROM a", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return P.erode(late(spark, d), "m", 2)


@query("closing", W(f"{_M}, a AS ({_ball('g', 'max')}), b AS ({_ball('a', 'min')}) SELECT * FROM b", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return P.closing(late(spark, d), "m")


@query("opening", W(f"{_M}, a AS ({_box('g', 'min', -1, 0)}), b AS ({_box('a', 'max', 0, 1)}) SELECT * FROM b", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return P.opening(late(spark, d), "m", 2)


_CSF_MASK = f"""WITH l AS (SELECT subject, avg(cbf) - 1.96 * stddev_pop(cbf) AS t FROM vox WHERE cbf > 0 AND cbf < 90 GROUP BY 1),
g AS (SELECT subject, x, y, z, CASE WHEN cbf > 0 AND cbf < t THEN 1 ELSE 0 END AS m FROM vox LEFT JOIN l USING (subject)),
a AS ({_box('g', 'min', -1, 0)}), b AS ({_box('a', 'max', 0, 1)}), c AS ({_box('b', 'max', -1, 2)}), e AS ({_box('c', 'min', -2, 1)})
SELECT subject, x, y, z, CASE WHEN x < 1 OR x >= 9 OR y < 1 OR y >= 5 OR z < 1 OR z >= 4 THEN 0 ELSE m END AS csf, 1 - CASE WHEN x < 1 OR x >= 9 OR y < 1 OR y >= 5 OR z < 1 OR z >= 4 THEN 0 ELSE m END AS brain FROM e"""


@query("csf_mask", W(_CSF_MASK, "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """Threshold, opening by 2, closing by 4, border cleared; brain is what is left."""
    from voxframe.functions import voxel as V

    v = N.csf_threshold(C.vox(spark, d), "cbf", high=90.0).select(*KEY, "csf")
    v = P.closing(P.opening(v, "csf", 2), "csf", 4).withColumn("csf", F.when(V.border(*SHAPE, 1), 0).otherwise(F.col("csf")))
    return v.withColumn("brain", 1 - F.col("csf"))


@query("undefined_count", W("SELECT v.subject, v.x, v.y, v.z, 45 - sum(o.mask) AS undefined FROM vox v JOIN vox o ON o.subject = v.subject AND abs(o.x - v.x) <= 1 AND abs(o.y - v.y) <= 2 AND abs(o.z - v.z) <= 1 GROUP BY ALL", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return P.undefined_count(C.vox(spark, d), "mask", (1, 2, 1)).select(*KEY, "undefined")


_FIELD = """WITH o AS (SELECT c, a, b, e, ((c * 3 + a + 1) * 3 + b + 1) * 1 + e AS i FROM range(2) c(c), range(-1, 2) a(a), range(-1, 2) b(b), range(1) e(e)),
f AS (SELECT v.subject, v.x, v.y, v.z, o.i, coalesce(CASE WHEN o.c = 0 THEN n.tmax ELSE n.mtt END, 0) AS u FROM vox v CROSS JOIN o LEFT JOIN vox n ON n.subject = v.subject AND n.x = v.x + o.a AND n.y = v.y + o.b AND n.z = v.z)
SELECT subject, x, y, z, CAST(i AS INT) AS i, round(u, 9) AS value FROM f"""


@query("receptive_field", W(_FIELD, "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """Radius 1, flat in z, two channels; one row per feature for comparison."""
    return rounded(P.receptive_field(C.vox(spark, d), ("tmax", "mtt"), (1, 1, 0)).select(*KEY, F.posexplode("features").alias("i", "value")), 9)


_FIELD3 = """WITH o AS (SELECT a, b, e, ((a + 3) * 7 + b + 3) * 7 + e + 3 AS i FROM range(-3, 4) a(a), range(-3, 4) b(b), range(-3, 4) e(e)),
f AS (SELECT v.subject, v.x, v.y, v.z, count(*) AS inside, sum(n.mask) AS masked, sum((i + 1) * n.tmax) AS s0, sum((i + 344) * n.cbf) AS s1, sum((i + 687) * n.mtt) AS s2, sum((i + 1030) * n.cbv) AS s3
 FROM vox v CROSS JOIN o JOIN vox n ON n.subject = v.subject AND n.x = v.x + o.a AND n.y = v.y + o.b AND n.z = v.z + o.e WHERE v.mask = 1 AND v.label = 1 GROUP BY ALL)
SELECT subject, x, y, z, 1372 AS n, CAST(343 - masked AS BIGINT) AS undefined, round(s0 + s1 + s2 + s3, 3) AS weighted FROM f"""


@query("receptive_field_rf3", W(_FIELD3, "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """Radius 3 in all directions, four channels, for the masked voxels of lesions; the 1372 values told by their sum weighted by place."""
    v = C.vox(spark, d).withColumn("chosen", F.when((F.col("mask") == 1) & (F.col("label") == 1), 1).otherwise(0))
    field = P.receptive_field(v, C.CHANNELS, (3, 3, 3), "chosen", "mask")
    weighted = F.aggregate(F.transform("features", lambda u, i: u * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return field.select(*KEY, F.size("features").alias("n"), "undefined", F.round(weighted, 3).alias("weighted"))


_ROLL = """WITH o AS (SELECT a, b, a * 3 + b AS i FROM range(2) a(a), range(3) b(b))
SELECT v.subject, v.x, v.y, v.z, CAST(o.i AS INT) AS i, round(n.tmax, 9) AS value FROM vox v CROSS JOIN o JOIN vox n ON n.subject = v.subject AND n.x = v.x + 2 * o.a AND n.y = v.y + o.b AND n.z = v.z WHERE v.x % 2 = 0 AND v.x + 2 < 10 AND v.y + 2 < 6"""


@query("rolling_window", W(_ROLL, "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """2 x 3 windows, every second x, dilated by two along x."""
    w = P.rolling_window(C.vox(spark, d), "tmax", SHAPE, (2, 3, 0), (2, 1, 1), (2, 1, 1))
    return rounded(w.select(*KEY, F.posexplode("window").alias("i", "value")), 9)


_REGION = f"""WITH g AS (SELECT subject * 2 + x // 5 AS subject, x % 5 AS x, y, z, cbf AS v FROM vox), {kernel_sql('a', 'g', 'x', 5, _W5)}, {kernel_sql('b', 'a', 'y', C.NY, _W5)},
m AS (SELECT subject // 2 AS subject, 9 - (x + 5 * (subject % 2)) AS x, y, z, v FROM b)
SELECT vox.subject, vox.x, vox.y, vox.z, round(CASE WHEN v <> 0 THEN cbf / v END, 6) AS ratio FROM vox LEFT JOIN m USING (subject, x, y, z)"""


@query("region_mirror_ratio", W(_REGION, "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.region_mirror_ratio(C.vox(spark, d), "cbf", SHAPE).select(*KEY, "ratio"))


@query("center_slices", W("SELECT subject, x, y, z, 'x' AS plane, round(tmax, 9) AS tmax FROM vox WHERE x = 4 UNION ALL SELECT subject, x, y, z, 'y', round(tmax, 9) FROM vox WHERE y = 2 UNION ALL SELECT subject, x, y, z, 'z', round(tmax, 9) FROM vox WHERE z = 2", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.center_slices(C.vox(spark, d), SHAPE).select(*KEY, "plane", "tmax"), 9)


_PAIRS = """WITH t AS (SELECT subject, x, y, z FROM vox WHERE label = 1 AND cbv < 6), p AS (SELECT subject, x, y, z FROM vox WHERE tmax > 10),
d AS (SELECT t.subject, t.x, t.y, t.z, min(sqrt((t.x - p.x) ** 2 + (t.y - p.y) ** 2 + (t.z - p.z) ** 2)) AS d FROM t JOIN p USING (subject) GROUP BY ALL),
e AS (SELECT p.subject, p.x, p.y, p.z, min(sqrt((t.x - p.x) ** 2 + (t.y - p.y) ** 2 + (t.z - p.z) ** 2)) AS d FROM p JOIN t USING (subject) GROUP BY ALL)"""


def two_masks(spark: SparkSession, d: str) -> DataFrame:
    return C.vox(spark, d).select(*KEY, F.when((F.col("label") == 1) & (F.col("cbv") < 6), 1).otherwise(0).alias("truth"), F.when(F.col("tmax") > 10, 1).otherwise(0).alias("predicted"))


@query("nearest_point", W(_PAIRS + " SELECT subject, x, y, z, round(d, 6) AS distance FROM d", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    near = P.squared_distance(two_masks(spark, d), "predicted")
    return rounded(near.filter("truth = 1 AND d2 IS NOT NULL").select(*KEY, F.sqrt(F.col("d2").cast("double")).alias("distance")))


@query("hausdorff", W(_PAIRS + " SELECT s.subject, round(max(d), 6) AS hausdorff FROM (SELECT DISTINCT subject FROM vox) s LEFT JOIN d USING (subject) GROUP BY 1", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.hausdorff(two_masks(spark, d), "truth", "predicted").select("subject", "hausdorff"))


@query("modified_hausdorff", W(_PAIRS + ", a AS (SELECT subject, avg(d) AS m FROM d GROUP BY 1), b AS (SELECT subject, avg(d) AS m FROM e GROUP BY 1) SELECT s.subject, round(a.m, 6) AS mean_truth_to_predicted, round(b.m, 6) AS mean_predicted_to_truth, round(CASE WHEN a.m IS NOT NULL AND b.m IS NOT NULL THEN greatest(a.m, b.m) END, 6) AS modified_hausdorff FROM (SELECT DISTINCT subject FROM vox) s LEFT JOIN a USING (subject) LEFT JOIN b USING (subject)", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.hausdorff(two_masks(spark, d), "truth", "predicted").drop("hausdorff"))


_REGIONS = """WITH RECURSIVE g AS (SELECT subject, x, y, z, x * 30 + y * 5 + z AS id FROM vox WHERE tmax > 8.5),
e AS (SELECT a.subject, a.id AS a, b.id AS b FROM g a JOIN g b ON a.subject = b.subject AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1),
r AS (SELECT subject, id, id AS root FROM g UNION SELECT r.subject, e.b, r.root FROM r JOIN e ON e.subject = r.subject AND e.a = r.id),
c AS (SELECT subject, id, min(root) AS region FROM r GROUP BY 1, 2), n AS (SELECT subject, region FROM c GROUP BY 1, 2 HAVING count(*) >= 4)
SELECT v.subject, v.x, v.y, v.z, CASE WHEN n.region IS NULL THEN 0 ELSE 1 END AS m FROM vox v LEFT JOIN c ON c.subject = v.subject AND c.id = v.x * 30 + v.y * 5 + v.z LEFT JOIN n ON n.subject = c.subject AND n.region = c.region"""


@query("remove_small_objects", _REGIONS.replace("WITH RECURSIVE g", f"WITH RECURSIVE vox AS ({C.VOX}), g"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return G.remove_small_objects(late(spark, d, 8.5), "m", 4)


def _smooth_oracle() -> str:
    from voxframe.plans.scoring import smooth_sql

    return f"WITH RECURSIVE vox AS ({C.VOX}), late AS MATERIALIZED (SELECT subject, x, y, z, CASE WHEN tmax > 8 THEN 1 ELSE 0 END AS m FROM vox), {smooth_sql('late', 10)} SELECT * FROM kept"


@query("smooth_mask", _smooth_oracle)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Closing and opening by the six-neighbour ball, then regions under 10 voxels dropped."""
    return E.smooth_masks(late(spark, d, 8), ("m",), 10)


def stepped(spark: SparkSession, d: str) -> DataFrame:
    """Channels in coarse steps, so that neighbouring voxels can be equal."""
    return C.vox(spark, d).select(*KEY, *[F.floor(F.col(c) / w).alias(c) for c, w in (("tmax", 6.0), ("cbf", 60.0), ("mtt", 10.0), ("cbv", 5.0))])


@query("background_component", f"""WITH RECURSIVE vox AS ({C.VOX}), g AS (SELECT subject, x, y, z, x * 30 + y * 5 + z AS id, floor(tmax / 6.0) AS v FROM vox),
r AS (SELECT subject, x, y, z, v FROM g WHERE id = 0 UNION SELECT n.subject, n.x, n.y, n.z, n.v FROM r JOIN g n ON n.subject = r.subject AND n.v = r.v AND abs(n.x - r.x) <= 1 AND abs(n.y - r.y) <= 1 AND abs(n.z - r.z) <= 1)
SELECT subject, x, y, z FROM r""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return G.background_component(stepped(spark, d), "tmax")


_BACKGROUND = """WITH RECURSIVE vox AS ({vox}), g AS MATERIALIZED ({images}),
r AS (SELECT subject, channel, x, y, z, v FROM g WHERE x = 0 AND y = 0 AND z = 0 UNION SELECT n.subject, n.channel, n.x, n.y, n.z, n.v FROM r JOIN g n ON n.subject = r.subject AND n.channel = r.channel AND n.v = r.v AND abs(n.x - r.x) <= 1 AND abs(n.y - r.y) <= 1 AND abs(n.z - r.z) <= 1),
b AS (SELECT subject, x, y, z, count(DISTINCT channel) AS n FROM r GROUP BY ALL) SELECT v.subject, v.x, v.y, v.z, CASE WHEN n = 4 THEN 1 ELSE 0 END AS background, CASE WHEN n = 4 THEN 0 ELSE 1 END AS brain FROM vox v LEFT JOIN b USING (subject, x, y, z)"""
_STEPS = (("tmax", 9.0), ("cbf", 60.0), ("mtt", 15.0), ("cbv", 8.0))


@query("brain_mask", _BACKGROUND.format(vox=C.VOX, images=" UNION ALL ".join(f"SELECT subject, '{c}' AS channel, x, y, z, floor({c} / {w}) AS v FROM vox" for c, w in _STEPS)))
def _(spark: SparkSession, d: str) -> DataFrame:
    """Channels in coarse steps, so that each has a background."""
    v = C.vox(spark, d).select(*KEY, *[F.floor(F.col(c) / w).alias(c) for c, w in _STEPS])
    return G.brain_mask(v, C.CHANNELS).select(*KEY, "background", "brain")


@query("reconstruct_grid", W("SELECT subject, x, y, z, round(CASE WHEN mask = 1 AND tmax > 6 THEN tmax ELSE 0 END, 9) AS tmax FROM vox", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """Sparse values put back on the dense grid, 0 elsewhere."""
    v = C.vox(spark, d)
    return rounded(P.reconstruct_grid(v.filter("mask = 1 AND tmax > 6"), ("tmax",), SHAPE, v), 9)


@query("masked_voxels", W("SELECT subject, x, y, z, round(tmax, 9) AS tmax FROM vox WHERE mask = 1", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.vox(spark, d).filter("mask = 1").select(*KEY, "tmax"), 9)


@query("image_difference", W("SELECT a.subject, a.x, a.y, a.z, round(CASE WHEN a.mask = 1 THEN a.cbf - b.cbf ELSE 0 END, 6) AS difference FROM vox a JOIN vox b ON b.subject = a.subject + 1 AND b.x = a.x AND b.y = a.y AND b.z = a.z", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """Each subject's image less the next subject's, masked."""
    v = C.vox(spark, d)
    return rounded(P.image_difference(v, v.withColumn("subject", F.col("subject") - 1), "cbf"))


@query("align_channels", W("SELECT subject, x, y, z, round(tmax, 9) AS tmax, round(cbf, 9) AS cbf, round(mtt, 9) AS mtt, round(cbv, 9) AS cbv FROM vox", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """One image per channel brought onto one key; a voxel that lacks a channel raises."""
    images = C.vox(spark, d).select(*KEY, F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("value")) for c in C.CHANNELS])).alias("s")).select(*KEY, "s.channel", "s.value")
    return rounded(P.align_channels(images, C.CHANNELS), 9)


@query("mask_set_ops", W("SELECT subject, sum(CASE WHEN tmax > 6 OR label = 1 THEN 1 ELSE 0 END) AS in_union, sum(CASE WHEN tmax > 6 AND label = 1 THEN 1 ELSE 0 END) AS in_both FROM vox GROUP BY 1", "vox"))
def _(spark: SparkSession, d: str) -> DataFrame:
    v = C.vox(spark, d)
    a, b = v.filter("tmax > 6"), v.filter("label = 1")
    n = lambda df, name: df.groupBy("subject").agg(F.count("*").alias(name))
    counts = v.select("subject").distinct().join(n(P.mask_union(a, b), "in_union"), "subject", "left").join(n(P.mask_intersection(a, b), "in_both"), "subject", "left")
    return counts.fillna(0)
