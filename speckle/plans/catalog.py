"""Registered queries, each beside the SQL that says the same. Results are rounded where doubles are summed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speckle.operators import analysis as an
from speckle.operators import blocks as bl
from speckle.operators import detector as dt
from speckle.operators import frames as fr
from speckle.operators import grid
from speckle.operators import known as kn
from speckle.operators import maximize as mx
from speckle.operators import multi as mu
from speckle.operators import orientation as ori
from speckle.operators import views as vw
from speckle.operators import volumes as vo
from speckle.operators.geometry import Axial, Plane, Volume
from speckle.plans import emc, recon
from speckle.sources import tables as tb

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "emc_iteration"
SIZE = tb.MODEL_SIZE


def query(sql: str | None = None):
    """Registers a function under its name; sql follows the common table expressions of the fixtures."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            more = " AS (" in sql.split("SELECT")[0]  # starts with further table expressions
            ORACLE[f.__name__] = tb.SQL + (", " if more else "") + sql
        return f

    return add


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(c, digits) + 0.0)
    return df


# Detector


@query("SELECT pix, ROUND(qx, 6) + 0.0 AS qx, ROUND(qy, 6) + 0.0 AS qy, ROUND(qz, 6) + 0.0 AS qz, ROUND(corr, 9) AS corr, mask FROM det")
def detector_geometry(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tb.detector(spark), "qx", "qy", "qz").select("pix", "qx", "qy", "qz", F.round("corr", 9).alias("corr"), "mask")


@query("SELECT ROUND(m, 6) AS qmax, CAST(2 * CEIL(m) + 3 AS INT) AS size, CAST(FLOOR((2 * CEIL(m) + 3) / 2) AS INT) AS center FROM (SELECT MAX(SQRT(qx*qx + qy*qy + qz*qz)) AS m FROM det WHERE mask < 2)")
def detector_qmax(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(dt.qmax(tb.detector(spark)), "qmax")


@query("SELECT pix, CAST(CASE WHEN mask = 0 AND SQRT(qx*qx + qy*qy + qz*qz) > 2.5 THEN 1 ELSE mask END AS INT) AS mask FROM det")
def detector_remask(spark: SparkSession, sf: str) -> DataFrame:
    return dt.remask(tb.detector(spark), 2.5).select("pix", "mask")


@query("SELECT pix, ROUND(corr / AVG(corr) OVER (), 6) AS corr FROM det")
def detector_corr_normalised(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(dt.normalised_corr(tb.detector(spark)).select("pix", "corr"), "corr")


@query("s AS (SELECT CASE WHEN AVG(qz) > 0 THEN -1.0 ELSE 1.0 END AS s FROM det) SELECT pix, ROUND(qx * 20.0 / (20.0 + s * qz), 6) + 0.0 AS qx, ROUND(qy * 20.0 / (20.0 + s * qz), 6) + 0.0 AS qy, 0.0::DOUBLE AS qz FROM det, s")
def detector_flat(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(dt.flat(tb.detector(spark), 20.0, 20.0).select("pix", "qx", "qy", "qz"), "qx", "qy")


@query("SELECT pix, CAST(x + 3.5 AS INT) AS ix, CAST(y + 3.5 AS INT) AS iy, mask FROM det")
def detector_assembled(spark: SparkSession, sf: str) -> DataFrame:
    return dt.assembled(tb.detector(spark), 20.0, 20.0)


@query("SELECT file_id, 'det_' || (file_id % 2) AS detector, CAST(DENSE_RANK() OVER (ORDER BY 'det_' || (file_id % 2)) - 1 AS INT) AS det_id FROM (SELECT DISTINCT file_id FROM frames)")
def detector_unique(spark: SparkSession, sf: str) -> DataFrame:
    files = tb.frames(spark, sf).select("file_id").distinct().withColumn("detector", F.concat(F.lit("det_"), (F.col("file_id") % 2).cast("string")))
    return dt.unique_detectors(files)


# Frames


@query("SELECT d.pix, CAST(COALESCE(SUM(cnt), 0) AS BIGINT) AS total FROM det d LEFT JOIN photons p ON p.pix = d.pix GROUP BY 1")
def frames_powder(spark: SparkSession, sf: str) -> DataFrame:
    return fr.powder(tb.photons(spark, sf), tb.detector(spark))


@query("SELECT d.pix, ROUND(COALESCE(SUM(cnt), 0) / (SELECT COUNT(*) FROM frames), 9) AS mean FROM det d LEFT JOIN photons p ON p.pix = d.pix WHERE mask < 1 GROUP BY 1")
def frames_mean_powder(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fr.mean_powder(tb.photons(spark, sf), tb.frames(spark, sf), tb.detector(spark)), "mean", digits=9)


@query("SELECT f.frame_id, CAST(COALESCE(s, 0) AS BIGINT) AS fcount FROM frames f LEFT JOIN (SELECT frame_id, SUM(cnt) AS s FROM photons JOIN det USING (pix) WHERE mask < 1 GROUP BY 1) p ON p.frame_id = f.frame_id")
def frames_counts(spark: SparkSession, sf: str) -> DataFrame:
    return fr.frame_counts(tb.photons(spark, sf), tb.frames(spark, sf), tb.detector(spark))


@query("SELECT frame_id, ROUND(SUM(lgamma(cnt + 1)), 6) AS sum_fact FROM photons JOIN det USING (pix) WHERE mask < 1 AND cnt > 1 GROUP BY 1")
def frames_sum_fact(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fr.sum_fact(tb.photons(spark, sf), tb.detector(spark)), "sum_fact")


@query("SELECT frame_id, CAST(COUNT(*) FILTER (cnt = 1) AS INT) AS n_ones, CAST(COUNT(*) FILTER (cnt > 1) AS INT) AS n_multi, MIN(pix) FILTER (cnt = 1) AS first_one, CAST(SUM(cnt) FILTER (cnt > 1) AS BIGINT) AS multi_total FROM photons GROUP BY 1")
def frames_ones_multi(spark: SparkSession, sf: str) -> DataFrame:
    x = fr.ones_multi(tb.photons(spark, sf))
    total = F.when(F.size("count_multi") > 0, F.aggregate("count_multi", F.lit(0).cast("long"), lambda a, v: a + v))
    return x.select("frame_id", F.size("place_ones").alias("n_ones"), F.size("place_multi").alias("n_multi"), F.get("place_ones", F.lit(0)).alias("first_one"), total.alias("multi_total"))


@query("SELECT frame_id, pix, cnt FROM photons")
def frames_layout_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return fr.from_ones_multi(fr.ones_multi(tb.photons(spark, sf)))


@query("SELECT frame_id, pix, CAST(FLOOR(val * 20) AS INT) AS cnt FROM dense JOIN det USING (pix) WHERE mask < 2 AND FLOOR(val * 20) > 0")
def frames_sparsified(spark: SparkSession, sf: str) -> DataFrame:
    return fr.sparsified(tb.dense_frames(spark, sf).withColumn("val", F.floor(F.col("val") * 20).cast("double")), tb.detector(spark))


@query("SELECT file_id, COUNT(*) AS n, CAST(COALESCE(SUM(COUNT(*)) OVER (ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM frames GROUP BY 1")
def frames_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return fr.offsets(tb.frames(spark, sf))


@query("""o AS (SELECT file_id, COUNT(*) AS n, COALESCE(SUM(COUNT(*)) OVER (ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM frames GROUP BY 1)
SELECT range AS num, file_id, CAST(range - first AS BIGINT) AS local FROM range((SELECT COUNT(*) FROM frames)) JOIN o ON range >= first AND range < first + n""")
def frames_located(spark: SparkSession, sf: str) -> DataFrame:
    f = tb.frames(spark, sf)
    return fr.located(spark.range(f.count()).withColumnRenamed("id", "num"), f)


def _parity_sql(keep: int) -> str:
    return f"SELECT frame_id, place FROM (SELECT frame_id, ROW_NUMBER() OVER (ORDER BY frame_id) - 1 AS place FROM frames WHERE blacklist = 0) WHERE place % 2 = {keep}"


@query(_parity_sql(0))
def frames_even(spark: SparkSession, sf: str) -> DataFrame:
    return fr.parity(tb.frames(spark, sf), 0)


@query(_parity_sql(1))
def frames_odd(spark: SparkSession, sf: str) -> DataFrame:
    return fr.parity(tb.frames(spark, sf), 1)


@query("SELECT f.frame_id, CASE WHEN blacklist = 1 THEN -1.0 WHEN file_id = 0 THEN 1.0 ELSE scale END AS scale FROM frames f")
def frames_scale(spark: SparkSession, sf: str) -> DataFrame:
    f = tb.frames(spark, sf)
    return fr.with_scale(f, f.filter("file_id <> 0").select("frame_id", "scale"))


@query("SELECT cls, COUNT(*) AS n FROM frames GROUP BY 1")
def classes_summary(spark: SparkSession, sf: str) -> DataFrame:
    return fr.class_counts(tb.frames(spark, sf))


@query("SELECT cls, pix, CAST(SUM(cnt) AS BIGINT) AS total FROM photons JOIN frames USING (frame_id) GROUP BY 1, 2")
def classes_powder(spark: SparkSession, sf: str) -> DataFrame:
    return fr.class_powder(tb.photons(spark, sf), tb.frames(spark, sf))


@query("""m AS (SELECT d.pix, COALESCE(SUM(cnt), 0) / (SELECT COUNT(*) FROM frames) AS mean FROM det d LEFT JOIN photons p ON p.pix = d.pix WHERE mask < 1 GROUP BY 1)
SELECT frame_id, pix, cnt FROM photons LEFT JOIN m USING (pix) WHERE cnt <= 1 OR COALESCE(mean, 0) >= 0.0224""")
def frames_without_cosmics(spark: SparkSession, sf: str) -> DataFrame:
    p = tb.photons(spark, sf)
    return fr.without_cosmics(p, fr.mean_powder(p, tb.frames(spark, sf), tb.detector(spark)))


_PHOTON = "x AS (SELECT frame_id, pix, unnest(range(1, cnt + 1)) AS k FROM photons), h AS (SELECT frame_id, pix, ('0x' || substr(md5('{}|' || frame_id || '|' || pix || '|' || k), 1, 8))::BIGINT AS h FROM x) "


@query(_PHOTON.format("thin") + "SELECT frame_id, pix, CAST(COUNT(*) AS INT) AS cnt FROM h WHERE h < 1288490188 GROUP BY 1, 2")
def frames_thinned(spark: SparkSession, sf: str) -> DataFrame:
    return fr.thinned(tb.photons(spark, sf), 0.3)


@query(_PHOTON.format("part") + "SELECT frame_id, CAST(h % 4 AS INT) AS part, pix, CAST(COUNT(*) AS INT) AS cnt FROM h GROUP BY 1, 2, 3")
def frames_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    return fr.partitioned(tb.photons(spark, sf), 4)


@query("SELECT CAST(x + 3.5 AS INT) AS ix, CAST(y + 3.5 AS INT) AS iy, CAST(COALESCE(SUM(cnt), 0) AS BIGINT) AS value FROM det d LEFT JOIN (SELECT * FROM photons WHERE frame_id = (SELECT MIN(frame_id) FROM photons)) p ON p.pix = d.pix WHERE mask < 2 GROUP BY 1, 2")
def frame_assembled(spark: SparkSession, sf: str) -> DataFrame:
    p = tb.photons(spark, sf)
    first = p.join(F.broadcast(p.agg(F.min("frame_id").alias("frame_id"))), "frame_id", "left_semi")
    return fr.assembled_frame(first, dt.assembled(tb.detector(spark), 20.0, 20.0))


@query("""i AS (SELECT CAST(x + 3.5 AS INT) AS ix, CAST(y + 3.5 AS INT) AS iy, CAST(COALESCE(SUM(cnt), 0) AS DOUBLE) AS v FROM det d LEFT JOIN photons p ON p.pix = d.pix WHERE mask < 2 GROUP BY 1, 2)
SELECT ix, iy, AVG(v) AS value FROM (SELECT * FROM i UNION ALL SELECT 7 - ix, 7 - iy, v FROM i) GROUP BY 1, 2""")
def powder_symmetrized(spark: SparkSession, sf: str) -> DataFrame:
    total = fr.powder(tb.photons(spark, sf), tb.detector(spark)).withColumnRenamed("total", "cnt")
    return fr.centro_symmetric(fr.assembled_frame(total, dt.assembled(tb.detector(spark), 20.0, 20.0)))


@query("SELECT frame_id, CAST(FLOOR(FLOOR(pix / 8) / 2) AS INT) AS bx, CAST(FLOOR((pix % 8) / 2) AS INT) AS by, CAST(SUM(cnt) AS BIGINT) AS cnt FROM photons GROUP BY 1, 2, 3")
def frames_binned(spark: SparkSession, sf: str) -> DataFrame:
    return fr.binned(tb.photons(spark, sf), 2)


@query("SELECT frame_id, 0 AS file_id FROM frames WHERE file_id = 0 UNION ALL SELECT frame_id, 1 FROM frames WHERE file_id = 2")
def frames_concatenated(spark: SparkSession, sf: str) -> DataFrame:
    f = tb.frames(spark, sf)
    return fr.concatenated([f.filter(F.col("file_id") == k).select("frame_id") for k in (0, 2)])


@query("SELECT frame_id, pix, cnt FROM photons JOIN frames USING (frame_id) WHERE cls IN ('1', '2') AND blacklist = 0")
def frames_of_classes(spark: SparkSession, sf: str) -> DataFrame:
    keep = tb.frames(spark, sf).filter("cls IN ('1', '2') AND blacklist = 0").select("frame_id")
    return tb.photons(spark, sf).join(keep, "frame_id", "left_semi")


@query("SELECT frame_id, CASE WHEN rmax % 3 IN (0, 2) THEN 0 ELSE 1 END AS blacklist FROM iter_log WHERE iteration = (SELECT MAX(iteration) FROM iter_log)")
def blacklist_from_modes(spark: SparkSession, sf: str) -> DataFrame:
    log = tb.iter_log(spark, sf)
    last = log.join(F.broadcast(log.agg(F.max("iteration").alias("iteration"))), "iteration", "left_semi")
    return last.select("frame_id", F.when((F.col("rmax") % 3).isin(0, 2), 0).otherwise(1).alias("blacklist"))


# Views

_CORNERS = """t AS (SELECT r, pix, corr, COS(angle) * qx - SIN(angle) * qy + 6 AS t0, SIN(angle) * qx + COS(angle) * qy + 6 AS t1 FROM rot, det WHERE mask < 2),
i AS (SELECT *, CAST(TRUNC(t0) AS BIGINT) AS i0, CAST(TRUNC(t1) AS BIGINT) AS i1 FROM t),
c AS (SELECT r, pix, corr, (i0 + a) * 13 + i1 + b AS vox, (CASE WHEN a = 1 THEN t0 - i0 ELSE 1 - (t0 - i0) END) * (CASE WHEN b = 1 THEN t1 - i1 ELSE 1 - (t1 - i1) END) AS f
  FROM i, (VALUES (0), (1)) x(a), (VALUES (0), (1)) y(b) WHERE t0 >= 0 AND t1 >= 0 AND i0 BETWEEN 0 AND 11 AND i1 BETWEEN 0 AND 11),
g AS (SELECT mode, r, pix, SUM(f * intens) AS v FROM c JOIN model USING (vox) GROUP BY 1, 2, 3),
views AS (SELECT m.mode, t.r, t.pix, CASE WHEN v * corr > 0 THEN v * corr ELSE 2.2250738585072014e-308 END AS value FROM t CROSS JOIN (SELECT DISTINCT mode FROM model) m LEFT JOIN g ON g.mode = m.mode AND g.r = t.r AND g.pix = t.pix)"""


def _views(spark: SparkSession, sf: str) -> DataFrame:
    return vw.views(vw.coords2d(tb.rotations(spark), tb.detector(spark), SIZE), tb.model(spark, sf), SIZE)


@query(_CORNERS + " SELECT mode, r, pix, ROUND(value, 9) AS value FROM views")
def views_2d(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_views(spark, sf), "value", digits=9)


@query(_CORNERS + " SELECT mode, vox, ROUND(SUM(f * value / corr), 6) AS num, ROUND(SUM(f), 6) AS weight FROM c JOIN views USING (r, pix) GROUP BY 1, 2")
def views_merged_2d(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(vw.merged(vw.coords2d(tb.rotations(spark), tb.detector(spark), SIZE), _views(spark, sf), SIZE), "num", "weight")


@query("SELECT mode, vox, ROUND(AVG(intens), 9) AS intens FROM (SELECT * FROM model UNION ALL SELECT mode, 168 - vox, intens FROM model) GROUP BY 1, 2")
def model_friedel(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(vw.friedel(tb.model(spark, sf), SIZE, 2), "intens", digits=9)


@query("SELECT vox, ROUND(AVG(intens), 9) AS intens FROM (SELECT * FROM cube UNION ALL SELECT 728 - vox, intens FROM cube) GROUP BY 1")
def volume_friedel(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(vw.friedel(tb.volume(spark, sf), 9, 3), "intens", digits=9)


@query("SELECT vox, ROUND(AVG(intens) OVER (PARTITION BY list_sort([ABS(vox // 81 - 4), ABS(vox // 9 % 9 - 4), ABS(vox % 9 - 4)])), 9) AS intens FROM cube")
def volume_octahedral(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(vw.octahedral(tb.volume(spark, sf), 9), "intens", digits=9)


@query("""x AS (SELECT vox, intens, 1.0::DOUBLE + vox % 4 AS w, vox // 81 - 4 AS x, vox // 9 % 9 - 4 AS y, vox % 9 - 4 AS z FROM cube),
s AS (SELECT a.vox, a.intens * a.w + b.intens * b.w AS num, a.w + b.w AS den FROM x a JOIN x b ON b.x = -a.x AND b.y = -a.y AND b.z = a.z WHERE a.x*a.x + a.y*a.y + a.z*a.z < 16)
SELECT vox, ROUND(COALESCE(CASE WHEN den > 0 THEN num / den END, 0), 6) AS intens FROM x LEFT JOIN s USING (vox)""")
def volume_axial(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(vw.axial(tb.volume(spark, sf).withColumn("weight", 1.0 + F.col("vox") % 4), 2, 9), "intens")


def _inline(n: int, letter: str) -> str:
    """The uniform rotations as rows of SQL, for what is computed from rotations; rotations_uniform tells whether they are right."""
    rows = ", ".join("(" + ", ".join([str(i), *(f"{float(x)!r}::DOUBLE" for x in q)]) + ")" for i, q in enumerate(ori.uniform(n)))
    return f"(VALUES {rows}) {letter}(r, q0, q1, q2, q3, w)"


_CORNERS_3D = f"""big AS (SELECT range AS vox, 0.3::DOUBLE + CAST((range * 37) % 101 AS DOUBLE) / 101.0 + 0.2 + COALESCE(n % 101, 0) / 50.0::DOUBLE AS intens FROM range(2197) LEFT JOIN (SELECT p_partkey % 2197 AS k, SUM(p_size) AS n FROM part GROUP BY 1) ON k = range),
q AS (SELECT * FROM turns),
t AS (SELECT r, pix, corr,
  (1 - 2 * (q2*q2 + q3*q3)) * qx + 2 * (q1*q2 - q0*q3) * qy + 2 * (q1*q3 + q0*q2) * qz + 6 AS t0,
  2 * (q1*q2 + q0*q3) * qx + (1 - 2 * (q1*q1 + q3*q3)) * qy + 2 * (q2*q3 - q0*q1) * qz + 6 AS t1,
  2 * (q1*q3 - q0*q2) * qx + 2 * (q2*q3 + q0*q1) * qy + (1 - 2 * (q1*q1 + q2*q2)) * qz + 6 AS t2 FROM q, det WHERE mask < 2),
i AS (SELECT *, CAST(TRUNC(t0) AS BIGINT) AS i0, CAST(TRUNC(t1) AS BIGINT) AS i1, CAST(TRUNC(t2) AS BIGINT) AS i2 FROM t),
c AS (SELECT r, pix, corr, ((i0 + a) * 13 + i1 + b) * 13 + i2 + d AS vox,
  (CASE WHEN a = 1 THEN t0 - i0 ELSE 1 - (t0 - i0) END) * (CASE WHEN b = 1 THEN t1 - i1 ELSE 1 - (t1 - i1) END) * (CASE WHEN d = 1 THEN t2 - i2 ELSE 1 - (t2 - i2) END) AS f
  FROM i, (VALUES (0), (1)) x(a), (VALUES (0), (1)) y(b), (VALUES (0), (1)) z(d) WHERE t0 >= 0 AND t1 >= 0 AND t2 >= 0 AND i0 BETWEEN 0 AND 11 AND i1 BETWEEN 0 AND 11 AND i2 BETWEEN 0 AND 11),
g AS (SELECT r, pix, SUM(f * intens) AS v FROM c JOIN big USING (vox) GROUP BY 1, 2),
views AS (SELECT t.r, t.pix, CASE WHEN v * corr > 0 THEN v * corr ELSE 2.2250738585072014e-308 END AS value FROM t LEFT JOIN g ON g.r = t.r AND g.pix = t.pix)"""


def _views_3d(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    coords = vw.coords3d(tb.turns(spark, sf), tb.detector(spark), SIZE)
    return coords, vw.views(coords, tb.volume(spark, sf, SIZE).withColumn("mode", F.lit(0).cast("long")), SIZE)


@query(_CORNERS_3D + " SELECT 0::BIGINT AS mode, r::BIGINT AS r, pix, ROUND(value, 6) AS value FROM views")
def views_3d(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_views_3d(spark, sf)[1], "value")


@query(_CORNERS_3D + " SELECT 0::BIGINT AS mode, vox, ROUND(SUM(f * value / corr), 5) AS num, ROUND(SUM(f), 5) AS weight FROM c JOIN views USING (r, pix) GROUP BY 2")
def views_merged_3d(spark: SparkSession, sf: str) -> DataFrame:
    coords, v = _views_3d(spark, sf)
    return rounded(vw.merged(coords, v, SIZE), "num", "weight", digits=5)


_RZ = """rz AS (SELECT p.range * 4 + b.range AS r, p.range * 2 * PI() / 6 AS phi, (b.range + 0.5::DOUBLE) * PI() / 8 - PI() / 4 AS beta FROM range(6) p, range(4) b),
a AS (SELECT r, pix, corr, qz, beta, COS(phi) * qx - SIN(phi) * qy AS u, SIN(phi) * qx + COS(phi) * qy AS v FROM rz, det WHERE mask < 2),
t AS (SELECT r, pix, corr, SQRT(u * u + POWER(SIN(beta) * v + COS(beta) * qz, 2)) AS t0, COS(beta) * v - SIN(beta) * qz + 6 AS t1 FROM a),
""" + _CORNERS[_CORNERS.index("i AS (") :]


def _coords_rz(spark: SparkSession) -> DataFrame:
    import math

    return vw.coords_rz(ori.rz_grid(spark, 6, math.pi / 2, math.pi / 8), tb.detector(spark), SIZE)


@query(_RZ + " SELECT mode, r, pix, ROUND(value, 9) AS value FROM views")
def views_rz(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(vw.views(_coords_rz(spark), tb.model(spark, sf), SIZE), "value", digits=9)


@query(_RZ + " SELECT mode, vox, ROUND(SUM(f * value / corr), 6) AS num, ROUND(SUM(f), 6) AS weight FROM c JOIN views USING (r, pix) GROUP BY 1, 2")
def views_merged_rz(spark: SparkSession, sf: str) -> DataFrame:
    x = _coords_rz(spark)
    return rounded(vw.merged(x, vw.views(x, tb.model(spark, sf), SIZE), SIZE), "num", "weight")


@query("""p AS (SELECT i.range - 4 AS i, j.range - 4 AS j FROM range(9) i, range(9) j)
SELECT i, j, ROUND(intens, 6) AS value FROM p JOIN cube ON vox = (i + 4) * 81 + (j + 4) * 9 + 4 WHERE i < 4 AND j < 4""")
def volume_plane(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(vw.oblique(tb.volume(spark, sf), (1, 0, 0), (0, 1, 0), 9), "value")


@query("""p AS (SELECT i.range - 4 AS i, j.range - 4 AS j FROM range(9) i, range(9) j)
SELECT i, j, ROUND(intens, 6) AS value FROM p JOIN cube ON vox = (4 - i) * 81 + (j + 4) * 9 + 5""")
def volume_layer(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(vw.normal_plane(tb.volume(spark, sf), (0, 0, 2), 5, 9), "value")


# Orientations


@query("SELECT r, ROUND(angle, 9) AS angle, ROUND(w, 9) AS w FROM rot")
def rotations_in_plane(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ori.in_plane(spark, 12), "angle", "w", digits=9)


@query("SELECT p.range * 4 + b.range AS r, ROUND(p.range * 2 * PI() / 6, 9) AS phi, ROUND((b.range + 0.5) * PI() / 8 - PI() / 4, 9) AS beta, ROUND(1.0 / 24, 9) AS w FROM range(6) p, range(4) b")
def rotations_rz(spark: SparkSession, sf: str) -> DataFrame:
    import math

    return rounded(ori.rz_grid(spark, 6, math.pi / 2, math.pi / 8), "phi", "beta", "w", digits=9)


# Independent of the generator: unit axes, halves, and the even permutations of (g, 1, 1/g, 0) / 2 with all signs.
_CELL600 = """g AS (SELECT (1 + SQRT(5.0::DOUBLE)) / 2 AS g), s AS (SELECT UNNEST([1.0::DOUBLE, -1.0::DOUBLE]) AS s),
z AS (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3),
axes AS (SELECT CASE WHEN k = 0 THEN s ELSE 0 END AS a, CASE WHEN k = 1 THEN s ELSE 0 END AS b, CASE WHEN k = 2 THEN s ELSE 0 END AS c, CASE WHEN k = 3 THEN s ELSE 0 END AS d FROM z, s),
halves AS (SELECT p.s / 2 AS a, q.s / 2 AS b, r.s / 2 AS c, t.s / 2 AS d FROM s p, s q, s r, s t),
u AS (SELECT p.s * g / 2 AS x, q.s / 2 AS y, r.s / g / 2 AS z, 0.0::DOUBLE AS o FROM g, s p, s q, s r),
perms AS (SELECT x AS a, y AS b, z AS c, o AS d FROM u UNION ALL SELECT x, z, o, y FROM u UNION ALL SELECT x, o, y, z FROM u UNION ALL SELECT y, x, o, z FROM u
  UNION ALL SELECT y, z, x, o FROM u UNION ALL SELECT y, o, z, x FROM u UNION ALL SELECT z, x, y, o FROM u UNION ALL SELECT z, y, o, x FROM u
  UNION ALL SELECT z, o, x, y FROM u UNION ALL SELECT o, x, z, y FROM u UNION ALL SELECT o, y, x, z FROM u UNION ALL SELECT o, z, y, x FROM u),
v AS (SELECT * FROM axes UNION ALL SELECT * FROM halves UNION ALL SELECT * FROM perms),
n AS (SELECT ROW_NUMBER() OVER (ORDER BY a, b, c, d) AS i, * FROM v)"""
_HALF = "(q0 > 1e-9 OR (ABS(q0) <= 1e-9 AND (q1 > 1e-9 OR (ABS(q1) <= 1e-9 AND (q2 > 1e-9 OR (ABS(q2) <= 1e-9 AND q3 > 1e-9))))))"


@query(_CELL600 + f""", e AS (SELECT p.a + q.a AS a, p.b + q.b AS b, p.c + q.c AS c, p.d + q.d AS d FROM n p JOIN n q ON p.i < q.i AND p.a * q.a + p.b * q.b + p.c * q.c + p.d * q.d BETWEEN 0.80 AND 0.82),
m AS (SELECT 1 AS n, a AS q0, b AS q1, c AS q2, d AS q3, 5.0::DOUBLE / 6 AS w FROM v UNION ALL SELECT 2, a, b, c, d, 5.0::DOUBLE / 6 FROM v
  UNION ALL SELECT 2, a / l, b / l, c / l, d / l, 35.0::DOUBLE / 36 / POWER(l / 2, 4) FROM (SELECT *, SQRT(a*a + b*b + c*c + d*d) AS l FROM e))
SELECT n, ROUND(q0, 6) + 0.0 AS q0, ROUND(q1, 6) + 0.0 AS q1, ROUND(q2, 6) + 0.0 AS q2, ROUND(q3, 6) + 0.0 AS q3, ROUND(w / SUM(w) OVER (PARTITION BY n), 9) AS w FROM m WHERE {_HALF}""")
def rotations_uniform(spark: SparkSession, sf: str) -> DataFrame:
    """Every quaternion and weight of the first two subdivisions."""
    out = None
    for n in (1, 2):
        x = ori.table(spark, ori.uniform(n)).select(F.lit(n).alias("n"), "q0", "q1", "q2", "q3", "w")
        out = x if out is None else out.union(x)
    return rounded(rounded(out, "q0", "q1", "q2", "q3"), "w", digits=9)


@query("SELECT n, CAST(10 * (5 * n * n * n + n) AS BIGINT) AS rotations, 1.0::DOUBLE AS weight, true AS unit FROM (VALUES (1), (2), (3), (4)) t(n)")
def rotations_counted(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for n in (1, 2, 3, 4):
        x = ori.table(spark, ori.uniform(n))
        length = F.col("q0") ** 2 + F.col("q1") ** 2 + F.col("q2") ** 2 + F.col("q3") ** 2
        x = x.agg(F.lit(n).alias("n"), F.count("*").alias("rotations"), F.round(F.sum("w"), 9).alias("weight"), (F.max(F.abs(length - 1)) < 1e-9).alias("unit"))
        out = x if out is None else out.union(x)
    return out


@query("x AS (SELECT f.r, MIN(ROUND(1 - POWER(f.q0*c.q0 + f.q1*c.q1 + f.q2*c.q2 + f.q3*c.q3, 2), 9)) AS dist FROM spins f, turns c GROUP BY 1) SELECT r, dist + 0.0 AS dist FROM x")
def rotations_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ori.nearest(tb.turns(spark, sf, "customer"), tb.turns(spark, sf)).select("r", "dist"), "dist", digits=9)


@query("SELECT r, ROUND(1 - 2 * (q2*q2 + q3*q3), 9) + 0.0 AS m00, ROUND(2 * (q1*q2 - q0*q3), 9) + 0.0 AS m01, ROUND(2 * (q1*q3 + q0*q2), 9) + 0.0 AS m02, ROUND(1 - 2 * (q1*q1 + q2*q2), 9) + 0.0 AS m22 FROM spins")
def rotation_matrices(spark: SparkSession, sf: str) -> DataFrame:
    m = vw.rotation_matrix()
    x = tb.turns(spark, sf, "customer").select("r", m[0][0].alias("m00"), m[0][1].alias("m01"), m[0][2].alias("m02"), m[2][2].alias("m22"))
    return rounded(x, "m00", "m01", "m02", "m22", digits=9)


def _kept(group: str) -> str:
    """Those of the uniform rotations that are not nearer to another element of the group (a, b, c, d) than to the identity."""
    return f""", f AS (SELECT * FROM {_inline(3, "f")}),
d AS (SELECT r, MAX(CASE WHEN ABS(a) > 0.999999 THEN ABS(q0*a + q1*b + q2*c + q3*d) END) AS one, MAX(CASE WHEN ABS(a) <= 0.999999 THEN ABS(q0*a + q1*b + q2*c + q3*d) END) AS other FROM f, {group} GROUP BY 1),
k AS (SELECT f.* FROM f JOIN d USING (r) WHERE one >= other - 1e-12)
SELECT ROUND(q0, 6) + 0.0 AS q0, ROUND(q1, 6) + 0.0 AS q1, ROUND(q2, 6) + 0.0 AS q2, ROUND(q3, 6) + 0.0 AS q3, ROUND(w / SUM(w) OVER (), 9) AS w FROM k"""


def _reduced(spark: SparkSession, group) -> DataFrame:
    x = ori.table(spark, ori.reduced(ori.uniform(3), group)).drop("r")
    return rounded(rounded(x, "q0", "q1", "q2", "q3"), "w", digits=9)


@query(_CELL600 + _kept("v"))
def rotations_icosahedral(spark: SparkSession, sf: str) -> DataFrame:
    return _reduced(spark, ori.icosahedral_group())


# 24 rotations of a cube: of the axes and halves, and the sums and differences of two axes.
_CUBE = _CELL600 + """, two AS (SELECT (p.a + q.a) / SQRT(2) AS a, (p.b + q.b) / SQRT(2) AS b, (p.c + q.c) / SQRT(2) AS c, (p.d + q.d) / SQRT(2) AS d FROM axes p, axes q WHERE p.a*q.a + p.b*q.b + p.c*q.c + p.d*q.d = 0),
every AS (SELECT * FROM axes UNION ALL SELECT * FROM halves UNION ALL SELECT * FROM two), o AS (SELECT DISTINCT ROUND(a, 12) AS a, ROUND(b, 12) AS b, ROUND(c, 12) AS c, ROUND(d, 12) AS d FROM every)"""


@query(_CUBE + _kept("o"))
def rotations_octahedral(spark: SparkSession, sf: str) -> DataFrame:
    return _reduced(spark, ori.octahedral_group())


_ROTATED = """, m AS (SELECT *, 1 - 2*(c*c + d*d) AS m00, 2*(b*c - a*d) AS m01, 2*(b*d + a*c) AS m02, 2*(b*c + a*d) AS m10, 1 - 2*(b*b + d*d) AS m11, 2*(c*d - a*b) AS m12,
  2*(b*d - a*c) AS m20, 2*(c*d + a*b) AS m21, 1 - 2*(b*b + c*c) AS m22 FROM {group}),
x AS (SELECT vox AS dest, vox // 81 - 4 AS x, vox // 9 % 9 - 4 AS y, vox % 9 - 4 AS z FROM cube),
t AS (SELECT m.*, dest, m00*x + m01*y + m02*z + 4 AS t0, m10*x + m11*y + m12*z + 4 AS t1, m20*x + m21*y + m22*z + 4 AS t2 FROM m, x WHERE x*x + y*y + z*z < 16),
j AS (SELECT *, CAST(TRUNC(t0) AS BIGINT) AS i0, CAST(TRUNC(t1) AS BIGINT) AS i1, CAST(TRUNC(t2) AS BIGINT) AS i2 FROM t),
f AS (SELECT a, b, c, d, dest, ((i0 + k0) * 9 + i1 + k1) * 9 + i2 + k2 AS vox, ABS(1 - k0 - (t0 - i0)) * ABS(1 - k1 - (t1 - i1)) * ABS(1 - k2 - (t2 - i2)) AS f
  FROM j, (VALUES (0), (1)) p(k0), (VALUES (0), (1)) q(k1), (VALUES (0), (1)) r(k2) WHERE t0 >= 0 AND t1 >= 0 AND t2 >= 0 AND i0 <= 7 AND i1 <= 7 AND i2 <= 7),
turned AS (SELECT a, b, c, d, dest AS vox, SUM(f * intens) AS intens FROM f JOIN cube USING (vox) GROUP BY ALL)"""


@query(_CELL600 + f", sixty AS (SELECT a, b, c, d FROM v WHERE {_HALF.replace('q0', 'a').replace('q1', 'b').replace('q2', 'c').replace('q3', 'd')})" + _ROTATED.format(group="sixty")
       + " SELECT cube.vox, ROUND(COALESCE(s / 60, intens), 6) AS intens FROM cube LEFT JOIN (SELECT vox, SUM(intens) AS s FROM turned GROUP BY 1) USING (vox)")
def volume_icosahedral(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(vw.icosahedral(tb.volume(spark, sf), 9), "intens")


@query(_CUBE + f", four AS (SELECT a, b, c, d FROM o WHERE {_HALF.replace('q0', 'a').replace('q1', 'b').replace('q2', 'c').replace('q3', 'd')})" + _ROTATED.format(group="four")
       + " SELECT ROUND(a, 6) + 0.0 AS q0, ROUND(b, 6) + 0.0 AS q1, ROUND(c, 6) + 0.0 AS q2, ROUND(d, 6) + 0.0 AS q3, ROUND(CORR(turned.intens, cube.intens), 6) AS cc FROM turned JOIN cube USING (vox) GROUP BY ALL")
def volume_correlation(spark: SparkSession, sf: str) -> DataFrame:
    cube, group = tb.volume(spark, sf), ori.half(ori.octahedral_group())
    m = [(k, *map(float, ori.matrix(q).ravel())) for k, q in enumerate(group)]
    df = spark.createDataFrame(m, "k int, " + ", ".join(f"m{i}{j} double" for i in range(3) for j in range(3)))
    quats = spark.createDataFrame([(k, *map(float, q)) for k, q in enumerate(group)], "k int, q0 double, q1 double, q2 double, q3 double")
    return rounded(vo.rotation_correlation(cube, cube, df, 9).join(quats, "k").drop("k"), "q0", "q1", "q2", "q3", "cc")


@query()
def volume_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """The rotation of a volume that was rotated by a quarter turn, searched from coarse to fine."""
    import numpy as np

    cube = tb.volume(spark, sf)
    m = spark.createDataFrame([(0, 0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)], "k int, " + ", ".join(f"m{i}{j} double" for i in range(3) for j in range(3)))
    turned = cube.join(vw.rotated(cube, m, 9).select("vox", F.col("intens").alias("t")), "vox", "left").select("vox", F.coalesce("t", "intens").alias("intens"))
    q, cc = vo.best_alignment(spark, turned, cube, np.column_stack([ori.octahedral_group(), np.ones(24)]), 9)
    return spark.createDataFrame([(*map(float, q), cc)], "q0 double, q1 double, q2 double, q3 double, cc double")


@query(f"SELECT CAST(r AS BIGINT) AS r FROM {_inline(2, 'f')} WHERE POWER(q0 - 1, 2) + q1*q1 + q2*q2 + q3*q3 < 0.3")
def rotations_about(spark: SparkSession, sf: str) -> DataFrame:
    return ori.about(ori.table(spark, ori.uniform(2)), (1.0, 0.0, 0.0, 0.0), 0.3).select("r")


@query("SELECT CAST(range AS BIGINT) AS r FROM range(420) WHERE range % 3 = 1")
def rotations_shared(spark: SparkSession, sf: str) -> DataFrame:
    return ori.share(ori.configured(spark, "3d", num_div=2), 1, 3).select("r")


@query("SELECT CAST(range AS BIGINT) AS r, ROUND(range * PI() / 12, 9) AS angle, ROUND(1.0::DOUBLE / 12, 9) AS w FROM range(12)")
def rotations_configured(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ori.configured(spark, "2D", num_rot=12, friedel_sym=True), "angle", "w", digits=9)


@query("SELECT range AS r, CAST(CASE WHEN range < 24 THEN range // 2 ELSE 0 END AS BIGINT) AS rotind, CAST(CASE WHEN range < 24 THEN range % 2 ELSE range - 22 END AS BIGINT) AS mode FROM range(27)")
def rotations_split(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(27).withColumnRenamed("id", "r").select("r", *mx.split_index(12, 2))


# The iteration

_COUNTS = "counts AS (SELECT f.frame_id, COALESCE(s, 0) AS fcount FROM frames f LEFT JOIN (SELECT frame_id, SUM(cnt) AS s FROM photons JOIN det USING (pix) WHERE mask < 1 GROUP BY 1) p ON p.frame_id = f.frame_id)"
_TOTALS = _CORNERS + ", totals AS (SELECT mode, r, SUM(value) AS u FROM views JOIN det USING (pix) WHERE mask < 1 GROUP BY 1, 2), " + _COUNTS
_LOGL = (
    _TOTALS
    + """, phi AS (SELECT frame_id, scale AS phi FROM frames WHERE blacklist = 0),
hits AS (SELECT frame_id, mode, r, SUM(cnt * LN(value)) AS s FROM photons JOIN views USING (pix) JOIN det USING (pix) WHERE mask < 1 GROUP BY 1, 2, 3),
logl AS (SELECT p.frame_id, t.mode, t.r, LN(w) - u * phi + COALESCE(s, 0) AS logl FROM phi p CROSS JOIN totals t JOIN rot ON rot.r = t.r LEFT JOIN hits h ON h.frame_id = p.frame_id AND h.mode = t.mode AND h.r = t.r)"""
)
_POST = (
    _LOGL
    + """, betas AS (SELECT frame_id, EXP(-6.5 * POWER(fcount * 1e-5, 0.15)) AS beta FROM counts),
best AS (SELECT frame_id, MAX(logl) AS best FROM logl GROUP BY 1),
e AS (SELECT l.*, best, EXP(beta * (logl - best)) AS e FROM logl l JOIN best USING (frame_id) JOIN betas USING (frame_id) WHERE logl > best - 14.0 / beta),
post AS (SELECT frame_id, mode, r, logl, e / SUM(e) OVER (PARTITION BY frame_id) AS p FROM e)"""
)
_FACT = ", facts AS (SELECT frame_id, SUM(lgamma(cnt + 1)) AS sum_fact FROM photons JOIN det USING (pix) WHERE mask < 1 AND cnt > 1 GROUP BY 1)"
_TOMO = (
    _POST
    + """, base AS (SELECT mode, r, SUM(p * phi) AS psum FROM post JOIN phi USING (frame_id) WHERE p > 1e-6 GROUP BY 1, 2),
lit AS (SELECT mode, r, pix, SUM(p * cnt) AS s FROM post JOIN photons USING (frame_id) JOIN det USING (pix) WHERE p > 1e-6 AND mask < 2 GROUP BY 1, 2, 3),
tomo AS (SELECT b.mode, b.r, d.pix, COALESCE(s, 0) / psum AS value FROM base b CROSS JOIN (SELECT pix FROM det WHERE mask < 2) d LEFT JOIN lit ON lit.mode = b.mode AND lit.r = b.r AND lit.pix = d.pix)"""
)


@query(_TOTALS + " SELECT mode, r, ROUND(u, 6) AS u FROM totals")
def view_totals(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mx.view_totals(_views(spark, sf), tb.detector(spark)), "u")


@query(_TOTALS + " SELECT ROUND((SELECT AVG(fcount) FROM counts) / SUM(w * u) * 2, 6) AS rescale FROM totals JOIN rot USING (r)")
def rescale(spark: SparkSession, sf: str) -> DataFrame:
    s = emc.State(spark, sf)
    return rounded(mx.rescale(s.totals, s.rot, fr.mean_count(s.photons, s.frames, s.det)), "rescale")


@query(_COUNTS + " SELECT frame_id, ROUND(EXP(-6.5 * POWER(fcount * 1e-5, 0.15)), 9) AS beta FROM counts")
def start_beta(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mx.start_beta(fr.frame_counts(tb.photons(spark, sf), tb.frames(spark, sf), tb.detector(spark))), "beta", digits=9)


@query(_COUNTS + " SELECT frame_id, ROUND(LEAST(1.0, EXP(-6.5 * POWER(fcount * 1e-5, 0.15)) * POWER(1.4, 2)), 9) AS beta FROM counts")
def scheduled_beta(spark: SparkSession, sf: str) -> DataFrame:
    b = mx.start_beta(fr.frame_counts(tb.photons(spark, sf), tb.frames(spark, sf), tb.detector(spark)))
    return rounded(mx.scheduled_beta(b, 25, 1.4, 10), "beta", digits=9)


@query(_LOGL + " SELECT frame_id, mode, r, ROUND(logl, 5) AS logl FROM logl")
def log_likelihood(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(emc.State(spark, sf).logl, "logl", digits=5)


@query(
    _TOTALS
    + """, hits AS (SELECT p.frame_id, v.mode, v.r, SUM(cnt * LN(GREATEST(v.value * scale + 0.5 * (0.01 + 0.001 * (p.pix % 7)), 2.2250738585072014e-308))) AS s FROM photons p JOIN frames f ON f.frame_id = p.frame_id AND blacklist = 0 JOIN views v ON v.pix = p.pix JOIN det d ON d.pix = p.pix WHERE mask < 1 GROUP BY 1, 2, 3)
SELECT f.frame_id, t.mode, t.r, ROUND(LN(w) - u * scale + COALESCE(s, 0), 5) AS logl FROM frames f CROSS JOIN totals t JOIN rot ON rot.r = t.r LEFT JOIN hits h ON h.frame_id = f.frame_id AND h.mode = t.mode AND h.r = t.r WHERE blacklist = 0"""
)
def log_likelihood_background(spark: SparkSession, sf: str) -> DataFrame:
    s = emc.State(spark, sf)
    return rounded(s.likelihoods(s.phi.withColumn("bgscale", F.lit(0.5)), det=emc.with_background(s.det), form="background"), "logl", digits=5)


@query(_CORNERS + " SELECT d.frame_id, v.mode, v.r, ROUND(-SUM(POWER(d.val - v.value * 2.0, 2)), 6) AS logl FROM dense d JOIN views v ON v.pix = d.pix JOIN det ON det.pix = d.pix WHERE mask < 1 GROUP BY 1, 2, 3")
def log_likelihood_gauss(spark: SparkSession, sf: str) -> DataFrame:
    s, dense = emc.State(spark, sf), tb.dense_frames(spark, sf).withColumnRenamed("val", "cnt")
    frames = dense.select("frame_id").distinct().withColumn("phi", F.lit(2.0))
    return rounded(bl.likelihoods(dense, frames, s.views, s.rot, s.det, frames.count(), s.n_views, form="gauss"), "logl")


@query(_POST + " SELECT frame_id, mode, r, ROUND(p, 7) AS p FROM post")
def posterior(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(emc.State(spark, sf).post.select("frame_id", "mode", "r", "p"), "p", digits=7)


@query(_LOGL + """ SELECT frame_id, mode, r, ROUND(logl, 5) AS logl FROM (SELECT *, ROUND(logl, 9) AS t FROM logl)
QUALIFY ROW_NUMBER() OVER (PARTITION BY frame_id ORDER BY t DESC, mode, r) = 1""")
def best_rotation(spark: SparkSession, sf: str) -> DataFrame:
    """Ties are those of nine decimals, as sums of doubles depend on their order."""
    return rounded(mx.best_rotation(rounded(emc.State(spark, sf).logl, "logl", digits=9)), "logl", digits=5)


@query(_POST + _FACT + " SELECT frame_id, ROUND(SUM(p * LN(p * 2 / w)), 6) AS info, ROUND(SUM(p * (logl - COALESCE(sum_fact, 0))), 5) AS likelihood FROM post JOIN rot USING (r) LEFT JOIN facts USING (frame_id) WHERE p >= 1e-6 GROUP BY 1")
def frame_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rounded(emc.State(spark, sf).metrics, "info"), "likelihood", digits=5)


@query(_POST + " SELECT frame_id, mode, r, ROUND(p, 7) AS p FROM post")
def posterior_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """From tiles of few views each, as a set of very many views has them."""
    s = emc.State(spark, sf)
    few = s.likelihoods(s.phi.join(s.betas, "frame_id"), keep=True, tile_pixels=256)
    return rounded(mx.posterior(few, s.betas).select("frame_id", "mode", "r", "p"), "p", digits=7)


@query(_TOMO + " SELECT mode, r, pix, ROUND(value, 6) AS value FROM tomo")
def tomograms_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(emc.State(spark, sf).tomograms, "value")


@query(_POST + " SELECT frame_id, mode, ROUND(SUM(p), 6) AS p FROM post WHERE p >= 1e-6 GROUP BY 1, 2")
def mode_occupancy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mx.occupancy(emc.State(spark, sf).post), "p")


@query(_TOMO + " SELECT mode, r, pix, ROUND(value, 6) AS value FROM tomo")
def tomograms(spark: SparkSession, sf: str) -> DataFrame:
    """By joins alone."""
    s = emc.State(spark, sf)
    return rounded(mx.tomograms(s.post, s.photons, s.phi, s.det), "value")


@query()
def tomograms_background(spark: SparkSession, sf: str) -> DataFrame:
    s = emc.State(spark, sf)
    return rounded(mx.tomograms_background(s.post, s.photons, s.phi.withColumn("bgscale", F.lit(0.5)), emc.with_background(s.det)), "value", digits=5)


@query(_POST + " SELECT frame_id, ROUND(MAX(fcount) / SUM(p * u), 6) AS phi FROM post JOIN totals USING (mode, r) JOIN counts USING (frame_id) GROUP BY 1")
def updated_scale(spark: SparkSession, sf: str) -> DataFrame:
    s = emc.State(spark, sf)
    return rounded(mx.updated_scale(s.post, s.totals, s.counts), "phi")


@query("SELECT frame_id, ROUND(scale / (SELECT AVG(scale) FROM frames WHERE blacklist = 0), 9) AS phi FROM frames WHERE blacklist = 0")
def normalised_scale(spark: SparkSession, sf: str) -> DataFrame:
    s = emc.State(spark, sf)
    return rounded(mx.normalised_scales(s.phi, s.model)[0], "phi", digits=9)


@query("SELECT mode, vox, ROUND(intens * (SELECT AVG(scale) FROM frames WHERE blacklist = 0), 6) AS intens FROM model")
def normalised_model(spark: SparkSession, sf: str) -> DataFrame:
    s = emc.State(spark, sf)
    return rounded(mx.normalised_scales(s.phi, s.model)[1], "intens")


@query("SELECT f.frame_id, r FROM (SELECT frame_id FROM frames WHERE blacklist = 0) f, rot WHERE r // 3 IN (f.frame_id % 4, (f.frame_id + 1) % 4)")
def refined_pairs(spark: SparkSession, sf: str) -> DataFrame:
    f = tb.frames(spark, sf).filter("blacklist = 0").select("frame_id")
    rot = tb.rotations(spark).select("r", F.floor(F.col("r") / 3).alias("coarse"))
    kept = f.select("frame_id", F.explode(F.array(F.col("frame_id") % 4, (F.col("frame_id") + 1) % 4)).alias("coarse"))
    return mx.refined(f.crossJoin(F.broadcast(rot.select("r"))), rot, kept)


# Iterations on packed blocks, of models in two and three dimensions and axial ones: views are made in the tasks that meet
# frames, and every frame has the scale that brings the mean view to the mean count

_AT_3D = """t AS (SELECT r, pix, corr,
  (1 - 2 * (q2*q2 + q3*q3)) * qx + 2 * (q1*q2 - q0*q3) * qy + 2 * (q1*q3 + q0*q2) * qz + 6 AS t0,
  2 * (q1*q2 + q0*q3) * qx + (1 - 2 * (q1*q1 + q3*q3)) * qy + 2 * (q2*q3 - q0*q1) * qz + 6 AS t1,
  2 * (q1*q3 - q0*q2) * qx + 2 * (q2*q3 + q0*q1) * qy + (1 - 2 * (q1*q1 + q2*q2)) * qz + 6 AS t2 FROM turns, det WHERE mask < 2),
i AS (SELECT *, CAST(TRUNC(t0) AS BIGINT) AS i0, CAST(TRUNC(t1) AS BIGINT) AS i1, CAST(TRUNC(t2) AS BIGINT) AS i2 FROM t),
c AS (SELECT r, pix, corr, ((i0 + a) * 13 + i1 + b) * 13 + i2 + d AS vox,
  (CASE WHEN a = 1 THEN t0 - i0 ELSE 1 - (t0 - i0) END) * (CASE WHEN b = 1 THEN t1 - i1 ELSE 1 - (t1 - i1) END) * (CASE WHEN d = 1 THEN t2 - i2 ELSE 1 - (t2 - i2) END) AS f
  FROM i, (VALUES (0), (1)) x(a), (VALUES (0), (1)) y(b), (VALUES (0), (1)) z(d) WHERE t0 >= 0 AND t1 >= 0 AND t2 >= 0 AND i0 BETWEEN 0 AND 11 AND i1 BETWEEN 0 AND 11 AND i2 BETWEEN 0 AND 11)"""
_AT_RZ = """a AS (SELECT r, pix, corr, qz, beta, COS(phi) * qx - SIN(phi) * qy AS u, SIN(phi) * qx + COS(phi) * qy AS v FROM tilts, det WHERE mask < 2),
t AS (SELECT r, pix, corr, SQRT(u * u + POWER(SIN(beta) * v + COS(beta) * qz, 2)) AS t0, COS(beta) * v - SIN(beta) * qz + 6 AS t1 FROM a),
""" + _CORNERS[_CORNERS.index("i AS (") : _CORNERS.index("g AS (")].rstrip(",\n ")


def _step_sql(at: str, rot: str, model: str, pairs: str = "", where: str = "") -> str:
    """An iteration from the corners c on; pairs: tables that say which frames meet which rotations, and where."""
    return at + f""", g AS (SELECT mode, r, pix, SUM(f * intens) AS v FROM c JOIN {model} USING (vox) GROUP BY 1, 2, 3),
views AS (SELECT m.mode, t.r, t.pix, CASE WHEN v * corr > 0 THEN v * corr ELSE 2.2250738585072014e-308 END AS value FROM t CROSS JOIN (SELECT DISTINCT mode FROM {model}) m LEFT JOIN g ON g.mode = m.mode AND g.r = t.r AND g.pix = t.pix),
totals AS (SELECT mode, r, SUM(value) AS u FROM views JOIN det USING (pix) WHERE mask < 1 GROUP BY 1, 2), {_COUNTS},
phi AS (SELECT frame_id, (SELECT AVG(fcount) FROM counts JOIN frames USING (frame_id)) / (SELECT SUM(w * u) / 2 FROM totals JOIN {rot} USING (r)) AS phi FROM frames WHERE blacklist = 0),
{pairs}hits AS (SELECT frame_id, mode, r, SUM(cnt * LN(value)) AS s FROM photons JOIN views USING (pix) JOIN det USING (pix) WHERE mask < 1 GROUP BY 1, 2, 3),
logl AS (SELECT p.frame_id, t.mode, t.r, LN(w) - u * p.phi + COALESCE(s, 0) AS logl FROM phi p CROSS JOIN totals t JOIN {rot} ON {rot}.r = t.r LEFT JOIN hits h ON h.frame_id = p.frame_id AND h.mode = t.mode AND h.r = t.r{where})""" + _TOMO[len(_LOGL) :]


_STEP_2D = _step_sql(_CORNERS[: _CORNERS.index("g AS (")].rstrip(",\n "), "rot", "model")
_STEP_3D, _STEP_RZ = _step_sql(_AT_3D, "turns", "solids"), _step_sql(_AT_RZ, "tilts", "flats")
_SUMS = """, sums AS (SELECT mode, vox, SUM(f * value / corr) AS num, SUM(f) AS weight FROM c JOIN tomo USING (r, pix) GROUP BY 1, 2),
new AS (SELECT m.mode, m.vox, COALESCE(num / weight, 0) AS intens FROM {0} m LEFT JOIN sums s ON s.mode = m.mode AND s.vox = m.vox),
sym AS (SELECT a.mode, a.vox, (a.intens + b.intens) / 2 AS intens FROM new a JOIN new b ON b.mode = a.mode AND b.vox = {1} - a.vox)
SELECT mode, vox, ROUND(intens, 5) AS intens FROM sym"""


def _problem(spark: SparkSession, sf: str, kind: str = "3d") -> recon.Problem:
    frames, photons, det = tb.frames(spark, sf), tb.photons(spark, sf), tb.detector(spark)
    if kind == "2d":
        return recon.Problem(photons, frames, det, tb.rotations(spark), tb.model(spark, sf), Plane(), SIZE)
    if kind == "rz":
        return recon.Problem(photons, frames, det, tb.tilts(spark, sf), tb.models(spark, sf, 2), Axial(), SIZE)
    return recon.Problem(photons, frames, det, tb.turns(spark, sf), tb.models(spark, sf, 3), Volume(), SIZE)


@query(_STEP_2D + _SUMS.format("model", 168))
def emc_iteration(spark: SparkSession, sf: str) -> DataFrame:
    s = recon.Step(_problem(spark, sf, "2d"))
    return rounded(s.next_model(s.rows(post=False)), "intens", digits=5)


@query(_STEP_2D + _SUMS.format("model", 168).replace("SELECT mode, vox, ROUND(intens, 5) AS intens FROM sym", "SELECT ROUND(SQRT(AVG(POWER(s.intens - m.intens, 2))), 5) AS rms_change FROM sym s JOIN model m USING (mode, vox)"))
def model_rms_change(spark: SparkSession, sf: str) -> DataFrame:
    s = recon.Step(_problem(spark, sf, "2d"))
    return rounded(mx.rms_change(s.x.model, s.next_model(s.rows(post=False))), "rms_change", digits=5)


@query(_STEP_2D + _FACT + """, m AS (SELECT frame_id, SUM(p * LN(p * 2 / w)) AS info, SUM(p * (logl - COALESCE(sum_fact, 0))) AS likelihood FROM post JOIN rot USING (r) LEFT JOIN facts USING (frame_id) WHERE p >= 1e-6 GROUP BY 1)
SELECT ROUND(AVG(info), 5) AS info_rate, ROUND(AVG(likelihood), 4) AS log_likelihood FROM m""")
def emc_averages(spark: SparkSession, sf: str) -> DataFrame:
    s = recon.Step(_problem(spark, sf, "2d"))
    metrics = mx.frame_metrics(grid.posterior(s.rows()), s.x.rot, fr.sum_fact(s.x.photons, s.x.det), s.modes)
    return rounded(rounded(mx.averages(metrics, s.x.frames), "info_rate", digits=5), "log_likelihood", digits=4)


@query(_STEP_3D + _SUMS.format("solids", 2196))
def emc_iteration_3d(spark: SparkSession, sf: str) -> DataFrame:
    s = recon.Step(_problem(spark, sf))
    return rounded(s.next_model(s.rows(post=False)), "intens", digits=5)


@query(_STEP_RZ + _SUMS.format("flats", 168))
def emc_iteration_rz(spark: SparkSession, sf: str) -> DataFrame:
    s = recon.Step(_problem(spark, sf, "rz"))
    return rounded(s.next_model(s.rows(post=False)), "intens", digits=5)


@query(_STEP_3D + " SELECT frame_id, mode, r, ROUND(p, 6) AS p FROM post WHERE p > 1e-3")
def posterior_3d(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(recon.Step(_problem(spark, sf)).likely(1e-3), "p")


#: Every fourth rotation is a coarse one; a frame keeps two coarse ones, by its number.
_ALLOWED = """coarse AS (SELECT r AS cell, q0 AS c0, q1 AS c1, q2 AS c2, q3 AS c3, ROW_NUMBER() OVER (ORDER BY r) - 1 AS k FROM turns WHERE r % 4 = 1),
cells AS (SELECT r, cell FROM turns, coarse QUALIFY ROW_NUMBER() OVER (PARTITION BY r ORDER BY 1 - POWER(q0*c0 + q1*c1 + q2*c2 + q3*c3, 2), cell) = 1),
kept AS (SELECT DISTINCT f.frame_id, cell FROM frames f, (SELECT COUNT(*) AS n FROM coarse) z, (VALUES (0), (1)) x(i), coarse WHERE blacklist = 0 AND coarse.k = (f.frame_id + i * 3) % n),
pairs AS (SELECT frame_id, r FROM kept JOIN cells USING (cell)),
"""
_STEP_REFINED = _step_sql(_AT_3D, "turns", "solids", _ALLOWED, " JOIN pairs ON pairs.frame_id = p.frame_id AND pairs.r = t.r")


def _refinement(spark: SparkSession, sf: str) -> recon.Step:
    x = _problem(spark, sf)
    coarse = x.rot.filter("r % 4 = 1")
    ids = F.broadcast(coarse.agg(F.array_sort(F.collect_list("r")).alias("ids")))
    some = x.frames.filter("blacklist = 0").crossJoin(ids)
    nth = lambda i: F.get("ids", ((F.col("frame_id") + 3 * i) % F.size("ids")).cast("int"))
    kept = some.select("frame_id", F.explode(F.array_distinct(F.array(nth(0), nth(1)))).alias("cell"))
    return recon.Step(x, allowed=(kept, recon.cells(x.rot, coarse)))


@query(_STEP_REFINED + " SELECT frame_id, mode, r, ROUND(logl, 5) AS logl FROM logl")
def refined_likelihood(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_refinement(spark, sf).likelihoods(), "logl", digits=5)


@query(_STEP_REFINED + _SUMS.format("solids", 2196))
def refined_iteration(spark: SparkSession, sf: str) -> DataFrame:
    s = _refinement(spark, sf)
    return rounded(s.next_model(s.rows(post=False)), "intens", digits=5)


# Analysis

_RBIN = "CAST(TRUNC(SQRT(POWER(vox // 13 - 6, 2) + POWER(vox % 13 - 6, 2))) AS INT)"


@query(f"SELECT mode, {_RBIN} AS rbin, ROUND(AVG(intens), 9) AS mean, ROUND(MIN(intens), 9) AS least FROM model GROUP BY 1, 2")
def model_radial(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(an.radial(tb.model(spark, sf), SIZE, 2), "mean", "least", digits=9)


@query(f"SELECT mode, vox, ROUND(CASE WHEN {_RBIN} BETWEEN 1 AND 5 THEN SQRT(intens) - AVG(SQRT(intens)) OVER (PARTITION BY mode, {_RBIN}) ELSE 0 END, 6) + 0.0 AS intens FROM model")
def model_minus_radial_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(an.minus_radial(tb.model(spark, sf), SIZE, 2, exponent=0.5, limits=(1, 5)), "intens")


@query(f"SELECT mode, vox, ROUND(intens - MIN(intens) OVER (PARTITION BY mode, {_RBIN}), 6) + 0.0 AS intens FROM model")
def model_minus_radial_min(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(an.minus_radial(tb.model(spark, sf), SIZE, 2, "min"), "intens")


def _flat_sql(name: str, size: int, modes: int) -> str:
    """The table that tables.models() gives for two dimensions."""
    return f"""{name} AS (SELECT m.range AS mode, v.range AS vox, 0.2::DOUBLE + COALESCE(n % 101, 0) / 50.0::DOUBLE AS intens FROM range({size * size}) v CROSS JOIN range({modes}) m
  LEFT JOIN (SELECT p_partkey % {modes} AS mode, p_partkey // {modes} % {size * size} AS vox, SUM(p_size) AS n FROM part GROUP BY 1, 2) p ON p.mode = m.range AND p.vox = v.range)"""


@query(_flat_sql("wide", 83, 2) + """, x AS (SELECT *, TRUNC(SQRT(POWER(vox // 83 - 41, 2) + POWER(vox % 83 - 41, 2))) AS r FROM wide)
SELECT mode, vox, ROUND(intens / AVG(CASE WHEN r > 0.9 * 41 AND r < 38 THEN intens END) OVER (PARTITION BY mode), 6) AS intens FROM x""")
def model_high_q(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(an.high_q_normalised(tb.models(spark, sf, 2, size=83), 83, 2), "intens")


@query(f"SELECT {_RBIN.replace('vox', 'a.vox')} AS rbin, ROUND(SUM(a.intens * b.intens) / SQRT(SUM(a.intens * a.intens)) / SQRT(SUM(b.intens * b.intens)), 9) AS fsc FROM flats a JOIN flats b ON a.vox = b.vox AND a.mode = 0 AND b.mode = 1 WHERE {_RBIN.replace('vox', 'a.vox')} < 6 GROUP BY 1")
def shell_correlation(spark: SparkSession, sf: str) -> DataFrame:
    m = tb.models(spark, sf, 2)
    return rounded(an.shell_correlation(m.filter("mode = 0"), m.filter("mode = 1"), SIZE, 2), "fsc", digits=9)


_POLAR = """a AS (SELECT pix, mask, SQRT(x*x + y*y) AS rad, ATAN2(x, y) AS t FROM det),
b AS (SELECT pix, mask < 1 AS good, rad, CAST(TRUNC(rad) AS INT) AS rbin, CAST(TRUNC(ang - MIN(ang) OVER ()) AS INT) AS abin FROM (SELECT *, (CASE WHEN t < 0 THEN t + PI() WHEN t >= PI() THEN t - PI() ELSE t END) / (PI() * 30 / 180) AS ang FROM a)),
cells AS (SELECT (LEAST(4, MAX(rbin) + 1) - 1) * (MAX(abin) + 1) AS cells FROM b),
n AS (SELECT rbin, abin, COUNT(*) AS n FROM b WHERE good AND rbin >= 1 AND rbin < 4 GROUP BY 1, 2),
s AS (SELECT frame_id, rbin, abin, SUM(cnt) / MAX(n) AS v FROM photons JOIN (SELECT * FROM b WHERE good) USING (pix) JOIN n USING (rbin, abin) GROUP BY 1, 2, 3)
"""


def _polar(spark: SparkSession, sf: str) -> DataFrame:
    return an.polar(tb.photons(spark, sf), an.polar_bins(tb.detector(spark), 1.0, 30.0), 1, 4)


@query(_POLAR + "SELECT frame_id, rbin, abin, ROUND(v / SUM(v) OVER (PARTITION BY frame_id) * (SELECT cells FROM cells), 6) AS mean FROM s")
def frames_polar(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_polar(spark, sf), "mean")


@query(_POLAR + """, p AS (SELECT frame_id, rbin, abin, v / SUM(v) OVER (PARTITION BY frame_id) * (SELECT cells FROM cells) AS mean FROM s),
d AS (SELECT frame_id, rbin, SQRT(GREATEST(SUM(mean * mean) - SUM(mean) * SUM(mean) / 6, 0)) AS norm FROM p GROUP BY 1, 2),
k AS (SELECT p.frame_id, p.rbin, k.range AS k, SUM(mean * COS(2 * PI() * k.range * abin / 6)) AS re, SUM(mean * SIN(2 * PI() * k.range * abin / 6)) AS im FROM p, range(1, 10) k GROUP BY 1, 2, 3)
SELECT k.frame_id, k.rbin, CAST(k AS INT) AS k, ROUND(CASE WHEN norm > 1e-6 THEN SQRT(re * re + im * im) / norm ELSE 0 END, 4) + 0.0 AS value FROM k JOIN d USING (frame_id, rbin)""")
def frames_angular_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(an.angular_correlation(_polar(spark, sf), 6), "value", digits=4)


@query(_POLAR + "SELECT frame_id, pix, ROUND(cnt * (SELECT COUNT(*) FROM b WHERE rad BETWEEN 1 AND 4) / SUM(cnt) OVER (PARTITION BY frame_id), 6) AS value FROM photons JOIN b USING (pix) WHERE rad BETWEEN 1 AND 4")
def frames_raw_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(an.raw_features(tb.photons(spark, sf), tb.detector(spark), 1.0, 4.0), "value")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Seven lines of each of five models, but for the three cells in their middle."""
    return an.radial_lines(tb.models(spark, sf, 2, modes=5), SIZE, 7, 1)


@query(_flat_sql("five", 13, 5) + """, spots AS (SELECT i.range AS line, k.range AS k, CAST(ROUND_EVEN((k.range - 6) * COS(i.range * PI() / 7) + 6, 0) * 13 + ROUND_EVEN((k.range - 6) * SIN(i.range * PI() / 7) + 6, 0) AS BIGINT) AS vox FROM range(7) i, range(13) k WHERE ABS(k.range - 6) > 1),
x AS (SELECT mode, line, k, intens AS v FROM five JOIN spots USING (vox)),
varied AS (SELECT mode, line FROM x GROUP BY 1, 2 HAVING MAX(v) > MIN(v)),
y AS (SELECT x.* FROM x JOIN varied USING (mode, line)),
c AS (SELECT a.mode AS i, b.mode AS j, a.line AS li, b.line AS lj, CORR(a.v, b.v) AS c FROM y a JOIN y b ON a.k = b.k AND a.mode <> b.mode GROUP BY 1, 2, 3, 4)
SELECT i, j, ROUND(MAX(c), 9) AS cc FROM c GROUP BY 1, 2 UNION ALL SELECT range, range, 1.0 FROM range(5)""")
def common_lines(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(an.common_lines(_lines(spark, sf), block=2), "cc", digits=9)


@query()
def common_line_components(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(an.principal_components(an.common_lines(_lines(spark, sf)), 2).withColumn("c1", F.abs("c1")).withColumn("c2", F.abs("c2")), "c1", "c2", digits=5)


@query("""it AS (SELECT iteration, COUNT(*) AS n FROM iter_log GROUP BY 1),
nw AS (SELECT iteration, CASE WHEN n <> LAG(n) OVER (ORDER BY iteration) THEN 1 ELSE 0 END AS new FROM it),
sg AS (SELECT iteration, CAST(SUM(new) OVER (ORDER BY iteration) AS BIGINT) AS segment FROM nw),
la AS (SELECT segment, MAX(iteration) AS iteration FROM sg GROUP BY 1),
pl AS (SELECT segment, frame_id, ROW_NUMBER() OVER (PARTITION BY segment ORDER BY rmax, frame_id) - 1 AS place FROM iter_log JOIN la USING (iteration))
SELECT l.iteration, l.frame_id, s.segment, CAST(p.place AS INT) AS place FROM iter_log l JOIN sg s USING (iteration) JOIN pl p ON p.segment = s.segment AND p.frame_id = l.frame_id""")
def orientation_order(spark: SparkSession, sf: str) -> DataFrame:
    return an.orientation_order(tb.iter_log(spark, sf))


@query("SELECT * FROM (SELECT frame_id, iteration, rmax <> LAG(rmax) OVER (PARTITION BY frame_id ORDER BY iteration) AS moved FROM iter_log) WHERE moved IS NOT NULL")
def orientation_changes(spark: SparkSession, sf: str) -> DataFrame:
    return an.changes(tb.iter_log(spark, sf))


@query("SELECT vox FROM cube ORDER BY intens DESC, vox LIMIT 60")
def volume_support(spark: SparkSession, sf: str) -> DataFrame:
    return an.support(tb.volume(spark, sf), 60)


_POINTS = "pts AS (SELECT frame_id, SUM(CASE WHEN pix = 0 THEN val END) AS x, SUM(CASE WHEN pix = 1 THEN val END) AS y FROM dense WHERE pix < 2 GROUP BY 1)"


def _points(spark: SparkSession, sf: str) -> DataFrame:
    d = tb.dense_frames(spark, sf).filter("pix < 2")
    return d.groupBy("frame_id").agg(*[F.sum(F.when(F.col("pix") == i, F.col("val"))).alias(k) for i, k in enumerate("xy")])


@query(_POINTS + """, l AS (SELECT MIN(x) AS x0, MAX(x) AS x1, MIN(y) AS y0, MAX(y) AS y1 FROM pts)
SELECT CAST(LEAST(9, FLOOR((x - x0) / (x1 - x0) * 10)) AS INT) AS bx, CAST(LEAST(9, FLOOR((y - y0) / (y1 - y0) * 10)) AS INT) AS by, COUNT(*) AS n FROM pts, l GROUP BY 1, 2""")
def embedding_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return an.histogram2d(_points(spark, sf), 10)


@query(_POINTS + " SELECT frame_id FROM pts WHERE x >= -0.1 AND x < 0.1 AND y >= -0.1 AND y < 0.1")
def embedding_polygon(spark: SparkSession, sf: str) -> DataFrame:
    return an.in_polygon(_points(spark, sf), [(-0.1, -0.1), (0.1, -0.1), (0.1, 0.1), (-0.1, 0.1)]).select("frame_id")


@query("WITH_P SELECT CAST(frame_id AS BIGINT) AS mode, ROUND(x, 9) AS x, ROUND(y, 9) AS y FROM pts ORDER BY POWER(x - 0.05, 2) + POWER(y + 0.02, 2), frame_id LIMIT 1".replace("WITH_P", _POINTS))
def embedding_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(an.nearest_class(_points(spark, sf).withColumnRenamed("frame_id", "mode"), 0.05, -0.02), "x", "y", digits=9)


@query("SELECT mode, ROUND(0.5 * ATAN2(2 * SUM(intens * (vox // 13 - 6) * (vox % 13 - 6)), SUM(intens * POWER(vox // 13 - 6, 2)) - SUM(intens * POWER(vox % 13 - 6, 2))), 6) AS angle FROM model GROUP BY 1")
def model_principal_axis(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(an.principal_axis(tb.model(spark, sf), SIZE), "angle")


@query("SELECT mode, COUNT(DISTINCT frame_id) AS n FROM dense GROUP BY 1")
def frames_per_mode(spark: SparkSession, sf: str) -> DataFrame:
    return tb.dense_frames(spark, sf).select("mode", "frame_id").distinct().groupBy("mode").agg(F.count("*").alias("n"))


@query()
def class_phasing(spark: SparkSession, sf: str) -> DataFrame:
    return an.phased(tb.model(spark, sf), SIZE, 40).select("mode", "vox", F.round("density", 6).alias("density"))


@query()
def frames_classified(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    d = tb.dense_frames(spark, sf)
    x = d.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("pix", "val"))).alias("v"), F.first("mode").alias("mode"))
    x = x.select("frame_id", array_to_vector("v.val").alias("features"), "mode")
    return an.classify(x.select("frame_id", "features"), x.select("frame_id", (F.when(F.col("frame_id") % 2 == 0, F.col("mode") % 3 + 1).otherwise(0)).alias("label")), [64, 12, 3])


@query()
def frames_simulated(spark: SparkSession, sf: str) -> DataFrame:
    import numpy as np

    from speckle.operators.simulate import simulated

    cube = (0.5 + (np.arange(SIZE**3) * 37 % 101) / 101).reshape((SIZE,) * 3)
    n = tb.frames(spark, sf).count()
    return simulated(spark, n, cube, tb.detector(spark).toPandas(), 50.0).select("frame_id", "pix", "cnt")


# Known orientations, volumes, bookkeeping


@query(_POST + """, pick AS (SELECT frame_id, MIN(r) AS r FROM post GROUP BY 1),
h AS (SELECT l.frame_id, l.mode, l.r, l.logl FROM logl l JOIN pick p ON p.frame_id = l.frame_id AND p.r = l.r),
hb AS (SELECT frame_id, MAX(logl) AS best FROM h GROUP BY 1),
he AS (SELECT h.*, EXP(beta * (logl - best)) AS e FROM h JOIN hb USING (frame_id) JOIN betas USING (frame_id) WHERE logl > best - 14.0 / beta)
SELECT frame_id, mode, ROUND(p, 6) AS p FROM (SELECT frame_id, mode, e / SUM(e) OVER (PARTITION BY frame_id) AS p FROM he) WHERE p >= 1e-4""")
def mode_posterior(spark: SparkSession, sf: str) -> DataFrame:
    s = emc.State(spark, sf)
    pick = s.post.groupBy("frame_id").agg(F.min("r").alias("r"))
    return rounded(kn.mode_posterior(s.logl, pick, mx.start_beta(s.counts)).select("frame_id", "mode", "p"), "p")


@query(_POST + " SELECT frame_id, mode, r, ROUND(p, 6) AS p FROM post WHERE p > 1e-6")
def saved_posterior(spark: SparkSession, sf: str) -> DataFrame:
    """Stored by running view numbers, and read back."""
    s = emc.State(spark, sf)
    return rounded(kn.previous_posterior(kn.saved_posterior(s.post, 12, 2), s.phi, 12, 2), "p")


@query(_COUNTS + """, best AS (SELECT frame_id, CAST(frame_id % 12 AS BIGINT) AS r, CAST(0 AS BIGINT) AS mode FROM frames WHERE blacklist = 0),
base AS (SELECT mode, r, SUM(scale) AS psum FROM best JOIN frames USING (frame_id) GROUP BY 1, 2),
lit AS (SELECT mode, r, pix, SUM(cnt) AS s FROM best JOIN photons USING (frame_id) JOIN det USING (pix) WHERE mask < 2 GROUP BY 1, 2, 3),
tomo AS (SELECT b.mode, b.r, d.pix, COALESCE(s, 0) / psum AS value FROM base b CROSS JOIN (SELECT pix FROM det WHERE mask < 2) d LEFT JOIN lit ON lit.mode = b.mode AND lit.r = b.r AND lit.pix = d.pix),
""" + _CORNERS.split("\ng AS (")[0].rstrip(",") + " SELECT mode, vox, ROUND(CASE WHEN SUM(f) > 0 THEN SUM(f * value / corr) / SUM(f) ELSE 0 END, 5) AS intens FROM c JOIN tomo USING (r, pix) GROUP BY 1, 2")
def merged_known(spark: SparkSession, sf: str) -> DataFrame:
    s = emc.State(spark, sf)
    best = s.phi.select("frame_id", F.lit(0).cast("long").alias("mode"), (F.col("frame_id") % 12).alias("r"), F.lit(1.0).alias("p"))
    return rounded(kn.merged_known(s.photons, best, s.coords, s.phi, s.det, s.size), "intens", digits=5)


@query()
def scale_background(spark: SparkSession, sf: str) -> DataFrame:
    s = emc.State(spark, sf)
    return rounded(kn.scale_background(s.photons, s.post, s.views, s.counts, emc.with_background(s.det), s.phi.withColumn("bgscale", F.lit(0.5))), "phi", digits=5)


@query(_POST + """, z AS (SELECT post.frame_id, p, 2 * (v.value * scale + 0.5 * (0.01 + 0.001 * (v.pix % 7))) AS z FROM post JOIN frames f ON f.frame_id = post.frame_id
  JOIN views v ON v.mode = post.mode AND v.r = post.r JOIN det d ON d.pix = v.pix WHERE p > 1e-6 AND mask < 1), y AS (SELECT *, z * z / 4 AS y FROM z)
SELECT frame_id, ROUND(SUM(p * (LN(1 + y * (1 + y / 4 * (1 + y / 9 * (1 + y / 16 * (1 + y / 25 * (1 + y / 36)))))) - z)), 6) AS expected FROM y GROUP BY 1""")
def expected_likelihood(spark: SparkSession, sf: str) -> DataFrame:
    """Views and backgrounds are small here, so that the series of the Bessel function ends after a few terms."""
    s = emc.State(spark, sf)
    return rounded(kn.expected_likelihood(s.post, s.views, s.phi.withColumn("bgscale", F.lit(0.5)), emc.with_background(s.det)), "expected")


@query("""v AS (SELECT m.range AS mode, v.range AS vox FROM range(3) m, range(169) v)
SELECT v.mode, v.vox, ROUND(COALESCE(intens, CAST(('0x' || substr(md5('24301|' || v.mode || '|' || v.vox), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE * 1.5), 6) AS intens FROM v LEFT JOIN model ON model.mode = v.mode AND model.vox = v.vox""")
def start_model(spark: SparkSession, sf: str) -> DataFrame:
    """Two modes are given, the third is random."""
    return rounded(kn.start_model(tb.model(spark, sf), spark, 3, SIZE, 2, 1.5), "intens")


@query("SELECT MIN(CASE WHEN frame_id > 500 THEN frame_id END) AS next, MAX(CASE WHEN frame_id < 500 THEN frame_id END) AS previous FROM frames WHERE blacklist = 0")
def frame_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return kn.neighbours(tb.frames(spark, sf).filter("blacklist = 0"), 500)


@query("SELECT frame_id, CASE WHEN frame_id % 5 = 0 THEN 'x' ELSE cls END AS cls FROM frames")
def classes_reassigned(spark: SparkSession, sf: str) -> DataFrame:
    f = tb.frames(spark, sf)
    return kn.reclassified(f, f.filter("frame_id % 5 = 0"), "x")


@query("""m AS (SELECT frame_id, MAX(pix) AS top, COUNT(*) FILTER (cnt > 1) AS multi FROM photons GROUP BY 1)
SELECT frame_id, CASE WHEN multi > 0 AND frame_id % 3 = 1 THEN 'lengths' WHEN multi > 0 AND frame_id % 3 = 2 THEN 'counts' ELSE 'places' END AS problem FROM m
WHERE (multi > 0 AND frame_id % 3 IN (1, 2)) OR top >= 60""")
def frames_invalid(spark: SparkSession, sf: str) -> DataFrame:
    """Of frames with multis every third lacks a count, and every third has counts of one."""
    x, k = fr.ones_multi(tb.photons(spark, sf)), F.col("frame_id") % 3
    short, low = F.slice("count_multi", 2, F.size("count_multi")), F.transform("count_multi", lambda c: F.lit(1))
    return kn.valid_frames(x.withColumn("count_multi", F.when((k == 1) & (F.size("count_multi") > 0), short).when(k == 2, low).otherwise(F.col("count_multi"))), 60)


@query("SELECT file_id, frame_id, CAST(ROW_NUMBER() OVER (PARTITION BY file_id ORDER BY frame_id % 12, frame_id) - 1 AS INT) AS place FROM frames")
def frames_by_orientation(spark: SparkSession, sf: str) -> DataFrame:
    f = tb.frames(spark, sf)
    return kn.ranked_by_orientation(f, f.select("frame_id", (F.col("frame_id") % 12).alias("r")))


@query(_CORNERS + " SELECT frame_id, pix, ROUND(value, 9) AS value FROM (SELECT frame_id, frame_id % 2 AS mode, frame_id % 12 AS r FROM frames) JOIN views USING (mode, r)")
def frames_predicted(spark: SparkSession, sf: str) -> DataFrame:
    best = tb.frames(spark, sf).select("frame_id", (F.col("frame_id") % 2).alias("mode"), (F.col("frame_id") % 12).alias("r"))
    return rounded(kn.predicted(best, _views(spark, sf)), "value", digits=9)


@query("""i AS (SELECT CAST(x + 3.5 AS INT) AS ix, CAST(y + 3.5 AS INT) AS iy, CAST(COALESCE(SUM(cnt), 0) AS BIGINT) AS value FROM det d LEFT JOIN (SELECT * FROM photons WHERE frame_id = (SELECT MIN(frame_id) FROM photons)) p ON p.pix = d.pix WHERE mask < 2 GROUP BY 1, 2),
l AS (SELECT MIN(ix) AS x0, MAX(ix) AS x1, MIN(iy) AS y0, MAX(iy) AS y1 FROM i WHERE value > 0)
SELECT ix, iy, value FROM i, l WHERE ix BETWEEN x0 - 1 AND x1 + 1 AND iy BETWEEN y0 - 1 AND y1 + 1""")
def frame_zoomed(spark: SparkSession, sf: str) -> DataFrame:
    return kn.zoom(frame_assembled(spark, sf), 1)


@query("""g AS (SELECT range AS r, COS(range * 2 * PI() / 12) AS c, SIN(range * 2 * PI() / 12) AS s FROM range(12)),
q AS (SELECT r, CASE WHEN c > 0 THEN SQRT(1 + c) / 2 ELSE s / SQRT(1 - c) / 2 END AS q0, CASE WHEN c > 0 THEN s / SQRT(1 + c) / 2 ELSE SQRT(1 - c) / 2 END AS q1 FROM g),
p AS (SELECT range AS pix, range // 9 - 4 AS x, range % 9 - 4 AS y FROM range(81)),
t AS (SELECT r, pix, (1 - 2 * (q0*q0 + q1*q1)) * x + 2 * (q1*q0 - q0*q1) * y + 4 AS t0, 2 * (q1*q0 + q0*q1) * x + (1 - 2 * (q1*q1 + q1*q1)) * y + 4 AS t1, 2 * (q1*q1 - q0*q0) * x + 2 * (q0*q1 + q0*q1) * y + 4 AS t2 FROM q, p),
i AS (SELECT *, CAST(TRUNC(t0) AS BIGINT) AS i0, CAST(TRUNC(t1) AS BIGINT) AS i1, CAST(TRUNC(t2) AS BIGINT) AS i2 FROM t),
n AS (SELECT pix, ((i0 + a) * 9 + i1 + b) * 9 + i2 + d AS vox, ABS(1 - a - (t0 - i0)) * ABS(1 - b - (t1 - i1)) * ABS(1 - d - (t2 - i2)) AS f
  FROM i, (VALUES (0), (1)) x(a), (VALUES (0), (1)) y(b), (VALUES (0), (1)) z(d) WHERE t0 >= 0 AND t1 >= 0 AND t2 >= 0 AND i0 <= 7 AND i1 <= 7 AND i2 <= 7),
plane AS (SELECT pix AS vox, SUM(f * intens) / 12 AS intens FROM n JOIN cube USING (vox) GROUP BY 1),
w AS (SELECT (range - 6) * 4 * (PI() / 18) / 6 AS a FROM range(12)),
u AS (SELECT pix, EXP(-a * a / 2 / POWER(PI() / 18, 2)) AS w, COS(a) * x - SIN(a) * y AS t0, SIN(a) * x + COS(a) * y AS t1 FROM p, w),
j AS (SELECT pix, w, t0 + 4 AS t0, t1 + 4 AS t1, CAST(TRUNC(t0 + 4) AS BIGINT) AS i0, CAST(TRUNC(t1 + 4) AS BIGINT) AS i1 FROM u WHERE SQRT(t0 * t0 + t1 * t1) <= 3.3),
k AS (SELECT pix, w, (i0 + a) * 9 + i1 + b AS vox, ABS(1 - a - (t0 - i0)) * ABS(1 - b - (t1 - i1)) AS f FROM j, (VALUES (0), (1)) x(a), (VALUES (0), (1)) y(b)),
o AS (SELECT pix, SUM(w * f * intens) AS value FROM k JOIN plane USING (vox) GROUP BY 1)
SELECT pix AS vox, ROUND(COALESCE(value, 0), 5) AS value FROM p LEFT JOIN o USING (pix)""")
def volume_cylindrical(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(vo.fibre_average(tb.volume(spark, sf), 9, 10.0, 12, 6, 0.7), "value", digits=5)


@query("""r AS (SELECT range - 3 AS v FROM range(7)), p AS (SELECT a.v AS h, b.v AS k, c.v AS l FROM r a, r b, r c)
SELECT h, k, l FROM p WHERE (h <> 0 OR k % 2 = 0) AND (k <> 0 OR l % 2 = 0) AND (l <> 0 OR h % 2 = 0)
AND (k <> 0 OR l <> 0 OR h % 2 = 0) AND (h <> 0 OR l <> 0 OR k % 2 = 0) AND (h <> 0 OR k <> 0 OR l % 2 = 0)""")
def lattice_allowed(spark: SparkSession, sf: str) -> DataFrame:
    return vo.lattice(spark, 3)


@query("""r AS (SELECT range - 1 AS v FROM range(3)), p AS (SELECT a.v AS h, b.v AS k, c.v AS l, a.v * 2.4::DOUBLE + 4 AS x, b.v * 2.4::DOUBLE + 4 AS y, c.v * 2.4::DOUBLE + 4 AS z FROM r a, r b, r c),
b AS (SELECT * FROM p WHERE x - 2 >= 0 AND x + 2 < 9 AND y - 2 >= 0 AND y + 2 < 9 AND z - 2 >= 0 AND z + 2 < 9),
v AS (SELECT vox, intens, vox // 81 AS i, vox // 9 % 9 AS j, vox % 9 AS m FROM cube),
o AS (SELECT vox, MAX(intens) AS intens, MIN((h + 8) * 256 + (k + 8) * 16 + l + 8) AS own FROM b, v WHERE i BETWEEN FLOOR(x) - 2 AND FLOOR(x) + 1 AND j BETWEEN FLOOR(y) - 2 AND FLOOR(y) + 1 AND m BETWEEN FLOOR(z) - 2 AND FLOOR(z) + 1
  AND POWER(i - FLOOR(x + 0.5), 2) + POWER(j - FLOOR(y + 0.5), 2) + POWER(m - FLOOR(z + 0.5), 2) < 4 GROUP BY 1)
SELECT CAST(own // 256 - 8 AS BIGINT) AS h, CAST(own // 16 % 16 - 8 AS BIGINT) AS k, CAST(own % 16 - 8 AS BIGINT) AS l, ROUND(SUM(intens), 6) AS total FROM o GROUP BY own HAVING SUM(intens) > 0""")
def lattice_sphere_spots(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(vo.sphere_spots(tb.volume(spark, sf), vo.lattice(spark, 1, extinct=False), 2.4, 9, 2), "total")


@query("""r AS (SELECT range - 1 AS v FROM range(3)), p AS (SELECT a.v AS h, b.v AS k, c.v AS l FROM r a, r b, r c)
SELECT h, k, l, ROUND(SUM(intens), 6) AS total FROM p JOIN cube ON POWER(vox // 81 - 4 - 3 * h, 2) + POWER(vox // 9 % 9 - 4 - 3 * k, 2) + POWER(vox % 9 - 4 - 3 * l, 2) < 1.44 GROUP BY 1, 2, 3""")
def lattice_spots(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(vo.spots(tb.volume(spark, sf), vo.lattice(spark, 1, extinct=False), 3.0, 9, 1.2), "total")


@query("""r AS (SELECT range - 1 AS v FROM range(3)), p AS (SELECT a.v AS h, b.v AS k, c.v AS l FROM r a, r b, r c WHERE (a.v <> 0 OR b.v % 2 = 0) AND (b.v <> 0 OR c.v % 2 = 0) AND (c.v <> 0 OR a.v % 2 = 0)
AND (b.v <> 0 OR c.v <> 0 OR a.v % 2 = 0) AND (a.v <> 0 OR c.v <> 0 OR b.v % 2 = 0) AND (a.v <> 0 OR b.v <> 0 OR c.v % 2 = 0)),
g AS (SELECT vox, vox // 81 - 4 - 3 * h AS x, vox // 9 % 9 - 4 - 3 * k AS y, vox % 9 - 4 - 3 * l AS z FROM p, cube)
SELECT vox, ROUND(SUM(EXP(-(x*x + y*y + z*z) / (2 * 0.49))), 6) AS intens FROM g WHERE ABS(x) <= 1 AND ABS(y) <= 1 AND ABS(z) <= 1 GROUP BY 1""")
def volume_crystal(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(vo.crystal(vo.lattice(spark, 1).withColumn("f", F.lit(1.0)), 3.0, 9, 0.7), "intens")


@query("""a AS (SELECT vox, vox // 13 AS x, vox % 13 AS y, intens FROM model WHERE mode = 0)
SELECT a.vox, ROUND(MAX(a.intens) - MIN(b.intens), 6) + 0.0 AS value FROM a JOIN a b ON ABS(a.x - b.x) <= 2 AND ABS(a.y - b.y) <= 2 GROUP BY 1""")
def image_minimum_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(vo.minimum_filtered(tb.model(spark, sf).filter("mode = 0"), SIZE, 2), "value")


@query(_POLAR + """, t AS (SELECT rbin, abin, SUM(v) AS value FROM s GROUP BY 1, 2), m AS (SELECT MAX(abin) + 1 AS n FROM t),
x AS (SELECT rbin, ((abin + d) % n + n) % n AS abin, EXP(-d * d / 2.0) AS w, value FROM t, m, (SELECT range - 2 AS d FROM range(5)))
SELECT rbin, CAST(abin AS INT) AS abin, ROUND(SUM(w * value) / SUM(w), 5) AS value FROM x GROUP BY 1, 2""")
def powder_blurred(spark: SparkSession, sf: str) -> DataFrame:
    t = an.ring_means(tb.photons(spark, sf), an.polar_bins(tb.detector(spark), 1.0, 30.0), 1, 4)
    return rounded(vo.blurred(t.select("rbin", "abin", F.col("v").alias("value")), 1.0, 2), "value", digits=5)


@query("SELECT vox, ROUND(b.intens, 6) AS intens FROM (SELECT vox, vox // 81 - 4 AS x, vox // 9 % 9 - 4 AS y, vox % 9 - 4 AS z FROM cube) a JOIN (SELECT vox AS v, intens FROM cube) b ON v = (-y + 4) * 81 + (x + 4) * 9 + z + 4 WHERE x*x + y*y + z*z < 16")
def volume_rotated(spark: SparkSession, sf: str) -> DataFrame:
    m = spark.createDataFrame([(0, 0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)], "k int, " + ", ".join(f"m{i}{j} double" for i in range(3) for j in range(3)))
    return rounded(vw.rotated(tb.volume(spark, sf), m, 9).select("vox", "intens"), "intens")


@query(_CORNERS + """, d AS (SELECT frame_id, pix, CAST(FLOOR(val * 20) AS INT) AS cnt FROM dense JOIN det USING (pix) WHERE mask < 1 AND FLOOR(val * 20) > 0),
u AS (SELECT mode, r, SUM(value) AS u FROM views JOIN det USING (pix) WHERE mask < 1 GROUP BY 1, 2),
h AS (SELECT frame_id, mode, r, SUM(cnt * LN(value)) AS s FROM d JOIN views USING (pix) GROUP BY 1, 2, 3)
SELECT f.frame_id, u.mode, u.r, ROUND(LN(w) - u + COALESCE(s, 0), 5) AS logl FROM (SELECT DISTINCT frame_id FROM dense) f CROSS JOIN u JOIN rot USING (r) LEFT JOIN h ON h.frame_id = f.frame_id AND h.mode = u.mode AND h.r = u.r""")
def log_likelihood_dense(spark: SparkSession, sf: str) -> DataFrame:
    det, v = tb.detector(spark), _views(spark, sf)
    dense = tb.dense_frames(spark, sf)
    photons = fr.sparsified(dense.withColumn("val", F.floor(F.col("val") * 20).cast("double")), det)
    phi = dense.select("frame_id").distinct().withColumn("phi", F.lit(1.0))
    return rounded(mx.log_likelihood(photons, v, mx.view_totals(v, det), tb.rotations(spark), phi, det), "logl", digits=5)


@query("SELECT mode, vox, ROUND(0.3 * intens + 0.7 * (intens * intens), 6) AS intens FROM model")
def model_mixed(spark: SparkSession, sf: str) -> DataFrame:
    m = tb.model(spark, sf)
    return rounded(mx.mixed_model(m, m.withColumn("intens", F.col("intens") * F.col("intens")), 0.3), "intens")


@query("""a AS (SELECT CAST(s_suppkey AS DOUBLE) % 7 * 0.63 AS x, CAST(s_nationkey AS DOUBLE) * 0.21 AS y, CAST(s_suppkey AS DOUBLE) % 11 * 0.37 AS z, 1.0 + s_suppkey % 3 AS f0 FROM supplier),
m AS (SELECT (MIN(x) + MAX(x)) / 2 AS cx, (MIN(y) + MAX(y)) / 2 AS cy, (MIN(z) + MAX(z)) / 2 AS cz FROM a),
t AS (SELECT f0, x - cx + 6 AS t0, y - cy + 6 AS t1, z - cz + 6 AS t2 FROM a, m),
c AS (SELECT ((TRUNC(t0) + i) * 13 + TRUNC(t1) + j) * 13 + TRUNC(t2) + k AS vox, f0 * ABS(1 - i - (t0 - TRUNC(t0))) * ABS(1 - j - (t1 - TRUNC(t1))) * ABS(1 - k - (t2 - TRUNC(t2))) AS v
  FROM t, (VALUES (0), (1)) p(i), (VALUES (0), (1)) q(j), (VALUES (0), (1)) r(k))
SELECT CAST(vox AS BIGINT) AS vox, ROUND(SUM(v), 5) + 0.0 AS value FROM c GROUP BY 1""")
def density_from_atoms(spark: SparkSession, sf: str) -> DataFrame:
    from speckle.operators.simulate import density

    s = spark.read.parquet(f"{sf}/supplier.parquet")
    key = F.col("s_suppkey").cast("double")
    atoms = s.select((key % 7 * 0.63).alias("x"), (F.col("s_nationkey").cast("double") * 0.21).alias("y"), (key % 11 * 0.37).alias("z"), (1.0 + F.col("s_suppkey") % 3).alias("f0"))
    return rounded(density(atoms, 1.0, SIZE), "value", digits=5)


# Several detectors: the second ignores pixels beyond a radius

_DET2 = """det2 AS (SELECT 0 AS det_id, pix, mask FROM det UNION ALL SELECT 1, pix, CASE WHEN mask = 0 AND SQRT(qx*qx + qy*qy + qz*qz) > 2.5 THEN 1 ELSE mask END FROM det),
own AS (SELECT frame_id, CAST(file_id % 2 AS INT) AS det_id, scale, blacklist FROM frames)"""


def _detectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    det = tb.detector(spark)
    both = det.withColumn("det_id", F.lit(0)).union(dt.remask(det, 2.5).withColumn("det_id", F.lit(1)))
    return both, tb.frames(spark, sf).withColumn("det_id", (F.col("file_id") % 2).cast("int"))


@query(_DET2 + """, s AS (SELECT o.frame_id, SUM(cnt) AS s FROM own o JOIN photons p ON p.frame_id = o.frame_id JOIN det2 d ON d.det_id = o.det_id AND d.pix = p.pix WHERE mask < 1 GROUP BY 1)
SELECT own.frame_id, det_id, CAST(COALESCE(s, 0) AS BIGINT) AS fcount FROM own LEFT JOIN s USING (frame_id)""")
def detectors_counts(spark: SparkSession, sf: str) -> DataFrame:
    det, frames = _detectors(spark, sf)
    return mu.frame_counts(tb.photons(spark, sf), frames, det)


@query(_DET2 + """, s AS (SELECT o.det_id, p.pix, SUM(cnt) AS s FROM own o JOIN photons p ON p.frame_id = o.frame_id GROUP BY 1, 2)
SELECT d.det_id, d.pix, ROUND(COALESCE(s, 0) / (SELECT COUNT(*) FROM own o WHERE o.det_id = d.det_id), 9) AS mean FROM det2 d LEFT JOIN s ON s.det_id = d.det_id AND s.pix = d.pix WHERE mask < 1""")
def detectors_mean_powder(spark: SparkSession, sf: str) -> DataFrame:
    det, frames = _detectors(spark, sf)
    return rounded(mu.mean_powder(tb.photons(spark, sf), frames, det), "mean", digits=9)


@query(_CORNERS + ", " + _DET2 + " SELECT det_id, mode, r, ROUND(SUM(value), 6) AS u FROM views JOIN det2 USING (pix) WHERE mask < 1 GROUP BY 1, 2, 3")
def detectors_view_totals(spark: SparkSession, sf: str) -> DataFrame:
    det, _ = _detectors(spark, sf)
    both = _views(spark, sf).crossJoin(F.broadcast(spark.range(2).select(F.col("id").cast("int").alias("det_id"))))
    return rounded(mu.view_totals(both, det), "u")


@query(_CORNERS + ", " + _DET2 + """, tot AS (SELECT det_id, mode, r, SUM(value) AS u FROM views JOIN det2 USING (pix) WHERE mask < 1 GROUP BY 1, 2, 3),
h AS (SELECT o.frame_id, v.mode, v.r, SUM(cnt * LN(v.value)) AS s FROM own o JOIN photons p ON p.frame_id = o.frame_id JOIN det2 d ON d.det_id = o.det_id AND d.pix = p.pix JOIN views v ON v.pix = p.pix WHERE d.mask < 1 AND blacklist = 0 GROUP BY 1, 2, 3),
l AS (SELECT o.frame_id, t.mode, t.r, ROUND(LN(w) - u * scale + COALESCE(s, 0), 9) AS logl FROM own o JOIN tot t ON t.det_id = o.det_id JOIN rot ON rot.r = t.r LEFT JOIN h ON h.frame_id = o.frame_id AND h.mode = t.mode AND h.r = t.r WHERE blacklist = 0)
SELECT frame_id, mode, r, ROUND(logl, 5) AS logl FROM l QUALIFY ROW_NUMBER() OVER (PARTITION BY frame_id ORDER BY logl DESC, mode, r) = 1""")
def detectors_best_rotation(spark: SparkSession, sf: str) -> DataFrame:
    det, frames = _detectors(spark, sf)
    v, phi = _views(spark, sf), frames.filter("blacklist = 0").withColumn("phi", F.col("scale"))
    logl = mu.log_likelihood(tb.photons(spark, sf), phi, {0: v, 1: v}, tb.rotations(spark), det, 24)
    return rounded(mu.best_rotation(rounded(logl, "logl", digits=9)), "logl", digits=5)


@query("SELECT frame_id, file_id, blacklist, scale, cls FROM frames WHERE (file_id + 1) % 2 = 1 AND frame_id < (SELECT COUNT(*) FROM frames)")
def frames_chosen(spark: SparkSession, sf: str) -> DataFrame:
    """By a list of numbers."""
    from speckle.sources import reader

    f = tb.frames(spark, sf)
    numbers = f.filter(((F.col("file_id") + 1) % 2 == 1) & (F.col("frame_id") < f.count())).select(F.lit(0).alias("line"), F.col("frame_id").alias("value"))
    return reader.chosen(f, numbers)


@query("""c AS (SELECT frame_id, CAST(FLOOR(FLOOR(pix / 8) / 2) * 4 + FLOOR((pix % 8) / 2) AS INT) AS pix, FLOOR(val * 20) AS v FROM dense WHERE FLOOR(val * 20) > 0)
SELECT frame_id, pix, CAST(SUM(v) AS INT) AS cnt FROM c GROUP BY 1, 2""")
def frames_from_stack(spark: SparkSession, sf: str) -> DataFrame:
    from speckle.sources import reader

    x = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("frame_id"), F.transform("embedding", lambda v: F.floor(v.cast("double") * 20).cast("double")).alias("frame"))
    return reader.from_stack(x, (8, 8), 2)


@query(_COUNTS + " SELECT file_id, ROUND(AVG(fcount), 6) AS mean_count FROM counts JOIN frames USING (frame_id) GROUP BY 1")
def mean_counts(spark: SparkSession, sf: str) -> DataFrame:
    f = tb.frames(spark, sf)
    return rounded(fr.frame_counts(tb.photons(spark, sf), f, tb.detector(spark)).join(f, "frame_id").groupBy("file_id").agg(F.avg("fcount").alias("mean_count")), "mean_count")
