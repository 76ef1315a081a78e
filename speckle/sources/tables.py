"""Frames, photons, detector and model as DataFrames over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE, DISTANCE, RADIUS, MODEL_SIZE = 8, 20.0, 3.5, 13


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def photons(spark: SparkSession, sf: str) -> DataFrame:
    """(frame_id, pix, cnt): counts of lit pixels only."""
    x = _read(spark, sf, "lineitem")
    pix = (F.col("l_partkey") % (SIDE * SIDE)).cast("int")
    return x.groupBy(F.col("l_orderkey").cast("long").alias("frame_id"), pix.alias("pix")).agg(F.count("*").cast("int").alias("cnt"))


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """(frame_id, file_id, blacklist, scale, cls), frames without photons too."""
    x = _read(spark, sf, "orders")
    return x.select(
        F.col("o_orderkey").cast("long").alias("frame_id"), (F.col("o_custkey") % 3).cast("int").alias("file_id"),
        F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("blacklist"),
        F.round(0.5 + (F.col("o_custkey") % 101) / F.lit(101.0), 6).alias("scale"), F.substring("o_orderpriority", 1, 1).alias("cls"),
    )


def detector(spark: SparkSession) -> DataFrame:
    """(pix, x, y, qx, qy, qz, corr, mask): 8 x 8 pixels."""
    from speckle.operators import detector as d

    xy = spark.range(SIDE * SIDE).select(
        F.col("id").cast("int").alias("pix"), (F.floor(F.col("id") / SIDE).cast("double") - 3.5).alias("x"), ((F.col("id") % SIDE).cast("double") - 3.5).alias("y")
    )
    return d.default_mask(d.q_vectors(xy, DISTANCE, DISTANCE, "x"), 1.0, RADIUS)


def dense_frames(spark: SparkSession, sf: str) -> DataFrame:
    """(frame_id, pix, val, mode) of the embedding vectors."""
    x = _read(spark, sf, "embeddings")
    return x.select(F.col("vec_id").cast("long").alias("frame_id"), F.col("label").cast("int").alias("mode"), F.posexplode("embedding").alias("pix", "v")).select(
        "frame_id", "pix", F.col("v").cast("double").alias("val"), "mode"
    )


def rotations(spark: SparkSession, n: int = 12) -> DataFrame:
    """(r, angle, w): equally spaced in-plane angles."""
    return spark.range(n).select("id", (F.lit(2.0) * F.pi() * F.col("id") / n).alias("angle"), (F.lit(1.0) / n).alias("w")).withColumnRenamed("id", "r")


def model(spark: SparkSession, sf: str, modes: int = 2, size: int = MODEL_SIZE) -> DataFrame:
    """(mode, vox, intens): a start model of the parts, over a floor that differs from voxel to voxel."""
    floor = F.lit(0.3) + ((F.col("vox") * 37 + F.col("mode") * 11) % 101).cast("double") / 101.0
    return models(spark, sf, 2, modes, size).select("mode", "vox", (floor + F.col("intens")).alias("intens"))


def volume(spark: SparkSession, sf: str, size: int = 9) -> DataFrame:
    """(vox, intens): a cube of the parts, over such a floor."""
    floor = F.lit(0.3) + ((F.col("vox") * 37) % 101).cast("double") / 101.0
    return models(spark, sf, 3, 1, size).select("vox", (floor + F.col("intens")).alias("intens"))


def turns(spark: SparkSession, sf: str, table: str = "supplier") -> DataFrame:
    """(r, q0..q3, w): a rotation for each row of `supplier` or `customer`."""
    key = _read(spark, sf, table).select(F.col(f"{table[0]}_{table[:4]}key").cast("long").alias("r"))
    q = [F.lit(1.0) + F.col("r") * 7 % 13, F.col("r") * 11 % 17 - 8.0, F.col("r") * 5 % 19 - 9.0, F.col("r") * 3 % 23 - 11.0]
    size = F.sqrt(sum((x * x for x in q), F.lit(0.0)))
    x = key.select("r", *[(x / size).alias(f"q{i}") for i, x in enumerate(q)], (1.0 + F.col("r") % 3).alias("w"))
    return x.crossJoin(F.broadcast(x.agg(F.sum("w").alias("all")))).withColumn("w", F.col("w") / F.col("all")).drop("all")


def tilts(spark: SparkSession, sf: str) -> DataFrame:
    """(r, phi, beta, w): an angle about the beam and a tilt for each row of `supplier`."""
    x = _read(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("r"))
    n = F.broadcast(x.agg(F.count("*").alias("n")))
    return x.crossJoin(n).select("r", (2 * F.pi() * (F.col("r") * 37 % 101) / 101).alias("phi"), (F.pi() * ((F.col("r") * 17 % 89) / F.lit(89.0) - 0.5) / 2).alias("beta"), (1.0 / F.col("n")).alias("w"))


def models(spark: SparkSession, sf: str, dims: int, modes: int = 2, size: int = MODEL_SIZE) -> DataFrame:
    """(mode, vox, intens): sizes of the parts whose numbers fall on each voxel, over a floor of 0.2."""
    x = _read(spark, sf, "part").groupBy((F.col("p_partkey") % modes).cast("long").alias("mode"), (F.floor(F.col("p_partkey") / modes) % size**dims).alias("vox")).agg(F.sum("p_size").alias("n"))
    every = spark.range(size**dims * modes).select((F.col("id") % modes).alias("mode"), F.floor(F.col("id") / modes).alias("vox"))
    return every.join(x, ["mode", "vox"], "left").select("mode", "vox", (F.lit(0.2) + F.coalesce(F.col("n") % 101, F.lit(0)) / F.lit(50.0)).alias("intens"))


def iter_log(spark: SparkSession, sf: str) -> DataFrame:
    """(iteration, frame_id, rmax): one row each, that of the least event."""
    x = _read(spark, sf, "events").select(F.dayofmonth("ts").alias("iteration"), F.col("user_id").alias("frame_id"), (F.col("event_id") % 60).cast("int").alias("rmax"), "event_id")
    return x.groupBy("iteration", "frame_id").agg(F.min_by("rmax", "event_id").alias("rmax"))


#: The same in SQL, put before every query's own.
SQL = """
WITH photons AS (SELECT CAST(l_orderkey AS BIGINT) AS frame_id, CAST(l_partkey % 64 AS INT) AS pix, CAST(COUNT(*) AS INT) AS cnt FROM lineitem GROUP BY 1, 2),
frames AS (SELECT CAST(o_orderkey AS BIGINT) AS frame_id, CAST(o_custkey % 3 AS INT) AS file_id, CAST(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS INT) AS blacklist,
  CAST(ROUND(0.5 + CAST(o_custkey % 101 AS DOUBLE) / 101.0, 6) AS DOUBLE) AS scale, SUBSTRING(o_orderpriority, 1, 1) AS cls FROM orders),
xy AS (SELECT CAST(range AS INT) AS pix, CAST(FLOOR(range / 8) AS DOUBLE) - 3.5 AS x, CAST(range % 8 AS DOUBLE) - 3.5 AS y FROM range(64)),
det AS (SELECT pix, x, y, 20.0::DOUBLE * x / SQRT(x*x + y*y + 400.0) AS qx, 20.0::DOUBLE * y / SQRT(x*x + y*y + 400.0) AS qy,
  20.0::DOUBLE * (20.0 / SQRT(x*x + y*y + 400.0) - 1.0) AS qz, 20.0::DOUBLE / POWER(SQRT(x*x + y*y + 400.0), 3) * (1.0 - x*x / (x*x + y*y + 400.0)) AS corr,
  CAST(CASE WHEN SQRT(x*x + y*y) < 1.0 THEN 2 WHEN SQRT(x*x + y*y) > 3.5 THEN 1 ELSE 0 END AS INT) AS mask FROM xy),
dense AS (SELECT CAST(vec_id AS BIGINT) AS frame_id, CAST(label AS INT) AS mode, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS pix, CAST(unnest(embedding) AS DOUBLE) AS val FROM embeddings),
rot AS (SELECT CAST(range AS BIGINT) AS r, 2.0::DOUBLE * PI() * range / 12 AS angle, 1.0::DOUBLE / 12 AS w FROM range(12)),
turns AS (SELECT r, q0 / l AS q0, q1 / l AS q1, q2 / l AS q2, q3 / l AS q3, w / SUM(w) OVER () AS w FROM (
  SELECT *, SQRT(q0 * q0 + q1 * q1 + q2 * q2 + q3 * q3) AS l FROM (SELECT CAST(s_suppkey AS BIGINT) AS r, 1.0::DOUBLE + s_suppkey * 7 % 13 AS q0, s_suppkey * 11 % 17 - 8.0::DOUBLE AS q1,
    s_suppkey * 5 % 19 - 9.0::DOUBLE AS q2, s_suppkey * 3 % 23 - 11.0::DOUBLE AS q3, 1.0::DOUBLE + s_suppkey % 3 AS w FROM supplier))),
spins AS (SELECT r, q0 / l AS q0, q1 / l AS q1, q2 / l AS q2, q3 / l AS q3, w / SUM(w) OVER () AS w FROM (
  SELECT *, SQRT(q0 * q0 + q1 * q1 + q2 * q2 + q3 * q3) AS l FROM (SELECT CAST(c_custkey AS BIGINT) AS r, 1.0::DOUBLE + c_custkey * 7 % 13 AS q0, c_custkey * 11 % 17 - 8.0::DOUBLE AS q1,
    c_custkey * 5 % 19 - 9.0::DOUBLE AS q2, c_custkey * 3 % 23 - 11.0::DOUBLE AS q3, 1.0::DOUBLE + c_custkey % 3 AS w FROM customer))),
tilts AS (SELECT CAST(s_suppkey AS BIGINT) AS r, 2.0::DOUBLE * PI() * (s_suppkey * 37 % 101) / 101 AS phi, PI() * ((s_suppkey * 17 % 89) / 89.0::DOUBLE - 0.5) / 2 AS beta, 1.0::DOUBLE / COUNT(*) OVER () AS w FROM supplier),
flats AS (SELECT m.range AS mode, v.range AS vox, 0.2::DOUBLE + COALESCE(n % 101, 0) / 50.0::DOUBLE AS intens FROM range(169) v CROSS JOIN range(2) m
  LEFT JOIN (SELECT p_partkey % 2 AS mode, p_partkey // 2 % 169 AS vox, SUM(p_size) AS n FROM part GROUP BY 1, 2) p ON p.mode = m.range AND p.vox = v.range),
solids AS (SELECT m.range AS mode, v.range AS vox, 0.2::DOUBLE + COALESCE(n % 101, 0) / 50.0::DOUBLE AS intens FROM range(2197) v CROSS JOIN range(2) m
  LEFT JOIN (SELECT p_partkey % 2 AS mode, p_partkey // 2 % 2197 AS vox, SUM(p_size) AS n FROM part GROUP BY 1, 2) p ON p.mode = m.range AND p.vox = v.range),
model AS (SELECT mode, vox, 0.3::DOUBLE + CAST((vox * 37 + mode * 11) % 101 AS DOUBLE) / 101.0 + intens AS intens FROM flats),
cube AS (SELECT range AS vox, 0.3::DOUBLE + CAST((range * 37) % 101 AS DOUBLE) / 101.0 + 0.2 + COALESCE(n % 101, 0) / 50.0::DOUBLE AS intens FROM range(729) LEFT JOIN (SELECT p_partkey % 729 AS k, SUM(p_size) AS n FROM part GROUP BY 1) ON k = range),
iter_log AS (SELECT CAST(EXTRACT(DAY FROM ts) AS INT) AS iteration, user_id AS frame_id, arg_min(CAST(event_id % 60 AS INT), event_id) AS rmax FROM events GROUP BY 1, 2)
"""
