"""Detector geometry: q-vectors, corrections, masks, assembly coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def q_vectors(xy: DataFrame, distance: float, radius: float, polarization: str = "x") -> DataFrame:
    """Adds qx, qy, qz on the Ewald sphere of `radius` and corr: solid angle times polarization (x, y or none)."""
    r2 = F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.lit(distance * distance)
    fac = F.sqrt(r2)
    polar = {"x": 1.0 - F.col("x") * F.col("x") / r2, "y": 1.0 - F.col("y") * F.col("y") / r2, "none": F.lit(1.0) - F.lit(0.0)}[polarization]
    return (
        xy.withColumn("qx", F.lit(radius) * F.col("x") / fac).withColumn("qy", F.lit(radius) * F.col("y") / fac)
        .withColumn("qz", F.lit(radius) * (F.lit(distance) / fac - 1.0)).withColumn("corr", F.lit(distance) / F.pow(fac, F.lit(3)) * polar)
    )


def default_mask(det: DataFrame, stop: float, edge: float) -> DataFrame:
    """mask: 2 inside the beam stop, 1 beyond the edge, else 0."""
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    return det.withColumn("mask", F.when(r < stop, 2).when(r > edge, 1).otherwise(0))


def norm() -> Column:
    return F.sqrt(F.col("qx") * F.col("qx") + F.col("qy") * F.col("qy") + F.col("qz") * F.col("qz"))


def remask(det: DataFrame, radius: float) -> DataFrame:
    """Good pixels beyond `radius` take no part in orientation."""
    return det.withColumn("mask", F.when((F.col("mask") == 0) & (norm() > radius), 1).otherwise(F.col("mask")))


def qmax(det: DataFrame) -> DataFrame:
    """(qmax, size, center): largest q of pixels that are not bad, and the model that holds it."""
    q = det.filter("mask < 2").agg(F.max(norm()).alias("qmax"))
    return q.withColumn("size", (2 * F.ceil("qmax") + 3).cast("int")).withColumn("center", F.floor(F.col("size") / 2).cast("int"))


def normalised_corr(det: DataFrame) -> DataFrame:
    """corr over its mean."""
    return det.withColumn("corr", F.col("corr") / F.avg("corr").over(Window.partitionBy()))


def flat(det: DataFrame, distance: float, radius: float) -> DataFrame:
    """qx and qy as seen on a flat detector, qz = 0: for two-dimensional models."""
    sign = F.when(F.avg("qz").over(Window.partitionBy()) > 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    fac = F.lit(distance) / (F.lit(radius) + sign * F.col("qz"))
    return det.withColumn("_f", fac).withColumn("qx", F.col("qx") * F.col("_f")).withColumn("qy", F.col("qy") * F.col("_f")).withColumn("qz", F.lit(0.0)).drop("_f")


def assembled(det: DataFrame, distance: float, radius: float) -> DataFrame:
    """(pix, ix, iy): integer coordinates of the assembled image, from the least of each."""
    f = flat(det, distance, radius)
    every = Window.partitionBy()
    return f.select("pix", F.rint(F.col("qx") - F.min("qx").over(every)).cast("int").alias("ix"), F.rint(F.col("qy") - F.min("qy").over(every)).cast("int").alias("iy"), "mask")


def unique_detectors(files: DataFrame) -> DataFrame:
    """(file_id, detector, det_id): the detectors of a file list, each numbered once."""
    return files.withColumn("det_id", F.dense_rank().over(Window.orderBy("detector")) - 1)


def experiment(wavelength: float, distance: float, width: float, pixel: float, stop: float) -> dict[str, float]:
    """Resolution scalars of a square detector of `width` pixels of `pixel` mm at `distance` mm."""
    import math

    half = width * pixel / 2
    theta = math.atan(half / distance)
    q_max = 2 * math.sin(theta / 2) / wavelength
    return {"q_max": q_max, "q_sep": 2 * math.sin(math.atan(pixel / distance) / 2) / wavelength, "half_p_res": 0.5 / q_max, "fov": wavelength / (2 * math.sin(math.atan(pixel / distance) / 2)), "stop": stop}
