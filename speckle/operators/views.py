"""Views of a model: interpolated slices, their merging back, rotation and symmetries of volumes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least positive double: what a pixel outside the volume, or without intensity, counts as.
TINY = 2.2250738585072014e-308


def rotation_matrix(q0: str = "q0", q1: str = "q1", q2: str = "q2", q3: str = "q3") -> list[list[Column]]:
    """Nine expressions of a unit quaternion."""
    a, b, c, d = (F.col(x) for x in (q0, q1, q2, q3))
    return [
        [1 - 2 * (c * c + d * d), 2 * (b * c - a * d), 2 * (b * d + a * c)],
        [2 * (b * c + a * d), 1 - 2 * (b * b + d * d), 2 * (c * d - a * b)],
        [2 * (b * d - a * c), 2 * (c * d + a * b), 1 - 2 * (b * b + c * c)],
    ]


def _pairs(rot: DataFrame, det: DataFrame) -> DataFrame:
    """Every rotation with every pixel that is not bad; a detector is small, one row a pixel."""
    return rot.crossJoin(F.broadcast(det.filter("mask < 2").select("pix", "qx", "qy", "qz", "corr")))


def coords2d(rot: DataFrame, det: DataFrame, size: int) -> DataFrame:
    c, s = F.cos("angle"), F.sin("angle")
    x = _pairs(rot, det)
    return x.select("r", "pix", "corr", (c * F.col("qx") - s * F.col("qy") + size // 2).alias("t0"), (s * F.col("qx") + c * F.col("qy") + size // 2).alias("t1"))


def coords_rz(rot: DataFrame, det: DataFrame, size: int) -> DataFrame:
    """In-plane angle phi about the beam after a tilt beta, looked up at (distance from the axis, height along it)."""
    c, s, cb, sb = F.cos("phi"), F.sin("phi"), F.cos("beta"), F.sin("beta")
    x = _pairs(rot, det).withColumn("u", c * F.col("qx") - s * F.col("qy")).withColumn("v", s * F.col("qx") + c * F.col("qy"))
    x = x.withColumn("z", cb * F.col("v") - sb * F.col("qz")).withColumn("w", sb * F.col("v") + cb * F.col("qz"))
    return x.select("r", "pix", "corr", F.sqrt(F.col("u") * F.col("u") + F.col("w") * F.col("w")).alias("t0"), (F.col("z") + size // 2).alias("t1"))


def coords3d(rot: DataFrame, det: DataFrame, size: int) -> DataFrame:
    m = rotation_matrix()
    t = [m[i][0] * F.col("qx") + m[i][1] * F.col("qy") + m[i][2] * F.col("qz") + size // 2 for i in range(3)]
    return _pairs(rot, det).select("r", "pix", "corr", *[e.alias(f"t{i}") for i, e in enumerate(t)])


def corners(coords: DataFrame, size: int) -> DataFrame:
    """One row for each corner (vox, f) of the cell that a coordinate lies in; coordinates outside the volume have none.

    Cells are cut towards zero, as an integer conversion does, and lie in it from 0 to size - 2.
    """
    dims = len([c for c in coords.columns if c.startswith("t") and c[1:].isdigit()])
    x = coords
    for i in range(dims):
        x = x.withColumn(f"i{i}", F.col(f"t{i}").cast("int")).filter(F.col(f"i{i}").between(0, size - 2) & (F.col(f"t{i}") >= 0))
        x = x.withColumn(f"f{i}", F.col(f"t{i}") - F.col(f"i{i}"))
    some = []
    for k in range(2**dims):
        bits = [(k >> i) & 1 for i in range(dims)]
        vox, f = F.lit(0).cast("long"), F.lit(1.0)
        for i, b in enumerate(bits):
            vox, f = vox * size + F.col(f"i{i}") + b, f * (F.col(f"f{i}") if b else 1 - F.col(f"f{i}"))
        some.append(F.struct(vox.alias("vox"), f.alias("f")))
    keep = [c for c in coords.columns if not (c.startswith("t") and c[1:].isdigit())]
    return x.select(*keep, F.inline(F.array(*some)))


def views(coords: DataFrame, model: DataFrame, size: int) -> DataFrame:
    """(mode, r, pix, value): the model at each coordinate, times corr; TINY outside and where it is not positive."""
    modes = model.select("mode").distinct()
    near = corners(coords, size).join(model, "vox").groupBy("mode", "r", "pix").agg(F.sum(F.col("f") * F.col("intens")).alias("v"))
    every = coords.select("r", "pix", "corr").crossJoin(F.broadcast(modes))
    v = F.col("v") * F.col("corr")
    return every.join(near, ["mode", "r", "pix"], "left").select("mode", "r", "pix", F.when(v > 0, v).otherwise(F.lit(TINY)).alias("value"))


def merged(coords: DataFrame, tomograms: DataFrame, size: int) -> DataFrame:
    """(mode, vox, num, weight): updated views (mode, r, pix, value) put back into the volume."""
    x = corners(coords, size).join(tomograms, ["r", "pix"])
    return x.groupBy("mode", "vox").agg(F.sum(F.col("f") * F.col("value") / F.col("corr")).alias("num"), F.sum("f").alias("weight"))


def divided(sums: DataFrame) -> DataFrame:
    """(mode, vox, intens): weighted means."""
    return sums.select("mode", "vox", F.when(F.col("weight") > 0, F.col("num") / F.col("weight")).otherwise(F.lit(0.0)).alias("intens"))


def friedel(model: DataFrame, size: int, dims: int) -> DataFrame:
    """Mean of each voxel and its mirror through the centre; planes of index 0 of an even size have no mirror and stay."""
    keys = [c for c in model.columns if c not in ("vox", "intens")]
    first = 1 - size % 2
    idx = [F.floor(F.col("vox") / size**i) % size for i in range(dims)]
    ok, mirror = F.lit(True), F.lit(0).cast("long")
    for i, e in enumerate(idx):
        ok, mirror = ok & (e >= first), mirror + (size - 1 + first - e) * size**i
    # both places from one row: a union would compute the model twice
    both = F.explode(F.array("vox", F.when(ok, mirror).otherwise(F.col("vox")).cast("long")))
    return model.select(*keys, both.alias("vox"), "intens").groupBy(*keys, "vox").agg(F.avg("intens").alias("intens"))


def rotated(volume: DataFrame, matrices: DataFrame, size: int, *keys: str) -> DataFrame:
    """(k, keys, vox, intens): volumes looked up at each rotated voxel within the inscribed sphere, for each matrix k."""
    c = size // 2
    idx = [F.floor(F.col("vox") / size ** (2 - i)) % size - c for i in range(3)]
    grid = volume.select("vox").distinct() if keys else volume.select("vox")
    grid = grid.select("vox", *[e.cast("double").alias(f"x{i}") for i, e in enumerate(idx)]).filter(F.col("x0") ** 2 + F.col("x1") ** 2 + F.col("x2") ** 2 < c * c)
    t = [F.col(f"m{i}0") * F.col("x0") + F.col(f"m{i}1") * F.col("x1") + F.col(f"m{i}2") * F.col("x2") + c for i in range(3)]
    at = grid.withColumnRenamed("vox", "to").crossJoin(F.broadcast(matrices)).select("k", "to", *[e.alias(f"t{i}") for i, e in enumerate(t)])
    return corners(at, size).join(volume, "vox").groupBy("k", *keys, "to").agg(F.sum(F.col("f") * F.col("intens")).alias("intens")).withColumnRenamed("to", "vox")


def axial(volume: DataFrame, order: int, size: int) -> DataFrame:
    """Weighted mean over `order` rotations about the last axis, of (vox, intens, weight); 0 where no weight comes to."""
    rows = []
    for k in range(order):
        a = 2 * math.pi * k / order
        rows.append((k, math.cos(a), -math.sin(a), 0.0, math.sin(a), math.cos(a), 0.0, 0.0, 0.0, 1.0))
    m = volume.sparkSession.createDataFrame(rows, "k int, " + ", ".join(f"m{i}{j} double" for i in range(3) for j in range(3)))
    # numerator and denominator as two volumes, turned at once
    both = volume.select("vox", F.inline(F.array(F.struct(F.lit(0).alias("what"), (F.col("intens") * F.col("weight")).alias("intens")), F.struct(F.lit(1).alias("what"), F.col("weight").alias("intens")))))
    turned = rotated(both, m, size, "what").groupBy("vox").agg(F.sum(F.when(F.col("what") == 0, F.col("intens"))).alias("num"), F.sum(F.when(F.col("what") == 1, F.col("intens"))).alias("den"))
    return volume.select("vox").join(turned, "vox", "left").select("vox", F.when(F.col("den") > 0, F.col("num") / F.col("den")).otherwise(0.0).alias("intens"))


def _averaged(volume: DataFrame, rows: list[tuple], size: int) -> DataFrame:
    m = volume.sparkSession.createDataFrame(rows, "k int, " + ", ".join(f"m{i}{j} double" for i in range(3) for j in range(3)))
    mean = rotated(volume, m, size).groupBy("vox").agg((F.sum("intens") / len(rows)).alias("mean"))
    return volume.join(mean, "vox", "left").select("vox", F.coalesce("mean", "intens").alias("intens"))


def icosahedral(volume: DataFrame, size: int) -> DataFrame:
    """Mean over the 60 rotations of the icosahedron."""
    from speckle.operators.orientation import icosahedral_group, matrix

    return _averaged(volume, [(k, *matrix(q).ravel().tolist()) for k, q in enumerate(icosahedral_group())], size)


def octahedral(volume: DataFrame, size: int) -> DataFrame:
    """Mean over the 48 signed permutations of the axes: voxels of equal sorted distances share one value."""
    c = size // 2
    x = [F.abs(F.floor(F.col("vox") / size**i) % size - c) for i in range(3)]
    keyed = volume.withColumn("key", F.array_sort(F.array(*x)))
    mean = keyed.groupBy("key").agg(F.avg("intens").alias("mean"))
    return keyed.join(F.broadcast(mean), "key").select("vox", F.col("mean").alias("intens"))


def oblique(volume: DataFrame, u: tuple, v: tuple, size: int) -> DataFrame:
    """(i, j, value): a plane through the centre along the directions u and v."""
    c = size // 2
    g = volume.sparkSession.range(size * size).select((F.floor(F.col("id") / size) - c).alias("i"), (F.col("id") % size - c).alias("j"))
    at = g.select("i", "j", *[(F.col("i") * float(u[k]) + F.col("j") * float(v[k]) + c).alias(f"t{k}") for k in range(3)])
    return corners(at, size).join(volume, "vox").groupBy("i", "j").agg(F.sum(F.col("f") * F.col("intens")).alias("value"))


def normal_plane(volume: DataFrame, normal: tuple[float, float, float], layer: float, size: int) -> DataFrame:
    """(i, j, value): the plane of a normal vector through `layer` of it (size // 2 is the centre), 0 outside the volume.

    Its second axis is the normal times the first axis of the volume, or times the second where these are nearly parallel;
    its first axis is the normal times its second.
    """
    c = size // 2
    n = np.array(normal, float) / np.linalg.norm(normal)
    v = np.cross(n, (1.0, 0.0, 0.0) if n[0] < 0.95 else (0.0, 1.0, 0.0))
    v /= np.linalg.norm(v)
    u = np.cross(n, v)
    grid = volume.sparkSession.range(size * size).select((F.floor(F.col("id") / size) - c).alias("i"), (F.col("id") % size - c).alias("j"))
    # noise of rounding does not move a point off the grid, and the last cell holds its end too
    t = [F.round(F.col("i") * float(u[k]) + F.col("j") * float(v[k]) + float(n[k] * (layer - c)) + c, 12) for k in range(3)]
    inside = [x.between(0, size - 1) for x in t]
    at = grid.filter(inside[0] & inside[1] & inside[2]).select("i", "j", *[F.least(x, F.lit(size - 1 - 1e-12)).alias(f"t{k}") for k, x in enumerate(t)])
    found = corners(at, size).join(volume, "vox").groupBy("i", "j").agg(F.sum(F.col("f") * F.col("intens")).alias("value"))
    return grid.join(found, ["i", "j"], "left").select("i", "j", F.coalesce("value", F.lit(0.0)).alias("value"))
