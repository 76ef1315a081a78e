"""Volumes compared, averaged and built: best rotations, fibres, crystals, spots."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speckle.operators import views as vw
from speckle.operators.views import corners, rotated


def rotation_correlation(a: DataFrame, b: DataFrame, matrices: DataFrame, size: int) -> DataFrame:
    """(k, cc): correlation of volume a with volume b under each rotation."""
    x = rotated(b, matrices, size).select("k", "vox", F.col("intens").alias("b")).join(a.select("vox", F.col("intens").alias("a")), "vox")
    return x.groupBy("k").agg(F.corr("a", "b").alias("cc"))


def best_alignment(spark, a: DataFrame, b: DataFrame, coarse: np.ndarray, size: int, rounds=((0.04, 30), (0.01, 40)), seed: int = 1) -> tuple[np.ndarray, float]:
    """Quaternion and correlation of the best rotation: all coarse ones, then random ones ever nearer to the best."""
    from speckle.operators.orientation import matrix

    rng, best = np.random.default_rng(seed), (None, -2.0)
    trial = coarse[:, :4]
    for width, n in ((None, 0), *rounds):
        if width is not None:
            trial = best[0] + rng.normal(0, width, (n, 4))
            trial = np.concatenate([best[0][None], trial / np.linalg.norm(trial, axis=1)[:, None]])
        rows = [(k, *map(float, matrix(q).ravel())) for k, q in enumerate(trial)]
        m = spark.createDataFrame(rows, "k int, " + ", ".join(f"m{i}{j} double" for i in range(3) for j in range(3)))
        top = rotation_correlation(a, b, m, size).orderBy(F.desc("cc"), "k").first()
        best = (np.asarray(trial[top.k]), float(top.cc))
    return best


def fibre_turns(spark, n: int) -> DataFrame:
    """(r, q0..q3): n turns of a plane about the axis of a fibre, which lies in it."""
    a = F.col("id") * (2 * np.pi / n)
    c, sn = F.cos(a), F.sin(a)
    q0 = F.when(c > 0, F.sqrt(1 + c) / 2).otherwise(sn / F.sqrt(F.greatest(1 - c, F.lit(1e-300))) / 2)
    q1 = F.when(c > 0, sn / F.sqrt(F.greatest(1 + c, F.lit(1e-300))) / 2).otherwise(F.sqrt(1 - c) / 2)
    return spark.range(n).select(F.col("id").alias("r"), q0.alias("q0"), q1.alias("q1"), q0.alias("q2"), q1.alias("q3"))


def fibre_average(volume: DataFrame, size: int, sigma: float, angles: int = 720, steps: int = 101, edge: float = 20.0) -> DataFrame:
    """(vox, value): what a fibre of the volume shows: a central plane averaged over `angles` turns, then blurred in itself.

    The blur adds the plane turned by angles up to 4 sigma (degrees) either way, `steps` of them each, with Gaussian weights
    that are not divided out, inside a circle `edge` short of the half size.
    """
    spark, c = volume.sparkSession, size // 2
    flat = spark.range(size * size).select(F.col("id").alias("pix"), (F.floor(F.col("id") / size) - c).cast("double").alias("qx"), (F.col("id") % size - c).cast("double").alias("qy"), F.lit(0.0).alias("qz"), F.lit(1.0).alias("corr"), F.lit(0).alias("mask"))
    seen = vw.corners(vw.coords3d(fibre_turns(spark, angles), flat, size), size).join(volume.select("vox", "intens"), "vox")
    plane = seen.groupBy(F.col("pix").alias("vox")).agg((F.sum(F.col("f") * F.col("intens")) / angles).alias("intens"))
    rad = sigma * np.pi / 180
    turns = spark.range(2 * steps).select(((F.col("id") - steps) * (4 * rad / steps)).alias("a")).withColumn("w", F.exp(-F.col("a") * F.col("a") / (2 * rad * rad)))
    x = flat.select("pix", "qx", "qy").crossJoin(F.broadcast(turns))
    t0, t1 = F.cos("a") * F.col("qx") - F.sin("a") * F.col("qy"), F.sin("a") * F.col("qx") + F.cos("a") * F.col("qy")
    x = x.select("pix", "w", t0.alias("t0"), t1.alias("t1")).filter(F.sqrt(F.col("t0") * F.col("t0") + F.col("t1") * F.col("t1")) <= c - edge)
    at = vw.corners(x.withColumn("t0", F.col("t0") + c).withColumn("t1", F.col("t1") + c), size)
    out = at.join(F.broadcast(plane), "vox").groupBy("pix").agg(F.sum(F.col("w") * F.col("f") * F.col("intens")).alias("value"))
    return flat.select("pix").join(out, "pix", "left").select(F.col("pix").alias("vox"), F.coalesce("value", F.lit(0.0)).alias("value"))


def blurred(profile: DataFrame, sigma: float, reach: int) -> DataFrame:
    """(rbin, abin, value) smoothed along the angle by a Gaussian of `sigma` bins, cut at `reach`; a ring is closed."""
    n = profile.agg((F.max("abin") + 1).alias("n"))
    steps = F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("d")
    x = profile.crossJoin(F.broadcast(n)).select("rbin", "abin", "value", "n", steps)
    w = F.exp(-F.col("d") * F.col("d") / (2 * sigma * sigma))
    x = x.select("rbin", F.pmod(F.col("abin") + F.col("d"), "n").alias("abin"), w.alias("w"), (w * F.col("value")).alias("v"))
    return x.groupBy("rbin", "abin").agg((F.sum("v") / F.sum("w")).alias("value"))


def allowed(h: str = "h", k: str = "k", m: str = "l"):
    """Reflections that the screw axes and glides of Pbca leave: 0kl with k even, h0l with l even, hk0 with h even, axes even."""
    even = lambda x: F.col(x) % 2 == 0
    zero = lambda x: F.col(x) == 0
    return (~zero(h) | even(k)) & (~zero(k) | even(m)) & (~zero(m) | even(h)) & (~(zero(k) & zero(m)) | even(h)) & (~(zero(h) & zero(m)) | even(k)) & (~(zero(h) & zero(k)) | even(m))


def lattice(spark, n: int, extinct: bool = True) -> DataFrame:
    """(h, k, l) of a cube of reflections."""
    r = spark.range(-n, n + 1)
    x = r.select(F.col("id").alias("h")).crossJoin(F.broadcast(r.select(F.col("id").alias("k")))).crossJoin(F.broadcast(r.select(F.col("id").alias("l"))))
    return x.filter(allowed()) if extinct else x


def crystal(points: DataFrame, spacing: float, size: int, sigma: float, reach: int = 1) -> DataFrame:
    """(vox, intens): Gaussian spots at lattice points (h, k, l, f), each spread over the voxels about its own."""
    c, d = size // 2, F.sequence(F.lit(-reach), F.lit(reach))
    at = points.select("f", *[(F.col(x) * spacing + c).alias(f"p{i}") for i, x in enumerate(("h", "k", "l"))])
    for i in range(3):
        at = at.withColumn(f"d{i}", F.explode(d)).withColumn(f"v{i}", F.rint(f"p{i}") + F.col(f"d{i}"))
    inside = F.lit(True)
    r2, vox = F.lit(0.0), F.lit(0).cast("long")
    for i in range(3):
        inside = inside & F.col(f"v{i}").between(0, size - 1)
        r2, vox = r2 + (F.col(f"v{i}") - F.col(f"p{i}")) ** 2, vox * size + F.col(f"v{i}").cast("long")
    return at.filter(inside).groupBy(vox.alias("vox")).agg(F.sum(F.col("f") * F.exp(-r2 / (2 * sigma * sigma))).alias("intens"))


def spots(volume: DataFrame, points: DataFrame, spacing: float, size: int, radius: float) -> DataFrame:
    """(h, k, l, total): intensity within `radius` of each lattice point; a voxel counts for the first of its points.

    Voxels find their points by cell, the nearest lattice place, so this is an equi-join.
    """
    c = size // 2
    x = [(F.floor(F.col("vox") / size ** (2 - i)) % size - c) / spacing for i in range(3)]
    v = volume.select("vox", "intens", *[e.alias(f"x{i}") for i, e in enumerate(x)], *[F.rint(e).cast("long").alias(n) for e, n in zip(x, "hkl")])
    near = sum(((F.col(f"x{i}") - F.col(n)) * spacing) ** 2 for i, n in enumerate("hkl"))
    return v.filter(near < radius * radius).join(points.select("h", "k", "l"), ["h", "k", "l"]).groupBy("h", "k", "l").agg(F.sum("intens").alias("total"))


def sphere_spots(volume: DataFrame, points: DataFrame, spacing: float, size: int, radius: int) -> DataFrame:
    """(h, k, l, total): each spot's sum over the voxels nearer than `radius` to its middle voxel, where that is above 0.

    Spots too near to an edge are left out. Spheres may overlap: a voxel counts for the first spot in the order of
    (h, k, l). A spot looks up its own voxels, so this is an equi-join; one more aggregation finds each voxel's owner.
    """
    c, step = size // 2, F.sequence(F.lit(-radius), F.lit(radius))
    at = points.select("h", "k", "l", *[(F.col(x) * spacing + c).alias(f"t{i}") for i, x in enumerate("hkl")])
    for i in range(3):
        at = at.filter((F.col(f"t{i}") - radius >= 0) & (F.col(f"t{i}") + radius < size))
    vox, r2 = F.lit(0).cast("long"), F.lit(0)
    for i in range(3):
        # the box from the cut place, the distance from the rounded one
        at = at.withColumn(f"d{i}", F.explode(step)).withColumn(f"v{i}", F.floor(f"t{i}").cast("int") + F.col(f"d{i}")).filter(F.col(f"d{i}") < radius)
        d = F.col(f"v{i}") - F.floor(F.col(f"t{i}") + 0.5).cast("int")
        vox, r2 = vox * size + F.col(f"v{i}"), r2 + d * d
    cells = at.filter(r2 < radius * radius).select("h", "k", "l", vox.alias("vox"))
    own = cells.groupBy("vox").agg(F.min(F.struct("h", "k", "l")).alias("s")).select("vox", "s.*")
    return own.join(volume.select("vox", "intens"), "vox").groupBy("h", "k", "l").agg(F.sum("intens").alias("total")).filter("total > 0")


def minimum_filtered(image: DataFrame, size: int, reach: int) -> DataFrame:
    """(vox, value): a 2D image less the least value within `reach` pixels."""
    x = image.select(F.floor(F.col("vox") / size).alias("x"), (F.col("vox") % size).alias("y"), "intens")
    step = F.sequence(F.lit(-reach), F.lit(reach))
    spread = x.select("*", F.explode(step).alias("dx")).select("*", F.explode(step).alias("dy")).select((F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), F.col("intens").alias("v"))
    low = spread.groupBy("x", "y").agg(F.min("v").alias("low"))
    return x.join(low, ["x", "y"]).select((F.col("x") * size + F.col("y")).alias("vox"), (F.col("intens") - F.col("low")).alias("value"))


def resampled(volume: DataFrame, size: int, to: int) -> DataFrame:
    """(vox, intens): a cube on a grid of another size, trilinear."""
    s = (size - 1 - 1e-9) / (to - 1)
    at = volume.sparkSession.range(to**3).select(F.col("id").alias("to"), *[((F.floor(F.col("id") / to ** (2 - i)) % to) * s).alias(f"t{i}") for i in range(3)])
    return corners(at, size).join(volume, "vox").groupBy("to").agg(F.sum(F.col("f") * F.col("intens")).alias("intens")).withColumnRenamed("to", "vox")
