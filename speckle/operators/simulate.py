"""Atoms to densities, and simulated frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speckle.operators.views import corners

#: eV times Angstrom.
HC = 12398.419


def energy(wavelength: float) -> float:
    return HC / wavelength


def atoms(lines: DataFrame) -> DataFrame:
    """(x, y, z, element) of ATOM and HETATM records: occupancy above a half, or a half unless the second alternative."""
    at = lambda a, n: F.trim(F.substring("value", a, n))
    x = lines.filter(F.substring("value", 1, 6).isin("ATOM  ", "HETATM"))
    x = x.select(*[F.try_to_number(at(a, 8), F.lit("S9999.999")).cast("double").alias(k) for a, k in ((31, "x"), (39, "y"), (47, "z"))], at(55, 6).cast("double").alias("occ"), F.substring("value", 17, 1).alias("alt"), F.upper(at(77, 2)).alias("element"))
    return x.filter((F.col("occ") > 0.5) | ((F.col("occ") == 0.5) & (F.col("alt") != "B"))).select("x", "y", "z", "element")


def symmetry(lines: DataFrame) -> DataFrame:
    """(k, m00..m22, t0..t2) of BIOMT records, three rows to a matrix."""
    x = lines.filter(F.substring("value", 14, 5) == "BIOMT").select(F.split(F.trim(F.substring("value", 19, 60)), r"\s+").alias("n"))
    x = x.select(F.substring(F.col("n")[0], 1, 1).cast("int").alias("row"), F.col("n")[1].cast("int").alias("k"), F.slice("n", 3, 4).cast("array<double>").alias("v"))
    pick = lambda i, j: F.max(F.when(F.col("row") == i + 1, F.col("v")[j]))
    return x.groupBy("k").agg(*[pick(i, j).alias(f"m{i}{j}") for i in range(3) for j in range(3)], *[pick(i, 3).alias(f"t{i}") for i in range(3)])


def copies(atoms: DataFrame, ops: DataFrame) -> DataFrame:
    """Atoms moved by each operation; a structure has tens of those."""
    x = atoms.crossJoin(F.broadcast(ops))
    to = [F.col(f"m{i}0") * F.col("x") + F.col(f"m{i}1") * F.col("y") + F.col(f"m{i}2") * F.col("z") + F.col(f"t{i}") for i in range(3)]
    return x.select("k", *[e.alias(k) for e, k in zip(to, "xyz")], "element")


def scattering(atoms: DataFrame, table: DataFrame, ev: float) -> DataFrame:
    """Adds f0 at an energy, linear between the bracketing rows (element, energy, f0) of a table."""
    lo = table.filter(F.col("energy") <= ev).groupBy("element").agg(F.max(F.struct("energy", "f0")).alias("lo"))
    hi = table.filter(F.col("energy") >= ev).groupBy("element").agg(F.min(F.struct("energy", "f0")).alias("hi"))
    t = lo.join(hi, "element").withColumn("s", F.when(F.col("hi.energy") > F.col("lo.energy"), (F.lit(ev) - F.col("lo.energy")) / (F.col("hi.energy") - F.col("lo.energy"))).otherwise(0.0))
    return atoms.join(F.broadcast(t.select("element", (F.col("lo.f0") + F.col("s") * (F.col("hi.f0") - F.col("lo.f0"))).alias("f0"))), "element")


def density(atoms: DataFrame, voxel: float, size: int) -> DataFrame:
    """(vox, value): f0 of atoms about their middle spread over the eight voxels around each."""
    mid = atoms.agg(*[((F.min(k) + F.max(k)) / 2).alias(f"c{k}") for k in "xyz"])
    x = atoms.crossJoin(F.broadcast(mid)).select(F.col("f0").alias("weight"), *[((F.col(k) - F.col(f"c{k}")) / voxel + size // 2).alias(f"t{i}") for i, k in enumerate("xyz")])
    return corners(x, size).groupBy("vox").agg(F.sum(F.col("f") * F.col("weight")).alias("value"))


#: Square of the classical electron radius in micrometres: photons per square micrometre times intensity times this.
ELECTRON = 2.81794e-9**2


def _views(volume: np.ndarray, q: np.ndarray, corr: np.ndarray, quats: np.ndarray) -> np.ndarray:
    """(rotation, pixel) values of a cube looked up at rotated q-vectors; 0 outside."""
    from speckle.operators.orientation import matrix

    size = volume.shape[0]
    t = np.einsum("rij,pj->rpi", np.array([matrix(x) for x in quats]), q) + size // 2
    i = np.trunc(t).astype(int)
    ok = ((t >= 0) & (i >= 0) & (i <= size - 2)).all(2)
    i, out = np.clip(i, 0, size - 2), np.zeros(ok.shape)
    f = t - i
    for k in range(8):
        b = [(k >> j) & 1 for j in range(3)]
        out += np.prod([f[..., j] if b[j] else 1 - f[..., j] for j in range(3)], 0) * volume[i[..., 0] + b[0], i[..., 1] + b[1], i[..., 2] + b[2]]
    return np.where(ok, out * corr, 0)


def level(volume: np.ndarray, det: pd.DataFrame, mean_count: float | None = None, fluence: float | None = None, views: int = 5000, seed: int = 5) -> tuple[float, float]:
    """(factor, mean count): what intensities are multiplied by for a fluence, or for a mean count of frames.

    The mean over random views counts pixels that are not bad.
    """
    from speckle.operators.orientation import random_unit

    if (mean_count is None) == (fluence is None):
        raise ValueError("give either the mean count or the fluence")
    use = det[det["mask"] < 2]
    q, corr = use[["qx", "qy", "qz"]].to_numpy(), use["corr"].to_numpy()
    quats = random_unit(views, seed)
    mean = np.mean([_views(volume, q, corr, quats[i : i + 200]).sum(1).mean() for i in range(0, views, 200)])
    factor = fluence * ELECTRON if fluence is not None else mean_count / max(mean, 1e-300)
    return factor, factor * mean


def simulated(spark, n: int, volume: np.ndarray, det: pd.DataFrame, mean_count: float | None = None, seed: int = 5, gamma: bool = False, background: float = 0.0, fluence: float | None = None, orientations: np.ndarray | None = None) -> DataFrame:
    """(frame_id, pix, cnt, q0..q3, fluence): Poisson counts of views of a cube of intensities.

    Views are random, or of a list of orientations, drawn at random. A frame's random numbers depend on the seed and its
    number alone, so any partitioning makes the same frames. The cube and the detector are arrays that every worker holds.
    """
    import pyarrow as pa

    use = det[det["mask"] < 2]
    q, corr, pix = use[["qx", "qy", "qz"]].to_numpy(), use["corr"].to_numpy(), use["pix"].to_numpy().astype("i4")
    factor, _ = level(volume, det, mean_count, fluence, seed=seed)
    names = ["frame_id", "pix", "cnt", "q0", "q1", "q2", "q3", "fluence"]

    def make(batches):
        for b in batches:
            every = b.column(0).to_numpy()
            for lo in range(0, len(every), 256):
                ids = every[lo : lo + 256]
                rngs = [np.random.default_rng([seed, int(k)]) for k in ids]
                u = np.array([r.normal(size=4) if orientations is None else orientations[r.integers(len(orientations)), :4] for r in rngs])
                u /= np.linalg.norm(u, axis=1)[:, None]
                phi = np.array([r.gamma(2, 0.5) if gamma else 1.0 for r in rngs])
                mean = _views(volume, q, corr, u) * factor * phi[:, None] + background
                c = np.array([r.poisson(m) for r, m in zip(rngs, mean)])
                i, k = np.nonzero(c)
                cols = [ids[i], pix[k], c[i, k].astype("i4"), *u[i].T, phi[i]]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in cols], names)

    return spark.range(n).mapInArrow(make, "frame_id long, pix int, cnt int, q0 double, q1 double, q2 double, q3 double, fluence double")


def actual_mean_count(frames: DataFrame, n: int) -> DataFrame:
    """(mean_count): photons over frames, those without photons too."""
    return frames.agg((F.coalesce(F.sum("cnt"), F.lit(0)) / n).alias("mean_count"))


def pipeline(spark, atom_lines: DataFrame, table: DataFrame, det: pd.DataFrame, n: int, wavelength: float, voxel: float, size: int, mean_count: float, seed: int = 5, damping: float = -1.0) -> tuple[DataFrame, np.ndarray]:
    """(frames, intensities): atoms to a density, smoothed, to intensities, to frames. A density is a cube of one molecule."""
    from speckle.operators.analysis import intensities, low_passed

    small = size // 2 | 1
    d = density(scattering(atoms(atom_lines), table, energy(wavelength)), voxel, small).toPandas()
    cube = np.zeros(small**3)
    cube[d["vox"]] = d["value"]
    volume = intensities(low_passed(cube.reshape((small,) * 3), damping), size)
    return simulated(spark, n, volume, det, mean_count, seed), volume
