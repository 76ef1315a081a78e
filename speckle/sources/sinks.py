"""What a reconstruction leaves behind: tables of each iteration, its log, and files other tools read.

Files of detectors, orientations, densities and powders are small, a row a pixel, rotation or voxel.
"""

from __future__ import annotations

import dataclasses
import os

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG_HEAD = "Iter\ttime\trms_change\tinfo_rate\tlog-likelihood\tnum_rot\tbeta\n"


def iteration(out: str, k: int, **tables: DataFrame) -> None:
    """Each table to its own folder, in the partition of the iteration; written anew where it was there before."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}/iteration={k}")


def params(spark, out: str, k: int, p, **more) -> None:
    """The parameters of an iteration as (name, value) texts."""
    rows = [(a, str(v)) for a, v in (dataclasses.asdict(p) | more).items()]
    iteration(out, k, params=spark.createDataFrame(rows, "name string, value string").coalesce(1))


def log_head(path: str, **facts) -> None:
    """A new log: a line for each fact, then the names of the columns."""
    with open(path, "w") as f:
        f.write("".join(f"{k} = {v}\n" for k, v in facts.items()) + "\n" + LOG_HEAD)


def log_row(path: str, iteration: int, seconds: float, rms_change: float, info_rate: float, log_likelihood: float, num_rot: int, beta: float) -> None:
    with open(path, "a") as f:
        f.write(f"{iteration}\t{seconds:4.2f}\t{rms_change:1.4e}\t{info_rate:f}\t{log_likelihood:.6e}\t{num_rot:<7d}\t{beta:f}\n")


def backup(path: str) -> str | None:
    """Moves an existing log aside under the first free number; returns its new name."""
    if not os.path.exists(path):
        return None
    k = 1
    while os.path.exists(f"{path}.{k}"):
        k += 1
    os.rename(path, f"{path}.{k}")
    return f"{path}.{k}"


def detector(det: DataFrame, path: str, distance: float, radius: float) -> None:
    """A detector file as texts.detector reads it: a header, then qx qy qz corr mask for each pixel."""
    rows = det.select("pix", "qx", "qy", "qz", "corr", "mask").orderBy("pix").toPandas()
    with open(path, "w") as f:
        f.write(f"{len(rows)} {distance!r} {radius!r}\n")
        f.writelines(f"{r.qx!r} {r.qy!r} {r.qz!r} {r.corr!r} {int(r.mask)}\n" for r in rows.itertuples())


def quaternions(rot: DataFrame, path: str) -> None:
    """An orientation file: their number, then q0 q1 q2 q3 w of each."""
    rows = rot.select("r", "q0", "q1", "q2", "q3", "w").orderBy("r").toPandas()
    with open(path, "w") as f:
        f.write(f"{len(rows)}\n")
        f.writelines(" ".join(repr(float(x)) for x in r[2:]) + "\n" for r in rows.itertuples())


def density(volume: DataFrame, path: str, size: int, dims: int = 3) -> None:
    """A raw file of doubles in C order; voxels that the table lacks are 0."""
    rows = volume.toPandas()
    x = np.zeros(size**dims)
    x[rows["vox"].to_numpy()] = rows.iloc[:, rows.columns.get_loc("intens")].to_numpy()
    x.astype("<f8").tofile(path)


def powder(table: DataFrame, path: str) -> None:
    """A powder (pix, total) as a raw file of doubles in the order of pixels."""
    table.select("pix", "total").orderBy("pix").toPandas()["total"].to_numpy().astype("<f8").tofile(path)


def appended(rows: DataFrame, path: str, pixels: int) -> int:
    """Sparse frames, checked, added to a Parquet set; returns how many. Frames that do not fit raise ValueError."""
    from speckle.operators.known import valid_frames

    bad = valid_frames(rows, pixels).agg(F.count("*").alias("n"), F.min(F.struct("frame_id", "problem")).alias("first")).first()
    if bad.n:
        raise ValueError(f"{bad.n} frames do not fit, the first {bad.first.frame_id}: {bad.first.problem}")
    rows.write.mode("append").parquet(path)
    return rows.count()
