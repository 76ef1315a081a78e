"""Text inputs: detectors, orientations, scales, blacklists, logs, and configuration files."""

from __future__ import annotations

import configparser
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "iteration int, seconds double, rms_change double, info_rate double, log_likelihood double, num_rot int, beta double"


def _fields(lines: DataFrame) -> DataFrame:
    return lines.withColumn("n", F.split(F.trim("value"), r"\s+"))


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of one small text file."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value")).filter("trim(value) <> ''")


def detector(spark: SparkSession, path: str) -> DataFrame:
    """(pix, qx, qy, qz, corr, mask) of a detector file: a header line, then a line for each pixel."""
    x = _fields(numbered(spark, path).filter("line > 0"))
    cols = [F.col("n")[i].cast("double").alias(k) for i, k in enumerate(("qx", "qy", "qz", "corr"))]
    return x.select((F.col("line") - 1).alias("pix"), *cols, F.col("n")[4].cast("int").alias("mask"))


def detector_header(spark: SparkSession, path: str) -> dict[str, float]:
    """num_pix, distance and Ewald radius."""
    n = numbered(spark, path).filter("line = 0").first().value.split()
    return {"num_pix": int(n[0]), "distance": float(n[1]), "radius": float(n[2])}


def per_frame(spark: SparkSession, path: str, name: str, kind: str) -> DataFrame:
    """(frame_id, name) of a file with a value for each frame, as scales and blacklists are."""
    return numbered(spark, path).select(F.col("line").cast("long").alias("frame_id"), F.trim("value").cast(kind).alias(name))


def log(lines: DataFrame) -> DataFrame:
    """Rows of an iteration log, batch or stream: lines whose first word is a number."""
    x = _fields(lines).filter(F.col("value").rlike(r"^\s*[0-9]"))
    kinds = [c.split() for c in LOG_SCHEMA.split(", ")]
    return x.select(*[F.get("n", F.lit(i)).try_cast(k).alias(c) for i, (c, k) in enumerate(kinds)])


@dataclass(frozen=True)
class Params:
    """What steers a reconstruction; names as in the configuration's [emc] section."""

    recon_type: str = "3d"
    num_modes: int = 1
    num_rot: int = 0
    num_div: int = 0
    need_scaling: bool = False
    alpha: float = 0.0
    beta: float = -1.0
    beta_jump: float = 1.0
    beta_period: int = 100
    sym_icosahedral: bool = False
    friedel_sym: bool = True
    update_scale: bool = True
    #: Of a refinement: `num_div = fine coarse`.
    coarse_div: int = 0
    #: Pixels beyond the radius take no part; it grows by radius_jump every radius_period, and rotations with it.
    radius: float = 0.0
    radius_jump: float = 0.0
    radius_period: int = 100
    oversampling: float = 10.0
    #: Of axial models: the range of tilts, and their step.
    beta_range: float = 1.0
    beta_step: float = 0.1
    selection: str = ""
    output_folder: str = "data/"
    log_file: str = "EMC.log"
    files: dict = field(default_factory=dict)


def config(text: str) -> configparser.ConfigParser:
    """A configuration whose values `section:::key` stand for other values, through any number of steps."""
    c = configparser.ConfigParser(interpolation=None)
    c.read_string(text)
    for s in c.sections():
        for k in c[s]:
            seen, v = set(), c[s][k]
            while ":::" in v:
                if v in seen:
                    raise ValueError(f"{s}/{k} refers to itself")
                seen.add(v)
                a, b = v.split(":::")
                v = c[a][b]
            c[s][k] = v
    return c


def params(text: str) -> Params:
    """Params of a configuration; unknown keys that end in _file, _list or _photons are kept in files."""
    s = config(text)["emc"]
    p, kinds = {}, {f: type(getattr(Params(), f)) for f in Params.__dataclass_fields__ if f != "files"}
    divs = s.get("num_div", "0").split()
    if len(divs) > 1:
        p |= {"num_div": int(divs[0]), "coarse_div": int(divs[1])}
    for k, kind in kinds.items():
        if k in s and k not in p:
            p[k] = s.getboolean(k) if kind is bool else kind(s[k])
    if "beta_schedule" in s:
        jump, period = s["beta_schedule"].split()
        p |= {"beta_jump": float(jump), "beta_period": int(period)}
    if "radius_schedule" in s:
        jump, period = s["radius_schedule"].split()
        p |= {"radius_jump": float(jump), "radius_period": int(period)}
    p["files"] = {k: v for k, v in s.items() if k.endswith(("_file", "_list", "_photons")) and k not in kinds}
    return Params(**p)


def resumed(spark: SparkSession, path: str) -> int:
    """The iteration to go on with: one past the last of the log, 1 without a log."""
    if not os.path.exists(path):
        return 1
    last = log(spark.read.text(path)).agg(F.max("iteration")).first()[0]
    return (last or 0) + 1
