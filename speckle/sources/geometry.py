"""Detector geometry files of panels (text): what they say of each panel, and the pixels that follow from it.

Lines are `key = value` with comments after `;`. `panel/key = value` says something of a panel, and a key without a panel
holds for all panels named after it that do not say otherwise. `badNAME/...` is a region without data.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speckle.operators import detector as dt

#: Keys of panels that are read as numbers, and those that name a direction.
NUMBERS = ("min_fs", "max_fs", "min_ss", "max_ss", "corner_x", "corner_y", "coffset", "no_index")
DIRECTIONS = ("fs", "ss")
LIMITS = ("min_x", "max_x", "min_y", "max_y", "min_fs", "max_fs", "min_ss", "max_ss")


@dataclass
class Layout:
    """Panels in the order of the file, regions without data, and the keys that stand for the whole detector."""

    panels: dict[str, dict] = field(default_factory=dict)
    bad: dict[str, dict] = field(default_factory=dict)
    whole: dict[str, str] = field(default_factory=dict)

    @property
    def width(self) -> int:
        """Pixels of a row of the array that holds all panels."""
        return 1 + int(max(p["max_fs"] for p in self.panels.values()))


def direction(text: str) -> tuple[float, float]:
    """(x, y) of a sum such as `-0.99x + 0.01y`; a third component is left out."""
    out = {"x": 0.0, "y": 0.0, "z": 0.0}
    rest = re.sub(r"([+-]?[0-9]*\.?[0-9]*(?:[eE][+-]?[0-9]+)?)([xyz])", lambda m: out.__setitem__(m[2], out[m[2]] + float(m[1] if m[1] not in ("", "+", "-") else m[1] + "1")) or "", text.replace(" ", ""))
    if rest:
        raise ValueError(f"not a direction: {text}")
    return out["x"], out["y"]


def parsed(text: str) -> Layout:
    """The layout that a file's text describes."""
    out, default = Layout(), {}
    for line in text.splitlines():
        key, found, value = line.split(";")[0].partition("=")
        key, value = key.strip(), value.strip()
        if not found or not key or key.startswith(("rigid_group", "group")):
            continue
        name, _, own = key.rpartition("/")
        if name.startswith("bad"):
            out.bad.setdefault(name, {})[own] = value if own in ("panel", "is_fsss") else float(value) if own in LIMITS else value
            continue
        known = own in NUMBERS or own in DIRECTIONS
        if not name and not known:
            out.whole[own] = value
            continue
        where = out.panels.setdefault(name, dict(default)) if name else default
        if known:
            where[own] = direction(value) if own in DIRECTIONS else float(value)
    for name, p in out.panels.items():
        if missing := [k for k in ("min_fs", "max_fs", "min_ss", "max_ss", "corner_x", "corner_y") if k not in p]:
            raise ValueError(f"panel {name} lacks {', '.join(missing)}")
        p.setdefault("fs", (1.0, 0.0))
        p.setdefault("ss", (0.0, 1.0))
    if not out.panels:
        raise ValueError("no panels")
    return out


def pixels(spark: SparkSession, layout: Layout) -> DataFrame:
    """(pix, panel, fs, ss, x, y, bad): every pixel of every panel; pix is its place in the array that holds all panels.

    A region is a rectangle of x and y, or of fs and ss, in one panel or in all. Panels that are not indexed are bad as a whole.
    """
    rows = [(n, *[int(p[k]) for k in ("min_fs", "max_fs", "min_ss", "max_ss")], p["corner_x"], p["corner_y"], *p["fs"], *p["ss"], bool(p.get("no_index"))) for n, p in layout.panels.items()]
    panels = spark.createDataFrame(rows, "panel string, f0 int, f1 int, s0 int, s1 int, cx double, cy double, fx double, fy double, sx double, sy double, unused boolean")
    x = panels.withColumn("ss", F.explode(F.sequence("s0", "s1"))).withColumn("fs", F.explode(F.sequence("f0", "f1")))
    i, j = F.col("fs") - F.col("f0"), F.col("ss") - F.col("s0")
    x = x.select(
        (F.col("ss") * layout.width + F.col("fs")).alias("pix"), "panel", "fs", "ss", (F.col("cx") + i * F.col("fx") + j * F.col("sx")).alias("x"), (F.col("cy") + i * F.col("fy") + j * F.col("sy")).alias("y"), "unused"
    )
    bad = F.col("unused")
    for b in layout.bad.values():
        here = F.lit(True) if b.get("panel") is None else F.col("panel") == b["panel"]
        for axis in ("fs", "ss") if any(k.endswith("s") and k in b for k in LIMITS) else ("x", "y"):
            here = here & F.col(axis).between(b.get(f"min_{axis}", float("-inf")), b.get(f"max_{axis}", float("inf")))
        bad = bad | here
    return x.select("pix", "panel", "fs", "ss", "x", "y", bad.alias("bad"))


def detector(spark: SparkSession, text: str, distance: float, ewald_radius: float, polarization: str = "x") -> DataFrame:
    """(pix, x, y, qx, qy, qz, corr, mask) of a file's text; distance in pixels.

    Pixels beyond the circle that the detector holds whole take no part in orientation (mask 1); bad ones are 2.
    """
    x = pixels(spark, parsed(text))
    lim = F.broadcast(x.agg(F.least(F.abs(F.max("x")), F.abs(F.min("x")), F.abs(F.max("y")), F.abs(F.min("y"))).alias("most")))
    x = x.crossJoin(lim).withColumn("mask", F.when(F.col("bad"), 2).when(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) > F.col("most"), 1).otherwise(0))
    return dt.q_vectors(x.select("pix", "x", "y", "mask"), distance, ewald_radius, polarization).select("pix", "x", "y", "qx", "qy", "qz", "corr", "mask")
