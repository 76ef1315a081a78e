"""Frame sets of several files and detectors, frames by number, and what comes as stacks, volumes or per-pixel files."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speckle.operators import frames as fr
from speckle.sources import emc, texts


def file_list(spark: SparkSession, path: str) -> list[tuple[str, str | None]]:
    """(file, dataset) of a list's lines: a file of sparse frames, or one of dense frames and the name of its dataset.

    Files that are not absolute lie beside the list. A list is small.
    """
    out = []
    for r in texts.numbered(spark, path).orderBy("line").collect():
        words = r.value.split()
        file = words[0] if os.path.isabs(words[0]) else os.path.join(os.path.dirname(path), words[0])
        out.append((file, words[1] if len(words) > 1 else None))
    return out


def frame_set(spark: SparkSession, files: list[tuple[str, str | None]], det: DataFrame, mapping: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(photons, frames) of files one after the other: (frame_id, pix, cnt) and (frame_id, file_id, local, det_id).

    Global numbers go on from file to file. Sparse and dense files may be mixed; dense frames lose what is not positive
    and the bad pixels of their detector, det (det_id, pix, mask). mapping: the detector of each file, 0 if not given.
    """
    spark.dataSource.register(emc.EmcSource)
    photons = frames = None
    first = 0
    for k, (path, dataset) in enumerate(files):
        d = mapping[k] if mapping else 0
        own = det.filter(F.col("det_id") == d)
        if emc.is_hdf5(path):
            from speckle.sources import hdf5

            x, n = (hdf5.dense(spark, path, dataset), hdf5.length(path, dataset)) if dataset else (hdf5.frames(spark, path), hdf5.length(path, "place_ones"))
        else:
            x, n = spark.read.format("emc").load(path), emc.header(path)[0]
        if "frame" in x.columns:
            p = fr.sparsified(x.select("frame_id", F.posexplode("frame").alias("pix", "val")), own)
        else:
            p = fr.from_ones_multi(x)
        p = p.select((F.col("frame_id") + first).alias("frame_id"), "pix", "cnt")
        f = spark.range(n).select((F.col("id") + first).alias("frame_id"), F.lit(k).alias("file_id"), F.col("id").alias("local"), F.lit(d).alias("det_id"))
        photons, frames, first = (p if photons is None else photons.union(p)), (f if frames is None else frames.union(f)), first + n
    return photons, frames


def frame(photons: DataFrame, frames: DataFrame, number: int, places: DataFrame, raw: bool = False, sparse: bool = False, zoomed: bool = False, sym: bool = False) -> DataFrame:
    """The frame of a global number: assembled (ix, iy, value); raw (pix, cnt) of every pixel; sparse its layout.

    places: (det_id, pix, ix, iy, mask). The filter by number reaches the scan where the source can use it.
    """
    own = photons.filter(F.col("frame_id") == number)
    if sparse:
        return fr.ones_multi(own)
    here = places.join(F.broadcast(frames.filter(F.col("frame_id") == number).select("det_id")), "det_id", "left_semi")
    if raw:
        return here.select("pix").join(own.select("pix", "cnt"), "pix", "left").select("pix", F.coalesce("cnt", F.lit(0)).alias("cnt"))
    image = fr.assembled_frame(own, here)
    if sym:
        image = fr.centro_symmetric(image)
    if zoomed:
        from speckle.operators.known import zoom

        image = zoom(image, 1)
    return image


def chosen(frames: DataFrame, selection: DataFrame) -> DataFrame:
    """Frames of a selection (line, value): a 0 or 1 for each frame, or else the numbers of the frames.

    It is a vector where it has a row for each frame and no value above 1, as numbers are told apart by that.
    """
    n = frames.count()
    top = selection.agg(F.count("*").alias("n"), F.max("value").alias("top")).first()
    if top.n == n and (top.top or 0) < 2:
        keep = selection.filter("value = 1").select(F.col("line").cast("long").alias("frame_id"))
    else:
        keep = selection.select(F.col("value").cast("long").alias("frame_id")).distinct()
    return frames.join(keep, "frame_id", "left_semi")


def from_stack(stack: DataFrame, shape: tuple[int, int], binning: int = 1, fraction: float = 1.0, parts: int = 1) -> DataFrame:
    """(frame_id, pix, cnt) of a stack of images (frame_id, frame array): negatives are 0, pixels are added up in squares
    of `binning`, photons kept with probability `fraction`, and each frame dealt to `parts` frames, that many numbers apart."""
    x = stack.select("frame_id", F.posexplode("frame").alias("at", "val")).filter("val > 0")
    row, col = F.floor(F.col("at") / shape[1] / binning), F.floor(F.col("at") % shape[1] / binning)
    pix = (row * (shape[1] // binning) + col).cast("int")
    x = x.groupBy("frame_id", pix.alias("pix")).agg(F.sum("val").cast("int").alias("cnt")).filter("cnt > 0")
    x = fr.thinned(x, fraction) if fraction < 1 else x
    if parts > 1:
        x = fr.partitioned(x, parts).select((F.col("frame_id") * parts + F.col("part")).alias("frame_id"), "pix", "cnt")
    return x


def background(spark: SparkSession, path: str, det: DataFrame) -> DataFrame:
    """det with the background of a file of doubles, one for each pixel, text or raw; 0 where it has none."""
    if path.endswith((".bin", ".raw")):
        b = volume(spark, path).select(F.col("vox").cast("int").alias("pix"), F.col("intens").alias("background"))
    else:
        b = texts.numbered(spark, path).select(F.col("line").cast("int").alias("pix"), F.trim("value").cast("double").alias("background"))
    return det.join(F.broadcast(b), "pix", "left").withColumn("background", F.coalesce("background", F.lit(0.0)))


def volume(spark: SparkSession, path: str) -> DataFrame:
    """(vox, intens) of a raw file of doubles, as densities and stacks of slices are; read in Arrow batches."""
    import pyarrow as pa

    def read(batches):
        for b in batches:
            for data in b.column("content"):
                x = np.frombuffer(data.as_py(), "<f8")
                for lo in range(0, len(x), 1 << 16):
                    part = x[lo : lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(part))), pa.array(part)], ["vox", "intens"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, "vox long, intens double")


def detector_from_pixels(pixels: DataFrame, distance: float, radius: float, stop: float, edge: float, polarization: str = "x") -> DataFrame:
    """(pix, qx, qy, qz, corr, mask) of pixel places (pix, x, y) in units of `distance`, as other formats' geometries give them; a column bad marks bad ones."""
    from speckle.operators import detector as d

    x = d.default_mask(d.q_vectors(pixels, distance, radius, polarization), stop, edge)
    if "bad" in pixels.columns:
        x = x.withColumn("mask", F.when(F.col("bad"), 2).otherwise(F.col("mask")))
    return x.select("pix", "qx", "qy", "qz", "corr", "mask")
