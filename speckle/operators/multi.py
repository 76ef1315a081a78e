"""Frame sets that several detectors took: frames carry det_id, and every table of pixels (det_id, pix, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speckle.operators import blocks as bl
from speckle.operators import maximize as mx


def _good(det: DataFrame) -> DataFrame:
    """Detectors are a few, of a row a pixel."""
    return F.broadcast(det.filter("mask < 1").select("det_id", "pix"))


def frame_counts(photons: DataFrame, frames: DataFrame, det: DataFrame) -> DataFrame:
    """(frame_id, det_id, fcount): photons in good pixels of the frame's own detector, empty frames too."""
    x = frames.select("frame_id", "det_id").join(photons, "frame_id", "left").join(_good(det).withColumn("ok", F.lit(1)), ["det_id", "pix"], "left")
    return x.groupBy("frame_id", "det_id").agg(F.coalesce(F.sum(F.when(F.col("ok") == 1, F.col("cnt"))), F.lit(0)).alias("fcount"))


def mean_counts(photons: DataFrame, frames: DataFrame, det: DataFrame) -> DataFrame:
    """(det_id, mean_count)."""
    return frame_counts(photons, frames, det).groupBy("det_id").agg(F.avg("fcount").alias("mean_count"))


def mean_powder(photons: DataFrame, frames: DataFrame, det: DataFrame) -> DataFrame:
    """(det_id, pix, mean): mean counts of good pixels over all frames of a detector."""
    n = frames.groupBy("det_id").agg(F.count("*").alias("n"))
    sums = photons.join(frames.select("frame_id", "det_id"), "frame_id").groupBy("det_id", "pix").agg(F.sum("cnt").alias("s"))
    x = det.filter("mask < 1").select("det_id", "pix").join(F.broadcast(n), "det_id").join(sums, ["det_id", "pix"], "left")
    return x.select("det_id", "pix", (F.coalesce("s", F.lit(0)) / F.col("n")).alias("mean"))


def view_totals(views: DataFrame, det: DataFrame) -> DataFrame:
    """(det_id, mode, r, u) of views (det_id, mode, r, pix, value)."""
    return views.join(_good(det), ["det_id", "pix"]).groupBy("det_id", "mode", "r").agg(F.sum("value").alias("u"))


def log_likelihood(photons: DataFrame, frames: DataFrame, views: dict[int, DataFrame], rot: DataFrame, det: DataFrame, n_views: int) -> DataFrame:
    """(frame_id, mode, r, logl): each frame with the views of its own detector, from views[det_id]."""
    out = None
    for k, v in sorted(views.items()):
        own = frames.filter(F.col("det_id") == k).select("frame_id", "phi")
        x = bl.likelihoods(photons.join(own.select("frame_id"), "frame_id", "left_semi"), own, v, rot, det.filter(F.col("det_id") == k), own.count(), n_views)
        out = x if out is None else out.union(x)
    return out


def best_rotation(logl: DataFrame) -> DataFrame:
    return mx.best_rotation(logl)
