"""Frame statistics, selections and reshaping of sparse photon tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def good(det: DataFrame, below: int = 1) -> DataFrame:
    """Pixels with mask below: 1 for orientation and counts, 2 for merging. A detector is small: one row a pixel."""
    return F.broadcast(det.filter(F.col("mask") < below).select("pix"))


def powder(photons: DataFrame, det: DataFrame) -> DataFrame:
    """(pix, total): counts of each pixel over all frames, unlit pixels too."""
    sums = photons.groupBy("pix").agg(F.sum("cnt").alias("total"))
    return det.select("pix").join(F.broadcast(sums), "pix", "left").select("pix", F.coalesce("total", F.lit(0)).alias("total"))


def mean_powder(photons: DataFrame, frames: DataFrame, det: DataFrame) -> DataFrame:
    """(pix, mean): mean count of good pixels per frame, blacklisted and empty frames included."""
    n = frames.agg(F.count("*").alias("n"))
    return powder(photons.join(good(det), "pix"), det.filter("mask < 1")).crossJoin(F.broadcast(n)).select("pix", (F.col("total") / F.col("n")).alias("mean"))


def frame_counts(photons: DataFrame, frames: DataFrame, det: DataFrame) -> DataFrame:
    """(frame_id, fcount): photons in good pixels, empty frames too."""
    sums = photons.join(good(det), "pix").groupBy("frame_id").agg(F.sum("cnt").alias("fcount"))
    return frames.select("frame_id").join(sums, "frame_id", "left").select("frame_id", F.coalesce("fcount", F.lit(0)).alias("fcount"))


def mean_count(photons: DataFrame, frames: DataFrame, det: DataFrame) -> DataFrame:
    return frame_counts(photons, frames, det).agg(F.avg("fcount").alias("mean_count"))


def log_factorial(n: Column) -> Column:
    return F.when(n < 2, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda a, x: a + F.ln(x.cast("double"))))


def sum_fact(photons: DataFrame, det: DataFrame) -> DataFrame:
    """(frame_id, sum_fact): sum of ln(count!) in good pixels; frames without a count above 1 have no row."""
    return photons.filter("cnt > 1").join(good(det), "pix").groupBy("frame_id").agg(F.sum(log_factorial(F.col("cnt"))).alias("sum_fact"))


def ones_multi(photons: DataFrame) -> DataFrame:
    """(frame_id, place_ones, place_multi, count_multi): the sparse frame layout."""
    ones = F.sort_array(F.collect_list(F.when(F.col("cnt") == 1, F.col("pix"))))
    multi = F.sort_array(F.collect_list(F.when(F.col("cnt") > 1, F.struct("pix", "cnt"))))
    return photons.groupBy("frame_id").agg(ones.alias("place_ones"), multi.alias("m")).select("frame_id", "place_ones", F.col("m.pix").alias("place_multi"), F.col("m.cnt").alias("count_multi"))


def from_ones_multi(frames: DataFrame) -> DataFrame:
    """The long table of a sparse frame layout."""
    ones = frames.select("frame_id", F.explode("place_ones").alias("pix"), F.lit(1).alias("cnt"))
    multi = frames.select("frame_id", F.inline(F.arrays_zip("place_multi", "count_multi"))).toDF("frame_id", "pix", "cnt")
    return ones.union(multi)


def sparsified(dense: DataFrame, det: DataFrame) -> DataFrame:
    """(frame_id, pix, cnt) of dense integer frames: positive values of pixels that are not bad."""
    return dense.filter("val > 0").join(good(det, 2), "pix").select("frame_id", "pix", F.col("val").cast("int").alias("cnt")).filter("cnt > 0")


def offsets(frames: DataFrame) -> DataFrame:
    """(file_id, n, first): frames of each file and the global number of its first."""
    n = frames.groupBy("file_id").agg(F.count("*").alias("n"))
    return n.withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("file_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def located(numbers: DataFrame, frames: DataFrame) -> DataFrame:
    """(num, file_id, local): where global frame numbers lie; a file list is small."""
    o = F.broadcast(offsets(frames))
    return numbers.join(o, (F.col("num") >= F.col("first")) & (F.col("num") < F.col("first") + F.col("n"))).select("num", "file_id", (F.col("num") - F.col("first")).alias("local"))


def parity(frames: DataFrame, keep: int) -> DataFrame:
    """Of the frames that are not blacklisted every second: those of even places for 0, of odd ones for 1.

    Places are counted within ranges of frame ids first, so no task orders all frames.
    """
    x = frames.filter("blacklist = 0").select("frame_id").withColumn("slab", F.floor(F.col("frame_id") / 65536))
    n = x.groupBy("slab").agg(F.count("*").alias("n"))
    base = n.select("slab", F.coalesce(F.sum("n").over(Window.orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    place = F.col("base") + F.row_number().over(Window.partitionBy("slab").orderBy("frame_id")) - 1
    return x.join(F.broadcast(base), "slab").withColumn("place", place).filter(F.col("place") % 2 == keep).select("frame_id", "place")


def with_scale(frames: DataFrame, scales: DataFrame) -> DataFrame:
    """(frame_id, scale): the given scales, 1 where there is none, -1 for blacklisted frames."""
    x = frames.select("frame_id", "blacklist").join(scales, "frame_id", "left")
    return x.select("frame_id", F.when(F.col("blacklist") == 1, -1.0).otherwise(F.coalesce("scale", F.lit(1.0))).alias("scale"))


def class_counts(frames: DataFrame) -> DataFrame:
    return frames.groupBy("cls").agg(F.count("*").alias("n"))


def class_powder(photons: DataFrame, frames: DataFrame) -> DataFrame:
    """(cls, pix, total)."""
    return photons.join(frames.select("frame_id", "cls"), "frame_id").groupBy("cls", "pix").agg(F.sum("cnt").alias("total"))


def without_cosmics(photons: DataFrame, mean: DataFrame, least: float = 0.0224) -> DataFrame:
    """Counts above 1 in pixels of a mean below `least` are dropped."""
    x = photons.join(F.broadcast(mean), "pix", "left")
    return x.filter((F.col("cnt") <= 1) | (F.coalesce("mean", F.lit(0.0)) >= least)).select("frame_id", "pix", "cnt")


def _photon(salt: str, *key: str) -> Column:
    """A number from 0 to 2^32 for each photon, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(salt), *key)), 1, 8), 16, 10).cast("long")


def thinned(photons: DataFrame, fraction: float, salt: str = "thin") -> DataFrame:
    """Each photon kept with probability `fraction`."""
    x = photons.select("frame_id", "pix", F.explode(F.sequence(F.lit(1), "cnt")).alias("k"))
    x = x.filter(_photon(salt, "frame_id", "pix", "k") < int(fraction * 2**32))
    return x.groupBy("frame_id", "pix").agg(F.count("*").cast("int").alias("cnt"))


def partitioned(photons: DataFrame, parts: int, salt: str = "part") -> DataFrame:
    """(frame_id, part, pix, cnt): the photons dealt to `parts` frames each."""
    x = photons.select("frame_id", "pix", F.explode(F.sequence(F.lit(1), "cnt")).alias("k"))
    return x.groupBy("frame_id", (_photon(salt, "frame_id", "pix", "k") % parts).cast("int").alias("part"), "pix").agg(F.count("*").cast("int").alias("cnt"))


def assembled_frame(frame: DataFrame, places: DataFrame, averaged: bool = False) -> DataFrame:
    """(ix, iy, value) of one frame's (pix, cnt): sums, or means if `averaged`, over the pixels that share a place, bad ones left out."""
    x = places.filter("mask < 2").join(frame.select("pix", "cnt"), "pix", "left")
    return x.groupBy("ix", "iy").agg((F.avg if averaged else F.sum)(F.coalesce("cnt", F.lit(0))).alias("value"))


def centro_symmetric(image: DataFrame) -> DataFrame:
    """Mean of an assembled image and its point mirror, where both have a pixel, else the one there is."""
    top = image.agg(F.max("ix").alias("mx"), F.max("iy").alias("my"))
    flip = image.crossJoin(F.broadcast(top)).select((F.col("mx") - F.col("ix")).alias("ix"), (F.col("my") - F.col("iy")).alias("iy"), "value")
    return image.union(flip).groupBy("ix", "iy").agg(F.avg("value").alias("value"))


def binned(photons: DataFrame, factor: int, side: int = 8) -> DataFrame:
    """(frame_id, bx, by, cnt): pixels of a square frame added up in blocks."""
    bx, by = (F.floor(x / factor).cast("int") for x in (F.floor(F.col("pix") / side), F.col("pix") % side))
    return photons.groupBy("frame_id", bx.alias("bx"), by.alias("by")).agg(F.sum("cnt").alias("cnt"))


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """Frame sets one after the other, file_id telling which."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("file_id", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return out
