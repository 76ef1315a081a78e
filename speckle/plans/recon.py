"""Reconstructions in two and three dimensions and of axial models, from a configuration, on packed blocks of frames."""

from __future__ import annotations

import math
import os
import time
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speckle.operators import blocks as bl
from speckle.operators import detector as dt
from speckle.operators import frames as fr
from speckle.operators import grid
from speckle.operators import known as kn
from speckle.operators import maximize as mx
from speckle.operators import orientation as ori
from speckle.operators import views as vw
from speckle.operators.geometry import Axial, Geometry, Plane, Volume
from speckle.sources import sinks, texts
from speckle.sources.texts import Params


@dataclass
class Problem:
    """Frames, where they may have been seen from, and the model that they are explained by.

    photons: (frame_id, pix, cnt); frames: (frame_id, blacklist); det: (pix, x, y, qx, qy, qz, corr, mask); rot: (r, w and
    the geometry's columns); model: (mode, vox, intens). scale: (frame_id, phi) of the iteration before, where intensities
    vary; without it every frame has the scale that brings the mean view to the mean count.
    """

    photons: DataFrame
    frames: DataFrame
    det: DataFrame
    rot: DataFrame
    model: DataFrame
    geometry: Geometry
    size: int
    friedel: bool = True
    scale: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.model.sparkSession


class Step:
    """One iteration: what a Problem's model explains of its frames, and the model that this asks for."""

    def __init__(self, x: Problem, beta: float = -1.0, factor: float = 1.0, blocks: tuple[DataFrame, int] | None = None, allowed: tuple[DataFrame, DataFrame] | None = None):
        """beta: that of all frames, if above 0; factor: what the schedule has raised it by; blocks: packed frames and their
        number, where a loop keeps them; allowed: candidates (frame_id, cell) and cells (r, cell), which a refinement is
        held to."""
        self.x, self.allowed = x, allowed
        spark = x.spark
        self.setup = grid.setup(x.model, x.rot, x.det, x.geometry, x.size)
        self.modes = len(self.setup.model)
        self.seen = x.frames.filter("blacklist = 0").select("frame_id")
        self.counts = fr.frame_counts(x.photons, x.frames, x.det)
        self.totals = grid.totals(spark, self.setup)
        self.n_blocks = blocks[1] if blocks else blocks_of(x, self.setup.views)
        self.blocks = blocks[0] if blocks else grid.packed(x.photons, self.seen, x.det, self.n_blocks)
        start = mx.start_beta(self.counts)
        start = start.withColumn("beta", F.lit(float(beta))) if beta > 0 else start
        self.betas = start.select("frame_id", F.least(F.lit(1.0), F.col("beta") * float(factor)).alias("beta"))
        if x.scale is None:
            self.rescale = mx.rescale(self.totals, x.rot, fr.mean_count(x.photons, x.frames, x.det)).first()[0]
            self.phi = self.seen.withColumn("phi", F.lit(self.rescale))
        else:
            self.phi = x.scale.join(self.seen, "frame_id", "left_semi")
        self.params = self.phi.join(self.betas, "frame_id")

    def rows(self, post: bool = True) -> DataFrame:
        """The posterior, if `post`, and the sums that it asks for; to be written once where both are read. Without the posterior
        frames that nothing tells apart meet the views once."""
        if self.allowed:
            p = mx.posterior(self.likelihoods(), self.betas)
            return grid.held(p, bl.tomogram_sums(p, self.x.photons, self.phi, self.x.det, self.seen.count()))
        if not post:
            return grid.summed(grid.classes(self.alike), self.setup)
        return grid.expanded(self.blocks, self.params, self.n_blocks, self.setup)

    @cached_property
    def alike(self) -> DataFrame:
        return grid.alike(self.x.photons, self.params, self.x.det)

    def likely(self, least: float) -> DataFrame:
        """(frame_id, mode, r, p) above `least`, of all frames with all views."""
        return grid.likely(self.alike, self.setup, least)

    def likelihoods(self) -> DataFrame:
        """Of the pairs of frames and rotations that are allowed."""
        return grid.refined(self.x.photons, self.phi, *self.allowed, self.setup)

    def next_model(self, rows: DataFrame, alpha: float = 0.0) -> DataFrame:
        new = mx.mixed_model(self.x.model, vw.divided(grid.merged(rows, self.setup)), alpha)
        return vw.friedel(new, self.x.size, self.x.geometry.dims) if self.x.friedel else new


def blocks_of(x: Problem, views: int) -> int:
    return grid.block_of(x.frames.filter("blacklist = 0").count(), views, x.spark.sparkContext.defaultParallelism)


def candidates(post: DataFrame) -> DataFrame:
    """(frame_id, cell): the rotations that a coarse posterior leaves to each frame."""
    return post.filter(F.col("p") > mx.PROB_MIN).select("frame_id", F.col("r").alias("cell")).distinct()


def cells(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """(r, cell): the coarse rotation that each fine one is nearest to."""
    return ori.nearest(fine, coarse).select("r", F.col("coarse").alias("cell"))


def rotations(spark: SparkSession, p: Params, num_div: int | None = None) -> tuple[DataFrame, Geometry]:
    """The orientations and the geometry that a configuration names: recon_type 2d, 3d or rz."""
    kind = p.recon_type.lower()
    if kind == "2d":
        return ori.in_plane(spark, p.num_rot), Plane()
    if kind == "rz":
        return ori.rz_grid(spark, p.num_rot, p.beta_range, p.beta_step), Axial()
    return ori.configured(spark, "3d", num_div=num_div or p.num_div, point_group="A5" if p.sym_icosahedral else "1"), Volume()


def level(p: Params, k: int) -> tuple[float, int]:
    """(radius, subdivision of rotations) of iteration k: 0 where none is set; a refinement begins with a coarse iteration."""
    if p.radius > 0:
        return kn.radius_step(k, p.radius, p.radius_period, p.radius_jump, p.oversampling)
    return 0.0, p.coarse_div if p.coarse_div and k == 1 else p.num_div


def reconstruct(x: Problem, iterations: int, out: str, p: Params | None = None, rotate: bool = True) -> list[dict]:
    """Runs the loop from a configuration; tables of each iteration and a line of the log go to `out` as they are made.

    Frames are packed once. With `radius` the detector is cut to a radius that grows by radius_jump every radius_period
    iterations, and rotations are as fine as it asks for. With coarse_div, a set of rotations finer than the one before it
    is searched only about what the last posterior of the coarser set left to each frame. rotate: rotations are those that
    p names, else those of x. A log with iterations is gone on from. Stops where the change is not a number. Returns the
    rows of this call.
    """
    p, spark, path, log = p or Params(), x.spark, f"{out}/EMC.log", []
    os.makedirs(out, exist_ok=True)
    read = lambda name, k: spark.read.parquet(f"{out}/{name}/iteration={k}")
    first = texts.resumed(spark, path)
    if first == 1:
        sinks.backup(path)
        sinks.iteration(out, 0, model=x.model)
        sinks.log_head(path, num_data=x.frames.count(), alpha=p.alpha, need_scaling=p.need_scaling)
    modes = x.model.agg(F.max("mode")).first()[0] + 1
    blocks, most = None, 0
    for k in range(first, first + iterations):
        began, cut, rot, geometry = time.monotonic(), x.det, x.rot, x.geometry
        radius, num_div = level(p, k)
        if rotate:
            rot, geometry = rotations(spark, p, num_div)
        if radius > 0:
            cut = dt.remask(x.det, radius)
        scaled = p.need_scaling and k > 1
        now = replace(x, det=cut, rot=rot, geometry=geometry, model=read("model", k - 1), friedel=p.friedel_sym, scale=read("scale", k - 1) if scaled else None)
        allowed = None
        if p.coarse_div and rotate:
            coarser = [j for j in range(1, k) if level(p, j)[1] < num_div]
            if coarser:
                allowed = candidates(read("posterior", coarser[-1])), cells(rot, read("quaternions", coarser[-1]))
        if (n := rot.count() * modes) > most:
            count = blocks_of(now, n)
            sinks.iteration(out, k, packed=grid.packed(x.photons, x.frames.filter("blacklist = 0"), x.det, count))
            blocks, most = (read("packed", k), count), n
        s = Step(now, p.beta, p.beta_jump ** ((k - 1) // p.beta_period), blocks, allowed)
        sinks.params(spark, out, k, p, iteration=k, num_rot=rot.count())
        sinks.iteration(out, k, expanded=s.rows(), quaternions=rot)
        rows = read("expanded", k)
        sinks.iteration(out, k, posterior=grid.posterior(rows))
        post, new = read("posterior", k), s.next_model(rows, p.alpha)
        if p.need_scaling:
            phi = mx.updated_scale(post, s.totals, s.counts) if p.update_scale or k == 1 else s.phi
            phi, new = mx.normalised_scales(phi, new)
            sinks.iteration(out, k, scale=phi)
        metrics = mx.frame_metrics(post, rot, fr.sum_fact(x.photons, cut), s.modes)
        sinks.iteration(out, k, model=new, metrics=metrics, orientations=mx.best_rotation(post), occupancies=mx.occupancy(post))
        rms, mean = mx.rms_change(now.model, read("model", k)).first()[0], mx.averages(read("metrics", k), x.frames).first()
        beta = s.betas.join(s.seen, "frame_id", "left_semi").agg(F.avg("beta")).first()[0]
        log.append({"iteration": k, "seconds": time.monotonic() - began, "rms_change": rms, "info_rate": mean[0], "log_likelihood": mean[1], "num_rot": rot.count(), "beta": beta})
        sinks.log_row(path, *log[-1].values())
        if math.isnan(rms):
            break
    return log
