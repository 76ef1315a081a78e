"""The expand-maximize-compress iteration as one plan, and the loop over it."""

from __future__ import annotations

import math
import os
import time
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speckle.operators import blocks as bl
from speckle.operators import frames as fr
from speckle.operators import maximize as mx
from speckle.operators import views as vw
from speckle.sources import sinks
from speckle.sources import tables as tb
from speckle.sources import texts
from speckle.sources.texts import Params


def with_background(det: DataFrame) -> DataFrame:
    return det.withColumn("background", F.lit(0.01) + 0.001 * (F.col("pix") % 7))


class State:
    """Tables of one iteration, each a lazy plan over those before it."""

    def __init__(self, spark: SparkSession, sf: str, model: DataFrame | None = None):
        self.spark = spark
        self.det, self.rot = tb.detector(spark), tb.rotations(spark)
        self.photons, self.frames = tb.photons(spark, sf), tb.frames(spark, sf)
        self.model = tb.model(spark, sf) if model is None else model
        self.phi = self.frames.filter("blacklist = 0").select("frame_id", F.col("scale").alias("phi"))
        self.size = tb.MODEL_SIZE
        self.modes = 2

    @cached_property
    def coords(self) -> DataFrame:
        return vw.coords2d(self.rot, self.det, self.size)

    @cached_property
    def views(self) -> DataFrame:
        return vw.views(self.coords, self.model, self.size)

    @cached_property
    def totals(self) -> DataFrame:
        return mx.view_totals(self.views, self.det)

    @cached_property
    def counts(self) -> DataFrame:
        return fr.frame_counts(self.photons, self.frames, self.det)

    def rescaled(self) -> DataFrame:
        """(frame_id, phi): of every frame the scale that brings the mean view to the mean count."""
        mean = mx.rescale(self.totals, self.rot, fr.mean_count(self.photons, self.frames, self.det))
        return self.phi.select("frame_id").crossJoin(F.broadcast(mean.select(F.col("rescale").alias("phi"))))

    @cached_property
    def n_frames(self) -> int:
        return self.phi.count()

    @cached_property
    def n_views(self) -> int:
        return self.rot.count() * self.modes

    @cached_property
    def betas(self) -> DataFrame:
        return mx.start_beta(self.counts)

    def likelihoods(self, frames: DataFrame, **how) -> DataFrame:
        how = {"det": self.det, "photons": self.photons} | how
        return bl.likelihoods(how.pop("photons"), frames, self.views, self.rot, how.pop("det"), self.n_frames, self.n_views, **how)

    @cached_property
    def logl(self) -> DataFrame:
        """Of every frame with every view."""
        return self.likelihoods(self.phi)

    @cached_property
    def candidates(self) -> DataFrame:
        """Those that the posterior may need: each frame's best views of each tile."""
        return self.likelihoods(self.phi.join(self.betas, "frame_id"), keep=True)

    @cached_property
    def post(self) -> DataFrame:
        return mx.posterior(self.candidates, self.betas)

    @cached_property
    def metrics(self) -> DataFrame:
        return mx.frame_metrics(self.post, self.rot, fr.sum_fact(self.photons, self.det), self.modes)

    @cached_property
    def tomograms(self) -> DataFrame:
        return bl.tomograms(self.post, self.photons, self.phi, self.det, self.n_frames)

    def next_model(self, alpha: float = 0.0) -> DataFrame:
        new = vw.divided(vw.merged(self.coords, self.tomograms, self.size))
        return vw.friedel(mx.mixed_model(self.model, new, alpha), self.size, 2)


def reconstruct(spark: SparkSession, sf: str, iterations: int, out: str, p: Params | None = None) -> list[dict]:
    """Runs the loop; every iteration's tables go to partitions under `out`, and a line of the log as each one ends.

    Tables: params, model, inter_weight, posterior, orientations, metrics, occupancies, scale, quaternions. p: alpha,
    need_scaling, beta (the start, if above 0, in place of one for each frame), beta_jump and beta_period. What the next
    iteration reads is written, so plans do not grow. A log with iterations is gone on from; one without is moved aside.
    Stops where the change is not a number. Returns the rows of this call: iteration, seconds, rms_change, info_rate,
    log_likelihood, num_rot, beta.
    """
    p, path, log = p or Params(), f"{out}/EMC.log", []
    os.makedirs(out, exist_ok=True)
    read = lambda name, k: spark.read.parquet(f"{out}/{name}/iteration={k}")
    start = texts.resumed(spark, path)
    if start == 1:
        sinks.backup(path)
        sinks.iteration(out, 0, model=tb.model(spark, sf))
        sinks.log_head(path, num_data=tb.frames(spark, sf).count(), alpha=p.alpha, need_scaling=p.need_scaling)
    for k in range(start, start + iterations):
        began, old = time.monotonic(), read("model", k - 1)
        s = State(spark, sf, old)
        s.phi = read("scale", k - 1) if p.need_scaling and k > 1 else s.rescaled()
        first = s.betas if p.beta <= 0 else s.betas.withColumn("beta", F.lit(p.beta))
        s.betas = mx.scheduled_beta(first, k, p.beta_jump, p.beta_period)
        sinks.params(spark, out, k, p, iteration=k, num_rot=s.rot.count())
        sinks.iteration(out, k, posterior=s.post, quaternions=s.rot)
        s.post = read("posterior", k)
        sums = vw.merged(s.coords, s.tomograms, s.size)
        sinks.iteration(out, k, inter_weight=sums)
        new = vw.friedel(mx.mixed_model(old, vw.divided(read("inter_weight", k)), p.alpha), s.size, 2)
        if p.need_scaling:
            phi, new = mx.normalised_scales(mx.updated_scale(s.post, s.totals, s.counts), new)
            sinks.iteration(out, k, scale=phi)
        sinks.iteration(out, k, model=new, metrics=s.metrics, occupancies=mx.occupancy(s.post), orientations=mx.best_rotation(s.post))
        rms, mean = mx.rms_change(old, read("model", k)).first()[0], mx.averages(read("metrics", k), s.frames).first()
        beta = s.betas.join(s.phi.select("frame_id"), "frame_id", "left_semi").agg(F.avg("beta")).first()[0]
        log.append({"iteration": k, "seconds": time.monotonic() - began, "rms_change": rms, "info_rate": mean[0], "log_likelihood": mean[1], "num_rot": s.rot.count(), "beta": beta})
        sinks.log_row(path, *log[-1].values())
        if math.isnan(rms):
            break
    return log
