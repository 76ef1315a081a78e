"""The hot loop on arrays: a grid of blocks of frames by tiles of views.

A cell of the grid meets its photons with its views as one gather and one segmented sum, so the product of photons and
views is never a table. Neither side passes through the driver or is held whole by a task: frames and views are dealt
by hash, and there are as many blocks and tiles as their numbers ask for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speckle.operators.frames import good
from speckle.operators.maximize import PROB_MIN, SPAN
from speckle.operators.views import TINY

#: Frames in a block, view pixels in a tile, and cells of an array that are computed at once.
FRAMES, TILE_PIXELS, CELLS = 8192, 1 << 22, 1 << 21
LOGL = "frame_id long, mode long, r long, logl double"


def _part(parts: int, *cols: str) -> Column:
    return F.pmod(F.xxhash64(*[F.col(c).cast("long") for c in cols]), F.lit(parts)).cast("int")


def _each(parts: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))


def _frames(t: pa.Table, *per_frame: str):
    """(frame ids, values of each column per frame, frame number, pixel and value of each lit pixel); photons in frame order."""
    t = t.sort_by("frame_id")
    ids, first, of = np.unique(t["frame_id"].to_numpy(), return_index=True, return_inverse=True)
    lit = ~np.asarray(t["pix"].is_null())
    return ids, [t[k].to_numpy()[first] for k in per_frame], of[lit], t["pix"].drop_null().to_numpy(), t["cnt"].drop_null().to_numpy().astype(float)


def _tile(t: pa.Table):
    """(mode, r, ln w, pixels, values of (pixel, view), background of each pixel)."""
    key, pix = np.stack([t["mode"].to_numpy(), t["r"].to_numpy()], 1), t["pix"].to_numpy()
    keys, view = np.unique(key, axis=0, return_inverse=True)
    pixels, place = np.unique(pix, return_inverse=True)
    values = np.full((len(pixels), len(keys)), TINY)
    values[place, view.ravel()] = t["value"].to_numpy()
    w, back = np.empty(len(keys)), np.empty(len(pixels))
    w[view.ravel()], back[place] = t["w"].to_numpy(), t["background"].to_numpy()
    return keys[:, 0], keys[:, 1], np.log(w), pixels, values, back


def likelihoods(photons: DataFrame, frames: DataFrame, views: DataFrame, rot: DataFrame, det: DataFrame, n_frames: int, n_views: int, form: str = "poisson", keep: bool = False, frames_in_block: int = FRAMES, tile_pixels: int = TILE_PIXELS) -> DataFrame:
    """(frame_id, mode, r, logl) of every frame with every view, over good pixels.

    form: `poisson` as maximize.log_likelihood; `background` as maximize.log_likelihood_background, with bgscale in
    frames and background in det; `gauss` as maximize.log_likelihood_gauss, photons being (frame_id, pix, cnt) of every
    pixel and frames.phi the scale. frames: (frame_id, phi) and beta if `keep`, which leaves of each tile the views
    within SPAN / beta of the frame's best there: all that the posterior needs.
    """
    pixels = det.filter("mask < 1").select("pix", F.col("background") if form == "background" else F.lit(0.0).alias("background"))
    blocks = max(1, -(-n_frames // frames_in_block))
    tiles = max(1, -(-n_views * pixels.count() // tile_pixels))
    per_frame = ["phi"] + ["bgscale"] * (form == "background") + ["beta"] * keep
    left = frames.select("frame_id", *per_frame).join(photons.join(good(det), "pix"), "frame_id", "left")
    left = left.select(_part(blocks, "frame_id").alias("block"), _each(tiles).alias("tile"), "frame_id", *per_frame, "pix", "cnt")
    right = views.join(F.broadcast(pixels), "pix").join(F.broadcast(rot.select("r", "w")), "r")
    right = right.select(_each(blocks).alias("block"), _part(tiles, "mode", "r").alias("tile"), "mode", "r", F.col("pix").alias("pix"), "value", "w", "background")

    def cell(f, v):
        out = [[], [], [], []]
        if f.num_rows and v.num_rows:
            ids, given, of, pix, cnt = _frames(f, *per_frame)
            extra = dict(zip(per_frame, given))
            mode, r, log_w, own, values, back = _tile(v)
            at = np.searchsorted(own, pix)
            totals, squares, logs = values.sum(0), (values * values).sum(0), np.log(values) if form == "poisson" else None
            step = max(1, CELLS // len(r))
            for lo in range(0, len(ids), step):
                hi = min(lo + step, len(ids))
                phi = extra["phi"][lo:hi, None]
                logl = np.zeros((hi - lo, len(r))) if form == "gauss" else log_w[None] - totals[None] * phi
                a, b = np.searchsorted(of, [lo, hi])
                # photons a few at a time, cut between frames
                while a < b:
                    c = b if (b - a) * len(r) <= CELLS else max(int(np.searchsorted(of, of[min(b - 1, a + max(1, CELLS // len(r)))])), int(np.searchsorted(of, of[a], "right")))
                    lit, starts = np.unique(of[a:c], return_index=True)
                    n = cnt[a:c, None]
                    if form == "poisson":
                        part = logs[at[a:c]] * n
                    elif form == "background":
                        x = values[at[a:c]] * extra["phi"][of[a:c], None] + (extra["bgscale"][of[a:c]] * back[at[a:c]])[:, None]
                        part = n * np.log(np.maximum(x, TINY))
                    else:
                        part = 2 * extra["phi"][of[a:c], None] * n * values[at[a:c]] - n * n
                    logl[lit - lo] += np.add.reduceat(part, starts)
                    a = c
                if form == "gauss":
                    logl -= phi * phi * squares[None]
                some = logl > logl.max(1)[:, None] - SPAN / extra["beta"][lo:hi, None] if keep else np.ones(logl.shape, bool)
                i, k = np.nonzero(some)
                for to, x in zip(out, (ids[lo + i], mode[k], r[k], logl[i, k])):
                    to.append(x)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.Table.from_arrays([pa.array(np.concatenate(x) if x else [], t) for x, t in zip(out, kinds)], ["frame_id", "mode", "r", "logl"])

    return left.groupBy("block", "tile").cogroup(right.groupBy("block", "tile")).applyInArrow(cell, LOGL)


def tomogram_sums(post: DataFrame, photons: DataFrame, phi: DataFrame, det: DataFrame, n_frames: int, frames_in_block: int = FRAMES) -> DataFrame:
    """(mode, r, pix, s) of a posterior: sums of p count over all frames, and as pixel -1 those of p phi.

    A block of frames gives one row for each view that explains a frame of it, so what is shuffled on is partial sums.
    """
    blocks = max(1, -(-n_frames // frames_in_block))
    left = phi.select("frame_id", "phi").join(photons.join(good(det, 2), "pix"), "frame_id", "left").select(_part(blocks, "frame_id").alias("block"), "frame_id", "phi", "pix", "cnt")
    # an alias, as both sides may come from one table of frames
    right = post.filter(F.col("p") > PROB_MIN).select(_part(blocks, "frame_id").alias("block"), F.col("frame_id").alias("frame_id"), "mode", "r", "p")

    def cell(f, v):
        out = [[], [], [], [], []]
        if f.num_rows and v.num_rows:
            ids, (phi,), of, pix, cnt = _frames(f, "phi")
            key = np.stack([v["mode"].to_numpy(), v["r"].to_numpy()], 1)
            keys, view = np.unique(key, axis=0, return_inverse=True)
            order = np.argsort(view.ravel(), kind="stable")
            view, p, frame = view.ravel()[order], v["p"].to_numpy()[order], np.searchsorted(ids, v["frame_id"].to_numpy()[order])
            weight = np.bincount(view, p * phi[frame], len(keys))
            pixels, place = np.unique(pix, return_inverse=True)
            first = np.searchsorted(of, np.arange(len(ids) + 1))
            n = np.diff(first)[frame]
            cuts = np.searchsorted(view, np.arange(len(keys) + 1))
            lo = 0
            while lo < len(keys):
                # views a few at a time, by the photons and pixels that they take
                done = np.cumsum(np.add.reduceat(n, cuts[lo:-1]) + len(pixels)) if len(n) else np.zeros(len(keys) - lo)
                hi = lo + max(1, int(np.searchsorted(done, CELLS, "right")))
                a, b = cuts[lo], cuts[hi]
                k = n[a:b]
                photon = np.repeat(first[frame[a:b]] - np.cumsum(k) + k, k) + np.arange(k.sum())
                cell = np.repeat(view[a:b] - lo, k) * len(pixels) + place[photon]
                s = np.bincount(cell, np.repeat(p[a:b], k) * cnt[photon], (hi - lo) * len(pixels)).reshape(hi - lo, len(pixels))
                every = np.concatenate([weight[lo:hi, None], s], 1)
                on = every > 0
                on[:, 0] = True
                j, k = np.nonzero(on)
                for to, x in zip(out, (keys[lo:hi, 0], keys[lo:hi, 1], on.sum(1), np.r_[-1, pixels][k], every[j, k])):
                    to.append(x)
                lo = hi
        mode, r, n, pix, s = (np.concatenate(x) if x else np.zeros(0) for x in out)
        ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(pix, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(s, pa.float64()))]
        return pa.Table.from_arrays([pa.array(mode, pa.int64()), pa.array(r, pa.int64()), *lists], ["mode", "r", "pix", "s"])

    parts = left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(cell, "mode long, r long, pix array<int>, s array<double>")
    return parts.select("mode", "r", F.inline(F.arrays_zip("pix", "s"))).groupBy("mode", "r", "pix").agg(F.sum("s").alias("s"))


def tomograms(post: DataFrame, photons: DataFrame, phi: DataFrame, det: DataFrame, n_frames: int, frames_in_block: int = FRAMES) -> DataFrame:
    """(mode, r, pix, value) as maximize.tomograms gives them."""
    rows = tomogram_sums(post, photons, phi, det, n_frames, frames_in_block).groupBy("mode", "r")
    rows = rows.agg(F.max(F.when(F.col("pix") == -1, F.col("s"))).alias("psum"), F.map_from_entries(F.collect_list(F.struct("pix", "s"))).alias("m")).filter("psum > 0")
    every = rows.crossJoin(F.broadcast(det.filter("mask < 2").select("pix")))
    return every.select("mode", "r", "pix", (F.coalesce(F.try_element_at("m", "pix"), F.lit(0.0)) / F.col("psum")).alias("value"))
