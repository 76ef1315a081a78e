"""Averages, correlations and classification of images and volumes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def radius(vox: str, size: int, dims: int) -> Column:
    """Distance of a voxel from the centre of its grid."""
    c = size // 2
    return F.sqrt(sum((F.pow(F.floor(F.col(vox) / size**i) % size - c, F.lit(2)) for i in range(dims)), F.lit(0.0)))


def radial(model: DataFrame, size: int, dims: int) -> DataFrame:
    """(mode, rbin, mean, least): of each shell of unit width."""
    return model.withColumn("rbin", radius("vox", size, dims).cast("int")).groupBy("mode", "rbin").agg(F.avg("intens").alias("mean"), F.min("intens").alias("least"))


def minus_radial(model: DataFrame, size: int, dims: int, what: str = "mean", exponent: float = 1.0, limits: tuple[int, int] | None = None) -> DataFrame:
    """Intensities to a power less the mean or the minimum of their shell; 0 in shells outside the limits, if there are some."""
    x = model.withColumn("rbin", radius("vox", size, dims).cast("int")).withColumn("v", F.pow("intens", F.lit(exponent)))
    shell = Window.partitionBy("mode", "rbin")
    out = F.col("v") - (F.avg("v") if what == "mean" else F.min("v")).over(shell)
    return x.select("mode", "vox", (F.when(F.col("rbin").between(*limits), out).otherwise(0.0) if limits else out).alias("intens"))


def high_q_normalised(model: DataFrame, size: int, dims: int) -> DataFrame:
    """Intensities over their mean in the shells above 0.9 of half the size and below 3 short of it; null where none is, as
    in models of 82 and fewer cells."""
    h = size // 2
    r = radius("vox", size, dims).cast("int")
    x = model.withColumn("in", (r > 0.9 * h) & (r < h - 3))
    level = F.avg(F.when(F.col("in"), F.col("intens"))).over(Window.partitionBy("mode"))
    return x.select("mode", "vox", (F.col("intens") / level).alias("intens"))


def shell_correlation(a: DataFrame, b: DataFrame, size: int, dims: int) -> DataFrame:
    """(rbin, fsc) of the shells inside the grid: sum ab over the root of sum aa times sum bb, 0 where there is nothing."""
    x = a.select("vox", F.col("intens").alias("a")).join(b.select("vox", F.col("intens").alias("b")), "vox").withColumn("rbin", radius("vox", size, dims).cast("int"))
    s = x.filter(F.col("rbin") < size // 2).groupBy("rbin").agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    return s.select("rbin", F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt("aa") / F.sqrt("bb")).otherwise(0.0).alias("fsc"))


def polar_bins(det: DataFrame, dr: float, degrees: float) -> DataFrame:
    """(pix, rbin, abin, good) of every pixel: angles modulo 180 degrees from the least one on, and whether it is counted."""
    ang = F.atan2("x", "y")
    ang = F.when(ang < 0, ang + F.pi()).when(ang >= F.pi(), ang - F.pi()).otherwise(ang) / (F.pi() * degrees / 180)
    rad = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    x = det.select("pix", (F.col("mask") < 1).alias("good"), rad.alias("rad"), ang.alias("ang"))
    return x.select("pix", (F.col("rad") / dr).cast("int").alias("rbin"), (F.col("ang") - F.min("ang").over(Window.partitionBy())).cast("int").alias("abin"), "good")


def ring_means(photons: DataFrame, bins: DataFrame, r_min: int, r_max: int, *keys: str) -> DataFrame:
    """(keys, rbin, abin, v): counts of good pixels over the number of these, of bins from r_min to r_max - 1; lit bins only."""
    own = bins.filter(F.col("good") & F.col("rbin").between(r_min, r_max - 1)).select("pix", "rbin", "abin")
    n = own.groupBy("rbin", "abin").agg(F.count("*").alias("n"))
    x = photons.join(F.broadcast(own), "pix").groupBy(*keys, "rbin", "abin").agg(F.sum("cnt").alias("s"))
    return x.join(F.broadcast(n), ["rbin", "abin"]).select(*keys, "rbin", "abin", (F.col("s") / F.col("n")).alias("v"))


def polar(photons: DataFrame, bins: DataFrame, r_min: int, r_max: int) -> DataFrame:
    """(frame_id, rbin, abin, mean): polar images over their mean, taken over all bins of all angles from r_min to r_max - 1.

    Bins without photons are 0 and have no row; frames without photons there have none at all.
    """
    x = ring_means(photons, bins, r_min, r_max, "frame_id")
    cells = bins.agg(((F.least(F.lit(r_max), F.max("rbin") + 1) - r_min) * (F.max("abin") + 1)).alias("cells"))
    total = F.sum("v").over(Window.partitionBy("frame_id"))
    return x.crossJoin(F.broadcast(cells)).select("frame_id", "rbin", "abin", (F.col("v") / total * F.col("cells")).alias("mean"))


def angular_correlation(polar_images: DataFrame, n_angles: int, orders: int = 9) -> DataFrame:
    """(frame_id, rbin, k, value): size of the Fourier orders 1 to 9 of each ring, demeaned and of length 1."""
    own = Window.partitionBy("frame_id", "rbin")
    x = polar_images.withColumn("m", F.sum("mean").over(own) / n_angles)
    x = x.withColumn("norm", F.sqrt(F.sum(F.col("mean") * F.col("mean")).over(own) - n_angles * F.col("m") * F.col("m")))
    x = x.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(orders)))).withColumn("arg", 2 * F.pi() * F.col("k") * F.col("abin") / n_angles)
    s = x.groupBy("frame_id", "rbin", "k").agg(F.sum(F.col("mean") * F.cos("arg")).alias("re"), F.sum(F.col("mean") * F.sin("arg")).alias("im"), F.first("norm").alias("norm"))
    size = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    return s.select("frame_id", "rbin", "k", F.when(F.col("norm") > 1e-9, size / F.col("norm")).otherwise(0.0).alias("value"))


def raw_features(photons: DataFrame, det: DataFrame, r_min: float, r_max: float) -> DataFrame:
    """(frame_id, pix, value): counts of the pixels from r_min to r_max over their mean, whatever their mask."""
    rad = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    ring = det.filter(rad.between(r_min, r_max)).select("pix")
    x = photons.join(F.broadcast(ring), "pix")
    n = ring.agg(F.count("*").alias("n"))
    return x.crossJoin(F.broadcast(n)).select("frame_id", "pix", (F.col("cnt") * F.col("n") / F.sum("cnt").over(Window.partitionBy("frame_id"))).alias("value"))


def radial_lines(models: DataFrame, size: int, n: int, mask_radius: int = 0) -> DataFrame:
    """(mode, line, k, v): each 2D model along n lines through its centre, less what lies within mask_radius, at the nearest cells."""
    c = size // 2
    points = models.sparkSession.range(n).select(F.col("id").alias("line"), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("k")).filter(F.abs(F.col("k") - c) > mask_radius)
    angle = F.col("line") * (float(np.pi) / n)
    at = F.rint((F.col("k") - c) * F.cos(angle) + c) * size + F.rint((F.col("k") - c) * F.sin(angle) + c)
    return models.join(F.broadcast(points.select("line", "k", at.cast("long").alias("vox"))), "vox").select("mode", "line", "k", F.col("intens").alias("v"))


def common_lines(lines: DataFrame, block: int = 64) -> DataFrame:
    """(i, j, cc): the best correlation of a line of model i with one of model j, from (mode, line, k, v). 1 with itself.

    Models are packed, lines of mean 0 and length 1 (those without variation correlate with none), and dealt to blocks of
    `block`; every two blocks are multiplied in a task, which gives a row for each pair of models. Pairs without a line that
    varies have no row.
    """

    def pack(key, t):
        line, v = t["line"].to_numpy(), t["v"].to_numpy()[np.lexsort((t["k"].to_numpy(), t["line"].to_numpy()))]
        v = v.reshape(len(np.unique(line)), -1)
        v = v - v.mean(1, keepdims=True)
        size = np.sqrt((v * v).sum(1))
        v = v[size > 1e-12] / size[size > 1e-12, None]
        return pa.table({"mode": [key[0].as_py()], "n": [len(v)], "v": pa.array([v.ravel()], pa.list_(pa.float64()))})

    packed = lines.groupBy("mode").applyInArrow(pack, "mode long, n long, v array<double>")
    most = lines.agg(F.max("mode")).first()[0]
    own, other = F.floor(F.col("mode") / block), F.explode(F.sequence(F.lit(0), F.lit((most or 0) // block)).cast("array<long>"))
    dealt = packed.filter("n > 0").withColumn("own", own).withColumn("other", other)
    dealt = dealt.select(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "mode", "n", "v")

    def multiply(key, t):
        a, b = key[0].as_py(), key[1].as_py()
        of, mode, n = (t[x].to_numpy() for x in ("own", "mode", "n"))
        length = len(t["v"][0]) // int(n[0]) if t.num_rows else 1
        i, j = (np.nonzero(of == x)[0] for x in (a, b))
        left, right = (np.concatenate([t["v"][int(k)].values.to_numpy() for k in x]).reshape(-1, length) if len(x) else np.zeros((0, length)) for x in (i, j))
        if not len(i) or not len(j):
            return pa.table({"i": np.zeros(0, np.int64), "j": np.zeros(0, np.int64), "cc": np.zeros(0)})
        starts = [np.concatenate([[0], np.cumsum(n[x])[:-1]]) for x in (i, j)]
        cc = np.maximum.reduceat(np.maximum.reduceat(left @ right.T, starts[0], 0), starts[1], 1)
        x, y = np.nonzero(mode[i][:, None] != mode[j][None] if a != b else mode[i][:, None] < mode[j][None])
        return pa.table({"i": mode[i][x], "j": mode[j][y], "cc": cc[x, y]})

    best = dealt.groupBy("a", "b").applyInArrow(multiply, "i long, j long, cc double")
    return best.union(best.select(F.col("j").alias("i"), F.col("i").alias("j"), "cc")).union(packed.select("mode", F.col("mode").alias("j"), F.lit(1.0)))


def orientation_order(log: DataFrame) -> DataFrame:
    """(iteration, frame_id, segment, place): frames in the order of their orientation in the last iteration of a segment.

    A segment is a run of iterations of one number of frames; its number rises where that number changes.
    """
    it = log.groupBy("iteration").agg(F.count("*").alias("n"))
    w = Window.orderBy("iteration")
    seg = it.withColumn("new", F.when(F.col("n") != F.lag("n").over(w), 1).otherwise(0)).withColumn("segment", F.sum("new").over(w))
    seg = seg.withColumn("last", F.max("iteration").over(Window.partitionBy("segment"))).select("iteration", "segment", "last")
    end = log.join(F.broadcast(seg.filter("iteration = last").select("iteration", "segment")), "iteration")
    # places by orientation and range of frames first, so that no task orders a whole segment
    end = end.withColumn("slab", F.floor(F.col("frame_id") / 65536))
    part = end.groupBy("segment", "rmax", "slab").agg(F.count("*").alias("n"))
    before = Window.partitionBy("segment").orderBy("rmax", "slab").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select("segment", "rmax", "slab", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("segment", "rmax", "slab").orderBy("frame_id")
    place = end.join(part, ["segment", "rmax", "slab"]).select("segment", "frame_id", (F.col("base") + F.row_number().over(inside) - 1).cast("int").alias("place"))
    return log.join(F.broadcast(seg), "iteration").join(place, ["segment", "frame_id"]).select("iteration", "frame_id", "segment", "place")


def changes(log: DataFrame) -> DataFrame:
    """(frame_id, iteration, moved): whether a frame's orientation differs from that of the iteration before."""
    w = Window.partitionBy("frame_id").orderBy("iteration")
    return log.select("frame_id", "iteration", (F.col("rmax") != F.lag("rmax").over(w)).alias("moved")).filter("moved IS NOT NULL")


def support(volume: DataFrame, k: int) -> DataFrame:
    """(vox): the k voxels of largest value, ties to the least number."""
    return volume.orderBy(F.desc("intens"), "vox").limit(k).select("vox")


def histogram2d(points: DataFrame, bins: int) -> DataFrame:
    """(bx, by, n): points (x, y) counted on a grid over their range."""
    lim = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    one = lambda v: F.least(F.lit(bins - 1), F.floor((F.col(v) - F.col(f"{v}0")) / (F.col(f"{v}1") - F.col(f"{v}0")) * bins)).cast("int")
    return points.crossJoin(F.broadcast(lim)).groupBy(one("x").alias("bx"), one("y").alias("by")).agg(F.count("*").alias("n"))


def in_polygon(points: DataFrame, polygon: list[tuple[float, float]]) -> DataFrame:
    """Points (x, y) inside a polygon: those from which a ray crosses its edges an odd number of times."""
    crossed = F.lit(0)
    for (x0, y0), (x1, y1) in zip(polygon, polygon[1:] + polygon[:1]):
        if y0 != y1:
            at = x0 + (F.col("y") - y0) * ((x1 - x0) / (y1 - y0))
            crossed = crossed + F.when(((F.col("y") < y0) != (F.col("y") < y1)) & (F.col("x") < at), 1).otherwise(0)
    return points.filter(crossed % 2 == 1)


def principal_axis(model: DataFrame, size: int) -> DataFrame:
    """(mode, angle): direction of the largest second moment of each 2D model."""
    c = size // 2
    x, y = F.floor(F.col("vox") / size) - c, F.col("vox") % size - c
    m = model.groupBy("mode").agg(F.sum(F.col("intens") * x * x).alias("xx"), F.sum(F.col("intens") * y * y).alias("yy"), F.sum(F.col("intens") * x * y).alias("xy"))
    return m.select("mode", (0.5 * F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy"))).alias("angle"))


def principal_components(cc: DataFrame, k: int = 3) -> DataFrame:
    """(mode, c1..ck): coordinates of each model on the leading axes of its row of the correlation matrix."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = cc.groupBy(F.col("i").alias("mode")).agg(F.array_sort(F.collect_list(F.struct("j", "cc"))).alias("v")).select("mode", array_to_vector(F.col("v.cc").cast("array<double>")).alias("v"))
    out = PCA(k=k, inputCol="v", outputCol="p").fit(rows).transform(rows).withColumn("p", vector_to_array("p"))
    return out.select("mode", *[F.col("p")[i].alias(f"c{i + 1}") for i in range(k)])


def classify(features: DataFrame, labelled: DataFrame, layers: list[int], seed: int = 1) -> DataFrame:
    """(frame_id, cls): a multilayer perceptron fitted on (frame_id, label > 0) and applied to all (frame_id, features)."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    known = features.join(labelled.filter("label > 0"), "frame_id").withColumn("label", F.col("label").cast("double") - 1)
    net = MultilayerPerceptronClassifier(layers=layers, seed=seed, maxIter=50).fit(known)
    return net.transform(features).select("frame_id", (F.col("prediction") + 1).cast("int").alias("cls"))


def embedding(matrix: np.ndarray, k: int = 2, method: str = "mds", neighbours: int = 5) -> np.ndarray:
    """Coordinates of items from their distances (mds, isomap, lle), or from their affinities (spectral). The items are class averages."""
    n = len(matrix)
    if method == "isomap":
        # distances along the graph of each item's nearest neighbours
        g = np.full((n, n), np.inf)
        near = np.argsort(matrix, axis=1)[:, : neighbours + 1]
        g[np.arange(n)[:, None], near] = np.take_along_axis(matrix, near, 1)
        g = np.minimum(g, g.T)
        for m in range(n):
            g = np.minimum(g, g[:, m : m + 1] + g[m : m + 1])
        return embedding(np.where(np.isfinite(g), g, g[np.isfinite(g)].max()), k)
    if method == "lle":
        # weights that make each item from its neighbours, from distances alone; coordinates that keep them
        near, w = np.argsort(matrix, axis=1)[:, 1 : neighbours + 1], np.zeros((n, n))
        for i in range(n):
            d = matrix[i, near[i]] ** 2
            gram = (d[:, None] + d[None] - matrix[np.ix_(near[i], near[i])] ** 2) / 2
            x = np.linalg.solve(gram + np.eye(len(d)) * 1e-3 * max(np.trace(gram), 1e-12), np.ones(len(d)))
            w[i, near[i]] = x / x.sum()
        m = np.eye(n) - w
        return np.linalg.eigh(m.T @ m)[1][:, 1 : k + 1]
    if method == "mds":
        c = np.eye(n) - 1 / n
        w, v = np.linalg.eigh(-0.5 * c @ matrix**2 @ c)
        return v[:, ::-1][:, :k] * np.sqrt(np.maximum(w[::-1][:k], 0))
    d = 1 / np.sqrt(matrix.sum(1))
    w, v = np.linalg.eigh(np.eye(n) - d[:, None] * matrix * d[None])
    return v[:, 1 : k + 1] * d[:, None]


def phased(images: DataFrame, size: int, keep: int, steps: str = "20 ER 20 DM 20 ER", seed: int = 3) -> DataFrame:
    """(mode, vox, density): phase retrieval of each class average (mode, vox, intens) by error reduction and difference map.

    Magnitudes are roots of the intensities, those below 0 free; the support is what lies above the `keep`-th largest
    smoothed value at each step, positive inside; in the end the support's centre goes to the middle. One class in a task.
    """
    words = steps.split()
    plan = [a for n, a in zip(words[::2], words[1::2]) for _ in range(int(n))]

    def run(t: pd.DataFrame) -> pd.DataFrame:
        grid = np.full(size * size, -1.0)
        grid[t["vox"].to_numpy()] = t["intens"].to_numpy()
        mag = np.fft.ifftshift(np.where(grid < 0, -1, np.sqrt(np.maximum(grid, 0))).reshape(size, size))
        x = np.random.default_rng(seed).random((size, size))

        def fit(x):
            f = np.fft.fft2(x)
            return np.fft.ifft2(np.where((mag < 0) | (f == 0), f, mag * np.exp(1j * np.angle(f)))).real

        def support(x):
            low = smoothed(x)
            return low > np.sort(low.ravel())[-keep]

        def cut(x):
            return np.where(support(x) & (x > 0), x, 0)

        for a in plan:
            if a == "ER":
                last, x = support(x), fit(cut(x))
            else:
                p = fit(x)
                last = support(2 * p - x)
                x = x + cut(2 * p - x) - p
        for _ in range(2):
            at = np.nonzero(last)
            shift = [int(size // 2 - i.mean()) for i in at] if len(at[0]) else [0, 0]
            x, last = np.roll(x, shift, (0, 1)), np.roll(last, shift, (0, 1))
        return pd.DataFrame({"mode": t["mode"].iloc[0], "vox": np.arange(size * size), "density": x.ravel()})

    return images.groupBy("mode").applyInPandas(run, "mode long, vox long, density double")


def low_passed(density: np.ndarray, damping: float = -1.0, floor: float = 1e-3, cycles: int = 2) -> np.ndarray:
    """A density times exp(damping r^2) in Fourier space, r from -1 to 1 along each axis, and 0 up to `floor`, in turns."""
    axes = np.meshgrid(*[np.linspace(-1, 1, n) for n in density.shape], indexing="ij")
    keep = np.fft.ifftshift(np.exp(damping * sum(a * a for a in axes)))
    for _ in range(cycles):
        density = np.fft.ifftn(np.fft.fftn(density) * keep).real
        density = np.where(density > floor, density, 0)
    return density


def smoothed(x: np.ndarray, sigma: float = 2.0) -> np.ndarray:
    """Gaussian smoothing of an array, mirrored at its edges, cut at four sigma."""
    reach = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    w /= w.sum()
    for axis in range(x.ndim):
        pad = np.pad(x, [(reach, reach) if a == axis else (0, 0) for a in range(x.ndim)], "symmetric")
        x = np.tensordot(np.lib.stride_tricks.sliding_window_view(pad, 2 * reach + 1, axis), w, (-1, 0))
    return x


def prepared(image: np.ndarray, least: float, most: float, width: int = 30) -> np.ndarray:
    """Intensities less the least value about each pixel; -1 up to the radius `least`, 0 from `most` on."""
    c = np.indices(image.shape) - np.reshape([n // 2 for n in image.shape], (-1,) + (1,) * image.ndim)
    rad = np.sqrt((c * c).sum(0))
    x = np.where((rad <= least) | (rad >= most), 1e20, image)
    low = x
    for axis in range(x.ndim):
        pad = np.pad(low, [(width // 2, width - width // 2 - 1) if a == axis else (0, 0) for a in range(x.ndim)], "symmetric")
        low = np.lib.stride_tricks.sliding_window_view(pad, width, axis).min(-1)
    return np.where(rad <= least, -1.0, np.where(rad >= most, 0.0, x - low))


def nearest_class(points: DataFrame, x: float, y: float) -> DataFrame:
    """(mode, x, y): the embedded class nearest to a place, ties to the least mode."""
    d = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    return points.agg(F.min_by(F.struct("mode", "x", "y"), F.struct(d, F.col("mode"))).alias("p")).select("p.*")


def intensities(density: np.ndarray, size: int) -> np.ndarray:
    """Squared Fourier magnitudes of a density padded to `size`, centred."""
    pad = np.zeros((size,) * 3)
    lo = (size - density.shape[0]) // 2
    n = density.shape[0]
    pad[lo : lo + n, lo : lo + n, lo : lo + n] = density
    return np.fft.fftshift(np.abs(np.fft.fftn(np.fft.ifftshift(pad))) ** 2)
