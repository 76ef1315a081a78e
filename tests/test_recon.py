"""The loop on packed blocks: geometries, refinement, the index over rotations, reconstructions from a configuration."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from speckle.operators import blocks as bl
from speckle.operators import geometry as ge
from speckle.operators import grid
from speckle.operators import maximize as mx
from speckle.operators import orientation as ori
from speckle.operators import views as vw
from speckle.plans import catalog, recon
from speckle.sources import tables as tb
from speckle.sources import texts

SF = "/root/testdata/sf0.001"
SIZE = tb.MODEL_SIZE


def turned():
    """A plane whose angle runs the other way: a geometry that the library does not have, and workers cannot import."""

    class Turned:
        columns, dims = ("angle",), 2

        def at(self, rot, q, size):
            c, s = np.cos(rot[:, :1]), np.sin(rot[:, :1])
            return np.stack([c * q[:, 0] + s * q[:, 1], c * q[:, 1] - s * q[:, 0]], 2) + size // 2

    return Turned()


def flat_problem(spark, geometry=None, sign=1):
    rot = tb.rotations(spark).withColumn("angle", sign * F.col("angle"))
    return recon.Problem(tb.photons(spark, SF), tb.frames(spark, SF), tb.detector(spark), rot, tb.models(spark, SF, 2), geometry or ge.Plane(), SIZE)


def pairs(df, *cols):
    return {tuple(r[c] for c in cols[:-1]): r[cols[-1]] for r in df.collect()}


def close(a, b, tol=1e-9):
    assert a.keys() == b.keys() and a
    for k in a:
        assert math.isclose(a[k], b[k], rel_tol=tol, abs_tol=tol), (k, a[k], b[k])


@pytest.fixture(scope="module")
def joined(spark):
    """The same iteration by joins and view rows."""
    x = flat_problem(spark)
    coords = vw.coords2d(x.rot, x.det, SIZE)
    views = vw.views(coords, x.model, SIZE)
    s = recon.Step(x)
    post = mx.posterior(mx.log_likelihood(x.photons, views, mx.view_totals(views, x.det), x.rot, s.phi, x.det), s.betas).cache()
    sums = vw.merged(coords, mx.tomograms(post, x.photons, s.phi, x.det), SIZE)
    return x, s, post, sums


def test_packed_blocks_give_what_joins_give(spark, joined):
    x, s, post, sums = joined
    rows = s.rows().cache()
    close(pairs(grid.posterior(rows), "frame_id", "mode", "r", "p"), pairs(post, "frame_id", "mode", "r", "p"))
    got, want = grid.merged(rows, s.setup).cache(), sums.filter("weight > 0").cache()
    for what in ("num", "weight"):
        close(pairs(got, "mode", "vox", what), pairs(want, "mode", "vox", what))


def test_small_arrays_and_many_blocks_change_nothing(spark, joined, monkeypatch):
    x, s, post, _ = joined
    want = pairs(grid.merged(s.rows(), s.setup), "mode", "vox", "num")
    monkeypatch.setattr(grid, "CELLS", 97)
    monkeypatch.setattr(grid, "SLAB", 50)
    blocks = grid.packed(x.photons, s.seen, x.det, 7)
    rows = grid.expanded(blocks, s.params, 7, s.setup)
    close(pairs(grid.posterior(rows), "frame_id", "mode", "r", "p"), pairs(post, "frame_id", "mode", "r", "p"))
    close(pairs(grid.merged(rows, s.setup), "mode", "vox", "num"), want)


def test_held_posteriors_give_the_same_sums(spark, joined):
    x, s, post, _ = joined
    rows = grid.held(post, bl.tomogram_sums(post, x.photons, s.phi, x.det, 500))
    close(pairs(grid.merged(rows, s.setup), "mode", "vox", "num"), pairs(grid.merged(s.rows(), s.setup), "mode", "vox", "num"))


def test_a_geometry_of_the_user_s_own(spark, joined):
    x, s, _, _ = joined
    other = recon.Step(flat_problem(spark, turned(), -1))
    close(pairs(other.next_model(other.rows()), "mode", "vox", "intens"), pairs(s.next_model(s.rows()), "mode", "vox", "intens"), 1e-7)


def test_views_of_every_geometry_are_those_of_the_joins(spark):
    det, size = tb.detector(spark), SIZE
    for geometry, rot, coords, dims in ((ge.Plane(), tb.rotations(spark), vw.coords2d, 2), (ge.Axial(), tb.tilts(spark, SF), vw.coords_rz, 2), (ge.Volume(), tb.turns(spark, SF), vw.coords3d, 3)):
        model = tb.models(spark, SF, dims)
        s = grid.setup(model, rot, det, geometry, size)
        want = pairs(vw.views(coords(rot, det, size), model, size), "mode", "r", "pix", "value")
        for mode in range(2):
            v = s.values(mode, slice(None))
            close({(mode, r, p): v[i, k] for i, p in enumerate(s.pix.tolist()) for k, r in enumerate(s.r.tolist())}, {k: x for k, x in want.items() if k[0] == mode})


def test_models_beyond_the_bound_are_not_broadcast(spark):
    with pytest.raises(ValueError, match="more than 1000 bytes"):
        grid.setup(tb.models(spark, SF, 2), tb.rotations(spark), tb.detector(spark), ge.Plane(), SIZE, most=1000)


def test_refined_pairs_are_those_of_the_full_run(spark):
    s = catalog._refinement(spark, SF)
    kept, cells = s.allowed
    allowed = {(f, r) for f, r in ((a.frame_id, a.r) for a in kept.join(cells, "cell").select("frame_id", "r").collect())}
    full = grid.setup(s.x.model, s.x.rot, s.x.det, s.x.geometry, SIZE)
    every = s.x.frames.filter("blacklist = 0").select("frame_id").crossJoin(s.x.rot.select(F.col("r").alias("cell")))
    all_pairs = pairs(grid.refined(s.x.photons, s.phi, every, s.x.rot.select("r", F.col("r").alias("cell")), full, frames_in_part=100), "frame_id", "mode", "r", "logl")
    close(pairs(s.likelihoods(), "frame_id", "mode", "r", "logl"), {k: v for k, v in all_pairs.items() if (k[0], k[2]) in allowed})
    plan = grid.refined(s.x.photons, s.phi, *[spark.createDataFrame(x.collect(), x.schema) for x in (kept, cells)], s.setup)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("n,coarse", [(2, 1), (3, 2), (2, 0)])
def test_nearest_by_index_is_nearest_of_all(spark, n, coarse):
    fine = ori.uniform(n)
    rough = ori.uniform(coarse) if coarse else fine[[5, 300]]
    got = pairs(ori.nearest(ori.table(spark, fine), ori.table(spark, rough)), "r", "dist")
    dots = fine[:, :4] @ rough[:, :4].T
    close(got, {(i,): 1 - d for i, d in enumerate((dots**2).max(1).tolist())}, 1e-9)
    plan = ori.nearest(ori.table(spark, fine), ori.table(spark, rough))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_configurations_name_refinements_and_radii():
    p = texts.params("[emc]\nnum_div = 3 1\nradius = 2\nradius_schedule = 0.5 2\noversampling = 2\nrecon_type = 3d\nfriedel_sym = 1\n")
    assert (p.num_div, p.coarse_div, p.radius_jump, p.radius_period, p.friedel_sym) == (3, 1, 0.5, 2, True)
    assert [recon.level(p, k) for k in (1, 3, 5)] == [(2.0, 1), (2.5, 2), (3.0, 2)]
    p = texts.params("[emc]\nnum_div = 3 1\n")
    assert [recon.level(p, k)[1] for k in (1, 2, 3)] == [1, 3, 3]


@pytest.mark.parametrize("text", ["recon_type = 2d\nnum_rot = 8\nneed_scaling = 1\nalpha = 0.2", "recon_type = rz\nnum_rot = 6\nbeta_range = 1.0\nbeta_step = 0.5", "num_div = 1\nbeta_schedule = 1.5 1"])
def test_reconstructions_of_each_kind(spark, tmp_path, text):
    p, out = texts.params("[emc]\n" + text + "\n"), str(tmp_path)
    x = recon.Problem(tb.photons(spark, SF), tb.frames(spark, SF), tb.detector(spark), None, tb.models(spark, SF, 3 if "div" in text else 2), None, SIZE)
    log = recon.reconstruct(x, 1, out, p) + recon.reconstruct(x, 1, out, p)
    assert [r["iteration"] for r in log] == [1, 2] and all(r["rms_change"] > 0 for r in log)
    assert log[0]["num_rot"] == {"2d": 8, "rz": 12, "3d": 60}[p.recon_type]
    if p.need_scaling:
        assert spark.read.parquet(f"{out}/scale").filter("iteration = 2").agg(F.avg("phi")).first()[0] == pytest.approx(1)


def test_refinement_in_the_loop(spark, tmp_path):
    p, out = texts.Params(num_div=2, coarse_div=1), str(tmp_path)
    x = recon.Problem(tb.photons(spark, SF), tb.frames(spark, SF).filter("frame_id % 5 = 0"), tb.detector(spark), None, tb.models(spark, SF, 3, 1), None, SIZE)
    log = recon.reconstruct(x, 2, out, p)
    assert [r["num_rot"] for r in log] == [60, 420]
    read = lambda name, k: spark.read.parquet(f"{out}/{name}").filter(F.col("iteration") == k)
    cells = pairs(recon.cells(read("quaternions", 2), read("quaternions", 1)), "r", "cell")
    kept = {(r.frame_id, r.cell) for r in recon.candidates(read("posterior", 1)).collect()}
    fine = read("posterior", 2).collect()
    assert fine and all((r.frame_id, cells[(r.r,)]) in kept for r in fine)
    assert {r.frame_id for r in fine} == {f for f, _ in kept}


def test_background_roots_of_split_views(spark):
    x = flat_problem(spark)
    s = recon.Step(x)
    post = grid.posterior(s.rows()).cache()
    phi, det = s.phi.withColumn("bgscale", 0.2 + (F.col("frame_id") % 5) / 10), x.det.withColumn("background", F.when(F.col("pix") % 5 == 0, 50.0).otherwise(0.005 + 0.001 * (F.col("pix") % 7)))
    # views of all frames, each dealt to some fifty parts
    got = pairs(mx.tomograms_background(post, x.photons, phi, det, hits_in_part=40), "mode", "r", "pix", "value")
    scale = {r.frame_id: (r.phi, r.bgscale) for r in phi.collect()}
    back, lit = {r.pix: r.background for r in det.filter("mask < 2").collect()}, {}
    for r in x.photons.collect():
        lit.setdefault(r.frame_id, []).append((r.pix, r.cnt))
    goal, terms = {}, {}
    for r in post.filter(F.col("p") > mx.PROB_MIN).collect():
        f, b = scale[r.frame_id]
        goal[r.mode, r.r] = goal.get((r.mode, r.r), 0) + r.p * f
        for pix, cnt in lit.get(r.frame_id, []):
            if pix in back:
                terms.setdefault((r.mode, r.r, pix), []).append((r.p * cnt * f, f, b * back[pix]))
    want = {(m, r, pix): 0.0 for m, r in goal for pix in back}
    for k, v in terms.items():
        a, f, b = np.array(v).T
        lo, hi = 0.0, (a / f).sum() / goal[k[:2]]
        if (a / b).sum() > goal[k[:2]]:
            for _ in range(80):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if (a / (mid * f + b)).sum() > goal[k[:2]] else (lo, mid)
            want[k] = (lo + hi) / 2
    close(got, want, 1e-8)
    assert 0 < sum(v > 0 for v in want.values()) < len(want)


@pytest.mark.parametrize("normal,layer", [((1.0, 2.0, -0.5), 3), ((5.0, 0.1, 0.2), 7), ((0.0, 1.0, 0.0), 0)])
def test_planes_by_normal_and_layer(spark, normal, layer):
    size, c = 9, 4
    volume = tb.volume(spark, SF, size)
    v = np.zeros(size**3)
    for r in volume.collect():
        v[r.vox] = r.intens
    v = v.reshape(size, size, size)
    n = np.array(normal) / np.linalg.norm(normal)
    b = np.cross(n, [1, 0, 0] if n[0] < 0.95 else [0, 1, 0])
    b = b / np.linalg.norm(b)
    a, want = np.cross(n, b), {}
    for i in range(-c, c + 1):
        for j in range(-c, c + 1):
            t = np.round(a * i + b * j + n * (layer - c) + c, 12)
            low = np.minimum(np.floor(t), size - 2).astype(int)
            f = t - low
            inside = ((t >= 0) & (t <= size - 1)).all()
            want[i, j] = sum(v[tuple(low + d)] * np.prod(np.where(d, f, 1 - f)) for d in np.ndindex(2, 2, 2)) if inside else 0.0
    close(pairs(vw.normal_plane(volume, normal, layer, size), "i", "j", "value"), want)


def test_averaged_assembly(spark):
    from speckle.operators import frames as fr

    places = spark.createDataFrame([(0, 0, 0, 0), (1, 0, 0, 1), (2, 0, 1, 0), (3, 0, 1, 2)], "pix int, ix int, iy int, mask int")
    frame = spark.createDataFrame([(0, 3), (3, 9)], "pix int, cnt int")
    assert pairs(fr.assembled_frame(frame, places, averaged=True), "ix", "iy", "value") == {(0, 0): 1.5, (0, 1): 0.0}
    assert pairs(fr.assembled_frame(frame, places), "ix", "iy", "value") == {(0, 0): 3, (0, 1): 0}
