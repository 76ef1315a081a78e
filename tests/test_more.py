"""Readers, sinks, several detectors, phasing and simulation on small cases."""

import numpy as np
import pytest

from speckle.operators import analysis, blocks, known, maximize, orientation, simulate
from speckle.plans import emc as plan
from speckle.plans.catalog import QUERIES
from speckle.plans.emc import State, with_background
from speckle.sources import emc, reader, sinks, tables, texts

SF = "/root/testdata/sf0.001"


def test_background_scales_solve_their_equations(spark):
    s = State(spark, SF)
    det = {r.pix: r for r in with_background(s.det).collect()}
    views = {(r.mode, r.r, r.pix): r.value for r in s.views.collect()}
    total = {(r.mode, r.r): r.u for r in s.totals.collect()}
    post, photons = {}, {}
    for r in s.post.filter("p > 1e-6").collect():
        post.setdefault(r.frame_id, []).append((r.mode, r.r, r.p))
    for r in s.photons.collect():
        if det[r.pix].mask == 0:
            photons.setdefault(r.frame_id, []).append((r.pix, r.cnt))
    back = 0.5 * sum(d.background for d in det.values() if d.mask == 0)
    seen = 0
    for r in QUERIES["scale_background"](spark, SF).collect():
        lit = photons.get(r.frame_id, [])
        if sum(n for _, n in lit) <= back:
            assert r.phi == 0.001
            continue
        at = lambda x: sum(p * (sum(n * views[m, k, q] / (x * views[m, k, q] + 0.5 * det[q].background) for q, n in lit) - total[m, k]) for m, k, p in post[r.frame_id])
        assert at(r.phi * 0.999 - 1e-4) > 0 > at(r.phi * 1.001 + 1e-4) or at(r.phi * 1.001 + 1e-4) > 0 and r.phi > 30
        seen += 1
    assert seen > 500


def test_blocks_and_tiles_of_any_size_agree_with_joins(spark):
    s = State(spark, SF)
    few = s.phi.filter("frame_id % 7 = 0").cache()
    joined = {(r.frame_id, r.mode, r.r): r.logl for r in maximize.log_likelihood(s.photons, s.views, s.totals, s.rot, few, s.det).collect()}
    for size in ({"frames_in_block": 20, "tile_pixels": 100}, {}):
        got = blocks.likelihoods(s.photons, few, s.views, s.rot, s.det, few.count(), s.n_views, **size).collect()
        assert len(got) == len(joined) and all(r.logl == pytest.approx(joined[r.frame_id, r.mode, r.r], abs=1e-8) for r in got)
    post = maximize.posterior(maximize.log_likelihood(s.photons, s.views, s.totals, s.rot, few, s.det), s.betas)
    want = {(r.mode, r.r, r.pix): r.value for r in maximize.tomograms(post, s.photons, few, s.det).collect()}
    got = blocks.tomograms(post, s.photons, few, s.det, few.count(), frames_in_block=30).collect()
    assert len(got) == len(want) and all(r.value == pytest.approx(want[r.mode, r.r, r.pix], abs=1e-9) for r in got)


def test_views_that_do_not_rotate_keep_their_mode(spark):
    post = spark.createDataFrame([(1, 0, 3, 0.5), (1, 1, 3, 0.25), (1, 2, 0, 0.25)], "frame_id long, mode long, r long, p double")
    back = known.previous_posterior(known.saved_posterior(post, 12, 2), post, 12, 2)
    assert sorted(map(tuple, back.select("frame_id", "mode", "r", "p").collect())) == sorted(map(tuple, post.collect()))


def test_frame_sets_of_mixed_files(spark, tmp_path):
    emc.write(str(tmp_path / "a.emc"), 4, [([0, 2], [1], [3]), ([], [], []), ([3], [], [])])
    head = np.zeros(256, "<i4")
    head[:3] = 2, 4, emc.INTEGER
    (tmp_path / "b.emc").write_bytes(head.tobytes() + np.array([[0, 5, 1, 2], [1, 0, -1, 9]], "<i4").tobytes())
    (tmp_path / "list").write_text("a.emc\nb.emc\n")
    det = spark.createDataFrame([(d, p, 2 if d == 1 and p == 3 else 0, p, 0) for d in (0, 1) for p in range(4)], "det_id int, pix int, mask int, ix int, iy int")
    photons, frames = reader.frame_set(spark, reader.file_list(spark, str(tmp_path / "list")), det, [0, 1])
    assert sorted(map(tuple, photons.collect())) == [(0, 0, 1), (0, 1, 3), (0, 2, 1), (2, 3, 1), (3, 1, 5), (3, 2, 1), (4, 0, 1)]
    assert sorted(map(tuple, frames.collect())) == [(0, 0, 0, 0), (1, 0, 1, 0), (2, 0, 2, 0), (3, 1, 0, 1), (4, 1, 1, 1)]
    one = lambda **how: reader.frame(photons, frames, 3, det, **how)
    assert sorted(map(tuple, one(raw=True).collect())) == [(0, 0), (1, 5), (2, 1), (3, 0)]
    assert one(sparse=True).first().place_multi == [1]
    assert sorted((r.ix, r.value) for r in one().collect()) == [(0, 0), (1, 5), (2, 1)]
    assert sorted((r.ix, r.value) for r in one(sym=True).collect()) == [(0, 0.5), (1, 5.0), (2, 0.5)]


def test_selections(spark):
    f = spark.range(5).withColumnRenamed("id", "frame_id")
    pick = lambda values: sorted(r.frame_id for r in reader.chosen(f, spark.createDataFrame(list(enumerate(values)), "line int, value int")).collect())
    assert pick([1, 0, 0, 1, 1]) == [0, 3, 4] and pick([4, 2, 9]) == [2, 4] and pick([1, 0]) == [0, 1]


def test_sinks_round_trip(spark, tmp_path):
    det = tables.detector(spark)
    sinks.detector(det, str(tmp_path / "det"), 20.0, 20.0)
    back = texts.detector(spark, str(tmp_path / "det"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, det.select("pix", "qx", "qy", "qz", "corr", "mask").collect()))
    rot = orientation.table(spark, orientation.uniform(1))
    sinks.quaternions(rot, str(tmp_path / "q"))
    assert orientation.from_text(texts.numbered(spark, str(tmp_path / "q"))).count() == 60
    sinks.density(tables.volume(spark, SF, 5), str(tmp_path / "v.raw"), 5)
    assert sorted(map(tuple, reader.volume(spark, str(tmp_path / "v.raw")).collect())) == sorted(map(tuple, tables.volume(spark, SF, 5).collect()))
    assert reader.background(spark, str(tmp_path / "v.raw"), det).filter("background > 0").count() == 64
    log = str(tmp_path / "EMC.log")
    sinks.log_head(log, num_data=3)
    sinks.log_row(log, 1, 2.5, 1e-3, 4.0, -3e5, 420, 0.01)
    assert texts.resumed(spark, log) == 2 and texts.log(spark.read.text(log)).first().num_rot == 420
    assert sinks.backup(log) == log + ".1" and sinks.backup(log) is None
    frames = spark.createDataFrame([(1, [0], [2], [3])], emc.SPARSE_SCHEMA)
    assert sinks.appended(frames, str(tmp_path / "set"), 4) == 1
    with pytest.raises(ValueError):
        sinks.appended(frames, str(tmp_path / "set"), 2)


def test_simulated_counts_meet_their_target(spark):
    det, cube = tables.detector(spark).toPandas(), np.random.default_rng(1).random((13, 13, 13))
    got = simulate.simulated(spark, 300, cube, det, 40.0, orientations=orientation.uniform(1))
    assert simulate.actual_mean_count(got, 300).first()[0] == pytest.approx(40, rel=0.1)
    assert got.select("q0", "q1", "q2", "q3").distinct().count() <= 60
    factor, mean = simulate.level(cube, det, fluence=1e12, views=200)
    assert factor == pytest.approx(1e12 * 2.81794e-9**2) and mean > 0
    with pytest.raises(ValueError):
        simulate.level(cube, det)


def test_phasing_finds_a_shape(spark):
    size, x = 16, np.zeros((16, 16))
    x[6:10, 6:11] = 1
    intens = np.fft.fftshift(np.abs(np.fft.fft2(x)) ** 2).ravel()
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(intens)], "mode long, vox long, intens double")
    got = np.zeros(256)
    for r in analysis.phased(df, size, 25, "20 ER 40 DM 40 ER").collect():
        got[r.vox] = r.density
    mag = np.abs(np.fft.fft2(got.reshape(16, 16)))
    assert np.abs(mag - np.abs(np.fft.fft2(x))).mean() < 0.5


def test_smoothing_and_preparation():
    x = np.zeros((21, 21))
    x[10, 10] = 1
    s = analysis.smoothed(x)
    assert s.sum() == pytest.approx(1) and s[10, 12] / s[10, 10] == pytest.approx(np.exp(-0.5))
    p = analysis.prepared(np.full((21, 21), 5.0) + x, 2, 9, 5)
    assert p[10, 10] == -1 and p[0, 0] == 0 and p[10, 15] == 0


def test_embeddings_along_a_curve():
    t = np.linspace(0, 3, 30)
    pts = np.stack([np.cos(t), np.sin(t)], 1)
    d = np.linalg.norm(pts[:, None] - pts[None], axis=2)
    for method in ("isomap", "lle"):
        y = analysis.embedding(d, 1, method, neighbours=3)[:, 0]
        assert (np.diff(y) > 0).all() or (np.diff(y) < 0).all()


def test_loop_goes_on_from_its_log(spark, tmp_path):
    out, p = str(tmp_path), texts.Params(need_scaling=True, alpha=0.3, beta_jump=1.5, beta_period=1)
    first = plan.reconstruct(spark, SF, 1, out, p)
    second = plan.reconstruct(spark, SF, 1, out, p)
    assert [r["iteration"] for r in first + second] == [1, 2]
    s = State(spark, SF)
    want = s.betas.join(s.phi, "frame_id").selectExpr("avg(beta)", "avg(least(1, 1.5 * beta))").first()
    assert [r["beta"] for r in first + second] == pytest.approx(list(want))
    log = texts.log(spark.read.text(f"{out}/EMC.log")).collect()
    assert sorted(r.iteration for r in log) == [1, 2] and texts.resumed(spark, f"{out}/EMC.log") == 3
    scale = spark.read.parquet(f"{out}/scale/iteration=2")
    assert scale.agg({"phi": "avg"}).first()[0] == pytest.approx(1.0)
    for name in ("params", "model", "inter_weight", "posterior", "orientations", "metrics", "occupancies", "quaternions"):
        assert spark.read.parquet(f"{out}/{name}/iteration=2").count() > 0
    # the first iteration in numpy
    old = {(r.mode, r.vox): r.intens for r in spark.read.parquet(f"{out}/model/iteration=0").collect()}
    sums = {(r.mode, r.vox): r.num / r.weight for r in spark.read.parquet(f"{out}/inter_weight/iteration=1").collect() if r.weight > 0}
    mixed = {k: 0.3 * v + 0.7 * sums.get(k, 0.0) for k, v in old.items()}
    phi = maximize.updated_scale(spark.read.parquet(f"{out}/posterior/iteration=1"), s.totals, s.counts).agg({"phi": "avg"}).first()[0]
    for r in spark.read.parquet(f"{out}/model/iteration=1").collect():
        assert r.intens == pytest.approx(phi * (mixed[r.mode, r.vox] + mixed[r.mode, 168 - r.vox]) / 2)


def test_dividing_by_sigma(spark):
    logl = spark.createDataFrame([(1, 0, 0, -2.0), (1, 0, 1, -4.0)], "frame_id long, mode long, r long, logl double")
    beta = spark.createDataFrame([(1, 1.0)], "frame_id long, beta double")
    p = {r.r: r.p for r in maximize.posterior(logl, beta, spread=2.0).collect()}
    assert p[0] / p[1] == pytest.approx(np.e)


GEOMETRY = """; two panels and what is wrong with them
clen = 0.5
res = 10000
coffset = 0.1
adu_per_photon = 1
fs = x
ss = y
rigid_group_all = a,b
a/min_fs = 0
a/max_fs = 3
a/min_ss = 0
a/max_ss = 2
a/corner_x = -2.5
a/corner_y = -1.5
b/min_fs = 0 ; below a in the array
b/max_fs = 3
b/min_ss = 3
b/max_ss = 4
b/corner_x = 4
b/corner_y = 1
b/fs = +0.0x -1.0y
b/ss = -x + 0.5y
badbeam/min_x = -0.6
badbeam/max_x = 0.6
badbeam/min_y = -1
badbeam/max_y = 1
badcorner/panel = b
badcorner/min_fs = 2
badcorner/max_fs = 3
badcorner/min_ss = 4
badcorner/max_ss = 4
"""


def test_geometry_files(spark):
    from speckle.sources import geometry

    layout = geometry.parsed(GEOMETRY)
    assert list(layout.panels) == ["a", "b"] and layout.width == 4 and layout.whole["clen"] == "0.5"
    assert layout.panels["b"]["fs"] == (0.0, -1.0) and layout.panels["b"]["ss"] == (-1.0, 0.5) and layout.panels["a"]["fs"] == (1.0, 0.0)
    got = {r.pix: r for r in geometry.pixels(spark, layout).collect()}
    assert sorted(got) == list(range(20))
    for p, r in got.items():
        fs, ss = p % 4, p // 4
        x, y = (-2.5 + fs, -1.5 + ss) if ss < 3 else (4 - (ss - 3), 1 - fs + 0.5 * (ss - 3))
        assert (r.panel, r.fs, r.ss, r.x, r.y) == ("ab"[ss >= 3], fs, ss, x, y)
        assert r.bad == (abs(x) <= 0.6 and abs(y) <= 1 or p in (18, 19))
    det = {r.pix: r for r in geometry.detector(spark, GEOMETRY, 20.0, 20.0).collect()}
    most = min(abs(f(getattr(r, k) for r in got.values())) for f in (max, min) for k in "xy")
    assert {p: r.mask for p, r in det.items()} == {p: 2 if r.bad else int((r.x**2 + r.y**2) ** 0.5 > most) for p, r in got.items()}
    r = det[0]
    norm = (r.x**2 + r.y**2 + 400) ** 0.5
    assert (r.qx, r.qz) == (pytest.approx(20 * r.x / norm), pytest.approx(20 * (20 / norm - 1)))
    for text, why in (("a/min_fs = 1", "lacks"), ("clen = 1", "no panels"), ("a/fs = 2w", "not a direction")):
        with pytest.raises(ValueError, match=why):
            geometry.parsed(text)


def test_moves_in_a_stream_are_those_of_the_batch(spark, tmp_path):
    from speckle.operators import analysis
    from speckle.streaming import frames as streaming

    log = tables.iter_log(spark, SF).filter("iteration <= 12 AND frame_id % 7 = 0").select("iteration", "frame_id", "rmax")
    rows = sorted(tuple(r) for r in log.collect())
    schema = "iteration int, frame_id long, rmax int"
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k, part in enumerate((rows[: len(rows) // 2], rows[len(rows) // 2 :], [(1, rows[0][1], 99)])):
            spark.createDataFrame(part[::-1], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            query = streaming.orientation_moves(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
            query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    want = analysis.changes(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.frame_id, r.iteration, r.moved) for r in got if not r.late) == sorted((r.frame_id, r.iteration, r.moved) for r in want) and want
    assert [(r.frame_id, r.iteration, r.moved) for r in got if r.late] == [(rows[0][1], 1, None)]
