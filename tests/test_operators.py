import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from speckle.operators import analysis, frames, maximize, orientation, simulate, views
from speckle.plans import emc as plan
from speckle.sources import emc, tables, texts
from speckle.streaming import frames as stream

SF = "/root/testdata/sf0.001"


def test_uniform_rotations():
    for n in (1, 2, 4):
        q = orientation.uniform(n)
        assert len(q) == 10 * (5 * n**3 + n)
        assert np.allclose(np.linalg.norm(q[:, :4], axis=1), 1) and np.isclose(q[:, 4].sum(), 1)
    assert len({tuple(np.round(x, 6)) for x in orientation.uniform(2)[:, :4]}) == 420


@pytest.mark.parametrize("group,n", [(orientation.icosahedral_group(), 60), (orientation.octahedral_group(), 24)])
def test_groups_are_closed(group, n):
    m = [orientation.matrix(q) for q in group]
    assert len(m) == n
    for a in m[:7]:
        for b in m[::5]:
            assert min(np.abs(a @ b - c).max() for c in m) < 1e-9


def test_reduced_set_is_one_part_of_the_group():
    q = orientation.uniform(6)
    kept = orientation.reduced(q, orientation.icosahedral_group())
    assert len(q) / 60 <= len(kept) < 2 * len(q) / 60 and np.isclose(kept[:, 4].sum(), 1)


def test_matrix_agrees_with_expressions(spark):
    q = orientation.random_unit(1, 3)[0]
    m = spark.createDataFrame([tuple(map(float, q))], "q0 double, q1 double, q2 double, q3 double").select(*[e.alias(f"e{i}{j}") for i, r in enumerate(views.rotation_matrix()) for j, e in enumerate(r)]).first()
    assert np.allclose(np.array(m).reshape(3, 3), orientation.matrix(q))


def test_views_of_a_linear_model_are_exact(spark):
    size = 9
    cube = spark.range(size**3).select(F.col("id").alias("vox"), (F.floor(F.col("id") / 81) * 2.0 + 1).alias("intens"), F.lit(0).cast("long").alias("mode"))
    rot = spark.createDataFrame([(0, 1.0, 0.0, 0.0, 0.0, 1.0)], "r long, q0 double, q1 double, q2 double, q3 double, w double")
    det = spark.createDataFrame([(0, 1.25, 0.5, -0.5, 1.0, 0), (1, 99.0, 0.0, 0.0, 1.0, 0), (2, 0.0, 0.0, 0.0, 1.0, 2)], "pix int, qx double, qy double, qz double, corr double, mask int")
    got = {r.pix: r.value for r in views.views(views.coords3d(rot, det, size), cube, size).collect()}
    assert got == {0: pytest.approx(5.25 * 2 + 1), 1: views.TINY}


def test_friedel_leaves_the_first_planes_of_even_sizes(spark):
    m = spark.range(16).select(F.col("id").alias("vox"), F.col("id").cast("double").alias("intens"))
    got = {r.vox: r.intens for r in views.friedel(m, 4, 2).collect()}
    assert got[0] == 0 and got[3] == 3 and got[12] == 12 and got[5] == got[15] == 10 and got[10] == 10


def test_background_tomogram_solves_its_equation(spark):
    post = spark.createDataFrame([(1, 0, 0, 0.0, 0.7, 0.0), (2, 0, 0, 0.0, 1.0, 0.0)], "frame_id long, mode long, r long, logl double, p double, best double")
    photons = spark.createDataFrame([(1, 0, 3), (2, 0, 1), (2, 1, 1)], "frame_id long, pix int, cnt int")
    phi = spark.createDataFrame([(1, 1.0, 0.5), (2, 2.0, 0.5)], "frame_id long, phi double, bgscale double")
    det = spark.createDataFrame([(0, 0, 0.2), (1, 0, 0.0), (2, 0, 0.2), (3, 2, 0.2)], "pix int, mask int, background double")
    got = {r.pix: r.value for r in maximize.tomograms_background(post, photons, phi, det).collect()}
    w = got[0]
    assert 0.7 * 3 / (w + 0.1) + 2 * 1 / (2 * w + 0.1) == pytest.approx(0.7 + 2.0)
    assert got[1] == pytest.approx(1.0 / 2.7) and got[2] == 0 and 3 not in got


def test_scales_and_models_make_up_for_each_other(spark):
    phi = spark.createDataFrame([(1, 1.0), (2, 3.0)], "frame_id long, phi double")
    model = spark.createDataFrame([(0, 0, 5.0)], "mode long, vox long, intens double")
    p, m = maximize.normalised_scales(phi, model)
    assert sorted(r.phi for r in p.collect()) == [0.5, 1.5] and m.first().intens == 10.0


def test_log_factorial(spark):
    got = spark.range(6).select(frames.log_factorial(F.col("id").cast("int")).alias("v")).collect()
    assert [round(np.exp(r.v)) for r in got] == [1, 1, 2, 6, 24, 120]


def test_frames_without_photons_are_counted(spark):
    det = tables.detector(spark)
    f = spark.createDataFrame([(1, 0), (2, 1)], "frame_id long, blacklist int")
    p = spark.createDataFrame([(1, 27, 2), (1, 0, 5)], "frame_id long, pix int, cnt int")
    masks = {r.pix: r.mask for r in det.collect()}
    assert set(masks.values()) == {0, 1, 2}
    assert {r.frame_id: r.fcount for r in frames.frame_counts(p, f, det).collect()} == {1: sum(c for x, c in ((27, 2), (0, 5)) if masks[x] == 0), 2: 0}


def test_reconstruction_loop(spark, tmp_path):
    log = plan.reconstruct(spark, SF, 2, str(tmp_path))
    assert [r["iteration"] for r in log] == [1, 2] and all(np.isfinite(r["rms_change"]) for r in log)
    assert spark.read.parquet(f"{tmp_path}/model").groupBy("iteration").count().count() == 3


def test_emc_files(spark, tmp_path):
    spark.dataSource.register(emc.EmcSource)
    rows = [(k, [k, k + 1] if k % 3 else [], [5] if k % 2 else [], [k + 2] if k % 2 else []) for k in range(25)]
    df = spark.createDataFrame(rows, emc.SPARSE_SCHEMA).repartitionByRange(3, "frame_id")
    df.write.format("emc").option("path", str(tmp_path / "x")).option("num_pix", 64).mode("append").save()
    back = spark.read.format("emc").option("frames", 4).load(str(tmp_path / "x"))
    assert sorted(map(tuple, back.collect())) == rows
    assert not emc.is_hdf5(str(next((tmp_path / "x").glob("*.emc"))))


def sparse_rows(n):
    return [(k, [k, k + 1] if k % 3 else [], [5] * (k % 4), [k + 2] * (k % 4)) for k in range(n)]


def test_a_lookup_opens_one_range(spark, tmp_path):
    spark.dataSource.register(emc.EmcSource)
    frames = sparse_rows(57)
    for k, (lo, hi) in enumerate(((0, 30), (30, 57))):
        emc.write(str(tmp_path / f"part-{k}.emc"), 64, [x[1:] for x in frames[lo:hi]])
    read = lambda ids: spark.read.format("emc").option("frames", 8).option("ids", ids).load(str(tmp_path))
    for ids, want in (("33", [33]), ("2,31,99", [2, 31]), ("28-31, 30-33,5", [5, *range(28, 34)]), ("99", []), ("", []), ("0-99", range(57))):
        assert sorted(tuple(r) for r in read(ids).collect()) == [frames[i] for i in want]
    assert read("33").rdd.getNumPartitions() == 1 and read("0-99").rdd.getNumPartitions() == 8
    (part,) = emc._Reader([str(tmp_path / f"part-{k}.emc") for k in (0, 1)], 8, "33").partitions()
    assert (part.lo, part.hi, part.first) == (3, 4, 30) and [x.tolist() for x in next(emc.rows(part))] == list(frames[33][1:])


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_one_ordered_file_from_many_tasks(spark, tmp_path, parts):
    spark.dataSource.register(emc.EmcSource)
    frames = sparse_rows(41)
    emc.write(str(tmp_path / "whole.emc"), 64, [x[1:] for x in frames])
    df = spark.createDataFrame(frames, emc.SPARSE_SCHEMA).repartition(5)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df.repartitionByRange(parts, "frame_id").write.format("emc").option("path", str(tmp_path / "x")).option("num_pix", 64).mode("append").save()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert emc.single_file(spark, str(tmp_path / "x"), str(tmp_path / "one.emc"), copied=16) == 41
    assert emc.write_single(df, str(tmp_path / "two.emc"), 64) == 41 and not (tmp_path / "two.emc.parts").exists()
    want = (tmp_path / "whole.emc").read_bytes()
    assert (tmp_path / "one.emc").read_bytes() == want == (tmp_path / "two.emc").read_bytes()


def test_dense_emc_files(tmp_path):
    head = np.zeros(256, "<i4")
    head[:3] = 2, 3, emc.DOUBLE
    (tmp_path / "d.emc").write_bytes(head.tobytes() + np.arange(6.0).tobytes())
    assert [x[0].tolist() for x in emc.frames(str(tmp_path / "d.emc"), 1, 9)] == [[3.0, 4.0, 5.0]]


def test_texts(spark, tmp_path):
    (tmp_path / "det.dat").write_text("2 20.0 20.0\n0.1 0.2 0.3 1.0 0\n1 2 3 0.5 2\n")
    assert texts.detector_header(spark, str(tmp_path / "det.dat")) == {"num_pix": 2, "distance": 20.0, "radius": 20.0}
    assert [tuple(r) for r in texts.detector(spark, str(tmp_path / "det.dat")).orderBy("pix").collect()] == [(0, 0.1, 0.2, 0.3, 1.0, 0), (1, 1.0, 2.0, 3.0, 0.5, 2)]
    (tmp_path / "log").write_text("Iter time\n1 2.5 0.1 3.0 -4e2 420 0.01\n2 2.5 nan 3.0 -4e2 420 0.01\n")
    got = texts.log(spark.read.text(str(tmp_path / "log"))).orderBy("iteration").collect()
    assert got[0].num_rot == 420 and got[0].log_likelihood == -400 and np.isnan(got[1].rms_change)
    assert texts.resumed(spark, str(tmp_path / "log")) == 3 and texts.resumed(spark, str(tmp_path / "none")) == 1
    (tmp_path / "q").write_text("2\n1 0 0 0\n0 1 0 0\n")
    q = orientation.from_text(texts.numbered(spark, str(tmp_path / "q"))).collect()
    assert [(r.r, r.q0, r.w) for r in q] == [(0, 1.0, 0.5), (1, 0.0, 0.5)]


def test_config():
    text = "[a]\nout = det.h5\n[emc]\nin_detector_file = a:::out\nlog = b:::x\nnum_div = 4\nneed_scaling = 1\nbeta_schedule = 1.4 10\n[b]\nx = a:::out\n"
    p = texts.params(text)
    assert p.num_div == 4 and p.need_scaling and (p.beta_jump, p.beta_period) == (1.4, 10) and p.files == {"in_detector_file": "det.h5"}
    with pytest.raises(ValueError):
        texts.config("[a]\nx = a:::y\ny = a:::x\n")


def _atom(x, y, z, occ, alt, element, kind="ATOM  "):
    return f"{kind}{1:5d}  CA {alt}ALA A   1    {x:8.3f}{y:8.3f}{z:8.3f}{occ:6.2f}{0:6.2f}          {element:>2}"


def test_atoms_to_density(spark):
    lines = [_atom(0, 0, 0, 1, " ", "C"), _atom(2, 0, 0, 0.5, "A", "N"), _atom(9, 9, 9, 0.5, "B", "N"), _atom(9, 9, 9, 0.3, " ", "N"), "REMARK 350   BIOMT1   1  1.000000  0.000000  0.000000        1.50000", "REMARK 350   BIOMT2   1  0.000000  1.000000  0.000000        0.00000", "REMARK 350   BIOMT3   1  0.000000  0.000000  1.000000        0.00000"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    a = simulate.atoms(df)
    assert sorted((r.x, r.element) for r in a.collect()) == [(0.0, "C"), (2.0, "N")]
    moved = simulate.copies(a, simulate.symmetry(df))
    assert sorted(r.x for r in moved.collect()) == [1.5, 3.5]
    table = spark.createDataFrame([("C", 100.0, 4.0), ("C", 200.0, 6.0), ("N", 100.0, 7.0), ("N", 200.0, 7.0)], "element string, energy double, f0 double")
    got = simulate.density(simulate.scattering(a, table, 150.0), 1.0, 7).collect()
    assert sum(r.value for r in got) == pytest.approx(12.0) and len(got) >= 2


def test_simulation_does_not_depend_on_partitions(spark):
    det = tables.detector(spark).toPandas()
    cube = np.random.default_rng(0).random((13, 13, 13))
    one = simulate.simulated(spark, 40, cube, det, 30.0).toPandas()
    assert 15 < one.groupby("frame_id")["cnt"].sum().mean() < 45
    two = simulate.simulated(spark, 40, cube, det, 30.0).repartition(7).toPandas()
    key = ["frame_id", "pix"]
    assert one.sort_values(key).reset_index(drop=True)[["pix", "cnt"]].equals(two.sort_values(key).reset_index(drop=True)[["pix", "cnt"]])


def test_volumes_by_fourier():
    d = np.zeros((5, 5, 5))
    d[2, 2, 2] = 2
    assert np.allclose(analysis.intensities(d, 9), 4)
    assert 0 < analysis.low_passed(d, -0.1).sum() <= 2.1


def test_embeddings():
    x = np.array([0.0, 1.0, 3.0, 7.0])
    y = analysis.embedding(np.abs(x[:, None] - x), 1)[:, 0]
    assert np.allclose(np.abs(y[:, None] - y), np.abs(x[:, None] - x))
    s = analysis.embedding(np.array([[1, 1, 0.01, 0], [1, 1, 0, 0], [0.01, 0, 1, 1], [0, 0, 1, 1.0]]), 1, "spectral")[:, 0]
    assert (s[0] > 0) == (s[1] > 0) != (s[2] > 0) == (s[3] > 0)


def test_streams(spark, tmp_path):
    p = pd.DataFrame({"frame_id": [1, 1, 2], "pix": [0, 3, 3], "cnt": [1, 2, 4]})
    spark.createDataFrame(p).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("frame_id long, pix long, cnt long").parquet(str(tmp_path / "in"))
    assert {r.pix: r.total for r in stream.run_to_end(stream.running_powder(s), "powder", "complete").collect()} == {0: 1, 3: 6}
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("Iter\n7 1 1 1 1 1 1\n")
    assert [r.iteration for r in stream.run_to_end(stream.log_rows(spark, str(tmp_path / "logs")), "logs", "append").collect()] == [7]
