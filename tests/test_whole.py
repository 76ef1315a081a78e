"""Queries that cover every frame of the tables, against brute force and their SQL."""

from pathlib import Path

import duckdb
import pytest

from speckle.operators import known
from speckle.plans.catalog import ORACLE, QUERIES, _views
from speckle.sources import tables as tb

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def test_every_frame_is_predicted(spark, con):
    views = {}
    for v in _views(spark, SF).collect():
        views.setdefault((v.mode, v.r), {})[v.pix] = v.value
    ids = {r.frame_id for r in tb.frames(spark, SF).collect()}
    got = {}
    for r in QUERIES["frames_predicted"](spark, SF).collect():
        assert r.pix not in got.setdefault(r.frame_id, {})
        got[r.frame_id][r.pix] = r.value
    assert set(got) == ids and max(ids) >= 400
    assert all(got[i] == pytest.approx(views[i % 2, i % 12], abs=1e-8) for i in ids)
    every = con.sql(ORACLE["frames_predicted"]).fetchall()
    assert {i for i, _, _ in every} == ids and all(got[i][pix] == pytest.approx(value, abs=1e-8) for i, pix, value in every)


def test_every_frame_is_located(spark, con):
    files = sorted(r.file_id for r in tb.frames(spark, SF).collect())
    want = {k: (f, k - files.index(f)) for k, f in enumerate(files)}
    rows = QUERIES["frames_located"](spark, SF).collect()
    assert len(rows) == len(files) and {r.num: (r.file_id, r.local) for r in rows} == want
    assert {num: (f, local) for num, f, local in con.sql(ORACLE["frames_located"]).fetchall()} == want


def test_frames_without_lit_good_pixels_have_a_scale(spark):
    post = spark.createDataFrame([(k, 0, 0, 1.0) for k in (1, 2, 3)], "frame_id long, mode long, r long, p double")
    photons = spark.createDataFrame([(1, 0, 9), (3, 1, 9)], "frame_id long, pix int, cnt int")
    views = spark.createDataFrame([(0, 0, 0, 2.0), (0, 0, 1, 2.0)], "mode long, r long, pix int, value double")
    counts = spark.createDataFrame([(1, 9), (2, 0), (3, 0)], "frame_id long, fcount long")
    det = spark.createDataFrame([(0, 0, 0.5), (1, 1, 0.5)], "pix int, mask int, background double")
    phi = spark.createDataFrame([(k, 1.0, 1.0) for k in (1, 2, 3)], "frame_id long, phi double, bgscale double")
    got = {r.frame_id: r.phi for r in known.scale_background(photons, post, views, counts, det, phi).collect()}
    # 9 * 2 / (2 phi + 0.5) = 2 at phi 4.25
    assert got == {1: pytest.approx(4.25), 2: 0.001, 3: 0.001}


def test_background_scales_of_all_frames(spark):
    ids = {r.frame_id for r in tb.frames(spark, SF).filter("blacklist = 0").collect()}
    rows = QUERIES["scale_background"](spark, SF).collect()
    assert len(rows) == len(ids) and {r.frame_id for r in rows} == ids
