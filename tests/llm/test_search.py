"""Vector search over rows that a sample tells little of: the nearest by brute force are found throughout."""

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from speckle.llm import ann


def unlike(r, n, d):
    """Rows in tight clusters, queries anywhere."""
    near = np.repeat(r.normal(size=(30, d)), n // 30 + 1, 0)[:n] + 0.05 * r.normal(size=(n, d))
    return np.where((np.arange(n) % 20 == 0)[:, None], r.normal(size=(n, d)), near)


def lengths(r, n, d):
    """Lengths with a heavy tail."""
    x = r.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1)[:, None] * (r.pareto(1.2, n) + 1)[:, None]


def offset(r, n, d):
    """Small differences beside a common mean."""
    return 1 + 0.01 * r.normal(size=(n, d))


def scales(r, n, d):
    """Lengths whose squares leave the range of a double, and copies."""
    x = r.normal(size=(n, d)) * np.where(np.arange(n) % 3 == 0, 1e-170, 1e140)[:, None]
    x[n // 2 : n // 2 + 60] = x[n // 2]
    return x


def nearest(x, q, k=20):
    score = (x * x[q]).sum(1)
    score[q] = -np.inf
    return [(i, score[i]) for i in np.lexsort([np.arange(len(x)), -score])[:k].tolist()]


@pytest.mark.parametrize("rows", [unlike, lengths, offset, scales])
def test_registered_search_misses_nothing(spark, tmp_path, rows):
    x = rows(np.random.default_rng(4), 3000, 32)
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x))}), tmp_path / "embeddings.parquet")
    got = defaultdict(list)
    for r in sorted(ann.op2_ann(spark, str(tmp_path)).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    assert dict(got) == {q: nearest(x, q) for q in range(0, len(x), 20)}


def test_check_adds_what_few_probes_miss(spark):
    """Cells dealt to several blocks, queries dealt to parts, hardly a cell probed."""
    x = np.random.default_rng(5).normal(size=(700, 8))
    v = ann.usable(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>"), "id", "vec")
    few = {"k": 10, "cells": 6, "probes": 1, "shortlist": 10, "block_rows": 50, "block_queries": 7}
    want = {(q, i) for q in range(0, 700, 20) for i, _ in nearest(x, q, 10)}
    assert {(r.query_id, r.vec_id) for r in ann.search(v.filter("id % 20 = 0"), v, **few).collect()} == want
    some = {(r.query_id, r.vec_id) for r in ann.search(v.filter("id % 20 = 0"), v, exact=False, **few).collect()}
    assert 0 < len(some & want) < len(want) == 350


def test_rows_that_repeat_an_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [2.0, 0.0]), (0, [1.0, 0.0, 0.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (1, [4.0, 1.0]), (2, [5.0, 0.0, 0.0])]
    v = ann.usable(spark.createDataFrame(rows, "id long, vec array<double>"), "id", "vec")
    got = ann.search(v.filter("id = 0"), v).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 1, 4.0), (0, 2, 1, 3.0), (0, 3, 1, 3.0)]
