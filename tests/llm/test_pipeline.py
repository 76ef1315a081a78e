"""The pipeline's stages over the smallest tables, and the queries against their SQL."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from speckle.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids and ids <= before
        before = ids
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact dedup", "near dedup", "mixing", "packing"]
    assert {"sequence_id", "offset", "length"} <= set(docs.columns)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df, rel = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(rel.columns)
    mine = sorted(tuple(r[c] for c in order) for r in df.collect())
    at = [rel.columns.index(c) for c in order]
    theirs = sorted(tuple(r[i] for i in at) for r in rel.fetchall())
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        assert all(x == y or (isinstance(x, float) and abs(x - y) < 1e-9 * max(1, abs(y))) for x, y in zip(a, b)), (a, b)
