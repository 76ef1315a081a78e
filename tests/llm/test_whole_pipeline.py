"""What the pipeline hands on from stage to stage, and at its end."""

import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from speckle.llm import _tokens

SF = "/root/testdata/sf0.001"


def test_packing_stage_keeps_the_token_ids(spark):
    docs = spark.createDataFrame([(i, f"Line {i} of a text. " * (1 + 90 * i)) for i in range(12)], "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["packing"]
    got = sorted(stage(spark, docs, SF).collect(), key=lambda r: (r.sequence_id, r.offset))
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = {k: [*x, 0] for k, x in zip(texts, _tokens.encode(_tokens.vocabulary("byte_bpe_50k.json"), list(texts.values())))}
    have, at = {}, 0
    for r in got:
        assert r.sequence_id * 1024 + r.offset == at and r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
        assert r.start == len(have.setdefault(r.doc_id, []))
        have[r.doc_id].extend(np.frombuffer(r.ids, "<u4").tolist())
        at += r.length
    assert have == want and got[-1].sequence_id > 2


def test_every_stage_reads_what_the_one_before_it_wrote(spark, monkeypatch):
    read = []

    def stage(spark, docs, sf_dir):
        read.append(set(docs.inputFiles()))
        return docs.filter("doc_id % 2 = 0")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first one", stage), ("second", stage), ("third", stage)])
    out = corpus_pipeline.run(spark, SF)
    read.append(set(out.inputFiles()))
    assert all(read) and not any(a & b for i, a in enumerate(read) for b in read[:i])
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id % 2 = 0").count()


def test_run_ends_in_token_ids(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length for r in rows)


def odd_documents(spark):
    from test_llm_operators import CLASH, SCHEMA, TEXTS, prose

    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}", None) for i, t in enumerate(TEXTS + [prose(60) for _ in range(20)])]
    df = spark.createDataFrame([*rows, rows[7], (None, "no id", None, None, None), (None, None, None, None, None), (3, "another text of 3", "en", "s1", 5)], SCHEMA).repartition(3)
    for c in (*CLASH, "_near_id", "label", "start", "offset", "length", "sequence_id", "size", "taken"):
        df = df.withColumn(c, F.lit(c))
    return df


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows and ids, clashing names, and a table without rows."""
    for name, docs in (("odd", odd_documents(spark)), ("empty", odd_documents(spark).limit(0))):
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before = docs.count()
            stage(spark, docs, SF).write.parquet(str(tmp_path / f"{name}{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{k}"))
            if k < 4:
                assert docs.columns == columns
            if k < 3:
                assert docs.count() <= before
        assert (docs.count() > 0) == (name == "odd")


def test_stages_against_brute_force(spark):
    from test_llm_operators import brute_components, crc

    from speckle.llm import mixing, quality

    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    score = lambda t: model.scores(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]
    want = {r.doc_id: r.text or "" for r in docs.collect() if score(r.text or "") >= 0.5}
    docs = stages["quality"](spark, docs, SF).cache()
    assert {r.doc_id: r.text or "" for r in docs.collect()} == want

    strip = str.maketrans("", "", " \t\n\x0b\x0c\r")
    best = {}
    for i, t in want.items():
        key = (-len(t), i)
        best[t.translate(strip)] = min(best.get(t.translate(strip), key), key)
    want = {i: want[i] for _, i in best.values()}
    docs = stages["exact dedup"](spark, docs, SF).cache()
    assert {r.doc_id: r.text or "" for r in docs.collect()} == want

    ids = sorted(want)
    sizes, roots = brute_components([want[i] for i in ids], 5, 80)
    want = {i: want[i] for i in {ids[k] for k in roots}}
    docs = stages["near dedup"](spark, docs, SF).cache()
    assert {r.doc_id: r.text or "" for r in docs.collect()} == want

    plan = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    docs = stages["mixing"](spark, docs, SF).cache()
    have = {}
    for r in docs.collect():
        words = (r.text or "").encode().split()
        assert (want[r.doc_id] or "").encode().split()[: len(words)] == words
        have[r.doc_id] = have.get(r.doc_id, 0) + len(words)
    assert have == {k: v for k, v in plan.items() if v}

    tokens = {}
    for r in docs.collect():
        tokens.setdefault(r.doc_id, []).append(crc([*_tokens.encode(_tokens.vocabulary("byte_bpe_50k.json"), [r.text or ""])[0], 0]))
    pieces = {}
    for r in stages["packing"](spark, docs, SF).orderBy("sequence_id", "offset").collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for i, rows in pieces.items():
        ids, got = b"", []
        for r in rows:
            if r.start == 0 and ids:
                got.append(zlib.crc32(ids))
                ids = b""
            ids += r.ids
        assert sorted([*got, zlib.crc32(ids)]) == sorted(tokens[i])
    assert pieces.keys() == tokens.keys()
