"""Packing by concatenate and cut: prefix sums of partition totals, fixed windows, boundary records."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speckle.llm import _common as c
from speckle.llm import _tokens

LENGTH, END = 1024, 0
#: Rows, bytes and pieces of a batch of the second pass, which holds ids on both sides.
CUT_ROWS, CUT_BYTES, CUT_PIECES = 100, 2 << 20, 256
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """One boundary record for each piece of a document in a sequence of `length` tokens.

    Documents lie end to end in the order they are read, each followed by the id `end`, and are cut every
    `length` ids, so only the last sequence is padded. Columns: doc_id, start (ids of the document before the
    piece), length, ids_crc32, doc_tokens, sequence_id, offset (in the sequence), and `ids` (little-endian
    unsigned 32-bit) if with_ids. Null and empty texts are the end id alone; repeated rows are packed each; an
    empty table gives no pieces; other columns are ignored.

    First pass: encode once, store ids with their place in the partition. Then the partitions' totals, a row
    each, are summed up, and the second pass cuts at global offsets.
    """
    spark = docs.sparkSession

    def encode(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for i, j in _tokens.blocks(texts):
                ids = [np.append(x, np.uint32(end)).astype("<u4") for x in _tokens.encode(tokenizer, texts[i:j])]
                n = np.array([len(x) for x in ids], np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                short = max((int(x.max()) for x in ids), default=0) < 1 << 16
                data = [x.astype("<u2").tobytes() if short else x.tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), pa.array([part] * (j - i), pa.int64()), pa.array(starts), pa.array(n), pa.array([short] * (j - i)), pa.array(data, pa.binary())],
                    ["doc_id", "part", "start", "n", "short", "ids"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with c.arrow_batches(spark, rows=500):
        stored = c.stored(rows.mapInArrow(encode, "doc_id long, part long, start long, n long, short boolean, ids binary"), "packed-ids")
    # One row for each partition of the first pass.
    totals = stored.groupBy("part").agg(F.sum("n").alias("total"))
    bases = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))

    def cut(batches):
        def made(out):
            cols = [pa.array(x, pa.int64()) for x in out[:7]] + ([pa.array(out[7], pa.binary())] if with_ids else [])
            return pa.RecordBatch.from_arrays(cols, names)

        for b in c.slices(batches, "ids", CUT_ROWS, CUT_BYTES):
            out = [[] for _ in range(8)]
            for doc, at, n, short, data in zip(*(b[k].to_pylist() for k in ("doc_id", "at", "n", "short", "ids")), strict=True):
                ids = np.frombuffer(data, "<u2" if short else "<u4")
                edges = [at, *range((at // length + 1) * length, at + n, length), at + n]
                for lo, hi in zip(edges, edges[1:]):
                    piece = ids[lo - at : hi - at].astype("<u4").tobytes()
                    for to, x in zip(out, (doc, lo - at, hi - lo, zlib.crc32(piece), n, lo // length, lo % length, piece)):
                        to.append(x)
                    if len(out[0]) == CUT_PIECES:
                        yield made(out)
                        out = [[] for _ in range(8)]
            if out[0]:
                yield made(out)

    schema = PIECE + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    placed = stored.join(c.small(bases), "part").select("doc_id", (F.col("base") + F.col("start")).alias("at"), "n", "short", "ids")
    return placed.mapInArrow(cut, schema)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), _tokens.vocabulary("byte_bpe_50k.json"))


QUERIES = {"op1_packing": op1_packing}
ORACLE: dict[str, str] = {}
