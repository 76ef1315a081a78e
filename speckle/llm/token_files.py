"""Token-ID files: patched frame-of-reference blocks with exception lists and an index of block starts.

A shard is one file, or several of FILE_SEGMENTS segments, one after the other. A segment, all integers little-endian:

    "SPKTOK1\\0"; u64 shard, ids of the shard before this segment, documents, ids, blocks
    i64 doc_id and u64 ids, for each document
    u32 minimum, u8 width, u32 exceptions, for each block of 128 ids
    u64 start of each block in the blocks' bytes, and their end
    blocks: 128 residuals of `width` bits, then u8 places and u32 values of the residuals that are wider
    u32 crc32 of all before; "\\n"

The last byte is a line feed, so Spark's text writer, whose commits survive lost tasks and executors, can write
each segment as one line on any file system, and the binary reader reads a file back. Segments say how long they are.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speckle.llm import _common as c
from speckle.llm import _tokens

MAGIC = b"SPKTOK1\0"
BLOCK, PERCENTILE, SEGMENT_IDS = 128, 0.9, 1 << 20
#: Bytes of text that a shard holds on average, and segments that a file holds at most, so that a file is read as one row.
SHARD_BYTES, FILE_SEGMENTS = 16 << 20, 16
END = 1


def bits(x: np.ndarray) -> np.ndarray:
    """Bits that each value below 2^32 needs."""
    return np.frexp(x.astype(np.float64))[1]


def _pack(v: np.ndarray, width: int) -> np.ndarray:
    """(n, BLOCK) values of `width` bits as (n, BLOCK * width / 8) bytes."""
    out = np.zeros((len(v), BLOCK * width // 32), np.uint32)
    v = v.astype(np.uint64)
    for j in range(BLOCK if width else 0):
        word, at = divmod(j * width, 32)
        both = v[:, j] << np.uint64(at)
        out[:, word] |= both.astype(np.uint32)
        if at + width > 32:
            out[:, word + 1] |= (both >> np.uint64(32)).astype(np.uint32)
    return out.astype("<u4").view(np.uint8).reshape(len(v), -1)


def _unpack(b: np.ndarray, width: int) -> np.ndarray:
    w = np.ascontiguousarray(b).view("<u4").astype(np.uint64).reshape(len(b), -1)
    out = np.zeros((len(b), BLOCK), np.uint32)
    for j in range(BLOCK if width else 0):
        word, at = divmod(j * width, 32)
        x = w[:, word] >> np.uint64(at)
        if at + width > 32:
            x = x | (w[:, word + 1] << np.uint64(32 - at))
        out[:, j] = (x & np.uint64((1 << width) - 1)).astype(np.uint32)
    return out


def write_segment(shard: int, before: int, doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    n = -(-len(ids) // BLOCK)
    x = np.zeros((n, BLOCK), np.uint32)
    x.ravel()[: len(ids)] = ids
    if len(ids) % BLOCK:
        x[-1, len(ids) % BLOCK :] = ids[-1]
    low = x.min(1) if n else np.zeros(0, np.uint32)
    x -= low[:, None]
    width = bits(np.partition(x, int(np.ceil(PERCENTILE * BLOCK)) - 1, 1)[:, int(np.ceil(PERCENTILE * BLOCK)) - 1]).astype(np.int64) if n else np.zeros(0, np.int64)
    wide = bits(x) > width[:, None]
    exceptions = wide.sum(1)
    starts = np.concatenate([[0], np.cumsum(width * (BLOCK // 8) + 5 * exceptions)]).astype(np.int64)
    body = np.zeros(starts[-1], np.uint8)
    for w in np.unique(width):
        at = np.nonzero(width == w)[0]
        if w:
            body[starts[at][:, None] + np.arange(w * BLOCK // 8)] = _pack(np.where(wide[at], 0, x[at]), int(w))
    row, place = np.nonzero(wide)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    to = starts[row] + width[row] * (BLOCK // 8)
    body[to + nth] = place
    values = x[row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    body[(to + exceptions[row] + 4 * nth)[:, None] + np.arange(4)] = values
    data = b"".join([
        MAGIC, struct.pack("<5Q", shard, before, len(doc_ids), len(ids), n), doc_ids.astype("<i8").tobytes(), counts.astype("<u8").tobytes(),
        low.astype("<u4").tobytes(), width.astype(np.uint8).tobytes(), exceptions.astype("<u4").tobytes(), starts.astype("<u8").tobytes(), body.tobytes(),
    ])
    return data + struct.pack("<I", zlib.crc32(data))


def read_segments(data: bytes):
    """(shard, ids of the shard before, doc_ids, counts, ids) of each segment in a file's bytes; a damaged file raises ValueError."""
    at = 0
    while at < len(data):
        size = _length(data, at)
        yield _read(data[at : at + size])
        at += size


def _length(data: bytes, at: int) -> int:
    """Bytes of the segment that starts at `at`."""
    if data[at : at + 8] != MAGIC or len(data) < at + 48:
        raise ValueError("not a token file")
    _, _, docs, _, n = struct.unpack_from("<5Q", data, at + 8)
    end = 48 + 16 * docs + 9 * n + 8 * n
    if len(data) < at + end + 8:
        raise ValueError("not a whole token file")
    return end + 8 + struct.unpack_from("<Q", data, at + end)[0] + 5


def _read(data: bytes):
    if data[-1:] != b"\n" or struct.unpack("<I", data[-5:-1])[0] != zlib.crc32(data[:-5]):
        raise ValueError("not a whole token file")
    shard, before, docs, size, n = struct.unpack_from("<5Q", data, 8)
    at = 48

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(data, kind, count, at)
        at += x.nbytes
        return x

    doc_ids, counts, low, width, exceptions, starts = take("<i8", docs), take("<u8", docs), take("<u4", n), take("u1", n).astype(np.int64), take("<u4", n).astype(np.int64), take("<u8", n + 1).astype(np.int64)
    body = np.frombuffer(data, np.uint8, starts[-1], at)
    x = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width):
        rows = np.nonzero(width == w)[0]
        if w:
            x[rows] = _unpack(body[starts[rows][:, None] + np.arange(w * BLOCK // 8)], int(w))
    row = np.repeat(np.arange(n), exceptions)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    to = starts[row] + width[row] * (BLOCK // 8)
    values = np.ascontiguousarray(body[(to + exceptions[row] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").ravel() if len(row) else np.zeros(0, np.uint32)
    x[row, body[to + nth]] = values
    x += low[:, None]
    return shard, before, doc_ids, counts.astype(np.int64), x.ravel()[:size]


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end: int = END) -> None:
    """Token files of all rows of docs at `path`, in ascending doc_id; each document ends with the id `end`.

    Null and empty texts are the end id alone; a null doc_id comes first and is written as the least 64-bit integer;
    rows that share a doc_id follow each other in the order of their texts' hashes, then texts. A text of any length is
    written whole, in one segment. An empty table gives no segments; other columns are ignored.

    Shards are ranges of (doc_id, hash of the text), as many as the bytes of all texts ask for.
    """
    spark = docs.sparkSession

    def run(batches):
        from pyspark import TaskContext

        shard, before, held, size = TaskContext.get().partitionId(), 0, [], 0

        def segment():
            ids = np.concatenate([x for _, x in held])
            return pa.RecordBatch.from_arrays([pa.array([write_segment(shard, before, np.array([d for d, _ in held]), np.array([len(x) for _, x in held]), ids)], pa.binary())], ["segment"])

        for b in batches:
            doc, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for i, j in _tokens.blocks(texts):
                for d, x in zip(doc[i:j], _tokens.encode(tokenizer, texts[i:j]), strict=True):
                    held.append((d, np.append(x, np.uint32(end)).astype("<u4")))
                    size += len(x) + 1
                    if size >= SEGMENT_IDS:
                        yield segment()
                        before, held, size = before + size, [], 0
        if held:
            yield segment()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), c.text_or_empty().alias("text"))
    shards = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES))
    rows = rows.withColumn("th", F.xxhash64("text")).repartitionByRange(int(shards), "doc_id", "th").sortWithinPartitions("doc_id", "th", "text").drop("th")
    segments = rows.mapInArrow(run, "segment binary").select(F.col("segment").cast("string"))
    with c.arrow_batches(spark, rows=200, size="4m"):
        segments.write.option("maxRecordsPerFile", FILE_SEGMENTS).option("compression", "none").text(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files at `path`, and its ids if asked for."""

    def run(batches):
        for b in batches:
            for data in b.column("content"):
                for shard, before, doc_ids, counts, ids in read_segments(data.as_py()):
                    ends = np.cumsum(counts)
                    pieces = [ids[e - k : e].astype("<u4").tobytes() for e, k in zip(ends, counts, strict=True)]
                    cols = [pa.array([shard] * len(counts), pa.int64()), pa.array(doc_ids), pa.array(before + ends - counts), pa.array(counts), pa.array([zlib.crc32(x) for x in pieces], pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols + [pa.array(pieces, pa.binary())] * with_ids, names)

    names = ["shard", "doc_id", "place", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    with c.arrow_batches(spark, rows=1):
        rows = c.stored(files.mapInArrow(run, "shard long, doc_id long, place long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids), "token-rows")
    # One row for each shard, of which there are as many as partitions wrote.
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    bases = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))
    doc_id = F.when(F.col("doc_id") > -(1 << 63), F.col("doc_id"))
    return rows.join(c.small(bases), "shard").select(doc_id.alias("doc_id"), (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = c.scratch(spark, "token-files")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), _tokens.vocabulary("word_bpe_49k.json"), path)
    return read_tokens(spark, path)


QUERIES = {"op10_token_files": op10_token_files}
ORACLE: dict[str, str] = {}
