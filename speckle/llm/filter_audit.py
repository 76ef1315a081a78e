"""Filter interaction audit: what each of five filters removes in every order, from counts of failure masks."""

from __future__ import annotations

import itertools
import json
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speckle.llm import _common as c
from speckle.llm._shingles import pieces

FILTERS = "ABCDE"
CAPITALS, SIGNS = bytes(range(65, 91)), b"#$%&*|"
#: Counters of the sketch for each text, hash functions, the least and greatest sketch, and the counters of one piece.
SLOTS, HASHES, LEAST, MOST, PIECE = 16, 3, 1 << 18, 1 << 30, 1 << 18
#: Positions that a task holds before it hands on its part of the sketch; parts that are merged first.
HELD, PARTS = 4 << 20, 256


def masks(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bits of filters A to D that each text fails: too short, repetitive, in capitals, with signs."""
    starts = (raw & 0xC0) != 0x80
    out = np.zeros(len(ends) - 1, np.int32)
    for i, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        text = raw[lo:hi].tobytes()
        n, distinct = 0, set()
        for piece in pieces(text):
            words = piece.split()
            n += len(words)
            distinct.update(words)
        capitals = len(text) - len(text.translate(None, CAPITALS))
        fails = (n < 50, 100 * len(distinct) < 65 * n, 100 * capitals > 5 * np.count_nonzero(starts[lo:hi]), len(text.translate(None, SIGNS)) < len(text))
        out[i] = sum(f << k for k, f in enumerate(fails))
    return out


def facts(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, sha) of every row of docs."""

    def run(batches):
        for b in c.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(masks(*c.flat_bytes(b.column("text"))))], ["doc_id", "part", "sha", "mask"])

    text = c.text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("sha"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, part string, sha binary, mask int")


def _positions(sha: np.ndarray, slots: int) -> np.ndarray:
    """The counters of each digest (rows of 32 bytes); slots is a power of two."""
    return (np.ascontiguousarray(sha).view("<u8")[:, :HASHES] & np.uint64(slots - 1)).astype(np.int64)


def _digests(col) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.uint8).reshape(-1, 32)


def sketch(rows: DataFrame, slots: int) -> np.ndarray:
    """A counting Bloom filter of the digests `sha`, as a bit for each counter that reached two.

    Every task counts its rows, up to two at a counter; the parts are added piece by piece, PARTS at a time first, so no
    merge holds more than a piece. Only bits reach the driver: MOST / 8 bytes at most.
    """

    def packed(at: np.ndarray, two: np.ndarray) -> bytes:
        return zlib.compress((at << 1 | two).astype("<u4").tobytes(), 1)

    def count(batches):
        from pyspark import TaskContext

        part, held, n = TaskContext.get().partitionId(), [], 0

        def out():
            at, times = np.unique(np.concatenate(held), return_counts=True)
            piece = at // PIECE
            cuts = np.concatenate([[0], np.nonzero(piece[1:] != piece[:-1])[0] + 1, [len(at)]]).tolist()
            data = [packed(at[i:j] % PIECE, times[i:j] > 1) for i, j in zip(cuts, cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(piece[cuts[:-1]]), pa.array([part // PARTS] * len(data), pa.int64()), pa.array(data, pa.binary())], ["piece", "part", "data"])

        for b in batches:
            if len(b):
                held.append(_positions(_digests(b.column("sha").to_pylist()), slots).ravel())
                if (n := n + len(held[-1])) > HELD:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    def added(t: pa.Table) -> np.ndarray:
        total = np.zeros(PIECE, np.uint8)
        for d in t.column("data"):
            x = np.frombuffer(zlib.decompress(d.as_py()), "<u4")
            total[x >> 1] = np.minimum(total[x >> 1] + 1 + (x & 1), 2)
        return total

    def merge(key, t):
        total = added(t)
        at = np.nonzero(total)[0]
        return pa.table({"piece": [key[0].as_py()], "part": pa.array([0], pa.int64()), "data": [packed(at, total[at] > 1)]})

    def bits(key, t):
        return pa.table({"piece": [key[0].as_py()], "bits": [zlib.compress(np.packbits(added(t) > 1).tobytes(), 1)]})

    schema = "piece long, part long, data binary"
    parts = rows.select("sha").mapInArrow(count, schema).groupBy("piece", "part").applyInArrow(merge, schema)
    whole = np.zeros(slots // 8, np.uint8)
    for r in parts.groupBy("piece").applyInArrow(bits, "piece long, bits binary").toLocalIterator():
        part = whole[r.piece * PIECE // 8 :][: PIECE // 8]
        part[:] = np.frombuffer(zlib.decompress(r.bits), np.uint8)[: len(part)]
    return whole


def possible_repeat(rows: DataFrame, texts: int, most: int = MOST):
    """A column function of `sha`: false only where no other row has this digest."""
    slots = min(most, max(LEAST, 1 << (SLOTS * max(1, texts) - 1).bit_length()))
    shared = rows.sparkSession.sparkContext.broadcast(sketch(rows, slots))

    @F.pandas_udf("boolean")
    def probe(sha: pd.Series) -> pd.Series:
        at = _positions(_digests(sha), slots)
        return pd.Series(((shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1))

    return probe


def repeats(docs: DataFrame, rows: DataFrame, most: int = MOST) -> DataFrame:
    """rows with the bit of filter E set where a row of a smaller doc_id has the same text.

    Texts that the sketch shows to be unique are neither shuffled nor compared. Of the others the least doc_id of each
    whole text is found by an aggregation that merges copies before it shuffles, and joined by the text's SHA-256.
    """
    total = rows.count()
    probe = possible_repeat(rows, total, most)
    text = c.text_or_empty()
    maybe = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("sha", F.unhex(F.sha2("text", 256))).filter(probe("sha"))
    least = maybe.groupBy("text").agg(F.min("doc_id").alias("least"), F.count("*").alias("count")).filter("count > 1")
    least = c.stored(least.select(F.unhex(F.sha2("text", 256)).alias("sha"), "least", "count"), "audit-repeats")
    flagged = c.stored(rows.withColumn("maybe", probe("sha")), "audit-flagged")
    joined = c.spread_join(flagged.filter("maybe").drop("maybe"), least.drop("count"), "sha", c.hot_keys(least, "sha", total), "left")
    late = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    found = joined.withColumn("mask", F.col("mask") + F.when(late, 1 << FILTERS.index("E")).otherwise(0)).select(*rows.columns)
    return flagged.filter("NOT maybe").select(*rows.columns).union(found)


def steps() -> list[dict]:
    """Every place of every order: its filter's bit, and the bits of those before it."""
    bit = lambda x: 1 << FILTERS.index(x)
    return [
        {"filter_order": "".join(o), "step": k + 1, "own": bit(o[k]), "before": sum(map(bit, o[:k]))}
        for o in itertools.permutations(FILTERS) for k in range(len(o))
    ]


def audit(counted: DataFrame) -> DataFrame:
    """The audit from (part, mask, n, good, toxic): additive counts, 32 rows a part at most."""
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    kind = "array<struct<filter_order:string,step:int,own:int,before:int>>"
    at = parts.select("part", "masks", F.explode(F.from_json(F.lit(json.dumps(steps())), kind)).alias("s")).select("part", "masks", "s.*")

    def total(value, when):
        return F.aggregate("masks", F.lit(0).cast("long"), lambda acc, x: acc + F.when(when(x["mask"]), value(x)).otherwise(0))

    own, before = F.col("own"), F.col("before")
    fails = lambda m, bits: m.bitwiseAND(bits) != 0
    first = lambda m: fails(m, own) & ~fails(m, before)
    orders = 1
    for k in range(2, len(FILTERS) + 1):
        orders *= k
    n = lambda x: x["n"]
    # of the filters that a document fails each comes first in as many orders
    share = lambda x: x["n"] * (F.lit(orders) / F.bit_count(x["mask"])).cast("long")
    return at.select(
        "part", "filter_order", "step",
        total(n, lambda m: ~fails(m, own.bitwiseOR(before))).alias("kept"), total(n, first).alias("removed"),
        total(n, lambda m: fails(m, own) & fails(m, before)).alias("redundant"), total(n, lambda m: m == own).alias("unique_fails"),
        total(lambda x: x["good"], first).alias("good_lost"), total(lambda x: x["toxic"], first).alias("toxic_lost"), total(share, lambda m: fails(m, own)).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows a part.

    Null text is empty (short, and equal to other empty ones), null source the part ''. A row without a doc_id has no
    smaller one and no label; rows that repeat count each, and rows that repeat id and text are no copies of each other.
    Of several labels of a document any positive one holds. Texts of any length are read whole; an empty table gives an
    empty result; other columns are ignored. `most` bounds the sketch: past it more unique texts are compared, and
    nothing else changes.
    """
    with c.arrow_batches(docs.sparkSession, size="8m"):
        rows = c.stored(facts(docs), "audit-facts")
        masked = c.stored(repeats(docs, rows, most).select("doc_id", "part", "mask"), "audit-masks")
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic")
    )
    held = masked.join(known, "doc_id", "left").groupBy("part", "mask")
    return audit(held.agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op11_filter_audit": op11_filter_audit}
ORACLE = {
    "op11_filter_audit": r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
f AS (
  SELECT doc_id, part, CAST(len(w) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT)
    + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS INT)
    + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > least, false) AS INT) AS mask FROM w),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
b AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS b(l, bit)),
o AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM b a JOIN b ON b.l <> a.l JOIN b c ON c.l NOT IN (a.l, b.l) JOIN b d ON d.l NOT IN (a.l, b.l, c.l) JOIN b e ON e.l NOT IN (a.l, b.l, c.l, d.l)),
s AS (SELECT filter_order, k AS step, bits[k] AS own, CAST(coalesce(list_sum(bits[1:k - 1]), 0) AS INT) AS before FROM o, unnest(range(1, 6)) AS u(k)),
x AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & own > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM x
"""
}
