"""Helpers shared by the operators: scratch tables, hot-key joins, Arrow text access, components."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key is hot when it holds at least this share of all rows, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 1000
#: Into how many parts a hot key is dealt.
SALTS = 32


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; in local mode a temporary one if unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="speckle-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def drop(*tables: DataFrame) -> None:
    """Delete stored() tables, wherever they are; only those that no result reads any more."""
    for t in tables:
        spark = t.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._scratch_path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return back


class arrow_batches:
    """Bounds the Arrow batches that texts travel in, by rows and by bytes, for the plans that run within.

    For what runs at once; a lazy result runs under the session's own settings, and its functions use slices().
    """

    def __init__(self, spark: SparkSession, rows: int = 1000, size: str = "16m"):
        self.spark, self.wanted = spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}

    def __enter__(self):
        self.before = {k: self.spark.conf.get(k, None) for k in self.wanted}
        for k, v in self.wanted.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_):
        for k, v in self.before.items():
            if v is None:
                self.spark.conf.unset(k)
            else:
                self.spark.conf.set(k, v)


def slices(batches, column: str, rows: int = 500, size: int = 8 << 20):
    """The batches cut to at most so many rows and about so many bytes of one column, a row at least."""
    for b in batches:
        _, ends = flat_bytes(b.column(column))
        lo = 0
        while lo < len(b):
            hi = max(lo + 1, min(lo + rows, int(np.searchsorted(ends, ends[lo] + size, "right")) - 1))
            yield b.slice(lo, hi - lo)
            lo = hi


def hot_keys(counts: DataFrame, key: str, total: int, count: str = "count") -> DataFrame:
    """Keys that hold at least HOT_SHARE of all rows: at most 1 / HOT_SHARE of them, so they can be broadcast."""
    return counts.filter(F.col(count) >= max(1000, total * HOT_SHARE)).select(key)


def spread_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """Equi-join on one non-null key; left rows of hot keys are dealt to SALTS parts, the right rows copied to each.

    right has few rows for a key. hot has at most 1 / HOT_SHARE keys (hot_keys()).
    """
    flag = F.broadcast(hot.select(F.col(key).alias("_hot_key"), F.lit(True).alias("_hot")))
    salted = left.join(flag, F.col(key) == F.col("_hot_key"), "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    ).drop("_hot", "_hot_key")
    copied = right.join(flag, F.col(key) == F.col("_hot_key"), "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    ).drop("_hot", "_hot_key")
    return salted.join(copied, [key, "_salt"], how).drop("_salt")


def small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """df, to be broadcast if it has at most so many rows of a few numbers; else Spark joins it as it finds fit."""
    return df if df.limit(rows + 1).count() > rows else F.broadcast(df)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for df that none of its own clashes with, in any case of letters."""
    taken, out = {x.lower() for x in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def running(parts: DataFrame, group: list[str], at: str, size: str, out: str, step: int = 1024) -> DataFrame:
    """Adds `out`: the sum of `size` over the group's rows of a lesser number `at`, which is not negative.

    Sums of `step` numbers each come first, so no task orders more than these sums, or the rows of one of them.
    """
    coarse = parts.withColumn("_step", F.floor(F.col(at) / step))
    sums = coarse.groupBy(*group, "_step").agg(F.sum(size).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*group, "_step", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*group, "_step").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    x = coarse.join(base, [*group, "_step"])
    return x.withColumn(out, F.col("_base") + F.coalesce(F.sum(size).over(inside), F.lit(0))).drop("_step", "_base")


def text_or_empty(col: Column | str = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def flat_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column end to end, and the n + 1 offsets of its rows; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links: (node, component), component the least node reachable.

    Alternates large-star and small-star steps; each step is two aggregations and a join, checkpointed,
    and ends when no link changes. A node of very many links is pre-aggregated and its rows dealt out.
    """
    spark = links.sparkSession
    checkpoint_dir(spark)
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    n = edges.count()
    if not n:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        stats = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("count"))
        least = stats.select("u", F.least("u", "m").alias("m"))
        hot = hot_keys(stats, "u", 2 * n)
        # large-star: every larger neighbour of u is linked to the least of u's neighbourhood
        large = spread_join(both, least, "u", hot).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = large.checkpoint()
        # small-star: every smaller neighbour of u, and u, are linked to the least of them
        stats = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("count"))
        down = spread_join(large, stats.select("u", "m"), "u", hot_keys(stats, "u", n))
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).union(stats.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = small.checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark, n = tuple(now), now[0]
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
