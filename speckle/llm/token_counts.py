"""Token counts by digest cache: stored counts are joined, only distinct misses are encoded and appended."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speckle.llm import _common as c
from speckle.llm import _tokens

LIMIT = 4096
CACHE = T.StructType([T.StructField("content", T.BinaryType()), T.StructField("tokenizer", T.StringType()), T.StructField("n_tokens", T.LongType())])


def token_counts(docs: DataFrame, tokenizer: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs, and new counts appended to the table at `cache`.

    Content is the text as it is, null as empty: any further normalising could change what the tokenizer counts.
    Its SHA-256 and that of the tokenizer's file are the cache's key. Rows whose content is stored are not
    encoded; of the others, copies are merged (before and after the shuffle, by digest and text) and each
    distinct text is encoded once. Repeated rows are rows of the result each; texts of any length are encoded whole. An
    empty table gives an empty result and appends nothing; other columns are ignored. `cache` is a Parquet folder on any
    file system that Spark writes; it may not exist yet, and outlives the session.
    """
    spark = docs.sparkSession
    version = _tokens.version(tokenizer)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), c.text_or_empty().alias("text"))
    rows = rows.withColumn("content", F.unhex(F.sha2("text", 256)))
    slim = c.stored(rows.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes")), "count-rows")
    distinct = rows.groupBy("content", "text").agg(F.lit(1))
    if (seen := _cached(spark, cache, version)) is not None:
        distinct = distinct.join(seen, "content", "left_anti")

    def count(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            n = [len(ids) for i, j in _tokens.blocks(texts) for ids in _tokens.encode(tokenizer, texts[i:j])]
            yield pa.RecordBatch.from_arrays([b.column("content"), pa.array(n, pa.int64())], ["content", "n_tokens"])

    new = distinct.select("content", "text").mapInArrow(count, "content binary, n_tokens long")
    with c.arrow_batches(spark):
        new.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    known = _cached(spark, cache, version).select("content", "n_tokens")
    stats = slim.groupBy("content").agg(F.count("*").alias("count"))
    out = c.spread_join(slim, known, "content", c.hot_keys(stats, "content", slim.count()))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _cached(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """Counts stored for this tokenizer version; a count that two runs appended is there once."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the cache at the folder that the setting speckle.token_cache names; if unset, with a new one of its own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, _tokens.vocabulary("piece_bpe_32k.model"), spark.conf.get("speckle.token_cache", None) or c.scratch(spark, "count-cache"))


QUERIES = {"op4_token_counts": op4_token_counts}
ORACLE: dict[str, str] = {}
