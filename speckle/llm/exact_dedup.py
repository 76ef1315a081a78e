"""Exact deduplication: groups by a 128-bit content hash, bytes compared inside the groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speckle.llm import _common as c

SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column | str = "text") -> Column:
    """The text without ASCII white space; null is empty."""
    return F.regexp_replace(c.text_or_empty(text), SPACE, "")


def exact_groups(docs: DataFrame, hashed=F.md5) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs.

    Rows are equal when their normalised texts are the same bytes. Of equal rows the one with the most code
    points in its original text stays, ties to the smallest doc_id; of repeated rows with that same doc_id all
    are marked kept, and exact_dedup() leaves one. Rows without a doc_id stay only where no equal row has one. Null
    text is empty text, and texts may be of any length; an empty table gives an empty result; other columns are ignored.

    Texts are shuffled once, and copies are merged before that: the aggregation's key is (hash, text), so a
    group of any size sends one row from each map task, and equal keys mean equal bytes. Rows then find their
    class by the hash alone; rows of hashes that turned out to have several texts find it by the text.
    """
    spark = docs.sparkSession
    n_cp = F.length(c.text_or_empty())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("norm"), n_cp.cast("long").alias("n_cp"))
    rows = rows.withColumn("h", F.unhex(hashed("norm")))
    narrow = c.stored(rows.select("doc_id", "h", F.sha2("norm", 256).alias("text_sha256"), "n_cp"), "exact-rows")
    two_64, two_63 = (F.lit(str(1 << n)).cast("decimal(20,0)") for n in (64, 63))
    # The order of (most code points, least doc_id) as one number, which a hash aggregation can hold.
    rank = F.col("n_cp").cast("decimal(38,0)") * two_64 - F.col("doc_id").cast("decimal(38,0)")
    classes = rows.groupBy("h", "norm").agg(F.count("*").alias("group_size"), F.max(rank.cast("decimal(38,0)")).alias("rank"))
    back = F.pmod(-F.col("rank") + two_63, two_64) - two_63
    classes = classes.withColumn("keep_id", back.cast("decimal(20,0)").cast("long"))
    slim = c.stored(classes.select("h", "group_size", "keep_id", F.sha2("norm", 256).alias("class_sha")), "exact-classes")
    per_hash = slim.groupBy("h").agg(F.count("*").alias("texts"), F.sum("group_size").alias("count"))
    mixed = per_hash.filter("texts > 1").select("h")
    hot = c.hot_keys(per_hash, "h", narrow.count())
    clash = not mixed.isEmpty()
    one = slim.join(mixed, "h", "left_anti") if clash else slim
    out = c.spread_join(narrow, one.drop("class_sha"), "h", hot)
    if clash:
        apart = classes.join(mixed, "h", "left_semi").select("h", "norm", "group_size", "keep_id")
        texts = rows.join(mixed, "h", "left_semi").withColumn("text_sha256", F.sha2("norm", 256)).join(apart, ["h", "norm"])
        out = out.select("doc_id", "keep_id", "group_size", "text_sha256").union(texts.select("doc_id", "keep_id", "group_size", "text_sha256"))
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns. Of rows that repeat a doc_id and its text, one stays, any if
    they differ in other columns.

    Rows that share a doc_id but not their text are told apart by the hash of the normalised text. Nulls, empty texts
    and empty tables as in exact_groups(); columns may have any names.
    """
    own, doc, sha = c.fresh(docs, "_own", "_doc", "_sha")
    keep = exact_groups(docs).filter("kept").select(F.col("doc_id").alias(doc), F.col("text_sha256").alias(sha)).distinct()
    mine = docs.withColumn(own, F.sha2(normalised(), 256))
    left = mine.join(keep, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(sha)), "left_semi")
    return left.dropDuplicates(["doc_id", own]).select(*docs.columns) if _repeats(docs) else left.select(*docs.columns)


def _repeats(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id").count().filter("count > 1").isEmpty()


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_exact_dedup": op9_exact_dedup}
ORACLE = {
    "op9_exact_dedup": r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id)
"""
}
