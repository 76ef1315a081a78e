"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts, repeated epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speckle.llm import _common as c

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2.0, "mix"
#: Rows that one range of the random keys holds on average.
RANGE_ROWS = 4096


def words(text: Column | str = "text") -> Column:
    return F.regexp_count(c.text_or_empty(text), F.lit(WORD)).cast("long")


def _key(seed: str) -> Column:
    """A row's random key, from its doc_id and text, so that rows without an id have different ones too."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(c.text_or_empty())))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(no, is_null, s, source_size, target) from (is_null, s, source_size), one row per source.

    Sources by code point, null last, weigh `weights` in turn and share `share` of all sizes; no target is above
    `most` times its source's size. Resharing the excess by weight ends where every open source has the same
    target per weight. Sources close in the order of most * size / weight, so the sources that are closed are
    the longest run, in that order, of which each is above what its predecessors leave to it and the rest.
    """
    order = Window.orderBy("is_null", "s")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("no"), F.lit(len(weights))) + 1).cast("int"))
    x = sizes.withColumn("no", F.row_number().over(order) - 1).withColumn("weight", pick)
    x = x.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), "no")
    before, every = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    x = x.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(every))
    x = x.withColumn("left_", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    x = x.withColumn("open_", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    x = x.withColumn("level", F.col("left_") / F.col("open_")).withColumn("stays", F.col("cap") > F.col("level") * F.col("weight"))
    x = x.withColumn("final", F.min(F.when(F.col("stays"), F.struct(F.col("cap") / F.col("weight"), "no", "level"))).over(every))
    level = F.col("final.level")
    return x.select("no", "is_null", "s", "source_size", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, key) for every row of docs.

    size: words of the text, 0 for null. Each source takes its documents whole as often as its target holds its
    size, then in the order of their random keys until the rest of the target, rounded down to words, is met:
    the document at the cut gives some of its words. Null sources are one source. Ties of keys go by doc_id,
    then size; rows that repeat both id and text have one key and share a range. Texts may be of any length. An empty
    table gives an empty result; other columns are ignored. Targets are found in one task, of a row for each source.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").isNull().alias("is_null"), F.coalesce("source", F.lit("")).alias("s"),
        words().alias("size"), _key(seed).alias("key"),
    )
    rows = c.stored(rows, "mix-rows")
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    # The keys are uniform, so equal ranges of them are equally full, within each source too.
    rows = rows.withColumn("range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 2**32 * ranges).cast("long"))
    group = ["is_null", "s", "range"]
    parts = rows.groupBy(*group).agg(F.sum("size").alias("part_size"))
    sizes = parts.groupBy("is_null", "s").agg(F.sum("part_size").alias("source_size"))
    offsets = c.running(parts, ["is_null", "s"], "range", "part_size", "base")
    offsets = offsets.join(source_targets(sizes, weights, share, most), ["is_null", "s"]).drop("part_size", "no")
    inside = Window.partitionBy(*group).orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    x = rows.join(offsets, group).withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    x = x.withColumn("epochs", epochs.cast("long")).withColumn("rest", F.floor(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before")))
    return x.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), "key")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents that the mix takes, with docs' columns: one row for each time a document is taken.

    A document that is cut gives a last row whose text ends after the words taken. A document without words is
    taken by no target and goes. Rows are told apart by doc_id and size; rows alike in both share what they take.
    """
    plan = mix(docs, **how).filter("taken > 0").groupBy("doc_id", "size").agg(F.collect_list("taken").alias("takes"))
    doc, size, takes, own, take, copy = c.fresh(docs, "_mix_id", "_mix_size", "_mix_takes", "_mix_words", "_mix_take", "_mix_copy")
    plan = plan.select(F.col("doc_id").alias(doc), F.col("size").alias(size), F.col("takes").alias(takes))
    mine = docs.withColumn(own, words())
    x = mine.join(plan, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(size)))
    rank = Window.partitionBy(doc, size).orderBy("text")
    x = x.withColumn(take, F.element_at(takes, F.when(F.size(takes) > 1, F.row_number().over(rank)).otherwise(F.lit(1))))
    x = x.withColumn(copy, F.explode(F.sequence(F.lit(1), F.ceil(F.col(take) / F.col(size)).cast("int"))))
    left = F.col(take) - (F.col(copy) - 1) * F.col(size)
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"([\x20\x09-\x0D]*{WORD})"), F.lit(1)), F.lit(1), left.cast("int")), "")
    text = F.when(left >= F.col(size), F.col("text")).otherwise(head)
    out = x.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("key")


QUERIES = {"op8_mix": op8_mix}
ORACLE = {
    "op8_mix": r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS is_null, coalesce(source, '') AS s,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS key
  FROM documents),
src AS (SELECT is_null, s, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, row_number() OVER (ORDER BY is_null, s) - 1 AS no FROM src),
v AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(no % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS cap FROM w),
r AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS left_,
             sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS open_
      FROM v WINDOW b AS (ORDER BY cap / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT left_ / open_ AS level FROM r WHERE cap > left_ / open_ * weight ORDER BY cap / weight, no LIMIT 1),
t AS (SELECT is_null, s, source_size, least(cap, coalesce((SELECT level FROM l) * weight, cap)) AS target FROM v),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             coalesce(sum(d.size) OVER (PARTITION BY d.is_null, d.s ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS epochs
      FROM d JOIN t ON d.is_null = t.is_null AND d.s = t.s)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken FROM p
"""
}
