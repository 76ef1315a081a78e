"""Corpus preparation in stages; each reads what the one before it kept.

All stages take null text as empty and read texts of any length whole. A row without a doc_id, lang or source goes through
as any other; rows that repeat, in id or text, are documents of their own unless a stage says otherwise. A table without
rows gives one without rows. Columns beyond those of documents, of any names, are handed on up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from speckle.llm import _common, _tokens, quality
from speckle.llm.exact_dedup import exact_dedup
from speckle.llm.jaccard import near_dedup
from speckle.llm.mixing import mixed_documents
from speckle.llm.packing import pack


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels of `sf_dir`, predicts as good.

    An empty text has a score too; a row that repeats is kept or dropped with its text.
    """
    return quality.accepted(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays: the row of most characters, then least doc_id; of rows that repeat id and text, one."""
    return exact_dedup(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 of their five-word shingles one stays, that of the least doc_id.

    Documents without words, and rows without a doc_id, all stay. Rows that repeat a doc_id are one document.
    """
    return near_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, cut at the target.

    Documents without words are never taken; null sources are a source of their own.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boundary records of sequences of 1024 tokens, with the tokens.

    An empty text is a piece of one token, its end.
    """
    return pack(docs, _tokens.vocabulary("byte_bpe_50k.json"), with_ids=True)


STAGES = [("quality", good), ("exact dedup", unique), ("near dedup", distinct), ("mixing", mixing), ("packing", packing)]
#: The first stage is a trained network, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = _common.stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
