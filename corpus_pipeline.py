"""Corpus pipeline over the ``documents`` table: a list of stages, each one operator of ``kinetoflow.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinetoflow.llm import decontaminate, mixing, packing, quality, simhash_dedup
from kinetoflow.llm.common import settle, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts are scored as texts without words. Repeated rows go or stay alike. Where no document is labelled every score is 0.5, so none
    stays; no rows give no rows. Other columns stay as they are.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    own = docs.select("doc_id", "text")
    return quality.score(docs, quality.train(own, labels), name="__score").where(f"__score >= {quality.THRESHOLD}").drop("__score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: texts whose five-word shingles are 0.8 alike or more are linked.

    Nulls and texts without words are alike; a group keeps its smallest id, null ids come last. No rows give no rows.
    """
    return simhash_dedup.keep_one(docs, words=5, similarity=0.8)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none. Rows that share an id, or have none, go together if one of them holds an item. No rows give no rows.
    """
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null and empty texts have size 0 and are not taken. A null source is a source, null ids count as one id, repeated rows are taken evenly. No rows give no rows.
    """
    return mixing.repeat(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids of all documents.

    Null and empty texts give the end token alone, repeated rows are packed each, null ids stay null. No rows give no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing sources", mixed),
    ("token packing", packed),
]

#: Classifier, fingerprints and tokenizer have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; each stage's result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), "stage")
    return docs
