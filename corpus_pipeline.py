"""The corpus pipeline: stages over documents, each written as Parquet and read again before the next.

Rejected documents go first, then all but one of each group of near-duplicates; what is left loses the
passages that repeat and its secrets are masked; the rest is packed into token windows. Every stage but
the last returns the columns of documents, whatever further columns it is given.

Defined cases: null and empty texts go through all stages like others (they are near-duplicates of each
other, so one is left), as do null doc_ids and null metadata; of repeated rows one stays; very long
texts are never cut but by the passage stage; an empty table gives an empty result.

A stage called alone deletes none of the tables that its result reads: they are its caller's, who ends with
``runtime.scratch`` as ``run`` does, or with the folder in spark.checkpoint.dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import bm25_pack, cotrain, secrets, shingles, suffix_dedup
from quarryline.llm.runtime import discard, scratch, stage_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents; n_chars is that of the text as it is now."""
    return df.select("doc_id", "text", "lang", "source", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    return _documents(cotrain.scored(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"), again=True).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group linked by SimHash at five words or by shingle sets of similarity 0.8."""
    return _documents(shingles.one_of_each(docs.select(*COLUMNS)))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that lie in a string of 200 bytes found elsewhere; a document may end up empty."""
    return _documents(suffix_dedup.dedup(docs.select(*COLUMNS), carry=("lang", "source")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every found secret masked."""
    return _documents(secrets.redact(docs.select(*COLUMNS)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows, with their ids."""
    return bm25_pack.pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: SQL can't express the classifier, the hashing, the byte spans or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's own tables go once its result is written, and that once the next one's is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        with scratch(spark) as keep:
            before, docs = docs, stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
            keep(docs)
        if i:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
