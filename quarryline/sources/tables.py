"""The driver tables, and their views as passages, tasks and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, domain, text) of the documents."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("domain"), F.coalesce("text", F.lit("")).alias("text"))


def page_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, url, text) of the web pages, one line per stretch of text between tags."""
    text = F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", "\n")
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.coalesce("url", F.lit("")).alias("url"), text.alias("text"))


def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, domain, title, text, links) of the web pages, all in one domain."""
    html = F.coalesce("html", F.lit(""))
    title = F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)
    links = F.regexp_extract_all(html, F.lit('(?i)href="([^"]*)"'), F.lit(1))
    text = F.regexp_replace(html, "<[^>]*>", "\n")
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("web").alias("domain"), title.alias("title"), text.alias("text"), links.alias("links"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_id, query, full): the benchmark items, each asking with all its tokens."""
    from quarryline.functions.text import tokens

    items = table(spark, sf_dir, "benchmark")
    return items.select(F.col("item_id").alias("task_id"), F.array_join(tokens(F.coalesce("text", F.lit(""))), " ").alias("query"), F.col("text").alias("full"))


def chunks(spark: SparkSession, sf_dir: str, step: int = 4, interval: float = 0.8) -> DataFrame:
    """User turns as growing transcripts: (stream_id, idx, ts, text, is_final, confidence)."""
    from quarryline.streaming.transcripts import simulate_chunks

    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    named = turns.select(F.concat_ws("-", "conv_id", "turn").alias("stream_id"), F.coalesce("text", F.lit("")).alias("text"))
    return simulate_chunks(named, step, interval)
