"""Sparse and dense indexes as tables, and ranked search over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import n_tokens, small_tokens, tokens


def postings(passages: DataFrame) -> DataFrame:
    """(id, domain, term, tf)."""
    terms = passages.select("id", "domain", F.explode(tokens(F.col("text"))).alias("term"))
    return terms.groupBy("id", "domain", "term").agg(F.count(F.lit(1)).alias("tf"))


def lengths(passages: DataFrame) -> DataFrame:
    """(id, domain, dl)."""
    return passages.select("id", "domain", n_tokens(F.col("text")).alias("dl"))


def passage_frequency(passages: DataFrame) -> DataFrame:
    """(term, df): how many passages hold a term, counted without postings."""
    return document_frequency(passages.select(F.explode(F.array_distinct(small_tokens(F.col("text")))).alias("term")))


def document_frequency(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def ranked(df: DataFrame, keys: list[str], score: Column, k: int, tie: str = "id") -> DataFrame:
    """The ``k`` best rows per key by score, ties by id; rank counts from 1."""
    w = Window.partitionBy(*keys).orderBy(score.desc(), F.col(tie).asc())
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def bm25(passages: DataFrame, queries: DataFrame, k: int = 5, k1: float = 1.2, b: float = 0.75, domain: str | None = None) -> DataFrame:
    """(task_id, id, domain, score, rank): the best passages for each (task_id, query).

    Statistics are those of all passages; a domain restricts only what is ranked.
    """
    corpus = lengths(passages).agg(F.count(F.lit(1)).cast("double").alias("n"), F.greatest(F.coalesce(F.avg("dl"), F.lit(0.0)), F.lit(1.0)).alias("mean"))
    asked = queries.select("task_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("task_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    words = passages.select("id", "domain", tokens(F.col("text")).alias("ts")).select("id", "domain", F.size("ts").cast("long").alias("dl"), F.explode("ts").alias("term"))
    # only the queries' terms are counted and exchanged
    posts = words.join(asked.select("term").distinct(), "term", "left_semi").groupBy("id", "domain", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = document_frequency(posts)
    weights = df.withColumn("_one", F.lit(1)).join(corpus.withColumn("_one", F.lit(1)), "_one").drop("_one")  # one row of statistics
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = asked.join(weights.select("term", idf.alias("idf"), "mean"), "term")
    hits = posts if domain is None else posts.where(F.col("domain") == domain)
    hits = hits.join(terms, "term")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("mean"))) * F.col("qtf")
    scores = hits.groupBy("task_id", "id", "domain").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")
    return ranked(scores, ["task_id"], F.col("score"), k)


def weighted_rrf(dense_hits: DataFrame, sparse_hits: DataFrame, key: str, k: int = 60, sparse_weight: float = 0.35, limit: int = 5) -> DataFrame:
    """(key, id, score, dense_rank, sparse_rank, rank): both rank lists fused by reciprocal rank."""
    d = dense_hits.select(key, "id", F.col("rank").alias("dense_rank"), F.lit(None).cast("long").alias("sparse_rank"))
    s = sparse_hits.select(key, "id", F.lit(None).cast("long").alias("dense_rank"), F.col("rank").alias("sparse_rank"))
    score = F.coalesce(1 / (k + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(sparse_weight / (k + F.col("sparse_rank")), F.lit(0.0))
    both = d.unionAll(s).groupBy(key, "id").agg(F.min("dense_rank").alias("dense_rank"), F.min("sparse_rank").alias("sparse_rank"))
    return ranked(both.withColumn("score", F.round(score, 9)), [key], F.col("score"), limit)


def nested_rrf(hits: DataFrame, key: str, part: str, limit: int = 5, k: int = 60) -> DataFrame:
    """Fuse the rank lists of a request's parts, each with an equal weight.

    ``hits`` has the request ``key``, the ``part``, id, rank, dense_rank and sparse_rank; ranks are averaged and cut to whole numbers.
    """
    n = hits.select(key, part).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("parts"))
    mean = lambda c: F.nullif(F.floor(F.avg(c)), F.lit(0)).cast("long")
    fused = hits.join(n, key).groupBy(key, "id").agg(F.round(F.sum(1 / F.col("parts") / (k + F.col("rank"))), 9).alias("score"), mean("dense_rank").alias("dense_rank"), mean("sparse_rank").alias("sparse_rank"))
    return ranked(fused, [key], F.col("score"), limit)


def candidate_pool(fused: DataFrame, per_part: DataFrame, key: str) -> DataFrame:
    """Fused hits in their order, then the parts' other hits, each id once: (key, id, pool_rank)."""
    a = fused.select(key, "id", F.lit(0).alias("tier"), F.col("rank").alias("pos"))
    b = per_part.select(key, "id", F.lit(1).alias("tier"), F.col("rank").alias("pos"))
    best = a.unionAll(b).groupBy(key, "id").agg(F.min(F.struct("tier", "pos")).alias("o"))
    w = Window.partitionBy(key).orderBy("o.tier", "o.pos", "id")
    return best.select(key, "id", F.row_number().over(w).cast("long").alias("pool_rank"))
