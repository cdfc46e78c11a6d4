"""Measures of retrieval, streams, answers and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.numeric import gain, ratio, upper_median


def hit_ranks(tasks: DataFrame, hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """(task_id, n_qrels, n_hit, hit_rank) per task: relevant passages, those found, and the first one's rank."""
    rel = qrels.select("task_id", "id").distinct()
    counts = rel.groupBy("task_id").agg(F.count(F.lit(1)).alias("n_qrels"))
    found = hits.join(rel, ["task_id", "id"]).groupBy("task_id").agg(F.count_distinct("id").alias("n_hit"), F.min("rank").alias("hit_rank"))
    df = tasks.select("task_id").join(counts, "task_id", "left").join(found, "task_id", "left")
    return df.select("task_id", F.coalesce("n_qrels", F.lit(0)).alias("n_qrels"), F.coalesce("n_hit", F.lit(0)).alias("n_hit"), "hit_rank")


def retrieval_report(ranks: DataFrame) -> DataFrame:
    """One row: success, mean recall over tasks with relevant passages, reciprocal rank over hits only and over all tasks."""
    n = F.count(F.lit(1))
    return ranks.agg(
        n.alias("tasks"),
        ratio(F.count("hit_rank"), n).alias("success_at_k"),
        F.coalesce(F.round(F.avg(F.when(F.col("n_qrels") > 0, F.col("n_hit") / F.col("n_qrels"))), 4), F.lit(0.0)).alias("recall_at_k"),
        F.coalesce(F.round(F.avg(1 / F.col("hit_rank")), 6), F.lit(0.0)).alias("mrr_hits"),
        F.round(ratio(F.sum(1 / F.col("hit_rank")), n, 6), 6).alias("mrr_all"),
    )


def graded(hits: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """(task_id, ndcg_k, recall_k ...) over tasks with relevant passages (task_id, id, rel)."""
    ideal_rank = F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("rel"), "id"))
    ideal = qrels.withColumn("r", ideal_rank).groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.when(F.col("r") <= k, gain(F.col("rel"), F.col("r"))).otherwise(0.0)).alias(f"i{k}") for k in ks])
    got = hits.join(qrels, ["task_id", "id"]).groupBy("task_id").agg(
        *[F.sum(F.when(F.col("rank") <= k, gain(F.col("rel"), F.col("rank"))).otherwise(0.0)).alias(f"g{k}") for k in ks],
        *[F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias(f"c{k}") for k in ks],
    )
    df = ideal.join(got, "task_id", "left")
    return df.select("task_id", *[ratio(F.col(f"g{k}"), F.col(f"i{k}"), 6).alias(f"ndcg_{k}") for k in ks], *[ratio(F.col(f"c{k}"), F.col("n"), 6).alias(f"recall_{k}") for k in ks])


def weighted_average(scores: DataFrame, group: str, names: list[str]) -> DataFrame:
    """Per group and, as group 'all', over all rows: rows and mean of each score."""
    total = scores.rollup(group).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in names], F.grouping(group).alias("_g"))
    return total.select(F.when(F.col("_g") == 1, "all").otherwise(F.col(group)).alias(group), "n", *names)


def streaming_report(streams: DataFrame, min_words: int = 5) -> DataFrame:
    """One row over (category, words, early, n_retrieve, settling_ms): early and false-trigger rates and settling times."""
    eligible = (F.col("category") == "early_retrieval") & (F.col("words") >= min_words)
    negative = F.col("category") == "no_retrieval"
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    settled = F.when(eligible & (F.col("settling_ms") >= 0), F.col("settling_ms"))
    return streams.agg(
        F.count(F.lit(1)).alias("tasks"),
        count(eligible).alias("eligible"),
        ratio(count(eligible & F.col("early")), count(eligible)).alias("early_rate"),
        ratio(count(negative & (F.col("n_retrieve") > 0)), count(negative)).alias("false_trigger_rate"),
        F.coalesce(F.floor(F.avg(settled)), F.lit(0)).cast("long").alias("settling_mean"),
        F.coalesce(F.max(settled), F.lit(0)).cast("long").alias("settling_max"),
    )


def answer_report(scores: DataFrame, support_threshold: float = 0.85) -> DataFrame:
    """One row over (support, faithfulness): means, upper medians, passing rates; faithfulness leaves zeros out."""
    faith = F.when(F.col("faithfulness") > 0, F.col("faithfulness"))
    return scores.agg(
        F.count(F.lit(1)).alias("queries"),
        F.round(F.avg("support"), 6).alias("mean_support"),
        F.round(upper_median(F.collect_list("support")), 6).alias("median_support"),
        F.round(F.avg((F.col("support") >= support_threshold).cast("double")), 6).alias("support_passing"),
        F.round(F.avg(faith), 6).alias("mean_faithfulness"),
        F.round(upper_median(F.collect_list(faith)), 6).alias("median_faithfulness"),
    )


def overlap_scores(pairs: DataFrame, prediction: str, target: str) -> DataFrame:
    """``pairs`` (key, arrays of tokens) with recall, precision and f1 of the multisets."""
    p = pairs.select("key", F.explode(prediction).alias("t")).groupBy("key", "t").agg(F.count(F.lit(1)).alias("a"))
    g = pairs.select("key", F.explode(target).alias("t")).groupBy("key", "t").agg(F.count(F.lit(1)).alias("b"))
    both = p.join(g, ["key", "t"]).groupBy("key").agg(F.sum(F.least("a", "b")).alias("common"))
    df = pairs.select("key", F.size(prediction).alias("np"), F.size(target).alias("nt")).join(both, "key", "left")
    common = F.coalesce("common", F.lit(0))
    return df.select("key", ratio(common, F.col("nt"), 6).alias("recall"), ratio(common, F.col("np"), 6).alias("precision"), ratio(2 * common, F.col("np") + F.col("nt"), 6).alias("f1"))


def trace_report(rows: DataFrame, expected: int) -> DataFrame:
    """One row over trace rows (trace_id, status, cost, problems): counts, coverage, duplicates, validity."""
    n = F.count(F.lit(1))
    return rows.agg(
        n.alias("traces"),
        F.round(F.least(n / expected, F.lit(1.0)), 6).alias("coverage"),
        (n - F.count_distinct("trace_id")).alias("repeated_ids"),
        F.sum((F.col("problems") != "").cast("long")).alias("bad_rows"),
        ((F.sum((F.col("problems") != "").cast("long")) == 0) & (n == F.count_distinct("trace_id")) & (n == expected)).alias("valid"),
    )


def cost(prompt: str, completion: str, price_in: float, price_out: float):
    """Sum of both token counts by their prices per million, null without prices."""
    return F.round(F.sum(F.col(prompt) * price_in + F.col(completion) * price_out) / 1e6, 8)
