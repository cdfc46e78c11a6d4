"""Connected components by alternating stars: every round is joins and aggregates over edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.runtime import discard, stage_table


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b), root the smallest node reachable.

    Rows with a null end and loops are ignored; repeated edges count once.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    current = stage_table(pairs, "edges")
    before = None
    while before != (now := _mark(current)):
        before = now
        both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(current.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = stage_table(large, "edges")
        discard(current)
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionAll(least.select("hi", "m")).distinct()
        current = stage_table(small, "edges")
        discard(large)
    roots = current.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(roots)
