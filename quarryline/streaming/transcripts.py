"""Transcripts as growing chunks, and when a search should start: plans over windows of a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.predicates import presentation_only, word_count
from quarryline.functions.text import common_prefix

def in_order():
    """Chunks of a stream in their order."""
    return Window.partitionBy("stream_id").orderBy("idx")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+", -1), lambda w: w != "")


def simulate_chunks(turns: DataFrame, step: int = 4, interval: float = 0.8) -> DataFrame:
    """(stream_id, idx, ts, text, is_final, confidence): every ``step`` words a longer hypothesis; streams without words have none."""
    df = turns.select("stream_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    last = F.ceil(F.size("w") / step).cast("int")
    df = df.select("stream_id", "w", last.alias("n"), F.explode(F.sequence(F.lit(1), last)).alias("k"))
    final = F.col("k") == F.col("n")
    return df.select(
        "stream_id",
        (F.col("k") - 1).cast("long").alias("idx"),
        F.round(F.col("k") * interval, 3).alias("ts"),
        F.array_join(F.slice("w", F.lit(1), F.col("k") * step), " ").alias("text"),
        final.alias("is_final"),
        F.when(final, 0.95).otherwise(0.8).alias("confidence"),
    )


def committed(chunks: DataFrame) -> DataFrame:
    """``chunks`` with the words that this hypothesis and the one before agree on from the start."""
    before = F.lag("text").over(in_order())
    return chunks.withColumn("committed", F.when(before.isNull(), F.lit(0)).otherwise(common_prefix(words(F.col("text")), words(before))).cast("long"))


def decisions(chunks: DataFrame, min_chars: int = 24, min_tokens: int = 5, min_confidence: float = 0.72, stable_words: int = 3) -> DataFrame:
    """Decision and reason for every chunk.

    Only chunks that are neither empty, about delivery nor final take part in the agreement; the first
    agreement of ``stable_words`` words retrieves, later ones wait for the final chunk.
    """
    text = F.trim("text")
    kind = F.when(text == "", "empty").when(presentation_only(text), "presentation").when(F.col("is_final"), "final").otherwise("window")
    df = chunks.withColumns({"_text": text, "_kind": kind})
    own = Window.partitionBy("stream_id", "_kind").orderBy("idx")
    before = F.lag("_text").over(own)
    agreed = F.when((F.col("_kind") == "window") & before.isNotNull(), common_prefix(words(F.col("_text")), words(before))).otherwise(0)
    df = df.withColumn("committed", agreed.cast("long"))
    stable = (F.col("_kind") == "window") & (F.col("committed") >= stable_words)
    df = df.withColumns({"_stable": stable, "_earlier": F.coalesce(F.sum(stable.cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    first = F.col("_stable") & (F.col("_earlier") == 0)
    decision = F.when(F.col("_kind").isin("empty", "presentation"), "No-Retrieval").when((F.col("_kind") == "final") | first, "Retrieve").otherwise("Wait")
    reason = (
        F.when(F.col("_kind") == "empty", "empty text")
        .when(F.col("_kind") == "presentation", "presentation-only command")
        .when(F.col("_kind") == "final", "final transcript")
        .when(first, F.concat(F.lit("stable intent ("), F.col("committed"), F.lit(" words agreed)")))
        .when(F.col("_stable"), "already retrieved; awaiting final")
        .when(F.col("confidence") < min_confidence, F.concat(F.lit("low confidence "), F.col("confidence"), F.lit("; intent not stable")))
        .when((F.length("_text") < min_chars) | (word_count(F.col("_text")) < min_tokens), "too short for retrieval; intent not stable")
        .otherwise(F.concat(F.lit("intent not yet stable ("), F.col("committed"), F.lit(f"/{stable_words} words)")))
    )
    return df.select("stream_id", "idx", "ts", "text", "is_final", "committed", decision.alias("decision"), reason.alias("reason"))


def first_retrieve(decided: DataFrame) -> DataFrame:
    """(stream_id, first_idx, first_ts, early): the first Retrieve of a stream, early if it isn't the final chunk."""
    hit = decided.where("decision = 'Retrieve'")
    return hit.groupBy("stream_id").agg(F.min("idx").alias("first_idx"), F.min("ts").alias("first_ts"), (~F.min_by("is_final", "idx")).alias("early"))


def stability(chunks: DataFrame, stable_words: int = 3) -> DataFrame:
    """(stream_id, stable_idx, settling_ms): where hypotheses first agree on ``stable_words`` words, and how long that took."""
    df = committed(chunks)
    at = F.min(F.when(F.col("committed") >= stable_words, F.struct("idx", "ts")))
    out = df.groupBy("stream_id").agg(at.alias("a"), F.min("ts").alias("t0"))
    return out.select("stream_id", F.coalesce("a.idx", F.lit(-1)).alias("stable_idx"), F.coalesce(F.round((F.col("a.ts") - F.col("t0")) * 1000).cast("long"), F.lit(-1)).alias("settling_ms"))


def superseded(chunks: DataFrame) -> DataFrame:
    """The text that stands per stream: the final hypothesis, else the latest."""
    return chunks.groupBy("stream_id").agg(F.max_by("text", F.struct("is_final", "idx")).alias("text"), F.max("is_final").alias("is_final"), F.count(F.lit(1)).alias("n_chunks"))


def revisions(chunks: DataFrame) -> DataFrame:
    """Partials that don't continue the one before: (stream_id, idx, before, after)."""
    df = chunks.where("NOT is_final").withColumn("before", F.lag("text").over(in_order()))
    changed = F.col("before").isNotNull() & ~F.startswith(F.col("text"), F.concat("before", F.lit(" "))) & (F.col("text") != F.col("before"))
    return df.where(changed).select("stream_id", "idx", "before", F.col("text").alias("after"))


def not_increasing(chunks: DataFrame) -> DataFrame:
    """Chunks whose time isn't later than that of the one before."""
    return chunks.withColumn("before_ts", F.lag("ts").over(in_order())).where("before_ts >= ts").select("stream_id", "idx", "before_ts", "ts")


def request_opportunities(decided: DataFrame) -> DataFrame:
    """(stream_id, n): different hypotheses that would be searched."""
    return decided.where("decision = 'Retrieve'").groupBy("stream_id").agg(F.count_distinct("text").alias("n"))


def stream_problems(chunks: DataFrame) -> DataFrame:
    """(stream_id, problems): a stream needs three chunks, one final chunk at its end and increasing times."""
    flagged = chunks.withColumns({"_back": F.coalesce(F.lag("ts").over(in_order()) >= F.col("ts"), F.lit(False))})
    out = flagged.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_final").cast("int")).alias("finals"), F.max_by("is_final", "idx").alias("ends"), F.max("_back").alias("back"))
    rules = F.array_compact(F.array(F.when(F.col("n") < 3, "fewer than 3 chunks"), F.when((F.col("finals") != 1) | ~F.col("ends"), "no single final chunk at the end"), F.when(F.col("back"), "times don't increase")))
    return out.select("stream_id", F.array_join(rules, "; ").alias("problems"))


def word_times(turns: DataFrame) -> DataFrame:
    """(stream_id, pos, word, end_s): cumulated spoken time of each word."""
    df = turns.select("stream_id", F.posexplode(words(F.col("text"))).alias("pos", "word"))
    spoken = 1 / 2.5 + 0.03 * F.length("word") + F.when(F.col("word").rlike("[.,;:!?]$"), 0.32).otherwise(0.0)
    total = F.sum(spoken).over(Window.partitionBy("stream_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return df.select("stream_id", "pos", "word", F.round(total, 2).alias("end_s"))


def spoken(turns: DataFrame, seed: int = 20260928, revised: float = 0.35) -> DataFrame:
    """(stream_id, idx, ts, text, is_final, confidence): word by word, in some streams with a word misheard at first.

    All chance is a keyed hash of (seed, stream), so a stream is the same in any run and any order: whether
    it is revised, at which word from a quarter to seven tenths of six words or more, and for how many words
    until the correction. A misheard word has two of its letters exchanged.
    """
    draw = lambda what, n: F.pmod(F.xxhash64(F.lit(f"{seed}:{what}"), "stream_id"), n)
    df = turns.select("stream_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).withColumn("n", F.size("w"))
    low, high = F.greatest(F.lit(1), F.floor(F.col("n") * 0.25)), F.least(F.col("n") - 2, F.floor(F.col("n") * 0.7))
    chosen = (draw("revise", F.lit(1000)) < revised * 1000) & (F.col("n") >= 6) & (low <= high)
    df = df.withColumn("at", F.when(chosen, low + draw("word", F.greatest(high - low + 1, F.lit(1)))).cast("int"))
    df = df.withColumn("until", (F.col("at") + 1 + draw("span", F.greatest(F.least(F.lit(3), F.col("n") - F.col("at") - 1), F.lit(1)))).cast("int"))
    misheard = F.transform("w", lambda x, i: F.when((i == F.col("at")) & (F.length(x) >= 4), F.concat(F.substring(x, 2, 1), F.substring(x, 1, 1), F.substring(x, 3, 1 << 20))).when(i == F.col("at"), F.concat(x, x)).otherwise(x))
    end = F.transform("w", lambda x: 1 / 2.5 + 0.03 * F.length(x) + F.when(x.rlike("[.,;:!?]$"), 0.32).otherwise(0.0))
    df = df.withColumns({"m": misheard, "d": end})
    df = df.select("*", F.explode(F.sequence(F.lit(1), F.col("n") + 1)).alias("k"))
    own = Window.partitionBy("stream_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    final = F.col("k") > F.col("n")
    wrong = F.col("at").isNotNull() & (F.col("k") > F.col("at")) & (F.col("k") < F.col("until"))
    spent = F.sum(F.when(final, 0.3).otherwise(F.try_element_at("d", F.col("k")))).over(own)
    confidence = F.when(final, 0.97).otherwise(F.round(F.least(F.lit(0.93), 0.5 + 0.4 * F.col("k") / F.col("n")), 2))
    return df.select("stream_id", (F.col("k") - 1).cast("long").alias("idx"), F.round(spent, 2).alias("ts"), F.array_join(F.slice(F.when(wrong, F.col("m")).otherwise(F.col("w")), F.lit(1), F.least("k", "n")), " ").alias("text"), final.alias("is_final"), confidence.alias("confidence"))
