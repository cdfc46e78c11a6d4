"""Evidence sentences, answers made of them, and their citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.predicates import word_count
from quarryline.functions.text import content_terms, sentences, squeeze, tokens, words_literal

ABSTENTION = "I do not have enough information in the retrieved corpus to answer that."


def evidence(queries: DataFrame, hits: DataFrame, max_spans: int = 4) -> DataFrame:
    """(task_id, id, sentence, score, pick): supporting sentences, one from each of the first three passages, then the best others.

    ``queries`` has task_id and query, ``hits`` task_id, id, text, score and rank. A sentence supports if it
    shares two content terms with the query, or one that is a third of them.
    """
    asked = queries.select("task_id", content_terms(F.col("query")).alias("terms"))
    rows = hits.join(asked, "task_id").select("task_id", "id", "rank", F.col("score").alias("hit"), "terms", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))
    overlap = F.size(F.array_intersect("terms", content_terms(F.col("sentence"))))
    rows = rows.withColumn("overlap", overlap).withColumn("coverage", F.col("overlap") / F.greatest(F.size("terms"), F.lit(1)))
    rows = rows.where((F.col("overlap") >= 2) | ((F.col("overlap") == 1) & (F.col("coverage") >= 0.34)))
    rows = rows.withColumn("score", F.round(F.col("coverage") + F.least(F.col("hit"), F.lit(1.0)) * 0.05, 6))
    order = [F.col("score").desc(), F.col("rank").asc(), F.col("pos").asc()]
    once = rows.withColumn("_copy", F.row_number().over(Window.partitionBy("task_id", "sentence").orderBy(*order))).where("_copy = 1")
    own = F.row_number().over(Window.partitionBy("task_id", "rank").orderBy(*order))
    first = (F.col("_own") == 1) & (F.col("rank") <= 3)
    rest = once.withColumn("_own", own).withColumn("_tier", F.when(first, F.col("rank")).otherwise(F.lit(9)))
    pick = F.row_number().over(Window.partitionBy("task_id").orderBy(F.col("_tier").asc(), *order))
    return rest.withColumn("pick", pick.cast("long")).where(F.col("pick") <= max_spans).select("task_id", "id", "sentence", "score", "pick")


def answers(queries: DataFrame, spans: DataFrame) -> DataFrame:
    """(task_id, answer, citations, uncertainty): the spans in order, or an abstention."""
    made = spans.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("pick", "sentence", "id"))).alias("s"))
    df = queries.select("task_id").join(made, "task_id", "left")
    text = F.array_join(F.transform("s", lambda x: x["sentence"]), " ")
    cited = F.array_distinct(F.transform("s", lambda x: x["id"].cast("string")))
    none = F.col("s").isNull()
    return df.select("task_id", F.when(none, ABSTENTION).otherwise(text).alias("answer"), F.when(none, "").otherwise(F.array_join(cited, ",")).alias("citations"), F.when(none, "No supporting evidence spans were found.").alias("uncertainty"))


def claims(answers_of: DataFrame) -> DataFrame:
    """(task_id, pos, claim): parts between full stops of more than ten characters."""
    parts = answers_of.select("task_id", F.posexplode(F.split("answer", r"\.", -1)).alias("pos", "claim"))
    return parts.select("task_id", "pos", F.trim("claim").alias("claim")).where(F.length("claim") > 10)


def citation_support(answers_of: DataFrame, hits: DataFrame) -> DataFrame:
    """(task_id, claims, supported, support_rate): a claim counts if a passage shares three of its words, or three tenths."""
    bag = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+", -1), lambda w: w != ""))
    pairs = claims(answers_of).select("task_id", "pos", bag(F.col("claim")).alias("w")).join(hits.select("task_id", bag(F.col("text")).alias("p")), "task_id", "left")
    ok = F.size(F.array_intersect("w", "p")) >= F.least(F.lit(3.0), F.size("w") * 0.3)
    each = pairs.groupBy("task_id", "pos").agg(F.max(F.coalesce(ok, F.lit(False)).cast("int")).alias("ok"))
    return each.groupBy("task_id").agg(F.count(F.lit(1)).alias("claims"), F.sum("ok").alias("supported"), F.round(F.avg("ok"), 6).alias("support_rate"))


def claim_citations(answers_of: DataFrame, hits: DataFrame) -> DataFrame:
    """(task_id, sentence, id): which hits of the task hold each sentence of its answer word for word."""
    said = answers_of.select("task_id", F.explode(sentences(F.col("answer"))).alias("sentence"))
    held = hits.select("task_id", "id", squeeze(F.col("text")).alias("text"))
    return said.join(held, "task_id").where(F.contains("text", F.col("sentence"))).select("task_id", "sentence", "id").distinct()


def refined(df: DataFrame) -> DataFrame:
    """``df`` (previous, delta, delta_query) with answer: an addition is appended, a correction replaces the sentences that share its terms."""
    old = sentences(F.col("previous"))
    new = content_terms(F.col("delta"))
    kept = F.filter(old, lambda s: ~F.arrays_overlap(content_terms(s), new))
    restrictive = F.col("delta_query").rlike(r"(?i)\b(?:only|instead|actually|except|rather|not)\b")
    additive = ~restrictive & F.col("delta_query").rlike(r"(?i)^\s*(?:what\s+about|also\b|and\b)")
    patched = F.trim(F.concat_ws(" ", kept, F.col("delta")))
    answer = F.when(additive, F.concat(F.rtrim("previous"), F.lit("\n\n"), F.trim("delta"))).when(restrictive & (F.size(kept) == F.size(old)), F.col("delta")).otherwise(patched)
    return df.withColumn("answer", answer)


def without_repeats(spans: Column) -> Column:
    """Spans in order, each once; one of 40 characters or more that lies in another is left out."""
    none = F.array().cast("array<string>")

    def step(kept, text):
        held = F.exists(kept, lambda o: (o == text) | ((F.length(text) >= 40) & F.contains(o, text)))
        rest = F.filter(kept, lambda o: ~((F.length(o) >= 40) & F.contains(text, o)))
        return F.when((text == "") | held, kept).otherwise(F.concat(rest, F.array(text)))

    return F.aggregate(F.transform(spans, squeeze), none, step)


def procedure(text: Column) -> Column:
    """Headings "Step n." of a text if they count 1, 2, 3 ... and are two or more, else empty."""
    steps = F.regexp_extract_all(text, F.lit(r"(?m)^[^\S\n]*(Step\s+\d+\.\s+[^\n]+)"), F.lit(1))
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^[^\S\n]*Step\s+(\d+)\.\s+[^\n]+"), F.lit(1)), lambda n: n.cast("int"))
    ok = (F.size(steps) >= 2) & (numbers == F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1))))
    return F.when(ok, F.transform(steps, squeeze)).otherwise(F.array().cast("array<string>"))


def novel_terms(delta_query: Column, previous: Column) -> Column:
    """Tokens of a follow-up that the answer before doesn't have and that carry content."""
    seen = F.concat(content_terms(previous), words_literal(["only", "instead", "actually", "rather", "except"]))
    raw = F.regexp_extract_all(delta_query, F.lit("[A-Za-z0-9_]+"), F.lit(0))
    return F.filter(raw, lambda t: F.array_contains(content_terms(t), F.lower(t)) & ~F.array_contains(seen, F.lower(t)))


def route(df: DataFrame) -> DataFrame:
    """``df`` (query, n_hits, direct, multi_intent) with to_provider and why, the first rule that applies."""
    from quarryline.functions.predicates import context_dependent, needs_reasoning

    q = F.col("query")
    compound = F.col("multi_intent") & q.rlike(r"(?i)\band\s+(?:what|how|why|who|when|where)\b")
    why = F.when(F.col("n_hits") == 0, "no passages").when(compound, "compound").when(needs_reasoning(q), "reasoning").when(context_dependent(q), "context").when(~F.col("direct"), "no direct evidence").otherwise("direct")
    return df.withColumns({"why": why, "to_provider": ~why.isin("no passages", "direct")})


__all__ = ["answers", "citation_support", "claim_citations", "claims", "evidence", "novel_terms", "procedure", "refined", "route", "tokens", "without_repeats", "word_count"]
