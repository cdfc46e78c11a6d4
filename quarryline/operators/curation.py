"""Curation of evaluation cases: signals, rules, splits, shortlists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import CURATION_STOPWORDS, curation_tokens, words_literal

#: What a case of each class is expected to bring about.
BEHAVIOURS = {"answerable": "answer", "partial": "partial_answer", "unanswerable": "abstain", "underspecified": "clarify"}
GAPS = ("not provide", "does not provide", "do not have", "no information", "cannot", "however", "but ", "not specify", "not state")


def audit(cases: DataFrame) -> DataFrame:
    """(case_id, score, coverage, overlap, flags) of cases (case_id, case_class, query, answer, evidence, clarification, source)."""
    terms = lambda c: F.array_distinct(F.array_except(curation_tokens(F.col(c)), words_literal(CURATION_STOPWORDS)))
    df = cases.withColumns({"_q": terms("query"), "_a": terms("answer"), "_e": terms("evidence")})
    share = lambda x: F.try_divide(F.size(F.array_intersect(x, "_e")).cast("double"), F.size(x))
    df = df.withColumns({"_cov": share("_a"), "_over": F.coalesce(share("_q"), F.lit(0.0)), "_n": F.size(F.regexp_extract_all("query", F.lit("[a-z0-9]+"), F.lit(0)))})
    grounded = F.col("case_class").isin("answerable", "partial")
    odd = ~F.col("_n").between(4, 80)
    gap = F.lower("answer").rlike("|".join(GAPS))
    partial, under = F.col("case_class") == "partial", F.col("case_class") == "underspecified"
    unclear = under & (F.trim("clarification") == "")
    score = F.when(grounded, 0.15 + 0.70 * F.coalesce("_cov", F.lit(0.0)) + 0.15 * F.col("_over")).when(F.col("source") == "benchmark", 0.90).otherwise(0.55)
    score = score - F.when(odd, 0.10).otherwise(0.0) + F.when(partial & gap, 0.10).otherwise(0.0) - F.when(unclear, 0.25).otherwise(0.0)
    flags = F.array_compact(
        F.array(
            F.when(grounded & (F.col("_cov") < 0.35), "low_answer_span_overlap"),
            F.when(grounded & (F.trim("evidence") == ""), "missing_support_span"),
            F.when(odd, "unusual_query_length"),
            F.when(partial & ~gap, "partial_answer_missing_explicit_gap"),
            F.when(unclear, "missing_clarification"),
        )
    )
    return df.select("case_id", F.round(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 9), 4).alias("score"), F.round("_cov", 4).alias("coverage"), F.round("_over", 4).alias("overlap"), F.array_join(flags, ",").alias("flags"))


def problems(cases: DataFrame) -> DataFrame:
    """(case_id, problems): the rules a case breaks, in order."""
    expected = F.create_map(*[F.lit(x) for kv in BEHAVIOURS.items() for x in kv])
    known = F.col("case_class").isin(*BEHAVIOURS)
    grounded = F.col("case_class").isin("answerable", "partial")
    rules = [
        (~F.col("split").isin("train", "dev", "test"), "invalid split"),
        (~known, "invalid case_class"),
        (known & (F.col("behavior") != F.try_element_at(expected, F.col("case_class"))), "expected_behavior does not match case_class"),
        (F.trim("query") == "", "empty query"),
        (grounded & ((F.trim("answer") == "") | (F.trim("evidence") == "")), "grounded case requires answer and support spans"),
        ((F.col("case_class") == "underspecified") & (F.trim("clarification") == ""), "underspecified case requires a clarification"),
        ((F.col("case_class") == "unanswerable") & (F.trim("answer") != ""), "unanswerable case must not contain a reference answer"),
        ((F.col("split") == "test") & (F.col("review") != "approved"), "test case lacks approved human review"),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in rules]))
    return cases.select("case_id", F.array_join(found, "; ").alias("problems"))


def shortlist(scored: DataFrame, targets: DataFrame, balanced: str = "partial") -> DataFrame:
    """(case_id, case_class, pick): the best cases per class up to its target; the balanced class takes half from each of its domains first."""
    order = [F.desc("score"), F.asc("case_id")]
    df = scored.join(targets, "case_class")
    own = F.row_number().over(Window.partitionBy("case_class", "domain").orderBy(*order))
    half = F.floor(F.col("target") / 2)
    df = df.withColumn("_first", F.when((F.col("case_class") == balanced) & (own <= half), 0).otherwise(1))
    pick = F.row_number().over(Window.partitionBy("case_class").orderBy("_first", *order))
    return df.withColumn("pick", pick.cast("long")).where(F.col("pick") <= F.col("target")).select("case_id", "case_class", "pick")


def round_robin(rows: DataFrame, group: str, turn: str, key: str, n: int) -> DataFrame:
    """The first ``n`` rows of each group, taking turns between the values of ``turn``."""
    own = F.row_number().over(Window.partitionBy(group, turn).orderBy(key))
    pick = F.row_number().over(Window.partitionBy(group).orderBy("_own", turn))
    return rows.withColumn("_own", own).withColumn("pick", pick.cast("long")).where(F.col("pick") <= n).select(group, turn, key, "pick")


def sample_by_hash(rows: DataFrame, key: str, group: str, seed: int, n: int) -> DataFrame:
    """One row per group, the groups in the order of a keyed hash, ``n`` at most."""
    order = F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256)
    w = Window.partitionBy(group).orderBy("_h", key)
    one = rows.withColumn("_h", order).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return one.orderBy("_h", key).limit(n).drop("_h", "_n")


def bounded_top(rows: DataFrame, keys: list[str], order: list[Column], k: int, spread: int = 64) -> DataFrame:
    """``rows`` with ``own``, their rank per ``keys`` up to ``k``; a key's rows are ranked in ``spread`` parts first, so no task holds more than ``k`` a part of it."""
    part = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns if c not in keys]), F.lit(spread))
    first = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    some = rows.withColumn("_part", part).withColumn("_first", first).where(F.col("_first") <= k)
    return some.withColumn("own", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("own") <= k).drop("_part", "_first")


def quota_seeds(cases: DataFrame, quotas: dict[str, int], seed: int = 20260928) -> DataFrame:
    """(case_class, domain, document_group, case_id, pick): ``quotas`` cases of each class, one of a document group, its domains taking turns.

    Cases are drawn in the order of a keyed hash. A class with fewer groups than its quota gives what it has.
    """
    drawn = F.sha2(F.concat(F.lit(f"{seed}|"), F.col("case_id").cast("string")), 256)
    wanted = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    rows = cases.where(F.col("case_class").isin(*quotas)).select("case_class", "document_group", F.struct(drawn.alias("h"), "case_id", "domain").alias("c"))
    one = rows.groupBy("case_class", "document_group").agg(F.min("c").alias("c")).select("case_class", "document_group", "c.h", "c.case_id", "c.domain")
    best = bounded_top(one, ["case_class", "domain"], [F.col("h").asc(), F.col("case_id").asc()], max(quotas.values()))
    pick = F.row_number().over(Window.partitionBy("case_class").orderBy("own", "domain"))
    return best.withColumn("pick", pick.cast("long")).where(F.col("pick") <= F.try_element_at(wanted, F.col("case_class"))).select("case_class", "domain", "document_group", "case_id", "pick")


def leaking_groups(cases: DataFrame) -> DataFrame:
    """(document_group, splits): groups of documents that more than one split uses."""
    g = cases.groupBy("document_group").agg(F.sort_array(F.collect_set("split")).alias("s"))
    return g.where(F.size("s") > 1).select("document_group", F.array_join("s", ",").alias("splits"))


def repeated_ids(cases: DataFrame) -> DataFrame:
    return cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def distractors(hits: DataFrame, gold: DataFrame, n: int = 5) -> DataFrame:
    """(task_id, id, pick): the best hits that aren't gold."""
    rest = hits.join(gold.select("task_id", "id"), ["task_id", "id"], "left_anti")
    w = Window.partitionBy("task_id").orderBy("rank", "id")
    return rest.withColumn("pick", F.row_number().over(w).cast("long")).where(F.col("pick") <= n).select("task_id", "id", "pick")


def best_spans(pairs: DataFrame, n: int = 3) -> DataFrame:
    """(key, sentence, jaccard, pick): sentences of ``text`` most like ``answer`` by their words."""
    rows = pairs.select("key", F.array_distinct(curation_tokens(F.col("answer"))).alias("a"), F.posexplode(F.split("text", r"[.!?]\s+", -1)).alias("pos", "sentence"))
    own = F.array_distinct(curation_tokens(F.col("sentence")))
    score = F.coalesce(F.try_divide(F.size(F.array_intersect("a", own)).cast("double"), F.size(F.array_union("a", own))), F.lit(0.0))
    w = Window.partitionBy("key").orderBy(F.desc("jaccard"), F.asc("pos"))
    df = rows.withColumn("jaccard", F.round(score, 6)).where("jaccard > 0").withColumn("pick", F.row_number().over(w).cast("long"))
    return df.where(F.col("pick") <= n).select("key", "sentence", "jaccard", "pick")
