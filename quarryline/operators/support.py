"""Sentences that support an answer outright, spans that a model chose and rules let pass, and structures kept whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import predicates as P
from quarryline.functions.text import SENTENCE, content_terms, current_question, sentences, squeeze
from quarryline.operators import evidence as V
from quarryline.operators.intents import defines

NAME = r"(?i)^what\s+is\s+(?:the\s+)?name\s+of\s+([^?]+)[?.]*$"
NAMING = r"(?i)\b(?:called|named|name\s+is)\b"
PAYING = r"(?i)\b(?:pay|paid|payment|payments)\b"
PAID = r"(?i)\b(?:pay|paid|payment|payments|cash|credit|debit|card|fare|fares|ticket|tickets)\b"
PROCEDURE = r"(?i)^how\s+(?:do|can|should)\s+(?:i|we|you)\s+(?:configure|install|enable)\s+(.+?)[?.]*$"
COVERED = 0.8


def asks_name(query: Column) -> Column:
    """Whether a query asks for one name."""
    return F.trim(query).rlike(NAME) & ~query.rlike(r"(?i)\b(?:and|or)\b")


def _procedures(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(task_id, id, sentence, pick): the numbered steps of the first passage that has all that a set-up question is about."""
    topic = content_terms(F.regexp_extract(current_question(F.col("query")), PROCEDURE, 1))
    asked = queries.select("task_id", topic.alias("topic")).where(F.size("topic") >= 2)
    found = hits.join(asked, "task_id").where(F.size(F.array_except("topic", content_terms(F.col("text")))) == 0)
    found = found.select("task_id", "id", "rank", V.procedure(F.col("text")).alias("steps")).where(F.size("steps") > 0)
    first = found.groupBy("task_id").agg(F.min(F.struct("rank", "id", "steps")).alias("f"))
    return first.select("task_id", F.col("f.id").alias("id"), F.posexplode("f.steps").alias("pick", "sentence")).select("task_id", "id", "sentence", (F.col("pick") + 1).cast("long").alias("pick"))


def direct(queries: DataFrame, hits: DataFrame, max_spans: int = 12) -> DataFrame:
    """(task_id, id, sentence, pick): sentences that answer a query without a model's help.

    ``queries`` has task_id and query, ``hits`` task_id, id, text, score and rank. The steps of a procedure
    come first where one is asked for; else of the evidence what is a sentence to answer with, has four fifths
    of the query's content terms, defines what a definition is asked of, names what a name is asked of, is about paying
    where the question is, and has the question's dates.
    """
    steps = _procedures(queries, hits)
    q, s = F.col("query"), F.col("sentence")
    named = asks_name(q)
    terms = F.when(named, F.array_except(content_terms(q), F.array(F.lit("name"), F.lit("our"), F.lit("my")))).otherwise(content_terms(q))
    asked = queries.select("task_id", "query", terms.alias("terms"), named.alias("named"), current_question(q).alias("question"))
    spans = V.evidence(queries, hits, max_spans).select("task_id", "id", "sentence", "pick").join(asked, "task_id").join(steps.select("task_id").distinct(), "task_id", "left_anti")
    covered = F.size(F.array_intersect("terms", content_terms(s))) / F.greatest(F.size("terms"), F.lit(1)) >= COVERED
    question = F.col("question")
    fits = ~s.endswith("?") & P.answer_span(s) & covered & defines(q, s) & (~F.col("named") | s.rlike(NAMING)) & (~question.rlike(PAYING) | s.rlike(PAID)) & P.dates_kept(question, s)
    return steps.unionByName(spans.where(fits).select("task_id", "id", "sentence", "pick"))


def selected(queries: DataFrame, spans: DataFrame) -> DataFrame:
    """``spans`` (task_id, id, sentence, pick) to answer with: for a name the shortest sentence that gives it, or all such if they disagree."""
    q, s = F.col("query"), F.col("sentence")
    question = current_question(q)
    topic = F.array_except(content_terms(F.regexp_extract(question, NAME, 1)), F.array(F.lit("our"), F.lit("my")))
    asked = queries.select("task_id", F.when(asks_name(question), topic).alias("topic"))
    rows = spans.join(asked, "task_id", "left")
    names = F.coalesce((F.size("topic") > 0) & (F.size(F.array_except("topic", content_terms(s))) == 0) & s.rlike(NAMING) & ~s.endswith("?"), F.lit(False))
    given = F.trim(F.lower(F.element_at(F.split(s, NAMING), -1)))
    w = Window.partitionBy("task_id")
    rows = rows.withColumns({"_names": names, "_given": F.when(names, given)})
    rows = rows.withColumns({"_any": F.max("_names").over(w), "_one": F.min("_given").over(w) == F.max("_given").over(w), "_best": F.min(F.when(F.col("_names"), F.struct(F.length("sentence"), "pick"))).over(w)})
    keep = ~F.col("_any") | (F.col("_names") & (~F.col("_one") | (F.col("_best.pick") == F.col("pick"))))
    return rows.where(keep).select("task_id", "id", "sentence", "pick")


def catalogue(hits: DataFrame) -> DataFrame:
    """(task_id, id, rank, sid, sentence): the sentences of every hit's lines, numbered "rank.place" as a model is shown them."""
    # F.trim by itself would take a sentence's place as the characters to cut off
    parts = F.flatten(F.transform(F.split("text", "\n", -1), lambda line: F.filter(F.transform(F.split(line, SENTENCE, -1), lambda x: F.trim(x)), lambda x: x != "")))
    each = hits.select("task_id", "id", "rank", F.posexplode(parts).alias("_at", "sentence"))
    return each.select("task_id", "id", "rank", F.concat_ws(".", "rank", F.col("_at") + 1).alias("sid"), squeeze(F.col("sentence")).alias("sentence"))


def prompts(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(task_id, prompt): the query and its hits' numbered sentences."""
    line = F.concat(F.lit("["), F.col("sid"), F.lit("] "), F.col("sentence"))
    shown = catalogue(hits).select("task_id", F.struct("rank", F.split("sid", r"\.")[1].cast("int").alias("at"), line.alias("line")).alias("s"))
    text = shown.groupBy("task_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["line"]), "\n").alias("lines"))
    return queries.join(text, "task_id").select("task_id", F.concat(F.lit("Query: "), "query", F.lit("\n\n"), "lines").alias("prompt"))


def chosen(replies: DataFrame, hits: DataFrame) -> DataFrame:
    """(task_id, id, sentence, pick) of the sentence numbers in replies (task_id, reply) like {"span_ids": ["1.3"]}; unknown numbers and broken replies choose nothing."""
    ids = F.from_json(F.regexp_extract("reply", r"(?s)(\{.*\})", 1), "span_ids array<string>")["span_ids"]
    asked = replies.select("task_id", F.posexplode(ids).alias("pick", "sid"))
    return asked.join(catalogue(hits), ["task_id", "sid"]).select("task_id", "id", "sentence", (F.col("pick") + 1).cast("long").alias("pick"))


def verified(queries: DataFrame, hits: DataFrame, spans: DataFrame, max_spans: int = 6) -> DataFrame:
    """(task_id, id, sentence, pick): of chosen ``spans`` (task_id, id, sentence, pick), in their order, the first that their passage holds word for word and that answer the query."""
    q, s = F.col("query"), F.col("sentence")
    asked = queries.select("task_id", "query", current_question(q).alias("question"), content_terms(current_question(q)).alias("terms"))
    held = hits.select("task_id", "id", "text").dropDuplicates(["task_id", "id"])
    rows = spans.withColumn("sentence", squeeze(s)).join(asked, "task_id").join(held, ["task_id", "id"])
    least = F.greatest(F.lit(1), F.floor(F.size("terms") * 0.30 + 0.999).cast("int"))
    near = (F.size("terms") == 0) | (P.shared_stems(F.col("terms"), content_terms(s)) >= least) | P.steps_towards(q, s, squeeze(F.col("text")))
    question = F.col("question")
    ok = (s != "") & F.contains(squeeze(F.col("text")), s) & P.answer_span(s) & P.answer_shape(question, s) & near & P.answers_relation(question, s)
    nth = F.row_number().over(Window.partitionBy("task_id").orderBy("pick"))
    return rows.where(ok).withColumn("_n", nth).where(F.col("_n") <= max_spans).select("task_id", "id", "sentence", F.col("_n").cast("long").alias("pick"))


def blocks(passages: DataFrame, most_lines: int = 12, most_chars: int = 700) -> DataFrame:
    """(id, heading, pos, n_lines, block): a heading of five words at most, blank lines, and the two to ``most_lines`` lines up to the next blank one.

    Runs of lines are found as gaps and islands: a line's island is how many blank lines stand before it.
    """
    lines = passages.select("id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).withColumn("blank", F.trim(F.regexp_replace("line", r"\s", " ")) == "")
    w = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    runs = lines.withColumn("island", F.sum(F.col("blank").cast("int")).over(w)).where("NOT blank")
    runs = runs.groupBy("id", "island").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("rows"))
    runs = runs.select("id", "island", F.size("rows").alias("n"), F.col("rows")[0]["at"].alias("first"), F.element_at("rows", -1)["at"].alias("last"), F.element_at("rows", -1)["line"].alias("tail"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("body"))
    before = Window.partitionBy("id").orderBy("island")
    runs = runs.withColumns({"heading": F.lag("tail").over(before), "at": F.lag("last").over(before)})
    block = F.concat_ws("\n", "heading", F.lit(""), "body")
    ok = F.col("heading").isNotNull() & F.col("n").between(2, most_lines) & (P.word_count(F.col("heading")) <= 5) & (F.length(block) <= most_chars)
    return runs.where(ok).select("id", F.trim("heading").alias("heading"), F.col("at").cast("long").alias("pos"), F.col("n").cast("long").alias("n_lines"), squeeze(block).alias("block"))


def expanded(spans: DataFrame, queries: DataFrame, found: DataFrame) -> DataFrame:
    """``spans`` (task_id, id, sentence, pick) with a chosen heading replaced by its whole block (of :func:`blocks`), if all of its two or more content terms are in the query."""
    asked = queries.select("task_id", content_terms(F.col("query")).alias("terms"))
    first = found.groupBy("id", "heading").agg(F.min_by("block", "pos").alias("block"))
    rows = spans.join(asked, "task_id", "left").join(first.withColumnRenamed("heading", "sentence"), ["id", "sentence"], "left")
    own = content_terms(F.col("sentence"))
    whole = F.col("block").isNotNull() & (F.size(own) >= 2) & (F.size(F.array_except(own, F.col("terms"))) == 0)
    return rows.select("task_id", "id", F.when(whole, F.col("block")).otherwise(F.col("sentence")).alias("sentence"), "pick")


__all__ = ["asks_name", "blocks", "catalogue", "chosen", "direct", "expanded", "prompts", "selected", "sentences", "verified"]
