"""Queries over direct evidence, spans that a model chose, and blocks kept whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import predicates as P
from quarryline.operators import evidence as V
from quarryline.operators import models, support
from quarryline.plans.base import TASKS, query
from quarryline.plans.measures import EVID, SENTS, TERMS
from quarryline.plans.transcripts import SPLIT
from quarryline.session import written
from quarryline.sources.indexes import passage_index
from quarryline.sources.tables import page_documents, passages, table

PLAIN = "regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9 .!?\\n]', ' ', 'g')"
#: The first sentence of each benchmark item as a question of its own.
QUESTIONS = f"task AS (SELECT item_id AS task_id, coalesce({SENTS.format('trim(' + PLAIN.format('text') + ')')}[1], '') AS query, text AS full_text FROM benchmark)"
ASKED = EVID.replace(TASKS, QUESTIONS)
IS_SPAN = f"""len({SPLIT.format('sentence')}) >= 4 AND NOT regexp_matches(sentence, '[?:]\\s*$')
  AND len(list_filter(['contact us', 'site map', 'skip to content', 'skip to main content', 'advanced search'], lambda m: contains(lower(sentence), m))) < 2
  AND NOT regexp_matches(sentence, '(?i)\\b(?:for more information|for .+ record),?\\s*see\\s*:?$')"""
DIRECT = f"""{ASKED}, direct AS (SELECT task_id, id, sentence, pick FROM evd JOIN task USING (task_id) JOIN qt USING (task_id)
  WHERE pick <= 12 AND {IS_SPAN} AND len(list_intersect(terms, {TERMS.format('sentence')})) / greatest(len(terms), 1) >= 0.8
  AND (NOT regexp_matches(query, '\\b(?:pay|paid|payment|payments)\\b') OR regexp_matches(sentence, '\\b(?:pay|paid|payment|payments|cash|credit|debit|card|fare|fares|ticket|tickets)\\b')))"""


def questions(spark, sf):
    """(task_id, query): the first sentence of each benchmark item, in plain lower case."""
    plain = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9 .!?\n]", " ")
    first = F.coalesce(F.get(support.sentences(plain), F.lit(0)), F.lit(""))
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("task_id"), first.alias("query"))


def found(spark, sf, k=5):
    """The questions' best passages, in plain lower case."""
    hits = passage_index(spark, sf).search(questions(spark, sf), k).join(passages(spark, sf).select("id", "text"), "id")
    return written(hits.withColumn("text", F.regexp_replace(F.lower("text"), "[^a-z0-9 .!?\n]", " ")), "hit-texts")


@query(f"WITH {DIRECT} SELECT task_id, id, sentence, pick FROM direct")
def direct_evidence(spark, sf):
    return support.selected(questions(spark, sf), support.direct(questions(spark, sf), found(spark, sf)))


CONTEXT = P.CONTEXT_DEPENDENT.replace("'", "''")
REASONING = P.COMPLEX.replace("'", "''")


@query(f"""WITH {DIRECT}, n AS (SELECT task_id, query, (SELECT count(*) FROM hit WHERE hit.task_id = task.task_id) AS n_hits, task_id IN (SELECT task_id FROM direct) AS direct FROM task),
w AS (SELECT task_id, CASE WHEN n_hits = 0 THEN 'no passages' WHEN regexp_matches(query, '(?i)\\band\\b') AND regexp_matches(query, '(?i)\\band\\s+(?:what|how|why|who|when|where)\\b') THEN 'compound'
  WHEN regexp_matches(query, '{REASONING}') THEN 'reasoning' WHEN regexp_matches(query, '{CONTEXT}') THEN 'context' WHEN NOT direct THEN 'no direct evidence' ELSE 'direct' END AS why FROM n)
SELECT task_id, why, why NOT IN ('no passages', 'direct') AS to_provider FROM w""")
def provider_routing(spark, sf):
    asked, hits = questions(spark, sf), found(spark, sf)
    n = hits.groupBy("task_id").agg(F.count(F.lit(1)).alias("n_hits"))
    direct = support.direct(asked, hits).select("task_id").distinct().withColumn("direct", F.lit(True))
    rows = asked.join(n, "task_id", "left").join(direct, "task_id", "left").withColumns({"n_hits": F.coalesce("n_hits", F.lit(0)), "direct": F.coalesce("direct", F.lit(False)), "multi_intent": F.col("query").rlike(r"(?i)\band\b")})
    return V.route(rows).select("task_id", "why", "to_provider")


def every_other():
    """An offline client that chooses every second sentence of each passage, and one that it wasn't shown."""
    import json
    import re

    def chat(prompt: str) -> tuple[str, int, int]:
        ids = [f"{a}.{b}" for a, b in re.findall(r"(?m)^\[(\d+)\.(\d+)\]", prompt) if int(b) % 2 == 0]
        return "```json\n" + json.dumps({"span_ids": [*ids, "9.99999"]}) + "\n```", len(prompt.split()), len(ids)

    return chat


@query(f"""WITH {ASKED}, cat AS (SELECT task_id, id, rank, unnest(flatten(list_transform(string_split(text, chr(10)), lambda l: {SENTS.format('trim(l)')}))) AS sentence,
  generate_subscripts(flatten(list_transform(string_split(text, chr(10)), lambda l: {SENTS.format('trim(l)')})), 1) AS pos, text FROM hit),
ch AS (SELECT *, {TERMS.format('sentence')} AS st FROM cat JOIN qt USING (task_id) WHERE pos % 2 = 0),
ok AS (SELECT *, len(list_filter(terms, lambda t: len(list_filter(st, lambda o: t = o OR (length(t) >= 5 AND (starts_with(t, o) OR starts_with(o, t))))) > 0)) AS shared FROM ch
  WHERE {IS_SPAN} AND contains(trim(regexp_replace(text, '\\s+', ' ', 'g')), sentence))
SELECT task_id, id, sentence, pick FROM (SELECT task_id, id, sentence, row_number() OVER (PARTITION BY task_id ORDER BY rank, pos) AS pick FROM ok
  WHERE len(terms) = 0 OR shared >= greatest(1, CAST(floor(len(terms) * 0.30 + 0.999) AS INT))) WHERE pick <= 6""")
def provider_spans(spark, sf):
    asked, hits = questions(spark, sf), found(spark, sf)
    replies = models.ask(support.prompts(asked, hits), "task_id", "prompt", every_other)
    return support.verified(asked, hits, support.chosen(replies, hits))


@query(f"""WITH p AS (SELECT 'd' || doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL
  SELECT 'p' || page_id, regexp_replace(coalesce(html, ''), '<[^>]*>', chr(10), 'g') FROM pages),
l AS (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM p),
b AS (SELECT *, trim(regexp_replace(line, '\\s', ' ', 'g')) = '' AS blank FROM l),
i AS (SELECT *, sum(CASE WHEN blank THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS island FROM b),
r AS (SELECT id, island, count(*) AS n, max(pos) AS last, arg_max(line, pos) AS tail, string_agg(line, chr(10) ORDER BY pos) AS body FROM i WHERE NOT blank GROUP BY ALL),
h AS (SELECT *, lag(tail) OVER (PARTITION BY id ORDER BY island) AS heading, lag(last) OVER (PARTITION BY id ORDER BY island) AS pos FROM r)
SELECT id, trim(heading) AS heading, pos, n AS n_lines, trim(regexp_replace(heading || chr(10) || chr(10) || body, '\\s+', ' ', 'g')) AS block FROM h
WHERE heading IS NOT NULL AND n BETWEEN 2 AND 12 AND len({SPLIT.format('heading')}) <= 5 AND length(heading || chr(10) || chr(10) || body) <= 700""")
def passage_blocks(spark, sf):
    docs = passages(spark, sf).select(F.concat(F.lit("d"), "id").alias("id"), "text")
    pages = page_documents(spark, sf).select(F.concat(F.lit("p"), "id").alias("id"), "text")
    return support.blocks(docs.unionAll(pages))

