"""Queries with models, compound requests and keyed state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarryline.functions.text import CONTENT_STOPWORDS, content_terms
from quarryline.operators import evidence as V
from quarryline.operators import index, intents, models
from quarryline.plans.base import BM25, TOKENS, query, values
from quarryline.plans.search import sparse_hits
from quarryline.plans.transcripts import DECIDED
from quarryline.session import shared_folder
from quarryline.sources.indexes import passage_vectors
from quarryline.sources.tables import chunks, passages, table, tasks
from quarryline.streaming import stateful


@query()
def hash_embedding_blake(spark, sf):
    return models.encode(tasks(spark, sf), "task_id", "query")


@query(f"""WITH w AS (SELECT item_id AS task_id, unnest({TOKENS.format('text')}) AS t FROM benchmark)
SELECT * FROM (SELECT task_id, CAST('0x' || substr(md5(t), 1, 6) AS BIGINT) % 64 AS bucket, sum(CASE WHEN CAST('0x' || substr(md5(t), 7, 1) AS INT) % 2 = 0 THEN 1 ELSE -1 END) AS weight FROM w GROUP BY ALL) WHERE weight <> 0""")
def hash_embedding_md5(spark, sf):
    return models.native_hash_embedding(tasks(spark, sf), "task_id", "full")


@query()
def dense_hash_topk(spark, sf):
    asked = models.encode(tasks(spark, sf), "task_id", "query").withColumnRenamed("task_id", "query_id")
    return passage_vectors(spark, sf).search(asked, own=False)


@query(f"""WITH {BM25}, c AS (SELECT task_id, s.id, s.rank AS old_rank, round(len(list_intersect(list_distinct({TOKENS.format('query')}), list_distinct({TOKENS.format("coalesce(d.text, '')")})))
/ greatest(1, len(list_distinct({TOKENS.format('query')}))), 6) AS score FROM sparse s JOIN task USING (task_id) JOIN documents d ON doc_id = s.id),
r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, old_rank) AS rank FROM c) SELECT task_id, id, score, old_rank, rank FROM r WHERE rank <= 5""")
def reranked(spark, sf):
    hits = sparse_hits(spark, sf).join(passages(spark, sf).select("id", "text"), "id").join(tasks(spark, sf).select("task_id", "query"), "task_id")
    return models.rerank(hits)


#: Requests made of the first words a, b, c, d of each user turn, by its place in the conversation.
SHAPES = (
    "'What is ' || a || ' ' || b || ' and how do I use it?'",
    "'How and why does ' || a || ' change?'",
    "a || ' and ' || b || ' prices'",
    "'Reset the ' || a || '; also, where is the ' || b || '? What about ' || c || '?'",
    "'When was ' || a || ' released and when was ' || b || ' released in 2021.'",
    "a || ' . ' || b || ' . ' || c || ' ' || d || ' . ' || a || ' . ' || d",
    "'Explain ' || a || '. Additionally, can ' || b || ' run plus is ' || c || ' free'",
)
REQUEST = "CASE (conv_id + turn / 2) % 7 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(SHAPES)) + " END"
TURN_WORDS = "regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+')"


def _requests(spark, sf):
    """(k, q): a request for each user turn."""
    turns = table(spark, sf, "conversations").where("role = 'user'")
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z0-9_]+"), F.lit(0))
    named = turns.select("conv_id", "turn", *[F.coalesce(F.get(words, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate("abcd")])
    return named.select(F.concat_ws("-", "conv_id", "turn").alias("k"), F.expr(REQUEST.replace("turn / 2", "turn div 2")).alias("q"))


def _cut_sql(text: str, rules) -> str:
    for pattern, to in rules:
        to = to.replace(intents.MARK, "' || chr(30) || '").replace("$", "\\")
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    bare = "trim(regexp_replace(regexp_replace(trim(p), '" + intents.CLOSING + "', ''), '" + intents.OPENING + "', ''))"
    return f"list_filter(list_transform(string_split({text}, chr(30)), lambda p: {bare}), lambda p: p <> '')"


EVENTS_SQL = r"list_transform(ps, lambda p: regexp_extract_all(lower(p), '\b(" + "|".join(intents.EVENTS) + r")\b'))"
PARTS_SQL = rf"""
w AS (SELECT conv_id, turn, {TURN_WORDS} AS ws FROM conversations WHERE role = 'user'),
n AS (SELECT conv_id, turn, {", ".join(f"coalesce(ws[{i + 1}], '') AS {x}" for i, x in enumerate("abcd"))} FROM w),
r AS (SELECT conv_id || '-' || turn AS k, trim({REQUEST.replace("turn / 2", "turn // 2")}) AS q FROM n),
c AS (SELECT k, q, {_cut_sql("q", [(intents.LIST, intents.MARK)])} AS listed, {_cut_sql("q", intents.boundaries())} AS cut FROM r),
p AS (SELECT k, q, (CASE WHEN len(listed) > 1 THEN listed ELSE cut END)[1:4] AS ps,
             regexp_extract(regexp_replace(q, '[ .?!]+$', ''), '{intents.DATE}', 1) AS date FROM c),
e AS (SELECT *, {EVENTS_SQL} AS ev FROM p),
f AS (SELECT k, q, CASE WHEN date <> '' AND len(ps) > 1 AND len(list_reduce(ev, lambda x, y: list_intersect(x, y))) > 0
             THEN list_transform(ps, lambda p: CASE WHEN regexp_matches(p, '\b\d{{4}}\b') THEN p ELSE p || ' ' || date END) ELSE ps END AS ps FROM e),
g AS (SELECT *, regexp_extract(ps[1], '{intents.SUBJECT}', 1) AS subject FROM f),
parts AS (SELECT k, q, CASE
  WHEN regexp_matches(q, '{intents.BOTH}') THEN list_transform([1, 2], lambda i: (CASE i WHEN 1 THEN regexp_extract(q, '{intents.BOTH}', 1) ELSE regexp_extract(q, '{intents.BOTH}', 2) END) || ' ' || regexp_replace(regexp_extract(q, '{intents.BOTH}', 3), '[ .?!]+$', ''))
  WHEN len(ps) < 2 THEN [q]
  WHEN subject <> '' AND NOT regexp_matches(subject, '(?i)\b(?:and|or)\b') THEN list_concat(ps[1:1], list_transform(ps[2:], lambda p: regexp_replace(p, '(?i)\bit\b', subject, 'g')))
  ELSE ps END AS ps FROM g)
"""


@query(f"WITH {PARTS_SQL} SELECT k, array_to_string(ps, ' / ') AS parts FROM parts")
def decomposition(spark, sf):
    return intents.with_parts(_requests(spark, sf), "q").select("k", F.array_join("parts", " / ").alias("parts"))


def _bag_sql(text: str) -> str:
    stops = ", ".join(f"'{w}'" for w in [*CONTENT_STOPWORDS, *intents.FILLERS])
    kept = f"list_filter(list_transform(regexp_extract_all({text}, '[A-Za-z0-9_]+'), lambda t: lower(t)), lambda t: t NOT IN ({stops}))"
    return f"list_transform({kept}, lambda t: CASE WHEN length(t) > 4 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN t[:-2] ELSE t END)"


MATCHED = f"""{PARTS_SQL},
cases AS (SELECT k, ps, list_transform(range(1, len(ps) + 1), lambda i: CASE WHEN i = 1 THEN ps[len(ps)] ELSE ps[i - 1] || ' ' || k END) AS expected FROM parts),
ex AS (SELECT k, i, {_bag_sql("expected[i]")} AS e FROM cases, unnest(range(1, len(expected) + 1)) AS u(i)),
pr AS (SELECT k, j, {_bag_sql("ps[j]")} AS p FROM cases, unnest(range(1, len(ps) + 1)) AS u(j)),
pair AS (SELECT k, i, j FROM ex JOIN pr USING (k) WHERE CASE WHEN len(e) + len(p) = 0 THEN 0
  ELSE 2.0 * list_sum(list_transform(list_distinct(e), lambda w: least(len(list_filter(e, lambda x: x = w)), len(list_filter(p, lambda x: x = w))))) / (len(e) + len(p)) END >= 0.5),
ways AS (SELECT k, 0 AS i, 0 AS n, [0]::BIGINT[] AS used FROM cases
  UNION ALL SELECT ways.k, ways.i + 1, CASE WHEN pair.j IS NULL THEN n ELSE n + 1 END, CASE WHEN pair.j IS NULL THEN used ELSE list_append(used, pair.j) END
  FROM ways JOIN cases ON cases.k = ways.k AND ways.i < len(expected)
  LEFT JOIN (SELECT k, i, j FROM pair UNION ALL SELECT k, unnest(range(1, len(ps) + 1)), NULL FROM cases) AS pair ON pair.k = ways.k AND pair.i = ways.i + 1
  WHERE pair.j IS NULL OR NOT list_contains(used, pair.j)),
matched AS (SELECT k, any_value(len(expected)) AS n_expected, any_value(len(ps)) AS n_predicted, max(n)::BIGINT AS n_matched, any_value(len(ps) > len(expected)) AS over_split
FROM ways JOIN cases USING (k) GROUP BY k)"""


def _matched(spark, sf):
    """Parts against the same in another order, all but one with a word more."""
    cases = intents.with_parts(_requests(spark, sf), "q")
    expected = F.transform("parts", lambda p, i: F.when(i == 0, F.element_at("parts", -1)).otherwise(F.concat(F.get("parts", i - 1), F.lit(" "), F.col("k"))))
    return intents.with_matching(cases.withColumn("expected", expected), "expected", "parts").select("k", "n_expected", "n_predicted", "n_matched", "over_split")


@query(f"WITH RECURSIVE {MATCHED} SELECT k, n_expected, n_predicted, n_matched, over_split FROM matched")
def intent_matching(spark, sf):
    return _matched(spark, sf)


@query(f"""WITH RECURSIVE {MATCHED}, mc AS (SELECT *, n_expected > 1 AS compound, n_matched = n_expected AND n_predicted = n_expected AS ok FROM matched)
SELECT count(*) AS cases, count(*) FILTER (compound) AS compound, count(*) FILTER (n_expected = 1) AS single,
coalesce(round(count(*) FILTER (compound AND ok) / nullif(count(*) FILTER (compound), 0), 4), 0) AS compound_success_rate,
coalesce(round(sum(n_matched) FILTER (compound) / nullif(sum(n_expected) FILTER (compound), 0), 4), 0) AS compound_recall,
coalesce(round(sum(n_matched) FILTER (compound) / nullif(sum(n_predicted) FILTER (compound), 0), 4), 0) AS compound_precision,
coalesce(round(count(*) FILTER (compound AND n_predicted > 1) / nullif(count(*) FILTER (compound), 0), 4), 0) AS compound_detection_rate,
coalesce(round(count(*) FILTER (n_expected = 1 AND n_predicted > 1) / nullif(count(*) FILTER (n_expected = 1), 0), 4), 0) AS single_over_split_rate,
coalesce(round(count(*) FILTER (n_expected = 1 AND n_predicted <= 1) / nullif(count(*) FILTER (n_expected = 1), 0), 4), 0) AS single_correct_rate FROM mc""")
def decomposition_totals(spark, sf):
    return intents.matching_report(_matched(spark, sf))


def _terms_sql(text: str) -> str:
    stops = ", ".join(f"'{w}'" for w in CONTENT_STOPWORDS)
    return f"list_distinct(list_filter(list_transform(regexp_extract_all({text}, '[A-Za-z0-9_]+'), lambda t: lower(t)), lambda t: length(t) > 2 AND t NOT IN ({stops})))"


#: What users ask after their first words, by the place of the turn: references of all kinds.
ASIDES = ("Is this clinic open?", "What is its fee?", "Does the program apply?", "How does it work?", "Show those camp facilities", "SDK best practices?", "")
ASIDE = "CASE (conv_id + turn / 2) % 7 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(ASIDES)) + " END"
SAID = "CASE WHEN (conv_id + turn) % 5 = 0 THEN 'The clinic and its program have campgrounds. ' ELSE '' END"


@query(rf"""WITH said AS (SELECT conv_id, turn, role, {SAID} || coalesce(text, '') AS text FROM conversations),
h AS (SELECT *, list(struct_pack(role := role, text := text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS l FROM said),
t AS (SELECT conv_id || '-' || turn AS key, {ASIDE.replace("turn / 2", "turn // 2")} || CASE WHEN turn % 3 = 0 THEN '' ELSE ' ' || coalesce(regexp_extract_all(text, '[A-Za-z0-9_]+')[1], '') END AS q, coalesce(l, []) AS l FROM h WHERE role = 'user'),
c AS (SELECT *, array_to_string(list_transform(l, lambda x: x.text), ' ') AS ctx FROM t),
d AS (SELECT *, {_terms_sql("q")} AS own, {_terms_sql("ctx")} AS about, trim(ctx) = '' AS silent, regexp_extract(q, '{intents.POINTING}', 1) || regexp_extract(q, '{intents.POINTING}', 2) AS pointed FROM c),
s AS (SELECT *, list_distinct(list_transform({_terms_sql("pointed")}, lambda x: CASE WHEN x LIKE '%ies' THEN regexp_replace(x, 'ies$', 'y') ELSE rtrim(x, 's') END)) AS ph,
  list_transform(about, lambda x: CASE WHEN x LIKE '%ies' THEN regexp_replace(x, 'ies$', 'y') ELSE rtrim(x, 's') END) AS sd FROM d),
u AS (SELECT *, CASE WHEN len(ph) > 1 THEN list_filter(ph, lambda x: x <> 'facility') ELSE ph END AS need, CASE WHEN list_has_any(sd, ['camping', 'campground']) THEN list_append(sd, 'camp') ELSE sd END AS have,
  regexp_extract(q, '(?is)^(.*?){intents.PRONOUN[4:]}', 1) AS ahead, coalesce(l[1].text, '') AS asked, coalesce(l[2].text, '') AS told FROM s),
v AS (SELECT *, {_terms_sql("asked")} AS ta, list_intersect({_terms_sql("asked")}, {_terms_sql("told")}) AS tc,
  list_filter(regexp_extract_all(asked, '[A-Za-z0-9_]+'), lambda x: length(x) >= 3 AND upper(x) = x AND lower(x) <> x) AS caps FROM u)
SELECT key, CASE WHEN pointed <> '' THEN silent OR len(list_filter(need, lambda x: NOT list_contains(have, x))) > 0
  ELSE (regexp_matches(q, '{intents.PRONOUN}') AND len({_terms_sql("ahead")}) < 2 AND NOT list_has_any(own, about)
        AND NOT coalesce(len(l) = 2 AND l[1].role = 'user' AND l[2].role IN ('agent', 'assistant') AND len(list_filter(own, lambda x: x NOT IN ({", ".join(f"'{x}'" for x in intents.ROUTINE)}))) = 0
             AND (len(tc) >= 2 OR (len(ta) BETWEEN 1 AND 2 AND len(tc) = len(ta)) OR list_has_any(caps, regexp_extract_all(told, '[A-Za-z0-9_]+'))), false))
    OR (regexp_matches(q, '(?i)\bsdk\b') AND len(list_filter(own, lambda x: x NOT IN ('sdk', 'best', 'practices'))) = 0 AND silent) END AS unresolved FROM v""")
def clarification(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, -1)
    said = table(spark, sf, "conversations").withColumn("text", F.concat(F.expr(SAID), F.coalesce("text", F.lit(""))))
    c = said.withColumn("ctx", F.collect_list(F.struct("role", "text")).over(w)).where("role = 'user'")
    first = F.coalesce(F.get(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0)), F.lit(0)), F.lit(""))
    asked = F.concat(F.expr(ASIDE.replace("turn / 2", "turn div 2")), F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit(" "), first)))
    keyed = c.select(F.concat_ws("-", "conv_id", "turn").alias("key"), asked.alias("q"), "ctx")
    return intents.with_open_reference(keyed, "q", "ctx").select("key", "unresolved")


REFINED = [
    (1, "The fee is ten dollars. Parking is free.", "The fee is five dollars for seniors.", "only for seniors", "Parking is free. The fee is five dollars for seniors."),
    (2, "The fee is ten dollars.", "Dogs are welcome.", "what about dogs", "The fee is ten dollars.\n\nDogs are welcome."),
    (3, "The fee is ten dollars.", "Dogs are welcome.", "only dogs", "Dogs are welcome."),
]


@query(f"SELECT k, a AS answer FROM {values([(k, a) for k, _, _, _, a in REFINED], ['k', 'a'])}")
def refined_answers(spark, sf):
    rows = spark.createDataFrame([r[:4] for r in REFINED], "k int, previous string, delta string, delta_query string")
    return V.refined(rows).select("k", "answer")


REPEATED = [(1, ["a  b", "a b", "c"], "a b|c"), (2, ["the whole of a sentence that is quite long indeed", "before the whole of a sentence that is quite long indeed after"], "before the whole of a sentence that is quite long indeed after"), (3, ["", " "], "")]


@query(f"SELECT k, s AS spans FROM {values([(k, s) for k, _, s in REPEATED], ['k', 's'])}")
def evidence_without_repeats(spark, sf):
    return spark.createDataFrame([r[:2] for r in REPEATED], "k int, s array<string>").select("k", F.array_join(V.without_repeats(F.col("s")), "|").alias("spans"))


STEPS = [(1, "Step 1. Open it\nStep 2. Close  it\n", "Step 1. Open it|Step 2. Close it"), (2, "Step 1. Only one", ""), (3, "Step 2. Late\nStep 3. Later", ""), (4, "none", "")]


@query(f"SELECT k, s AS steps FROM {values([(k, s) for k, _, s in STEPS], ['k', 's'])}")
def procedural_steps(spark, sf):
    return spark.createDataFrame([r[:2] for r in STEPS], "k int, s string").select("k", F.array_join(V.procedure(F.col("s")), "|").alias("steps"))


def drained(spark, made, schema_of, name: str, watch=None):
    """Write rows as files, run a streaming operator over them to their end, and return its output table."""
    source, out, mark = (shared_folder(spark, f"{name}-{x}") for x in ("in", "out", "mark"))
    made.write.parquet(source)
    stream = spark.readStream.schema(made.schema).parquet(source)
    result = schema_of(stream)
    run = result.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(result.schema).parquet(out)


@query(f"WITH {DECIDED} SELECT stream_id, idx, committed, decision FROM dec")
def stateful_controller(spark, sf):
    made = chunks(spark, sf).select("stream_id", "idx", "text", "is_final").repartition(4, "stream_id")
    return drained(spark, made, stateful.controller, "controller")


@query(f"""WITH u AS (SELECT conv_id, turn + 1 AS turn, {_terms_sql("coalesce(text, '')")} AS ts FROM conversations WHERE role = 'user'),
v AS (SELECT conv_id, turn, len(list_intersect(ts, lag(ts, 1, []) OVER (PARTITION BY conv_id ORDER BY turn))) >= 3 AS again FROM u),
t AS (SELECT CAST(c.conv_id AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS version, trim(text) AS d, coalesce(again, false) AS again
  FROM conversations c LEFT JOIN v ON v.conv_id = c.conv_id AND v.turn = c.turn WHERE role = 'assistant' AND trim(coalesce(text, '')) <> ''),
g AS (SELECT *, sum(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY version) AS part FROM t)
SELECT session_id, version, version - 1 AS previous_version, string_agg(d, chr(10) || chr(10)) OVER (PARTITION BY session_id, part ORDER BY version) AS answer FROM g""")
def session_versions(spark, sf):
    """A reply replaces the answer where its question shares three content terms with the one before, and is appended elsewhere."""
    talk = table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    asked = talk.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), content_terms(F.coalesce("text", F.lit(""))).alias("ts"))
    again = asked.select("conv_id", "turn", (F.size(F.array_intersect("ts", F.coalesce(F.lag("ts").over(w), F.array().cast("array<string>")))) >= 3).alias("again"))
    turns = talk.where("role = 'assistant'").join(again, ["conv_id", "turn"], "left")
    made = turns.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), F.col("text").alias("delta"), F.coalesce("again", F.lit(False)).alias("replaces"))
    return drained(spark, made, stateful.session_answers, "session")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf):
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    n = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")

