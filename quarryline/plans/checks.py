"""Queries that check answers, files and dialogues, and further joins of the evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarryline.functions import predicates as P
from quarryline.functions import text as T
from quarryline.operators import evidence as V
from quarryline.operators import scoring
from quarryline.plans.base import BM25, query, spoken, values
from quarryline.plans.cleaning import QRELS, qrels
from quarryline.plans.measures import CASES, cases
from quarryline.plans.search import sparse_hits
from quarryline.plans.transcripts import DECIDED
from quarryline.sources.tables import chunks, passages, table
from quarryline.streaming import transcripts as S

SENTENCES = [
    (1, "Contact us or see the site map for more of this"), (2, "Too short here"), (3, "Is this a question?"), (4, "Offices open at nine every weekday."),
    (5, "For more information see:"), (6, "I do not have enough information to say."), (7, "The list follows:"), (8, "Opened on 3 May 2020 in the old hall"),
]


@query(f"""SELECT conv_id, turn, len(list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> '')) >= 4 AND NOT regexp_matches(s, '[?:]\\s*$')
AND len(list_filter(['contact us', 'site map', 'skip to content', 'skip to main content', 'advanced search'], lambda m: contains(lower(s), m))) < 2
AND NOT regexp_matches(s, '(?i)\\b(?:for more information|for .+ record),?\\s*see\\s*:?$') AS span,
regexp_matches(s, '{P.ABSTAIN.replace(chr(39), chr(39) * 2)}') AS abstains, contains(lower(s), '3 may 2020') AS dated FROM (SELECT conv_id, turn, {spoken(SENTENCES, 'conv_id + turn')} AS s FROM conversations)""")
def answer_spans(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.expr(spoken(SENTENCES, "conv_id + turn")).alias("s"))
    return rows.select("conv_id", "turn", P.answer_span(F.col("s")).alias("span"), P.abstains(F.col("s")).alias("abstains"), P.dates_kept(F.lit("what opened on 3 May 2020?"), F.col("s")).alias("dated"))


@query("""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS heard FROM conversations WHERE role = 'user'""")
def normalized_hypotheses(spark, sf):
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", T.normalize_asr(F.col("text")).alias("heard"))


@query("""SELECT item_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[!-/:-@\\[-`{-~]', '', 'g'), '\\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ') AS answer FROM benchmark""")
def normalized_answers(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.normalize_answer(F.col("text")).alias("answer"))


@query("SELECT page_id, length(x) AS n, sha1(x) AS digest FROM (SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&') AS x FROM pages)")
def html_without_tags(spark, sf):
    return table(spark, sf, "pages").withColumn("x", T.clean_html(F.col("html"))).select("page_id", F.length("x").cast("long").alias("n"), F.sha1("x").alias("digest"))


STOPPED = "['" + "', '".join(T.CONTENT_STOPWORDS) + "']"
TOKENIZED = "regexp_extract_all({0}, '[A-Za-z0-9_]+')"


@query(f"""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS q, lag(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter({TOKENIZED.format('q')}, lambda x: length(x) > 2 AND NOT list_contains({STOPPED}, lower(x)) AND NOT list_contains(list_concat(list_transform({TOKENIZED.format('a')}, lambda y: lower(y)),
['only', 'instead', 'actually', 'rather', 'except']), lower(x))), ' ') AS terms FROM t WHERE role = 'user' AND a IS NOT NULL""")
def refinement_focus(spark, sf):
    """What is new in a user's turn against the turn before."""
    talk = table(spark, sf, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    turns = talk.withColumn("a", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("role = 'user' AND a IS NOT NULL")
    return turns.select("conv_id", "turn", F.array_join(V.novel_terms(F.col("text"), F.col("a")), " ").alias("terms"))


REPLIES = [(1, 'Sure: ```json\n{"a": 1}\n```'), (2, "x {bad} then [1, 2] y"), (3, "none"), (4, '{"p": "50\\%"}'), (5, None)]


@query("""SELECT * FROM (VALUES (1, '{"a":1}'), (2, '[1,2]'), (3, NULL), (4, '{"p":"50%"}'), (5, NULL)) AS t(k, found)""")
def reply_json(spark, sf):
    return spark.createDataFrame(REPLIES, "k int, s string").select("k", scoring.found_json(F.col("s")).alias("found"))


LCS = [(1, "the cat sat on the mat", "the cat lay on a mat"), (2, "a b c", "x y"), (3, "", "x"), (4, "one two", "zero one two three")]


@query("SELECT * FROM (VALUES (1, 0.666667, 0.666667), (2, 0.0, 0.0), (3, 0.0, 1.0), (4, 0.666667, 1.0)) AS t(k, rouge, extractive)")
def rouge_scores(spark, sf):
    r = spark.createDataFrame(LCS, "k int, p string, t string")
    return r.select("k", F.round(scoring.rouge(F.col("p"), F.col("t")), 6).alias("rouge"), F.round(scoring.extractiveness(F.col("p"), F.col("t")), 6).alias("extractive"))


@query("SELECT doc_id, length(coalesce(text, '')) AS n FROM documents")
def answer_lengths(spark, sf):
    return passages(spark, sf).select(F.col("id").alias("doc_id"), F.length("text").cast("long").alias("n"))


@query("""WITH s AS (SELECT conv_id, turn, text, lower(role || ' ' || text) AS hay FROM conversations) SELECT conv_id, turn FROM s WHERE contains(hay, 'user') AND contains(hay, 'th')""")
def scenario_search(spark, sf):
    hay = F.lower(F.concat_ws(" ", "role", "text"))
    return table(spark, sf, "conversations").where(F.contains(hay, F.lit("user")) & F.contains(hay, F.lit("th"))).select("conv_id", "turn")


@query(f"""WITH {BM25}, {QRELS}, p AS (SELECT task_id, count(*) AS n, count(*) FILTER (id % 10 <> 0) AS valid FROM sparse WHERE rank <= 3 GROUP BY task_id),
h AS (SELECT DISTINCT task_id FROM sparse JOIN qrel USING (task_id, id) WHERE rank <= 3)
SELECT count(*) AS tasks, round(avg(CASE WHEN n = valid THEN 1.0 ELSE 0 END), 4) AS citation_valid_rate, round(avg(CASE WHEN h.task_id IS NOT NULL THEN 1.0 ELSE 0 END), 4) AS qrel_hit_rate,
round(avg(CASE WHEN n = 0 OR n IS NULL THEN 1.0 ELSE 0 END), 4) AS abstention_rate FROM task LEFT JOIN p USING (task_id) LEFT JOIN h ON h.task_id = task.task_id""")
def provider_metrics(spark, sf):
    from quarryline.sources.tables import tasks

    hits = sparse_hits(spark, sf, 3)
    p = hits.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") % 10 != 0).alias("valid"))
    h = hits.join(qrels(spark, sf), ["task_id", "id"]).select("task_id").distinct().withColumn("hit", F.lit(1.0))
    df = tasks(spark, sf).select("task_id").join(p, "task_id", "left").join(h, "task_id", "left")
    rate = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    return df.agg(F.count(F.lit(1)).alias("tasks"), rate(F.col("n") == F.col("valid")).alias("citation_valid_rate"), rate(F.col("hit").isNotNull()).alias("qrel_hit_rate"), rate(F.col("n").isNull() | (F.col("n") == 0)).alias("abstention_rate"))


CLASSES = ("answerable", "partial", "unanswerable", "underspecified")


@query(f"""WITH {CASES}, k(case_class) AS (VALUES {', '.join(f"('{c}')" for c in CLASSES)}),
a AS (SELECT case_class, count(*) AS n, round(avg(CASE WHEN review = 'approved' THEN 1.0 ELSE 0 END), 4) AS approved FROM cs GROUP BY case_class)
SELECT case_class, coalesce(n, 0) AS n, coalesce(approved, 0) AS approved FROM k LEFT JOIN a USING (case_class)""")
def per_class_report(spark, sf):
    a = cases(spark, sf).groupBy("case_class").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("review") == "approved").cast("double")), 4).alias("approved"))
    k = spark.createDataFrame([(c,) for c in CLASSES], "case_class string")
    return k.join(a, "case_class", "left").select("case_class", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("approved", F.lit(0.0)).alias("approved"))


@query(f"""WITH {CASES} SELECT coalesce(domain, 'all') AS domain, coalesce(case_class, 'all') AS case_class, count(*) AS n FROM cs GROUP BY GROUPING SETS ((domain), (case_class), ())""")
def report_by_domain_and_class(spark, sf):
    c = cases(spark, sf).groupingSets([["domain"], ["case_class"], []], "domain", "case_class").agg(F.count(F.lit(1)).alias("n"))
    return c.select(F.coalesce("domain", F.lit("all")).alias("domain"), F.coalesce("case_class", F.lit("all")).alias("case_class"), "n")


@query(f"""WITH {CASES}, t AS (SELECT domain, case_class, case_id, row_number() OVER (PARTITION BY domain ORDER BY case_id) - 1 AS rn, count(*) OVER (PARTITION BY domain) AS n FROM cs)
SELECT a.domain, a.case_id AS first, b.case_id AS second, a.rn % 5 AS connector FROM t a JOIN t b ON a.domain = b.domain AND b.rn = (a.rn + 7) % a.n""")
def rotated_pairs(spark, sf):
    w = Window.partitionBy("domain")
    t = cases(spark, sf).select("domain", "case_id", (F.row_number().over(w.orderBy("case_id")) - 1).alias("rn"), F.count(F.lit(1)).over(w).alias("n"))
    b = t.select("domain", F.col("case_id").alias("second"), F.col("rn").alias("other"))
    return t.withColumn("other", (F.col("rn") + 7) % F.col("n")).join(b, ["domain", "other"]).select("domain", F.col("case_id").alias("first"), "second", (F.col("rn") % 5).cast("long").alias("connector"))


BUDGET = [(1, "a", 1, 4), (1, "b", 2, 9), (1, "c", 3, 3), (1, "d", 4, 3), (2, "e", 1, 11), (2, "f", 2, 10)]


@query("SELECT * FROM (VALUES (1, 'a'), (1, 'c'), (1, 'd'), (2, 'f')) AS t(g, k)")
def budgeted_prefix(spark, sf):
    rows = spark.createDataFrame(BUDGET, "g int, k string, pos int, cost int")
    return scoring.within_budget(rows, "g", ["pos", "k"], "cost", 10).select("g", "k")


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'extra' ELSE 'missing' END AS problem FROM (SELECT doc_id FROM documents WHERE lang = 'en') a FULL OUTER JOIN (SELECT DISTINCT doc_id FROM labels) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL")
def prediction_id_check(spark, sf):
    a = table(spark, sf, "documents").where("lang = 'en'").select("doc_id", F.lit(True).alias("a"))
    b = table(spark, sf, "labels").select("doc_id").distinct().withColumn("b", F.lit(True))
    return a.join(b, "doc_id", "full_outer").where("a IS NULL OR b IS NULL").select("doc_id", F.when(F.col("a").isNull(), "extra").otherwise("missing").alias("problem"))


LINES = [(1, '{"task_id": "a", "contexts": [], "predictions": [{"text": "x"}]}'), (2, "{broken"), (3, '{"contexts": []}'), (4, '{"task_id": "b", "contexts": [1,2,3,4,5,6,7,8,9,10,11], "predictions": []}')]


@query("SELECT * FROM (VALUES (1, ''), (2, 'invalid JSON'), (3, 'missing task_id; missing predictions'), (4, 'more than 10 contexts; empty predictions')) AS t(k, problems)")
def format_checker_rules(spark, sf):
    rows = spark.createDataFrame(LINES, "k int, line string").withColumn("keys", F.json_object_keys("line"))
    size = lambda name: F.json_array_length(F.get_json_object("line", f"$.{name}"))
    ok, has = F.col("keys").isNotNull() & F.col("line").rlike(r"\}\s*$"), lambda n: F.array_contains("keys", n)
    rules = F.array_compact(F.array(F.when(~ok, "invalid JSON"), F.when(ok & ~has("task_id"), "missing task_id"), F.when(ok & ~has("predictions"), "missing predictions"), F.when(ok & (size("contexts") > 10), "more than 10 contexts"), F.when(ok & (size("predictions") == 0), "empty predictions")))
    return rows.select("k", F.array_join(rules, "; ").alias("problems"))


@query("""WITH u AS (SELECT conv_id, turn, role, text, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS reply,
list(role || ': ' || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last FROM conversations)
SELECT conv_id || '<::>' || turn AS task_id, array_to_string(last, chr(10)) AS query FROM u WHERE role = 'user' AND reply = 'assistant'""")
def beir_export(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    u = table(spark, sf, "conversations").withColumns({"reply": F.lead("role").over(w), "last": F.collect_list(F.concat("role", F.lit(": "), "text")).over(w.rowsBetween(-2, 0))})
    return u.where("role = 'user' AND reply = 'assistant'").select(F.concat_ws("<::>", "conv_id", "turn").alias("task_id"), F.array_join("last", "\n").alias("query"))


@query(f"""WITH {DECIDED} SELECT stream_id, bool_or(decision = 'Retrieve' AND ts < f) AS before_final FROM (SELECT *, max(CASE WHEN is_final THEN ts END) OVER (PARTITION BY stream_id) AS f FROM dec) GROUP BY stream_id""")
def dispatch_before_final(spark, sf):
    d = S.decisions(chunks(spark, sf))
    final = d.groupBy("stream_id").agg(F.max(F.when(F.col("is_final"), F.col("ts"))).alias("f"))
    return d.join(final, "stream_id").groupBy("stream_id").agg(F.coalesce(F.bool_or((F.col("decision") == "Retrieve") & (F.col("ts") < F.col("f"))), F.lit(False)).alias("before_final"))


@query(f"WITH {DECIDED} SELECT decision, split_part(reason, ' (', 1) AS reason, count(*) AS n FROM dec GROUP BY ALL")
def controller_health(spark, sf):
    return S.decisions(chunks(spark, sf)).groupBy("decision", F.split_part("reason", F.lit(" ("), F.lit(1)).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, round(median(x), 6) AS median FROM (SELECT l_orderkey, unnest([l_discount, l_tax, l_quantity / 50]) AS x FROM lineitem) GROUP BY l_orderkey")
def judge_medians(spark, sf):
    x = F.explode(F.array("l_discount", "l_tax", F.col("l_quantity") / 50))
    return table(spark, sf, "lineitem").select("l_orderkey", x.alias("x")).groupBy("l_orderkey").agg(F.round(F.percentile("x", 0.5), 6).alias("median"))


@query(f"WITH {BM25} SELECT task_id FROM sparse LEFT JOIN documents ON doc_id = id WHERE rank <= 5 GROUP BY task_id HAVING bool_and(coalesce(length(text) > 200, false))")
def tasks_with_full_context(spark, sf):
    hits = sparse_hits(spark, sf, 5).join(passages(spark, sf).select("id", "text"), "id", "left")
    return hits.groupBy("task_id").agg(F.bool_and(F.coalesce(F.length("text") > 200, F.lit(False))).alias("ok")).where("ok").select("task_id")


@query("SELECT user_id, count(*) AS calls, sum(length(props)) AS tokens FROM (SELECT DISTINCT event_id, user_id, props FROM events) GROUP BY user_id")
def token_usage(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "props").dropDuplicates(["event_id"])
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.length("props")).alias("tokens"))


PLACES = [(1, "fees in Texas", "https://dmv.ca.gov/x"), (2, "fees in California", "https://dmv.ca.gov/x"), (3, "fees", "https://ca.gov"), (4, "Texas or Ohio fees", "https://ca.gov"), (5, "fees in Texas", "https://www.va.gov/a"), (6, "fees in Texas", "not a url"), (7, "fees in Texas", "https://irs.gov")]


@query("SELECT * FROM (VALUES (1, false), (2, true), (3, true), (4, true), (5, true), (6, true), (7, true)) AS t(k, fits)")
def jurisdictions(spark, sf):
    return spark.createDataFrame(PLACES, "k int, q string, u string").select("k", P.jurisdiction_fits(F.col("q"), F.col("u")).alias("fits"))


@query()
def semantic_controller(spark, sf):
    from quarryline.streaming.stateful import semantic_decisions

    return semantic_decisions(chunks(spark, sf))


@query()
def spoken_streams(spark, sf):
    turns = table(spark, sf, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("stream_id"), F.coalesce("text", F.lit("")).alias("text"))
    return S.spoken(turns)
