"""Queries that measure retrieval, answers, traces and curated cases."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarryline.functions import numeric as N
from quarryline.functions import predicates as P
from quarryline.functions import text as T
from quarryline.operators import curation as C
from quarryline.operators import evaluation as E
from quarryline.operators import evidence as V
from quarryline.plans.base import BM25, TASKS, TOKENS, query, spoken, values
from quarryline.plans.cleaning import QRELS, qrels
from quarryline.plans.search import STOPS, sparse_hits
from quarryline.session import written
from quarryline.sources.tables import passages, table, tasks

RANKS = f"""{BM25}, {QRELS}, top AS (SELECT * FROM sparse WHERE rank <= 5),
hr AS (SELECT task.task_id, (SELECT count(*) FROM qrel WHERE qrel.task_id = task.task_id) AS n_qrels,
  (SELECT count(*) FROM top JOIN qrel USING (task_id, id) WHERE top.task_id = task.task_id) AS n_hit,
  (SELECT min(rank) FROM top JOIN qrel USING (task_id, id) WHERE top.task_id = task.task_id) AS hit_rank FROM task)"""


def _ranks(spark, sf):
    return E.hit_ranks(tasks(spark, sf), sparse_hits(spark, sf, 5), qrels(spark, sf))


@query(f"WITH {RANKS} SELECT task_id, n_qrels, n_hit, hit_rank FROM hr")
def hit_ranks(spark, sf):
    return _ranks(spark, sf)


@query(f"""WITH {RANKS} SELECT count(*) AS tasks, round(count(hit_rank) / count(*), 4) AS success_at_k, coalesce(round(avg(CASE WHEN n_qrels > 0 THEN n_hit / n_qrels END), 4), 0) AS recall_at_k,
coalesce(round(avg(1 / hit_rank), 6), 0) AS mrr_hits, coalesce(round(sum(1 / hit_rank) / count(*), 6), 0) AS mrr_all FROM hr""")
def eval_retrieval_metrics(spark, sf):
    return E.retrieval_report(_ranks(spark, sf))


@query(f"WITH {RANKS} SELECT task_id FROM hr WHERE hit_rank IS NULL AND n_qrels > 0")
def eval_misses(spark, sf):
    return _ranks(spark, sf).where("hit_rank IS NULL AND n_qrels > 0").select("task_id")


GRADED = f"""{BM25}, {QRELS}, rel AS (SELECT task_id, id, 1 + id % 2 AS rel FROM qrel),
ideal AS (SELECT task_id, rel, row_number() OVER (PARTITION BY task_id ORDER BY rel DESC, id) AS r FROM rel),
ii AS (SELECT task_id, count(*) AS n, {", ".join(f"sum(CASE WHEN r <= {k} THEN rel / log2(r + 1) ELSE 0 END) AS i{k}" for k in (1, 3, 5))} FROM ideal GROUP BY task_id),
gg AS (SELECT task_id, {", ".join(f"sum(CASE WHEN rank <= {k} THEN rel / log2(rank + 1) ELSE 0 END) AS g{k}, count(*) FILTER (rank <= {k}) AS c{k}" for k in (1, 3, 5))} FROM sparse JOIN rel USING (task_id, id) GROUP BY task_id),
gr AS (SELECT task_id, {", ".join(f"coalesce(round(g{k} / i{k}, 6), 0) AS ndcg_{k}, coalesce(round(c{k} / n, 6), 0) AS recall_{k}" for k in (1, 3, 5))} FROM ii LEFT JOIN gg USING (task_id))"""
NAMES = [f"{m}_{k}" for k in (1, 3, 5) for m in ("ndcg", "recall")]


def _graded(spark, sf):
    rel = qrels(spark, sf).withColumn("rel", (1 + F.col("id") % 2).cast("double"))
    return E.graded(sparse_hits(spark, sf), rel)


@query(f"WITH {GRADED} SELECT task_id, {', '.join(NAMES)} FROM gr")
def ndcg_recall_at_k(spark, sf):
    return _graded(spark, sf).select("task_id", *NAMES)


@query(f"""WITH {GRADED} SELECT CASE WHEN GROUPING(coll) = 1 THEN 'all' ELSE coll END AS coll, count(*) AS n, {", ".join(f"round(avg({c}), 6) AS {c}" for c in NAMES)}
FROM (SELECT *, 'c' || (task_id % 3) AS coll FROM gr) GROUP BY ROLLUP (coll)""")
def weighted_collection_avg(spark, sf):
    return E.weighted_average(_graded(spark, sf).withColumn("coll", F.concat(F.lit("c"), F.col("task_id") % 3)), "coll", NAMES)


@query(f"""WITH {RANKS} SELECT s.k AS strategy, round(avg(CASE WHEN hit_rank <= s.n THEN 1.0 ELSE 0 END), 6) AS success, round(sum(CASE WHEN hit_rank <= s.n THEN 1 / hit_rank ELSE 0 END) / count(*), 6) AS mrr
FROM hr, (VALUES ('top1', 1), ('top3', 3), ('top5', 5)) AS s(k, n) GROUP BY s.k""")
def ablation_mrr_all_tasks(spark, sf):
    r = _ranks(spark, sf).withColumn("s", F.explode(F.array(*[F.struct(F.lit(f"top{n}").alias("k"), F.lit(n).alias("n")) for n in (1, 3, 5)])))
    hit = F.coalesce(F.col("hit_rank") <= F.col("s.n"), F.lit(False))
    return r.groupBy(F.col("s.k").alias("strategy")).agg(F.round(F.avg(hit.cast("double")), 6).alias("success"), F.round(F.sum(F.when(hit, 1 / F.col("hit_rank")).otherwise(0.0)) / F.count(F.lit(1)), 6).alias("mrr"))


#: Answers made of the first sentences (up to a full stop and a blank) of the best passages.
SENTS = r"list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')"
TERMS = "list_distinct(list_filter(" + TOKENS + ", lambda y: length(y) > 2 AND NOT list_contains(" + STOPS + ", y)))"


def plain(spark, sf):
    """Hits whose text splits at blanks after stops only, so that both engines see the same sentences."""
    hits = sparse_hits(spark, sf, 5).join(passages(spark, sf).select("id", "text"), "id")
    safe = F.regexp_replace(F.lower("text"), r"[^a-z0-9 .!?\n]", " ")
    return written(hits.withColumn("text", safe), "hit-texts")


EVID = f"""{BM25}, hit AS (SELECT task_id, s.id, score, rank, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9 .!?\\n]', ' ', 'g') AS text FROM sparse s JOIN documents ON doc_id = s.id WHERE rank <= 5),
qt AS (SELECT task_id, {TERMS.format('query')} AS terms FROM task),
se AS (SELECT task_id, id, rank, score AS hit, terms, unnest({SENTS.format('trim(text)')}) AS sentence, generate_subscripts({SENTS.format('trim(text)')}, 1) AS pos FROM hit JOIN qt USING (task_id)),
so AS (SELECT *, len(list_intersect(terms, {TERMS.format('sentence')})) AS overlap FROM se),
sc AS (SELECT *, round(overlap / greatest(len(terms), 1) + least(hit, 1.0) * 0.05, 6) AS score FROM so WHERE overlap >= 2 OR (overlap = 1 AND overlap / greatest(len(terms), 1) >= 0.34)),
on1 AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY task_id, sentence ORDER BY score DESC, rank, pos) = 1),
on2 AS (SELECT *, row_number() OVER (PARTITION BY task_id, rank ORDER BY score DESC, pos) AS own FROM on1),
evd AS (SELECT task_id, id, sentence, score, row_number() OVER (PARTITION BY task_id ORDER BY CASE WHEN own = 1 AND rank <= 3 THEN rank ELSE 9 END, score DESC, rank, pos) AS pick FROM on2)"""


@query(f"WITH {EVID} SELECT task_id, id, sentence, score, pick FROM evd WHERE pick <= 4")
def evidence_overlap(spark, sf):
    return V.evidence(tasks(spark, sf), plain(spark, sf))


def _answers(spark, sf, hits=None):
    return V.answers(tasks(spark, sf), V.evidence(tasks(spark, sf), plain(spark, sf) if hits is None else hits))


def _supported(spark, sf):
    hits = plain(spark, sf)
    return V.citation_support(_answers(spark, sf, hits), hits)


@query(f"""WITH {EVID}, e4 AS (SELECT * FROM evd WHERE pick <= 4), ci AS (SELECT task_id, id, min(pick) AS p FROM e4 GROUP BY ALL)
SELECT task_id, coalesce((SELECT string_agg(sentence, ' ' ORDER BY pick) FROM e4 WHERE e4.task_id = task.task_id), '{V.ABSTENTION}') AS answer,
coalesce((SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY p) FROM ci WHERE ci.task_id = task.task_id), '') AS citations,
CASE WHEN task_id NOT IN (SELECT task_id FROM e4) THEN 'No supporting evidence spans were found.' END AS uncertainty FROM task""")
def synthesized_answers(spark, sf):
    return _answers(spark, sf)


SUPPORT = f"""{EVID}, e4 AS (SELECT * FROM evd WHERE pick <= 4),
aw AS (SELECT task_id, coalesce((SELECT string_agg(sentence, ' ' ORDER BY pick) FROM e4 WHERE e4.task_id = task.task_id), '{V.ABSTENTION}') AS answer FROM task),
cl AS (SELECT task_id, unnest(string_split(answer, '.')) AS c, generate_subscripts(string_split(answer, '.'), 1) AS pos FROM aw),
cb AS (SELECT task_id, pos, list_distinct(list_filter(regexp_split_to_array(lower(trim(c)), '\\s+'), lambda x: x <> '')) AS w FROM cl WHERE length(trim(c)) > 10),
hb AS (SELECT task_id, list_distinct(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS p FROM hit),
ck AS (SELECT cb.task_id, pos, max(CASE WHEN len(list_intersect(w, p)) >= least(3.0, len(w) * 0.3) THEN 1 ELSE 0 END) AS ok FROM cb LEFT JOIN hb USING (task_id) GROUP BY ALL)"""


@query(f"WITH {SUPPORT} SELECT task_id, count(*) AS claims, sum(ok) AS supported, round(avg(ok), 6) AS support_rate FROM ck GROUP BY task_id")
def citation_support(spark, sf):
    return _supported(spark, sf)


@query(f"""WITH {EVID}, e4 AS (SELECT * FROM evd WHERE pick <= 4), sx AS (SELECT DISTINCT task_id, sentence FROM e4)
SELECT DISTINCT task_id, sentence, hit.id FROM sx JOIN hit USING (task_id) WHERE contains(trim(regexp_replace(hit.text, '\\s+', ' ', 'g')), sentence)""")
def claim_citation_map(spark, sf):
    hits = plain(spark, sf)
    ans = V.evidence(tasks(spark, sf), hits).select("task_id", F.col("sentence").alias("answer"))
    return V.claim_citations(ans, hits)


@query(f"""WITH {SUPPORT}, r AS (SELECT task_id, avg(ok) AS support, CASE WHEN task_id % 3 = 0 THEN 0 ELSE avg(ok) END AS faithfulness FROM ck GROUP BY task_id)
SELECT count(*) AS queries, round(avg(support), 6) AS mean_support, round(list_sort(list(support))[count(*) // 2 + 1], 6) AS median_support,
round(avg(CASE WHEN support >= 0.85 THEN 1.0 ELSE 0 END), 6) AS support_passing, round(avg(faithfulness) FILTER (faithfulness > 0), 6) AS mean_faithfulness,
round((list_sort(list(faithfulness) FILTER (faithfulness > 0)))[count(*) FILTER (faithfulness > 0) // 2 + 1], 6) AS median_faithfulness FROM r""")
def answer_quality_report(spark, sf):
    s = _supported(spark, sf).withColumnRenamed("support_rate", "support")
    return E.answer_report(s.withColumn("faithfulness", F.when(F.col("task_id") % 3 == 0, 0.0).otherwise(F.col("support"))))


@query(f"""WITH {BM25}, p AS (SELECT task_id AS key, {TOKENS.format('query')} AS a, {TOKENS.format("coalesce(d.text, '')")} AS b FROM sparse JOIN task USING (task_id) JOIN documents d ON doc_id = sparse.id WHERE rank = 1),
pa AS (SELECT key, t, count(*) AS n FROM (SELECT key, unnest(a) AS t FROM p) GROUP BY ALL), pb AS (SELECT key, t, count(*) AS n FROM (SELECT key, unnest(b) AS t FROM p) GROUP BY ALL),
cm AS (SELECT key, sum(least(pa.n, pb.n)) AS c FROM pa JOIN pb USING (key, t) GROUP BY key)
SELECT key, coalesce(round(coalesce(c, 0) / nullif(len(b), 0), 6), 0) AS recall, coalesce(round(coalesce(c, 0) / nullif(len(a), 0), 6), 0) AS precision, coalesce(round(2 * coalesce(c, 0) / nullif(len(a) + len(b), 0), 6), 0) AS f1 FROM p LEFT JOIN cm USING (key)""")
def token_f1(spark, sf):
    best = sparse_hits(spark, sf, 1).join(passages(spark, sf).select("id", "text"), "id").join(tasks(spark, sf), "task_id")
    pairs = written(best.select(F.col("task_id").alias("key"), T.tokens(F.col("query")).alias("a"), T.tokens(F.col("text")).alias("b")), "best-tokens")
    return E.overlap_scores(pairs, "a", "b")


JUDGED = [(1, "Rating: [[7]]"), (2, "I say Score: 8.6/10 overall"), (3, "[Rating]\n7"), (4, "no number"), (5, "Rating: [[12]]"), (6, "it is 6 out of 10"), (7, "For example: Rating: [[9]]\nRating: 3"), (8, "Overall Rating: 9.5 and [4]")]
RATED = "CASE " + " ".join(f"WHEN regexp_matches(t, '(?i){p}') THEN try_cast(regexp_extract(t, '(?i){p}', 1) AS DOUBLE) / 10" for p in reversed(T.RATING_FORMS)) + " ELSE 0.5 END"


@query(f"SELECT k, CASE WHEN r <= 0 OR r > 1 THEN 0.5 ELSE r END AS rating FROM (SELECT k, {RATED} AS r FROM (SELECT k, regexp_replace(s, '(?im)for example:.*?$', '', 'g') AS t FROM (SELECT doc_id AS k, {spoken(JUDGED, 'doc_id', every=16)} AS s FROM documents)))")
def judge_ratings(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("k"), T.rating(F.expr(spoken(JUDGED, "doc_id", every=16))).alias("rating"))


REPLIES = [(1, "Yes, it is"), (2, " no"), (3, "partial"), (4, "42"), (5, "YES!"), (6, "")]


@query(f"""SELECT conv_id, turn, CASE w WHEN '' THEN -1.0 WHEN 'yes' THEN 1.0 WHEN 'no' THEN 0.0 ELSE 0.5 END AS verdict FROM
(SELECT conv_id, turn, lower(regexp_extract(s, '^\\s*([A-Za-z]+)', 1)) AS w FROM (SELECT conv_id, turn, {spoken(REPLIES, 'conv_id + turn', every=16)} AS s FROM conversations))""")
def first_token_verdicts(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.first_token_verdict(F.expr(spoken(REPLIES, "conv_id + turn", every=16))).alias("verdict"))


IDK = [(1, "UNANSWERABLE", 1.0, 0.4), (2, "CONVERSATIONAL", 0.5, 0.4), (3, "ANSWERABLE", 1.0, 0.4), (4, "PARTIAL", 0.0, 0.7), (5, "UNANSWERABLE", 0.0, 0.2)]


@query(f"SELECT k, CASE WHEN a IN ('UNANSWERABLE', 'CONVERSATIONAL') AND i = 1 THEN 1 WHEN a IN ('UNANSWERABLE', 'CONVERSATIONAL') THEN 0 WHEN i = 1 THEN 0 ELSE m END::DOUBLE AS score FROM {values(IDK, ['k', 'a', 'i', 'm'])}")
def idk_conditioned(spark, sf):
    none = F.col("a").isin("UNANSWERABLE", "CONVERSATIONAL")
    score = F.when(none & (F.col("i") == 1), 1.0).when(none, 0.0).when(F.col("i") == 1, 0.0).otherwise(F.col("m"))
    return spark.createDataFrame(IDK, "k int, a string, i double, m double").select("k", score.alias("score"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount <= 0 OR l_tax <= 0 OR l_quantity <= 0 THEN 0 ELSE 3 / (1 / l_discount + 1 / l_tax + 1 / l_quantity) END, 6) AS rb FROM lineitem""")
def rb_agg(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(N.harmonic_of_three(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")), 6).alias("rb"))


#: Events as executions: every user one trace file, checked by rules.
TRACES = "tr AS (SELECT event_id AS trace_id, user_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'complete' END AS status, value AS cost, CASE WHEN json_valid(props) THEN '' ELSE 'invalid JSON' END || CASE WHEN value < 0 THEN 'negative cost' ELSE '' END AS problems FROM events)"


def traces(spark, sf):
    """(trace_id, user_id, status, cost, problems): an event per execution."""
    bad = F.concat(F.when(F.call_function("try_parse_json", F.col("props")).isNull(), "invalid JSON").otherwise(""), F.when(F.col("value") < 0, "negative cost").otherwise(""))
    return table(spark, sf, "events").select(F.col("event_id").alias("trace_id"), "user_id", F.when(F.col("event_type") == "error", "error").otherwise("complete").alias("status"), F.col("value").alias("cost"), bad.alias("problems"))


@query(f"WITH {TRACES} SELECT count(*) AS traces, round(least(count(*) / 10000, 1.0), 6) AS coverage, count(*) - count(DISTINCT trace_id) AS repeated_ids, count(*) FILTER (problems <> '') AS bad_rows, count(*) FILTER (problems <> '') = 0 AND count(*) = count(DISTINCT trace_id) AND count(*) = 10000 AS valid FROM tr")
def trace_validation(spark, sf):
    return E.trace_report(traces(spark, sf), 10000)


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def event_counts_by_class(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT event_type, round(median(value), 6) AS median, round(max(value), 6) AS max FROM events GROUP BY event_type")
def latency_median_max(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.max("value"), 6).alias("max"))


@query("SELECT l_returnflag, round(sum(l_quantity * 0.35 + l_linenumber * 0.75) / 1e6, 8) AS usd FROM lineitem GROUP BY l_returnflag")
def cost_estimate(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(E.cost("l_quantity", "l_linenumber", 0.35, 0.75).alias("usd"))


@query("SELECT event_id, props AS json, json_extract_string(props, '$.' || (json_keys(props))[1]) AS first_value, len(json_keys(props)) AS n_keys FROM events WHERE json_valid(props)")
def json_props_extract(spark, sf):
    keys = F.json_object_keys("props")
    e = table(spark, sf, "events").where(F.call_function("try_parse_json", F.col("props")).isNotNull())
    first = F.from_json("props", "map<string,string>")[F.try_element_at(keys, F.lit(1))]
    return e.select("event_id", F.col("props").alias("json"), first.alias("first_value"), F.size(keys).cast("long").alias("n_keys"))


#: Labelled documents as curated cases: quality and toxicity give the class, the text query, answer and evidence.
CASES = """
cs AS (SELECT 'c' || doc_id || '-' || row_number() OVER (PARTITION BY doc_id ORDER BY quality, toxic) AS case_id, doc_id, lang AS domain, source AS document_group,
  CASE WHEN quality = 1 AND toxic = 0 AND doc_id % 4 <> 0 THEN 'answerable' WHEN quality = 1 AND toxic = 0 THEN 'partial' WHEN toxic = 1 THEN 'unanswerable' ELSE 'underspecified' END AS case_class,
  array_to_string(list_slice(regexp_extract_all(lower(t), '[a-z0-9]+'), 1, 8 + doc_id % 90), ' ') AS query,
  CASE WHEN toxic = 1 THEN '' ELSE array_to_string(list_slice(regexp_extract_all(lower(t), '[a-z0-9]+'), 5, 20), ' ') || CASE WHEN doc_id % 8 = 0 THEN ' however' ELSE '' END END AS answer,
  CASE WHEN doc_id % 11 = 0 THEN '' ELSE array_to_string(list_slice(regexp_extract_all(lower(t), '[a-z0-9]+'), 1 + doc_id % 15, 40), ' ') END AS evidence,
  CASE WHEN doc_id % 2 = 0 THEN 'which one?' ELSE '' END AS clarification, CASE WHEN doc_id % 3 = 0 THEN 'benchmark' ELSE 'corpus' END AS source,
  CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'dev' ELSE 'test' END AS split, CASE WHEN doc_id % 5 = 0 THEN 'pending' ELSE 'approved' END AS review
  FROM (SELECT doc_id, quality, toxic, lang, source, coalesce(text, '') AS t FROM labels JOIN documents USING (doc_id)))"""
BEHAVE = "CASE case_class " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.BEHAVIOURS.items()) + " END"


def cases(spark, sf):
    d, i = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id"), F.col("doc_id")
    w = T.curation_tokens(F.coalesce("text", F.lit("")))
    part = lambda a, n: F.array_join(F.slice(w, a if not isinstance(a, int) else F.lit(a), n if not isinstance(n, int) else F.lit(n)), " ")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("quality", "toxic"))
    kind = F.when(good & (i % 4 != 0), "answerable").when(good, "partial").when(F.col("toxic") == 1, "unanswerable").otherwise("underspecified")
    return d.select(
        F.concat(F.lit("c"), i, F.lit("-"), number).alias("case_id"),
        "doc_id",
        F.col("lang").alias("domain"),
        F.col("source").alias("document_group"),
        kind.alias("case_class"),
        part(1, (8 + i % 90).cast("int")).alias("query"),
        F.when(F.col("toxic") == 1, "").otherwise(F.concat(part(5, 16), F.when(i % 8 == 0, " however").otherwise(""))).alias("answer"),
        F.when(i % 11 == 0, "").otherwise(part((1 + i % 15).cast("int"), (40 - i % 15).cast("int"))).alias("evidence"),
        F.when(i % 2 == 0, "which one?").otherwise("").alias("clarification"),
        F.when(i % 3 == 0, "benchmark").otherwise("corpus").alias("source"),
        F.when(i % 3 == 0, "train").when(i % 3 == 1, "dev").otherwise("test").alias("split"),
        F.when(i % 5 == 0, "pending").otherwise("approved").alias("review"),
    )


CSTOPS = "['" + "','".join(T.CURATION_STOPWORDS) + "']"
BAG = "list_distinct(list_filter(regexp_extract_all({0}, '[a-z0-9]+'), lambda x: NOT list_contains(" + CSTOPS + ", x)))"
GAP = "|".join(C.GAPS)
AUDIT = f"""{CASES},
ab AS (SELECT *, {BAG.format('query')} AS q, {BAG.format('answer')} AS a, {BAG.format('evidence')} AS e, len(regexp_extract_all(query, '[a-z0-9]+')) AS nq FROM cs),
ac AS (SELECT *, len(list_intersect(a, e)) / nullif(len(a), 0) AS cov, coalesce(len(list_intersect(q, e)) / nullif(len(q), 0), 0) AS ovl, case_class IN ('answerable', 'partial') AS grounded FROM ab),
au AS (SELECT *, round(round(greatest(0, least(1, CASE WHEN grounded THEN 0.15 + 0.70 * coalesce(cov, 0) + 0.15 * ovl WHEN source = 'benchmark' THEN 0.90 ELSE 0.55 END
  - CASE WHEN nq NOT BETWEEN 4 AND 80 THEN 0.10 ELSE 0 END + CASE WHEN case_class = 'partial' AND regexp_matches(lower(answer), '{GAP}') THEN 0.10 ELSE 0 END
  - CASE WHEN case_class = 'underspecified' AND trim(clarification) = '' THEN 0.25 ELSE 0 END)), 9), 4) AS score,
  array_to_string(list_filter([CASE WHEN grounded AND cov < 0.35 THEN 'low_answer_span_overlap' END, CASE WHEN grounded AND trim(evidence) = '' THEN 'missing_support_span' END,
  CASE WHEN nq NOT BETWEEN 4 AND 80 THEN 'unusual_query_length' END, CASE WHEN case_class = 'partial' AND NOT regexp_matches(lower(answer), '{GAP}') THEN 'partial_answer_missing_explicit_gap' END,
  CASE WHEN case_class = 'underspecified' AND trim(clarification) = '' THEN 'missing_clarification' END], lambda x: x IS NOT NULL), ',') AS flags FROM ac)"""


@query(f"WITH {AUDIT} SELECT case_id, score, round(cov, 4) AS coverage, round(ovl, 4) AS overlap, flags FROM au")
def audit_scores(spark, sf):
    return C.audit(cases(spark, sf))


@query(f"""WITH {CASES} SELECT case_id, array_to_string(list_filter([CASE WHEN case_class IN ('answerable', 'partial') AND (trim(answer) = '' OR trim(evidence) = '') THEN 'grounded case requires answer and support spans' END,
CASE WHEN case_class = 'underspecified' AND trim(clarification) = '' THEN 'underspecified case requires a clarification' END,
CASE WHEN case_class = 'unanswerable' AND trim(answer) <> '' THEN 'unanswerable case must not contain a reference answer' END,
CASE WHEN split = 'test' AND review <> 'approved' THEN 'test case lacks approved human review' END], lambda x: x IS NOT NULL), '; ') AS problems FROM (SELECT * FROM cs)
WHERE trim(query) <> ''""")
def case_validation(spark, sf):
    expected = F.create_map(*[F.lit(x) for kv in C.BEHAVIOURS.items() for x in kv])
    return C.problems(cases(spark, sf).where("trim(query) <> ''").withColumn("behavior", F.try_element_at(expected, F.col("case_class"))))


@query(f"""WITH {AUDIT}, tg(case_class, target) AS (VALUES ('answerable', 30), ('partial', 9), ('unanswerable', 12), ('underspecified', 9)),
sl AS (SELECT case_id, case_class, score, target, row_number() OVER (PARTITION BY case_class, domain ORDER BY score DESC, case_id) AS own FROM au JOIN tg USING (case_class)),
sp AS (SELECT case_id, case_class, target, row_number() OVER (PARTITION BY case_class ORDER BY CASE WHEN case_class = 'partial' AND own <= target // 2 THEN 0 ELSE 1 END, score DESC, case_id) AS pick FROM sl)
SELECT case_id, case_class, pick FROM sp WHERE pick <= target""")
def shortlist_quota(spark, sf):
    c = cases(spark, sf)
    targets = spark.createDataFrame([("answerable", 30), ("partial", 9), ("unanswerable", 12), ("underspecified", 9)], "case_class string, target int")
    return C.shortlist(C.audit(c).join(c.select("case_id", "case_class", "domain"), "case_id"), targets)


@query(f"""WITH {CASES}, rr AS (SELECT case_class, domain, case_id, row_number() OVER (PARTITION BY case_class, domain ORDER BY case_id) AS own FROM cs),
rp AS (SELECT case_class, domain, case_id, row_number() OVER (PARTITION BY case_class ORDER BY own, domain) AS pick FROM rr) SELECT case_class, domain, case_id, pick FROM rp WHERE pick <= 12""")
def round_robin_pick(spark, sf):
    return C.round_robin(cases(spark, sf), "case_class", "domain", "case_id", 12)


QUOTAS = {"unanswerable": 40, "underspecified": 30}


@query(f"""WITH {CASES}, hs AS (SELECT case_class, domain, document_group, case_id, sha256('20260928|' || case_id) AS h FROM cs WHERE case_class IN ('unanswerable', 'underspecified')),
og AS (SELECT * FROM hs QUALIFY row_number() OVER (PARTITION BY case_class, document_group ORDER BY h, case_id) = 1),
od AS (SELECT *, row_number() OVER (PARTITION BY case_class, domain ORDER BY h, case_id) AS own FROM og),
op AS (SELECT *, row_number() OVER (PARTITION BY case_class ORDER BY own, domain) AS pick FROM od)
SELECT case_class, domain, document_group, case_id, pick FROM op WHERE pick <= CASE case_class WHEN 'unanswerable' THEN 40 ELSE 30 END""")
def quota_seeds(spark, sf):
    return C.quota_seeds(cases(spark, sf), QUOTAS)


@query(f"WITH {CASES} SELECT document_group, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM cs GROUP BY document_group HAVING count(DISTINCT split) > 1")
def group_leakage(spark, sf):
    return C.leaking_groups(cases(spark, sf))


@query(f"WITH {CASES} SELECT split, case_class, count(*) AS n FROM cs GROUP BY ALL")
def split_class_counts(spark, sf):
    return cases(spark, sf).groupBy("split", "case_class").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {AUDIT} SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(flags, ',')) AS tag FROM au WHERE flags <> '') GROUP BY tag")
def tag_counts(spark, sf):
    return C.audit(cases(spark, sf)).where("flags <> ''").select(F.explode(F.split("flags", ",")).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {BM25}, {QRELS}, r AS (SELECT task_id, id, row_number() OVER (PARTITION BY task_id ORDER BY rank, id) AS pick FROM sparse ANTI JOIN qrel USING (task_id, id)) SELECT task_id, id, pick FROM r WHERE pick <= 5")
def distractors(spark, sf):
    return C.distractors(sparse_hits(spark, sf), qrels(spark, sf))


@query(f"""WITH {BM25}, bp AS (SELECT task_id AS key, full_text AS answer, coalesce(d.text, '') AS text FROM sparse JOIN task USING (task_id) JOIN documents d ON doc_id = sparse.id WHERE rank = 1),
bs AS (SELECT key, list_distinct(regexp_extract_all(lower(answer), '[a-z0-9]+')) AS a, unnest(regexp_split_to_array(text, '[.!?]\\s+')) AS sentence, generate_subscripts(regexp_split_to_array(text, '[.!?]\\s+'), 1) AS pos FROM bp),
bj AS (SELECT key, sentence, pos, a, list_distinct(regexp_extract_all(lower(sentence), '[a-z0-9]+')) AS s FROM bs),
bk AS (SELECT key, sentence, pos, round(coalesce(len(list_intersect(a, s)) / nullif(len(list_distinct(list_concat(a, s))), 0), 0), 6) AS jaccard FROM bj),
bl AS (SELECT key, sentence, jaccard, row_number() OVER (PARTITION BY key ORDER BY jaccard DESC, pos) AS pick FROM bk WHERE jaccard > 0) SELECT key, sentence, jaccard, pick FROM bl WHERE pick <= 3""")
def support_spans_jaccard(spark, sf):
    best = sparse_hits(spark, sf, 1).join(passages(spark, sf).select("id", "text"), "id").join(tasks(spark, sf), "task_id")
    return C.best_spans(best.select(F.col("task_id").alias("key"), F.col("full").alias("answer"), "text"))


@query("SELECT b.item_id AS task_id, d.doc_id AS id, CAST(instr(d.text, b.text) - 1 AS INT) AS start FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def located_spans(spark, sf):
    q = qrels(spark, sf).join(passages(spark, sf).select("id", "text"), "id").join(tasks(spark, sf).select("task_id", "full"), "task_id")
    return q.select("task_id", "id", T.locate(F.col("text"), F.col("full")).cast("int").alias("start"))


@query(f"WITH {TASKS} SELECT task_id, 'mtragun-' || substr(sha256(CAST(task_id AS VARCHAR)), 1, 16) AS case_id FROM task")
def hashed_case_ids(spark, sf):
    return tasks(spark, sf).select("task_id", T.hashed_id("mtragun-", F.col("task_id").cast("string")).alias("case_id"))


@query("""SELECT doc_id FROM (SELECT doc_id, sha256('7|' || doc_id) AS h, row_number() OVER (PARTITION BY source ORDER BY sha256('7|' || doc_id), doc_id) AS n FROM documents) WHERE n = 1 ORDER BY h, doc_id LIMIT 12""")
def seeded_sample(spark, sf):
    return C.sample_by_hash(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", "source", 7, 12).select("doc_id")


@query("""WITH s AS (SELECT conv_id AS stream_id, CASE conv_id % 3 WHEN 0 THEN 'early_retrieval' WHEN 1 THEN 'multi_intent' ELSE 'no_retrieval' END AS category,
max(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> ''))) AS words, count(*) > 3 AS early, count(*) FILTER (role = 'user') - 1 AS n_retrieve, max(turn) * 100 - 200 AS settling_ms FROM conversations GROUP BY conv_id)
SELECT count(*) AS tasks, count(*) FILTER (category = 'early_retrieval' AND words >= 5) AS eligible,
coalesce(round(count(*) FILTER (category = 'early_retrieval' AND words >= 5 AND early) / nullif(count(*) FILTER (category = 'early_retrieval' AND words >= 5), 0), 4), 0) AS early_rate,
coalesce(round(count(*) FILTER (category = 'no_retrieval' AND n_retrieve > 0) / nullif(count(*) FILTER (category = 'no_retrieval'), 0), 4), 0) AS false_trigger_rate,
coalesce(CAST(floor(avg(settling_ms) FILTER (category = 'early_retrieval' AND words >= 5 AND settling_ms >= 0)) AS BIGINT), 0) AS settling_mean,
coalesce(max(settling_ms) FILTER (category = 'early_retrieval' AND words >= 5 AND settling_ms >= 0), 0) AS settling_max FROM s""")
def streaming_metrics(spark, sf):
    kind = F.when(F.col("conv_id") % 3 == 0, "early_retrieval").when(F.col("conv_id") % 3 == 1, "multi_intent").otherwise("no_retrieval")
    s = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("stream_id"), kind.alias("category")).agg(
        F.max(P.word_count(F.coalesce("text", F.lit("")))).alias("words"), (F.count(F.lit(1)) > 3).alias("early"), (F.count_if(F.col("role") == "user") - 1).alias("n_retrieve"), (F.max("turn") * 100 - 200).alias("settling_ms")
    )
    return E.streaming_report(s)
