"""Queries over growing transcripts and dialogues."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarryline.functions import predicates as P
from quarryline.functions import text as T
from quarryline.functions.numeric import cosine, recency_mean
from quarryline.plans.base import query, spoken
from quarryline.sources.tables import chunks, table
from quarryline.streaming import transcripts as S

SPLIT = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> '')"
TURNS = f"turn AS (SELECT conv_id || '-' || turn AS stream_id, {SPLIT.format('coalesce(text, chr(32))')} AS w FROM conversations WHERE role = 'user')"
CHUNKS = f"""{TURNS},
ch AS (SELECT stream_id, CAST(k - 1 AS BIGINT) AS idx, round(k * 0.8, 3) AS ts, array_to_string(list_slice(w, 1, k * 4), ' ') AS text, k = n AS is_final,
  CASE WHEN k = n THEN 0.95 ELSE 0.8 END AS confidence
  FROM (SELECT stream_id, w, CAST(ceil(len(w) / 4) AS BIGINT) AS n, unnest(range(1, CAST(ceil(len(w) / 4) AS BIGINT) + 1)) AS k FROM turn WHERE len(w) > 0))"""
PREFIX = "len(list_filter(range(1, least(len({0}), len({1})) + 1), lambda i: {0}[1:i] = {1}[1:i]))"
LAGGED = f"""{CHUNKS},
lg AS (SELECT *, {SPLIT.format('text')} AS a, {SPLIT.format("coalesce(lag(text) OVER (PARTITION BY stream_id ORDER BY idx), '')")} AS b FROM ch),
cm AS (SELECT *, CAST({PREFIX.format('a', 'b')} AS BIGINT) AS committed FROM lg)"""
BARE = "regexp_replace(ltrim(lower({0})), '^(?:(?:can|could|would|will|may)\\s+you\\s+(?:please\\s+)?|(?:please|just|ok|okay)\\s+|i\\s+(?:want|need)\\s+you\\s+to\\s+)+', '')"
LONG = "'" + "', '".join(P.LONG_PRESENTATION) + "'"
PRESENTATION = f"(regexp_matches({BARE}, '^(?:{P.PRESENTATION.replace(chr(39), chr(39) * 2)})\\b') AND (len({SPLIT.format(BARE)}) <= 5 OR regexp_replace({BARE}, '[ .!?]+$', '') IN ({LONG})))"
DECIDED = f"""{CHUNKS},
kd AS (SELECT *, CASE WHEN trim(text) = '' THEN 'empty' WHEN {PRESENTATION.format('text')} THEN 'presentation' WHEN is_final THEN 'final' ELSE 'window' END AS kind FROM ch),
kl AS (SELECT *, {SPLIT.format('text')} AS a, {SPLIT.format("coalesce(lag(text) OVER (PARTITION BY stream_id, kind ORDER BY idx), '')")} AS b FROM kd),
kc AS (SELECT *, CASE WHEN kind = 'window' THEN CAST({PREFIX.format('a', 'b')} AS BIGINT) ELSE 0 END AS committed FROM kl),
ks AS (SELECT *, kind = 'window' AND committed >= 3 AS stable FROM kc),
kf AS (SELECT *, coalesce(sum(CASE WHEN stable THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id, kind ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM ks),
dec AS (SELECT stream_id, idx, ts, text, is_final, committed,
  CASE WHEN kind IN ('empty', 'presentation') THEN 'No-Retrieval' WHEN kind = 'final' OR (stable AND earlier = 0) THEN 'Retrieve' ELSE 'Wait' END AS decision,
  CASE WHEN kind = 'empty' THEN 'empty text' WHEN kind = 'presentation' THEN 'presentation-only command' WHEN kind = 'final' THEN 'final transcript'
    WHEN stable AND earlier = 0 THEN 'stable intent (' || committed || ' words agreed)' WHEN stable THEN 'already retrieved; awaiting final'
    WHEN confidence < 0.72 THEN 'low confidence ' || confidence || '; intent not stable'
    WHEN length(trim(text)) < 24 OR len(a) < 5 THEN 'too short for retrieval; intent not stable'
    ELSE 'intent not yet stable (' || committed || '/3 words)' END AS reason FROM kf)"""


@query(f"WITH {CHUNKS} SELECT stream_id, idx, ts, text, is_final, confidence FROM ch")
def chunk_stream(spark, sf):
    return chunks(spark, sf)


@query(f"WITH {LAGGED} SELECT stream_id, idx, committed FROM cm")
def committed_prefix(spark, sf):
    return S.committed(chunks(spark, sf)).select("stream_id", "idx", "committed")


@query(f"WITH {DECIDED} SELECT stream_id, idx, ts, text, is_final, committed, decision, reason FROM dec")
def controller_decisions(spark, sf):
    return S.decisions(chunks(spark, sf))


@query(f"WITH {DECIDED} SELECT stream_id, min(idx) AS first_idx, min(ts) AS first_ts, NOT arg_min(is_final, idx) AS early FROM dec WHERE decision = 'Retrieve' GROUP BY stream_id")
def first_retrieve(spark, sf):
    return S.first_retrieve(S.decisions(chunks(spark, sf)))


@query(f"""WITH {DECIDED}, f AS (SELECT stream_id, NOT arg_min(is_final, idx) AS early FROM dec WHERE decision = 'Retrieve' GROUP BY stream_id)
SELECT count(*) AS streams, round(avg(CASE WHEN early THEN 1.0 ELSE 0.0 END), 4) AS early_rate FROM f""")
def early_retrieval_rate(spark, sf):
    return S.first_retrieve(S.decisions(chunks(spark, sf))).agg(F.count(F.lit(1)).alias("streams"), F.round(F.avg(F.col("early").cast("double")), 4).alias("early_rate"))


SETTLED = f"""{LAGGED}, stb AS (SELECT stream_id, coalesce(min(idx) FILTER (committed >= 3), -1) AS stable_idx,
coalesce(CAST(round((min(ts) FILTER (committed >= 3) - min(ts)) * 1000) AS BIGINT), -1) AS settling_ms FROM cm GROUP BY stream_id)"""


@query(f"WITH {SETTLED} SELECT stream_id, stable_idx, settling_ms FROM stb")
def stability_index(spark, sf):
    return S.stability(chunks(spark, sf))


@query(f"WITH {SETTLED} SELECT settling_ms, count(*) AS n FROM stb GROUP BY settling_ms")
def settling_ms(spark, sf):
    return S.stability(chunks(spark, sf)).groupBy("settling_ms").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CHUNKS} SELECT stream_id, arg_max(text, (is_final, idx)) AS text, bool_or(is_final) AS is_final, count(*) AS n_chunks FROM ch GROUP BY stream_id")
def stream_supersede_final(spark, sf):
    return S.superseded(chunks(spark, sf))


#: Events as a second kind of transcript: per user, the event types so far as partials that may change.
EVENT_CHUNKS = "ev AS (SELECT CAST(user_id AS VARCHAR) AS stream_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS idx, epoch(ts) AS ts, event_type AS text, false AS is_final FROM events)"


def event_chunks(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").cast("string").alias("stream_id"), (F.row_number().over(w) - 1).cast("long").alias("idx"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("ts"), F.col("event_type").alias("text"), F.lit(False).alias("is_final"))


@query(f"WITH {EVENT_CHUNKS} SELECT * FROM (SELECT stream_id, idx, lag(text) OVER (PARTITION BY stream_id ORDER BY idx) AS before, text AS after FROM ev) WHERE before IS NOT NULL AND after <> before AND NOT starts_with(after, before || ' ')")
def revision_log(spark, sf):
    return S.revisions(event_chunks(spark, sf))


@query(f"WITH {EVENT_CHUNKS} SELECT stream_id, idx FROM (SELECT *, lag(ts) OVER (PARTITION BY stream_id ORDER BY idx) AS b FROM ev) WHERE b >= ts")
def monotonic_violations(spark, sf):
    return S.not_increasing(event_chunks(spark, sf)).select("stream_id", "idx")


@query(f"WITH {DECIDED} SELECT stream_id, count(DISTINCT text) AS n FROM dec WHERE decision = 'Retrieve' GROUP BY stream_id")
def request_opportunities(spark, sf):
    return S.request_opportunities(S.decisions(chunks(spark, sf)))


@query(f"""WITH {CHUNKS}, fl AS (SELECT *, coalesce(lag(ts) OVER (PARTITION BY stream_id ORDER BY idx) >= ts, false) AS back FROM ch)
SELECT stream_id, array_to_string(list_filter([CASE WHEN count(*) < 3 THEN 'fewer than 3 chunks' END,
CASE WHEN count(*) FILTER (is_final) <> 1 OR NOT arg_max(is_final, idx) THEN 'no single final chunk at the end' END, CASE WHEN bool_or(back) THEN 'times don''t increase' END],
lambda x: x IS NOT NULL), '; ') AS problems FROM fl GROUP BY stream_id""")
def stream_validation(spark, sf):
    return S.stream_problems(chunks(spark, sf))


@query(f"""WITH {TURNS}, p AS (SELECT stream_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM turn)
SELECT stream_id, CAST(pos AS INT) AS pos, word, round(sum(1 / 2.5 + 0.03 * length(word) + CASE WHEN regexp_matches(word, '[.,;:!?]$') THEN 0.32 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 2) AS end_s FROM p""")
def word_durations(spark, sf):
    turns = table(spark, sf, "conversations").where("role = 'user'")
    return S.word_times(turns.select(F.concat_ws("-", "conv_id", "turn").alias("stream_id"), F.coalesce("text", F.lit("")).alias("text")))


@query("""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS version,
coalesce(lag(v) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS previous_version
FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS v FROM conversations WHERE role = 'assistant')""")
def version_lineage(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    v = table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.row_number().over(w).cast("long").alias("version"))
    return v.withColumn("previous_version", F.coalesce(F.lag("version").over(w), F.lit(0).cast("long")))


@query("SELECT conv_id, arg_max(text, turn) AS text, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id")
def last_user_turn(spark, sf):
    return table(spark, sf, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"), F.max("turn").alias("turn"))


WINDOWED = "cw AS (SELECT conv_id, turn, role, text, list(role || ': ' || trim(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS ctx FROM conversations)"


def _context(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, -1)
    c = table(spark, sf, "conversations")
    return c.withColumn("ctx", F.collect_list(F.concat("role", F.lit(": "), F.trim("text"))).over(w))


@query(f"WITH {WINDOWED} SELECT conv_id, turn, coalesce(len(ctx), 0) AS n, coalesce(array_to_string(ctx, ' '), '') AS context FROM cw WHERE role = 'user'")
def dialogue_context_window(spark, sf):
    return _context(spark, sf).where("role = 'user'").select("conv_id", "turn", F.size("ctx").cast("long").alias("n"), F.array_join("ctx", " ").alias("context"))


DEPENDENT = P.CONTEXT_DEPENDENT.replace("'", "''")


@query(f"""WITH {WINDOWED} SELECT conv_id, turn, CASE WHEN regexp_matches(text, '{DEPENDENT}') AND len(ctx) > 0
THEN 'Conversation context: ' || array_to_string(ctx, ' ') || ' Current question: ' || text ELSE text END AS query FROM cw WHERE role = 'user'""")
def contextualized_query(spark, sf):
    q = F.when(P.context_dependent(F.col("text")) & (F.size("ctx") > 0), F.concat(F.lit("Conversation context: "), F.array_join("ctx", " "), F.lit(" Current question: "), F.col("text"))).otherwise(F.col("text"))
    return _context(spark, sf).where("role = 'user'").select("conv_id", "turn", q.alias("query"))


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS dialogue, arg_max(text, turn) AS last FROM conversations GROUP BY conv_id")
def rendered_dialogues(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return c.select("conv_id", F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("dialogue"), F.element_at("t", -1)["text"].alias("last"))


#: Consecutive vectors of a label as one stream of hypotheses.
DRIFT = """
vs AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e, lag(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
sm AS (SELECT label, vec_id, round(CASE WHEN b IS NULL THEN NULL WHEN list_dot_product(e, e) * list_dot_product(b, b) = 0 THEN 0
  ELSE greatest(-1, least(1, list_dot_product(e, b) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(b, b))))) END, 6) AS sim FROM vs)"""


def _similarities(spark, sf):
    w = Window.partitionBy("label").orderBy("vec_id")
    v = table(spark, sf, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return v.withColumn("b", F.lag("e").over(w)).select("label", "vec_id", F.when(F.col("b").isNotNull(), F.round(cosine(F.col("e"), F.col("b")), 6)).alias("sim"))


@query(f"WITH {DRIFT} SELECT label, vec_id, sim, coalesce(sim < 0.65, false) AS drift FROM sm")
def embedding_drift(spark, sf):
    return _similarities(spark, sf).withColumn("drift", F.coalesce(F.col("sim") < 0.65, F.lit(False)))


@query(f"""WITH {DRIFT} SELECT label, vec_id, count(sim) OVER w = 2 AND min(sim) OVER w >= 0.1 AS stable FROM sm
WINDOW w AS (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)""")
def rolling_stability(spark, sf):
    w = Window.partitionBy("label").orderBy("vec_id").rowsBetween(-1, 0)
    s = _similarities(spark, sf).withColumns({"_n": F.count("sim").over(w), "_m": F.min("sim").over(w)})
    return s.select("label", "vec_id", F.coalesce((F.col("_n") == 2) & (F.col("_m") >= 0.1), F.lit(False)).alias("stable"))


@query(f"WITH {DRIFT} SELECT label, vec_id, coalesce(sum(CASE WHEN sim < 0.65 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id), 0) AS segment FROM sm")
def drift_segments(spark, sf):
    w = Window.partitionBy("label").orderBy("vec_id").rowsBetween(Window.unboundedPreceding, 0)
    return _similarities(spark, sf).select("label", "vec_id", F.sum(F.when(F.col("sim") < 0.65, 1).otherwise(0)).over(w).alias("segment"))


@query("""WITH r AS (SELECT user_id, value, exp(-0.5 * (row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1)) AS w FROM events)
SELECT user_id, round(sum(w * value) / sum(w), 6) AS mean FROM r GROUP BY user_id""")
def exp_weighted_confidence(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = table(spark, sf, "events").withColumn("w", F.exp(-0.5 * (F.row_number().over(w) - 1)))
    return rows.groupBy("user_id").agg(F.round(F.sum(F.col("w") * F.col("value")) / F.sum("w"), 6).alias("mean"))


@query("""WITH t AS (SELECT conv_id, list(length(coalesce(text, ''))::DOUBLE ORDER BY turn) AS c FROM conversations GROUP BY conv_id)
SELECT conv_id, round(list_sum(list_transform(c, lambda x, i: x * exp(-0.3 * (len(c) - i)))) / list_sum(list_transform(c, lambda x, i: exp(-0.3 * (len(c) - i)))), 6) AS mean FROM t""")
def recency_means(spark, sf):
    """Mean length of a conversation's turns, the latest weighing most."""
    size = F.length(F.coalesce("text", F.lit(""))).cast("double").alias("n")
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", size))).alias("t"))
    return turns.select("conv_id", F.round(recency_mean(F.transform("t", lambda x: x["n"]), 0.3), 6).alias("mean"))


SAID = [
    (1, "repeat"), (2, "Can you please summarize that?"), (3, "stoplight timing in Denver"), (4, "hold on to the waiver requirement today"),
    (5, "Go back to the previous point."), (6, "please just repeat that"), (7, "thanks"), (8, "I need you to start over"), (9, "what is the fee"),
    (10, "could you tell me the price"), (11, ""), (12, "stop"), (13, "How do I configure the error log?"), (14, "explain billing quota"), (15, "there is a problem here"), (16, "OK"),
]
SAYING = f"SELECT conv_id, turn, {spoken(SAID, 'conv_id + turn')} AS s FROM conversations"


def _saying(spark, sf):
    """The turns' texts, a few of them made requests about delivery and the like."""
    return table(spark, sf, "conversations").select("conv_id", "turn", F.expr(spoken(SAID, "conv_id + turn")).alias("s"))


@query(f"SELECT conv_id, turn, coalesce({PRESENTATION.format('s')}, false) AS presentation, regexp_matches(trim(lower(s)), '^(?:{P.COMMANDS.replace(chr(39), chr(39) * 2)})') AS command FROM ({SAYING})")
def presentation_commands(spark, sf):
    return _saying(spark, sf).select("conv_id", "turn", P.presentation_only(F.col("s")).alias("presentation"), P.presentation_command(F.col("s")).alias("command"))


TYPES = "CASE " + " ".join(f"WHEN regexp_matches(lower({{0}}), '{'|'.join(ws)}') THEN '{n}'" for n, ws in P.QUERY_TYPES) + " ELSE 'general' END"


@query(f"SELECT conv_id, turn, {TYPES.format('s')} AS kind FROM ({SAYING})")
def query_type(spark, sf):
    return _saying(spark, sf).select("conv_id", "turn", P.query_type(F.col("s")).alias("kind"))


@query(f"""WITH {CHUNKS} SELECT stream_id, idx, CASE WHEN trim(text) = '' THEN 'empty text' WHEN length(trim(text)) < 24 THEN 'text too short (' || length(trim(text)) || ' < 24 chars)'
WHEN len({SPLIT.format('trim(text)')}) < 5 THEN 'insufficient tokens (' || len({SPLIT.format('trim(text)')}) || ' < 5)'
WHEN confidence < 0.5 THEN 'low ASR confidence (' || printf('%.3f', confidence) || ')' END AS problem FROM ch""")
def validate_chunk(spark, sf):
    return chunks(spark, sf).select("stream_id", "idx", P.chunk_problem(F.col("text"), F.col("confidence")).alias("problem"))


@query("""SELECT doc_id, length(t) BETWEEN 300 AND 5000 AND len(w) >= 55 AND len(list_distinct(w)) >= 25 AND (length(t) - length(replace(t, 'http', ''))) / 4 <= 8 AS suitable
FROM (SELECT doc_id, trim(coalesce(text, '')) AS t, regexp_extract_all(lower(trim(coalesce(text, ''))), '[a-z0-9]+') AS w FROM documents)""")
def passage_suitable(spark, sf):
    return table(spark, sf, "documents").select("doc_id", P.passage_suitable(F.coalesce("text", F.lit(""))).alias("suitable"))


@query(f"SELECT conv_id, turn, trim(regexp_replace(lower(s), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM ({SAYING})")
def slugs(spark, sf):
    return _saying(spark, sf).select("conv_id", "turn", T.slug(F.col("s")).alias("slug"))
