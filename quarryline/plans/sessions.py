"""Queries over sessions of utterances, run as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import predicates as P
from quarryline.operators import models
from quarryline.plans.base import TOKENS, query
from quarryline.plans.measures import SENTS, TERMS
from quarryline.plans.plugins import drained
from quarryline.plans.transcripts import CHUNKS, DECIDED, PRESENTATION, SPLIT
from quarryline.session import shared_folder
from quarryline.sources.tables import chunks, table
from quarryline.streaming import journal, production, runs

IDLE = 30_001
LATE = 60_000
#: Replies in lower case with blanks for odd characters, so that both engines see the same sentences.
PLAIN = "regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9 .!?\\n]', ' ', 'g')"
ONCE = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
RESTRICTIVE = "regexp_matches({0}, '(?i)\\b(?:only|instead|actually|except|rather|not)\\b')"
ADDITIVE = "regexp_matches({0}, '(?i)^\\s*(?:what\\s+about|also\\b|and\\b)')"
RUNS = f"""{DECIDED},
reply AS (SELECT conv_id, turn - 1 AS turn, {PLAIN.format('text')} AS reply FROM conversations WHERE role = 'assistant'),
utt AS (SELECT conv_id, turn, conv_id || '-' || turn AS stream_id, reply FROM conversations LEFT JOIN reply USING (conv_id, turn) WHERE role = 'user'),
rw AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS utterance, idx, ts, text, is_final, decision, reply, conv_id * 60000 + turn * 100000 + CAST(round(ts * 1000) AS BIGINT) AS ms
  FROM dec JOIN utt USING (stream_id) WHERE NOT is_final OR reply IS NOT NULL),
mark AS (SELECT max(ms) - {LATE} AS mark FROM rw),
hit AS (SELECT *, lag(text) OVER (PARTITION BY session_id, utterance ORDER BY idx) AS searched FROM rw WHERE decision = 'Retrieve'),
se AS (SELECT * FROM hit WHERE searched IS NULL OR searched <> text),
fin AS (SELECT session_id, utterance, idx, text AS q, {PRESENTATION.format('trim(text)')} AS presented, {ONCE.format(SENTS.format('trim(reply)'))} AS said FROM rw WHERE is_final),
base AS (SELECT session_id, min(utterance) AS since FROM fin WHERE NOT presented AND len(said) > 0 GROUP BY session_id),
cm AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY utterance) AS version, NOT presented AND len(said) > 0 AS news FROM fin JOIN base USING (session_id) WHERE utterance >= since),
st AS (SELECT *, list({{'u': utterance, 'c': list_transform(said, lambda x: {{'s': x, 'u': utterance}}), 't': {TERMS.format("array_to_string(said, ' ')")}, 'adds': {ADDITIVE.format('q')} AND NOT {RESTRICTIVE.format('q')}, 'only': {RESTRICTIVE.format('q')}, 'gone': 0::BIGINT}})
  FILTER (news) OVER (PARTITION BY session_id ORDER BY utterance) AS steps FROM cm),
fo AS (SELECT *, list_reduce(steps, lambda a, x: {{'u': x.u, 'c': list_concat(
    CASE WHEN x.adds THEN a.c WHEN x.only AND len(list_filter(a.c, lambda y: list_has_any({TERMS.format('y.s')}, x.t))) = 0 THEN [] ELSE list_filter(a.c, lambda y: NOT list_has_any({TERMS.format('y.s')}, x.t)) END,
    list_filter(x.c, lambda y: NOT list_contains(list_transform(CASE WHEN x.adds THEN a.c WHEN x.only AND len(list_filter(a.c, lambda z: list_has_any({TERMS.format('z.s')}, x.t))) = 0 THEN [] ELSE list_filter(a.c, lambda z: NOT list_has_any({TERMS.format('z.s')}, x.t)) END, lambda w: w.s), y.s))),
  't': x.t, 'adds': x.adds, 'only': x.only,
  'gone': CASE WHEN x.adds THEN 0 WHEN x.only AND len(list_filter(a.c, lambda y: list_has_any({TERMS.format('y.s')}, x.t))) = 0 THEN len(a.c) ELSE len(list_filter(a.c, lambda y: list_has_any({TERMS.format('y.s')}, x.t))) END}}) AS f FROM st),
stale AS (SELECT f.session_id, f.utterance, count(se.text) AS n FROM fin f LEFT JOIN se ON se.session_id = f.session_id AND se.utterance = f.utterance AND se.text <> f.q GROUP BY ALL),
ev AS (SELECT se.session_id, utterance, idx, CASE WHEN utterance > since THEN 'refinement' WHEN is_final THEN 'final' ELSE 'provisional' END AS kind, text, NULL::BIGINT AS version, NULL::BIGINT AS dropped, NULL::VARCHAR AS citations
  FROM se LEFT JOIN base USING (session_id)
UNION ALL SELECT fo.session_id, fo.utterance, idx, CASE WHEN news THEN 'answer' WHEN presented THEN 'presented' ELSE 'preserved' END, array_to_string(list_transform(f.c, lambda x: x.s), ' '), version,
  CASE WHEN news THEN f.gone ELSE 0 END + stale.n, array_to_string({ONCE.format("list_transform(f.c, lambda v: v.u)")}, ',') FROM fo JOIN stale ON stale.session_id = fo.session_id AND stale.utterance = fo.utterance
UNION ALL SELECT o.session_id, o.utterance, NULL, 'given up', NULL, NULL, count(se.text), NULL FROM (SELECT session_id, utterance, max(ms) AS last FROM rw GROUP BY ALL HAVING NOT bool_or(is_final)) o
  LEFT JOIN se ON se.session_id = o.session_id AND se.utterance = o.utterance, mark WHERE last + {IDLE} <= mark GROUP BY o.session_id, o.utterance)"""


def said(spark, sf):
    """Hypotheses of the users' turns as a session's utterances, with the reply to each; one that has no reply never becomes final."""
    talk = table(spark, sf, "conversations")
    plain = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9 .!?\n]", " ")
    replies = talk.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), plain.alias("reply"))
    turns = talk.where("role = 'user'").select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("stream_id")).join(replies, ["conv_id", "turn"], "left")
    rows = chunks(spark, sf).join(turns, "stream_id").where(~F.col("is_final") | F.col("reply").isNotNull())
    at = F.col("conv_id") * 60000 + F.col("turn") * 100000 + F.round(F.col("ts") * 1000).cast("long")
    return rows.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("utterance"), "idx", F.timestamp_millis(at).alias("at"), "text", "is_final", F.when(F.col("is_final"), F.col("reply")).alias("reply"))


@query(f"WITH {RUNS} SELECT session_id, utterance, idx, kind, text, version, dropped, citations FROM ev")
def utterance_runs(spark, sf):
    with runs.rocks(spark):
        return drained(spark, said(spark, sf), lambda s: runs.runs(s, IDLE, f"{LATE} milliseconds"), "runs")


#: Hypotheses with a hashed bag of their tokens in 64 dimensions, and the cosine of each with the one before.
EMBEDDED = f"""{CHUNKS},
hy AS (SELECT split_part(stream_id, '-', 1) AS session_id, CAST(split_part(stream_id, '-', 2) AS BIGINT) AS utterance, idx, text, is_final, confidence,
  CASE WHEN is_final THEN 'final' WHEN trim(text) = '' THEN 'empty' WHEN length(trim(text)) < 24 OR len({SPLIT.format('trim(text)')}) < 5 OR confidence < 0.5 THEN 'problem'
    WHEN regexp_matches(trim(lower(text)), '^(?:{P.COMMANDS.replace(chr(39), chr(39) * 2)})') THEN 'presentation' ELSE 'semantic' END AS kind FROM ch),
tk AS (SELECT session_id, utterance, idx, unnest({TOKENS.format('text')}) AS t FROM hy WHERE kind = 'semantic'),
bk AS (SELECT session_id, utterance, idx, CAST('0x' || substr(md5(t), 1, 6) AS BIGINT) % 64 AS b, sum(CASE WHEN CAST('0x' || substr(md5(t), 7, 1) AS INT) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS x FROM tk GROUP BY ALL),
nn AS (SELECT session_id, utterance, idx, sqrt(sum(x * x)) AS r FROM bk GROUP BY ALL),
pv AS (SELECT session_id, utterance, idx, lag(idx) OVER (PARTITION BY session_id, utterance ORDER BY idx) AS p, row_number() OVER (PARTITION BY session_id, utterance ORDER BY idx) AS n FROM hy WHERE kind = 'semantic'),
dt AS (SELECT pv.session_id, pv.utterance, pv.idx, sum(a.x * b.x) AS d FROM pv JOIN bk a ON a.session_id = pv.session_id AND a.utterance = pv.utterance AND a.idx = pv.idx
  JOIN bk b ON b.session_id = pv.session_id AND b.utterance = pv.utterance AND b.idx = pv.p AND b.b = a.b GROUP BY ALL),
si AS (SELECT pv.*, CASE WHEN p IS NOT NULL THEN round(greatest(-1, least(1, coalesce(d / nullif(u.r * v.r, 0), 0))), 9) END AS sim FROM pv LEFT JOIN dt USING (session_id, utterance, idx)
  LEFT JOIN nn u ON u.session_id = pv.session_id AND u.utterance = pv.utterance AND u.idx = pv.idx LEFT JOIN nn v ON v.session_id = pv.session_id AND v.utterance = pv.utterance AND v.idx = pv.p),
sv AS (SELECT *, least(floor((sim + 1) / 2 * 64), 63) AS bin, lag(sim) OVER (PARTITION BY session_id, utterance ORDER BY idx) AS sim1 FROM si),
th AS (SELECT *, count(sim) OVER w AS seen, avg(sim) OVER w AS mean, stddev_pop(sim) OVER w AS sd, list_sort(list(bin) FILTER (bin IS NOT NULL) OVER w) AS bins FROM sv
  WINDOW w AS (PARTITION BY session_id ORDER BY utterance, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tr AS (SELECT *, CASE WHEN seen >= 8 THEN round(least(0.85, mean - sd), 9) ELSE 0.85 END AS stable_at, CASE WHEN seen >= 8 THEN round(least(0.65, bins[CAST(ceil(seen * 0.05) AS INT)] * 2 / 64 - 1), 9) ELSE 0.65 END AS drift_at FROM th),
de AS (SELECT *, coalesce(sim1 IS NOT NULL AND sim < drift_at, false) AS drifts,
  coalesce(sim1 >= stable_at AND sim >= stable_at AND sim >= drift_at AND round(greatest(0, least(1, (sim1 * exp(-0.3) + sim) / (exp(-0.3) + 1) * (0.7 + 0.3 * 0.8))), 9) >= stable_at, false) AS settled FROM tr),
fi AS (SELECT *, coalesce(bool_or(settled) OVER (PARTITION BY session_id, utterance ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS fired FROM de)"""


def embedded(spark, sf):
    """Hypotheses of the users' turns, a conversation being a session, with their embeddings."""
    rows = chunks(spark, sf)
    names = F.split("stream_id", "-")
    keyed = rows.withColumn("key", F.concat_ws("#", "stream_id", "idx"))
    held = models.native_hash_embedding(keyed, "key", "text").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.col("weight").cast("double")))).alias("held"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.try_element_at("held", i.cast("long")), F.lit(0.0)))
    return keyed.join(held, "key", "left").select(names[0].alias("session_id"), names[1].cast("long").alias("utterance"), "idx", "text", "is_final", "confidence", vector.alias("embedding"))


@query(f"""WITH {EMBEDDED} SELECT hy.session_id, hy.utterance, hy.idx,
CASE WHEN kind = 'final' THEN 'Retrieve' WHEN kind IN ('empty', 'presentation') THEN 'No-Retrieval' WHEN kind = 'problem' THEN 'Wait' WHEN (settled AND NOT fired) OR (drifts AND fired) THEN 'Retrieve' ELSE 'Wait' END AS decision,
CASE WHEN kind <> 'semantic' THEN kind WHEN settled AND NOT fired THEN 'stable' WHEN drifts AND fired THEN 'intent drift' WHEN n < 3 THEN 'building window' ELSE 'not stable' END AS reason, stable_at, drift_at
FROM hy LEFT JOIN fi ON fi.session_id = hy.session_id AND fi.utterance = hy.utterance AND fi.idx = hy.idx""")
def production_controller(spark, sf):
    with runs.rocks(spark):
        return drained(spark, embedded(spark, sf), production.streamed, "production")


@query("SELECT row_number() OVER (ORDER BY event_id) AS event_id, event_id AS source_id, user_id, event_type FROM events WHERE event_type IN ('error', 'purchase')")
def published_events(spark, sf):
    """Errors and purchases in a journal, read again from its beginning."""
    source, path, mark = (shared_folder(spark, f"journal-{x}") for x in ("in", "out", "mark"))
    found = table(spark, sf, "events").where("event_type IN ('error', 'purchase')").select(F.col("event_id").alias("source_id"), "user_id", "event_type")
    found.write.parquet(source)
    journal.publish(spark.readStream.schema(found.schema).parquet(source), path, mark, ["source_id"]).start().awaitTermination()
    return journal.events(spark, path).select("event_id", "source_id", "user_id", "event_type")
