"""Queries that clean and validate a corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import text as T
from quarryline.operators import cleaning as C
from quarryline.operators.containment import containing
from quarryline.plans.base import query, spoken, values
from quarryline.session import written
from quarryline.sources.tables import page_passages, passages, table

STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
PAGES = "pg AS (SELECT page_id AS id, coalesce(url, '') AS url, regexp_replace(coalesce(html, ''), '<[^>]*>', chr(10), 'g') AS text FROM pages)"
HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
CHROME = f"""{PAGES},
hp AS (SELECT *, {HOST} AS host FROM pg WHERE NOT regexp_matches(url, '(?i)webarchive\\.library\\.unt\\.edu/eot\\d+/query')),
ln AS (SELECT DISTINCT id, host, {STRIP.format("l")} AS line FROM (SELECT id, host, unnest(string_split(text, chr(10))) AS l FROM hp)),
lc AS (SELECT host, line, count(*) AS n FROM ln WHERE length(line) BETWEEN 2 AND 60 GROUP BY ALL),
hc AS (SELECT host, count(*) AS passages FROM hp GROUP BY host),
chrome AS (SELECT host, line FROM lc JOIN hc USING (host) WHERE passages >= 10 AND n >= 0.6 * passages)"""
STRIPPED = f"""{CHROME},
kept AS (SELECT id, {STRIP.format("regexp_replace(array_to_string(list_transform(list_filter(list_zip(ls, fs), lambda x: NOT x[2]), lambda x: x[1]), chr(10)), chr(10) || '{3,}', chr(10) || chr(10), 'g')")} AS c
  FROM (SELECT id, list(l ORDER BY p) AS ls, list(c.line IS NOT NULL ORDER BY p) AS fs
    FROM (SELECT id, host, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM hp) x
    LEFT JOIN chrome c ON c.host = x.host AND c.line = {STRIP.format("x.l")} GROUP BY id)),
st AS (SELECT hp.*, c, hp.host IN (SELECT host FROM chrome) AND c <> '' AND length(c) >= length(text) * 0.3 AS did FROM hp JOIN kept USING (id))"""


@query(f"WITH {PAGES} SELECT {HOST} AS host, count(*) AS n FROM pg GROUP BY ALL")
def page_hosts(spark, sf):
    return page_passages(spark, sf).groupBy(T.host_of(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CHROME} SELECT host, line, n, passages FROM lc JOIN hc USING (host)")
def host_line_df(spark, sf):
    return C.host_lines(page_passages(spark, sf))


@query(f"WITH {CHROME} SELECT host, line FROM chrome")
def chrome_lines(spark, sf):
    return C.chrome_lines(page_passages(spark, sf))


@query(f"WITH {STRIPPED} SELECT id, host, did AS did_strip, sha1(CASE WHEN did THEN c ELSE text END) AS digest FROM st")
def chrome_strip(spark, sf):
    return C.strip_chrome(page_passages(spark, sf)).select("id", "host", "did_strip", F.sha1("clean").alias("digest"))


@query("SELECT doc_id AS id, sha1(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS digest FROM documents")
def text_digests(spark, sf):
    return passages(spark, sf).select("id", T.text_digest(F.col("text")).alias("digest"))


TIDY = STRIP.format("array_to_string(list_transform(string_split(regexp_replace(regexp_replace({0}, '\\n[ \\t]*(?:\\n[ \\t]*){{2,}}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g'), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), chr(10))")


@query(f"WITH {PAGES} SELECT id, length(tidy) AS n, sha1(tidy) AS digest FROM (SELECT id, {TIDY.format('text')} AS tidy FROM pg)")
def clean_whitespace(spark, sf):
    t = T.tidy_lines(F.col("text"))
    return page_passages(spark, sf).withColumn("tidy", t).select("id", F.length("tidy").cast("long").alias("n"), F.sha1("tidy").alias("digest"))


DEDUP = """
dg AS (SELECT doc_id AS id, sha1(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS digest,
  doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS is_gold FROM documents),
hd AS (SELECT digest, min(id) AS first, coalesce(min(CASE WHEN is_gold THEN id END), min(id)) AS winner FROM dg GROUP BY digest),
dd AS (SELECT id, digest, is_gold, id = winner OR is_gold AS kept,
  CASE WHEN id = winner AND first <> id THEN first WHEN id <> winner AND is_gold THEN winner END AS dropped_duplicate_of FROM dg JOIN hd USING (digest))"""


def _dedup(spark, sf):
    gold = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return C.dedup_exact(passages(spark, sf), gold)


@query(f"WITH {DEDUP} SELECT id, digest, is_gold, kept, dropped_duplicate_of FROM dd")
def dedup_exact_gold(spark, sf):
    return _dedup(spark, sf)


@query(f"WITH {DEDUP} SELECT id, dropped_duplicate_of FROM dd WHERE dropped_duplicate_of IS NOT NULL")
def dedup_displaced(spark, sf):
    return _dedup(spark, sf).where("dropped_duplicate_of IS NOT NULL").select("id", "dropped_duplicate_of")


LINKED = [
    (1, "See [the guide](https://a.example/x) and https://b.example/y now."),
    (2, "[only](https://a.example/long/address/that/is/most/of/it)"),
    (3, "no links here"),
    (4, "bare https://c.example/z\nand [empty]() plus [t](u)"),
]


@query(f"""WITH p AS (SELECT k, t, regexp_replace(t, '\\[([^\\]\\n]*)\\]\\(([^)\\s]*)\\)', '\\1', 'g') AS prose FROM {values(LINKED, ['k', 't'])}),
q AS (SELECT k, t, regexp_replace(prose, 'https?://\\S+', ' ', 'g') AS l, list_concat(regexp_extract_all(t, '\\[([^\\]\\n]*)\\]\\(([^)\\s]*)\\)', 2), regexp_extract_all(prose, 'https?://\\S+')) AS ls FROM p)
SELECT k, CASE WHEN len(ls) > 0 AND length(l) < 0.3 * length(t) THEN t ELSE l END AS prose,
  CASE WHEN len(ls) > 0 AND length(l) < 0.3 * length(t) THEN '' ELSE array_to_string(ls, ' ') END AS links FROM q""")
def passage_links(spark, sf):
    prose, links = C.links_of(F.col("t"))
    return spark.createDataFrame(LINKED, "k int, t string").select("k", prose.alias("prose"), F.array_join(links, " ").alias("links"))


@query("SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))), ' ') AS links FROM pages")
def page_links(spark, sf):
    found = F.sort_array(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('href="([^"]*)"'), F.lit(1))))
    return table(spark, sf, "pages").select("page_id", F.array_join(found, " ").alias("links"))


URLS = [(1, "https://WebArchive.library.unt.edu/eot2008/query?year=1"), (2, "https://example.org/eot2008/query"), (3, ""), (4, "http://webarchive.library.unt.edu/eot/query")]


@query(f"SELECT k, regexp_matches(u, '(?i)webarchive\\.library\\.unt\\.edu/eot\\d+/query') AS crawl FROM (SELECT page_id AS k, {spoken(URLS, 'page_id', 'url', 16)} AS u FROM pages)")
def crawl_pagination(spark, sf):
    return table(spark, sf, "pages").select(F.col("page_id").alias("k"), C.is_pagination(F.expr(spoken(URLS, "page_id", "url", 16))).alias("crawl"))


@query(f"""WITH {STRIPPED}, a AS (SELECT id, host, text, did, CASE WHEN did THEN c ELSE text END AS b FROM st),
t AS (SELECT *, {TIDY.format("regexp_replace(b, 'https?://\\S+', ' ', 'g')")} AS x, regexp_extract_all(b, 'https?://\\S+') AS ls FROM a)
SELECT id, host, sha1(x) AS digest, length(text) - length(x) AS chars_removed, sha256(text) AS text_raw_sha256 FROM t WHERE x <> ''""")
def clean_pages(spark, sf):
    out = C.clean(page_passages(spark, sf))
    return out.select("id", "host", F.sha1("text").alias("digest"), "chars_removed", "text_raw_sha256")


QRELS = "qrel AS (SELECT b.item_id AS task_id, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def qrels(spark, sf):
    """(task_id, id): passages that hold a benchmark item word for word."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("task_id"), F.col("text").alias("item"))
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    return written(containing(docs, items), "qrels")


@query(f"WITH {QRELS} SELECT task_id, array_to_string(list(id ORDER BY id), ',') AS ids FROM qrel GROUP BY task_id")
def qrels_collect(spark, sf):
    q = qrels(spark, sf).groupBy("task_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return q.select("task_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("SELECT doc_id AS id FROM labels ANTI JOIN (SELECT doc_id FROM documents WHERE lang = 'en') e USING (doc_id)")
def qrels_missing_antijoin(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents").where("lang = 'en'").select("doc_id"), "doc_id", "left_anti").select(F.col("doc_id").alias("id"))


@query(f"""WITH {DEDUP} SELECT count(*) AS n_raw, sum(CASE WHEN kept THEN 1 ELSE 0 END) AS n_clean, sum(CASE WHEN kept THEN 0 ELSE 1 END) AS n_dropped,
(SELECT count(*) FROM labels ANTI JOIN documents USING (doc_id)) AS n_missing FROM dd""")
def corpus_validate_counts(spark, sf):
    p = passages(spark, sf)
    return C.validate_domains(table(spark, sf, "labels").select(F.col("doc_id").alias("id")), p, _dedup(spark, sf).where("kept"))


@query("""SELECT doc_id AS id, lang || ':id:' || doc_id AS document_group,
CASE WHEN b < 6522 THEN 'train' WHEN b < 7826 THEN 'dev' ELSE 'test' END AS split FROM
(SELECT doc_id, lang, CAST('0x' || substr(sha256('20260928:' || lang || ':id:' || doc_id), 1, 16) AS UBIGINT) % 10000 AS b FROM documents)""")
def split_assignment(spark, sf):
    group = T.document_group(F.col("domain"), F.lit(""), F.col("id").cast("string"))
    return passages(spark, sf).select("id", group.alias("document_group"), T.assigned_split(group).alias("split"))


@query(f"WITH {PAGES} SELECT id, 'web:url:' || string_split(lower(trim(url)), '#')[1] AS document_group FROM pg WHERE trim(url) <> ''")
def page_groups(spark, sf):
    return page_passages(spark, sf).where("trim(url) <> ''").select("id", T.document_group(F.lit("web"), F.col("url"), F.lit("x")).alias("document_group"))
