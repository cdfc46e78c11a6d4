"""How queries are registered: a function of (spark, sf_dir) and, where SQL has the same, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return register


def values(rows: list[tuple], columns: list[str]) -> str:
    """A SQL VALUES list with the rows of a fixture."""

    def one(x):
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        if isinstance(x, (int, float)):
            return repr(x)
        if isinstance(x, (list, tuple)):
            return "[" + ", ".join(map(one, x)) + "]"
        return "'" + str(x).replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(columns)})"


def spoken(rows: list[tuple], key: str, text: str = "text", every: int = 64) -> str:
    """An expression that both engines read: a table's own texts, but one of the example ``rows`` (n, text) where ``key`` modulo ``every`` is n."""
    some = " ".join(f"WHEN {n} THEN '{t}'" for n, t in rows)
    return f"CASE ({key}) % {every} {some} ELSE coalesce({text}, '') END"


#: Tokens of a text in DuckDB.
TOKENS = "list_transform(regexp_extract_all({0}, '[A-Za-z0-9_]+'), lambda x: lower(x))"
#: Postings, lengths and corpus statistics of the documents.
INDEX = f"""
d AS (SELECT doc_id AS id, lang AS domain, {TOKENS.format("coalesce(text, '')")} AS ts FROM documents),
post AS (SELECT id, domain, term, count(*) AS tf FROM (SELECT id, domain, unnest(ts) AS term FROM d) GROUP BY ALL),
dl AS (SELECT id, domain, len(ts) AS dl FROM d),
corpus AS (SELECT count(*) AS n, greatest(coalesce(avg(dl), 0), 1) AS mean FROM dl),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term)
"""
TASKS = f"task AS (SELECT item_id AS task_id, array_to_string({TOKENS.format("coalesce(text, '')")}, ' ') AS query, text AS full_text FROM benchmark)"
BM25 = f"""
{INDEX}, {TASKS},
asked AS (SELECT task_id, term, count(*) AS qtf FROM (SELECT task_id, unnest({TOKENS.format('query')}) AS term FROM task) GROUP BY ALL),
scores AS (
  SELECT task_id, post.id, post.domain, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) * qtf), 6) AS score
  FROM post JOIN asked USING (term) JOIN df USING (term) JOIN dl ON dl.id = post.id, corpus GROUP BY ALL),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, id) AS rank FROM scores WHERE score > 0) WHERE rank <= 30)
"""
