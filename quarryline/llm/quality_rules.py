"""Host-level quality rules, in DataFrame functions only.

Each document is measured on its whole text; rule failures are summed by host, the hosts' failure
rates are shrunk with a beta prior fitted to all hosts, and the verdict on a host is joined back:
in a rejected host a document stays only if it breaks no rule at all.

Defined cases: a null or empty text has no words (and fails the base rules); a null host is a host
of its own; repeated rows are measured, counted and returned each; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.runtime import stage_table

WHITE = r"[\x20\x09-\x0D]"
WHITE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class HostRules:
    """Limits of the rules. ``reject_rate``: shrunk failure rate above which a host is rejected."""

    min_words: int = 50
    max_repeat_share: float = 0.5
    max_symbol_share: float = 0.1
    max_dup_line_share: float = 0.3
    min_mean_word: float = 2.0
    max_mean_word: float = 12.0
    reject_rate: float = 0.5


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WHITE + "+", -1), lambda w: w != "")


def _tail(array: Column, start: int, n: Column) -> Column:
    return F.slice(array, F.lit(start), F.greatest(n, F.lit(0)))


def _repeat_words(keys: Column) -> Column:
    """Words inside the 3-word windows whose key occurs twice or more; ``keys`` has one per window."""
    by_key = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    m = F.size(keys) - 1
    pairs = F.zip_with(_tail(by_key, 1, m), _tail(by_key, 2, m), lambda a, b: F.when(a.k == b.k, F.array(a.i, b.i)))
    return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the per-document measures to the columns of ``docs`` (its text column leaves)."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.translate(x, WHITE_CHARS, "") != "")
    df = docs.withColumns({"_body": body, "_words": words_of(body), "_lines": lines})
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.translate("_body", WHITE_CHARS, "")).cast("long"),
            "n_symbols": (F.length("_body") - F.length(F.translate("_body", SYMBOLS, ""))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_hash": F.transform("_words", lambda w: F.xxhash64(w)),
        }
    )
    n = F.size("_hash") - 2
    pairs = F.zip_with(_tail(F.col("_hash"), 1, n), _tail(F.col("_hash"), 2, n), lambda a, b: F.xxhash64(a, b))
    df = df.drop("_words", "_lines", "_body", text).withColumn("_keys", F.zip_with(pairs, _tail(F.col("_hash"), 3, n), lambda p, c: F.xxhash64(p, c)))
    df = df.withColumn("_starts", F.when(F.size(F.array_distinct("_keys")) < F.size("_keys"), _repeat_words(F.col("_keys"))))
    gaps = F.size("_starts") - 1
    covered = F.aggregate(F.zip_with(_tail(F.col("_starts"), 1, gaps), _tail(F.col("_starts"), 2, gaps), lambda a, b: F.least(F.lit(3), b - a)), F.lit(3), lambda s, x: s + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_hash", "_keys", "_starts")


def judged(measured: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """Add base_failed and n_failed, the number of rules that a document breaks."""
    n, chars = F.col("n_words"), F.col("word_chars")
    base = (n < rules.min_words) | (100 * F.col("n_repeat_words") > int(100 * rules.max_repeat_share) * n)
    broken = [
        base,
        F.col("n_symbols") > rules.max_symbol_share * chars,
        F.col("n_dup_lines") > rules.max_dup_line_share * F.col("n_lines"),
        (chars < rules.min_mean_word * n) | (chars > rules.max_mean_word * n),
    ]
    return measured.withColumns({"base_failed": base, "n_failed": sum((b.cast("int") for b in broken), F.lit(0))})


def host_verdicts(judged_docs: DataFrame, host: str = "host", rules: HostRules = HostRules()) -> DataFrame:
    """One row per host: documents, failing documents, shrunk rate and verdict.

    The prior's mean is the overall rate; its weight comes from the variance of the hosts' rates
    beyond sampling noise (method of moments), held between 1 and 10,000 documents.
    """
    hosts = judged_docs.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), F.sum((F.col("n_failed") > 0).cast("long")).alias("n_bad"))
    m = F.try_divide(F.sum("n_bad"), F.sum("n_docs"))
    prior = hosts.agg(
        m.alias("m"),
        (F.try_divide(F.sum(F.col("n_bad").cast("double") * F.col("n_bad") / F.col("n_docs")), F.sum("n_docs")) - m * m).alias("v"),
        F.try_divide(F.count(F.lit(1)).cast("double"), F.sum("n_docs")).alias("per"),
    ).first()  # one row, whatever the input
    mean, var, per = (float(x or 0.0) for x in prior)
    spread = mean * (1 - mean)
    between = var - spread * per
    weight = min(1e4, max(1.0, spread / between - 1)) if between > 0 else 1e4
    rate = (F.col("n_bad") + weight * mean) / (F.col("n_docs") + weight)
    return hosts.withColumn("shrunk_rate", rate).withColumn("host_rejected", F.col("shrunk_rate") > rules.reject_rate)


def host_rules(docs: DataFrame, host: str = "source", rules: HostRules = HostRules()) -> DataFrame:
    """Judge ``docs`` (doc_id, text and the host column); one row per input row."""
    rows = docs.select(F.col("doc_id"), F.col(f"`{host}`").alias("host"), F.col("text"))
    table = stage_table(judged(measure(rows), rules), "host-rules")
    verdicts = host_verdicts(table, "host", rules).select(F.col("host").alias("verdict_host"), "shrunk_rate", "host_rejected")
    joined = table.join(verdicts, F.col("host").eqNullSafe(F.col("verdict_host")), "left").drop("verdict_host")
    return joined.withColumn("kept", ~F.col("base_failed") & ~(F.col("host_rejected") & (F.col("n_failed") > 0)))


def op7_host_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return host_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tri AS (SELECT r, u.i AS i, w.ws[u.i] || ' ' || w.ws[u.i + 1] || ' ' || w.ws[u.i + 2] AS g
        FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT r, sum(least(3, coalesce(nx - i, 3))) AS n FROM
        (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM rep) GROUP BY r),
m AS (SELECT w.doc_id, w.source, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) AS BIGINT) AS n_lines,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cov USING (r)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) OR n_symbols > 0.1 * word_chars
             OR n_dup_lines > 0.3 * n_lines OR word_chars < 2 * n_words OR word_chars > 12 * n_words AS bad FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (bad) AS k FROM j GROUP BY source),
p AS (SELECT sum(k) / sum(n) AS m, sum(k * k / n) / sum(n) - (sum(k) / sum(n)) * (sum(k) / sum(n)) AS v,
             count(*) / sum(n) AS per FROM h),
q AS (SELECT m, CASE WHEN v - m * (1 - m) * per > 0
             THEN least(10000, greatest(1, m * (1 - m) / (v - m * (1 - m) * per) - 1)) ELSE 10000 END AS s FROM p),
verdict AS (SELECT source, (k + s * m) / (n + s) > 0.5 AS rejected FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (rejected AND bad) AS kept
FROM j JOIN verdict ON j.source IS NOT DISTINCT FROM verdict.source
"""
