"""Cleaning of a passage corpus: boilerplate lines, links, white space and exact duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import host_of, strip, text_digest, tidy_lines

MIN_PASSAGES = 10
MAX_LINE = 60
SHARE = 0.60
KEPT = 0.30
PAGINATION = r"(?i)webarchive\.library\.unt\.edu/eot\d+/query"
MARKDOWN = r"\[([^\]\n]*)\]\(([^)\s]*)\)"
BARE = r"(?<![(\[])https?://\S+"


def is_pagination(url: Column) -> Column:
    return url.rlike(PAGINATION)


def host_lines(passages: DataFrame) -> DataFrame:
    """(host, line, n, passages): in how many of its host's passages each short line stands; crawl pages don't count."""
    rows = passages.where(~is_pagination(F.col("url"))).withColumn("host", host_of(F.col("url")))
    lines = F.array_distinct(F.filter(F.transform(F.split("text", "\n", -1), strip), lambda x: F.length(x).between(2, MAX_LINE)))
    counts = rows.select("host", F.explode(lines).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(rows.groupBy("host").agg(F.count(F.lit(1)).alias("passages")), "host")


def chrome_lines(passages: DataFrame) -> DataFrame:
    """(host, line) of boilerplate: lines in most passages of a host with enough of them."""
    return host_lines(passages).where((F.col("passages") >= MIN_PASSAGES) & (F.col("n") >= SHARE * F.col("passages"))).select("host", "line")


def strip_chrome(passages: DataFrame) -> DataFrame:
    """``passages`` with host, clean and did_strip; a passage that would be gutted stays as it is."""
    chrome = chrome_lines(passages).groupBy("host").agg(F.collect_set("line").alias("chrome"))
    df = passages.withColumn("host", host_of(F.col("url"))).join(chrome, "host", "left")
    kept = F.filter(F.split("text", "\n", -1), lambda x: ~F.array_contains(F.col("chrome"), strip(x)))
    df = df.withColumn("_clean", strip(F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n")))
    ok = F.col("chrome").isNotNull() & (F.col("_clean") != "") & (F.length("_clean") >= F.length("text") * KEPT)
    return df.withColumns({"clean": F.when(ok, F.col("_clean")).otherwise(F.col("text")), "did_strip": F.coalesce(ok, F.lit(False))}).drop("_clean", "chrome")


def links_of(text: Column) -> tuple[Column, Column]:
    """(prose, links): link text stays, targets and bare addresses are lifted; kept as it was if links make up most of it."""
    prose = F.regexp_replace(text, MARKDOWN, "$1")
    links = F.concat(F.regexp_extract_all(text, F.lit(MARKDOWN), F.lit(2)), F.regexp_extract_all(prose, F.lit(BARE), F.lit(0)))
    left = F.regexp_replace(prose, BARE, " ")
    gutted = (F.size(links) > 0) & (F.length(left) < F.length(text) * KEPT)
    return F.when(gutted, text).otherwise(left), F.when(gutted, F.array().cast("array<string>")).otherwise(links)


def clean(passages: DataFrame) -> DataFrame:
    """(id, host, text, links, stripped, chars_removed, text_raw_sha256) of what remains of each passage (id, url, text)."""
    df = strip_chrome(passages.where(~is_pagination(F.col("url"))))
    prose, links = links_of(F.col("clean"))
    df = df.withColumns({"_prose": prose, "links": links})
    df = df.withColumn("_tidy", tidy_lines(F.col("_prose")))
    stripped = F.array_compact(F.array(F.when(F.col("did_strip"), "nav_chrome"), F.when(F.size("links") > 0, "markdown_links"), F.when(F.col("_tidy") != F.col("_prose"), "whitespace")))
    removed = F.length("text") - F.length("_tidy")
    out = df.select("id", "host", F.col("_tidy").alias("clean"), "links", stripped.alias("stripped"), removed.cast("long").alias("chars_removed"), F.sha2("text", 256).alias("text_raw_sha256"))
    return out.where(F.col("clean") != "").withColumnRenamed("clean", "text")


def dedup_exact(passages: DataFrame, gold: DataFrame) -> DataFrame:
    """(id, digest, is_gold, kept, dropped_duplicate_of) of each passage; input order is that of ids.

    Of equal texts the first gold one wins, else the first; every gold one stays. The winner names the
    first row if it displaced it, other gold rows name the winner.
    """
    rows = passages.withColumn("digest", text_digest(F.col("text"))).join(gold.select("id").distinct().withColumn("is_gold", F.lit(True)), "id", "left")
    rows = rows.select("id", "digest", F.coalesce("is_gold", F.lit(False)).alias("is_gold"))
    # the group's two names come from one small row per digest, so a very common text stays spread out
    heads = rows.groupBy("digest").agg(F.min("id").alias("first"), F.coalesce(F.min(F.when(F.col("is_gold"), F.col("id"))), F.min("id")).alias("winner"))
    df = rows.join(heads, "digest")
    won = F.col("id") == F.col("winner")
    other = F.when(won & (F.col("first") != F.col("id")), F.col("first")).when(~won & F.col("is_gold"), F.col("winner"))
    return df.select("id", "digest", "is_gold", (won | F.col("is_gold")).alias("kept"), other.alias("dropped_duplicate_of"))


def validate_domains(qrels: DataFrame, raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """(n_raw, n_clean, n_dropped, n_missing): counts, and relevance rows whose passage doesn't exist."""
    missing = qrels.join(raw.select("id"), "id", "left_anti")
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)).withColumn("_k", F.lit(1))
    out = one(raw, "n_raw").join(one(cleaned, "n_clean"), "_k").join(one(missing, "n_missing"), "_k")
    return out.select("n_raw", "n_clean", (F.col("n_raw") - F.col("n_clean")).alias("n_dropped"), "n_missing")


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
