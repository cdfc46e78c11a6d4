"""File sources and sinks: JSON lines, relevance tables, reviews, traces, manifests and indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = "struct<timestamp_s: double, text: string, is_final: boolean, confidence: double>"
STREAM = f"stream_id string, task_id string, category string, domain string, qrel_passage_ids array<string>, stability_chunk_index int, settling_ms int, chunks array<{CHUNK}>, split string, case_class string, provenance string"
CASE = "case_id string, split string, domain string, case_class string, query string, expected_behavior string, source_document_group string, reference_answer string, required_clarification string, gold_passage_ids array<string>, support_spans array<struct<passage_id: string, start: int, `end`: int, text: string>>, tags array<string>, provenance map<string,string>, review map<string,string>"
TASK = "task_id string, conversation_id string, Collection string, input array<struct<speaker: string, text: string>>, contexts array<struct<document_id: string, text: string, score: double>>, answerability array<string>"
TRACE = "trace_id string, status string, cost_estimate_basis string, estimated_cost_usd double, retrieval_events array<struct<timestamp_s: double, query: string, trigger: string>>, decisions array<struct<timestamp_s: double, text: string, decision: string, reason: string>>, stage_latency_ms map<string,double>, token_usage map<string,bigint>"
REQUIRED = ("trace_id", "status", "cost_estimate_basis", "retrieval_events", "decisions", "stage_latency_ms", "token_usage")


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines by a schema; blank lines are skipped, a bad line ends a strict read and is null otherwise."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def relevance(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, corpus_id, score) of a tab-separated file with a header; the last of repeated pairs counts."""
    raw = spark.read.option("sep", "\t").option("header", True).schema("`query-id` string, `corpus-id` string, score int").csv(path)
    rows = raw.select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("corpus_id"), "score", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("n"))
    return rows.groupBy("query_id", "corpus_id").agg(F.max_by("score", F.struct("f", "n")).alias("score"))


def query_tasks(tasks: DataFrame, qrels: DataFrame, collection: str) -> DataFrame:
    """(task_id, query, qrels) of a collection's tasks that have relevance rows; the query is the last user turn."""
    last = F.try_element_at(F.filter("input", lambda x: x["speaker"] == "user"), F.lit(-1))["text"]
    rel = qrels.groupBy(F.col("query_id").alias("task_id")).agg(F.sort_array(F.collect_list("corpus_id")).alias("qrels"))
    return tasks.where(F.contains(F.lower("Collection"), F.lit(collection))).join(rel, "task_id").select("task_id", last.alias("query"), "qrels")


def stream_chunks(streams: DataFrame) -> DataFrame:
    """(stream_id, idx, ts, text, is_final, confidence) of stream rows."""
    rows = streams.select("stream_id", F.posexplode("chunks").alias("idx", "c"))
    return rows.select("stream_id", F.col("idx").cast("long").alias("idx"), F.col("c.timestamp_s").alias("ts"), "c.text", "c.is_final", "c.confidence")


def first_of_files(spark: SparkSession, paths: list[str], schema: str, key: str) -> DataFrame:
    """Rows of several files, the first file's row winning for a key; rows that can't be read are left out."""
    from pyspark.sql import Window

    parts = [json_lines(spark, p, schema, strict=False).where(F.col(key).isNotNull()).withColumn("_file", F.lit(i)) for i, p in enumerate(paths)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    w = Window.partitionBy(key).orderBy("_file")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_file")


def reviews(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a review file: quoted fields may hold commas, quotes and line ends."""
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def write_reviews(cases: DataFrame, path: str) -> None:
    """Cases as a review file, lists and spans as JSON in their columns."""
    out = cases.select("case_id", "split", "domain", "case_class", "query", "reference_answer", "required_clarification", F.to_json("gold_passage_ids").alias("gold_passage_ids"), F.to_json("support_spans").alias("support_spans"))
    out.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def imported_reviews(cases: DataFrame, file: DataFrame) -> DataFrame:
    """(case_id, status, problem): unknown ids and cases without a review are problems."""
    a, b = cases.select("case_id", F.lit(True).alias("known")), file.select("case_id", "status")
    problem = F.when(F.col("known").isNull(), "unknown case").when(F.col("status").isNull(), "no review").when(~F.col("status").isin("approved", "rejected", "pending"), "invalid status")
    return a.join(b, "case_id", "full_outer").select("case_id", "status", problem.alias("problem"))


def traces(spark: SparkSession, path: str) -> DataFrame:
    """(trace_id, status, cost, problems) of every non-blank line of a trace file."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    row = raw.select("value", F.from_json("value", TRACE).alias("t"), F.json_object_keys("value").alias("keys"))
    missing = F.array_except(F.array(*map(F.lit, REQUIRED)), F.coalesce("keys", F.array().cast("array<string>")))
    t = F.col("t")
    rules = F.array_compact(
        F.array(
            F.when(F.col("keys").isNull(), "invalid JSON"),
            F.when(F.col("keys").isNotNull() & (F.size(missing) > 0), F.concat(F.lit("missing fields "), F.array_join(missing, ", "))),
            F.when(~F.coalesce(t["status"].isin("complete", "error"), F.lit(False)), "invalid execution status"),
            F.when(t["estimated_cost_usd"] < 0, "estimated_cost_usd must be null or nonnegative"),
            F.when((t["status"] == "complete") & t["estimated_cost_usd"].isNull(), "complete trace has no cost estimate"),
        )
    )
    return row.select(t["trace_id"].alias("trace_id"), t["status"].alias("status"), t["estimated_cost_usd"].alias("cost"), F.array_join(rules, "; ").alias("problems"))


def write_json_lines(df: DataFrame, path: str, sort_keys: bool = False, keep_nulls: bool = True) -> None:
    """A folder of JSON lines; keys in alphabetical order if asked."""
    out = df.select(*sorted(df.columns)) if sort_keys else df
    out.write.mode("overwrite").option("ignoreNullFields", str(not keep_nulls).lower()).json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of the files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, problem) of files that are missing or of another size or checksum."""
    e = expected.select("name", F.col("bytes").alias("want"), F.col("sha256").alias("sum"))
    problem = F.when(F.col("bytes").isNull(), "missing").when(F.col("bytes") != F.col("want"), "size").when(F.col("sha256") != F.col("sum"), "checksum")
    return e.join(found, "name", "left").select("name", problem.alias("problem")).where("problem IS NOT NULL")


def write_index(vectors: DataFrame, path: str, encoder: str) -> str:
    """Overwrite the vector table of an encoder, laid out by domain; returns its path."""
    target = f"{path}__{encoder}"
    vectors.write.mode("overwrite").partitionBy("domain").parquet(target)
    return target


def remaining(cases: DataFrame, done: DataFrame, key: str = "case_id") -> DataFrame:
    """Cases that a checkpoint doesn't have yet."""
    return cases.join(done.select(key).distinct(), key, "left_anti")
