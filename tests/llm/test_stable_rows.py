"""Rows keep their numbers when scans of the input are split differently from job to job."""

import itertools
import random

from quarryline.llm import suffix_dedup


def test_repeats_are_cut_from_the_right_documents(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage = prose(50)
    rows = [(i, prose(80) + (f" {passage} {prose(10)}" if i % 7 == 0 else "")) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(12).write.parquet(f"{tmp_path}/d.parquet")
    splits, real = itertools.cycle(["2000", "134217728", "300000"]), suffix_dedup.stage_table
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def stage_table(*args, **options):
        out = real(*args, **options)
        spark.conf.set("spark.sql.files.maxPartitionBytes", next(splits))
        return out

    monkeypatch.setattr(suffix_dedup, "stage_table", stage_table)
    try:
        got = {r.doc_id: r.text for r in suffix_dedup.dedup(spark.read.parquet(f"{tmp_path}/d.parquet")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == len(rows)
    for i, t in rows:
        assert (got[i] == t) == (i % 7 != 0) and passage not in got[i]
