"""Quotas per class against a plain draw."""

import hashlib
import random

from quarryline.operators import curation


def test_quotas(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["a", "b", "x"]), rng.choice(["en", "en", "en", "de", "fr"]), f"g{rng.randint(0, 90)}") for i in range(600)] + [(999, "a", "es", "lone")]
    table = spark.createDataFrame(rows, "case_id long, case_class string, domain string, document_group string").repartition(5)
    quotas = {"a": 23, "b": 500, "none": 3}
    got = sorted((r.case_class, r.pick, r.case_id) for r in curation.quota_seeds(table, quotas, 5).collect())
    want = []
    for c, n in quotas.items():
        one = {}
        for h, i, d, g in sorted((hashlib.sha256(f"5|{i}".encode()).hexdigest(), i, d, g) for i, k, d, g in rows if k == c):
            one.setdefault(g, (h, i, d))
        turns = {}
        for h, i, d in sorted(one.values()):
            turns.setdefault(d, []).append(i)
        order = sorted((own, d, i) for d, some in turns.items() for own, i in enumerate(some))
        want += [(c, k, i) for k, (_, _, i) in enumerate(order[:n], 1)]
    assert got == sorted(want) and sum(g[0] == "a" for g in got) == 23


def test_a_large_stratum_is_ranked_in_parts(spark):
    table = spark.range(5000).selectExpr("id", "1 AS k")
    from pyspark.sql import functions as F

    top = curation.bounded_top(table, ["k"], [F.col("id").desc()], 7, spread=16)
    assert sorted((r.own, r.id) for r in top.collect()) == [(n + 1, 4999 - n) for n in range(7)]
