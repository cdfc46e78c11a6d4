"""Passages that hold an item, by runs of words, against trying all."""

import random

from quarryline.operators import containment
from quarryline.plans.cleaning import qrels


def brute(docs, items):
    return sorted({(t, d) for t, item in items for d, text in docs if item is not None and text is not None and item in text})


def test_containing_equals_trying_all(spark, monkeypatch):
    rng = random.Random(11)
    words = ["a", "be", "see", "ü", "Ab", "long-er", "a,b", "x.y"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t", " ", "\x1f"]) for _ in range(n))
    docs = [(i, text(rng.choice([0, 9, 40, 200]))) for i in range(120)] + [(500, None), (501, ""), (502, "a " * 30), (503, "A " * 30)]
    items = [(i, docs[i][1][rng.randrange(1, 9) : rng.choice([20, 60, 300])]) for i in range(60)]  # cut inside words
    items += [(100, None), (101, ""), (102, "a"), (103, "a " * 12), (104, "a " * 9), (105, docs[3][1]), (106, text(15)), (101, "be")]
    for size in (containment.BYTES, 900):
        monkeypatch.setattr(containment, "BYTES", size)
        found = containment.containing(spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(items, "task_id long, item string"))
        assert sorted(map(tuple, found.collect())) == brute(docs, items)
    assert containment.containing(spark.createDataFrame([], "id long, text string"), spark.createDataFrame(items[:2], "task_id long, item string")).count() == 0


def test_no_run_of_a_passage_is_exchanged(spark, tmp_path):
    """Judgements come of one pass over the texts, and a passage without a text holds not even the empty item, as in SQL."""
    spark.createDataFrame([(1, "en", "one two"), (2, "en", None)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "two"), (8, ""), (9, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(map(tuple, qrels(spark, str(tmp_path)).collect())) == [(7, 1), (8, 1)]
