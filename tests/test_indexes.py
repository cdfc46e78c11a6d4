"""The stored indexes against scoring everything."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarryline.operators import index, inverted, vectors
from quarryline.plans.queries import QUERIES
from quarryline.sources import indexes


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(400)], k=n))
    rows = [(i, rng.choice(["en", "de", None]), text(rng.choice([3, 30, 120]))) for i in range(900)]
    rows += [(1000 + i, "en", rows[5][2]) for i in range(300)] + [(2000, "en", None), (2001, "en", ""), (2002, "en", "W0 w0, w0.w1_")]
    rows += [(7, rows[7][1], " ".join(["w1"] * n)) for n in (11, 12, 13)]  # one id, four passages
    asked = [(1, rows[5][2]), (2, "w1 w1 w390"), (3, "unknown words only"), (4, None), (5, text(60)), (6, "w399"), (7, "")]
    return spark.createDataFrame(rows, "id long, domain string, text string").repartition(5), spark.createDataFrame(asked, "task_id long, query string")


def rows_of(df, *names):
    return sorted(map(tuple, df.select(*names).collect()))


@pytest.mark.parametrize("k, block, domain", [(1, 8, None), (5, 64, None), (40, 16, None), (5, 8, "en"), (3, 64, "xx")])
def test_search_equals_scoring_everything(spark, corpus, tmp_path, k, block, domain):
    docs, asked = corpus
    found = inverted.build(docs, str(tmp_path / "i"), inverted.Bm25(block=block))
    docs = docs.fillna("", "text")
    names = ("task_id", "id", "score", "rank")
    assert rows_of(found.search(asked, k, domain), *names) == rows_of(index.bm25(docs, asked, k, domain=domain), *names)
    assert rows_of(found.scores(asked, domain), *names[:3]) == rows_of(index.bm25(docs, asked, 1 << 30, domain=domain), *names[:3])


@pytest.mark.parametrize("k, domain", [(1, None), (5, None), (40, None), (5, "en"), (3, "xx")])
def test_going_over_all_passages_equals_scoring_everything(spark, corpus, tmp_path, k, domain):
    docs, asked = corpus
    found = inverted.build(docs, str(tmp_path / "i"), blocks=False)
    docs = docs.fillna("", "text")
    names = ("task_id", "id", "score", "rank")
    assert rows_of(found.search(asked, k, domain), *names) == rows_of(index.bm25(docs, asked, k, domain=domain), *names)
    assert rows_of(found.scores(asked, domain), *names[:3]) == rows_of(index.bm25(docs, asked, 1 << 30, domain=domain), *names[:3])
    whole = inverted.build(docs, str(tmp_path / "w"))
    assert rows_of(found.terms(), "term", "df", "max_tf", "total") != [] and rows_of(found.passages().drop("terms"), "id", "dl", "n_terms") == rows_of(whole.passages(), "id", "dl", "n_terms")
    shared = index.ranked(found.overlaps(asked, k), ["task_id"], F.col("score"), k)
    assert rows_of(shared, *names) == rows_of(index.ranked(whole.overlaps(asked), ["task_id"], F.col("score"), k), *names)


def test_slices_and_parts_of_queries_change_nothing(spark, corpus, tmp_path, monkeypatch):
    docs, asked = corpus[0].where("id <> 7"), corpus[1]
    found = inverted.build(docs, str(tmp_path / "i"), blocks=False)
    names = ("task_id", "id", "score", "rank")
    wanted = rows_of(found.search(asked, 4), *names)
    monkeypatch.setattr(inverted, "TERMS", 30)
    assert rows_of(found.search(asked, 4), *names) == wanted
    some = inverted.Asked.of(found.weights(asked).select("task_id", "term", "weight").toArrow())
    mean = found.corpus().first().mean
    batches = found.passages().select("id", "domain", "dl", "terms").toArrow().to_batches()
    for pairs in (1, 700, 10**6):
        monkeypatch.setattr(inverted, "PAIRS", pairs)
        hits = sorted((t, i, s) for b in some.best(iter(batches), lambda tf, dl: found.config.weight(tf, dl, mean), 4) for t, i, _, s in zip(*(c.to_pylist() for c in b.columns), strict=True))
        assert hits == [w[:3] for w in wanted]


def test_benchmark_items_are_searched_without_postings(spark, tmp_path):
    """Building postings and peaks for questions of frequent words costs more than going over the passages."""
    spark.createDataFrame([(1, "en", "one two"), (2, "en", None)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "Two")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = indexes.passage_index(spark, str(tmp_path))
    assert [r.id for r in QUERIES["bm25_topk"](spark, str(tmp_path)).collect()] == [1]
    assert not any(spark.catalog.tableExists(found._name(part)) for part in ("postings", "peaks"))


def test_blocks_that_cannot_matter_stay_closed(spark, corpus, tmp_path):
    docs, asked = corpus
    found = inverted.build(docs, str(tmp_path / "i"), inverted.Bm25(block=8))
    asked = asked.where("task_id IN (1, 5, 6)")
    weights = found.weights(asked)
    opened, all_ = found.reaching(weights, 3).count(), found.bounds(weights).count()
    assert opened < 0.6 * all_
    bounds = {(r.task_id, r.domain, r.block): r.bound for r in found.bounds(weights).collect()}
    place = {r.id: (r.domain, r.block) for r in found.passages().collect()}
    assert all(bounds[r.task_id, *place[r.id]] >= r.score - 1e-6 for r in found.scores(asked).collect() if place[r.id][0] is not None)


def test_statistics(spark, corpus, tmp_path):
    docs = corpus[0].where("id <> 7")
    found = inverted.build(docs, str(tmp_path / "i"))
    docs = docs.fillna("", "text")
    posts = index.postings(docs)
    assert rows_of(found.terms(), "term", "df", "max_tf", "total") == rows_of(posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("tf").alias("max_tf"), F.sum("tf").alias("total")), "term", "df", "max_tf", "total")
    assert rows_of(found.passages(), "id", "dl") == rows_of(index.lengths(docs), "id", "dl")


@pytest.mark.parametrize("name", ["doc_length_stats", "term_doc_freq", "tokenize_stats"])
def test_counts_need_no_index(spark, tmp_path, monkeypatch, name):
    """What one pass over the texts can count builds no postings."""
    monkeypatch.setattr(inverted, "build", lambda *a, **k: pytest.fail("an index was built"))
    rows = [(1, "en", "One one two_3, ÄB é"), (2, "en", None), (3, "de", "two"), (4, None, "")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    wanted = {
        "doc_length_stats": {("en", 2, 4, 2.0), ("de", 1, 1, 1.0), (None, 1, 0, 0.0)},
        "term_doc_freq": {("one", 1), ("two_3", 1), ("b", 1), ("two", 1)},
        "tokenize_stats": {(1, 4, 3), (2, 0, 0), (3, 1, 1), (4, 0, 0)},
    }
    assert {tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()} == wanted[name]


def test_peaks_are_added_up_once(spark, tmp_path, monkeypatch):
    """Where every id has one passage, postings aren't grouped by id before their peaks are taken."""
    grouped = []
    monkeypatch.setattr(inverted.InvertedIndex, "_store", lambda self, rows, part, buckets, store=inverted.InvertedIndex._store: grouped.append((part, rows._jdf.queryExecution().optimizedPlan().toString().count("Aggregate ["))) or store(self, rows, part, buckets))
    for n, ids in enumerate(([1, 2, 3], [1, 2, 2])):
        docs = spark.createDataFrame([(i, "en", t) for i, t in zip(ids, ("a b b", "a c", "c c a"), strict=True)], "id long, domain string, text string")
        found = inverted.build(docs, str(tmp_path / f"i{n}"), inverted.Bm25(block=64))
        assert {(r.term, r.df, r.max_tf, r.total) for r in found.terms().collect()} == {("a", 3, 1, 3), ("b", 1, 2, 2), ("c", 2, 2, 3)}
    assert [n for part, n in grouped if part == "peaks"] == [1, 2]


def test_titles_and_links_count(spark, tmp_path):
    docs = spark.createDataFrame([("a", "h", "Zebra crossing", "plain text", ["https://zebra.example/zebra"]), ("b", "h", None, "plain text", None)], "id string, domain string, title string, text string, links array<string>")
    found = inverted.build(docs, str(tmp_path / "i"))
    assert {r.id: r.dl for r in found.passages().collect()} == {"a": 8, "b": 2}
    hits = found.search(spark.createDataFrame([(1, "zebra plain")], "task_id long, query string")).collect()
    assert [h.id for h in sorted(hits, key=lambda h: h["rank"])] == ["a", "b"]


def test_empty_index(spark, tmp_path):
    found = inverted.build(spark.createDataFrame([], "id long, domain string, text string"), str(tmp_path / "i"))
    assert found.search(spark.createDataFrame([(1, "a")], "task_id long, query string")).count() == 0 and found.corpus().first().asDict() == {"n": 0, "mean": 1.0}


def test_index_follows_its_table(spark, tmp_path):
    def put(n):
        spark.range(n).selectExpr("id AS doc_id", "'en' AS lang", "concat('word', id) AS text").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")

    put(3)
    first = indexes.passage_index(spark, str(tmp_path))
    assert indexes.passage_index(spark, str(tmp_path)) is first
    put(4)
    assert indexes.passage_index(spark, str(tmp_path)).corpus().first().n == 4 and first.corpus().first().n == 3


def brute(rows, asked, k, prefilter=False):
    def cosine(a, b):
        x, y = (np.array([math.nan if v is None else v for v in u], float) if u is not None else np.array([math.nan]) for u in (a, b))
        if not (np.isfinite(x).all() and np.isfinite(y).all()) or not x.any() or not y.any():
            return 0.0
        return float(np.clip(x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)), -1, 1))

    out = []
    for q, v, d in asked:
        scores = sorted(((-round(cosine(v, u), 6), i) for i, u, e in rows if i != q and (not prefilter or e == d)))
        out += [(q, i, -s, n + 1) for n, (s, i) in enumerate(scores[:k])]
    return sorted((q, i, s + 0.0, n) for q, i, s, n in out)


def cloud(n, clusters, seed, spread=0.5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, 16))
    return [(i, (centres[rng.integers(clusters)] + rng.normal(size=16) * spread).tolist(), int(i % 3)) for i in range(n)]


def test_exact_search_equals_brute_force(spark, tmp_path):
    rows = cloud(700, 12, 1)
    rows += [(1000 + i, rows[3][1], 0) for i in range(350)]  # a third are copies
    rows += [(2000, None, 0), (2001, [0.0] * 16, 1), (2002, [math.nan] + [1.0] * 15, 0), (2003, [math.inf] * 16, 2), (2004, [None] + [1.0] * 15, 0), (2005, [-x for x in rows[3][1]], 0)]
    table = spark.createDataFrame(rows, "id long, embedding array<double>, domain int").repartition(4)
    found = vectors.build(table, str(tmp_path / "v"), vectors.Cells(rows=40, pack=32))
    assert found.packs().selectExpr("max(size(id))").first()[0] < 80 and found.packs().selectExpr("sum(size(id))").first()[0] == len(rows)
    some = [r for r in rows if r[0] % 50 == 0 or r[0] >= 2000]
    asked = spark.createDataFrame(some, "query_id long, embedding array<double>, domain int")
    for k, prefilter in ((5, False), (5, True), (900, False)):
        assert rows_of(found.search(asked, k, prefilter=prefilter), "query_id", "id", "score", "rank") == brute(rows, some, k, prefilter)


@pytest.mark.parametrize("n, recall", [(2000, 0.95), (8000, 0.95)])
def test_recall_of_near_cells(spark, tmp_path, n, recall):
    rows = cloud(n, 40, n)
    found = vectors.build(spark.createDataFrame(rows, "id long, embedding array<double>, domain int"), str(tmp_path / "v"), vectors.Cells(rows=100))
    asked = spark.createDataFrame([r for r in rows if r[0] % 40 == 0], "query_id long, embedding array<double>, domain int")
    hits = lambda df: {(r.query_id, r.id) for r in df.select("query_id", "id").collect()}
    exact = hits(found.search(asked, 5))
    near = hits(found.search(asked, 5, probes=5))
    assert len(found.centroids) >= 20 and len(near & exact) >= recall * len(exact)


def test_batches_stay_small(monkeypatch):
    """One large batch comes out in small ones, whose rows don't go with the number of cells."""
    rng = np.random.default_rng(5)
    found, _ = vectors.units(list(rng.normal(size=(300, 8))))
    x = rng.normal(size=(5000, 8))
    x[7] = 0
    held = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array([0] * 5000), pa.array(x.tolist()), pa.array([0.5, None] * 2500)], ["id", "domain", "embedding", "least"])
    sizes = []
    dot = vectors.units
    monkeypatch.setattr(vectors, "units", lambda v: sizes.append(len(v)) or dot(v))
    parts = list(vectors.placed(iter([held]), found))
    assert max(sizes) * len(found) <= vectors.NUMBERS and sum(sizes) == 5000 and [i for p in parts for i in p.column(0).to_pylist()] == list(range(5000))
    near = dot(list(x))[0] @ found.T
    assert [c for p in parts for c in p.column(2).to_pylist()] == [vectors.NOWHERE if i == 7 else c for i, c in enumerate(near.argmax(axis=1))]
    widths = np.full(301, 0.1)
    opened = list(vectors.opened(iter([held]), found, widths, None))
    assert max(p.num_rows for p in opened) <= vectors.OPENED
    allowed = np.cos(np.maximum(np.arccos(np.clip(near, -1, 1)) - 0.1, 0)) >= 0.5 - 1e-6
    wanted = sum((allowed[i].sum() if i % 2 == 0 else 301) if i != 7 else 301 for i in range(5000))
    assert sum(p.num_rows for p in opened) == wanted
    probed = list(vectors.opened(iter([held]), found, widths, 10))
    assert max(p.num_rows for p in probed) <= vectors.OPENED and sum(p.num_rows for p in probed) == 50_000


def test_no_vectors(spark, tmp_path):
    none = spark.createDataFrame([], "id long, embedding array<double>")
    found = vectors.build(none, str(tmp_path / "v"))
    assert found.search(spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, embedding array<double>")).count() == 0
