"""The pipeline's stages, each against what its operator should do to what it was given."""

import random

import numpy as np
import pytest

import corpus_pipeline
from quarryline.llm import cotrain, runtime, secrets, simhash, wordbpe
from quarryline.llm.runtime import stage_table


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    passage = prose(60)
    docs = []
    for i in range(200):
        text = prose(rng.randint(60, 160))
        if i % 4 == 0:
            text = " ".join(w + "###" for w in text.split())
        if i % 10 == 1:
            text = text + "\n" + passage + "\n" + prose(20)
        if i % 10 == 3:
            text += ' password = "hunter2hunter2hunter2"'
        docs.append((i, text, "en", f"s{i % 5}", len(text), "junk"))
    docs += [(200 + i, docs[7][1], "en", "s1", 5, "junk") for i in range(3)] + [(7, docs[7][1], "en", "s1", 5, "junk"), (None, None, None, None, None, None)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, `_row` string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 200) if i % 3], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    given, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        given = stage_table(stage(spark, given, folder), name)
        kept.append(given)
        if name != "packing":
            assert given.columns == list(corpus_pipeline.COLUMNS)
    accepted, single, clean, masked, pieces = kept
    ids = {r.doc_id for r in accepted.collect()} - {None}
    assert sum(i % 4 == 0 for i in ids if i < 200) <= 2 and sum(i % 4 != 0 for i in ids if i < 200) >= 148

    fps = {r.doc_id: simhash.fingerprint(r.text) for r in single.collect()}
    assert all(bin(a ^ b).count("1") > 2 for i, a in fps.items() for j, b in fps.items() if i != j)
    assert len(fps) == single.count() and 7 in fps and not fps.keys() & {200, 201, 202}
    assert {i for i in ids if i < 200} <= fps.keys() | {7}

    before = {r.doc_id: r.text for r in single.collect()}
    after = {r.doc_id: r.text for r in clean.collect()}
    raw = {i: (t or "").encode() for i, t in before.items()}
    seen = {}
    for t in raw.values():
        for i in range(len(t) - 199):
            seen[t[i : i + 200]] = seen.get(t[i : i + 200], 0) + 1
    for i, t in raw.items():
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        assert after[i] == bytes(np.frombuffer(t, np.uint8)[~gone]).decode()
    assert any(before[i] != after[i] for i in before)

    texts = {r.doc_id: r.text for r in masked.collect()}
    assert texts.keys() == after.keys() and "hunter2hunter2" not in " ".join(filter(None, texts.values()))
    assert all(texts[i] == after[i] for i in texts if i is not None and i < 200 and i % 10 != 3)
    assert all(r.n_chars == len(r.text or "") for r in masked.collect())
    assert secrets.scan(masked).where("size(base) > 0").count() == 0

    enc = wordbpe.encoder(wordbpe.default_file())
    want = {i: len(enc.encode([(t or "").encode()], 2)[0]) for i, t in texts.items()}
    got = {}
    for r in pieces.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_run(spark, folder):
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()} >= {7}


def test_stages_take_empty_tables_nulls_and_extra_columns(spark, tmp_path):
    rows = [(1, "a b c d e f " * 20, "en", "s", 5, 1), (1, "a b c d e f " * 20, "en", "s", 5, 2), (None, None, None, None, None, 3), (3, "", "en", "s", 0, 4), (4, "x" * 300_000, None, "s", 1, 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row long"
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for n, some in (("all", rows), ("none", [])):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{n}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{n}.parquet")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name == "packing":
                assert (out.count() == 0) == (n == "none")
            else:
                assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
                assert out.count() == (0 if n == "none" else 3 if name == "near_duplicates" else 5)


def test_results_outlive_later_calls(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        first = stage(spark, docs, folder)
        second = stage(spark, docs.where("doc_id > 5"), folder)
        assert second.count() >= 0 and first.count() > 0
    one, two = corpus_pipeline.run(spark, folder), corpus_pipeline.run(spark, folder)
    assert one.count() == two.count() > 0


def test_stages_leave_no_copy_of_the_texts(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = set(runtime._TABLES)
        out = stage(spark, docs, folder)
        left = [p for p in runtime._TABLES if p not in before]
        holding = [p for p in left if "text" in spark.read.parquet(p).columns]
        assert len(holding) == (name == "repeated_passages"), left
        assert out.count() > 0


def test_rows_go_by_what_they_hold(spark):
    row = lambda i, t, lang: (i, t, lang, "s", len(t))
    rows = [row(1, "a b c", "en"), row(1, "a b c", "en"), row(1, "a b c", "fr"), row(2, 'x password = "hunter2hunter2" y', "en"), row(3, 'x password = "hunter2hunter2" y', "fr")]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 2]
    masked = corpus_pipeline.secret_scan(spark, docs, "").collect()
    assert len(masked) == 10 and sum(r.text == 'x [SECRET]" y' for r in masked) == 4


def test_views_worked_out_again_give_the_same_scores(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet").select(*c) for t, c in (("documents", corpus_pipeline.COLUMNS), ("labels", ("doc_id", "quality"))))
    once, again = (sorted(map(str, cotrain.scored(docs, labels, again=a).collect())) for a in (False, True))
    assert once == again
