"""Co-training: held-out accuracy, the exchange of labels, the expression against the arrays, and odd inputs."""

import math
import re

import numpy as np
import pytest

from quarryline.llm import cotrain

GOOD = "The river ran past the old mill, and nobody had seen the miller for a year. "
JUNK = ("BUY!! NOW!! CHEAP!! ", "foo### bar%%% baz&&& ", "one | two | three | ")


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(6)
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        body = "".join(rng.choice(JUNK) if bad else GOOD for _ in range(rng.integers(3, 30)))
        docs.append((i, body, "en" if i % 3 else None, f"site{i % 9 if not bad else i % 3}", len(body), 1.0))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, 0 if bad else 1, 0))
    docs += [(None, None, None, None, None, None), (1000, "", "en", "site1", 0, 0.0), (1, docs[1][1], "en", "site1", 3, 0.0), (1001, GOOD * 3000, "en", "site8", 9, 0.0)]
    labels += [(0, None, 0), (None, 1, 0), (99999, 1, 0), (2, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score double").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def views_by_hand(text):
    """The measures of a text, word by word and character by character."""
    text = text or ""
    words = [w for w in re.split("[ \\t-\\r]+", text) if w]
    lines, n, w = text.split("\n"), max(1, len(text)), max(1, len(words))
    solid = sum(c not in " \t\n\x0b\x0c\r" for c in text)
    groups = ("#*$%&", "|<>", "!?", "0123456789", ".,;", "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÉÈÑÓÍÄÖÜ")
    shares = [sum(c in g for c in text) / n for g in groups]
    return [math.log1p(len(words)), math.log1p((len(text) - solid) / w), len(set(words)) / w, solid / w / 10, *shares, sum(x.endswith(".") for x in words) / w, len(lines) / w, len(set(lines)) / len(lines)]


def test_content_view_against_counting_by_hand(spark):
    texts = [None, "", " ", "a", "One. Two, THREE!! 4 #5 $ & | <x>\n\nÀÉ é.\n", "x\x0by\tz\n" * 50, GOOD * 20, "日本 語. ]^[-\\"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r._content for r in cotrain.with_views(df, cotrain.CoTraining(), ("doc_id",)).collect()}
    for i, t in enumerate(texts):
        assert rows[i] == pytest.approx(views_by_hand(t), abs=1e-12)


def test_held_out_accuracy(tables):
    docs, labels = tables
    rule = cotrain.CoTraining()
    table = cotrain.with_views(docs, rule, ("doc_id",))
    model = cotrain.train(table, labels, rule)
    assert model.held_out >= 0.95
    rows = cotrain.scored(docs, labels).collect()
    assert len(rows) == 404 and rows[0].asDict().keys() >= {"doc_id", "text", "lang", "source", "n_chars"}
    unlabelled = [r for r in rows if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 2 and r.doc_id % 5]
    assert np.mean([r.kept == (r.doc_id % 4 != 0) for r in unlabelled]) >= 0.97
    assert next(r for r in rows if r.doc_id == 1001).kept
    got = {r.doc_id: r for r in rows}
    x = {r.doc_id: r for r in table.collect()}
    for d in (0, 7, 1000, None):
        odds = np.array([cotrain.log_odds(model.views[v], np.array([x[d][f"_{v}"]]))[0] for v in model.views])
        assert got[d]["score"] == pytest.approx(1 / (1 + np.exp(-cotrain.log_odds(model.final, odds[None])[0])), abs=1e-9)


def test_rounds_against_arrays(tables):
    """The model from tables equals one whose rounds sort all documents in arrays."""
    docs, labels = tables
    rule = cotrain.CoTraining(per_round=20, rounds=3)
    table = cotrain.with_views(docs, rule, ("doc_id",))
    every = [(r.doc_id, np.array(r._content), np.array(r._metadata)) for r in table.collect() if r.doc_id is not None]
    votes: dict = {}
    for r in labels.collect():
        if r.doc_id is not None and r.quality is not None:
            votes.setdefault(r.doc_id, []).append(r.quality)
    known = {}
    for d, c, m in sorted(every, key=lambda r: (r[0], r[1].tolist(), r[2].tolist())):
        if d in votes and d not in known:
            known[d] = (float(np.mean(votes[d]) >= 0.5), c, m)
    ids = sorted(sorted(known), key=cotrain._shuffled)
    y = np.array([known[d][0] for d in ids])
    views = {"content": np.array([known[d][1] for d in ids]), "metadata": np.array([known[d][2] for d in ids])}
    free = [r for r in every if r[0] not in votes]
    pool = {"content": np.array([r[1] for r in free]), "metadata": np.array([r[2] for r in free])}
    hashes = dict(table.where("doc_id IS NOT NULL").selectExpr("doc_id", "xxhash64(doc_id)").collect())

    def surest(v, b, n_good, n_bad):
        odds = cotrain.log_odds(b, pool[v])
        least = np.log(rule.sure / (1 - rule.sure))
        by = lambda sign: sorted((i for i in range(len(free)) if sign * odds[i] >= least), key=lambda i: (-sign * odds[i], hashes[free[i][0]], free[i][0]))
        rows = by(1)[:n_good], by(-1)[:n_bad]
        return {u: np.concatenate([pool[u][list(r)].reshape(-1, pool[u].shape[1]) for r in rows]) for u in pool}, np.concatenate([np.ones(len(rows[0])), np.zeros(len(rows[1]))])

    want, got = cotrain.co_train(views, y, surest, rule), cotrain.train(table, labels, rule)
    for v in views:
        assert got.views[v] == pytest.approx(want.views[v], rel=1e-3, abs=1e-4)
    assert got.final == pytest.approx(want.final, rel=1e-3, abs=1e-4)


def test_views_teach_each_other():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 2000).astype(float)
    content = np.stack([y * 4 + rng.normal(size=2000), rng.normal(size=2000)], axis=1)
    meta = np.stack([y * 3 + rng.normal(size=2000), *rng.normal(size=(12, 2000))], axis=1)
    views, pool = {"content": content[:60], "metadata": meta[:60]}, {"content": content[60:1500], "metadata": meta[60:1500]}

    def surest(v, b, n_good, n_bad):
        odds = cotrain.log_odds(b, pool[v])
        rows = np.concatenate([np.argsort(-odds, kind="stable")[:n_good], np.argsort(odds, kind="stable")[:n_bad]])
        return {u: pool[u][rows] for u in pool}, (odds[rows] > 0).astype(float)

    right = {}
    for rounds in (0, 4):
        m = cotrain.co_train(views, y[:60], surest, cotrain.CoTraining(rounds=rounds))
        right[rounds] = np.mean((cotrain.log_odds(m.views["metadata"], meta[1500:]) > 0) == y[1500:])
    assert right[4] >= right[0] and right[4] > 0.85


def test_without_labels_all_stay(spark, tables):
    docs, labels = tables
    assert cotrain.scored(docs, labels.limit(0)).where("kept").count() == 404
    assert cotrain.scored(docs, labels.where("quality = 1")).where("kept AND score = 1").count() == 404
    assert cotrain.scored(docs.limit(0), labels).count() == 0
