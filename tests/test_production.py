"""The production controller as windows over a table and with state over a stream, and matching of many intents."""

import random
from itertools import permutations

import pytest

from quarryline.operators import intents
from quarryline.streaming import production, runs

SCHEMA = "session_id string, utterance long, idx long, text string, is_final boolean, confidence double, embedding array<double>"


def said(seed, sessions=6):
    rng, rows = random.Random(seed), []
    for s in range(sessions):
        for u in range(5):
            vector = [rng.gauss(0, 1) for _ in range(8)]
            n = rng.randint(1, 12)
            for i in range(n):
                vector = [rng.gauss(0, 1) for _ in range(8)] if rng.random() < 0.15 else [x + rng.gauss(0, rng.choice([0.05, 0.6])) for x in vector]
                text = rng.choice(["a hypothesis of some length here", "a hypothesis of some length here", "a hypothesis of some length here", "short", "", "thanks for all of that, really"])
                rows.append((f"s{s}", u, i, text, i == n - 1 and rng.random() < 0.8, rng.choice([None, 0.9, 0.7, 0.3]), [0.0] * 8 if rng.random() < 0.05 else vector))
    return rows


@pytest.mark.parametrize("batches", [1, 4])
def test_table_and_stream_decide_alike(spark, tmp_path, batches):
    rows = sorted(said(4), key=lambda r: (r[1], r[2]))
    size = -(-len(rows) // batches)
    for n in range(0, len(rows), size):
        spark.createDataFrame(rows[n : n + size], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1 if batches > 1 else 1000).parquet(f"{tmp_path}/in")
    with runs.rocks(spark):
        run = production.streamed(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).start()
    assert run.awaitTermination(300)
    got = sorted(map(tuple, spark.read.schema(production.DECISIONS).parquet(f"{tmp_path}/out").collect()))
    want = sorted(map(tuple, production.decisions(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert len(got) == len(rows) and [g[:5] for g in got] == [w[:5] for w in want]
    assert all(g[5:] == w[5:] or max(abs(a - b) for a, b in zip(g[5:], w[5:], strict=True)) < 1e-8 for g, w in zip(got, want, strict=True))
    reasons = {w[4] for w in want}
    assert reasons == {"final", "empty", "problem", "presentation", "stable", "intent drift", "building window", "not stable"}
    assert len({w[5] for w in want if w[5] is not None}) > 3


def test_state_stays_small():
    rule = production.Thresholds()
    p = production.Production(rule)
    assert p._thresholds(3, 0.2, 0.1, [0] * 64) == (0.85, 0.65)
    bins = [0] * 64
    bins[40] = 10
    assert p._thresholds(10, 0.25, 0.0, bins) == (0.25, 0.25)


def brute(e, p):
    fits = [[intents_f1(a, b) >= 0.5 for b in p] for a in e]
    if len(e) > len(p):
        fits = [list(c) for c in zip(*fits, strict=True)]
    best = 0
    for order in permutations(range(max(len(e), len(p))), min(len(e), len(p))):
        best = max(best, sum(fits[i][j] for i, j in enumerate(order)))
    return best


def intents_f1(a, b):
    a, b = a.split(), b.split()
    shared = sum(min(a.count(w), b.count(w)) for w in set(a))
    return 2 * shared / (len(a) + len(b)) if a or b else 0


def test_matching_of_many(spark):
    rng = random.Random(4)
    words = ["zebra", "quark", "fjord", "glyph", "waltz", "nymph"]
    part = lambda: " ".join(rng.choices(words, k=rng.randint(1, 3)))
    cases = [(i, [part() for _ in range(rng.randint(0, 7))], [part() for _ in range(rng.randint(0, 7))]) for i in range(60)]
    got = {r.k: r.n_matched for r in intents.with_matching(spark.createDataFrame(cases, "k int, e array<string>, p array<string>"), "e", "p").collect()}
    assert got == {k: brute(e, p) for k, e, p in cases}


def test_twelve_by_twelve(spark):
    """Each fits itself and the next but the last, whose only place all others must make room for."""
    names = [f"topic{c} subject{c}" for c in "abcdefghijkl"]
    expected = [f"{names[i]}" for i in range(12)]
    predicted = [names[0]] + [f"{names[i - 1]} {names[i]}" for i in range(1, 12)]
    report = intents.with_matching(spark.createDataFrame([(1, expected, predicted), (2, expected, predicted[1:]), (3, expected, [])], "k int, e array<string>, p array<string>"), "e", "p")
    assert {r.k: r.n_matched for r in report.collect()} == {1: 12, 2: 11, 3: 0}
    totals = intents.matching_report(report).first()
    assert (totals.cases, totals.compound, totals.single, totals.compound_success_rate, totals.compound_recall, totals.compound_precision) == (3, 3, 0, 0.3333, 0.6389, 1.0)
