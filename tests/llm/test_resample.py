"""Importance resampling against a plain computation."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quarryline.llm import resample

ODD = [None, "", " ", "x", "Ab c", "é日 a\x7fb 9z_Q", "tail ", "Straße ÀÉ", "w" * 500 + " " + "v" * 70, "\x00a", "z" * 64 + " " + "z" * 65]


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def buckets(text, n=10_000):
    ws = words(text)
    return [zlib.crc32(f.encode()) % n for f in ws + [f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)]]


def expected(docs, target, percent=25):
    s, t = np.zeros(10_000), np.zeros(10_000)
    for into, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            np.add.at(into, buckets(x), 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10_000) / ((a + 1) * (t.sum() + 10_000)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, x in docs:
        f = buckets(x)
        weight = sum(gain[k] for k in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))))
    enough = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], math.inf if r[0] is None else r[0], r[1]))
    place = {}
    for k, r in enumerate(enough[: percent * len(enough) // 100], 1):
        place.setdefault(r, []).append(k)
    return sorted(((*r[:4], place[r].pop(0) if place.get(r) else None) for r in sorted(rows, key=str)), key=str)


def test_features_of_sliced_columns():
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choices("abcXYZ019 _\n-éß日😀", k=rng.randrange(80))) for _ in range(500)]
    for column in (pa.array(texts), pa.array(["before", *texts, "after"]).slice(1, len(texts)), pa.array(texts, pa.large_string())):
        one, two, counts = resample.features(column, 10_000)
        assert counts.tolist() == [len(words(t)) for t in texts]
        a = b = 0
        for t, n in zip(texts, counts.tolist(), strict=True):
            assert one[a : a + n].tolist() + two[b : b + max(n - 1, 0)].tolist() == buckets(t)
            a, b = a + n, b + max(n - 1, 0)


def test_bytes_past_the_side_by_side_steps():
    data = np.frombuffer(random.Random(3).randbytes(4000), np.uint8)
    at, sizes = np.array([0, 5, 700, 3000]), np.array([3000, 0, 64, 65])
    got = resample.advance(np.full(4, resample.ONES), data, at, sizes) ^ resample.ONES
    assert got.tolist() == [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(at, sizes, strict=True)]


@pytest.mark.parametrize("partitions", [1, 7])
def test_against_plain_computation(spark, partitions):
    rng = random.Random(5)
    lexicon = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(300)]
    text = lambda: " ".join(rng.choices(lexicon, k=rng.choice([3, 19, 20, 60, 200])))
    docs = [(i, text()) for i in range(300)] + [(300 + i, t) for i, t in enumerate(ODD)] + [(7, "a b " * 12)] * 3 + [(None, "c d " * 30), (-1, "c d " * 30)]
    target = [text() for _ in range(10)] + [None]
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id int, text string, rank int, _row string").repartition(partitions)
    out = resample.resample(table, spark.createDataFrame([(t,) for t in target], "text string")).drop("n_words")
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, out.collect()), key=str) == expected(docs, target)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert resample.resample(none, some).count() == 0
    row = resample.resample(some, none, resample.Resampling(percent=100)).first()
    assert (row.n_features, row.rank) == (79, 1)
