"""Spelling variants against all pairs, and the wavelet tree against plain scans."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quarryline.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_wavelet_tree():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 64, 300):
        values = rng.permutation(n)
        tree = spelling.WaveletTree(values)
        box = rng.integers(0, n + 1, (200, 4))
        begin, end, low, high = box[:, 0], np.maximum(box[:, 0], box[:, 1]), box[:, 2], box[:, 3]
        who, value = tree.report(begin, end, low, high)
        want = sorted((q, v) for q in range(200) for v in values[begin[q] : end[q]].tolist() if low[q] <= v < high[q])
        assert sorted(zip(who.tolist(), value.tolist(), strict=True)) == want


@pytest.mark.parametrize("crowded", [4096, 3])
def test_links_equal_all_pairs(spark, crowded):
    rng = random.Random(crowded)
    words = {"".join(rng.choices("abé", k=rng.randint(1, 8))) for _ in range(500)} | {"a" * n for n in range(1, 60)} | {"z" * 99 + c + "z" * 99 for c in "abcd"}
    table = spark.createDataFrame([(w, i + 1) for i, w in enumerate(sorted(words))], "word string, n long")
    got = spelling.links(table, spelling.Spelling(crowded=crowded)).collect()
    n = {w: i + 1 for i, w in enumerate(sorted(words))}
    assert len(got) == len({(r.word, r.near) for r in got}) and all(n[r.near] == r.near_n for r in got)
    assert {(r.word, r.near) for r in got} == {(a, b) for a in words for b in words if a != b and one_edit(a, b)}


def expected(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in counts if v != w and one_edit(v, w)] for w in counts}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return sorted(out, key=str)


def test_variants(spark):
    rng = random.Random(9)
    base = ["".join(rng.choices("abcdeéÀ×", k=rng.randint(5, 9))) for _ in range(25)]
    forms = [b for b in base] + [b[:i] + rng.choice("abé") + b[i:] for b in base for i in (0, len(b) // 2, len(b))] + [b[:2] + b[3:] for b in base] + [b[:4] + "x" + b[5:] for b in base]
    weight = [rng.choice([1, 1, 6, 40, 250]) for _ in forms]
    docs = [(i, " ".join(rng.choices(forms, weight, k=200)).replace("a", rng.choice("aA"))) for i in range(120)]
    docs += [(None, "Abcdef " * 30), (5, None), (6, ""), (7, "tiny Öffnung"), (8, "zz" * 3000)] + [(9, docs[0][1])] * 4 + [(20 + i, "zz" * 3000) for i in range(5)]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n int").repartition(3)
    got = spelling.variants(table).select("word", "form", "root", "n", "n_near", "form_n")
    want = expected(docs)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert any(r[1] and r[2] != r[1] for r in want) and any(r[4] > 1 for r in want)


def test_empty(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "short")], "doc_id long, text string")).count() == 0
