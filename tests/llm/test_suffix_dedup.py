"""Repeated bytes against brute force, and the suffix order against plain sorting."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryline.llm import suffix_dedup as sd


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_suffix_order(symbols):
    text = [*symbols, 0]
    assert sd.suffix_order(text) == sorted(range(len(text)), key=lambda i: text[i:])


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for r in raw:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for r in raw:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(c for c, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéßx") for _ in range(rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(30))
    texts = [" ".join(word() for _ in range(rng.randint(5, 120))) for _ in range(30)]
    copy = texts[3]
    texts += [copy] * 3 + [copy[:40] + "Q" + copy[40:80] + "ZZ" + copy[80:] for _ in range(2)]
    for _ in range(25):
        own = " ".join(word() for _ in range(12))
        a, b = rng.randint(0, 30), rng.randint(60, len(passage))
        texts.append(own + passage[a:b] + own[::-1])
    texts += [None, "", "aaaaaaaa" * 30, "aaaaaaaa" * 11 + "b", "ab" * 90, "short", passage + "\n" + passage]
    return texts


@pytest.mark.parametrize("group", [2, 256])
@pytest.mark.parametrize("seed", [1, 2])
def test_removed_bytes(spark, seed, group, monkeypatch):
    monkeypatch.setattr(sd, "TILE", 400)
    texts = corpus(seed)
    rows = spark.createDataFrame([(i if i % 7 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, row string").repartition(3)
    from quarryline.llm.runtime import stage_table

    rows = stage_table(rows, "t")
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.dedup(rows, sd.Repeats(length=24, gram=15, group=group)).collect())
    assert got == sorted(brute(texts, 24))


def test_contract_length_and_empty_table(spark):
    from quarryline.llm.runtime import stage_table

    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    shared, copy = text(230), text(900)
    texts = [text(500) + shared + text(300) for _ in range(4)] + [copy, copy[:450] + "X" + copy[450:], copy[:199], text(150) + shared[:200]]
    rows = stage_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "t")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.dedup(rows).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 200)
    assert sd.dedup(stage_table(spark.createDataFrame([], "doc_id long, text string"), "t")).count() == 0
