"""Merge-dropout encoding and window packing on small tables with nulls, empty and long texts, ties and repeated rows."""

import re
import zlib

import numpy as np
import pytest

from quarryline.llm import bm25_pack, dropout_bpe, wordbpe

TEXTS = [None, "", "The cat sat. " * 40, "The cat sat. " * 40, "it's <|endoftext|> 12 été", *[f"topic{i % 4} words about subject{i % 4} number {i} " * (5 + i) for i in range(40)], "long tail " * 900]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i if i != 9 else None, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string, n int").repartition(3)


def test_pieces_cover_every_document_once(spark, docs):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(wordbpe.default_file())
    rows = bm25_pack.pack(docs, bm25_pack.Windows(size=128, shard=2000)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {i if i != 9 else None for i in range(len(TEXTS))}
    for i, t in enumerate(TEXTS):
        want = [*tk.encode(t or "", add_special_tokens=False).ids, 2]
        got = sorted(by[i if i != 9 else None], key=lambda r: r.start)
        at = 0
        for r in got:
            ids = np.array(want[at : at + r.length], "<u4")
            assert r.start == at and r.doc_tokens == len(want) and r.ids_crc32 == zlib.crc32(ids.tobytes()) and bytes(r.ids) == ids.tobytes()
            at += r.length
        assert at == len(want)
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        assert at <= 128
    assert sum(sum(n for _, n in w) < 128 for w in windows.values()) <= 4  # one a task
    assert bm25_pack.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_scores_are_bm25():
    docs = [np.array(x) for x in ([1, 2, 2, 3], [2, 3, 4], [5], [1, 1, 1, 1, 4])]
    idf = np.array([0.0, 1.5, 0.7, 0.9, 1.1, 2.0])
    w = bm25_pack.Windows()
    got = bm25_pack.Index(docs, idf, 3.25, w).scores(0)
    for d, doc in enumerate(docs):
        want = 0.0
        for t in docs[0]:
            tf = int((doc == t).sum())
            want += idf[t] * tf * (w.k1 + 1) / (tf + w.k1 * (1 - w.b + w.b * len(doc) / 3.25)) if tf else 0
        assert got[d] == pytest.approx(want, rel=1e-5)


def test_dropout_matches_library_without_skips_and_decodes(spark, docs):
    import sentencepiece

    m = dropout_bpe.model(dropout_bpe.default_file())
    texts = [t or "" for t in TEXTS] + ["日本語 テキスト  \n\n\t x  ", "   lead", "a" * 300 + "b" * 50, "\x00 nul"]
    lib = sentencepiece.SentencePieceProcessor(model_file=dropout_bpe.default_file())
    assert [x.tolist() for x in m.encode(texts, [0] * len(texts), 0, 0.0)] == lib.encode(texts)
    a, b = (m.encode(texts, list(range(len(texts))), seed, 0.2) for seed in (1, 2))
    assert any(len(x) != len(y) for x, y in zip(a, b))
    assert [m.decode(x) for x in a] == texts
    rows = dropout_bpe.encode(docs).collect()
    assert all(r.lossless for r in rows) and len(rows) == len(TEXTS)
    assert {r.n_pieces for r in rows if r.doc_id in (0, 1)} == {0}
    again = {r.doc_id: r.ids_crc32 for r in dropout_bpe.encode(docs.repartition(1)).collect()}
    assert again == {r.doc_id: r.ids_crc32 for r in rows}
    assert dropout_bpe.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_side_by_side_agendas_equal_single_ones():
    m = dropout_bpe.model(dropout_bpe.default_file())
    rng = np.random.default_rng(4)
    parts = ["▁" + "".join(rng.choice(list("theandingéß€ x."), rng.integers(1, 30))).replace(" ", "") for _ in range(300)]
    base, bound = dropout_bpe._mix(np.arange(300, dtype=np.uint64)), np.uint64(2**62)
    ids, steps = m.agendas(parts, base, bound)
    single = [m._agenda(p, int(b), int(bound)) for p, b in zip(parts, base)]
    assert ids == [x for x, _ in single] and steps.tolist() == [s for _, s in single]


def test_remembered_segmentations_equal_fresh_ones():
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("theandingsor"), rng.integers(1, 14))) for _ in range(60)] + ["a" * 45, "x" * 70]
    texts = [" ".join(rng.choice(words, 400)) for _ in range(12)]
    m = dropout_bpe.MergeModel(dropout_bpe.default_file())
    bound = np.uint64(int(0.25 * 2.0**64))
    got = m.encode(texts, list(range(12)), 5, 0.25)
    for n, t in enumerate(texts):
        parts = re.findall("▁*[^▁]+|▁+", "▁" + t.replace(" ", "▁"))
        key = dropout_bpe._mix(np.array([n], np.uint64) + dropout_bpe._mix(np.array([5], np.uint64)))
        base = dropout_bpe._mix(key + np.arange(len(parts)).astype(np.uint64))
        want = b"".join(m._agenda(p, int(b), int(bound))[0] for p, b in zip(parts, base))
        assert got[n].tobytes() == want
    assert len(m.variant) > 100
