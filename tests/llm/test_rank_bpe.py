"""Rank-array encoding and decoding against the tokenizers library."""

import hashlib
import json
import random

import numpy as np
import pytest

from quarryline.llm import rank_bpe, wordbpe

ODD = ["", " ", "don't stop's it's", "<|endoftext|> a<|startoftext|>b", "<|endoftext|", "Ünï×÷ ÀÉß ÿŸ", "foo-bar_baz42x 3.14", "日本語 テスト é x́", "a\xa0b c", "İstanbul ΣΑΣ", "\x00\x01 a\x7fb", "😀😀 hi", "a'sb 're", "tab\tnl\nvt\x0bff\x0ccr\rx\x1cy\x85z", "x" * 5000, "ab" * 400 + " é" * 3, "the" * 200, "aaaa" * 12]


def texts():
    rng = random.Random(1)
    some = [*"aAbÉéÜß'<|>_-.,5 7 \n\tÖ×÷ñtheing", "日", "́", " ", "😀"]
    return ODD + ["".join(rng.choices(some, k=rng.randrange(30))) for _ in range(2000)] + ["".join(rng.choices("theingaorstl", k=rng.randrange(90))) for _ in range(2000)]


def agrees(coder, given):
    for k in range(0, len(given), 500):
        some = given[k : k + 500]
        ids, sizes = coder.encode([t.encode() for t in some])
        want = [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in some]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
        assert coder.decode(ids.astype(np.int32), sizes).to_pylist() == [coder.tokenizer.decode(w, skip_special_tokens=False) for w in want]


def test_equals_the_library():
    coder = rank_bpe.RankCoder(wordbpe.default_file(), limit=3000)
    agrees(coder, texts())
    assert len(coder.spot) <= 3000


def test_files_with_other_rules(tmp_path):
    """Random merges in an order that training would not give, another cut, and a decoder."""
    rng, letters = random.Random(4), rank_bpe.byte_letters()
    tokens, merges = list(letters), []
    while len(merges) < 400:
        a, b = rng.choice(tokens[:3] + [letters[ord(c)] for c in "abcd"] + tokens[256:]), rng.choice([letters[ord(c)] for c in "abcd"] + tokens[256:])
        if len(a + b) < 9 and (a, b) not in merges:
            merges.append((a, b))
            if a + b not in tokens:
                tokens.append(a + b)
    spec = {
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "post_processor": None,
        "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "decoder": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True},
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": {t: i for i, t in enumerate(tokens)}, "merges": [list(m) for m in merges]},
    }
    path = tmp_path / "t.json"
    path.write_text(json.dumps(spec))
    agrees(rank_bpe.RankCoder(str(path)), ODD + ["".join(rng.choices("abcd ", k=rng.randrange(140))) for _ in range(1000)])


def test_short_and_long_pieces_agree():
    coder = rank_bpe.RankCoder(wordbpe.default_file())
    rng = random.Random(6)
    pieces = ["".join(rng.choices("theingaorst", k=rng.randint(1, rank_bpe.SHORT))).encode() for _ in range(3000)]
    ids, sizes, bounds = coder.ranked(pieces)
    heap = [coder._heap(p) for p in pieces]
    assert ids.tolist() == np.concatenate([h[0] for h in heap]).tolist() and bounds.tolist() == np.concatenate([h[1] for h in heap]).tolist()
    # a part's boundaries hold just the letters of its token
    at = 0
    for p, n in zip(pieces, sizes.tolist(), strict=True):
        cuts = [*bounds[at : at + n].tolist(), len(p)]
        assert [p[a:z].decode() for a, z in zip(cuts, cuts[1:], strict=False)] == [coder.tokens[i].as_py().removesuffix("</w>") for i in ids[at : at + n].tolist()]
        at += n


def test_tables(spark):
    rows = [(i, t, 1) for i, t in enumerate(texts()[:60])] + [(None, None, 1), (3, "a b", 2), (3, "a b", 2), (4, "wörter " * 40_000, 3)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, ids int").repartition(5)
    tokenizer = wordbpe.encoder(wordbpe.default_file()).tokenizer
    want = sorted(((i, tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows), key=str)
    encoded = rank_bpe.encode(docs)
    assert sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=str) == want
    decoded = rank_bpe.decode(encoded)
    assert sorted(((r.doc_id, r.text) for r in decoded.collect()), key=str) == sorted(((i, tokenizer.decode(x, skip_special_tokens=False)) for i, x in want), key=str)
    gone = spark.createDataFrame([(1, None), (2, []), (3, [320, 49407])], "doc_id long, ids array<int>")
    assert sorted((r.doc_id, r.text) for r in rank_bpe.decode(gone).collect()) == [(1, ""), (2, ""), (3, "a</w> <|endoftext|>")]
    assert rank_bpe.decode(rank_bpe.encode(docs.limit(0))).count() == 0


def test_query(spark, tmp_path):
    spark.createDataFrame([(1, "The cat's here"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tokenizer = wordbpe.encoder(wordbpe.default_file()).tokenizer
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    ids = tokenizer.encode("The cat's here", add_special_tokens=False).ids
    want = [(1, len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))), (2, 0, sha(""), sha(""))]
    assert sorted(map(tuple, rank_bpe.op12_rank_array(spark, str(tmp_path)).collect())) == want


def test_files_of_another_kind(tmp_path):
    path = tmp_path / "t.json"
    spec = json.load(open(wordbpe.default_file(), encoding="utf8"))
    spec["model"]["dropout"] = 0.1
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        rank_bpe.RankCoder(str(path))
