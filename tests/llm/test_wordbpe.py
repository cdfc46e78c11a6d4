"""Encoding by parts of words against the tokenizers library, and the token store's grammar against replacing one pair at a time."""

import random

import numpy as np
import pytest

from quarryline.llm import token_store, wordbpe

ODD = ["", " ", "don't stop's it's", "<|endoftext|> a<|startoftext|>b", "Ünï×÷ ÀÉß ÿŸ", "foo-bar_baz42x 3.14", "日本語 テスト é x\u0301", "a\xa0b\u2003c", "İstanbul ΣΑΣ", "\x00\x01 a\x7fb", "😀😀 hi", "a'sb 're", "tab\tnl\nvt\x0bff\x0ccr\rx\x1cy\x85z"]


def test_parts_equal_the_library():
    enc = wordbpe.WordEncoder(wordbpe.default_file(), limit=3000)
    random.seed(1)
    alphabet = [*"aAbÉéÜß'<|>_-.,5 7 \n\tÖ×÷ñ", "日", "\u0301", "\u2003", "😀"]
    texts = ODD + ["".join(random.choices(alphabet, k=random.randrange(30))) for _ in range(4000)]
    for k in range(0, len(texts), 500):
        some = texts[k : k + 500]
        ids, sizes = enc.encode([t.encode() for t in some], 7)
        want = [[*enc.tokenizer.encode(t, add_special_tokens=False).ids, 7] for t in some]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
    assert len(enc.spot) <= 3000
    assert [x.tolist() for x in enc.encode([])] == [[], []]


def one_pair_at_a_time(docs: list[list[int]], base: int, least: int) -> int:
    """Symbols left after replacing the most frequent pair, again and again."""
    while True:
        counts: dict = {}
        for d in docs:
            before = None
            for i in range(len(d) - 1):
                if before == (d[i], d[i + 1], i - 1):
                    before = None  # overlaps the one before
                    continue
                counts[d[i], d[i + 1]] = counts.get((d[i], d[i + 1]), 0) + 1
                before = (d[i], d[i + 1], i) if d[i] == d[i + 1] else None
        pair = max(counts, key=counts.get, default=None)
        if pair is None or counts[pair] < least:
            return sum(map(len, docs))
        out = []
        for d in docs:
            new, i = [], 0
            while i < len(d):
                if i + 1 < len(d) and (d[i], d[i + 1]) == pair:
                    new.append(base)
                    i += 2
                else:
                    new.append(d[i])
                    i += 1
            out.append(new)
        docs, base = out, base + 1


@pytest.mark.parametrize("base", [300, 80_000])
def test_grammar(base):
    rng = np.random.default_rng(3)
    phrases = [rng.integers(base - 300, base, rng.integers(2, 9)).tolist() for _ in range(40)]
    docs = [sum((phrases[i] for i in rng.zipf(1.4, 60) % 40), []) for _ in range(50)] + [[base - 1] * 999, [base - 7, base - 8] * 99, [1]]
    ids, sizes = np.array(sum(docs, []), np.uint32), np.array([len(d) for d in docs])
    grammar = token_store.Grammar(symbols=base + 5000)
    ends = np.zeros(len(ids), bool)
    ends[np.cumsum(sizes) - 1] = True
    symbols, last, rules = token_store.compress(ids, ends, base, grammar)
    pairs = np.stack([symbols[:-1], symbols[1:]], axis=1)[~last[:-1]]
    counts: dict = {}
    for i, (a, b) in enumerate(pairs.tolist()):
        counts.setdefault((a, b), []).append(i)
    assert all(len(x) < 2 * grammar.least if a == b else len(x) < grammar.least for (a, b), x in counts.items())
    assert len(symbols) <= 1.15 * one_pair_at_a_time(docs, base, grammar.least)
    shard = token_store.Shard(token_store.pack(list(range(len(docs))), ids, sizes, base, grammar))
    assert shard.all().tolist() == ids.tolist()
    assert [shard.document(i).tolist() for i in range(len(docs))] == docs
    for a, b in ((0, 5), (17, 1200), (len(ids) - 3, len(ids)), (40, 40)):
        assert shard.ids(a, b).tolist() == ids[a:b].tolist()
