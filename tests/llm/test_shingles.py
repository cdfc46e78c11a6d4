"""The pipeline's near-duplicate stage against brute force over all pairs."""

import numpy as np

import corpus_pipeline
from quarryline.llm import runtime, shingles


def grams(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def texts(rng):
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9)))
    out = []
    for _ in range(60):
        words = [word() for _ in range(rng.integers(100, 300))]
        out.append(" ".join(words))
        for share in (0.002, 0.005, 0.01, 0.02, 0.05):
            out.append(" ".join(word() if rng.random() < share else w for w in words))
    long = [word() for _ in range(400)]  # a crowd around one text
    out += [" ".join(word() if i in rng.choice(400, 4) else w for i, w in enumerate(long)) for _ in range(80)]
    return [*out, None, "", "one two", "One  two", "one two three"]


def roots(sets):
    r = list(range(len(sets)))

    def top(i):
        while r[i] != i:
            i = r[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8:
                a, b = sorted((top(i), top(j)))
                r[b] = a
    return [top(i) for i in range(len(sets))]


def test_near_duplicates_are_the_groups_of_all_similar_pairs(spark, tmp_path):
    every = texts(np.random.default_rng(6))
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(every)] + [(0, every[0], "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/d.parquet")
    docs = spark.read.parquet(f"{tmp_path}/d.parquet")
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == sorted(set(roots([grams(t) for t in every])))
    assert corpus_pipeline.near_duplicates(spark, docs.where("doc_id < 0"), "").count() == 0


def test_sets_that_the_smallest_does_not_link_are_compared(spark):
    words = [f"w{i}" for i in range(300)]
    chain = [" ".join(words[: 300 - 24 * i]) for i in range(6)]  # each similar to the next only
    docs = spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string")
    assert [r.doc_id for r in shingles.one_of_each(docs).collect()] == [0]


def test_a_crowd_of_short_texts_that_are_alike_in_parts(spark, monkeypatch):
    monkeypatch.setattr(shingles, "BLOCK", 40)
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(90)]
    crowd = [" ".join(f"x{rng.integers(1 << 30)}" if rng.random() < 0.012 else w for w in words) for _ in range(220)]
    docs = spark.createDataFrame(list(enumerate(crowd)), "doc_id long, text string")
    assert sorted(r.doc_id for r in shingles.one_of_each(docs).collect()) == sorted(set(roots([grams(t) for t in crowd])))


def test_keys_of_one_group_only_are_not_carried_on(spark, monkeypatch):
    """Texts that SimHash links share nearly all their keys; roots must not be looked up for each of these."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9)))
    words = [word() for _ in range(8000)]
    crowd = [" ".join([*words, f"x{i}"]) for i in range(12)]
    apart = [" ".join(word() if rng.random() < 0.03 else w for w in words[:200]) for _ in range(3)]
    rows, stored = [], shingles.stage_table

    def counting(df, name, **options):
        out = stored(df, name, **options)
        if name == "near-keys":
            rows.append(out.count())
        return out

    monkeypatch.setattr(shingles, "stage_table", counting)
    every = crowd + apart
    docs = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    assert sorted(r.doc_id for r in shingles.one_of_each(docs).collect()) == sorted(set(roots([grams(t) for t in every])))
    assert max(rows) <= 24 * len(apart)


def test_the_driver_gives_memory_back(spark):
    answer = runtime.trim_driver(spark)
    assert answer is None or "rim" in answer
