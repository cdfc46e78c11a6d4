"""Operators on small tables with known results."""

import json

import pytest
from pyspark.sql import functions as F

from quarryline.functions import numeric, predicates, text
from quarryline.operators import cleaning, curation, evidence, index, intents, models
from quarryline.sources import files
from quarryline.streaming import stateful, transcripts


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_sentences_split_at_stops_glued_words_and_openers(spark):
    got = one(spark, text.sentences(F.col("t")), t="One is here. Two is there!Three follows  on workThis is four?  ")
    assert got == ["One is here.", "Two is there!", "Three follows on work", "This is four?"]


def test_content_terms_and_digest(spark):
    assert one(spark, text.content_terms(F.col("t")), t="What are the Fees of the fees office") == ["fees", "office"]
    a, b = (one(spark, text.text_digest(F.col("t")), t=t) for t in ("a  b\n", " a b"))
    assert a == b


@pytest.mark.parametrize("said, expected", [("repeat that", True), ("Could you please repeat that", True), ("stoplight timing", False), ("hold on to the waiver requirement today", False), ("go back to the previous point!", True), ("please", False), ("", False)])
def test_presentation(spark, said, expected):
    assert one(spark, predicates.presentation_only(F.col("t")), t=said) is expected
    assert stateful._delivery(said) is expected


def test_numbers(spark):
    assert one(spark, numeric.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0
    assert one(spark, numeric.upper_median(F.array(*map(F.lit, (4, 1, 3, 2))))) == 3
    assert one(spark, numeric.ratio(F.lit(1), F.lit(0))) == 0
    assert one(spark, text.common_prefix(F.split(F.lit("a b c"), " "), F.split(F.lit("a b"), " "))) == 2


def test_gold_protected_dedup(spark):
    rows = [(1, "same text"), (2, "same  text "), (3, "other"), (4, "same text"), (5, "lone"), (6, "lone")]
    out = cleaning.dedup_exact(spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame([(2,), (4,)], "id long"))
    got = {r.id: (r.kept, r.dropped_duplicate_of) for r in out.collect()}
    assert got == {1: (False, None), 2: (True, 1), 4: (True, 2), 3: (True, None), 5: (True, None), 6: (False, None)}


def test_chrome_is_stripped_but_not_to_a_stub(spark):
    body = "A long line of real content that says something on this page {0}.\nMore of it here on {0}, so that enough is left."
    rows = [(i, "https://h.example/a", "Home\n" + body.format(i) + "\nFooter") for i in range(12)] + [(50, "https://h.example/b", "Home\nFooter\nx"), (60, "https://other.example/", "Home\nkept")]
    got = {r.id: r for r in cleaning.strip_chrome(spark.createDataFrame(rows, "id long, url string, text string")).collect()}
    assert got[3].did_strip and got[3].clean == body.format(3)
    assert not got[50].did_strip and not got[60].did_strip and got[60].clean == "Home\nkept"


def test_links(spark):
    prose, links = cleaning.links_of(F.col("t"))
    row = spark.createDataFrame([("see [docs](https://a.b/c) or https://d.e/f for a lot more on it",)], "t string").select(prose.alias("p"), links.alias("l")).first()
    assert row.l == ["https://a.b/c", "https://d.e/f"] and row.p == "see docs or   for a lot more on it"


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, domain string, text string, url string")
    asked = spark.createDataFrame([(1, "any words")], "task_id long, query string")
    assert index.bm25(none, asked).count() == 0 and cleaning.clean(none).count() == 0
    assert evidence.answers(asked, evidence.evidence(asked, none.selectExpr("1L task_id", "id", "text", "1.0D score", "1L rank"))).first().answer == evidence.ABSTENTION


def test_requests_and_references(spark):
    asked = {
        "How and when do offices open?": ["How do offices open", "when do offices open"],
        "salt and pepper": ["salt and pepper"],
        "What is Cloud Run and how do I deploy it?": ["What is Cloud Run", "how do I deploy Cloud Run"],
        "Reset the router; also, where is the log?": ["Reset the router", "where is the log"],
        "When was X released and when was Y released in 2021": ["When was X released in 2021", "when was Y released in 2021"],
        "one . two . three . four . five": ["one", "two", "three", "four"],
        "What is A$1\\b and why is it so?": ["What is A$1\\b", "why is A$1\\b so"],
        "": [""],
    }
    rows = spark.createDataFrame([(q,) for q in [*asked, None]], "q string")
    got = {r.q: r.parts for r in intents.with_parts(rows, "q").collect()}
    assert got == asked | {None: [""]}
    turns = [
        ("what is its fee", [], True),
        ("what is the storage quota and how do I raise it", [], False),
        ("is this clinic open", [("user", "the library"), ("agent", "yes")], True),
        ("is this clinic open", [("user", "the clinic downtown"), ("agent", "the clinic")], False),
        ("how does it work", [("user", "the VPN gateway"), ("agent", "The VPN gateway is up.")], False),
        ("how does it work", [("user", "parking in town"), ("agent", "I don't know.")], True),
        ("SDK best practices", None, True),
    ]
    rows = spark.createDataFrame([(i, q, t) for i, (q, t, _) in enumerate(turns)], "i int, q string, t array<struct<role string, text string>>")
    got = {r.i: r.unresolved for r in intents.with_open_reference(rows, "q", "t").collect()}
    assert got == {i: x for i, (_, _, x) in enumerate(turns)}
    cases = [(1, ["alpha beta", "gamma delta"], ["gamma delta", "alpha"]), (2, ["one thing"], ["other words", "one thing", "one"]), (3, [], ["x"]), (4, None, None)]
    got = {r.k: (r.n_expected, r.n_predicted, r.n_matched, r.over_split) for r in intents.with_matching(spark.createDataFrame(cases, "k int, e array<string>, p array<string>"), "e", "p").collect()}
    assert got == {1: (2, 2, 2, False), 2: (1, 3, 1, True), 3: (0, 1, 0, True), 4: (0, 0, 0, False)}
    pairs = [("what is a quota", "A quota is a limit on use.", True), ("what is a quota", "You may raise limits.", False), ("what is the price", "Anything.", True), ("define drone", "Small flying robots are called drone.", True), ("open the door", "Yes.", True)]
    rows = spark.createDataFrame([(i, q, t) for i, (q, t, _) in enumerate(pairs)], "i int, q string, t string")
    got = {r.i: r.d for r in rows.select("i", intents.defines(F.col("q"), F.col("t")).alias("d")).collect()}
    assert got == {i: x for i, (_, _, x) in enumerate(pairs)}


def test_encoder_reranker_and_client(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, ""), (3, None)], "k long, t string")
    got = {r.k: r.embedding for r in models.encode(df, "k", "t", "unknown").collect()}
    assert len(got[1]) == 128 and abs(sum(v * v for v in got[1]) - 1) < 1e-9 and set(got[2]) == {0.0}

    def client():
        def chat(prompt):
            if not prompt:
                raise ValueError("key sk-1 refused")
            return prompt.upper(), 3, 1

        return chat

    rows = {r.k: r for r in models.ask(df, "k", "t", client, redact=("sk-1",)).collect()}
    assert rows[1].reply == "ALPHA BETA" and rows[2].error == "key [redacted] refused" and rows[3].reply is None


def test_files_round_trip(spark, tmp_path):
    rows = [{"trace_id": "a", "status": "complete", "estimated_cost_usd": 0.1, "cost_estimate_basis": "x", "retrieval_events": [], "decisions": [], "stage_latency_ms": {}, "token_usage": {}}]
    rows += [{**rows[0], "trace_id": "b", "estimated_cost_usd": -1}, {k: v for k, v in rows[0].items() if k != "token_usage"}]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\nnot json\n")
    got = sorted(r.problems for r in files.traces(spark, str(tmp_path / "t.jsonl")).collect())
    assert got == ["", "estimated_cost_usd must be null or nonnegative", "invalid JSON; invalid execution status", "missing fields token_usage"]
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\nq1\tp1\t1\nq1\tp2\t0\nq1\tp1\t2\n")
    assert {(r.query_id, r.corpus_id): r.score for r in files.relevance(spark, str(tmp_path / "q.tsv")).collect()} == {("q1", "p1"): 2, ("q1", "p2"): 0}
    cases = spark.createDataFrame([("c1", "test", "d", "partial", 'say "x", y\nz', "a", "", ["p"], [("p", 0, 1, "t")])], "case_id string, split string, domain string, case_class string, query string, reference_answer string, required_clarification string, gold_passage_ids array<string>, support_spans array<struct<passage_id: string, start: int, `end`: int, text: string>>")
    files.write_reviews(cases, str(tmp_path / "r"))
    back = files.reviews(spark, str(tmp_path / "r")).first()
    assert back.query == 'say "x", y\nz' and json.loads(back.gold_passage_ids) == ["p"]
    found = files.imported_reviews(cases, spark.createDataFrame([("c1", "approved"), ("zz", "approved")], "case_id string, status string"))
    assert {r.case_id: r.problem for r in found.collect()} == {"c1": None, "zz": "unknown case"}
    m = files.manifest(spark, str(tmp_path / "q.tsv"))
    assert files.verify_manifest(m, m).count() == 0 and files.verify_manifest(m.limit(0), m).first().problem == "missing"
    vectors = spark.createDataFrame([(1, "en", [1.0])], "id long, domain string, embedding array<double>")
    assert spark.read.parquet(files.write_index(vectors, str(tmp_path / "ix"), "hash128")).count() == 1
    assert files.remaining(cases, cases.limit(0)).count() == 1
    (tmp_path / "bad.jsonl").write_text('{"case_id": "a"}\n{broken\n')
    with pytest.raises(Exception):
        files.json_lines(spark, str(tmp_path / "bad.jsonl"), "case_id string").collect()
    (tmp_path / "more.jsonl").write_text('{"case_id": "a", "split": "second"}\n{"case_id": "b", "split": "second"}\n')
    both = files.first_of_files(spark, [str(tmp_path / "bad.jsonl"), str(tmp_path / "more.jsonl")], "case_id string, split string", "case_id")
    assert {r.case_id: r.split for r in both.collect()} == {"a": None, "b": "second"}


def test_stream_equals_batch_for_any_split(spark, tmp_path):
    turns = [(f"s{i}", f"please tell me about the opening hours of office number {i} and its annual fee" if i % 3 else "repeat that") for i in range(12)]
    chunks = transcripts.simulate_chunks(spark.createDataFrame(turns, "stream_id string, text string"), step=3)
    want = sorted((r.stream_id, r.idx, r.committed, r.decision) for r in transcripts.decisions(chunks).collect())
    for parts in (1, 4):
        source = str(tmp_path / f"in{parts}")
        chunks.select("stream_id", "idx", "text", "is_final").orderBy("idx").repartitionByRange(parts, "idx").write.parquet(source)
        stream = spark.readStream.schema("stream_id string, idx long, text string, is_final boolean").parquet(source)
        name = f"decided{parts}"
        stateful.controller(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
        got = sorted((r.stream_id, r.idx, r.committed, r.decision) for r in spark.table(name).collect())
        assert got == want


def test_curation_rules(spark):
    row = ("c1", "nowhere", "odd", "answer", "", "", "", "", "approved")
    names = "case_id string, split string, case_class string, behavior string, query string, answer string, evidence string, clarification string, review string"
    assert curation.problems(spark.createDataFrame([row], names)).first().problems == "invalid split; invalid case_class; empty query"


def test_semantic_controller_fires_once_and_again_after_drift():
    vectors = {"same": [1.0, 0.0], "other": [0.0, 1.0]}
    import numpy as np

    c = stateful.Semantic(lambda ts: np.array([vectors[ts[0].split()[0]] for _ in ts]))
    state, said = stateful.Semantic.fresh(), []
    for first in ("same", "same", "same", "same", "other"):
        state, decision, reason = c.step(state, first + " words that are long enough here", False, 0.9)
        said.append((decision, reason))
    assert said == [("Wait", "collecting"), ("Wait", "collecting"), ("Retrieve", "stable"), ("Wait", "already retrieved"), ("Retrieve", "intent drift")]
    assert c.step(state, "same", False, 0.9)[2] == "too short" and c.step(state, "x", True, None)[1] == "Retrieve"


def test_spoken_streams_are_reproducible_and_end_with_the_text(spark):
    turns = spark.createDataFrame([(f"s{i}", "the quick brown foxes jumped over lazy dogs, twice") for i in range(30)] + [("e", "")], "stream_id string, text string")
    rows = transcripts.spoken(turns).collect()
    again = transcripts.spoken(turns.repartition(5)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert {r.text for r in rows if r.is_final} == {"the quick brown foxes jumped over lazy dogs, twice"}
    assert transcripts.stream_problems(transcripts.spoken(turns)).where("problems <> ''").count() == 0
    revised = {r.stream_id for r in transcripts.revisions(transcripts.spoken(turns)).collect()}
    assert 2 <= len(revised) <= 25


def test_breaker_and_sequences():
    from quarryline.operators import scoring

    now = [0.0]
    b = scoring.Breaker(failures=2, wait_s=10, clock=lambda: now[0])

    def bad():
        raise ValueError

    for _ in range(2):
        with pytest.raises(ValueError):
            b.call(bad)
    with pytest.raises(RuntimeError):
        b.call(int)
    now[0] = 11
    assert b.state == "half-open" and b.call(int) == 0 and b.state == "closed"
    assert scoring.longest_common(list("abcbdab"), list("bdcaba")) == 4
