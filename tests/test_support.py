"""Direct evidence, spans that rules let pass, and blocks kept whole."""

import json

import pytest
from pyspark.sql import functions as F

from quarryline.functions import predicates as P
from quarryline.operators import models, support

HITS = "task_id long, id long, text string, score double, rank long"


def ask(spark, query, *texts, task=1):
    return spark.createDataFrame([(task, query)], "task_id long, query string"), spark.createDataFrame([(task, i, t, 1.0, i) for i, t in enumerate(texts, 1)], HITS)


def spans(df):
    return [(r.id, r.sentence) for r in sorted(df.collect(), key=lambda r: r.pick)]


@pytest.mark.parametrize(
    "query, text, expected",
    [
        ("When does the garage open", "The garage does open at nine every day.", ["The garage does open at nine every day."]),
        ("When does the garage open", "Parking at the garage costs five dollars.", []),
        ("When does the garage open", "When does the garage open?", []),
        ("What is a widget", "The shop sells a widget for ten dollars.", []),
        ("What is a widget", "A widget is a small round tool.", ["A widget is a small round tool."]),
        ("What is the name of the mascot", "The mascot of the city is called Bruno.", ["The mascot of the city is called Bruno."]),
        ("What is the name of the mascot", "The mascot of the city runs every year.", []),
        ("How can parking fines be paid", "Parking fines that can be paid are listed by card type.", ["Parking fines that can be paid are listed by card type."]),
        ("What opened on 3 May 2020 downtown", "The hall opened downtown on 4 May 2020.", []),
    ],
)
def test_direct(spark, query, text, expected):
    queries, hits = ask(spark, query, text)
    assert [s for _, s in spans(support.direct(queries, hits))] == expected


def test_procedures_come_first(spark):
    steps = "Blue router setup\nStep 1. Open the   page\nStep 2. Save the router\n"
    queries, hits = ask(spark, "How do I configure the blue router?", "The blue router is nice to configure here.", steps, steps + "Step 3. Again")
    assert spans(support.direct(queries, hits)) == [(2, "Step 1. Open the page"), (2, "Step 2. Save the router")]


def test_names(spark):
    queries, _ = ask(spark, "What is the name of the mascot?")
    rows = lambda *ts: spark.createDataFrame([(1, i, t, i) for i, t in enumerate(ts, 1)], "task_id long, id long, sentence string, pick long")
    agreed = rows("The mascot, a large old bear, is called Bruno", "The mascot is called Bruno", "Bears eat honey and the mascot too")
    assert spans(support.selected(queries, agreed)) == [(2, "The mascot is called Bruno")]
    torn = rows("The mascot is called Bruno", "The mascot is named Berta", "Bears eat honey")
    assert spans(support.selected(queries, torn)) == [(1, "The mascot is called Bruno"), (2, "The mascot is named Berta")]
    other, _ = ask(spark, "Where is the mascot?")
    assert len(spans(support.selected(other, torn))) == 3


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "question, sentence, expected",
    [
        ("why is it closed", "It is closed because of rain", True),
        ("why is it closed", "It is closed today", False),
        ("are object storage and block storage the same", "They differ in many ways", False),
        ("is alpha engine the same as gamma turbine", "The alpha engine differs, unlike a gamma turbine, the same parts", True),
        ("who do i call for help", "Send us a postcard", False),
        ("who do i call for help", "Call the hotline", True),
        ("how many seats", "Hall 3 20 45", False),
        ("how many seats", "There are 3 halls for 20", True),
        ("anything else", "Any sentence", True),
    ],
)
def test_relations(spark, question, sentence, expected):
    assert value(spark, P.answers_relation(F.lit(question), F.lit(sentence))) is expected


def test_shapes_and_steps(spark):
    assert value(spark, P.answer_shape(F.lit("What is the phone number"), F.lit("Ring (303) 555-0100 now"))) is True
    assert value(spark, P.answer_shape(F.lit("What is the phone number"), F.lit("12 Main Street 80202"))) is False
    source = F.lit("Blue router guide. Open the page.")
    assert value(spark, P.steps_towards(F.lit("how do I install the blue router"), F.lit("2. Open the page"), source)) is True
    assert value(spark, P.steps_towards(F.lit("how do I install the blue router"), F.lit("The page is open"), source)) is False
    assert value(spark, P.steps_towards(F.lit("x: blue router Current question: how do I install it"), F.lit("Open the page"), source)) is True
    assert value(spark, P.shared_stems(F.array(F.lit("parking"), F.lit("fee")), F.array(F.lit("park"), F.lit("fees")))) == 1


def test_sentences_keep_their_digits(spark):
    """A sentence that begins or ends with the number of its place is shown whole."""
    _, hits = ask(spark, "q", "0 is a number. 14 is one more.  2 is another 2\n \n0 ends it 0")
    assert [(r.sid, r.sentence) for r in sorted(support.catalogue(hits).collect(), key=lambda r: r.sid)] == [("1.1", "0 is a number."), ("1.2", "14 is one more."), ("1.3", "2 is another 2"), ("1.4", "0 ends it 0")]


def test_chosen_spans_are_verified(spark):
    queries, hits = ask(spark, "When does the garage open", "The garage opens at nine. Contact us.\nIt rains.", "The garage opens for the fair only.")
    shown = {r.sid: r.sentence for r in support.catalogue(hits).collect()}
    assert shown == {"1.1": "The garage opens at nine.", "1.2": "Contact us.", "1.3": "It rains.", "2.1": "The garage opens for the fair only."}
    prompt = support.prompts(queries, hits).first().prompt
    assert prompt.startswith("Query: When does the garage open\n\n[1.1] The garage") and prompt.endswith("[2.1] The garage opens for the fair only.")

    def client(ids):
        return lambda: lambda p: ("so: " + json.dumps({"span_ids": ids}), 1, 1)

    reply = models.ask(support.prompts(queries, hits), "task_id", "prompt", client(["2.1", "1.3", "7.7", "1.1"]))
    assert spans(support.verified(queries, hits, support.chosen(reply, hits))) == [(2, "The garage opens for the fair only."), (1, "The garage opens at nine.")]
    assert spans(support.verified(queries, hits, support.chosen(reply, hits), 1)) == [(2, "The garage opens for the fair only.")]
    broken = models.ask(support.prompts(queries, hits), "task_id", "prompt", lambda: lambda p: ("no json", 1, 1))
    assert spans(support.verified(queries, hits, support.chosen(broken, hits))) == []
    made_up = spark.createDataFrame([(1, 1, "The garage opens at ten.", 1), (1, 9, "The garage opens at nine.", 2)], "task_id long, id long, sentence string, pick long")
    assert spans(support.verified(queries, hits, made_up)) == []


def test_blocks(spark):
    text = "Intro line\n\nOpening hours\n \nMonday nine\nTuesday ten\n\nA heading that has far too many words\n\none\ntwo\n\nAlone\n\nonly one line\n\nLast\n\n" + "\n".join("line" for _ in range(13))
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")
    found = support.blocks(rows)
    assert [tuple(r) for r in found.collect()] == [(1, "Opening hours", 2, 2, "Opening hours Monday nine Tuesday ten")]
    queries, _ = ask(spark, "what are the opening hours")
    chosen = spark.createDataFrame([(1, 1, "Opening hours", 1), (1, 1, "Intro line", 2)], "task_id long, id long, sentence string, pick long")
    assert spans(support.expanded(chosen, queries, found)) == [(1, "Opening hours Monday nine Tuesday ten"), (1, "Intro line")]
    other, _ = ask(spark, "what are the fees")
    assert spans(support.expanded(chosen, other, found))[0] == (1, "Opening hours")
