"""Runs of utterances with keyed state and event-time timers."""

import datetime as dt

import pytest

from quarryline.streaming import runs

SCHEMA = "session_id string, utterance long, idx long, at timestamp, text string, is_final boolean, reply string"
START = dt.datetime(2024, 1, 1)


def chunk(session, utterance, idx, second, text, reply=None, final=None):
    return (session, utterance, idx, START + dt.timedelta(seconds=second), text, reply is not None if final is None else final, reply)


SAID = [
    chunk("a", 0, 0, 0, "what does parking"),
    chunk("a", 0, 1, 1, "what does parking cost here"),
    chunk("a", 0, 2, 2, "what does parking cost here today", "Parking costs five dollars. The garage opens early."),
    chunk("a", 2, 0, 10, "also what about dogs", "Dogs are welcome."),
    chunk("a", 4, 0, 20, "only for the garage", "The garage opens at nine."),
    chunk("a", 6, 0, 30, "say that again", "ignored"),
    chunk("a", 8, 0, 40, "and nothing found", ""),
    chunk("a", 10, 0, 50, "only elephants", "Elephants need permits."),
    chunk("b", 0, 0, 0, "how do I get"),
    chunk("b", 0, 1, 1, "how do I get there by"),
    chunk("c", 0, 0, 5, "an utterance that is overtaken"),
    chunk("c", 0, 1, 6, "an utterance that is overtaken soon"),
    chunk("c", 1, 0, 7, "where is it", "It is here."),
    chunk("z", 0, 0, 500, "later", "Much later."),
]
WANTED = {
    ("a", 0, 1, "provisional", "what does parking cost here", None, None, None),
    ("a", 0, 2, "final", "what does parking cost here today", None, None, None),
    ("a", 0, 2, "answer", "Parking costs five dollars. The garage opens early.", 1, 1, "0"),
    ("a", 2, 0, "refinement", "also what about dogs", None, None, None),
    ("a", 2, 0, "answer", "Parking costs five dollars. The garage opens early. Dogs are welcome.", 2, 0, "0,2"),
    ("a", 4, 0, "refinement", "only for the garage", None, None, None),
    ("a", 4, 0, "answer", "Parking costs five dollars. Dogs are welcome. The garage opens at nine.", 3, 1, "0,2,4"),
    ("a", 6, 0, "presented", "Parking costs five dollars. Dogs are welcome. The garage opens at nine.", 4, 0, "0,2,4"),
    ("a", 8, 0, "refinement", "and nothing found", None, None, None),
    ("a", 8, 0, "preserved", "Parking costs five dollars. Dogs are welcome. The garage opens at nine.", 5, 0, "0,2,4"),
    ("a", 10, 0, "refinement", "only elephants", None, None, None),
    ("a", 10, 0, "answer", "Elephants need permits.", 6, 3, "10"),
    ("b", 0, 1, "provisional", "how do I get there by", None, None, None),
    ("b", 0, None, "given up", None, None, 1, None),
    ("c", 0, 1, "provisional", "an utterance that is overtaken soon", None, None, None),
    ("c", 0, None, "given up", None, None, 1, None),
    ("c", 1, 0, "final", "where is it", None, None, None),
    ("c", 1, 0, "answer", "It is here.", 1, 0, "1"),
    ("z", 0, 0, "final", "later", None, None, None),
    ("z", 0, 0, "answer", "Much later.", 1, 0, "0"),
}


@pytest.mark.parametrize("batches", [1, 3, len(SAID)])
def test_sessions(spark, tmp_path, batches):
    """The same events however the stream is cut into batches."""
    said = sorted(SAID, key=lambda r: r[3])
    size = -(-len(said) // batches)
    for n in range(0, len(said), size):
        spark.createDataFrame(said[n : n + size], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1 if batches > 1 else 1000).parquet(f"{tmp_path}/in")
    with runs.rocks(spark):
        run = runs.runs(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).start()
    assert run.awaitTermination(300)
    got = [tuple(r) for r in spark.read.schema(runs.EVENTS).parquet(f"{tmp_path}/out").collect()]
    assert len(got) == len(set(got)) and set(got) == WANTED


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Tokyo"])
def test_time_zones(spark, tmp_path, zone):
    """Timers go by event time, whatever time zone the session shows it in; tenths of seconds aren't cut."""
    said = [chunk("a", 0, 0, 8.2, "how do I get there"), chunk("b", 0, 0, 38, "how do I get here"), chunk("z", 0, 0, 98.3, "later", "Later.")]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        spark.createDataFrame(said, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
        with runs.rocks(spark):
            run = runs.runs(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).start()
        assert run.awaitTermination(300)
        got = {(r.session_id, r.kind) for r in spark.read.schema(runs.EVENTS).parquet(f"{tmp_path}/out").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == {("a", "given up"), ("z", "final"), ("z", "answer")}


def test_refining():
    old = ["Parking is free.", "Dogs are welcome."]
    assert runs.refine([], "x", ["a"]) == (["a"], 0)
    assert runs.refine(old, "also cats", ["Cats too."]) == ([*old, "Cats too."], 0)
    assert runs.refine(old, "what about only parking", ["Parking costs."]) == (["Dogs are welcome.", "Parking costs."], 1)
    assert runs.refine(old, "tell me more", ["Horses graze."]) == ([*old, "Horses graze."], 0)
    assert runs.refine(old, "rather horses", ["Horses graze."]) == (["Horses graze."], 2)
    assert runs.claims_of(" One is here.  Two\nis there! One is here. ") == ["One is here.", "Two is there!"]
