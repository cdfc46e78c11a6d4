"""Exactly-once appending with growing ids."""

import pytest

from quarryline.streaming import journal


def rows(spark, *numbers):
    return spark.createDataFrame([(n, f"e{n}") for n in numbers], "at long, what string").repartition(3)


def held(spark, path, after=0):
    return sorted((r.event_id, r.what) for r in journal.events(spark, path, after).collect())


def test_replays_add_nothing(spark, tmp_path):
    path = str(tmp_path)
    journal.append(rows(spark, 3, 1, 2), 0, path, ["at"])
    assert held(spark, path) == [(1, "e1"), (2, "e2"), (3, "e3")]
    journal.append(rows(spark, 3, 1, 2, 9), 0, path, ["at"])
    journal.append(rows(spark), 1, path, ["at"])
    journal.append(rows(spark, 7, 5), 2, path, ["at"])
    journal.append(rows(spark, 7, 5), 2, path, ["at"])
    assert held(spark, path) == [(1, "e1"), (2, "e2"), (3, "e3"), (4, "e5"), (5, "e7")]
    assert held(spark, path, 3) == [(4, "e5"), (5, "e7")] and held(spark, path, 5) == []


def test_a_batch_that_failed_half_way(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    journal.append(rows(spark, 1), 0, path, ["at"])
    real = journal.ledger
    calls = []

    def failing(s, p):
        calls.append(1)
        return real(s, p)

    monkeypatch.setattr(journal, "ledger", failing)
    count = type(rows(spark, 1)).count
    monkeypatch.setattr(type(rows(spark, 1)), "count", lambda self: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        journal.append(rows(spark, 2, 3), 1, path, ["at"])
    monkeypatch.setattr(type(rows(spark, 1)), "count", count)
    assert held(spark, path) == [(1, "e1")]  # its events are there, but not in the ledger
    journal.append(rows(spark, 2, 3), 1, path, ["at"])
    assert held(spark, path) == [(1, "e1"), (2, "e2"), (3, "e3")] and calls


def test_streams(spark, tmp_path):
    schema = "at long, what string"
    for n in ((1, 2), (3,), (4, 5)):
        rows(spark, *n).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for mark in ("one", "one", "two"):  # again from its checkpoint, and from the start with the same batch numbers
        run = journal.publish(stream, f"{tmp_path}/out", f"{tmp_path}/{mark}", ["at"]).start()
        assert run.awaitTermination(300)
    got = held(spark, f"{tmp_path}/out")
    assert [i for i, _ in got] == [1, 2, 3, 4, 5] and sorted(w for _, w in got) == ["e1", "e2", "e3", "e4", "e5"]
