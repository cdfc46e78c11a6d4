"""Runs of utterances over sessions, with state per session and event-time timers.

A session is a series of utterances; an utterance is a series of growing hypotheses, the last of them
final. A hypothesis that the controller wants searched is searched once, provisionally while the utterance
is open and for good when it is final; once the session has an answer, utterances are late constraints and
their searches refinements. Only the final hypothesis counts for the answer: searches of others are stale
and dropped. An utterance that stays open for ``idle_ms`` of event time, or is overtaken by a later one, is
given up with all that it searched.

What the sources say to a final hypothesis comes with it as its reply. The standing answer is a list of
claims with the utterances that they come from. A first reply sets it; a constraint that adds ("also ...")
appends; any other constraint drops the claims that share content terms with its reply, and a restrictive
one ("only ...") that shares none replaces them all. Without a reply the answer stands. Every answer is a new version.

State: one value (version and controller) and three collections, so that a session's cost goes with what is
new in a batch: a list of open searches, a list of claims, and a map from claim to utterance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from quarryline.functions.text import CONTENT_STOPWORDS, SENTENCE, TOKEN
from quarryline.streaming.stateful import _delivery, decide

RESTRICTIVE = r"(?i)\b(?:only|instead|actually|except|rather|not)\b"
ADDITIVE = r"(?i)^\s*(?:what\s+about|also\b|and\b)"
EVENTS = "session_id string, utterance long, idx long, kind string, text string, version long, dropped long, citations string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def claims_of(text: str | None) -> list[str]:
    """Sentences with single spaces, each once."""
    parts = (" ".join(s.split()) for s in re.split(SENTENCE, (text or "").strip()))
    return list(dict.fromkeys(s for s in parts if s))


def terms_of(text: str) -> set[str]:
    return {t for t in (x.lower() for x in re.findall(TOKEN, text)) if len(t) > 2 and t not in CONTENT_STOPWORDS}


def refine(standing: list[str], constraint: str, reply: list[str]) -> tuple[list[str], int]:
    """(claims that stand after a constraint and its reply, how many went)."""
    if not standing:
        return reply, 0
    restrictive = re.search(RESTRICTIVE, constraint) is not None
    if not restrictive and re.search(ADDITIVE, constraint):
        kept = standing
    else:
        new = set().union(*map(terms_of, reply))
        kept = [s for s in standing if not terms_of(s) & new]
        if restrictive and len(kept) == len(standing):
            kept = []
    return kept + [s for s in reply if s not in kept], len(standing) - len(kept)


class Run(StatefulProcessor):
    """One session: rows of (utterance, idx, at, text, is_final, reply, ms) in, events out; ``ms`` is ``at`` in whole milliseconds of UTC."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "version long, utterance long, window string, fired boolean, searched string")
        self.open = handle.getListState("open", "text string")
        self.claims = handle.getListState("claims", "text string")
        self.cited = handle.getMapState("cited", "text string", "utterance long")

    def _drop_open(self) -> int:
        """Forget the open utterance's searches; how many there were."""
        n = sum(1 for _ in self.open.get()) if self.open.exists() else 0
        self.open.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        return n

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.session.get() if self.session.exists() else None
        version, utterance, window, fired, searched = held if held else (0, None, None, False, None)
        out, due = [], next(iter(self.handle.listTimers()), None)
        pending = [r[0] for r in self.open.get()] if self.open.exists() else []
        for r in pd.concat(list(rows)).sort_values(["utterance", "idx"]).itertuples():
            u, text = int(r.utterance), r.text or ""
            if utterance is not None and u < utterance:
                continue  # overtaken
            if u != utterance:
                if due is not None or pending:
                    out.append((utterance, None, "given up", None, None, len(pending), None))
                    pending, due = [], None
                utterance, window, fired, searched = u, None, False, None
            window, fired, _, decision = decide(window, fired, text, bool(r.is_final))
            if decision == "Retrieve" and searched != text:
                searched = text
                out.append((u, int(r.idx), "refinement" if version else "final" if r.is_final else "provisional", text, None, None, None))
                pending.append(text)
            if not r.is_final:
                due = int(r.ms) + self.idle_ms
                continue
            due = None
            stale = sum(t != text for t in pending)
            pending = []
            reply = [] if _delivery(text.strip()) else claims_of(r.reply)
            standing = [c[0] for c in self.claims.get()] if version else []
            if not version and not reply:
                continue
            version += 1
            if reply:
                now, gone = refine(standing, text, reply)
                for c in set(standing) - set(now):
                    self.cited.removeKey((c,))
                for c in now:
                    if c not in standing:
                        self.cited.updateValue((c,), (u,))
                self.claims.put([(c,) for c in now])
                kind = "answer"
            else:
                now, gone, kind = standing, 0, "presented" if _delivery(text.strip()) else "preserved"
            sources = dict.fromkeys(int(self.cited.getValue((c,))[0]) for c in now)
            out.append((u, int(r.idx), kind, " ".join(now), version, gone + stale, ",".join(map(str, sources))))
        self._drop_open()
        if pending:
            self.open.put([(t,) for t in pending])
        if due is not None:
            self.handle.registerTimer(due)
        self.session.update((version, utterance, window, fired, searched))
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        version, utterance, _, _, _ = self.session.get()
        n = self._drop_open()
        self.session.update((version, utterance + 1, None, False, None))  # what still comes of it is late
        yield self._rows(key, [(utterance, None, "given up", None, None, n, None)])

    def _rows(self, key, out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame([(key[0], *r) for r in out], columns=["session_id", "utterance", "idx", "kind", "text", "version", "dropped", "citations"])
        return frame.astype({c: "Int64" for c in ("utterance", "idx", "version", "dropped")})

    def close(self) -> None:
        pass


def runs(chunks: DataFrame, idle_ms: int = 30_000, late: str = "1 minute") -> DataFrame:
    """Events of a stream of (session_id, utterance, idx, at, text, is_final, reply); rows later than ``late`` are left out."""
    # pandas shows timestamps in the session's time zone, timers go by UTC
    timely = chunks.withWatermark("at", late).withColumn("ms", F.unix_millis("at"))
    return timely.groupBy("session_id").transformWithStateInPandas(Run(idle_ms), EVENTS, "append", "eventTime")


@contextmanager
def rocks(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which collections and timers need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)
