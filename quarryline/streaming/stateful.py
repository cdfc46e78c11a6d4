"""Structured Streaming: the controller per stream and versioned answers per session, with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from quarryline.functions.predicates import LONG_PRESENTATION, POLITE, PRESENTATION

DECISION = "stream_id string, idx long, committed long, decision string"
CONTROL = "window string, fired boolean"


def _delivery(text: str) -> bool:
    import re

    bare = re.sub(POLITE, "", text.lower().lstrip())
    exact = bare.rstrip(" .!?") in LONG_PRESENTATION
    return bool(re.match(rf"(?:{PRESENTATION})\b", bare)) and (len(bare.split()) <= 5 or exact)


def decide(window: str | None, fired: bool, text: str, is_final: bool, stable_words: int = 3) -> tuple[str | None, bool, int, str]:
    """One step of the controller: the new state, the agreed words and the decision."""
    text = text.strip()
    if not text or _delivery(text):
        return window, fired, 0, "No-Retrieval"
    if is_final:
        return window, fired, 0, "Retrieve"
    agreed = 0
    if window is not None:
        for a, b in zip(window.split(), text.split()):  # noqa: B905
            if a != b:
                break
            agreed += 1
    if agreed >= stable_words and not fired:
        return text, True, agreed, "Retrieve"
    return text, fired, agreed, "Wait"


def _timeout(ttl_ms: int | None) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout


def controller(chunks: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Decisions for a stream of (stream_id, idx, text, is_final); a stream's state goes after its final chunk, or after ``ttl_ms`` without one (such a query runs until it is stopped)."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        window, fired = state.get if state.exists else (None, False)
        rows, done = [], False
        for r in pd.concat(list(frames)).sort_values("idx").itertuples():
            window, fired, agreed, decision = decide(window, fired, r.text or "", bool(r.is_final))
            rows.append((key[0], r.idx, agreed, decision))
            done = done or bool(r.is_final)
        if done:
            state.remove()
        else:
            state.update((window, fired))
            if ttl_ms:
                state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(rows, columns=["stream_id", "idx", "committed", "decision"])

    return chunks.groupBy("stream_id").applyInPandasWithState(step, DECISION, CONTROL, "append", _timeout(ttl_ms))


SESSION = "session_id string, version long, previous_version long, answer string"


def session_answers(turns: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Versions of a session's answer from a stream of (session_id, seq, delta, replaces); without news the answer stands.

    An addition is appended, a replacement drops what was there; with ``ttl_ms`` the state is forgotten after that time, and the query runs until it is stopped.
    """

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        version, answer = state.get if state.exists else (0, "")
        rows = []
        for r in pd.concat(list(frames)).sort_values("seq").itertuples():
            if not (r.delta or "").strip():
                continue
            answer = r.delta.strip() if r.replaces or not answer else f"{answer}\n\n{r.delta.strip()}"
            rows.append((key[0], version + 1, version, answer))
            version += 1
        state.update((version, answer))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(rows, columns=["session_id", "version", "previous_version", "answer"])

    return turns.groupBy("session_id").applyInPandasWithState(step, SESSION, "version long, answer string", "append", _timeout(ttl_ms))


def superseding(chunks: DataFrame) -> DataFrame:
    """The hypothesis that stands per stream, in update mode: a final chunk replaces all partials."""
    return chunks.groupBy("stream_id").agg(F.max_by("text", F.struct("is_final", "idx")).alias("text"), F.max("is_final").alias("is_final"))


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and type; rows later than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))


class Semantic:
    """The controller by meaning: a stream's recent embeddings must stay close before it retrieves.

    ``window`` hypotheses are looked at; similarity at or above ``stable`` throughout means stability, below
    ``drift`` a change of intent: before the first retrieval the window starts anew, after it a new one is
    due. Thresholds are fixed per stream, so streams don't depend on each other's order.
    """

    def __init__(self, encode, window: int = 3, stable: float = 0.85, drift: float = 0.65, min_confidence: float = 0.72, min_chars: int = 24, min_tokens: int = 5):
        self.encode, self.window, self.stable, self.drift = encode, window, stable, drift
        self.min_confidence, self.min_chars, self.min_tokens = min_confidence, min_chars, min_tokens

    def step(self, state: dict, text: str, is_final: bool, confidence: float | None) -> tuple[dict, str, str]:
        text = text.strip()
        if not text:
            return state, "No-Retrieval", "empty text"
        if _delivery(text):
            return state, "No-Retrieval", "presentation-only command"
        if is_final:
            return state, "Retrieve", "final transcript"
        sure = 0.5 if confidence is None else confidence
        if sure < self.min_confidence:
            return state, "Wait", "low confidence"
        if len(text) < self.min_chars or len(text.split()) < self.min_tokens:
            return state, "Wait", "too short"
        vector = self.encode([text])[0]
        seen, sims = state["n"] + 1, list(state["sims"])
        if state["last"] is not None:
            sims.append(float(max(-1.0, min(1.0, vector @ state["last"]))))
        scores = [*state["scores"], sure][-self.window :]
        state = {"n": seen, "sims": sims[-(self.window - 1) :], "last": vector, "fired": state["fired"], "scores": scores}
        if seen < self.window:
            return state, "Wait", "collecting"
        if len(sims) >= 2 and sims[-1] < self.drift:
            if state["fired"]:
                return state, "Retrieve", "intent drift"
            return {**state, "n": 1, "sims": [], "scores": scores[-1:]}, "Wait", "intent drift"
        weight = [2.718281828459045 ** (-0.5 * i) for i in range(len(scores))][::-1]
        steady = sum(s * w for s, w in zip(scores, weight, strict=True)) / sum(weight)
        if len(sims) >= self.window - 1 and all(s >= self.stable for s in sims[-(self.window - 1) :]) and steady >= self.min_confidence:
            if state["fired"]:
                return state, "Wait", "already retrieved"
            return {**state, "fired": True}, "Retrieve", "stable"
        return state, "Wait", "not stable yet"

    @staticmethod
    def fresh() -> dict:
        return {"n": 0, "sims": [], "last": None, "fired": False, "scores": []}


def semantic_decisions(chunks: DataFrame, backend: str = "hash128", **settings) -> DataFrame:
    """(stream_id, idx, decision, reason) of a table of chunks (stream_id, idx, text, is_final, confidence), by the semantic controller."""
    from quarryline.operators.models import ENCODERS

    factory = ENCODERS[backend]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        controller, state, rows = Semantic(factory(), **settings), Semantic.fresh(), []
        for r in frame.sort_values("idx").itertuples():
            state, decision, reason = controller.step(state, r.text or "", bool(r.is_final), None if pd.isna(r.confidence) else r.confidence)
            rows.append((r.stream_id, r.idx, decision, reason))
        return pd.DataFrame(rows, columns=["stream_id", "idx", "decision", "reason"])

    return chunks.groupBy("stream_id").applyInPandas(run, "stream_id string, idx long, decision string, reason string")
