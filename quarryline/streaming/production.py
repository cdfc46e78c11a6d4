"""The production controller: retrieval decisions with thresholds that follow what a session's hypotheses do.

Hypotheses of an utterance are compared with the one before. Two similarities in a row, and their score
with the recognizer's confidence, at or above the stability threshold start a search; after that a
similarity below the drift threshold starts another. Both thresholds are the fixed ones until a session
has ``warm`` similarities behind it; from then on stability is asked at most at the mean less ``spread``
standard deviations, and drift at most at a low quantile, of the session's own similarities so far. Mean
and variance are kept running, the quantile in a histogram of ``bins`` counts, so the state stays small.

The same rules are given twice: as windows over a table, and with keyed state over a stream.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from quarryline.functions.numeric import dot
from quarryline.functions.predicates import chunk_problem, presentation_command

DECISIONS = "session_id string, utterance long, idx long, decision string, reason string, stable_at double, drift_at double"
DECAY = math.exp(-0.3)


@dataclass(frozen=True)
class Thresholds:
    stable: float = 0.85
    drift: float = 0.65
    warm: int = 8
    spread: float = 1.0
    low: float = 0.05
    bins: int = 64


def prepared(chunks: DataFrame) -> DataFrame:
    """``chunks`` (text, is_final, confidence) with ``kind``: final, empty, a problem, presentation, or semantic."""
    problem = chunk_problem(F.col("text"), F.coalesce("confidence", F.lit(1.0)))
    kind = F.when(F.col("is_final"), "final").when(problem == "empty text", "empty").when(problem.isNotNull(), "problem").when(presentation_command(F.col("text")), "presentation").otherwise("semantic")
    return chunks.withColumn("kind", kind)


def _outcome(kind: Column, semantic: tuple[Column, Column]) -> tuple[Column, Column]:
    decision = F.when(kind == "final", "Retrieve").when(kind.isin("empty", "presentation"), "No-Retrieval").when(kind == "problem", "Wait").otherwise(semantic[0])
    return decision, F.when(kind == "semantic", semantic[1]).otherwise(kind)


def decisions(chunks: DataFrame, rule: Thresholds = Thresholds()) -> DataFrame:
    """(session_id, utterance, idx, decision, reason, stable_at, drift_at) of a table (session_id, utterance, idx, text, is_final, confidence, embedding)."""
    rows = prepared(chunks)
    own = Window.partitionBy("session_id", "utterance", "kind").orderBy("idx")
    before = F.lag("embedding").over(own)
    length = lambda v: F.sqrt(dot(v, v))
    cosine = F.coalesce(F.try_divide(dot(F.col("embedding"), F.col("_last")), length(F.col("embedding")) * length(F.col("_last"))), F.lit(0.0))
    rows = rows.withColumn("_last", before).withColumn("_sim", F.when((F.col("kind") == "semantic") & F.col("_last").isNotNull(), F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)), 9)))
    rows = rows.withColumn("_sure", F.coalesce("confidence", F.lit(0.8)))
    rows = rows.withColumns({"_sim1": F.lag("_sim").over(own), "_sure1": F.lag("_sure").over(own), "_n": F.row_number().over(own)})
    session = Window.partitionBy("session_id").orderBy("utterance", "idx").rowsBetween(Window.unboundedPreceding, -1)
    bin_ = F.least(F.floor((F.col("_sim") + 1) / 2 * rule.bins), F.lit(rule.bins - 1))
    rows = rows.withColumn("_bin", bin_).withColumns({"_seen": F.count("_sim").over(session), "_mean": F.avg("_sim").over(session), "_sd": F.stddev_pop("_sim").over(session), "_bins": F.array_sort(F.collect_list("_bin").over(session))})
    warm = F.col("_seen") >= rule.warm
    edge = F.try_element_at("_bins", F.ceil(F.col("_seen") * rule.low).cast("int")) * 2 / rule.bins - 1
    stable_at = F.round(F.when(warm, F.least(F.lit(rule.stable), F.col("_mean") - rule.spread * F.col("_sd"))).otherwise(rule.stable), 9)
    drift_at = F.round(F.when(warm, F.least(F.lit(rule.drift), edge)).otherwise(rule.drift), 9)
    rows = rows.withColumns({"stable_at": stable_at, "drift_at": drift_at})
    mean = lambda a, b: (F.col(a) * DECAY + F.col(b)) / (DECAY + 1)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean("_sim1", "_sim") * (0.7 + 0.3 * mean("_sure1", "_sure"))))
    full = F.col("_sim1").isNotNull() & F.col("_sim").isNotNull()
    drifts = F.coalesce(full & (F.col("_sim") < F.col("drift_at")), F.lit(False))
    settled = F.coalesce(full & ~drifts & (F.col("_sim1") >= F.col("stable_at")) & (F.col("_sim") >= F.col("stable_at")) & (F.round(score, 9) >= F.col("stable_at")), F.lit(False))
    rows = rows.withColumns({"_drifts": drifts, "_settled": settled})
    fired = F.coalesce(F.max(F.col("_settled").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > 0
    first, again = F.col("_settled") & ~fired, F.col("_drifts") & fired
    decision, reason = _outcome(F.col("kind"), (F.when(first | again, "Retrieve").otherwise("Wait"), F.when(first, "stable").when(again, "intent drift").when(F.col("_n") < 3, "building window").otherwise("not stable")))
    only = lambda c: F.when(F.col("kind") == "semantic", F.col(c))
    return rows.select("session_id", "utterance", "idx", decision.alias("decision"), reason.alias("reason"), only("stable_at").alias("stable_at"), only("drift_at").alias("drift_at"))


class Production(StatefulProcessor):
    """One session of a stream of prepared chunks."""

    def __init__(self, rule: Thresholds):
        self.rule = rule

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "n long, mean double, m2 double, bins array<long>")
        self.open = handle.getValueState("open", "utterance long, n long, last array<double>, sims array<double>, sures array<double>, fired boolean")

    def _thresholds(self, n: int, mean: float, m2: float, bins: list[int]) -> tuple[float, float]:
        rule = self.rule
        if n < rule.warm:
            return rule.stable, rule.drift
        wanted, reached, b = math.ceil(n * rule.low), 0, 0
        while (reached := reached + bins[b]) < wanted:
            b += 1
        return round(min(rule.stable, mean - rule.spread * math.sqrt(max(m2, 0) / n)), 9), round(min(rule.drift, b * 2 / rule.bins - 1), 9)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rule, fresh = self.rule, lambda u: [u, 0, None, [], [], False]
        n, mean, m2, bins = self.seen.get() if self.seen.exists() else (0, 0.0, 0.0, [0] * rule.bins)
        bins, out = list(bins), []
        held = list(self.open.get()) if self.open.exists() else fresh(None)
        for r in pd.concat(list(rows)).sort_values(["utterance", "idx"]).itertuples():
            if held[0] != r.utterance:
                held = fresh(int(r.utterance))
            if r.kind != "semantic":
                decision = {"final": "Retrieve", "problem": "Wait"}.get(r.kind, "No-Retrieval")
                out.append((int(r.utterance), int(r.idx), decision, r.kind, None, None))
                continue
            vector, sure = [float(x) for x in r.embedding], 0.8 if pd.isna(r.confidence) else float(r.confidence)
            stable, drift = self._thresholds(n, mean, m2, bins)
            held[1] += 1
            sim = None
            if held[2] is not None:
                length = math.sqrt(sum(x * x for x in vector)) * math.sqrt(sum(x * x for x in held[2]))
                sim = round(max(-1.0, min(1.0, sum(x * y for x, y in zip(vector, held[2], strict=True)) / length)) if length else 0.0, 9)
                held[3] = [*held[3], sim][-2:]
                n += 1
                delta = sim - mean
                mean += delta / n
                m2 += delta * (sim - mean)
                bins[min(int((sim + 1) / 2 * rule.bins), rule.bins - 1)] += 1
            held[2], held[4] = vector, [*held[4], sure][-2:]
            drifts = settled = False
            if len(held[3]) == 2:
                weighted = lambda v: (v[0] * DECAY + v[1]) / (DECAY + 1)
                score = max(0.0, min(1.0, weighted(held[3]) * (0.7 + 0.3 * weighted(held[4]))))
                drifts = sim < drift
                settled = not drifts and min(held[3]) >= stable and round(score, 9) >= stable
            if settled and not held[5]:
                held[5], decision, reason = True, "Retrieve", "stable"
            elif drifts and held[5]:
                decision, reason = "Retrieve", "intent drift"
            else:
                decision, reason = "Wait", "building window" if held[1] < 3 else "not stable"
            out.append((int(r.utterance), int(r.idx), decision, reason, stable, drift))
        self.seen.update((n, mean, m2, bins))
        self.open.update(tuple(held))
        yield pd.DataFrame([(key[0], *o) for o in out], columns=["session_id", "utterance", "idx", "decision", "reason", "stable_at", "drift_at"])

    def close(self) -> None:
        pass


def streamed(chunks: DataFrame, rule: Thresholds = Thresholds()) -> DataFrame:
    """The same decisions for a stream; to be started inside :func:`quarryline.streaming.runs.rocks`."""
    return prepared(chunks).groupBy("session_id").transformWithStateInPandas(Production(rule), DECISIONS, "append", "none")
