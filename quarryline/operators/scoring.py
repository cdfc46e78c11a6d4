"""Scores that need a sequence or a budget, and JSON found in a model's reply."""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def longest_common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one row of the table at a time."""
    if not a or not b:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(b))}
    right = np.array([number[w] for w in b])
    row = np.zeros(len(b) + 1, np.int64)
    for w in a:
        hit = np.where(right == number.get(w, -1), row[:-1] + 1, 0)
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], hit))
    return int(row[-1])


def rouge_l(prediction: str, target: str) -> float:
    p, t = (re.findall("[a-z0-9]+", (x or "").lower()) for x in (prediction, target))
    n = longest_common(p, t)
    return 2 * n / (len(p) + len(t)) if n else 0.0


@cache
def _pairwise(name: str):
    f = {"rouge_l": rouge_l, "extractive": lambda p, t: 1.0 if (p or "") in (t or "") else rouge_l(p, t)}[name]
    return F.pandas_udf(lambda a, b: a.combine(b, f), T.DoubleType())


def rouge(prediction: Column, target: Column) -> Column:
    return _pairwise("rouge_l")(prediction, target)


def extractiveness(prediction: Column, passage: Column) -> Column:
    """1 if the prediction stands in the passage, else its ROUGE-L with it."""
    return _pairwise("extractive")(prediction, passage)


def first_json(text: str | None) -> str | None:
    """The first JSON object or array in a text, fenced or not, as compact JSON."""
    if not text:
        return None
    fence = re.search(r"```(?:json)?\s*(.+?)```", text, re.S)
    body = fence[1] if fence else text
    body = re.sub(r'\\(?!["\\/bfnrtu])', "", body)
    reader = json.JSONDecoder()
    for m in re.finditer(r"[{\[]", body):
        try:
            return json.dumps(reader.raw_decode(body, m.start())[0], separators=(",", ":"))
        except ValueError:
            continue
    return None


@cache
def _json():
    return F.pandas_udf(lambda s: s.map(first_json), T.StringType())


def found_json(text: Column) -> Column:
    return _json()(text)


def within_budget(rows: DataFrame, group: str, order: list[str], size: str, budget: int) -> DataFrame:
    """Rows taken in order while they fit what is left of the budget; a row too large is passed over.

    Greedy in order, so each group is folded as one array; a group is one request's candidates.
    """
    made = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(size).cast("long").alias("_size")))).alias("c"))
    kind = made.schema["c"].dataType
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast(kind).alias("kept"))

    def step(s, x):
        fits = x["_size"] <= s["left"]
        return F.struct(F.when(fits, s["left"] - x["_size"]).otherwise(s["left"]).alias("left"), F.when(fits, F.concat(s["kept"], F.array(x))).otherwise(s["kept"]).alias("kept"))

    kept = F.aggregate("c", start, step, lambda s: s["kept"])
    return made.select(group, F.explode(kept).alias("x")).select(group, *[f"x.{o}" for o in order], F.col("x._size").alias(size))


class Breaker:
    """Stops calling a failing service: open after ``failures`` in a row, one trial after ``wait_s``."""

    def __init__(self, failures: int = 3, wait_s: float = 30.0, clock=None):
        import time

        self.failures, self.wait_s, self.clock = failures, wait_s, clock or time.monotonic
        self.count, self.opened = 0, None

    @property
    def state(self) -> str:
        if self.opened is None:
            return "closed"
        return "half-open" if self.clock() - self.opened >= self.wait_s else "open"

    def call(self, f, *args):
        if self.state == "open":
            raise RuntimeError("the service is not being called")
        try:
            out = f(*args)
        except Exception:
            self.count += 1
            if self.count >= self.failures or self.opened is not None:
                self.opened = self.clock()
            raise
        self.count, self.opened = 0, None
        return out
