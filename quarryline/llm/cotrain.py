"""Quality classifier by co-training of two views.

One classifier sees measures of a document's whole text, the other its metadata (language, source,
stated length). Both are logistic regressions, fitted on a bounded sample of labelled documents. Both
views are worked out once for all documents and written. In each round every view scores all
documents without a label and labels those that it is most sure of, as many of either class as its
prior has it and no more than the round's bound, for the other view to learn from at a lower weight.
At the end both are calibrated on labelled documents kept apart, their calibrated log-odds are
combined by a last regression on these, and every document is scored by one expression. A further
part of the labelled documents takes no part in any of this; ``Model.held_out`` is the accuracy on it.

Defined cases: null and empty texts have zero measures and are scored like others; very long texts
are measured whole; null metadata is a value of its own; labels of one document count once, their
mean decides (a tie is good), null ones don't; of rows with one doc_id, one is learned from and all
are scored; equally sure documents are taken in the order of a hash of doc_id; with no labels, or one
class only, all documents have the score 1 and are kept; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.quality_rules import WHITE_CHARS, words_of
from quarryline.llm.runtime import discard, stage_table


@dataclass(frozen=True)
class CoTraining:
    """``labelled``: most labelled documents fitted, by hash of doc_id. ``per_round``: documents that a view labels in the first round, twice as many in the second, and so on. ``sure``: least probability to label for the other view."""

    labelled: int = 6000
    rounds: int = 4
    per_round: int = 300
    sure: float = 0.95
    weight: float = 0.5
    ridge: float = 1.0
    threshold: float = 0.5
    buckets: int = 16


@dataclass
class Model:
    """Log-odds of a good document: intercept and weights for each view, and for their calibrated values."""

    views: dict[str, np.ndarray] = field(default_factory=dict)
    final: np.ndarray | None = None
    held_out: float | None = None


#: Characters counted by group; upper case letters come last.
COUNTED = ("#*$%&", "|<>", "!?", "0123456789", ".,;", "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÉÈÑÓÍÄÖÜ")


def content_view(text: Column) -> list[Column]:
    """Measures of a whole text; none looks at the metadata."""
    body = F.coalesce(text, F.lit(""))
    words = words_of(body)
    n, w = F.greatest(F.length(body), F.lit(1)).cast("double"), F.greatest(F.size(words), F.lit(1)).cast("double")
    rest = F.regexp_replace(body, "[^" + "".join(COUNTED) + "]+", "")  # short, so that counting in it is cheap
    share = lambda chars: (F.length(rest) - F.length(F.translate(rest, chars, ""))) / n
    solid = F.length(F.translate(body, WHITE_CHARS, ""))
    lines = F.split(body, "\n", -1)
    return [
        F.log1p(F.size(words).cast("double")),
        F.log1p((F.length(body) - solid) / w),
        F.size(F.array_distinct(words)) / w,
        solid / w / 10,
        *map(share, COUNTED),
        F.size(F.filter(words, lambda x: x.endswith("."))) / w,
        F.size(lines) / w,
        F.size(F.array_distinct(lines)) / F.size(lines),
    ]


def metadata_view(lang: Column, source: Column, n_chars: Column, buckets: int) -> list[Column]:
    length = F.log1p(F.greatest(F.coalesce(n_chars, F.lit(0)), F.lit(0)).cast("double"))
    hot = lambda c, k: [(F.pmod(F.xxhash64(F.coalesce(c, F.lit("\0"))), F.lit(k)) == i).cast("double") for i in range(k)]
    return [length, length * length / 10, *hot(lang, 8), *hot(source, buckets)]


def with_views(docs: DataFrame, rule: CoTraining, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the arrays _content and _metadata, as a stored table."""
    return stage_table(viewed(docs, rule, keep), "views")


def viewed(docs: DataFrame, rule: CoTraining, keep: tuple[str, ...]) -> DataFrame:
    have = set(docs.columns)
    column = lambda name, kind: F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
    meta = metadata_view(column("lang", "string"), column("source", "string"), column("n_chars", "long"), rule.buckets)
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.array(*content_view(F.col("text"))).alias("_content"), F.array(*meta).alias("_metadata"))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Logistic regression by Newton steps; intercept first, inputs standardised inside."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd < 1e-9] = 1.0
    z = np.concatenate([np.ones((len(x), 1)), (x - mean) / sd], axis=1)
    b, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (weight * (y - p)) - penalty * b
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9)
        step = np.linalg.solve(h, g)
        b = b + step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    out = b.copy()
    out[1:] = b[1:] / sd
    out[0] -= (out[1:] * mean).sum()
    return out


def log_odds(b: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip(b[0] + x @ b[1:], -30, 30)


def parts_of(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of ``n`` labelled rows are for fitting, for calibration and held out: five, two and one of eight."""
    turn = np.arange(n) % 8
    return turn < 5, (turn == 5) | (turn == 6), turn == 7


def co_train(views: dict[str, np.ndarray], y: np.ndarray, surest, rule: CoTraining) -> Model:
    """Fit on labelled rows; ``surest(name, b, n_good, n_bad)`` gives the views of the unlabelled documents that a view with weights ``b`` is most sure of, good ones first, and their labels."""
    own, apart, held = parts_of(len(y))
    names = list(views)
    prior = float(np.clip(y[own].mean(), 0.02, 0.98))
    extra: dict = {v: None for v in names}

    def fitted(v):
        x, labels = (np.zeros((0, views[v].shape[1])), np.zeros(0)) if extra[v] is None else extra[v]
        w = np.concatenate([np.ones(own.sum()), np.full(len(x), rule.weight)])
        return fit(np.concatenate([views[v][own], x]), np.concatenate([y[own], labels]), w, rule.ridge)

    model = {v: fitted(v) for v in names}
    for turn in range(rule.rounds):
        most = rule.per_round * (turn + 1)
        given = {v: surest(v, model[v], int(most * prior), int(most * (1 - prior))) for v in names}
        for v in names:
            others = [given[u] for u in names if u != v]
            extra[v] = (np.concatenate([o[0][v] for o in others]), np.concatenate([o[1] for o in others]))
        model = {v: fitted(v) for v in names}
    ones = np.ones(apart.sum())
    calibrated = {v: fit(log_odds(model[v], views[v][apart])[:, None], y[apart], ones, 0.1) for v in names}
    views_of = {v: np.concatenate([[calibrated[v][0] + calibrated[v][1] * model[v][0]], calibrated[v][1] * model[v][1:]]) for v in names}
    joint = lambda rows: np.stack([log_odds(views_of[v], views[v][rows]) for v in names], axis=1)
    final = fit(joint(apart), y[apart], ones, rule.ridge)
    right = ((log_odds(final, joint(held)) > 0) == (y[held] > 0.5)).mean()
    return Model(views_of, final, float(right))


def _odds(b: np.ndarray, values: str) -> Column:
    """Log-odds of the array ``values``."""
    out = F.lit(float(b[0]))
    for i, w in enumerate(b[1:].tolist()):
        out = out + F.lit(w) * F.col(values)[i]
    return F.least(F.lit(30.0), F.greatest(F.lit(-30.0), out))


def train(table: DataFrame, labels: DataFrame, rule: CoTraining = CoTraining()) -> Model:
    """Fit on a sample of ``labels`` (doc_id, quality) and on all rows of ``table`` (doc_id, _content, _metadata), a stored table."""
    order = F.xxhash64("doc_id")
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.avg(F.col("quality").cast("double")) >= 0.5).cast("double").alias("_y"))
    known = known.orderBy(order, "doc_id").limit(rule.labelled)  # a bounded sample of labelled rows
    names = ["content", "metadata"]
    # of rows with one doc_id the one with the smallest views
    sample = table.join(F.broadcast(known), "doc_id").groupBy("doc_id", "_y").agg(F.min(F.struct("_content", "_metadata")).alias("v"))
    rows = sorted(tuple(r) for r in sample.select("doc_id", "_y", "v._content", "v._metadata").collect())
    rows.sort(key=lambda r: _shuffled(r[0]))
    y = np.array([r[1] for r in rows])
    one_class = lambda part: not 0 < y[part].mean() < 1 if part.any() else True
    if len(rows) < 16 or one_class(parts_of(len(y))[0]) or one_class(parts_of(len(y))[1]):
        return Model()
    views = {v: np.array([r[i] for r in rows], float) for i, v in enumerate(names, 2)}
    free = table.where("doc_id IS NOT NULL").join(F.broadcast(known.select("doc_id")), "doc_id", "left_anti")

    def surest(v, b, n_good, n_bad):
        odds = free.select("doc_id", "_content", "_metadata", _odds(b, f"_{v}").alias("_odds"))
        least = float(np.log(rule.sure / (1 - rule.sure)))
        best = odds.where(F.col("_odds") >= least).orderBy(F.desc("_odds"), order, "doc_id", "_content", "_metadata").limit(n_good)
        worst = odds.where(F.col("_odds") <= -least).orderBy("_odds", order, "doc_id", "_content", "_metadata").limit(n_bad)
        found = best.withColumn("_y", F.lit(1.0)).unionAll(worst.withColumn("_y", F.lit(0.0))).collect()  # at most the round's bound
        found.sort(key=lambda r: (-r["_y"], -abs(r["_odds"]), _shuffled(r["doc_id"]), r["doc_id"]))
        return {u: np.array([r[f"_{u}"] for r in found], float).reshape(len(found), views[u].shape[1]) for u in names}, np.array([r["_y"] for r in found])

    return co_train(views, y, surest, rule)


def _shuffled(doc_id: int) -> int:
    """A fixed order of ids that has nothing to do with their size."""
    return zlib.crc32(str(doc_id).encode())


def scored(docs: DataFrame, labels: DataFrame, rule: CoTraining = CoTraining(), keep: tuple[str, ...] | None = None, again: bool = False) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if not given) with content_score, metadata_score, score and kept, by a model trained on ``labels`` and ``docs``.

    ``again``: the result reads ``docs`` alone and works its views out once more; no copy of the texts is stored beside them.
    """
    keep = tuple(docs.columns) if keep is None else keep
    table = with_views(docs, rule, ("doc_id",) if again else keep)
    model = train(table, labels, rule)
    rows = table.select(*[F.col(f"`{c}`") for c in keep], "_content", "_metadata") if not again else viewed(docs, rule, keep)
    if again:
        discard(table)
        # taken from a generated column, as a filter on the score would else be worked out below the views, each from the text
        rows = rows.withColumn("_views", F.explode(F.array(F.struct("_content", "_metadata")))).withColumns({c: F.col(f"_views.{c}") for c in ("_content", "_metadata")}).drop("_views")
    if model.final is None:
        return rows.drop("_content", "_metadata").withColumns({"content_score": F.lit(1.0), "metadata_score": F.lit(1.0), "score": F.lit(1.0), "kept": F.lit(True)})
    chance = lambda x: 1 / (1 + F.exp(-x))
    odds = {name: _odds(model.views[name], f"_{name}") for name in ("content", "metadata")}
    df = rows.withColumns({f"_{name}_odds": x for name, x in odds.items()}).withColumn("_both", F.array("_content_odds", "_metadata_odds"))
    df = df.withColumns({"content_score": chance(F.col("_content_odds")), "metadata_score": chance(F.col("_metadata_odds")), "score": chance(_odds(model.final, "_both"))})
    return df.withColumn("kept", F.col("score") >= rule.threshold).drop("_content", "_metadata", "_content_odds", "_metadata_odds", "_both")


def op10_cotrain(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scored(docs, labels, keep=("doc_id",)).select("doc_id", "content_score", "metadata_score", "score", "kept")
