"""A stored vector index by cells, with approximate and exact ranked search.

Cells are the nearest of a number of centroids, fitted by k-means on the unit sphere to a bounded sample
(``Cells.sample`` rows, those of the smallest hashed ids). A row of the index packs up to ``Cells.pack``
vectors of one cell and domain as one matrix, so a large cell is many rows, and a search multiplies packed
queries by packed vectors. An approximate search opens each query's ``probes`` nearest cells. An exact one
first does that to learn the score that a query's last hit must reach, then opens every cell whose angle to
the query, less the cell's own width, still allows it.

Vectors that are null, empty, without length or with non-finite parts have cosine 0 with all others; they
are kept in a cell of their own that only exact searches open.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators.index import ranked

#: Cell of the vectors that have no direction.
NOWHERE = -1
#: Numbers in one matrix of similarities to centroids, and rows in one batch of queries with their cells: what a worker holds doesn't grow with the cells.
NUMBERS, OPENED = 1 << 20, 1 << 13


@dataclass(frozen=True)
class Cells:
    """At most ``most`` cells, of about ``rows`` vectors each; ``sample`` vectors fit them in ``rounds``; matrices hold ``pack`` vectors at most."""

    most: int = 4096
    rows: int = 256
    sample: int = 20_000
    rounds: int = 8
    pack: int = 512


def units(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """(vectors in double precision at length one, which of them have a direction)."""
    size = max((len(v) for v in vectors if v is not None), default=0)
    out = np.zeros((len(vectors), size))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == size and size:
            out[i] = np.asarray([np.nan if x is None else x for x in v], np.float64)
    known = np.isfinite(out).all(axis=1) & (out != 0).any(axis=1) if size else np.zeros(len(vectors), bool)
    out[~known] = 0
    with np.errstate(over="ignore"):
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    odd = known & ~(np.isfinite(length) & (length > 1e-150)).ravel()  # scaled first where squares leave the doubles
    if odd.any():
        out[odd] /= np.abs(out[odd]).max(axis=1, keepdims=True)
        length[odd] = np.sqrt((out[odd] * out[odd]).sum(axis=1, keepdims=True))
    return out / np.where(length == 0, 1, length), known


def centroids(vectors: DataFrame, config: Cells = Cells()) -> np.ndarray:
    """Centroids of ``vectors`` (id, embedding), fitted to the bounded sample; the number goes by all rows."""
    n = vectors.count()
    some = vectors.where("embedding IS NOT NULL").select("embedding", F.xxhash64("id").alias("h")).orderBy("h", F.hash("embedding")).limit(config.sample)
    x, known = units([r.embedding for r in some.toLocalIterator()])
    x = x[known]
    k = max(1, min(config.most, n // config.rows, len(x)))
    if not len(x):
        return np.zeros((1, x.shape[1]))
    rng = np.random.default_rng(11)
    found = x[np.sort(rng.choice(len(x), k, replace=False))]
    step = max(1, NUMBERS // k)
    for _ in range(config.rounds):
        cell = np.concatenate([(x[at : at + step] @ found.T).argmax(axis=1) for at in range(0, len(x), step)])
        total = np.zeros_like(found)
        np.add.at(total, cell, x)
        length = np.sqrt((total * total).sum(axis=1, keepdims=True))
        found = np.where(length > 0, total / np.where(length == 0, 1, length), found)
    return found


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def placed(batches: Iterator[pa.RecordBatch], found: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id, domain, cell, angle, unit) of (id, domain, embedding): the nearest of the centroids ``found``, and the angle to it."""
    for b in _slices(batches, max(1, NUMBERS // len(found))):
        x, known = units(b.column(2).to_pylist())
        if x.shape[1] != found.shape[1]:
            x = np.zeros((b.num_rows, found.shape[1]))
        near = x @ found.T
        cell = near.argmax(axis=1)
        angle = np.arccos(np.clip(near[np.arange(len(x)), cell], -1, 1))
        cell = np.where(known, cell, NOWHERE).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell), pa.array(angle), pa.array([v.tobytes() for v in x], pa.binary())], ["id", "domain", "cell", "angle", "unit"])


def opened(batches: Iterator[pa.RecordBatch], found: np.ndarray, widths: np.ndarray, probes: int | None) -> Iterator[pa.RecordBatch]:
    """(query_id, domain, qv, cell) of (query_id, domain, embedding, least): a row for each cell to open, ``OPENED`` rows or one query's in a batch."""
    for b in _slices(batches, max(1, OPENED // (probes or len(widths)))):
        x, known = units(b.column(2).to_pylist())
        if x.shape[1] != found.shape[1]:
            x, known = np.zeros((b.num_rows, found.shape[1])), np.zeros(b.num_rows, bool)
        rows, cells = [], []
        for i, least in enumerate(b.column(3).to_pylist()):
            angle = np.arccos(np.clip(found @ x[i], -1, 1))
            if probes:
                some = np.argsort(angle, kind="stable")[:probes]
            else:
                # what has no direction has cosine 0 with all
                nearest = np.append(np.cos(np.maximum(angle - widths[:-1], 0)) if known[i] else np.zeros(len(angle)), 0.0)
                some = np.flatnonzero((widths >= 0) & ((nearest >= least - 1e-6) if least is not None else True))
                some = np.where(some == len(angle), NOWHERE, some)
            rows.append(np.full(len(some), i))
            cells.append(some)
        at = pa.array(np.concatenate([np.zeros(0, np.int64), *rows]))
        qv = pa.array([v.tobytes() for v in x], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), qv.take(at), pa.array(np.concatenate([np.zeros(0, np.int64), *cells]).astype(np.int32))], ["query_id", "domain", "qv", "cell"])


def build(vectors: DataFrame, path: str, config: Cells = Cells()) -> VectorIndex:
    """Index ``vectors`` (id, embedding and, if there, domain) into tables below ``path``."""
    rows = vectors if "domain" in vectors.columns else vectors.withColumn("domain", F.lit(0))
    rows = rows.select("id", "domain", "embedding")
    found = centroids(rows, config)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    units_ = rows.mapInArrow(lambda batches: placed(batches, found), f"id {kinds['id']}, domain {kinds['domain']}, cell int, angle double, unit binary")
    spark = vectors.sparkSession
    units_.write.parquet(f"{path}/units")
    stored = spark.read.schema(units_.schema).parquet(f"{path}/units")
    sizes = stored.groupBy("cell", "domain").agg(F.count(F.lit(1)).alias("_n"))
    # a cell's vectors are dealt over as many matrices as it needs, whatever its share of all rows
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / config.pack)).cast("int")
    packs = stored.join(sizes, ["cell", "domain"]).withColumn("part", part).groupBy("cell", "domain", "part").agg(F.sort_array(F.collect_list(F.struct("id", "unit"))).alias("rows"))
    packs.select("cell", "domain", "part", "rows.id", "rows.unit").write.parquet(f"{path}/packs")
    widths = stored.groupBy("cell").agg(F.max("angle").alias("width"), F.count(F.lit(1)).alias("n"))
    widths.coalesce(1).write.parquet(f"{path}/cells")
    return VectorIndex(spark, path, found, config)


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    centroids: np.ndarray
    config: Cells = Cells()

    def packs(self) -> DataFrame:
        """(cell, domain, part, id, unit): ids and unit vectors of up to about ``config.pack`` rows."""
        return self.spark.read.parquet(f"{self.path}/packs")

    def cells(self) -> DataFrame:
        """(cell, width, n): the widest angle of a cell's vectors to its centroid, and how many it has."""
        return self.spark.read.parquet(f"{self.path}/cells")

    def widths(self) -> np.ndarray:
        """Width of each cell, that of the vectors without a direction last; as many numbers as there are cells."""
        out = np.full(len(self.centroids) + 1, -1.0)
        for r in self.cells().toLocalIterator():
            out[r.cell] = max(r.width, 0.0)
        return out

    def _cells(self, queries: DataFrame, probes: int | None) -> DataFrame:
        """(query_id, domain, qv, cell): the cells to open for each of ``queries`` (query_id, domain, embedding, least).

        With ``probes`` the nearest ones, without it all that may hold a cosine of ``least`` or more.
        """
        found, widths = self.centroids, self.widths()
        kinds = {f.name: f.dataType.simpleString() for f in queries.schema.fields}

        return queries.select("query_id", "domain", "embedding", "least").mapInArrow(lambda batches: opened(batches, found, widths, probes), f"query_id {kinds['query_id']}, domain {kinds['domain']}, qv binary, cell int")

    def _scored(self, opened: DataFrame, k: int, prefilter: bool, own: bool) -> DataFrame:
        """(query_id, id, score) of the opened (query_id, domain, qv, cell): the ``k`` best of every pack, queries meeting it in packs too."""
        key = ["cell", "domain"] if prefilter else ["cell"]
        sizes = opened.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / self.config.pack).alias("_n"))
        dealt = opened.join(sizes, key).withColumn("_part", F.pmod(F.xxhash64("query_id"), F.col("_n")))
        asks = dealt.groupBy(*key, "_part").agg(F.collect_list(F.struct("query_id", "qv")).alias("asks"))
        met = self.packs().join(asks, key).select("asks.query_id", "asks.qv", "id", "unit")
        kinds = {f.name: f.dataType.elementType.simpleString() for f in met.schema.fields}
        wide = self.centroids.shape[1]

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    names, qs, ids, us = (batch.column(c)[i].values for c in range(4))
                    q, v = (np.frombuffer(b"".join(x.to_pylist()), np.float64).reshape(len(x), wide) for x in (qs, us))
                    score = np.round(np.clip(q @ v.T, -1, 1), 6) + 0.0
                    if own:
                        score[names.to_numpy(zero_copy_only=False)[:, None] == ids.to_numpy(zero_copy_only=False)[None, :]] = -2
                    best = np.argsort(-score, axis=1, kind="stable")[:, :k]  # ids ascend in a pack: ties go to the smaller
                    line = np.repeat(np.arange(len(q)), best.shape[1])
                    value = score[line, best.ravel()]
                    ok = value > -2
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(line[ok])), ids.take(pa.array(best.ravel()[ok])), pa.array(value[ok])], ["query_id", "id", "score"])

        return met.mapInArrow(run, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")

    def search(self, queries: DataFrame, k: int = 5, probes: int | None = None, prefilter: bool = False, own: bool = True) -> DataFrame:
        """(query_id, id, score, rank): the ``k`` vectors of largest cosine for each of ``queries`` (query_id, embedding and, for ``prefilter``, domain).

        With ``probes`` only that many cells are opened for each query; without it the result is exact. With
        ``prefilter`` only vectors of the query's own domain count; ``own`` leaves out the vector with the query's id.
        """
        asked = queries.select("query_id", F.col("domain") if "domain" in queries.columns else F.lit(0).alias("domain"), "embedding")
        first = self._scored(self._cells(asked.withColumn("least", F.lit(None).cast("double")), probes or 4), k, prefilter, own)
        hits = ranked(first, ["query_id"], F.col("score"), k)
        if probes:
            return hits
        least = hits.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        return ranked(self._scored(self._cells(asked.join(least, "query_id", "left"), None), k, prefilter, own), ["query_id"], F.col("score"), k)
