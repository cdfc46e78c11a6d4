"""Near-duplicate vectors by E8 lattice hashing.

Equal vectors are one class. Several tables project a class's unit vector to 16 dimensions and decode
the two halves to their nearest E8 lattice points; the pair of points is its cell. A class is listed
in its own cell and in the nearest neighbouring cells. Classes that meet in a cell are compared by a
sketch of projection signs first, and by cosine in double precision in the end; only pairs at or above
the threshold are links.

A cell with very many classes is divided into blocks of ``block`` classes; each row goes to one task per
pair of blocks that its own belongs to, so no task holds more than two blocks and all pairs are compared.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of different lengths don't link; repeated rows link with each other; a null vec_id
has no component_id of its own (the smallest vec_id of its component, else null) and isn't kept; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.components import components
from quarryline.llm.runtime import discard, releasing, scratch, stage_table


@dataclass(frozen=True)
class Lattice:
    """``tables`` of cells ``scale`` wide, each class in ``probes`` + 1 cells of each; ``signs``: bits of the sketch."""

    threshold: float = 0.95
    tables: int = 8
    scale: float = 0.3
    probes: int = 5
    signs: int = 128
    slack: float = 6.0
    block: int = 1024
    seed: int = 8


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: signed pairs of coordinates, and halves with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i + 1, 8):
            for a in (-1.0, 1.0):
                for b in (-1.0, 1.0):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        if bits.bit_count() % 2 == 0:
            out.append(np.array([-0.5 if bits >> i & 1 else 0.5 for i in range(8)]))
    return np.array(out)


ROOTS = _roots()


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum: round, and where the sum is odd move the worst-rounded coordinate the other way."""
    r = np.rint(x)
    off = x - r
    odd = np.flatnonzero(r.sum(axis=1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(axis=1)
    r[odd, worst] += np.where(off[odd, worst] < 0, -1.0, 1.0)
    return r


def nearest_point(x: np.ndarray) -> np.ndarray:
    """The E8 point nearest to each row of 8: the better of the whole and the half-odd coset."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def _name(points: np.ndarray, table: int) -> np.ndarray:
    """A 64-bit name of each row of 16 half-integers."""
    h = np.full(len(points), 0x9E3779B97F4A7C15 * (table + 1) % (1 << 64), np.uint64)
    for c in range(points.shape[1]):
        h = (h ^ (2 * points[:, c]).astype(np.int64).view(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def cells(unit: np.ndarray, rule: Lattice) -> np.ndarray:
    """(rows, tables * (probes + 1)) names of the cells that each unit vector is listed in."""
    n, dim = unit.shape
    out = []
    for table in range(rule.tables):
        rng = np.random.default_rng((rule.seed, dim, table))
        basis = np.linalg.qr(rng.standard_normal((max(dim, 16), 16)))[0][:dim]
        x = unit @ basis * (np.sqrt(dim / 16) / rule.scale / 2) + rng.random(16)
        halves = [nearest_point(x[:, :8]), nearest_point(x[:, 8:])]
        gains = np.concatenate([(x[:, :8] - halves[0]) @ ROOTS.T, (x[:, 8:] - halves[1]) @ ROOTS.T], axis=1)
        near = np.argsort(-gains, axis=1, kind="stable")[:, : rule.probes] if rule.probes else np.zeros((n, 0), np.int64)
        own = np.concatenate(halves, axis=1)
        out.append(_name(own, table))
        for p in range(rule.probes):
            moved = own.copy()
            side, root = near[:, p] // len(ROOTS), near[:, p] % len(ROOTS)
            moved[side == 0, :8] += ROOTS[root[side == 0]]
            moved[side == 1, 8:] += ROOTS[root[side == 1]]
            out.append(_name(moved, table))
    return np.stack(out, axis=1)


def sketches(unit: np.ndarray, rule: Lattice) -> np.ndarray:
    """(rows, signs / 64) words of projection signs."""
    rng = np.random.default_rng((rule.seed, unit.shape[1], 1 << 20))
    bits = unit @ rng.standard_normal((unit.shape[1], rule.signs)) > 0
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")


def most_differing(rule: Lattice) -> int:
    """Sketch bits that a pair at the threshold may differ in: the mean and ``slack`` deviations."""
    p = float(np.arccos(rule.threshold) / np.pi)
    return int(rule.signs * p + rule.slack * np.sqrt(rule.signs * p * (1 - p)))


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, dtype=np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _listed(classes: DataFrame, rule: Lattice) -> DataFrame:
    """(cell, node, s0, s1 ...) of every class in each of its cells."""
    words = rule.signs // 64

    def run(batches):
        for batch in batches:
            nodes, vectors = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            sizes = np.array([len(v) for v in vectors])
            for dim in np.unique(sizes).tolist():
                some = np.flatnonzero(sizes == dim)
                for k in range(0, len(some), 2048):
                    at = some[k : k + 2048]
                    unit = _unit([vectors[i] for i in at.tolist()])
                    names, sketch = cells(unit, rule), sketches(unit, rule)
                    width = names.shape[1]
                    columns = [names.ravel(), np.repeat(nodes[at], width), *(np.repeat(sketch[:, w], width) for w in range(words))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cell", "node", *(f"s{w}" for w in range(words))])

    return classes.select("node", "vector").mapInArrow(releasing(run), "cell long, node long, " + ", ".join(f"s{w} long" for w in range(words)))


def candidates(listed: DataFrame, rule: Lattice) -> DataFrame:
    """Different (a, b), a < b, that meet in a cell and whose sketches are close enough."""
    words, most = rule.signs // 64, most_differing(rule)
    sizes = listed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = listed.join(stage_table(sizes, "lattice-sizes"), "cell")
    blocks = F.ceil(F.col("n") / rule.block).cast("int")
    own = F.pmod(F.xxhash64("node", "cell"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    dealt = sized.withColumns({"_own": own, "_other": other}).withColumns({"lo": F.least("_own", "_other"), "hi": F.greatest("_own", "_other"), "first": F.col("_own") <= F.col("_other")})
    dealt = dealt.repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi").select("cell", "lo", "hi", "_own", "node", *(f"s{w}" for w in range(words)))

    def pairs(own, nodes, sketch, lo, hi):
        """Within a block, or between two."""
        left = np.flatnonzero(own == lo)
        right = left if lo == hi else np.flatnonzero(own == hi)
        for k in range(0, len(left), 512):
            some = left[k : k + 512]
            apart = sum(np.bitwise_count(sketch[some, w][:, None] ^ sketch[right, w][None, :]).astype(np.int16) for w in range(words))
            i, j = np.nonzero(apart <= most)
            a, b = nodes[some[i]], nodes[right[j]]
            a, b = np.minimum(a, b), np.maximum(a, b)
            yield np.unique(np.stack([a, b], axis=1)[a != b], axis=0)

    def run(batches):
        held, name = [], None

        def close():
            m = np.concatenate(held, axis=0)
            return pairs(m[:, 0], m[:, 1], m[:, 2:].view(np.uint64), name[1], name[2])

        found, amount = [], 0
        for batch in batches:
            m = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)
            cut = np.flatnonzero((m[1:, :3] != m[:-1, :3]).any(axis=1)) + 1
            for part in np.split(m, cut):
                own = tuple(part[0, :3].tolist())
                if name is not None and own != name:
                    for p in close():
                        found.append(p)
                        amount += len(p)
                    held = []
                    if amount > 1 << 16:
                        ab = np.unique(np.concatenate(found), axis=0)
                        found, amount = [], 0
                        yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])
                name = own
                held.append(part[:, 3:])
        if held:
            found += list(close())
        if found:
            ab = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])

    return dealt.mapInArrow(releasing(run), "a long, b long").distinct()


def verified(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) whose cosine is at or above ``threshold``."""

    def run(batches):
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = np.zeros(len(a), bool)
            lengths = np.array([len(x) if len(x) == len(y) else -1 for x, y in zip(a, b, strict=True)])
            for dim in np.unique(lengths[lengths >= 0]).tolist():
                at = np.flatnonzero(lengths == dim)
                x, y = (np.array([v[i] for i in at.tolist()], np.float64) for v in (a, b))
                cos = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
                keep[at] = cos >= threshold
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    of = lambda side: classes.select(F.col("node").alias(side), F.col("vector").alias(f"v{side}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "va", "vb").mapInArrow(run, "a long, b long")


def near_vectors(rows: DataFrame, rule: Lattice = Lattice()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``rows`` (vec_id, embedding); vec_id is whole-numbered."""
    x = F.col("embedding")
    sound = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    vector = F.when(F.coalesce(sound, F.lit(False)), F.transform(x, lambda c: c.cast("double") + 0.0))
    base = rows.select(F.col("vec_id"), vector.alias("vector")).withColumn("node", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")))
    with scratch(rows.sparkSession) as keep:
        classes = stage_table(base.where("node IS NOT NULL").groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"), F.min("vector").alias("vector")), "lattice-classes")
        pairs = stage_table(candidates(_listed(classes, rule), rule), "lattice-pairs")
        links = stage_table(verified(pairs, classes, rule.threshold), "lattice-links")
        discard(pairs)
        both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        others = both.join(classes.select(F.col("node").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("linked")).withColumnRenamed("a", "node")
        roots = components(links)
        info = classes.join(others, "node", "left").join(roots, "node", "left").select("node", "n", "first", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("root", "node").alias("root"))
        info = stage_table(info, "lattice-info")
        info = stage_table(info.join(info.groupBy("root").agg(F.min("first").alias("component")), "root").select("node", "n", "linked", "component"), "lattice-info")
        keep(info)
    out = base.select("vec_id", "node").join(info, "node", "left")
    component = F.when(F.col("n").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce(F.col("n") - 1 + F.col("linked"), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op6_lattice(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS r FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / (a.r * b.r) >= 0.95),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
k AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT vec_id, coalesce(k, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN k ON k.a = vec_id
"""
