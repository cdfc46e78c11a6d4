"""SimHash near-duplicates found by pigeonring filtering.

A 64-bit fingerprint is cut into ``SEGMENTS`` segments on a ring. If two fingerprints differ in at
most ``distance`` bits, some segment starts a chain around the ring in which the first l segments
differ in at most l * distance / SEGMENTS bits, for every l. The leading segments that the budget
forces to be equal form the search key, the rest of the chain prunes candidates, and the full
Hamming distance decides.

A key that many different fingerprints share isn't paired out: there each fingerprint is listed
under itself and its one-bit neighbours, and two within two bits meet under one of these, in groups
of at most 65.

Defined cases: null and empty texts have fingerprint zero, which links like any other; a very long
text is hashed whole, in parts; a bit set in just half of the shingles is 0; repeated rows share a fingerprint and so a component; a component without any doc_id has component_id null; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.components import components
from quarryline.llm.runtime import releasing, scratch, stage_table

SEGMENTS = 5
DISTANCE = 2
#: Different fingerprints under one key beyond which it is searched by neighbours instead of pairs.
CROWDED = 48


def fingerprint(text: str | None, seed: int = 42, width: int = 3) -> int:
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and white space as in the contract
    if not words:
        return 0
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        joined, digest = b" ".join(words), xxhash.xxh64_intdigest
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[:-1]])
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)]
    return majority(np.array(hashes, dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the 64-bit ``hashes``."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = hashes[k : k + (1 << 14)].astype("<u8", copy=False)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each row of ``docs`` (doc_id, text)."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(releasing(run), f"doc_id {kind}, fp long")


def _cuts(segments: int) -> list[tuple[int, int]]:
    ends = [round(64 * i / segments) for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def _segment(fp: Column, i: int) -> Column:
    at, width = _cuts(SEGMENTS)[i % SEGMENTS]
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))


def _forced(distance: int) -> int:
    """Leading segments of a chain whose budget is below one bit."""
    return max(n for n in range(SEGMENTS + 1) if n * distance < SEGMENTS)


def _chain(a: Column, b: Column, start: int, distance: int) -> Column:
    """Whether every beginning of the chain at ``start`` is within its share of ``distance``."""
    ok, total = F.lit(True), F.lit(0)
    for n in range(1, SEGMENTS + 1):
        total = total + F.bit_count(_segment(a, start + n - 1).bitwiseXOR(_segment(b, start + n - 1)))
        ok = ok & (total * SEGMENTS <= n * distance)
    return ok


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b) that connect all different fingerprints of ``fps`` (fp) within ``distance`` (at most 2) bits."""
    forced = _forced(distance)
    keys = []
    for i in range(SEGMENTS):
        key = F.lit(i).cast("long")
        for n in range(forced):
            key = F.shiftleft(key, _cuts(SEGMENTS)[(i + n) % SEGMENTS][1]).bitwiseOR(_segment(F.col("fp"), i + n))
        keys.append(F.struct(F.lit(i).alias("i"), key.alias("key")))
    keyed = fps.select("fp", F.inline(F.array(*keys)))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stage_table(keyed.join(sizes, "key"), "simhash-keys")
    lists = shared.where(F.col("n") <= CROWDED).groupBy("i", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = F.flatten(F.transform("fps", lambda a, k: F.transform(F.slice("fps", k + 2, F.size("fps")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    chains = F.lit(False)
    for i in range(SEGMENTS):
        chains = chains | ((F.col("i") == i) & _chain(F.col("a"), F.col("b"), i, distance))
    near = lambda p: F.bit_count(p["a"].bitwiseXOR(p["b"])) <= distance
    close = lists.select("i", F.explode(F.filter(pairs, near)).alias("p")).select("i", "p.a", "p.b").where(chains).select("a", "b")
    crowded = shared.where(F.col("n") > CROWDED).select("fp").distinct()
    if distance > 1:
        around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63))) for b in range(64)])
        met = crowded.select("fp", F.explode(around).alias("at")).groupBy("at").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    else:
        around = F.array(*[F.col("fp").bitwiseAND(F.lit(~(1 << b) if b < 63 else (1 << 63) - 1)) for b in range(64)])
        met = crowded.select("fp", F.posexplode(around).alias("bit", "at")).groupBy("bit", "at").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    star = F.transform(F.slice("fps", 2, F.greatest(F.size("fps") - 1, F.lit(0))), lambda b: F.struct(F.element_at("fps", 1).alias("a"), b.alias("b")))
    return close.unionAll(met.where(F.size("fps") > 1).select(F.inline(star))).distinct()


def near_groups(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``; component_id is the smallest doc_id reachable."""
    with scratch(docs.sparkSession) as keep:
        table = stage_table(fingerprints(docs), "simhash")
        classes = stage_table(table.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
        found = stage_table(components(links(classes.select("fp"), distance)), "simhash-roots")
        rooted = classes.join(found, classes.fp == found.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
        firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
        ids = stage_table(rooted.join(firsts, "root").select("fp", "component_id"), "simhash-ids")
        keep(table)
        keep(ids)
    return table.join(ids, "fp").select("doc_id", "fp", "component_id")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
