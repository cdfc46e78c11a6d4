"""Near-duplicates by the similarity of their sets of five-word shingles: SimHash links, completed to Jaccard 0.8.

First come the links of operator 9: 64-bit SimHash fingerprints of the sets within two bits, found by
pigeonring filtering. At Jaccard 0.8 two fingerprints differ in ten bits on average and up to 16 now
and then, a distance at which a pigeonring forces no segment to be equal and selects nothing. So the
pairs beyond two bits are looked up by ``BANDS`` keys of ``ROWS`` min-hashes: two sets of similarity s
share a key with chance 1 - (1 - s^ROWS)^BANDS, 0.99993 at 0.8. For every candidate of either kind the
exact similarity of the texts decides.

Under each key all sets are first compared with one of them, chosen by hash, and those that are still
apart with another one; only sets that these links leave in different groups are then compared with
each other, if enough of their min-hashes agree (a pair at 0.8 fails that with chance 1e-6).

Defined cases: words are those of the SimHash contract; a text of at most five words is one shingle;
null and empty texts have the empty set and are alike; very long texts are taken whole; equal sets,
told by 64-bit hashes, are one node; of rows with equal doc_ids one stays, told by hashes of the row; an
empty table gives an empty result; further columns are kept. Rows go by hashes of what they hold, not by
their place, so that no copy of the texts is stored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm import simhash, wordbpe
from quarryline.llm.components import components
from quarryline.llm.runtime import discard, drop_shuffles, releasing, scratch, stage_table

WIDTH = 5
SIMILAR = (4, 5)  # numerator and denominator of the least similarity
ROWS, BANDS = 5, 24
#: Of the ROWS * BANDS min-hashes, how many must agree for an exact comparison: the mean at 0.8 less 4.8 deviations.
AGREE = 75
#: Sets and shingles of a key that make a block; a task compares two blocks at a time.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20


def shingles(text: bytes) -> np.ndarray:
    """Different hashes of the shingles of ``text``, in order."""
    import xxhash

    words, digest = text.lower().split(), xxhash.xxh64_intdigest
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= WIDTH:
        return np.array([digest(joined)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts[: len(words) - WIDTH + 1].tolist(), (ends[WIDTH - 1 :] - 1).tolist(), strict=True)], np.uint64))


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(42)
    return rng.integers(0, 2**63, (ROWS * BANDS, 1), dtype=np.uint64), rng.integers(0, 2**63, (ROWS * BANDS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(hashes: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The set's min-hash by each function."""
    flip, times = functions
    low = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 512):
        low = np.minimum(low, ((hashes[a : a + 512] ^ flip) * times).min(axis=1))
    return low


def keys(low: np.ndarray) -> np.ndarray:
    """The key in each band of a set with the min-hashes ``low``."""
    out = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def sketches(rows: DataFrame) -> DataFrame:
    """A row per row of ``rows`` (row, also, doc_id, text): hash (same), size and fingerprint of its shingle set, its keys, and a byte of each min-hash, eight to a number."""

    def run(batches):
        import xxhash

        functions = _functions()
        for batch in batches:
            for b in wordbpe.slices(batch, 2):
                sets = [shingles(t) for t in wordbpe.text_bytes(b.column(2))]
                same = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                prints = np.array([simhash.majority(s) for s in sets], np.uint64).view(np.int64)
                lows = [minima(s, functions) for s in sets]
                lists = []
                for width, values in ((BANDS, [keys(x) for x in lows]), (ROWS * BANDS // 8, [((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).view(np.int64) for x in lows])):
                    lists.append(pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * width), pa.array(np.concatenate([np.zeros(0, np.int64), *values]))))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints), *lists, b.column(3)], ["row", "doc_id", "same", "size", "fp", "keys", "bytes", "also"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("row", "doc_id", F.coalesce("text", F.lit("")).alias("text"), "also").mapInArrow(releasing(run), f"row long, doc_id {kind}, same long, size long, fp long, keys array<long>, bytes array<long>, also long")


def similar(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b), a stored table of nodes, whose texts in ``held`` (row, text) are similar; also a stored table."""
    both = pairs.join(held.select(F.col("row").alias("a"), F.col("text").alias("text_a")), "a").join(held.select(F.col("row").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches):
        above, below = SIMILAR
        last, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            close = []
            for a, left, right in zip(batch.column(0).to_pylist(), wordbpe.text_bytes(batch.column(2)), wordbpe.text_bytes(batch.column(3)), strict=True):
                if a != last:
                    last, own = a, shingles(left)
                other = shingles(right)
                common = len(np.intersect1d(own, other, assume_unique=True))
                close.append(common * below >= above * (len(own) + len(other) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(close, pa.bool_()))

    found = stage_table(both.select("a", "b", "text_a", "text_b").mapInArrow(releasing(run), "a long, b long"), "near-links")
    discard(pairs)
    return found


def _fits(x: str, y: str) -> Column:
    """Whether sets of these sizes can be similar."""
    above, below = SIMILAR
    return F.least(x, y) * below >= F.greatest(x, y) * above


def _rooted(sets: DataFrame, found: DataFrame) -> DataFrame:
    """``sets`` with the root of their node in ``found`` (node, root): the node itself if it isn't there."""
    return sets.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _mixed(keyed: DataFrame) -> DataFrame:
    """The rows of ``keyed`` (key, node, size, root) under keys that have sets of different groups."""
    apart = keyed.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")
    return keyed.join(apart, "key").select("key", "node", "size", "root")


def _with_leads(keyed: DataFrame, turn: int) -> DataFrame:
    """(a, b) of every set of ``keyed`` (key, node, size, root) with the one that leads its key this turn, if they are in different groups."""
    lead = F.min(F.struct(F.xxhash64("key", "node", F.lit(turn)).alias("h"), "node", "size", "root")).alias("lead")
    leads = keyed.groupBy("key").agg(lead, F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key", "lead")
    return keyed.join(leads, "key").where((F.col("root") != F.col("lead.root")) & _fits("size", "lead.size")).select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b"))


def _fingerprint_links(sets: DataFrame) -> DataFrame:
    """(a, b) of sets that operator 9 links: those of one fingerprint in a star, and the heads of linked fingerprints."""
    heads = stage_table(sets.groupBy("fp").agg(F.min("node").alias("head")), "near-heads")
    stars = sets.join(heads, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    linked = simhash.links(heads.select("fp")).select(F.col("a").alias("fa"), F.col("b").alias("fb"))
    of = lambda side: heads.select(F.col("fp").alias(f"f{side}"), F.col("head").alias(side))
    across = linked.join(of("a"), "fa").join(of("b"), "fb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return stars.unionAll(across)


def _joined(mixed: DataFrame, held: DataFrame) -> DataFrame:
    """Links (a, b) that join the groups of all similar pairs under each key of ``mixed`` (key, node, size, root, keys, bytes).

    The sets of a key are dealt into blocks; a task holds two of them, with their texts, and gives only
    the links that join what is still apart in it. A pair is compared under its first common key.
    """
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES), F.lit(1)).cast("int")
    sized = mixed.join(mixed.groupBy("key").agg(blocks.alias("blocks")), "key")
    own = F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int")
    texts = sized.join(held.select(F.col("row").alias("node"), "text"), "node")
    dealt = texts.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    dealt = dealt.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    dealt = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node").select("key", "lo", "hi", "own", "node", "root", "size", "keys", "bytes", "text")

    def links(held, key, lo, hi):
        above, below = SIMILAR
        part, node, root, size = (np.array([h[i] for h in held], np.int64) for i in (3, 4, 5, 6))
        bands, marks = np.array([h[7] for h in held], np.int64), np.array([h[8] for h in held], np.int64).view(np.uint8)
        sets: dict[int, np.ndarray] = {}
        parent: dict[int, int] = {}

        def top(x):
            while x in parent:
                x = parent[x]
            return x

        for a in range(0, len(held), 64):
            left = np.arange(a, min(len(held), a + 64))
            near = root[left][:, None] != root
            near &= (part[left][:, None] != part) if lo != hi else True
            near &= node[left][:, None] < node
            near &= np.minimum(size[left][:, None], size) * below >= np.maximum(size[left][:, None], size) * above
            near &= (marks[left][:, None] == marks).sum(axis=2) >= AGREE
            i, j = np.nonzero(near)
            i += a
            same = bands[i] == bands[j]
            mine = bands[i, same.argmax(axis=1)] == key
            for x, y in zip(i[mine].tolist(), j[mine].tolist(), strict=True):
                p, q = top(int(root[x])), top(int(root[y]))
                if p == q:
                    continue
                for k in (x, y):
                    if k not in sets:
                        sets[k] = shingles(held[k][9])
                common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if common * below >= above * (size[x] + size[y] - common):
                    parent[max(p, q)] = min(p, q)
                    yield int(node[x]), int(node[y])

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:9]] + [wordbpe.text_bytes(batch.column(9))]
            out = []
            for row in zip(*columns, strict=True):
                if held and row[:3] != held[0][:3]:
                    out += links(held, *held[0][:3])
                    held = []
                held.append(row)
            yield _pairs(out)
        if held:
            yield _pairs(list(links(held, *held[0][:3])))

    return dealt.mapInArrow(releasing(run), "a long, b long")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(2)], ["a", "b"])


def near(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, root) of the groups that similar ``sets`` (node, size, fp, keys, bytes) make; node is the hash, in ``rows`` (row, text), of a row with the set."""
    spark = sets.sparkSession
    keyed = sets.select("node", F.explode("keys").alias("key"))
    several = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    shared = stage_table(keyed.join(several, "key", "left_semi").select("node").distinct(), "near-nodes")
    drop_shuffles(spark)
    pairs = stage_table(_fingerprint_links(sets).distinct(), "near-pairs")
    drop_shuffles(spark)
    # the texts that any comparison can need, found among all texts once; too many to be sent to all tasks
    nodes = shared.select(F.col("node").alias("row")).unionAll(pairs.select(F.explode(F.array("a", "b")))).distinct()
    held = rows.select("row", F.coalesce("text", F.lit("")).alias("text")).join(nodes.hint("merge"), "row", "left_semi")
    held = stage_table(held.groupBy("row").agg(F.first("text").alias("text")), "near-texts")
    discard(shared)
    drop_shuffles(spark)
    links = similar(pairs, held)
    found = stage_table(components(links), "near-roots")
    # roots are looked up for sets, not for their keys, and only the keys whose sets these links leave apart go on
    rooted = stage_table(_rooted(sets.select("node", "size", "keys"), found), "near-rooted")
    placed = stage_table(_mixed(rooted.select(F.explode("keys").alias("key"), "node", "size", "root")), "near-keys")
    discard(found, rooted)
    drop_shuffles(spark)
    for turn in range(2):
        links = links.unionAll(similar(stage_table(_with_leads(placed, turn).distinct(), "near-pairs"), held))
        drop_shuffles(spark)
        found, before = stage_table(components(links), "near-roots"), placed
        placed = stage_table(_rooted(before.drop("root"), found), "near-keys")
        discard(found, before)
        drop_shuffles(spark)
    mixed = _mixed(placed).join(sets.select("node", "keys", "bytes"), "node").select("key", "node", "size", "root", "keys", "bytes")
    mixed = stage_table(mixed, "near-mixed")
    discard(placed)
    drop_shuffles(spark)
    links = links.unionAll(stage_table(_joined(mixed, held), "near-links"))
    discard(held, mixed)
    drop_shuffles(spark)
    return components(links)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that have the smallest doc_id of their group; of equal doc_ids, one row."""
    every = [F.col(f"`{c}`") for c in docs.columns]
    hashed = [c for c, f in zip(every, docs.schema, strict=True) if "map<" not in f.dataType.simpleString()]
    own = [F.xxhash64(*hashed).alias("row"), F.xxhash64(F.lit(1), *hashed).alias("also")]
    with scratch(docs.sparkSession) as keep:
        rows = docs.select("doc_id", "text", *own)
        sketched = stage_table(sketches(rows), "near-sketches")
        sets = sketched.groupBy("same").agg(F.min(F.struct("doc_id", "row", "also")).alias("first"), *[F.first(c).alias(c) for c in ("size", "fp", "keys", "bytes")])
        sets = stage_table(sets.select("first", F.col("first.row").alias("node"), "size", "fp", "keys", "bytes"), "near-sets")
        discard(sketched)
        found = stage_table(near(sets, rows), "near-roots")
        heads = sets.join(found, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("head")).select("head.row", "head.also")
        heads = stage_table(heads, "near-heads")
        drop_shuffles(docs.sparkSession)
        keep(heads)
    # nearly all rows have one of the heads, which are too many to be sent to all tasks; rows that are equal throughout are one
    names = [f"_c{i}" for i in range(len(every))]
    kept = docs.select(*[c.alias(n) for c, n in zip(every, names, strict=True)], *own).join(heads.hint("merge"), ["row", "also"], "left_semi")
    kept = kept.groupBy("row", "also").agg(F.first(F.struct(*names)).alias("r"))
    return kept.select(*[F.col(f"r.{n}").alias(c) for c, n in zip(docs.columns, names, strict=True)])
