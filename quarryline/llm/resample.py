"""Importance resampling towards a target distribution, by hashed word runs.

A text's UTF-8 bytes are worked on where Arrow holds them: a lookup table says which bytes belong to
words, word boundaries are where this changes or a text begins, and a table-driven CRC-32 advances over
all words of a slice at once, byte by byte; a run of two words carries on from the state that its first
word ended in. Features are counted in a fixed number of buckets, so all that is known of the corpus
and of the target are two count tables of bounded size. A document's weight is the mean log ratio of its
features' buckets; it is drawn by weight plus Gumbel noise keyed by its id (sampling without replacement).

Words are runs of digits, letters a to z once A to Z are in lower case, and all characters beyond ASCII.

Defined cases: a null or empty text has no features and weight 0; a very long text is worked on whole,
and a very long word's end by a plain CRC; ties in the score go to the smaller doc_id; repeated rows are
drawn one by one; a null doc_id is hashed as an empty one and comes last among equal scores; empty
tables give empty results, an empty target counts as one without features; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm import wordbpe
from quarryline.llm.runtime import releasing, stage_table

ONES = np.uint32(0xFFFFFFFF)
#: Bytes of a word that all words of a slice advance over side by side; what is longer ends one by one.
STEPS = 64


@dataclass(frozen=True)
class Resampling:
    """``percent`` of the documents with at least ``least_words`` words are drawn, features being hashed into ``buckets``."""

    buckets: int = 10_000
    percent: int = 25
    least_words: int = 20
    seed: int = 7


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(CRC-32 of each byte, lower case of each byte, whether each byte belongs to words)."""
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, np.uint32(0xEDB88320) ^ (crc >> np.uint32(1)), crc >> np.uint32(1))
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    word = np.zeros(256, bool)
    word[48:58] = word[65:91] = word[97:123] = word[128:] = True
    return crc, lower, word


_CRC, _LOWER, _WORD = _tables()


def advance(state: np.ndarray, data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC states after ``sizes`` bytes of ``data`` from ``at`` on, all of them one byte a step."""
    short = np.minimum(sizes, STEPS + 1).astype(np.uint8)
    order = np.argsort(STEPS + 1 - short, kind="stable")  # the longest first: those still advancing are a prefix
    x, place = state[order], at[order]
    going = len(order) - np.cumsum(np.bincount(short, minlength=STEPS + 2))
    for j in range(STEPS):
        k = int(going[j])
        if not k:
            break
        x[:k] = _CRC[(x[:k] ^ data[place[:k] + j]) & np.uint32(255)] ^ (x[:k] >> np.uint32(8))
    for i in range(int(going[STEPS])):
        rest = data[place[i] + STEPS : place[i] + sizes[order[i]]]
        x[i] = zlib.crc32(rest, int(x[i] ^ ONES)) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[order] = x
    return out


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of a string column, where each text begins, and the end of the last); a null is empty."""
    texts = texts.cast(pa.large_string())
    texts = texts.fill_null("") if texts.null_count else texts
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where words begin, their sizes, how many each text has)."""
    inside = _WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = bounds[:-1][np.diff(bounds) > 0]
    first[cut] = inside[cut]
    last[cut[1:] - 1] = inside[cut[1:] - 1]
    begin = np.flatnonzero(first)
    return begin, np.flatnonzero(last) + 1 - begin, np.diff(np.searchsorted(begin, bounds))


def features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word, bucket of each run of two words, how many words each text has)."""
    data, bounds = _buffers(texts)
    begin, sizes, counts = words(data, bounds)
    data = _LOWER[data]
    one = advance(np.full(len(begin), ONES), data, begin, sizes)
    ends = np.cumsum(counts)
    second = np.ones(len(begin), bool)  # words with another before them in their text
    second[(ends - counts)[counts > 0]] = False
    at = np.flatnonzero(second)
    spaced = one[at - 1]
    spaced = _CRC[(spaced ^ np.uint32(32)) & np.uint32(255)] ^ (spaced >> np.uint32(8))
    two = advance(spaced, data, begin[at], sizes[at])
    return (one ^ ONES) % np.uint32(buckets), (two ^ ONES) % np.uint32(buckets), counts


def bucket_counts(texts: DataFrame, config: Resampling = Resampling()) -> DataFrame:
    """(bucket, n) over all features of ``texts`` (text); each task adds up its own part first."""

    def run(batches):
        total = np.zeros(config.buckets, np.int64)
        for batch in batches:
            for b in wordbpe.slices(batch, 0, 1 << 20):
                one, two, _ = features(b.column(0), config.buckets)
                total += np.bincount(one, minlength=config.buckets) + np.bincount(two, minlength=config.buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    parts = texts.select("text").mapInArrow(releasing(run), "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, config: Resampling = Resampling()) -> np.ndarray:
    """Log ratio of target and raw counts of each bucket, in whole thousandths; ``config.buckets`` numbers reach the driver."""
    s, t = np.zeros(config.buckets), np.zeros(config.buckets)
    for into, counts in ((s, raw), (t, target)):
        for bucket, n in counts.toLocalIterator():
            into[bucket] = n
    all_s, all_t = float(s.sum()) + config.buckets, float(t.sum()) + config.buckets
    return np.array([math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, config: Resampling = Resampling()) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row of ``docs`` (doc_id, text)."""

    def run(batches):
        for batch in batches:
            for b in wordbpe.slices(batch, 1, 1 << 20):
                one, two, n = features(b.column(1), config.buckets)
                pairs = np.maximum(n - 1, 0)
                total = np.zeros(len(n), np.int64)
                for bucket, counts in ((one, n), (two, pairs)):
                    sums = np.concatenate([[0], np.cumsum(gain[bucket])])
                    total += np.diff(sums[np.concatenate([[0], np.cumsum(counts)])])
                weight = total // np.maximum(n + pairs, 1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(n + pairs), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(releasing(run), "doc_id long, n_words long, n_features long, weight long")


def noisy(weights: DataFrame, config: Resampling = Resampling()) -> DataFrame:
    """``weights`` with ``score``: the weight plus Gumbel noise, in thousandths, keyed by seed and doc_id."""
    key = F.concat(F.lit(f"{config.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weights.withColumn("score", F.col("weight") + noise)


def drawn(scores: DataFrame, config: Resampling = Resampling()) -> DataFrame:
    """``scores`` (doc_id, n_words, n_features, weight, score) with ``rank`` from 1 for the documents drawn, null for the others.

    Ranges of scores are sorted apart and numbered inside; a range's first number is what all better ranges hold.
    """
    enough = F.col("n_words") >= config.least_words
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]
    sorted_ = scores.where(enough).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    # the id holds the partition above 33 bits and the row's place below; written, as a second run may cut ranges otherwise
    placed = sorted_.select("*", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_row")).drop("_at")
    placed = stage_table(placed, "resample-ranges")
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row for each range
    w = Window.orderBy("_part")
    parts = parts.select("_part", (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    rank = F.col("_before") + F.col("_row") + 1
    ranked = placed.join(parts, "_part").withColumn("rank", F.when(rank * 100 <= F.col("_all") * config.percent, rank))
    names = [*scores.columns, "rank"]
    return ranked.select(*names).unionAll(scores.where(~enough).withColumn("rank", F.lit(None).cast("long")).select(*names))


def resample(docs: DataFrame, target: DataFrame, config: Resampling = Resampling()) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each row of ``docs`` (doc_id, text), drawn to be like ``target`` (text)."""
    raw, aim = bucket_counts(docs, config), bucket_counts(target, config)
    return drawn(stage_table(noisy(weighted(docs, gains(raw, aim, config), config), config), "resample-scores"), config)


def op11_byte_resample(spark, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 of byte lists, and words and runs of two in lower case.
CRC_TABLE = """crc_table AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i)))"""
CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen({0})), lambda j: ('0x' || substr(hex(encode({0})), 2 * j + 1, 2))::BIGINT)),
  lambda c, x: xor(tab[1 + (xor(c, x) & 255)], c >> 8)), 4294967295)"""
LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""WITH {CRC_TABLE},
w AS (SELECT raw, id, regexp_extract_all({LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM (SELECT true AS raw, doc_id AS id, text FROM documents UNION ALL SELECT false, item_id, text FROM benchmark)),
f AS (SELECT raw, id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM w),
b AS (SELECT f, {CRC.format("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM f), crc_table),
c AS (SELECT bucket, count(*) FILTER (raw) AS s, count(*) FILTER (NOT raw) AS t FROM f JOIN b USING (f) GROUP BY bucket),
n AS (SELECT sum(s)::DOUBLE AS ss, sum(t)::DOUBLE AS tt FROM c),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (ss + 10000) / ((s + 1)::DOUBLE * (tt + 10000)))) AS gain FROM c, n),
d AS (SELECT id, count(*) AS n_features, floor(sum(gain) / count(*)) AS weight FROM f JOIN b USING (f) JOIN g USING (bucket) WHERE raw GROUP BY id),
e AS (SELECT w.id AS doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  ('0x' || substr(sha256('7:' || w.id), 1, 8))::BIGINT AS h FROM w LEFT JOIN d ON d.id = w.id WHERE raw),
o AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM e),
r AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS place,
  count(*) FILTER (n_words >= 20) OVER () AS eligible FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN place * 100 <= eligible * 25 THEN place END AS rank FROM r"""
