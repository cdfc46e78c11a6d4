"""Spelling variants: words one edit apart, found by two-dimensional range reporting.

A word that differs from a given one at one place shares all before that place and all behind it. Words
are sorted once as they are and once reversed; those with the prefix are an interval of the first order,
those with the suffix an interval of the second, and the words in both are the points of a rectangle,
which a wavelet tree reports. An inserted code point is sought likewise among words one longer.

Spark deals the work by what an edit leaves alone: a word is cut into segments, the edit lies in one of
them, and all words that agree outside that segment come together. A group of more than ``crowded`` words
is dealt anew with its segment halved, until it is small or its words differ in one code point only (at
most the alphabet's size), so no task holds an unbounded group. The two sides of a pair always meet, and
once only: an insertion is taken at its leftmost place.

Defined cases: a null or empty text has no words; very long texts and words are taken whole; of variants
that occur equally often the first in code-point order counts; repeated rows count again; a null doc_id is
written as an empty one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.resample import CRC, CRC_TABLE, LOWER
from quarryline.llm.runtime import discard, releasing, stage_table

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
KEY = ["m", "a", "b", "rest"]


@dataclass(frozen=True)
class Spelling:
    """Words have ``least_chars`` code points and ``least_seen`` occurrences; a form occurs ``times`` as often; every ``damage``-th run loses a code point."""

    least_chars: int = 6
    least_seen: int = 5
    times: int = 5
    damage: int = 199
    crowded: int = 4096


def vocabulary(docs: DataFrame, config: Spelling = Spelling()) -> DataFrame:
    """(word, n) of ``docs`` (doc_id, text)."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= config.least_chars).select("id", F.translate("run", UPPER, SMALL).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = F.pmod(h, F.length("run")).cast("int")
    damaged = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select(F.when(h % config.damage == 0, damaged).otherwise(F.col("run")).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where((F.length("word") >= config.least_chars) & (F.col("n") >= config.least_seen))


def _outside(word: Column, a: Column, b: Column) -> Column:
    """A word without its code points from ``a`` to ``b``."""
    return F.concat(F.substring(word, F.lit(1), a), F.lit("\u0001"), F.substring(word, b + 1, F.length(word)))


def _dealt(rows: DataFrame, segments: Column) -> DataFrame:
    """``rows`` (m, word, n, shorter) under the key of every segment (a, b) of the word sought, which has ``m`` code points."""
    cut = rows.select("m", "word", "n", "shorter", F.inline(segments).alias("a", "b"))
    rest = F.when(F.col("shorter"), _outside(F.col("word"), F.col("a"), F.col("b") - 1)).otherwise(_outside(F.col("word"), F.col("a"), F.col("b")))
    return cut.withColumn("rest", rest)


def _halves(a: Column, b: Column) -> Column:
    """A segment's two halves."""
    middle = F.floor((a + b) / 2).cast("int")
    return F.array(F.struct(a.alias("a"), middle.alias("b")), F.struct(middle.alias("a"), b.alias("b")))


def groups(words: DataFrame, config: Spelling = Spelling()) -> DataFrame:
    """Every word under the keys where it meets its variants: as one of its own length, and as one shorter than those sought."""
    own = words.select(F.length("word").alias("m"), "word", "n", F.lit(False).alias("shorter"))
    short = words.select((F.length("word") + 1).alias("m"), "word", "n", F.lit(True).alias("shorter"))
    open_ = stage_table(_dealt(own.unionAll(short), _halves(F.lit(0), F.col("m"))), "spelling-keys")
    out = None
    while True:
        large = open_.where("b - a > 1").groupBy(*KEY).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > config.crowded).select(*KEY)
        large = stage_table(large, "spelling-crowded")
        if large.isEmpty():
            return open_ if out is None else out.unionByName(open_)
        calm = open_.join(large, KEY, "left_anti")
        out = calm if out is None else out.unionByName(calm)
        split = open_.join(large, KEY, "left_semi").withColumnsRenamed({"a": "_a", "b": "_b"})
        open_ = stage_table(_dealt(split, _halves(F.col("_a"), F.col("_b"))), "spelling-keys")


class WaveletTree:
    """A sequence of whole numbers below ``2 ** bits``, one level of bits with running counts for each binary digit."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.zeros: list[np.ndarray] = []  # zeros before each place
        for level in reversed(range(self.bits)):
            one = (values >> level) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - one)]))
            values = np.concatenate([values[one == 0], values[one == 1]])

    def report(self, begin: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) for every element from ``begin`` to ``end`` with a value from ``low`` to ``high``, ends excluded, of all queries at once."""
        who, value = np.arange(len(begin)), np.zeros(len(begin), np.int64)
        for depth, zeros in enumerate(self.zeros):
            width = 1 << (self.bits - 1 - depth)
            a, b = zeros[begin], zeros[end]
            begin, end = np.concatenate([a, zeros[-1] + begin - a]), np.concatenate([b, zeros[-1] + end - b])
            who, value = np.tile(who, 2), np.concatenate([value, value + width])
            open_ = np.flatnonzero((begin < end) & (value < high[who]) & (value + width > low[who]))
            begin, end, who, value = begin[open_], end[open_], who[open_], value[open_]
        return np.repeat(who, end - begin), np.repeat(value, end - begin)


def _intervals(order: list[int], group: list[int], sides: list[list[str]]) -> dict[tuple[int, str], tuple[int, int]]:
    """Where in ``order`` the words of a group with one prefix (or suffix) stand; ``sides`` has those of each word."""
    found: dict[tuple[int, str], tuple[int, int]] = {}
    for place, i in enumerate(order):
        for side in sides[i]:
            key = (group[i], side)
            found[key] = (found[key][0] if key in found else place, place + 1)
    return found


def near_in(group: list[int], begin: list[int], end: list[int], words: list[str], shorter: list[bool]) -> list[tuple[int, int]]:
    """Pairs of rows (i, j) of one group that are one edit apart within the group's segment, each once; of an insertion i is the shorter word."""
    points = [i for i, s in enumerate(shorter) if not s]
    if not points:
        return []
    heads = [[w[:p] for p in range(a, z)] for w, a, z in zip(words, begin, end, strict=True)]
    tails = [[w[p + (not s) :] for p in range(a, z)] for w, a, z, s in zip(words, begin, end, shorter, strict=True)]
    forward = sorted(points, key=lambda i: (group[i], words[i]))
    backward = sorted(points, key=lambda i: (group[i], words[i][::-1]))
    before, behind = _intervals(forward, group, heads), _intervals(backward, group, tails)
    rank = np.empty(len(words), np.int64)
    rank[backward] = np.arange(len(backward))
    tree = WaveletTree(rank[forward])
    asked, boxes = [], []
    for i, (g, a, s) in enumerate(zip(group, begin, shorter, strict=True)):
        for k, (head, tail) in enumerate(zip(heads[i], tails[i], strict=True)):
            x, y = before.get((g, head)), behind.get((g, tail))
            # a word of the same length always finds itself
            if x and y and (s or (x[1] - x[0] > 1 and y[1] - y[0] > 1)):
                asked.append((i, a + k))
                boxes.append((*x, *y))
    if not boxes:
        return []
    who, value = tree.report(*np.array(boxes, np.int64).T)
    out = []
    for q, v in zip(who.tolist(), value.tolist(), strict=True):
        (i, p), j = asked[q], backward[v]
        if shorter[i]:
            if p == 0 or words[i][p - 1] != words[j][p]:  # of equal code points in a row the first is the one inserted
                out.append((i, j))
        elif words[i] < words[j]:
            out.append((i, j))
    return out


def links(words: DataFrame, config: Spelling = Spelling()) -> DataFrame:
    """(word, near, near_n): every two words of ``words`` (word, n) that are one edit apart, from both sides."""

    def search(rows: list[tuple]):
        group, names = [], defaultdict(lambda: len(names))
        for r in rows:
            group.append(names[r[:4]])
        w, n = [r[4] for r in rows], [r[5] for r in rows]
        pairs = near_in(group, [r[1] for r in rows], [r[2] for r in rows], w, [r[6] for r in rows])
        both = [(w[i], w[j], n[j]) for i, j in pairs] + [(w[j], w[i], n[i]) for i, j in pairs]
        columns = list(zip(*both, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["word", "near", "near_n"])

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            held += zip(*[c.to_pylist() for c in batch.columns], strict=True)
            if len(held) > 1 << 14:
                cut = next((k for k in range(len(held) - 1, 0, -1) if held[k][:4] != held[k - 1][:4]), 0)  # a group stays whole
                if cut:
                    yield search(held[:cut])
                    held = held[cut:]
        yield search(held)

    dealt = groups(words, config).select(*KEY, "word", "n", "shorter")
    return dealt.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(releasing(run), "word string, near string, near_n long")


def forms(words: DataFrame, near: DataFrame, config: Spelling = Spelling()) -> DataFrame:
    """(word, n, n_near, form, form_n) of each word."""
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    often = -F.col("best.less") >= config.times * F.col("n")
    return words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: forms followed to the last, by doubling the step until none has another."""
    steps = stage_table(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        longer = stage_table(steps.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling-roots")
        discard(steps)
        steps = longer.select("word", "root")
        if longer.where("_moved").isEmpty():
            return steps
        steps.stage_path = longer.stage_path


def variants(docs: DataFrame, config: Spelling = Spelling()) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the words of ``docs`` (doc_id, text)."""
    words = stage_table(vocabulary(docs, config), "spelling-words")
    found = stage_table(forms(words, links(words, config), config), "spelling-forms")
    return found.join(roots(found), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("word", "form", "root", "n", "n_near", "form_n")


ORACLE = f"""WITH RECURSIVE {CRC_TABLE},
o AS (SELECT doc_id, unnest(regexp_extract_all({LOWER.format("text")}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
k AS (SELECT run, length(run) AS m, coalesce(doc_id::VARCHAR, '') || ':' || run AS key FROM o WHERE length(run) >= 6),
h AS (SELECT run, m, {CRC.format("key")} AS h FROM k, crc_table),
w AS (SELECT word, count(*) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % m) || substr(run, h % m + 2) ELSE run END AS word FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5),
d AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS short FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
near AS (SELECT x.word, y.word AS near, y.n AS near_n FROM d x JOIN d y ON x.short = y.short AND x.i = y.i AND x.word <> y.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.short = w.word
  UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.short = w.word),
b AS (SELECT word, count(*) AS n_near, min((-near_n, near)) AS best FROM near GROUP BY word),
f AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 5 * n THEN best[2] END AS form, CASE WHEN -best[1] >= 5 * n THEN -best[1] END AS form_n FROM w LEFT JOIN b USING (word)),
r(word, here) AS (SELECT word, word FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.here WHERE f.form IS NOT NULL),
l AS (SELECT r.word, r.here AS root FROM r JOIN f ON f.word = r.here WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN l USING (word)"""
