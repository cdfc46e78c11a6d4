"""Bytes that lie in a string of ``length`` bytes found twice or more, by suffix sorting of the places that need it.

1. Winnowing: every window of ``length`` bytes has an anchor, the leftmost smallest hash among its
   grams of ``gram`` bytes; equal windows have equal anchors at equal offsets. The windows with one
   anchor make a block, so a document's windows are dealt into blocks once each.
2. Blocks whose anchor occurs once hold nothing that repeats. Equal blocks repeat entirely. What is
   left are different blocks around one anchor: where copies begin, end or were changed.
3. These go through suffix sorting, an anchor as one symbol (its gram is equal in all): suffix groups
   by Lyndon prefix, built in descending order with previous-smaller pointers, then each group's
   order is emitted from the smaller suffixes, without naming or recursion. Neighbours in the order
   that agree in a whole window mark it as repeated.
4. An anchor with very many different blocks is first divided: its blocks are cut into half as wide
   ranges of windows and grouped by what all windows of a range share, again and again, until groups
   are small or the ranges are equal; no group is collected beyond ``group`` blocks.

Blocks are compared by two 64-bit hashes, windows in step 3 byte by byte.

Rows are numbered and written once, and told apart by these numbers. Defined cases: a null text is
empty; shorter texts than ``length`` lose nothing; repeated rows lose everything from ``length``
bytes on; null or repeated doc_ids do no harm; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm import wordbpe
from quarryline.llm.runtime import discard, drop_shuffles, releasing, stage_table

TILE = 1 << 19
_POWERS: list[np.ndarray] = []


@dataclass(frozen=True)
class Repeats:
    """``length``: bytes of a repeated string; ``gram``: bytes of an anchor; ``group``: most blocks sorted at once for an anchor."""

    length: int = 200
    gram: int = 140
    group: int = 256


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        base = 0x9E3779B97F4A7C15
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        _POWERS[:] = pair
    return _POWERS[0], _POWERS[1]


def blocks(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, rule: Repeats) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor, anchor hash, block hash) of all blocks; texts lie at ``begins`` in ``data``."""
    k, w, n = rule.gram, rule.length - rule.gram + 1, len(data)
    none = np.zeros(0, np.int64)
    if n < rule.length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    up, down = _powers(max(n + 1, 2 * TILE + rule.length))
    letters = _mix(np.arange(1, 257, dtype=np.uint64))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(letters[data] * up[:n], out=sums[1:])
    grams = _mix((sums[k:] - sums[:-k]) * down[: n - k + 1])
    low, span = grams, 1
    while span * 2 <= w:
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    if span < w:
        low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
    valid = np.zeros(n - rule.length + 2, np.int8)
    long = sizes >= rule.length
    np.add.at(valid, begins[long], 1)
    np.add.at(valid, begins[long] + sizes[long] - rule.length + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    same = np.concatenate([[False], (low[1:] == low[:-1]) & valid[1:] & valid[:-1]])
    edge = np.zeros(len(low), bool)
    edge[begins[long]] = True
    first = np.flatnonzero(valid & (~same | edge))
    stop = np.append(first[1:], len(low))
    ends = np.flatnonzero(valid & np.append(~valid[1:] | edge[1:], True))
    last = np.minimum(stop - 1, ends[np.searchsorted(ends, first)])
    out = []
    while len(first):
        at = np.empty(len(first), np.int64)
        for a in range(0, len(first), 1 << 14):
            f = first[a : a + (1 << 14)]
            at[a : a + len(f)] = f + (grams[f[:, None] + np.arange(w)] == low[f][:, None]).argmax(axis=1)
        out.append((first, np.minimum(last, at), at))
        more = last > at
        first, last = at[more] + 1, last[more]
    lo, hi, at = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, none)
    whole = _mix((sums[hi + rule.length] - sums[lo]) * down[lo])
    whole = _mix(whole ^ ((at - lo).astype(np.uint64) << np.uint64(20)) ^ (hi - lo).astype(np.uint64))
    return lo, hi, at, grams[at], whole


def _tiles(batches, length: int):
    """(bytes, row of each piece, place of each piece in its text, begins, sizes), with overlaps where a long text is cut."""
    step = TILE - (length - 1)
    for batch in batches:
        for b in wordbpe.slices(batch, 1, TILE):
            pieces, rows, places = [], [], []
            for row, text in zip(b.column(0).to_pylist(), wordbpe.text_bytes(b.column(1)), strict=True):
                for at in range(0, max(1, len(text) - length + 1), step) if len(text) > TILE else (0,):
                    if pieces and sum(map(len, pieces[-1:])) >= TILE:
                        yield _joined(pieces, rows, places)
                        pieces, rows, places = [], [], []
                    pieces.append(text[at : at + TILE])
                    rows.append(row)
                    places.append(at)
            if pieces:
                yield _joined(pieces, rows, places)


def _joined(pieces, rows, places):
    sizes = np.array([len(p) for p in pieces], np.int64)
    return np.frombuffer(b"".join(pieces), np.uint8), np.array(rows, np.int64), np.array(places, np.int64), np.cumsum(sizes) - sizes, sizes


BLOCK = "anchor long, whole long, row long, lo long, shape int"


def found_blocks(rows: DataFrame, rule: Repeats) -> DataFrame:
    """All blocks of ``rows`` (row, text): shape holds the anchor's and the last window's offsets from lo."""

    def run(batches):
        for data, row, place, begins, sizes in _tiles(batches, rule.length):
            lo, hi, at, anchor, whole = blocks(data, begins, sizes, rule)
            piece = np.searchsorted(begins, lo, "right") - 1
            shape = ((at - lo) << 12 | (hi - lo)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(row[piece]), pa.array(lo - begins[piece] + place[piece]), pa.array(shape)], ["anchor", "whole", "row", "lo", "shape"])

    return rows.mapInArrow(releasing(run), BLOCK)


def suffix_order(text: list[int]) -> list[int]:
    """The suffixes of ``text`` in ascending order; its last symbol must be smaller than all others.

    Groups lie in ``order`` one after the other by their common prefix. They are finished from the
    last to the first: the nearest earlier suffix in a smaller group, seen from every member, has the
    members' prefix appended to its own, once for each member, and moves behind what remains of its
    group. Then the places are filled from the smallest suffix on.
    """
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    group, size = [0] * n, [0] * n
    where = [0] * n
    start, before = 0, None
    for i, s in enumerate(order):
        if text[s] != before:
            start, before = i, text[s]
        group[s] = start
        size[start] += 1
        where[s] = i
    smaller = [-1] * n
    end = n
    while end:
        own = group[order[end - 1]]
        members = order[own:end]
        end = own
        if len(members) > 1:
            members.sort()
        times: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= own:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if len(times) == 1:
            levels = [list(times)]
        elif max(times.values(), default=0) <= 1:
            levels = [list(times)]
        else:
            levels = [[p for p, c in times.items() if c == k] for k in sorted(set(times.values()), reverse=True)]
        for level in levels:
            if not level:
                continue
            left = []
            for p in level:
                g = group[p]
                left.append(g)
                size[g] -= 1
                to = g + size[g]
                at = where[p]
                if at != to:
                    other = order[to]
                    order[at], order[to] = other, p
                    where[other], where[p] = at, to
            new = [g + size[g] for g in left]
            for p, g in zip(level, new):  # noqa: B905
                group[p] = g
                size[g] += 1
    free = group[:]
    slot = list(range(n))
    out, placed = [-1] * n, [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for i in range(n):
        p = out[i] - 1
        while p >= 0 and not placed[p]:
            g = free[p]
            out[slot[g]] = p
            slot[g] += 1
            placed[p] = True
            p = smaller[p]
    return out


def repeated_windows(parts: list[tuple[int, bytes, int]], window: int) -> list[np.ndarray]:
    """For each (anchor, bytes around it, offset of the anchor in them): which windows of ``window`` symbols occur elsewhere in ``parts``."""
    names = {a: 257 + i for i, a in enumerate(sorted({a for a, _, _ in parts}))}
    text: list[int] = []
    begins = []
    for anchor, around, at in parts:
        begins.append(len(text))
        text += [c + 1 for c in around[:at]]
        text.append(names[anchor])
        text += [c + 1 for c in around[at:]]
        text.append(len(names) + 257)
    text.append(0)
    symbols = np.array(text, np.int32)
    starts = np.zeros(len(text), bool)
    counts = [len(a) + 1 - window + 1 for _, a, _ in parts]
    for b, c in zip(begins, counts, strict=True):
        starts[b : b + c] = True
    order = np.array(suffix_order(text), np.int64)
    order = order[starts[order]]
    view = np.lib.stride_tricks.sliding_window_view(symbols, window)
    again = np.zeros(len(text), bool)
    for a in range(0, len(order) - 1, 1 << 14):
        some = order[a : a + (1 << 14) + 1]
        rows = view[some]
        equal = (rows[1:] == rows[:-1]).all(axis=1)
        again[some[1:][equal]] = True
        again[some[:-1][equal]] = True
    return [again[b : b + c] for b, c in zip(begins, counts, strict=True)]


def _runs(mark: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


SPAN = "row long, lo long, hi long"
PART = "key long, row long, at long, n long, anchor_at int, around binary"


def _sorted_spans(parts: DataFrame, rule: Repeats) -> DataFrame:
    """Repeated windows of ``parts``; every key's rows are together in one partition, in order."""
    window = rule.length - rule.gram + 1

    def flush(held):
        marks = repeated_windows([(k, a, j) for k, _, _, _, j, a in held], window)
        spans = [(row, at + lo, at + hi) for (_, row, at, n, _, _), m in zip(held, marks, strict=True) if n == 1 for lo, hi in _runs(m)]
        return pa.RecordBatch.from_arrays([pa.array([s[i] for s in spans], pa.int64()) for i in range(3)], ["row", "lo", "hi"])

    def run(batches):
        held, group, total = [], [], 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][0] != r[0]:
                    if len(group) > 1:
                        held += group
                    group = []
                    if total > 1 << 15 and held:
                        yield flush(held)
                        held, total = [], 0
                group.append(r)
                total += len(r[5])
        if len(group) > 1:
            held += group
        if held:
            yield flush(held)

    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # sorting is slow for its bytes, so tasks aren't merged by size
    return parts.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(releasing(run), SPAN)


def _divided(parts: DataFrame, rule: Repeats, cell: int) -> DataFrame:
    """Each part cut by its windows' bytes before the anchor, in cells of ``cell`` bytes, with the hash of what all windows of a cell share as key."""
    window = rule.length - rule.gram + 1

    def run(batches):
        for batch in batches:
            out = []
            for key, row, at, n, j, around in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                count = len(around) + 2 - window
                for c in range((j - count + 1) // cell, j // cell + 1):
                    a, b = max(0, j - (c + 1) * cell + 1), min(count, j - c * cell + 1)
                    # windows a to b - 1; the anchor is symbol j, bytes after it lie one symbol further
                    left, right = around[a:j], around[j : b + window - 2]
                    shared = around[j - c * cell : j] + b"|" + around[j : j + max(0, window - (c + 1) * cell)]
                    digest = hashlib.blake2b(key.to_bytes(8, "little", signed=True) + c.to_bytes(4, "little") + shared, digest_size=8).digest()
                    full = hashlib.blake2b(digest + len(left).to_bytes(4, "little") + left + right, digest_size=8).digest()
                    out.append((int.from_bytes(digest, "little", signed=True), int.from_bytes(full, "little", signed=True), row, at + a, n, len(left), left + right))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], ["key", "whole", "row", "at", "n", "anchor_at", "around"])

    return parts.mapInArrow(run, "key long, whole long, row long, at long, n long, anchor_at int, around binary")


def repeated_spans(rows: DataFrame, rule: Repeats = Repeats()) -> DataFrame:
    """(row, spans): pairs lo, hi such that every window that starts in lo..hi of the row's text is repeated, for ``rows`` (row, text)."""
    spark = rows.sparkSession
    found = found_blocks(rows, rule)
    # written first: joined straight from its aggregation, a very common anchor couldn't be split over tasks
    often = stage_table(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor"), "repeat-anchors")
    shared = stage_table(found.join(often, "anchor"), "repeat-blocks")
    discard(often)
    drop_shuffles(spark)
    classes = shared.groupBy("anchor", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "lo", "shape")).alias("one"))
    classes = stage_table(classes, "repeat-classes")
    sure = shared.join(classes.where("n > 1").select("anchor", "whole"), ["anchor", "whole"]).select("row", "lo", (F.col("lo") + F.col("shape").bitwiseAND(F.lit(4095))).alias("hi"))
    spans = [stage_table(sure, "repeat-spans")]
    discard(shared)
    drop_shuffles(spark)
    groups = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("single")).where("blocks > 1 AND single > 0").select("anchor", "blocks")
    open_ = classes.join(groups, "anchor").select(F.col("one.row").alias("row"), F.struct("one.lo", "one.shape", "anchor", "n", "blocks").alias("b"))
    by_row = open_.groupBy("row").agg(F.collect_list("b").alias("bs"))

    def cut(batches):
        k = rule.gram
        for batch in batches:
            out = []
            for row, bs, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), wordbpe.text_bytes(batch.column(2)), strict=True):
                for b in bs:
                    lo, j, reach = b["lo"], b["shape"] >> 12, b["shape"] & 4095
                    out.append((b["anchor"], row, lo, b["n"], j, text[lo : lo + j] + text[lo + j + k : lo + reach + rule.length], b["blocks"]))
            for a in range(0, len(out), 4096):
                some = out[a : a + 4096]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in some], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()))], ["key", "row", "at", "n", "anchor_at", "around", "blocks"])

    parts = stage_table(by_row.join(rows, "row").select("row", "bs", "text").mapInArrow(releasing(cut), PART + ", blocks long"), "repeat-parts")
    discard(classes)
    drop_shuffles(spark)
    names = [c.split()[0] for c in PART.split(", ")]
    spans += [stage_table(_sorted_spans(parts.where(F.col("blocks") <= rule.group).select(*names), rule), "repeat-spans")]
    crowded = parts.where(F.col("blocks") > rule.group).select(*names)
    width = rule.length - rule.gram + 1
    cell = 1 << (width - 1).bit_length()
    while cell > 1 and not crowded.isEmpty():
        cell //= 2
        level = stage_table(_divided(crowded, rule, cell), "repeat-halves")
        same = level.groupBy("key", "whole").agg(F.sum("n").alias("n"), F.min(F.struct("row", "at", "anchor_at", "around")).alias("one"))
        same = stage_table(same, "repeat-halves")
        windows = F.length("around") + 2 - width
        hit = level.where("n = 1").join(same.where("n > 1").select("key", "whole"), ["key", "whole"])
        spans.append(stage_table(hit.select("row", F.col("at").alias("lo"), (F.col("at") + windows - 1).cast("long").alias("hi")), "repeat-spans"))
        groups = same.groupBy("key").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("single")).where("blocks > 1 AND single > 0").select("key", "blocks")
        discard(parts, level)
        parts = stage_table(same.join(groups, "key").select("key", "one.row", "one.at", "n", "one.anchor_at", "one.around", "blocks"), "repeat-halves")
        spans.append(stage_table(_sorted_spans(parts.where(F.col("blocks") <= rule.group).select(*names), rule), "repeat-spans"))
        discard(same)
        crowded = parts.where(F.col("blocks") > rule.group).select(*names)
    out = spans[0]
    for s in spans[1:]:
        out = out.unionAll(s)
    out = stage_table(out.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "repeat-spans")
    discard(parts, *spans)
    drop_shuffles(spark)
    return out


def dedup(docs: DataFrame, rule: Repeats = Repeats(), keep_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): row, doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, the remaining text; then the columns in ``carry``.

    In ``text`` a character of which bytes were removed is left out altogether.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *[F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry)])
    # written once: scans of ``docs`` in later jobs may be split, and so numbered, in another way
    rows = stage_table(rows, "repeat-rows", compression="zstd")
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    spans = repeated_spans(rows.select("row", "text"), rule)
    joined = rows.join(spans, "row", "left").select("row", "text", "doc_id", "spans", *[f"_carry{i}" for i in range(len(carry))])

    def run(batches):
        for batch in batches:
            out = []
            for row, text, doc, spans in zip(batch.column(0).to_pylist(), wordbpe.text_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                kept, at, n = [], 0, 0
                reach = -1
                for s in sorted((s["lo"], s["hi"] + rule.length) for s in spans or ()):
                    if s[0] > reach:
                        kept.append(text[at : s[0]])
                        n += 1
                    at = reach = max(reach, s[1])
                kept = b"".join([*kept, text[at:]])
                out.append((row, doc, len(text), len(text) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept.decode("utf8", "ignore") if keep_text else None))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)] + batch.columns[4:], ["row", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", *carry])

    return joined.mapInArrow(releasing(run), "row long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string" + kinds)


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
