"""Packing of documents into token windows, each filled with lexical neighbours of a seed.

Documents are encoded once; how many documents hold each vocabulary id, and the mean length, are
counted over all of them. They are then laid out by several weighted min-hashes of their ids, where
an id weighs as much as it does in BM25 (an id of one document only has no weight), so that documents
that share rare ids tend to lie together, and cut into shards of bounded size. A shard has an inverted index with BM25 weights from the corpus-wide counts. The next unused
document seeds a window; the index ranks the unused documents of the shard by BM25 against all ids
of the seed, and they fill the window from the best on: first those that fit whole, then the best one
left is cut to fill it exactly, and its rest seeds the next window. A document longer than a window
first fills windows of its own. Only the last window of a task can need padding.

Defined cases: a null or empty text is its end id alone; null doc_ids and repeated rows are packed
like others; ties in score go to the earlier document of the layout; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm import wordbpe
from quarryline.llm.runtime import releasing, stage_table


@dataclass(frozen=True)
class Windows:
    """``size`` ids a window; ``shard`` ids an index; BM25's ``k1`` and ``b``; ``hashes`` to lay out by, each with its own ``seed``."""

    size: int = 4096
    shard: int = 1 << 18
    hashes: int = 3
    seed: int = 5
    k1: float = 1.2
    b: float = 0.75
    end_id: int = 2


ENCODED = "doc_id long, n long, ids binary, terms array<long>, df array<long>"


def encoded(docs: DataFrame, windows: Windows, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n, ids, terms, df): a row per document, and per batch a row with its counts of documents by id in ``terms`` and ``df``."""
    file = tokenizer or wordbpe.default_file()
    names = [c.split()[0] for c in ENCODED.split(", ")]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches):
        enc = wordbpe.encoder(file)
        size = enc.tokenizer.get_vocab_size()
        width = _width(size)
        seen = np.zeros(size, bool)
        for batch in batches:
            df = np.zeros(size, np.int64)
            for b in wordbpe.slices(batch, 1):
                flat, sizes = enc.encode(wordbpe.text_bytes(b.column(1)), windows.end_id)
                ends = np.cumsum(sizes)
                for a, z in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
                    if z - a < 3000:
                        df[np.unique(flat[a:z])] += 1
                    else:
                        seen[flat[a:z]] = True
                        df += seen
                        seen[:] = False
                raw = flat.astype(width).tobytes()
                cuts = pa.array(np.concatenate([[0], ends]) * np.dtype(width).itemsize, pa.int64())
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, cuts.buffers()[1], pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(sizes), ids, pa.nulls(len(sizes), types[3]), pa.nulls(len(sizes), types[4])], names)
            used = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([None], [None], [None], [used.tolist()], [df[used].tolist()]), types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(releasing(run), ENCODED)


def _width(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _orders(weight: np.ndarray, windows: Windows) -> np.ndarray:
    """For each hash, the ids' ranks; the smallest rank among a document's ids is its weighted min-hash."""
    rng = np.random.default_rng(windows.seed)
    late = rng.exponential(size=(windows.hashes, len(weight))) / np.maximum(weight, 1e-300)
    return np.argsort(np.argsort(late, axis=1, kind="stable"), axis=1, kind="stable").astype(np.uint32)


def laid_out(rows: DataFrame, weight: np.ndarray, windows: Windows, width: str) -> DataFrame:
    """(doc_id, n, ids) of ``rows`` in ranges of their min-hashes, in order; equal ones by a hash of their ids."""
    orders = _orders(weight, windows)

    def run(batches):
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            flat = np.frombuffer(b"".join(batch.column(2).to_pylist()), width)
            starts = np.cumsum(sizes) - sizes
            places = [pa.array(np.minimum.reduceat(o[flat], starts).astype(np.int64)) for o in orders] if len(sizes) else [pa.array([], pa.int64())] * len(orders)
            yield pa.RecordBatch.from_arrays([*batch.columns, *places], ["doc_id", "n", "ids", *(f"p{i}" for i in range(len(orders)))])

    places = [f"p{i}" for i in range(windows.hashes)]
    placed = rows.select("doc_id", "n", "ids").mapInArrow(releasing(run), "doc_id long, n long, ids binary, " + ", ".join(f"{p} long" for p in places))
    placed = placed.withColumns({"_h": F.xxhash64("ids"), "_n": F.monotonically_increasing_id()})
    return placed.repartitionByRange(*places, "_h", "_n").sortWithinPartitions(*places, "_h", "_n").select("doc_id", "ids", "n")


class Index:
    """Inverted index of some documents: for each id, the documents that hold it and their BM25 weights."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float, windows: Windows):
        sizes = np.array([len(d) for d in docs], np.int64)
        owner = np.repeat(np.arange(len(docs)), sizes)
        key, tf = np.unique(np.concatenate(docs).astype(np.int64) * len(docs) + owner, return_counts=True)
        self.terms, self.owner = key // len(docs), key % len(docs)
        norm = windows.k1 * (1 - windows.b + windows.b * sizes / max(mean, 1.0))
        self.weight = (idf[self.terms] * tf * (windows.k1 + 1) / (tf + norm[self.owner])).astype(np.float32)
        self.begin = np.searchsorted(self.terms, np.arange(len(idf) + 1))
        self.n = len(docs)
        self.by_doc = np.argsort(self.owner, kind="stable")
        self.cut = np.searchsorted(self.owner[self.by_doc], np.arange(len(docs) + 1))
        self.tf = tf

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of every document against all ids of ``doc``."""
        own = self.by_doc[self.cut[doc] : self.cut[doc + 1]]
        terms, times = self.terms[own], self.tf[own]
        sizes = self.begin[terms + 1] - self.begin[terms]
        at = np.repeat(self.begin[terms] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        return np.bincount(self.owner[at], self.weight[at] * np.repeat(times, sizes), self.n)


def pack_shard(docs: list[np.ndarray], index: Index, windows: Windows) -> tuple[list[tuple[int, int, int, int]], int]:
    """Pieces (document, start, length, window) of a shard and the windows used; every window but the last is full."""
    pieces, window = [], 0
    todo = np.array([len(d) for d in docs])
    start = np.zeros(len(docs), np.int64)
    for d in range(len(docs)):
        while todo[d] >= windows.size:
            pieces.append((d, int(start[d]), windows.size, window))
            start[d] += windows.size
            todo[d] -= windows.size
            window += 1
    seed, first = -1, 0
    while True:
        if seed < 0:
            while first < len(docs) and not todo[first]:
                first += 1
            if first == len(docs):
                return pieces, window
            seed = first
        room, around = windows.size, index.scores(seed)
        pieces.append((seed, int(start[seed]), int(todo[seed]), window))
        room -= int(todo[seed])
        todo[seed] = 0
        left = np.flatnonzero(todo)
        ranked = left[np.argsort(-around[left], kind="stable")]
        for d in ranked.tolist():
            if todo[d] <= room:
                pieces.append((d, int(start[d]), int(todo[d]), window))
                room -= int(todo[d])
                todo[d] = 0
                if not room:
                    break
        seed = -1
        if room:
            for d in ranked.tolist():
                if todo[d]:
                    pieces.append((d, int(start[d]), room, window))
                    start[d] += room
                    todo[d] -= room
                    seed = d
                    break
        window += 1


def pack(docs: DataFrame, windows: Windows = Windows(), tokenizer: str | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and if asked the 32-bit ids) of every piece of ``docs`` (doc_id, text)."""
    rows = stage_table(encoded(docs, windows, tokenizer), "pack-ids")
    total = rows.where("n IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("ids")).first()
    counts = rows.where("terms IS NOT NULL").select(F.inline(F.arrays_zip("terms", "df"))).groupBy("terms").agg(F.sum("df").alias("df"))
    df = {r["terms"]: r["df"] for r in counts.collect()}  # at most one row per vocabulary id
    size = wordbpe.encoder(tokenizer or wordbpe.default_file()).tokenizer.get_vocab_size()
    width = _width(size)
    have = np.zeros(size)
    have[list(df)] = list(df.values())
    idf = np.log(1 + (total["n"] - have + 0.5) / (have + 0.5))
    mean = (total["ids"] or 0) / max(1, total["n"])

    def run(batches):
        wordbpe.forget()
        task, window = TaskContext.get().partitionId(), 0
        held: list[tuple] = []  # ids, start of what isn't packed, doc_id
        amount = 0

        def close(final: bool):
            """Pack what is held; a window that isn't full goes on to the next shard unless it is the task's last."""
            nonlocal held, amount, window
            index = Index([h for h, _, _ in held], idf, mean, windows)
            tails = [h[s:] for h, s, _ in held]
            pieces, used = pack_shard(tails, index, windows)
            fill = {}
            for _, _, n, w in pieces:
                fill[w] = fill.get(w, 0) + n
            open_ = used - 1 if used and not final and fill[used - 1] < windows.size else -1
            out, offset, again = [], {}, []
            for d, s, n, w in pieces:
                h, before, name = held[d]
                if w == open_:
                    again.append((h, before + s, name))
                    continue
                ids = h[before + s : before + s + n]
                out.append((name, before + s, n, zlib.crc32(ids.astype("<u4").tobytes()), len(h), (task << 40) + window + w, offset.get(w, 0), ids.astype("<u4").tobytes() if with_ids else None))
                offset[w] = offset.get(w, 0) + n
            window += used - (open_ >= 0)
            held = again
            amount = sum(len(h) - s for h, s, _ in again)
            types = (*[pa.int64()] * 7, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            for doc, raw, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held.append((np.frombuffer(raw, width), 0, doc))
                amount += n
                if amount >= windows.shard:
                    yield close(False)
        if held:
            yield close(True)

    laid = laid_out(rows.where("n IS NOT NULL"), np.where(have >= 2, idf * idf, 0), windows, width)
    return laid.mapInArrow(releasing(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def op5_bm25_pack(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False).drop("ids")
