"""Token files with Re-Pair grammars.

Documents are encoded in ascending doc_id order and cut into shards of bounded size. In every shard
frequent adjacent id pairs are replaced by new symbols, in rounds: a round counts the pairs, takes
those that occur often enough, most frequent first, and replaces them where they don't overlap a
more frequent one; the next round works on the result, until no pair is frequent or no symbol is
free. A pair without a new symbol only gets rarer, so later rounds count the pairs with new symbols
and those that were frequent and had to wait. Pairs never cross documents. A shard holds its rules,
the expansion length of every symbol and, for each document, its first symbol and first id, so any
document or id range is decoded without touching the rest.

Shards are rows of a Parquet table: Spark commits them atomically and redoes lost tasks.

Defined cases: a null or empty text is the end id alone; a very long text may make its shard longer
than the bound; null doc_ids come first; rows with one doc_id are in the order of their texts'
hashes, and of their places in the table where these are equal; an empty table gives an empty store;
further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm import wordbpe
from quarryline.llm.runtime import releasing, shared_root

MAGIC = b"QLRP"
SCHEMA = "part long, shard long, n_docs long, n_tokens long, payload binary"


@dataclass(frozen=True)
class Grammar:
    """Pairs seen at least ``least`` times are replaced; a shard's symbols stay below ``symbols`` (or the vocabulary's size); a shard closes at ``shard_tokens``."""

    least: int = 16
    symbols: int = 1 << 16
    shard_tokens: int = 1 << 20


def _apart(spot: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending places with their pairs' ranks, those to replace: no two side by side, better ranks first, every other place of a run of one pair."""
    again = np.flatnonzero((spot[1:] == spot[:-1] + 1) & (rank[1:] == rank[:-1])) + 1
    if len(again):
        run = np.arange(len(again)) - np.maximum.accumulate(np.where(np.diff(again, prepend=-1) != 1, np.arange(len(again)), 0))
        every = np.ones(len(spot), bool)
        every[again[run % 2 == 0]] = False
        spot, rank = spot[every], rank[every]
    spots, ranks = [spot[:0]], [rank[:0]]
    while len(spot):
        beside = spot[1:] == spot[:-1] + 1
        worse = np.zeros(len(spot), bool)
        worse[1:] |= beside & (rank[1:] >= rank[:-1])
        worse[:-1] |= beside & (rank[:-1] > rank[1:])
        spots.append(spot[~worse])
        ranks.append(rank[~worse])
        open_ = worse.copy()
        open_[1:] &= ~(beside & ~worse[:-1])
        open_[:-1] &= ~(beside & ~worse[1:])
        spot, rank = spot[open_], rank[open_]
    return np.concatenate(spots), np.concatenate(ranks)


def compress(ids: np.ndarray, ends: np.ndarray, base: int, grammar: Grammar = Grammar()) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """(symbols, last-symbol flags, rules of each round as (first symbol, pairs)) of ``ids`` below ``base``.

    A pair is left << 16 | right, or left << 32 | right where symbols don't fit 16 bits.
    """
    narrow = max(base, grammar.symbols) <= 1 << 16
    kind, half, spare, odd = (np.uint32, 16, 12, 0x9E3779B1) if narrow else (np.uint64, 32, 44, 0x9E3779B97F4A7C15)
    # marks: 1 the last symbol of a document, 2 a frequent pair that may still wait, 4 a new symbol
    x, mark, rules, following = ids.astype(kind), ends.astype(np.uint8), [], base
    slot = lambda k: ((k * kind(odd)) >> kind(spare)).astype(np.int64)
    at = np.flatnonzero(mark[:-1] == 0)
    while len(at) and following < grammar.symbols:
        keys = (x[at] << kind(half)) | x[at + 1]
        ranked = np.sort(keys)
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        counts = np.diff(np.append(first, len(ranked)))
        often = counts >= grammar.least
        pairs, counts = ranked[first[often]], counts[often]
        if not len(pairs):
            break
        slots = slot(keys)
        open_ = np.zeros(1 << 20, bool)
        open_[slot(pairs)] = True
        waits = open_[slots]
        # half of the free symbols a round; of pairs with one slot the most frequent has it, the others wait
        pairs = pairs[np.lexsort((slot(pairs), -counts))[: (grammar.symbols - following + 1) // 2]]
        owner = np.full(1 << 20, -1, np.int32)
        owner[slot(pairs[::-1])] = np.arange(len(pairs), dtype=np.int32)[::-1]
        pairs = pairs[owner[slot(pairs)] == np.arange(len(pairs))]
        owner[slot(pairs)] = np.arange(len(pairs), dtype=np.int32)
        rank = owner[slots]
        some = np.flatnonzero(rank >= 0)
        some = some[pairs[rank[some]] == keys[some]]
        spot, r = at[some], rank[some]
        spot, r = _apart(spot, r)
        keep = np.ones(len(x), bool)
        keep[spot + 1] = False
        x[spot] = following + r.astype(kind)
        mark[spot] = (mark[spot + 1] & 1) | 4
        mark[at[waits]] |= 2
        rules.append((following, pairs))
        following += len(pairs)
        x, mark = x[keep], mark[keep]
        at = np.flatnonzero(((mark[:-1] > 1) | (mark[1:] > 3)) & (mark[:-1] & 1 == 0))
        mark &= 1
    return x, mark > 0, rules


def _sides(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = 4 * pairs.itemsize
    return pairs >> pairs.dtype.type(half), pairs & pairs.dtype.type((1 << half) - 1)


def expansions(base: int, rules: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(where each symbol's expansion begins, all expansions): a table by which symbols become ids in one step."""
    sizes = np.concatenate([np.ones(base, np.int64), expansion_lengths(base, rules).astype(np.int64)])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    table = np.empty(int(begin[-1]), np.uint32)
    table[:base] = np.arange(base)
    for first, pairs in rules:
        both = np.stack(_sides(pairs), axis=1).ravel()
        table[begin[first] : begin[first + len(pairs)]] = _spread(both, begin, table)
    return begin, table


def _spread(symbols: np.ndarray, begin: np.ndarray, table: np.ndarray) -> np.ndarray:
    sizes = begin[symbols.astype(np.int64) + 1] - begin[symbols]
    ends = np.cumsum(sizes)
    return table[np.repeat(begin[symbols] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


def expansion_lengths(base: int, rules: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Ids that each symbol from ``base`` on stands for."""
    out = np.ones(base + sum(len(p) for _, p in rules), np.uint32)
    for first, pairs in rules:
        left, right = _sides(pairs)
        out[first : first + len(pairs)] = out[left] + out[right]
    return out[base:]


def _widths(base: int, grammar_symbols: int) -> tuple[str, str]:
    """How symbols and pairs are stored."""
    return ("<u2", "<u4") if max(base, grammar_symbols) <= 1 << 16 else ("<u4", "<u8")


def pack(doc_ids: list, ids: np.ndarray, sizes: np.ndarray, base: int, grammar: Grammar) -> bytes:
    """A shard's bytes: MAGIC, counts, then doc ids and their null flags, rules, expansion lengths, first symbols, first ids, symbols."""
    ends = np.zeros(len(ids), bool)
    ends[np.cumsum(sizes) - 1] = True
    symbols, last, rules = compress(ids, ends, base, grammar)
    first = np.concatenate([[0], np.flatnonzero(last) + 1]).astype("<u8")
    narrow, wide = _widths(base, grammar.symbols)
    head = MAGIC + struct.pack("<IIIIQ", base, grammar.symbols, len(rules), len(sizes), len(symbols)) + b"".join(struct.pack("<II", f, len(p)) for f, p in rules)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
    body = [numbers, known, *[p.astype(wide) for _, p in rules], expansion_lengths(base, rules).astype("<u4"), first, starts, symbols.astype(narrow)]
    return head + b"".join(a.tobytes() for a in body)


class Shard:
    """A shard's bytes, opened."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token shard")
        self.base, most, n_rules, n, m = struct.unpack_from("<IIIIQ", payload, 4)
        at = 28
        narrow, wide = _widths(self.base, most)
        heads = [struct.unpack_from("<II", payload, at + 8 * i) for i in range(n_rules)]
        at += 8 * n_rules

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, count, at)
            at += out.nbytes
            return out

        numbers, known = take("<i8", n), take("u1", n)
        self.doc_ids = [int(d) if k else None for d, k in zip(numbers, known, strict=True)]
        self.rules = [(f, take(wide, c)) for f, c in heads]
        self.lengths = take("<u4", sum(c for _, c in heads))
        self.begin, self.table = expansions(self.base, self.rules)
        self.first, self.starts, self.symbols = take("<u8", n + 1), take("<u8", n + 1), take(narrow, m)

    def document(self, i: int) -> np.ndarray:
        return _spread(self.symbols[self.first[i] : self.first[i + 1]], self.begin, self.table)

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids ``begin`` to ``end`` of the shard: only the symbols that cover them are expanded."""
        d = int(np.searchsorted(self.starts, begin, "right")) - 1
        stop = int(np.searchsorted(self.starts, end, "left"))
        symbols = self.symbols[self.first[max(d, 0)] : self.first[min(stop, len(self.first) - 1)]]
        size = np.ones(len(symbols), np.int64)
        wide = symbols >= self.base
        size[wide] = self.lengths[symbols[wide] - self.base]
        at = np.concatenate([[0], np.cumsum(size)]) + int(self.starts[max(d, 0)])
        a, b = int(np.searchsorted(at, begin, "right")) - 1, int(np.searchsorted(at, end, "left"))
        return _spread(symbols[max(a, 0) : b], self.begin, self.table)[begin - int(at[max(a, 0)]) : end - int(at[max(a, 0)])]

    def all(self) -> np.ndarray:
        return _spread(self.symbols, self.begin, self.table)


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1, grammar: Grammar = Grammar()) -> None:
    """Encode ``docs`` (doc_id, text) and write the shards at ``path``."""
    file = tokenizer or wordbpe.default_file()

    def run(batches):
        enc, part, shard = wordbpe.encoder(file), TaskContext.get().partitionId(), 0
        base = enc.tokenizer.get_vocab_size()
        held: list[tuple] = []  # doc_ids, ids, sizes
        total = 0

        def close():
            nonlocal held, shard, total
            docs = [d for names, _, _ in held for d in names]
            ids, sizes = np.concatenate([x for _, x, _ in held]), np.concatenate([n for _, _, n in held])
            payload = pack(docs, ids, sizes, base, grammar)
            row = pa.RecordBatch.from_arrays([pa.array([part]), pa.array([shard]), pa.array([len(docs)]), pa.array([len(ids)]), pa.array([payload], pa.binary())], ["part", "shard", "n_docs", "n_tokens", "payload"])
            held, shard, total = [], shard + 1, 0
            return row

        for batch in batches:
            for piece in wordbpe.slices(batch, 1):
                names = piece.column(0).to_pylist()
                ids, sizes = enc.encode(wordbpe.text_bytes(piece.column(1)), end_id)
                ends, a, before = np.cumsum(sizes), 0, 0
                while a < len(names):
                    z = min(len(names), int(np.searchsorted(ends, before + grammar.shard_tokens - total)) + 1)
                    held.append((names[a:z], ids[before : ends[z - 1]], sizes[a:z]))
                    total += int(ends[z - 1]) - before
                    a, before = z, int(ends[z - 1])
                    if total >= grammar.shard_tokens:
                        yield close()
        if held:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumns({"_h": F.xxhash64("text"), "_n": F.monotonically_increasing_id()})
    ranged = rows.repartitionByRange("doc_id", "_h", "_n").sortWithinPartitions("doc_id", "_h", "_n").select("doc_id", "text")
    ranged.mapInArrow(run, SCHEMA).write.parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document, decoded from the shards."""

    def run(batches):
        wordbpe.forget()
        for batch in batches:
            for part, shard, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = Shard(payload.as_py())
                ids, starts = s.all().astype("<u4"), s.starts.astype(np.int64)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int64()), pa.array([shard] * n, pa.int64()), pa.array(s.doc_ids, pa.int64()), pa.array(starts[:-1]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())],
                    ["part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    shards = spark.read.schema(SCHEMA).parquet(path)
    docs = shards.select("part", "shard", "payload").mapInArrow(releasing(run), "part long, shard long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row per writing task
    parts = parts.select("part", before(Window.orderBy("part"), "n").alias("part_start"))
    starts = shards.select("part", "shard", before(Window.partitionBy("part").orderBy("shard"), "n_tokens").alias("shard_start")).join(parts, "part")
    placed = docs.join(starts, ["part", "shard"])
    return placed.select("doc_id", (F.col("part_start") + F.col("shard_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_store(spark, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_root(spark)}/token-store-{uuid.uuid4().hex}"
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_store(spark, path)
