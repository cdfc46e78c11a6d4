"""Encoding by a contiguous rank array, and decoding.

Texts are cut into the pieces that the file's rules name, and each different piece is encoded once per
worker. A short piece is a row of two arrays that stay contiguous: the boundaries of its parts and, beside
each part, the rank at which it merges with the next. All rows of a batch are scanned for their smallest
rank, leftmost first, the boundary inside that pair is deleted, and the two ranks beside the new part are
looked up again, until no row has a rank left. A long piece, where scanning would take the square of its
length, keeps its ranks in a heap instead.

Ids are those of the tokenizers library without truncation and padding; decoding joins the tokens by a
space where the file names no decoder, and goes by the file's decoder otherwise.

Defined cases: a null or empty text has no ids and decodes to an empty text; very long texts and pieces are
encoded whole; of equal ranks the leftmost merges first; repeated rows get equal results; an empty table
gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm import wordbpe
from quarryline.llm.runtime import releasing

#: Bytes up to which a piece is short.
SHORT = 48
NONE = np.int32(2**31 - 1)
_CODERS: dict[str, RankCoder] = {}


def byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = iter(range(256, 512))
    return [chr(b if b in set(plain) else next(moved)) for b in range(256)]


class Merges:
    """Rank and outcome of each pair of ids that merges, found by open addressing."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.pairs = pairs
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys, self.rank, self.made = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32), np.full(1 << self.bits, -1, np.int32)
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        values = np.array(list(pairs.values()), np.int32).reshape(-1, 2)
        at, left = self._slots(keys), np.arange(len(keys))
        while len(left):  # of those that want one free slot the first has it, the others go on to the next
            spot = at[left]
            _, chosen = np.unique(spot, return_index=True)
            won = left[chosen][self.keys[spot[chosen]] == -1]
            self.keys[at[won]], self.rank[at[won]], self.made[at[won]] = keys[won], values[won, 0], values[won, 1]
            lost = np.ones(len(keys), bool)
            lost[won] = False
            left = left[lost[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, id made) of each pair, NONE and -1 if it doesn't merge; negative ids never do."""
        keys = (a.astype(np.int64) << 32) | b
        keys[(a < 0) | (b < 0)] = -2
        at = self._slots(keys)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != -1) & (keys != -2))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[open_]]
            open_ = open_[(held != keys[open_]) & (held != -1)]
        hit = self.keys[at] == keys
        return np.where(hit, self.rank[at], NONE), np.where(hit, self.made[at], np.int32(-1))


class RankCoder(wordbpe.WordEncoder):
    """Texts to ids and back by the vocabulary and merges of a tokenizers file of byte-level BPE."""

    def __init__(self, path: str, limit: int = 900_000):
        super().__init__(path, limit)
        with open(path, encoding="utf8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges") or any(c + e not in vocab for c in letters for e in ("", end)):
            raise ValueError("a byte-level BPE file with plain merges is needed")
        self.letter = {c: b for b, c in enumerate(letters)}
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + end] for c in letters], np.int32)
        split = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = Merges({(vocab[a], vocab[b]): (n, vocab[a + b]) for n, (a, b) in enumerate(split)})
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.plain_added = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec.get("added_tokens") or [])
        self.cuts = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.tokens = pa.array([t for t, _ in sorted(names.items(), key=lambda x: x[1])])
        if sorted(names.values()) != list(range(len(names))) or not self.plain_added:
            raise ValueError("ids with gaps, or special tokens that take in what stands around them")
        self.joined = spec.get("decoder") is None

    def pieces(self, part: bytes) -> list[bytes | int]:
        """The pieces of a part by the file's own rules, special tokens as their ids."""
        out: list[bytes | int] = []
        for text in self.cuts.split(part.decode()) if self.cuts else [part.decode()]:
            if text in self.added:
                out.append(self.added[text])
            elif text:
                text = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
                out += [bytes(map(self.letter.__getitem__, p)) for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return out

    def _learn(self, missing: list[bytes]) -> None:
        plain = re.compile(rb"(?:[\x21-\x26\x28-\x3b\x3d-\x7e]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*")
        whole = [self.by_part and plain.fullmatch(p) is not None for p in missing]
        alone = [p for p, w in zip(missing, whole, strict=True) if w]
        ids, sizes, _ = self.ranked(alone)
        self._add(alone, ids.astype(np.uint32), sizes)
        odd = [p for p, w in zip(missing, whole, strict=True) if not w]
        if odd:
            lists = [self.pieces(p) for p in odd]
            ids, sizes, _ = self.ranked([x for some in lists for x in some if isinstance(x, bytes)])
            ends = iter(np.cumsum(sizes).tolist())
            flat, counts, at = [], [], 0
            for some in lists:
                n = len(flat)
                for x in some:
                    if isinstance(x, bytes):
                        begin, at = at, next(ends)
                        flat += ids[begin:at].tolist()
                    else:
                        flat.append(x)
                counts.append(len(flat) - n)
            self._add(odd, np.array(flat, np.uint32), np.array(counts, np.int64))

    def ranked(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all pieces one after the other, how many each has, the byte at which each id's part begins)."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts, done = np.zeros(len(pieces), np.int64), []
        for i in np.flatnonzero(size > SHORT).tolist():
            ids, bounds = self._heap(pieces[i])
            counts[i] = len(ids)
            done.append((np.array([i]), ids, bounds))
        low = 0
        for high in (2, 3, 4, 6, 8, 10, 13, 17, 24, SHORT):
            rows = np.flatnonzero((size > low) & (size <= high))
            low = high
            for k in range(0, len(rows), 1 << 14):
                some = rows[k : k + (1 << 14)]
                raw = np.frombuffer(b"".join([pieces[i].ljust(high, b"\0") for i in some.tolist()]), np.uint8).reshape(len(some), high)
                ids, bounds, counts[some] = self._scan(raw, size[some])
                done.append((some, ids, bounds))
        begin = np.cumsum(counts) - counts
        flat, where = np.empty(int(counts.sum()), np.int32), np.empty(int(counts.sum()), np.int32)
        for rows, ids, bounds in done:
            n = counts[rows]
            at = np.repeat(begin[rows] - np.cumsum(n) + n, n) + np.arange(len(ids))
            flat[at], where[at] = ids, bounds
        return flat, counts, where

    def _scan(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rank arrays of all rows of ``raw`` side by side, as (ids, boundaries, parts of each row): a step of the scan is one deleted boundary in each row that still merges."""
        n, width = raw.shape
        line, column = np.arange(n), np.arange(width)
        parts = np.full((n, width + 1), -1, np.int32)  # a part's id stands for the bytes between its boundary and the next
        parts[:, :width] = np.where(column < sizes[:, None], self.inner[raw], np.int32(-1))
        parts[line, sizes - 1] = self.final[raw[line, sizes - 1]]
        bounds = np.tile(np.arange(width + 1, dtype=np.uint8), (n, 1))
        rank, made = (x.reshape(n, width) for x in self.merges.find(parts[:, :-1].ravel(), parts[:, 1:].ravel()))
        left = sizes.copy()
        rows = line[rank.min(axis=1) != NONE]
        while len(rows):
            at = rank[rows].argmin(axis=1)
            new = made[rows, at]
            # delete the boundary behind `at`: everything beyond moves one place to the left
            move = np.minimum(column + (column > at[:, None]), width)
            wide = np.concatenate([move, np.full((len(rows), 1), width)], axis=1)
            p = np.take_along_axis(parts[rows], wide, axis=1)
            p[np.arange(len(rows)), at] = new
            parts[rows], bounds[rows] = p, np.take_along_axis(bounds[rows], wide, axis=1)
            inside = np.minimum(move, width - 1)
            r, m = np.take_along_axis(rank[rows], inside, axis=1), np.take_along_axis(made[rows], inside, axis=1)
            r[:, -1] = NONE
            k = np.arange(len(rows))
            r[k, at], m[k, at] = self.merges.find(new, p[k, at + 1])
            before = np.flatnonzero(at > 0)
            r[before, at[before] - 1], m[before, at[before] - 1] = self.merges.find(p[before, at[before] - 1], new[before])
            rank[rows], made[rows] = r, m
            left[rows] -= 1
            rows = rows[r.min(axis=1) != NONE]
        used = np.arange(width + 1) < left[:, None]
        return parts[used], bounds[used], left

    def _heap(self, piece: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The same for one long piece: the smallest rank comes from a heap, boundaries from linked lists."""
        raw = np.frombuffer(piece, np.uint8)
        ids = self.inner[raw].tolist()
        ids[-1] = int(self.final[raw[-1]])
        after, before, pairs, heap = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)], self.merges.pairs, []

        def refresh(a: int) -> None:
            if a >= 0 and after[a] >= 0 and (found := pairs.get((ids[a], ids[after[a]]))):
                heapq.heappush(heap, (found[0], a, ids[a], ids[after[a]], found[1]))

        for a in range(len(ids)):
            refresh(a)
        while heap:
            _, a, one, two, new = heapq.heappop(heap)
            b = after[a]
            if ids[a] != one or b < 0 or ids[b] != two:
                continue  # one of the parts has merged since
            ids[a], ids[b], after[a] = new, -1, after[b]
            if after[b] >= 0:
                before[after[b]] = a
            refresh(before[a])
            refresh(a)
        at = [i for i, x in enumerate(ids) if x >= 0]
        return np.array([ids[i] for i in at], np.int32), np.array(at, np.int32)

    def _encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.by_part:
            return super()._encode(texts)
        self.forget()
        names = list(dict.fromkeys(texts))
        self._learn(names)
        at = np.array([self.spot[t] for t in texts], np.int64)
        return np.concatenate([self.ids[:0], *[self.ids[self.begin[i] : self.begin[i + 1]] for i in at.tolist()]]), self.begin[at + 1] - self.begin[at]

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """The texts that runs of ``ids`` stand for, special tokens included."""
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        if not self.joined:
            return pa.array([self.tokenizer.decode(ids[a:z].tolist(), skip_special_tokens=False) for a, z in zip(offsets, offsets[1:], strict=False)], pa.string())
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pc.take(self.tokens, pa.array(ids))), " ")


def coder(path: str) -> RankCoder:
    if path not in _CODERS:
        _CODERS[path] = RankCoder(path)
    return _CODERS[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of each row of ``docs`` (doc_id, text)."""
    file = path or wordbpe.default_file()

    def run(batches):
        c = coder(file)
        for batch in batches:
            for b in wordbpe.slices(batch, 1, 2 << 20):
                ids, sizes = c.encode(wordbpe.text_bytes(b.column(1)))
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), lists], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(releasing(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, text) of each row of ``encoded`` (doc_id, ids); null ids decode to an empty text."""
    file = path or wordbpe.default_file()

    def run(batches):
        c = coder(file)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            block = (np.cumsum(sizes) - sizes) >> 20  # about a million ids a block
            for k in np.flatnonzero(np.diff(block, prepend=-1)).tolist():
                n = int(np.searchsorted(block, block[k], "right")) - k
                b = batch.slice(k, n)
                yield pa.RecordBatch.from_arrays([*b.columns, c.decode(b.column(1).flatten().to_numpy(), sizes[k : k + n])], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(releasing(run), "doc_id long, ids array<int>, text string")


def op12_rank_array(spark, sf_dir: str) -> DataFrame:
    found = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    digest = lambda c: F.sha2(c, 256)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join("ids", " ")).alias("ids_sha256"), digest(F.col("text")).alias("decoded_sha256"))
