"""Merge-dropout encoding with a SentencePiece merge-type model, and its decoding.

A text is cut before runs of the space mark, which no piece crosses. Every part has an agenda of
candidate merges, best score first and leftmost first among equals; each candidate that comes up is
skipped if a keyed hash of (seed, document, part, number on the agenda) falls below the dropout, and
merged otherwise. A skipped candidate comes back only when a merge beside it makes a new one. Equal
keys give equal segmentations; other seeds give others; all decode to the very text, characters
outside the vocabulary by way of byte pieces.

Parts are worked on side by side in arrays, one agenda step of all of them at a time. The result of
an agenda without a skip is remembered per part, with its number of steps.

Defined cases: a null or empty text has no pieces; a very long text is worked on whole, a long part
with a heap; of equal scores the leftmost merges first; a null doc_id is keyed as zero; repeated rows with
one doc_id get one segmentation; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import gc
import heapq
import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm import wordbpe

SPACE = "▁"
LONG = 48
NONE = np.int32(2**31 - 1)
_MODELS: dict[str, MergeModel] = {}


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class MergeModel:
    def __init__(self, path: str, limit: int = 2_000_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.trainer_spec.model_type != 2 or proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("a merge-type model without normalisation is needed")
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        pieces = [(i, p.piece, p.score) for i, p in enumerate(proto.pieces) if p.type == 1]
        if any(SPACE in p.lstrip(SPACE) for _, p, _ in pieces):
            raise ValueError("a piece crosses the space mark")
        self.size = len(proto.pieces)
        if self.size > 1 << 16:
            raise ValueError("more pieces than 16 bits can name")
        self.id = {p: i for i, p, _ in pieces}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.raw = [b""] * self.size
        for i, p, _ in pieces:
            self.raw[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            self.raw[i] = bytes([b])
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.raw_begin = np.concatenate([[0], np.cumsum([len(r) for r in self.raw])])
        levels = {s: n for n, s in enumerate(sorted({s for _, _, s in pieces}, reverse=True))}
        self.rank = np.full(self.size, NONE, np.int32)
        for i, _, s in pieces:
            self.rank[i] = levels[s]
        pairs = {}
        for i, p, _ in pieces:
            for cut in range(1, len(p)):
                a, b = self.id.get(p[:cut]), self.id.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = i
        self.pairs = pairs
        self._table(pairs)
        self.limit = limit
        self._forget()

    def _table(self, pairs: dict[int, int]) -> None:
        """Open addressing: every pair lies within ``self.reach`` slots of its hash."""
        self.bits = max(4, (len(pairs) * 4).bit_length())
        self.keys, self.values, self.reach = np.full((1 << self.bits) + 64, -1, np.int64), np.full((1 << self.bits) + 64, -1, np.int32), 1
        keys = np.array(list(pairs), np.int64)
        for k, at in zip(keys.tolist(), self._slot(keys).tolist(), strict=True):
            n = 0
            while self.keys[at + n] != -1:
                n += 1
            self.keys[at + n], self.values[at + n] = k, pairs[k]
            self.reach = max(self.reach, n + 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Id of the piece that each pair of symbols makes, -1 if none."""
        keys = (a.astype(np.int64) << 20) | b
        keys[(a < 0) | (b < 0)] = -2
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], np.int32(-1))
        left = np.flatnonzero((out < 0) & (self.keys[at] != -1) & (keys >= 0))
        for n in range(1, self.reach):
            if not len(left):
                break
            spot = at[left] + n
            hit = self.keys[spot] == keys[left]
            out[left[hit]] = self.values[spot[hit]]
            left = left[~hit & (self.keys[spot] != -1)]
        return out

    def _skips(self, base: np.ndarray, step: np.ndarray, bound: np.uint64) -> np.ndarray:
        return _mix(base + step.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)) < bound

    def agendas(self, parts: list[str], base: np.ndarray, bound: np.uint64) -> tuple[list[bytes], np.ndarray]:
        """Ids (unsigned 16-bit) and agenda steps of each part under its key; ``bound`` 0 never skips."""
        out: list[bytes] = [b""] * len(parts)
        steps = np.zeros(len(parts), np.int64)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        for i in np.flatnonzero(sizes > LONG).tolist():
            out[i], steps[i] = self._agenda(parts[i], int(base[i]), int(bound))
        get, low = self.id.get, 0
        for high in (4, 6, 8, 10, 13, 17, 24, LONG):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            for k in range(0, len(rows), 1 << 15):
                some = rows[k : k + (1 << 15)]
                text = "".join([parts[i].ljust(high, "\0") for i in some.tolist()])
                chars = np.frombuffer(text.encode("utf-32-le"), "<u4").reshape(len(some), high)
                seen, back = np.unique(chars, return_inverse=True)
                ids = np.array([get(chr(c), -1 - c) for c in seen.tolist()], np.int32)
                symbols = ids[back.reshape(chars.shape)]
                symbols[np.arange(high) >= sizes[some][:, None]] = NONE
                self._together(symbols, some, base[some], bound, out, steps)
        return out, steps

    def _together(self, symbols, rows, base, bound, out, steps) -> None:
        width = symbols.shape[1]
        symbols = np.concatenate([symbols, np.full((len(rows), 1), NONE, np.int32)], axis=1)
        free = symbols == NONE
        lookup = np.where(free, np.int32(-1), symbols)
        new = self.merged(lookup[:, :-1].ravel(), lookup[:, 1:].ravel()).reshape(len(rows), width)
        order = np.where(new >= 0, self.rank[new], NONE)
        step = np.zeros(len(rows), np.int64)
        columns = np.arange(width)
        while len(rows):
            at = order.argmin(axis=1)
            line = np.arange(len(rows))
            going = order[line, at] != NONE
            if not going.all():
                done = np.flatnonzero(~going)
                self._write(symbols[done], rows[done], out)
                steps[rows[done]] = step[done]
                rows, base, step, symbols, new, order, at = rows[going], base[going], step[going], symbols[going], new[going], order[going], at[going]
                line = np.arange(len(rows))
                if not len(rows):
                    break
            skip = self._skips(base, step, bound) if bound else np.zeros(len(rows), bool)
            step += 1
            s = np.flatnonzero(skip)
            order[s, at[s]] = NONE
            m = np.flatnonzero(~skip)
            if not len(m):
                continue
            j = at[m]
            made = new[m, j]
            move = columns + (columns > j[:, None])
            sym = np.take_along_axis(symbols[m], np.concatenate([move, np.full((len(m), 1), width)], axis=1), axis=1)
            k = np.arange(len(m))
            sym[k, j] = made
            symbols[m] = sym
            pad = np.full((len(m), 1), -1, np.int32)
            pair = np.take_along_axis(np.concatenate([new[m], pad], axis=1), move, axis=1)
            rank = np.take_along_axis(np.concatenate([order[m], pad + np.int32(0)], axis=1), move, axis=1)
            rank[:, -1] = NONE
            right = sym[k, j + 1]
            value = self.merged(made, np.where(right == NONE, np.int32(-1), right))
            pair[k, j], rank[k, j] = value, np.where(value >= 0, self.rank[value], NONE)
            has = np.flatnonzero(j > 0)
            before = sym[has, j[has] - 1]
            value = self.merged(before, made[has])
            pair[has, j[has] - 1], rank[has, j[has] - 1] = value, np.where(value >= 0, self.rank[value], NONE)
            new[m], order[m] = pair, rank

    def _write(self, symbols: np.ndarray, rows: np.ndarray, out: list[bytes]) -> None:
        used = symbols != NONE
        odd = (symbols < 0).any(axis=1)
        sizes = used.sum(axis=1) * 2
        flat = symbols[used & ~odd[:, None]].astype("<u2").tobytes()
        at = 0
        for i, n, o in zip(rows.tolist(), sizes.tolist(), odd.tolist(), strict=True):
            if not o:
                out[i] = flat[at : at + n]
                at += n
        for r in np.flatnonzero(odd).tolist():
            out[rows[r]] = self._bytes([int(x) for x in symbols[r] if x != NONE])

    def _bytes(self, symbols: list[int]) -> bytes:
        ids = []
        for x in symbols:
            ids += [x] if x >= 0 else [self.byte[b] for b in chr(-1 - x).encode()]
        return np.array(ids, "<u2").tobytes()

    def _agenda(self, part: str, base: int, bound: int) -> tuple[bytes, int]:
        """The same for one long part, with a heap."""
        symbols = [self.id.get(c, -1 - ord(c)) for c in part]
        n = len(symbols)
        size, nxt, prv, heap, step = [1] * n, [*range(1, n), -1], list(range(-1, n - 1)), [], 0

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (p := self.pairs.get(symbols[a] << 20 | symbols[b]) if symbols[a] >= 0 and symbols[b] >= 0 else None) is not None:
                heapq.heappush(heap, (int(self.rank[p]), a, b, size[a], size[b], p))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, na, nb, p = heapq.heappop(heap)
            if size[a] != na or size[b] != nb:
                continue
            key = np.array([base], np.uint64)
            skip = bool(bound) and bool(self._skips(key, np.array([step]), np.uint64(bound))[0])
            step += 1
            if skip:
                continue
            symbols[a], size[a], size[b], nxt[a] = p, na + nb, 0, nxt[b]
            if nxt[a] >= 0:
                prv[nxt[a]] = a
            offer(prv[a], a)
            offer(a, nxt[a])
        return self._bytes([s for s, k in zip(symbols, size, strict=True) if k]), step

    def encode(self, texts: list[str], keys: list[int], seed: int = 0, dropout: float = 0.1) -> list[np.ndarray]:
        ids, counts, _ = self.encode_flat(texts, keys, seed, dropout)
        return np.split(ids, np.cumsum(counts)[:-1]) if texts else []

    def encode_flat(self, texts: list[str], keys: list[int], seed: int = 0, dropout: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, how many each has, whether they decode to the very text)."""
        gc.disable()  # the many small objects made here hold no cycles
        try:
            return self._encode(texts, keys, seed, dropout)
        finally:
            gc.enable()

    def _encode(self, texts: list[str], keys: list[int], seed: int, dropout: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bound = np.uint64(min(int(dropout * 2.0**64), 2**64 - 1))
        lead, mark = b" " if self.prefix else b"", SPACE.encode()
        plain = [t.encode() for t in texts]
        marked = np.array([mark in t for t in plain], bool)
        raw = [lead + t.replace(mark, b" ") if t else b"" for t in plain]
        data = np.frombuffer(b"".join(raw), np.uint8)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        space = data == 32
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[bounds[:-1][sizes > 0]] = True
        starts = np.flatnonzero(first)
        offsets = np.append(starts, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        parts = np.diff(np.searchsorted(starts, bounds))
        key = _mix(np.array([k & (2**64 - 1) for k in keys], np.uint64) + _mix(np.array([seed & (2**64 - 1)], np.uint64)))
        number = np.arange(len(starts)) - np.repeat(np.cumsum(parts) - parts, parts)
        base = _mix(np.repeat(key, parts) + number.astype(np.uint64))
        entry = self._remember(names)[code]
        if bound and len(starts):
            self._varied(names, code, entry, base, bound)
        ids, counts = self._gather(entry)
        counts = np.diff(np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(parts)])])
        return ids, counts, self._restores(ids, counts, data, bounds) & ~marked

    def _gather(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the entries one after the other, how many each has)."""
        begin = self.begin[entry]
        counts = self.begin[entry + 1] - begin
        ends = np.cumsum(counts)
        return self.flat[np.repeat(begin - ends + counts, counts) + np.arange(int(ends[-1]) if len(ends) else 0)], counts

    def _restores(self, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Whether each text's ids stand for its bytes."""
        begin = self.raw_begin[ids]
        sizes = self.raw_begin[ids.astype(np.int64) + 1] - begin
        ends = np.cumsum(sizes)
        made = self.raw_bytes[np.repeat(begin - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        if np.array_equal(cuts, bounds):
            wrong = np.concatenate([[0], np.cumsum(made != data)])
            return wrong[bounds[1:]] == wrong[bounds[:-1]]
        return np.array([np.array_equal(made[a:z], data[c:e]) for a, z, c, e in zip(cuts, cuts[1:], bounds, bounds[1:], strict=False)], bool)

    def _forget(self) -> None:
        self.spot: dict[bytes, int] = {}  # entry of each part without a skip
        self.variant: dict[int, int] = {}  # entry by that of the part and the bits of its skips
        self.flat, self.begin, self.steps, self.n = np.zeros(1 << 16, np.uint16), np.zeros((1 << 14) + 1, np.int64), np.zeros(1 << 14, np.int32), 0

    def _store(self, made: list[bytes], steps: np.ndarray) -> np.ndarray:
        """The new entries of segmentations."""
        ids = np.frombuffer(b"".join(made), "<u2")
        entries = np.arange(self.n, self.n + len(made))
        used = int(self.begin[self.n])
        self.n += len(made)
        if len(self.steps) < self.n:
            more = max(len(self.steps), self.n - len(self.steps))
            self.begin = np.concatenate([self.begin, np.zeros(more, np.int64)])
            self.steps = np.concatenate([self.steps, np.zeros(more, np.int32)])
        if len(self.flat) < used + len(ids):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint16)])
        self.flat[used : used + len(ids)] = ids
        self.begin[entries + 1] = used + np.cumsum(np.fromiter(map(len, made), np.int64, len(made)) // 2)
        self.steps[entries] = steps
        return entries

    def _remember(self, names: list[bytes]) -> np.ndarray:
        """The entry of each part's agenda without a skip."""
        if self.n + len(names) > self.limit:
            self._forget()
        spots = list(map(self.spot.get, names))
        if None in spots:
            fresh = [p for p, s in zip(names, spots, strict=True) if s is None]
            made, steps = self.agendas([_text(p) for p in fresh], np.zeros(len(fresh), np.uint64), np.uint64(0))
            self.spot.update(zip(fresh, self._store(made, steps).tolist(), strict=True))
            spots = list(map(self.spot.__getitem__, names))
        return np.array(spots, np.int64)

    def _varied(self, names: list[bytes], code: np.ndarray, entry: np.ndarray, base: np.ndarray, bound: np.uint64) -> None:
        """Put the right entry where something is skipped in a part's agenda.

        What a part becomes depends on the skips among its steps only; results whose agenda is at most one
        step longer than the plain one are remembered by part and skips.
        """
        steps = self.steps[entry]
        skips, left = np.zeros(len(entry), np.int64), np.flatnonzero(steps > 0)
        for n in range(min(31, int(steps.max(initial=0)) + 1)):
            left = left[steps[left] >= n]
            hit = left[self._skips(base[left], np.full(len(left), n), bound)]
            skips[hit] |= 1 << n
        wide = steps > 30
        rows = np.flatnonzero(wide | ((skips & ((1 << np.minimum(steps, 30).astype(np.int64)) - 1)) > 0))
        own = rows[wide[rows]]
        rows = rows[~wide[rows]]
        keys, one, back = np.unique(entry[rows] << 31 | skips[rows], return_index=True, return_inverse=True)
        found = np.fromiter(map(self.variant.get, keys.tolist(), itertools.repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(found < 0)
        if len(new):
            which = rows[one[new]]
            made, taken = self.agendas([_text(names[c]) for c in code[which].tolist()], base[which], bound)
            found[new] = self._store(made, taken)
            short = taken <= steps[which] + 1
            self.variant.update(zip(keys[new[short]].tolist(), found[new[short]].tolist(), strict=True))
            loose = np.zeros(len(keys), bool)
            loose[new[~short]] = True
            again = loose[back]
            again[one[new]] = False  # these are the very rows that were worked out
            own = np.concatenate([own, rows[again]])
        entry[rows] = found[back]
        if len(own):
            made, taken = self.agendas([_text(names[c]) for c in code[own].tolist()], base[own], bound)
            entry[own] = self._store(made, taken)

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return (raw[1:] if self.prefix and raw[:1] == b" " else raw).decode()


def _text(part: bytes) -> str:
    return part.decode().replace(" ", SPACE)


def model(path: str) -> MergeModel:
    if path not in _MODELS:
        _MODELS[path] = MergeModel(path)
    return _MODELS[path]


def encode(docs: DataFrame, seed: int = 17, dropout: float = 0.1, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, lossless) of each row of ``docs`` (doc_id, text), with the ids as unsigned 16-bit ``ids`` if asked.

    A space mark that is itself in a text decodes to a space, as the format has it; ``lossless`` says so.
    """
    file = path or default_file()
    schema = "doc_id long, n_pieces long, ids_crc32 long, lossless boolean" + ", ids binary" * with_ids

    def run(batches):
        m = model(file)
        for batch in batches:
            for b in wordbpe.slices(batch, 1, 4 << 20):
                texts = [t or "" for t in b.column(1).to_pylist()]
                docs = b.column(0).to_pylist()
                flat, counts, lossless = m.encode_flat(texts, [d or 0 for d in docs], seed, dropout)
                ends, wide = np.cumsum(counts), flat.astype("<u4")
                cuts = list(zip((ends - counts).tolist(), ends.tolist(), strict=True))
                columns = [pa.array(docs, pa.int64()), pa.array(counts), pa.array([zlib.crc32(wide[a:z]) for a, z in cuts], pa.int64()), pa.array(lossless)]
                if with_ids:
                    columns.append(pa.array([flat[a:z].tobytes() for a, z in cuts], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pieces", "ids_crc32", "lossless", "ids"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, schema)


def op1_merge_dropout(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
