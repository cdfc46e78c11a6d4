"""Encoding of whole texts by a tokenizers file, with each different part of a word encoded once per worker."""

from __future__ import annotations

import gc
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ENCODERS: dict[str, WordEncoder] = {}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Classes of bytes: white space, letters, marks, digits (a part each), and what only the file's own rules can cut.
WHITE, LETTER, MARK, DIGIT, OTHER = range(5)


def _classes() -> tuple[bytes, bytes, np.ndarray]:
    """(class of each byte, lower case of each byte, whether a byte after C3 makes a letter of Latin-1)."""
    kind, lower = np.full(256, OTHER, np.uint8), np.arange(256, dtype=np.uint8)
    kind[list(b" \t\n\r\x0b\x0c")] = WHITE
    kind[list(range(65, 91)) + list(range(97, 123))] = LETTER
    kind[list(b"0123456789")] = DIGIT
    # ASCII marks but those that begin a contraction or a special token
    kind[list(b'!"#$%&()*+,-./:;=>?@[\\]^_`{|}~')] = MARK
    lower[65:91] += 32
    latin = np.zeros(256, bool)
    latin[0x80:0xC0] = True
    latin[[0x97, 0xB7]] = False
    return kind.tobytes(), lower.tobytes(), latin


_KIND, _LOWER, _LATIN = _classes()


def cut(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """(parts of all texts in lower case, where each text's parts begin, and the end).

    A part is a run of letters, a run of marks or a digit, or a whole word that holds any other character;
    such a word keeps its case.
    """
    raw = b" ".join([*texts, b""])
    data, kind, low = (np.frombuffer(x, np.uint8) for x in (raw, bytearray(raw.translate(_KIND)), bytearray(raw.translate(_LOWER))))
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[_LATIN[data[lead + 1]]]
    kind[lead], kind[lead + 1] = LETTER, LETTER
    capital = lead[data[lead + 1] < 0x9F] + 1  # 80..9E are the capitals of A0..BE
    low[capital] += np.uint8(0x20)
    if len(odd := np.flatnonzero(kind == OTHER)):
        white = np.flatnonzero(kind == WHITE)
        after = np.unique(np.searchsorted(white, odd))
        begin, end = np.where(after > 0, white[after - 1] + 1, 0), white[after]
        sizes = end - begin
        whole = np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        kind[whole], low[whole] = OTHER, data[whole]
    solid = kind != WHITE
    first = solid.copy()
    first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    at = np.flatnonzero(first)
    before = np.cumsum(solid, dtype=np.int32)  # the first byte of a part counts itself
    offsets = np.append(before[at] - 1, before[-1]).astype(np.int32)
    parts = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(low[solid])])
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return parts, np.searchsorted(at, np.concatenate([[0], np.cumsum(sizes)]))


class WordEncoder:
    """Ids of texts. Parts of words are encoded apart where the file's own rules never look across them.

    ``limit`` bounds the parts remembered; past it all are forgotten.
    """

    def __init__(self, path: str, limit: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        with open(path, encoding="utf8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        first = steps[0] if steps else {}
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.by_part = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and first.get("pattern", {}).get("Regex") == _SPLIT and bool(suffix)
        # for parts, which are in lower case and cut already
        cuts = [{"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        self.of_parts = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": cuts}})) if self.by_part else None
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.spot: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin = np.zeros((1 << 14) + 1, np.int64)  # of each remembered part, and the end of the last

    def _learn(self, missing: list[bytes]) -> None:
        odd = re.compile(rb"[\x00-\x08\x0e-\x1f'<\x7f-\xff]")
        latin = re.compile(rb"(?:[\x20-\x7e]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*")
        plain = [p for p in missing if not odd.search(p) or (latin.fullmatch(p) and b"'" not in p and b"<" not in p)]
        for k in range(0, len(plain), 6400):
            some = plain[k : k + 6400]
            found = self.of_parts.encode_batch_fast([b" ".join(some[i : i + 64]).decode() for i in range(0, len(some), 64)], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in found])
            sizes = np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0)
            if len(sizes) != len(some):
                raise ValueError("a part without a marked end")
            self._add(some, ids, sizes)
        known = set(plain)
        rest = [p for p in missing if p not in known]
        if rest:
            found = self.tokenizer.encode_batch_fast([p.decode() for p in rest], add_special_tokens=False)
            self._add(rest, np.concatenate([np.array(e.ids, np.uint32) for e in found]), np.array([len(e.ids) for e in found]))

    def _add(self, parts: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, end = len(self.spot), self.used + len(ids)
        while len(self.ids) < end:
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        while len(self.begin) < n + len(parts) + 1:
            self.begin = np.concatenate([self.begin, np.zeros(len(self.begin), np.int64)])
        self.ids[self.used : end] = ids
        self.begin[n + 1 : n + len(parts) + 1] = self.used + np.cumsum(sizes)
        self.used = end
        self.spot.update(zip(parts, range(n, n + len(parts)), strict=True))

    def encode(self, texts: list[bytes], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, how many each has); each text's end with ``end_id`` if given."""
        gc.disable()  # the many small objects made here hold no cycles
        try:
            ids, sizes = self._encode(texts)
        finally:
            gc.enable()
        if end_id is None:
            return ids, sizes
        return np.insert(ids, np.cumsum(sizes), np.uint32(end_id)), sizes + 1

    def _encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_part:
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64)
        if not texts:
            return self.ids[:0], np.zeros(0, np.int64)
        parts, firsts = cut(texts)
        coded = parts.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.spot) + len(names) > self.limit:
            self.forget()
        spots = list(map(self.spot.get, names))
        if None in spots:
            self._learn([p for p, s in zip(names, spots, strict=True) if s is None])
            spots = list(map(self.spot.__getitem__, names))
        at = np.array(spots, np.int64)
        begins, lengths = self.begin[at], self.begin[at + 1] - self.begin[at]
        code = coded.indices.to_numpy()
        size = lengths.astype(np.int32)[code]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        narrow = np.int32 if max(total, self.used) < 1 << 30 else np.int64
        shift = begins.astype(narrow)[code] - (ends - size).astype(narrow)
        ids = self.ids[np.repeat(shift, size) + np.arange(total, dtype=narrow)]
        return ids, np.diff(np.concatenate([[0], ends])[firsts])


def forget() -> None:
    """Drop the parts that this worker remembers, once a job's encoding is over."""
    for e in _ENCODERS.values():
        e.forget()


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    binary = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(binary).to_pylist()]


def slices(batch: pa.RecordBatch, column: int, most: int = 8 << 20):
    """Parts of a batch with about ``most`` bytes of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, begin = np.cumsum(sizes), 0
    while begin < batch.num_rows:
        n = max(1, int(np.searchsorted(total, most + (total[begin - 1] if begin else 0), "right")) - begin)
        yield batch.slice(begin, n)
        begin += n
