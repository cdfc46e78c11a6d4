"""Places where a model plugs in, with offline defaults: encoders, rerankers and chat clients.

Each plug-in is a factory called once per Python worker; rows reach it in Arrow batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import tokens

ENCODERS: dict[str, Callable[[], Callable[[list[str]], np.ndarray]]] = {}
_READY: dict[str, Callable] = {}


def encoder(name: str):
    """Register a factory of a function from texts to vectors, one row each."""

    def register(factory):
        ENCODERS[name] = factory
        return factory

    return register


def token_bucket(token: str, dim: int) -> tuple[int, float]:
    """Bucket and sign of a token: the low four bytes of its 8-byte BLAKE2b digest, and the parity of the fifth."""
    d = hashlib.blake2b(token.encode(), digest_size=8).digest()
    return int.from_bytes(d[:4], "little") % dim, -1.0 if d[4] & 1 else 1.0


@encoder("hash128")
def hashing(dim: int = 128):
    import re

    known: dict[str, tuple[int, float]] = {}

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for token in re.findall("[A-Za-z0-9_]+", t):
                token = token.lower()
                if token not in known:
                    if len(known) > 200_000:
                        known.clear()
                    known[token] = token_bucket(token, dim)
                bucket, sign = known[token]
                out[i, bucket] += sign
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out / np.where(length == 0, 1.0, length)

    return encode


def _ready(kind: str, name: str, factory: Callable) -> Callable:
    key = f"{kind}:{name}"
    if key not in _READY:
        _READY[key] = factory()
    return _READY[key]


def encode(df: DataFrame, key: str, text: str, backend: str = "hash128", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, embedding) by a registered encoder, and the columns to ``carry``; an unknown encoder falls back to hashing."""
    name = backend if backend in ENCODERS else "hash128"
    factory = ENCODERS[name]
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        model = _ready("encoder", name, factory)
        for b in batches:
            vectors = model([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(vectors), pa.list_(pa.float64())), *b.columns[2:]], [key, "embedding", *carry])

    also = "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in carry)
    return df.select(key, text, *carry).mapInArrow(run, f"{key} {kind}, embedding array<double>{also}")


def overlap_scorer():
    """Share of a query's tokens that a passage holds."""
    import re

    bag = lambda t: {x.lower() for x in re.findall("[A-Za-z0-9_]+", t or "")}
    return lambda pairs: [len(bag(q) & bag(p)) / max(1, len(bag(q))) for q, p in pairs]


def rerank(hits: DataFrame, scorer: Callable = overlap_scorer, depth: int = 50, limit: int = 5) -> DataFrame:
    """The first ``depth`` hits (task_id, id, query, text, rank) in the order of a pair scorer, ties in their old order."""

    def run(batches):
        model = _ready("scorer", scorer.__name__, scorer)
        for b in batches:
            cols = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            s = model(list(zip(cols["query"], cols["text"], strict=True)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([round(float(x), 6) for x in s]), b.column(4)], ["task_id", "id", "score", "old_rank"])

    kinds = {c: hits.schema[c].dataType.simpleString() for c in ("task_id", "id", "rank")}
    scored = hits.where(F.col("rank") <= depth).select("task_id", "id", "query", "text", "rank").mapInArrow(run, f"task_id {kinds['task_id']}, id {kinds['id']}, score double, old_rank {kinds['rank']}")
    w = Window.partitionBy("task_id").orderBy(F.desc("score"), "old_rank")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= limit)


def ask(df: DataFrame, key: str, prompt: str, client: Callable, redact: tuple[str, ...] = ()) -> DataFrame:
    """(key, reply, error, prompt_tokens, completion_tokens) of a chat client; a failure is a row, and secrets are masked in its text.

    ``client`` is a factory of a function from a prompt to (reply, prompt tokens, completion tokens).
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        chat = client()
        for b in batches:
            out = []
            for p in b.column(1).to_pylist():
                try:
                    reply, used, made = chat(p or "")
                    out.append((reply, None, used, made))
                except Exception as e:  # a provider's fault must not end the job
                    said = str(e)
                    for secret in redact:
                        said = said.replace(secret, "[redacted]")
                    out.append((None, said, 0, 0))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64())))], [key, "reply", "error", "prompt_tokens", "completion_tokens"])

    return df.select(key, prompt).mapInArrow(run, f"{key} {kind}, reply string, error string, prompt_tokens long, completion_tokens long")


def native_hash_embedding(df: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """(key, bucket, weight): a hashed bag of tokens without Python, by MD5."""
    words = df.select(key, F.explode(tokens(F.col(text))).alias("t"))
    digest = F.md5("t")
    bucket = F.conv(F.substring(digest, 1, 6), 16, 10).cast("long") % dim
    sign = F.when(F.conv(F.substring(digest, 7, 1), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    return words.groupBy(key, bucket.alias("bucket")).agg(F.sum(sign).alias("weight")).where("weight <> 0")
