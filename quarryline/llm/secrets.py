"""Secret scans, in DataFrame functions only.

Patterns find the base spans. Beyond them, long tokens are put through a battery of randomness
tests in the encoding that their characters suggest (chi-squared uniformity over its alphabet, with
simulated critical values where few characters are expected in a cell; runs about the middle; lag-1
serial correlation); a token that fails any of them is no random string. For the rest, the likelihood
ratio of uniform characters against ordinary text in that encoding bounds the chance that ordinary
text looks this random: P(ratio >= t) <= 1 / t. Ordinary text is the corpus's own words (see
``background``) and ``Battery.prior`` characters of plain lower-case text, so that what is found
doesn't depend on how many other secrets there are. These bounds, smaller for longer tokens, enter a
Benjamini-Hochberg step-up within each stratum of encoding and length, over all tokens of the corpus.

Offsets are code points, ends exclusive. Defined cases: null and empty texts have no spans; very long
texts are scanned whole, in linear time; null doc_ids and repeated rows are kept; ties between kinds
at one start are in the order of ``KINDS``; equal tokens get one verdict; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.runtime import discard, drop_shuffles, stage_table

KINDS = ("assign", "access", "hex", "random")
#: Pattern, group whose length counts, least length.
BASE = (
    (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    (r"(AKIA[A-Z0-9]+)", 1, 18),
    (r"([0-9a-f]{16,})", 1, 16),
)
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
BLOCK = 256


@dataclass(frozen=True)
class Battery:
    """``least``: shortest token tested; ``alpha``: level at which the battery rejects randomness; ``rate``: false-discovery rate; ``prior``: characters of ordinary text assumed beside those of the corpus."""

    least: int = 20
    alpha: float = 0.001
    rate: float = 0.01
    prior: float = 2000.0


#: Letters in ordinary text, by the thousand (a to z; sources of several languages, rounded).
LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1), strict=True))
#: Stands for a character inside a base span while tokens are looked for; tokens next to one in a text are left out.
COVER = "\ue000"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once; an expression named in a lambda is else worked out for every element."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def _prefix_sums(steps: Column) -> Column:
    """Inclusive sums, by blocks so that the work stays linear in long arrays."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    starts = F.when(F.size(steps) > 0, F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(starts, lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)))

    def inside(block, base):
        return F.transform(block, lambda _, i: base + total(F.slice(block, F.lit(1), i + 1)))

    def joined(v):
        return F.flatten(F.transform(v["blocks"], lambda block, b: let(total(F.slice(v["sums"], F.lit(1), b)), lambda base: inside(block, base))))

    return let(blocks, lambda bs: let(F.struct(bs.alias("blocks"), F.transform(bs, total).alias("sums")), joined))


def matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """Array of (start, end, body): leftmost non-overlapping matches whose group has ``least`` characters."""
    whole, body, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.split(text, pattern, -1)

    def placed(v):
        n = F.size(v["size"])
        before = F.concat(F.array(F.lit(0).cast("long")), v["size"])
        steps = F.zip_with(F.slice(v["between"], F.lit(1), n), F.slice(before, F.lit(1), n), lambda piece, m: F.length(piece) + m)
        ends = F.zip_with(let(steps, _prefix_sums), v["size"], lambda at, n: F.struct(at.alias("at"), n.alias("n")))
        spans = F.zip_with(ends, v["body"], lambda s, b: F.struct(s["at"].alias("start"), (s["at"] + s["n"]).alias("end"), b.alias("body")))
        return F.filter(spans, lambda s: F.length(s["body"]) >= least)

    parts = F.struct(F.transform(whole, lambda x: F.length(x).cast("long")).alias("size"), body.alias("body"), between.alias("between"))
    return F.when(text.rlike(pattern), let(parts, placed))


def covered(text: Column, pattern: str, group: int, least: int) -> Column:
    """The text with every character of such matches replaced by ``COVER``."""
    whole, body, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.split(text, pattern, -1)
    hidden = F.zip_with(whole, body, lambda w, b: F.when(F.length(b) >= least, F.repeat(F.lit(COVER), F.length(w))).otherwise(w))
    pieces = F.zip_with(between, hidden, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(pieces, "")).otherwise(text)


def _encoding(token: Column) -> Column:
    return (
        F.when(token.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(token.rlike(r"^[A-Z2-7]+$"), "base32")
        .when(token.rlike(r"^[A-Za-z0-9+/]+$"), "base64")
        .when(token.rlike(r"^[A-Za-z0-9_-]+$"), "base64url")
    )


def _upper_tail(z: Column) -> Column:
    """Chance that a standard normal is above z, by the tabled five-term formula (error below 1e-7)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    # Coefficients of the formula.
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _codes(token: Column, alphabet: str) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)


@lru_cache
def critical_values(k: int, alpha: float) -> tuple[tuple[int, float], ...]:
    """(least length, standardised chi-squared above which the uniformity test rejects) for ``k`` letters.

    Simulated from uniform letters at a third of ``alpha`` for each length from which it is used up to
    the next; from 5 expected in a cell on, by the Wilson-Hilferty formula.
    """
    rng, draws, out = np.random.default_rng(k), 30_000, []
    sizes = [n for n in (8, 12, 16, 20, 24, 32, 40, 48, 64, 96, 128, 192, 256, 320) if n < 5 * k]
    for n in sizes:
        cells = rng.integers(0, k, (draws, n)) + np.arange(draws)[:, None] * k
        square = (np.bincount(cells.ravel(), minlength=draws * k).reshape(draws, k).astype(float) ** 2).sum(axis=1)
        out.append((n, float(np.quantile((k / n * square - n - (k - 1)) / math.sqrt(2 * (k - 1)), 1 - alpha / 3))))
    z = 3.4  # upper point of the normal for a third of 0.001; other levels below
    for step in range(60):
        z += (0.5 * math.erfc(z / math.sqrt(2)) - alpha / 3) / max(1e-300, math.exp(-z * z / 2) / math.sqrt(2 * math.pi))
    df = k - 1
    return (*out, (5 * k, (df * (1 - 2 / (9 * df) + z * math.sqrt(2 / (9 * df))) ** 3 - df) / math.sqrt(2 * df)))


def looks_random(codes: Column, k: int, alpha: float) -> Column:
    """Whether none of the three tests, each at a third of ``alpha``, rejects uniform independent ``codes`` in 0..k-1."""
    n = F.size(codes).cast("double")
    square = F.aggregate(F.transform(F.array_distinct(codes), lambda c: F.pow(F.size(F.filter(codes, lambda x: x == c)).cast("double"), 2.0)), F.lit(0.0), lambda s, x: s + x)
    uneven = (k / n * square - n - (k - 1)) / math.sqrt(2 * (k - 1))
    limit = F.lit(math.inf)
    for least, value in critical_values(k, alpha):
        limit = F.when(n >= least, value).otherwise(limit)
    high = F.transform(codes, lambda c: c >= k // 2)
    n1 = F.size(F.filter(high, lambda h: h)).cast("double")
    n2 = n - n1
    tail = lambda a: F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))
    head = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
    runs = 1.0 + F.size(F.filter(F.zip_with(head(high), tail(high), lambda a, b: a != b), lambda x: x))
    mean = 1 + 2 * n1 * n2 / n
    sd = F.sqrt(F.greatest((mean - 1) * (mean - 2) / F.greatest(n - 1, F.lit(1.0)), F.lit(1e-9)))
    p_runs = 2 * _upper_tail(F.abs((runs - mean) / sd))
    mu = (k - 1) / 2
    cross = F.aggregate(F.zip_with(head(codes), tail(codes), lambda a, b: (a - mu) * (b - mu)), F.lit(0.0), lambda s, x: s + x)
    own = F.aggregate(codes, F.lit(0.0), lambda s, x: s + (x - mu) * (x - mu))
    p_serial = 2 * _upper_tail(F.abs(cross / F.greatest(own, F.lit(1e-9)) * F.sqrt(n)))
    return (uneven <= limit) & (F.least(p_runs, p_serial) > alpha / 3)


def background(docs: DataFrame, battery_of: Battery) -> dict[str, dict[str, float]]:
    """How often the words of ``docs`` (text) in each encoding have each of its characters.

    The prior's characters count as well. Base spans don't count, nor do tokens that the battery lets pass and that occur once, as secrets do:
    what is found in one place doesn't depend on how many secrets lie elsewhere.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    for pattern, _, _ in BASE:
        text = F.regexp_replace(text, pattern, " ")
    words = docs.select(F.explode(F.split(text, "[^A-Za-z0-9+/_-]+")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    words = words.select("w", "n", _encoding(F.col("w")).alias("code"))
    passes = F.lit(False)
    for code, alphabet in ALPHABETS.items():
        body = F.lower("w") if code == "hex" else F.col("w")
        passes = F.when(F.col("code") == code, let(_codes(body, alphabet), lambda codes, k=len(alphabet): looks_random(codes, k, battery_of.alpha))).otherwise(passes)
    alone = (F.length("w") >= battery_of.least) & (F.col("n") == 1)
    kept = words.where(F.col("code").isNotNull() & F.when(alone, ~passes).otherwise(True))
    body = F.when(F.col("code") == "hex", F.lower("w")).otherwise(F.col("w"))
    chars = kept.select("code", "n", F.explode(F.split(body, "")).alias("c")).groupBy("code", "c").agg(F.sum("n").alias("n"))
    counts = {code: prior_counts(code, battery_of.prior) for code in ALPHABETS}
    for r in chars.collect():  # at most the alphabets' 176 characters
        counts[r["code"]][r["c"]] += r["n"]
    return counts


def prior_counts(code: str, amount: float) -> dict[str, float]:
    """``amount`` characters of ordinary text in an encoding: letters as often as in prose (capitals where there are no others), every character a little."""
    letters = {c.upper() if code == "base32" else c: n for c, n in LETTERS.items()}
    share = {c: letters.get(c, 0) + 1 for c in ALPHABETS[code]}
    return {c: n * amount / sum(share.values()) for c, n in share.items()}


def scan(docs: DataFrame, battery_of: Battery = Battery()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, base (array of start, kind, end) and found (with the method's spans)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    token = f"([A-Za-z0-9+/_{COVER}-]{{{battery_of.least},}})"
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    rows = docs.select(F.col("doc_id"), text.alias("body"))
    rows = rows.withColumns({f"_m{i}": matches(F.col("body"), *b) for i, b in enumerate(BASE)})
    for b in BASE:  # a token that overlaps a base span holds one of its characters
        rows = rows.withColumn("body", covered(F.col("body"), *b))
    rows = rows.withColumn("_tokens", matches(F.col("body"), token, 1, battery_of.least))
    of_kind = lambda i: lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"))
    spans = [F.coalesce(F.transform(f"_m{i}", of_kind(i)), none) for i in range(len(BASE))]
    rows = rows.select("doc_id", "_tokens", F.array_sort(F.concat(*spans)).alias("base"))
    rows = rows.withColumn("_tokens", F.filter("_tokens", lambda t: ~F.contains(t["body"], F.lit(COVER))))
    rows = rows.withColumn("_tokens", F.transform("_tokens", lambda t: F.struct(t["start"], t["end"], t["body"], _encoding(t["body"]).alias("code"))))
    rows = stage_table(rows.withColumn("_tokens", F.coalesce(F.filter("_tokens", lambda t: t["code"].isNotNull()), F.array().cast("array<struct<start:bigint,end:bigint,body:string,code:string>>"))), "secret-tokens")

    drop_shuffles(docs.sparkSession)  # these plans are large, and the driver is to hold one at a time
    counts = background(docs, battery_of)
    drop_shuffles(docs.sparkSession)

    def scored(t: Column) -> Column:
        """-10 log10 of the false-alarm bound, 0 if a test rejects randomness."""
        out = F.lit(0)
        for code, alphabet in ALPHABETS.items():
            k, total = len(alphabet), sum(counts[code].values())
            share = [math.log((counts[code][c] + 1) / (total + k) * k) for c in alphabet]
            body = F.lower(t["body"]) if code == "hex" else t["body"]
            weights = F.array(*[F.lit(-x) for x in share])

            def level(codes, weights=weights, k=k):
                gain = F.aggregate(codes, F.lit(0.0), lambda s, x: s + F.element_at(weights, x + 1))
                bound = F.least(F.lit(400), F.greatest(F.lit(0), F.floor(gain * 10 / math.log(10)).cast("int")))
                return F.when(looks_random(codes, k, battery_of.alpha), bound).otherwise(0)

            out = F.when(t["code"] == code, let(_codes(body, alphabet), level)).otherwise(out)
        return out

    stratum = lambda t: F.concat(t["code"], F.floor(F.log2(F.length(t["body"]))).cast("string"))
    tokens = rows
    rows = stage_table(rows.withColumn("_tokens", F.transform("_tokens", lambda t: F.struct(t["start"], t["end"], stratum(t).alias("stratum"), scored(t).alias("level")))), "secret-scores")
    discard(tokens)
    drop_shuffles(docs.sparkSession)
    levels = rows.select(F.explode("_tokens").alias("t")).groupBy(F.col("t.stratum").alias("stratum"), F.col("t.level").alias("level")).count()
    by = Window.partitionBy("stratum")
    steps = levels.withColumns({"above": F.sum("count").over(by.orderBy(F.desc("level"))), "m": F.sum("count").over(by)})
    bound = F.pow(F.lit(10.0), -F.col("level") / 10)
    passed = steps.where((F.col("level") > 0) & (bound <= battery_of.rate * F.col("above") / F.col("m"))).groupBy("stratum").agg(F.min("level").alias("least"))
    least = {r["stratum"]: r["least"] for r in passed.collect()}  # at most four encodings by the doublings of a token's length
    if not least:
        return rows.select("doc_id", "base", F.col("base").alias("found"))
    limits = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])
    random = F.filter("_tokens", lambda t: t["level"] >= F.coalesce(F.try_element_at(limits, t["stratum"]), F.lit(1 << 30)))
    found = F.array_sort(F.concat("base", F.transform(random, lambda t: F.struct(t["start"].alias("start"), F.lit(len(BASE)).alias("kind"), t["end"].alias("end")))))
    return rows.select("doc_id", "base", found.alias("found"))


def spans_text(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame, battery_of: Battery = Battery(), mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span of its text replaced by ``mark``; overlapping spans become one mark."""
    # equal texts have equal spans, so these go by two hashes of the text and no copy of the texts is stored
    hashes = {"_h1": F.xxhash64("text"), "_h2": F.xxhash64(F.lit(1), "text")}
    spans = scan(docs.select(F.struct(*[h.alias(name) for name, h in hashes.items()]).alias("doc_id"), "text"), battery_of).where(F.size("found") > 0)
    spans = spans.select("doc_id.*", F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("_spans")).dropDuplicates(["_h1", "_h2"])
    joined = docs.withColumns(hashes).join(spans, ["_h1", "_h2"], "left")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(s, x):
        piece = F.substring(F.col("text"), (s["at"] + 1).cast("int"), F.greatest(x["start"] - s["at"], F.lit(0)).cast("int"))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["end"] <= s["at"], s["parts"]).otherwise(F.concat(s["parts"], F.when((x["start"] < s["at"]) & (s["at"] > 0), F.array().cast("array<string>")).otherwise(F.array(piece, F.lit(mark))))).alias("parts"))

    clean = F.aggregate("_spans", start, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(F.col("text"), (s["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    return joined.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(clean)).select(*docs.columns)


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{KINDS[i]}") for i in range(3)], F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("found").alias("spans"))
