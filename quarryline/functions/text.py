"""Text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[A-Za-z0-9_]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words that carry no topic, for evidence and for curation.
CONTENT_STOPWORDS = (
    "a an and are as at be by can could did do does for from had has have how i if "
    "in is it its may of on or should that the their them then there these they this those "
    "to was were what when where which who why will with would you your "
    "please sorry thank thanks yes okay oops meant want know tell bit confused "
    "think correct sure really also about"
).split()
CURATION_STOPWORDS = (
    "a an and are as at be by for from has have how i in is it of on or that the "
    "their this to was what when where which who why with you your"
).split()
#: Fixed value: sentence boundaries.
SENTENCE = r"(?<=[.!?])\s+|(?<=[a-z][.!?])(?=[A-Z])|(?<=[a-z])(?=(?:From|This|The|Our)\s)"
#: Splits by hash bucket out of 10,000.
SPLIT_BOUNDS = (("train", 6522), ("dev", 7826), ("test", 10000))


def words_literal(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


def small_tokens(text: Column) -> Column:
    """:func:`tokens` without a lambda: A-Z are lowered before the text is cut."""
    return F.regexp_extract_all(F.translate(text, UPPER, UPPER.lower()), F.lit("[a-z0-9_]+"), F.lit(0))


def n_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def curation_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def content_terms(text: Column) -> Column:
    """Different tokens of three characters or more that aren't stopwords."""
    return F.array_distinct(F.array_except(F.filter(tokens(text), lambda t: F.length(t) > 2), words_literal(CONTENT_STOPWORDS)))


def sentences(text: Column) -> Column:
    """Trimmed sentences with single spaces; empty ones are left out."""
    parts = F.transform(F.split(F.trim(text), SENTENCE, -1), squeeze)
    return F.filter(parts, lambda s: s != "")


def squeeze(text: Column) -> Column:
    """White-space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def text_digest(text: Column) -> Column:
    return F.sha1(squeeze(text))


def host_of(url: Column) -> Column:
    """Lower-cased authority of a URL, empty if there is none or it can't be parsed."""
    return F.lower(F.coalesce(F.call_function("try_parse_url", url, F.lit("AUTHORITY")), F.lit("")))


def tidy_lines(text: Column) -> Column:
    """Runs of blank lines as one, runs of blanks as one space, lines and text trimmed."""
    t = F.regexp_replace(F.regexp_replace(text, r"\n[ \t]*(?:\n[ \t]*){2,}", "\n\n"), r"[ \t]+", " ")
    lines = F.array_join(F.transform(F.split(t, "\n", -1), strip), "\n")
    return strip(lines)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def expand_query(text: Column) -> Column:
    """Tokens of a query, the first south america rewritten to the corpus's words."""
    joined = F.array_join(tokens(text), " ")
    return F.regexp_replace(joined, r"^((?:(?!\bsouth america\b).)*)\bsouth america\b", "$1sao paulo br sao")


def normalize_asr(text: Column) -> Column:
    """Lower case, everything but letters, digits and underscores to spaces, squeezed."""
    return squeeze(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def normalize_answer(text: Column) -> Column:
    """Lower case without ASCII punctuation and articles, squeezed."""
    bare = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return squeeze(F.regexp_replace(bare, r"\b(?:a|an|the)\b", " "))


def clean_html(text: Column) -> Column:
    """Tags out, the five predefined character references decoded."""
    t = F.regexp_replace(text, "<[^>]*>", "")
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(value))
    return t


def current_question(text: Column) -> Column:
    return F.trim(F.substring_index(text, " Current question:", -1))


def document_group(domain: Column, url: Column, passage_id: Column) -> Column:
    """By URL without its fragment, or by id without its last two parts."""
    u = F.split(F.lower(F.trim(url)), "#", 2)[0]
    parts = F.size(F.split(passage_id, "-"))
    prefix = F.when(parts >= 3, F.array_join(F.slice(F.split(passage_id, "-"), F.lit(1), F.greatest(parts - 2, F.lit(0))), "-")).otherwise(passage_id)
    return F.when(F.trim(url) != "", F.concat_ws(":", domain, F.lit("url"), u)).otherwise(F.concat_ws(":", domain, F.lit("id"), prefix))


def assigned_split(group: Column, seed: int = 20260928) -> Column:
    """First eight bytes of a SHA-256 modulo 10,000, looked up in the splits."""
    high = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), group), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    bucket = high % F.lit(10000).cast("decimal(20,0)")
    out = F.lit(None)
    for name, bound in reversed(SPLIT_BOUNDS):
        out = F.when(bucket < bound, name).otherwise(out)
    return out


def hashed_id(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(key, 256), 1, 16))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False))
    return F.when(at > 0, at - 1).otherwise(F.least(F.size(a), F.size(b))).cast("long")


def locate(text: Column, span: Column) -> Column:
    """0-based start of ``span`` in ``text``, null if it isn't there."""
    at = F.call_function("instr", text, span)
    return F.when(at > 0, at - 1)


def rating(text: Column) -> Column:
    """Score of a judge's reply in tenths; of the known forms the last one that occurs counts, else a half."""
    clean = F.regexp_replace(text, r"(?im)for example:.*?$", "")
    out = F.lit(0.5)
    for form in RATING_FORMS:
        found = F.regexp_extract(clean, "(?i)" + form, 1)
        out = F.when(clean.rlike("(?i)" + form), found.try_cast("double") / 10).otherwise(out)
    return F.when((out <= 0) | (out > 1), F.lit(0.5)).otherwise(out)


#: Forms of a rating, weakest first.
RATING_FORMS = (
    r"Rating: \[\[(\d+)\]\]",
    r"Rating: (\d+)",
    r"\[\[(\d+)\]\]",
    r"\[(\d+)\]",
    r"Rating: \[\[([0-9]*\.?[0-9]+)\]\]",
    r"Overall Rating: ([0-9]*\.?[0-9]+)",
    r"Score: ([0-9]*\.?[0-9]+)/10",
    r"Score: ([0-9]*\.?[0-9]+)",
    r"\[Rating\]\n(\d+)",
    r"Rating: \[\[(\d+)/10\]\]",
    r"Rating: \[\[([-+]?\d*\.?\d+)",
    r"([-+]?\d*\.?\d+) out of 10",
)


def first_token_verdict(text: Column) -> Column:
    """yes 1, no 0, another word 0.5, no word -1."""
    word = F.lower(F.regexp_extract(text, r"^\s*([A-Za-z]+)", 1))
    return F.when(word == "", -1.0).when(word == "yes", 1.0).when(word == "no", 0.0).otherwise(0.5)
