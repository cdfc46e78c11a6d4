"""Tests on text as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryline.functions.text import content_terms, curation_tokens, current_question

#: Requests about delivery rather than content.
PRESENTATION = (
    "repeat|say that again|read that back|say again|summarize|summarise|speak|rephrase|replay|go back|"
    "go over that again|start over|start again|never mind|nevermind|hold on|stop|pause|what did you mean|"
    "what did you just say|that's all|thats all|thank you|thanks|got it|sounds good"
)
LONG_PRESENTATION = ("go back to the previous point", "what did you mean by that")
POLITE = r"^(?:(?:can|could|would|will|may)\s+you\s+(?:please\s+)?|(?:please|just|ok|okay)\s+|i\s+(?:want|need)\s+you\s+to\s+)+"
#: The plain command list of the second controller.
COMMANDS = (
    "repeat|summarize|summarise|speak|rephrase|can you rephrase|go back|start over|never mind|hold on|stop|pause|"
    "what did you mean|that's all|thats all|thank you|thanks|got it|sounds good"
)
CONTEXT_DEPENDENT = (
    r"(?i)\b(?:it|its|they|them|their|there|this|that|these|those|one|ones)\b"
    r"|\bwhat\s+about\b|\bi\s+meant\b|\bwhich\s+one\b|\b(?:then|other|next steps|more concrete)\b"
)
COMPLEX = (
    r"(?i)\b(?:why|reason|compare|compared|same or different|difference between|what if|steps involved|"
    r"how does .* work together|i(?:'m| am) not sure|i do not understand|i don't understand|confused about)\b"
)
#: Query types by the words they contain, first match wins.
QUERY_TYPES = (
    ("how-to", ("how", "configure", "setup", "install")),
    ("definition", ("what", "explain", "define")),
    ("troubleshooting", ("error", "problem", "issue", "troubleshoot")),
    ("pricing", ("price", "cost", "billing", "quota")),
)
NAVIGATION = ("contact us", "site map", "skip to content", "skip to main content", "advanced search")
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
ABSTAIN = r"(?i)do not have enough information|don't have enough information|cannot answer|no supporting evidence|unable to answer"


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+", -1), lambda w: w != ""))


def presentation_only(text: Column) -> Column:
    """A short request about delivery, politeness aside."""
    bare = F.regexp_replace(F.ltrim(F.lower(text)), POLITE, "")
    exact = F.regexp_replace(bare, r"[ .!?]+$", "").isin(*LONG_PRESENTATION)
    return bare.rlike(rf"^(?:{PRESENTATION})\b") & ((word_count(bare) <= 5) | exact)


def presentation_command(text: Column) -> Column:
    return F.trim(F.lower(text)).rlike(f"^(?:{COMMANDS})")


def chunk_problem(text: Column, confidence: Column, min_chars: int = 24, min_tokens: int = 5) -> Column:
    """The first thing wrong with a transcript chunk, null if nothing is."""
    t = F.trim(text)
    return (
        F.when(t == "", "empty text")
        .when(F.length(t) < min_chars, F.concat(F.lit("text too short ("), F.length(t), F.lit(f" < {min_chars} chars)")))
        .when(word_count(t) < min_tokens, F.concat(F.lit("insufficient tokens ("), word_count(t), F.lit(f" < {min_tokens})")))
        .when(confidence < 0.5, F.concat(F.lit("low ASR confidence ("), F.format_string("%.3f", confidence), F.lit(")")))
    )


def query_type(text: Column) -> Column:
    out = F.lit("general")
    for name, words in reversed(QUERY_TYPES):
        out = F.when(F.lower(text).rlike("|".join(words)), name).otherwise(out)
    return out


def passage_suitable(text: Column) -> Column:
    t = F.trim(text)
    words = curation_tokens(t)
    return F.length(t).between(300, 5000) & (F.size(words) >= 55) & (F.size(F.array_distinct(words)) >= 25) & (F.regexp_count(t, F.lit("http")) <= 8)


def context_dependent(text: Column) -> Column:
    return text.rlike(CONTEXT_DEPENDENT)


def needs_reasoning(text: Column) -> Column:
    return text.rlike(COMPLEX)


def answer_span(sentence: Column) -> Column:
    """A sentence that can stand as an answer: no stub, heading or piece of navigation."""
    low = F.lower(sentence)
    markers = sum((F.when(F.contains(low, F.lit(m)), 1).otherwise(0) for m in NAVIGATION), F.lit(0))
    return (word_count(sentence) >= 4) & ~sentence.rlike(r"[?:]\s*$") & (markers < 2) & ~sentence.rlike(r"(?i)\b(?:for more information|for .+ record),?\s*see\s*:?$")


def dates_kept(question: Column, sentence: Column) -> Column:
    """Whether every date of the question is in the sentence."""
    dates = F.regexp_extract_all(question, F.lit(rf"(?i)\b\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}\b"), F.lit(0))
    return F.forall(dates, lambda d: F.contains(F.lower(sentence), F.lower(d)))


def abstains(answer: Column) -> Column:
    return answer.rlike(ABSTAIN)


#: Codes of state hosts, and their states.
STATES = {
    "al": "Alabama",
    "ak": "Alaska",
    "az": "Arizona",
    "ar": "Arkansas",
    "ca": "California",
    "co": "Colorado",
    "ct": "Connecticut",
    "de": "Delaware",
    "fl": "Florida",
    "ga": "Georgia",
    "hi": "Hawaii",
    "id": "Idaho",
    "il": "Illinois",
    "in": "Indiana",
    "ia": "Iowa",
    "ks": "Kansas",
    "ky": "Kentucky",
    "la": "Louisiana",
    "me": "Maine",
    "md": "Maryland",
    "ma": "Massachusetts",
    "mi": "Michigan",
    "mn": "Minnesota",
    "ms": "Mississippi",
    "mo": "Missouri",
    "mt": "Montana",
    "ne": "Nebraska",
    "nv": "Nevada",
    "nh": "New Hampshire",
    "nj": "New Jersey",
    "nm": "New Mexico",
    "ny": "New York",
    "nc": "North Carolina",
    "nd": "North Dakota",
    "oh": "Ohio",
    "ok": "Oklahoma",
    "or": "Oregon",
    "pa": "Pennsylvania",
    "ri": "Rhode Island",
    "sc": "South Carolina",
    "sd": "South Dakota",
    "tn": "Tennessee",
    "tx": "Texas",
    "ut": "Utah",
    "vt": "Vermont",
    "va": "Virginia",
    "wa": "Washington",
    "wv": "West Virginia",
    "wi": "Wisconsin",
    "wy": "Wyoming",
}


def jurisdiction_fits(question: Column, url: Column) -> Column:
    """Whether a source may answer: a state's host doesn't if the question names one other state only; va.gov is federal."""
    host = F.lower(F.coalesce(F.call_function("try_parse_url", url, F.lit("HOST")), F.lit("")))
    code = F.regexp_extract(host, r"(?:^|\.)([a-z]{2})\.gov$", 1)
    names = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    own = F.try_element_at(names, code)
    asked = F.filter(F.map_values(names), lambda s: F.regexp_like(question, F.concat(F.lit(r"(?i)\b"), s, F.lit(r"\b"))))
    other = own.isNotNull() & (F.size(asked) == 1) & ~F.array_contains(asked, own)
    return ~((code != "va") & F.coalesce(other, F.lit(False)))


#: Verbs that begin a step of a procedure, and those that ask for one.
STEP_VERBS = ("edit", "append", "close", "save", "restart", "configure", "select", "choose", "open", "run", "use", "click", "complete", "create", "submit")
SET_UP_VERBS = ("configure", "install", "setup", "apply", "enable")
#: Words by which a sentence gives a reason, and compares.
REASONS = ("because", "due to", "reason", "purpose", "so that", "in order to", "protect", "prevent", "ensure", "allow", "enable", "designed to", "helps?", "gain insight")
COMPARISONS = ("same", "different", "similar", "differ", "unlike", "whereas", "versus", "compared", "equivalent", "not identical")
#: Words that tell no compared things apart.
GENERIC = ("object", "storage", "cloud", "service", "platform", "product", "same", "different", "similar", "differ", "compared")
PHONE_ASKED = r"(?i)\b(?:phone|telephone|tele|tel)\s*(?:number|no\b)|\bphone\s+number\b"
PHONE = r"(?:^|[^0-9])(?:\+?1[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?:[^0-9]|$)"


def any_word(words: tuple[str, ...]) -> str:
    return r"\b(?:" + "|".join(words) + r")\b"


def answer_shape(question: Column, sentence: Column) -> Column:
    """Whether a sentence has the dates of the question, and a telephone number if it asks for one."""
    return dates_kept(question, sentence) & (~question.rlike(PHONE_ASKED) | sentence.rlike(PHONE))


def shared_stems(terms: Column, others: Column) -> Column:
    """How many of ``terms`` are among ``others``; one of five characters or more also if either begins with the other."""
    fits = lambda t: F.exists(others, lambda o: (t == o) | ((F.length(t) >= 5) & (t.startswith(o) | o.startswith(t))))
    return F.size(F.filter(terms, fits))


def steps_towards(query: Column, sentence: Column, source: Column) -> Column:
    """Whether a sentence is an instruction of the procedure asked for, whose subject only its source names."""
    asked = current_question(query)
    about = lambda text: F.filter(content_terms(text), lambda t: ~t.isin(*SET_UP_VERBS))
    own = about(asked)
    context = F.when(F.contains(query, F.lit(" Current question:")), about(F.substring_index(query, " Current question:", 1)))
    topic = F.when((F.size(own) < 2) & context.isNotNull(), context).otherwise(own)
    asks = asked.rlike(r"(?i)\bhow\b.*\b(?:configure|install|setup|set up|apply|enable)\b")
    instructs = sentence.rlike(rf"(?i)^\s*(?:(?:step\s+)?[0-9]+[.:)]\s*)?(?:{'|'.join(STEP_VERBS)})\b")
    return asks & instructs & (F.size(F.array_intersect(topic, content_terms(source))) >= 2)


def answers_relation(question: Column, sentence: Column) -> Column:
    """Whether a sentence gives what the question asks for: a reason, a comparison of its things, a contact, one count."""
    from quarryline.operators.intents import defines

    q, s = F.lower(question), F.lower(sentence)
    numbers = F.size(F.regexp_extract_all(s, F.lit(r"\b[0-9]+(?:\.[0-9]+)?\b"), F.lit(0)))
    bare_counts = q.rlike(r"\bhow many\b") & (numbers > 1) & (word_count(s) <= 10) & ~s.rlike(any_word(("is", "are", "includes", "allows", "per", "each", "for")))
    compares = q.rlike(r"\b(?:same or different|same\s*/\s*different|the same|different from|similar to|compared with)\b")
    things = F.array_except(content_terms(F.when(F.contains(q, F.lit(" if ")), F.substring_index(q, " if ", -1)).otherwise(q)), F.array(*map(F.lit, GENERIC)))
    compared = s.rlike(any_word(COMPARISONS)) & (F.size(things) >= 2) & (shared_stems(things, content_terms(sentence)) == F.size(things))
    contact = q.rlike(r"\b(?:who do i call|whom should i call|how do i contact|who should i contact)\b")
    kind = (
        F.when(q.rlike(any_word(("why", "reason", "purpose", "cause"))), s.rlike(any_word(REASONS)))
        .when(compares, compared)
        .when(contact, s.rlike(any_word(("call", "contact", "phone", "email", "hotline", "number"))))
        .otherwise(True)
    )
    return defines(question, sentence) & ~bare_counts & kind
