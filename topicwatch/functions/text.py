"""Text column functions (JVM-side expressions, no Python UDFs).

Tokenising follows word-character semantics: split on runs of characters that
are not letters, digits or underscore (Unicode aware), so "zürich" stays one
word in every engine. ``\\b`` is avoided: Java and RE2 disagree on it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
# Simple-keyword stop words (request parser):
SIMPLE_STOP_WORDS = ["this", "that", "with", "from", "they", "have", "been", "their", "than", "what"]
# Lexicon sentiment word lists (end-to-end test analyzer):
POSITIVE_WORDS = ["good", "great", "excellent", "success"]
NEGATIVE_WORDS = ["bad", "error", "failure", "critical", "vulnerability"]
# Request intent keywords, checked in this order; default "monitor":
INTENT_KEYWORDS = [
    ("monitor", ["monitor", "track", "watch", "follow", "keep an eye on"]),
    ("alert", ["alert", "notify", "warn", "inform me", "let me know"]),
    ("summarize", ["summarize", "digest", "overview", "brief", "report"]),
    ("compare", ["compare", "versus", "vs", "difference", "trend"]),
]
# Event-type patterns (multi-label, in this order):
EVENT_PATTERNS = [
    ("conflict", ["tension", "conflict", "war", "dispute", "sanction"]),
    ("legislation", ["law", "regulation", "policy", "bill", "act", "legal"]),
    ("breakthrough", ["breakthrough", "discovery", "innovation", "advance"]),
    ("disruption", ["disruption", "shortage", "crisis", "problem"]),
]
# Time-frame phrases, checked in this order; default "ongoing":
TIMEFRAME_PHRASES = [
    ("recent", ["last week", "recent", "latest"]),
    ("ongoing", ["ongoing", "continuous", "keep"]),
    ("future", ["upcoming", "future", "next"]),
]
# Entity labels kept by the entity extractor, and geographic labels:
ENTITY_LABELS = ["PERSON", "ORG", "GPE", "PRODUCT"]
GEO_LABELS = ["GPE", "LOC"]
# Capitalised-phrase fallback pattern for entities:
CAPITALISED_PHRASE = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"
# Paywall phrases:
PAYWALL_PATTERN = r"(?i)(paywall|subscribe to read|subscribers only|premium content)"
# ---------------------------------------------------------------------------

# Stop words by which a language is guessed (articles, prepositions, conjunctions; default en).
LANG_STOP_WORDS = {
    "en": ["the", "and", "is", "in", "to", "of", "a", "on", "for", "with", "that", "this", "are", "was"],
    "es": ["el", "la", "de", "que", "y", "en", "los", "se", "del", "las", "una", "por", "con", "para"],
    "fr": ["le", "la", "de", "et", "les", "des", "est", "un", "une", "sur", "dans", "pour", "qui", "avec"],
}

# Characters that are not word characters (letters, digits, underscore).
NON_WORD = r"[^\p{L}\p{N}_]+"
# Non-ASCII letters / digits, replaced by an ASCII word character before a
# regex that uses \b so Java and RE2 see the same word boundaries.
NON_ASCII_LETTER = r"[^\x00-\x7F\P{L}]"
NON_ASCII_DIGIT = r"[^\x00-\x7F\P{N}]"


def strip_ws(c: Column) -> Column:
    """Python-style strip of leading/trailing whitespace (Spark trim strips
    spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


WORD = r"[\p{L}\p{N}_]+"
# A whole word made of at least 4 ASCII letters (no word character around).
ASCII_WORD4 = r"(?<![\p{L}\p{N}_])[a-z]{4,}(?![\p{L}\p{N}_])"


def words(text: Column) -> Column:
    """Lower-cased word tokens of a text (maximal runs of letters, digits,
    underscore). One regex pass, no lambda (lambdas run interpreted)."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def simple_keywords(text: Column, n: int = 10) -> Column:
    """P-7: words of at least 4 ASCII letters, stop words out, distinct in
    order of first appearance, first ``n``. ``array_except`` keeps first
    occurrences in order and drops the stop words in one step."""
    stop = F.array(*[F.lit(w) for w in SIMPLE_STOP_WORDS])
    return F.slice(F.array_except(F.regexp_extract_all(F.lower(text), F.lit(ASCII_WORD4), 0), stop), 1, n)


def explode_values(c: Column) -> Column:
    """``explode`` for computed arrays. A plain explode makes Catalyst infer
    ``size(arr) > 0`` and push a copy of the whole array expression below the
    projection (evaluating it up to three times); ``explode_outer`` has no
    inferred filter. Callers drop the NULL row of empty arrays."""
    return F.explode_outer(c)


def word_count(text: Column) -> Column:
    """S-29: number of whitespace-separated words."""
    return F.size(F.filter(F.split(strip_ws(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: t != ""))


def ascii_boundaries(text: Column) -> Column:
    t = F.regexp_replace(text, NON_ASCII_LETTER, "0")
    return F.regexp_replace(t, NON_ASCII_DIGIT, "0")


def capitalised_phrases(text: Column) -> Column:
    """P-5 fallback: capitalised phrases (array of strings, in order)."""
    return F.regexp_extract_all(ascii_boundaries(text), F.lit(CAPITALISED_PHRASE), 0)


def lexicon_counts(text: Column) -> tuple[Column, Column]:
    """Distinct positive / negative lexicon words contained (as substrings)
    in the text."""
    low = F.lower(text)
    pos = sum((F.instr(low, w) > 0).cast("int") for w in POSITIVE_WORDS)
    neg = sum((F.instr(low, w) > 0).cast("int") for w in NEGATIVE_WORDS)
    return pos, neg


def lexicon_sentiment(text: Column) -> Column:
    """P-2: positive / negative / neutral from lexicon hits; NULL for NULL or
    empty text."""
    pos, neg = lexicon_counts(text)
    label = F.when(pos > neg, "positive").when(neg > pos, "negative").otherwise("neutral")
    return F.when(F.coalesce(F.length(strip_ws(text)), F.lit(0)) == 0, F.lit(None).cast("string")).otherwise(label)


def lexicon_score(text: Column) -> Column:
    """Compound score in [-1, 1]: (pos - neg) / (pos + neg), 0 without hits."""
    pos, neg = lexicon_counts(text)
    return F.when(F.coalesce(F.length(strip_ws(text)), F.lit(0)) == 0, F.lit(None).cast("double")) \
        .when(pos + neg == 0, F.lit(0.0)) \
        .otherwise((pos - neg).cast("double") / (pos + neg))


def _contains_any(low: Column, phrases: list[str]) -> Column:
    cond = None
    for p in phrases:
        c = F.instr(low, p) > 0
        cond = c if cond is None else (cond | c)
    return cond


def intent(text: Column) -> Column:
    """P-9: first intent group with a contained keyword; default monitor."""
    low = F.lower(text)
    expr = None
    for name, kws in INTENT_KEYWORDS:
        cond = _contains_any(low, kws)
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr.otherwise("monitor")


def event_types(text: Column) -> Column:
    """P-10: every event type with a contained pattern, in fixed order."""
    low = F.lower(text)
    arr = F.array(*[F.when(_contains_any(low, pats), F.lit(name)) for name, pats in EVENT_PATTERNS])
    return F.filter(arr, lambda x: x.isNotNull())


def timeframe(text: Column) -> Column:
    """P-11: recent / ongoing / future by first matching group."""
    low = F.lower(text)
    expr = None
    for name, phrases in TIMEFRAME_PHRASES:
        cond = _contains_any(low, phrases)
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr.otherwise("ongoing")


def language_guess(text: Column) -> Column:
    """S-24: language with the largest stop-word overlap; ties and no overlap
    -> en (order en, es, fr)."""
    toks = F.array_distinct(words(text))
    scores = {lang: F.size(F.array_intersect(toks, F.array(*[F.lit(w) for w in ws])))
              for lang, ws in LANG_STOP_WORDS.items()}
    en, es, fr = scores["en"], scores["es"], scores["fr"]
    return (F.when((es > en) & (es >= fr), "es")
            .when((fr > en) & (fr > es), "fr")
            .otherwise("en"))


def is_paywalled(text: Column) -> Column:
    """S-25: paywall phrases present."""
    return F.coalesce(text.rlike(PAYWALL_PATTERN), F.lit(False))


def truncate(c: Column, n: int) -> Column:
    """F-12 ``truncate_text``: cut to n-3 chars + '...' when longer than n."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def preview(c: Column, n: int) -> Column:
    """F-12 page previews: first n chars + '...' when longer than n."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def sentiment_label(score: Column, scheme: str = "utils") -> Column:
    """F-15: the four labelling schemes; all comparisons strict."""
    if scheme == "utils":
        return (F.when(score.isNull(), "Unknown").when(score > 0.5, "Very Positive")
                .when(score > 0.1, "Positive").when(score < -0.5, "Very Negative")
                .when(score < -0.1, "Negative").otherwise("Neutral"))
    if scheme == "emoji":
        return (F.when(score > 0.3, "very_positive").when(score > 0.1, "positive")
                .when(score < -0.3, "very_negative").when(score < -0.1, "negative")
                .otherwise("neutral"))
    if scheme == "situation":
        return F.when(score > 0.2, "positive").when(score < -0.2, "negative").otherwise("neutral")
    if scheme == "distribution":
        return F.when(score > 0.1, "positive").when(score < -0.1, "negative").otherwise("neutral")
    raise ValueError(f"unknown scheme {scheme}")


def relevance(tokens: Column, keywords: Column) -> Column:
    """P-17: share of the situation's keywords present among the tokens."""
    return F.when(F.size(keywords) == 0, F.lit(None).cast("double")).otherwise(
        F.size(F.array_intersect(F.array_distinct(tokens), F.array_distinct(keywords))).cast("double")
        / F.size(F.array_distinct(keywords)))


def compression_ratio(summary: Column, original: Column) -> Column:
    """S-28: summary length / original length."""
    return F.try_divide(F.length(summary).cast("double"), F.length(original).cast("double"))


def search_query(keywords: Column, entities: Column) -> Column:
    """S-26: keywords and entity names joined by spaces."""
    return F.array_join(F.concat(F.coalesce(keywords, F.array()), F.coalesce(entities, F.array())), " ")
