"""Found-source table operators (W-3, J-5, L-5, S-23, S-25, X-3, P-16,
P-17, S-30). Discovery itself (web search) is not built; these run on
source tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import text as TX


def limit_per_category(sources: DataFrame, n: int, category: str = "category", order: list | None = None) -> DataFrame:
    """W-3: at most ``n`` sources per category (first by ``order``)."""
    w = Window.partitionBy(category).orderBy(*(order or ["id"]))
    return sources.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def by_preferences(sources: DataFrame, categories: DataFrame, preferred: bool = True,
                   category: str = "category") -> DataFrame:
    """J-5: keep sources in the preferred categories (left semi join) or
    drop the excluded ones (left anti join). ``categories`` holds one
    column ``category``."""
    return sources.join(categories.select(F.col("category").alias(category)), category,
                        "left_semi" if preferred else "left_anti")


def relevant_sources(sources: DataFrame, threshold: float = 0.5, boost: float = 1.1) -> DataFrame:
    """L-5: keep ``relevance * (boost if has_keywords) > threshold``, most
    relevant first (id breaks ties)."""
    eff = F.col("relevance_score") * F.when(F.coalesce(F.col("has_keywords"), F.lit(False)), boost).otherwise(1.0)
    return sources.where(eff > threshold).orderBy(F.col("relevance_score").desc(), F.col("id"))


def with_credibility(pages: DataFrame, url: str = "url", html: str = "raw_html") -> DataFrame:
    """S-23 + S-25: paywall flag and credibility score/label per page."""
    pay = TX.is_paywalled(F.col(html))
    score, label = I.credibility(F.col(url), pay)
    return pages.withColumn("is_paywalled", pay).withColumn("credibility_score", score).withColumn(
        "credibility_label", label)


def topics(docs: DataFrame, top_n: int = 5, text_col: str = "content", key: str = "situation_id") -> DataFrame:
    """P-16: the most frequent bigrams per situation as topic labels
    (ties: bigram asc)."""
    from .textops import unigrams, with_bigrams
    u = docs.select(key, unigrams(F.col(text_col)).alias("_u"))
    b = u.select(key, TX.explode_values(F.slice(with_bigrams(F.col("_u")), F.size("_u") + 1, 1 << 30))
                 .alias("topic")).where(F.col("topic").isNotNull())
    g = b.groupBy(key, "topic").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key).orderBy(F.col("n").desc(), F.col("topic"))
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)


def relevance(doc_keywords: DataFrame, situation_keywords: DataFrame, key: str = "situation_id") -> DataFrame:
    """P-17: share of the situation's keywords among the document's
    keywords (NULL when the situation has none)."""
    j = doc_keywords.join(situation_keywords.select(key, F.col("keywords").alias("_sk")), key, "left")
    return j.withColumn("relevance_score", TX.relevance(F.col("keywords"), F.coalesce(
        F.col("_sk"), F.array().cast("array<string>")))).drop("_sk")


def readability(text: Column) -> Column:
    """S-30: Flesch reading ease 206.835 - 1.015 words/sentences - 84.6
    syllables/words; syllables are vowel groups. NULL without words."""
    low = F.lower(text)
    n_words = F.size(TX.words(text))
    n_sent = F.greatest(F.size(F.regexp_extract_all(text, F.lit(r"[^.!?]+[.!?]*"), 0)), F.lit(1))
    syll = F.size(F.regexp_extract_all(low, F.lit("[aeiouy]+"), 0))
    return F.when(n_words > 0, F.round(206.835 - 1.015 * (n_words / n_sent) - 84.6 * (syll / n_words), 6))
