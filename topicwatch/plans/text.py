"""Text-analysis queries over the documents and request tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..functions import text as TX
from ..operators import textops as TO
from . import register
from .trends import ENTITY_SQL

wv = V.with_views

WORDS_SQL = r"list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '')"
STRIP_SQL = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _any_sql(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), '{w}')" for w in words) + ")"


def _hits_sql(col: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains(lower({col}), '{w}') AS INTEGER)" for w in words) + ")"


_POS = _hits_sql("content", TX.POSITIVE_WORDS)
_NEG = _hits_sql("content", TX.NEGATIVE_WORDS)
_EMPTY = f"coalesce(length({STRIP_SQL.format(c='content')}), 0) = 0"


@register("lexicon_sentiment", wv(f"""
WITH h AS (SELECT id, content, {_POS} AS positive_hits, {_NEG} AS negative_hits FROM docs)
SELECT id,
  CASE WHEN {_EMPTY} THEN NULL WHEN positive_hits > negative_hits THEN 'positive'
       WHEN negative_hits > positive_hits THEN 'negative' ELSE 'neutral' END AS sentiment,
  CASE WHEN {_EMPTY} THEN NULL WHEN positive_hits + negative_hits = 0 THEN 0.0
       ELSE CAST(positive_hits - negative_hits AS DOUBLE) / (positive_hits + negative_hits) END AS score,
  positive_hits, negative_hits
FROM h""", "docs"))
def lexicon_sentiment(spark, sf):
    return TO.lexicon_sentiment(V.docs(spark, sf).select("id", "content"))


@register("extractive_summary", wv(f"""
WITH s AS (SELECT id, t.sentence, t.pos FROM docs,
           unnest(list_filter(list_transform(regexp_extract_all(content, '[^.!?]+[.!?]*', 0),
                  lambda x: {STRIP_SQL.format(c='x')}), lambda x: x <> '')) WITH ORDINALITY AS t(sentence, pos)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
w AS (SELECT s.id, s.pos, t.word FROM s, unnest({WORDS_SQL.format(c='s.sentence')}) AS t(word)),
f AS (SELECT id, pos, count(*) OVER (PARTITION BY id, word) AS freq FROM w),
sc AS (SELECT id, pos, CAST(sum(freq) AS DOUBLE) / count(*) AS score FROM f GROUP BY id, pos),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) AS rk FROM sc),
best AS (SELECT r.id, r.pos, s.sentence FROM r JOIN s ON s.id = r.id AND s.pos = r.pos JOIN n ON n.id = r.id
         WHERE rk <= 3 AND n.n >= 3),
summ AS (SELECT id, string_agg(sentence, ' ' ORDER BY pos) AS summary FROM best GROUP BY id)
SELECT d.id, summ.summary, CAST(length(summ.summary) AS DOUBLE) / length(d.content) AS ratio
FROM docs d LEFT JOIN summ ON summ.id = d.id""", "docs"))
def extractive_summary(spark, sf):
    return TO.extractive_summary(V.docs(spark, sf).select("id", "content"))


_STOP_LIST = "[" + ", ".join(f"'{w}'" for w in TO.TFIDF_STOP_WORDS) + "]"


@register("keyword_tfidf", wv(f"""
WITH u AS (SELECT id, t.tok, t.pos FROM docs,
           unnest(list_filter({WORDS_SQL.format(c='content')},
                  lambda x: regexp_full_match(x, '\\p{{L}}{{3,}}') AND NOT list_contains({_STOP_LIST}, x)))
           WITH ORDINALITY AS t(tok, pos)
           WHERE length(content) >= 50),
terms AS (SELECT id, tok AS term FROM u
          UNION ALL SELECT a.id, a.tok || ' ' || b.tok FROM u a JOIN u b ON a.id = b.id AND b.pos = a.pos + 1),
tf AS (SELECT id, term, count(*) AS tf FROM terms GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT tf.id, tf.term, tf.tf, df.df,
              round(tf.tf * ln(CAST((SELECT count(*) FROM docs) AS DOUBLE) / df.df), 9) AS score
       FROM tf JOIN df ON tf.term = df.term)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, term) AS rank FROM sc)
WHERE rank <= 10""", "docs"))
def keyword_tfidf(spark, sf):
    out = TO.keyword_tfidf(V.docs(spark, sf).select("id", "content"), top_n=10)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


def _first_keywords_sql(table: str, key: str, text: str) -> str:
    stop = "(" + ", ".join(f"'{w}'" for w in TX.SIMPLE_STOP_WORDS) + ")"
    return f"""
kt AS (SELECT {key}, t.tok, t.pos FROM {table}, unnest({WORDS_SQL.format(c=text)}) WITH ORDINALITY AS t(tok, pos)
       WHERE regexp_full_match(t.tok, '[a-z]{{4,}}') AND t.tok NOT IN {stop}),
kf AS (SELECT {key}, tok, min(pos) AS p FROM kt GROUP BY ALL),
kw AS (SELECT {key}, string_agg(tok, ',' ORDER BY p) AS keywords FROM (
        SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY p) AS r FROM kf) WHERE r <= 10 GROUP BY {key})"""


def _when_chain(col: str, groups, default: str) -> str:
    parts = " ".join(f"WHEN {_any_sql(col, words)} THEN '{name}'" for name, words in groups)
    return f"CASE {parts} ELSE '{default}' END"


_EVENTS_SQL = "concat_ws(',', " + ", ".join(
    f"CASE WHEN {_any_sql('text', pats)} THEN '{name}' END" for name, pats in TX.EVENT_PATTERNS) + ")"


@register("parse_requests", wv(f"""
WITH {_first_keywords_sql('requests', 'conv_id, turn', 'text').strip()}
SELECT r.conv_id, r.turn, {_when_chain('r.text', TX.INTENT_KEYWORDS, 'monitor')} AS intent,
       {_EVENTS_SQL.replace('text', 'r.text')} AS event_types,
       {_when_chain('r.text', TX.TIMEFRAME_PHRASES, 'ongoing')} AS timeframe,
       coalesce(kw.keywords, '') AS keywords,
       len({ENTITY_SQL.format(c='r.text')}) AS entity_count, 0 AS geography_count, 0.8 AS confidence
FROM requests r LEFT JOIN kw ON kw.conv_id = r.conv_id AND kw.turn = r.turn""", "requests"))
def parse_requests(spark, sf):
    p = TO.parse_requests(V.requests(spark, sf))
    return p.select("conv_id", "turn", "intent", F.array_join("event_types", ",").alias("event_types"),
                    "timeframe", F.array_join("keywords", ",").alias("keywords"),
                    F.size("entities").cast("bigint").alias("entity_count"),
                    F.size("geography").alias("geography_count"),
                    F.col("confidence").cast("decimal(2,1)").alias("confidence"))


@register("analysis_pipeline", wv(f"""
WITH {_first_keywords_sql('docs', 'id', 'content').strip()},
h AS (SELECT id, content, {_POS} AS pos, {_NEG} AS neg, {_EMPTY} AS empty FROM docs)
SELECT h.id, NOT h.empty AS success, CASE WHEN h.empty THEN 'No content' END AS error,
       len(list_filter(regexp_split_to_array({STRIP_SQL.format(c="coalesce(h.content, '')")}, '\\s+'), lambda x: x <> ''))
         AS word_count,
       CASE WHEN h.empty THEN NULL WHEN pos > neg THEN 'positive' WHEN neg > pos THEN 'negative'
            ELSE 'neutral' END AS sentiment,
       CASE WHEN h.empty THEN NULL ELSE len(list_distinct({ENTITY_SQL.format(c='h.content')})) END AS entity_count,
       CASE WHEN h.empty THEN NULL ELSE coalesce(kw.keywords, '') END AS keywords
FROM h LEFT JOIN kw ON kw.id = h.id""", "docs"))
def analysis_pipeline(spark, sf):
    r = TO.analyze(V.docs(spark, sf).select("id", "content"))
    return r.select("id", "success", "error", F.col("word_count").cast("bigint").alias("word_count"), "sentiment",
                    F.size("entities").cast("bigint").alias("entity_count"),
                    F.array_join("keywords", ",").alias("keywords"))


@register("analysis_summary", wv(f"""
SELECT count(*) AS documents, count(*) FILTER (WHERE NOT {_EMPTY}) AS succeeded,
       count(*) FILTER (WHERE {_EMPTY}) AS failed FROM docs""", "docs"))
def analysis_summary(spark, sf):
    return TO.batch_summary(TO.analyze(V.docs(spark, sf).select("id", "content")))


def _lang_sql(lang: str) -> str:
    lst = "[" + ", ".join(f"'{w}'" for w in TX.LANG_STOP_WORDS[lang]) + "]"
    return f"len(list_intersect(list_distinct({WORDS_SQL.format(c='content')}), {lst}))"


@register("language_guess", wv(f"""
WITH s AS (SELECT id, language, {_lang_sql('en')} AS en, {_lang_sql('es')} AS es, {_lang_sql('fr')} AS fr FROM docs)
SELECT id, language, CASE WHEN es > en AND es >= fr THEN 'es' WHEN fr > en AND fr > es THEN 'fr' ELSE 'en' END
  AS guess FROM s""", "docs"))
def language_guess(spark, sf):
    d = V.docs(spark, sf)
    return d.select("id", "language", TX.language_guess(F.col("content")).alias("guess"))
