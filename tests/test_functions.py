"""Column functions against the values the reference's tests pin."""

import datetime as dt

from pyspark.sql import functions as F

from topicwatch.functions import html as H
from topicwatch.functions import ids, severity as SEV, text as TX, timecols as TC


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return df.select(expr.alias("x")).first()["x"]


def test_content_hash_lower_strip(spark):
    import hashlib
    html = "  <HTML>Body</HTML>\n"
    got = one(spark, ids.content_hash(F.col("h")), h=html)
    assert got == hashlib.sha256(html.lower().strip().encode()).hexdigest()
    assert one(spark, ids.content_hash(F.col("h")), h="") == ""


def test_doc_id_16_hex(spark):
    import hashlib
    got = one(spark, ids.doc_id(F.col("a"), F.col("b"), F.col("c")), a="src", b="http://x", c="t")
    assert got == hashlib.sha256(b"src:http://x:t").hexdigest()[:16]


def test_dead_letter_id(spark):
    import hashlib
    got = one(spark, ids.dead_letter_id(F.col("s"), F.col("u")), s="src1", u="http://a/b")
    assert got == "src1:" + hashlib.sha256(b"http://a/b").hexdigest()[:8]


def test_urljoin(spark):
    from urllib.parse import urljoin
    base = "https://example.com/news/article?id=3#top"
    for href in ["/page1", "https://other.com/page", "//cdn.example.com/x.png", "rel/path", "?q=2", "#frag", "../up", "./here", "../../../far",
                 "a/./b/../c?x=../y", "..", ".", "/a/../b/", "a..b/.hidden", "../#f"]:
        assert one(spark, ids.urljoin(F.col("b"), F.col("h")), b=base, h=href) == urljoin(base, href), href


def test_normalize_url_trailing_slash(spark):
    a = one(spark, ids.normalize_url(F.col("u")), u="https://Example.com/page/")
    b = one(spark, ids.normalize_url(F.col("u")), u="https://example.com/page")
    assert a == b == "https://example.com/page"


def test_credibility(spark):
    edu = spark.createDataFrame([("https://mit.edu/x", False), ("https://paper.com/a", True)], "u string, p boolean")
    rows = edu.select(*ids.credibility(F.col("u"), F.col("p"))).collect()
    assert rows[0][0] >= 0.9 and rows[1][0] <= 0.6


def test_title_and_article(spark):
    html = ("<html><head><title>Page Title</title><script>var t='</p>';</script></head><body>"
            "<h1>Article Title</h1><article><p>First paragraph here.</p><p>Second paragraph.</p></article>"
            "<a href='/page1'>x</a><a href='https://other.com/page'>y</a></body></html>")
    assert one(spark, H.title(F.col("h")), h=html) in ("Page Title", "Article Title")
    text = one(spark, H.article_text(F.col("h")), h=html)
    assert "First paragraph here." in text and "Second paragraph." in text
    links = one(spark, H.links(F.col("h"), F.lit("https://example.com/")), h=html)
    assert any("/page1" in x for x in links)
    assert one(spark, H.title(F.col("h")), h="<html><body><h1>Test Article</h1><p>Content here</p></body></html>")


def test_full_article_fields(spark):
    html = ("<html><head><title>Big News</title><meta name='author' content='Jane Doe'></head><body>"
            "<time datetime='2024-01-15T10:30:00'>Jan 15</time><p>" + "word " * 20 + "</p></body></html>")
    row = spark.createDataFrame([(html,)], "h string").select(
        H.author(F.col("h")).alias("a"), H.publish_date(F.col("h")).alias("d"), H.article_text(F.col("h")).alias("t")
    ).first()
    assert row["a"] == "Jane Doe"
    assert row["d"] == dt.datetime(2024, 1, 15, 10, 30)
    assert row["t"].startswith("word")


def test_basic_extract(spark):
    html = "<html><TITLE> Hi </title><body><p>a\n\n b</p></body></html>"
    assert one(spark, H.basic_title(F.col("h")), h=html) == "Hi"
    assert one(spark, H.basic_text(F.col("h")), h=html) == "Hi a b"
    assert one(spark, H.basic_title(F.col("h")), h="<p>x</p>") == "Untitled"


def test_lexicon_sentiment(spark):
    cases = {"Security vulnerability found in popular framework": "negative",
             "New Python version released with great features": "positive",
             "Critical system error detected in production": "negative",
             "The sky is blue": "neutral", "": None}
    for text, want in cases.items():
        assert one(spark, TX.lexicon_sentiment(F.col("t")), t=text) == want, text


def test_simple_keywords_order_and_stop_words(spark):
    got = one(spark, TX.simple_keywords(F.col("t")), t="This conflict with Zürich tension, conflict again from them")
    assert got == ["conflict", "tension", "again", "them"]


def test_intent_events_timeframe(spark):
    t = "Please alert me about the latest trade war sanctions and new regulation"
    assert one(spark, TX.intent(F.col("t")), t=t) == "alert"
    assert one(spark, TX.event_types(F.col("t")), t=t) == ["conflict", "legislation"]
    assert one(spark, TX.timeframe(F.col("t")), t=t) == "recent"
    assert one(spark, TX.intent(F.col("t")), t="nothing here") == "monitor"
    assert one(spark, TX.timeframe(F.col("t")), t="upcoming launch") == "future"


def test_language_guess(spark):
    assert one(spark, TX.language_guess(F.col("t")), t="El perro corre rápido") == "es"
    assert one(spark, TX.language_guess(F.col("t")), t="Le chat dort sur le lit") == "fr"
    assert one(spark, TX.language_guess(F.col("t")), t="xyz") == "en"


def test_capitalised_phrases(spark):
    got = one(spark, TX.capitalised_phrases(F.col("t")), t="Hello World met Paris France in Zürich")
    assert got == ["Hello World", "Paris France"]


def test_truncate_and_word_count(spark):
    assert one(spark, TX.truncate(F.col("t"), 10), t="abcdefghijklmnop") == "abcdefg..."
    assert one(spark, TX.word_count(F.col("t")), t="  one two\nthree  ") == 3


def test_sentiment_label_schemes(spark):
    df = spark.createDataFrame([(0.6,), (0.2,), (0.0,), (-0.2,), (-0.6,), (None,)], "s double")
    got = [r[0] for r in df.select(TX.sentiment_label(F.col("s"), "utils")).collect()]
    assert got == ["Very Positive", "Positive", "Neutral", "Negative", "Very Negative", "Unknown"]
    got = [r[0] for r in df.select(TX.sentiment_label(F.col("s"), "situation")).collect()]
    assert got[:5] == ["positive", "neutral", "neutral", "neutral", "negative"]


def test_severity_rank_and_band(spark):
    df = spark.createDataFrame([("info",), ("warning",), ("high",), ("critical",)], "s string")
    assert [r[0] for r in df.select(SEV.rank(F.col("s"))).collect()] == [0, 1, 2, 3]
    band = [r[0] for r in df.select(SEV.in_band(F.col("s"), F.lit("warning"), F.lit(None))).collect()]
    assert band == [False, True, True, True]


def test_severity_from_analysis(spark):
    cases = [(-0.9, 0.0, 0, "critical"), (0.0, 0.6, 0, "critical"), (-0.6, 0.0, 0, "warning"),
             (0.0, 0.0, 4, "warning"), (-0.2, 0.0, 1, "info")]
    df = spark.createDataFrame([c[:3] for c in cases], "s double, c double, n int")
    got = [r[0] for r in df.select(SEV.from_analysis(F.col("s"), F.col("c"), F.col("n"))).collect()]
    assert got == [c[3] for c in cases]


def test_quiet_hours(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, h),) for h in (0, 7, 12, 22, 23)], "ts timestamp_ntz")
    wrap = [r[0] for r in df.select(TC.in_quiet_hours(F.col("ts"), F.lit(22), F.lit(8))).collect()]
    assert wrap == [True, True, False, True, True]
    whole = [r[0] for r in df.select(TC.in_quiet_hours(F.col("ts"), F.lit(0), F.lit(23))).collect()]
    assert whole == [True, True, True, True, False]


def test_age_label(spark):
    now = dt.datetime(2024, 1, 31)
    df = spark.createDataFrame([(now - dt.timedelta(seconds=s),) for s in (10, 600, 7200, 90000, 3 * 86400, 30 * 86400)],
                               "ts timestamp_ntz")
    got = [r[0] for r in df.select(TC.age_label(F.col("ts"), TC.as_ntz(now))).collect()]
    assert got == ["Just now", "10m ago", "2h ago", "Yesterday", "3d ago", "2024-01-01"]
