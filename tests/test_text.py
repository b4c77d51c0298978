import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from presswork.functions import html as h
from presswork.functions import text as t
from presswork.functions.providers import OverlapReranker, Scripted, generate_object, salvage


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "c string").select(build(F.col("c")).alias("x")).first()["x"]


def test_body_and_hash(spark):
    raw = "First   line\r\n\r\n  second\tline \rthird\n\n\n"
    assert one(spark, raw, t.body) == "First line\n\nsecond line\n\nthird"
    assert one(spark, raw, lambda c: t.content_hash(t.body(c))) == hashlib.sha256(b"First line\n\nsecond line\n\nthird").hexdigest()
    assert one(spark, None, t.body) == ""
    assert one(spark, "   ", t.optional) is None
    assert one(spark, " two  words ", t.word_count) == 2


def test_url(spark):
    cases = {
        " HTTPS://Lenta.RU/News/1/?utm_source=x&b=2&a=#top ": "https://lenta.ru/News/1?b=2",
        "ria.ru": "https://ria.ru/",
        "http://a.example/?UTM_x=1": "http://a.example/",
        "https://a.example/p//": "https://a.example/p/",
    }
    for raw, want in cases.items():
        assert one(spark, raw, t.url) == want


def test_dates(spark):
    assert one(spark, "2026-04-20T10:00:00+03:00", t.compact) == "20260420T1000"
    assert one(spark, "20260421T1015", t.compact) == "20260421T1015"
    assert one(spark, "2026-04-20", t.compact) == "20260420"
    assert one(spark, "2026-04-20 10:00", t.period) == "202604"
    assert t.bound("2026-04-27") == "20260427T0000" and t.bound("2026-04-27T9") == "20260427T9000" and t.bound(" ") is None
    assert t.bound("20260427T1015") == "20260427T1015"


def test_stem_and_query(spark):
    assert one(spark, "миграциями", t.stem) == t.stem_text("миграциями") == "миграц"
    q = t.Query.of("Что известно о блокировке мессенджеров и мессенджерах?")
    assert [raw for raw, _ in q.terms] == ["известно", "блокировке", "мессенджеров"]
    assert not q.narrow and t.Query.of("block telegram messenger channel").narrow
    assert t.Query.of("и в на").terms == ()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="абвгдеиклмоя", min_size=1, max_size=14), min_size=1, max_size=20))
def test_stem_column_agrees_with_python(spark, words):
    got = [r["x"] for r in spark.createDataFrame([(w,) for w in words], "c string").select(t.stem(F.col("c")).alias("x")).collect()]
    assert got == [t.stem_text(w) for w in words]


def test_quality_steps(spark):
    for text, want in (("", -0.80), (None, -0.80), ("Подпишитесь на нас", -0.65), ("three short words", -0.28), ("word " * 12, -0.08), ("word " * 50, 0.06), ("word " * 300, -0.05)):
        assert float(one(spark, text, t.quality)) == want


def test_cosine_guards(spark):
    df = spark.sql("select array(1d, 0d) a, array(0d, 0d) z, array(1d) s, array(-1d, 0d) m, cast(null as array<double>) n")
    r = df.select(*[t.cosine(F.col("a"), F.col(c)).alias(c) for c in "azsmn"]).first()
    assert tuple(r) == (1.0, 0.0, 0.0, -1.0, 0.0)


def test_salvage(spark):
    assert one(spark, 'Sure: {"a": 1} ok', t.salvage_object) == '{"a": 1}'
    assert one(spark, "no json", t.salvage_object) is None and one(spark, "[1]", t.salvage_object) is None
    assert salvage('x {"a": [1]} y') == {"a": [1]} and salvage("[1]") is None
    answers = iter(["broken {", '{"ok": true}'])
    assert generate_object(Scripted(lambda p: next(answers)), "p") == {"ok": True}
    assert 0 < float(one(spark, "flood map", lambda c: OverlapReranker().score(F.lit("flood"), c))) < 1


PAGE = """<html><head><meta property="article:section" content="Мир &amp; люди"><script type="application/ld+json">
{"@type": "NewsArticle", "headline": "From data", "author": {"name": "Data Author"}, "datePublished": "2026-01-02T03:04"}</script></head>
<body><h1 class="topic-body__title">Большой &laquo;заголовок&raquo;</h1><time datetime="2026-04-20T10:00:00">x</time>
<div class="topic-body__content"><p>Первый абзац достаточной длины.</p><p>коротко</p><p>Первый абзац достаточной длины.</p><p>Последние новости и ещё какой-то текст</p></div></div>
<script>var p = "<p>Этого абзаца быть не должно.</p>";</script><!-- <p>И этого комментария тоже.</p> --></body></html>"""


def test_parse_page(spark):
    df = spark.createDataFrame([(PAGE,), ("<p>nothing</p>",)], "html string")
    got = df.select(*[c.alias(k) for k, c in h.parse(F.col("html"), h.SITES["lenta"]).items()]).collect()
    assert got[0].asDict() == {
        "title": "Большой «заголовок»", "subtitle": None, "body_text": "Первый абзац достаточной длины.", "published_at": "2026-04-20T10:00:00", "author": "Data Author", "category": "Мир & люди",
    }
    assert got[1]["title"] == "" and got[1]["body_text"] == "" and got[1]["author"] is None


def test_strip_tags(spark):
    assert one(spark, "<p>a&nbsp;b</p><br>c<style>x</style>\n\n\n\n<b>d</b>", h.strip_tags) == "a b\n\nc\n\nd"
    assert one(spark, "&#1071;&#x42F; &amp;lt; &copy; &unknown; &#0; &", h.unescape) == "ЯЯ &lt; © &unknown; &#0; &"
    el = "<meta content='a \"b\"' NAME=\"x\" data-name='n'>"
    assert one(spark, el, lambda c: h.attribute(c, "content")) == 'a "b"' and one(spark, el, lambda c: h.attribute(c, "name")) == "x" and one(spark, el, lambda c: h.attribute(c, "href")) is None
