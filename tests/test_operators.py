import numpy as np
import pytest
from pyspark.sql import functions as F

from presswork.functions import html as H
from presswork.functions import text as t
from presswork.functions.providers import OverlapReranker, Scripted
from presswork.operators import chunking, frames, ingest, retrieval, store
from presswork.plans import queries as Q
from presswork.sources import discovery as D


def arts(spark, rows):
    return spark.createDataFrame(rows, "id bigint, source_id bigint, url string, title string, subtitle string, body_text string, published_at string, author string, category string, content_hash string, is_canonical boolean, duplicate_group_id string")


def fold(body, target=700, least=300):
    out, cur = [], ""
    for p in [x for x in body.split("\n\n") if x]:
        if cur and len(cur) + len(p) + 2 > target and len(cur) >= least:
            out.append(cur)
            cur = ""
        cur = p if not cur else cur + "\n\n" + p
    return out + ([cur] if cur else [])


def test_chunks_follow_the_fold_and_their_offsets(spark):
    bodies = ["", "one", "\n".join("p" * k for k in (100, 250, 300, 200, 900, 10, 320, 380)), "x" * 5000, "a" * 298 + "\n" + "b" * 400 + "\n" + "c" * 2]
    got = chunking.chunk_articles(spark.createDataFrame(list(enumerate(bodies)), "id bigint, body_text string")).collect()
    for i, b in enumerate(bodies):
        whole = "\n\n".join(x for x in b.split("\n") if x)
        mine = sorted((r["chunk_index"], r["chunk_text"], r["char_start"], r["char_end"]) for r in got if r["article_id"] == i)
        assert [m[1] for m in mine] == fold(whole)
        assert all(whole[s:e] == c for _, c, s, e in mine)


def test_arrival_order_and_dropped_urls(spark):
    # 2 repeats 1's text and so never registers its url: 3 with that url and new text is kept.
    df = spark.createDataFrame([(1, "u1", "h1"), (2, "u2", "h1"), (3, "u2", "h2"), (4, "u1", "h9"), (5, None, "h2"), (6, None, None)], "id bigint, url string, content_hash string")
    got = {r["id"]: r["kept_id"] for r in ingest.arrival_winners(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 3, 6: 6}


def test_ingest_statuses(spark):
    text = "word " * 40
    stored = arts(spark, [(1, 1, "https://a.example/1", "T", None, text, "2026-01-01", None, None, None, True, None)])
    new = arts(spark, [
        (10, 1, "HTTPS://A.example/1/?utm_x=1", "T", None, "other " * 40, "2026-01-01", None, None, None, True, None),
        (11, 1, "https://a.example/2", "T", None, text, "2026-01-01", None, None, None, True, None),
        (12, 1, "https://a.example/3", "T", None, "fresh " * 40, "2026-01-01", None, None, None, True, None),
        (13, 1, "https://a.example/3", "T", None, "again " * 40, "2026-01-01", None, None, None, True, None),
        (14, 1, "https://a.example/4", "T", None, "short", "2026-01-01", None, None, None, True, None),
        (15, 2, "https://a.example/5", None, None, text, "2026-01-01", None, None, None, True, None),
    ])
    got = ingest.ingest(new, stored)
    assert {r["id"]: r["status"] for r in got.collect()} == {10: "skipped_existing", 11: "skipped_duplicate", 12: "saved", 13: "skipped_duplicate", 14: "skipped_invalid", 15: "skipped_invalid"}
    c = {r["source_id"]: r for r in ingest.counters(got).collect()}
    assert (c[1]["discovered"], c[1]["saved"], c[1]["skipped_existing"], c[1]["skipped_duplicates"], c[2]["skipped_invalid"]) == (5, 1, 1, 3, 1)


def test_latest_and_flags(spark):
    df = spark.createDataFrame([(1, "a", 1, True), (1, "b", 2, True), (2, "c", 1, False)], "id bigint, v string, version int, is_active boolean")
    assert {(r["id"], r["v"]) for r in ingest.latest(df, ["id"], ["version"]).collect()} == {(1, "b"), (2, "c")}
    assert store.set_flag(df, F.col("id") == 1, "is_active", False).where("is_active").count() == 0
    assert store.domains_key([" b ", "a", "b", ""]) == "a,b" and store.domains_key([]) == "*"


def test_search_filters_terms_and_ranking(spark, data):
    rows, asked = Q._embedded(spark, data)
    assert retrieval.search(rows, t.Query.of("и в на"), asked, None, None).count() == 0
    found = retrieval.search(rows, Q.QUERY, asked, Q.FROM, Q.TO, 5, model=OverlapReranker())
    pdf = found.toPandas()
    assert len(pdf) <= 5 and pdf["article_id"].value_counts().max() <= 2
    few = retrieval.rerank(retrieval.hybrid(rows, Q.QUERY, asked, Q.FROM, Q.TO, 5), Q.QUERY, 5)
    ids = [r["chunk_id"] for r in few.orderBy(*retrieval.order_keys()).collect()]
    told = retrieval.rerank(few, Q.QUERY, 5, ranking=[ids[-1], 999_999_999]).collect()
    assert {r["chunk_id"]: r["rerank_score"] for r in told}[ids[-1]] == 1.0
    assert retrieval.summary(found.limit(0).withColumn("quality", F.lit(0.0))).first()["summary"] == retrieval.NOTHING


def test_narrow_query_without_evidence_finds_nothing(spark):
    q = t.Query.of("block telegram messenger channel")
    row = spark.sql("select 1L chunk_id, 0.0d overlap, 0.0d anchor, 0 anchor_matches, 0.9d vector_score, 0.9d final_score, 0.06d quality")
    assert retrieval.topical(row, q).count() == 0
    assert retrieval.topical(row, t.Query.of("some other thing")).count() == 1


def test_classification_margin_and_reasons(spark):
    f = spark.createDataFrame([("f1", 1, "t"), ("f2", 2, "t"), ("f3", 3, None), ("f4", 4, "other")], "frame_id string, article_id bigint, topic_id string")
    v = spark.createDataFrame([("f1", [1.0, 0.0]), ("f2", [1.0, 1.0]), ("f4", [1.0, 0.0])], "frame_id string, vector array<double>")
    c = spark.createDataFrame([("c1", "t", [1.0, 0.0]), ("c2", "t", [0.0, 1.0])], "cluster_id string, topic_id string, centroid array<double>")
    got = {r["frame_id"]: (r["cluster_id"], r["reason"]) for r in frames.classify(f, v, c).collect()}
    assert got == {"f1": ("c1", "embedding_similarity"), "f2": (None, "unknown_or_ambiguous"), "f3": (None, "missing_embedding"), "f4": (None, "unknown_or_ambiguous")}


def test_topic_text_is_whole(spark):
    said = lambda stem, n: " ".join(stem + chr(0x430 + i // 32) + chr(0x430 + i % 32) for i in range(n))
    long, late = said("слово", 300), said("поздно", 40)
    rows = [(1, "Заголовок статьи", None, "тело", [long, "кусок " + late, None, "четвёртый", "пятый"]), (2, "Второй", "Подзаголовок", said("начало", 60) + " " + late, None),
            (3, "Третий", None, "короткое тело", ["кусок"]), (4, None, None, None, None), (5, "Words in English 12", "", "All in English", [])]
    docs = spark.createDataFrame(rows, "topic_id int, title string, subtitle string, body_text string, chunk_texts array<string>")
    got = {r["topic_id"]: r["words"] for r in frames.topic_words(docs).collect()}
    assert got[1] == ["заголовок", "статьи", *long.split()[:220], "кусок", *late.split(), "четвёртый"]
    assert got[2] == ["второй", "подзаголовок", *said("начало", 60).split(), *late.split()]
    assert got[3] == ["короткое", "тело"] and got[4] == got[5] == []
    assert "поздноаа" in {r["word"] for r in frames.ctfidf(frames.topic_words(docs), 400).where("topic_id = 2").collect()}


def test_topic_ctfidf_reads_past_the_beginning(spark, tmp_path):
    body = " ".join(["начало"] * 80) + " редкость"
    spark.createDataFrame([(1, "м", None, body, "t"), (2, "м", None, "иное " * 90, "u")], "id bigint, title string, subtitle string, body_text string, category string").write.parquet(f"{tmp_path}/articles.parquet")
    spark.createDataFrame([], "article_id bigint, chunk_index int, chunk_text string").write.parquet(f"{tmp_path}/article_chunks.parquet")
    assert {r["word"] for r in Q.topic_ctfidf(spark, str(tmp_path)).where("topic_id = 't'").collect()} == {"начало", "редкость"}


def test_density_clusters():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.05, (20, 4)), rng.normal(5, 0.05, (15, 4)), rng.normal(-6, 0.05, (12, 4)), rng.uniform(-20, 20, (5, 4))])
    got = frames.hdbscan(x, 5)
    assert len({*got[:20]}) == len({*got[20:35]}) == len({*got[35:47]}) == 1 and len({got[0], got[20], got[35]}) == 3
    assert (frames.hdbscan(x[:2], 5) == -1).all()


def test_grouped_clusters(spark):
    rng = np.random.default_rng(1)
    pts = np.concatenate([rng.normal(0, 0.02, (8, 3)), rng.normal(3, 0.02, (8, 3))])
    f = spark.createDataFrame([(f"f{i:02}", i, "t") for i in range(16)], "frame_id string, article_id bigint, topic_id string")
    v = spark.createDataFrame([(f"f{i:02}", [float(z) for z in p]) for i, p in enumerate(pts)], "frame_id string, vector array<double>")
    assert frames.cluster_frames(f, v).select("local_cluster").distinct().count() == 2


def test_feeds_sections_and_archives(spark):
    c = D.source_config("lenta")
    item = lambda u: f"<item><link>{u}</link></item>"
    one, two, three = (f"https://lenta.ru/news/2026/04/20/{x}/" for x in ("one", "two", "three"))
    first = f"<rss><channel><link>https://lenta.ru</link>{item(one)}<entry><link href='{two}'/></entry>{item('https://lenta.ru/rubrics/x/')}{item(one)}</channel></rss>"
    feeds = spark.createDataFrame([(c.rss_urls[1], f"<rss>{item(three)}{item(two)}</rss>"), (c.rss_urls[0], first)], "feed_url string, xml string")
    # First seen over all feeds of the source, in the order of its configuration.
    assert [r["url"] for r in D.feed_links(feeds, c).orderBy("pos").collect()] == [one, two, three]
    assert [r["url"] for r in D.feed_links(feeds, c, 2).orderBy("pos").collect()] == [one, two]
    page = '<a href="/news/2026/04/20/a/">1</a><a href="/news/2026/04/20/a/?x=1">2</a><a href="https://other.example/z">3</a><a href="../../../rubrics/q/">4</a>'
    days = D.archive_days(spark, c, "2026-04-19", "2026-04-20")
    got = D.archive_links(days, spark.createDataFrame([("https://lenta.ru/2026/04/20/", page)], "archive_url string, html string"), c)
    assert {(str(r["day"]), r["url"]) for r in got.collect()} == {("2026-04-19", None), ("2026-04-20", "https://lenta.ru/news/2026/04/20/a/")}
    sec = D.section_links(spark.createDataFrame([("https://lenta.ru/a/b/c/d.html", page), ("https://lenta.ru/news/", page)], "page_url string, html string"), c)
    assert {r["url"] for r in sec.collect()} == {"https://lenta.ru/news/2026/04/20/a/", "https://lenta.ru/news/2026/04/20/a/?x=1", "https://lenta.ru/rubrics/q/"}


def test_links_are_read_against_their_page(spark):
    cases = {"x.html": "https://a.example/p/q/x.html", "/x": "https://a.example/x", "../y/./z?a=../b": "https://a.example/p/y/z?a=../b", "//c.example/d": "https://c.example/d", "http://e.example": "http://e.example", "../../../../w": "https://a.example/w"}
    df = spark.createDataFrame([(k,) for k in cases], "href string")
    got = df.select("href", H.absolute(F.col("href"), "https://a.example/p/q/r?s=1").alias("u")).collect()
    assert {r["href"]: r["u"] for r in got} == cases


def test_unknown_site_is_an_error(spark):
    pages = spark.createDataFrame([("u", "<p>x</p>", "elsewhere")], "url string, html string, site string")
    with pytest.raises(Exception, match="unknown parser"):
        D.parse_pages(pages).collect()


def test_summary_keeps_poor_chunks_if_all_are_poor(spark):
    schema = "chunk_id bigint, chunk_text string, quality double, final_score double, rerank_score double, lexical_score double, vector_score double, published_at string, article_title string"
    rows = [(1, " poor one ", -0.65, 0.9, 0.0, 0.0, 0.0, "2026", "t"), (2, "poor two", -0.8, 0.8, 0.0, 0.0, 0.0, "2026", "t"), (3, "good", 0.06, 0.1, 0.0, 0.0, 0.0, "2026", "t")]
    df = spark.createDataFrame(rows, schema)
    told = lambda d: retrieval.summary(d).first()["summary"]
    assert told(df) == "good" and told(df.where("chunk_id < 3")) == "poor one\n\npoor two" and told(df.limit(0)) == retrieval.NOTHING
    query = t.Query.of("poor words")
    assert retrieval.model_summary(df, query, Scripted(lambda p: " Сводка. ")) == "Сводка." and retrieval.model_summary(df, query, Scripted(lambda p: "no")) == "good"
    ranked = retrieval.listwise(df, query, Scripted(lambda p: '{"ranked_chunk_ids": ["3", 9, 3, 1]}')).collect()
    assert {r["chunk_id"]: round(r["rerank_score"], 4) for r in ranked} == {1: 0.25, 2: 0.0, 3: 1.0}
    assert {r["rerank_score"] for r in retrieval.listwise(df, query, Scripted(lambda p: "nothing")).collect()} == {0.0}


def test_fetch_retries():
    waits, calls = [], []

    def get(url):
        calls.append(url)
        if len(calls) < 3:
            raise OSError("down")
        return b"ok"

    assert D.fetch(get, "u", retries=2, delay=2.0, multiplier=2.0, sleep=waits.append) == b"ok" and waits == [2.0, 4.0]
