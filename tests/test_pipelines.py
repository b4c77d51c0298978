import numpy as np

from presswork.plans import pipelines as P
from presswork.streaming import incremental as S

SCHEMA = "frame_id string, article_id bigint, topic_id string, status string, main_claim string, cause string, mechanism string, consequence string, future_expectation string, valence string, actors array<string>, implications array<string>, confidence double"


def page(i, text):
    return f'<h1>Title {i}</h1><time datetime="2026-04-{10 + i}T10:00"></time><section class="topic-page__content"><p>{text}</p></section>'


def test_pages_to_articles_and_chunks(spark):
    long = "Предложение достаточной длины для статьи. " * 8
    pages = spark.createDataFrame([(1, 7, "https://lenta.ru/a", page(1, long), "lenta"), (2, 7, "https://lenta.ru/b", page(2, long), "lenta"), (3, 7, "https://lenta.ru/c", page(3, "мало"), "lenta")], "id bigint, source_id bigint, url string, html string, site string")
    stored = spark.createDataFrame([], "id bigint, source_id bigint, url string, title string, subtitle string, body_text string, published_at string, author string, category string, content_hash string, is_canonical boolean, duplicate_group_id string")
    out = P.ingest_pages(pages, stored)
    assert [r["id"] for r in out["articles"].collect()] == [1]
    assert out["chunks"].count() == 1
    c = out["counters"].first()
    assert (c["discovered"], c["saved"], c["skipped_duplicates"], c["skipped_invalid"]) == (3, 1, 1, 1)


def test_narrative_run_and_views(spark):
    rng = np.random.default_rng(2)
    rows, vecs = [], []
    for k in range(2):
        centre = np.eye(4)[k] * 3
        for i in range(8):
            fid = f"f{k}{i}"
            rows.append((fid, k * 10 + i, "t", "ok", "Длинное утверждение о том, как меняется городская политика " + fid, "достаточно длинная причина", "достаточно длинный механизм", None, None, "тревожная", ["Мэрия"], ["рост недоверия"], 0.5))
            vecs.append((fid, [float(x) for x in centre + 0.01 * rng.normal(size=4)]))
    rows.append(("fx", 99, "t", "no_clear_narrative", "x", None, None, None, None, None, [], [], None))
    frames, vectors = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(vecs, "frame_id string, vector array<double>")
    arts = spark.createDataFrame([(k * 10 + i, 1 + i % 2, f"2026-0{1 + i % 3}-05") for k in range(2) for i in range(8)], "id bigint, source_id bigint, published_at string")
    sources = spark.createDataFrame([(1, "a.example"), (2, "b.example")], "id bigint, domain string")
    run = P.analyse(frames, vectors, arts, sources)
    assert run["clusters"].count() == 2
    a = {r["frame_id"]: r for r in run["assignments"].collect()}
    assert a["fx"]["reason"] == "missing_embedding" and a["f00"]["assigned"] and a["f00"]["cluster_id"] != a["f10"]["cluster_id"]
    lab = run["labels"].collect()
    assert {r["title"] for r in lab} == {"Рост недоверия нарратив: Мэрия"} and lab[0]["dominant_tone"] == "тревожная"
    s = run["dynamics"].collect()
    assert {r["total_articles"] for r in s} == {8} and {r["n_points"] for r in s} == {3}
    assert P.strong_clusters(run).count() == 2
    assert P.new_analyses(arts, arts.select(arts.id.alias("article_id")).limit(3)).count() == 13
    assert P.evaluation(run).where("measure = 'clusters'").first()["value"] == 2


def test_frames_of_model_answers(spark):
    df = spark.createDataFrame([
        (1, "T", 'ok {"frames": [{"main_claim": " c1 ", "actors": ["A", " "], "implications": "one", "confidence": 0.5}, {"main_claim": ""}]}'), (2, "T2", "sorry"), (3, None, None), (4, "T4", '{"frames": "text"}'),
    ], "article_id bigint, title string, answer string")
    got = {r["frame_id"]: (r["status"], r["main_claim"], r["actors"], r["implications"]) for r in P.frames_from_answers(df).collect()}
    assert got["frame-1-1"] == ("ok", "c1", ["A"], ["one"])
    assert got["frame-2-1"][:2] == ("no_clear_narrative", "T2") and got["frame-3-1"][:2] == ("no_clear_narrative", "") and got["frame-4-1"][0] == "no_clear_narrative"


def test_streamed_pages_reach_the_store_once(spark, tmp_path):
    long = "Предложение достаточной длины для статьи. " * 8
    landed, store = str(tmp_path / "pages"), str(tmp_path / "store")
    rows = [("https://lenta.ru/a", page(1, long), "lenta"), ("https://lenta.ru/a", page(1, long), "lenta"), ("https://lenta.ru/b", page(2, long + "Ещё одно."), "lenta")]
    add = lambda r: spark.createDataFrame(r, "url string, html string, site string").selectExpr("*", "current_timestamp() as fetched_at").write.mode("append").parquet(landed)
    add(rows)
    for _ in range(2):
        S.append_new(S.article_stream(S.landed_pages(spark, landed)), store, str(tmp_path / "check"), spark).awaitTermination()
        add(rows[:1])
    assert sorted(r["url"] for r in spark.read.parquet(store).collect()) == ["https://lenta.ru/a", "https://lenta.ru/b"]


def test_windowed_counts(spark, data, tmp_path):
    spark.read.parquet(f"{data}/events.parquet").write.parquet(str(tmp_path / "events"))
    schema = spark.read.parquet(str(tmp_path / "events")).schema
    q = S.counts(spark.readStream.schema(schema).parquet(str(tmp_path / "events"))).writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from windowed").first()[0] == spark.read.parquet(str(tmp_path / "events")).count()
