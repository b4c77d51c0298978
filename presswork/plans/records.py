"""Queries of the stored side: upserts, caches, backfill, topics of articles, views, and both sites' pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as h
from ..functions import text as t
from ..operators import frames, ingest, retrieval, store
from ..runtime import table
from . import pipelines, queries as q

#: The representation's length that the refusing embedder of frame_embedding_retry takes at most.
MOST_SIGNS = 420


def embedding_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Vectors' sizes by frame and model, those of every third article in a new version."""
    e = table(spark, d, "frame_embeddings").groupBy("frame_id", "model_name").agg(F.max(F.size("vector")).alias("dimension"))
    old = e.withColumn("created_at", F.lit("2024-01-01 00:00:00"))
    new = e.where(F.regexp_extract("frame_id", "^frame-([0-9]+)-", 1).try_cast("bigint") % 3 == 0)
    new = new.withColumns({"dimension": F.coalesce("dimension", F.lit(0)) + 1, "created_at": F.lit("2025-01-01 00:00:00")})
    return store.upsert(old, new.unionByName(new.withColumn("model_name", F.lit("another"))), ["frame_id", "model_name"])


def analysis_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Analyses by article: rewritten ones keep created_at and get a new updated_at; publication times in the sortable form."""
    a = table(spark, d, "articles").select(F.col("id").alias("article_id"), t.compact(F.col("published_at")).alias("published_at"), F.lit(1).alias("frame_count"), "created_at", "updated_at")
    new = a.where("article_id % 4 = 0").withColumns({"frame_count": F.lit(2), "created_at": F.lit("2026-01-01 00:00:00"), "updated_at": F.lit("2026-01-01 00:00:00")})
    i = table(spark, d, "incoming_articles").select(F.col("id").alias("article_id"), t.compact(F.col("published_at")).alias("published_at"))
    more = i.withColumns({"frame_count": F.lit(3), "created_at": F.lit("2026-01-01 00:00:00"), "updated_at": F.lit("2026-01-01 00:00:00")})
    return store.upsert(a, new.unionByName(more), ["article_id"], ("created_at",))


def flag_updates(spark: SparkSession, d: str) -> DataFrame:
    """Whether a canonical flag's update finds its row, for known, incoming and made-up ids."""
    asked = table(spark, d, "incoming_articles").select("id").unionByName(table(spark, d, "articles").where("id % 5 = 0").select("id"))
    return store.matched(table(spark, d, "articles"), asked)


def source_registry(spark: SparkSession, d: str) -> DataFrame:
    """The documents' domains as sources: known ids, and new ones after the largest."""
    return store.get_or_create_sources(table(spark, d, "sources"), table(spark, d, "documents").select(F.col("source").alias("domain")).unionByName(table(spark, d, "sources").where("id <= 10").select("domain")))


def chunk_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Articles that have no chunk yet."""
    return store.without_chunks(table(spark, d, "articles"), table(spark, d, "article_chunks")).select("id", "is_canonical")


def bulk_days(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of the incoming rows by day of receipt, with running totals."""
    i = ingest.normalise(table(spark, d, "incoming_articles")).withColumns({"verdict": ingest.validity(), "day": F.date_format("received_at", "yyyy-MM-dd")})
    s = i.select("id", "day", F.when(F.col("verdict") == "ok", "saved").otherwise("skipped_invalid").alias("status"))
    return ingest.accumulated(s, "day").select("day", "discovered", "saved", "skipped_invalid", "total_discovered", "total_saved", "total_skipped_invalid")


def articles_by_ids(spark: SparkSession, d: str) -> DataFrame:
    """The articles that duplicate records name, newest first."""
    ids = table(spark, d, "article_duplicates").select(F.col("article_id").alias("id"))
    return store.by_ids(table(spark, d, "articles"), ids).select("id", "published_at")


def latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The newest of three runs, two of them of the asked key."""
    runs = None
    for i, (domains, to) in enumerate(((["b", "a"], q.TO), (["a", "b "], q.TO), (["a"], q.TO)), 1):
        s = store.snapshot({"articles": table(spark, d, "articles").where(f"id % {i} = 0")}, domains, q.FROM, to).withColumn("id", F.lit(i))
        runs = s if runs is None else runs.unionByName(s)
    return store.latest_run(runs, [" a", "b"], q.FROM, q.TO).select("id", "source_domains_key", "n_articles", "payload_json")


def vector_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Stored vectors of one model with their chunks in scope: a frame's vector stands for its article's first chunk."""
    c = table(spark, d, "article_chunks").where("chunk_index = 0").groupBy("article_id").agg(F.min("id").alias("chunk_id"))
    e = table(spark, d, "frame_embeddings").groupBy("frame_id", "model_name").agg(F.max("vector").alias("embedding"))
    held = e.withColumn("article_id", F.regexp_extract("frame_id", "^frame-([0-9]+)-", 1).try_cast("bigint")).join(c, "article_id").drop("article_id")
    found = retrieval.vector_candidates(held, q._rows(spark, d), "narr-embed-a64", q.FROM, q.TO, q.DOMAINS)
    return found.select("frame_id", "chunk_id", "article_id", "source_domain", F.size("embedding").alias("dimension"))


def frame_embedding_retry(spark: SparkSession, d: str) -> DataFrame:
    """How each frame's embedding came about with an embedder that refuses long texts."""

    def embed(text: str) -> list[float]:
        if len(text) > MOST_SIGNS:
            raise ValueError("too long")
        return [float(len(text)), 1.0]

    out = pipelines.embed_representations(q._frames(spark, d), embed, "short")
    return out.select("frame_id", "status", F.length("representation_text").alias("n_signs"))


def frame_codec(spark: SparkSession, d: str) -> DataFrame:
    """Frames written as JSON and read back."""
    f = q._frames(spark, d).select(frames.of_json(frames.to_json()).alias("f"))
    return f.select("f.frame_id", "f.article_id", "f.main_claim", F.coalesce(F.size("f.actors"), F.lit(0)).alias("n_actors"), F.array_join("f.implications", "; ").alias("implications"))


def _topics(spark: SparkSession, d: str) -> DataFrame:
    """Topics in order: sources' own ones (none for every other source), then categories."""
    a = table(spark, d, "articles")
    by_source = a.where("source_id % 2 = 0").select(F.col("source_id").alias("topic_no"), F.concat(F.lit("source-"), F.col("source_id").cast("string")).alias("topic_id"), F.col("id").alias("article_id"))
    by_name = a.select(F.lit(1_000).cast("bigint").alias("topic_no"), t.optional(F.col("category")).alias("topic_id"), F.col("id").alias("article_id")).where("topic_id is not null")
    return by_source.unionByName(by_name)


def article_topics(spark: SparkSession, d: str) -> DataFrame:
    """Every article's first topic."""
    return frames.article_topics(_topics(spark, d))


def dominant_topics(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent topic of every source's frames, the earlier frame's of equal ones."""
    f = q._frames(spark, d).join(table(spark, d, "articles").select(F.col("id").alias("article_id"), "source_id"), "article_id")
    return frames.dominant(f, "source_id", "topic_id", "frame_id")


def materialization(spark: SparkSession, d: str) -> DataFrame:
    """What a cached run does where every third article has been analysed before."""
    a = table(spark, d, "articles").where("is_canonical")
    return pipelines.materialised(a, a.where("id % 3 = 0").select(F.col("id").alias("article_id")), q._frames(spark, d))


def cached_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames read from a cache of analyses in range, with their topics: every fifth article's are stored without one."""
    f = q._frames(spark, d).withColumn("j", F.to_json(F.struct(*[c for c in frames._CODED], F.when(F.col("article_id") % 5 != 0, F.col("topic_id")).alias("topic_id"))))
    a = table(spark, d, "articles").join(F.broadcast(table(spark, d, "sources").select(F.col("id").alias("source_id"), F.col("domain").alias("source_domain"))), "source_id")
    cache = f.groupBy("article_id").agg(F.to_json(F.collect_list("j")).alias("payload_json")).join(a.select(F.col("id").alias("article_id"), "source_domain", "published_at"), "article_id")
    return pipelines.cached_frames(cache, frames.article_topics(_topics(spark, d)), q.FROM, q.TO).select("frame_id", "article_id", "topic_id", "main_claim")


def dynamics_view(spark: SparkSession, d: str) -> DataFrame:
    """The twelve largest clusters' dynamics, with three digits."""
    return pipelines.dynamics_view(q.dynamics_series(spark, d))


def cyrillic(spark: SparkSession, d: str) -> DataFrame:
    """Whether a document has Cyrillic letters."""
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.col("text").rlike("[А-Яа-яЁё]"), F.lit(False)).alias("cyrillic"))


def _site_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of the articles in the markup of the second site."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&#60;")), F.lit(">"), F.lit("&#x3E;"))
    html = F.concat(
        F.lit("<html><head><meta content='rubric' name=\"article:section\"></head><body><div class=\"article__share\">share</div><h1 class='x article__title'>"), esc(F.col("title")), F.lit('</h1><h1 class="article__title">'), esc(F.col("title")),
        F.lit('</h1><a class="article__tag">tag</a><div class="article__text">'), esc(F.col("body_text")), F.lit('</div><a class="article__author" href=\'/a?x=1\'>'), esc(F.col("author")), F.lit("</a></body></html>"),
    )
    return table(spark, d, "articles").select(F.col("id").alias("page_id"), html.alias("html"))


def page_articles_second(spark: SparkSession, d: str) -> DataFrame:
    """Articles read from the second site's pages, whose category comes from the page's meta first."""
    got = h.parse(F.col("html"), h.SITES["ria"])
    return _site_pages(spark, d).select("page_id", *[got[c].alias(c) for c in ("title", "author", "category")], F.md5(got["body_text"]).alias("body_md5"))


def page_attributes(spark: SparkSession, d: str) -> DataFrame:
    """An attribute's value of the pages' last link and of their meta element."""
    p = _site_pages(spark, d).select("page_id", F.element_at(h.elements(F.col("html"), "a"), -1).alias("link"), F.get(h.elements(F.col("html"), "meta"), F.lit(0)).alias("meta"))
    return p.select("page_id", h.attribute(F.col("link"), "href").alias("href"), h.attribute(F.col("meta"), "content").alias("content"), h.attribute(F.col("meta"), "charset").alias("charset"))


QUERIES = {
    f.__name__: f
    for f in (
        embedding_upsert, analysis_upsert, flag_updates, source_registry, chunk_backfill, bulk_days, articles_by_ids, latest_snapshot, vector_candidates, frame_embedding_retry, frame_codec,
        article_topics, dominant_topics, materialization, cached_frames, dynamics_view, cyrillic, page_articles_second, page_attributes,
    )
}
