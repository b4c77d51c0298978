"""The catalogue of core queries: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import html as h
from ..functions import text as t
from ..functions.providers import OverlapReranker
from ..operators import chunking, frames, ingest, retrieval, store
from ..operators import timestamps as ts
from ..operators.search_store import SearchStore
from ..runtime import modified, scratch_path, table
from ..sources import discovery

#: The query, dates and limits of the retrieval queries.
ASKED, FROM, TO, LIMIT = "flood risk map reviewed by the harbour board", "2024-01-01", "2026-12-31", 10
QUERY = t.Query.of(ASKED)
#: The domains of the date range query.
DOMAINS = ["news659-dale-4.example", "vest850-grad-1.example", "blatt687-tal-6.example"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Articles whose publication text names a definite, existing time, with that instant."""
    out = ts.article_instants(table(spark, d, "articles"), table(spark, d, "source_profiles"))
    return out.where(F.col("published_utc_us").isNotNull()).select("article_id", "published_utc_us")


def p1_status(spark: SparkSession, d: str) -> DataFrame:
    """How each source's publication texts were resolved."""
    out = ts.article_instants(table(spark, d, "articles"), table(spark, d, "source_profiles"))
    return out.groupBy("source_id", "utc_status").agg(F.count("*").alias("n_articles"), F.min("published_utc_us").alias("first_us"), F.max("published_utc_us").alias("last_us"))


# Text, urls, ingestion


def normalize_hash(spark: SparkSession, d: str) -> DataFrame:
    a = ingest.normalise(table(spark, d, "articles"))
    return a.select("id", "title", "subtitle", "author", "category", "word_count", "content_hash", F.length("body_text").alias("body_length"))


def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "incoming_articles").select("id", "url").unionByName(table(spark, d, "articles").select("id", "url"))
    return a.select("id", t.url(F.col("url")).alias("normal_url"))


def validate_articles(spark: SparkSession, d: str) -> DataFrame:
    a = ingest.normalise(table(spark, d, "articles")).withColumn("verdict", ingest.validity())
    return a.groupBy("source_id", "verdict").agg(F.count("*").alias("n"))


def dedup_canonical(spark: SparkSession, d: str) -> DataFrame:
    return ingest.canonical_by_hash(ingest.normalise(table(spark, d, "articles")))


def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return ingest.duplicates_of(ingest.normalise(table(spark, d, "incoming_articles")), ingest.normalise(table(spark, d, "articles")))


def ingest_counters(spark: SparkSession, d: str) -> DataFrame:
    return ingest.counters(ingest.ingest(table(spark, d, "incoming_articles"), table(spark, d, "articles")))


def upsert_compaction(spark: SparkSession, d: str) -> DataFrame:
    cols = ["url", "id", "title", "source_id"]
    old = table(spark, d, "articles").select(*cols, F.lit(0).alias("version"))
    new = table(spark, d, "incoming_articles").select(*cols, F.col("batch_no").alias("version"))
    return ingest.latest(old.unionByName(new).where("url is not null"), ["url"], ["version", "id"]).select("url", "id", "title", "source_id", "version")


def latest_incoming(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "incoming_articles").withColumn("received_us", F.unix_micros("received_at"))
    return ingest.latest(i, ["source_id"], ["received_us", "id"]).select("source_id", "id", "batch_no", "received_us")


def integrity(spark: SparkSession, d: str) -> DataFrame:
    return store.violations(*[table(spark, d, x) for x in ("sources", "articles", "article_chunks", "article_duplicates")])


# Reads


def date_range(spark: SparkSession, d: str) -> DataFrame:
    out = store.in_range(table(spark, d, "articles"), table(spark, d, "sources"), "2024-03-01", "2025-09-30T12:00", DOMAINS)
    return out.select("id", "source_id", t.compact(F.col("published_at")).alias("published_minute"), F.lit(store.domains_key(DOMAINS)).alias("domains_key"))


def recent_by_source(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles").where("published_at is not null")
    return store.by_source(a, 5).select("source_id", "id", "published_at")


def active_sources(spark: SparkSession, d: str) -> DataFrame:
    return store.list_sources(table(spark, d, "sources"), True).select("id", "name", "domain")


def load_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = store.documents(table(spark, d, "articles"), table(spark, d, "sources"), table(spark, d, "article_chunks"), FROM, TO)
    return docs.select("article_id", "source_domain", F.size("chunk_texts").alias("n_chunks"), F.md5(F.array_join("chunk_texts", "|")).alias("chunks_md5"))


def missing_embeddings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "frame_embeddings").where("vector is not null")
    rows = table(spark, d, "article_chunks").select(F.col("id").alias("chunk_id"), "article_id").distinct()
    told = frames.frames_of_representations(e).select("article_id").distinct()
    held = rows.join(told, "article_id", "left_semi").select("chunk_id", F.lit("m").alias("model_name"))
    return retrieval.index_missing(rows, held, "m")


def snapshot_counts(spark: SparkSession, d: str) -> DataFrame:
    tables = {x: table(spark, d, x) for x in ("articles", "article_chunks", "article_duplicates", "frame_embeddings")}
    return store.snapshot(tables, [" b.example", "a.example"], FROM, TO).drop("payload_json")


# Pages


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages made of the articles, in the markup of a known site."""
    a = table(spark, d, "articles")
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.concat(
        F.lit('<html><head><script>var a = "<p>no</p>";</script></head><body><!-- top --><h1 class="topic-body__title">'), esc(F.col("title")),
        F.lit('</h1><a href="'), F.coalesce("url", F.lit("")), F.lit('">more</a><div class="topic-body__content"><p>'), esc(F.col("body_text")),
        F.lit('</p></div></div><span class="topic-authors__name">'), esc(F.col("author")), F.lit("</span></body></html>"),
    )
    return a.select(F.col("id").alias("page_id"), "source_id", html.alias("html"))


def page_text(spark: SparkSession, d: str) -> DataFrame:
    text = h.strip_tags(F.col("html"))
    return _pages(spark, d).select("page_id", F.length(text).alias("n_chars"), F.md5(text).alias("text_md5"))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", F.posexplode(h.links(F.col("html"))).alias("pos", "href"))


def page_articles(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d)
    got = h.parse(F.col("html"), h.SITES["lenta"])
    return p.select("page_id", got["title"].alias("title"), got["author"].alias("author"), F.md5(got["body_text"]).alias("body_md5"))


def archive_calendar(spark: SparkSession, d: str) -> DataFrame:
    days = discovery.archive_days(spark, discovery.source_config("lenta"), "2024-02-25", "2024-03-03")
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "archive_url")


# Chunks and retrieval


def chunk_corpus(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.chunk_articles(table(spark, d, "articles").where("is_canonical"))
    return c.select("article_id", "chunk_index", "char_start", "char_end", "token_count", F.md5("chunk_text").alias("chunk_md5"))


def chunk_quality(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "article_chunks").select("id", "chunk_text").distinct()
    return c.select("id", t.quality(F.col("chunk_text")).cast("double").alias("quality"), F.size(t.tokens(F.col("chunk_text"))).alias("n_tokens"))


def token_stats(spark: SparkSession, d: str) -> DataFrame:
    post = retrieval.postings(_rows(spark, d))
    return post.groupBy("token").agg(F.count("*").alias("n_chunks"), F.sum("tf").alias("n_places"))


def stems(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "articles").select(F.explode(F.array_distinct(t.tokens(F.col("title")))).alias("token")).distinct()
    return words.select("token", t.stem(F.col("token")).alias("stem"))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.search_rows(table(spark, d, "article_chunks"), table(spark, d, "articles"), table(spark, d, "sources"))


def _embedded(spark: SparkSession, d: str) -> tuple[DataFrame, object]:
    rows = _rows(spark, d).withColumn("embedding", t.hashed_embedding(F.concat_ws(" ", "article_title", "chunk_text")))
    return rows, t.hashed_embedding(F.lit(" ".join(raw for raw, _ in QUERY.terms)))


_stores: dict[tuple, SearchStore] = {}


def search_store(spark: SparkSession, d: str) -> SearchStore:
    """The stored index over a folder's chunks: made once an application and state of the tables, then read."""
    key = (spark.sparkContext.applicationId, d, *[modified(spark, f"{d}/{n}.parquet") for n in ("article_chunks", "articles", "sources")])
    if key not in _stores:
        _stores[key] = SearchStore.create(_embedded(spark, d)[0], scratch_path(spark, "search"))
    return _stores[key]


def _asked():
    return t.hashed_embedding(F.lit(" ".join(raw for raw, _ in QUERY.terms)))


def _fused(spark: SparkSession, d: str) -> DataFrame:
    s, wide = search_store(spark, d), max(3 * LIMIT, retrieval.HYBRID_LIMIT)
    return retrieval.fuse(s.lexical(QUERY, FROM, TO, wide), s.vector(QUERY, _asked(), FROM, TO, wide), QUERY, LIMIT)


def bm25_top(spark: SparkSession, d: str) -> DataFrame:
    return search_store(spark, d).lexical(QUERY, FROM, TO, 20).select("chunk_id", "article_id", "bm25", "lexical_rank")


def bm25_of_domains(spark: SparkSession, d: str) -> DataFrame:
    """The same within some domains."""
    return search_store(spark, d).lexical(QUERY, FROM, TO, 20, DOMAINS).select("chunk_id", "article_id", "bm25", "lexical_rank")


def index_append(spark: SparkSession, d: str) -> DataFrame:
    """An index of two thirds of the chunks, to which all are appended: the held ones are left out."""
    rows = _embedded(spark, d)[0]
    s = SearchStore.create(rows.where("chunk_id % 3 > 0"), scratch_path(spark, "search"))
    s.append(rows)
    return s.postings.groupBy("token").agg(F.count("*").alias("n_chunks"), F.sum("tf").alias("n_places"))


def contains_top(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.contains_score(_rows(spark, d), QUERY, FROM, TO, 20).select("chunk_id", "article_id", "match_count")


def query_overlap(spark: SparkSession, d: str) -> DataFrame:
    rows = retrieval.with_query(_rows(spark, d), QUERY)
    return rows.select("chunk_id", F.round("overlap", 6).alias("overlap"), F.round("anchor", 6).alias("anchor"), "anchor_matches")


def vector_top(spark: SparkSession, d: str) -> DataFrame:
    return search_store(spark, d).vector(QUERY, _asked(), FROM, TO, 20).select("chunk_id", "vector_score", "vector_final", "vector_rank")


def hybrid_top(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select("chunk_id", "article_id", "final_score", "lexical_score", "vector_score")


def _found(spark: SparkSession, d: str, model=None) -> DataFrame:
    return retrieval.narrowed(_fused(spark, d), QUERY, LIMIT, model)


def search_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).select("chunk_id", "article_id", "final_score", "kind")


def search_reranked(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, OverlapReranker()).select("chunk_id", "article_id", "final_score", "model_score", "kind")


def search_articles(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.source_articles(_found(spark, d))


def answer(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.summary(_found(spark, d)).select("n_chunks", F.md5("summary").alias("summary_md5"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """BM25 over the chunks, at most two of an article."""
    top = search_store(spark, d).lexical(QUERY, FROM, TO, 50)
    w = W.partitionBy("article_id").orderBy("lexical_rank")
    return top.withColumn("r", F.row_number().over(w)).where("r <= 2").select("chunk_id", "article_id", "article_title", "bm25", "lexical_rank")


# Narrative analytics: frames are read from their representations, topics are the articles' categories.


def _frames(spark: SparkSession, d: str) -> DataFrame:
    f = frames.frames_of_representations(table(spark, d, "frame_embeddings"))
    a = table(spark, d, "articles").select(F.col("id").alias("article_id"), t.optional(F.col("category")).alias("topic_id"), (F.col("word_count") % 100 / 100.0).cast("double").alias("confidence"))
    return f.join(a, "article_id", "left")


def _members(spark: SparkSession, d: str) -> DataFrame:
    """A cluster for each topic: its frames."""
    return _frames(spark, d).where("topic_id is not null").withColumn("cluster_id", F.concat(F.lit("cluster-"), F.col("topic_id")))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """The frames' vectors of one model only; frames that have vectors of another model alone are not covered."""
    e = table(spark, d, "frame_embeddings").where("model_name = 'narr-embed-a64' and vector is not null and size(vector) = 64 and forall(vector, x -> x is not null and not isnan(x))")
    return e.groupBy("frame_id").agg(F.min("vector").alias("vector"))


def frame_informative(spark: SparkSession, d: str) -> DataFrame:
    f = _frames(spark, d)
    return f.select("frame_id", "article_id", frames.informative().alias("informative"), frames.statement_like(F.col("main_claim")).alias("statement_like"), frames.operational(F.col("main_claim")).alias("operational"))


def frame_representation(spark: SparkSession, d: str) -> DataFrame:
    return _frames(spark, d).select("frame_id", frames.representation().alias("representation"), frames.compact_representation().alias("compact"))


def cluster_support(spark: SparkSession, d: str) -> DataFrame:
    return frames.support(_members(spark, d), table(spark, d, "articles"), table(spark, d, "sources"))


def cluster_event_like(spark: SparkSession, d: str) -> DataFrame:
    return frames.event_like(_members(spark, d))


def cluster_labels(spark: SparkSession, d: str) -> DataFrame:
    lab = frames.labels(_members(spark, d))
    return lab.select("cluster_id", "title", "summary", F.array_join("causal_chain", " > ").alias("causal_chain"), "dominant_tone", F.array_join("examples", " | ").alias("examples"))


def classify_margin(spark: SparkSession, d: str) -> DataFrame:
    m = _members(spark, d)
    v = _vectors(spark, d)
    return frames.classify(_frames(spark, d), v, frames.centroids(m.join(v, "frame_id", "left_semi"), v))


def classify_open(spark: SparkSession, d: str) -> DataFrame:
    """The same with centroids that fit every topic, counted by reason and cluster."""
    v = _vectors(spark, d)
    m = _members(spark, d).join(v, "frame_id", "left_semi").withColumn("topic_id", F.lit(None).cast("string"))
    c = frames.classify(_frames(spark, d), v, frames.centroids(m, v))
    return c.groupBy("reason", "cluster_id").agg(F.count("*").alias("n"), F.round(F.avg("similarity"), 5).alias("mean_similarity"))


def period_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").where("published_at is not null").groupBy(t.period(F.col("published_at")).alias("period")).agg(F.count("*").alias("n_articles"), F.count_distinct("source_id").alias("n_sources"))


def dynamics_points(spark: SparkSession, d: str) -> DataFrame:
    return frames.dynamics_points(_members(spark, d), table(spark, d, "articles"), table(spark, d, "sources"))


def dynamics_series(spark: SparkSession, d: str) -> DataFrame:
    m = _members(spark, d)
    return frames.dynamics_series(frames.dynamics_points(m, table(spark, d, "articles"), table(spark, d, "sources")), m)


def _topic_docs(spark: SparkSession, d: str) -> DataFrame:
    """Title, subtitle and the first 400 signs of the body: the text of topic_keywords only."""
    a = table(spark, d, "articles")
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("subtitle", F.lit("")), F.substring(F.coalesce("body_text", F.lit("")), 1, 400))
    return a.where(t.optional(F.col("category")).isNotNull()).select(t.optional(F.col("category")).alias("topic_id"), F.col("id").alias("doc_id"), text.alias("text"))


def topic_keywords(spark: SparkSession, d: str) -> DataFrame:
    k = frames.topic_keywords(_topic_docs(spark, d))
    return k.select("topic_id", F.array_join("keywords", " ").alias("keywords"), frames.topic_label(F.col("keywords"), F.col("topic_id")).alias("label"))


def topic_ctfidf(spark: SparkSession, d: str) -> DataFrame:
    """The telling words of every category over its articles' whole topic texts."""
    a = table(spark, d, "articles").select(F.col("id").alias("article_id"), t.optional(F.col("category")).alias("topic_id"), "title", "subtitle", "body_text").where("topic_id is not null")
    docs = a.join(chunking.ordered_chunks(table(spark, d, "article_chunks")), "article_id", "left")
    return frames.ctfidf(frames.topic_words(docs))


def json_salvage(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    raw = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Sure: "), F.col("props"), F.lit(" - done"))).otherwise(F.lit("no object"))
    return e.select("event_id", F.get_json_object(t.salvage_object(raw), "$.k").cast("bigint").alias("k"))


def frame_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Density clusters of the frames with a clear narrative within each topic."""
    f = _frames(spark, d).where(F.col("topic_id").isNotNull() & (F.col("status") != frames.UNCLEAR))
    return frames.cluster_frames(f, _vectors(spark, d))


def topic_model(spark: SparkSession, d: str) -> DataFrame:
    """Topics of frames by their vectors, with sizes."""
    return frames.topic_clusters(_vectors(spark, d)).groupBy("topic_id").agg(F.count("*").alias("n_frames"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_status, normalize_hash, url_normalize, validate_articles, dedup_canonical, duplicate_groups, ingest_counters, upsert_compaction, latest_incoming, integrity,
        date_range, recent_by_source, active_sources, load_documents, missing_embeddings, snapshot_counts, page_text, page_links, page_articles, archive_calendar,
        chunk_corpus, chunk_quality, token_stats, stems, bm25_top, bm25_of_domains, index_append, contains_top, query_overlap, vector_top, hybrid_top, search_chunks, search_reranked, search_articles, answer, flagship,
        frame_informative, frame_representation, cluster_support, cluster_event_like, cluster_labels, classify_margin, classify_open, period_counts, dynamics_points, dynamics_series,
        topic_keywords, topic_ctfidf, json_salvage, frame_clusters, topic_model,
    )
}
