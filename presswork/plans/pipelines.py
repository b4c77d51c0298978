"""Composed runs: pages to stored articles and chunks, and articles to narrative tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.providers import Embedder, HashEmbedder
from ..operators import chunking, frames, ingest, store
from ..runtime import written
from ..sources import discovery


@dataclass(frozen=True)
class AnalysisConfig:
    """Thresholds of the narrative run."""

    least_similarity: float = frames.LEAST_SIMILARITY
    least_margin: float = frames.LEAST_MARGIN
    least_articles: int = frames.LEAST_ARTICLES
    least_sources: int = frames.LEAST_SOURCES
    least_cluster: int = 3
    frames_per_article: int = 3


def ingest_pages(pages: DataFrame, stored: DataFrame) -> dict[str, DataFrame]:
    """Landed pages (id, source_id, url, html, site) to new articles, their chunks, and the run's counters."""
    parsed = written(discovery.parse_pages(pages), "parsed")
    status = written(ingest.ingest(parsed, stored), "status")
    saved = ingest.normalise(parsed).join(status.where("status = 'saved'").select("id"), "id", "left_semi").withColumns({"is_canonical": F.lit(True), "duplicate_group_id": F.lit(None).cast("string")})
    repeats = ingest.duplicates_of(ingest.normalise(parsed), ingest.normalise(stored)).join(status.where("status like 'skipped_%'").select("id"), "id", "left_semi")
    return {"articles": saved, "chunks": chunking.chunk_articles(saved), "duplicates": repeats.withColumns({"is_primary": F.lit(True), "similarity_score": F.lit(1.0)}), "counters": ingest.counters(status)}


def embed_missing(chunks: DataFrame, held: DataFrame, embedder: Embedder | None = None, limit: int | None = None) -> DataFrame:
    """(chunk_id, model_name, embedding, dimension) of chunks that have none of the model yet."""
    e = embedder or HashEmbedder()
    lacking = chunks.join(held.where(F.col("model_name") == e.name).select("chunk_id"), "chunk_id", "left_anti")
    lacking = lacking.orderBy("chunk_id").limit(limit) if limit else lacking
    out = lacking.select("chunk_id", F.lit(e.name).alias("model_name"), e.embed(F.col("chunk_text")).alias("embedding"))
    return out.withColumn("dimension", F.size("embedding")).where("dimension > 0")


def analyse(frame_rows: DataFrame, vectors: DataFrame, articles: DataFrame, sources: DataFrame, config: AnalysisConfig | None = None) -> dict[str, DataFrame]:
    """Frames to clusters, labels, assignments and monthly dynamics.

    frame_rows have a topic_id; frames without one never form a cluster. Cluster numbers follow the
    order of topics and of clusters within them.
    """
    c = config or AnalysisConfig()
    eligible = frame_rows.where((F.col("status") != frames.UNCLEAR) & frames.informative() & F.col("topic_id").isNotNull())
    local = written(frames.cluster_frames(eligible, vectors, c.least_cluster), "local-clusters")
    named = local.select("frame_id", F.concat_ws("/", "topic_id", F.col("local_cluster").cast("string")).alias("cluster_id"))
    members = eligible.join(named, "frame_id")
    enough = frames.support(members, articles, sources).where((F.col("article_support") >= c.least_articles) & (F.col("source_support") >= c.least_sources))
    kept = enough.join(frames.event_like(members).where("not event_like").select("cluster_id"), "cluster_id")
    members = written(members.join(kept.select("cluster_id"), "cluster_id", "left_semi"), "members")
    assigned = written(frames.classify(frame_rows, vectors, frames.centroids(members, vectors), c.least_similarity, c.least_margin), "assigned")
    dated = assigned.where("assigned").join(frame_rows.select("frame_id", "confidence"), "frame_id")
    points = frames.dynamics_points(dated, articles, sources)
    return {"clusters": kept, "members": members, "labels": frames.labels(members), "assignments": assigned, "dynamics_points": points, "dynamics": frames.dynamics_series(points, dated)}


def strong_clusters(run: dict[str, DataFrame], most: int = 20) -> DataFrame:
    """The view of clusters worth showing: enough support, no event-like label, most assigned first."""
    n = run["assignments"].where("assigned").groupBy("cluster_id").agg(F.count("*").alias("n_assigned"))
    told = run["labels"].select("cluster_id", "title", F.concat_ws(" ", "title", "summary", "canonical_claim").alias("told"))
    rows = run["clusters"].join(n, "cluster_id", "left").join(told, "cluster_id", "left").withColumn("n_assigned", F.coalesce("n_assigned", F.lit(0)))
    good = rows.where((F.greatest("n_assigned", "article_support") >= 3) & ~frames.event_label(F.col("told")))
    return good.select("cluster_id", "title", "n_assigned", "article_support", "source_support", F.when(F.col("n_assigned") > 0, F.col("n_assigned")).otherwise(F.col("n_frames")).alias("shown")).orderBy(F.desc("shown"), "cluster_id").limit(most).drop("shown")


def new_analyses(articles: DataFrame, cached: DataFrame, force: bool = False) -> DataFrame:
    """Articles without a cached analysis (all of them if forced)."""
    return articles if force else articles.join(cached.select(F.col("article_id").alias("id")), "id", "left_anti")


def embed_representations(frame_rows: DataFrame, embed: Callable[[str], list[float]], model: str) -> DataFrame:
    """(frame_id, representation_text, vector, model_name, status) of frames: by their whole text, else by the compact one.

    embed may raise: the frame is then tried with its compact text, and is ``skipped`` if that fails too.
    It runs in the executors, batch by batch.
    """
    texts = frame_rows.select("frame_id", frames.representation().alias("whole"), frames.compact_representation().alias("compact"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for frame, whole, compact in pdf.itertuples(index=False):
                found = (frame, None, None, model, "skipped")
                for text, status in ((whole, "whole"), (compact, "compact")):
                    try:
                        vector = [float(x) for x in embed(text)]
                    except Exception:  # whatever a provider raises
                        continue
                    if vector:
                        found = (frame, text, vector, model, status)
                        break
                out.append(found)
            yield pd.DataFrame(out, columns=["frame_id", "representation_text", "vector", "model_name", "status"])

    return texts.mapInPandas(run, "frame_id string, representation_text string, vector array<double>, model_name string, status string")


def materialised(articles: DataFrame, cached: DataFrame, found: DataFrame, force: bool = False) -> DataFrame:
    """One row of what a cached run does: articles in all, processed and reused ones, frames of the processed."""
    fresh = new_analyses(articles, cached, force).select("id")
    n = articles.agg(F.count("*").alias("total_articles"))
    p = fresh.agg(F.count("*").alias("processed_articles"))
    f = found.join(fresh.withColumnRenamed("id", "article_id"), "article_id", "left_semi").agg(F.count("*").alias("n_frames"))
    one = lambda df: F.broadcast(df.withColumn("one", F.lit(1)))
    out = one(n).join(one(p), "one").join(one(f), "one")  # single rows
    return out.select("total_articles", "processed_articles", (F.col("total_articles") - F.col("processed_articles")).alias("reused_articles"), "n_frames")


def cached_frames(cache: DataFrame, topics: DataFrame, date_from: str | None, date_to: str | None, domains: list[str] | None = None) -> DataFrame:
    """Frames of cached analyses (article_id, source_domain, published_at, payload_json) in range: their own topic, else their article's.

    payload_json is an array of frames' JSON; topics are (article_id, topic_id).
    """
    at, low, high = t.compact(F.col("published_at")), t.bound(date_from), t.bound(date_to)
    rows = cache.where((at >= low if low else F.lit(True)) & (at <= high if high else F.lit(True)))
    rows = rows.where(F.col("source_domain").isin(*domains)) if domains else rows
    listed = rows.select("article_id", F.explode(F.from_json("payload_json", "array<string>")).alias("j"))
    told = listed.select(frames.of_json(F.col("j")).alias("f"), F.get_json_object("j", "$.topic_id").alias("own"))
    mine = told.select("f.*", "own").join(topics.select("article_id", F.col("topic_id").alias("theirs")), "article_id", "left")
    return mine.withColumn("topic_id", F.coalesce("own", "theirs")).drop("own", "theirs")


def cached_run(cache: DataFrame, topics: DataFrame, vectors: DataFrame, articles: DataFrame, sources: DataFrame, date_from: str | None, date_to: str | None, domains: list[str] | None = None, config: AnalysisConfig | None = None) -> dict[str, DataFrame]:
    """A narrative run over cached frames: clusters, labels, assignments and dynamics."""
    found = cached_frames(cache, topics, date_from, date_to, domains).withColumn("confidence", F.lit(None).cast("double"))
    return analyse(found, vectors, articles, sources, config)


def dynamics_view(series: DataFrame, most: int = 12) -> DataFrame:
    """The first clusters by articles, with figures of three digits."""
    top = series.orderBy(F.desc("total_articles"), "cluster_id").limit(most)
    return top.select("cluster_id", "n_points", "total_articles", F.round("growth_rate", 3).alias("growth_rate"), F.round("stability_score", 3).alias("stability_score"))


def assignment_counts(assignments: DataFrame, frame_rows: DataFrame) -> DataFrame:
    """(cluster_id, n_assigned, n_unclear): assigned frames by cluster, and the frames without a clear narrative in all."""
    unclear = frame_rows.agg(F.count_if(F.col("status") == frames.UNCLEAR)).scalar()
    return assignments.where("assigned").groupBy("cluster_id").agg(F.count("*").alias("n_assigned")).withColumn("n_unclear", unclear)


def evaluation(run: dict[str, DataFrame]) -> DataFrame:
    """Counts of a run; quality scores are left null, as nothing to hold them against is given."""
    counts = [df.agg(F.lit(k).alias("measure"), F.count("*").cast("double").alias("value")) for k, df in run.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def frames_from_answers(answers: DataFrame, most: int = 3) -> DataFrame:
    """Frames of a text model's answers (article_id, title, answer): the first few of each, else one unclear frame.

    The answer is a JSON object with a list ``frames``; lists may be given as one text, texts may be blank.
    """
    item = "main_claim string, cause string, mechanism string, consequence string, future_expectation string, valence string, actors string, implications string, confidence double"
    listed = F.from_json(F.get_json_object(t.salvage_object(F.col("answer")), "$.frames"), f"array<struct<{item.replace(' string', ':string').replace(' double', ':double')}>>")
    some = F.slice(F.filter(listed, lambda x: F.trim(F.coalesce(x["main_claim"], F.lit(""))) != ""), 1, most)
    rows = answers.select("article_id", "title", F.posexplode_outer(F.when(F.size(some) > 0, some)).alias("i", "f"))
    many = lambda c: F.filter(F.transform(F.coalesce(F.from_json(c, "array<string>"), F.array(c)), lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False)))
    found = F.col("f").isNotNull()
    return rows.select(
        F.concat(F.lit("frame-"), F.col("article_id").cast("string"), F.lit("-"), (F.coalesce("i", F.lit(0)) + 1).cast("string")).alias("frame_id"), "article_id",
        F.when(found, "ok").otherwise(frames.UNCLEAR).alias("status"), F.when(found, F.trim("f.main_claim")).otherwise(F.coalesce("title", F.lit(""))).alias("main_claim"),
        *[F.nullif(F.trim(F.col(f"f.{s}")), F.lit("")).alias(s) for s in (*frames.SLOTS, "valence")], many(F.col("f.actors")).alias("actors"), many(F.col("f.implications")).alias("implications"), F.col("f.confidence").alias("confidence"),
    )


def saved_run(run: dict[str, DataFrame], folder: str, domains: list[str] | None, date_from: str | None, date_to: str | None) -> DataFrame:
    """Write a run's tables into the folder, and give its snapshot row."""
    for name, df in run.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return store.snapshot({k: run[k] for k in ("clusters", "assignments", "dynamics")}, domains, date_from, date_to)
