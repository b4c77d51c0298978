"""Narrative analytics over frames: reading, rules, support, labels, classification, dynamics, topics.

A frame is one row: frame_id, article_id, topic_id, status, main_claim, the causal slots, valence,
actors, implications, confidence. First-seen ties follow frame_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as t

SLOTS = ("cause", "mechanism", "consequence", "future_expectation")
# The rules' word lists, thresholds and texts.
EVENT_WORDS = (
    "выиграл", "выиграла", "обыграл", "обыграла", "завоевал", "завоевала", "занял должность", "временно занял", "временно уехал", "воздушная тревога",
    "беспилотной опасности", "ограничения на прием и выпуск", "временные ограничения", "богослужение", "турнир", "матч", "тренер",
)
REPORT_WORDS = ("произош", "случил", "взрыв", "заявил", "сообщил", "сообщила", "прошел", "состоялся")
STATEMENT_WORDS = (
    " заявил", " заявила", " сказа", " сообщил", " сообщила", " считает", " назвал", " назвала", " обвинил", " обвинила", " призвал", " призвала",
    " отметил", " отметила", " подчеркнул", " подчеркнула", " указал", " указала", " допустил", " допустила",
)
OPERATIONAL_WORDS = (
    "воздушная тревога", "беспилотной опасности", "временные ограничения", "ограничения на прием", "ограничения на выпуск", "в аэропортах",
    "выиграл", "выиграла", "назначен", "назначена", "временно", "объявлен", "объявлена", "сняты", "сняли",
)
EVENT_LABEL_WORDS = ("заявил", "заявила", "считает", "сообщил", "сообщила", "воздушная тревога", "временные ограничения", "беспилотной опасности", "выиграл", "выиграла", "временно")
PLACEHOLDERS = ("", "...", "—", "n/a", "none", "unknown", "общая тема")
TOPIC_STOPWORDS = (
    "это", "как", "что", "или", "для", "при", "после", "между", "также", "который", "которая", "которые", "новости", "риа", "россия", "заявил",
    "сообщил", "сообщила", "сказал", "сказала", "2026", "2025",
)
UNCLEAR = "no_clear_narrative"
LEAST_SIMILARITY, LEAST_MARGIN = 0.78, 0.08
LEAST_ARTICLES, LEAST_SOURCES = 5, 1
TITLE_WORD, TITLE_NONE, SUMMARY_NONE = "нарратив", "Нарративный кластер", "Кластер объединяет близкие интерпретационные формулировки."


def frames_of_representations(embeddings: DataFrame) -> DataFrame:
    """Frames read back from their representation texts (``key: value`` lines); repeated rows are one frame."""
    text = F.coalesce("representation_text", F.lit(""))
    value = lambda k: F.nullif(F.trim(F.regexp_extract(text, rf"(?m)^{k}: (.*)$", 1)), F.lit(""))
    many = lambda k: F.filter(F.split(F.coalesce(value(k), F.lit("")), ", "), lambda x: x != "")
    one = embeddings.groupBy("frame_id").agg(F.max("representation_text").alias("representation_text"))
    return one.select(
        "frame_id", F.regexp_extract("frame_id", "^frame-([0-9]+)-", 1).cast("bigint").alias("article_id"),
        F.coalesce(value("main_claim"), F.lit("")).alias("main_claim"), *[value(s).alias(s) for s in SLOTS], value("valence").alias("valence"),
        many("actors").alias("actors"), many("implications").alias("implications"), F.when(text == "", UNCLEAR).otherwise("ok").alias("status"),
    )


def _any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def statement_like(claim: Column) -> Column:
    return _any(F.lower(claim), STATEMENT_WORDS)


def operational(claim: Column) -> Column:
    return _any(F.lower(claim), OPERATIONAL_WORDS)


def placeholder(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(*PLACEHOLDERS), F.lit(True))


def _filled(least: int) -> Column:
    return sum((F.coalesce((F.length(F.trim(F.col(s))) >= least).cast("int"), F.lit(0)) for s in SLOTS[1:]), F.coalesce((F.length(F.trim(F.col(SLOTS[0]))) >= least).cast("int"), F.lit(0)))


def informative() -> Column:
    """Whether a frame says more than that something happened; unclear ones pass."""
    claim, actors, implications = F.col("main_claim"), F.size("actors") > 0, F.size("implications") > 0
    low = F.lower(claim)
    some_slot = F.lit(False)
    for s in SLOTS:
        some_slot = some_slot | (F.coalesce(F.col(s), F.lit("")) != "")
    future = F.coalesce(F.col("future_expectation"), F.lit("")) != ""
    score = _filled(12)
    return (
        F.when(F.col("status") == UNCLEAR, True)
        .when(F.length(F.trim(claim)) < 40, False)
        .when(_any(low, EVENT_WORDS) & (_filled(16) < 3), False)
        .when(_any(low, REPORT_WORDS) & ~some_slot, False)
        .when(statement_like(claim) & ~(future & implications), False)
        .when(operational(claim) & ~((score >= 3) & implications & future), False)
        .otherwise(score + actors.cast("int") + implications.cast("int") >= 2)
    )


def representation() -> Column:
    """The frame as ``key: value`` lines, only what it has, in a fixed order."""
    line = lambda k, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}: "), v))
    listed = lambda k: line(k, F.array_join(k, ", "))
    return F.concat_ws("\n", F.concat(F.lit("main_claim: "), F.col("main_claim")), *[line(s, F.col(s)) for s in SLOTS], listed("implications"), listed("actors"), line("valence", F.col("valence")))


def compact_representation(most: int = 1200) -> Column:
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    listed = lambda c: full(F.array_join(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != ""), ", "))
    return F.trim(F.substring(t.squeeze(F.concat_ws(" | ", full(F.col("main_claim")), *[full(F.col(s)) for s in SLOTS], listed("implications"), listed("actors"))), 1, most))


def support(members: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(cluster_id, n_frames, article_support, source_support) of (cluster_id, frame_id, article_id)."""
    a = articles.select(F.col("id").alias("article_id"), "source_id")
    s = sources.select(F.col("id").alias("source_id"), "domain")
    joined = members.join(a, "article_id", "left").join(F.broadcast(s), "source_id", "left")
    return joined.groupBy("cluster_id").agg(F.count("*").alias("n_frames"), F.count_distinct("article_id").alias("article_support"), F.count_distinct(F.nullif(F.col("domain"), F.lit(""))).alias("source_support"))


def event_like(members: DataFrame) -> DataFrame:
    """(cluster_id, statement_ratio, operational_ratio, broad_ratio, event_like) of frames with a cluster_id."""
    told = F.trim("main_claim") != ""
    ratio = lambda c: F.coalesce(F.avg(F.when(told, c.cast("double"))), F.lit(1.0))
    broad = (F.size("implications") > 0) & (F.coalesce(F.col("future_expectation"), F.lit("")) != "") & ~placeholder(F.col("future_expectation"))
    r = members.groupBy("cluster_id").agg(F.round(ratio(statement_like(F.col("main_claim"))), 6).alias("statement_ratio"), F.round(ratio(operational(F.col("main_claim"))), 6).alias("operational_ratio"),
                                          F.round(F.avg(F.coalesce(broad, F.lit(False)).cast("double")), 6).alias("broad_ratio"), F.count_if(told).alias("told"))
    kind = (F.col("told") == 0) | (((F.col("statement_ratio") >= 0.7) | (F.col("operational_ratio") >= 0.7)) & (F.col("broad_ratio") < 0.35))
    return r.select("cluster_id", "statement_ratio", "operational_ratio", "broad_ratio", kind.alias("event_like"))


def _distinct_values(c: Column) -> Column:
    """Trimmed values that are no placeholders, each once, in order."""
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: ~F.coalesce(F.lower(x).isin(*PLACEHOLDERS), F.lit(True))))


def _capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1_000_000)))


def labels(members: DataFrame, first: int = 5) -> DataFrame:
    """A label per cluster from its first frames, without a model."""
    few = members.withColumn("pos", F.row_number().over(W.partitionBy("cluster_id").orderBy("frame_id"))).where(F.col("pos") <= first)
    item = F.struct("pos", "main_claim", *SLOTS, "valence", "actors", "implications")
    g = few.groupBy("cluster_id").agg(F.array_sort(F.collect_list(item)).alias("f"))  # at most ``first`` each
    col = lambda k: F.transform("f", lambda x: x[k])
    claims = F.filter(col("main_claim"), lambda x: F.trim(x) != "")
    actors, implications = _distinct_values(F.flatten(col("actors"))), _distinct_values(F.flatten(col("implications")))
    canonical = F.coalesce(F.get(claims, F.lit(0)), F.lit("No canonical claim"))
    head = lambda a: F.get(a, F.lit(0))
    title = (
        F.when((F.size(implications) > 0) & (F.size(actors) > 0), F.concat(_capital(head(implications)), F.lit(f" {TITLE_WORD}: "), head(actors)))
        .when(F.size(implications) > 0, F.concat(_capital(head(implications)), F.lit(f" {TITLE_WORD}"))).when(F.size(actors) > 0, F.substring(head(actors), 1, 96))
        .when(~placeholder(canonical), F.substring(canonical, 1, 96)).otherwise(TITLE_NONE)
    )
    examples = _distinct_values(claims)
    chain = F.filter(F.array(*[head(_distinct_values(F.filter(col(s), lambda x: x.isNotNull()))) for s in SLOTS[:3]]), lambda x: x.isNotNull())
    tones = F.filter(col("valence"), lambda x: ~placeholder(x))
    counted = F.transform(F.array_distinct(tones), lambda v: F.struct((-F.size(F.filter(tones, lambda x: x == v))).alias("n"), F.array_position(tones, v).alias("p"), v.alias("v")))
    return g.select(
        "cluster_id", title.alias("title"), F.when(~placeholder(canonical), canonical).otherwise(F.coalesce(head(examples), F.lit(SUMMARY_NONE))).alias("summary"), canonical.alias("canonical_claim"),
        F.slice(F.array_distinct(F.filter(F.flatten(col("actors")), lambda x: x != "")), 1, 6).alias("key_actors"), chain.alias("causal_chain"),
        F.get(F.transform(F.array_sort(counted), lambda x: x["v"]), F.lit(0)).alias("dominant_tone"), F.slice(examples, 1, 3).alias("examples"),
    )


def event_label(label: Column) -> Column:
    return F.coalesce(F.trim(label) == "", F.lit(True)) | _any(F.lower(label), EVENT_LABEL_WORDS)


def centroids(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """(cluster_id, topic_id, centroid): the vector of the first frame of each cluster."""
    first = members.groupBy("cluster_id", "topic_id").agg(F.min("frame_id").alias("frame_id"))
    return first.join(vectors.select("frame_id", F.col("vector").alias("centroid")), "frame_id").select("cluster_id", "topic_id", "centroid")


def _centre_parts(centres: DataFrame, most: int) -> Iterator[pd.DataFrame]:
    """The centroids in parts of at most ``most`` rows, one part on the driver at a time by its iterator's pages."""
    held: list = []
    for r in centres.select("cluster_id", "topic_id", "centroid").toLocalIterator():
        held.append((r["cluster_id"], r["topic_id"], np.asarray(r["centroid"], dtype=np.float64)))
        if len(held) == most:
            yield pd.DataFrame(held, columns=["cluster_id", "topic_id", "centroid"])
            held = []
    if held:
        yield pd.DataFrame(held, columns=["cluster_id", "topic_id", "centroid"])


def _two_best(vectors: DataFrame, part) -> DataFrame:
    """(frame_id, sim, cluster_id) of the two best centroids of a broadcast part for every frame: a product of blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = part.value
        sizes = c["centroid"].map(len).to_numpy()
        for pdf in batches:
            for lo in range(0, len(pdf), 1024):
                rows = pdf.iloc[lo : lo + 1024]
                for n, some in rows.groupby(rows["vector"].map(len)):
                    of = c[sizes == n]
                    if not len(of) or not n:
                        continue
                    x, y = np.stack(some["vector"].to_numpy()).astype(np.float64), np.stack(of["centroid"].to_numpy())
                    norm = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None]
                    sim = np.divide(x @ y.T, norm, out=np.zeros(norm.shape), where=norm > 0).round(6)
                    mine, theirs = some["topic_id"].to_numpy(object), of["topic_id"].to_numpy(object)
                    free = pd.isna(theirs)[None] | pd.isna(mine)[:, None]
                    ids = of["cluster_id"].to_numpy(object)
                    sim = np.where(free | (np.where(pd.isna(mine), "", mine)[:, None] == np.where(pd.isna(theirs), "", theirs)[None]), sim, -np.inf)
                    by = np.argsort(ids, kind="stable")[::-1]  # ties go to the larger id
                    top = by[np.argsort(-sim[:, by], axis=1, kind="stable")[:, :2]]
                    for k in range(top.shape[1]):
                        s = sim[np.arange(len(some)), top[:, k]]
                        good = s > -np.inf
                        yield pd.DataFrame({"frame_id": some["frame_id"].to_numpy()[good], "sim": s[good], "cluster_id": ids[top[good, k]]})

    return vectors.mapInPandas(run, "frame_id string, sim double, cluster_id string")


def classify(frames: DataFrame, vectors: DataFrame, centres: DataFrame, least: float = LEAST_SIMILARITY, margin: float = LEAST_MARGIN, part_rows: int = 20_000) -> DataFrame:
    """(frame_id, article_id, cluster_id, similarity, assigned, reason): best centroid by cosine and its lead.

    A frame meets the centroids of its topic and those without one, a frame without a topic all of them.
    Centroids are broadcast in parts of at most ``part_rows``; each part gives a frame's two best, so
    that nothing but these is shuffled.
    """
    f = frames.select("frame_id", "article_id", "topic_id").join(vectors.select("frame_id", "vector"), "frame_id", "left")
    asked = f.where("vector is not null").select("frame_id", "topic_id", "vector")
    met = None
    for part in _centre_parts(centres, part_rows):
        found = _two_best(asked, frames.sparkSession.sparkContext.broadcast(part))
        met = found if met is None else met.unionByName(found)
    if met is None:
        met = asked.select("frame_id", F.lit(0.0).alias("sim"), F.lit("").alias("cluster_id")).limit(0)
    ranked = met.withColumn("k", F.row_number().over(W.partitionBy("frame_id").orderBy(F.desc("sim"), F.desc("cluster_id")))).where("k <= 2")
    top = ranked.groupBy("frame_id").agg(F.max(F.when(F.col("k") == 1, F.struct("sim", "cluster_id"))).alias("best"), F.max(F.when(F.col("k") == 2, F.col("sim"))).alias("second"))
    out = f.select("frame_id", "article_id", F.col("vector").isNull().alias("missing")).join(top, "frame_id", "left")
    lead = F.round(F.col("best.sim") - F.coalesce("second", F.lit(-1.0)), 6)
    yes = F.coalesce((F.col("best.sim") >= least) & (lead >= margin), F.lit(False)) & ~F.col("missing")
    return out.select(
        "frame_id", "article_id", F.when(yes, F.col("best.cluster_id")).alias("cluster_id"), F.greatest(F.coalesce(F.col("best.sim"), F.lit(0.0)), F.lit(0.0)).alias("similarity"), yes.alias("assigned"),
        F.when(F.col("missing"), "missing_embedding").when(yes, "embedding_similarity").otherwise("unknown_or_ambiguous").alias("reason"),
    )


def dynamics_points(assigned: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Per cluster and calendar month: articles, share of the month's articles, sources per article, mean confidence.

    assigned has (cluster_id, article_id, frame_id, confidence) and counts only assigned frames.
    """
    dated = articles.select(F.col("id").alias("article_id"), "source_id", t.period(F.col("published_at")).alias("period")).where(F.col("period").rlike("^[0-9]{6}$"))
    month = dated.groupBy("period").agg(F.count("*").alias("corpus"))
    s = sources.select(F.col("id").alias("source_id"), "domain")
    joined = assigned.join(dated, "article_id").join(F.broadcast(s), "source_id", "left")
    g = joined.groupBy("cluster_id", "period").agg(F.count_distinct("article_id").alias("article_count"), F.count_distinct("domain").alias("domains"), F.round(F.avg("confidence"), 6).alias("mean_intensity"))
    share = F.round(F.col("article_count") / F.col("corpus"), 6)
    return g.join(month, "period").select(
        "cluster_id", F.concat("period", F.lit("01")).alias("period_start"), F.concat("period", F.lit("31")).alias("period_end"), "article_count", share.alias("share_of_corpus"),
        F.round(F.col("domains") / F.greatest("article_count", F.lit(1)), 6).alias("source_diversity"), "mean_intensity", share.alias("burst_score"),
    )


def dynamics_series(points: DataFrame, assigned: DataFrame) -> DataFrame:
    """Per cluster: months, articles in all, growth from the first to the last month, stability."""
    w = W.partitionBy("cluster_id").orderBy("period_start")
    p = points.withColumn("step", F.abs(F.col("article_count") - F.lag("article_count").over(w)))
    g = p.groupBy("cluster_id").agg(F.count("*").alias("n_points"), F.min_by("article_count", "period_start").alias("first"), F.max_by("article_count", "period_start").alias("last"), F.sum("step").alias("steps"))
    total = assigned.groupBy("cluster_id").agg(F.count_distinct("article_id").alias("total_articles"))
    several = F.col("n_points") >= 2
    return total.join(g, "cluster_id", "left").select(
        "cluster_id", F.coalesce("n_points", F.lit(0)).alias("n_points"), "total_articles",
        F.when(several & (F.col("first") > 0), F.round((F.col("last") - F.col("first")) / F.col("first"), 6)).alias("growth_rate"),
        F.when(several, F.round(1 / (1 + F.coalesce("steps", F.lit(0))), 6)).alias("stability_score"),
    )


def topic_tokens(c: Column, most: int = 220) -> Column:
    """The words of a text that may name a topic: Cyrillic ones of three letters on, without stopwords."""
    low = F.lower(F.coalesce(c, F.lit("")))
    # Marks and joiners are no word signs in the rule, but are for (?U)\w; other numbers (²) the other way round.
    for p in (r"(?U)https?://\S+", r"[\p{M}\p{Pc}\u200C\u200D&&[^_]]", r"(?U)\b\d{8,}\b", r"(?U)\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b", r"(?U)\b\d+\b", r"(?U)\b[a-z]{1,4}\d+[a-z0-9-]*\b", r"(?U)\b[a-z0-9_-]+\b", r"(?U)[^\w\s\-\p{N}]"):
        low = F.regexp_replace(low, p, " ")
    words = F.split(F.trim(F.regexp_replace(low, r"(?U)\s+", " ")), " ")
    return F.slice(F.filter(words, lambda x: (F.length(x) >= 3) & ~x.isin(*TOPIC_STOPWORDS) & ~x.rlike("^[a-z0-9_-]+$")), 1, most)


def topic_words(docs: DataFrame, chunks: int = 4, least: int = 160) -> DataFrame:
    """docs (title, subtitle, body_text, chunk_texts) with words: the topic text of a document, word by word.

    Title, subtitle and the first chunks (the whole body where there are none) go through topic_tokens
    one by one; where they join to less than ``least`` signs, the whole body takes their place.
    """
    texts = F.coalesce("chunk_texts", F.array().cast("array<string>"))
    parts = F.concat(F.array("title", "subtitle"), F.when(F.size(texts) > 0, F.slice(texts, 1, chunks)).otherwise(F.array("body_text")))
    told = docs.withColumn("__parts", F.filter(F.transform(parts, lambda x: topic_tokens(x)), lambda x: F.size(x) > 0))
    merged = F.array_join(F.transform("__parts", lambda x: F.array_join(x, " ")), "\n\n")
    return told.withColumn("words", F.when(F.length(merged) < least, topic_tokens(F.col("body_text"))).otherwise(F.flatten("__parts"))).drop("__parts")


def topic_text(title: Column, subtitle: Column, body: Column, chunks: Column, most: int = 4, least: int = 160) -> Column:
    """A document's topic text: title, subtitle and first chunks (else the body), each by its topic words; the body's alone if that is short."""
    told = lambda c: F.array_join(topic_tokens(c), " ")
    parts = F.concat(F.array(told(title), told(subtitle)), F.when(F.size(chunks) > 0, F.transform(F.slice(chunks, 1, most), told)).otherwise(F.array(told(body))))
    merged = F.array_join(F.filter(parts, lambda x: x != ""), "\n\n")
    return F.when(F.length(merged) < least, told(body)).otherwise(merged)


def clean_keywords(words: Column, most: int = 8) -> Column:
    """Keywords by their first topic word, of three letters on, each once, at most so many."""
    first = F.transform(words, lambda x: F.get(topic_tokens(x), F.lit(0)))
    return F.slice(F.array_distinct(F.filter(first, lambda x: F.coalesce(F.length(x) >= 3, F.lit(False)))), 1, most)


def topic_label(keywords: Column, topic: Column) -> Column:
    """The first three keywords, or the topic's own name if there are none."""
    return F.when(F.size(keywords) > 0, F.array_join(F.slice(keywords, 1, 3), " / ")).otherwise(F.concat(F.lit("topic "), topic.cast("string")))


def article_topics(listed: DataFrame) -> DataFrame:
    """(article_id, topic_id) of (topic_no, topic_id, article_id): the first topic that lists an article."""
    return listed.groupBy("article_id").agg(F.min(F.struct("topic_no", "topic_id")).alias("t")).select("article_id", "t.topic_id")


def dominant(rows: DataFrame, key: str, value: str, place: str) -> DataFrame:
    """(key, value, n): the most frequent value per key, of equal ones that with the first place."""
    n = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(place).alias("first"))
    best = n.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), "first", value)).alias("b"))
    return best.select(key, F.col(f"b.{value}").alias(value), (-F.col("b.m")).alias("n"))


_CODED = ("frame_id", "article_id", "status", "main_claim", *SLOTS, "valence", "actors", "implications")


def to_json() -> Column:
    """A frame as one JSON text."""
    return F.to_json(F.struct(*_CODED))


def of_json(c: Column) -> Column:
    """The frame in a JSON text; lists and texts that are missing are null."""
    kinds = {"article_id": "bigint", "actors": "array<string>", "implications": "array<string>"}
    return F.from_json(c, ", ".join(f"{k} {kinds.get(k, 'string')}" for k in _CODED))


def topic_keywords(docs: DataFrame, most: int = 8) -> DataFrame:
    """(topic_id, keywords): the most frequent words of four letters on over (topic_id, doc_id, text); ties go to the smaller word."""
    words = docs.select("topic_id", F.explode(topic_tokens(F.col("text"))).alias("word")).where(F.length("word") >= 4)
    n = words.groupBy("topic_id", "word").agg(F.count("*").alias("n"))
    ranked = n.withColumn("r", F.row_number().over(W.partitionBy("topic_id").orderBy(F.desc("n"), "word"))).where(F.col("r") <= most)
    return ranked.groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]).alias("keywords"))


def ctfidf(docs: DataFrame, most: int = 8) -> DataFrame:
    """(topic_id, word, score, rank) by class-based tf-idf over (topic_id, words): tf * log(1 + A / f)."""
    words = docs.select("topic_id", F.explode("words").alias("word"))
    tf = words.groupBy("topic_id", "word").agg(F.count("*").alias("tf"))
    size = tf.groupBy("topic_id").agg(F.sum("tf").alias("size"))
    mean = size.agg(F.avg("size")).scalar()
    total = tf.groupBy("word").agg(F.sum("tf").alias("f"))
    scored = tf.join(total, "word").join(F.broadcast(size), "topic_id").select("topic_id", "word", F.round(F.col("tf") / F.col("size") * F.log(1 + mean / F.col("f")), 6).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("topic_id").orderBy(F.desc("score"), "word")))
    return ranked.where(F.col("rank") <= most)


# Density clustering: one group per task; the mutual-reachability tree of a group is quadratic in the
# group, which the caller bounds by its topics.

def _tree(x: np.ndarray, least: int) -> list[tuple[float, int, int]]:
    """Edges of the minimum spanning tree over mutual reachability, shortest first (Prim, one row at a time)."""
    n = len(x)
    core = np.empty(n)
    for i in range(n):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        core[i] = np.partition(d, min(least, n) - 1)[min(least, n) - 1]
    best, frm, done = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool)
    at, out = 0, []
    for _ in range(n - 1):
        done[at] = True
        reach = np.maximum(np.maximum(np.sqrt(((x - x[at]) ** 2).sum(1)), core), core[at])
        nearer = ~done & (reach < best)
        best[nearer], frm[nearer] = reach[nearer], at
        at = int(np.argmin(np.where(done, np.inf, best)))
        out.append((float(best[at]), int(frm[at]), at))
    return sorted(out)


def hdbscan(x: np.ndarray, least: int = 3) -> np.ndarray:
    """Cluster numbers by excess of mass, -1 for noise."""
    n = len(x)
    if n < max(2, least):
        return np.full(n, -1)
    parent, node, kids, size = list(range(n)), list(range(n)), {}, [1] * n

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    height = [0.0] * n
    for d, a, b in _tree(x, least):
        a, b = root(a), root(b)
        new = len(size)
        kids[new] = (node[a], node[b])
        size.append(size[node[a]] + size[node[b]])
        height.append(d)
        parent[b] = a
        node[a] = new
    top = len(size) - 1

    def leaves(v: int) -> list[int]:
        out, todo = [], [v]
        while todo:
            u = todo.pop()
            if u < n:
                out.append(u)
            else:
                todo += kids[u]
        return out

    # Condensed tree: a cluster lives from its birth until it splits into two of at least ``least`` points.
    clusters: list[dict] = []
    todo = [(top, None, 0.0)]
    while todo:
        v, up, birth = todo.pop()
        me = len(clusters)
        clusters.append({"birth": birth, "mass": 0.0, "up": up, "down": [], "node": v})
        if up is not None:
            clusters[up]["down"].append(me)
        cur = v
        while cur >= n:
            lam = 1 / height[cur] if height[cur] > 0 else 1e12
            a, b = kids[cur]
            if size[a] >= least and size[b] >= least:
                clusters[me]["mass"] += (lam - birth) * size[cur]
                todo += [(a, me, lam), (b, me, lam)]
                break
            big, small = (a, b) if size[a] >= size[b] else (b, a)
            clusters[me]["mass"] += (lam - birth) * size[small]
            if size[big] < least:
                clusters[me]["mass"] += (lam - birth) * size[big]
                break
            cur = big
    chosen, value = set(), [0.0] * len(clusters)
    for i in range(len(clusters) - 1, -1, -1):
        below = sum(value[k] for k in clusters[i]["down"])
        if i and clusters[i]["mass"] >= below or not clusters[i]["down"] and i:
            value[i] = clusters[i]["mass"]
            gone = list(clusters[i]["down"])
            while gone:
                k = gone.pop()
                chosen.discard(k)
                gone += clusters[k]["down"]
            chosen.add(i)
        else:
            value[i] = below
    out = np.full(n, -1)
    for number, i in enumerate(sorted(chosen)):
        out[leaves(clusters[i]["node"])] = number
    return out


def cluster_frames(frames: DataFrame, vectors: DataFrame, least: int = 3) -> DataFrame:
    """(topic_id, frame_id, article_id, local_cluster) by density within each topic; noise is left out.

    frames are the eligible ones. A topic is one task's work, as every point of it bears on the
    others; topics of more than a task can hold are to be parted further before.
    """
    rows = frames.select("topic_id", "frame_id", "article_id").join(vectors.select("frame_id", "vector"), "frame_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_id")
        x = np.stack(pdf["vector"].to_numpy()).astype(float)
        pdf = pdf.assign(local_cluster=hdbscan(x, least))
        return pdf.loc[pdf["local_cluster"] >= 0, ["topic_id", "frame_id", "article_id", "local_cluster"]]

    return rows.groupBy("topic_id").applyInPandas(run, "topic_id string, frame_id string, article_id bigint, local_cluster int")


def topic_clusters(docs: DataFrame, vector: str = "vector", k: int = 12, seed: int = 7) -> DataFrame:
    """Topics by spherical k-means over document vectors: the distributed stand-in for a stochastic topic model.

    The centres start from a bounded sample and are refined by a fixed number of rounds of partial sums.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    some = docs.where(F.exists(F.col(vector), lambda x: x != 0))  # the cosine of a zero vector is not defined
    rows = some.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=k, seed=seed, distanceMeasure="cosine", maxIter=10, initMode="random").fit(rows)
    return model.transform(rows).drop("features").withColumn("topic_id", F.concat(F.lit("topic-"), F.col("prediction").cast("string"))).drop("prediction")


