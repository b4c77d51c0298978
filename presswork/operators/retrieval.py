"""Hybrid retrieval: prefix BM25, cosine search, fusion, staged re-ranking, topical filter.

The index is a postings table (token, chunk, tf) with lengths; a query is analysed on the driver and
becomes literals of one plan. Scores are rounded where they are ordered, so that sums taken in
another order rank alike; ties follow the stated keys down to the chunk id.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as t
from ..functions.providers import Reranker, TextModel, generate_object

# BM25 constants, fusion weights, candidate limits.
K1, B, FLOOR = 1.2, 0.75, 1e-6
HYBRID_LIMIT, RERANK_LIMIT, PER_ARTICLE, SOURCE_ARTICLES = 24, 8, 2, 5
INDEX_TOKEN = r"[\p{L}\p{N}]+"


def search_rows(chunks: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks with title, date, canonical flag and domain: what every search reads; repeats of a chunk id count once."""
    a = articles.select(F.col("id").alias("article_id"), F.col("title").alias("article_title"), "published_at", "is_canonical", F.col("source_id").alias("sid"))
    s = sources.select(F.col("id").alias("sid"), F.col("domain").alias("source_domain"))
    c = chunks.select(F.col("id").alias("chunk_id"), "article_id", "chunk_index", "chunk_text").dropDuplicates(["chunk_id"])
    return c.join(a, "article_id").join(F.broadcast(s), "sid").drop("sid")


def in_scope(rows: DataFrame, date_from: str | None, date_to: str | None, domains: list[str] | None = None, canonical: bool = True) -> DataFrame:
    """Rows of canonical articles in the date range (inclusive, on the sortable form) and of the domains; none given means all."""
    at, low, high = t.compact(F.col("published_at")), t.bound(date_from), t.bound(date_to)
    keep = F.lit(True)
    if low:
        keep &= at >= low
    if high:
        keep &= at <= high
    if canonical:
        keep &= F.col("is_canonical")
    if domains:
        keep &= F.col("source_domain").isin(*domains)
    return rows.where(keep)


def postings(rows: DataFrame) -> DataFrame:
    """(token, chunk_id, tf) over text and title."""
    both = F.regexp_extract_all(F.lower(F.concat_ws(" ", "article_title", "chunk_text")), F.lit(INDEX_TOKEN), F.lit(0))
    return rows.select("chunk_id", F.explode(both).alias("token")).groupBy("token", "chunk_id").agg(F.count("*").alias("tf"))


def lengths(post: DataFrame) -> DataFrame:
    return post.groupBy("chunk_id").agg(F.sum("tf").alias("doc_len"))


def _with_prefix(prefix: str) -> Column:
    return F.size(F.filter("tokens", lambda x: x.startswith(prefix)))


def bm25(rows: DataFrame, prefixes: list[str]) -> DataFrame:
    """(chunk_id, bm25), smaller is better, for chunks that hold a token with one of the prefixes.

    Statistics are those of all rows. The prefixes are few and become an array literal, so that no
    join is needed to find them; the counts travel, the texts do not.
    """
    both = F.regexp_extract_all(F.lower(F.concat_ws(" ", "article_title", "chunk_text")), F.lit(INDEX_TOKEN), F.lit(0))
    listed = rows.select("chunk_id", both.alias("tokens")).select(
        "chunk_id", F.size("tokens").alias("doc_len"),
        *[_with_prefix(p).alias(f"f{i}") for i, p in enumerate(prefixes)],
    )
    stats = listed.agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_len"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(prefixes))])
    score = F.lit(0.0)
    for i in range(len(prefixes)):
        f = F.col(f"f{i}")
        idf = F.log((F.col("n_docs") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        idf = F.when(idf <= 0, FLOOR).otherwise(idf)
        score = score - F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len")))).otherwise(0.0)
    some = F.expr(" + ".join(f"f{i}" for i in range(len(prefixes))) or "0") > 0
    one = F.broadcast(stats.withColumn("one", F.lit(1)))  # a single row
    return listed.where(some).withColumn("one", F.lit(1)).join(one, "one").select("chunk_id", F.round(score, 6).alias("bm25"))


def lexical(rows: DataFrame, query: t.Query, date_from: str | None, date_to: str | None, limit: int = 20, domains: list[str] | None = None) -> DataFrame:
    """The best chunks by BM25 in scope, with their rank from 1."""
    if not query.prefixes:
        return rows.limit(0).withColumns({"bm25": F.lit(0.0), "lexical_rank": F.lit(0)})
    hits = in_scope(rows, date_from, date_to, domains).join(bm25(rows, query.prefixes), "chunk_id")
    top = hits.orderBy("bm25", t.compact(F.col("published_at")).desc(), "article_id", "chunk_index", "chunk_id").limit(limit)
    order = W.orderBy("bm25", t.compact(F.col("published_at")).desc(), "article_id", "chunk_index", "chunk_id")  # at most limit rows
    return top.withColumn("lexical_rank", F.row_number().over(order))


def contains_score(rows: DataFrame, query: t.Query, date_from: str | None, date_to: str | None, limit: int = 20) -> DataFrame:
    """The fallback without an index: how many of the query's tokens text or title contain."""
    words = list(dict.fromkeys(raw for raw, _ in query.terms))
    hits = [(F.lower("chunk_text").contains(w) | F.lower(F.coalesce("article_title", F.lit(""))).contains(w)).cast("int") for w in words]
    score = sum(hits[1:], hits[0]) if hits else F.lit(0)
    found = in_scope(rows, date_from, date_to).withColumn("match_count", score).where("match_count > 0")
    return found.orderBy(F.desc("match_count"), t.compact(F.col("published_at")).desc(), "article_id", "chunk_index", "chunk_id").limit(limit)


def with_query(rows: DataFrame, query: t.Query) -> DataFrame:
    """overlap, anchor share and count, and quality of each row; the haystack is made once."""
    hay = rows.withColumn("hay", t.haystack(F.col("article_title"), F.col("chunk_text")))
    return hay.withColumns({
        "overlap": t.overlap(F.col("hay"), query), "anchor": t.anchor_share(F.col("hay"), query),
        "anchor_matches": t.anchor_matches(F.col("hay"), query), "quality": t.quality(F.col("chunk_text")),
    }).drop("hay")


def vector_search(rows: DataFrame, query: t.Query, asked: Column, date_from: str | None, date_to: str | None, limit: int = 20, domains: list[str] | None = None, embedding: str = "embedding") -> DataFrame:
    """The most similar chunks in scope (cosine above 0), exactly: a scan with a bounded top-k."""
    near = in_scope(rows, date_from, date_to, domains).withColumn("vector_score", F.round(t.cosine(F.col(embedding), asked), 6)).where("vector_score > 0")
    return vector_order(with_query(near, query), limit)


def vector_order(near: DataFrame, limit: int) -> DataFrame:
    """The best of rows with a vector_score and what with_query adds, and their rank."""
    mixed = near.withColumn("vector_final", F.round(0.54 * F.col("vector_score") + 0.16 * F.col("overlap") + 0.16 * F.col("anchor") + F.col("quality"), 6))
    keys = (F.desc("vector_score"), F.desc("vector_final"), F.desc("published_at"), F.asc("chunk_id"))
    return mixed.orderBy(*keys).limit(limit).withColumn("vector_rank", F.row_number().over(W.orderBy(*keys)))


_COLUMNS = ("chunk_id", "article_id", "chunk_index", "chunk_text", "article_title", "published_at", "source_domain", "overlap", "anchor", "anchor_matches", "quality")


def hybrid(rows: DataFrame, query: t.Query, asked: Column, date_from: str | None, date_to: str | None, limit: int = 10, domains: list[str] | None = None, embedding: str = "embedding") -> DataFrame:
    """Lexical and vector candidates in one list, by fused score."""
    wide = max(3 * limit, HYBRID_LIMIT)
    return fuse(lexical(rows, query, date_from, date_to, wide, domains), vector_search(rows, query, asked, date_from, date_to, wide, domains, embedding), query, limit)


def fuse(lexical_found: DataFrame, vector_found: DataFrame, query: t.Query, limit: int = 10) -> DataFrame:
    """Two ranked lists of candidates in one, by fused score."""
    wide = max(3 * limit, HYBRID_LIMIT)
    lex = with_query(lexical_found, query).select(*_COLUMNS, "lexical_rank")
    vec = vector_found.select(*_COLUMNS, "vector_score", "vector_rank")
    both = lex.alias("l").join(vec.alias("v"), "chunk_id", "full_outer").select(
        "chunk_id", *[F.coalesce(F.col(f"l.{c}"), F.col(f"v.{c}")).alias(c) for c in _COLUMNS if c != "chunk_id"], "lexical_rank", "vector_score", "vector_rank"
    )
    sim, lr, vr, o, a, q = (F.col(c) for c in ("vector_score", "lexical_rank", "vector_rank", "overlap", "anchor", "quality"))
    from_lex = 0.48 / lr + 0.22 * o + 0.20 * a + q
    fused = F.when(vr.isNull(), from_lex).when(lr.isNull(), 0.45 * sim + 0.12 / vr + 0.18 * o + 0.18 * a + q).otherwise(
        from_lex + 0.22 * sim + 0.05 / vr + 0.06 * a + 0.03 * o
    )
    out = both.withColumns({
        "final_score": F.round(fused, 6), "lexical_score": F.when(lr.isNull(), 0.0).otherwise(F.round(1 / lr, 6)), "vector_score": F.coalesce(sim, F.lit(0.0)),
        "rerank_score": F.lit(0.0), "model_score": F.lit(0.0),
    }).drop("lexical_rank", "vector_rank")
    return out.orderBy(*order_keys()).limit(wide)


def order_keys() -> list[Column]:
    return [F.desc("final_score"), F.desc("rerank_score"), F.desc("lexical_score"), F.desc("vector_score"), F.desc("published_at"), F.asc("chunk_id")]


def rerank(rows: DataFrame, query: t.Query, limit: int = 10, model: Reranker | None = None, ranking: list[int] | None = None) -> DataFrame:
    """Cut to the re-ranked few, then add a model's scores and a given ranking of chunk ids."""
    few = rows.orderBy(*order_keys()).limit(max(2 * limit, RERANK_LIMIT))
    if model is not None:
        few = few.withColumn("model_score", model.score(F.lit(query.text), F.concat_ws("\n", "article_title", "chunk_text")))
        few = few.withColumn("final_score", F.round(F.col("final_score") + 0.42 * F.col("model_score"), 6))
    if ranking:
        # The place of an id's first mention in the whole list, repeats counted.
        told = F.nullif(F.array_position(F.lit(list(ranking)).cast("array<bigint>"), F.col("chunk_id").cast("bigint")), F.lit(0))
        few = few.withColumns({"rerank_score": F.coalesce(1 / told, F.lit(0.0)), "final_score": F.round(F.col("final_score") + F.coalesce(0.30 / told, F.lit(0.0)), 6)})
    return few


def topical(rows: DataFrame, query: t.Query) -> DataFrame:
    """What stays of the candidates: a class per row, and a decision over the classes present.

    Strict rows win (with the semantic ones after them); a narrow query is content with nothing;
    then semantic rows, then fallback ones, else everything.
    """
    o, a, m, v, f, q = (F.col(c) for c in ("overlap", "anchor", "anchor_matches", "vector_score", "final_score", "quality"))
    need = min(2, len(query.anchors))
    if query.narrow:
        kind = F.when(q <= -0.45, "none").when((m >= need) & ((o >= 0.40) | (v >= 0.55)), "strict").otherwise("none")
    else:
        kind = (
            F.when(q <= -0.45, "none").when((o >= 0.50) | (a >= 0.50), "strict")
            .when(((a > 0) & (v >= 0.72)) | ((o > 0) & (v >= 0.66)) | ((v >= 0.82) & (f >= 0.50)), "semantic").when(f >= 0.62, "fallback").otherwise("none")
        )
    marked = rows.withColumn("kind", kind)
    every = W.partitionBy(F.lit(1))  # over the few candidates only
    there = lambda c: F.max(c.cast("int")).over(every) == 1
    flags = {f"any_{k}": there(F.col("kind") == k) for k in ("strict", "semantic", "fallback")} | {"any_anchor": there((m > 0) & (q > -0.45))}
    marked = marked.withColumns(flags)
    strict, semantic, fallback = F.col("any_strict"), F.col("any_semantic"), F.col("any_fallback")
    if query.narrow:
        keep = F.when(strict, F.col("kind") == "strict").otherwise(False)
    else:
        keep = (
            F.when(strict, F.col("kind").isin("strict", "semantic")).when(semantic | (F.col("any_anchor") & F.lit(bool(query.anchors))), F.col("kind") == "semantic")
            .when(fallback, F.col("kind") == "fallback").otherwise(True)
        )
    return marked.where(keep).drop(*flags)


def diversify(rows: DataFrame, limit: int = 10, per_article: int = PER_ARTICLE) -> DataFrame:
    """At most two chunks an article, the best first, and the first so many of all."""
    w = W.partitionBy("article_id").orderBy(*order_keys())
    return rows.withColumn("of_article", F.row_number().over(w)).where(F.col("of_article") <= per_article).drop("of_article").orderBy(*order_keys()).limit(limit)


def search(rows: DataFrame, query: t.Query, asked: Column, date_from: str | None, date_to: str | None, limit: int = 10, domains: list[str] | None = None, model: Reranker | None = None) -> DataFrame:
    """The whole path from a query to its chunks; a query without terms finds nothing."""
    return narrowed(hybrid(rows, query, asked, date_from, date_to, limit, domains), query, limit, model)


def narrowed(found: DataFrame, query: t.Query, limit: int = 10, model: Reranker | None = None) -> DataFrame:
    """Hybrid candidates re-ranked, cut to the topic, and spread over articles."""
    if not query.terms:
        return found.limit(0).withColumn("kind", F.lit("none"))
    return diversify(topical(rerank(found, query, limit, model), query), limit)


def source_articles(found: DataFrame, limit: int = SOURCE_ARTICLES) -> DataFrame:
    """Articles by the sum of their chunks' scores, earlier chunks counting somewhat more."""
    part = F.greatest("final_score", F.lit(0.0)) + 0.10 / (F.col("chunk_index") + 1)
    sums = found.groupBy("article_id", "article_title", "source_domain").agg(F.round(F.sum(part), 6).alias("article_score"))
    return sums.orderBy(F.desc("article_score"), "article_id").limit(limit)


def listwise(rows: DataFrame, query: t.Query, model: TextModel, limit: int = 10) -> DataFrame:
    """Re-rank by a model's order of the best few chunks; without a usable answer nothing changes.

    The prompt holds max(2 * limit, RERANK_LIMIT) texts at most, which come to the driver for it.
    """
    few = rows.orderBy(*order_keys()).limit(max(2 * limit, RERANK_LIMIT)).collect()
    told = "\n".join(f"{r['chunk_id']}: [{r['article_title']}] {r['chunk_text']}" for r in few)
    try:
        answer = generate_object(model, f'Rank the chunks for the query "{query.text}". Answer with a JSON object {{"ranked_chunk_ids": [...]}}.\n{told}')
    except Exception:  # whatever a provider raises, the search goes on without it
        return rerank(rows, query, limit)
    known = {r["chunk_id"] for r in few}
    listed = answer.get("ranked_chunk_ids")
    ids = [int(x) if str(x).isdigit() else -1 for x in listed] if isinstance(listed, list) else []
    return rerank(rows, query, limit, ranking=ids if known & set(ids) else None)


# Fixed value: the message for a query that found nothing.
NOTHING = "По выбранному запросу релевантные фрагменты не найдены."


def summary(found: DataFrame, chunks: int = 2, message: str = NOTHING) -> DataFrame:
    """One row: the trimmed texts of the best chunks (the path without a model), or the fixed message.

    Chunks of little worth are left out, unless all are such.
    """
    few = found.withColumn("useful", F.max((F.col("quality") > -0.45).cast("int")).over(W.partitionBy(F.lit(1))))  # over the few found
    worth = few.where("useful = 0 or quality > -0.45").orderBy(*order_keys()).limit(chunks)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("final_score")).alias("o"), "chunk_id", F.trim(F.coalesce("chunk_text", F.lit(""))).alias("text"))))
    text = F.array_join(F.filter(F.transform(listed, lambda x: x["text"]), lambda x: x != ""), "\n\n")
    return worth.agg(F.coalesce(F.nullif(text, F.lit("")), F.lit(message)).alias("summary"), F.count("*").alias("n_chunks"))


def model_summary(found: DataFrame, query: t.Query, model: TextModel, chunks: int = 5) -> str:
    """A model's summary of the best chunks; an empty answer, one without Cyrillic letters or an error gives that of :func:`summary`."""
    useful = found.where("quality > -0.45")
    few = (found if useful.isEmpty() else useful).orderBy(*order_keys()).limit(chunks).collect()
    if few:
        told = "\n".join(f"{i}. [{r['article_title']}] {r['chunk_text']}" for i, r in enumerate(few, 1))
        try:
            text = model.generate(f"Сделай короткую сводку на русском языке по запросу «{query.text}» только по этим фрагментам:\n{told}", 0.1, 260).strip()
        except Exception:  # whatever a provider raises
            text = ""
        if re.search("[А-Яа-яЁё]", text):
            return text
    return summary(found).first()["summary"]


def vector_candidates(vectors: DataFrame, rows: DataFrame, model: str, date_from: str | None, date_to: str | None, domains: list[str] | None = None) -> DataFrame:
    """Stored vectors (chunk_id, model_name, embedding) of a model, with chunk, article and source in scope; newest first."""
    sane = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    held = vectors.where((F.col("model_name") == model) & sane)
    met = in_scope(rows, date_from, date_to, domains).join(held, "chunk_id")
    return met.orderBy(t.compact(F.col("published_at")).desc(), "article_id", "chunk_index", "chunk_id")


def index_missing(rows: DataFrame, embedded: DataFrame, model: str, limit: int | None = None) -> DataFrame:
    """Chunks without an embedding of a model, by id."""
    out = rows.join(embedded.where(F.col("model_name") == model).select("chunk_id"), "chunk_id", "left_anti").orderBy("chunk_id")
    return out.limit(limit) if limit else out
