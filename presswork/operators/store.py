"""Reads and writes over the stored tables: lookups, lists, flags, integrity, documents, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as t
from . import chunking


def by_ids(articles: DataFrame, ids: DataFrame) -> DataFrame:
    """Articles of the given ids (a table with id), newest text first."""
    return articles.join(ids.select("id").distinct(), "id", "left_semi").orderBy(F.desc("published_at"), F.desc("id"))


def in_range(articles: DataFrame, sources: DataFrame, date_from: str | None, date_to: str | None, domains: list[str] | None = None, canonical: bool = True) -> DataFrame:
    """Articles between two dates (inclusive, on the sortable form), canonical ones, of some domains; by date and id."""
    at, low, high = t.compact(F.col("published_at")), t.bound(date_from), t.bound(date_to)
    out = articles
    if low:
        out = out.where(at >= low)
    if high:
        out = out.where(at <= high)
    if canonical:
        out = out.where("is_canonical")
    if domains:
        out = out.join(F.broadcast(sources.where(F.col("domain").isin(*domains)).select(F.col("id").alias("source_id"))), "source_id", "left_semi")
    return out.orderBy(at, "id")


def by_source(articles: DataFrame, limit: int = 100) -> DataFrame:
    """The newest articles of every source."""
    w = W.partitionBy("source_id").orderBy(F.desc("published_at"), F.desc("id"))
    return articles.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= limit).drop("__r")


def list_sources(sources: DataFrame, active: bool | None = None) -> DataFrame:
    return (sources if active is None else sources.where(F.col("is_active") == active)).orderBy("name")


def set_flag(df: DataFrame, key: Column, flag: str, value: bool, stamp: Column | None = None) -> DataFrame:
    """Rows that key selects get the flag (and time of change); the others stay."""
    out = df.withColumn(flag, F.when(key, F.lit(value)).otherwise(F.col(flag)))
    return out.withColumn("updated_at", F.when(key, stamp).otherwise(F.col("updated_at"))) if stamp is not None else out


def matched(df: DataFrame, asked: DataFrame, key: str = "id") -> DataFrame:
    """(key, matched) of the asked keys: whether an update of that row would find one."""
    held = df.select(key).distinct().withColumn("matched", F.lit(True))
    return asked.select(key).distinct().join(held, key, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], kept: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """old with the rows of new in place of those of their keys; columns in kept stay as the old row has them.

    Of several new rows of a key the last by order holds. One shuffle on the key.
    """
    both = old.withColumn("__new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("__new", F.lit(1)))
    last = [F.col("__new").desc(), *([F.col(order).desc_nulls_last()] if order else [])]
    rest = [c for c in old.columns if c not in keys]
    # A stable choice among equal versions: by all other columns.
    w = W.partitionBy(*keys)
    first = {c: F.first(F.when(F.col("__new") == 0, F.col(c)), ignorenulls=True).over(w.orderBy("__new", *rest).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) for c in kept}
    out = both.withColumns({f"__k_{c}": v for c, v in first.items()}).withColumn("__r", F.row_number().over(w.orderBy(*last, *rest))).where("__r = 1")
    return out.select(*[F.coalesce(F.col(f"__k_{c}"), F.col(c)).alias(c) if c in kept else F.col(c) for c in old.columns])


def get_or_create_sources(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """(domain, id, created) of the wanted domains: known ones with their id, others with the next free ones in order of domain.

    The sources table is small; only its missing domains are numbered, by a running number over them.
    """
    ask = wanted.select("domain").where("domain is not null").distinct()
    held = known.groupBy("domain").agg(F.min("id").alias("id"))
    top = known.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    new = ask.join(F.broadcast(held.select("domain")), "domain", "left_anti").withColumn("id", F.row_number().over(W.orderBy("domain")).cast("bigint")).withColumn("id", F.col("id") + top)
    return ask.join(F.broadcast(held), "domain").withColumn("created", F.lit(False)).unionByName(new.withColumn("created", F.lit(True)))


def without_chunks(articles: DataFrame, chunks: DataFrame) -> DataFrame:
    """Articles that no chunk belongs to: what a backfill has to cut."""
    return articles.join(chunks.select(F.col("article_id").alias("id")).distinct(), "id", "left_anti")


def missing_sources(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sources of wanted whose domain is not known yet: what a get-or-create appends."""
    return wanted.join(known.select("domain"), "domain", "left_anti")


def violations(sources: DataFrame, articles: DataFrame, chunks: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(rule, n): rows that break a key, a reference or a check."""
    def row(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.lit(name).alias("rule"), F.count("*").alias("n"))

    repeated = lambda df, *k: df.groupBy(*k).count().where("count > 1")
    checks = [
        row("articles.url unique", repeated(articles.where("url is not null"), "url")), row("sources.domain unique", repeated(sources, "domain")),
        row("article_chunks(article_id, chunk_index) unique", repeated(chunks, "article_id", "chunk_index")),
        row("articles.source_id refers", articles.join(F.broadcast(sources.select(F.col("id").alias("source_id"))), "source_id", "left_anti")),
        row("article_chunks.article_id refers", chunks.join(articles.select(F.col("id").alias("article_id")), "article_id", "left_anti")),
        row("article_duplicates.article_id refers", duplicates.join(articles.select(F.col("id").alias("article_id")), "article_id", "left_anti")),
        row("articles.word_count >= 0", articles.where("word_count < 0")), row("similarity_score in [0, 1]", duplicates.where("similarity_score < 0 or similarity_score > 1")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def documents(articles: DataFrame, sources: DataFrame, chunks: DataFrame, date_from: str | None = None, date_to: str | None = None, domains: list[str] | None = None) -> DataFrame:
    """Canonical articles with their source's name and domain and their ordered chunk texts (an empty list if none)."""
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("domain").alias("source_domain"))
    a = in_range(articles, sources, date_from, date_to, domains).join(F.broadcast(s), "source_id")
    out = a.join(chunking.ordered_chunks(chunks).withColumnRenamed("article_id", "id"), "id", "left")
    none = F.array().cast("array<string>")
    return out.select(F.col("id").alias("article_id"), "source_id", "source_name", "source_domain", "title", "subtitle", "body_text", "published_at", "category", F.coalesce("chunk_texts", none).alias("chunk_texts"))


def domains_key(domains: list[str] | None) -> str:
    return ",".join(sorted({d.strip() for d in domains or [] if d.strip()})) or "*"


def snapshot(tables: dict[str, DataFrame], domains: list[str] | None, date_from: str | None, date_to: str | None) -> DataFrame:
    """One row of counts of a run's tables, with its key; the tables themselves are written beside it."""
    out = None
    for name, df in tables.items():
        n = df.agg(F.count("*").alias(f"n_{name}")).withColumn("one", F.lit(1))
        out = n if out is None else out.join(F.broadcast(n), "one")
    key = {"source_domains_key": F.lit(domains_key(domains)), "date_from": F.lit(t.bound(date_from)), "date_to": F.lit(t.bound(date_to))}
    cols = [F.col(f"n_{n}") for n in tables]
    return out.select(*[v.alias(k) for k, v in key.items()], *cols, F.to_json(F.struct(*cols)).alias("payload_json"))


def latest_run(runs: DataFrame, domains: list[str] | None, date_from: str | None, date_to: str | None) -> DataFrame:
    """The newest run of a key."""
    key = (F.col("source_domains_key") == domains_key(domains)) & F.col("date_from").eqNullSafe(F.lit(t.bound(date_from))) & F.col("date_to").eqNullSafe(F.lit(t.bound(date_to)))
    return runs.where(key).orderBy(F.desc("id")).limit(1)
