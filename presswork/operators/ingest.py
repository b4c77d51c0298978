"""Normalisation, validation, canonical selection and arrival-ordered de-duplication of articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as t
from ..runtime import forget, written

LEAST_BODY = 120


def normalise(df: DataFrame) -> DataFrame:
    """The nine stored fields of parsed articles, beside all other columns."""
    nb = t.body(F.col("body_text"))
    return df.withColumns({
        "url": t.url(F.col("url")), "title": t.squeeze(F.coalesce("title", F.lit(""))), "subtitle": t.optional(F.col("subtitle")), "body_text": nb,
        "published_at": F.trim(F.coalesce("published_at", F.lit(""))), "author": t.optional(F.col("author")), "category": t.optional(F.col("category")),
        "word_count": t.word_count(nb), "content_hash": t.content_hash(nb),
    })


def validity(least: int = LEAST_BODY) -> Column:
    """Why an article is refused, in the order of the tests; ``ok`` otherwise."""
    empty = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return (
        F.when(empty("title"), "empty_title").when(empty("body_text"), "empty_body").when(empty("published_at"), "empty_published_at")
        .when(F.length(F.trim("body_text")) < least, "short_body").otherwise("ok")
    )


def canonical_by_hash(df: DataFrame, key: str = "id", digest: str = "content_hash") -> DataFrame:
    """(content_hash, canonical_id, n): the canonical row of each hash, flagged ones first, then the smallest id.

    One partial aggregate, so that a hash with very many rows is no burden.
    """
    best = F.min(F.struct((~F.coalesce("is_canonical", F.lit(False))).alias("o"), F.col(key).alias("id")))
    return df.where(F.col(digest).isNotNull()).groupBy(digest).agg(best.alias("b"), F.count("*").alias("n")).select(digest, F.col("b.id").alias("canonical_id"), "n")


def duplicates_of(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, duplicate_type, canonical_id, duplicate_group_id) of incoming rows that a stored one matches: by url first, then by hash."""
    by_url = stored.where("url is not null").groupBy(F.col("url").alias("u")).agg(F.min_by("id", "id").alias("url_id"), F.min_by("duplicate_group_id", "id").alias("url_group"))
    best = F.min(F.struct((~F.coalesce("is_canonical", F.lit(False))).alias("o"), "id", "duplicate_group_id"))
    by_hash = stored.where("content_hash is not null").groupBy(F.col("content_hash").alias("h")).agg(best.alias("b")).select("h", F.col("b.id").alias("hash_id"), F.col("b.duplicate_group_id").alias("hash_group"))
    j = incoming.join(by_url, F.col("url") == F.col("u"), "left").join(by_hash, F.col("content_hash") == F.col("h"), "left")
    hit = j.where("url_id is not null or hash_id is not null")
    url_hit = F.col("url_id").isNotNull()
    return hit.select(
        "id", F.when(url_hit, "url").otherwise("content_hash").alias("duplicate_type"), F.coalesce("url_id", "hash_id").alias("canonical_id"),
        F.when(url_hit, F.coalesce("url_group", F.concat(F.lit("url:"), F.col("url_id").cast("string")))).otherwise(F.coalesce("hash_group", F.concat(F.lit("hash:"), F.col("content_hash")))).alias("duplicate_group_id"),
    )


def arrival_winners(df: DataFrame, order: str = "id") -> DataFrame:
    """(id, kept_id): which row each one is a repeat of when rows arrive in order; a kept row names itself.

    A repeat is not stored, so that it registers neither its url nor its hash. Rounds settle that: a row
    is kept once no earlier row that may still be kept shares its url or hash.
    """
    keys = F.explode(F.array(F.struct(F.lit("u").alias("k"), F.col("url").alias("v")), F.struct(F.lit("h").alias("k"), F.col("content_hash").alias("v")))).alias("g")
    groups = written(df.select(F.col(order).alias("id"), keys).where("g.v is not null").select("id", "g.k", "g.v"), "groups")
    state = written(df.select(F.col(order).alias("id"), F.lit(0).alias("s")), "state")
    while True:
        g = groups.join(state, "id").groupBy("k", "v").agg(F.min(F.when(F.col("s") == 1, F.col("id"))).alias("kept"), F.min(F.when(F.col("s") == 0, F.col("id"))).alias("open"))
        seen = groups.join(g, ["k", "v"]).groupBy("id").agg(F.min(F.when(F.col("kept") < F.col("id"), F.col("kept"))).alias("kept"), F.min(F.when(F.col("open") < F.col("id"), F.col("open"))).alias("open"))
        nxt = F.when(F.col("s") != 0, F.col("s")).when(F.col("kept").isNotNull(), 2).when(F.col("open").isNull(), 1).otherwise(0)
        fresh = written(state.join(seen, "id", "left").select("id", nxt.alias("s")), "state")
        forget(state)
        state = fresh
        if state.where("s = 0").isEmpty():
            break
    kept = groups.join(state.where("s = 1"), "id").groupBy("k", "v").agg(F.min("id").alias("kept"))
    first = groups.join(kept, ["k", "v"]).where("kept < id").groupBy("id").agg(F.min(F.struct((F.col("k") != "u").alias("o"), "kept")).alias("b"))
    return state.join(first, "id", "left").select("id", F.when(F.col("s") == 1, F.col("id")).otherwise(F.col("b.kept")).alias("kept_id"))


def ingest(incoming: DataFrame, stored: DataFrame, least: int = LEAST_BODY) -> DataFrame:
    """(id, source_id, status): what becomes of each incoming row: invalid, duplicate of a stored or earlier one, or saved."""
    ready = normalise(incoming).withColumn("verdict", validity(least))
    good = ready.where("verdict = 'ok'")
    old = duplicates_of(good, normalise(stored)).select("id", "duplicate_type")
    fresh = good.join(old, "id", "left_anti")
    rest = arrival_winners(fresh).where("kept_id <> id").select("id", F.lit("batch").alias("duplicate_type"))
    marked = ready.select("id", "source_id", "verdict").join(old.unionByName(rest), "id", "left")
    status = F.when(F.col("verdict") != "ok", "skipped_invalid").when(F.col("duplicate_type") == "url", "skipped_existing").when(F.col("duplicate_type").isNotNull(), "skipped_duplicate").otherwise("saved")
    return marked.select("id", "source_id", status.alias("status"))


def counters(statuses: DataFrame, by: str = "source_id") -> DataFrame:
    """Run counters per source; existing ones are part of the duplicates."""
    s = F.col("status")
    return statuses.groupBy(by).agg(
        F.count("*").alias("discovered"), F.count_if(s == "saved").alias("saved"), F.count_if(s == "skipped_existing").alias("skipped_existing"),
        F.count_if(s.isin("skipped_existing", "skipped_duplicate")).alias("skipped_duplicates"), F.count_if(s == "skipped_invalid").alias("skipped_invalid"),
    )


def accumulated(statuses: DataFrame, day: str) -> DataFrame:
    """Counters of a bulk run's days, and their running totals."""
    names = ("discovered", "saved", "skipped_existing", "skipped_duplicates", "skipped_invalid")
    per = counters(statuses, day)  # one row a day
    w = W.orderBy(day).rowsBetween(W.unboundedPreceding, W.currentRow)
    return per.select(day, *names, *[F.sum(n).over(w).alias(f"total_{n}") for n in names])


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key by the order columns: compaction of appended versions (upserts)."""
    w = W.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
