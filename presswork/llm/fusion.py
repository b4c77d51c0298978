"""One surviving record per duplicate group, chosen field by field.

The members' field values become claims (group, field, value, source). Sources' accuracies and
their dependence are estimated in turn over all groups: two sources that share values which are
probably false, and seldom differ, are taken to copy; the votes of a copier are discounted after
those of the more accurate sources that say the same, and a value's posterior follows from the
discounted votes. Where trust decides, the ranks of trust are a prior before all votes: the fusion
then leaves the values of the most trusted claims, and the stated order settles between these.

Defined results
  * members are the existing rows that either table puts into a group; null and blank group ids
    and rows that do not exist are left out, repeated rows count once;
  * a value without a letter or digit (null, blank, dashes) is unfilled and claims nothing; a
    field nobody fills has no row;
  * null trust and null or unreadable times come last; remaining ties go to the smallest id;
  * groups of any size: all choices are partial aggregates, no group is gathered in one task.

What is held per source or pair of sources is bounded by the sources table, which has a fixed size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, forget, written

FIELDS = ("title", "subtitle", "author", "category")
#: Rounds of estimation at most, and change of the accuracies below which they have settled.
ROUNDS, SETTLED = 6, 0.005
#: First accuracy of a source and the votes it weighs, probability that a source copies at all,
#: share of a copier's values that are copied, number of false values a field may take.
ACCURACY, PRIOR_VOTES, COPIES, COPIED, FALSE_VALUES = 0.8, 4.0, 0.1, 0.8, 50.0


def memberships(articles: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(duplicate_group_id, article_id), once each, from both tables; existence is not checked."""
    a = articles.select("duplicate_group_id", F.col("id").alias("article_id"))
    b = duplicates.select("duplicate_group_id", "article_id")
    named = F.trim(F.col("duplicate_group_id")) != ""
    return a.unionByName(b).where(named & F.col("article_id").isNotNull()).distinct()


def _filled(value: Column) -> Column:
    return value.rlike(r"[\p{L}\p{N}]")


def members(articles: DataFrame, duplicates: DataFrame, profiles: DataFrame) -> DataFrame:
    """Existing members with their fields, source, trust and time of change."""
    trust = profiles.groupBy(F.col("source_id").alias("__s")).agg(F.min("trust_rank").alias("trust"))
    rows = articles.select(F.col("id").alias("article_id"), "source_id", "updated_at", *FIELDS)
    rows = rows.join(broadcast_if_small(memberships(articles, duplicates)), "article_id")
    rows = rows.join(F.broadcast(trust), F.col("source_id") == F.col("__s"), "left").drop("__s")
    changed = F.unix_timestamp(F.try_to_timestamp("updated_at"))
    return rows.withColumns({"trust_at": F.coalesce(F.col("trust"), F.lit(2**31 - 1)), "age": F.coalesce(-changed, F.lit(2**62))})


def claims(rows: DataFrame) -> DataFrame:
    """One row per member and filled field."""
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS])).alias("c")
    out = rows.select("duplicate_group_id", "article_id", "source_id", "trust_at", "age", fields)
    return out.select("duplicate_group_id", "c.field", "c.value", "article_id", "source_id", "trust_at", "age").where(_filled(F.col("value")))


def _value_key(value: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(value, r"\s+", " ")))


_ITEM = ["duplicate_group_id", "field"]


def _posteriors(votes: DataFrame, accuracy: DataFrame, dependence: DataFrame | None) -> DataFrame:
    """(group, field, value_key, rank, votes, posterior) from one vote per source and value.

    A vote counts less for every more accurate source that says the same and from which, or to
    which, it may be copied: sources of a value meet in pairs, at most as many as the sources table
    has rows, squared. Values of a better rank of trust go before all others, as a prior that no
    number of votes outweighs.
    """
    a = F.col("accuracy")
    # The sources table bounds the accuracies; the estimate of their size is looked at nevertheless.
    scored = votes.join(broadcast_if_small(accuracy), "source_id").withColumn("score", F.log(F.lit(FALSE_VALUES) * a / (1 - a)))
    value = [*_ITEM, "value_key"]
    if dependence is not None:
        one = scored.select(*value, F.col("source_id").alias("x"), F.col("score").alias("sx"))
        two = scored.select(*value, F.col("source_id").alias("y"), F.col("score").alias("sy"))
        # y goes before x: the more accurate first, then the smaller id.
        pairs = one.join(two, value).where((F.col("sy") > F.col("sx")) | ((F.col("sy") == F.col("sx")) & (F.col("y") < F.col("x"))))
        known = broadcast_if_small(dependence)
        pairs = pairs.withColumns({"a": F.least("x", "y"), "b": F.greatest("x", "y")}).join(known, ["a", "b"])
        alone = pairs.groupBy(*value, F.col("x").alias("source_id")).agg(F.exp(F.sum(F.log(1 - COPIED * F.col("p")))).alias("alone"))
        scored = scored.join(alone, [*value, "source_id"], "left").withColumn("score", F.col("score") * F.coalesce("alone", F.lit(1.0)))
    values = scored.groupBy(value).agg(F.min("rank").alias("rank"), F.sum("score").alias("votes"))
    best = values.groupBy(_ITEM).agg(F.min(F.struct("rank", (-F.col("votes")).alias("v"))).alias("best"), F.count("*").alias("n_values"))
    joined = values.join(best, _ITEM)
    first = F.col("rank") == F.col("best.rank")
    weight = F.when(first, F.exp(F.col("votes") + F.col("best.v"))).otherwise(0.0)
    joined = joined.withColumns({"weight": weight, "none": F.greatest(F.lit(FALSE_VALUES) + 1 - F.col("n_values"), F.lit(1.0)) * F.exp(F.col("best.v"))})
    total = joined.groupBy(_ITEM).agg((F.sum("weight") + F.max("none")).alias("total"))
    return joined.join(total, _ITEM).select(*value, "rank", "votes", (F.col("weight") / F.col("total")).alias("posterior"))


def _dependence(votes: DataFrame, post: DataFrame, accuracy: DataFrame) -> DataFrame:
    """(a, b, p): probability that one of two sources copies the other.

    Shared values that are probably true say little, shared false ones much, and differing values
    speak against it, each by its likelihood under copying and under independence.
    """
    said = votes.join(post.select(*_ITEM, "value_key", "posterior"), [*_ITEM, "value_key"]).select(*_ITEM, "value_key", "source_id", "posterior")
    one = said.select(*_ITEM, F.col("value_key").alias("u"), F.col("source_id").alias("a"), "posterior")
    two = said.select(*_ITEM, F.col("value_key").alias("v"), F.col("source_id").alias("b"))
    met = one.join(two, _ITEM).where("a < b")
    same = F.col("u") == F.col("v")
    counts = met.groupBy("a", "b").agg(
        F.sum(F.when(same, F.col("posterior")).otherwise(0.0)).alias("k_true"), F.sum(F.when(same, 1 - F.col("posterior")).otherwise(0.0)).alias("k_false"), F.sum((~same).cast("double")).alias("k_other")
    ).where("k_true + k_false > 0")
    small = broadcast_if_small(accuracy)
    both = counts.join(small.select(F.col("source_id").alias("a"), F.col("accuracy").alias("qa")), "a").join(small.select(F.col("source_id").alias("b"), F.col("accuracy").alias("qb")), "b")
    true = F.col("qa") * F.col("qb")
    false = (1 - F.col("qa")) * (1 - F.col("qb")) / FALSE_VALUES
    mean = (F.col("qa") + F.col("qb")) / 2
    odds = (
        F.lit(math.log(COPIES / (1 - COPIES))) + F.col("k_true") * F.log(COPIED * mean / true + 1 - COPIED)
        + F.col("k_false") * F.log(COPIED * (1 - mean) / false + 1 - COPIED) + F.col("k_other") * math.log(1 - COPIED)
    )
    p = 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(50.0)), F.lit(-50.0))))
    return both.select("a", "b", p.alias("p"))


def fuse(claimed: DataFrame, rounds: int = ROUNDS, trust: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(posteriors, accuracies, dependences), estimated over all groups in turn until they settle.

    With trust, the sources' ranks of trust are a prior before all votes; else they do not count.
    """
    rank = F.col("trust_at") if trust else F.lit(0)
    votes = claimed.select(*_ITEM, _value_key(F.col("value")).alias("value_key"), F.coalesce("source_id", F.lit(-1)).alias("source_id"), rank.alias("rank"))
    votes = written(votes.groupBy(*_ITEM, "value_key", "source_id").agg(F.min("rank").alias("rank")), "votes")
    accuracy = written(votes.select("source_id").distinct().withColumn("accuracy", F.lit(ACCURACY)), "accuracy")
    dependence = None
    for _ in range(rounds):
        post = written(_posteriors(votes, accuracy, dependence), "posteriors")
        each = votes.join(post.select(*_ITEM, "value_key", "posterior"), [*_ITEM, "value_key"])
        mean = (F.sum("posterior") + PRIOR_VOTES * ACCURACY) / (F.count("*") + PRIOR_VOTES)
        fresh = written(each.groupBy("source_id").agg(F.greatest(F.lit(0.05), F.least(F.lit(0.99), mean)).alias("accuracy")), "accuracy")
        dependence = written(_dependence(votes, post, fresh), "dependence")
        moved = fresh.join(accuracy.withColumnRenamed("accuracy", "was"), "source_id").agg(F.max(F.abs(F.col("accuracy") - F.col("was")))).first()[0]
        forget(post, accuracy)
        accuracy = fresh
        if moved is None or moved < SETTLED:
            break
    return _posteriors(votes, accuracy, dependence), accuracy, dependence


def survivors(claimed: DataFrame, posteriors: DataFrame, prefer: tuple[str, ...]) -> DataFrame:
    """(duplicate_group_id, field, article_id, value, source_id): the best claim by prefer, in order.

    ``posterior`` among them takes the value of greatest posterior. Without it every value that the
    prior leaves possible (of a posterior above 0) may win, and the order settles which.
    """
    post = posteriors.where("posterior > 0").select(*_ITEM, "value_key", F.round("posterior", 9).alias("posterior"))
    claimed = claimed.withColumn("value_key", _value_key(F.col("value"))).join(post, [*_ITEM, "value_key"])
    order = {"trust": F.col("trust_at"), "recent": F.col("age"), "smallest": F.col("article_id"), "posterior": -F.col("posterior")}
    best = F.min(F.struct(*[order[p].alias(f"o{i}") for i, p in enumerate(prefer)], "article_id", "value", "source_id")).alias("best")
    out = claimed.groupBy(_ITEM).agg(best)
    return out.select(*_ITEM, "best.article_id", "best.value", "best.source_id")


def trusted_values(articles: DataFrame, duplicates: DataFrame, profiles: DataFrame) -> DataFrame:
    """(duplicate_group_id, field, article_id): the claim that survives if trust is a prior before all votes.

    The fusion leaves the values of the most trusted claims; among these the exact order (trust of the
    claim itself, time, id) decides.
    """
    claimed = written(claims(members(articles, duplicates, profiles)), "claims")
    post, _, _ = fuse(claimed, trust=True)
    return survivors(claimed, post, ("trust", "recent", "smallest")).select(*_ITEM, "article_id")


def fused_records(articles: DataFrame, duplicates: DataFrame, profiles: DataFrame) -> DataFrame:
    """One record per group: the values of maximum posterior, field by field, with their origin."""
    claimed = written(claims(members(articles, duplicates, profiles)), "claims")
    post, _, _ = fuse(claimed)
    best = survivors(claimed, post, ("posterior", "trust", "recent", "smallest"))
    return best.groupBy("duplicate_group_id").agg(
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in FIELDS],
        *[F.max(F.when(F.col("field") == f, F.col("article_id"))).alias(f"{f}_from") for f in FIELDS],
    )
