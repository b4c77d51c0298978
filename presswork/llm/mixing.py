"""A mixture of sources whose shares of all tokens follow target weights.

Each source's share of the total is turned into the mean number of copies of its documents; a
source whose documents would have to be used more often than allowed gives all it may, and the
others share the rest in proportion to their weights. The whole part of the mean goes to every
document; the fractional part is rounded by the pivotal method: two documents with fractional
copy counts trade token mass until one of them is whole, at random but so that every mean is kept
and the source's token mass changes only with its very last document. Partitions do this alone and
leave at most one fractional document a source; those residuals are combined in a tree.

Defined results
  * targets that are null, zero or negative, or without documents, take no part and show a share of 0;
  * sources not listed take no part; null and empty texts have no tokens and are never copied;
  * repeated target rows: the weights are summed, the smallest max_repeats holds; null means 1;
  * the same rows and seed give the same mixture, also if a task is run again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import written
from . import tokens

#: Leaves of the tree at least, documents of a leaf at most (about), and members of a node above.
LEAVES, LEAF_ROWS, FAN_IN = 64, 50_000, 16


def quotas(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """(source, target_share, max_repeats, n_tokens, quota_tokens, copies) of every listed source.

    sizes has (source, n_docs, n_tokens). total is the wanted size of the mixture in tokens; without
    it, the tokens that the participating sources have. One row per target: a bounded table, whose
    water-filling runs as a fixed number of rounds of window sums, one more than there are targets
    at most.
    """
    t = targets.groupBy("source").agg(F.sum("target_weight").alias("weight"), F.min("max_repeats").alias("max_repeats"))
    t = t.where(F.col("source").isNotNull()).join(F.broadcast(sizes), "source", "left")
    t = t.withColumns({
        "weight": F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)), "max_repeats": F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)),
        "n_docs": F.coalesce("n_docs", F.lit(0)), "n_tokens": F.coalesce("n_tokens", F.lit(0)),
    })

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        w = pdf["weight"].to_numpy(float)
        n = pdf["n_tokens"].to_numpy(float)
        most = n * pdf["max_repeats"].to_numpy(float)
        live = (w > 0) & (most > 0)
        rest = float(n[live].sum()) if total is None else float(total)
        quota, open_ = np.zeros(len(w)), live.copy()
        while open_.any():
            share = rest * w / w[open_].sum()
            full = open_ & (share >= most)
            if not full.any():
                quota[open_] = share[open_]
                break
            quota[full] = most[full]
            rest -= most[full].sum()
            open_ &= ~full
        return pdf.assign(target_share=w / w.sum() if w.sum() > 0 else w, quota_tokens=quota, copies=np.divide(quota, n, out=np.zeros(len(w)), where=n > 0))

    schema = "source string, weight double, max_repeats int, n_docs bigint, n_tokens bigint, target_share double, quota_tokens double, copies double"
    return t.select("source", "weight", "max_repeats", "n_docs", "n_tokens").groupBy().applyInPandas(lambda pdf: fill(pdf.sort_values("source")), schema)


def _draw(a: int, b: int, seed: int) -> float:
    """A number in [0, 1) that depends on the two documents and the seed alone."""
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + seed * 0x165667B19E3779F9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 31)) >> 11) / float(1 << 53)


def pivot(ids: list[int], mass: list[float], part: list[float], seed: int) -> list[float]:
    """Round fractional parts in [0, 1] so that sum(part * mass) is kept; at most one stays fractional."""
    out = list(part)
    eps = 1e-9
    hold = -1
    for i, p in enumerate(out):
        if p <= eps or p >= 1 - eps:
            out[i] = float(p > 0.5)
            continue
        if hold < 0:
            hold = i
            continue
        a, b = hold, i
        # Mass that may go from b to a, and from a to b, before one of the two is whole.
        up = min((1 - out[a]) * mass[a], out[b] * mass[b])
        down = min(out[a] * mass[a], (1 - out[b]) * mass[b])
        move = up if _draw(ids[a], ids[b], seed) * (up + down) < down else -down
        out[a] += move / mass[a]
        out[b] -= move / mass[b]
        left = []
        for j in (a, b):
            if out[j] <= eps or out[j] >= 1 - eps:
                out[j] = float(out[j] > 0.5)
            else:
                left.append(j)
        hold = left[0] if left else -1
    return out


def _round_rows(pdf: pd.DataFrame, seed: int, last: bool) -> pd.DataFrame:
    """Round one partition's rows, source by source; the last level settles what remains."""
    done = []
    for _, rows in pdf.groupby("source", sort=True):
        rows = rows.sort_values("doc_id", kind="stable")
        part = pivot(rows["doc_id"].tolist(), rows["n_tokens"].astype(float).tolist(), rows["part"].tolist(), seed)
        if last:
            part = [float(_draw(i, i, seed) < p) if 0 < p < 1 else p for i, p in zip(rows["doc_id"], part, strict=True)]
        done.append(rows.assign(part=part))
    return pd.concat(done) if done else pdf


def mixture(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 7, **where: str) -> tuple[DataFrame, DataFrame]:
    """(copies, report): (doc_id, source, n_tokens, copies) of the documents used, and the shares.

    Every document is encoded once; its size is then carried as a number. The leaves of the tree are
    cut by a hash of the document within its source, so that a source with most of the documents is
    spread like any other; a leaf holds numbers only.
    """
    listed = F.broadcast(targets.select(F.col("source").alias("__t")).distinct())  # bounded by the target list
    docs = documents.select("doc_id", "text", "source").join(listed, F.col("source") == F.col("__t")).drop("__t")
    keyed = docs.select(F.struct("doc_id", "source").alias("k"), "text")
    sized = written(tokens.count_tokens(keyed, "k", "text", **where).select("k.doc_id", "k.source", "n_tokens"), "sized")
    sizes = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    plan = written(quotas(sizes, targets, total), "quotas")
    rows = sized.where("n_tokens > 0").join(F.broadcast(plan.select("source", "copies")), "source").where("copies > 0")
    whole = F.floor("copies")
    level = rows.select("doc_id", "source", "n_tokens", whole.cast("int").alias("whole"), (F.col("copies") - whole).alias("part"))
    schema = level.schema
    n = max(LEAVES, -(-sized.count() // LEAF_ROWS))
    out = None
    while True:
        level = level.withColumn("node", F.pmod(F.xxhash64("doc_id"), F.lit(n)))
        rounded = written(_by_node(level, schema, seed, n == 1), "rounded")
        settled = rounded if n == 1 else rounded.where("part in (0.0, 1.0)")
        out = settled if out is None else out.unionByName(settled)
        if n == 1:
            break
        # What is left has at most one document per node and source.
        level, n = rounded.where("part not in (0.0, 1.0)"), max(1, n // FAN_IN)
    copies = out.select("doc_id", "source", "n_tokens", (F.col("whole") + F.col("part")).cast("int").alias("copies")).where("copies > 0")
    used = copies.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"), F.max("copies").alias("most_copies"), F.count("*").alias("used_docs"))
    all_tokens = used.agg(F.sum("mixed_tokens")).scalar()
    report = plan.join(F.broadcast(used), "source", "left").select(
        "source", "target_share", "max_repeats", "n_docs", "n_tokens", "quota_tokens", F.coalesce("used_docs", F.lit(0)).alias("used_docs"),
        F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.coalesce(F.col("mixed_tokens") / all_tokens, F.lit(0.0)).alias("actual_share"),
    )
    return copies, report


def _by_node(level: DataFrame, schema, seed: int, last: bool) -> DataFrame:
    """Round within the nodes: a task holds one node at a time, about LEAF_ROWS rows of numbers at most."""
    return level.groupBy("node").applyInPandas(lambda pdf: _round_rows(pdf.drop(columns="node"), seed, last), schema)
