"""A stored search index: postings sorted by token, search rows with their vectors sorted by chunk.

A query reads the postings of its prefixes only, as the filter reaches the row groups; vectors are
read without the texts beside them; and the texts of the few chunks that are shown are fetched by
their ids. New chunks are appended, what is held already is left out.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as t
from ..runtime import broadcast_if_small
from . import retrieval as r

#: Ids that are looked up as literals; more are joined.
MOST_IDS = 1_000


class SearchStore:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.folder, name))

    @property
    def rows(self) -> DataFrame:
        return self._read("rows")

    @property
    def postings(self) -> DataFrame:
        return self._read("postings")

    @classmethod
    def create(cls, rows: DataFrame, folder: str) -> SearchStore:
        """rows are those of retrieval.search_rows with an ``embedding``, one per chunk."""
        out = cls(rows.sparkSession, folder)
        out._write(rows)
        return out

    def _write(self, rows: DataFrame) -> None:
        path = lambda name: os.path.join(self.folder, name)
        rows.repartitionByRange("chunk_id").sortWithinPartitions("chunk_id").write.mode("append").parquet(path("rows"))
        tokens = F.regexp_extract_all(F.lower(F.concat_ws(" ", "article_title", "chunk_text")), F.lit(r.INDEX_TOKEN), F.lit(0))
        listed = rows.select("chunk_id", tokens.alias("tokens")).withColumn("doc_len", F.size("tokens"))
        counted = listed.select("chunk_id", "doc_len", F.explode("tokens").alias("token")).groupBy("token", "chunk_id", "doc_len").agg(F.count("*").cast("int").alias("tf"))
        counted.repartitionByRange("token").sortWithinPartitions("token").write.mode("append").parquet(path("postings"))
        listed.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total_len")).coalesce(1).write.mode("append").parquet(path("totals"))

    def append(self, rows: DataFrame) -> None:
        """Add the rows whose chunk is not held yet."""
        self._write(rows.join(self.rows.select("chunk_id"), "chunk_id", "left_anti").select(*self.rows.columns))

    def fetch(self, found: DataFrame) -> DataFrame:
        """The full rows of found (chunk_id and other columns), by their ids where these are few."""
        few = found.limit(MOST_IDS + 1).collect()
        if len(few) > MOST_IDS:
            return self.rows.join(broadcast_if_small(found), "chunk_id")
        listed = self.spark.createDataFrame(few, found.schema)
        return self.rows.where(F.col("chunk_id").isin([x["chunk_id"] for x in few])).join(F.broadcast(listed), "chunk_id")  # at most MOST_IDS rows

    def scores(self, prefixes: list[str]) -> DataFrame:
        """(chunk_id, bm25) of the chunks that hold a token with one of the prefixes; smaller is better."""
        starts = [F.col("token").startswith(p) for p in prefixes]
        any_ = starts[0]
        for s in starts[1:]:
            any_ = any_ | s
        counts = [F.sum(F.when(s, F.col("tf")).otherwise(0)).alias(f"f{i}") for i, s in enumerate(starts)]
        held = self.postings.where(any_).groupBy("chunk_id", "doc_len").agg(*counts)
        n = held.agg(*[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(starts))]).first()
        n_docs, total = self._read("totals").agg(F.sum("n_docs"), F.sum("total_len")).first()
        mean = (total / n_docs) if n_docs else 1.0
        score = F.lit(0.0)
        for i in range(len(starts)):
            f = F.col(f"f{i}")
            idf = F.log((F.lit(n_docs or 0) - n[f"n{i}"] + 0.5) / F.lit(n[f"n{i}"] + 0.5))
            idf = F.when(idf <= 0, r.FLOOR).otherwise(idf)
            score = score - F.when(f > 0, idf * f * (r.K1 + 1) / (f + r.K1 * (1 - r.B + r.B * F.col("doc_len") / mean))).otherwise(0.0)
        return held.select("chunk_id", F.round(score, 6).alias("bm25"))

    def lexical(self, query: t.Query, date_from: str | None, date_to: str | None, limit: int = 20, domains: list[str] | None = None) -> DataFrame:
        """As retrieval.lexical: the best chunks by BM25 in scope, with their rank from 1."""
        if not query.prefixes:
            return self.rows.limit(0).withColumns({"bm25": F.lit(0.0), "lexical_rank": F.lit(0)})
        narrow = r.in_scope(self.rows, date_from, date_to, domains).select("chunk_id", "article_id", "chunk_index", "published_at")
        order = ("bm25", t.compact(F.col("published_at")).desc(), "article_id", "chunk_index", "chunk_id")
        top = narrow.join(self.scores(query.prefixes), "chunk_id").orderBy(*order).limit(limit)
        ranked = top.withColumn("lexical_rank", F.row_number().over(W.orderBy(*order)))  # at most limit rows
        return self.fetch(ranked.select("chunk_id", "bm25", "lexical_rank"))

    def vector(self, query: t.Query, asked: Column, date_from: str | None, date_to: str | None, limit: int = 20, domains: list[str] | None = None) -> DataFrame:
        """As retrieval.vector_search: an exact scan of the stored vectors; texts are read of the best and those that tie with them."""
        near = r.in_scope(self.rows, date_from, date_to, domains).withColumn("vector_score", F.round(t.cosine(F.col("embedding"), asked), 6)).where("vector_score > 0").select("chunk_id", "vector_score")
        least = near.orderBy(F.desc("vector_score")).limit(limit).agg(F.min("vector_score")).first()[0]
        few = self.fetch(near.where(F.col("vector_score") >= F.lit(1.0 if least is None else least)))
        return r.vector_order(r.with_query(few, query), limit)
