"""Paragraph-aware chunks of article bodies, as one fold over the paragraphs of a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

#: Signs at which a chunk is closed, and below which it is not.
TARGET, LEAST = 700, 300


def chunk_array(normal_body: Column, target: int = TARGET, least: int = LEAST) -> Column:
    """array<struct<chunk_text, char_start, char_end>> of a body whose paragraphs are parted by blank lines.

    A chunk is closed before a paragraph that would take it over target, once it has least signs;
    paragraphs are never cut.
    """
    paragraphs = F.filter(F.split(normal_body, "\n\n"), lambda p: p != "")
    kind = "struct<done:array<struct<chunk_text:string,char_start:int,char_end:int>>,cur:string,start:int,pos:int>"
    zero = F.expr(f"cast(named_struct('done', array(), 'cur', '', 'start', 0, 'pos', 0) as {kind})")
    piece = lambda cur, start: F.struct(cur.alias("chunk_text"), start.cast("int").alias("char_start"), (start + F.length(cur)).cast("int").alias("char_end"))

    def step(s: Column, p: Column) -> Column:
        n = F.length(s["cur"])
        close = (n > 0) & (n + F.length(p) + 2 > target) & (n >= least)
        fresh = close | (n == 0)
        return F.struct(
            F.when(close, F.array_append(s["done"], piece(s["cur"], s["start"]))).otherwise(s["done"]).alias("done"),
            F.when(fresh, p).otherwise(F.concat(s["cur"], F.lit("\n\n"), p)).alias("cur"),
            F.when(fresh, s["pos"]).otherwise(s["start"]).cast("int").alias("start"),
            (s["pos"] + F.length(p) + 2).cast("int").alias("pos"),
        ).cast(kind)

    def finish(s: Column) -> Column:
        return F.when(s["cur"] != "", F.array_append(s["done"], piece(s["cur"], s["start"]))).otherwise(s["done"])

    return F.aggregate(paragraphs, zero, step, finish)


def chunk_articles(articles: DataFrame, key: str = "id", body: str = "body_text", **how: int) -> DataFrame:
    """(article_id, chunk_index, chunk_text, char_start, char_end, token_count); no shuffle."""
    rows = articles.select(F.col(key).alias("article_id"), F.posexplode(chunk_array(t.body(F.col(body)), **how)).alias("chunk_index", "c"))
    return rows.select("article_id", "chunk_index", "c.chunk_text", "c.char_start", "c.char_end", t.word_count(F.col("c.chunk_text")).alias("token_count"))


def ordered_chunks(chunks: DataFrame) -> DataFrame:
    """(article_id, chunk_texts): each article's chunks in order; repeated rows count once."""
    one = chunks.select("article_id", "chunk_index", "chunk_text").distinct()
    listed = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text")))
    return one.groupBy("article_id").agg(F.transform(listed, lambda x: x["chunk_text"]).alias("chunk_texts"))
