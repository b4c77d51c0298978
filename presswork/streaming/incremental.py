"""Streaming forms of the incremental operators: landed pages to new articles, and dated counts.

The reference workload is batch; these let the same steps run as files arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest
from ..sources import discovery, schemas


def landed_pages(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(schemas.PAGES).parquet(folder)


def article_stream(pages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Parsed, normalised, valid articles; repeats of a url within the watermark are dropped."""
    rows = ingest.normalise(discovery.parse_pages(pages)).withColumn("verdict", ingest.validity())
    return rows.where("verdict = 'ok'").withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["url"])


def append_new(articles: DataFrame, store: str, checkpoint: str, spark: SparkSession) -> StreamingQuery:
    """Write a stream's articles to a parquet store, less what it already holds by url or content hash."""

    def batch(df: DataFrame, number: int) -> None:
        try:
            held = spark.read.parquet(store)
        except Exception:  # nothing stored yet
            held = None
        new = df
        if held is not None:
            new = new.join(held.select("url"), "url", "left_anti").join(held.select("content_hash"), "content_hash", "left_anti")
        new.dropDuplicates(["content_hash"]).write.mode("append").parquet(store)

    return articles.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts(events: DataFrame, time: str = "ts", key: str = "event_type", window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Events per key and window, late ones counted within the delay."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    return events.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
