"""Article links from feeds, section pages and archive pages; pages landed by a fetcher are read as tables."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import html as h


@dataclass(frozen=True)
class SourceConfig:
    """Where a source's articles are found."""

    name: str
    domain: str
    base_url: str
    rss_urls: tuple[str, ...] = ()
    section_urls: tuple[str, ...] = ()
    site: str = ""
    article_patterns: tuple[str, ...] = ()
    archive_template: str | None = None


# The catalogue of known sources.
CATALOGUE = {
    "lenta": SourceConfig(
        "Lenta.ru", "lenta.ru", "https://lenta.ru", ("https://lenta.ru/rss", "https://lenta.ru/rss/news"), ("https://lenta.ru/news/", "https://lenta.ru/rubrics/russia/"), "lenta",
        (r"^https?://lenta\.ru/news/\d{4}/\d{2}/\d{2}/[^/]+/?$", r"^https?://lenta\.ru/articles/\d{4}/\d{2}/\d{2}/[^/]+/?$"), "https://lenta.ru/{year}/{month}/{day}/",
    ),
    "ria": SourceConfig(
        "РИА Новости", "ria.ru", "https://ria.ru", ("https://ria.ru/export/rss2/index.xml", "https://ria.ru/export/rss2/archive/index.xml"), ("https://ria.ru/world/", "https://ria.ru/politics/"), "ria",
        (r"^https?://ria\.ru/\d{8}/[^/]+\.html$", r"^https?://ria\.ru/\d{8}/[^/]+/?$"), "https://ria.ru/{ymd}/",
    ),
}


def source_config(name: str) -> SourceConfig:
    if name not in CATALOGUE:
        raise ValueError(f"unknown source: {name}")
    return CATALOGUE[name]


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, c.name, c.domain, c.base_url, c.site) for k, c in CATALOGUE.items()], "key string, name string, domain string, base_url string, site string")


def fits(link: Column, c: SourceConfig, strict: bool) -> Column:
    """Whether a link leads to an article of the source; strict refuses queries and fragments, and demands http."""
    host, path = F.lower(F.regexp_extract(link, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.regexp_extract(link, "^[^:]+://[^/?#]*([^?#]*)", 1)
    pattern = F.lit(not c.article_patterns)
    for p in c.article_patterns:
        pattern = pattern | link.rlike(p)
    ok = (host != "") & host.contains(c.domain) & ~path.isin("", "/") & (F.regexp_replace(link, "/$", "") != c.base_url.rstrip("/")) & pattern
    return ok & link.rlike("^https?://") & ~link.rlike("[?#]") if strict else ok


def _first_seen(rows: DataFrame, by: list[str], limit: int | None) -> DataFrame:
    """Links in order of their first place, each once per key, at most so many. by is never empty."""
    one = rows.groupBy(*by, "url").agg(F.min("pos").alias("pos"))
    ranked = one.withColumn("pos", F.row_number().over(W.partitionBy(*by).orderBy("pos")))
    return ranked.where(F.col("pos") <= limit) if limit else ranked


def _of_source(rows: DataFrame, page: str, order: tuple[str, ...], c: SourceConfig, limit: int | None) -> DataFrame:
    """(source, url, pos): first seen over all of a source's pages, in the order that its configuration lists them."""
    listed = F.array_position(F.lit(list(order)).cast("array<string>"), F.col(page))
    place = F.struct(F.when(listed > 0, listed).otherwise(len(order) + 1).alias("page"), F.col(page).alias("name"), F.col("pos").alias("pos"))
    return _first_seen(rows.withColumns({"source": F.lit(c.domain), "pos": place}), ["source"], limit)


def feed_links(feeds: DataFrame, c: SourceConfig, limit: int | None = None) -> DataFrame:
    """(source, url, pos) of feeds (feed_url, xml): item and entry elements' first link, by href or text."""
    entries = F.regexp_extract_all("xml", F.lit(r"(?is)<(?:\w+:)?(?:item|entry)\b[^>]*>(.*?)</(?:\w+:)?(?:item|entry)>"), F.lit(1))
    href = lambda x: F.nullif(F.regexp_extract(x, r"(?is)<(?:\w+:)?link\b[^>]*?href=[\"'](.*?)[\"']", 1), F.lit(""))
    told = lambda x: F.nullif(F.trim(F.regexp_extract(x, r"(?is)<(?:\w+:)?link\b[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</", 1)), F.lit(""))
    rows = feeds.select("feed_url", F.posexplode(F.transform(entries, lambda x: h.unescape(F.coalesce(href(x), told(x))))).alias("pos", "url"))
    return _of_source(rows.where(F.col("url").isNotNull() & fits(F.col("url"), c, False)), "feed_url", c.rss_urls, c, limit)


def section_links(pages: DataFrame, c: SourceConfig, limit: int | None = None) -> DataFrame:
    """(source, url, pos) of section pages (page_url, html): all links to the source's domain, read against their page."""
    rows = pages.select("page_url", F.posexplode(h.links(F.col("html"))).alias("pos", "url")).withColumn("url", h.absolute(F.col("url"), F.col("page_url")))
    host = F.regexp_extract("url", "^https?://([^/?#]*)", 1)
    return _of_source(rows.where(F.lower(host).contains(c.domain)), "page_url", c.section_urls, c, limit)


def archive_days(spark: SparkSession, c: SourceConfig, date_from: str, date_to: str) -> DataFrame:
    """(day, archive_url): every day of the range, both ends included; no rows without a template."""
    days = spark.sql(f"select explode(sequence(date'{date_from}', date'{date_to}', interval 1 day)) as day")
    if not c.archive_template:
        return days.select("day", F.lit("").alias("archive_url")).limit(0)
    url = F.lit(c.archive_template)
    for mark, form in (("{year}", "yyyy"), ("{month}", "MM"), ("{day}", "dd"), ("{ymd}", "yyyyMMdd")):
        url = F.replace(url, F.lit(mark), F.date_format("day", form))
    return days.select("day", url.alias("archive_url"))


def archive_links(days: DataFrame, pages: DataFrame, c: SourceConfig, per_day: int = 200) -> DataFrame:
    """(day, url, pos): the article links of each day's archive page (archive_url, html); days without any keep a null row."""
    found = days.join(pages, "archive_url", "left").select("day", "archive_url", F.posexplode(h.links(F.coalesce("html", F.lit("")))).alias("pos", "url"))
    found = found.withColumn("url", h.absolute(F.col("url"), F.col("archive_url")))
    good = _first_seen(found.where(fits(F.col("url"), c, True)), ["day"], per_day)
    return days.select("day").join(good, "day", "left")


def fetch(get: Callable[[str], bytes], url: str, retries: int = 2, delay: float = 1.5, multiplier: float = 1.75, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """One page by the caller's transport, tried again after growing pauses."""
    for attempt in range(1, retries + 2):
        try:
            return get(url)
        except OSError:
            if attempt > retries:
                raise
            sleep(delay * multiplier ** (attempt - 1))
    raise AssertionError


def parse_pages(pages: DataFrame) -> DataFrame:
    """Articles of landed pages (url, html, site): each site's patterns apply to its own pages; a page of an unknown site is an error."""
    known = F.coalesce(F.col("site").isin(*h.SITES), F.lit(False))
    pages = pages.withColumn("site", F.when(known, F.col("site")).otherwise(F.raise_error(F.concat(F.lit("unknown parser: "), F.coalesce("site", F.lit("null"))))))
    out = None
    for name, site in h.SITES.items():
        rows = pages.where(F.col("site") == name).withColumns(h.parse(F.col("html"), site))
        out = rows if out is None else out.unionByName(rows)
    return out.drop("html")
