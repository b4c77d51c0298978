"""Mixed timestamp spellings and zones brought to one UTC instant.

A text is read by one of six spellings into a wall-clock time in microseconds, and is then
joined to the offset intervals of its zone: the intervals of every zone, cut at its offset
changes and exploded into decades, so that the as-of join is an equi-join on (zone, decade)
with at most a handful of intervals to look at. One matching interval gives the offset, two
mean that the time occurs twice, none means that it was skipped.

Defined results
  * null, blank, wordless or impossible texts (``0000-00-00``, 30 February, 25:00) give null;
  * a zone, offset or abbreviation in the text wins over the zone of the row;
  * a row without any zone is read as UTC; an unknown zone name gives null;
  * a wall time after 2099 has the offset of the same date in a year before with the same calendar;
  * a time that occurs twice is its first pass, a skipped one moves forward by the jump;
  * repeated rows and repeated ids each keep their own result, extra columns pass through.
"""

from __future__ import annotations

import os
import struct
from datetime import datetime, timezone
from functools import lru_cache
from importlib import resources
from zoneinfo import TZPATH, ZoneInfo, available_timezones

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

US = 1_000_000
DAY_US = 86_400 * US
#: Years that the interval table covers, from before the zone files' first changes; its first and last intervals are open beyond them.
FIRST_YEAR, LAST_YEAR = 1840, 2099
#: No yearly rule keeps an offset for a shorter time than this.
PROBE_DAYS = 28

# Month names (English, German, Russian genitive and nominative).
MONTHS = (
    ("jan", "january", "januar", "jänner", "янв", "января", "январь"),
    ("feb", "february", "februar", "фев", "февр", "февраля", "февраль"),
    ("mar", "march", "märz", "mär", "maerz", "мар", "марта", "март"),
    ("apr", "april", "апр", "апреля", "апрель"),
    ("may", "mai", "мая", "май"),
    ("jun", "june", "juni", "июн", "июня", "июнь"),
    ("jul", "july", "juli", "июл", "июля", "июль"),
    ("aug", "august", "авг", "августа", "август"),
    ("sep", "sept", "september", "сен", "сент", "сентября", "сентябрь"),
    ("oct", "october", "oktober", "okt", "окт", "октября", "октябрь"),
    ("nov", "november", "ноя", "нояб", "ноября", "ноябрь"),
    ("dec", "december", "dezember", "dez", "дек", "декабря", "декабрь"),
)
# Usual abbreviations of zones, in minutes east of Greenwich.
ABBREVIATIONS = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "mez": 60, "cest": 120, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "мск": 180, "msd": 240, "samt": 240, "yekt": 300, "omst": 360, "novt": 420,
    "krat": 420, "irkt": 480, "yakt": 540, "vlat": 600, "ist": 330, "jst": 540, "kst": 540, "aest": 600, "aedt": 660,
    "nst": -210, "ndt": -150, "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360, "cdt": -300,
    "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?: ?(am|pm|a\.m\.|p\.m\.|uhr|h)(?![\p{L}/]))?"
_ZONE = r"(?: ?([a-zа-я]+(?:/[a-z0-9_+-]+){1,2}|(?:utc|gmt)?[+\-−]\d{1,2}(?::?\d{2})?|[a-zа-я]{1,5}))?"
_WHEN = rf"(?:(?:,? (?:at |um |в |o |- )?|t){_TIME})?{_ZONE}"
_WEEKDAY = r"(?:\p{L}+\.?,? )?"
#: Spelling -> pattern on the squeezed lower-case text; groups: three date parts, five of the time, the zone.
SPELLINGS = {
    "ymd": rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_WHEN}$",
    "compact": rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[t ](\d{{2}}):?(\d{{2}})(?::?(\d{{2}})(?:[.,](\d{{1,9}}))?)?()?{_ZONE})?$",
    "numeric": rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}){_WHEN}$",
    "day_name": rf"^{_WEEKDAY}(\d{{1,2}})(?:\.|st|nd|rd|th)? (\p{{L}}+)\.?,? (\d{{4}})(?: г\.?| года)?{_WHEN}$",
    "name_day": rf"^{_WEEKDAY}(\p{{L}}+)\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}}){_WHEN}$",
}


def _stored_changes(name: str) -> tuple[list[tuple[int, int]], bool]:
    """Transitions that the compiled zone file lists (RFC 8536), and whether a yearly rule follows."""
    data = b""
    for root in TZPATH:
        if os.path.isfile(path := os.path.join(root, name)):
            with open(path, "rb") as f:
                data = f.read()
            break
    else:
        data = resources.files("tzdata.zoneinfo").joinpath(name).read_bytes()

    def counts(at: int) -> tuple[int, ...]:
        return struct.unpack(">6l", data[at + 20 : at + 44])

    utc, std, leaps, times, types, chars = counts(0)
    at = 44 + times * 5 + types * 6 + chars + leaps * 8 + std + utc
    utc, std, leaps, times, types, chars = counts(at)
    at += 44
    seconds = struct.unpack(f">{times}q", data[at : at + times * 8])
    kinds = data[at + times * 8 : at + times * 9]
    at += times * 9
    offsets = [struct.unpack(">l", data[at + i * 6 : at + i * 6 + 4])[0] for i in range(types)]
    footer = data[at + types * 6 + chars + leaps * 12 + std + utc :]
    return [(t, offsets[k]) for t, k in zip(seconds, kinds, strict=True)], b"," in footer


def _offset_changes(name: str) -> list[tuple[int, int]]:
    """(UTC second from which it holds, offset in seconds) of a zone, in order."""
    zone = ZoneInfo(name)

    def at(second: int) -> int:
        return int(datetime.fromtimestamp(second, zone).utcoffset().total_seconds())

    start = int(datetime(FIRST_YEAR, 1, 1, tzinfo=timezone.utc).timestamp())
    end = int(datetime(LAST_YEAR + 1, 1, 1, tzinfo=timezone.utc).timestamp())
    stored, rule = _stored_changes(name)
    out = [(start, at(start))]
    for second, offset in stored:
        if start < second < end and offset != out[-1][1]:
            out.append((second, offset))
    low = max([start, *(s for s, _ in stored)])
    offset = at(low)
    while rule and low < end:  # the yearly rule goes on beyond the listed ones
        high = min(low + PROBE_DAYS * 86_400, end)
        if (new := at(high)) != offset:
            a, b = low, high
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (mid, b) if at(mid) == offset else (a, mid)
            out.append((b, new))
            offset = new
        low = high
    return out


@lru_cache(maxsize=1)
def _interval_rows() -> pa.Table:
    """One row per (zone, decade): its offset intervals in local time.

    Its size depends on the zone database alone (about 600 zones, 26 decades). ``until`` is
    the local end of the interval, ``jump_until`` the local start of the next one if that is
    later: times between the two were skipped.
    """
    far = 1 << 61
    names, decades, lists, aliases = [], [], [], {}
    for name in sorted(available_timezones()):
        changes = tuple(_offset_changes(name))
        if changes not in aliases:
            spans = []
            for i, (since, offset) in enumerate(changes):
                last = i + 1 == len(changes)
                begin = -far if i == 0 else (since + offset) * US
                until = far if last else (changes[i + 1][0] + offset) * US
                jump = far if last else max(until, (changes[i + 1][0] + changes[i + 1][1]) * US)
                spans.append({"since": begin, "until": until, "jump_until": jump, "offset_us": offset * US})
            per = {}
            for decade in range(FIRST_YEAR // 10, LAST_YEAR // 10 + 1):
                low = -far if decade == FIRST_YEAR // 10 else _year_us(decade * 10)
                high = far if decade == LAST_YEAR // 10 else _year_us(decade * 10 + 10)
                per[decade] = [s for s in spans if s["since"] < high and s["jump_until"] > low]
            aliases[changes] = per
        for decade, spans in aliases[changes].items():
            names.append(name.lower())
            decades.append(decade)
            lists.append(spans)
    item = pa.struct([(c, pa.int64()) for c in ("since", "until", "jump_until", "offset_us")])
    return pa.table({"zone_key": pa.array(names, pa.string()), "decade": pa.array(decades, pa.int32()), "spans": pa.array(lists, pa.list_(item))})


def _year_us(year: int) -> int:
    return int(datetime(year, 1, 1, tzinfo=timezone.utc).timestamp()) * US


def offset_intervals(spark: SparkSession) -> DataFrame:
    """(zone_key, decade, spans): the exploded zone-offset intervals."""
    return spark.createDataFrame(_interval_rows())


def _days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a Gregorian date (y >= 1), in integers."""
    early = (m <= 2).cast("long")
    year = y - early
    era = F.floor(year / 400).cast("long")
    of_era = year - era * 400
    of_year = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5).cast("long") + d - 1
    return era * 146097 + of_era * 365 + F.floor(of_era / 4).cast("long") - F.floor(of_era / 100).cast("long") + of_year - 719468


def _calendars() -> dict[int, int]:
    """Kind of calendar (weekday of New Year, leap or not) -> day number of New Year in such a year, of the last 28 covered before the end."""
    out = {}
    for year in range(LAST_YEAR - 32, LAST_YEAR - 4):
        first = _year_us(year) // DAY_US
        out[first % 7 * 2 + (year % 4 == 0)] = first
    return out


def _int(c: Column) -> Column:
    return F.nullif(c, F.lit("")).cast("long")


def _groups(text: Column) -> Column:
    """The spelling's name and its nine groups (date 3, time 5, zone), joined by tabs; else null."""
    out = F.when(text.rlike(r"^(?:\d{10}|\d{13})$"), F.concat(F.lit("epoch\t"), text))
    for kind, pattern in SPELLINGS.items():
        out = out.when(text.rlike(pattern), F.regexp_replace(text, pattern, kind + "".join(f"\t${i}" for i in range(1, 10))))
    return out


def normalise_timestamps(df: DataFrame, text: str, zone: str, order: str | None = None, out: str = "utc_us", status: str = "utc_status") -> DataFrame:
    """Append ``out`` (UTC microseconds) and ``status`` to df; rows and columns are kept.

    text, zone, order name the columns of the text, the row's tz database name and the reading of
    all-numeric dates (``DMY`` or ``MDY``, null as DMY). status is ``instant`` (epoch or offset
    stated), ``unique``, ``ambiguous``, ``nonexistent`` or ``unreadable``.
    No shuffle: one projection and a broadcast join to the interval table, whose size is fixed.
    """
    squeezed = F.lower(F.trim(F.regexp_replace(F.col(f"`{text}`"), r"[\s\u00A0\u2007\u202F]+", " ")))
    order_by = F.col(f"`{order}`") if order else F.lit("DMY")
    abbreviations = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    months = F.create_map(*[F.lit(x) for i, names in enumerate(MONTHS) for n in names for x in (n, i + 1)])
    base = df.withColumn("__text", squeezed)
    base = base.withColumn("__g", F.split(_groups(F.col("__text")), "\t"))
    part = lambda i: F.nullif(F.get("__g", F.lit(i)), F.lit(""))
    kind = part(0)
    mdy = (kind == "numeric") & (order_by == "MDY")
    first, second, third = part(1), part(2), part(3)
    base = base.withColumns({
        "__y": F.when(kind.isin("ymd", "compact"), first).when(kind != "epoch", third).cast("long"),
        "__m": F.when(mdy, first.cast("long")).when(kind.isin("ymd", "compact", "numeric"), second.cast("long"))
        .when(kind == "day_name", F.try_element_at(months, second).cast("long")).when(kind == "name_day", F.try_element_at(months, first).cast("long")),
        "__day": F.when(kind.isin("ymd", "compact"), third).when(mdy | (kind == "name_day"), second).when(kind != "epoch", first).cast("long"),
        "__h": F.coalesce(part(4).cast("long"), F.lit(0)), "__min": F.coalesce(part(5).cast("long"), F.lit(0)),
        "__sec": F.coalesce(part(6).cast("long"), F.lit(0)),
        "__us": F.coalesce(F.substring(F.rpad(part(7), 6, "0"), 1, 6).cast("long"), F.lit(0)),
        "__half": F.coalesce(F.substring(part(8), 1, 1), F.lit("")), "__told": part(9),
        "__epoch": F.when(kind == "epoch", first.cast("long") * F.when(F.length(first) == 10, US).otherwise(1000)),
    })
    year, month, day, hour = (F.col(c) for c in ("__y", "__m", "__day", "__h"))
    halves = F.col("__half").isin("a", "p")
    hour24 = F.when(halves, hour % 12 + F.when(F.col("__half") == "p", 12).otherwise(0)).otherwise(hour)
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    length = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    fine = (
        (year >= 1) & month.between(1, 12) & (day >= 1) & (day <= length) & (F.col("__min") < 60) & (F.col("__sec") < 60)
        & F.when(halves, hour.between(1, 12)).otherwise(hour < 24)
    )
    of_day = ((hour24 * 60 + F.col("__min")) * 60 + F.col("__sec")) * US + F.col("__us")
    base = base.withColumn("__local", F.when(fine, _days_from_civil(year, month, day) * DAY_US + of_day))
    told = F.col("__told")
    signed = r"^(?:utc|gmt)?([+\-\u2212])(\d{1,2}):?(\d{2})?$"
    minutes = _int(F.regexp_extract(told, signed, 2)) * 60 + F.coalesce(_int(F.regexp_extract(told, signed, 3)), F.lit(0))
    fixed = F.when(told.rlike(signed), F.when(F.regexp_extract(told, signed, 1) == "+", minutes).otherwise(-minutes)).otherwise(
        F.try_element_at(abbreviations, told).cast("long")
    )
    named = F.when(told.contains("/"), told).when(told.isNull(), F.lower(F.coalesce(F.trim(F.col(f"`{zone}`")), F.lit("UTC"))))
    # Yearly rules go on for ever: a later year is read as one of a full cycle of calendars that the table covers.
    new_year = _days_from_civil(year, F.lit(1), F.lit(1))
    cycle = F.create_map(*[F.lit(x) for pair in _calendars().items() for x in pair])
    back = (new_year - F.try_element_at(cycle, (F.pmod(new_year, F.lit(7)) * 2 + leap.cast("long")).cast("int"))) * DAY_US
    base = base.withColumn("__by_rule", F.when(year > LAST_YEAR, F.col("__local") - back).otherwise(F.col("__local")))
    local, told_local = F.col("__by_rule"), F.col("__local")
    decade = F.floor((local / (365.2425 * DAY_US) + 1970) / 10)
    decade = F.least(F.greatest(decade, F.lit(FIRST_YEAR // 10)), F.lit(LAST_YEAR // 10)).cast("int")
    base = base.withColumns({"__zone": named, "__fixed": F.when(told.isNotNull(), fixed), "__decade": decade})
    spans = offset_intervals(df.sparkSession).toDF("__k", "__d", "__spans")
    joined = base.join(F.broadcast(spans), (F.col("__zone") == F.col("__k")) & (F.col("__decade") == F.col("__d")), "left")
    near = F.filter("__spans", lambda s: (s["since"] <= local) & (local < s["jump_until"]))
    joined = joined.withColumn("__near", near)
    joined = joined.withColumn("__hits", F.filter("__near", lambda s: local < s["until"]))
    pick = F.array_max(F.transform(F.when(F.size("__hits") > 0, F.col("__hits")).otherwise(F.col("__near")), lambda s: s["offset_us"]))
    instant = F.coalesce(F.col("__epoch"), told_local - F.col("__fixed") * (60 * US))
    joined = joined.withColumns({"__instant": instant, "__by_zone": told_local - pick})
    result = F.coalesce("__instant", "__by_zone")
    label = (
        F.when(result.isNull(), "unreadable").when(F.col("__instant").isNotNull(), "instant")
        .when(F.size("__hits") > 1, "ambiguous").when(F.size("__hits") == 0, "nonexistent").otherwise("unique")
    )
    kept = [c for c in df.columns if c.lower() not in (out.lower(), status.lower())]  # results replace columns of their name
    return joined.select(*[F.col(f"`{c}`") for c in kept], result.alias(out), label.alias(status))


def article_instants(articles: DataFrame, profiles: DataFrame) -> DataFrame:
    """(article_id, source_id, published_at, published_utc_us, utc_status) of every article.

    profiles has one row per source and a fixed size; an article whose source has no profile is
    read as UTC, day first.
    """
    p = profiles.select(F.col("source_id").alias("__s"), F.col("time_zone").alias("__tz"), F.col("date_order").alias("__order"))
    a = articles.select(F.col("id").alias("article_id"), "source_id", "published_at")
    a = a.join(F.broadcast(p), F.col("source_id") == F.col("__s"), "left").drop("__s")
    return normalise_timestamps(a, "published_at", "__tz", "__order", out="published_utc_us").drop("__tz", "__order")
