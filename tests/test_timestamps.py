from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from presswork.operators.timestamps import article_instants, normalise_timestamps

US = 1_000_000


def us(*a, zone="UTC", fold=0, micro=0):
    return int(datetime(*a, tzinfo=ZoneInfo(zone), fold=fold).timestamp()) * US + micro


CASES = [
    ("2026-04-15T14:37:20+03:00", "Asia/Kolkata", "DMY", us(2026, 4, 15, 11, 37, 20), "instant"),
    ("2025-12-15T22:49", "Europe/Berlin", "DMY", us(2025, 12, 15, 22, 49, zone="Europe/Berlin"), "unique"),
    ("20250303T1747", "America/New_York", "MDY", us(2025, 3, 3, 17, 47, zone="America/New_York"), "unique"),
    ("26.09.2024 02:22", "Europe/Moscow", "DMY", us(2024, 9, 26, 2, 22, zone="Europe/Moscow"), "unique"),
    ("03/04/2025 5:07 PM", "America/New_York", "MDY", us(2025, 3, 4, 17, 7, zone="America/New_York"), "unique"),
    ("03/04/2025 05:07", "Europe/Berlin", "DMY", us(2025, 4, 3, 5, 7, zone="Europe/Berlin"), "unique"),
    ("12/01/2025 12:05 AM", "America/Los_Angeles", "MDY", us(2025, 12, 1, 0, 5, zone="America/Los_Angeles"), "unique"),
    ("1752936969", None, "DMY", 1752936969 * US, "instant"),
    ("1776484589842", None, "DMY", 1776484589842000, "instant"),
    ("20251106", "Europe/London", "DMY", us(2025, 11, 6, zone="Europe/London"), "unique"),
    ("15 апреля 2024, 00:48", "Europe/Moscow", "DMY", us(2024, 4, 15, 0, 48, zone="Europe/Moscow"), "unique"),
    ("31. März 2024, 02:04 Uhr", "Europe/Berlin", "DMY", us(2024, 3, 31, 1, 4), "nonexistent"),
    ("April 22, 2025 9:38 AM", "America/St_Johns", "MDY", us(2025, 4, 22, 9, 38, zone="America/St_Johns"), "unique"),
    ("Sat, 22 Mar 2025 12:58:56 +0200", "Asia/Kolkata", "DMY", us(2025, 3, 22, 10, 58, 56), "instant"),
    ("Tue, 08 Apr 2025 17:22:52 GMT", "Asia/Kolkata", "DMY", us(2025, 4, 8, 17, 22, 52), "instant"),
    ("2024-05-10 23:51:13 America/New_York", "Asia/Kolkata", "DMY", us(2024, 5, 10, 23, 51, 13, zone="America/New_York"), "unique"),
    ("2024-11-17 14:20 CEST", "Europe/Berlin", "DMY", us(2024, 11, 17, 12, 20), "instant"),
    ("2025-02-18 23:14:57,775", "UTC", "DMY", us(2025, 2, 18, 23, 14, 57, micro=775000), "unique"),
    ("2024-03-05T02:20:13.004297Z", "UTC", "DMY", us(2024, 3, 5, 2, 20, 13, micro=4297), "instant"),
    (" 2025-03-06T16:54  ", "UTC", "DMY", us(2025, 3, 6, 16, 54), "unique"),
    ("2024-10-27T02:30", "Europe/Berlin", "DMY", us(2024, 10, 27, 0, 30), "ambiguous"),
    ("2025-11-02 01:13:59", "America/New_York", "MDY", us(2025, 11, 2, 5, 13, 59), "ambiguous"),
    ("2026-13-04 08:00", "UTC", "DMY", None, "unreadable"),
    ("2025-02-30T10:15:00", "UTC", "DMY", None, "unreadable"),
    ("0000-00-00 00:00:00", "UTC", "DMY", None, "unreadable"),
    ("2025-01-01 25:00", "UTC", "DMY", None, "unreadable"),
    ("yesterday 10:15", "UTC", "DMY", None, "unreadable"),
    ("", "UTC", "DMY", None, "unreadable"),
    (None, None, None, None, "unreadable"),
    ("2025-01-01 10:00", "No/Such_Zone", "DMY", None, "unreadable"),
    ("2025-01-01 10:00", None, None, us(2025, 1, 1, 10), "unique"),
    ("x" * 100_000, "UTC", "DMY", None, "unreadable"),
]


def test_spellings_zones_and_changes(spark):
    rows = [(i, *c[:3], "keep") for i, c in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, text string, tz string, ord string, utc_us string")
    got = {r["i"]: r for r in normalise_timestamps(df, "text", "tz", "ord").collect()}
    for i, (text, _, _, want, kind) in enumerate(CASES):
        assert (got[i]["utc_us"], got[i]["utc_status"]) == (want, kind), text


@pytest.mark.parametrize("zone", ["Europe/Helsinki", "America/St_Johns", "Asia/Kolkata", "Australia/Lord_Howe", "Africa/Casablanca"])
def test_every_half_hour_of_a_year_agrees_with_the_zone_database(spark, zone):
    start = datetime(2025, 1, 1)
    walls = [start + timedelta(minutes=30 * k) for k in range(365 * 48)]
    df = spark.createDataFrame([(w.strftime("%Y-%m-%d %H:%M"), zone) for w in walls], "text string, tz string")
    got = {r["text"]: r["utc_us"] for r in normalise_timestamps(df, "text", "tz").collect()}
    for w in walls:
        # fold=0 is the first pass of a repeated time, and reads a skipped one by the offset before the jump.
        assert got[w.strftime("%Y-%m-%d %H:%M")] == int(w.replace(tzinfo=ZoneInfo(zone)).astimezone(timezone.utc).timestamp()) * US


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/Berlin", "Asia/Manila", "Africa/Monrovia", "Australia/Sydney"])
def test_early_and_late_years_agree_with_the_zone_database(spark, zone):
    walls = [datetime(y, m, 15, 12) for y in (1840, 1883, 1910, 1944, 1968, 1969, 1970, 2049, 2050, 2055, 2099, 2100, 2101, 2160, 2196, 2400, 9998) for m in (1, 3, 7, 10)]
    df = spark.createDataFrame([(w.strftime("%Y-%m-%d %H:%M"), zone) for w in walls], "text string, tz string")
    got = {r["text"]: r["utc_us"] for r in normalise_timestamps(df, "text", "tz").collect()}
    for w in walls:
        assert got[w.strftime("%Y-%m-%d %H:%M")] == us(w.year, w.month, 15, 12, zone=zone), w


def test_repeated_rows_clashing_columns_and_empty_tables(spark):
    arts = spark.createDataFrame([(1, 7, "2025-01-01 10:00", "a"), (1, 7, "2025-01-01 10:00", "a"), (2, 9, None, "b"), (3, None, "20250101", "c")], "id bigint, source_id bigint, published_at string, time_zone string")
    prof = spark.createDataFrame([(7, "Europe/Berlin", "DMY", "x")], "source_id bigint, time_zone string, date_order string, id string")
    out = sorted((r["article_id"], r["published_utc_us"]) for r in article_instants(arts, prof).where("published_utc_us is not null").collect())
    assert out == [(1, us(2025, 1, 1, 9)), (1, us(2025, 1, 1, 9)), (3, us(2025, 1, 1))]
    assert article_instants(arts.limit(0), prof.limit(0)).count() == 0
