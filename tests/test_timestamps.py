"""Timestamps against the standard library, and the defined results of odd input."""

from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import timestamps as T


def us(*parts, zone="UTC", fold=0):
    return int(datetime(*parts[:6], tzinfo=ZoneInfo(zone), fold=fold).timestamp()) * 1_000_000 + (parts[6] if len(parts) > 6 else 0)


CASES = [
    ("2024:01:31 12:00:00", "Asia/Tokyo", None, us(2024, 1, 31, 12, 0, 0, zone="Asia/Tokyo")),
    ("  2024:1:3 9:05:07\x00", "UTC", None, us(2024, 1, 3, 9, 5, 7)),
    ("2024-01-31T12:00", "UTC", None, us(2024, 1, 31, 12, 0, 0)),
    ("2024-01-31T12:00:00.1234567Z", "Asia/Tokyo", None, us(2024, 1, 31, 12, 0, 0, 123456)),
    ("2024-01-31T12:00:00,5", "UTC", None, us(2024, 1, 31, 12, 0, 0, 500000)),
    ("2024-01-31T12:00:00+05:45[Asia/Kathmandu]", "UTC", None, us(2024, 1, 31, 6, 15, 0)),
    ("2024:01:31 12:00:00 -0330", "UTC", None, us(2024, 1, 31, 15, 30, 0)),
    ("2024-01-31 12:00:00 GMT+9", "UTC", None, us(2024, 1, 31, 3, 0, 0)),
    ("2024-01-31 12:00:00 GMT-3:30", "UTC", None, us(2024, 1, 31, 15, 30, 0)),
    ("20240131_120001", "UTC", None, us(2024, 1, 31, 12, 0, 1)),
    ("03/04/2024 01:02:03", "UTC", "dmy", us(2024, 4, 3, 1, 2, 3)),
    ("03/04/2024 01:02:03 PM", "UTC", "mdy", us(2024, 3, 4, 13, 2, 3)),
    ("12/04/2024 12:02:03 am", "UTC", "mdy", us(2024, 12, 4, 0, 2, 3)),
    ("03.04.2024 01:02:03", "UTC", "mdy", us(2024, 4, 3, 1, 2, 3)),
    ("Apr 2, 2023 2:55:15 am", "UTC", None, us(2023, 4, 2, 2, 55, 15)),
    ("Fri, 05 Feb 2021 20:42:56 +0100", "UTC", None, us(2021, 2, 5, 19, 42, 56)),
    ("10 May 2024 15:14:21 EDT", "America/New_York", None, us(2024, 5, 10, 19, 14, 21)),
    ("2024-07-01 12:00:00 IST", "Asia/Kolkata", None, us(2024, 7, 1, 6, 30, 0)),
    ("2024-07-01 12:00:00 UTC", "Asia/Kolkata", None, us(2024, 7, 1, 12, 0, 0)),
    ("1610306900", "UTC", None, 1610306900_000_000),
    ("1610506929454", "UTC", None, 1610506929454_000),
    ("1610507638541205", "UTC", None, 1610507638541205),
    # twice: the first; skipped: the offset before the change
    ("2024:10:27 02:30:00", "Europe/Berlin", None, us(2024, 10, 27, 2, 30, 0, zone="Europe/Berlin", fold=0)),
    ("2024:03:31 02:30:00", "Europe/Berlin", None, us(2024, 3, 31, 1, 30, 0)),
    ("2024-10-27 02:30:00 CET", "Europe/Berlin", None, us(2024, 10, 27, 1, 30, 0)),
    ("2024:04:07 01:45:00", "Australia/Lord_Howe", None, us(2024, 4, 7, 1, 45, 0, zone="Australia/Lord_Howe", fold=0)),
]
NONE = [None, "", "   ", "unknown", "2024:01:31", "31.01.2024", "0000:00:00 00:00:00", "2022-02-30 10:00:00", "2023:13:41 25:61:00", "2023-02-29T10:00:00Z", "2024-01-01 24:00:00", "2024-01-01 10:60:00", "13:00:00", "Foo 2, 2023 2:55:15 am", "13/13/2024 10:00:00", "01/01/2024 13:00:00 PM", "2024-01-01 10:00:00 +25:00", "x" * 100_000]


def test_spellings_and_zones(spark):
    rows = [(i, t, z, o) for i, (t, z, o, _) in enumerate(CASES)]
    got = dict(T.resolve_instants(spark.createDataFrame(rows, "i int, t string, z string, o string"), "t", "z", "o").select("i", "captured_us").collect())
    wrong = [(CASES[i][0], got[i], CASES[i][3]) for i in got if got[i] != CASES[i][3]]
    assert not wrong


def test_unusable_texts_are_null(spark):
    got = T.resolve_instants(spark.createDataFrame([(t, "UTC", None) for t in NONE], "t string, z string, o string"), "t", "z", "o").collect()
    assert [r["t"] for r in got if r["captured_us"] is not None] == [] and len(got) == len(NONE)


def test_unknown_zone_gives_null_and_extra_columns_stay(spark):
    df = spark.createDataFrame([("2024:01:01 10:00:00", "No/Where", "dmy", 1), ("2024:01:01 10:00:00Z", None, None, 2)], "t string, z string, o string, captured_us long")
    got = T.resolve_instants(df, "t", "z", "o").collect()
    assert sorted((r["captured_us"] or 0) for r in got) == [0, us(2024, 1, 1, 10, 0, 0)]
    with pytest.raises(ValueError):
        T.resolve_instants(df.withColumn("__wall", F.lit(1)), "t", "z", "o")


def test_days_from_civil_agrees_with_the_calendar(spark):
    df = spark.sql("select explode(sequence(date'0001-01-01', date'9999-12-31', interval 97 days)) d").withColumn("n", T.days_from_civil(F.year("d"), F.month("d"), F.dayofmonth("d")))
    assert df.where("n <> unix_date(d)").count() == 0


def test_capture_instants_joins_and_repeats(spark):
    photo = spark.createDataFrame([(1, "t", 1, "2024:01:01 10:00:00", "exif", "x"), (1, "t", 1, "2024:01:01 10:00:00", None, "x"), (2, "t", 1, "2024:01:01 10:00:00", " MTIME ", "x"), (3, None, None, "2024:01:01 10:00:00", "exif", "x"), (4, "t", 1, "no", "exif", "x"), (None, "t", 1, "2024:01:01 10:00:00", "exif", "x"), (5, None, None, "1610306900", None, "x")], "photo_id long, trip_id string, device_id int, captured_at string, timestamp_source string, clock_zone string")
    device = spark.createDataFrame([(1, "UTC", "dmy"), (1, "UTC", "dmy")], "device_id int, clock_zone string, date_order string")
    trip = spark.createDataFrame([("t", "Asia/Tokyo")], "trip_id string, host_zone string")
    got = dict(T.capture_instants(photo, device, trip).collect())
    assert got == {1: us(2024, 1, 1, 10, 0, 0), 2: us(2024, 1, 1, 1, 0, 0), 5: 1610306900_000_000}
    assert T.capture_instants(photo.limit(0), device.limit(0), trip.limit(0)).count() == 0


def test_abbreviations_mean_what_they_meant_at_their_time(spark):
    hours = {"2012-06-01 12:00:00 MSK": 8, "2015-06-01 12:00:00 MSK": 9, "2005-01-15 12:00:00 MSK": 9, "2005-07-15 12:00:00 MSD": 8, "1985-01-15 12:00:00 MSK": 9, "2011-03-27 01:59:59 MSK": 22, "2011-03-27 03:00:00 MSK": 23}
    df = spark.createDataFrame([(t, "Europe/Moscow", "dmy") for t in hours], "t string, z string, o string")
    got = {r["t"]: (r["captured_us"] // 3_600_000_000) % 24 for r in T.resolve_instants(df, "t", "z", "o").collect()}
    assert got == hours
