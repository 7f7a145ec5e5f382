import datetime as dt

import pytest
from pyspark.sql import functions as F

from needledrop.functions import (
    floor_div,
    label_flag,
    lenient_float,
    micros,
    platform_family,
    release_year,
    song_age,
    track_id,
    wall_clock,
    with_temporal_features,
)


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "text, family",
    [
        ("Windows 10", "windows"),
        ("WINDOWS android", "windows"),
        ("Android Chromecast", "android"),
        ("iOS 14", "ios"),
        ("some iPhone", "ios"),
        ("IPAD", "ios"),
        ("Linux", "linux"),
        ("osx", "osx"),
        ("Macintosh", "osx"),
        ("OS X 11", "osx"),
        ("google cast_tv", "cast"),
        ("WebPlayer", "webplayer"),
        ("web player", "webplayer"),
        ("the web", "webplayer"),
        ("playstation", "other"),
        ("", "other"),
        (None, "other"),
    ],
)
def test_platform(spark, text, family):
    assert one(spark, platform_family("v"), text) == family


@pytest.mark.parametrize(
    "text, year",
    [
        ("1999", 1999),
        ("2005-07", 2005),
        ("2012-07-04", 2012),
        ("", None),
        ("0000", None),
        ("2020-13", None),
        ("2021-02-30", None),
        ("soon", None),
        ("1500", None),
        ("1677-09-21", None),
        ("1677-09-22", 1677),
        ("2262-04-11", 2262),
        ("2262-04-12", None),
        (None, None),
    ],
)
def test_release_year(spark, text, year):
    assert one(spark, release_year("v"), text) == year


@pytest.mark.parametrize("text, number", [("3.5", 3.5), (" -2 ", -2.0), ("1e3", 1000.0), (".5", 0.5), ("inf", float("inf")), ("1d", None), ("0x1p3", None), ("1,5", None), ("x", None), ("", None), ("NaN", None), (None, None)])
def test_lenient_float(spark, text, number):
    assert one(spark, lenient_float("v"), text) == number


def test_track_id_is_literal_and_anywhere(spark):
    assert one(spark, track_id("v"), "a.spotify:track:b") == "a.b"
    assert one(spark, track_id("v"), None) is None


def test_label(spark):
    assert [one(spark, label_flag("v"), x) for x in ("fwdbtn", "trackdone", None)] == [1, 0, 0]


@pytest.mark.parametrize("released, age", [(2020.0, 4.0), (2030.0, 0.0), (None, 0.0), (float("nan"), 0.0)])
def test_song_age(spark, released, age):
    assert one(spark, song_age(F.lit(2024), "v"), released, "double") == age


@pytest.mark.parametrize("value, result", [(5, 0), (-1, -1), (-20, -1), (-21, -2), (20, 1)])
def test_floor_div(spark, value, result):
    assert one(spark, floor_div("v", 20), value, "long") == result


def test_temporal_parts_are_half_open(spark):
    def at(text):
        df = spark.sql(f"SELECT TIMESTAMP_NTZ'{text}' AS ts")
        return with_temporal_features(df, corrected=True).first()

    r = at("2024-01-06 05:59:59.999999")
    assert (r.day_of_week, r.is_weekend, r.is_morning, r.is_night, r.is_night_corrected) == ("Saturday", 1, 0, 1, 1)
    r = at("2024-01-08 06:00:00")
    assert (r.is_weekend, r.is_morning, r.is_night, r.is_night_corrected) == (0, 1, 1, 0)
    assert at("2024-01-08 12:00:00").is_afternoon == 1 and at("2024-01-08 12:00:00").is_morning == 0
    assert at("2024-01-08 18:00:00").is_evening == 1 and at("2024-01-08 22:00:00").is_evening == 0
    assert abs(at("2024-01-08 06:00:00").time_of_day_sin - 1) < 1e-12
    assert list(with_temporal_features(spark.sql("SELECT 1 AS x, TIMESTAMP_NTZ'2024-01-01' AS ts")).columns)[:3] == ["year", "month", "day"]


@pytest.mark.parametrize("zone_name", ["UTC", "America/New_York"])
def test_wall_clock_is_utc(spark, zone, zone_name):
    zone(zone_name)
    moment = dt.datetime(2024, 3, 10, 2, 30, 0, 123456)
    by_instant = wall_clock(spark.sql("SELECT TIMESTAMP'2024-03-10 02:30:00.123456Z' AS ts"))
    by_text = wall_clock(spark.sql("SELECT '2024-03-10T02:30:00.123456Z' AS ts"))
    plain = wall_clock(spark.sql("SELECT '2024-03-10 02:30:00.123456' AS ts"))
    for df in (by_instant, by_text, plain):
        assert df.schema["ts"].dataType.simpleString() == "timestamp_ntz"
        assert df.first()["ts"] == moment
        assert df.select(micros("ts").alias("u")).first()["u"] == 1710037800123456
    with pytest.raises(TypeError):
        wall_clock(spark.range(1).withColumnRenamed("id", "ts"))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2024-01-01 10:00:00+02:00", "2024-01-01 08:00:00"), ("2024-01-01T10:00:00-0300", "2024-01-01 13:00:00"),
        ("2024-01-01 10:00:00 America/New_York", "2024-01-01 15:00:00"), ("2024-01-01 10:00:00.5Z", "2024-01-01 10:00:00.5"),
        ("2024-01-01 10:00:00 UTC", "2024-01-01 10:00:00"), ("2024-01-01 10:00", "2024-01-01 10:00:00"), ("2024-01-01", "2024-01-01 00:00:00"),
        ("2024-01-01 10:00:00 nowhere", None), ("soon", None),
    ],
)
def test_text_with_a_zone_is_an_instant(spark, zone, text, want):
    zone("Asia/Kolkata")
    got = wall_clock(spark.createDataFrame([(text,)], "ts string")).select(F.col("ts").cast("string")).first()[0]
    assert got == want
