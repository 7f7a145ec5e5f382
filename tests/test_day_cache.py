"""Counts kept by day, and the rate that knows no own label."""

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from needledrop.config import RATE_COLUMN
from needledrop.operators.history import with_history
from needledrop.operators.rates import with_past_rate
from needledrop.plans.dataset import PAST_COUNTS, build_dataset
from needledrop.sources.day_cache import DAY_COUNTS, cached_history

FIRST = dt.datetime(2024, 3, 1)
DAY = (FIRST - dt.datetime(1970, 1, 1)).days


def plays(spark, days, seed=1, more=()):
    r = random.Random(seed)
    rows = []
    for day in days:
        r.seed(day)
        rows += [(1000 * day + i, r.choice(["hot", "hot", "a", "b"]), FIRST + dt.timedelta(days=day, minutes=r.randrange(1440)), "x") for i in range(60)]
    return spark.createDataFrame(rows + list(more), "obs_id long, username string, ts timestamp_ntz, other string")


def same(found, df):
    order = ["obs_id", "username", "ts", *DAY_COUNTS]
    want = with_history(df, DAY_COUNTS).select(*order)
    assert sorted(map(tuple, found.select(*order).collect())) == sorted(map(tuple, want.collect()))


def test_only_changed_days_and_the_day_after_are_counted(spark, tmp_path):
    folder = str(tmp_path / "cache")
    first = plays(spark, range(5))
    found, counted = cached_history(first, folder)
    same(found, first)
    assert counted == [DAY + d for d in range(5)]
    # Nothing new; rows in another order and another column are no change.
    found, counted = cached_history(first.withColumn("other", F.lit("y")).orderBy(F.desc("obs_id")), folder)
    same(found, first)
    assert counted == []
    # One day is appended in a gap, so the day after it has new plays to look back on.
    gap = plays(spark, [0, 1, 2, 3, 4, 6, 7])
    assert cached_history(gap, folder)[1] == [DAY + 6, DAY + 7]
    whole = plays(spark, range(8))
    found, counted = cached_history(whole, folder)
    same(found, whole)
    assert counted == [DAY + 5, DAY + 6]
    written = sorted(p.name for p in Path(folder).glob("run-*/day=*") if p.stat().st_mtime > 0)
    assert written.count(f"day={DAY + 5}") == 1 and written.count(f"day={DAY + 6}") == 2 and written.count(f"day={DAY + 7}") == 1
    # A late play changes its own day and the next.
    late = plays(spark, range(8), more=[(99, "a", FIRST + dt.timedelta(days=2, minutes=3), "z")])
    found, counted = cached_history(late, folder)
    same(found, late)
    assert counted == [DAY + 2, DAY + 3]
    # Rows that go, and a return to what was there before.
    assert cached_history(whole, folder)[1] == []
    less = whole.where("obs_id <> 4000")
    found, counted = cached_history(less, folder)
    same(found, less)
    assert counted == [DAY + 4, DAY + 5]


def test_a_run_that_died_counts_for_nothing(spark, tmp_path):
    folder = str(tmp_path / "cache")
    df = plays(spark, range(3))
    cached_history(df.where("obs_id < 1000"), folder)
    # Files that the index does not name.
    stray = df.withColumn("day", F.lit(DAY + 1)).withColumns({c: F.lit(7) for c in DAY_COUNTS})
    stray.write.partitionBy("day").parquet(f"{folder}/run-stray")
    same(cached_history(df, folder)[0], df)


def test_cache_of_odd_tables(spark, tmp_path):
    empty = plays(spark, [])
    assert cached_history(empty, str(tmp_path / "e"))[0].count() == 0
    with pytest.raises(ValueError, match="songs_total_20min"):
        cached_history(empty, str(tmp_path / "e"), ("songs_total_20min",))
    with pytest.raises(Exception, match="null in username"):
        cached_history(plays(spark, [1], more=[(5, "a", None, "x")]), str(tmp_path / "n"))
    keyed = plays(spark, range(2)).withColumn("frame", F.when(F.col("obs_id") % 2 == 0, "train").otherwise("test"))
    found, _ = cached_history(keyed, str(tmp_path / "k"), ("songs_total_1h",), ["username", "frame"])
    want = with_history(keyed, ("songs_total_1h",), ["username", "frame"])
    assert sorted(map(tuple, found.select("obs_id", "songs_total_1h").collect())) == sorted(map(tuple, want.select("obs_id", "songs_total_1h").collect()))


def test_dataset_with_a_cache_equals_one_without(spark, tmp_path):
    label = F.when(F.col("obs_id") % 3 == 0, 1).otherwise(0).alias("fwdbtn")
    extra = [F.lit("Android").alias("platform"), F.lit("n").alias("master_metadata_track_name"), F.lit(2001.0).alias("release_year")]
    train = plays(spark, range(4)).select("*", label, *extra)
    test = plays(spark, range(2, 6)).select("*", *extra)
    want = build_dataset(train, test, counts=PAST_COUNTS)
    for _ in range(2):
        found = build_dataset(train, test, counts=PAST_COUNTS, cache=str(tmp_path / "c"))
        order = sorted(want.columns)
        assert sorted(found.columns) == order
        assert sorted(map(str, found.select(*order).collect())) == sorted(map(str, want.select(*order).collect()))


def test_past_rate_equals_brute_force(spark):
    r = random.Random(4)
    rows = [(i, "hot" if i % 3 else r.choice("abc"), FIRST + dt.timedelta(minutes=r.randrange(4 * 1440)), r.choice([0, 1, 1, None])) for i in range(400)]
    rows += [(1000 + i, "tie", FIRST + dt.timedelta(days=1), i % 2) for i in range(5)] + [(2000, "new", FIRST + dt.timedelta(days=9), None)]
    df = spark.createDataFrame(rows, "obs_id long, username string, ts timestamp_ntz, fwdbtn int")
    found = {x["obs_id"]: x[RATE_COLUMN] for x in with_past_rate(df).collect()}
    for i, user, ts, _ in rows:
        own = [y for j, u, t, y in rows if u == user and (t, j) < (ts, i) and y is not None]
        days = [y for _, _, t, y in rows if t.date() < ts.date() and y is not None]
        known = own or days
        assert found[i] == (pytest.approx(sum(known) / len(known)) if known else None)
    # Its own label takes no part.
    turned = with_past_rate(df.withColumn("fwdbtn", F.when(F.col("obs_id") == 2000, 1).otherwise(F.col("fwdbtn"))))
    assert turned.where("obs_id = 2000").first()[RATE_COLUMN] == found[2000]
    assert with_past_rate(df.limit(0)).count() == 0
