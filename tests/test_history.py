"""Counts per play against loops written from their definitions."""

import re
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from needledrop.config import TRAILING_MINUTES
from needledrop.operators.history import HISTORY_COLUMNS, with_history
from needledrop.operators.split import with_time_split

def plays(seed=7, rows=600, start="1969-12-30 20:00:00"):
    """One user has more than half of the rows; coarse times make ties; the range spans the epoch."""
    rng = np.random.default_rng(seed)
    seconds = rng.integers(0, 4 * 86400, rows)
    seconds[::3] = seconds[::3] // 600 * 600
    seconds[:40] = 90_000
    users = np.where(rng.random(rows) < 0.55, "hot", rng.choice(["a", "b", "c", "once"], rows, p=[0.4, 0.3, 0.29, 0.01]))
    ts = pd.Timestamp(start) + pd.to_timedelta(seconds, unit="s") + pd.to_timedelta(rng.integers(0, 2, rows) * 250_000, unit="us")
    return pd.DataFrame({"obs_id": rng.permutation(rows) * 3, "username": users, "ts": ts})


def expected(pdf):
    out = {}
    for row in pdf.itertuples():
        mine = pdf[pdf.username == row.username]
        same_day = mine[mine.ts.dt.date == row.ts.date()]
        earlier = (same_day.ts < row.ts) | ((same_day.ts == row.ts) & (same_day.obs_id <= row.obs_id))
        bin_start = row.ts.floor("20min")
        counts = {
            "track_order_in_day": int(earlier.sum()),
            "songs_total_20min": int((mine.ts >= bin_start).sum()),
            "songs_bin_20min": int((mine.ts.dt.floor("20min") == bin_start).sum()),
        }
        for name, minutes in TRAILING_MINUTES.items():
            since = row.ts - pd.Timedelta(minutes=minutes)
            counts[name] = int(((mine.ts >= since) & (mine.ts < row.ts)).sum())
        out[row.obs_id] = counts
    return out


def frame(spark, pdf):
    return spark.createDataFrame(pdf.assign(ts=pdf.ts.astype(str)), "obs_id long, username string, ts string").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")
    )


def test_counts(spark):
    pdf = plays()
    got = {r["obs_id"]: r.asDict() for r in with_history(frame(spark, pdf)).collect()}
    want = expected(pdf)
    assert got.keys() == want.keys()
    for key, counts in want.items():
        assert {n: got[key][n] for n in HISTORY_COLUMNS} == counts


@pytest.mark.parametrize("zone_name", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_session_zone_does_not_matter(spark, zone, zone_name):
    pdf = plays(seed=3, rows=200, start="2024-03-09 12:00:00")
    df = frame(spark, pdf)
    zone(zone_name)
    got = {r["obs_id"]: r.asDict() for r in with_history(df).collect()}
    for key, counts in expected(pdf).items():
        assert {n: got[key][n] for n in HISTORY_COLUMNS} == counts


def test_row_order_and_partitions_do_not_matter(spark):
    df = frame(spark, plays(rows=300))
    a = with_history(df.repartition(1).orderBy("obs_id")).orderBy("obs_id").collect()
    b = with_history(df.repartition(7, "ts")).orderBy("obs_id").collect()
    assert a == b


def test_trailing_counts_have_one_exchange_and_one_sort(spark):
    df = with_history(frame(spark, plays(rows=50)), ("track_order_in_day", *TRAILING_MINUTES))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 1


def test_no_window_holds_the_plays_of_a_user(spark):
    """Windows by user alone see totals per day only, and no frame slides."""
    df = with_history(frame(spark, plays(rows=50)))
    windows = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x]
    assert windows
    for line in windows:
        assert re.search(r"windowspecdefinition\(username#\d+, _day#", line) or "sum(_n#" in line, line
        assert "RangeFrame, -" not in line


def test_many_plays_of_one_day_take_linear_time(spark):
    n = 40_000
    df = spark.range(n).select(
        F.col("id").alias("obs_id"), F.lit("one").alias("username"),
        (F.lit("2024-01-01 00:30:00").cast("timestamp") + F.make_dt_interval(secs=(F.col("id") * 2).cast("decimal(18,6)"))).alias("ts"),
    )
    began = time.time()
    rows = with_history(df, tuple(TRAILING_MINUTES)).agg(*[F.sum(c).alias(c) for c in TRAILING_MINUTES]).first()
    assert time.time() - began < 30
    for name, minutes in TRAILING_MINUTES.items():
        assert rows[name] == sum(min(i, minutes * 30) for i in range(n))


def test_split(spark):
    pdf = plays(seed=11)
    got = {r["obs_id"]: r["split"] for r in with_time_split(frame(spark, pdf)).collect()}
    want = {}
    for _, mine in pdf.groupby("username"):
        ordered = mine.assign(d=mine.ts.dt.date).sort_values(["d", "obs_id"])
        cut = max(1, int(np.floor(len(mine) * 0.8)))
        want |= {o: "train" if i < cut else "val" for i, o in enumerate(ordered.obs_id)}
    assert got == want
    assert set(got) == set(pdf.obs_id)


def test_user_with_one_play_is_train(spark):
    pdf = pd.DataFrame({"obs_id": [5], "username": ["x"], "ts": [pd.Timestamp("2024-01-01")]})
    assert with_time_split(frame(spark, pdf)).first()["split"] == "train"
