"""Counts of a stream against those of a table."""

import datetime as dt
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from needledrop.config import BIN_COLUMN
from needledrop.operators.history import with_bin_counts
from needledrop.streaming.bins import read_play_stream, with_streamed_bin_counts, write_bin_counts
from needledrop.workload import views

FIRST = dt.datetime(2024, 3, 1)
KINDS = pa.schema([("obs_id", pa.int64()), ("username", pa.string()), ("ts", pa.timestamp("us")), ("other", pa.string())])


def put(folder, number, rows):
    """A file of the stream; files are taken by their time."""
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{number:03}.parquet"
    pq.write_table(pa.Table.from_pylist([dict(zip(KINDS.names, r)) for r in rows], KINDS), path)
    os.utime(path, (1_700_000_000 + number * 10,) * 2)


def run(spark, base, delay="30 minutes"):
    schema = spark.read.parquet(f"{base}/in").schema
    counted = with_streamed_bin_counts(read_play_stream(spark, f"{base}/in", schema, 1), delay)
    query = write_bin_counts(counted, f"{base}/out", f"{base}/checkpoint")
    query.awaitTermination(240)
    assert query.exception() is None
    dropped = sum(s.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for s in p["stateOperators"])
    return spark.read.parquet(f"{base}/out"), dropped


def far(day):
    """A play that closes all bins of the days before."""
    return (10**6 + day, "clock", FIRST + dt.timedelta(days=day), "end")


def test_file_batches_equal_the_table(spark, tmp_path):
    r = random.Random(2)
    plays = [(i, r.choice(["hot", "hot", "a", "b"]), FIRST + dt.timedelta(minutes=r.randrange(0, 600), seconds=r.choice([0, 0, 59])), "x") for i in range(600)]
    # Late by less than the delay: times are shuffled inside 25 minutes.
    plays.sort(key=lambda p: p[2] + dt.timedelta(minutes=random.Random(p[0]).randrange(25)))
    plays.append(plays[-1])  # a repeated row is a play of its own
    base = str(tmp_path)
    for n in range(3):
        put(f"{base}/in", n, plays[n * 100 : (n + 1) * 100])
    first, dropped = run(spark, base)
    early = first.count()
    assert 0 < early < 300 and dropped == 0
    # The same checkpoint goes on where it stopped, with what was open.
    put(f"{base}/in", 3, plays[300:])
    put(f"{base}/in", 4, [far(3)])
    done, dropped = run(spark, base)
    assert dropped == 0
    columns = ["obs_id", "username", "ts", "other", BIN_COLUMN]
    table = spark.createDataFrame(plays, "obs_id long, username string, ts timestamp_ntz, other string")
    # Times of equal text: the stream keeps the columns as they came.
    want = sorted(map(tuple, with_bin_counts(table).select(*columns).collect()))
    assert sorted(map(tuple, done.select(*columns).collect())) == want


def test_events_as_a_stream_equal_the_registered_query(spark, tmp_path):
    plays = views.plays(spark, "/root/testdata/sf0.001").select("obs_id", "username", "ts")
    base, kinds = str(tmp_path), plays.schema
    plays.coalesce(1).write.parquet(f"{base}/in")
    closing = spark.createDataFrame([(-1, -1, dt.datetime(2030, 1, 1))], kinds)
    closing.write.mode("append").parquet(f"{base}/in")
    found, dropped = run(spark, base, "60 days")
    assert dropped == 0
    want = sorted(map(tuple, with_bin_counts(plays).select("obs_id", BIN_COLUMN).collect()))
    assert sorted(map(tuple, found.select("obs_id", BIN_COLUMN).collect())) == want


def test_plays_after_their_bin_was_closed_are_counted_as_dropped(spark, tmp_path):
    base = str(tmp_path)
    put(f"{base}/in", 0, [(1, "a", FIRST, "x"), (2, "a", FIRST + dt.timedelta(minutes=5), "x")])
    put(f"{base}/in", 1, [far(1)])
    put(f"{base}/in", 2, [far(2)])
    put(f"{base}/in", 3, [(3, "a", FIRST + dt.timedelta(minutes=6), "late")])
    put(f"{base}/in", 4, [far(3)])
    found, dropped = run(spark, base)
    assert sorted((r["obs_id"], r[BIN_COLUMN]) for r in found.where("username = 'a'").collect()) == [(1, 2), (2, 2)]
    assert dropped >= 1


def test_rows_without_a_user_fail_the_stream(spark, tmp_path):
    base = str(tmp_path)
    put(f"{base}/in", 0, [(1, None, FIRST, "x")])
    with pytest.raises(Exception, match="null|username"):
        run(spark, base)
