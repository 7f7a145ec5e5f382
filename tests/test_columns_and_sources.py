import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from needledrop.operators import columns as cols
from needledrop.operators.tracks import duration_stats, enrich, flatten_documents, join_coverage, track_features
from needledrop.operators.columns import reject_null_keys
from needledrop.operators.history import with_history
from needledrop.operators.split import with_time_split
from needledrop.sources.scans import parse_documents, read_catalogue, read_enriched, read_plays
from needledrop.sources.store import fingerprint, path_exists, settled, stored


def test_tab_separated_plays(spark, tmp_path, zone):
    path = tmp_path / "plays.txt"
    path.write_text(
        "obs_id\tts\tusername\tshuffle\textra\n"
        "1\t2024-03-10T02:30:00Z\ta\tTrue\tx\n"
        "2\t2024-03-10 02:30:00\t\tFalse\t\n"
        "3\t\tb\t\t\n"
    )
    zone("America/New_York")
    rows = read_plays(spark, str(path)).orderBy("obs_id").collect()
    moment = dt.datetime(2024, 3, 10, 2, 30)
    assert [tuple(r) for r in rows] == [
        (1, moment, "a", True, "x"),
        (2, moment, None, False, None),
        (3, None, "b", None, None),
    ]


def test_missing_words_and_quotes(spark, tmp_path):
    path = tmp_path / "plays.txt"
    path.write_text('obs_id\tconn_country\tmaster_metadata_track_name\n1\tNA\t"say ""hi""\tnow"\n2\tAR\tNone\n3\tnan\tNada\n')
    rows = [tuple(r) for r in read_plays(spark, str(path)).orderBy("obs_id").collect()]
    assert rows == [(1, None, 'say "hi"\tnow'), (2, "AR", None), (3, None, "Nada")]


def test_enriched_csv(spark, tmp_path):
    path = tmp_path / "enriched.csv"
    path.write_text(
        ",obs_id,ts,username,explicit,shuffle,offline_timestamp,release_year,fwdbtn\n"
        "0,1,2024-01-01T00:00:00Z,a,1,0,1700000000.0,NaN,1\n"
    )
    df = read_enriched(spark, str(path))
    assert df.columns[0] == "obs_id"
    assert tuple(df.first()) == (1, dt.datetime(2024, 1, 1), "a", 1, 0, 1.7e9, None, 1)


def test_null_keys_are_rejected(spark):
    df = spark.sql("SELECT 1L AS obs_id, CAST(NULL AS STRING) AS username, TIMESTAMP_NTZ'2024-01-01' AS ts")
    for step in (reject_null_keys, with_history, with_time_split):
        with pytest.raises(Exception, match="null in username"):
            step(df).collect()
    assert reject_null_keys(df.withColumn("username", F.lit("a"))).count() == 1


@pytest.fixture
def folder(tmp_path):
    full = {
        "id": "t1", "duration_ms": 100, "explicit": True, "popularity": 3, "track_number": 4,
        "available_markets": ["AR", "US"], "album": {"album_type": "single", "release_date": "2001-02"},
    }
    (tmp_path / "a.json").write_text(json.dumps(full, indent=2))
    (tmp_path / "b.JSON").write_text(json.dumps({"id": "t2"}))
    (tmp_path / "c.json").write_text(json.dumps({"id": "t3", "duration_ms": None, "album": None, "available_markets": None}))
    (tmp_path / "g.json").write_text(json.dumps({"id": "t4", "popularity": "high", "track_number": 7}))
    (tmp_path / "d.json").write_text('{"id": "broken", ')
    (tmp_path / "e.txt").write_text(json.dumps({"id": "text"}))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "f.json").write_text(json.dumps({"id": "below"}))
    return str(tmp_path)


def test_catalogue_folder(spark, folder):
    flat = {r["track_id"]: r for r in flatten_documents(read_catalogue(spark, folder)).collect()}
    assert set(flat) == {"t1", "t2", "t3", "t4"}
    assert tuple(flat["t1"])[1:] == (100, True, "3", "4", 2, "single", "2001-02")
    assert tuple(flat["t2"])[1:] == tuple(flat["t3"])[1:] == (0, False, "0", "0", 0, "", "")
    features = {r["track_id"]: r for r in track_features(flatten_documents(read_catalogue(spark, folder))).collect()}
    assert (features["t4"]["popularity"], features["t4"]["track_number"]) == (None, 7.0)
    assert (features["t1"]["popularity"], features["t1"]["available_markets_count"]) == (3.0, 2.0)


def test_track_statistics_come_from_train_tracks(spark):
    rows = [("a", 100), ("b", 300), ("c", 10_000), ("d", 0), ("e", -5)]
    tracks = spark.createDataFrame(rows, "id string, duration_ms long").selectExpr(
        "id", "duration_ms", "true AS explicit", "'1' AS popularity", "'1' AS track_number",
        "array('x') AS available_markets", "named_struct('album_type', 'y', 'release_date', '2000') AS album",
    )
    flat = flatten_documents(tracks)
    train = spark.createDataFrame([("a",), ("b",), ("d",)], "track_id string")
    stats = duration_stats(flat, train).first()
    assert (stats["mean_ms"], stats["n"]) == (200.0, 2)
    assert stats["p99_ms"] == pytest.approx(298.0)
    got = {r["track_id"]: r for r in track_features(flat, train, minutes=True).collect()}
    assert got["c"]["duration_normalized"] == 1.0
    assert got["d"]["duration_normalized"] == pytest.approx(200 / 298)
    assert got["d"]["duration_min"] == pytest.approx(200 / 60000)
    assert got["e"]["duration_normalized"] == pytest.approx(-5 / 298)
    assert got["a"]["release_year"] == 2000.0
    assert duration_stats(flat).first()["n"] == 3
    nothing = track_features(flat, train.where("track_id = 'd'")).first()
    assert nothing["duration_normalized"] == 0.0


def test_join_keeps_every_play_once(spark):
    plays = spark.createDataFrame([(1, "spotify:track:a"), (2, None), (3, "spotify:track:z")], "obs_id long, spotify_track_uri string")
    features = spark.createDataFrame([("a", 0.5), ("a", 0.25)], "track_id string, duration_normalized float")
    joined = enrich(plays, features)
    assert joined.count() == 3
    assert tuple(join_coverage(joined).first()) == (pytest.approx(1 / 3), 1, 3)
    assert enrich(plays, features, dedupe=False).count() == 4


def test_all_null_columns(spark):
    df = spark.createDataFrame([(1, None, None), (2, "x", None)], "a int, b string, c string")
    assert cols.all_null_columns(df) == ["c"]
    assert cols.drop_all_null_columns(df.where("a = 1"), decide_on=df).columns == ["a", "b"]
    assert cols.all_null_columns(df.where("a > 5")) == []


def test_constants_and_roles(spark):
    df = spark.createDataFrame([(None, None, 1.5), (True, "x", float("nan"))], "shuffle boolean, platform string, v double")
    assert [tuple(r) for r in cols.fill_constants(df).select("shuffle", "platform").collect()] == [(0, "unknown"), (1, "x")]
    assert cols.null_nans(df).where("v IS NULL").count() == 1
    assert cols.numeric_columns(df) == ["v"] and cols.categorical_columns(df) == ["shuffle", "platform"]
    assert cols.label_last(df, "shuffle").columns == ["platform", "v", "shuffle"]


def test_membership_and_distinct(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "k string")
    assert sorted(r["k"] for r in cols.distinct_values(df, "k").collect()) == ["a", "b"]
    assert cols.membership(df, None, "k").count() == 4
    assert cols.membership(df, spark.createDataFrame([("a",)], "k string"), "k").count() == 2


def test_bad_documents_are_skipped(spark):
    from pyspark.sql import types as T

    df = spark.createDataFrame([(1, '{"k": 3}'), (2, "{"), (3, None), (4, "{}")], "i int, t string")
    got = parse_documents(df, "t", T.StructType([T.StructField("k", T.IntegerType())]), ["i"]).orderBy("i").collect()
    assert [tuple(r) for r in got] == [(1, 3), (4, None)]


def test_fingerprint_and_stored_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "x int, y string")
    assert fingerprint(df).first() == fingerprint(df.orderBy("x").repartition(3)).first()
    assert fingerprint(df).first() != fingerprint(df.withColumn("y", F.lit("a"))).first()
    folder = str(tmp_path / "store")
    first = stored(df.groupBy("x").count(), "counts", [df], folder)
    assert sorted(map(tuple, first.collect())) == [(1, 1), (2, 2)]
    again = stored(df.groupBy("x").count(), "counts", [df.repartition(2)], folder)
    assert again.inputFiles() and set(again.inputFiles()) == set(first.inputFiles())
    other = stored(df.groupBy("x").count(), "counts", [df.where("x = 1")], folder)
    assert set(other.inputFiles()) != set(first.inputFiles())
    assert settled(df, "t").count() == 3
    assert not path_exists(spark, f"{folder}/nothing")


def test_values_of_another_kind_do_not_cost_the_document(spark, tmp_path):
    texts = {
        "a": '{"id": "a", "duration_ms": 1000.5, "explicit": 1}', "b": '{"id": "b", "duration_ms": "x", "explicit": 0}',
        "c": '{"id": "c", "duration_ms": 7, "explicit": true}', "d": "no json",
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    flat = {r.track_id: (r.duration_ms, r.explicit) for r in flatten_documents(read_catalogue(spark, str(tmp_path))).collect()}
    assert flat == {"a": (1000.5, True), "b": (0.0, False), "c": (7.0, True)}


def test_quoted_line_breaks_need_multi_line(spark, tmp_path):
    path = tmp_path / "plays.tsv"
    path.write_text('obs_id\tts\tusername\tplatform\n1\t2024-01-01T00:00:00Z\tu\t"two\nlines"\n')
    assert [(r.obs_id, r.platform) for r in read_plays(spark, str(path), multi_line=True).collect()] == [(1, "two\nlines")]
