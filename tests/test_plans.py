"""The entry points on a small made-up folder of plays and documents."""

import json
import re
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from needledrop.operators.rates import with_user_rate
from needledrop.operators.tracks import enrich
from needledrop.plans.dataset import build_dataset, feature_table, load_frames
from needledrop.plans.runs import run_full, run_profile, run_short, write_profile
from needledrop.plans.search import draw, search, trial_frame
from needledrop.plans.boosting import best_round
from needledrop.plans.training import classifier, encode, fit_with_patience
from needledrop.sources.sinks import load_model, prediction_path, prediction_rows
from needledrop.sources.store import settled

SMALL = {"n_estimators": 4, "learning_rate": 0.3, "max_depth": 3, "min_child_weight": 1, "subsample": 1.0, "colsample_bytree": 1.0}


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    rng = np.random.default_rng(1)
    root = tmp_path_factory.mktemp("inputs")
    (root / "catalogue").mkdir()
    for i in range(12):
        doc = {"id": f"t{i}", "duration_ms": 1000 * i, "explicit": i % 2 == 0, "popularity": i, "track_number": 1,
               "available_markets": ["AR"] * i, "album": {"album_type": "album" if i % 3 else "single", "release_date": str(2000 + i)}}
        (root / "catalogue" / f"{i}.json").write_text(json.dumps(doc))

    def plays(rows, first, with_label):
        track = rng.integers(0, 14, rows)
        users = rng.choice(["hot", "u1", "u2", "u3"], rows, p=[0.5, 0.2, 0.2, 0.1]).astype(object)
        if not with_label:
            users[0] = "new user"
        pdf = pd.DataFrame({
            "obs_id": np.arange(rows) + first,
            "ts": (pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 20 * 86400, rows)) + first, unit="s")).strftime("%Y-%m-%dT%H:%M:%SZ"),
            "username": users, "platform": rng.choice(["Android", "iOS", None], rows), "conn_country": rng.choice(["AR", "US"], rows),
            "ip_addr": "1.1.1.1", "master_metadata_track_name": "n", "master_metadata_album_artist_name": "a",
            "master_metadata_album_album_name": "b", "spotify_track_uri": [f"spotify:track:t{t}" for t in track],
            "episode_name": None, "episode_show_name": None, "spotify_episode_uri": None, "audiobook_title": None,
            "shuffle": rng.choice(["True", "False", None], rows), "offline": "False", "incognito_mode": "False", "offline_timestamp": None,
        })
        if with_label:
            skip = (track % 3 == 0) | (rng.random(rows) < 0.1)
            pdf["reason_end"] = np.where(skip, "fwdbtn", "trackdone")
        return pdf

    plays(500, 0, True).to_csv(root / "train.txt", sep="\t", index=False)
    plays(120, 10_000, False).to_csv(root / "test.txt", sep="\t", index=False)
    return {"train": str(root / "train.txt"), "test": str(root / "test.txt"), "catalogue": str(root / "catalogue")}


@pytest.fixture(scope="module")
def frames(spark, inputs, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("enriched"))
    return load_frames(spark, inputs["train"], inputs["test"], inputs["catalogue"], folder)


def test_enriched_tables_are_kept_by_content(spark, inputs, tmp_path):
    first = load_frames(spark, inputs["train"], inputs["test"], inputs["catalogue"], str(tmp_path))
    again = load_frames(spark, inputs["train"], inputs["test"], inputs["catalogue"], str(tmp_path))
    assert sorted(first[0].inputFiles()) == sorted(again[0].inputFiles())
    assert first[0].columns[-1] == "fwdbtn" and "reason_end" not in first[0].columns
    assert first[0].where("shuffle IS NULL OR platform IS NULL").count() == 0
    # Other plays in the same folder are another table.
    other = pd.read_csv(inputs["train"], sep="\t").iloc[:300]
    other.to_csv(tmp_path / "other.txt", sep="\t", index=False)
    moved = load_frames(spark, str(tmp_path / "other.txt"), inputs["test"], inputs["catalogue"], str(tmp_path))
    assert moved[0].count() == 300 and first[0].count() == 500


def test_runs_start_from_a_joined_pair(spark, frames, tmp_path):
    pair = []
    for name, df in zip(("train", "test"), frames):
        pair.append(str(tmp_path / f"{name}.csv"))
        df.toPandas().to_csv(pair[-1], index=False)
    target = str(tmp_path / "own name")
    done = run_short(spark, "gone", "gone", "gone", str(tmp_path), SMALL, enriched=pair, predictions=target)
    assert done["path"] == target and spark.read.option("header", True).csv(target).count() == 120


def test_patience_bridges_a_pause():
    pause = [1.0, 0.9, *[0.95] * 48, 0.8, *[0.85] * 60]
    assert best_round(pause, 50) == 51
    assert best_round(pause, 10) == 2
    assert best_round([1.0, 2.0], 50) == 1


def test_trial_keeps_the_rounds_it_scored(spark, frames):
    encoded = encode(settled(build_dataset(*frames), "dataset"))
    model, rounds = fit_with_patience(encoded, {**SMALL, "n_estimators": 8}, patience=2)
    assert 1 <= rounds <= 8 and model.getNumTrees == rounds


def test_test_rows_do_not_move_train_rows(spark, frames):
    train, test = frames

    def train_part(t):
        df = build_dataset(train, t)
        return df.where("split <> 'test'").select(*sorted(df.columns)).orderBy("obs_id").collect()

    moved = test.withColumn("ts", F.expr("ts + INTERVAL '100' DAY")).withColumn("popularity", F.lit(1e6).cast("float"))
    assert train_part(test) == train_part(moved)


def test_frames_from_a_kept_catalogue_are_the_same(spark, inputs, frames, tmp_path):
    for _ in range(2):
        found = load_frames(spark, inputs["train"], inputs["test"], inputs["catalogue"], catalogue_store=str(tmp_path))
        for got, want in zip(found, frames):
            assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_counts_across_frames_see_the_other_frame(spark):
    from needledrop.operators.history import with_history
    from needledrop.plans.dataset import FRAME, PAST_COUNTS, history_features

    rows = [(i, "hot" if i % 3 else "a", datetime(2024, 1, 1 + i // 40, i % 24, i % 60), "train" if i < 90 else "test") for i in range(120)]
    df = spark.createDataFrame(rows, f"obs_id long, username string, ts timestamp_ntz, {FRAME} string")
    order = ["obs_id", *PAST_COUNTS]
    got = history_features(df, PAST_COUNTS, learn_rate=False, across_frames=True)
    assert sorted(map(tuple, got.select(*order).collect())) == sorted(map(tuple, with_history(df, PAST_COUNTS).select(*order).collect()))
    apart = history_features(df, PAST_COUNTS, learn_rate=False)
    assert sorted(map(tuple, got.select("obs_id", "split").collect())) == sorted(map(tuple, apart.select("obs_id", "split").collect()))
    assert sorted(map(tuple, got.select(*order).collect())) != sorted(map(tuple, apart.select(*order).collect()))
    with pytest.raises(ValueError):
        history_features(df, PAST_COUNTS, cache="/nowhere", across_frames=True)


def test_new_user_gets_the_global_rate(spark, frames):
    df = build_dataset(*frames)
    rate = df.where("split = 'train'").agg(F.avg("fwdbtn")).first()[0]
    assert df.where("username = 'new user'").first()["per_user_skip_rate"] == pytest.approx(rate)


@pytest.mark.parametrize("join", ["enrich", "rate"])
def test_hot_join_keys_are_split(spark, join):
    knobs = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    }
    before = {k: spark.conf.get(k, None) for k in knobs}
    for k, v in knobs.items():
        spark.conf.set(k, v)
    try:
        ids = spark.range(40_000).repartition(8)
        hot = F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500))
        if join == "enrich":
            features = spark.range(500).select(F.concat(F.lit("k"), "id").alias("track_id"), F.rand(1).alias("duration_normalized"))
            df = enrich(ids.select(F.col("id").alias("obs_id"), hot.alias("track_id"), F.md5(F.col("id").cast("string")).alias("x")), features)
        else:
            rows = ids.select(F.col("id").alias("obs_id"), hot.alias("username"), (F.col("id") % 2).alias("fwdbtn"), F.lit("train").alias("split"))
            df = with_user_rate(rows)
        df.write.format("noop").mode("overwrite").save()
        df.collect()
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_feature_table_layout(spark, frames):
    table = feature_table(frames[0])
    assert table.columns[:4] == ["year", "month", "day", "day_of_week"] and table.columns[-1] == "fwdbtn"
    assert not {"ts", "track_id", "ip_addr", "spotify_track_uri"} & set(table.columns)


def test_short_run(spark, inputs, tmp_path):
    done = run_short(spark, inputs["train"], inputs["test"], inputs["catalogue"], str(tmp_path), SMALL)
    assert 0.6 < done["auc"] <= 1
    written = spark.read.option("header", True).option("inferSchema", True).csv(done["path"])
    assert written.columns == ["obs_id", "target"] and written.count() == 120
    assert written.where("target < 0 OR target > 1").count() == 0
    assert written.agg(F.min("obs_id"), F.max("obs_id")).first() == (10_000, 10_119)
    assert re.search(r"submission_short_auc_\d\.\d{4}_\d{8}_\d{6}\.csv$", done["path"])
    assert {r["label"] for r in done["report"].collect()} == {"0", "1", "accuracy", "macro avg", "weighted avg"}
    top = done["importance"].collect()
    assert top == sorted(top, key=lambda r: (-r["importance"], r["feature"])) and len(top) <= 20
    model = load_model(spark, f"{tmp_path}/models/best_model")
    assert len(model.stages) == 2 and model.stages[1].getNumTrees == SMALL["n_estimators"]
    with pytest.raises(FileNotFoundError):
        load_model(spark, f"{tmp_path}/models/none")


def test_full_run(spark, inputs, tmp_path):
    done = run_full(
        spark, inputs["train"], inputs["test"], inputs["catalogue"], str(tmp_path), n_trials=2, estimators=(2, 3), first=SMALL
    )
    found = done["search"]
    scores = [t["mean_cv_score"] for t in found["tuning_results"]]
    assert found["best_score"] == max(scores) and len(scores) == 2
    assert 0.6 < done["auc"] <= 1
    document = json.loads(spark.read.text(done["search_files"][0]).first()[0])
    assert document["total_trials"] == 2 and document["best_params"] == found["best_params"]
    summary = [r[0] for r in spark.read.text(done["search_files"][1]).collect()]
    assert "trials=2" in summary
    assert done["top_trials"].first()["mean_cv_score"] == max(scores)


def test_search_reports_when_every_trial_fails(spark, frames):
    class Broken:
        rows = spark.range(1)
        encoder = None

    with pytest.raises(RuntimeError, match="every trial failed"):
        search(Broken(), n_trials=1)


def test_draws_are_seeded_and_inside_the_space():
    import random

    a = [draw(random.Random(420)) for _ in range(3)]
    assert a[0] == a[1]
    rng = random.Random(1)
    for _ in range(200):
        p = draw(rng)
        assert 0.005 <= p["learning_rate"] <= 0.2 and 3 <= p["max_depth"] <= 10 and 1 <= p["min_child_weight"] <= 20
        assert 0.6 <= p["subsample"] <= 1 and 0.6 <= p["colsample_bytree"] <= 1


def test_classifier_parameters(spark):
    gbt = classifier(SMALL)
    assert (gbt.getMaxIter(), gbt.getStepSize(), gbt.getMaxDepth(), gbt.getSeed()) == (4, 0.3, 3, 420)


def test_trial_frame(spark):
    t = [{"tid": 0, "params": {"max_depth": 3}, "mean_cv_score": None, "fold_scores": [], "error": "no"}]
    assert trial_frame(spark, t).first()["error"] == "no"


def test_prediction_paths():
    now = datetime(2024, 5, 6, 7, 8, 9)
    assert prediction_path(0.83304, "full", None, now) == "submissions/submission_full_auc_0.8330_20240506_070809.csv"
    assert prediction_path(0.5, "short", "x", now).endswith("_070809_x.csv")
    assert prediction_path() == "last_submission.csv"


def test_rows_without_ids_need_an_order(spark):
    df = spark.createDataFrame([(5, 0.1), (2, 0.9)], "k long, target double")
    assert sorted(map(tuple, prediction_rows(df, None, "k").collect())) == [(0, 0.9), (1, 0.1)]
    with pytest.raises(ValueError):
        prediction_rows(df, None)


def test_profile_run(spark, frames):
    parts = run_profile(frames[0])
    assert parts["roles"]["popularity"] == "numeric" and parts["roles"]["shuffle"] == "categorical"
    assert parts["shape"].first()["rows"] == 500
    assert {r["fwdbtn"] for r in parts["target"].collect()} == {0, 1}
    for name in ("stats", "histogram", "density", "categories"):
        assert parts[name].count() > 0


def test_every_report_of_a_profile_is_written(spark, frames, tmp_path):
    written = write_profile(run_profile(frames[0]), str(tmp_path))
    density = spark.read.parquet(written["density"])
    assert density.groupBy("column", "target").count().agg(F.min("count"), F.max("count")).first() == (200, 200)
    assert {"target", "shape", "stats", "histogram", "density", "categories"} < set(written)
