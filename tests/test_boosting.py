"""Continuing boosting and the AUC of every round, against Spark's own boosting and against brute force."""

import math
import random
from pathlib import Path

import pytest
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from needledrop.operators.metrics import roc_auc
from needledrop.operators.staged import exported_nodes, running_sums, staged_auc, staged_margins, tree_column
from needledrop.plans.boosting import STEP, boost, cut_model
from needledrop.sources.store import shared_dir

PARAMS = {"n_estimators": 12, "learning_rate": 0.3, "max_depth": 3}


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(5)
    data = [(i, a := r.randrange(9), b := r.random(), int(a % 4 == 1 or b > 0.8 or r.random() < 0.15), i % 5 == 0) for i in range(1500)]
    df = spark.createDataFrame(data, "id long, a int, b double, y int, held boolean")
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).cache()


def brute_auc(pairs):
    pos, neg = ([s for y, s in pairs if y == k] for k in (1, 0))
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None


def margins_of(model, df):
    return [r[0] for r in model.transform(df).orderBy("id").select(vector_to_array("rawPrediction")[1]).collect()]


def test_boosting_grows_the_trees_of_spark_s_own(spark, rows):
    found = boost(rows, rows.where("held"), "y", PARAMS, seed=3, patience=50, step=5)
    own = GBTClassifier(labelCol="y", maxIter=12, stepSize=0.3, maxDepth=3, maxBins=256, seed=3, featureSubsetStrategy="1.0")
    whole = own.fit(rows.withColumn("y", F.col("y").cast("double")))
    assert found.rounds == max(range(1, 13), key=lambda i: found.aucs[i - 1])
    grown = boost(rows, rows.where("y = 1"), "y", PARAMS, seed=3, patience=50)  # no AUC, so no tree is cut off
    assert grown.rounds == 12 and grown.aucs == [None] * 12
    assert margins_of(grown.model, rows) == pytest.approx(margins_of(whole, rows), abs=1e-9)
    cut = cut_model(spark, whole, found.rounds)
    assert margins_of(found.model, rows) == pytest.approx(margins_of(cut, rows), abs=1e-9)
    assert cut.getNumTrees == found.rounds and list(cut.featureImportances) == pytest.approx(list(found.model.featureImportances))


def test_each_round_s_auc_is_that_of_the_cut_model(spark, rows):
    val = rows.where("held")
    found = boost(rows.where("NOT held"), val, "y", {**PARAMS, "n_estimators": 6}, seed=1, patience=50, step=4, grid=None)
    assert len(found.aucs) == 6
    for n, auc in enumerate(found.aucs[: found.rounds], 1):
        scored = cut_model(spark, found.model, n).transform(val).withColumn("s", vector_to_array("probability")[1])
        assert auc == pytest.approx(roc_auc(scored, "y", "s").first()["auc"], abs=1e-12)


def test_boosting_stops_when_the_auc_has_stopped_to_rise(rows):
    # Labels drawn by lot: what is learned does not hold on the val rows for long.
    lots = rows.withColumn("y", (F.xxhash64("id") % 2 == 0).cast("int"))
    found = boost(lots.where("NOT held"), lots.where("held"), "y", {**PARAMS, "n_estimators": 200}, seed=1, patience=5, step=5)
    assert len(found.aucs) < 60 and found.model.getNumTrees == found.rounds
    best = found.aucs[found.rounds - 1]
    assert best == max(found.aucs[: found.rounds + 5])


def test_steps_leave_no_tables_behind(spark, rows):
    folder = Path(shared_dir(spark).removeprefix("file:")) / spark.sparkContext.applicationId
    boost(rows, rows.where("held"), "y", {**PARAMS, "n_estimators": STEP + 1, "max_depth": 1}, seed=3, patience=50)
    assert not [p for p in folder.glob("boost-*") if any(p.iterdir())]


def test_model_saves_and_its_nodes_are_sql(spark, rows, tmp_path):
    model = boost(rows, rows.where("held"), "y", {**PARAMS, "n_estimators": 3}, seed=3, patience=50).model
    model.write().overwrite().save(str(tmp_path / "m"))
    again = GBTClassificationModel.load(str(tmp_path / "m"))
    assert margins_of(again, rows) == margins_of(model, rows)
    nodes = exported_nodes(spark, str(tmp_path / "m"))
    trees = [[n for n in nodes if n.tree == t] for t in range(model.getNumTrees)]
    predictions = [tree_column(t, [F.col("a"), F.col("b")]) for t in trees]
    staged = staged_margins(rows, predictions, list(model.treeWeights)).orderBy("id").collect()
    assert [r.margins[-1] for r in staged] == pytest.approx(margins_of(model, rows), abs=1e-12)
    assert all(len(r.margins) == model.getNumTrees for r in staged)


def test_staged_auc_equals_brute_force(spark):
    r = random.Random(8)
    data = [(r.choice([0, 1, 1, None]), [r.choice([-1.0, 0.0, 0.25, 2.0]) if r.random() < 0.9 else None for _ in range(3)]) for _ in range(300)]
    data += [(1, None), (0, [])] + [(1, [0.25, 9.0, 0.0])] * 600  # a hot score
    df = spark.createDataFrame(data, "label int, margins array<double>")
    found = {x["round"]: x for x in staged_auc(df).collect()}
    for n in range(3):
        pairs = [(y, m[n]) for y, m in data if y is not None and m and m[n] is not None]
        assert found[n + 1]["auc"] == pytest.approx(brute_auc(pairs), abs=1e-12) and found[n + 1]["error"] == 0
    assert staged_auc(df.where("label = 1")).select("auc").distinct().collect() == [(None,)]
    assert staged_auc(df.where("label > 1")).count() == 0


@pytest.mark.parametrize("grid", [2, 16, 4096])
def test_a_grid_keeps_the_auc_within_its_error(spark, grid):
    r = random.Random(grid)
    data = [(y := r.randrange(2), [r.gauss(0.4 * y, 1), r.gauss(0, 0.05)]) for _ in range(800)]
    df = spark.createDataFrame(data, "label int, margins array<double>")
    exact, rough = ({x["round"]: x for x in staged_auc(df, grid=g).collect()} for g in (None, grid))
    for n in (1, 2):
        assert abs(exact[n]["auc"] - rough[n]["auc"]) <= rough[n]["error"] + 1e-12
        cells = [math.floor(grid / (1 + math.exp(-2 * m[n - 1]))) for _, m in data]
        assert rough[n]["auc"] == pytest.approx(brute_auc([(y, c) for (y, _), c in zip(data, cells)]), abs=1e-12)


def test_running_sums(spark):
    row = spark.range(1).select(running_sums([F.lit(1), F.lit(2.5), F.lit(-1)], F.lit(10)).alias("s")).first()
    assert row.s == [11.0, 13.5, 12.5]
    many = spark.range(1).transform(lambda d: staged_margins(d, [F.lit(1.0)] * 60, [0.5] * 60)).first()
    assert many.margins == [0.5 * (i + 1) for i in range(60)]
