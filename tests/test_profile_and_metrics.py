import math

import numpy as np
import pandas as pd
import pytest

from needledrop.operators.profile import class_histogram

from needledrop.operators import metrics, profile

RNG = np.random.default_rng(2)


@pytest.fixture(scope="module")
def data():
    y = (RNG.random(400) < 0.3).astype(int)
    return pd.DataFrame({"y": y, "a": RNG.normal(y, 1.0), "same": 4.0, "steps": RNG.integers(0, 4, 400), "c": RNG.choice(["p", "q"], 400)})


def test_histogram_equals_numpy(spark, data):
    rows = profile.class_histogram(spark.createDataFrame(data), ["a", "same", "steps"], "y").collect()
    assert {r["column"] for r in rows} == {"a", "steps"}
    for column in ("a", "steps"):
        for k in (0, 1):
            mine = sorted((r for r in rows if r["column"] == column and r["target"] == k), key=lambda r: r["bin"])
            counts, edges = np.histogram(data[data.y == k][column], bins=50)
            assert [r["n"] for r in mine] == counts.tolist()
            assert [r["lower"] for r in mine] == pytest.approx(edges[:-1])
            assert sum(r["density"] * (r["upper"] - r["lower"]) for r in mine) == pytest.approx(1)


def test_constant_class_gets_a_widened_range(spark):
    df = spark.createDataFrame([(0, 2.0), (0, 2.0), (1, 1.0), (1, 3.0)], "y int, a double")
    rows = [r for r in profile.class_histogram(df, ["a"], "y").collect() if r["target"] == 0]
    assert (min(r["lower"] for r in rows), max(r["upper"] for r in rows)) == (1.5, 2.5)
    assert [r["bin"] for r in rows if r["n"]] == [25]
    assert {r["target"] for r in profile.class_kde(df, ["a"], "y").collect()} == {1}


def test_density_equals_the_formula(spark, data):
    spread = data.assign(far=np.where(np.arange(400) == 0, 1e4, data.a))
    rows = profile.class_kde(spark.createDataFrame(spread), ["a", "far"], "y").collect()
    for column in ("a", "far"):
        for k in (0, 1):
            v = spread[spread.y == k][column].to_numpy()
            h = len(v) ** -0.2 * v.std(ddof=1)
            grid = np.linspace(v.min(), v.max(), 200)
            want = np.exp(-0.5 * ((v[:, None] - grid) / h) ** 2).sum(0) / (len(v) * h * math.sqrt(2 * math.pi))
            mine = sorted((r for r in rows if r["column"] == column and r["target"] == k), key=lambda r: r["point"])
            assert [r["density"] for r in mine] == pytest.approx(want.tolist(), abs=1e-15)


def test_class_stats(spark, data):
    got = {(r["column"], r["target"]): r for r in profile.class_conditional_stats(spark.createDataFrame(data), ["a", "same"], "y").collect()}
    assert set(got) == {("a", 0), ("a", 1)}
    v = data[data.y == 1].a
    r = got[("a", 1)]
    assert (r["n"], r["n_distinct"]) == (len(v), v.nunique())
    assert (r["mean"], r["std"], r["median"]) == pytest.approx((v.mean(), v.std(), v.median()))


def test_class_without_rows_is_skipped(spark):
    df = spark.createDataFrame([(0, 1.0, "p"), (0, 2.0, "q")], "y int, a double, c string")
    assert profile.class_conditional_stats(df, ["a"], "y").count() == 0
    assert profile.class_category_counts(df, ["c"], "y").count() == 0


def test_roles(spark):
    df = spark.createDataFrame(
        [(1, 0, 2.0, True, "x", None), (2, 1, 3.0, False, "y", None)],
        "n int, bit int, v double, flag boolean, s string, nothing double",
    )
    got = dict(map(tuple, profile.column_roles(df, ("s",)).collect()))
    assert got == {"n": "numeric", "bit": "categorical", "v": "numeric", "flag": "categorical", "nothing": "categorical"}


def brute_auc(y, s):
    p, n = s[y == 1], s[y == 0]
    return ((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n))


@pytest.mark.parametrize("digits", [0, 1, 6])
def test_auc_equals_all_pairs(spark, digits):
    y = (RNG.random(500) < 0.4).astype(int)
    s = np.round(RNG.normal(y), digits)
    df = spark.createDataFrame(pd.DataFrame({"label": y, "score": s})).repartition(5)
    assert metrics.roc_auc(df).first()["auc"] == pytest.approx(brute_auc(y, s), abs=1e-12)


def test_auc_of_one_class_is_null(spark):
    assert metrics.roc_auc(spark.createDataFrame([(1, 0.5)], "label int, score double")).first()["auc"] is None


def test_report(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (1, 0)], "label int, prediction int")
    got = {r["label"]: tuple(r)[1:] for r in metrics.classification_report(df).collect()}
    assert got["0"] == pytest.approx((0.5, 0.5, 0.5, 2))
    assert got["1"] == pytest.approx((2 / 3, 2 / 3, 2 / 3, 3))
    assert got["accuracy"][0] == pytest.approx(0.6)
    assert got["macro avg"][2] == pytest.approx((0.5 + 2 / 3) / 2)
    assert got["weighted avg"][0] == pytest.approx((2 * 0.5 + 3 * 2 / 3) / 5)


def test_report_without_predicted_positives(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "label int, prediction int")
    got = {r["label"]: tuple(r)[1:] for r in metrics.classification_report(df).collect()}
    assert got["1"] == (0.0, 0.0, 0.0, 1)


def test_failed_trials_cannot_win(spark):
    rows = [(0, 0.7, [0.7]), (1, None, []), (2, 0.9, [0.8, 1.0]), (3, 0.9, [0.9])]
    df = spark.createDataFrame(rows, "tid int, mean_cv_score double, fold_scores array<double>")
    got = metrics.trial_summary(df, 2).collect()
    assert [(r["tid"], r["is_best"]) for r in got] == [(2, True), (3, False)]
    assert got[0]["std_cv_score"] == pytest.approx(0.1) and got[0]["loss"] == -0.9


@pytest.mark.parametrize("values", [[i / 100 for i in range(101)], list(range(35)), list(range(56)), list(range(69)), [0.1 * i for i in range(77)]])
def test_histogram_puts_values_on_edges_where_numpy_does(spark, values):
    rows = spark.createDataFrame([(float(v), t) for v in values for t in (0, 1)], "v double, t int")
    found = {r.bin: r.n for r in class_histogram(rows, ["v"], "t").where("target = 1").collect()}
    assert [found[b] for b in range(50)] == list(np.histogram(values, 50)[0])
