import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from needledrop.operators.numbering import with_sequential_id
from needledrop.operators.quantiles import exact_quantiles, smallest_modes

RNG = np.random.default_rng(5)
SAMPLES = {
    "normal": RNG.normal(size=3000),
    "close together": 1e6 + RNG.random(3000) * 1e-6,
    "long tail": np.exp(RNG.normal(0, 40, 2001)),
    "both signs with ties": np.round(RNG.normal(size=2500), 1),
    "one value": np.full(17, 3.25),
    "two values": np.array([1.0, 2.0]),
    "single": np.array([-7.5]),
    "tiny and huge": np.array([5e-324, -5e-324, 0.0, 1e308, -1e308, 1.0]),
    "hot value": np.concatenate([np.zeros(5000), RNG.random(100)]),
}


@pytest.mark.parametrize("name", SAMPLES)
def test_equals_numpy(spark, name):
    values = SAMPLES[name]
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    probs = [0.0, 0.25, 0.5, 0.99, 1.0]
    got = {r["prob"]: r["value"] for r in exact_quantiles(df, ["v"], probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.percentile(values, 100 * p), rel=1e-12, abs=1e-300)


def test_groups_nulls_and_nan(spark):
    rows = [(0, 1.0, None), (0, 3.0, None), (1, float("nan"), 5.0), (1, 8.0, None), (None, 2.0, None)]
    df = spark.createDataFrame(rows, "g int, a double, b double")
    got = {(r["g"], r["column"]): r["value"] for r in exact_quantiles(df, ["a", "b"], [0.5], ["g"]).collect()}
    assert got == {(0, "a"): 2.0, (1, "a"): 8.0, (1, "b"): 5.0, (None, "a"): 2.0}


def test_mode_tie_goes_to_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,), (None,), (None,)], "c string")
    assert smallest_modes(df, ["c"]).collect() == [("c", "a", 2)]


def test_sequential_id(spark):
    ids = [-5, 0, 7, 1 << 21, (1 << 21) + 1, 1 << 42, (1 << 62) + 3]
    df = spark.createDataFrame([(i,) for i in reversed(ids)], "k long").repartition(3)
    got = {r["k"]: r["seq_id"] for r in with_sequential_id(df, "k").collect()}
    assert got == {k: i for i, k in enumerate(ids)}


def test_more_groups_than_a_driver_should_hold(spark):
    rows = spark.range(240_000).select(F.floor(F.col("id") / 2).alias("g"), F.col("id").cast("double").alias("v"))
    found = exact_quantiles(rows, ["v"], [0.5], ["g"])
    assert found.count() == 120_000
    assert found.where(F.col("value") != F.col("g") * 2 + 0.5).count() == 0
