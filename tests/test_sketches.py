"""Mergeable quantiles and distinct counts, kept by day; curves from bins."""

import datetime as dt
import math
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from needledrop.operators import profile, sketches
from needledrop.plans.runs import run_profile
from needledrop.sources.sketch_store import kept_sketches

RNG = np.random.default_rng(5)
FIRST = dt.datetime(2024, 3, 1)
DAY = (FIRST - dt.datetime(1970, 1, 1)).days


@pytest.fixture(scope="module")
def rows(spark):
    # Two thirds of all rows in one group; heavy tails, many ties, nulls and NaN.
    n = 60_000
    pdf = pd.DataFrame({"part": np.where(RNG.random(n) < 0.67, 0, RNG.integers(1, 40, n)), "tail": RNG.standard_cauchy(n), "ties": RNG.integers(0, 9, n) * 1.0})
    pdf["who"] = RNG.zipf(1.3, n) % 50_000
    df = spark.createDataFrame(pdf).withColumn("tail", F.when(F.col("who") % 11 == 0, None).when(F.col("who") % 13 == 0, float("nan")).otherwise(F.col("tail")))
    return df.repartition(16).cache()


def rank_gap(values, answer, prob):
    """How far the ranks of ``answer`` are from the wanted one, as a share of the rows."""
    low, high = (values < answer).mean(), (values <= answer).mean()
    return max(0.0, low - prob, prob - high)


@pytest.mark.parametrize("k", [256, sketches.QUANTILE_K])
def test_merged_quantiles_keep_their_rank_error(spark, rows, k):
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    parts = sketches.sketched(rows, ["tail", "ties"], ["part"], k=k)
    found = sketches.sketch_quantiles(sketches.merged(parts, [], k), probs).collect()
    assert len(found) == 2 * len(probs)
    local = rows.select("tail", "ties").toPandas()
    for r in found:
        values = local[r["column"]].dropna()
        assert r["n"] == len(values)
        assert rank_gap(values, r["value"], r["prob"]) <= sketches.rank_error(k) + 1 / len(values)


def test_merged_distinct_counts_keep_their_error(spark, rows):
    parts = sketches.sketched(rows, ["who", "ties", "tail"], ["part"], numbers=["ties"])
    found = {r["column"]: r["n_distinct"] for r in sketches.sketch_distinct(sketches.merged(parts, [])).collect()}
    exact = rows.agg(F.count_distinct("who").alias("who"), F.count_distinct("tail").alias("tail")).first()
    assert found["ties"] == 9
    for c in ("who", "tail"):
        assert abs(found[c] - exact[c]) <= sketches.distinct_error() * exact[c]
    # Merging does not count a value twice, however it is split.
    whole = sketches.sketch_distinct(sketches.sketched(rows, ["who"], [], numbers=[])).first()["n_distinct"]
    assert abs(found["who"] - whole) <= 2 * sketches.distinct_error() * whole


def test_sketches_of_odd_columns(spark):
    kinds = "g int, nothing double, one double, zeros double, text string"
    df = spark.createDataFrame([(None, None, 3.0, 0.0, "a"), (None, None, None, -0.0, None), (1, None, float("nan"), 0.0, "b")], kinds)
    found = sketches.sketched(df, ["nothing", "one", "zeros", "text"], ["g"], numbers=["nothing", "one", "zeros"])
    counts = {(r["g"], r["column"]): (r["n"], r["n_distinct"]) for r in sketches.sketch_distinct(found, ["g"]).collect()}
    assert counts[(None, "one")] == (1, 1) and counts[(1, "one")] == counts[(1, "nothing")] == (0, 0)
    assert counts[(None, "zeros")] == (2, 1) and counts[(None, "text")] == (1, 1)
    got = {(r["g"], r["column"]): r["value"] for r in sketches.sketch_quantiles(found, [0.5], ["g"]).collect()}
    assert got == {(None, "one"): 3.0, (None, "zeros"): 0.0, (1, "zeros"): 0.0}
    all_ = sketches.merged(found, [])
    assert {r["column"]: r["n"] for r in all_.collect()} == {"nothing": 0, "one": 1, "zeros": 3, "text": 2}
    assert [r["column"] for r in sketches.sketch_quantiles(all_, [0.5]).orderBy("column").collect()] == ["one", "zeros"]
    assert sketches.sketched(df.limit(0), ["one"], ["g"]).count() == 0
    with pytest.raises(ValueError):
        sketches.sketched(df, [], [])


def plays(spark, days, more=()):
    made = [(i, ["hot", "hot", "a"][i % 3], float(i % 7), FIRST + dt.timedelta(days=d, minutes=i), "x") for d in days for i in range(50)]
    return spark.createDataFrame(made + list(more), "obs_id long, username string, v double, ts timestamp_ntz, other string")


def test_only_changed_days_are_sketched(spark, tmp_path):
    folder = str(tmp_path / "kept")

    def kept(df):
        found, fresh = kept_sketches(df, folder, ["v", "username"], numbers=["v"])
        counts = {r["column"]: (r["n"], r["n_distinct"]) for r in sketches.sketch_distinct(sketches.merged(found, [])).collect()}
        assert counts == {"v": (df.where("v IS NOT NULL").count(), 7), "username": (df.count(), 2)}
        return fresh

    assert kept(plays(spark, range(4))) == [DAY, DAY + 1, DAY + 2, DAY + 3]
    assert kept(plays(spark, range(4)).withColumn("other", F.lit("y")).orderBy(F.desc("v"))) == []
    assert kept(plays(spark, range(5))) == [DAY + 4]
    late = plays(spark, range(5), [(99, "a", None, FIRST + dt.timedelta(days=2), "z")])
    assert kept(late) == [DAY + 2]
    assert kept(plays(spark, range(5))) == []
    no_time = plays(spark, range(5), [(99, "a", 1.0, None, "z")])
    assert kept(no_time) == [None] and kept(no_time) == []
    written = [p.name for p in Path(folder).glob("run-*/day=*")]
    assert written.count(f"day={DAY + 2}") == 2 and written.count(f"day={DAY}") == 1
    found, fresh = kept_sketches(plays(spark, []), str(tmp_path / "none"), ["v"])
    assert found.count() == 0 and fresh == []


def test_binned_curve_is_within_its_error_of_the_exact_one(spark):
    n = 4000
    pdf = pd.DataFrame({"y": RNG.integers(0, 2, n), "even": RNG.normal(0, 1, n), "far": RNG.normal(0, 1, n), "steps": RNG.integers(0, 4, n) * 1.0, "same": 2.0})
    pdf.loc[0, "far"] = 1e4
    pdf["tiny"] = pdf.even * 1e-6 + 1e3
    df, columns = spark.createDataFrame(pdf), ["even", "far", "steps", "same", "tiny"]
    key = ["column", "target", "point", "x"]
    exact = {tuple(r[k] for k in key): r["density"] for r in profile.class_kde(df, columns, "y").collect()}
    for tolerance in (1e-6, 1e-3):
        binned = profile.class_kde_binned(df, columns, "y", tolerance=tolerance).collect()
        assert {tuple(r[k] for k in key) for r in binned} == set(exact) and len(binned) == len(exact)
        for r in binned:
            want = exact[tuple(r[k] for k in key)]
            assert abs(r["density"] - want) <= r["error"] * (1 + 1e-6)
            if tolerance == 1e-6 and r["column"] in ("even", "steps"):
                assert abs(r["density"] - want) <= 1e-6 * max(1.0, 1 / math.sqrt(2 * math.pi) / pdf[r["column"]].std() * n**0.2)
    with pytest.raises(ValueError):
        profile.class_kde_binned(df, columns, "y", tolerance=0)


def test_binned_curve_of_many_values_has_area_one(spark):
    n = 200_000
    df = spark.createDataFrame(pd.DataFrame({"y": RNG.integers(0, 2, n), "v": RNG.normal(0, 1, n)}))
    found = profile.class_kde_binned(df, ["v"], "y", tolerance=1e-3)
    area = found.groupBy("target").agg((F.sum("density") * (F.max("x") - F.min("x")) / 199).alias("area")).collect()
    assert all(abs(r["area"] - 1) < 0.01 for r in area) and len(area) == 2


def test_a_profile_without_exact_counts(spark, rows):
    df = rows.select(F.when(F.col("part") == 0, 0).otherwise(1).alias("fwdbtn"), F.col("who").cast("double").alias("who"), F.col("ties").cast("string").alias("word"))
    exact, near = run_profile(df), run_profile(df, exact=False)
    want = {r["target"]: r for r in exact["stats"].collect()}
    for r in near["stats"].collect():
        w = want[r["target"]]
        assert r["n"] == w["n"]
        assert r["mean"] == pytest.approx(w["mean"]) and abs(r["n_distinct"] - w["n_distinct"]) <= sketches.distinct_error() * w["n_distinct"]
    assert near["density"].columns == [*exact["density"].columns, "error"]
    both = [profile.dataset_summary(rows, "part", "who", "who", "ties", "tail", exact=e).orderBy("part").collect() for e in (True, False)]
    for w, r in zip(*both):
        assert (w["part"], w["n_rows"], w["n_positive"]) == (r["part"], r["n_rows"], r["n_positive"])
        assert abs(w["n_users"] - r["n_users"]) <= max(1, sketches.distinct_error() * w["n_users"])
