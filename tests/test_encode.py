import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.linalg import SparseVector

from needledrop.operators.encode import ColumnImputer, FeatureEncoder, FeatureEncoderModel


def learn_rows(spark):
    rows = [(i, float(i % 5) if i % 4 else None, "x" if i < 120 else "y") for i in range(200)]
    rows += [(200, 1.0, "seldom"), (201, 1.0, None)]
    return spark.createDataFrame(rows, "obs_id long, v double, c string")


def test_imputer(spark):
    df = spark.createDataFrame(
        [(1.0, 1, "b", None, True), (2.0, 2, "a", None, None), (None, None, None, None, True), (4.0, 4, "a", None, False)],
        "d double, n int, s string, empty string, flag boolean",
    )
    stage = ColumnImputer(numberCols=["d", "n"], textCols=["s", "empty", "flag"])
    row = stage.fit(df).transform(df).where("d = 2.0 AND s = 'a'").first()
    filled = stage.fit(df).transform(df).collect()[2]
    assert tuple(filled) == (2.0, 2, "a", "unknown", True)
    assert row["flag"] is True


def test_half_median_turns_integers_into_doubles(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "n int")
    out = ColumnImputer(numberCols=["n"]).fit(df).transform(df)
    assert out.collect()[2]["n"] == 1.5


def test_fit_does_not_look_at_other_rows(spark):
    df = learn_rows(spark)
    train = df.where("obs_id < 150")
    a = ColumnImputer(numberCols=["v"], textCols=["c"]).fit(train)
    b = ColumnImputer(numberCols=["v"], textCols=["c"]).fit(df.where("obs_id < 150"))
    assert a.getOrDefault(a.medians) == b.getOrDefault(b.medians)


def test_rare_unseen_and_missing(spark):
    model = FeatureEncoder(numberCols=["v"], textCols=["c"]).fit(learn_rows(spark))
    assert model.feature_names() == ["num__v", "cat__c_x", "cat__c_y", "cat__c_infrequent_sklearn"]
    new = spark.createDataFrame(
        [(1, 5.0, "x"), (2, 5.0, "seldom"), (3, 5.0, "never"), (4, None, None)], "obs_id long, v double, c string"
    )
    wide = {r["obs_id"]: tuple(r)[1:] for r in model.wide(new, ["obs_id"]).collect()}
    assert wide[1] == (5.0, 1.0, 0.0, 0.0)
    assert wide[2] == (5.0, 0.0, 0.0, 1.0)
    assert wide[3] == (5.0, 0.0, 0.0, 0.0)
    assert wide[4] == (2.0, 1.0, 0.0, 0.0)
    vectors = {r["obs_id"]: tuple(r["features"]) for r in model.transform(new).collect()}
    assert vectors == wide


def test_no_categories(spark):
    model = FeatureEncoder(numberCols=["v"]).fit(learn_rows(spark))
    assert model.feature_names() == ["num__v"]
    assert model.wide(learn_rows(spark), ["obs_id"]).count() == 202


def test_save_and_load(spark, tmp_path):
    df = learn_rows(spark)
    stage = FeatureEncoder(numberCols=["v"], textCols=["c"], tableDir=str(tmp_path / "tables"))
    fitted = Pipeline(stages=[stage]).fit(df)
    fitted.write().overwrite().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    assert isinstance(loaded.stages[0], FeatureEncoderModel)
    assert loaded.transform(df).orderBy("obs_id").collect() == fitted.transform(df).orderBy("obs_id").collect()


def test_unsaved_rare_table_is_reported(spark, tmp_path):
    model = FeatureEncoder(textCols=["c"]).fit(learn_rows(spark))
    model.write().overwrite().save(str(tmp_path / "m"))
    with pytest.raises(ValueError, match="tableDir"):
        FeatureEncoderModel.load(str(tmp_path / "m")).transform(learn_rows(spark))


def wide_rows(spark, n=400, columns=50):
    names = [f"c{j}" for j in range(columns)]
    rows = [(i, *(["x", "y", f"r{(i + j) % 300}"][(i * 7 + j * 3) % 11 % 3] for j in range(columns))) for i in range(n)]
    return spark.createDataFrame(rows, "obs_id long, " + ", ".join(f"{c} string" for c in names)), names


def test_fifty_category_columns_are_looked_up_by_one_join(spark):
    df, names = wide_rows(spark)
    model = FeatureEncoder(textCols=names).fit(df)
    assert len(model.getOrDefault(model.merged)) == 50
    out = model.transform(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
    # Against counting by hand.
    counts = {c: {r[c]: r["count"] for r in df.groupBy(c).count().collect()} for c in names}
    want = {}
    for row in df.collect():
        vector = []
        for c in names:
            kept = sorted(v for v, n in counts[c].items() if n >= 4)
            vector += [float(row[c] == v) for v in kept] + [float(row[c] not in kept)]
        want[row["obs_id"]] = vector
    found = out.select("obs_id", "features").collect()
    assert {r["obs_id"]: list(r["features"].toArray()) for r in found} == want
    assert all(isinstance(r["features"], SparseVector) and len(r["features"].indices) <= 50 for r in found)


def test_equal_rows_and_unseen_values_keep_their_number(spark):
    df = learn_rows(spark)
    model = FeatureEncoder(numberCols=["v"], textCols=["c"]).fit(df)
    new = spark.createDataFrame([(1, 5.0, "seldom")] * 40 + [(2, None, "never")] * 3 + [(3, 1.0, "x")] * 5 + [(None, None, "")], "obs_id long, v double, c string")
    found = sorted((tuple(r) for r in model.with_groups(new).collect()), key=str)
    want = [(1, 5.0, "infrequent_sklearn")] * 40 + [(2, None, None)] * 3 + [(3, 1.0, "x")] * 5 + [(None, None, None)]
    assert found == sorted(want, key=str)
    assert model.transform(new.limit(0)).count() == 0
