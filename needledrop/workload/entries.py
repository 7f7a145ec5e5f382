"""One Spark query per operator; each reads the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from needledrop.config import ORDER_COLUMN, RATE_COLUMN, Settings
from needledrop.functions import (
    label_flag,
    lenient_float,
    micros,
    platform_family,
    presence_flag,
    release_year,
    song_age,
    track_id,
    wall_clock,
    with_temporal_features,
)
from needledrop.operators import columns as cols
from needledrop.operators import inference, metrics, profile, sketches, staged
from needledrop.operators.encode import ColumnImputer, FeatureEncoder
from needledrop.operators.history import with_bin_counts, with_rolling_counts, with_track_order
from needledrop.operators.rates import with_past_rate, with_user_rate
from needledrop.operators.split import TEST, TRAIN, with_time_split
from needledrop.operators.tracks import CATALOGUE_SCHEMA, duration_stats, enrich, flatten_documents, join_coverage, track_features
from needledrop.plans.dataset import (
    FRAME,
    PAST_COUNTS,
    build_dataset,
    feature_table,
    history_features,
    impute,
)
from needledrop.plans.search import search, top_trials
from needledrop.plans.training import classifier, encode, fit, importance, scored
from needledrop.sources.scans import parse_documents
from needledrop.sources.store import fingerprint, settled
from needledrop.sources.sinks import prediction_rows
from needledrop.workload import views

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

DEFAULTS = Settings()

STAT_DIGITS, CURVE_DIGITS = 6, 9


def query(f: Query) -> Query:
    """Register under the function's name; a trailing underscore only avoids a name clash."""
    _QUERIES[f.__name__.rstrip("_")] = f
    return f


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Rounded for the comparison, without a negative zero."""
    return df.withColumns({n: F.when(F.round(n, digits) == 0, 0.0).otherwise(F.round(n, digits)) for n in names})


def _framed(spark: SparkSession, sf: str) -> DataFrame:
    return views.plays(spark, sf).withColumn(FRAME, F.when(F.expr(views.IS_TEST), TEST).otherwise(TRAIN))


def _train_frame(spark: SparkSession, sf: str) -> DataFrame:
    return views.plays(spark, sf).where(f"NOT ({views.IS_TEST})")


def _train_tracks(spark: SparkSession, sf: str) -> DataFrame:
    plays = _train_frame(spark, sf).select(track_id("spotify_track_uri").alias("track_id"))
    return cols.distinct_values(plays, "track_id")


def _features_of_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return track_features(views.tracks(spark, sf), _train_tracks(spark, sf))


def _enriched(spark: SparkSession, sf: str) -> DataFrame:
    return enrich(views.plays(spark, sf), _features_of_tracks(spark, sf))


# --- sources and columns -------------------------------------------------------------


@query
def json_extract(spark: SparkSession, sf: str) -> DataFrame:
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("missing", T.StringType())])
    rows = parse_documents(views.table(spark, sf, "events"), "props", schema, ["event_id"])
    return rows.select("event_id", "k", F.coalesce("missing", F.lit("")).alias("missing"))


@query
def frame_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.plays(spark, sf).withColumn("ts", micros("ts"))
    sums = fingerprint(rows, ["ts", "username", "fwdbtn", "spotify_track_uri"])
    return sums.select("n_rows", *[F.col(c).cast("string").alias(c) for c in sums.columns[1:]])


@query
def timestamp_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Times as text, a quarter each without zone, with Z, and with two spellings of an offset."""
    zone = F.expr("CASE obs_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'Z' WHEN 2 THEN '+02:00' ELSE ' -0330' END")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), zone)
    rows = views.plays(spark, sf).select("obs_id", text.alias("ts"))
    return wall_clock(rows).select("obs_id", micros("ts").alias("micros"))


@query
def flatten_documents_(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogue documents with whole and broken durations, flags as words and numbers, and lost fields."""
    text = F.expr(
        """concat('{"id": "', p_partkey, '", "duration_ms": ',
             CASE p_partkey % 4 WHEN 0 THEN '0' WHEN 1 THEN concat(p_size * 1000, '.5') WHEN 2 THEN 'null' ELSE CAST(p_size * 1000 AS STRING) END,
             ', "explicit": ', CASE p_partkey % 5 WHEN 0 THEN 'true' WHEN 1 THEN '1' WHEN 2 THEN '0' WHEN 3 THEN 'false' ELSE 'null' END,
             CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat(', "popularity": ', p_size) END,
             ', "available_markets": ["A", "B"], "album": {"album_type": "', p_partkey % 7, '"}}')"""
    )
    docs = parse_documents(views.table(spark, sf, "part").select(text.alias("doc")), "doc", CATALOGUE_SCHEMA, [])
    return flatten_documents(docs).select("track_id", "duration_ms", "explicit", "popularity", "available_markets_count", "album_type")


@query
def drop_all_null_columns(spark: SparkSession, sf: str) -> DataFrame:
    return cols.drop_all_null_columns(views.plays(spark, sf).drop("ts", "shuffle"))


@query
def label_binarize(spark: SparkSession, sf: str) -> DataFrame:
    return views.plays(spark, sf).select("obs_id", label_flag("reason_end").alias("fwdbtn"))


@query
def safe_numeric_cast(spark: SparkSession, sf: str) -> DataFrame:
    text = F.expr("CASE WHEN k % 11 = 0 THEN 'n/a' WHEN k % 11 = 1 THEN '' ELSE concat(CAST(k AS VARCHAR(10)), '.5') END")
    return views.plays(spark, sf).select("obs_id", lenient_float(text).alias("number"))


@query
def infer_types(spark: SparkSession, sf: str) -> DataFrame:
    return inference.infer_types(views.view(spark, sf, views.PLAYS_FROM, views.WRITTEN))


@query
def fill_constants(spark: SparkSession, sf: str) -> DataFrame:
    plays = views.plays(spark, sf).select("obs_id", "shuffle", "platform", "conn_country")
    return cols.fill_constants(plays)


@query
def track_event_flags(spark: SparkSession, sf: str) -> DataFrame:
    return views.plays(spark, sf).select(
        "obs_id",
        presence_flag("master_metadata_track_name").alias("is_song"),
        presence_flag("episode_name").alias("is_episode"),
    )


@query
def column_roles(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.labeled_docs(spark, sf).withColumn("nothing", F.lit(None).cast("double"))
    return profile.column_roles(docs, ("doc_id",))


@query
def distinct_train_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return _train_tracks(spark, sf)


# --- catalogue -----------------------------------------------------------------------


@query
def duration_stats_train_only(spark: SparkSession, sf: str) -> DataFrame:
    stats = duration_stats(views.tracks(spark, sf), _train_tracks(spark, sf))
    return _rounded(stats, STAT_DIGITS, "mean_ms", "p99_ms")


@query
def track_features_(spark: SparkSession, sf: str) -> DataFrame:
    rows = track_features(views.tracks(spark, sf), _train_tracks(spark, sf), minutes=True)
    rows = rows.withColumn("duration_normalized", F.round(F.col("duration_normalized").cast("double"), 5))
    return _rounded(rows, STAT_DIGITS, "duration_min")



@query
def release_year_(spark: SparkSession, sf: str) -> DataFrame:
    return views.tracks(spark, sf).select("track_id", release_year("release_date").alias("release_year"))



@query
def track_id_extract(spark: SparkSession, sf: str) -> DataFrame:
    return views.plays(spark, sf).select("obs_id", track_id("spotify_track_uri").alias("track_id"))


@query
def enrich_left_join(spark: SparkSession, sf: str) -> DataFrame:
    return _enriched(spark, sf).select(
        "obs_id",
        "track_id",
        F.round(F.col("duration_normalized").cast("double"), 5).alias("duration_normalized"),
        "explicit",
        "popularity",
        "track_number",
        "available_markets_count",
        "album_type",
        "release_year",
    )


@query
def join_coverage_(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(join_coverage(_enriched(spark, sf)), STAT_DIGITS, "coverage")



# --- per-event features --------------------------------------------------------------


@query
def temporal_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_temporal_features(views.plays(spark, sf).select("obs_id", "ts"), corrected=True).drop("ts")
    return _rounded(rows, CURVE_DIGITS, "time_of_day_sin", "time_of_day_cos")


@query
def platform_map(spark: SparkSession, sf: str) -> DataFrame:
    return views.plays(spark, sf).select("obs_id", platform_family("platform").alias("platform"))


@query
def song_age_(spark: SparkSession, sf: str) -> DataFrame:
    return _enriched(spark, sf).select("obs_id", song_age(F.year("ts"), "release_year").alias("song_age"))



@query
def track_order_in_day(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.plays(spark, sf, minute=True).select("obs_id", "username", "ts")
    return with_track_order(rows).select("obs_id", ORDER_COLUMN)


@query
def track_order_in_day_heavy(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.user_orders(spark, sf)
    return with_track_order(rows).select("obs_id", ORDER_COLUMN)


@query
def rolling_counts(spark: SparkSession, sf: str) -> DataFrame:
    return with_rolling_counts(views.plays(spark, sf).select("obs_id", "username", "ts")).drop("username", "ts")


@query
def rolling_counts_tied(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.plays(spark, sf, minute=True).select("obs_id", "username", "ts")
    return with_rolling_counts(rows).drop("username", "ts")


@query
def rolling_counts_heavy(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.heavy_plays(spark, sf).select("obs_id", "username", "ts")
    return with_rolling_counts(rows).drop("username", "ts")


@query
def rolling_bin20_documented(spark: SparkSession, sf: str) -> DataFrame:
    return with_bin_counts(views.plays(spark, sf).select("obs_id", "username", "ts")).drop("username", "ts")


@query
def time_split(spark: SparkSession, sf: str) -> DataFrame:
    return with_time_split(views.plays(spark, sf).select("obs_id", "username", "ts")).drop("username", "ts")


@query
def time_split_dates(spark: SparkSession, sf: str) -> DataFrame:
    return with_time_split(views.user_orders(spark, sf)).drop("username", "ts")


@query
def time_split_heavy(spark: SparkSession, sf: str) -> DataFrame:
    return with_time_split(views.heavy_orders(spark, sf)).drop("username", "ts")


@query
def history_across_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Counts over both frames, the split by frame."""
    rows = _framed(spark, sf).select("obs_id", "username", "ts", FRAME)
    counts = tuple(c for c in PAST_COUNTS if c != ORDER_COLUMN)
    return history_features(rows, counts, learn_rate=False, across_frames=True).drop("username", "ts", FRAME)


@query
def user_skip_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Rates learned per frame; users under 5 are moved to the test frame, so some users are new there."""
    rows = views.plays(spark, sf).select("obs_id", "username", "ts", "fwdbtn")
    is_test = F.expr(views.IS_TEST) | (F.col("username") < 5)
    rows = rows.withColumn(FRAME, F.when(is_test, TEST).otherwise(TRAIN))
    rated = history_features(rows, ())
    return _rounded(rated, CURVE_DIGITS, RATE_COLUMN).select("obs_id", DEFAULTS.fold_column, RATE_COLUMN)


@query
def user_skip_rate_joined(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.plays(spark, sf).select("obs_id", "username", "ts", "fwdbtn")
    rated = with_user_rate(rows, ~F.expr(views.IS_TEST))
    return _rounded(rated, CURVE_DIGITS, RATE_COLUMN).select("obs_id", RATE_COLUMN)


@query
def user_rate_past(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.heavy_plays(spark, sf).select("obs_id", "username", "ts", "fwdbtn")
    # Plays of the test frame have no label.
    rows = rows.withColumn("fwdbtn", F.when(~F.expr(views.IS_TEST), F.col("fwdbtn")))
    return _rounded(with_past_rate(rows).select("obs_id", RATE_COLUMN), CURVE_DIGITS, RATE_COLUMN)


@query
def feature_table_(spark: SparkSession, sf: str) -> DataFrame:
    plays = cols.drop_all_null_columns(views.plays(spark, sf).drop("value_nullable", "k", "shuffle"))
    table = feature_table(plays, _features_of_tracks(spark, sf))
    table = table.withColumn("duration_normalized", F.round(F.col("duration_normalized").cast("double"), 5))
    return _rounded(table, CURVE_DIGITS, "time_of_day_sin", "time_of_day_cos")


# --- encoding ------------------------------------------------------------------------


@query
def impute_median_mode(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.plays(spark, sf).select("obs_id", "ts", "value_nullable", "platform", "conn_country")
    stage = ColumnImputer(numberCols=["value_nullable"], textCols=["platform", "conn_country"])
    filled = stage.fit(rows.where(f"NOT ({views.IS_TEST})")).transform(rows)
    return _rounded(filled, STAT_DIGITS, "value_nullable").drop("ts")


def _late_category(df: DataFrame) -> DataFrame:
    """A category that only the held-out frame has."""
    late = f"CASE WHEN {views.IS_TEST} AND k % 9 = 0 THEN 'new' ELSE conn_country END"
    return df.withColumn("conn_country", F.expr(late))


@query
def rare_category_encode(spark: SparkSession, sf: str) -> DataFrame:
    rows = _late_category(views.plays(spark, sf).select("obs_id", "ts", "k", "conn_country"))
    model = FeatureEncoder(textCols=["conn_country"]).fit(rows.where(f"NOT ({views.IS_TEST})"))
    return model.with_groups(rows).select("obs_id", F.col("conn_country").alias("category"))


@query
def encoded_wide(spark: SparkSession, sf: str) -> DataFrame:
    """One country is held under the cut at every scale: k = 0 and an even id."""
    rows = views.plays(spark, sf).select("obs_id", "ts", "k", "value_nullable", "platform")
    country = "CASE WHEN k = 0 AND obs_id % 2 = 0 THEN 'XX' WHEN k < 50 THEN 'AR' WHEN k < 95 THEN 'US' END"
    rows = rows.withColumns({"platform": platform_family("platform"), "country": F.expr(country)})
    stage = FeatureEncoder(numberCols=["value_nullable"], textCols=["platform", "country"])
    model = stage.fit(rows.where(f"NOT ({views.IS_TEST})"))
    return model.wide(rows, ["obs_id"])


# --- profiling -----------------------------------------------------------------------

_NUMBERS = ["value", "value_nullable", "k"]
_TEXTS = ["platform", "conn_country", "shuffle"]


@query
def target_distribution(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.table(spark, sf, "documents").join(views.table(spark, sf, "labels"), "doc_id", "left")
    out = profile.target_distribution(rows.select("quality"), "quality")
    return _rounded(out, STAT_DIGITS, "pct", "pct_of_rows")


@query
def class_conditional_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.plays(spark, sf).withColumn("constant", F.lit(1))
    stats = profile.class_conditional_stats(rows, [*_NUMBERS, "constant"], "fwdbtn")
    return _rounded(stats, STAT_DIGITS, "mean", "std", "median")


@query
def class_conditional_stats_docs(spark: SparkSession, sf: str) -> DataFrame:
    stats = profile.class_conditional_stats(views.labeled_docs(spark, sf), ["n_chars"], "quality")
    return _rounded(stats, STAT_DIGITS, "mean", "std", "median")


@query
def class_category_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profile.class_category_counts(views.plays(spark, sf), _TEXTS, "fwdbtn")


@query
def class_category_union(spark: SparkSession, sf: str) -> DataFrame:
    return profile.class_category_union(views.plays(spark, sf), _TEXTS, "fwdbtn")


@query
def class_histogram(spark: SparkSession, sf: str) -> DataFrame:
    bins = profile.class_histogram(views.plays(spark, sf), _NUMBERS, "fwdbtn")
    return _rounded(bins, STAT_DIGITS, "lower", "upper", "density")


@query
def class_kde(spark: SparkSession, sf: str) -> DataFrame:
    curve = profile.class_kde(views.plays(spark, sf), _NUMBERS, "fwdbtn")
    return _rounded(_rounded(curve, CURVE_DIGITS, "density"), STAT_DIGITS, "x")


@query
def class_kde_binned(spark: SparkSession, sf: str) -> DataFrame:
    curve = profile.class_kde_binned(views.plays(spark, sf), _NUMBERS, "fwdbtn")
    return _rounded(_rounded(curve, CURVE_DIGITS, "density", "error"), STAT_DIGITS, "x")


def _days_merged(spark: SparkSession, sf: str, columns: list[str], numbers: list[str]) -> DataFrame:
    """Sketches by day and class, merged over the days."""
    rows = views.plays(spark, sf).withColumn("day", F.to_date("ts"))
    return sketches.merged(sketches.sketched(rows, columns, ["day", "fwdbtn"], numbers=numbers), ["fwdbtn"])


@query
def quantile_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles by class from merged sketches; ``within`` says that their rank in the whole table keeps the bound."""
    by = ["fwdbtn", "column", "prob"]
    found = sketches.sketch_quantiles(_days_merged(spark, sf, _NUMBERS, _NUMBERS), [0.01, 0.25, 0.5, 0.75, 0.99], ["fwdbtn"])
    found = settled(found.withColumnRenamed("value", "answer"), "sketch-quantiles")
    long = profile.long_values(views.plays(spark, sf), _NUMBERS, ["fwdbtn"])
    ranks = long.join(F.broadcast(found), ["fwdbtn", "column"]).groupBy(*by, "n").agg(
        F.count_if(F.col("value") < F.col("answer")).alias("_below"), F.count_if(F.col("value") <= F.col("answer")).alias("_upto")
    )
    slack = F.lit(sketches.rank_error()) * F.col("n")
    wanted = F.col("prob") * F.col("n")
    within = (F.col("_below") <= wanted + slack + 1) & (F.col("_upto") >= wanted - slack - 1)
    return ranks.select(*by, "n", within.alias("within"))


@query
def distinct_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct users, plays and platforms by class from merged sketches; ``within`` says that they keep the bound."""
    columns = ["username", "obs_id", "platform"]
    found = sketches.sketch_distinct(_days_merged(spark, sf, columns, []), ["fwdbtn"])
    exact = views.plays(spark, sf).groupBy("fwdbtn").agg(*[F.count_distinct(c).alias(c) for c in columns])
    exact = exact.unpivot(["fwdbtn"], columns, "column", "exact")
    error = F.abs(F.col("n_distinct") - F.col("exact"))
    within = error <= F.greatest(F.lit(1.0), F.lit(sketches.distinct_error()) * F.col("exact"))
    return found.join(exact, ["fwdbtn", "column"]).select("fwdbtn", "column", "n", "exact", within.alias("within"))


@query
def dataset_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = _framed(spark, sf).withColumn("track_id", track_id("spotify_track_uri"))
    folded = history_features(rows, (), learn_rate=False)
    return profile.dataset_summary(folded, "split", "username", "obs_id", "fwdbtn", "track_id")


# --- metrics and sinks ---------------------------------------------------------------


@query
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.scored(spark, sf)
    coarse = metrics.roc_auc(rows, "y", "score").select(F.lit("score").alias("by"), "auc")
    fine = metrics.roc_auc(rows, "y", "fine_score").select(F.lit("fine_score").alias("by"), "auc")
    return _rounded(coarse.unionByName(fine), STAT_DIGITS, "auc")


@query
def staged_auc(spark: SparkSession, sf: str) -> DataFrame:
    """The AUC of a saved model after each of its rounds, exact and from a grid of probabilities with its error."""
    nodes = [staged.Node(*n) for n in views.SAVED_NODES]
    features = [F.coalesce("k", F.lit(-1)), F.col("value")]
    trees = [staged.tree_column([n for n in nodes if n.tree == t], features) for t in range(len(views.SAVED_WEIGHTS))]
    rows = staged.staged_margins(views.plays(spark, sf), trees, list(views.SAVED_WEIGHTS))
    both = [staged.staged_auc(rows, "fwdbtn", grid=g).withColumn("grid", F.lit(g or 0)) for g in (None, 64)]
    return _rounded(both[0].unionByName(both[1]), STAT_DIGITS, "auc", "error")


@query
def classification_report(spark: SparkSession, sf: str) -> DataFrame:
    report = metrics.classification_report(views.scored(spark, sf), "y", "pred")
    return _rounded(report, STAT_DIGITS, "precision", "recall", "f1")


@query
def importance_top(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as features, with ties in their importance."""
    rows = views.table(spark, sf, "part").select(
        F.concat(F.lit("f"), F.col("p_partkey")).alias("feature"), (F.col("p_size") / 50).cast("double").alias("importance")
    )
    return metrics.feature_importance(rows, 20)


@query
def trial_summary(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.trial_summary(views.trials(spark, sf), 5).select(
        "tid", "max_depth", "mean_cv_score", "loss", "std_cv_score", "is_best"
    )


@query
def predictions_with_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Test rows by their own id, and numbered from 0."""
    rows = views.plays(spark, sf).where(views.IS_TEST)
    rows = rows.select("obs_id", (F.col("value") / 1000).alias("target"))
    own = prediction_rows(rows).select(F.lit("own").alias("ids"), "obs_id", "target")
    counted = prediction_rows(rows, None, "obs_id").select(F.lit("counted").alias("ids"), "obs_id", "target")
    return _rounded(own.unionByName(counted), STAT_DIGITS, "target")


# --- model (no SQL form) -------------------------------------------------------------

# Few and shallow trees keep the check short; the rows are all there.
_SMALL = {"n_estimators": 5, "learning_rate": 0.3, "max_depth": 3, "subsample": 0.8, "colsample_bytree": 0.8}


def _dataset(spark: SparkSession, sf: str) -> DataFrame:
    plays = views.plays(spark, sf).drop("k", "shuffle", "value_nullable", "reason_end")
    plays = plays.withColumn("username", F.col("username").cast("string"))
    train, test = plays.where(f"NOT ({views.IS_TEST})"), plays.where(views.IS_TEST)
    return settled(build_dataset(train, test, _features_of_tracks(spark, sf), PAST_COUNTS), "dataset")


@query
def imputed_dataset(spark: SparkSession, sf: str) -> DataFrame:
    rows = impute(_dataset(spark, sf))
    numbers = [c for c in cols.numeric_columns(rows) if c not in ("obs_id", "fwdbtn")]
    return _rounded(rows.withColumns({c: F.col(c).cast("double") for c in numbers}), 5, *numbers)


@query
def stump_split(spark: SparkSession, sf: str) -> DataFrame:
    """The split of a single tree of depth one over the train plays, with what lies on its sides."""
    rows = _train_frame(spark, sf).select(F.coalesce("k", F.lit(-1)).alias("k"), F.col("fwdbtn").cast("double").alias("fwdbtn"))
    params = {"n_estimators": 1, "max_depth": 1, "learning_rate": 1.0}
    model = classifier(params).fit(rows.withColumn("features", array_to_vector(F.array(F.col("k").cast("double")))))
    threshold = F.lit(float(model.trees[0]._call_java("rootNode").split().threshold()))
    sides = rows.groupBy((F.col("k") <= threshold).alias("left")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("fwdbtn").cast("bigint").alias("positives")
    )
    return sides.select(threshold.alias("threshold"), "left", "n", "positives")


@query
def model_predictions(spark: SparkSession, sf: str) -> DataFrame:
    encoded = encode(_dataset(spark, sf))
    rows = scored(fit(encoded, _SMALL), encoded.rows.where(F.col("split") == TEST))
    return prediction_rows(rows.select("obs_id", F.col("score").alias("target")))


@query
def model_feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    encoded = encode(_dataset(spark, sf))
    return importance(spark, fit(encoded, _SMALL), encoded.encoder.feature_names())


@query
def search_trials(spark: SparkSession, sf: str) -> DataFrame:
    encoded = encode(_dataset(spark, sf))
    found = search(encoded, n_trials=2, estimators=(3,), first=_SMALL)
    return top_trials(spark, found["tuning_results"], 3)
