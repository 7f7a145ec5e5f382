"""Catalogue features whose statistics come from the tracks of the train plays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from needledrop.functions import NUMBER, as_salted_key, lenient_float, release_year, track_id
from needledrop.operators.columns import membership
from needledrop.operators.quantiles import exact_quantiles
from needledrop.sources.store import settled

# The fields of a catalogue document.
CATALOGUE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        # Text, so that a value of another kind costs the value and not the document.
        T.StructField("duration_ms", T.StringType()),
        T.StructField("explicit", T.StringType()),
        T.StructField("popularity", T.StringType()),
        T.StructField("track_number", T.StringType()),
        T.StructField("available_markets", T.ArrayType(T.StringType())),
        T.StructField(
            "album",
            T.StructType(
                [T.StructField("album_type", T.StringType()), T.StructField("release_date", T.StringType())]
            ),
        ),
    ]
)

# Fixed value: durations are clipped at this quantile.
CLIP_QUANTILE = 0.99
_FLOATS = ("popularity", "track_number", "available_markets_count", "release_year", "duration_normalized")


def flatten_documents(docs: DataFrame) -> DataFrame:
    """Catalogue documents to flat columns; a missing or null field takes its default."""
    return docs.select(
        F.coalesce("id", F.lit("")).alias("track_id"),
        F.coalesce(F.when(F.col("duration_ms").rlike(NUMBER), F.col("duration_ms").try_cast("double")), F.lit(0.0)).alias("duration_ms"),
        # A flag may be a word or a number.
        F.coalesce(F.col("explicit").try_cast("boolean"), F.col("explicit").try_cast("double") != 0, F.lit(False)).alias("explicit"),
        F.coalesce("popularity", F.lit("0")).alias("popularity"),
        F.coalesce("track_number", F.lit("0")).alias("track_number"),
        F.coalesce(F.size("available_markets"), F.lit(0)).alias("available_markets_count"),
        F.coalesce(F.col("album.album_type"), F.lit("")).alias("album_type"),
        F.coalesce(F.col("album.release_date"), F.lit("")).alias("release_date"),
    )


def duration_stats(tracks: DataFrame, train_tracks: DataFrame | None = None) -> DataFrame:
    """One row ``mean_ms, p99_ms, n``; every document with a positive duration has one vote.

    The durations of the train tracks become a one-column table first: finding these tracks
    reads all plays, and that should not be repeated by each pass over the durations.
    """
    used = membership(tracks, train_tracks, "track_id").where(F.col("duration_ms") > 0)
    if train_tracks is not None:
        used = settled(used.select("duration_ms"), "durations")
    mean = used.agg(
        F.coalesce(F.avg("duration_ms"), F.lit(0.0)).alias("mean_ms"), F.count(F.lit(1)).alias("n")
    )
    clip = exact_quantiles(used, ["duration_ms"], [CLIP_QUANTILE]).agg(
        F.coalesce(F.max("value"), F.lit(0.0)).alias("p99_ms")
    )
    return mean.crossJoin(F.broadcast(clip)).select("mean_ms", "p99_ms", "n")


def track_features(
    tracks: DataFrame, train_tracks: DataFrame | None = None, minutes: bool = False
) -> DataFrame:
    """Flat catalogue rows to feature rows; ``train_tracks`` is a frame of train ``track_id``."""
    stats = F.broadcast(duration_stats(tracks, train_tracks).select("mean_ms", "p99_ms"))
    d = F.when(F.col("duration_ms") == 0, F.col("mean_ms")).otherwise(F.col("duration_ms").cast("double"))
    clipped = F.least(d, F.col("p99_ms"))
    shaped = tracks.crossJoin(stats).select(
        "track_id",
        F.when(F.col("p99_ms") > 0, clipped / F.col("p99_ms")).otherwise(F.lit(0.0)).alias("duration_normalized"),
        F.col("explicit").cast("int").alias("explicit"),
        "popularity",
        "track_number",
        "available_markets_count",
        "album_type",
        release_year("release_date").alias("release_year"),
        *([(d / 60_000.0).alias("duration_min")] if minutes else []),
    )
    texts = {f.name for f in shaped.schema if isinstance(f.dataType, T.StringType)}
    return shaped.withColumns({c: lenient_float(c) if c in texts else F.col(c).cast("float") for c in _FLOATS})


def one_row_per_track(features: DataFrame) -> DataFrame:
    """Keep one document per id, the smallest by value, so that a join cannot multiply plays."""
    rest = [c for c in features.columns if c != "track_id"]
    return features.groupBy("track_id").agg(F.min(F.struct(*rest)).alias("_t")).select("track_id", "_t.*")


def enrich(plays: DataFrame, features: DataFrame, dedupe: bool = True) -> DataFrame:
    """Left join of the plays to their track's features; derives ``track_id`` when absent.

    The catalogue grows with the data, so no broadcast is forced; the planner broadcasts
    it below its size limit, and splits the partition of a hot track otherwise. It can do
    so only below a plain exchange, so the one row per track is written first; pass
    ``dedupe=False`` for features that have one already. Plays without a track are spread
    over all partitions.
    """
    if "track_id" not in plays.columns:
        plays = plays.withColumn("track_id", track_id("spotify_track_uri"))
    features = settled(one_row_per_track(features), "tracks-once") if dedupe else features
    spread = F.col("obs_id") if "obs_id" in plays.columns else F.monotonically_increasing_id()
    keyed = plays.withColumn("_key", as_salted_key(F.col("track_id"), F.col("track_id").isNotNull(), spread))
    joined = keyed.join(features.withColumnRenamed("track_id", "_of"), F.col("_key") == F.col("_of"), "left")
    return joined.drop("_key", "_of")


def join_coverage(enriched: DataFrame) -> DataFrame:
    """One row: share and number of plays that found their track, and all plays."""
    hit = F.col("duration_normalized").isNotNull()
    return enriched.agg(
        F.avg(hit.cast("int")).alias("coverage"),
        F.count("duration_normalized").alias("matched"),
        F.count(F.lit(1)).alias("total"),
    )
