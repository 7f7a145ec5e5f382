"""From plays and catalogue to a table of features with train, val and test rows.

The history counts of all frames and the time split come from one exchange by user and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from needledrop.config import BIN_COLUMN, BIN_SUFFIX_COLUMN, ORDER_COLUMN, TRAILING_MINUTES, Settings
from needledrop.functions import (
    label_flag,
    platform_family,
    presence_flag,
    song_age,
    track_id,
    wall_clock,
    with_temporal_features,
)
from needledrop.operators.columns import (
    RAW_COLUMNS,
    all_null_columns,
    categorical_columns,
    distinct_values,
    feature_columns,
    fill_constants,
    label_last,
    numeric_columns,
)
from needledrop.operators.encode import ColumnImputer
from needledrop.operators.history import IS_TRAIN, by_day, with_history
from needledrop.operators.rates import with_user_rate
from needledrop.operators.split import TEST, TRAIN, fold_name
from needledrop.operators.tracks import enrich, flatten_documents, one_row_per_track, track_features
from needledrop.sources.catalogue_store import kept_catalogue
from needledrop.sources.day_cache import cached_history
from needledrop.sources.scans import read_catalogue, read_enriched_frames, read_play_frames
from needledrop.sources.store import content_key, settled, stored

FRAME = "frame"
# What the original computes, and the documented count that knows no future plays.
PARITY_COUNTS = (ORDER_COLUMN, BIN_SUFFIX_COLUMN, *TRAILING_MINUTES)
PAST_COUNTS = (ORDER_COLUMN, BIN_COLUMN, *TRAILING_MINUTES)


def row_features(df: DataFrame) -> DataFrame:
    """Features that need no other row: calendar, presence flags, song age, platform.

    A source column that was dropped because it held nothing counts as null in every row.
    """
    df = with_temporal_features(wall_clock(df))

    def source(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None)

    return df.withColumns(
        {
            "is_song": presence_flag(source("master_metadata_track_name")),
            "is_episode": presence_flag(source("episode_name")),
            "song_age": song_age("year", source("release_year")),
            "platform": platform_family(source("platform").cast("string")),
        }
    )


def history_features(
    df: DataFrame,
    counts: tuple[str, ...] = PARITY_COUNTS,
    settings: Settings = Settings(),
    learn_rate: bool = True,
    cache: str | None = None,
    across_frames: bool = False,
) -> DataFrame:
    """Add history counts, ``split`` and the user rate to plays with a ``frame`` column.

    ``frame`` is train or test. Counts and split see the rows of one frame only; the rate
    is learned from the train rows and reaches the test rows of the same user. Users without
    train rows get the rate over all train rows. The counted table is written once, and both rates
    are learned from it. With a folder in ``cache`` the counts of days that have not changed since an earlier
    run are read from there; ids must be unique in a frame. With ``across_frames`` the counts see the plays of
    a user in both frames, so the first test plays have the history that the train plays are; the split stays by frame.
    """
    user, fold, row = settings.user, settings.fold_column, settings.obs_id
    if cache and across_frames:
        raise ValueError("the cache keeps counts by frame")
    if across_frames:
        rows = by_day(by_day(df, [user], set(counts), settings), [user, FRAME], set(), settings, split=True)
    elif cache:
        kept, _ = cached_history(df, cache, counts, [user, FRAME], settings)
        rows = by_day(df, [user, FRAME], set(), settings, split=True).join(kept.select(FRAME, row, *counts), [FRAME, row])
    else:
        rows = by_day(df, [user, FRAME], set(counts), settings, split=True)
    named = F.when(F.col(FRAME) == TEST, TEST).otherwise(fold_name(F.col(IS_TRAIN))).alias(fold)
    table = rows.select(*df.columns, *counts, named)
    return with_user_rate(settled(table, "history"), None, settings) if learn_rate else table


def feature_table(
    plays: DataFrame,
    features: DataFrame | None = None,
    counts: tuple[str, ...] = PARITY_COUNTS,
    settings: Settings = Settings(),
) -> DataFrame:
    """All features of one frame, raw columns dropped, label last.

    The counts are taken on the plays as they are read, and the catalogue ``features`` are
    joined after that (none for plays that are joined already): the totals per day are then
    a scan of few columns.
    """
    table = with_history(plays, counts, settings=settings)
    table = row_features(table if features is None else enrich(table, features)).drop(*RAW_COLUMNS)
    return label_last(table, settings.label) if settings.label in table.columns else table


def catalogue_features(documents: DataFrame, train: DataFrame) -> DataFrame:
    """Features of all documents, with statistics of the train plays' tracks, as a table.

    The many small documents are read once, and each of the passes below reads a table.
    """
    tracks = settled(flatten_documents(documents), "tracks")
    used = settled(distinct_values(train.select(track_id("spotify_track_uri").alias("track_id")), "track_id"), "used")
    return settled(one_row_per_track(track_features(tracks, used)), "track_features")


def enrich_frames(train: DataFrame, test: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Join both frames with the catalogue (one row per track), fill the constant defaults, make the label 0/1."""
    train = enrich(train, features, dedupe=False).withColumn("reason_end", label_flag("reason_end"))
    train = label_last(train.withColumnRenamed("reason_end", "fwdbtn"), "fwdbtn")
    return fill_constants(train), fill_constants(enrich(test, features, dedupe=False).drop("reason_end"))


def load_frames(
    spark: SparkSession,
    train_path: str,
    test_path: str,
    catalogue: str,
    folder: str | None = None,
    enriched: tuple[str, str] | None = None,
    multi_line: bool = False,
    catalogue_store: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The enriched train and test frames; ``multi_line`` reads quoted line breaks in text files.

    With a folder in ``catalogue_store`` only documents that are new or changed since an earlier run are parsed.

    ``enriched`` names a pair of tables (CSV or Parquet) that are joined already. Otherwise they are built;
    with ``folder`` they are kept there under the content of all three inputs, and built once.
    """
    if enriched:
        train, test = read_enriched_frames(spark, enriched, multi_line=multi_line)
        return train, test
    train, test = read_play_frames(spark, (train_path, test_path), multi_line)
    documents = kept_catalogue(spark, catalogue, catalogue_store)[0] if catalogue_store else read_catalogue(spark, catalogue)
    joined = enrich_frames(train, test, catalogue_features(documents, train))
    if not folder:
        return joined
    # Every input is hashed once, for both tables.
    content = [content_key(df) for df in (train, test, flatten_documents(documents))]
    kept = [stored(df, name, content, folder) for name, df in zip(("train", "test"), joined)]
    return kept[0], kept[1]


def build_dataset(
    train: DataFrame,
    test: DataFrame,
    features: DataFrame | None = None,
    counts: tuple[str, ...] = PARITY_COUNTS,
    settings: Settings = Settings(),
    cache: str | None = None,
    across_frames: bool = False,
) -> DataFrame:
    """Both frames to features, label, id and ``split``; nulls are left for ``impute``.

    ``features`` is joined as in ``feature_table``. Columns without any value in the train
    frame are dropped from both frames.
    """
    empty = all_null_columns(train)
    train, test = train.drop(*empty), test.drop(*empty)
    both = train.withColumn(FRAME, F.lit(TRAIN)).unionByName(
        test.drop(settings.label).withColumn(FRAME, F.lit(TEST)), allowMissingColumns=True
    )
    table = history_features(both, counts, settings, cache=cache, across_frames=across_frames)
    return row_features(table if features is None else enrich(table, features)).drop(FRAME, *RAW_COLUMNS)


def impute(dataset: DataFrame, parity: bool = False, settings: Settings = Settings()) -> DataFrame:
    """Fill nulls by medians and modes of the train rows; ``parity`` also learns from val rows.

    ``dataset`` is read several times, so it should be a table (``settled``) and not a plan. One pass finds
    the columns that have a null in any fold; fills are learned for these alone.
    """
    features = feature_columns(dataset, (settings.fold_column,))
    seen = dataset.agg(*[F.max(F.col(f"`{c}`").isNull()).alias(c) for c in features]).first()
    features = [c for c in features if seen[c]]
    if not features:
        return dataset
    fold = F.col(settings.fold_column)
    learn = dataset.where(fold != TEST if parity else fold == TRAIN).select(*features)
    stage = ColumnImputer(numberCols=numeric_columns(learn), textCols=categorical_columns(learn))
    return stage.fit(learn).transform(dataset)
