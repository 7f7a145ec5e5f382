"""Operators on the column set of a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from needledrop.config import Settings

# Columns the feature table does without.
RAW_COLUMNS = (
    "ts",
    "master_metadata_album_artist_name",
    "master_metadata_track_name",
    "episode_name",
    "episode_show_name",
    "master_metadata_album_album_name",
    "ip_addr",
    "spotify_track_uri",
    "spotify_episode_uri",
    "track_id",
)
# Columns that are not features.
NOT_FEATURES = ("reason_end", "obs_id", "ts", "offline_timestamp", "fwdbtn")
# Columns whose nulls become 0 and whose nulls become 'unknown'.
FLAG_COLUMNS = ("explicit", "shuffle", "offline", "incognito_mode")
NAME_COLUMNS = ("platform", "conn_country", "album_type", "username")
UNKNOWN = "unknown"


def null_nans(df: DataFrame) -> DataFrame:
    """NaN and null are the same missing value; keep only null."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not floats:
        return df
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def reject_null_keys(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Fail, when the plan runs, on a row without user, time or id; such rows have no place in a history."""
    missing = F.col(settings.user).isNull() | F.col(settings.ts).isNull() | F.col(settings.obs_id).isNull()
    error = F.raise_error(F.lit(f"null in {settings.user}, {settings.ts} or {settings.obs_id}; a quoted line break in a text file needs multi_line"))
    return df.withColumn(settings.obs_id, F.when(missing, error.cast("bigint")).otherwise(F.col(settings.obs_id)))


def all_null_columns(df: DataFrame) -> list[str]:
    """Names of the columns without any value; one job, one row back."""
    row = df.agg(*[F.max(F.col(f"`{c}`").isNotNull()).alias(c) for c in df.columns]).first()
    # An empty frame has no evidence against a column.
    return [c for c in df.columns if row[c] is False]


def drop_all_null_columns(df: DataFrame, decide_on: DataFrame | None = None) -> DataFrame:
    """Drop the columns that hold nothing in ``decide_on`` (default: in ``df`` itself)."""
    return df.drop(*all_null_columns(df if decide_on is None else decide_on))


def fill_constants(
    df: DataFrame, flags: tuple[str, ...] = FLAG_COLUMNS, names: tuple[str, ...] = NAME_COLUMNS
) -> DataFrame:
    """Flags become 0/1 with 0 for null, names get a word for null; absent columns are skipped."""
    new = {c: F.coalesce(F.col(c).cast("tinyint"), F.lit(0).cast("tinyint")) for c in flags if c in df.columns}
    new |= {c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) for c in names if c in df.columns}
    return df.withColumns(new) if new else df


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    """Everything that is not a number; booleans count as categories."""
    return [f.name for f in df.schema if not isinstance(f.dataType, T.NumericType)]


def label_last(df: DataFrame, label: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c != label], label)


def feature_columns(df: DataFrame, also_not: tuple[str, ...] = ()) -> list[str]:
    return [c for c in df.columns if c not in NOT_FEATURES and c not in also_not]


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def membership(df: DataFrame, keys: DataFrame | None, column: str) -> DataFrame:
    """Rows whose ``column`` occurs in ``keys``; ``None`` keeps all rows."""
    return df if keys is None else df.join(keys.select(column), column, "left_semi")
