"""Split every user's history by calendar date into train and validation rows.

The first ``max(1, floor(n * fraction))`` rows of a user, in the order (date, obs_id), are train. A row's
place is its place among the rows of its day plus the rows of earlier days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from needledrop.config import Settings
from needledrop.operators.history import IS_TRAIN, by_day

TRAIN, VALIDATION, TEST = "train", "val", "test"


def fold_name(is_train: Column) -> Column:
    return F.when(is_train, TRAIN).otherwise(VALIDATION)


def with_time_split(
    df: DataFrame, keys: list[str] | None = None, settings: Settings = Settings()
) -> DataFrame:
    """Add ``split`` with the values train and val."""
    rows = by_day(df, list(keys) if keys else [settings.user], set(), settings, split=True)
    return rows.select(*df.columns, fold_name(F.col(IS_TRAIN)).alias(settings.fold_column))
