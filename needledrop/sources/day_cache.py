"""History counts kept by day: only days whose plays, or whose day before, have changed are counted again.

A trailing count looks back a day at most, so what is stored for a day depends on its plays and on those of
the day before. Both have a key of their content; a stored day is named by the pair. The counts of a run
go to a folder of its own, partitioned by day, and an index of (day, name, folder) is added once they are
complete: a run that dies leaves files that the index does not name. Nothing is overwritten.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needledrop.config import BIN_SUFFIX_COLUMN, MICROS_PER_DAY, Settings
from needledrop.functions import floor_div, micros, wall_clock
from needledrop.operators.history import HISTORY_COLUMNS, with_history
from needledrop.sources.store import content_sums, path_exists

# Counts that know no later play; the others depend on all days.
DAY_COUNTS = tuple(c for c in HISTORY_COLUMNS if c != BIN_SUFFIX_COLUMN)
# Raise when an operator changes what it counts.
CACHE_VERSION = 1

_INDEX = "day long, name string, folder string"


def day_keys(rows: DataFrame, columns: list[str], kinds: str) -> DataFrame:
    """(day, key): a text per ``_day`` that changes with any value of ``columns``; one row per calendar day."""
    sums = content_sums(columns)
    found = rows.groupBy(F.col("_day").alias("day")).agg(*sums)
    values = [F.col(f"`{c}`").cast("string") for c in found.columns[1:]]
    return found.select("day", F.sha2(F.concat_ws(",", F.lit(f"{CACHE_VERSION}:{kinds}"), *values), 256).alias("key"))


def day_index(spark: SparkSession, folder: str) -> dict[tuple[int | None, str], str]:
    """The folder that holds each stored day, by day and name; a few names per calendar day."""
    path = f"{folder}/index"
    found = spark.read.schema(_INDEX).parquet(path).collect() if path_exists(spark, path) else []
    return {(r["day"], r["name"]): r["folder"] for r in found}


def note_days(spark: SparkSession, folder: str, new: list[tuple[int | None, str, str]]) -> dict[tuple[int | None, str], str]:
    """Add complete days to the index."""
    spark.createDataFrame(new, _INDEX).coalesce(1).write.mode("append").parquet(f"{folder}/index")
    return {(d, name): path for d, name, path in new}


def kept_days(spark: SparkSession, stored: dict[tuple[int | None, str], str], names: dict[int | None, str]) -> DataFrame | None:
    """The stored rows of the named days; None without any."""
    by_folder: dict[str, list[int | None]] = {}
    for d, name in names.items():
        by_folder.setdefault(stored[(d, name)], []).append(d)
    whole = None
    for path, days in sorted(by_folder.items()):
        wanted = F.col("day").isin(sorted(d for d in days if d is not None))
        part = spark.read.parquet(path).where(wanted | F.col("day").isNull() if None in days else wanted)
        whole = part if whole is None else whole.unionByName(part)
    return whole


def cached_history(
    df: DataFrame, folder: str, columns: tuple[str, ...] = DAY_COUNTS, keys: list[str] | None = None, settings: Settings = Settings()
) -> tuple[DataFrame, list[int]]:
    """The plays' keys, id and time with history counts from the cache in ``folder``, and the days that were counted now.

    Days are numbered from 1970-01-01. A day is counted again if a play of it or of the day before came, went or
    changed in keys, id or time; what other columns hold does not matter. Only one row per calendar day
    comes to the driver. The keys default to the user.
    """
    if set(columns) - set(DAY_COUNTS):
        raise ValueError(f"not counted by day: {sorted(set(columns) - set(DAY_COUNTS))}")
    spark, keys = df.sparkSession, list(keys) if keys else [settings.user]
    needed = list(dict.fromkeys([*keys, settings.obs_id, settings.ts]))
    rows = wall_clock(df.select(*needed), settings.ts)
    dated = rows.withColumn("_day", floor_div(micros(settings.ts), MICROS_PER_DAY))
    folder = folder.rstrip("/")
    content = {r["day"]: r["key"] for r in day_keys(dated, needed, f"{rows.schema.simpleString()}{columns}").collect()}
    # Rows without a time have no day; they are refused below, as everywhere in a history.
    names = {d: f"{k}-{content.get(d - 1, '')}" if d is not None else k for d, k in content.items()}
    stored = day_index(spark, folder)
    missing = sorted((d for d, name in names.items() if (d, name) not in stored), key=lambda d: (d is not None, d))
    if missing:
        near = {x for d in missing if d is not None for x in (d - 1, d)}
        some = F.col("_day").isin(sorted(near)) | F.col("_day").isNull()
        counted = with_history(dated.where(some).drop("_day"), columns, keys, settings)
        day = floor_div(micros(settings.ts), MICROS_PER_DAY)
        counted = counted.withColumn("day", day).where(F.col("day").isin([d for d in missing if d is not None]))
        target = f"{folder}/run-{uuid.uuid4().hex}"
        counted.repartition("day", F.pmod(F.xxhash64(*keys), F.lit(16))).write.partitionBy("day").parquet(target)
        stored |= note_days(spark, folder, [(d, names[d], target) for d in missing if d is not None])
    whole = kept_days(spark, stored, names)
    if whole is None:
        return with_history(rows.limit(0), columns, keys, settings), []
    return whole.select(*needed, *columns), missing
