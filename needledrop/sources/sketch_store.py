"""Sketches kept by day: a day is sketched again only if its values have changed.

A day's sketches are named by the content of its rows. A run writes those that are missing to a folder of its
own and adds (day, name, folder) to an index when they are complete, so a run that dies counts for nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needledrop.config import MICROS_PER_DAY, Settings
from needledrop.functions import floor_div, micros, wall_clock
from needledrop.operators.sketches import DISTINCT_BITS, QUANTILE_K, sketched
from needledrop.sources.day_cache import day_index, day_keys, kept_days, note_days


def kept_sketches(
    df: DataFrame,
    folder: str,
    columns: list[str],
    by: list[str] | None = None,
    numbers: list[str] | None = None,
    k: int = QUANTILE_K,
    bits: int = DISTINCT_BITS,
    settings: Settings = Settings(),
) -> tuple[DataFrame, list[int | None]]:
    """(day, by ..., column, n, quantiles, distinct) from ``folder``, and the days that were sketched now.

    Days are numbered from 1970-01-01; rows without a time are a day of their own, null. One row per calendar
    day comes to the driver. An empty table gives no row.
    """
    spark, by, folder = df.sparkSession, list(by or []), folder.rstrip("/")
    needed = list(dict.fromkeys([settings.ts, *by, *columns]))
    rows = wall_clock(df.select(*needed), settings.ts).withColumn("_day", floor_div(micros(settings.ts), MICROS_PER_DAY))
    kinds = f"sketch:{rows.schema.simpleString()}{columns}{by}{numbers}{k},{bits}"
    names = {r["day"]: r["key"] for r in day_keys(rows, needed, kinds).collect()}
    stored = day_index(spark, folder)
    missing = sorted((d for d, name in names.items() if (d, name) not in stored), key=lambda d: (d is not None, d))
    if missing:
        some = F.col("_day").isin([d for d in missing if d is not None])
        some = some | F.col("_day").isNull() if None in missing else some
        found = sketched(rows.where(some), columns, ["_day", *by], k, bits, numbers)
        target = f"{folder}/run-{uuid.uuid4().hex}"
        found.withColumnRenamed("_day", "day").repartition("day").write.partitionBy("day").parquet(target)
        stored |= note_days(spark, folder, [(d, names[d], target) for d in missing])
    whole = kept_days(spark, stored, names)
    if whole is None:
        return sketched(rows.limit(0), columns, ["_day", *by], k, bits, numbers).withColumnRenamed("_day", "day"), []
    return whole.select(F.col("day").cast("bigint").alias("day"), *by, "column", "n", "quantiles", "distinct"), missing
