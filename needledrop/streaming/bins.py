"""Plays of the same user and 20-minute bin, counted as the plays arrive.

A play leaves the stream once, with the count of its whole bin, when the watermark has passed the bin's end. Until
then the state holds the plays of the open bins and one count per user and open bin, so it grows with the delay
and not with the history. Counts combine before they shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from needledrop.config import BIN_COLUMN, BIN_MINUTES, Settings
from needledrop.functions import micros, wall_clock
from needledrop.operators.columns import reject_null_keys


def read_play_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files with plays that appear in ``folder``, oldest first."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def with_streamed_bin_counts(plays: DataFrame, delay: str = "1 hour", settings: Settings = Settings()) -> DataFrame:
    """A stream of plays with ``songs_bin_20min``, as ``with_bin_counts`` gives for a table.

    A play may be late by ``delay`` against the latest play seen; one that comes after its bin was closed is dropped
    and counted in the query's progress (``numRowsDroppedByWatermark``), so the delay must cover the source's lateness.
    Bins that the watermark has not passed stay in the state and leave in a later run. Rows without user, time
    or id fail the query, as in a table. Repeated rows are plays of their own.
    """
    user = settings.user
    timed = reject_null_keys(wall_clock(plays, settings.ts), settings)
    # The id is asked for with the time, so that a row without a key fails before it can be filtered out.
    event = F.when(F.col(settings.obs_id).isNotNull(), F.timestamp_micros(micros(settings.ts)))
    marked = timed.withColumn("_event", event).withWatermark("_event", delay)
    bin_ = F.window("_event", f"{BIN_MINUTES} minutes")
    counts = marked.groupBy(F.col(user).alias("_user"), bin_.alias("_opened")).agg(F.count(F.lit(1)).alias(BIN_COLUMN))
    placed = marked.withColumn("_bin", bin_)
    joined = placed.join(counts, F.col(user).eqNullSafe(F.col("_user")) & (F.col("_bin") == F.col("_opened")))
    return joined.select(*plays.columns, BIN_COLUMN)


def write_bin_counts(counted: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start to write the counted plays as Parquet; each play once, also after a restart with the same checkpoint.

    ``once`` takes what has arrived and stops, else the query goes on. Both folders must be shared by all executors.
    """
    writer = counted.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(folder)
