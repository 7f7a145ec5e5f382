"""Per-user play counts: order in the day, trailing intervals, 20-minute bins, and the time split.

A window partition is one user and day, never a user. No interval is longer than a day, so for the
trailing counts every play is also sent to the next day, without its other columns. A count over
[t - span, t) is the count before t less the count before t - span: both frames start at the
partition's first row, which Spark adds up row by row, while it recounts a sliding frame for each row.
What reaches further than a day (the bins open towards the future, and the split) adds totals carried over
from other days, which have one row per user and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from needledrop.config import (
    BIN_COLUMN,
    BIN_MINUTES,
    BIN_SUFFIX_COLUMN,
    MICROS_PER_DAY,
    MICROS_PER_MINUTE,
    ORDER_COLUMN,
    TRAILING_MINUTES,
    Settings,
)
from needledrop.functions import floor_div, micros, wall_clock
from needledrop.operators.columns import reject_null_keys

HISTORY_COLUMNS = (ORDER_COLUMN, BIN_SUFFIX_COLUMN, *TRAILING_MINUTES, BIN_COLUMN)
IS_TRAIN = "_is_train"
_BIN = BIN_MINUTES * MICROS_PER_MINUTE


def train_rows(n: Column, settings: Settings) -> Column:
    """Number of train rows of a user with ``n`` rows; the product stays a double."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor(n * F.lit(float(settings.train_frac))))


def day_totals(timed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _day, _earlier, _all): plays on earlier days and in all; one row per key and day."""
    days = timed.groupBy(*keys, "_day").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    return days.select(
        *keys,
        "_day",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("bigint")).alias("_earlier"),
        F.sum("_n").over(W.partitionBy(*keys)).alias("_all"),
    )


def _with_next_day(rows: DataFrame, needed: list[str]) -> DataFrame:
    """Every play on its own day (``_own``), and once more, with the needed columns only, on the next."""
    places = F.array(
        F.struct(F.col("_day").alias("_day"), F.lit(True).alias("_own")),
        F.struct((F.col("_day") + 1).alias("_day"), F.lit(False).alias("_own")),
    )
    others = [c for c in rows.columns if c != "_day" and c not in needed]
    placed = rows.select(*needed, *others, F.inline(places))
    return placed.withColumns({c: F.when(F.col("_own"), F.col(f"`{c}`")) for c in others}) if others else placed


def by_day(
    df: DataFrame, keys: list[str], wanted: set[str], settings: Settings = Settings(), split: bool = False
) -> DataFrame:
    """Add the wanted counts, and with ``split`` the flag ``_is_train``; other ``_`` columns are scratch."""
    timed = reject_null_keys(wall_clock(df, settings.ts), settings).withColumn("_us", micros(settings.ts))
    rows = timed.withColumn("_day", floor_div("_us", MICROS_PER_DAY))
    carried = split or BIN_SUFFIX_COLUMN in wanted
    totals = day_totals(rows, keys) if carried else None
    spans = {name: minutes for name, minutes in TRAILING_MINUTES.items() if name in wanted}
    if spans:
        rows = _with_next_day(rows, [*keys, settings.obs_id, "_us"])
    else:
        rows = rows.withColumn("_own", F.lit(True))
    if carried:
        rows = rows.join(totals, [*keys, "_day"], "left")
    day = W.partitionBy(*keys, "_day")
    in_order = day.orderBy("_us", settings.obs_id)
    upto_here = in_order.rowsBetween(W.unboundedPreceding, W.currentRow)
    own = F.col("_own").cast("bigint")
    out: dict[str, Column] = {}
    if ORDER_COLUMN in wanted or BIN_SUFFIX_COLUMN in wanted:
        rows = rows.withColumn("_pos", F.sum(own).over(upto_here))
        out[ORDER_COLUMN] = F.col("_pos").cast("int")
    if BIN_SUFFIX_COLUMN in wanted or BIN_COLUMN in wanted:
        rows = rows.withColumn("_bin", floor_div("_us", _BIN))
    if BIN_SUFFIX_COLUMN in wanted:
        rows = rows.withColumn("_before_bin", F.lag("_bin").over(in_order))
        opens = F.when(~F.col("_before_bin").eqNullSafe(F.col("_bin")), F.col("_pos"))
        rows = rows.withColumn("_opened", F.max(opens).over(upto_here))
        out[BIN_SUFFIX_COLUMN] = F.col("_all") - F.col("_earlier") - F.col("_opened") + 1
    clock = day.orderBy("_us")

    def before(micros_ago: int) -> Column:
        return F.count(F.lit(1)).over(clock.rangeBetween(W.unboundedPreceding, -micros_ago))

    for name, minutes in spans.items():
        out[name] = before(1) - before(minutes * MICROS_PER_MINUTE + 1)
    rows = rows.withColumns({c: v for c, v in out.items() if c in wanted}) if wanted else rows
    if BIN_COLUMN in wanted:
        rows = rows.withColumn(BIN_COLUMN, F.sum(own).over(W.partitionBy(*keys, "_day", "_bin")))
    if split:
        by_id = day.orderBy(settings.obs_id).rowsBetween(W.unboundedPreceding, W.currentRow)
        place = F.col("_earlier") + F.sum(own).over(by_id)
        rows = rows.withColumn(IS_TRAIN, place <= train_rows(F.col("_all"), settings))
    return rows.where("_own").select(*timed.columns, *[c for c in HISTORY_COLUMNS if c in wanted], *([IS_TRAIN] if split else []))


def with_history(
    df: DataFrame,
    columns: tuple[str, ...] = HISTORY_COLUMNS,
    keys: list[str] | None = None,
    settings: Settings = Settings(),
) -> DataFrame:
    """Add the wanted count columns; counts see the rows of the same ``keys`` only."""
    unknown = set(columns) - set(HISTORY_COLUMNS)
    if unknown:
        raise ValueError(f"unknown history columns: {sorted(unknown)}")
    counted = by_day(df, list(keys) if keys else [settings.user], set(columns), settings)
    return counted.select(*df.columns, *columns)


def with_track_order(df: DataFrame, keys: list[str] | None = None, settings: Settings = Settings()) -> DataFrame:
    return with_history(df, (ORDER_COLUMN,), keys, settings)


def with_rolling_counts(df: DataFrame, keys: list[str] | None = None, settings: Settings = Settings()) -> DataFrame:
    return with_history(df, (BIN_SUFFIX_COLUMN, *TRAILING_MINUTES), keys, settings)


def with_bin_counts(df: DataFrame, keys: list[str] | None = None, settings: Settings = Settings()) -> DataFrame:
    return with_history(df, (BIN_COLUMN,), keys, settings)
