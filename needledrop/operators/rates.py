"""Share of forward presses per user, learned from the train rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from needledrop.config import MICROS_PER_DAY, RATE_COLUMN, Settings
from needledrop.functions import floor_div, micros, wall_clock
from needledrop.operators.columns import reject_null_keys
from needledrop.operators.split import TRAIN
from needledrop.sources.store import settled


def user_rates(df: DataFrame, learn: Column, settings: Settings = Settings()) -> DataFrame:
    """One row per user with at least one learning row."""
    return df.where(learn).groupBy(settings.user).agg(F.avg(settings.label).alias(RATE_COLUMN))


def global_rate(df: DataFrame, learn: Column, settings: Settings = Settings()) -> DataFrame:
    """One row: the rate over all learning rows."""
    return df.where(learn).agg(F.avg(settings.label).alias("_global_rate"))


def with_user_rate(
    df: DataFrame, learn: Column | None = None, settings: Settings = Settings()
) -> DataFrame:
    """Add the rate of each row's user; users without learning rows get the global rate.

    The rates are written first: the join then reads both sides from plain exchanges, and the adaptive
    planner can split the partition of a hot user. No broadcast is forced, but of the one row of the global rate.
    """
    learn = F.col(settings.fold_column) == TRAIN if learn is None else learn
    keep = df.columns
    joined = df.join(settled(user_rates(df, learn, settings), "rates"), settings.user, "left")
    joined = joined.crossJoin(F.broadcast(global_rate(df, learn, settings)))
    return joined.select(*keep, F.coalesce(RATE_COLUMN, "_global_rate").alias(RATE_COLUMN))


def with_past_rate(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Add the share of forward presses among the earlier plays of each row's user; its own label takes no part.

    Earlier is by time, ties by id. A user without earlier labels gets the share over all plays of earlier days, and
    null on the first day. Null labels count for nothing, so test rows learn and do not teach.

    A window partition is one user and day; sums of earlier days, one row per user and day, are carried over.
    """
    keep, user, label = df.columns, settings.user, F.col(settings.label).cast("double")
    rows = reject_null_keys(wall_clock(df, settings.ts), settings).withColumn("_us", micros(settings.ts))
    rows = rows.withColumn("_day", floor_div("_us", MICROS_PER_DAY))
    days = rows.groupBy(user, "_day").agg(F.sum(label).alias("_s"), F.count(label).alias("_n"))
    # Both kinds of totals are read from one table; written, the join below can split a hot user.
    days = settled(days, "rate-days")

    def earlier(by: list[str], table: DataFrame, name: str) -> DataFrame:
        before = W.partitionBy(*by).orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
        sums = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{name}{c}") for c in ("_s", "_n")]
        return table.select(*by, "_day", *sums)

    own = settled(earlier([user], days, "_own"), "rate-earlier-days")
    everyone = earlier([], days.groupBy("_day").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n")), "_all")
    # One row per calendar day.
    rows = rows.join(own, [user, "_day"]).join(F.broadcast(everyone), "_day")
    before = W.partitionBy(user, "_day").orderBy("_us", settings.obs_id).rowsBetween(W.unboundedPreceding, -1)
    s = F.col("_own_s") + F.coalesce(F.sum(label).over(before), F.lit(0.0))
    n = F.col("_own_n") + F.coalesce(F.count(label).over(before), F.lit(0))
    rate = F.when(n > 0, s / n).when(F.col("_all_n") > 0, F.col("_all_s") / F.col("_all_n"))
    return rows.withColumn(RATE_COLUMN, rate).select(*[c for c in keep if c != RATE_COLUMN], RATE_COLUMN)
