"""Exact quantiles and modes without a sort of all values in one task.

A value is located in up to three passes. The first counts values per bucket of a monotone
map (1024 buckets per power of two), the second per 1/65536 of the bucket that holds the
wanted rank, the third per distinct value of the piece that is left. Each pass combines on
the map side, and the last one sees at most the doubles between two neighbours of a relative
distance of 2**-26, however many rows there are. The maps only have to be monotone and
repeatable, so the result is the exact order statistic. A piece of one value ends the
search, so data with few values needs the first pass only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from needledrop.sources.store import settled

_PER_OCTAVE = 1024
_OFFSET = 1 << 21  # above 1075 * 1024, so the sign decides first
_PIECES = 65_536


def monotone_bucket(v: Column) -> Column:
    """Integer bucket that never decreases as the finite value grows."""
    size = F.abs(v)
    top = F.lit(2 * _OFFSET).cast("bigint")
    far = F.when(size == F.lit(float("inf")), top).otherwise(
        F.floor(F.log2(size) * _PER_OCTAVE).cast("bigint") + _OFFSET
    )
    return F.when(v > 0, far).when(v < 0, -far).otherwise(F.lit(0).cast("bigint"))


def _ranked(counts: DataFrame, group: list[str], order: str) -> DataFrame:
    """Add the number of earlier values; a group has one row per bucket or distinct value."""
    earlier = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("bigint")))


def _holds_rank() -> Column:
    return (F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_n"))


def long_values(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by ..., column, value) with the values as doubles and without nulls and NaN."""
    wide = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    long = wide.unpivot(by, columns, "column", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def _pieces(found: DataFrame, wanted: list[str]) -> DataFrame:
    """The pieces that hold the wanted ranks, one row per group, column, prob and end."""
    left = (F.col("_rank") - F.col("_before")).alias("_rank")
    return found.where(_holds_rank()).select(*wanted, "_lo", "_hi", left, "_frac")


def exact_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], by: list[str] | None = None
) -> DataFrame:
    """(by ..., column, prob, value): quantiles with linear interpolation between ranks.

    Two rows per group, column and prob are written between the passes; the planner decides how the
    values are joined with them. Groups without values have no row.
    """
    by = list(by or [])
    long = long_values(df, columns, by)
    group = [*by, "column"]
    wanted = [*group, "prob", "end"]

    def narrowed(pieces: DataFrame) -> DataFrame:
        t = pieces.withColumnsRenamed({c: f"_t_{c}" for c in group})
        match = [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in group]
        inside = F.col("value").between(F.col("_lo"), F.col("_hi"))
        return long.join(t, [*match, inside])

    measures = [F.count(F.lit(1)).alias("_n"), F.min("value").alias("_lo"), F.max("value").alias("_hi")]
    carried = [F.max("_rank").alias("_rank"), F.max("_frac").alias("_frac")]

    buckets = long.groupBy(*group, monotone_bucket(F.col("value")).alias("_b")).agg(*measures)
    buckets = _ranked(buckets, group, "_b").withColumn("_all", F.sum("_n").over(W.partitionBy(*group)))
    ends = F.array(
        *[
            F.struct(F.lit(float(p)).alias("prob"), F.lit(e).alias("end"))
            for p in probs
            for e in ("lower", "upper")
        ]
    )
    position = (F.col("_all") - 1) * F.col("prob")
    rank = F.when(F.col("end") == "lower", F.floor(position)).otherwise(F.ceil(position))
    buckets = buckets.select("*", F.inline(ends)).withColumns(
        {"_rank": rank.cast("bigint"), "_frac": position - F.floor(position)}
    )
    pieces = settled(_pieces(buckets, wanted), "pieces")

    width = F.col("_hi") - F.col("_lo")
    share = F.when(width > 0, F.floor((F.col("value") - F.col("_lo")) / width * _PIECES)).otherwise(0)
    for part in (share, F.col("value")):
        wide = pieces.where(F.col("_lo") != F.col("_hi"))
        if wide.isEmpty():
            break
        counts = narrowed(wide).groupBy(*wanted, part.alias("_b")).agg(*measures, *carried)
        closed = pieces.where(F.col("_lo") == F.col("_hi"))
        pieces = settled(closed.unionByName(_pieces(_ranked(counts, wanted, "_b"), wanted)), "pieces")

    lower = F.max(F.when(F.col("end") == "lower", F.col("_lo")))
    upper = F.max(F.when(F.col("end") == "upper", F.col("_lo")))
    frac = F.max("_frac")
    value = F.when(frac > 0, lower * (1 - frac) + upper * frac).otherwise(lower)
    return pieces.groupBy(*group, "prob").agg(value.alias("value"))


def smallest_modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n): the most frequent value as text; a tie goes to the smallest.

    Counts combine on the map side, so a value that fills a third of the table is one row
    per task in the shuffle.
    """
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    counts = (
        texts.unpivot([], columns, "column", "value")
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("m"), "value")).alias("_b"))
    return best.select("column", F.col("_b.value").alias("value"), (-F.col("_b.m")).alias("n"))
