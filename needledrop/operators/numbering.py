"""Consecutive numbers over a whole table, in the order of a unique integer key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_FINE_BITS, _COARSE_BITS = 21, 42


def with_sequential_id(df: DataFrame, order: str, name: str = "seq_id") -> DataFrame:
    """Add 0, 1, 2, ... by ascending ``order``, a unique BIGINT.

    Rows are numbered inside blocks of 2**21 keys, and the blocks inside groups of 2**21
    blocks, so no window ever holds more than 2**22 rows.
    """
    fine = F.shiftright(F.col(order).cast("bigint"), _FINE_BITS)
    blocks = df.groupBy(fine.alias("_fine")).agg(F.count(F.lit(1)).alias("_n"))
    blocks = blocks.withColumn("_coarse", F.shiftright("_fine", _COARSE_BITS - _FINE_BITS))
    groups = blocks.groupBy("_coarse").agg(F.sum("_n").alias("_n"))
    zero = F.lit(0).cast("bigint")
    earlier = W.orderBy("_coarse").rowsBetween(W.unboundedPreceding, -1)
    groups = groups.select("_coarse", F.coalesce(F.sum("_n").over(earlier), zero).alias("_base"))
    inside = W.partitionBy("_coarse").orderBy("_fine").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("_first", F.coalesce(F.sum("_n").over(inside), zero))
    blocks = blocks.join(groups, "_coarse").select("_fine", (F.col("_base") + F.col("_first")).alias("_first"))
    keep = df.columns
    numbered = df.withColumn("_fine", fine).join(blocks, "_fine")
    in_block = F.row_number().over(W.partitionBy("_fine").orderBy(order))
    return numbered.select(*keep, (F.col("_first") + in_block - 1).alias(name))
