"""Mergeable summaries of columns: quantiles (KLL) and distinct counts (HyperLogLog).

A sketch has a bounded size however many rows it has seen, and sketches of parts merge to one of the whole.
So they are kept per day, or per partition of any other kind, and a report over a longer time merges them
without a look at the rows. Errors are relative to the rows (quantiles) or to the count (distinct values).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUANTILE_K = 4096
DISTINCT_BITS = 14


def rank_error(k: int = QUANTILE_K) -> float:
    """The documented bound of a quantile's rank, as a share of the rows: twice the published 99 % error of KLL."""
    return 2 * 2.296 / k**0.9021


def distinct_error(bits: int = DISTINCT_BITS) -> float:
    """The documented bound of a distinct count, as a share of it: four standard errors of HyperLogLog."""
    return 4 * 1.04 / math.sqrt(2**bits)


def _named(c: Column) -> Column:
    """64 bits of a value; two values share them with a probability that no sketch of this size can see."""
    return F.when(c.isNotNull(), F.xxhash64(c))


def distinct_estimate(c: Column, bits: int = DISTINCT_BITS) -> Column:
    """The distinct count of an aggregate, from a sketch; 0 without values."""
    return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(_named(c), bits)), F.lit(0).cast("bigint"))


def sketched(
    df: DataFrame, columns: list[str], by: list[str], k: int = QUANTILE_K, bits: int = DISTINCT_BITS, numbers: list[str] | None = None
) -> DataFrame:
    """(by ..., column, n, quantiles, distinct): one row per group and column, in one aggregation.

    ``n`` counts the values that are neither null nor NaN. ``quantiles`` is null for a column that is not in
    ``numbers`` (default: all are) or has no value in the group. Columns are aggregated side by side, so rows
    are not multiplied by them, and every task sends one sketch per group and column.
    """
    if not columns:
        raise ValueError("no columns to sketch")
    numeric = set(columns if numbers is None else numbers)
    values = {}
    for c in columns:
        v = F.col(f"`{c}`")
        # -0.0 + 0.0 is 0.0, so that both zeros are one value.
        number = v.cast("double") + F.lit(0.0)
        values[c] = F.when(~F.isnan(number), number) if c in numeric else v
    wide = df.select(*by, *[v.alias(f"_{i}") for i, v in enumerate(values.values())])
    measures = []
    for i, c in enumerate(columns):
        v = F.col(f"_{i}")
        measures += [F.count(v).alias(f"_{i}_n"), F.hll_sketch_agg(_named(v), bits).alias(f"_{i}_d")]
        if c in numeric:
            measures.append(F.kll_sketch_agg_double(v, k).alias(f"_{i}_q"))
    found = wide.groupBy(*by).agg(*measures)
    rows = []
    for i, c in enumerate(columns):
        n = F.col(f"_{i}_n")
        quantiles = F.when(n > 0, F.col(f"_{i}_q")) if c in numeric else F.lit(None).cast("binary")
        rows.append(F.struct(F.lit(c).alias("column"), n.alias("n"), quantiles.alias("quantiles"), F.col(f"_{i}_d").alias("distinct")))
    return found.select(*by, F.inline(F.array(*rows)))


def merged(sketches: DataFrame, by: list[str], k: int = QUANTILE_K) -> DataFrame:
    """The sketches of coarser groups ``by`` (their names may be fewer than those kept, or none)."""
    return sketches.groupBy(*by, "column").agg(
        F.sum("n").alias("n"),
        F.when(F.count("quantiles") > 0, F.kll_merge_agg_double("quantiles", k)).alias("quantiles"),
        F.hll_union_agg("distinct").alias("distinct"),
    )


def sketch_quantiles(sketches: DataFrame, probs: list[float], by: list[str] | None = None) -> DataFrame:
    """(by ..., column, prob, n, value): a value whose rank is within ``rank_error`` of prob; groups without values have no row."""
    asked = F.array(*[F.lit(float(p)) for p in probs])
    usable = (F.col("n") > 0) & F.col("quantiles").isNotNull()
    rows = sketches.where(usable)
    # Asked under the condition too: the planner adds a filter on the answers, and an empty sketch has none.
    found = F.when(usable, F.kll_sketch_get_quantile_double("quantiles", asked))
    pairs = F.arrays_zip(asked.alias("prob"), found.alias("value"))
    return rows.select(*(by or []), "column", "n", F.inline(pairs)).select(*(by or []), "column", "prob", "n", "value")


def sketch_distinct(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by ..., column, n, n_distinct): the distinct count is within ``distinct_error`` of the exact one."""
    return sketches.select(*(by or []), "column", "n", F.hll_sketch_estimate("distinct").alias("n_distinct"))
