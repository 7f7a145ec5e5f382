"""Boosted trees round by round: the margin after every round, and the AUC of all rounds at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.regression import DecisionTreeRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Trees whose sums share one array; more follow in the next step of the plan.
BLOCK = 25


@dataclass(frozen=True)
class Node:
    """A node of an exported tree; ``feature`` is -1 in a leaf, rows of at most ``threshold`` go left."""

    tree: int
    node: int
    feature: int
    threshold: float
    left: int
    right: int
    prediction: float


def exported_nodes(spark: SparkSession, path: str) -> list[Node]:
    """The nodes of a saved boosted-tree model with number features, as small as the model itself."""
    rows = spark.read.parquet(f"{path.rstrip('/')}/data").select("treeID", "nodeData.*")
    split = F.col("split")
    rows = rows.select(
        "treeID", "id", split.featureIndex.alias("feature"), F.try_element_at(split.leftCategoriesOrThreshold, F.lit(1)).alias("threshold"),
        "leftChild", "rightChild", "prediction", split.numCategories.alias("categories"),
    )
    found = rows.orderBy("treeID", "id").collect()
    if any(r["feature"] >= 0 and r["categories"] >= 0 for r in found):
        raise ValueError("splits by category have no threshold")
    return [
        Node(r["treeID"], r["id"], r["feature"], r["threshold"] or 0.0, r["leftChild"], r["rightChild"], r["prediction"]) for r in found
    ]


def tree_column(nodes: list[Node], features: list[Column]) -> Column:
    """What one exported tree predicts, as a plain expression."""
    by_id = {n.node: n for n in nodes}

    def below(at: int) -> Column:
        n = by_id[at]
        if n.feature < 0:
            return F.lit(n.prediction)
        return F.when(features[n.feature] <= n.threshold, below(n.left)).otherwise(below(n.right))

    return below(0)


def running_sums(values: list[Column], start: Column) -> Column:
    """The array of ``start`` plus the first, the first two, ... of ``values``."""
    grown = F.aggregate(
        F.array(*[v.cast("double") for v in values]),
        F.array(start.cast("double")),
        lambda sums, v: F.concat(sums, F.array(F.element_at(sums, -1) + v)),
    )
    return F.slice(grown, 2, len(values))


def staged_margins(rows: DataFrame, predictions: list[Column], weights: list[float], out: str = "margins") -> DataFrame:
    """Add the array of margins after each round, from one prediction per tree."""
    total, parts = F.lit(0.0), []
    for at in range(0, len(predictions), BLOCK):
        part = f"_margins_{at}"
        weighted = [p * w for p, w in zip(predictions[at : at + BLOCK], weights[at : at + BLOCK])]
        rows = rows.withColumn(part, running_sums(weighted, total))
        total = F.element_at(part, -1)
        parts.append(part)
    return rows.withColumn(out, F.concat(*parts)).drop(*parts)


def with_tree(rows: DataFrame, tree: DecisionTreeRegressionModel, out: str, features: str = "features") -> DataFrame:
    """Add what one fitted tree predicts."""
    return tree.setFeaturesCol(features).setPredictionCol(out).transform(rows)


def staged_auc(df: DataFrame, label: str = "label", margins: str = "margins", grid: int | None = None) -> DataFrame:
    """(round, auc, error): the AUC of every element of an array column, rounds from 1, in one aggregation.

    Exact without ``grid``: ties count as half, ``error`` is 0. With it the probability 1 / (1 + exp(-2 margin)) is
    cut into so many equal steps before rows are added up, so a round sends at most grid + 1 rows per task however
    large the table is, and the AUC is off by ``error`` at most: half the share of pairs that meet in one step.
    Rounds with one class only have a null AUC. Null labels, margins and elements take no part.
    """
    long = df.where(F.col(label).isNotNull()).select(F.col(label).cast("bigint").alias("_y"), F.posexplode(margins).alias("_at", "_s"))
    step = F.col("_s") if grid is None else F.floor(grid / (1 + F.exp(-2 * F.col("_s"))))
    per_score = long.where("_s IS NOT NULL").groupBy((F.col("_at") + 1).alias("round"), step.alias("_s")).agg(
        F.sum("_y").alias("_p"), F.sum(1 - F.col("_y")).alias("_n")
    )
    # Rounds and scores are laid out by range; only totals per range and round meet again.
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid_out = per_score.repartitionByRange(ranges, "round", "_s").withColumn("_range", F.spark_partition_id())
    zero = F.lit(0).cast("bigint")
    below = W.partitionBy("_range", "round").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    laid_out = laid_out.withColumn("_below", F.coalesce(F.sum("_n").over(below), zero))
    p, n = F.col("_p").cast("decimal(18,0)"), F.col("_n").cast("decimal(18,0)")
    half_pairs = F.col("_p").cast("decimal(18,0)") * (2 * F.col("_below") + F.col("_n")).cast("decimal(19,0)")
    per_range = laid_out.groupBy("round", "_range").agg(
        F.sum("_p").alias("_p"), F.sum("_n").alias("_n"), F.sum(half_pairs.cast("decimal(38,0)")).alias("_half"),
        F.sum((p * n).cast("decimal(38,0)")).alias("_met"),
    )
    earlier = W.partitionBy("round").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    per_range = per_range.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), zero))
    won = F.sum(F.col("_half").cast("double") / 2 + F.col("_p").cast("double") * F.col("_offset"))
    pairs = F.sum("_p").cast("double") * F.sum("_n")
    met = F.sum(F.col("_met").cast("double")) / 2 if grid else F.lit(0.0)
    return per_range.groupBy("round").agg(
        F.when(pairs > 0, won / pairs).alias("auc"), F.when(pairs > 0, met / pairs).alias("error")
    )

