"""Boosting that continues: trees are added in steps until the validation AUC has stopped to rise.

Spark's own boosting cannot be continued, so a longer fit grows its first trees again. Here the margin of
every row is a column; each tree is one fit of ``RandomForestRegressor`` with one tree on the gradient of the
log loss, as Spark's boosting does it, and the trees become a ``GBTClassificationModel`` in the end.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.regression import DecisionTreeRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needledrop.operators.staged import running_sums, staged_auc, with_tree
from needledrop.sources.store import removed, shared_dir

# Rounds between two looks at the validation AUC; the lineage of the margins is cut as often.
STEP = 10
# Steps of the probability for the AUC that decides when to stop; see ``staged_auc`` for its error.
GRID = 1 << 16


@dataclass
class Boosted:
    """The model cut to its best round, that round, and the AUC after each tree that was grown."""

    model: GBTClassificationModel
    rounds: int
    aucs: list[float | None]


def best_round(losses: list[float], patience: int) -> int:
    """Rounds up to the least loss, seen until ``patience`` rounds bring no progress."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def as_model(spark: SparkSession, trees: list[DecisionTreeRegressionModel], weights: list[float], n_features: int) -> GBTClassificationModel:
    """Trees and weights as Spark's boosted-tree classifier."""
    context = spark.sparkContext
    jvm, gateway = context._jvm, context._gateway
    each = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    factors = gateway.new_array(jvm.double, len(trees))
    for i, (tree, weight) in enumerate(zip(trees, weights)):
        each[i], factors[i] = tree._java_obj, weight
    uid = f"GBTClassificationModel_{uuid.uuid4().hex[:12]}"
    return GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(uid, each, factors, n_features, 2))


def cut_model(spark: SparkSession, model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The first ``rounds`` trees of a model."""
    return as_model(spark, model.trees[:rounds], list(model.treeWeights[:rounds]), model.numFeatures)


class _Rolling:
    """Rows that are written anew at each step; what they were before is removed then."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.step, self.path = spark, 0, None
        self.folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame) -> DataFrame:
        before, self.path, self.step = self.path, f"{self.folder}/{self.step}", self.step + 1
        df.write.parquet(self.path)
        if before:
            removed(self.spark, before)
        return self.spark.read.parquet(self.path)

    def close(self) -> None:
        removed(self.spark, self.folder)


def boost(
    train: DataFrame, val: DataFrame, label: str, params: dict, seed: int, patience: int, step: int = STEP, grid: int | None = GRID
) -> Boosted:
    """Grow at most ``n_estimators`` trees on ``train``; stop when ``patience`` rounds brought no greater AUC on ``val``.

    Both have ``label`` (0 or 1) and ``features``. No tree is grown twice, and the model is cut to its best round.
    A val frame of one class has no AUC; all trees are kept then.
    """
    spark = train.sparkSession
    most, rate = int(params["n_estimators"]), float(params["learning_rate"])
    side = (2 * F.col(label).cast("double") - 1).alias("_side")
    learn, judge = _Rolling(spark, "boost-train"), _Rolling(spark, "boost-val")
    try:
        rows = learn.write(train.select("features", side, F.lit(0.0).alias("_margin")))
        held = judge.write(val.select("features", F.col(label).cast("bigint").alias("_label"), F.lit(0.0).alias("_margin")))
        trees: list[DecisionTreeRegressionModel] = []
        weights: list[float] = []
        aucs: list[float | None] = []
        tree_seed, n_features = seed, 0
        while len(trees) < most:
            new = []
            for _ in range(min(step, most - len(trees))):
                m = len(trees)
                tree_seed += m
                # The first tree learns the sides themselves, as Spark's boosting has it.
                target = F.col("_side") if m == 0 else 4 * F.col("_side") / (1 + F.exp(2 * F.col("_side") * F.col("_margin")))
                learner = RandomForestRegressor(
                    labelCol="_target", numTrees=1, bootstrap=False, maxBins=256, cacheNodeIds=True, seed=tree_seed,
                    maxDepth=int(params["max_depth"]), minInstancesPerNode=int(params.get("min_child_weight", 1)),
                    subsamplingRate=float(params.get("subsample", 1.0)),
                    featureSubsetStrategy=str(float(params.get("colsample_bytree", 1.0))),
                )
                fitted = learner.fit(rows.withColumn("_target", target))
                tree, n_features = fitted.trees[0], fitted.numFeatures
                trees.append(tree)
                weights.append(1.0 if m == 0 else rate)
                rows = with_tree(rows, tree, "_new").withColumn("_margin", F.col("_margin") + weights[m] * F.col("_new")).drop("_new")
                held = with_tree(held, tree, f"_tree_{m}")
                new.append(weights[m] * F.col(f"_tree_{m}"))
            staged = held.select("features", "_label", running_sums(new, F.col("_margin")).alias("margins"))
            staged = judge.write(staged.withColumn("_margin", F.element_at("margins", -1)))
            found = {r["round"]: r["auc"] for r in staged_auc(staged, "_label", "margins", grid).collect()}
            aucs += [found.get(i + 1) for i in range(len(new))]
            if aucs[-1] is not None and best_round([-a for a in aucs], patience) + patience <= len(trees):
                break
            if len(trees) < most:
                rows, held = learn.write(rows), staged.drop("margins")
        rounds = len(trees) if aucs[-1] is None else best_round([-a for a in aucs], patience)
        return Boosted(as_model(spark, trees[:rounds], weights[:rounds], n_features), rounds, aucs)
    finally:
        learn.close()
        judge.close()
